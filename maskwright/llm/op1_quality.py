"""Quality rules: Jensen-Shannon distance of a document's histograms to a language reference.

Two histograms are taken of every whole text: characters by class (lower-case letter,
upper-case letter, digit, space, symbol, other) and words by membership in the common
words of the document's language (one bin a word, one for all others). The reference of
a language is the pooled histogram of all its documents of at least MIN_WORDS words. A
document is rejected if either distance exceeds its threshold; a text shorter than the
guards is too small a sample and is judged by the base rules alone.

One projection with built-in functions reads the texts once and stores a small row a
document. The references are a sum over those rows: at most len(COMMON) + 1 rows a task,
since languages without a list share the bin "other", and that bound, not the data, sets
the size of the broadcast. quality_rules() takes the rejected keys out of the documents by
an anti-join, broadcast or not as Spark finds their size.

Defined cases: null text is the empty text (base_failed); null or unknown language uses
the reference "other", which has no word histogram; repeated rows are judged each; extra
columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import SPACES, bounded, let, shingle_hashes, stored, table, text_or_empty, words_of

#: Twenty common words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is that it was for on are with as be at by this from or".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "le la les de des du un une et en que qui dans pour par sur au avec est pas".split(),
}
BINS = 21
#: Classes of characters; the last class is what is in none of them.
CLASSES = ["\\p{Ll}", "\\p{Lu}", "\\p{Nd}", SPACES, "#*$%&|<>"]
MIN_WORDS = 50
MIN_CHARS = 250
MAX_CLASS_DISTANCE = 0.29
MAX_WORD_DISTANCE = 0.36
#: A document that is beyond both of these is rejected too: both histograms are off at once.
BOTH_CLASS_DISTANCE, BOTH_WORD_DISTANCE = 0.13, 0.30


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit("other"))


def _common(language: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, words in COMMON.items():
        out = F.when(language == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def _class_counts(text: Column) -> Column:
    counts = [F.length(F.regexp_replace(text, f"[^{c}]+", "")).cast("long") for c in CLASSES]
    return let(F.array(*counts), lambda c: F.concat(c, F.array(F.length(text) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))


def _word_counts(words: Column, language: Column) -> Column:
    """BINS counts: a bin for each common word, zeros where a language has no list, and the rest."""
    return let(
        _common(language),
        lambda common: let(
            F.filter(words, lambda w: F.array_contains(common, w)),
            lambda kept: F.concat(
                F.transform(common, lambda w: (F.size(kept) - F.size(F.array_remove(kept, w))).cast("long")),
                F.array_repeat(F.lit(0).cast("long"), F.lit(BINS - 1) - F.size(common)),
                F.array((F.size(words) - F.size(kept)).cast("long")),
            ),
        ),
    )


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of counts; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def divergence(n: Column, m: Column) -> Column:
        shares = F.zip_with(counts, reference, lambda c, r: F.struct((c / n).alias("p"), (r / m).alias("q")))
        return F.aggregate(shares, F.lit(0.0), lambda s, x: s + (part(x.p, (x.p + x.q) / 2) + part(x.q, (x.p + x.q) / 2)) / 2)

    return F.when((total(counts) > 0) & (total(reference) > 0), let(total(counts), lambda n: let(total(reference), lambda m: F.sqrt(F.greatest(divergence(n, m), F.lit(0.0)))))).otherwise(F.lit(0.0))


def references(features: DataFrame) -> DataFrame:
    """One row a language, six at most: language, class_reference, word_reference (summed counts)."""
    enough = lambda x: F.coalesce(F.sum(F.when(F.col("n_words") >= MIN_WORDS, x)), F.lit(0).cast("long"))
    sums = lambda name, n: F.array(*[enough(F.get(name, F.lit(i))) for i in range(n)])
    return features.groupBy("language").agg(sums("class_counts", len(CLASSES) + 1).alias("class_reference"), sums("word_counts", BINS).alias("word_reference"))


def _repeated_words(words: Column, k: int = 5) -> Column:
    """How many words lie in k-word windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, i: F.coalesce(e.h == F.get(s, i - 1).h, F.lit(False)) | F.coalesce(e.h == F.get(s, i + 1).h, F.lit(False)))
        starts = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda e: e.i)))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x))

    return let(shingle_hashes(words, k), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def features(docs: DataFrame) -> DataFrame:
    """One row a document: its key, the counts of the base rules and both histograms, stored."""
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    from_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).cast("long").alias("n_repeat_words"),
        _word_counts(w, _language(F.col("lang"))).alias("word_counts"),
    )
    rows = docs.select(
        *_key(),
        _language(F.col("lang")).alias("language"),
        F.inline(F.transform(F.array(words_of(text_or_empty())), from_words)),
        _class_counts(text_or_empty()).alias("class_counts"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    return stored(rows)


def _key() -> list[Column]:
    """What a verdict hangs on: equal keys have equal verdicts, whatever else the rows hold."""
    return [F.col("doc_id"), F.col("lang"), F.xxhash64("text").alias("text_hash")]


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def verdicts(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, lang, text_hash and RESULT."""
    found = features(docs)
    judged = (F.col("n_words") >= MIN_WORDS) & (F.col("word_chars") >= MIN_CHARS)
    distance = lambda counts, reference: F.coalesce(F.when(judged, F.round(_distance(F.col(counts), F.col(reference)), 6)), F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE)
    near &= (F.col("class_distance") <= BOTH_CLASS_DISTANCE) | (F.col("word_distance") <= BOTH_WORD_DISTANCE)
    return (
        found.join(F.broadcast(references(found)), "language")
        .withColumn("class_distance", distance("class_counts", "class_reference"))
        .withColumn("word_distance", distance("word_counts", "word_reference"))
        .withColumn("n_symbols", F.get("class_counts", F.lit(4)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & near)
        .select("doc_id", "lang", "text_hash", *RESULT)
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all columns as they were."""
    rejected = bounded(stored(verdicts(docs).filter(~F.col("kept")).select("doc_id", "lang", "text_hash").distinct()))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "lang")]
    return docs.alias("d").join(rejected.alias("r"), [*same, F.xxhash64("d.text") == F.col("r.text_hash")], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", *RESULT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs)


def _oracle() -> str:
    lists = " ".join(f"WHEN '{name}' THEN [{', '.join(repr(w) for w in words)}]" for name, words in COMMON.items())
    classes = ", ".join(f"length(regexp_replace(t, '[^{c}]+', '', 'g'))" for c in CLASSES)
    total = lambda name, n: "[" + ", ".join(f"coalesce(sum({name}[{i}]) FILTER (n_words >= {MIN_WORDS}), 0)::DOUBLE" for i in range(1, n + 1)) + "]"

    def distance(counts: str, reference: str, n: int) -> str:
        p, q = f"({counts}[i] / list_sum({counts}))", f"({reference}[i] / list_sum({reference}))"
        part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
        whole = f"sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: ({part(p)} + {part(q)}) / 2)), 0))"
        return f"CASE WHEN n_words >= {MIN_WORDS} AND word_chars >= {MIN_CHARS} AND list_sum({counts}) > 0 AND list_sum({reference}) > 0 THEN round({whole}, 6) ELSE 0.0 END"

    return f"""
WITH a AS (SELECT doc_id, CASE WHEN lang IN ({', '.join(repr(x) for x in COMMON)}) THEN lang ELSE 'other' END AS language, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, list_filter(string_split_regex(t, '[{SPACES}]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS lines,
  CASE language {lists} ELSE [] END AS common FROM a),
c AS (SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines, [{classes}] AS part,
  list_transform(common, lambda x: len(list_filter(w, lambda y: y = x))) AS hits FROM b),
d AS (SELECT *, list_append(part, length(t) - list_sum(part)) AS cc, list_concat(list_concat(hits, list_transform(range(0, {BINS - 1} - len(hits)), lambda x: 0)), [n_words - coalesce(list_sum(hits), 0)]) AS wc FROM c),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) >= 5),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1), (VALUES (0), (1), (2), (3), (4)) AS v(k) GROUP BY doc_id),
f AS (SELECT language, {total('cc', len(CLASSES) + 1)} AS cr, {total('wc', BINS)} AS wr FROM d GROUP BY language),
x AS (SELECT d.doc_id, n_words, word_chars, cc[5] AS n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  {distance('cc', 'cr', len(CLASSES) + 1)} AS class_distance, {distance('wc', 'wr', BINS)} AS word_distance
  FROM d JOIN f USING (language) LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND class_distance <= {MAX_CLASS_DISTANCE} AND word_distance <= {MAX_WORD_DISTANCE}
  AND (class_distance <= {BOTH_CLASS_DISTANCE} OR word_distance <= {BOTH_WORD_DISTANCE}) AS kept FROM x
"""


ORACLE_SQL = _oracle()
