"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least THRESHOLD of the item's distinct five-word
shingles are shingles of the document. Words are lower-cased runs of letters and digits;
a text of one to four words is one shingle, its whole sequence, and no words none.

Items are partitioned by size (number of distinct shingles, in powers of two). In a
partition whose largest size is u, the sketch of an item is its u - ceil(THRESHOLD * u) + 1
smallest shingle hashes, a bottom-k MinHash. An item contained to THRESHOLD misses at most
size - ceil(THRESHOLD * size) shingles, so at least one hash of its sketch is in the
document: the search loses no pair however long the document is, where signatures of
whole documents would need thousands of hash functions. Every document, whole, probes the
sketches; what it meets is verified by exact containment of the shingles' words.

The sketches are broadcast if the benchmark's texts measure at most BROADCAST_BYTES;
beyond it Spark joins by the hash, and divides hot hashes as it does any skewed join. Of
the texts only those that met a sketch are moved, while their keys are few enough to be
broadcast.

Defined cases: null and empty texts have no shingles and meet nothing; repeated rows are
one document each, found together; rows with a null item_id are no items; ties do not
arise; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import bounded, let, shingle_hashes, stored, table, text_or_empty

THRESHOLD_PERCENT = 80
WORDS = 5
BROADCAST_BYTES = 32 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _hashes(words: Column) -> Column:
    few = lambda w: F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return let(words, lambda w: F.when(F.size(w) >= WORDS, shingle_hashes(w, WORDS)).otherwise(few(w)))


def _shingles(words: Column) -> Column:
    """The distinct shingles as strings, for the exact test."""
    def whole(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), lambda i: F.array_join(F.slice(w, i, WORDS), " "))
        few = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.when(F.size(w) >= WORDS, many).otherwise(few))

    return let(words, whole)


def _least(n: Column) -> Column:
    """ceil(THRESHOLD * n) in whole numbers."""
    return F.expr("cast(0 as bigint)") + F.floor((n * THRESHOLD_PERCENT + 99) / 100)


def sketches(benchmark: DataFrame) -> DataFrame:
    """One row an item: item_id, shingles, size_class, sketch."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", _shingles(_words(text_or_empty())).alias("shingles"), F.array_distinct(_hashes(_words(text_or_empty()))).alias("hashes"))
    items = items.filter(F.size("hashes") > 0).withColumn("size_class", F.floor(F.log2(F.size("hashes").cast("double"))).cast("int"))
    largest = F.pow(F.lit(2), F.col("size_class") + 1).cast("long") - 1
    kept = (largest - _least(largest) + 1).cast("int")
    return items.select("item_id", "shingles", "size_class", F.slice(F.sort_array("hashes"), F.lit(1), kept).alias("sketch"))


def _same(docs: str, keys: str) -> Column:
    """Whether a document, by doc_id and text, is the one of a key."""
    return F.col(f"{docs}.doc_id").eqNullSafe(F.col(f"{keys}.doc_id")) & (F.xxhash64(f"{docs}.text") == F.col(f"{keys}.text_hash"))


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a pair: doc_id, text_hash, item_id, n_shared, n_shingles, containment."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small = F.broadcast if total <= BROADCAST_BYTES else (lambda df: df)
    items = stored(sketches(benchmark))
    probes = small(items.select("item_id", F.explode("sketch").alias("hash")))
    # explode() would have Spark test the array for being empty first, by making it twice.
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode_outer(_hashes(_words(text_or_empty()))).alias("hash"))
    met = stored(rows.join(probes, "hash").select("doc_id", "text_hash", "item_id").distinct())
    # The texts of the documents that met an item, without moving the others.
    keys = bounded(stored(met.select("doc_id", "text_hash").distinct())).alias("k")
    texts = docs.select("doc_id", "text").alias("d").join(keys, _same("d", "k"), "left_semi").distinct()
    lists = met.join(small(items.select("item_id", "shingles")), "item_id").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "shingles")).alias("items"))
    exact = texts.alias("d").join(lists.alias("m"), _same("d", "m"))
    shared = lambda own: F.transform("items", lambda x: F.struct(x.item_id.alias("item_id"), F.size(F.array_intersect(x.shingles, own)).cast("long").alias("n_shared"), F.size(x.shingles).cast("long").alias("n_shingles")))
    pairs = exact.select("d.doc_id", "text_hash", F.inline_outer(let(_shingles(_words(text_or_empty("d.text"))), shared)))
    pairs = pairs.filter(F.col("n_shared") * 100 >= F.col("n_shingles") * THRESHOLD_PERCENT)
    return pairs.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, all columns as they were."""
    found = bounded(stored(contained(docs, benchmark).select("doc_id", "text_hash").distinct()))
    return docs.alias("d").join(found.alias("f"), _same("d", "f"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment
FROM j JOIN n USING (item_id) WHERE n_shared * 100 >= n_shingles * 80
"""
