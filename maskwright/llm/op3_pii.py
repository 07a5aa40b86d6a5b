"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, IP address, payment card, phone) are found by patterns with checks in
every whole text. Each distinct base value is a protected entity. The words within WINDOW
words of a mention are candidate terms; how strongly a term reveals an entity is measured
over the corpus by pointwise mutual information, as a share of the entity's own
information: log(p(term | entity) / p(term)) / -log p(entity). p(term) and p(entity) are
shares of all documents; p(term | entity) is the share of the entity's distinct contexts
that have the term, so copies of one text count once, shrunk towards p(term) by PRIOR
contexts drawn from all documents: (together + PRIOR * p(term)) / (contexts + PRIOR). So
an entity of any number of contexts is judged, one that is seen once by its rarest terms
only. A term whose share reaches DISCLOSURE is a span too, wherever it stands in a context
of that entity. In the output text a span is generalised to its kind; terms with digits
become [CODE], other terms are removed as [REDACTED].

Documents are read twice, by Arrow batches: once for spans and contexts, once for the
document frequency of the candidate terms. Only small rows are stored or moved. The
candidate terms go to the tasks as a Bloom filter of BITS bits, whatever their number is:
each task counts its words, lets those through that the filter knows, and the sums are
joined with the candidates. More candidates let more words through; nothing else changes.

Defined cases: null text is the empty text, with no spans; repeated rows have a result
each and count as one context; equal starts are ordered by kind as listed; overlapping
spans are all reported and rewritten as one, labelled by the first; extra columns are
kept as they are by sanitise(); n_chars, if there, is that of the new text.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import TEXTS, bounded, released, stored, table

KINDS = ["email", "ip", "card", "phone", "term"]
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[REDACTED]"]
WINDOW = 8
PRIOR = 10
DISCLOSURE = 0.5
BITS = 1 << 22
#: Words that a task counts at once.
COUNTED = 400_000

NAME = frozenset((string.ascii_letters + string.digits + "._%+-"))
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Digit runs are taken whole, so a match can only begin where a run begins.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PUNCTUATION = re.compile(r"([!-/:-@\[-`{-~]+)")
#: Terms are compared in lower case (A-Z) with ASCII punctuation as space.
PLAIN = bytes.maketrans(string.punctuation.encode() + string.ascii_uppercase.encode(), b" " * len(string.punctuation) + string.ascii_lowercase.encode())


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is tried with the whole run of name characters before it, which is where a leftmost match begins."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in NAME:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) in code points, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(out)


def entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, str, int, int]]:
    """(entity, hash of the context, term, start, end) for the terms around each mention."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    free = _outside(words, spans)
    out, k = [], 0
    for a, kind, b in spans:
        while k < len(words) and words[k][1] <= a:
            k += 1
        last = k
        while last < len(words) and words[last][0] < b:
            last += 1
        around = [*range(max(0, k - WINDOW), k), *range(last, min(len(words), last + WINDOW))]
        own = " ".join(text[words[i][0] : words[i][1]] for i in around).lower().encode()
        mark = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
        name = entity(kind, text[a:b])
        out += [(name, mark, *term) for i in around if free[i] for term in _terms(text, *words[i])]
    return out


def _outside(words: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each word is clear of all spans (both sorted by start)."""
    out, reach, k = [], 0, 0
    for a, b in words:
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][2])
            k += 1
        out.append(reach <= a)
    return out


def _terms(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """The parts of a word between ASCII punctuation, of three characters or more, that aren't numbers."""
    at = start
    for part in PUNCTUATION.split(text[start:end]):
        if len(part) >= 3 and part[0] not in string.punctuation and not part.isdigit():
            yield part.encode().translate(PLAIN).decode(), at, at + len(part)
        at += len(part)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, near array<struct<entity:string,context:long,term:string,start:int,end:int>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        counts, digests, base, near = [], [], [], []
        for x in batch.column(2):
            text = x.as_py() or ""
            spans = base_spans(text)
            counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
            digests.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            base.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
            near.append([dict(zip(("entity", "context", "term", "start", "end"), c)) for c in contexts(text, spans)] if spans else [])
        columns = [batch.column(0), batch.column(1), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(base, spans_type), pa.array(near, near_type)]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])
    released()


def bloom(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms; at most BITS / 64 rows come to the driver."""
    h = F.xxhash64("term")
    bits = terms.select(F.explode(F.array(h, F.shiftrightunsigned(h, 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit(BITS - 1)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    out = np.zeros(max(1, BITS // 64), np.int64)
    for r in words.toLocalIterator():
        out[r["at"]] = r["word"]
    return out


def _counted(known: np.ndarray, counted: int) -> Callable:
    bits, mask = known.tobytes(), 64 * len(known) - 1

    def passes(word: bytes) -> bool:
        h = xxhash.xxh64_intdigest(word, 42)
        a, b = h & mask, (h >> 32) & mask
        return bool(bits[a >> 3] >> (a & 7) & bits[b >> 3] >> (b & 7) & 1)

    def emitted(kept: Counter) -> pa.RecordBatch:
        names = list(kept)
        return pa.RecordBatch.from_arrays([pa.array([n.decode() for n in names], pa.string()), pa.array([kept[n] for n in names], pa.int64())], ["term", "documents"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        kept: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                seen.update(set((x.as_py() or b"").translate(PLAIN).split()))
                if len(seen) >= counted:
                    kept.update({w: n for w, n in seen.items() if passes(w)})
                    seen.clear()
                    if len(kept) >= counted:
                        yield emitted(kept)
                        kept.clear()
        kept.update({w: n for w, n in seen.items() if passes(w)})
        seen.clear()
        yield emitted(kept)
        kept.clear()
        released()

    return run


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, documents: in how many of all documents each term is. Words that are no terms may be among them."""
    parts = docs.select(F.col("text").cast("binary")).mapInArrow(_counted(bloom(terms), COUNTED), "term string, documents long")
    return parts.groupBy("term").agg(F.sum("documents").alias("documents"))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """entity, term: the terms that reveal an entity beyond DISCLOSURE."""
    near = found.select(F.inline("near")).select("entity", "context", "term").distinct()
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("together"))
    pairs = stored(pairs)
    entities = near.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("contexts"))
    total = docs.count()
    frequency = document_frequency(docs, pairs.select("term").distinct())
    rows = pairs.join(entities, "entity").join(frequency, "term")
    alone, own = F.least(F.col("documents") / total, F.lit(1.0)), F.col("contexts") / (total + F.col("contexts"))
    given = (F.col("together") + PRIOR * alone) / (F.col("contexts") + PRIOR)
    return rows.filter(F.log2(given / alone) >= DISCLOSURE * -F.log2(own)).select("entity", "term")


def spans(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_hash, counts, base_sha256 and all (array of start, kind, end, in order)."""
    found = stored(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_found, FOUND), TEXTS)
    terms = found.select("doc_id", "text_hash", F.inline("near")).join(bounded(stored(disclosing(found, docs), TEXTS)), ["entity", "term"])
    more = terms.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("more"))
    same = F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_hash") == F.col("m.text_hash"))
    rows = found.drop("near").alias("f").join(stored(more).alias("m"), same, "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more")))
    return rows.select("f.doc_id", "f.text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", every.alias("all"))


def rewritten(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with each run of overlapping spans replaced by the label of its first span."""
    out, at = [], 0
    for a, kind, b in found:
        if a >= at:
            out += [text[at:a], "[CODE]" if kind == 4 and DIGITS.search(text[a:b]) else LABELS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _rewrite(texts: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or f is None or not len(f) else rewritten(t, [(s["start"], s["kind"], s["end"]) for s in f]) for t, f in zip(texts, found)], dtype="object")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data in text generalised or removed, other columns as they were.

    Texts without a span are not moved, while the keys of the others are few enough to be broadcast.
    """
    hit = stored(spans(docs).filter(F.size("all") > 0).select("doc_id", "text_hash", "all").dropDuplicates(["doc_id", "text_hash"]))
    keys = bounded(hit.select("doc_id", "text_hash")).alias("k")
    same = lambda other: F.col("d.doc_id").cast("long").eqNullSafe(F.col(f"{other}.doc_id")) & (F.xxhash64("d.text") == F.col(f"{other}.text_hash"))
    clean = docs.alias("d").join(keys, same("k"), "left_anti")
    rows = docs.alias("d").join(keys, same("k"), "left_semi").alias("d").join(hit.alias("h"), same("h")).select("d.*", F.col("h.all").alias("__spans"))
    rows = rows.withColumn("text", F.pandas_udf(_rewrite, "string")("text", "__spans"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean.unionByName(rows.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))
    found = spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(F.transform("all", one), ",").alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)
