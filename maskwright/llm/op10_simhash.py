"""SimHash near-duplicates: fingerprints linked by a binary trie self-join.

A fingerprint is taken of every whole text: A-Z lower-cased, words split at
[\\x20\\x09-\\x0D]+, 4-word shingles with repeats hashed by XXH64 (seed 42), and a bit set
if it is set in over half the hashes. Distinct fingerprints, each with its smallest
doc_id, are then linked if they differ in at most BUDGET bits, and components of the links
come from star contractions, all as tables: no fingerprint, link or component goes to the
driver.

The trie join walks pairs of nodes of a binary trie together, from the first bit to the
last, adds up differing bits and drops a pair beyond the budget. To deal one trie out to
many tasks, the 64 bits are cut into blocks: fingerprints within 4 bits agree wholly in all
but 4 blocks, so for each choice of that many blocks the fingerprints that agree in them
make one trie, and each link is in at least one of these tries. The number of blocks
follows the number of fingerprints, so that a trie holds about TRIE fingerprints at any
size. Within a trie, links of one differing bit are joined first; the walk then drops
pairs of nodes that are already one component as a whole, and takes the frontier piece by
piece, so a dense family of copies neither multiplies rows nor fills memory. A task emits
a star, at most one row a fingerprint and trie.

Defined cases: null text is the empty text, whose fingerprint is zero and links like any
other; exact copies share a fingerprint; rows with a null doc_id get their fingerprint
and the component of its other documents, null if there is none; repeated rows keep their
own result row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import bounded, stored, table
from maskwright.llm.graph import components

BUDGET = 4
SHINGLE = 4
SEED = 42
TRIE = 256
#: Pairs of nodes that are walked at once.
FRONTIER = 1 << 19


def fingerprint(text: bytes | None) -> int:
    """bytes.lower() and bytes.split() work on A-Z and on [\\x20\\x09-\\x0D] alone."""
    words = text.lower().split() if text else []
    n, plain = len(words), b" ".join(words)
    if not n:
        return 0
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(plain, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(plain[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(x.as_py()) for x in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], ["doc_id", "text_hash", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary")).mapInArrow(_fingerprints, "doc_id long, text_hash long, mark long")


def block_choices(n: int) -> list[list[tuple[int, int]]]:
    """Choices of blocks (low bit, width) for n fingerprints; each pair within BUDGET agrees in one choice."""
    for blocks in range(BUDGET + 1, BUDGET + 5):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        spans = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        choices = [list(c) for c in combinations(spans, blocks - BUDGET)]
        if n >> min(sum(w for _, w in c) for c in choices) <= TRIE:
            break
    return choices


def _key(mark: Column, choice: list[tuple[int, int]]) -> Column:
    """The bits of the chosen blocks, put side by side (at most 32)."""
    out = F.lit(0).cast("long")
    for low, width in choice:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(mark, low).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return out


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels with a and b joined; a label is the smallest index of its component."""
    while len(a):
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(short := labels[labels], labels):
            labels = short
    return labels


def trie_labels(tries: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """tries, marks: sorted together, distinct. Labels (smallest index) of the components of the links in each trie."""
    n = len(marks)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, tries[1:] != tries[:-1]])
    stops = np.r_[starts[1:], n]
    # First the links of one differing bit, where a trie is large enough for that to pay.
    for lo, hi in zip(starts, stops):
        if hi - lo > 2 * TRIE:
            own = marks[lo:hi]
            for bit in range(64):
                other = own ^ np.uint64(1 << bit)
                at = np.minimum(np.searchsorted(own, other), hi - lo - 1)
                hit = np.flatnonzero((own[at] == other) & (at > np.arange(hi - lo)))
                labels = _union(labels, lo + hit, lo + at[hit])
    # Prefix counts: of set bits, for where a node divides; of label changes, for whether it is one component.
    more = starts[stops - starts > 1]
    stack = [(63, *(x.astype(np.int64) for x in (more, stops[np.searchsorted(starts, more)], more, stops[np.searchsorted(starts, more)], np.zeros(len(more)))))]
    while stack:
        bit, lo1, hi1, lo2, hi2, off = stack.pop()
        if len(lo1) > FRONTIER:
            half = len(lo1) // 2
            stack += [(bit, *(x[half:] for x in (lo1, hi1, lo2, hi2, off))), (bit, *(x[:half] for x in (lo1, hi1, lo2, hi2, off)))]
            continue
        # Two leaves are compared at once.
        leaves = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        a, b = lo1[leaves], lo2[leaves]
        near = np.bitwise_count(marks[a] ^ marks[b]) <= BUDGET
        labels = _union(labels, a[near], b[near])
        lo1, hi1, lo2, hi2, off = (x[~leaves] for x in (lo1, hi1, lo2, hi2, off))
        if not len(lo1) or bit < 0:
            continue
        changes = np.r_[0, np.cumsum(labels[1:] != labels[:-1])]
        joined = (changes[hi1 - 1] == changes[lo1]) & (changes[hi2 - 1] == changes[lo2]) & (labels[lo1] == labels[lo2])
        lo1, hi1, lo2, hi2, off = (x[~joined] for x in (lo1, hi1, lo2, hi2, off))
        if not len(lo1):
            continue
        ones = np.r_[0, np.cumsum((marks >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        same = (lo1 == lo2) & (hi1 == hi2)
        out = []
        for c1, d1, c2, d2, add, keep in ((lo1, mid1, lo2, mid2, 0, None), (mid1, hi1, mid2, hi2, 0, None), (lo1, mid1, mid2, hi2, 1, None), (mid1, hi1, lo2, mid2, 1, ~same)):
            ok = (d1 > c1) & (d2 > c2) & (off + add <= BUDGET)
            if keep is not None:
                ok &= keep
            ok &= ~((c1 == c2) & (d1 - c1 == 1))
            out.append((c1[ok], d1[ok], c2[ok], d2[ok], off[ok] + add))
        merged = [np.concatenate(x) for x in zip(*out)]
        if len(merged[0]):
            stack.append((bit - 1, *merged))
    return labels


def _trie_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows trie, mark, doc sorted by trie and mark -> stars a, b of smallest documents."""

    def stars(trie: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        labels = trie_labels(trie, mark.view(np.uint64))
        # The centre of a star is the smallest document, so stars of one component tend to meet.
        least = np.full(len(doc), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, doc)
        centre = least[labels]
        linked = centre != doc
        return pa.RecordBatch.from_arrays([pa.array(doc[linked]), pa.array(centre[linked])], ["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        trie, mark, doc = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(trie, trie[-1])) if len(trie) else 0
        if cut and len(trie) >= 20_000:
            yield stars(*_in_order(trie[:cut], mark[:cut], doc[:cut]))
            trie, mark, doc = trie[cut:], mark[cut:], doc[cut:]
        held = [[trie, mark, doc]]
    if held and len(held[0][0]):
        yield stars(*_in_order(*held[0]))


def _in_order(trie: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((mark.view(np.uint64), trie))
    return trie[order], mark[order], doc[order]


def links(distinct: DataFrame) -> DataFrame:
    """distinct: mark, doc (smallest doc_id) -> star edges a, b."""
    n = distinct.count()
    tries = [F.struct(F.xxhash64(F.lit(i), _key(F.col("mark"), choice)).alias("trie")) for i, choice in enumerate(block_choices(n))]
    rows = distinct.select("mark", "doc", F.inline(F.array(*tries))).select("trie", "mark", "doc")
    return rows.repartition("trie").sortWithinPartitions("trie").mapInArrow(_trie_join, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_hash, mark (the fingerprint as a signed long), component_id."""
    marked = stored(fingerprints(docs))
    distinct = stored(marked.groupBy("mark").agg(F.min("doc_id").alias("doc")))
    roots = components(links(distinct.filter(F.col("doc").isNotNull())))
    classes = distinct.join(roots, distinct.doc == roots.node, "left").select("mark", F.coalesce("root", "doc").alias("component_id"))
    return marked.join(stored(classes), "mark").select("doc_id", "text_hash", "mark", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest doc_id stays, and of rows that repeat it, one.

    Rows with a null doc_id stay unless their component has a document with one.
    """
    found = stored(near_duplicates(docs))
    gone = bounded(stored(found.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()))
    rest = docs.withColumn("__hash", F.xxhash64("text")).alias("d")
    same = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("d.__hash") == F.col(f"{other}.text_hash"))
    rest = rest.join(gone.alias("g"), same("g"), "left_anti").alias("d")
    twice = bounded(stored(found.groupBy("doc_id", "text_hash").count().filter((F.col("count") > 1) & F.col("doc_id").isNotNull()).select("doc_id", "text_hash")))
    once = rest.join(twice.alias("t"), same("t"), "left_anti")
    again = rest.join(twice.alias("t"), same("t"), "left_semi").dropDuplicates(["doc_id", "__hash"])
    return once.unionByName(again).select(*docs.columns)
