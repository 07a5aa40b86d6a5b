"""Hierarchical residual packing of tokenised documents into fixed-length sequences.

Documents are tokenised whole, an end id is put behind each, and only those longer than a
sequence are cut, into full pieces with the shorter one first. Full pieces are sequences
by themselves. The others are dealt evenly to groups of about GROUP pieces, packed there
by best fit in falling order of length, and bins with at most SLACK free places are
emitted. Underfull bins go on as items: FAN groups are merged and packed again, round by
round, until one group is left.

Of the underfull bins of a group the KEEP emptiest go on. No sequence is lost by that: best
fit opens a bin only for an item that fits in no other, so any two bins of a group exceed a
sequence together, and at most one of them is half empty or less. Bins that are joined later
hold at most one that is over half full, so FAN groups have at most FAN bins that can be
added to others, and each needs one host, for which any emptier bin does as well. KEEP is
far above FAN.

Rounds hold bins, not pieces: a round gives each of its items its bin and its offset there,
and the places of the pieces come from going up through the rounds. So no group of any round
has more than about GROUP, or FAN * KEEP, rows, whatever the lengths are. Each round is a
stored table; no list of pieces goes to the driver.

Defined cases: null text is the empty text, which is its end id alone; ties in length are
packed in any order; repeated rows are packed each; rows with a null doc_id are packed and
keep it; extra columns are not read; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe
from maskwright.llm.common import bounded, stored, table

LENGTH = 2048
END_ID = 0
GROUP = 4096
FAN = 16
KEEP = 256
SLACK = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of n ids."""
    first = n if n <= length else n % length or length
    return [(0, first), *((a, a + length) for a in range(first, n, length))]


def _tokenised(path: str, length: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = bpe.encoder(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                for k, (a, b) in enumerate(cut(len(ids) // 4, length)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), part if with_ids else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def tokenised(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenised(path or bpe.default_path(), length, with_ids), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the used length of each bin, by best fit in falling order."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0  # bit g is set if a bin has g free places
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        if fits := has >> size:
            gap = size + (fits & -fits).bit_length() - 1
            at = free[gap].pop()
            if not free[gap]:
                has ^= 1 << gap
        else:
            at, gap = len(used), capacity
            used.append(0)
        bins[i], offsets[i] = at, used[at]
        used[at] += size
        if gap := gap - size:
            free[gap].append(at)
            has |= 1 << gap
    return bins, offsets, np.array(used, np.int64)


ROUND = "node long, parent long, parent_length long, offset long, grp long, done boolean"


def _round(number: int, capacity: int, last: bool, keep: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("node_length", "descending"), ("node", "ascending")])
        group, node, size = rows.column("grp")[0].as_py(), rows.column("node").to_numpy(), rows.column("node_length").to_numpy()
        bins, offsets, used = best_fit(size, capacity)
        done = np.full(len(used), last)
        done |= used >= capacity - SLACK
        done[np.argsort(used, kind="stable")[keep:]] = True
        columns = [node, (number << 58) + (group << 20) + bins, used[bins], offsets, np.full(len(node), group), done[bins]]
        return pa.table([pa.array(c) for c in columns], [x.split()[0] for x in ROUND.split(", ")])

    return run


def packed(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces (row: unique long, length: long) -> row, sequence_id, offset."""
    full = pieces.filter(F.col("length") >= length).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < length)
    groups = max(1, -(-items.count() // GROUP))
    nodes = items.select(F.col("row").alias("node"), F.col("length").alias("node_length"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long").alias("grp"))
    rounds: list[DataFrame] = []
    while True:
        rounds.append(stored(nodes.groupBy("grp").applyInArrow(_round(len(rounds) + 1, length, groups == 1, KEEP), ROUND)))
        if groups == 1:
            break
        groups = -(-groups // FAN)
        nodes = rounds[-1].filter("not done").select(F.col("parent").alias("node"), F.col("parent_length").alias("node_length"), F.expr(f"grp div {FAN}").alias("grp")).distinct()
    places = rounds.pop().select("node", F.col("parent").alias("sequence_id"), "offset")
    while rounds:
        above = bounded(stored(places)).select(F.col("node").alias("above"), F.col("sequence_id").alias("last"), F.col("offset").alias("more"))
        own = rounds.pop().join(above, F.col("parent") == F.col("above"), "left")
        places = own.select("node", F.coalesce("last", "parent").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
    return full.union(places)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row a piece: the columns of tokenised() with sequence_id and offset.

    row numbers take part in sequence_id: those of full pieces lie below 1 << 57, others above 1 << 58.
    """
    pieces = stored(tokenised(docs, path, length, with_ids).withColumn("row", F.monotonically_increasing_id()))
    return pieces.join(packed(pieces.select("row", "length"), length), "row").drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
