"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 100 words, all of its text. A passage is encoded from
its words, by learned embeddings of hashed words, and from shares of its byte classes, common
and repeated words and word lengths; gated attention and the weighted mean of the encoded
passages give the score (see mil). The model is fitted on at most SAMPLE labelled documents,
those with the smallest hash of doc_id among the rows that may be learnt from, as long as
they have at most PASSAGES passages together; one that would exceed that is left out. Only
their passages come to the driver, some 270 bytes each. Every document is then scored in one
pass without a shuffle.

Neither labels nor lang, source or doc_id enter a score. Defined cases: null and empty
texts are a bag of one empty passage; a doc_id with several labels has the smallest; null
labels and null doc_ids are not learnt from; of several texts of a doc_id the smallest is; without both labels the score is the smoothed
share of label 1; repeated rows are scored each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import mil
from maskwright.llm.common import stored, table

#: The bounds of the labelled sample.
SAMPLE, PASSAGES = 8000, 100_000
CHUNK = 256


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [mil.passages(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(b.words) for b in bags], pa.int64()), pa.array([b.packed() for b in bags], pa.binary())], ["doc_id", "label", "passages", "bag"])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict[str, np.ndarray]:
    """Weights learnt from the rows that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("long")).alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").cast("binary").alias("text"))
    bags = stored(rows.mapInArrow(_bags, "doc_id long, label long, passages long, bag binary"))
    taken, total = [], 0
    for r in bags.select("doc_id", "passages").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r.passages <= PASSAGES:
            taken.append((r.doc_id,))
            total += r.passages
    keys = docs.sparkSession.createDataFrame(taken, "doc_id long")
    found = sorted(bags.join(F.broadcast(keys), "doc_id").collect(), key=lambda r: r.doc_id)
    return mil.fit([mil.unpacked(bytes(r.bag)) for r in found], np.array([float(r.label > 0) for r in found]))


def _scored(weights: dict[str, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                score, attention = mil.score(weights, [mil.passages(x.as_py()) for x in batch.column(2)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([x.astype(np.float32) for x in attention], pa.list_(pa.float32()))], ["doc_id", "held_out", "score", "attention"])

    return run


def scored(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """One row a document: doc_id, held_out, score, attention of each passage."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary"))
    return rows.mapInArrow(_scored(weights), "doc_id long, held_out boolean, score double, attention array<float>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
