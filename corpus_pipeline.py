"""A corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import op1_quality, op2_decontaminate, op3_pii, op5_packing, op10_simhash
from maskwright.llm.common import stored, table

STAGES = [
    ("quality_rules", op1_quality.stage),
    ("near_duplicates", op10_simhash.stage),
    ("decontamination", op2_decontaminate.stage),
    ("personal_data", op3_pii.stage),
    ("packing", op5_packing.stage),
]

#: Fingerprint components and byte-level BPE are not expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
