"""Tables between steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows that spread() gives to a task at most.
ROWS_A_TASK = 10_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt to at least all cores: a file of short rows is one split, however much work each of its rows makes."""
    rows = df.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return df.repartition(max(1, min(tasks, rows)))


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back, so that several uses do not run the plan behind it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwright-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
