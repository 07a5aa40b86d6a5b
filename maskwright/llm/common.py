"""What the operators share: tables, intermediate tables in the shared folder, native word arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a regular-expression class body (fixed values).
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts lineage, and the files outlive any executor. batch: rows of an Arrow batch at most while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwright-{uuid.uuid4().hex}"
    with _batches_of(spark, batch):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of whole texts. Of the usual 10,000 rows the JVM and Python each hold tens of MB a task, several times over.
TEXTS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    usual = spark.conf.get(_BATCH)
    if rows and not 0 < int(usual) <= rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, usual)


#: Parameters of mallopt() of the GNU C library, and the bytes they are set to in held().
_TRIM, _MAPPED, _HELD = -1, -3, 1 << 28


def held() -> None:
    """Lets this Python worker keep the memory of freed arrays for the next ones.

    Else arrays that are made and freed thousands of times a task are mapped by the system, and filled with zeros by it, each time.
    released() gives that memory back all the same.
    """
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no mallopt
        libc = ctypes.CDLL(None)
        libc.mallopt(_MAPPED, _HELD)
        libc.mallopt(_TRIM, _HELD)


def released() -> None:
    """Gives the free memory of this Python worker back, since an idle worker keeps it beside the next task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of keys (a few numbers each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def bounded(keys: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if a count proves it small, else joined as Spark sees fit."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row and bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order."""
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of the k-word windows of an array bound by let(); empty when there are fewer words."""
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))
