"""Change streams: duplicates, pending events, policy and retention.

events: seq, ts, app, text, origin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources import inputs, store
from maskwright.sources.tables import stored

POLL = "250 milliseconds"
SWEEP = "300 seconds"


def read_changes(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def accepted(events: DataFrame, apps: list[str], delay: str = "10 minutes") -> DataFrame:
    """Events with text, not written by the engine, once each, while an allowed application is in front."""
    rows = events.filter(F.col("text").isNotNull() & (F.col("text") != "") & (F.coalesce("origin", F.lit("")) != "engine"))
    rows = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["seq"]) if rows.isStreaming else rows.dropDuplicates(["seq"])
    return rows.filter(F.col("app").isin(*apps)) if apps else rows


def pending(events: DataFrame, apps: list[str], source: str) -> DataFrame:
    """The last text of each source, emitted once an allowed application is in front.

    A text that came while another application was in front waits; a newer one takes its place.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, text, done = state.get if state.exists else (-1, "", True)
        out = []
        for rows in batches:
            for r in rows.sort_values("seq").itertuples():
                if r.seq > seq and r.text:
                    seq, text, done = int(r.seq), r.text, False
                if not done and r.app in apps:
                    out.append((key[0], seq, text))
                    done = True
        state.update((seq, text, done))
        yield pd.DataFrame(out, columns=[source, "seq", "text"])

    kind = dict(events.dtypes)[source]
    return events.groupBy(source).applyInPandasWithState(run, f"{source} {kind}, seq long, text string", "seq long, text string, done boolean", "append", "NoTimeout")


def retained(mappings: DataFrame, minutes: int, time: str = "first_seen") -> DataFrame:
    """Extension: of a stream of mappings, counts by the event-time window in which they expire."""
    return mappings.withWatermark(time, f"{minutes} minutes").groupBy(F.window(time, f"{minutes} minutes")).count()


def run_policy(stream: DataFrame, policy: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Applies a batch policy to each micro-batch; the checkpoint folder makes it recover where it stopped."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(policy(batch), n))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def sweep(spark: SparkSession, read: Callable[[], DataFrame], keep: Callable[[DataFrame], None], minutes: int, checkpoint: str, once: bool = False):
    """Retention: mappings older than so many minutes go at the start and then every SWEEP; with 0 minutes all go, at the start only.

    read gives the mapping table as it is, keep puts the rows that stay in its place.
    Returns the running query, or None where only the start counts.
    """

    def purge() -> None:
        keep(stored(store.purged(read(), F.current_timestamp(), minutes)))

    purge()
    if minutes == 0 or once:
        return None
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=SWEEP).foreachBatch(lambda _, n: purge()).start()


def ended(settings: inputs.Settings, archive: DataFrame) -> DataFrame:
    """The archive that stays when a session ends."""
    return store.archive_without(archive) if settings.stash_clear_on_quit else archive


def since_start(events: DataFrame, start: int) -> DataFrame:
    """Without what was there before the watch began: start is the last seq at that time."""
    return events.filter(F.col("seq") > start)
