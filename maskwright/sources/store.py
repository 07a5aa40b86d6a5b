"""The mapping table and the archive, as transformations of DataFrames.

mappings: case_id, token, original, first_seen. archive: id, created_at, mode, title,
redacted_text, entity_counts, content_kind, redacted_html, image_path. Writers append the
rows that record() and archived() return, or overwrite with what the purging functions
keep; the archive never holds originals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.sources.tables import stored

MAPPINGS = "case_id string, token string, original string, first_seen timestamp"
ARCHIVE = "id long, created_at timestamp, mode string, title string, redacted_text string, entity_counts map<string,int>, content_kind string, redacted_html string, image_path string"


def record(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new to append: first write wins, by case and token; first_seen of known rows stays."""
    first = new.groupBy("case_id", "token").agg(F.min(F.struct("first_seen", "original")).alias("m"))
    return first.join(existing.select("case_id", "token"), ["case_id", "token"], "left_anti").select("case_id", "token", "m.original", "m.first_seen")


def collisions(mappings: DataFrame, normalise: Column | None = None) -> DataFrame:
    """Tokens of a case that stand for more than one normalised original."""
    from maskwright.functions.tokens import normalised

    return mappings.groupBy("case_id", "token").agg(F.count_distinct(normalise if normalise is not None else normalised(F.col("original"))).alias("originals")).filter("originals > 1")


def restore_case(texts: DataFrame, mappings: DataFrame, text: str = "text") -> DataFrame:
    """texts (case_id, text) with every token of the case replaced, in the order of tokens.

    Replacement is sequential: an original that holds a token is replaced again by a later
    one. A text is joined with the tokens that it holds and with those that their originals
    hold in turn, never with the whole of a large case.
    """
    known = mappings.select("case_id", "token", "original")
    rows = stored(texts.withColumn("__row", F.monotonically_increasing_id()))
    held = lambda df, c: df.filter(T.has_token(F.col(c))).select("__row", "case_id", F.explode_outer(T.extract_tokens(F.col(c))).alias("token"))
    found = stored(held(rows, text).join(known, ["case_id", "token"]))
    while found.filter(T.has_token(F.col("original"))).limit(1).count():
        more = held(found, "original").join(found, ["__row", "token"], "left_anti").distinct().join(known, ["case_id", "token"])
        more = stored(more.select(*found.columns))
        if not more.limit(1).count():
            break
        found = stored(found.union(more))
    lists = found.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("token", "original"))).alias("__m"))
    put = lambda s, m: F.replace(s, m.token, m.original)
    joined = rows.join(lists, "__row", "left")
    return joined.withColumn(text, F.when(F.col("__m").isNull(), F.col(text)).otherwise(F.aggregate("__m", F.col(text), put))).drop("__m", "__row")


def restore_all(texts: DataFrame, mappings: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts with the tokens of any case replaced in order of appearance.

    Tokens of 30 bits may stand for different originals in different cases. Then a case that
    knows every known token of the text goes first; of several such, or without one, the
    earliest mapping counts, then the smallest case.
    """
    known = mappings.select("token", "case_id", "original", "first_seen")
    found = texts.filter(T.has_token(F.col(text))).select(key, F.posexplode(T.extract_tokens(F.col(text))).alias("at", "token"))
    wanted = known.join(found.select("token").distinct(), "token", "left_semi")
    earliest = F.min_by("original", F.struct("first_seen", "case_id"))
    first = wanted.groupBy("token").agg(earliest.alias("original"), (F.min("original") != F.max("original")).alias("several"), F.count("*").alias("cases"))
    lists = found.join(first, "token").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "token", "original"))).alias("__m"), F.max("several").alias("several"), F.min(F.struct("cases", "token"))["token"].alias("rarest"))
    lists = stored(lists)
    # A case that knows all of a text's tokens knows the rarest. With one token all cases do, and the earliest counts.
    unclear = lists.filter(F.col("several") & (F.size("__m") > 1))
    candidates = unclear.join(known.select(F.col("token").alias("rarest"), "case_id"), "rarest").select(key, "case_id", F.size("__m").alias("all"), F.explode("__m.token").alias("token"))
    held = candidates.distinct().join(known, ["case_id", "token"])
    whole = held.groupBy(key, "case_id").agg(F.count_distinct("token").alias("n"), F.first("all").alias("all"), F.collect_list(F.struct("token", "original", "first_seen")).alias("own")).filter("n = all")
    chosen = whole.select(key, "case_id", F.inline("own")).groupBy(key, "token").agg(earliest.alias("original"))
    own = chosen.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("__own"))
    put = lambda s, m: F.replace(s, m.token, F.coalesce(F.element_at("__own", m.token), m.original))
    joined = texts.join(lists.select(key, "__m"), key, "left").join(own, key, "left")
    return joined.withColumn(text, F.when(F.col("__m").isNull(), F.col(text)).otherwise(F.aggregate("__m", F.col(text), put))).drop("__m", "__own")


def purged(mappings: DataFrame, now: Column, minutes: int) -> DataFrame:
    """The mappings that stay when those first seen more than so many minutes ago go."""
    return mappings.filter(F.col("first_seen") >= now - F.make_dt_interval(mins=F.lit(minutes)))


def cleared(mappings: DataFrame, case_id: str | None = None) -> DataFrame:
    """The mappings that stay when one case goes, or all do."""
    return mappings.filter(F.lit(False) if case_id is None else ~F.col("case_id").eqNullSafe(F.lit(case_id)))


def archived(existing: DataFrame, redactions: DataFrame) -> DataFrame:
    """Archive rows for redactions with findings, numbered on from the largest id.

    redactions: created_at, mode, redacted_text, entity_counts, content_kind and, if they have them, redacted_html and image_path.
    Numbers follow created_at: rows are counted within ranges of it, and the ranges are added up.
    """
    have = set(redactions.columns)
    rows = redactions.filter(F.size(F.map_keys("entity_counts")) > 0)
    for c in ("redacted_html", "image_path"):
        if c not in have:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("day", F.to_date("created_at"))
    days = rows.groupBy("day").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = rows.withColumn("own", F.row_number().over(Window.partitionBy("day").orderBy("created_at", "redacted_text")))
    numbered = numbered.join(days.select("day", "before"), "day").join(F.broadcast(last))
    return numbered.select(
        (F.col("last") + F.col("before") + F.col("own")).cast("long").alias("id"), "created_at", "mode", T.title(F.col("redacted_text")).alias("title"), "redacted_text", "entity_counts", "content_kind", "redacted_html", "image_path"
    )


def archive_list(archive: DataFrame) -> DataFrame:
    """The list view, newest first, without bodies."""
    return archive.select("id", T.iso_time(F.col("created_at")).alias("created_at"), "mode", "title", F.to_json("entity_counts").alias("entity_counts"), F.char_length("redacted_text").alias("char_len"), "content_kind").orderBy(F.desc("id"))


def counts_of(text: Column) -> Column:
    """MAP<STRING,INT> of the JSON that the list view has; empty where it is not such JSON."""
    return F.coalesce(F.from_json(text, "map<string,int>"), F.create_map().cast("map<string,int>"))


def archive_content(archive: DataFrame, entry: int) -> DataFrame:
    """One entry's best flavour: image, else HTML, else text. No row if the id is unknown."""
    best = F.when(F.col("image_path").isNotNull(), "image").when(F.col("redacted_html").isNotNull(), "html").otherwise("text")
    return archive.filter(F.col("id") == entry).select("id", best.alias("flavour"), "redacted_text", "redacted_html", "image_path")


def archive_get(archive: DataFrame, entry: int) -> Row:
    """One entry; KeyError if the id is unknown."""
    found = archive.filter(F.col("id") == entry).take(1)
    if not found:
        raise KeyError(f"the archive has no entry {entry}")
    return found[0]


def archive_copy(archive: DataFrame, entry: int, read_image: Callable[[str], bytes] | None = None) -> tuple[str, str | bytes]:
    """The flavour and content to put out for an entry: its image if it can be read, else its HTML, else its text."""
    row = archive_get(archive, entry)
    if row.image_path is not None and read_image is not None:
        try:
            return "image", read_image(row.image_path)
        except OSError:
            pass
    return ("html", row.redacted_html) if row.redacted_html is not None else ("text", row.redacted_text)


def archive_without(archive: DataFrame, entry: int | None = None) -> DataFrame:
    """The archive when one entry goes, or all do."""
    return archive.filter(F.lit(False) if entry is None else ~F.col("id").eqNullSafe(F.lit(entry)))


def orphaned_images(archive: DataFrame, entry: int | None = None) -> DataFrame:
    """image_path of the files that go with an entry, or with all, and that no entry left names."""
    left = archive_without(archive, entry).select("image_path")
    return archive.filter(F.col("image_path").isNotNull()).select("image_path").distinct().join(left, "image_path", "left_anti")


def delete_images(paths: DataFrame) -> int:
    """Deletes the files through Spark's file systems, one by one as the rows arrive; how many were there. Files that are gone already are no error."""
    spark = paths.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, done = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in paths.toLocalIterator():
        path = hadoop.Path(row.image_path)
        done += bool(path.getFileSystem(conf).delete(path, False))
    return done


def with_missing_columns(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a newer schema that it lacks, as nulls; applied twice it changes nothing."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], schema).schema
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in df.columns])


def encrypted(df: DataFrame, key: Column, column: str = "original") -> DataFrame:
    """column as base64 of AES-GCM; applied to a plain table it is the migration to an encrypted one."""
    return df.withColumn(column, F.base64(F.aes_encrypt(F.encode(F.col(column), "UTF-8"), key)))


def decrypted(df: DataFrame, key: Column, column: str = "original") -> DataFrame:
    """column in the clear; null where the key does not fit."""
    return df.withColumn(column, F.decode(F.try_aes_decrypt(F.unbase64(F.col(column)), key), "UTF-8"))


def title_and_length(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", T.title(F.col(text)).alias("title"), F.char_length(text).alias("char_len"))


