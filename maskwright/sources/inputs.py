"""Inputs: readers, classification by size, routing by flavour, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions import values as V


@dataclass(frozen=True)
class Settings:
    """Engine settings; fields missing from a JSON object keep their defaults, unknown ones are ignored."""

    enable_ner: bool = False
    retention_minutes: int = 60
    strict_mode: bool = False
    stash_clear_on_quit: bool = False
    auto_detection: bool = False
    hotkey: str = "CmdOrCtrl+Alt+B"

    @classmethod
    def load(cls, text: str) -> Settings:
        try:
            found = json.loads(text)
        except ValueError:
            found = {}
        known = {f.name: f.default for f in fields(cls)}
        kept = {k: v for k, v in (found if isinstance(found, dict) else {}).items() if k in known and type(v) is type(known[k])}
        if kept.get("hotkey") == "Ctrl+B":  # the default of older versions
            kept["hotkey"] = cls.hotkey
        return cls(**kept)


def settings_column(text: Column) -> Column:
    """Settings of a JSON string column, as a struct without nulls."""
    kinds = {bool: "boolean", int: "int", str: "string"}
    schema = ", ".join(f"{f.name} {kinds[type(f.default)]}" for f in fields(Settings))
    parsed = F.from_json(text, schema)
    return F.struct(*[F.coalesce(parsed.getField(f.name), F.lit(f.default)).alias(f.name) for f in fields(Settings)])


def read_texts(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Texts from Parquet, JSON, CSV, ORC or plain files (one text a file)."""
    if format == "text":
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text").withColumn("path", F.col("_metadata.file_path"))
    return spark.read.format(format).option("header", "true").load(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("content").alias("image"))


def classified(text: Column) -> Column:
    """empty, too_large or proceed."""
    return F.when(text.isNull() | (text == ""), "empty").when(F.octet_length(text) > V.MAX_TEXT_BYTES, "too_large").otherwise("proceed")


def routed(df: DataFrame) -> DataFrame:
    """df (text, html, image) with content_kind and error: HTML before text before image.

    A text over the limit is an error even if there is an image; HTML over the limit falls back to the text.
    """
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    text, html, image = size("text"), size("html"), size("image")
    has_text = (text > 0) & T.visible(F.coalesce("text", F.lit("")))
    error = F.when(text > V.MAX_TEXT_BYTES, "too_large").when(~has_text & (image > V.MAX_IMAGE_BYTES), "image_too_large").when(~has_text & (image == 0) & (html == 0), "empty")
    kind = F.when(error.isNotNull(), F.lit(None)).when((html > 0) & (html <= V.MAX_TEXT_BYTES), "rich").when(has_text, "plain").when(image > 0, "image")
    return df.withColumn("error", error).withColumn("content_kind", kind)


def changes(events: DataFrame, order: str, by: str | None = None, text: str = "text") -> DataFrame:
    """Events whose text differs from the one before, null-safe; the first of each source counts as a change."""
    w = Window.partitionBy(by).orderBy(order) if by else Window.orderBy(order)
    return events.withColumn("__last", F.lag(text).over(w)).withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | ~F.col(text).eqNullSafe(F.col("__last"))).drop("__last", "__n")


def consistent_html(text: Column, text_before: Column, html: Column) -> Column:
    """html, if the text is still the one that was captured with it."""
    return F.when(text.eqNullSafe(text_before), html)


def from_allowed(app: Column, apps: list[str]) -> Column:
    """Whether the application in front is one of the given identifiers."""
    return app.isin(*apps) if apps else F.lit(False)
