"""Entry points: detect, pseudonymise, anonymise, restore, and the policies that combine them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions import tokens
from maskwright.functions import values as V
from maskwright.operators import detect as D
from maskwright.operators import html as H
from maskwright.operators import image as I
from maskwright.operators import rewrite as R
from maskwright.sources import inputs, store
from maskwright.sources.tables import stored


def detect(df: DataFrame, text: str = "text", words: D.Gazetteer = D.Gazetteer(), extra: Column | None = None) -> DataFrame:
    """df with findings: ARRAY<struct> of disjoint spans with byte offsets.

    Several uses of findings would run the detectors several times where Spark merges
    projections; give it to a sink, or cache or write it, before it is used twice.
    """
    return df.withColumn("findings", D.detect_column(text, words) if extra is None else D.detect(F.col(text), words, extra))


def _literal_pads(key: bytes) -> tuple[Column, Column]:
    inner, outer = tokens.pads(key)
    return F.lit(bytearray(inner)), F.lit(bytearray(outer))


def pseudonymise(df: DataFrame, master: bytes, text: str = "text", case: str | None = None, hint: bool = True, words: D.Gazetteer = D.Gazetteer()) -> DataFrame:
    """df with findings (with tokens) and redacted_text.

    With a case column each case has a secret of its own, so its tokens are stable inside
    it and cannot be linked to those of others; without one the installation's secret counts.
    """
    rows = detect(df, text, words)
    if case is None:
        inner, outer = _literal_pads(master)
    else:
        rows = tokens.with_case_pads(rows, master, case)
        inner, outer = F.col("inner_pad"), F.col("outer_pad")
    rows = rows.withColumn("findings", R.pseudonyms(F.col("findings"), inner, outer)).drop("inner_pad", "outer_pad")
    out = R.rewritten(F.col(text), F.col("findings"))
    return rows.withColumn("redacted_text", T.with_hint(out, F.col("findings")) if hint else out)


def mappings_of(pseudonymised: DataFrame, case: str, at: Column) -> DataFrame:
    """Mapping rows of the findings: case_id, token, original, first_seen."""
    return pseudonymised.select(F.col(case).cast("string").alias("case_id"), F.explode("findings").alias("f")).select("case_id", "f.token", "f.original", at.alias("first_seen"))


def anonymise(df: DataFrame, text: str = "text", hint: bool = True, words: D.Gazetteer = D.Gazetteer()) -> DataFrame:
    """df with findings (with readable placeholders) and redacted_text; no mapping exists."""
    rows = detect(df, text, words).withColumn("findings", R.placeholders(F.col("findings")))
    out = R.rewritten(F.col(text), F.col("findings"))
    return rows.withColumn("redacted_text", T.with_hint(out, F.col("findings"), strict=True) if hint else out)


def smart_transform(df: DataFrame, key: str, mappings: DataFrame, master: bytes, settings: inputs.Settings = inputs.Settings(), text: str = "text", case: str | None = None) -> DataFrame:
    """df with action (forward, reverse, strict, pass), replacement (null: leave as it is), replaced and findings.

    Strict mode goes forward only. Else a text with tokens is restored if that changes it;
    else it is pseudonymised if something is found; else, as a text over the size limit, it passes.
    """
    fits = inputs.classified(F.col(text)) == "proceed"
    if settings.strict_mode:
        rows = anonymise(df, text)
        found = fits & (F.size("findings") > 0)
        return rows.withColumn("action", F.when(found, "strict").otherwise("pass")).withColumn("replacement", F.when(found, F.col("redacted_text"))).withColumn("replaced", F.when(found, F.size("findings")).otherwise(0)).drop("redacted_text")
    rows = stored(pseudonymise(df, master, text, case or key))
    back = store.restore_all(df.select(key, text), mappings, key, text).select(key, F.col(text).alias("__back"))
    rows = rows.join(back, key)
    reverse = fits & T.has_token(F.col(text)) & (F.col("__back") != F.col(text))
    forward = fits & (F.size("findings") > 0)
    return (
        rows.withColumn("action", F.when(reverse, "reverse").when(forward, "forward").otherwise("pass"))
        .withColumn("replacement", F.when(reverse, F.col("__back")).when(forward, F.col("redacted_text")))
        .withColumn("replaced", F.when(reverse, T.restored_count(F.col(text), F.col("__back"))).when(forward, F.size("findings")).otherwise(0))
        .drop("__back", "redacted_text")
    )


def watch_policy(df: DataFrame, key: str, mappings: DataFrame, master: bytes, text: str = "text", case_id: str = "default") -> DataFrame:
    """df with replacement: forward first, then reverse, in one fixed case and whatever the strict setting; null leaves the text."""
    rows = stored(pseudonymise(df.withColumn("__case", F.lit(case_id)), master, text, "__case"))
    back = store.restore_case(df.select(key, F.lit(case_id).alias("case_id"), text), mappings, text).select(key, F.col(text).alias("__back"))
    replaced = F.when(F.size("findings") > 0, F.col("redacted_text")).when(F.col("__back") != F.col(text), F.col("__back"))
    return rows.join(back, key).withColumn("replacement", replaced).drop("__case", "__back", "redacted_text")


def redact_pages(pages: DataFrame, master: bytes | None = None, html: str = "html", case: str | None = None) -> DataFrame:
    """pages with sanitised, plaintext, findings, annotated_html, redacted_html and redacted_text; placeholders without a master secret."""
    rows = H.with_text(pages, html)
    strict = master is None
    rows = anonymise(rows, "plaintext") if strict else pseudonymise(rows, master, "plaintext", case)
    rows = rows.withColumn("__r", H.redacted(F.col(html), F.col("findings")))
    return rows.withColumn("annotated_html", F.col("__r.annotated_html")).withColumn("redacted_html", T.html_with_hint(F.col("__r.redacted_html"), F.col("findings"), strict)).drop("__r")


def stage(df: DataFrame, mode: str = "strict", text: str = "text") -> DataFrame:
    """Result rows for display: segments, truncated, finding_count and entity_counts of texts that are to be processed."""
    rows = inputs.routed(df).filter(F.col("error").isNull()) if {"text", "html", "image"} <= set(df.columns) else df
    rows = anonymise(rows, text)
    shown = T.segments(F.col(text), F.col("findings"))
    return rows.withColumn("__s", shown).select("*", "__s.segments", "__s.truncated", F.size("findings").alias("finding_count"), R.entity_counts(F.col("findings")).alias("entity_counts"), F.lit(mode).alias("mode")).drop("__s")


def redact_images(df: DataFrame, key: str, image: str = "image", words: str = "words", gazetteer: D.Gazetteer = D.Gazetteer()) -> DataFrame:
    """df (key, PNG image, recognised words with places) with text, findings, boxes, redacted_image and error.

    The words are put together to a text, its findings get a box a line, and the boxes are
    painted. error is image_too_large, unreadable, or null; an image without words has no boxes.
    """
    empty = F.array().cast("array<struct<text:string,x:double,y:double,w:double,h:double,line:int>>")
    rows = df.withColumn("__a", I.assembled(F.coalesce(F.col(words), empty)))
    rows = rows.withColumn("text", F.col("__a.text")).withColumn("slices", F.col("__a.slices")).drop("__a")
    rows = stored(anonymise(rows, "text", hint=False, words=gazetteer).drop("redacted_text"))
    place = F.struct("finding", "line", "x", "y", "w", "h", "entity_type", "replacement")
    found = I.boxes(rows.select(key, F.col(words).alias("words"), "slices", "findings"), key).groupBy(key).agg(F.sort_array(F.collect_list(place)).alias("boxes"))
    none = F.array().cast(found.schema["boxes"].dataType)
    out = rows.join(found, key, "left").withColumn("boxes", F.coalesce("boxes", none)).drop("slices")
    fits = F.coalesce(F.octet_length(image), F.lit(0)) <= V.MAX_IMAGE_BYTES
    out = out.withColumn("redacted_image", F.when(fits, I.rendered(F.when(fits, F.col(image)), F.col("boxes"))))
    return out.withColumn("error", F.when(~fits, "image_too_large").when(F.col("redacted_image").isNull(), "unreadable"))


def stage_and_archive(df: DataFrame, archive: DataFrame, at: Column, mode: str = "strict", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The result rows of stage(), and the rows to append to the archive: those with a finding."""
    rows = stored(stage(df, mode, text))
    kind = F.col("content_kind") if "content_kind" in rows.columns else F.lit("plain")
    entries = rows.select(at.alias("created_at"), "mode", "redacted_text", "entity_counts", kind.alias("content_kind"), *[c for c in ("redacted_html", "image_path") if c in rows.columns])
    return rows, store.archived(archive, entries)


def with_case_id(df: DataFrame, name: str = "case_id") -> DataFrame:
    """df with a fresh random case for each row. Stored, as a random value would change with each use."""
    return stored(df.withColumn(name, F.uuid()))
