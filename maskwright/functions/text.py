"""Small text functions: titles, escaping, style filter, counts, data URLs, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import values as V
from maskwright.functions.checks import let


def title(x: Column) -> Column:
    """White space collapsed, first characters."""
    return F.left(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(V.TITLE_CHARS))


def escape_html(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def filter_style(style: Column) -> Column:
    """The allowed declarations of a style attribute, without url( and expression(."""

    def declaration(d: Column) -> Column:
        name, value = F.lower(F.trim(F.substring_index(d, ":", 1))), F.trim(F.substring(d, F.locate(":", d) + 1, F.length(d)))
        bad = F.contains(F.lower(value), F.lit("url(")) | F.contains(F.lower(value), F.lit("expression("))
        return F.when(d.contains(":") & name.isin(V.STYLES) & ~bad, F.concat(name, F.lit(": "), value))

    return F.array_join(F.filter(F.transform(F.split(style, ";"), declaration), lambda d: d.isNotNull()), "; ")


def has_token(x: Column) -> Column:
    return x.rlike(V.TOKEN)


def extract_tokens(x: Column) -> Column:
    """The distinct tokens of a text in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(V.TOKEN), F.lit(0)))


def restored_count(before: Column, after: Column) -> Column:
    """How many opening marks fewer a text has than before."""
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("«"), F.lit("")))
    return F.greatest(marks(before) - marks(after), F.lit(0))


def with_hint(x: Column, findings: Column, strict: bool = False) -> Column:
    return F.when(F.size(findings) > 0, F.concat(x, F.lit(V.STRICT_HINT if strict else V.HINT))).otherwise(x)


def html_with_hint(x: Column, findings: Column, strict: bool = False) -> Column:
    body = (V.STRICT_HINT if strict else V.HINT).lstrip().removeprefix("---").lstrip()
    return F.when(F.size(findings) > 0, F.concat(x, F.lit("<hr><p>"), escape_html(F.lit(body)), F.lit("</p>"))).otherwise(x)


def visible(x: Column) -> Column:
    """Whether a text shows anything beside removed images."""
    return F.regexp_replace(F.replace(x, F.lit(V.IMAGE_WORD), F.lit(" ")), r"(?U)\s+", "") != ""


def display_fits(text: Column, html: Column) -> Column:
    return (F.char_length(text) <= V.SEGMENT_CHARS) & (F.octet_length(html) <= V.MAX_DISPLAY_HTML)


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def segments(text: Column, findings: Column, cap: int = V.SEGMENT_CHARS) -> Column:
    """Alternating text and finding pieces up to cap characters; findings are never cut.

    findings are disjoint and sorted. Struct of segments and truncated.
    """
    kind = "struct<kind:string,content:string,original:string,replacement:string,entity_type:string,confidence:double>"
    plain = lambda content: F.struct(F.lit("text").alias("kind"), content.alias("content"), *[F.lit(None).cast("string").alias(c) for c in ("original", "replacement", "entity_type")], F.lit(None).cast("double").alias("confidence"))
    found = lambda f: F.struct(F.lit("finding").alias("kind"), F.lit(None).cast("string").alias("content"), f.original.alias("original"), f.token.alias("replacement"), f.entity_type.alias("entity_type"), f.confidence.cast("double").alias("confidence"))
    slice_of = lambda b, start, end: F.decode(F.substring(b, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
    add = lambda pieces, content: F.when(content != "", F.concat(pieces, F.array(plain(content)))).otherwise(pieces)

    def build(b: Column) -> Column:
        def step(s: Column, f: Column) -> Column:
            def placed(before: Column) -> Column:
                room = F.lit(cap) - s.used - F.char_length(before)
                return (
                    F.when(room < 0, F.struct(f.end.alias("pos"), F.lit(cap).alias("used"), F.lit(True).alias("cut"), add(s.out, F.left(before, F.lit(cap) - s.used)).alias("out")))
                    .when(room < F.char_length(f.original), F.struct(f.end.alias("pos"), F.lit(cap).alias("used"), F.lit(True).alias("cut"), add(s.out, before).alias("out")))
                    .otherwise(F.struct(f.end.alias("pos"), (s.used + F.char_length(before) + F.char_length(f.original)).alias("used"), F.lit(False).alias("cut"), F.concat(add(s.out, before), F.array(found(f))).alias("out")))
                )

            return F.when(s.cut, s).otherwise(let(slice_of(b, s.pos, f.start), placed))

        def finish(s: Column) -> Column:
            def tail(rest: Column) -> Column:
                cut = s.cut | (s.used + F.char_length(rest) > cap)
                own = F.when(s.cut, F.lit("")).otherwise(F.left(rest, F.lit(cap) - s.used))
                return F.struct(F.concat(add(s.out, own), F.when(cut, F.array(plain(F.lit(V.TRUNCATED)))).otherwise(F.array().cast(f"array<{kind}>"))).alias("segments"), cut.alias("truncated"))

            return let(slice_of(b, s.pos, F.octet_length(b)), tail)

        start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("used"), F.lit(False).alias("cut"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(findings, start, step, finish)

    return let(F.encode(text, "UTF-8"), build)
