"""All matches of a pattern with their byte offsets, as an array column.

Spark has no function that gives the offsets of all matches. Instead the matches are
marked with two control characters, the text is cut at the marks, and the bytes of the
pieces are added up: odd pieces are spans. Marks that the text itself holds are replaced by
another control character of equal width before matching, so offsets stay, and the strings
of the spans are then taken from the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import values as V
from maskwright.functions.arrays import running
from maskwright.functions.checks import let

SPAN = "struct<start:int,end:int,original:string>"


def _has_marks(text: Column) -> Column:
    return text.contains(V.OPEN) | text.contains(V.SHUT)


def marked(text: Column, pattern: str, marks: str) -> Column:
    safe = F.when(_has_marks(text), F.translate(text, V.OPEN + V.SHUT, "\u0003\u0003")).otherwise(text)
    return F.split(F.regexp_replace(safe, pattern, marks), f"[{V.OPEN}{V.SHUT}]")


def _span(start: Column, end: Column, original: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), original.alias("original"))


def of_pieces(pieces: Column) -> Column:
    """The odd pieces with their byte offsets."""

    def odd(ends: Column) -> Column:
        found = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, _span(F.get(ends, i - 1), F.get(ends, i), p)))
        return F.filter(found, lambda s: s.isNotNull())

    return let(running(pieces, F.lit(0), lambda at, p: at + F.octet_length(p), "int"), odd)


def spans(text: Column, pattern: str, marks: str = V.WHOLE, keep: Callable[[Column], Column] | None = None) -> Column:
    """ARRAY<struct<start,end,original>>: byte offsets (end exclusive) and the string of each match that keep accepts."""
    found = let(marked(text, pattern, marks), of_pieces)
    found = F.filter(found, lambda s: keep(s.original)) if keep else found
    return let(found, lambda x: originals(text, x))


def originals(text: Column, found: Column) -> Column:
    """Spans or findings with the strings as they are in the text, where marks in it have been replaced for matching."""
    own = lambda data: F.transform(found, lambda s: s.withField("original", part(data, s.start, s.end)))
    return F.when(_has_marks(text) & (F.size(found) > 0), let(F.encode(text, "UTF-8"), own)).otherwise(found)


def part(data: Column, start: Column, end: Column) -> Column:
    """The characters between two byte offsets. The cast checks nothing, so a window may cut a character in two."""
    return F.substring(data, (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def before(data: Column, start: Column, most: int) -> Column:
    """At most so many bytes before a span of the text whose bytes are data."""
    return part(data, F.greatest(start - most, F.lit(0)), start)


def after(data: Column, end: Column, most: int) -> Column:
    return part(data, end, F.least(end + most, F.octet_length(data)))
