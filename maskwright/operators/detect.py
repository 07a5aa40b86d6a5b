"""The detectors, their union, the growth of person spans and the removal of overlaps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import checks
from maskwright.functions import values as V
from maskwright.functions.arrays import running
from maskwright.operators.spans import after, before, marked, of_pieces, originals, part

FINDING = "struct<entity_type:string,original:string,start:int,end:int,confidence:double,ord:int>"


@dataclass(frozen=True)
class Gazetteer:
    """Lower-case word lists; give larger ones for other regions."""

    names: tuple[str, ...] = tuple(dict.fromkeys(V.FIRST_NAMES + V.LAST_NAMES))
    first_names: tuple[str, ...] = tuple(dict.fromkeys(V.FIRST_NAMES + V.LAST_NAMES))
    cities: tuple[str, ...] = tuple(V.CITIES)


@dataclass(frozen=True)
class Detector:
    """One recogniser: entity type, pattern, confidence; cue is a cheap test of the whole text.

    keep looks at the matched string, check at the bytes of the text and the span.
    """

    name: str
    entity_type: str
    pattern: str
    confidence: float
    cue: Callable[[Column], Column] = field(default=lambda text: F.lit(True))
    keep: Callable[[Column], Column] | None = None
    check: Callable[[Column, Column], Column] | None = None

    def findings(self, text: Column, rank: int) -> Column:
        """All findings of this detector alone."""
        pattern, marks = V.PATTERNS[self.pattern]
        found = checks.let(F.encode(text, "UTF-8"), lambda data: checks.let(marked(text, pattern, marks), lambda pieces: self.of_spans(data, of_pieces(pieces), rank)))
        found = F.when(self.cue(text), found).otherwise(F.array().cast(f"array<{FINDING}>"))
        return checks.let(found, lambda x: originals(text, x))

    def of_spans(self, data: Column, found: Column, rank: int) -> Column:
        """Findings of the spans that pass; data: the bytes of the text."""
        passes = lambda s: (self.keep(s.original) if self.keep else F.lit(True)) & (self.check(data, s) if self.check else F.lit(True))
        found = F.filter(found, passes) if self.keep or self.check else found
        return F.transform(found, lambda s: F.struct(F.lit(self.entity_type).alias("entity_type"), s.original.alias("original"), s.start.alias("start"), s.end.alias("end"), F.lit(self.confidence).alias("confidence"), F.lit(rank).alias("ord")))


def _has_digit(text: Column) -> Column:
    return text.rlike("(?U)\\d")


def _phone(data: Column, s: Column) -> Column:
    # What stands before a number is no digit, so a hex literal shows in the last characters.
    return ~checks.in_hex(before(data, s.start, 64), after(data, s.end, 4))


def _word_in(words: tuple[str, ...]) -> Callable[[Column], Column]:
    """Membership in a word list, which Spark looks up by hash where the words are literals of an IN."""
    return lambda x: F.lower(x).isin(list(words))


def detectors(words: Gazetteer = Gazetteer()) -> list[Detector]:
    """In the order that breaks ties; the persons come before growth, places and organisations after it."""
    count = lambda x: F.length(checks.digits(x))
    return [
        Detector("email", "email", "email", 0.99, lambda t: t.contains("@")),
        Detector("phone", "phone", "phone", 0.85, _has_digit, lambda x: count(x).between(6, 16), _phone),
        Detector("iban", "iban", "iban", 0.99, _has_digit, checks.iban),
        Detector("card", "credit_card", "card", 0.95, _has_digit, lambda x: F.when(count(x).between(13, 19), checks.luhn(checks.digits(x))).otherwise(F.lit(False))),
        Detector("tax_id", "steuer_id", "tax_id", 0.90, _has_digit, checks.tax_id, lambda data, s: checks.tax_cue(before(data, s.start, 4 * V.CUE_WINDOW + 4))),
        Detector("date", "date", "date", 0.80, _has_digit),
        Detector("vat", "steuer_id", "vat", 0.99, lambda t: t.contains("DE")),
        Detector("bic", "iban", "bic", 0.95, lambda t: t.contains("DE")),
        Detector("url", "url", "url", 0.95, lambda t: t.contains("://") | t.contains("www.")),
        Detector("name", "person", "name", 0.70, keep=_word_in(words.names)),
        Detector("salutation", "person", "salutation", 0.75, lambda t: t.rlike("Herr|Hr|Frau|Fr\\.|Dr\\.|Prof\\.|Mag\\.|Mr|Ms\\.")),
        Detector("surname_first", "person", "surname_first", 0.85, lambda t: t.contains(",")),
        Detector("city", "location", "city", 0.80, keep=_word_in(words.cities)),
        Detector("organization", "organization", "organization", 0.85, lambda t: t.rlike("GmbH|AG|SE|KG|OHG|UG|e\\.V\\.|eG")),
        Detector("postal_code", "location", "postal_code", 0.85, _has_digit),
        Detector("street", "location", "street", 0.85, _has_digit),
    ]


PERSONS = 12  # the first detectors, up to surname_first


def _pairs(found: Column, words: Gazetteer) -> Column:
    """Of the surname and first-name spans, in turn, those pairs whose second is a known first name."""
    known = _word_in(words.first_names)
    return F.filter(found, lambda s, i: known(F.get(found, F.when(i % 2 == 0, i + 1).otherwise(i)).original))


#: Bytes behind a person that are looked at first for a capitalised word.
AHEAD = 256


def grown(data: Column, findings: Column) -> Column:
    """Person findings that a capitalised word follows, with that word."""

    def longer(f: Column, more: Column) -> Column:
        return F.struct(f.entity_type.alias("entity_type"), F.concat(f.original, more).alias("original"), f.start.alias("start"), (f.end + F.octet_length(more)).cast("int").alias("end"), f.confidence.alias("confidence"), f.ord.alias("ord"))

    def grow(f: Column) -> Column:
        # Where the window ends within white space or a word, all that follows is looked at.
        open_ended = lambda near: (F.octet_length(data) > f.end + AHEAD) & near.rlike("(?U)^\\s+(?:\\p{Lu}\\p{Ll}*)?\uFFFD{0,3}$")
        more = checks.let(after(data, f.end, AHEAD), lambda near: F.when(open_ended(near), F.regexp_extract(part(data, f.end, F.octet_length(data)), V.EXPANSION, 0)).otherwise(F.regexp_extract(near, V.EXPANSION, 0)))
        return F.when(f.entity_type == "person", checks.let(more, lambda m: longer(f, m))).otherwise(f)

    return F.transform(findings, grow)


def resolved(findings: Column) -> Column:
    """Disjoint findings: earliest start first, then the longest, then the order of detectors; the rest is dropped."""
    keyed = F.sort_array(F.transform(findings, lambda f: F.struct(f.start.alias("a"), (-f.end).alias("b"), f.ord.alias("c"), f.alias("f"))))
    state = lambda last, kept: F.struct(last.cast("int").alias("last"), kept.alias("kept"))
    step = lambda s, k: F.when(k.a >= s.last, state(-k.b, F.lit(True))).otherwise(state(s.last, F.lit(False)))

    def kept(keyed: Column) -> Column:
        states = running(keyed, state(F.lit(0), F.lit(True)), step, "struct<last:int,kept:boolean>")
        return checks.let(states, lambda s: F.transform(F.filter(keyed, lambda _, i: F.get(s, i).kept), lambda k: k.f))

    return checks.let(keyed, kept)


def detect(text: Column, words: Gazetteer = Gazetteer(), extra: Column | None = None) -> Column:
    """ARRAY<FINDING> of a text, disjoint and sorted. extra: findings of a model, with ord after the detectors'.

    The texts are cut for all detectors first, so that the expression that makes spans of the pieces is there once.
    """
    own = detectors(words)
    none = F.array().cast("array<string>")

    def of(text: Column) -> Column:
        pieces = F.array(*[F.when(d.cue(text), marked(text, *V.PATTERNS[d.pattern])).otherwise(none) for d in own])
        return checks.let(F.transform(pieces, of_pieces), lambda all_: checks.let(F.encode(text, "UTF-8"), lambda data: union(text, data, all_)))

    def union(text: Column, data: Column, all_: Column) -> Column:
        each = {}
        for rank, d in enumerate(own):
            found = d.of_spans(data, F.get(all_, F.lit(rank)), rank)
            each[d.name] = checks.let(found, lambda x: _pairs(x, words)) if d.name == "surname_first" else found
        names = list(each)
        early, late = [each[n] for n in names[:PERSONS]], [each[n] for n in names[PERSONS:]]
        # What grows is taken from the text, what was found from the copy that was matched: see originals().
        found = resolved(F.concat(grown(data, F.concat(*early)), *late, *([extra] if extra is not None else [])))
        return checks.let(found, lambda x: originals(text, x))

    return checks.let(F.coalesce(text, F.lit("")), of)


_KNOWN: dict[tuple, Column] = {}


def detect_column(name: str, words: Gazetteer = Gazetteer()) -> Column:
    """detect() of a column by its name. Building the expression takes seconds, so it is kept for the session."""
    key = (id(SparkContext._active_spark_context), name, words)
    if key not in _KNOWN:
        if len(_KNOWN) >= 64:
            _KNOWN.clear()
        _KNOWN[key] = detect(F.col(name), words)
    return _KNOWN[key]
