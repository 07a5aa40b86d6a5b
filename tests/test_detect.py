"""Detectors, growth and removal of overlaps on single texts."""

import pytest
import regex
from pyspark.sql import functions as F

from maskwright.functions import values as V
from maskwright.functions.arrays import running
from maskwright.operators import detect as D
from maskwright.operators.spans import spans

#: id, text, (entity type, original) that must be found or, with a leading None, types that must not.
CASES = [
    ("mail", "Bitte an kontakt@beispiel.de schreiben.", [("email", "kontakt@beispiel.de")]),
    ("phone", "Tel: +49 441 123456 abends", [("phone", "+49 441 123456")]),
    ("phone slash", "Ruf 04451 / 15 234 an", [("phone", "04451 / 15 234")]),
    ("phone in hash", "Hash 0x49301234567a und ab0441123456 hier", [(None, "phone")]),
    ("phones share neighbour", "a 0441123456,0441654321 b", [("phone", "0441123456")]),
    ("iban", "Konto DE89370400440532013000.", [("iban", "DE89370400440532013000")]),
    ("iban spaced", "Konto DE89 3704 0044 0532 0130 00.", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("iban check digits", "Konto DE88370400440532013000.", [(None, "iban")]),
    ("iban swallows", "Konto DE89 3704 0044 0532 0130 00\nBIC NOCH EINE", [(None, "iban")]),
    ("bic", "BIC: COBADEFFXXX hier", [("iban", "COBADEFFXXX")]),
    ("card", "Karte 4532015112830366.", [("credit_card", "4532015112830366")]),
    ("card trailing", "Karte 4532015112830366 gut", [("credit_card", "4532015112830366 ")]),
    ("card luhn", "Karte 4532015112830367.", [(None, "credit_card")]),
    ("tax id", "Steuer-ID: 86095742719.", [("steuer_id", "86095742719")]),
    ("tax id without cue", "Nummer 86095742719.", [(None, "steuer_id")]),
    ("tax id cue inside a word", "Martin 86095742719.", [("steuer_id", "86095742719")]),
    ("tax id leading zero", "Steuer-ID: 06095742719.", [(None, "steuer_id")]),
    ("vat", "USt DE123456789.", [("steuer_id", "DE123456789")]),
    ("date", "am 30.02.2024 und", [("date", "30.02.2024")]),
    ("date in words", "am 11. September 2026", [(None, "date")]),
    ("url", "siehe https://www.beispiel.de/weg?x=1.", [("url", "https://www.beispiel.de/weg?x=1")]),
    ("name", "gestern kam Petra vorbei", [("person", "Petra")]),
    ("name grows", "gestern kam Petra Obst vorbei", [("person", "Petra Obst")]),
    ("name grows over lines", "Gruß, Petra\n\nHallo du", [("person", "Petra\n\nHallo")]),
    ("growth stops at hyphen", "mit Petra Klein-Obst dort", [("person", "Petra Klein")]),
    ("salutation", "Herr Dr. Demary sprach", [("person", "Demary")]),
    ("salutation grows", "Frau Erika Lang Weber sprach", [("person", "Erika Lang Weber")]),
    ("surname first", "Obst, Petra kommt", [("person", "Obst"), ("person", "Petra")]),
    ("surname first unknown", "Obst, Zitrone kommt", [(None, "person")]),
    ("city", "in Oldenburg wohnt", [("location", "Oldenburg")]),
    ("city with hyphen", "in Baden-Baden wohnt", [("location", "Baden-Baden")]),
    ("organisation", "die Nordwind Handel GmbH liefert", [("organization", "Nordwind Handel GmbH")]),
    ("organisation with points", "der Heimat e.V. lädt", [("organization", "Heimat e.V.")]),
    ("postal code", "in 26121 Irgendwo", [("location", "26121")]),
    ("street", "im Lindenweg 12a wohnt", [("location", "Lindenweg 12a")]),
    ("none", "nur kleine worte hier", []),
    ("empty", "", []),
    ("marks in the text", "\u0001 kontakt@beispiel.de \u0002", [("email", "kontakt@beispiel.de")]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, text) for name, text, _ in CASES] + [("null", None)]
    df = spark.createDataFrame(rows, "name string, text string")
    return {r.name: r.f for r in df.select("name", D.detect(F.col("text")).alias("f")).collect()}


@pytest.mark.parametrize("name,text,expected", CASES, ids=[c[0] for c in CASES])
def test_case(found, name, text, expected):
    got = [(f.entity_type, f.original) for f in found[name]]
    data, last = text.encode(), 0
    for f in found[name]:
        assert data[f.start : f.end].decode() == f.original and f.start >= last
        last = f.end
    for kind, what in expected:
        if kind is None:
            assert what not in [k for k, _ in got]
        else:
            assert (kind, what) in got
    if not expected:
        assert got == []


def test_strings_are_those_of_the_text(spark):
    """Also where the text holds the characters that mark matches: they are replaced in the matching copy only."""
    text = "siehe https://a.example.com/x\u0001y/z und Petra Obst \u0002 Ruf 0441 123456"
    for column in (D.detect(F.col("t")), next(d for d in D.detectors() if d.name == "url").findings(F.col("t"), 0)):
        found = spark.createDataFrame([(text,)], "t string").select(column.alias("f")).first().f
        assert found[0].original == "https://a.example.com/x\u0001y/z"
        assert all(text.encode()[f.start : f.end].decode() == f.original for f in found)


def test_long_texts_have_the_findings_of_their_parts(spark):
    """More findings than are folded in one block, and persons that are followed by more white space than a window has."""
    unit = "Frau Dr. Becker, Petra kommt am 01.02.2024 aus Köln, Tel +49 441 123456. "
    one, many = (spark.createDataFrame([(unit * n,)], "t string").select(D.detect_column("t").alias("f")).first().f for n in (1, 500))
    size = len(unit.encode())
    assert [(f.entity_type, f.original, f.start, f.end) for f in many] == [(f.entity_type, f.original, f.start + i * size, f.end + i * size) for i in range(500) for f in one]
    gap = " " * 300
    far = spark.createDataFrame([(f"mit Petra{gap}Obst da",), (f"mit Petra {'O' + 'b' * 400} da",), (f"mit Petra{gap}obst",)], "t string").select(D.detect_column("t").alias("f")).collect()
    assert [r.f[0].original for r in far] == [f"Petra{gap}Obst", f"Petra O{'b' * 400}", "Petra"]


def test_every_first_name_is_known(spark):
    """Alone, and behind a surname."""
    assert len(set(V.FIRST_NAMES)) == 218 and {"jörn", "rüdiger", "sönke", "armin", "gerd", "konrad", "ulla", "marlene"} <= set(V.FIRST_NAMES)
    rows = [(n.capitalize(), f"heute kam {n.capitalize()}.", f"gez. Obstler, {n.capitalize()}") for n in V.FIRST_NAMES]
    df = spark.createDataFrame(rows, "n string, a string, b string")
    for r in df.select("n", D.detect_column("a").alias("a"), D.detect_column("b").alias("b")).collect():
        # The pattern of single names has no é, that of names behind a surname has every letter.
        assert [(f.entity_type, f.original) for f in r.a] == ([] if r.n == "André" else [("person", r.n)]), r.n
        assert [(f.entity_type, f.original) for f in r.b] == [("person", "Obstler"), ("person", r.n)], r.n


def test_null_is_empty(found):
    assert found["null"] == []


def test_longer_span_that_starts_later_is_dropped(spark):
    one = lambda a, b, o: F.struct(F.lit("x").alias("entity_type"), F.lit("").alias("original"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(1.0).alias("confidence"), F.lit(o).alias("ord"))
    df = spark.range(1).select(D.resolved(F.array(one(3, 20, 0), one(0, 5, 1), one(0, 4, 0), one(20, 21, 2), one(20, 21, 1))).alias("f"))
    assert [(f.start, f.end, f.ord) for f in df.first().f] == [(0, 5, 1), (20, 21, 1)]


def test_spans_equal_a_unicode_regex_engine(spark):
    """Every whole-match pattern against an independent engine on texts with umlauts, digits of other scripts and emoji."""
    texts = [t for _, t, _ in CASES] + ["Jürgen, Ö-Ring ٣٤ 😀 Über-Straße 5 in Köln-Mülheim am 01.02.2023", "www.ä.de http://a.bc/(x) x@y.zz Äpfel AG, SE & Co KG."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for name, (pattern, marks) in V.PATTERNS.items():
        if marks != V.WHOLE or name == "street":
            continue
        plain = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
        got = {r.i: [(s.start, s.original) for s in r.s] for r in df.select("i", spans(F.col("text"), pattern, marks).alias("s")).collect()}
        for i, t in enumerate(texts):
            safe = t.replace(V.OPEN, "\u0003").replace(V.SHUT, "\u0003")
            assert got[i] == [(len(safe[: m.start()].encode()), m[0]) for m in regex.finditer(plain, safe)], (name, t)


def test_words_are_looked_up_by_hash(spark):
    words = D.Gazetteer().names
    rows = spark.createDataFrame([("Anna",), ("MÜLLER",), ("Nordwind",), (None,)], "x string").select("x", D._word_in(words)(F.col("x")).alias("known"), D._word_in(())(F.col("x")).alias("none"))
    assert "INSET" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.x, r.known, bool(r.none)) for r in rows.collect()] == [("Anna", True, False), ("MÜLLER", True, False), ("Nordwind", False, False), (None, None, False)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 255, 256, 257, 1000])
def test_running_states_over_blocks_of_any_length(spark, n):
    got = spark.range(1).select(running(F.array_repeat(F.lit(2), n), F.lit(0), lambda a, x: a + x, "int").alias("x")).first().x
    assert got == [2 * (i + 1) for i in range(n)]
