"""Checksums, tokens, labels and text functions."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from maskwright.functions import checks, tokens
from maskwright.functions import text as T
from maskwright.functions import values as V
from maskwright.operators import rewrite as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("number,valid", [("79927398713", True), ("79927398710", False), ("4532015112830366", True), ("0", True)])
def test_luhn(spark, number, valid):
    assert one(spark, checks.luhn(F.lit(number))) is valid


@pytest.mark.parametrize("number,valid", [("86095742719", True), ("86095742718", False), ("06095742719", False), ("11111111111", False), ("8609574271", False)])
def test_tax_id(spark, number, valid):
    assert one(spark, checks.tax_id(F.lit(number))) is valid


@pytest.mark.parametrize("number,valid", [("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("FR1420041010050500013M02606", True), ("XX89370400440532013000", False), ("DE8937040044053201300", False)])
def test_iban(spark, number, valid):
    assert one(spark, checks.iban(F.lit(number))) is valid


def test_token_is_the_hmac(spark):
    key = b"k" * 32
    inner, outer = (F.lit(bytearray(p)) for p in tokens.pads(key))
    for original in ("Max Mustermann", "Jürgen Öß", "a b", "x" * 200):
        plain = original.replace(" ", " ")
        digest = hmac.new(key, plain.encode(), hashlib.sha256).digest()
        expected = base64.b32encode(digest).decode().lower()[:6]
        assert one(spark, tokens.make_token(F.lit("person"), F.lit(original), inner, outer)) == f"«P_{expected}»"


def test_case_secrets(spark):
    df = spark.createDataFrame([("a",), ("b",)], "case_id string")
    rows = tokens.with_case_pads(df, b"master").collect()
    for r in rows:
        assert (bytes(r.inner_pad), bytes(r.outer_pad)) == tokens.pads(tokens.case_secret(b"master", r.case_id))


@pytest.mark.parametrize("raw,plain", [("  a  b \t c ", "a b c"), ("a​b﻿", "ab"), ("", "")])
def test_normalised(spark, raw, plain):
    assert one(spark, tokens.normalised(F.lit(raw))) == plain


@pytest.mark.parametrize("n,letters", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA")])
def test_letters(spark, n, letters):
    assert one(spark, tokens.letters(F.lit(n))) == letters


def test_style_title_escape(spark):
    assert one(spark, T.filter_style(F.lit("COLOR: red; position: fixed; width:1px; background-color:URL(x)"))) == "color: red; width: 1px"
    assert one(spark, T.title(F.lit("  ä😀\n\n" + "x" * 80))) == ("ä😀 " + "x" * 80)[:60]
    assert one(spark, T.escape_html(F.lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert one(spark, T.extract_tokens(F.lit("«P_abcdef» «P_abcdefg» «E_123abc» «P_abcdef»"))) == ["«P_abcdef»", "«E_123abc»"]


FINDING = "entity_type string, original string, token string, start int, end int, confidence double"


def findings(*rows):
    out = [F.struct(*[F.lit(v).alias(n.split()[0]) for v, n in zip(r, FINDING.split(", "))]) for r in rows]
    return F.array(*out) if out else F.array().cast(f"array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")


def test_rewriting_at_umlauts(spark):
    text = "ä😀 Petra ß"
    start = len("ä😀 ".encode())
    found = findings(("person", "Petra", "«P»", start, start + 5, 0.7))
    assert one(spark, R.rewritten(F.lit(text), found)) == "ä😀 «P» ß"
    assert one(spark, R.rewritten(F.lit(text), findings())) == text


def segments(spark, text, *rows, cap=10):
    r = one(spark, T.segments(F.lit(text), findings(*rows), cap))
    return [(s.kind, s.content if s.kind == "text" else s.original) for s in r.segments], r.truncated


def test_segments(spark):
    f = ("person", "Anna", "«P»", 3, 7, 0.7)
    assert segments(spark, "ab Anna cd", f) == ([("text", "ab "), ("finding", "Anna"), ("text", " cd")], False)
    assert segments(spark, "ab Anna cde", f) == ([("text", "ab "), ("finding", "Anna"), ("text", " cd"), ("text", V.TRUNCATED)], True)
    assert segments(spark, "ab Anna cd", f, cap=5) == ([("text", "ab "), ("text", V.TRUNCATED)], True)
    assert segments(spark, "ab Anna cd", f, cap=2) == ([("text", "ab"), ("text", V.TRUNCATED)], True)
    assert segments(spark, "", cap=5) == ([], False)


def test_labels_repeat_and_count_by_type(spark):
    rows = [("person", "Anna", "", 0, 4, 0.7), ("location", "Kiel", "", 5, 9, 0.8), ("person", "Uwe", "", 10, 13, 0.7), ("person", "Anna", "", 14, 18, 0.7)]
    got = one(spark, R.placeholders(findings(*rows)))
    assert [f.token for f in got] == ["«Person A»", "«Ort A»", "«Person B»", "«Person A»"]
    assert one(spark, R.entity_counts(findings(*rows))) == {"person": 3, "location": 1}


def test_labels_go_on_behind_three_letters(spark):
    numbers = {702: "ZZ", 703: "AAA", 18278: "ZZZ", 18279: "AAAA", 475254: "ZZZZ", 475255: "AAAAA"}
    assert {n: one(spark, tokens.letters(F.lit(n))) for n in numbers} == numbers


def test_pads_are_computed_once_for_all_findings(spark):
    found = F.array(*[F.struct(F.lit("person").alias("entity_type"), F.lit("Anna").alias("original"), F.lit(i).alias("start"), F.lit(i + 1).alias("end"), F.lit(0.7).alias("confidence")) for i in (0, 2, 4)])
    pad = F.encode(F.rand(1).cast("string"), "UTF-8")
    assert len({f.token for f in one(spark, R.pseudonyms(found, pad, F.lit(bytearray(64))))}) == 1
