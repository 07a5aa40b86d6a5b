"""HTML, images, recognition and streams."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import values as V
from maskwright.operators import html as H
from maskwright.operators import image as I
from maskwright.operators import ner as N
from maskwright.plans import api
from maskwright.streaming import changes as C


@pytest.mark.parametrize(
    "raw,clean",
    [
        ('<p onclick="x()" style="color:red;position:fixed">a</p>', '<p style="color: red">a</p>'),
        ('<script>alert(1)</script><b title="t">b</b>', "<b>b</b>"),
        ('<a href="http://x">l</a><iframe src="y">z</iframe>', "<a>l</a>"),
        ('<img src="http://x/y.png" alt="Anna"><img src="data:image/png;base64,AA">', '<img><img src="data:image/png;base64,AA">'),
        ('<td colspan="2" id="q">1 &lt; 2 &amp; 3</td>', '<td colspan="2">1 &lt; 2 &amp; 3</td>'),
        ("<section><p>x<p>y</section>", "<p>x</p><p>y</p>"),
    ],
)
def test_sanitise(raw, clean):
    assert H.sanitise(raw) == clean and H.sanitise(clean) == clean


@pytest.mark.parametrize("raw,text", [("<p>a</p><p>b</p>", "a\nb\n"), ("a<br>b", "a\nb"), ("<table><tr><td>1</td><td>2</td></tr></table>", "1\t2\t\n"), ("<img>x", V.IMAGE_WORD + "x"), ("<div><p>a</p></div>b", "a\nb")])
def test_plaintext(raw, text):
    assert H._text_of(raw) == text


def test_redaction_over_elements():
    raw = "<p>Frau <b>An</b>na <i>x</i></p>"
    text = H._text_of(raw)
    start = len(text[: text.index("Anna")].encode())
    f = [{"start": start, "end": start + 4, "token": "«P»", "entity_type": "person", "original": "Anna", "confidence": 0.7}]
    annotated, redacted = H.redact(raw, f)
    assert redacted == "<p>Frau <b>«P»</b> <i>x</i></p>"
    assert annotated.count("data-sz-finding") == 2 and 'data-confidence="0.70"' in annotated and 'data-original="Anna"' in annotated and "data-sz-cont" in annotated


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 8)), max_size=6), st.lists(st.integers(1, 6), max_size=8))
def test_cuts_cover_each_finding_once(found, sizes):
    bounds, at = [], 0
    for n in sizes:
        bounds.append((at, at + n))
        at += n
    ordered = sorted(({"start": a, "end": a + n} for a, n in found), key=lambda f: f["start"])
    parts = [(bounds[i][0] + a, bounds[i][0] + b, k) for i, own in enumerate(H.cuts(bounds, ordered)) for a, b, k, _ in own]
    assert parts == sorted(parts)
    assert all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))


def test_pages(spark):
    df = spark.createDataFrame([(1, "<p>Mail a@b.de</p>"), (2, None), (3, "")], "page_id int, html string")
    rows = {r.page_id: r for r in api.redact_pages(df).collect()}
    assert rows[1].redacted_html.startswith("<p>Mail «E-Mail A»</p><hr><p>") and rows[3].redacted_html == ""
    assert rows[2].sanitised is None


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_roundtrip_and_boxes(channels):
    pixel = np.random.default_rng(1).integers(0, 255, (40, 60, channels), np.uint8)
    data = I.encode(pixel)
    assert np.array_equal(I.decode(data), pixel) and I.size_of(data) == (60, 40)
    out = I.decode(I.painted(data, [{"x": 0.5, "y": 0.5, "w": 0.1, "h": 0.1}]))
    assert not out[17:27, 27:39, 0].any() and np.array_equal(out[:17], pixel[:17])


def test_png_guards():
    with pytest.raises(ValueError):
        I.size_of(b"GIF89a" + b"\0" * 30)
    with pytest.raises(ValueError):
        I.size_of(I.PNG + b"\0\0\0\rIHDR" + (9000).to_bytes(4, "big") + (10).to_bytes(4, "big") + b"\0" * 8)


def test_image_flow(spark):
    """Words of two lines: each finding is painted on its own line, what can't be read has an error."""
    white = I.encode(np.full((100, 200, 3), 255, np.uint8))
    words = [("Petra", 0.125, 0.125, 0.25, 0.125, 0), ("wohnt", 0.5, 0.125, 0.25, 0.125, 0), ("in", 0.125, 0.5, 0.0625, 0.125, 1), ("Bremen", 0.25, 0.5, 0.25, 0.125, 1)]
    df = spark.createDataFrame([(1, white, words), (2, white, None), (3, b"GIF89a", words), (4, None, words)], "k int, image binary, words array<struct<text:string,x:double,y:double,w:double,h:double,line:int>>")
    got = {r.k: r for r in api.redact_images(df, "k").collect()}
    assert got[1].text == "Petra wohnt\nin Bremen" and [(b.line, b.entity_type, b.replacement) for b in got[1].boxes] == [(0, "person", "«Person A»"), (1, "location", "«Ort A»")]
    pixel = I.decode(bytes(got[1].redacted_image))
    dark = np.zeros((100, 200), bool)
    dark[9:28, 22:78] = dark[47:66, 47:103] = True
    assert np.array_equal(pixel[:, :, 0] == 0, dark) and got[1].error is None
    assert got[2].boxes == [] and np.array_equal(I.decode(bytes(got[2].redacted_image)), I.decode(white))
    assert got[3].error == got[4].error == "unreadable" and got[3].redacted_image is None


def test_assembled_text(spark):
    words = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(line).alias("line")) for t, line in (("Frau", 0), ("Äna", 0), ("Obst", 1))])
    r = spark.range(1).select(I.assembled(words).alias("a")).first().a
    assert r.text == "Frau Äna\nObst" and [(s.start, s.end) for s in r.slices] == [(0, 4), (5, 9), (10, 14)]


def test_windows():
    assert N.windows(510) == [(0, 510)]
    assert N.windows(1000) == [(0, 480), (432, 912), (864, 1000)]


def test_spans_of_labels(spark):
    text = "Anna Obst in Kiel und Berlin"
    offsets = [(0, 4), (5, 9), (10, 12), (13, 17), (18, 21), (22, 28)]
    labels, ps = [3, 4, 0, 8, 0, 7], [0.9, 0.8, 0.9, 0.95, 0.9, 0.3]
    assert [(k, a, b) for k, a, b, _ in N.bio_spans(labels, ps, offsets, text)] == [("person", 0, 9), ("location", 13, 17)]
    rows = spark.createDataFrame([(1, i, a, b, x, p) for i, ((a, b), x, p) in enumerate(zip(offsets, labels, ps))], "doc int, tok int, start int, end int, label int, probability double")
    assert sorted((r.entity_type, r.start, r.end) for r in N.spans_of_tokens(rows, "doc").collect()) == [("location", 13, 17), ("person", 0, 9)]


def test_softmax_takes_the_first_maximum():
    best, p = N.softmax_argmax(np.array([[1.0, 1.0, 0.0]]))
    assert best[0] == 0 and p[0] == pytest.approx(np.e / (2 * np.e + 1))


def test_manifest(tmp_path):
    (tmp_path / "model.onnx").write_bytes(b"m")
    good = hashlib.sha256(b"m").hexdigest()
    lines = tmp_path / "manifest"
    lines.write_text(f"﻿# files\n{good.upper()}  model.onnx\n", encoding="utf-8")
    assert N.verify_manifest(str(lines), str(tmp_path)) == 1
    for text, library in ((f"{good} model.onnx", "lib.so"), ("0" * 64 + " model.onnx", None), ("# none", None)):
        lines.write_text(text)
        with pytest.raises(ValueError):
            N.verify_manifest(str(lines), str(tmp_path), library)
    assert N.findings(None, None) is None


def test_stream_accepts_each_change_once(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, "app", "a", "user"), (1, at, "app", "a", "user"), (2, at, "other", "b", "user"), (3, at, "app", "", "user"), (4, at, "app", "c", "engine"), (5, at, "app", "d", None)]
    schema = "seq long, ts timestamp, app string, text string, origin string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = C.accepted(C.read_changes(spark, str(tmp_path / "in"), schema), ["app"])
    seen = []
    C.run_policy(stream, lambda df: df, lambda df, n: seen.extend(r.seq for r in df.collect()), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert sorted(seen) == [1, 5]
    batch = C.accepted(spark.createDataFrame(rows, schema), ["app"])
    assert sorted(r.seq for r in batch.collect()) == [1, 5]


def test_stream_pending_waits_for_an_allowed_application(spark, tmp_path):
    schema = "seq long, app string, text string, host string"
    path = str(tmp_path / "in")
    for rows in ([(1, "other", "a", "h")], [(2, "other", "b", "h")], [(3, "app", "b", "h"), (1, "app", "z", "g")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    out = C.pending(C.read_changes(spark, path, schema), ["app"], "host")
    seen = []
    out.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, n: seen.extend((r.host, r.text) for r in df.collect())).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == [("g", "z"), ("h", "b")]
