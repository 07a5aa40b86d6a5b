"""Mapping table, archive, inputs, settings and policies."""

import datetime

import pytest
from pyspark.sql import functions as F

from maskwright.functions import values as V
from maskwright.plans import api, catalogue
from maskwright.sources import inputs, store
from maskwright.streaming import changes

KEY = b"0" * 32
AT = datetime.datetime(2024, 1, 1)


def mappings(spark, *rows):
    return spark.createDataFrame([(*r, AT) if len(r) == 3 else r for r in rows], store.MAPPINGS)


def test_first_write_wins(spark):
    old = mappings(spark, ("c", "«P_aaaaaa»", "Anna"))
    new = mappings(spark, ("c", "«P_aaaaaa»", "Berta"), ("c", "«P_bbbbbb»", "Uwe"), ("c", "«P_bbbbbb»", "Uwe"), ("d", "«P_aaaaaa»", "Anna"))
    assert sorted((r.case_id, r.original) for r in store.record(old, new).collect()) == [("c", "Uwe"), ("d", "Anna")]


def test_restore_is_isolated_by_case(spark):
    known = mappings(spark, ("a", "«P_aaaaaa»", "Anna"), ("b", "«P_bbbbbb»", "Berta"))
    texts = spark.createDataFrame([("a", "«P_aaaaaa» «P_bbbbbb»"), ("z", "«P_aaaaaa»"), ("a", None)], "case_id string, text string")
    assert sorted(str(r.text) for r in store.restore_case(texts, known).collect()) == ["Anna «P_bbbbbb»", "None", "«P_aaaaaa»"]


def test_originals_with_tokens_are_replaced_in_order(spark):
    known = mappings(spark, ("a", "«P_aaaaaa»", "x «P_bbbbbb»"), ("a", "«P_bbbbbb»", "y «P_aaaaaa» «P_cccccc»"), ("a", "«P_cccccc»", "z"))
    texts = spark.createDataFrame([("a", "1 «P_aaaaaa»"), ("a", "2 «P_bbbbbb»")], "case_id string, text string")
    assert sorted(r.text for r in store.restore_case(texts, known).collect()) == ["1 x y «P_aaaaaa» z", "2 y «P_aaaaaa» z"]


def test_restore_all_takes_the_earliest(spark):
    late = datetime.datetime(2025, 1, 1)
    known = mappings(spark, ("b", "«P_aaaaaa»", "Berta", late), ("c", "«P_aaaaaa»", "Anna", AT), ("a", "«P_aaaaaa»", "Zoe", late))
    texts = spark.createDataFrame([(1, "x «P_aaaaaa» «P_cccccc»"), (2, "none")], "k int, text string")
    assert {r.k: r.text for r in store.restore_all(texts, known, "k").collect()} == {1: "x Anna «P_cccccc»", 2: "none"}


def test_restore_all_prefers_the_case_that_knows_the_whole_text(spark):
    late = datetime.datetime(2025, 1, 1)
    known = mappings(spark, ("a", "«P_aaaaaa»", "Anna", AT), ("a", "«P_bbbbbb»", "Bernd", late), ("z", "«P_aaaaaa»", "Zoe", late), ("z", "«P_cccccc»", "Carl", late), ("y", "«P_cccccc»", "Carl", AT))
    texts = spark.createDataFrame([(1, "«P_cccccc» «P_aaaaaa»"), (2, "«P_aaaaaa» «P_bbbbbb» «P_xxxxxx»"), (3, "«P_aaaaaa»"), (4, "«P_aaaaaa» «P_bbbbbb» «P_cccccc»"), (5, None)], "k int, text string")
    got = {r.k: r.text for r in store.restore_all(texts, known, "k").collect()}
    assert got == {1: "Carl Zoe", 2: "Anna Bernd «P_xxxxxx»", 3: "Anna", 4: "Anna Bernd Carl", 5: None}


def test_purge_is_strict(spark):
    known = mappings(spark, ("a", "t1", "x", AT), ("a", "t2", "x", AT - datetime.timedelta(seconds=1)))
    now = F.lit(AT + datetime.timedelta(minutes=60)).cast("timestamp")
    assert [r.token for r in store.purged(known, now, 60).collect()] == ["t1"]
    assert store.cleared(known).count() == 0 and store.cleared(known, "a").count() == 0 and store.cleared(known, "b").count() == 2


def test_archive(spark):
    rows = spark.createDataFrame([(AT + datetime.timedelta(days=i % 2, minutes=i), "strict", f"text {i}", {"person": 1} if i else {}, "plain") for i in range(4)], "created_at timestamp, mode string, redacted_text string, entity_counts map<string,int>, content_kind string")
    first = store.archived(spark.createDataFrame([], store.ARCHIVE), rows)
    assert sorted((r.id, r.redacted_text) for r in first.collect()) == [(1, "text 2"), (2, "text 1"), (3, "text 3")]
    more = store.archived(first, rows)
    assert min(r.id for r in more.collect()) == 4
    listed = store.archive_list(first).collect()
    assert [r.id for r in listed] == [3, 2, 1] and listed[0].entity_counts == '{"person":1}' and listed[0].char_len == 6
    assert store.archive_content(first, 2).first().flavour == "text" and store.archive_content(first, 9).count() == 0
    assert store.archive_without(first, 2).count() == 2 and store.archive_without(first).count() == 0


def test_archive_entries(spark, tmp_path):
    image = tmp_path / "a.png"
    image.write_bytes(b"png")
    rows = [(1, AT, "strict", "t", "text 1", {"person": 2}, "plain", None, None), (2, AT, "strict", "t", "text 2", {}, "rich", "<p>2</p>", None), (3, AT, "strict", "t", "text 3", {}, "image", None, str(image)), (None, AT, "strict", "t", "no id", {}, "plain", None, str(image))]
    archive = spark.createDataFrame(rows, store.ARCHIVE)
    assert store.archive_get(archive, 2).redacted_text == "text 2"
    with pytest.raises(KeyError):
        store.archive_get(archive, 9)
    with pytest.raises(KeyError):
        store.archive_copy(archive, 9)

    def read(path):
        with open(path, "rb") as f:
            return f.read()

    assert [store.archive_copy(archive, i, read) for i in (1, 2, 3)] == [("text", "text 1"), ("html", "<p>2</p>"), ("image", b"png")]
    # Rows without an id stay; a file goes when the last entry that names it does.
    assert sorted(str(r.id) for r in store.archive_without(archive, 3).collect()) == ["1", "2", "None"]
    assert store.orphaned_images(archive, 3).count() == 0
    assert store.orphaned_images(archive.filter("id is not null"), 3).count() == 1
    assert store.delete_images(store.orphaned_images(archive)) == 1 and not image.exists()
    assert store.archive_copy(archive, 3, read) == ("text", "text 3")
    listed = store.archive_list(archive).select("id", store.counts_of(F.col("entity_counts")).alias("c")).collect()
    assert {r.id: r.c for r in listed}[1] == {"person": 2}
    assert spark.createDataFrame([("no json",), (None,)], "t string").select(store.counts_of(F.col("t")).alias("c")).first().c == {}
    assert changes.ended(inputs.Settings(), archive).count() == 4 and changes.ended(inputs.Settings(stash_clear_on_quit=True), archive).count() == 0


def test_sweep(spark, tmp_path):
    """At the start, and with a retention again and again; 0 minutes purge at the start only."""
    now = datetime.datetime.now()
    table = {"rows": mappings(spark, ("a", "old", "x", now - datetime.timedelta(minutes=90)), ("a", "new", "y", now))}
    assert changes.sweep(spark, lambda: table["rows"], lambda df: table.update(rows=df), 60, str(tmp_path / "c1"), once=True) is None
    assert [r.token for r in table["rows"].collect()] == ["new"]
    query = changes.sweep(spark, lambda: table["rows"], lambda df: table.update(rows=df), 60, str(tmp_path / "c2"))
    try:
        assert query.isActive
    finally:
        query.stop()
    table["rows"] = mappings(spark, ("a", "old", "x", now - datetime.timedelta(minutes=90)))
    assert changes.sweep(spark, lambda: table["rows"], lambda df: table.update(rows=df), 0, str(tmp_path / "c3")) is None
    assert table["rows"].count() == 0
    events = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, text string")
    assert [r.text for r in changes.since_start(events, 1).collect()] == ["b"]


def test_stage_and_archive(spark):
    df = spark.createDataFrame([(1, "Petra aus Bremen"), (2, "nichts")], "k int, text string")
    shown, entries = api.stage_and_archive(df, spark.createDataFrame([], store.ARCHIVE), F.lit(AT).cast("timestamp"))
    assert shown.count() == 2
    (row,) = entries.collect()
    assert row.id == 1 and row.entity_counts == {"person": 1, "location": 1} and row.redacted_text.startswith("«Person A» aus «Ort A»")
    cases = api.with_case_id(df)
    assert len({r.case_id for r in cases.collect()}) == 2 and cases.collect() == cases.collect()


def test_encryption_and_migration(spark):
    known = mappings(spark, ("a", "t", "Jürgen"))
    key, other = F.lit(bytearray(b"k" * 32)), F.lit(bytearray(b"o" * 32))
    hidden = store.encrypted(known, key)
    assert hidden.first().original != "Jürgen" and store.decrypted(hidden, key).first().original == "Jürgen" and store.decrypted(hidden, other).first().original is None
    plain = known.drop("first_seen")
    again = store.with_missing_columns(store.with_missing_columns(plain, store.MAPPINGS), store.MAPPINGS)
    assert again.columns == ["case_id", "token", "original", "first_seen"]


def test_settings():
    assert inputs.Settings.load("{}") == inputs.Settings() == inputs.Settings.load("no json")
    got = inputs.Settings.load('{"strict_mode": true, "retention_minutes": 5, "unknown": 1, "hotkey": "Ctrl+B"}')
    assert (got.strict_mode, got.retention_minutes, got.hotkey) == (True, 5, "CmdOrCtrl+Alt+B")


def test_classes_and_routes(spark):
    rows = [("a", None, None), ("", None, None), (None, None, bytearray(b"x")), ("t", "<p>t", None), ("x" * (V.MAX_TEXT_BYTES + 1), None, bytearray(b"x")), (V.IMAGE_WORD, None, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "text string, html string, image binary")
    got = inputs.routed(df).withColumn("class", inputs.classified(F.col("text"))).collect()
    assert [r["class"] for r in got] == ["proceed", "empty", "empty", "proceed", "too_large", "proceed"]
    assert [(r.content_kind, r.error) for r in got] == [("plain", None), (None, "empty"), ("image", None), ("rich", None), (None, "too_large"), ("image", None)]


POLICY = {
    "nichts hier": ("pass", "pass"),
    "mail an a@b.de": ("forward", "strict"),
    "siehe «E_abc234» und c@d.de": ("reverse", "strict"),
    "siehe «E_zzzzzz» und c@d.de": ("forward", "strict"),
    "siehe «E_zzzzzz» allein": ("pass", "pass"),
}


@pytest.mark.parametrize("strict", [False, True])
def test_policy(spark, strict):
    df = spark.createDataFrame([(t,) for t in POLICY], "k string").withColumn("text", F.col("k"))
    known = mappings(spark, ("c", "«E_abc234»", "e@f.de"))
    rows = {r.k: r for r in api.smart_transform(df, "k", known, KEY, inputs.Settings(strict_mode=strict)).collect()}
    assert {t: r.action for t, r in rows.items()} == {t: actions[strict] for t, actions in POLICY.items()}
    assert all((r.replacement is None) == (r.action == "pass") for r in rows.values())
    if not strict:
        back = rows["siehe «E_abc234» und c@d.de"]
        assert back.replacement == "siehe e@f.de und c@d.de" and back.replaced == 1


def test_smart_action_of_every_turn(spark, tmp_path):
    texts = {"nichts hier": "pass", "mail an a@b.de": "forward", "IBAN DE89 3704 0044 0532 0130 00": "forward", "siehe «E_zzzzzz» allein": "pass", "": "pass"}
    rows = [(conv, turn, "user", t) for conv, t in enumerate(texts) for turn in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in catalogue.queries()["smart_action"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((conv, turn, "reverse" if turn % 3 == 0 else texts[t]) for conv, turn, _, t in rows)


def test_watch_policy_prefers_forward(spark):
    known = mappings(spark, ("default", "«E_abc234»", "e@f.de"))
    df = spark.createDataFrame([(1, "«E_abc234» und c@d.de"), (2, "nur «E_abc234»"), (3, "nichts")], "k int, text string")
    got = {r.k: r.replacement for r in api.watch_policy(df, "k", known, KEY).collect()}
    assert "«E_abc234» und «E_" in got[1] and got[2] == "nur e@f.de" and got[3] is None


def test_roundtrip_without_hint(spark):
    texts = ["Frau Anna Obst, a@b.de, 26121 Kiel", "Anna und Anna", "ohne"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "case_id string, text string")
    rows = api.pseudonymise(df, KEY, case="case_id", hint=False)
    known = api.mappings_of(rows, "case_id", F.current_timestamp()).dropDuplicates(["case_id", "token"])
    back = store.restore_case(rows.select("case_id", F.col("redacted_text").alias("text")), known)
    assert sorted(r.text for r in back.collect()) == sorted(texts)
    for r in rows.collect():
        assert all(f.original not in r.redacted_text for f in r.findings)


def test_hints(spark):
    df = spark.createDataFrame([("a@b.de",), ("x",)], "text string")
    assert [r.redacted_text for r in api.anonymise(df).collect()] == ["«E-Mail A»" + V.STRICT_HINT, "x"]
    assert api.pseudonymise(df, KEY).first().redacted_text.endswith(V.HINT)
    shown = api.stage(df).collect()
    assert shown[0].finding_count == 1 and shown[0].segments[0].replacement == "«E-Mail A»" and shown[1].entity_counts == {}
