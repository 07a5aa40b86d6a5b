"""SimHash components, packing and WARC revisits against brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from maskwright.llm import bpe
from maskwright.llm import op5_packing as p
from maskwright.llm import op6_warc as w
from maskwright.llm import op10_simhash as s
from maskwright.llm.graph import components
from tests.llm.cases import documents, empty, key


def brute_mark(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """mark -> smallest mark reachable by links of at most BUDGET bits."""
    marks, root = sorted(marks), {}
    for m in marks:
        if m not in root:
            todo = [m]
            root[m] = m
            while todo:
                a = todo.pop()
                for b in marks:
                    if b not in root and (a ^ b).bit_count() <= s.BUDGET:
                        root[b] = m
                        todo.append(b)
    return root


def test_trie_labels_against_all_pairs():
    rng = random.Random(9)
    for size in (1, 2, 40, 700):
        centres = [rng.getrandbits(64) for _ in range(max(1, size // 6))]
        marks = set()
        while len(marks) < size:
            m = rng.choice(centres)
            for _ in range(rng.randint(0, 5)):
                m ^= 1 << rng.randrange(64)
            marks.add(m)
        array = np.array(sorted(marks), np.uint64)
        labels = s.trie_labels(np.zeros(size, np.int64), array)
        root = brute_components(marks)
        assert [int(array[x]) for x in labels] == [root[int(x)] for x in array]


def test_each_pair_is_in_a_trie():
    rng = random.Random(2)
    for n in (10, 10**6, 10**8, 10**11):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            part = lambda m, choice: [m >> low & ((1 << width) - 1) for low, width in choice]
            assert any(part(a, c) == part(b, c) for c in s.block_choices(n))


def test_near_duplicates_against_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    marks = [brute_mark(r.text) for r in rows]
    ids = collections.defaultdict(list)
    root = brute_components(set(m for m, r in zip(marks, rows) if r.doc_id is not None))
    for m, r in zip(marks, rows):
        if r.doc_id is not None:
            ids[root[m]].append(r.doc_id)
    want = [(r.doc_id, m, min(ids[root[m]]) if m in root else None) for m, r in zip(marks, rows)]
    got = [(r.doc_id, r.mark & (1 << 64) - 1, r.component_id) for r in s.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert s.near_duplicates(empty(spark)).count() == 0


def test_stage_keeps_one_of_each(spark):
    docs = documents(spark)
    kept = s.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    least = {r.component_id for r in s.near_duplicates(docs).collect()}
    assert {i for i in ids if i is not None} == {i for i in least if i is not None} and max(ids.values()) == 1
    assert {103, 107, 110} <= set(ids) and not {104, 105, 106} & set(ids)
    assert s.stage(spark, empty(spark), "").count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for n in got:
        seen, todo = {n}, [n]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        assert got[n] == min(seen)
    assert set(got) == {n for n in near if near[n] - {n}}


TEXTS = ["", " ", "a", " a", "a b", "a  b", "a \nb", "a\n b", "x.\nY z", "don't we'll", "é😀  ü", "a\t b", "tab\t", "end ", "12 34,5 --", "a b  c", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a<|endoftext|>\n <|endoftext", "a" * 300 + " b", "  x \x1c y"]


def test_cached_ids_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(bpe.default_path())
    encoder = bpe.encoder(bpe.default_path())
    for text in TEXTS + ["".join(random.Random(i).choices(" \n\tab.é'", k=40)) for i in range(300)]:
        for _ in range(2):
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark):
    docs = documents(spark)
    got = p.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(bpe.default_path())
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for own in pieces.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= p.LENGTH
    want = collections.Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        bounds = [(0, first), *((a, a + 2048) for a in range(first, len(ids), 2048))]
        want.update((r.doc_id, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(bounds))
    assert want == collections.Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got)
    assert len(pieces) <= -(-sum(r.length for r in got) // 2048) + 1
    assert p.pack_documents(empty(spark)).count() == 0


def test_rounds_merge_groups(spark, monkeypatch):
    monkeypatch.setattr(p, "GROUP", 40)
    monkeypatch.setattr(p, "FAN", 3)
    monkeypatch.setattr(p, "KEEP", 8)
    rng = random.Random(6)
    lengths = [rng.choice([1, 5, 300, 700, 1100, 2047, 2048, rng.randint(1, 2048)]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    rows = p.packed(df).collect()
    assert sorted(r.row for r in rows) == list(range(1500))
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, lengths[r.row]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.08 * sum(lengths) / 2048 + 1


@pytest.mark.parametrize("kind", ["mixed", "halves", "tiny", "large", "thirds"])
def test_bins_that_stay_behind_cost_no_sequence(spark, monkeypatch, kind):
    """With KEEP and without it, as many sequences."""
    rng = random.Random(kind)
    draw = {"mixed": lambda: rng.randint(1, 2047), "halves": lambda: rng.choice([1000, 1023, 1025, 1100]), "tiny": lambda: rng.choice([1, 2, 3, 1900]), "large": lambda: rng.choice([1300, 1500, 60, 700]), "thirds": lambda: rng.choice([683, 682, 684, 1365])}[kind]
    df = spark.createDataFrame([(i, draw()) for i in range(3000)], "row long, length long").cache()
    monkeypatch.setattr(p, "GROUP", 60)
    monkeypatch.setattr(p, "FAN", 4)
    counts = []
    for keep in (16, 1 << 30):
        monkeypatch.setattr(p, "KEEP", keep)
        rows = p.packed(df).collect()
        assert sorted(r.row for r in rows) == list(range(3000))
        counts.append(len({r.sequence_id for r in rows}))
    assert counts[0] <= counts[1]


def test_best_fit_fills():
    bins, offsets, used = p.best_fit(np.array([5, 5, 4, 3, 3]), 10)
    assert sorted(used.tolist()) == [10, 10] and offsets.max() < 10 and len(set(bins.tolist())) == 2


def test_revisits(spark):
    full = lambda i, url, ts, tag, date, payload: (i, url, ts, "response", tag, date, {"ETag": tag or "", "Content-Type": "text/html", "X-Old": "1"}, payload)
    back = lambda i, url, ts, tag, date: (i, url, ts, "revisit", tag, date, {"x-old": "2", "content-type": "no", "Date": "now"}, None)
    rows = [
        full(1, "http://www.A.com:80/p/?utm_source=x&b=2&a=1#f", 10, '"t1"', "d1", "one"), full(2, "https://a.com/p?a=1&b=2", 5000, '"t2"', "d2", "two"), full(3, "a.com/p?b=2&a=1", 5000, '"t3"', "d3", "three"),
        back(11, "http://a.com/p?a=1&b=2", 10, '"t1"', "d1"), back(12, "http://a.com/p?a=1&b=2", 11, 'W/"t1"', "zz"), back(13, "http://a.com/p?a=1&b=2", 5000, '"t1"', None), back(14, "http://a.com/p?a=1&b=2", 90_000, '"t3"', None),
        back(15, "http://a.com/p?a=1&b=2", 90_001, '"t1"', "d3"), back(16, "http://a.com/p?a=1&b=2", 90_002, None, "d3"), back(17, "http://a.com/p?a=1&b=2", 90_003, None, None), back(18, "http://b.com/", 9, None, None),
        back(12, "http://a.com/p?a=1&b=2", 11, 'W/"t1"', "zz"), (19, None, 1, "revisit", None, None, None, None), (20, "x.com", None, "response", None, None, None, None), (21, "x.com", 4, "other", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string").withColumn("status", w.F.lit(1)).withColumn("key", w.F.lit(2))
    got = {r.record_id: r for r in w.resolve(df).collect()}
    assert {i: (r.status, r.response_id, r.payload) for i, r in got.items()} == {
        11: ("no_response", None, None), 12: ("resolved", 1, "one"), 13: ("resolved", 1, "one"), 14: ("resolved", 3, "three"), 15: ("mismatch", 3, None), 16: ("resolved", 3, "three"), 17: ("no_validator", 3, None), 18: ("no_response", None, None)
    }
    assert [(h.name, h.value) for h in got[12].headers] == [("content-type", "text/html"), ("date", "now"), ("etag", '"t1"'), ("x-old", "2")]
    assert w.resolve(df.limit(0)).count() == 0


def test_rows_that_clash_count_as_one_whole_row(spark):
    """Of the rows of a record_id one stays, the same in any order of the input; its headers and payload are its own."""
    rows = [
        (1, "http://a.com/", 10, "response", '"a"', None, {"n": "1"}, "P1"), (1, "http://b.com/", 20, "response", '"b"', None, {"n": "2"}, "P2"), (1, "http://b.com/", 20, "response", '"b"', None, {"n": "3"}, "P3"),
        (2, "http://a.com/", 90, "revisit", '"a"', None, None, None), (4, "http://b.com/", 90, "revisit", '"b"', None, {"x": "y"}, None), (4, "http://b.com/", 90, "revisit", '"b"', None, {"x": "z"}, None),
    ]
    seen = set()
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string").repartition(3)
        got = {r.record_id: r for r in w.resolve(df).collect()}
        assert got[2].status == "resolved" and got[2].payload == "P1" and [h.value for h in got[2].headers] == ["1"]
        assert got[4].status == "no_response" and len(got) == 2
        seen.add(got[4].headers[0].value)
    assert len(seen) == 1


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"u{rng.randrange(4)}", rng.randrange(20_000), i, rng.choice(["response", "revisit"])) for i in range(800)]
    got = {r.record_id: r.response_id for r in w.latest_earlier(spark.createDataFrame(rows, "key string, ts long, record_id long, kind string")).collect()}
    for url, ts, i, kind in rows:
        if kind == "revisit":
            earlier = [(t, j) for u, t, j, k in rows if u == url and k == "response" and t < ts]
            assert got.pop(i) == (max(earlier)[1] if earlier else None)
    assert not got
