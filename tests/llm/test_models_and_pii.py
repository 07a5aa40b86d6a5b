"""Personal data, the quality classifier, the language model and the pipeline."""

import collections
import hashlib
import math
import random
import re
import resource
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from maskwright.llm import attention_lm as lm
from maskwright.llm import bpe, mil
from maskwright.llm import op3_pii as pii
from maskwright.llm import op8_quality_mil as q8
from maskwright.llm import op9_lm as q9
from tests.llm.cases import documents, empty

OPENS = np.arange(lm.IDS) % 2 == 0
PEOPLE = [
    (500, "write to Max.M+x@mail.example.org, or 10.0.0.255 and 300.1.1.1; card 4532 0151 1283 0366!", "en"),
    (501, "phone +1 (555) 123-4567, not +12 34; a@b no; x@y.z@w.de é@ü.de", "en"),
    (502, "1.2.3.4.5.6.7.8 and 0001.02.3.4 4532-0151-1283-0367 +49 151 1234567890123456", "en"),
    (503, "@@ a@b..c a@b.c. " + "y" * 3000 + "@", "en"),
    *[(510 + i, f"note {i} from agent zebrafish about {['red', 'green', 'blue', 'cyan', 'teal'][i]} things: spy@agency.example sent it {i} of that", "en") for i in range(5)],
    *[(520 + i, "copied mole text near dup@copy.example again", "en") for i in range(5)],
]


def brute_spans(text):
    """The contract's patterns, straight."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("ab.@-+ 0123456789()é", k=rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_spans_and_rewriting(spark):
    docs = documents(spark, PEOPLE)
    rows = {r.doc_id: r for r in pii.spans(docs).collect()}
    for r in docs.filter("doc_id is not null").collect():
        base = brute_spans(r.text)
        got = [(x.start, x.kind, x.end) for x in rows[r.doc_id].all]
        assert [x for x in got if x[1] < 4] == base and got == sorted(got)
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [rows[r.doc_id][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(k == i for _, k, _ in base) for i in range(4)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    terms = {i: [texts[i][x.start : x.end] for x in r.all if x.kind == 4] for i, r in rows.items() if i is not None}
    assert all("zebrafish" in terms[510 + i] and "that" not in terms[510 + i] for i in range(5))
    assert not any(terms[520 + i] for i in range(5))  # copies are one context
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert not brute_spans(r.text) or r.doc_id == 502
        if r.doc_id is not None and r.doc_id < 500:
            assert r.text == texts[r.doc_id]
    clean = {r.doc_id: r for r in out.collect()}
    assert clean[500].text.startswith("write to [EMAIL], or [IP] and 300.1.1.1; card [CARD]!") and clean[500].n_chars == len(clean[500].text)
    assert "zebrafish" not in clean[510].text and clean[100].text is None
    assert pii.sanitise(empty(spark)).count() == 0 and pii.spans(empty(spark)).count() == 0


def test_terms_of_an_entity_seen_once(spark):
    """Each distinct context counts, down to one; the spans against the formula, by hand."""
    texts = [f"plain note number {i} about the usual things" for i in range(400)]
    texts += ["the axolotl note about usual things by one@rare.example", "the narwhal plain note: two@rare.example", "about the narwhal, number two@rare.example"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    contexts = {400: {"axolotl", "the", "note", "about", "usual", "things"}, 401: {"narwhal", "the", "plain", "note"}, 402: {"narwhal", "the", "about", "number"}}
    n, want = len(texts), {400: set(), 401: set(), 402: set()}
    for own in ([400], [401, 402]):
        for i in own:
            for term in contexts[i]:
                p = sum(term in re.split("[^a-z]+", t) for t in texts) / n
                together = sum(term in contexts[j] for j in own)
                given = (together + pii.PRIOR * p) / (len(own) + pii.PRIOR) if p else 0
                if p and math.log2(given / p) >= -pii.DISCLOSURE * math.log2(len(own) / (n + len(own))):
                    want[i].add(term)
    rows = {r.doc_id: r.all for r in pii.spans(docs).collect()}
    got = {i: {texts[i][x.start : x.end] for x in rows[i] if x.kind == 4} for i in want}
    assert got == want and "axolotl" in got[400] and "narwhal" in got[401] & got[402] and "the" not in got[400]
    assert not any(rows[i] for i in range(400))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With one word of bits every word passes; with few counted at once a task emits again and again."""
    docs = documents(spark, PEOPLE)
    plain = lambda: sorted(str([r.doc_id, r.all]) for r in pii.spans(docs).collect())
    wide = plain()
    monkeypatch.setattr(pii, "BITS", 64)
    monkeypatch.setattr(pii, "COUNTED", 20)
    assert plain() == wide


def test_term_spans_equal_brute_force(spark):
    """Every term span by plain counting over all texts, with entities of one and of several contexts."""
    rng = random.Random(5)
    common = [f"wort{i}" for i in range(30)]
    rows = []
    for i in range(160):
        words = rng.choices(common, k=rng.randint(3, 30))
        if i % 4 == 0:
            words.insert(rng.randint(0, len(words)), f"user{i % 24}@example.com")
            words.insert(rng.randint(0, len(words)), f"Kennzeichen{i % 24}x")
        rows.append((i, None if i == 9 else " ".join(words)))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (4, rows[4][1])]
    near, base, documents_ = collections.defaultdict(set), {}, collections.Counter()
    places = collections.defaultdict(list)
    for n, (_, text) in enumerate(rows):
        text = text or ""
        base[n] = pii.base_spans(text)
        documents_.update({w for w in re.sub(r"[!-/:-@\[-`{-~]", " ", text).lower().split()})
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        for a, kind, b in base[n]:
            left = [t for t in tokens if t[1] <= a][-pii.WINDOW :]
            right = [t for t in tokens if t[0] >= b][: pii.WINDOW]
            context = " ".join(text[x:y] for x, y in left + right).lower()
            for x, y in left + right:
                if not any(x < q and p < y for p, _, q in base[n]):
                    for m in re.finditer(r"[^!-/:-@\[-`{-~]{3,}", text[x:y]):
                        if not m[0].isdigit():
                            near[text[a:b].lower()].add((context, m[0].lower()))
                            places[n].append((text[a:b].lower(), m[0].lower(), x + m.start(), x + m.end()))
    disclosed = set()
    for entity, seen in near.items():
        contexts = len({c for c, _ in seen})
        for term in {t for _, t in seen}:
            alone = documents_[term] / len(rows)
            given = (sum(t == term for _, t in seen) + pii.PRIOR * alone) / (contexts + pii.PRIOR)
            if math.log2(given / alone) >= pii.DISCLOSURE * -math.log2(contexts / (len(rows) + contexts)):
                disclosed.add((entity, term))
    want = sorted(str((rows[n][0], sorted({*base[n], *((x, 4, y) for e, t, x, y in places[n] if (e, t) in disclosed)}))) for n in range(len(rows)))
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, [(s.start, s.kind, s.end) for s in r.all])) for r in got) == want
    assert 0 < len(disclosed) < sum(len({t for _, t in x}) for x in near.values())


def test_overlaps_are_rewritten_as_one():
    assert pii.rewritten("0123456789", [(1, 0, 4), (2, 1, 6), (6, 2, 7), (8, 4, 9)]) == "0[EMAIL][CARD]7[CODE]9"
    assert pii.rewritten("abc", []) == "abc" and pii.rewritten("abc", [(0, 4, 3)]) == "[REDACTED]"


def test_attention_finds_the_passage():
    """One passage of a bag decides its label, by a share or by a word."""
    rng = np.random.default_rng(0)
    for by_word in (False, True):
        bags, labels = [], []
        for _ in range(900):
            n = rng.integers(1, 6)
            bag = mil.Bag(rng.standard_normal((n, mil.FEATURES)).astype(np.float32), rng.integers(0, 50, n * 20).astype(np.uint16), np.full(n, 20, np.int32))
            labels.append(float(rng.random() < 0.5))
            if labels[-1]:
                k = rng.integers(n)
                if by_word:
                    bag.buckets[20 * k : 20 * k + 10] = 77
                else:
                    bag.shares[k, 3] += 6
            bags.append(bag)
        weights = mil.fit(bags[:700], np.array(labels[:700]))
        score, attention = mil.score(weights, bags[700:])
        assert ((score >= 0.5) == np.array(labels[700:])).mean() > 0.85
        assert all(abs(a.sum() - 1) < 1e-6 for a in attention)


def test_a_score_equals_a_naive_forward_pass():
    """Passage by passage and word by word in plain loops."""
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["the", "Haus", "x1", "#", "und", "lorem"], n)).encode() for n in (1, 99, 100, 101, 350)] + [b"", None]
    w = mil.fit([mil.passages(t) for t in texts], np.array([0, 1, 0, 1, 1, 0, 0.0]))
    got, attention = mil.score(w, [mil.passages(t) for t in texts])
    for text, score, weights in zip(texts, got, attention):
        words = (text or b"").split()
        shares = mil.passages(text).shares
        encoded, raw = [], []
        for k in range(max(1, -(-len(words) // 100))):
            own = [zlib.crc32(x) % mil.BUCKETS for x in words[100 * k : 100 * k + 100]] or [mil.BUCKETS]
            mean = sum(w["t"][i] for i in own) / len(own)
            h = np.tanh(np.r_[(shares[k] - w["mean"]) / w["deviation"], mean] @ w["e"] + w["eb"])
            encoded.append(h)
            raw.append(sum(math.tanh(h @ w["v"][:, j]) / (1 + math.exp(-(h @ w["u"][:, j]))) * w["a"][j] for j in range(mil.GATE)))
        weight = [math.exp(x) / sum(map(math.exp, raw)) for x in raw]
        assert np.allclose(weights, weight, atol=1e-6) and len(shares) == len(weight)
        z = sum(a * h for a, h in zip(weight, encoded))
        assert abs(score - 1 / (1 + math.exp(-(z @ w["c"] + w["cb"][0])))) < 1e-6


def test_bags_survive_packing_and_the_sample_is_bounded(spark, monkeypatch):
    for text in (None, b"", b"a b c", b"x " * 250):
        bag = mil.passages(text)
        assert all(np.array_equal(a, b) for a, b in zip(bag, mil.unpacked(bag.packed())))
    docs = spark.createDataFrame([(i, "wort " * (300 if i % 2 else 30)) for i in range(60)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mil, "fit", lambda bags, y: seen.append((sum(len(b.words) for b in bags), len(bags))))
    q8.fitted(docs, labels)
    monkeypatch.setattr(q8, "PASSAGES", 20)
    q8.fitted(docs, labels)
    assert seen[0][1] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60)) and 17 <= seen[1][0] <= 20


def test_quality_scores(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(r.doc_id, 0 if (r.text or "").count("#") > 3 or r.doc_id % 7 == 0 else 1) for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()] + [(None, 1), (3, None)], "doc_id long, quality int")
    weights = q8.fitted(docs, labels)
    rows = q8.scored(docs, weights).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert q8.scored(empty(spark), weights).count() == 0
    # Labels of held-out rows change nothing; without labels the score is constant.
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    assert all(np.array_equal(weights[k], x) for k, x in q8.fitted(docs, flipped).items())
    none = q8.fitted(docs, labels.limit(0))
    assert {r.score for r in q8.scored(docs, none).collect()} == {0.5}


def small_vocabulary(n=50):
    counts = np.zeros(lm.IDS)
    counts[:n] = np.arange(n, 0, -1)
    counts[lm.END] = 3
    return lm.Vocabulary(counts, OPENS)


def test_gradients(monkeypatch):
    """The hand-written backward pass, which takes power() for exp(), against finite differences with exp()."""
    monkeypatch.setattr(lm, "power", np.exp)
    vocabulary = small_vocabulary()
    windows = lm.Windows(vocabulary, np.random.default_rng(3).integers(0, 50, 90), np.array([60, 0, 30]))
    w = lm.initial(vocabulary)
    loss = lambda w: -lm.log_probabilities(lm.Network(w, vocabulary), windows).sum() / 93
    trainer = lm.Trainer(w, vocabulary)
    trainer.show(windows)  # one batch: m is a tenth of the gradient
    for name in lm.shapes(vocabulary):
        grad = trainer.m[name] * 10
        direction = np.random.default_rng(5).standard_normal(grad.shape).astype(np.float32)
        if name == "e":
            direction[vocabulary.blank] = 0
        eps = 1e-2
        slope = (loss(w | {name: w[name] + eps * direction}) - loss(w | {name: w[name] - eps * direction})) / (2 * eps)
        taken = (grad * direction).sum()
        assert abs(slope - taken) < 2e-2 * max(0.05, abs(slope)), (name, slope, taken)


def test_every_batch_trains_every_layer():
    vocabulary = small_vocabulary()
    trainer = lm.Trainer(lm.initial(vocabulary), vocabulary)
    moved = []
    for seed in range(3):
        before = {n: x.copy() for n, x in trainer.w.items()}
        n = lm.BATCH * lm.NEW - 1
        trainer.show(lm.Windows(vocabulary, np.random.default_rng(seed).integers(0, 50, n), np.array([n])))
        moved.append(all((trainer.w[n] != x).any() for n, x in before.items()))
    assert trainer.steps == 3 and all(moved) and trainer.tokens == 3 * lm.BATCH * lm.NEW


def test_probabilities_are_causal_and_sum_to_one():
    vocabulary = small_vocabulary(300)
    w = lm.initial(vocabulary)
    net = lm.Network(w, vocabulary)
    ids = np.random.default_rng(2).integers(0, lm.IDS - 1, 100)
    score = lambda ids, lengths: lm.log_probabilities(net, lm.Windows(vocabulary, ids, np.array(lengths)))
    one = score(ids, [100])
    other = ids.copy()
    other[70:] = 5
    assert np.allclose(one[:70], score(other, [100])[:70], atol=1e-5)
    two = lm.Windows(vocabulary, np.r_[ids[:30], ids], np.array([30, 100]))
    assert np.allclose(lm.log_probabilities(net, two)[two.starts[1] :], one, atol=1e-4)
    # Over all ids that may come next, those that were never seen among them.
    after = np.r_[np.arange(300), lm.END]
    total = sum(np.exp(score(np.r_[ids[:40], i], [41])[40]) for i in after[:-1]) + np.exp(score(ids[:40], [40])[40])
    unseen = np.exp(score(np.r_[ids[:40], 5000], [41])[40])
    assert abs(total + unseen * (lm.IDS - 301) - 1) < 1e-3


def test_scores_equal_a_naive_forward_pass():
    """Token by token in plain loops: embeddings, attention over the inputs of the token's window, both levels of the output."""
    vocabulary = small_vocabulary(80)
    trainer = lm.Trainer(lm.initial(vocabulary), vocabulary)
    rng = np.random.default_rng(8)
    trainer.show(lm.Windows(vocabulary, rng.integers(0, 80, 4000), np.full(40, 100)))
    w = {n: x.astype(np.float64) for n, x in trainer.w.items()}

    def power(x):
        k = math.floor(x / math.log(2))
        return 2.0**k * (1 + x / math.log(2) - k)

    def naive(text):
        inputs = [vocabulary.symbol[lm.END], *(vocabulary.symbol[i] for i in text)]
        total = 0.0
        for t, target in enumerate([*inputs[1:], inputs[0]]):
            opening = t // lm.NEW * lm.NEW
            x = w["e"][inputs[t]]
            q = x @ w["a"][:, : lm.KEY]
            over, under = np.zeros(lm.DIM), 0.0
            for j in range(max(0, opening - lm.PAST), t + 1):
                y = w["e"][inputs[j]]
                weight = power(q @ (y @ w["a"][:, lm.KEY : 2 * lm.KEY])) * math.exp(w["r"][t - j])
                over, under = over + weight * (y @ w["a"][:, 2 * lm.KEY :]), under + weight
            u = x + over / under @ w["o"]
            h = np.r_[u / (1 + np.abs(u)), 1.0]
            k = int(vocabulary.cls[target])
            first = [power(v) for v in h @ w["c"]]
            within = [power(w["u"][i] @ h) for i in range(vocabulary.bounds[k], vocabulary.bounds[k + 1])]
            total += math.log(first[k] / sum(first)) + math.log(within[target - vocabulary.bounds[k]] / sum(within))
            total -= vocabulary.shared if target == vocabulary.unseen else 0
        return total

    texts = [rng.integers(0, 80, n) for n in (0, 1, 23, 24, 25, 70)] + [np.array([4, 9999, 5])]
    windows = lm.Windows(vocabulary, np.concatenate(texts), np.array([len(x) for x in texts]))
    got = np.add.reduceat(lm.log_probabilities(trainer.net, windows), windows.starts)
    assert np.allclose(got, [naive(x) for x in texts], rtol=2e-3)


def test_partitions_do_not_change_a_score(spark, monkeypatch):
    monkeypatch.setattr(q9, "SHARD", 3000)
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 500)) for i in range(200)], "doc_id long, text string")
    got = [{r.doc_id: r.score for r in q9.scores(docs.repartition(n)).collect()} for n in (1, 16)]
    assert len(got[0]) == 200 and all(abs(x - got[1][i]) < 1e-4 * abs(x) for i, x in got[0].items())


def test_words_encoded_together_are_those_encoded_alone():
    known = q9.Table(bpe.default_path())
    words = "don't it's a's 's x--y 12ab... \u00e4\u00f6 \u00a0lead trail\u00a0 in\u00a0side \u3000 \U0001f600! <|endoftext|> \x1cfs #$% 007 \u0085n".split(" ")
    rng = np.random.default_rng(12)
    texts = [[words[i].encode() for i in rng.integers(0, len(words), 9)] for _ in range(40)]
    for part in (texts[:3], texts[3:]):
        ids, lengths = known.subwords(known.places(part, sum(map(len, part))))
        cut = np.split(ids, np.cumsum(lengths)[:-1])
        assert [x.tolist() for x in cut] == [known.encode(" " + w.decode()) for t in part for w in t]


def test_places_of_words_are_those_of_a_dict(monkeypatch):
    """Words are looked up all at once by a hash of their bytes, also where all of them meet in one slot."""
    rng, hashes = np.random.default_rng(13), q9.byte_hashes
    words = [w for n in (0, 7, 8, 9, 250) for end in (b"", b"\0", b"\0\0", b"x", b"y") for m in (0, 1, 8) if (w := b"a" * n + end + b"b" * m)]
    words += [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in rng.integers(1, 12, 40_000).tolist()]
    for met, n in ((hashes, len(words)), (lambda *x: hashes(*x) << np.uint64(16), 400)):
        monkeypatch.setattr(q9, "byte_hashes", met)
        known, places = q9.Table(bpe.default_path()), {}
        for a in range(0, n, 9000):
            part = words[:n][a : a + 9000]
            for word, place in zip(part, known.places([part, []], len(part)).tolist()):
                assert places.setdefault(word, place) == place
        assert len(set(places.values())) == len(places) == len(known)
        assert known.places([[]], 0).tolist() == []


def test_logs_are_those_of_a_search():
    rng = np.random.default_rng(11)
    # Many hashes share their low bits, and some others do too without being known.
    some = np.unique(rng.integers(-(2**62), 2**62, 3000))
    hashes = np.unique(np.r_[some, some[:900] ^ (1 << 50)])
    logs, asked = rng.random(len(hashes)), np.r_[rng.permutation(hashes), some[900:] ^ (1 << 51), 0, -1]
    often, got = q9.Logs(hashes, logs).of(asked)
    known = dict(zip(hashes.tolist(), logs.tolist()))
    assert often.tolist() == [x in known for x in asked.tolist()]
    assert got.tolist() == [known.get(x, 0.0) for x in asked.tolist()]
    often, got = q9.Logs(np.zeros(0, np.int64), np.zeros(0)).of(asked)
    assert not often.any() and not got.any()


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(10)
    words = {tuple(rng.integers(0, lm.IDS, rng.integers(1, 5)).tolist()) for _ in range(20_000)}
    ids, starts = np.concatenate([np.array(w) for w in words]), np.cumsum([0, *map(len, words)])[:-1]
    assert len(set(q9.word_hashes(ids, starts).tolist())) == len(words)
    assert q9.word_hashes(ids[:3], np.array([0]))[0] == q9.word_hashes(np.r_[7, ids[:3]], np.array([0, 1]))[1]


def test_scores(spark):
    docs = documents(spark)
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = collections.Counter(x for r in rows if not held(r.doc_id) for x in words(r.text))
    n, bottom = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    want = collections.Counter((r.doc_id, held(r.doc_id), len(words(r.text)), sum(x in c for x in words(r.text)), n, round(sum(math.log10((c[x] + 0.5) / bottom) for x in words(r.text)), 5)) for r in rows)
    for few in (q9.FREQUENT, 5):
        q9.FREQUENT, before = few, q9.FREQUENT
        try:
            got = q9.scores(docs).collect()
        finally:
            q9.FREQUENT = before
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert q9.scores(empty(spark)).count() == 0


def test_training_helps():
    """One pass over texts of a simple rule brings the held-out loss well below that of the start."""
    rng = np.random.default_rng(4)
    make = lambda n: np.concatenate([np.tile(rng.integers(0, 20) * 2 + np.array([0, 1]), 30) for _ in range(n)])
    train, test = make(4000), make(20)
    counts = np.bincount(train, minlength=lm.IDS)
    counts[lm.END] = 4000
    vocabulary = lm.Vocabulary(counts, OPENS)
    trainer = lm.Trainer(lm.initial(vocabulary), vocabulary)
    trainer.show(lm.Windows(vocabulary, train, np.full(4000, 60)))
    held = lm.Windows(vocabulary, test, np.full(20, 60))
    mean = lambda w: lm.log_probabilities(lm.Network(w, vocabulary), held).sum() / 1220
    assert mean(trainer.w) > mean(lm.initial(vocabulary)) + 0.5
    assert all(np.array_equal(x, trainer.w[k]) for k, x in lm.unpacked(lm.packed(trainer.w), vocabulary).items())


def test_training_keeps_the_memory_of_freed_arrays():
    """A step of training takes few new pages from the system. Before, each array was mapped and zeroed anew."""
    steps, rng = 60, np.random.default_rng(6)
    ids = rng.integers(0, 2000, steps * lm.BATCH * lm.NEW - 1)
    run = q9._train(bpe.default_path(), np.bincount(np.r_[ids, lm.END], minlength=lm.IDS))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([ids.astype("<u2").tobytes()])], ["part", "ids"])
    list(run(iter([batch])))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    list(run(iter([batch])))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 250 * steps


def test_inputs_are_projected_once_a_symbol(monkeypatch):
    rows, projected = [], lm.Network.projected
    monkeypatch.setattr(lm.Network, "projected", lambda self, x, p: rows.append(len(x)) or projected(self, x, p))
    vocabulary = small_vocabulary()
    windows = lm.Windows(vocabulary, np.random.default_rng(3).integers(0, 50, 5000), np.array([5000]))
    trainer = lm.Trainer(lm.initial(vocabulary), vocabulary)
    trainer.show(windows)
    lm.log_probabilities(trainer.net, windows)
    # The symbols of the one batch, and all of the vocabulary with blank.
    assert len(rows) == 2 and rows[0] <= rows[1] == vocabulary.size + 1


def _small_batches(run, most):
    def checked(batches):
        def each():
            for b in batches:
                assert b.num_rows <= most, b.num_rows
                yield b

        yield from run(each())

    return checked


def test_texts_come_to_pii_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(pii, "_found", _small_batches(pii._found, 1000))
    counted = pii._counted
    monkeypatch.setattr(pii, "_counted", lambda *x: _small_batches(counted(*x), 1000))
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to a"), F.col("id"), F.lit("@example.com")).alias("text"))
    assert pii.spans(docs).agg(F.count("*"), F.sum("n_email")).first()[:] == (2500, 2500)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual


def test_texts_come_to_the_language_model_in_small_batches(spark, monkeypatch):
    read = q9._read
    monkeypatch.setattr(q9, "_read", lambda path: _small_batches(read(path), 1000))
    docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), q9.held_out(F.col("id")).alias("held_out"), F.lit("two words").alias("text"))
    assert q9.read(docs, q9.bpe.default_path()).filter("row is not null").count() == 2500
