"""Gated-attention multiple-instance learning in numpy: bags of passages, one label a bag.

A passage is encoded from its own words: the mean of learned embeddings of the words, by
hashed buckets, and shares of its characters and words. Nothing about the whole document
goes past the attention.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np

WORDS = 100
FEATURES = 17
BUCKETS, WIDTH = 4096, 8
HIDDEN, GATE = 16, 8
EPOCHS, BAGS, RATE = 15, 64, 1e-2


class Bag(NamedTuple):
    """Passages of a document: shares (n, FEATURES), the buckets of all their words in order, words of each passage."""

    shares: np.ndarray
    buckets: np.ndarray
    words: np.ndarray

    def packed(self) -> bytes:
        return np.int32(len(self.words)).tobytes() + self.words.astype("<i4").tobytes() + self.shares.astype("<f4").tobytes() + self.buckets.astype("<u2").tobytes()


def unpacked(data: bytes) -> Bag:
    n = int(np.frombuffer(data, "<i4", 1)[0])
    words = np.frombuffer(data, "<i4", n, 4)
    shares = np.frombuffer(data, "<f4", n * FEATURES, 4 + 4 * n).reshape(n, FEATURES)
    return Bag(shares, np.frombuffer(data, "<u2", int(words.sum()), 4 + 4 * n * (1 + FEATURES)), words)


#: Class of each byte: letters, digits, spaces, marks, bytes of other characters.
CLASS = np.full(256, 9, np.uint8)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&|<>", b".", b",;:", b"!?")):
    CLASS[np.frombuffer(_set, np.uint8)] = _i
CLASS[128:] = 10
N_CLASSES = 11
#: Common short words of several languages.
COMMON = frozenset(b"the of and to in is that it was for on are with as be at by this from der die und den von zu das mit sich des auf im dem nicht ein eine de la que el en los del se las por un para con no una su al le les du une et qui dans pour par sur au avec est pas".split())


def passages(text: bytes | None) -> Bag:
    """A passage for each WORDS words of the whole text; a text without words has one passage, of one word of a bucket of its own."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return Bag(np.zeros((1, FEATURES), np.float32), np.array([BUCKETS], np.uint16), np.ones(1, np.int32))
    data = np.frombuffer(text, np.uint8)
    kinds = CLASS[data]
    blank = (kinds == 3) | (kinds == 4)
    opens = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    starts = np.arange(0, n, WORDS)
    count = len(starts)
    bounds = opens[starts]
    bounds[0] = 0
    part = np.repeat(np.arange(count), np.diff(np.r_[bounds, len(data)]))
    shares = np.bincount(part * N_CLASSES + kinds, minlength=count * N_CLASSES).reshape(count, N_CLASSES).astype(np.float64)
    size = shares.sum(axis=1)
    shares /= size[:, None]
    marks = np.fromiter(map(zlib.crc32, words), np.int64, n)
    three = np.zeros(n, np.int64)
    if n > 2:
        three[2:] = marks[:-2] * 31 + marks[1:-1] * 1_000_003 + marks[2:]
    seen = np.ones(n, bool)
    seen[np.unique(three, return_index=True)[1]] = False
    if n > 2:
        seen[:2] = False
    per = np.diff(np.r_[starts, n])
    share = lambda x: np.add.reduceat(x.astype(np.float64), starts) / per
    common = np.fromiter((w in COMMON for w in words), bool, n)
    lengths = np.fromiter(map(len, words), np.float64, n)
    own = np.array([len(set(words[a : a + WORDS])) for a in starts]) / per
    out = np.concatenate([
        shares,
        np.stack([share(common), share(seen), own, share(lengths) / 10, np.sqrt(np.maximum(share(lengths**2) - share(lengths) ** 2, 0)) / 10, np.log1p(per) / 5], axis=1),
    ], axis=1)
    return Bag(out.astype(np.float32), (marks % BUCKETS).astype(np.uint16), per.astype(np.int32))


def initial() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    draw = lambda *shape: rng.standard_normal(shape) * 0.3
    return {"t": draw(BUCKETS + 1, WIDTH), "e": draw(FEATURES + WIDTH, HIDDEN), "eb": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "cb": np.zeros(1)}


def joined(bags: list[Bag]) -> tuple[Bag, np.ndarray]:
    """The passages of all bags end to end, and where each bag begins."""
    return Bag(*map(np.concatenate, zip(*bags))), np.cumsum([0, *(len(b.words) for b in bags[:-1])])


def forward(w: dict[str, np.ndarray], x: Bag, starts: np.ndarray) -> dict[str, np.ndarray]:
    """x: passages of all bags end to end; starts: where each bag begins."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x.words)]))
    mean = np.add.reduceat(w["t"][x.buckets], np.cumsum(x.words) - x.words, axis=0) / x.words[:, None]
    inputs = np.concatenate([(x.shares - w["mean"]) / w["deviation"], mean], axis=1)
    h = np.tanh(inputs @ w["e"] + w["eb"])
    t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    raw = (t * s) @ w["a"]
    e = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
    attention = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(h * attention[:, None], starts, axis=0)
    score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -30, 30)))
    return {"bag": bag, "inputs": inputs, "h": h, "t": t, "s": s, "attention": attention, "z": z, "score": score}


def fit(bags: list[Bag], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Weights with the mean and deviation of the shares; a constant score where labels are all alike."""
    n = len(bags)
    stack = np.concatenate([b.shares for b in bags]) if n else np.zeros((1, FEATURES))
    w = initial() | {"mean": stack.mean(axis=0, dtype=np.float64), "deviation": stack.std(axis=0, dtype=np.float64) + 1e-3}
    if not 0 < labels.sum() < n:
        rate = (labels.sum() + 1) / (n + 2)
        return w | {"c": np.zeros(HIDDEN), "cb": np.array([np.log(rate / (1 - rate))])}
    rng = np.random.default_rng(13)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BAGS):
            x, starts = joined([bags[i] for i in order[a : a + BAGS]])
            y = labels[order[a : a + BAGS]]
            f = forward(w, x, starts)
            dlogit = (f["score"] - y) / len(y)
            dz = dlogit[:, None] * w["c"]
            g = {"c": f["z"].T @ dlogit, "cb": np.array([dlogit.sum()])}
            dh = dz[f["bag"]] * f["attention"][:, None]
            da = (dz[f["bag"]] * f["h"]).sum(axis=1)
            draw = f["attention"] * (da - np.add.reduceat(da * f["attention"], starts)[f["bag"]])
            g["a"] = (f["t"] * f["s"]).T @ draw
            dt = draw[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2)
            ds = draw[:, None] * w["a"] * f["t"] * f["s"] * (1 - f["s"])
            g["v"], g["u"] = f["h"].T @ dt, f["h"].T @ ds
            dh += dt @ w["v"].T + ds @ w["u"].T
            de = dh * (1 - f["h"] ** 2)
            g["e"], g["eb"] = f["inputs"].T @ de, de.sum(axis=0)
            each = np.repeat(de @ w["e"][FEATURES:].T / x.words[:, None], x.words, axis=0)
            g["t"] = np.stack([np.bincount(x.buckets, each[:, k], BUCKETS + 1) for k in range(WIDTH)], axis=1)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in g:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                w[k] = w[k] - rate * (m[k] / (np.sqrt(v[k]) + 1e-8) + 1e-4 * w[k])
    return w


def score(w: dict[str, np.ndarray], bags: list[Bag]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Score of each bag, and the attention of its passages."""
    if not bags:
        return np.zeros(0), []
    x, starts = joined(bags)
    f = forward(w, x, starts)
    return f["score"], np.split(f["attention"], starts[1:])
