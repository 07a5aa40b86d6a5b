"""A small causal self-attention language model in numpy, over subword ids.

One attention layer reads the symbols before a token. The output has two levels, both from
that context: the class of the next symbol, and the symbol within its class. Every id that
the training documents have is a symbol of its own, with its own embedding and its own
output; ids that they don't have are one symbol together and share its probability evenly.
Ids that open a word and ids that go on with one are in classes of their own, each of about
the same mass, as many classes as the root of the number of symbols.

Texts are cut into overlapping windows of PAST + NEW inputs of which the last NEW are
scored, so each token is scored once, with at least PAST inputs of context where the text
has them. All windows of a batch go through masked attention at once. How far back an input
lies adds a learned bias.

Where others take exp(x), power(x) is used throughout: whole powers of two and straight
lines between them. It costs a third, and as both levels divide by the sum of its values,
probabilities add up to one as before.
"""

from __future__ import annotations

import numpy as np

#: Width of embeddings and values, and of queries and keys.
DIM, KEY = 16, 8
PAST, NEW = 8, 24
END = 50256
IDS = 50257
#: Windows in one matrix product, and in one step of training.
BATCH = 256
RATE = 2e-2
SPAN = PAST + NEW
#: How far back each input of a window is from each target's own input; negative: not yet seen.
BACK = np.arange(NEW)[:, None] + PAST - np.arange(SPAN)[None, :]
_UNIT, _ONE, _LEAST, _MOST = (np.float32(x) for x in (2**23 / np.log(2), 127 * 2**23, 2**23, 2.1e9))


def power(x: np.ndarray) -> np.ndarray:
    """exp(x) with straight lines between whole powers of two; x is used up."""
    x *= _UNIT
    x += _ONE
    np.clip(x, _LEAST, _MOST, out=x)
    # One dimension, as only then numpy converts in place, without a copy.
    flat = x.reshape(-1)
    np.copyto(flat.view(np.int32), flat, casting="unsafe")
    return flat.reshape(x.shape)


class Vocabulary:
    """Symbols of ids, and their classes, from corpus counts.

    opens: which ids open a word. symbol: of each id; the symbols of a class follow one
    another, class k from bounds[k] on. The last two symbols are no targets: unseen as an
    input of its own kind is, blank stands outside the texts.
    """

    def __init__(self, counts: np.ndarray, opens: np.ndarray):
        seen = np.flatnonzero(counts > 0)
        # The unseen ids take part as one, the last, which opens no word.
        mass = np.r_[counts[seen].astype(np.float64), 0.5]
        first = np.r_[opens[seen], False]
        self.size = len(mass)
        root = self.size**0.5
        most = max(2, int(4 * root))
        cls = np.empty(self.size, np.int64)
        order = np.argsort(-mass, kind="stable")
        n = 0
        for own in (order[first[order]], order[~first[order]]):
            held, members = 0.0, 0
            for i in own.tolist():
                if members and (members >= most or held >= mass.sum() / max(1.0, 0.6 * root)):
                    held, members, n = 0.0, 0, n + 1
                cls[i] = n
                held, members = held + mass[i], members + 1
            n += members > 0
        by_class = np.lexsort((np.arange(self.size), -mass, cls))
        place = np.empty(self.size, np.int32)
        place[by_class] = np.arange(self.size)
        self.symbol = np.full(IDS, place[-1], np.int32)
        self.symbol[seen] = place[:-1]
        self.unseen, self.blank = int(place[-1]), self.size
        self.shared = np.float32(np.log(max(1, IDS - len(seen))))
        self.cls = cls[by_class].astype(np.uint16)
        self.bounds = np.searchsorted(self.cls, np.arange(n + 1))
        self.classes = n
        self.mass = mass[by_class]


def shapes(vocabulary: Vocabulary) -> dict[str, tuple[int, ...]]:
    """e: embeddings (that of blank is never learnt); a: q, k and v side by side; r: bias by distance; c, u: output by class and by symbol, the bias last."""
    return {"e": (vocabulary.size + 1, DIM), "a": (DIM, 2 * KEY + DIM), "o": (DIM, DIM), "r": (SPAN,), "c": (DIM + 1, vocabulary.classes), "u": (vocabulary.size, DIM + 1)}


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    out = {n: (rng.standard_normal(s) * 0.15).astype(np.float32) for n, s in shapes(vocabulary).items()}
    out["r"] = -np.log1p(np.arange(SPAN, dtype=np.float32))
    mass = np.add.reduceat(vocabulary.mass, vocabulary.bounds[:-1])
    out["c"][DIM] = np.log(mass / mass.sum())
    out["u"][:, DIM] = np.log(vocabulary.mass / mass[vocabulary.cls])
    return out


def packed(weights: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([weights[n].ravel() for n in ("e", "a", "o", "r", "c", "u")]).astype("<f4").tobytes()


def unpacked(data: bytes, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for n, s in shapes(vocabulary).items():
        size = int(np.prod(s))
        out[n] = flat[at : at + size].reshape(s).astype(np.float32)
        at += size
    return out


class Windows:
    """The windows of texts: ids of the texts end to end, and how many each text has. An end behind each text is predicted too."""

    def __init__(self, vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray):
        steps = np.asarray(lengths, np.int64) + 1
        count = -(-steps // NEW)
        self.vocabulary, self.steps = vocabulary, steps
        #: Of each text the first window, and the first place in a table of NEW places a window.
        self.opening = np.cumsum(count) - count
        self.starts = self.opening * NEW
        n = int(count.sum())
        at = np.arange(len(ids)) + np.repeat(self.starts - (np.cumsum(lengths) - lengths), lengths)
        symbols, end = vocabulary.symbol[ids], vocabulary.symbol[END]
        stream = np.full(PAST + n * NEW, vocabulary.blank, np.int32)
        stream[PAST + self.starts] = end
        stream[PAST + 1 + at] = symbols
        self.targets = np.full(n * NEW, vocabulary.blank, np.int32)
        self.targets[at] = symbols
        self.targets[self.starts + steps - 1] = end
        self.rows = np.lib.stride_tricks.sliding_window_view(stream, SPAN)[::NEW] if n else stream[:0].reshape(0, SPAN)
        self.first = np.zeros(n, bool)
        self.first[self.opening] = True

    def batches(self):
        """symbols (B, SPAN) and targets (B * NEW), blank where a window goes beyond its text."""
        for a in range(0, len(self.rows), BATCH):
            symbols = self.rows[a : a + BATCH].copy()
            symbols[self.first[a : a + BATCH], :PAST] = self.vocabulary.blank
            yield symbols, self.targets[a * NEW : (a + len(symbols)) * NEW]


#: Added to the logarithm of attention to what stands outside the texts.
MASK = -30
#: Columns of an input's projection: q and a 1, which is times the mask; k and the mask; v and a 1, which adds up attention.
Q, K, V = slice(0, KEY + 1), slice(KEY + 1, 2 * KEY + 2), slice(2 * KEY + 2, 2 * KEY + DIM + 3)


class Network:
    """The weights, in the layout of the products when they are asked for: mask and sum of attention ride along as columns."""

    def __init__(self, w: dict[str, np.ndarray], vocabulary: Vocabulary):
        self.w, self.vocabulary = w, vocabulary

    def projection(self) -> np.ndarray:
        """From embeddings to the columns Q, K and V. The values pass through w["o"] here, not after they are added up, which is the same."""
        out = np.zeros((DIM, V.stop), np.float32)
        out[:, :KEY], out[:, K.start : K.stop - 1] = self.w["a"][:, :KEY], self.w["a"][:, KEY : 2 * KEY]
        out[:, V.start : V.stop - 1] = self.w["a"][:, 2 * KEY :] @ self.w["o"]
        return out

    def projected(self, x: np.ndarray, projection: np.ndarray) -> np.ndarray:
        """Of the embeddings x, none of them that of blank."""
        out = x @ projection
        out[:, KEY] = out[:, -1] = 1
        return out

    def bias(self) -> np.ndarray:
        return np.where(BACK >= 0, np.exp(np.minimum(self.w["r"], 30)[np.maximum(BACK, 0)]), 0).astype(np.float32)

    def hidden(self, x: np.ndarray, table: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
        """x: embeddings; table: what projected() makes of them; places (B, SPAN): the rows of both that are the inputs."""
        all_ = np.take(table, places, axis=0)
        q, k, v = all_[:, PAST:, Q], all_[:, :, K], all_[:, :, V]
        a = power(q @ k.transpose(0, 2, 1))
        a *= self.bias()
        o = (a @ v).reshape(-1, DIM + 1)
        z = o[:, DIM:] + np.float32(1e-20)
        o = o[:, :DIM] / z
        u = np.take(x, places[:, PAST:].ravel(), axis=0)
        u += o
        return {"q": q, "k": k, "v": v, "a": a, "z": z, "o": o, "u": u}


def squashed(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u / (1 + |u|) and a 1 in each row, and 1 + |u|."""
    h, under = np.empty((len(u), DIM + 1), np.float32), np.abs(u)
    under += 1
    h[:, DIM] = 1
    np.divide(u, under, out=h[:, :DIM])
    return h, under


_SUM: dict[int, np.ndarray] = {}


def _row_sums(p: np.ndarray) -> np.ndarray:
    """As a product, which is faster than a sum along rows."""
    return p @ _SUM.setdefault(p.shape[1], np.ones(p.shape[1], np.float32))


#: Rows of tall matrices that are multiplied at once. All rows at once take up to twice the time.
TALL = 256


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for a tall a."""
    n = len(a) // TALL
    out = np.empty((len(a), b.shape[1]), np.float32)
    np.matmul(a[: n * TALL].reshape(n, TALL, a.shape[1]), b, out=out[: n * TALL].reshape(n, TALL, b.shape[1]))
    np.matmul(a[n * TALL :], b, out=out[n * TALL :])
    return out


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for tall a and b."""
    n = len(a) // TALL
    parts = a[: n * TALL].reshape(n, TALL, a.shape[1]).transpose(0, 2, 1) @ b[: n * TALL].reshape(n, TALL, b.shape[1])
    return parts.sum(axis=0) + a[n * TALL :].T @ b[n * TALL :]


class Inner:
    """The second level for targets, none of them blank and sorted by class: values of the symbols in the class of each, end to end."""

    def __init__(self, u: np.ndarray, h: np.ndarray, targets: np.ndarray, cls: np.ndarray, vocabulary: Vocabulary):
        members, each = np.diff(vocabulary.bounds), np.bincount(cls, minlength=vocabulary.classes)
        self.widths = np.repeat(members, each)
        ends = np.cumsum(self.widths)
        self.starts = ends - self.widths
        values = np.zeros(int(ends[-1]) if len(ends) else 0, np.float32)
        #: Of each class that is there and has several symbols: its rows, its symbols, where its values are, their shape.
        self.parts = []
        row = at = 0
        for k in np.flatnonzero(each).tolist():
            n, m = int(each[k]), int(members[k])
            if m > 1:
                symbols, out = slice(int(vocabulary.bounds[k]), int(vocabulary.bounds[k + 1])), slice(at, at + n * m)
                self.parts.append((slice(row, row + n), symbols, out, (n, m)))
                np.matmul(h[row : row + n], u[symbols].T, out=values[out].reshape(n, m))
            row, at = row + n, at + n * m
        self.values = power(values)
        self.own = self.starts + (targets - vocabulary.bounds[cls])
        self.sums = np.add.reduceat(self.values, self.starts) if len(self.starts) else self.values


def _by_class(targets: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The places of targets that are not blank, sorted by class."""
    use = np.flatnonzero(targets != vocabulary.blank)
    return use[np.argsort(vocabulary.cls[targets[use]], kind="stable")]


def log_probabilities(net: Network, windows: Windows) -> np.ndarray:
    """Natural log of the probability of each place of windows.targets, 0 where it is blank."""
    voc, out = windows.vocabulary, np.zeros(len(windows.targets), np.float64)
    table = net.projected(net.w["e"], net.projection())
    table[voc.blank, K.stop - 1] = MASK
    at = 0
    for symbols, targets in windows.batches():
        use = _by_class(targets, voc)
        h, _ = squashed(np.take(net.hidden(net.w["e"], table, symbols)["u"], use, axis=0))
        own = targets[use]
        cls = voc.cls[own]
        p = power(_times(h, net.w["c"]))
        inner = Inner(net.w["u"], h, own, cls, voc)
        share = p[np.arange(len(own)), cls] / _row_sums(p) * (inner.values[inner.own] / inner.sums)
        out[at + use] = np.log(np.maximum(share, np.float32(1e-37))) - np.where(own == voc.unseen, voc.shared, np.float32(0))
        at += len(targets)
    return out


class Trainer:
    """Adam over all windows of the texts it is shown, one pass; embeddings that a batch doesn't have stay as they are."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: Vocabulary):
        #: All but the embeddings take each step together: their names, and how many numbers they are.
        self.dense = [n for n in weights if n != "e"]
        size = sum(weights[n].size for n in self.dense)
        self.flat = {kind: np.zeros(size, np.float32) for kind in "wgms"}
        self.w, self.g, self.m, self.s = ({"e": np.zeros_like(weights["e"])} for _ in range(4))
        at = 0
        for n in self.dense:
            for kind, own in zip("wgms", (self.w, self.g, self.m, self.s)):
                own[n] = self.flat[kind][at : at + weights[n].size].reshape(weights[n].shape)
            at += weights[n].size
        for n, x in weights.items():
            self.w[n][...] = x
        self.net = Network(self.w, vocabulary)
        self.steps = self.tokens = 0

    def show(self, windows: Windows) -> None:
        for symbols, targets in windows.batches():
            self.step(symbols, targets)

    def step(self, symbols: np.ndarray, targets: np.ndarray) -> None:
        w, g, d, voc = self.w, self.g, DIM, self.net.vocabulary
        # The symbols of the batch, each once, and where they are. Blank is the last, if it is there.
        marks = symbols.ravel()
        by = np.argsort(marks.astype(np.uint16 if voc.size < 1 << 16 else np.int32), kind="stable")
        marks = marks[by]
        first = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
        touched = marks[first]
        places = np.empty(symbols.shape, np.intp)
        places.ravel()[by] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(marks)]))
        x, projection = w["e"][touched], self.net.projection()
        table = self.net.projected(x, projection)
        if touched[-1] == voc.blank:
            table[-1, K.stop - 1] = MASK
        f = self.net.hidden(x, table, places)
        use = _by_class(targets, voc)
        h, under = squashed(np.take(f["u"], use, axis=0))
        own = targets[use]
        cls, n, each = voc.cls[own], len(own), np.float32(1 / len(own))
        # Both levels of the output.
        p = power(_times(h, w["c"]))
        p *= (each / _row_sums(p))[:, None]
        p[np.arange(n), cls] -= each
        second = Inner(w["u"], h, own, cls, voc)
        values = second.values
        values *= np.repeat(each / second.sums, second.widths)
        values[second.own] -= each
        self.flat["g"][:] = 0
        g["c"][...] = _crossed(h, p)
        dh = _times(p, w["c"][:d].T)
        for rows, of, where, shape in second.parts:
            inner = values[where].reshape(shape)
            np.matmul(inner.T, h[rows], out=g["u"][of])
            dh[rows] += inner @ w["u"][of, :d]
        dh /= under
        dh /= under
        du = np.zeros((len(targets), d), np.float32)
        du[use] = dh
        # Attention, not divided by its sum z: that is done to what comes back.
        many = len(symbols)
        back = np.empty((len(targets), d + 1), np.float32)
        do = back[:, :d]
        np.divide(du, f["z"], out=do)
        np.negative(np.einsum("ij,ij->i", do, f["o"]), out=back[:, d])
        back = back.reshape(many, NEW, d + 1)
        ds = back @ f["v"].transpose(0, 2, 1)
        ds *= f["a"]
        g["r"][:] = np.bincount(np.maximum(BACK, 0).ravel(), (ds.sum(axis=0) * (BACK >= 0)).ravel(), SPAN)
        dall = np.empty((many, SPAN, V.stop), np.float32)
        dall[:, :PAST, Q] = 0
        np.matmul(ds, f["k"], out=dall[:, PAST:, Q])
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=dall[:, :, K])
        np.matmul(f["a"].transpose(0, 2, 1), back, out=dall[:, :, V])
        flat = dall.reshape(-1, V.stop)
        da = _crossed(np.take(x, places.ravel(), axis=0), flat)
        dv = da[:, V.start : V.stop - 1]
        g["a"][:, :KEY], g["a"][:, KEY : 2 * KEY], g["a"][:, 2 * KEY :] = da[:, :KEY], da[:, K.start : K.stop - 1], dv @ w["o"].T
        np.matmul(w["a"][:, 2 * KEY :].T, dv, out=g["o"])
        dx = _times(flat, projection.T).reshape(many, SPAN, d)
        dx[:, PAST:] += du.reshape(many, NEW, d)
        # Two columns at a time, as complex numbers, are added in half the time.
        sums = np.add.reduceat(np.take(dx.reshape(-1, d), by, axis=0).view(np.complex64), first, axis=0).view(np.float32)
        if touched[-1] == voc.blank:
            touched, sums = touched[:-1], sums[:-1]
        self.tokens += n
        self.steps += 1
        rate = np.float32(RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps))
        self.flat["w"] -= _adam(self.flat["m"], self.flat["s"], self.flat["g"], rate)
        m, s = self.m["e"][touched], self.s["e"][touched]
        w["e"][touched] -= _adam(m, s, sums, rate)
        self.m["e"][touched], self.s["e"][touched] = m, s


def _adam(m: np.ndarray, s: np.ndarray, g: np.ndarray, rate: np.float32) -> np.ndarray:
    """The step; m and s are brought up to date, g is used up."""
    m *= np.float32(0.9)
    s *= np.float32(0.999)
    m += np.float32(0.1) * g
    g *= g
    g *= np.float32(0.001)
    s += g
    np.sqrt(s, out=g)
    g += np.float32(1e-8)
    np.divide(m, g, out=g)
    g *= rate
    return g
