"""Language-model scores of whole documents, learnt from the training documents.

Base: unigrams over words, with counts over all training documents. Model: causal
self-attention over subword ids (attention_lm). Every training document is learnt from
whole, in every layer, once.

1. One pass over the texts makes the subword ids of each document, with marks where words
   begin, and counts words and ids. A word is known by a 64-bit hash of its ids from here on.
2. The training documents are dealt to shards by a hash of doc_id and text, about SHARD
   tokens each, MAX_SHARDS at most, and each shard is trained on from the same start in the
   order of that hash. The weights are averaged by tokens, in a tree of tables. Shards follow
   from the rows alone, so partitions and tasks don't change a score.
3. One pass over the ids gives the model's score and the base of the FREQUENT words at most
   whose counts go to all tasks; the other words are joined with the counts by their hash.

Nothing that is broadcast grows with the corpus: FREQUENT words, a count for each subword
id, and one set of weights. Tables of words in a task are emptied at CACHED entries.

Defined cases: null text is the empty text, which has the end token only; rows with a null
doc_id are training documents; repeated rows are scored each and count each; without
training documents all counts are 0 and the weights stay as they began; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import attention_lm as lm
from maskwright.llm import bpe
from maskwright.llm.common import TEXTS, held, released, stored, table

FREQUENT = 250_000
CACHED = 800_000
SHARD = 4_000_000
MAX_SHARDS = 4096
#: Bytes of text, and subword ids, that are handled at once in a task.
CHUNK = 1 << 19
TRAINED = 1 << 18
FAN = 16
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, lm.IDS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.lower() and bytes.split() work on A-Z and on [\\x20\\x09-\\x0D] alone."""
    return text.lower().split() if text else []


def word_hashes(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ids of each word; starts: where the words begin in ids."""
    if not len(starts):
        return np.zeros(0, np.int64)
    at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
    weights = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(at.max()), _STEP)])
    out = np.add.reduceat(_FACTORS[ids] * weights[at], starts)
    out ^= out >> np.uint64(32)
    out *= _STEP
    return (out ^ (out >> np.uint64(29))).view(np.int64)


#: The end of a text counts as a word. No other word has this id.
END_HASH = int(word_hashes(np.array([lm.END]), np.array([0]))[0])


#: The first n bytes of eight, and how many bytes of a word are mixed eight at a time.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64, which map different numbers to different numbers; x is used up."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def byte_hashes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of data. Words of eight bytes at most and the same length never share one."""
    eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    out = lengths.astype(np.uint64) * _STEP
    which = np.arange(len(lengths))
    for at in range(0, LONG, 8):
        which = which[lengths[which] > at]
        if not len(which):
            break
        x = eights[starts[which] + at]
        x &= _BYTES[np.minimum(lengths[which] - at, 8)]
        x ^= out[which]
        out[which] = _mixed(x)
    for i in np.flatnonzero(lengths > LONG).tolist():
        word = data[starts[i] : starts[i] + lengths[i]]
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


class Table:
    """word -> its place; for each place the subword ids. Words are told apart by a 64-bit hash of their bytes, and looked up all at once."""

    def __init__(self, path: str):
        self.encode, self.opens = bpe.encoder(path).encode, bpe.encoder(path).opens(lm.IDS)
        self.reset()

    def reset(self) -> None:
        self.ids, self.starts, self.lengths = array("i"), array("i"), array("i")
        #: Hash of the word at each place, and places by the low bits of the hash, or in the next slot that was free; negative: free.
        self.keys, self.slots = np.zeros(1 << 14, np.uint64), np.full(1 << 16, -1, np.int32)

    def __len__(self) -> int:
        return len(self.lengths)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The places of words, negative for those not met before."""
        mask = len(self.slots) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            place = self.slots[at[wrong]]
            out[wrong] = place
            wrong = wrong[(place >= 0) & (self.keys[place] != keys[wrong])]
        return out

    def _enter(self, keys: np.ndarray, before: int) -> None:
        """New words, the first of them at the place before. At most a quarter of the slots are taken."""
        n = before + len(keys)
        if n > len(self.keys):
            size = 1 << (n - 1).bit_length()
            self.keys = np.r_[self.keys[:before], np.zeros(size - before, np.uint64)]
            self.slots = np.full(4 * size, -1, np.int32)
            keys, before = np.r_[self.keys[:before], keys], 0
        self.keys[before:n] = keys
        mask = len(self.slots) - 1
        at, places = (keys & np.uint64(mask)).astype(np.int64), np.arange(before, n, dtype=np.int32)
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]
            # Of several words that came to a slot together one has got it.
            lost = self.slots[at] != places
            at, places = (at[lost] + 1) & mask, places[lost]

    def places(self, words: list[list[bytes]], n: int) -> np.ndarray:
        """The places of n words; those not met before are encoded together."""
        data = b" ".join(chain.from_iterable(words))
        stops = np.flatnonzero(np.frombuffer(data + b" ", np.uint8) == 32)[:n]
        starts = np.r_[0, stops[:-1] + 1][:n]
        keys, before = byte_hashes(data, starts, stops - starts), len(self)
        out = self._found(keys)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        fresh, first, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
        out[missing] = before + inverse
        first = missing[first]
        new = [data[a:b].decode() for a, b in zip(starts[first].tolist(), stops[first].tolist())]
        text = "".join(" " + w for w in new)
        # In this pre-tokenisation a space always begins a group, and so a word, where no other white space is next to it.
        if text.split() == new:
            self._add(self.encode(text))
        else:
            for alone, run in groupby(new, lambda w: w.split() != [w]):
                if alone:
                    for w in run:
                        self._add(self.encode(" " + w), cut=False)
                else:
                    self._add(self.encode("".join(" " + w for w in run)))
        self._enter(fresh, before)
        return out

    def _add(self, ids: list[int], cut: bool = True) -> None:
        """New words, each from an id that opens a word on, or all ids as one word."""
        ids = np.array(ids, np.int32)
        starts = np.flatnonzero(self.opens[ids]) if cut else np.zeros(1, np.int64)
        self.starts.frombytes((starts + len(self.ids)).astype(np.int32).tobytes())
        self.lengths.frombytes(np.diff(np.r_[starts, len(ids)]).astype(np.int32).tobytes())
        self.ids.frombytes(ids.tobytes())

    def subwords(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at places, end to end, and how many each word has."""
        # The buffers are let go at once, as an array can't grow while one is held.
        starts, lengths = (np.frombuffer(x, np.int32)[places] for x in (self.starts, self.lengths))
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return np.frombuffer(self.ids, np.int32)[at], lengths

    def hashes(self) -> np.ndarray:
        return word_hashes(np.frombuffer(self.ids, np.int32).copy(), np.frombuffer(self.starts, np.int32).copy()) if self else np.zeros(0, np.int64)


class Logs:
    """Base log10 of the words of given hashes. Most are found where the low bits of their hash point."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        """hashes: sorted."""
        self.hashes, self.logs = np.r_[hashes, np.int64(0)], np.r_[logs, 0.0]
        self.known, self.last = np.r_[np.ones(len(hashes), bool), False], len(hashes)
        self.mask = np.int64((1 << max(4, len(hashes)).bit_length() + 3) - 1)
        slots = hashes & self.mask
        self.slots = np.full(int(self.mask) + 1, self.last, np.int32)
        self.slots[slots] = np.arange(self.last)
        #: Slots that several hashes point to.
        self.shared = np.bincount(slots, minlength=len(self.slots)) > 1

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are known, and their logs, 0 for others."""
        slots = words & self.mask
        at = self.slots[slots]
        again = np.flatnonzero(self.shared[slots])
        at[again] = np.searchsorted(self.hashes[: self.last], words[again])
        often = self.known[at] & (self.hashes[at] == words)
        return often, np.where(often, self.logs[at], 0.0)


#: What this Python worker keeps for the tasks it gets: of the last run that asked for it.
_KEPT: dict[str, object] = {}


def _kept(run: str, make: Callable) -> object:
    if run not in _KEPT:
        _KEPT.clear()
        _KEPT[run] = make()
    return _KEPT[run]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
    """The other columns and the words of documents, a few at a time; text is the last column."""
    rows, words, size = [], [], 0
    for batch in batches:
        others = [c.to_pylist() for c in batch.columns[:-1]]
        for i, x in enumerate(batch.columns[-1]):
            text = x.as_py() or b""
            rows.append(tuple(c[i] for c in others))
            words.append(words_of(text))
            size += len(text) + 64
            if size >= CHUNK:
                yield rows, words
                rows, words, size = [], [], 0
    if rows:
        yield rows, words


#: Documents (row to opens: the ids as unsigned 16-bit numbers, and a bit for each that begins a word), counts of words, counts of ids.
READ = "row long, doc_id long, held_out boolean, mark long, ids binary, opens binary, word long, id long, n long"
_READ_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_READ_FIELDS = [(x.split()[0], _READ_TYPES[x.split()[1]]) for x in READ.split(", ")]


def _rows(size: int, **columns) -> pa.RecordBatch:
    """A batch of READ with these columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(size, kind) for name, kind in _READ_FIELDS], [name for name, _ in _READ_FIELDS])


def _read(path: str) -> Callable:
    key = uuid.uuid4().hex

    def counted(names: np.ndarray, counts: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
        there = np.flatnonzero(counts)
        for a in range(0, len(there), 50_000):
            part = there[a : a + 50_000]
            yield _rows(len(part), **{kind: names[part], "n": counts[part]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _kept(key, lambda: Table(path))
        words_seen, ids_seen = np.zeros(0, np.int64), np.zeros(lm.IDS, np.int64)
        for rows, words in _chunks(batches):
            if len(known) >= CACHED:
                yield from counted(known.hashes(), words_seen[: len(known)], "word")
                known.reset()
                words_seen = np.zeros(0, np.int64)
            n_words = np.array([len(w) for w in words])
            places = known.places(words, int(n_words.sum()))
            ids, lengths = known.subwords(places)
            train = ~np.array([r[2] for r in rows])
            if len(known) > len(words_seen):
                words_seen = np.r_[words_seen, np.zeros(len(known), np.int64)]
            np.add.at(words_seen, places[np.repeat(train, n_words)], 1)
            stops = np.r_[0, np.cumsum(lengths)][np.cumsum(n_words)]
            starts = np.r_[0, stops[:-1]]
            ids_seen += np.bincount(ids[np.repeat(train, stops - starts)], minlength=lm.IDS)
            ids_seen[lm.END] += int(train.sum())
            opens = np.zeros(len(ids), bool)
            opens[np.cumsum(lengths) - lengths] = True
            data = ids.astype("<u2").tobytes()
            columns = dict(zip(("row", "doc_id", "held_out", "mark"), zip(*rows)))
            yield _rows(len(rows), **columns, ids=[data[2 * a : 2 * b] for a, b in zip(starts, stops)], opens=[np.packbits(opens[a:b]).tobytes() for a, b in zip(starts, stops)])
        yield from counted(known.hashes()[: len(words_seen)], words_seen[: len(known)], "word")
        yield from counted(np.arange(lm.IDS), ids_seen, "id")
        released()

    return run


def read(docs: DataFrame, path: str) -> DataFrame:
    """docs: doc_id, held_out, text -> a stored table of READ."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", F.xxhash64("doc_id", "text").alias("mark"), F.col("text").cast("binary"))
    return stored(rows.mapInArrow(_read(path), READ), TEXTS)


def _vocabulary(path: str, counts: np.ndarray) -> lm.Vocabulary:
    return lm.Vocabulary(counts, bpe.encoder(path).opens(lm.IDS))


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """The other columns, ids end to end and their numbers, of documents whose ids are the last column, about most ids at a time."""

    def joined() -> tuple[list[tuple], np.ndarray, np.ndarray]:
        return rows, np.frombuffer(b"".join(data), "<u2").astype(np.int32), np.array([len(x) // 2 for x in data], np.int64)

    rows, data, size = [], [], 0
    for batch in batches:
        others = [c.to_pylist() for c in batch.columns[:-1]]
        for i, x in enumerate(batch.columns[-1]):
            rows.append(tuple(c[i] for c in others))
            data.append(x.as_py())
            size += len(data[-1]) // 2 + 1
            if size >= most:
                yield joined()
                rows, data, size = [], [], 0
    if rows:
        yield joined()


WEIGHTS = "part long, tokens long, weights binary"


def _weights(part: int, tokens: int, weights: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([weights], pa.binary())], ["part", "tokens", "weights"])


def _train(path: str, counts: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.clear()  # the words of the reading tasks are not needed any more
        held()
        vocabulary = _vocabulary(path, counts)
        trainer, part = lm.Trainer(lm.initial(vocabulary), vocabulary), None
        for rows, ids, lengths in _parts(batches, TRAINED):
            part = rows[0][0]
            trainer.show(lm.Windows(vocabulary, ids, lengths))
        if trainer.tokens:
            yield _weights(part, trainer.tokens, lm.packed(trainer.w))
        del trainer
        released()

    return run


def _averaged(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    tokens, total = rows.column("tokens").to_pylist(), sum(rows.column("tokens").to_pylist())
    mean = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) * (n / total) for n, x in zip(tokens, rows.column("weights")))
    return pa.Table.from_batches([_weights(rows.column("part")[0].as_py(), total, mean.astype("<f4").tobytes())])


def trained(documents: DataFrame, path: str, counts: np.ndarray) -> bytes:
    """documents: mark, ids. Weights averaged over the shards, FAN at a time until one row is left."""
    shards = int(np.clip(-(-int(counts.sum()) // SHARD), 1, MAX_SHARDS))
    dealt = documents.select(F.pmod("mark", F.lit(shards)).cast("int").alias("part"), "mark", "ids").repartitionById(shards, "part")
    state = stored(dealt.sortWithinPartitions("mark", "ids").select("part", "ids").mapInArrow(_train(path, counts), WEIGHTS), TEXTS)
    while (left := state.count()) > 1:
        state = stored(state.groupBy(F.expr(f"part div {FAN}").alias("g")).applyInArrow(_averaged, WEIGHTS).withColumn("part", F.expr(f"part div {FAN}")))
    return bytes(state.first().weights) if left else lm.packed(lm.initial(_vocabulary(path, counts)))


SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>"


def _score(path: str, counts: np.ndarray, weights: bytes, frequent: tuple[np.ndarray, np.ndarray], end: tuple[float, int]) -> Callable:
    """frequent: sorted hashes of words, and their base log10; end: base log10 of the end of a text, and whether it is known."""
    key = uuid.uuid4().hex

    def make() -> tuple[lm.Network, Logs]:
        vocabulary = _vocabulary(path, counts)
        return lm.Network(lm.unpacked(weights, vocabulary), vocabulary), Logs(*frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        net, logs = _kept(key, make)
        for rows, ids, lengths in _parts(batches, TRAINED):
            windows = lm.Windows(net.vocabulary, ids, lengths)
            score = np.add.reduceat(lm.log_probabilities(net, windows), windows.starts) / np.log(10)
            opens = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8), count=n) for r, n in zip(rows, lengths)]) if len(ids) else np.zeros(0, np.uint8)
            begin = np.flatnonzero(opens)
            words = word_hashes(ids, begin)
            often, base = logs.of(words)
            base = np.r_[0.0, np.cumsum(base)]
            hits, many = np.r_[0, np.cumsum(often)], np.r_[0, np.cumsum(opens)]
            stops = np.cumsum(lengths)
            last, first = many[stops], many[stops - lengths]
            rare = np.r_[0, np.cumsum(~often)]
            rest = pa.ListArray.from_arrays(pa.array(np.r_[0, rare[last]], pa.int32()), pa.array(words[~often], pa.int64()))
            columns = [[r[0] for r in rows], [r[1] for r in rows], last - first + 1, hits[last] - hits[first] + end[1], base[last] - base[first] + end[0], score]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), rest], [x.split()[0] for x in SCORED.split(", ")])
        released()

    return run


def frequent_words(counts: DataFrame) -> pa.Table:
    """At most FREQUENT rows of counts, those above a count that a histogram of logarithms gives."""
    bins = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("bin")).count().collect()
    held, least = 0, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["bin"]
    return counts.filter(F.floor(F.log2("c") * 8) >= least if least is not None else F.lit(False)).select("word", "c").toArrow().sort_by("word")


def scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    path = path or bpe.default_path()
    all_ = read(docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text"), path)
    documents = all_.filter(F.col("row").isNotNull())
    ids = np.zeros(lm.IDS, np.int64)
    for r in all_.filter(F.col("id").isNotNull()).groupBy("id").agg(F.sum("n").alias("n")).collect():
        ids[r.id] = r.n
    end = int(ids[lm.END])
    counts = stored(all_.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + end, v + (end > 0)
    bottom = n + 0.5 * (v + 1)
    weights = trained(documents.filter(~F.col("held_out")).select("mark", "ids"), path, ids)
    log10 = lambda c: np.log10((c + 0.5) / bottom)
    found = frequent_words(counts)
    frequent = found.column("word").to_numpy(), log10(found.column("c").to_numpy())
    scored = documents.select("doc_id", "held_out", "opens", "ids").mapInArrow(_score(path, ids, weights, frequent, (float(log10(end)), int(end > 0))), SCORED)
    rows = stored(scored.withColumn("row", F.monotonically_increasing_id()), TEXTS)
    rest = rows.select("row", F.explode("rest").alias("word")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = rest.groupBy("row").agg(F.sum(F.log10((F.col("c") + 0.5) / bottom)).alias("more"), F.count_if(F.col("c") > 0).alias("also"))
    return rows.drop("rest").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
