"""Model-based recognition: token windows, softmax, BIO spans, an optional ONNX model.

Without a model the detector is left out of the plan. With one, each Python worker loads
it once, after the files have been held against the manifest on the driver.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import values as V


def windows(n: int, limit: int = V.NER_LIMIT, size: int = V.NER_WINDOW, overlap: int = V.NER_OVERLAP) -> list[tuple[int, int]]:
    """Start and end of the windows over n sub-tokens; one if they fit with two marks."""
    if n + 2 <= limit:
        return [(0, n)]
    out, start = [], 0
    while True:
        out.append((start, min(start + size, n)))
        if start + size >= n:
            return out
        start += size - overlap


def softmax_argmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (the first of equal maxima) and probability of the best label of each row."""
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    best = logits.argmax(axis=1)
    return best, e[np.arange(len(e)), best] / e.sum(axis=1)


def bio_spans(labels: list[int], probabilities: list[float], offsets: list[tuple[int, int]], text: str, least: float = V.NER_CONFIDENCE) -> list[tuple[str, int, int, float]]:
    """(entity type, start, end, confidence): B- opens a span, I- extends one of its type and else opens one.

    The confidence is the geometric mean; spans below the least, empty ones and those out of range are dropped.
    """
    spans: list[list] = []
    current: list | None = None
    for label, p, (a, b) in zip(labels, probabilities, offsets):
        name = V.NER_LABELS[label]
        if name == "O":
            current = None
        elif name[0] == "I" and current and current[0] == name[2:]:
            current[2] = b
            current[3].append(p)
        else:
            current = [name[2:], a, b, [p]]
            spans.append(current)
    out = []
    for kind, a, b, ps in spans:
        confidence = float(np.exp(np.mean(np.log(np.maximum(ps, 1e-12)))))
        if confidence >= least and 0 <= a < b <= len(text):
            out.append((V.NER_TYPES[kind], a, b, confidence))
    return out


def softmax_column(logits: Column) -> Column:
    """Struct of label (first maximum) and probability of an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp((x - top).cast("double")))
    return F.struct((F.array_position(logits, top) - 1).cast("int").alias("label"), (F.lit(1.0) / total).alias("probability"))


def spans_of_tokens(tokens: DataFrame, key: str) -> DataFrame:
    """tokens: key, tok, start, end, label, probability -> spans with confidence, by windows over each key.

    A span opens where a token is B-, or I- without an open span of its type just before it.
    """
    kind = F.get(F.array(*[F.lit(n[2:] if n != "O" else None) for n in V.NER_LABELS]), F.col("label"))
    begins = F.get(F.array(*[F.lit(n[0] == "B") for n in V.NER_LABELS]), F.col("label"))
    w = Window.partitionBy(key).orderBy("tok")
    rows = tokens.withColumn("kind", kind).withColumn("opens", F.col("kind").isNotNull() & (begins | ~F.col("kind").eqNullSafe(F.lag(kind).over(w))))
    rows = rows.withColumn("span", F.sum(F.col("opens").cast("int")).over(w)).filter(F.col("kind").isNotNull())
    found = rows.groupBy(key, "span", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.exp(F.avg(F.log("probability"))).alias("confidence"))
    names = F.create_map(*[F.lit(x) for pair in V.NER_TYPES.items() for x in pair])
    return found.filter(F.col("confidence") >= V.NER_CONFIDENCE).select(key, F.element_at(names, F.col("kind")).alias("entity_type"), "start", "end", "confidence")


def verify_manifest(manifest: str, folder: str, library: str | None = None) -> int:
    """Holds the files of a folder against "hash path" lines; the number of files. ValueError where anything differs."""
    if not os.path.exists(manifest):
        raise ValueError(f"no manifest: {manifest}")
    with open(manifest, encoding="utf-8-sig") as f:
        lines = [x.strip() for x in f]
    names = []
    for k, line in enumerate(lines, 1):
        if not line or line.startswith("#"):
            continue
        expected, _, name = line.partition(" ")
        if not name.strip():
            raise ValueError(f"manifest, line {k}: no path")
        with open(os.path.join(folder, name.strip()), "rb") as f:
            actual = hashlib.sha256(f.read()).hexdigest()
        if actual != expected.lower():
            raise ValueError(f"{name.strip()}: expected {expected}, found {actual}")
        names.append(os.path.basename(name.strip()))
    if not names:
        raise ValueError("the manifest is empty")
    if library and library not in names:
        raise ValueError(f"the manifest has no hash of {library}")
    return len(names)


@functools.cache
def _engine(folder: str):
    """Session and tokenizer of a folder, or None if they can't be loaded; kept for the worker's life."""
    try:
        import onnxruntime
        from tokenizers import Tokenizer

        return onnxruntime.InferenceSession(os.path.join(folder, "model.onnx")), Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
    except Exception:
        return None


def classify(text: str, folder: str) -> list[tuple[str, int, int, float]]:
    """Spans of a text in code points; none without a model."""
    engine = _engine(folder)
    if engine is None or not text:
        return []
    session, tokenizer = engine
    names = {x.name for x in session.get_inputs()}
    whole = tokenizer.encode(text, add_special_tokens=False)
    found = []
    for a, b in windows(len(whole.ids)):
        ids = [tokenizer.token_to_id("[CLS]") or 0, *whole.ids[a:b], tokenizer.token_to_id("[SEP]") or 0]
        feed = {"input_ids": np.array([ids], np.int64), "attention_mask": np.ones((1, len(ids)), np.int64), "token_type_ids": np.zeros((1, len(ids)), np.int64)}
        logits = session.run(None, {k: v for k, v in feed.items() if k in names})[0][0][1:-1]
        labels, ps = softmax_argmax(logits)
        found += bio_spans(labels.tolist(), ps.tolist(), whole.offsets[a:b], text)
    return list(dict.fromkeys(found))


def findings(text: Column, folder: str | None, rank: int = 99) -> Column | None:
    """Findings of the model as an array column with byte offsets; None without a model."""
    if not folder or not os.path.exists(os.path.join(folder, "model.onnx")):
        return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                t = t or ""
                at = lambda i: len(t[:i].encode())  # noqa: B023, E731
                out.append([{"entity_type": kind, "original": t[a:b], "start": at(a), "end": at(b), "confidence": p, "ord": rank} for kind, a, b, p in classify(t, folder)])
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<entity_type:string,original:string,start:int,end:int,confidence:double,ord:int>>")(text)
