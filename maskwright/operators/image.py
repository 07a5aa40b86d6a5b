"""Images: text of recognised words, boxes of findings, painting of boxes into PNG files.

Recognition itself is not part of the engine: words come as an array column of
text, x, y, w, h (shares of the image, from the top left) and line, in reading order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import values as V

PNG = b"\x89PNG\r\n\x1a\n"


def assembled(words: Column) -> Column:
    """Struct of text (words apart by a space, by a line end where the line changes) and slices (byte start and end of each word)."""

    def step(s: Column, w: Column) -> Column:
        gap = F.when(s.line.isNull(), F.lit("")).when(s.line == w.line, F.lit(" ")).otherwise(F.lit("\n"))
        start = s.at + F.octet_length(gap)
        end = start + F.octet_length(w.text)
        return F.struct(end.alias("at"), w.line.cast("long").alias("line"), F.concat(s.text, gap, w.text).alias("text"), F.concat(s.slices, F.array(F.struct(start.alias("start"), end.alias("end")))).alias("slices"))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("long").alias("line"), F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("slices"))
    return F.aggregate(words, start, step, lambda s: F.struct(s.text.alias("text"), s.slices.alias("slices")))


def boxes(df: DataFrame, key: str) -> DataFrame:
    """df: key, words, slices, findings -> key, finding, line, x, y, w, h, entity_type, replacement: one box a finding and line.

    A word is in a finding if their bytes overlap. The overlap is tested inside the row, so
    nothing is shuffled before the words of a finding are put together.
    """
    hits = F.filter(F.arrays_zip("words", "slices"), lambda z: (z.slices.start < F.col("f.end")) & (z.slices.end > F.col("f.start")))
    rows = df.select(key, "words", "slices", F.posexplode("findings").alias("finding", "f")).select(key, "finding", "f", F.explode(hits).alias("z"))
    w = F.col("z.words")
    per_line = rows.groupBy(key, "finding", w.line.alias("line")).agg(
        F.min(w.x).alias("x"), F.min(w.y).alias("y"), F.max(w.x + w.w).alias("right"), F.max(w.y + w.h).alias("bottom"), F.first("f.entity_type").alias("entity_type"), F.first("f.token").alias("replacement")
    )
    return per_line.select(key, "finding", "line", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "entity_type", "replacement")


def pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, padding: int = V.BOX_PADDING) -> Column:
    """Pixel bounds of a box, grown by the padding and clamped: left, top, right, bottom."""
    low = lambda v, n: F.greatest(F.floor(v * n) - padding, F.lit(0)).cast("int")
    high = lambda v, n: F.least(F.ceil(v * n) + padding, n.cast("long")).cast("int")
    return F.struct(low(x, width).alias("left"), low(y, height).alias("top"), high(x + w, width).alias("right"), high(y + h, height).alias("bottom"))


def size_of(image: bytes) -> tuple[int, int]:
    """Width and height from a PNG header alone; ValueError if it is none or too large."""
    if image[:8] != PNG or image[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height = struct.unpack(">II", image[16:24])
    if max(width, height) > V.MAX_IMAGE_SIDE:
        raise ValueError(f"image of {width} x {height} pixels")
    return width, height


def decode(image: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG image of 8 bits a channel, not interlaced."""
    width, height = size_of(image)
    depth, kind, _, _, interlaced = struct.unpack(">BBBBB", image[24:29])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("unsupported kind of PNG image")
    at, data = 8, b""
    while at + 8 <= len(image):
        size, name = struct.unpack(">I4s", image[at : at + 8])
        if name == b"IDAT":
            data += image[at + 8 : at + 8 + size]
        at += size + 12
    stride = width * channels
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, width + 1, channels), np.int32)
    for y in range(height):
        rule, line = raw[y, 0], raw[y, 1:].reshape(width, channels).astype(np.int32)
        up = out[y, 1:]
        if rule == 0:
            out[y + 1, 1:] = line
        elif rule == 2:
            out[y + 1, 1:] = (line + up) & 255
        elif rule == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        else:
            for x in range(width):
                left, corner = out[y + 1, x], out[y, x]
                if rule == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    near = np.abs(np.stack([p - left, p - up[x], p - corner]))
                    guess = np.choose(near.argmin(axis=0), [left, up[x], corner])
                out[y + 1, x + 1] = (line[x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def encode(pixel: np.ndarray) -> bytes:
    """A PNG file of pixels, without any metadata."""
    height, width, channels = pixel.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 2: 4, 4: 6}[channels], 0, 0, 0)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixel.reshape(height, -1)], axis=1).tobytes()
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def painted(image: bytes, found: list[dict]) -> bytes:
    """The image with opaque black boxes."""
    pixel = decode(image).copy()
    height, width, channels = pixel.shape
    black = np.zeros(channels, np.uint8)
    if channels in (2, 4):
        black[-1] = 255
    for b in found:
        left, top = max(int(np.floor(b["x"] * width)) - V.BOX_PADDING, 0), max(int(np.floor(b["y"] * height)) - V.BOX_PADDING, 0)
        right, bottom = min(int(np.ceil((b["x"] + b["w"]) * width)) + V.BOX_PADDING, width), min(int(np.ceil((b["y"] + b["h"]) * height)) + V.BOX_PADDING, height)
        pixel[top:bottom, left:right] = black
    return encode(pixel)


def display_copy(image: bytes) -> bytes:
    """The image, or a smaller copy if a side is over the display limit (every n-th pixel)."""
    pixel = decode(image)
    step = -(-max(pixel.shape[:2]) // V.MAX_DISPLAY_SIDE)
    return encode(pixel[::step, ::step]) if step > 1 else encode(pixel)


def rendered(image: Column, found: Column) -> Column:
    """Binary PNG with painted boxes; null where the image can't be read."""

    def paint(images: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for data, own in zip(images, lists):
            try:
                out.append(None if data is None else painted(bytes(data), list(own) if own is not None else []))
            except (ValueError, zlib.error):
                out.append(None)
        return pd.Series(out, dtype="object")

    paint.__annotations__ = {"images": pd.Series, "lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(paint, "binary")(image, found)
