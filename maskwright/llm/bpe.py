"""Byte-level BPE ids of whole texts, with a cache of space-delimited chunks.

The vocabulary is that of a tokenizers JSON file; its ids serve as merge ranks. ids() reads
the strings of special tokens as these tokens, as the file says; encode() reads them as
ordinary text.

In this pre-tokenisation a space before a non-space always opens a new token group, so a
text can be cut before such spaces and each chunk encoded by itself. A text with any other
chunk (double spaces, a space before a line end) is encoded as a whole instead.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 400_000
LONGEST = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Whole(Exception):
    """The text can't be cut into chunks."""


class Encoder(dict):
    """chunk (what follows a space) -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.ranks = ranks
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in special.items()}
        self.cuts = re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")") if special else None
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def opens(self, n: int) -> np.ndarray:
        """Which of the ids below n begin with a space."""
        out = np.zeros(n, bool)
        out[[i for token, i in self.ranks.items() if token[:1] == b" "]] = True
        return out

    def _bytes(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Whole
        found = self._bytes(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if self.cuts and self.cuts.search(text):
            return b"".join(self.special[x] if i % 2 else self._plain(x) for i, x in enumerate(self.cuts.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not rest:
            return self._bytes(text)
        try:
            if not first:
                raise _Whole
            return self._bytes(first) + b"".join(map(self.__getitem__, rest))
        except _Whole:
            return self._bytes(text)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
