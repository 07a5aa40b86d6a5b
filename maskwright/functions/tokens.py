"""Keyed pseudonyms and readable placeholders as column expressions."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import values as V
from maskwright.functions.checks import let

BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def normalised(x: Column) -> Column:
    """Trimmed, no-break spaces as spaces, zero-width space and byte-order mark left out, white space collapsed."""
    plain = F.translate(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), "\u00a0\u200b\ufeff", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer pad of HMAC-SHA256 for a key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    """Hex HMAC-SHA256; inner and outer are binary pads."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def make_token(entity_type: Column, original: Column, inner: Column, outer: Column) -> Column:
    """«C_hhhhhh»: letter of the type and the first 30 bits of the HMAC in base 32."""
    digest = hmac_sha256(inner, outer, F.encode(normalised(original), "UTF-8"))
    top = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    letter = lambda n, k: F.substring(F.lit(BASE32), F.shiftright(n, 27 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    hashed = let(top, lambda n: F.concat(*[letter(n, k) for k in range(6)]))
    return F.concat(F.lit("«"), F.coalesce(_lookup(V.TYPE_LETTERS, entity_type), F.lit("?")), F.lit("_"), hashed, F.lit("»"))


def _lookup(known: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in reversed(known.items()):
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def case_secret(master: bytes, case_id: str) -> bytes:
    return hmac.new(master, b"case:" + case_id.encode(), hashlib.sha256).digest()


def with_case_pads(df: DataFrame, master: bytes, case: str = "case_id") -> DataFrame:
    """df with the pads of each row's own case secret (inner_pad, outer_pad), derived in the plan.

    The secret of a case is HMAC(master, "case:" + case_id); 32 bytes, so the pads need no hashing.
    """
    inner, outer = pads(master)
    key = hmac_sha256(F.lit(bytearray(inner)), F.lit(bytearray(outer)), F.concat(F.lit(bytearray(b"case:")), F.encode(F.col(case), "UTF-8")))
    byte = lambda h, i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pad = lambda h, mask: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.when(i < 32, byte(h, F.least(i, F.lit(31))).bitwiseXOR(F.lit(mask))).otherwise(F.lit(mask)).cast("long")), 2, "0")), ""))
    return df.withColumn("inner_pad", let(key, lambda h: pad(h, 0x36))).withColumn("outer_pad", let(key, lambda h: pad(h, 0x5C)))


def letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, 53 -> BA."""
    digit = lambda m: F.chr((m % 26 + 65).cast("long"))
    step = lambda s, _: F.when(s.n > 0, F.struct(F.expr("1").cast("long").alias("_"), ((s.n - 1 - (s.n - 1) % 26) / 26).cast("long").alias("n"), F.concat(digit(s.n - 1), s.text).alias("text"))).otherwise(s)
    start = F.struct(F.lit(1).cast("long").alias("_"), n.cast("long").alias("n"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda s: s.text)


def strict_label(entity_type: Column, n: Column) -> Column:
    return F.concat(F.lit("«"), F.coalesce(_lookup(V.TYPE_WORDS, entity_type), F.lit(V.OTHER_WORD)), F.lit(" "), letters(n), F.lit("»"))
