"""Checksums and context tests as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import values as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    value = lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(F.transform(_chars(F.reverse(number)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Remainder by 97 of an account number whose first four characters are put last and letters read as 10 to 35."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(turned), F.lit(0), step)


def _structure(code: str, parts: str) -> str:
    import re

    kinds = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}
    return f"{code}[0-9]{{2}}" + "".join(f"{kinds[k]}{{{n}}}" for n, k in re.findall(r"(\d+)([nac])", parts))


IBAN = "^(?:" + "|".join(_structure(c, s) for c, s in V.IBAN_STRUCTURES.items()) + ")$"


def iban(candidate: Column) -> Column:
    """Country, structure and check digits of a candidate, white space left out."""
    return let(F.regexp_replace(candidate, r"(?U)\s+", ""), lambda x: F.when(x.rlike(IBAN), mod97(x) == 1).otherwise(F.lit(False)))


def tax_id(number: Column) -> Column:
    """Eleven digits, the first not 0, exactly one of the first ten digits two or three times there, MOD 11,10 check digit."""

    def valid(d: Column) -> Column:
        ten = F.slice(d, 1, 10)
        often = F.size(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda x: F.size(F.filter(ten, lambda y: y == x)).isin(2, 3)))
        step = lambda p, x: let((p + x) % 10, lambda s: (F.when(s == 0, 10).otherwise(s) * 2) % 11)
        left = F.lit(11) - F.aggregate(ten, F.lit(10), step)
        return (F.get(d, F.lit(0)) != 0) & (often == 1) & (F.when(left >= 10, left - 10).otherwise(left) == F.get(d, F.lit(10)))

    return F.when(number.rlike("^[0-9]{11}$"), let(F.transform(_chars(number), lambda c: c.cast("int")), valid)).otherwise(F.lit(False))


def in_hex(before: Column, after: Column) -> Column:
    """Whether a span stands in a hex literal or touches a hex letter."""
    return before.rlike("0[xX][0-9a-fA-F]*$") | before.rlike("[a-fA-F]$") | after.rlike("^[a-fA-F]")


def tax_cue(before: Column) -> Column:
    """Whether a cue is in the last characters before a span."""
    window = F.lower(F.substring(before, -V.CUE_WINDOW, V.CUE_WINDOW))
    return F.exists(F.array(*map(F.lit, V.TAX_ID_CUES)), lambda cue: F.contains(window, cue))
