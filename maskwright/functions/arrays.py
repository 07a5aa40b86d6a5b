"""Running states over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.checks import let

#: Most elements that are appended one by one; arrays are put together from blocks of the root of their length, at most so many.
BLOCK = 512


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state of type kind after each element of items.

    Spark copies an array for each element that is appended to it, so a plain fold takes a
    time that grows with the square of the length. Blocks keep the copies short.
    """
    empty = F.array().cast(f"array<{kind}>")
    state = lambda s, out: F.struct(s.alias("s"), out.alias("out"))
    within = lambda a, x: let(step(a.s, x), lambda s: state(s, F.concat(a.out, F.array(s))))

    def over(xs: Column, most: Column) -> Column:
        def block(a: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(xs, b * most + 1, most), state(a.s, empty), within)
            return let(inner, lambda done: state(done.s, F.concat(a.out, done.out)))

        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / most).cast("int"))
        return F.aggregate(blocks, state(start.cast(kind), empty), block, lambda a: a.out)

    def all_(xs: Column) -> Column:
        root = F.least(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(BLOCK))
        return F.when(F.size(xs) > 0, let(root, lambda most: over(xs, most))).otherwise(empty)

    return let(items, all_)
