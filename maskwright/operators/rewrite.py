"""Tokens and placeholders for findings, and the texts with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import tokens
from maskwright.functions.arrays import running
from maskwright.functions.checks import let


def _with_token(f: Column, token: Column) -> Column:
    return F.struct(f.entity_type.alias("entity_type"), f.original.alias("original"), token.alias("token"), f.start.alias("start"), f.end.alias("end"), f.confidence.alias("confidence"))


def pseudonyms(findings: Column, inner: Column, outer: Column) -> Column:
    """Keyed tokens. The pads are bound once: Spark puts the expressions behind them in place of the columns, and inside the transform they would run for each finding."""
    of = lambda inner, outer: F.transform(findings, lambda f: _with_token(f, tokens.make_token(f.entity_type, f.original, inner, outer)))
    return let(inner, lambda i: let(outer, lambda o: of(i, o)))


def placeholders(findings: Column) -> Column:
    """Labels by entity type and normalised original, numbered by first appearance in the text.

    Equal originals are found by sorting, not by looking through all others.
    """
    mark = lambda f, i: F.struct(f.entity_type.alias("kind"), tokens.normalised(f.original).alias("norm"), i.alias("at"))

    def first(x: Column, others: Column, i: Column, *keys: str) -> Column:
        """Whether x differs by the keys from the element before it."""
        last = F.get(others, i - 1)
        same = F.lit(True)
        for k in keys:
            same = same & last[k].eqNullSafe(x[k])
        return (i == 0) | ~same

    def numbered(firsts: Column) -> Column:
        """The labels' numbers, in the order of kind and norm; firsts: kind, at, norm, sorted."""
        opens = F.transform(F.filter(F.transform(firsts, lambda x, i: F.struct(x.kind.alias("kind"), i.alias("i"), first(x, firsts, i, "kind").alias("new"))), lambda x: x.new), lambda x: F.struct(x.kind.alias("kind"), x.i.alias("i")))
        # As many as there are entity types.
        base = lambda opens, kind: F.aggregate(opens, F.lit(0), lambda a, o: F.when(o.kind == kind, o.i).otherwise(a))
        return let(opens, lambda opens: F.sort_array(F.transform(firsts, lambda x, i: F.struct(x.kind.alias("kind"), x.norm.alias("norm"), (i - base(opens, x.kind) + 1).alias("n")))))

    def label(findings: Column, sorted_: Column) -> Column:
        new = F.transform(sorted_, lambda x, i: first(x, sorted_, i, "kind", "norm"))
        firsts = lambda new: F.sort_array(F.transform(F.filter(sorted_, lambda x, i: F.get(new, i)), lambda x: F.struct(x.kind.alias("kind"), x["at"].alias("at"), x.norm.alias("norm"))))
        group = lambda new: running(new, F.lit(0), lambda a, x: a + x.cast("int"), "int")

        def placed(new: Column) -> Column:
            return let(let(firsts(new), numbered), lambda numbers: let(group(new), lambda groups: F.sort_array(F.transform(sorted_, lambda x, i: F.struct(x["at"].alias("at"), F.get(numbers, F.get(groups, i) - 1).n.alias("n"))))))

        return let(let(new, placed), lambda order: F.transform(findings, lambda f, i: _with_token(f, tokens.strict_label(f.entity_type, F.get(order, i).n))))

    return let(findings, lambda found: let(F.sort_array(F.transform(found, mark)), lambda sorted_: label(found, sorted_)))


def rewritten(text: Column, findings: Column) -> Column:
    """text with each finding's token in its place; findings are disjoint and sorted, offsets in bytes.

    findings is bound once: where Spark puts the expression behind it in place of the
    column, a use inside the transform would run the detectors for each element.
    """

    def build(b: Column, found: Column) -> Column:
        last = lambda i: F.coalesce(F.get(found, i - 1).getField("end"), F.lit(0))
        gap = lambda start, end: F.decode(F.substring(b, start + 1, end - start), "UTF-8")
        parts = F.transform(found, lambda f, i: F.concat(gap(last(i), f.start), f.token))
        tail = let(F.coalesce(F.get(found, F.size(found) - 1).getField("end"), F.lit(0)), lambda end: gap(end, F.octet_length(b)))
        return F.concat(F.array_join(parts, ""), tail)

    return let(findings, lambda found: F.when(F.size(found) > 0, let(F.encode(text, "UTF-8"), lambda b: build(b, found))).otherwise(text))


def entity_counts(findings: Column) -> Column:
    """MAP<STRING,INT> of findings by entity type."""

    def count(kinds: Column) -> Column:
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("key"), F.size(F.filter(kinds, lambda x: x == k)).alias("value"))))

    return let(F.transform(findings, lambda f: f.entity_type), count)
