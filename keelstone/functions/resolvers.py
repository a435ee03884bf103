"""Resolve functions: how an upsert's value meets the one below it.

A resolver is associative; its first argument is the newer value. Most are
Spark aggregates, which are summed up before a shuffle; any other is a fold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Resolver:
    """total(v, order): the resolved value of a group; a larger order is newer."""

    name: str
    total: Callable[[Column, Column], Column]
    #: Whether the order of values doesn't matter, so that they add up anywhere.
    commutative: bool = False


FIRST = Resolver("first", lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), True)
SUM = Resolver("sum", lambda v, o: F.sum(v), True)
MIN = Resolver("min", lambda v, o: F.min(v), True)
MAX = Resolver("max", lambda v, o: F.max(v), True)
#: Sums of unsigned 64-bit numbers, modulo 2**64.
SUM_WORD64 = Resolver("sum_word64", lambda v, o: F.pmod(F.sum(v.cast("decimal(38,0)")), F.lit(Decimal(1 << 64))).cast("decimal(20,0)"), True)


def fold(name: str, step: Callable[[Column, Column], Column]) -> Resolver:
    """Any associative step(new, old) on columns; values fold from the oldest to the newest."""

    def total(v: Column, o: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v")))))
        rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        return F.aggregate(rest, F.get(rows, F.lit(0))["v"], lambda old, new: step(new["v"], old))

    return Resolver(name, total)


def concat(separator: str = "") -> Resolver:
    """Newer text first, then the separator and the older text; with no separator also for bytes."""
    if separator:
        return fold(f"concat:{separator}", lambda new, old: F.concat(new, F.lit(separator), old))
    return fold("concat", F.concat)


PRODUCT = fold("product", lambda new, old: new * old)


def by_name(name: str) -> Resolver:
    """The resolver that a snapshot's metadata names; folds of one's own are given by hand."""
    fixed = {r.name: r for r in (FIRST, SUM, MIN, MAX, SUM_WORD64, PRODUCT)}
    if name.startswith("concat"):
        return concat(name.partition(":")[2])
    return fixed[name]
