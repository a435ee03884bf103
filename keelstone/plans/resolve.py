"""The two resolve plans: a change log's state, and the union of states.

A log has the columns k, seq, op, v and blob: op is I (insert), U (upsert) or D
(delete), and seq orders the entries of a key. A state has k, v and blob.
Entries without a key are none.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelstone.functions.resolvers import FIRST, Resolver

#: A key is hot if it holds more than one entry in so many of the log.
HOT_SHARE = 1_000
#: Entries of a hot key that are folded at a time, for resolvers that need an order.
FOLD_WIDTH = 1 << 16
#: Entries in which hot keys are looked for; of a larger log a share is taken.
HOT_SAMPLE = 10_000_000
#: Looked-up keys that reach the scan as a list, and those that are broadcast, with the bytes that these take at most.
LISTED, BROADCAST, BROADCAST_BYTES = 4_096, 1_000_000, 64 << 20


def _hides() -> Column:
    return F.when(F.col("op") != "U", F.col("seq"))


def anchors(log: DataFrame) -> DataFrame:
    """(k, anchor, last): the newest entry that hides what is older, and the newest of all."""
    return log.groupBy("k").agg(F.max(_hides()).alias("anchor"), F.max("seq").alias("last"))


def _marked(log: DataFrame) -> DataFrame:
    """The log with its keys' anchor and last: entries meet by key once, and what follows keeps that partitioning."""
    by = Window.partitionBy("k")
    return log.where("k IS NOT NULL").withColumn("anchor", F.max(_hides()).over(by)).withColumn("last", F.max("seq").over(by))


def _live() -> Column:
    return (F.col("op") != "D") & _kept()


def _kept() -> Column:
    return F.col("anchor").isNull() | (F.col("seq") >= F.col("anchor"))


def _blob() -> Column:
    return F.max(F.when((F.col("seq") == F.col("last")) & (F.col("op") == "I"), F.col("blob"))).alias("blob")


def _top() -> Column:
    return F.max_by(F.struct("op", "v", "blob"), "seq").alias("top")


def hot_keys(log: DataFrame, share: int = HOT_SHARE, entries: int | None = None) -> list:
    """The keys with more than 1 / share of all entries, fewer than ``share`` of them; of a large log, of those in a sample of it."""
    entries = log.count() if entries is None else entries
    if entries > HOT_SAMPLE:
        log = log.sample(HOT_SAMPLE / entries, seed=29)
        entries = HOT_SAMPLE
    counts = log.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    return [r["k"] for r in counts.where(F.col("n") > entries / share).orderBy(F.desc("n")).limit(share).select("k").collect()]


def level_state(log: DataFrame, resolver: Resolver, hot: list | None = None) -> DataFrame:
    """The live keys of a log: newest first, up to the first entry that isn't an upsert.

    Where the newest entry decides all, it is a maximum that adds up before the
    shuffle. Otherwise entries meet by key in one exchange, what is hidden goes,
    and the rest is resolved where it is. Keys listed in ``hot`` take a plan of
    their own: their anchors, at most HOT_SHARE rows, are broadcast, so that
    their entries are filtered and added up where they lie. A resolver that
    needs an order folds a hot key's stretches of seq first, which
    associativity allows.
    """
    if resolver.name == FIRST.name:
        top = log.where("k IS NOT NULL").groupBy("k").agg(_top()).where("top.op <> 'D'")
        return top.select("k", F.col("top.v").alias("v"), F.when(F.col("top.op") == "I", F.col("top.blob")).alias("blob"))
    if hot:
        listed = is_in("k", log, hot)
        return _hot_state(log.where(listed), resolver).unionByName(level_state(log.where(~listed), resolver))
    return _marked(log).where(_live()).groupBy("k").agg(resolver.total(F.col("v"), F.col("seq")).alias("v"), _blob())


def _hot_state(log: DataFrame, resolver: Resolver) -> DataFrame:
    live = log.join(F.broadcast(anchors(log)), "k").where(_live())
    return _folded(live, resolver, F.col("v"), ["k"]).select("k", "v", "blob")


def _folded(rows: DataFrame, resolver: Resolver, v: Column, by: list[str]) -> DataFrame:
    """by, v, blob: totals that add up before the shuffle, in stretches of seq where an order counts."""
    if resolver.commutative:
        return rows.groupBy(*by).agg(resolver.total(v, F.col("seq")).alias("v"), _blob())
    parts = rows.groupBy(*by, F.floor(F.col("seq") / FOLD_WIDTH).alias("part")).agg(resolver.total(v, F.col("seq")).alias("v"), _blob())
    return parts.groupBy(*by).agg(resolver.total(F.col("v"), F.col("part")).alias("v"), F.max("blob").alias("blob"))


def merged_log(log: DataFrame, resolver: Resolver, last_level: bool = False, hot: list | None = None) -> DataFrame:
    """One entry per key that stands for a contiguous stretch of the log.

    At the last level nothing older exists, so upserts become inserts and
    deletes go; elsewhere an upsert stays one, as older entries may lie below.
    ``hot`` keys are merged as in ``level_state``.
    """
    if resolver.name == FIRST.name:
        top = log.where("k IS NOT NULL").groupBy("k").agg(F.max("seq").alias("seq"), F.max(_hides()).alias("anchor"), _top())
        op = F.col("top.op")
        rows = top.select("k", "seq", _stands(op, last_level).alias("op"), F.when(op != "D", F.col("top.v")).alias("v"), F.when(op == "I", F.col("top.blob")).alias("blob"))
        return rows.where("op <> 'D'") if last_level else rows
    if hot:
        listed = is_in("k", log, hot)
        mine = log.where(listed)
        tops = mine.groupBy("k").agg(F.max(_hides()).alias("anchor"), F.max("seq").alias("last"), F.max_by("op", "seq").alias("last_op"))
        rows = mine.join(F.broadcast(tops), "k").where(_kept())
        out = _folded(rows, resolver, F.when(F.col("op") != "D", F.col("v")), ["k", "last", "last_op", "anchor"])
        return _entries(out, last_level).unionByName(merged_log(log.where(~listed), resolver, last_level))
    v = F.when(F.col("op") != "D", F.col("v"))
    by_key = _marked(log).where(_kept()).groupBy("k")
    out = by_key.agg(F.max("seq").alias("last"), F.max_by("op", "seq").alias("last_op"), F.max("anchor").alias("anchor"), resolver.total(v, F.col("seq")).alias("v"), _blob())
    return _entries(out, last_level)


def _stands(last_op: Column, last_level: bool) -> Column:
    return F.when(last_op == "D", "D").when(F.col("anchor").isNotNull() | F.lit(last_level), "I").otherwise("U")


def _entries(out: DataFrame, last_level: bool) -> DataFrame:
    out = out.select("k", F.col("last").alias("seq"), _stands(F.col("last_op"), last_level).alias("op"), "v", "blob")
    return out.where("op <> 'D'") if last_level else out


def union_state(states: list[DataFrame], resolver: Resolver) -> DataFrame:
    """Pointwise union, the first state newest; the blob is the first holder's, also if it has none."""
    if len(states) == 1:
        return states[0].select("k", "v", "blob")
    tagged = [s.select("k", F.lit(-t).alias("o"), "v", "blob") for t, s in enumerate(states)]
    rows = reduce(DataFrame.unionByName, tagged)
    blob = F.max_by(F.struct("blob"), "o")["blob"]
    return rows.groupBy("k").agg(resolver.total(F.col("v"), F.col("o")).alias("v"), blob.alias("blob"))


def _literal(x: Any) -> str:
    if isinstance(x, (bytes, bytearray)):
        return f"X'{bytes(x).hex()}'"
    if isinstance(x, str):
        quoted = x.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{quoted}'"
    if isinstance(x, (date, datetime)):
        return f"{'TIMESTAMP' if isinstance(x, datetime) else 'DATE'} '{x}'"
    return f"{x}BD" if isinstance(x, Decimal) else repr(x)


def is_in(column: str, rows: DataFrame, values: list) -> Column:
    """Whether the column is one of the values: a list that the scan can use, of the column's own type."""
    kind = rows.schema[column].dataType.simpleString()
    if not values:
        return F.lit(False)
    return F.expr(f"`{column}` IN ({', '.join(f'CAST({_literal(x)} AS {kind})' if not isinstance(x, (str, bytes, bytearray)) else _literal(x) for x in values)})")


def lookups(log: DataFrame, keys: DataFrame, resolver: Resolver, hot: list | None = None) -> DataFrame:
    """(ordinal, k, found, v, blob) for keys(ordinal, k), duplicates included.

    The keys meet the log before anything is resolved, so that only their
    entries are shuffled. Up to LISTED keys reach the scan as a list, which
    Parquet's bounds and Bloom filters know how to use; more, if their number
    and bytes are below the bounds, are broadcast; beyond that both sides are
    shuffled by key. The result is the same.
    """
    wanted = keys.select("k").where("k IS NOT NULL").distinct()
    few = [r["k"] for r in wanted.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        mine = log.where(is_in("k", log, few))
    else:
        n, size = wanted.agg(F.count("*"), F.sum(F.length(F.col("k").cast("string")))).first()
        mine = log.join(F.broadcast(wanted) if n <= BROADCAST and size <= BROADCAST_BYTES else wanted, "k", "left_semi")
    state = level_state(mine, resolver, hot).withColumn("found", F.lit(True))
    return keys.select("ordinal", "k").join(state, "k", "left").select("ordinal", "k", F.coalesce("found", F.lit(False)).alias("found"), "v", "blob")
