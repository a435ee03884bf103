"""Connected components of a link table, in a few distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.common import as_table


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of links(a, b); root: the least node reachable.

    Large-star and small-star rounds alternate until the links stand still. A
    node's links are never gathered: each round is a minimum per node (summed
    before the shuffle) and an inner join that adaptive execution can split.
    Empty links give an empty result; self links and repeats do no harm.
    """
    now = as_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = _mark(now)
    while mark[0]:
        now = as_table(_small_star(_large_star(now)), name)
        mark, before = _mark(now), mark
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a").select("a", "b", "m")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
