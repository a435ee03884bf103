"""Ordinals of rows in key order, without ordering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelstone.functions.codecs import Codec

#: Ranges of keys that are numbered on their own.
RANGES = 64


def numbered(df: DataFrame, codec: Codec) -> DataFrame:
    """df with ``ordinal``, from 1 on in the order of numeric keys k.

    Keys fall into ranges between their approximate quantiles; the ranges'
    sizes, one row each, give the number that each range starts with.
    """
    cuts = df.select(F.percentile_approx("k", [i / RANGES for i in range(1, RANGES)], 10_000).alias("q")).first()["q"] or []
    k = F.col("k")
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= k)) if cuts else F.lit(0)
    if codec.signed:  # negative keys come last
        at = at + F.when(k < 0, 2 * RANGES).otherwise(0)
    rows = df.withColumn("_range", at)
    first, starts = 1, {}
    for r in sorted(rows.groupBy("_range").count().collect()):
        starts[r["_range"]] = first
        first += r["count"]
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("_range")] if starts else F.lit(1)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(k))
    return rows.select((base + within - 1).cast("bigint").alias("ordinal"), *df.columns)
