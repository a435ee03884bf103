"""The laws that codecs and resolvers obey, as checks on sample values."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.functions.codecs import Codec
from keelstone.functions.resolvers import Resolver


def key_identity(spark: SparkSession, codec: Codec, keys: Sequence[Any]) -> bool:
    """Decoding an encoded key gives the key."""
    df = spark.createDataFrame([(k,) for k in keys], f"k {codec.spark_type}")
    return df.where(~codec.from_bytes(codec.to_bytes(F.col("k"))).eqNullSafe(F.col("k"))).isEmpty()


def _cut_out(b: Column) -> Column:
    """The same bytes, sliced out of a longer string."""
    return F.substring(F.concat(F.lit(b"\x07\x00before"), b, F.lit(b"\xffafter")), F.lit(9), F.octet_length(b))


def key_identity_up_to_slicing(spark: SparkSession, codec: Codec, keys: Sequence[Any]) -> bool:
    """Decoding an encoded key that is a slice of a longer string gives the key."""
    df = spark.createDataFrame([(k,) for k in keys], f"k {codec.spark_type}")
    return df.where(~codec.from_bytes(_cut_out(codec.to_bytes(F.col("k")))).eqNullSafe(F.col("k"))).isEmpty()


def value_identity(spark: SparkSession, codec: Codec, values: Sequence[Any]) -> bool:
    """Decoding an encoded value gives the value."""
    df = spark.createDataFrame([(v,) for v in values], f"v {codec.spark_type}")
    return df.where(~codec.value_from_bytes(codec.value_to_bytes(F.col("v"))).eqNullSafe(F.col("v"))).isEmpty()


def value_identity_up_to_slicing(spark: SparkSession, codec: Codec, values: Sequence[Any]) -> bool:
    """Decoding an encoded value that is a slice of a longer string gives the value."""
    df = spark.createDataFrame([(v,) for v in values], f"v {codec.spark_type}")
    return df.where(~codec.value_from_bytes(_cut_out(codec.value_to_bytes(F.col("v")))).eqNullSafe(F.col("v"))).isEmpty()


def pack_slice(spark: SparkSession, rows: Sequence[tuple[bytes, bytes, bytes]]) -> bool:
    """A string put between two others and sliced out again is itself, and orders as itself."""
    df = spark.createDataFrame([(bytearray(a), bytearray(b), bytearray(c)) for a, b, c in rows], "a binary, b binary, c binary")
    cut = F.substring(F.concat("a", "b", "c"), F.octet_length("a") + 1, F.octet_length("b"))
    return df.where(~cut.eqNullSafe(F.col("b")) | (cut < F.col("b")) | (cut > F.col("b"))).isEmpty()


def _pairs(spark: SparkSession, values: Sequence[Any], codec: Codec) -> DataFrame:
    rows = [(i, o, x) for i, pair in enumerate((a, b) for a in values for b in values) for o, x in enumerate(pair)]
    return spark.createDataFrame(rows, f"i int, o int, v {codec.spark_type}")


def resolve_valid_output(spark: SparkSession, resolver: Resolver, values: Sequence[Any], codec: Codec) -> bool:
    """Resolving two values gives a value of the type: it is there, and its bytes decode to it."""
    out = _pairs(spark, values, codec).groupBy("i").agg(resolver.total(F.col("v"), F.col("o")).cast(codec.spark_type).alias("v"))
    again = codec.value_from_bytes(codec.value_to_bytes(F.col("v")))
    return out.where(F.col("v").isNull() | ~again.eqNullSafe(F.col("v"))).isEmpty()


def resolve_compatibility(spark: SparkSession, resolver: Resolver, values: Sequence[Any], codec: Codec) -> bool:
    """Resolving values that were encoded and decoded gives the bytes of what resolving the values gives."""
    df = _pairs(spark, values, codec).withColumn("w", codec.value_from_bytes(codec.value_to_bytes(F.col("v"))))
    total = lambda c: codec.value_to_bytes(resolver.total(F.col(c), F.col("o")).cast(codec.spark_type))
    return df.groupBy("i").agg(total("v").alias("x"), total("w").alias("y")).where(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()


def key_order(spark: SparkSession, codec: Codec, keys: Sequence[Any]) -> bool:
    """The codec's comparisons order keys as their bytes do."""
    df = spark.createDataFrame([(k,) for k in keys], f"k {codec.spark_type}")
    k = F.col("k")
    return [r[0] for r in df.orderBy(*codec.order(k)).collect()] == [r[0] for r in df.orderBy(codec.to_bytes(k)).collect()]


def resolve_associativity(spark: SparkSession, resolver: Resolver, values: Sequence[Any], kind: str) -> bool:
    """Resolving three values at once equals resolving any two neighbours first."""
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate((a, b, c) for a in values for b in values for c in values)]
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}, c {kind}")

    def resolved(*cols: str):
        parts = [df.select("i", F.lit(n).alias("o"), F.col(c).alias("v")) for n, c in enumerate(reversed(cols))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def total(frame):
        return frame.groupBy("i").agg(resolver.total(F.col("v"), F.col("o")).alias("v"))

    pair = lambda x, y, o: total(resolved(x, y)).select("i", F.lit(o).alias("o"), "v")
    one = lambda x, o: df.select("i", F.lit(o).alias("o"), F.col(x).alias("v"))
    left = total(pair("a", "b", 1).unionByName(one("c", 0))).withColumnRenamed("v", "l")
    right = total(one("a", 1).unionByName(pair("b", "c", 0))).withColumnRenamed("v", "r")
    flat = total(resolved("a", "b", "c"))
    return flat.join(left, "i").join(right, "i").where(~F.col("v").eqNullSafe(F.col("l")) | ~F.col("v").eqNullSafe(F.col("r"))).isEmpty()
