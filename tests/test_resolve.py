import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keelstone.functions import laws, resolvers
from keelstone.functions.codecs import BYTES, CODECS, INT8, INT64, UTF8, WORD8, WORD64
from keelstone.plans import resolve
from keelstone.plans.resolve import hot_keys, level_state, lookups, merged_log, union_state
from tests.model import Model

LOG = "k bigint, seq bigint, op string, v string, blob string"
RESOLVERS = {
    "first": (resolvers.FIRST, lambda new, old: new),
    "max": (resolvers.MAX, max),
    "min": (resolvers.MIN, min),
    "concat": (resolvers.concat(" "), lambda new, old: new + " " + old),
    "plain concat": (resolvers.concat(), lambda new, old: new + old),
    "fold": (resolvers.fold("wrap", lambda new, old: F.concat(new, F.lit("/"), old)), lambda new, old: f"{new}/{old}"),
}


def rows_of(df):
    return sorted((r["k"], r["v"], r["blob"]) for r in df.collect())


@pytest.mark.parametrize("name", RESOLVERS)
def test_all_histories_of_three_entries(spark, name):
    """Every sequence of one to three operations, each under a key of its own."""
    resolver, plain = RESOLVERS[name]
    kinds = ["I", "B", "U", "D"]
    log, model = [], Model(plain)
    histories = [h for n in (1, 2, 3) for h in itertools.product(kinds, repeat=n)]
    for k, h in enumerate(histories):
        changes = [(k, "I" if op == "B" else op, None if op == "D" else f"v{i}", f"b{i}" if op == "B" else None) for i, op in enumerate(h)]
        model.apply(changes)
        log += [(k, i, op, v, b) for i, (k, op, v, b) in enumerate(changes)]
    df = spark.createDataFrame(log, LOG)
    want = model.sorted()
    assert rows_of(level_state(df, resolver)) == want
    # Merging any stretch of the log first changes nothing.
    for cut in (1, 2):
        older, newer = df.where(F.col("seq") < cut), df.where(F.col("seq") >= cut)
        assert rows_of(level_state(older.unionByName(merged_log(newer, resolver)), resolver)) == want
        assert rows_of(level_state(merged_log(older, resolver, last_level=True).unionByName(newer), resolver)) == want
    last = merged_log(df, resolver, last_level=True)
    assert {r["op"] for r in last.select("op").distinct().collect()} == {"I"} and rows_of(last) == want


@pytest.mark.parametrize("name", ["first", "concat"])
def test_hot_keys_and_unions_of_random_logs(spark, name):
    resolver, plain = RESOLVERS[name]
    rnd = random.Random(9)
    parts, models = [], []
    for _ in range(3):
        changes = []
        for i in range(600):
            k = 0 if rnd.random() < 0.4 else rnd.randrange(60)
            op = rnd.choices("IUD", [10, 5, 1])[0]
            changes.append((k, op, None if op == "D" else f"v{i}", f"b{i}" if op == "I" and rnd.random() < 0.5 else None))
        m = Model(plain)
        m.apply(changes)
        df = spark.createDataFrame([(k, i * 1000, op, v, b) for i, (k, op, v, b) in enumerate(changes)], LOG)
        assert hot_keys(df, 10) == [0]
        state = level_state(df, resolver, hot_keys(df, 10))
        assert rows_of(state) == m.sorted() == rows_of(level_state(df, resolver))
        parts.append(state)
        models.append(m)
    assert rows_of(union_state(parts, resolver)) == Model.union(models).sorted()
    assert rows_of(union_state(parts[:1], resolver)) == models[0].sorted()


def test_sums(spark):
    df = spark.createDataFrame([(1, 0, "I", Decimal(2**63), None), (1, 1, "U", Decimal(2**63 + 5), None)], "k bigint, seq bigint, op string, v decimal(20,0), blob string")
    assert rows_of(level_state(df, resolvers.SUM_WORD64)) == [(1, 5, None)]
    ints = spark.createDataFrame([(1, i, "U", i + 1, None) for i in range(5)], "k bigint, seq bigint, op string, v bigint, blob string")
    assert rows_of(level_state(ints, resolvers.PRODUCT)) == [(1, 120, None)]
    assert rows_of(level_state(ints, resolvers.SUM)) == [(1, 15, None)]
    assert rows_of(level_state(ints.limit(0), resolvers.SUM)) == []


KEYS = {
    "int64": [0, 1, -1, 5, -5, 2**63 - 1, -(2**63)], "int32": [0, 7, -7, -(2**31)], "int16": [0, 1, -1, 300], "int8": [0, 1, -1, -128, 127],
    "word64": [0, 1, 2**63, 2**64 - 1, 2**32], "word32": [0, 2**32 - 1, 9], "word16": [0, 65535], "word8": [0, 255, 16], "utf8": ["", "a", "ab", "é", "🙂"], "bytes": [bytearray(b""), bytearray(b"\x00"), bytearray(b"\xff\x01")],
}


@pytest.mark.parametrize("name", CODECS)
def test_key_laws(spark, name):
    keys = [Decimal(k) for k in KEYS[name]] if name == "word64" else KEYS[name]
    assert laws.key_identity(spark, CODECS[name], keys)
    assert laws.key_order(spark, CODECS[name], keys)


def test_ranges_follow_the_bytes(spark):
    keys = [*range(-20, 20), 2**62, -(2**62)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    k = F.col("k")
    unsigned = lambda x: x % 2**64
    for lo, hi in [(-5, 5), (5, -5), (3, 9), (-9, -3), (9, 3), (0, 0)]:
        for inclusive in (False, True):
            got = sorted(r["k"] for r in df.where(INT64.at_least(k, lo) & INT64.below(k, hi, inclusive)).collect())
            assert got == [x for x in sorted(keys) if unsigned(lo) <= unsigned(x) and (unsigned(x) < unsigned(hi) or inclusive and x == hi)]


@pytest.mark.parametrize("name", CODECS)
def test_slicing_and_value_laws(spark, name):
    keys = [Decimal(k) for k in KEYS[name]] if name == "word64" else KEYS[name]
    assert laws.key_identity_up_to_slicing(spark, CODECS[name], keys)
    assert laws.value_identity(spark, CODECS[name], keys) and laws.value_identity_up_to_slicing(spark, CODECS[name], keys)


def test_resolver_laws(spark):
    assert laws.pack_slice(spark, [(b"", b"", b""), (b"a", b"\x00\xff", b"z"), (b"xy", b"q", b"")])
    assert laws.resolve_valid_output(spark, resolvers.SUM, [1, -4, 9], INT64) and laws.resolve_compatibility(spark, resolvers.MAX, [1, -4, 9], INT64)
    assert not laws.resolve_valid_output(spark, resolvers.fold("none", lambda new, old: F.nullif(new, new)), [1, 2], INT64)
    assert laws.resolve_associativity(spark, resolvers.concat("-"), ["a", "b"], "string")
    assert laws.resolve_associativity(spark, resolvers.FIRST, ["a", "b"], "string")
    assert not laws.resolve_associativity(spark, resolvers.fold("minus", lambda new, old: new - old), [1, 2, 4], "bigint")
    for name in ("first", "sum", "concat", "concat:x", "product"):
        assert resolvers.by_name(name).name == name


def test_plans_push_bounds_and_keys_down(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id AS seq", "'I' AS op", "id AS v", "CAST(NULL AS STRING) AS blob").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,3)" in plan(level_state(log, resolvers.SUM).where("k >= 3 AND k <= 5"))
    # A state takes one exchange and one scan of the log, whatever the resolver.
    for resolver in (resolvers.SUM, resolvers.FIRST, resolvers.concat(" ")):
        text = log.withColumn("v", F.col("v").cast("string")) if resolver.name.startswith("concat") else log
        for df in (level_state(text, resolver), merged_log(text, resolver)):
            assert plan(df).count("Exchange hashpartitioning") == 1 and plan(df).count("FileScan") == 1
    # Looked-up keys reach the scan as a list; the log itself isn't shuffled or joined to find them.
    keys = spark.createDataFrame([(0, 7), (1, 8)], "ordinal int, k bigint")
    few = plan(lookups(log, keys, resolvers.SUM))
    assert "PushedFilters: [IsNotNull(k), In(k, [7,8])" in few or "Or(EqualTo(k,7),EqualTo(k,8))" in few or "In(k, [7,8])" in few
    assert "LeftSemi" not in few


def test_lookups_by_list_broadcast_and_shuffle_agree(spark, monkeypatch):
    log = spark.createDataFrame([(i % 50, i, "IUD"[i % 3], str(i), None) for i in range(600)], LOG)
    keys = spark.createDataFrame([(i, i % 70) for i in range(140)] + [(999, None)], "ordinal int, k bigint")
    want = sorted(map(str, lookups(log, keys, resolvers.concat(" ")).collect()))
    for listed, broadcast in ((3, 10**6), (3, 1)):
        monkeypatch.setattr(resolve, "LISTED", listed)
        monkeypatch.setattr(resolve, "BROADCAST", broadcast)
        assert sorted(map(str, lookups(log, keys, resolvers.concat(" ")).collect())) == want


def test_merging_with_hot_keys_changes_nothing(spark):
    rnd = random.Random(2)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(40), i * 7, rnd.choices("IUD", [3, 9, 1])[0], f"v{i}", None) for i in range(900)]
    df = spark.createDataFrame([(k, s, op, None if op == "D" else v, f"b{s}" if op == "I" else None) for k, s, op, v, _ in rows], LOG)
    older, newer = df.where("seq < 3000"), df.where("seq >= 3000")
    for resolver in (resolvers.concat(" "), resolvers.MAX, resolvers.FIRST):
        want = rows_of(level_state(df, resolver))
        for hot in (None, [0, 3], hot_keys(newer, 10)):
            assert rows_of(level_state(older.unionByName(merged_log(newer, resolver, hot=hot)), resolver, hot)) == want
            assert rows_of(merged_log(df, resolver, last_level=True, hot=hot)) == want


assert {INT8.name, WORD8.name, WORD64.name, UTF8.name, BYTES.name} <= set(CODECS)
