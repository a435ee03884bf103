"""The registered queries and their DuckDB equivalents.

Most work on the change log of ``events`` (see sources.logs), over all its
rows; those of mutable tables run in a session of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.config import TableConfig, TableConfigOverride
from keelstone.functions import laws
from keelstone.functions.codecs import BYTES, INT32, INT64, UTF8
from keelstone.functions.resolvers import FIRST, MAX, MIN, SUM, Resolver, concat, fold
from keelstone.operators import simple, snapshot, union
from keelstone.operators.cursor import Cursor, prefix
from keelstone.operators.session import Session
from keelstone.operators.table import Delete, Insert, Range, Table, Upsert
from keelstone.plans.ordinals import numbered
from keelstone.plans.resolve import hot_keys, level_state, lookups, merged_log, union_state
from keelstone.sources.logs import EVENTS_LOG, as_log, events_log, orders_log
from keelstone.sources.scratch import session_root
from keelstone.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOTALS = {
    "sum": "CAST(sum(l.v) AS BIGINT)",
    "first": "arg_max(l.v, l.seq)",
    "min": "min(l.v)",
    "max": "max(l.v)",
    "concat": "string_agg(CAST(l.v AS VARCHAR), ' ' ORDER BY l.seq DESC)",
}


def state_sql(name: str, log: str, total: str = "sum") -> str:
    """CTEs that resolve a log to the state ``name``."""
    return f"""{name}_a AS (
  SELECT k, max(CASE WHEN op <> 'U' THEN seq END) AS anchor, max(seq) AS last FROM {log} GROUP BY k
), {name} AS (
  SELECT l.k, {TOTALS[total]} AS v, max(CASE WHEN l.seq = a.last AND l.op = 'I' THEN l.blob END) AS blob
  FROM {log} l JOIN {name}_a a ON l.k = a.k WHERE l.op <> 'D' AND l.seq >= coalesce(a.anchor, -1) GROUP BY l.k
)"""


def query(name: str, sql: str) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


RESOLVED = f"WITH {EVENTS_LOG}, {state_sql('S', 'L')}"


# Resolve functions


def _resolve(resolver: Resolver, text: bool = False) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = events_log(spark, sf_dir)
        return level_state(log.withColumn("v", F.col("v").cast("string")) if text else log, resolver).select("k", "v", "blob")

    return run


for _name, _resolver, _total in [("sum", SUM, "sum"), ("first", FIRST, "first"), ("min", MIN, "min"), ("max", MAX, "max"), ("concat", concat(" "), "concat"), ("fold", fold("plus", lambda new, old: new + old), "sum")]:
    query(f"resolve_{_name}", f"WITH {EVENTS_LOG}, {state_sql('S', 'L', _total)} SELECT k, v, blob FROM S")(_resolve(_resolver, _name == "concat"))


@query("resolve_hot_keys", f"{RESOLVED} SELECT k, v, blob FROM S")
def resolve_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for keys that hold a large share of the log."""
    log = events_log(spark, sf_dir)
    return level_state(log, SUM, hot_keys(log, 100)).select("k", "v", "blob")


# Lookups: every third customer key, present or not, and each of them twice.

KEYS = "K AS (SELECT 2 * c_custkey AS ordinal, 3 * c_custkey AS k FROM customer UNION ALL SELECT 2 * c_custkey + 1, 3 * c_custkey FROM customer)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((3 * F.col("c_custkey")).alias("k"), (2 * F.col("c_custkey")).alias("ordinal"))
    return c.unionByName(c.withColumn("ordinal", F.col("ordinal") + 1))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups(events_log(spark, sf_dir), _keys(spark, sf_dir), SUM)


_LOOKED = f"WITH {EVENTS_LOG}, {state_sql('S', 'L')}, {KEYS} SELECT "


@query("lookup_batch", _LOOKED + "ordinal, K.k, S.k IS NOT NULL AS found, v, blob FROM K LEFT JOIN S ON K.k = S.k")
def lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("ordinal", "k", "found", "v", "blob")


@query("member_batch", _LOOKED + "ordinal, K.k, S.k IS NOT NULL AS member FROM K LEFT JOIN S ON K.k = S.k")
def member_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("ordinal", "k", F.col("found").alias("member"))


@query("lookup_value_projection", _LOOKED + "ordinal, v FROM K LEFT JOIN S ON K.k = S.k")
def lookup_value_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("ordinal", "v")


@query("lookup_blob_projection", _LOOKED + "ordinal, blob FROM K LEFT JOIN S ON K.k = S.k")
def lookup_blob_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("ordinal", "blob")


# Ranges over orders; the bounds reach the scan.


def _range(low: int, high: int, inclusive: bool) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.col("k")
        log = orders_log(spark, sf_dir).where(INT64.at_least(k, low) & INT64.below(k, high, inclusive))
        return numbered(level_state(log, FIRST), INT64).select("ordinal", "k", "v")

    return run


for _name, _low, _high, _end in [("range_excl", 100, 700, False), ("range_incl", 100, 700, True), ("range_empty", 300, 300, False), ("range_reversed", 700, 100, True)]:
    query(_name, f"SELECT row_number() OVER (ORDER BY o_orderkey) AS ordinal, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders WHERE o_orderkey >= {_low} AND o_orderkey {'<=' if _end else '<'} {_high}")(
        _range(_low, _high, _end)
    )


@query(
    "range_int64_bytes",
    """WITH X AS (SELECT event_id - 500 AS k FROM events), H AS (SELECT k, lpad(upper(hex(CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616::HUGEINT ELSE k::HUGEINT END)), 16, '0') AS h FROM X)
SELECT row_number() OVER (ORDER BY h) AS ordinal, k, h AS key_bytes FROM H WHERE h >= '0000000000000005' AND h <= 'FFFFFFFFFFFFFFF0'""",
)
def range_int64_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed keys in the order of their bytes: negative ones last."""
    k = F.col("k")
    keys = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") - 500).alias("k"))
    inside = keys.where(INT64.at_least(k, 5) & INT64.below(k, -16, True))
    return numbered(inside, INT64).select("ordinal", "k", F.hex(INT64.to_bytes(k)).alias("key_bytes"))


# Updates on top of the log: (k, op, v, blob), in this order.

UPDATES = {
    "insert_overwrite": [(1, "I", 11, None), (1, "I", 12, None), (2, "I", 7, "b"), (1_000_001, "I", 5, None)],
    "insert_clears_blob": [(3, "I", 1, "old"), (3, "I", 2, None)],
    "upsert_absent": [(1_000_002, "U", 9, None), (4, "U", 1, None)],
    "upsert_drops_blob": [(5, "I", 10, "gone"), (5, "U", 4, None)],
    "delete_absent": [(1_000_003, "D", None, None), (6, "D", None, None)],
    "delete_then_upsert": [(7, "I", 50, "x"), (7, "D", None, None), (7, "U", 3, None)],
}


def _updated(rows: list[tuple]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        extra = spark.createDataFrame([(k, 1_000_000_000_000 + i, op, v, b) for i, (k, op, v, b) in enumerate(rows)], "k bigint, seq bigint, op string, v bigint, blob string")
        return level_state(events_log(spark, sf_dir).unionByName(extra), SUM).select("k", "v", "blob")

    return run


def _values(rows: list[tuple]) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({k}, {1_000_000_000_000 + i}, '{op}', CAST({lit(v)} AS BIGINT), CAST({lit(b)} AS VARCHAR))" for i, (k, op, v, b) in enumerate(rows))


for _name, _rows in UPDATES.items():
    query(_name, f"WITH {EVENTS_LOG}, M AS (SELECT * FROM L UNION ALL SELECT * FROM (VALUES {_values(_rows)}) t(k, seq, op, v, blob)), {state_sql('S', 'M')} SELECT k, v, blob FROM S")(_updated(_rows))


# Tables in a session


def _table(spark: SparkSession, sf_dir: str, batches: int = 1, config: TableConfig | None = None) -> Table:
    """The events log as a table, in so many batches one after another."""
    table = Table(Session.open(spark, session_root(spark)), INT64, "bigint", SUM, config or TableConfig())
    log = events_log(spark, sf_dir).select(F.col("seq").alias("ordinal"), "k", "op", "v", F.col("blob").cast("binary").alias("blob"))
    last = (log.agg(F.max("ordinal")).first()[0] or 0) + 1
    for b in range(batches):
        table.updates(log.where((F.col("ordinal") * batches >= b * last) & (F.col("ordinal") * batches < (b + 1) * last)))
    return table


def _shown(table: Table, state: DataFrame | None = None) -> DataFrame:
    """(k, v, blob) with the blobs' text."""
    return table.with_blobs(state).select("k", "v", F.col("bytes").cast("string").alias("blob"))


@query("updates_batch_order", f"{RESOLVED} SELECT k, v, blob FROM S")
def updates_batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches equal one."""
    return _shown(_table(spark, sf_dir, 3))


@query(
    "duplicate_diverge",
    f"WITH {EVENTS_LOG}, M AS (SELECT * FROM L UNION ALL SELECT k, seq + 1000000000, 'U', 100, NULL FROM L WHERE op = 'I'), {state_sql('S', 'L')}, {state_sql('T', 'M')} SELECT 'original' AS side, k, v FROM S UNION ALL SELECT 'duplicate', k, v FROM T",
)
def duplicate_diverge(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    other = table.duplicate()
    more = events_log(spark, sf_dir).where("op = 'I'")
    other.updates(more.select(F.col("seq").alias("ordinal"), "k", F.lit("U").alias("op"), F.lit(100).cast("bigint").alias("v"), F.lit(None).cast("binary").alias("blob")))
    return table.state().select(F.lit("original").alias("side"), "k", "v").unionByName(other.state().select(F.lit("duplicate").alias("side"), "k", "v"))


@query("blob_retrieve", f"{RESOLVED} SELECT k, blob FROM S WHERE blob IS NOT NULL")
def blob_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from the state, followed to the blobs beside the runs."""
    table = _table(spark, sf_dir)
    return _shown(table, table.state().where("blob IS NOT NULL")).select("k", "blob")


# Unions of the log's parts by seq modulo n, each resolved on its own first.


def _parts(spark: SparkSession, sf_dir: str, n: int) -> list[DataFrame]:
    log = events_log(spark, sf_dir)
    return [level_state(log.where(F.col("seq") % n == i), SUM) for i in range(n)]


def union_sql(n: int, total: str = "CAST(sum(v) AS BIGINT)") -> str:
    parts = ", ".join(f"L{i} AS (SELECT * FROM L WHERE seq % {n} = {i}), {state_sql(f'S{i}', f'L{i}')}" for i in range(n))
    rows = " UNION ALL ".join(f"SELECT {i} AS t, * FROM S{i}" for i in range(n))
    return f"WITH {EVENTS_LOG}, {parts}, R AS ({rows}), F AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS n FROM R) SELECT k, {total} AS v, max(CASE WHEN n = 1 THEN blob END) AS blob FROM F GROUP BY k"


for _n in (1, 2, 3):
    query(f"union_{_n}", union_sql(_n))(lambda spark, sf_dir, n=_n: union_state(_parts(spark, sf_dir, n), SUM).select("k", "v", "blob"))


@query("union_blob_left", f"SELECT k, blob FROM ({union_sql(2)})")
def union_blob_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_state(_parts(spark, sf_dir, 2), SUM).select("k", "blob")


@query("union_first_is_newest", union_sql(3, "arg_min(v, t)"))
def union_first_is_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_state(_parts(spark, sf_dir, 3), FIRST).select("k", "v", "blob")


@query(
    "union_with_deletes",
    f"WITH {EVENTS_LOG}, D AS (SELECT DISTINCT k FROM L WHERE op = 'D'), L0 AS (SELECT * FROM L UNION ALL SELECT k, 1000000000000, 'D', NULL, NULL FROM D), {state_sql('S0', 'L0')}, {state_sql('S1', 'L')} SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT k, v FROM S0 UNION ALL SELECT k, v FROM S1) GROUP BY k",
)
def union_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that one table has deleted comes from the other one alone."""
    log = events_log(spark, sf_dir)
    gone = log.where("op = 'D'").select("k").distinct().select("k", F.lit(1_000_000_000_000).cast("bigint").alias("seq"), F.lit("D").alias("op"), F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("string").alias("blob"))
    return union_state([level_state(log.unionByName(gone), SUM), level_state(log, SUM)], SUM).select("k", "v")


@query("union_self", f"{RESOLVED} SELECT k, 2 * v AS v, blob FROM S")
def union_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = level_state(events_log(spark, sf_dir), SUM)
    return union_state([state, state], SUM).select("k", "v", "blob")


def _union_tables(spark: SparkSession, sf_dir: str) -> list[Table]:
    first = Table(Session.open(spark, session_root(spark)), INT64, "bigint", SUM)
    second = Table(first.session, INT64, "bigint", SUM)
    log = events_log(spark, sf_dir).select(F.col("seq").alias("ordinal"), "k", "op", "v", F.col("blob").cast("binary").alias("blob"))
    for i, t in enumerate((first, second)):
        t.updates(log.where(F.col("ordinal") % 2 == i))
    return [first, second]


@query("incremental_union_partial", f"SELECT k, v FROM ({union_sql(2)})")
def incremental_union_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half paid: the same rows as ever."""
    out = union.incremental_unions(_union_tables(spark, sf_dir))
    union.supply_union_credits(out, union.remaining_union_debt(out) // 2)
    return out.state().select("k", "v")


@query("union_debt", "SELECT 'before' AS at, count(*) + 1 AS debt FROM events UNION ALL SELECT 'paid', 0 UNION ALL SELECT 'left over', 2 UNION ALL SELECT 'not a union', 0")
def union_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _union_tables(spark, sf_dir)
    out = union.incremental_unions(parts)
    before = union.remaining_union_debt(out)
    left = union.supply_union_credits(out, before + 2)
    rows = [("before", before), ("paid", union.remaining_union_debt(out)), ("left over", left), ("not a union", union.remaining_union_debt(parts[0]))]
    return spark.createDataFrame(rows, "at string, debt bigint")


# Cursors; an ordinal shows the order.

_ORDERED = f"{RESOLVED}, C AS (SELECT row_number() OVER (ORDER BY k) AS ordinal, k, v FROM S WHERE k >= %d) SELECT ordinal, k, v FROM C"


def _ordinal(df: DataFrame) -> DataFrame:
    return numbered(df, INT64).select("ordinal", "k", "v")


@query("cursor_full", _ORDERED % 0)
def cursor_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordinal(Cursor(_table(spark, sf_dir)).frame())


@query("cursor_offset", _ORDERED % 5)
def cursor_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordinal(Cursor(_table(spark, sf_dir), 5).frame())


@query("cursor_take", _ORDERED % 10 + " WHERE ordinal <= 25")
def cursor_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Cursor(_table(spark, sf_dir), 10).take(25)
    return spark.createDataFrame([(i + 1, e.key, e.value) for i, e in enumerate(rows)], "ordinal bigint, k bigint, v bigint")


@query("cursor_take_while", _ORDERED % 0 + " WHERE k < coalesce((SELECT min(k) FROM S WHERE NOT v < 20000), 1000000000)")
def cursor_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of keys before the first that fails a condition."""
    table = _table(spark, sf_dir)
    return _ordinal(prefix(table.state(), F.col("v") < 20000, table))


@query("cursor_pages", _ORDERED % 0 + " WHERE ordinal <= 30")
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reads of ten."""
    cursor = Cursor(_table(spark, sf_dir))
    rows = [e for _ in range(3) for e in cursor.take(10)]
    return spark.createDataFrame([(i + 1, e.key, e.value) for i, e in enumerate(rows)], "ordinal bigint, k bigint, v bigint")


@query("cursor_stable_view", _ORDERED % 0)
def cursor_stable_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later updates and the table's closing don't show."""
    table = _table(spark, sf_dir)
    cursor = Cursor(table)
    table.deletes(range(20))
    table.close()
    return _ordinal(cursor.frame())


# Snapshots


def _reopened(spark: SparkSession, sf_dir: str, override: TableConfigOverride | None = None, through: bool = False) -> DataFrame:
    table = _table(spark, sf_dir, 2)
    session = table.session
    snapshot.save_snapshot(table, "kept", "events by user")
    if through:
        outside = f"{session.root}-exported"
        snapshot.export_snapshot(session, "kept", outside)
        snapshot.import_snapshot(session, "again", outside)
    session.close()
    again = Session.restore(spark, session.root)
    return snapshot.open_table_from_snapshot(again, "again" if through else "kept", "events by user", override=override).state().select("k", "v")


@query("snapshot_roundtrip", f"{RESOLVED} SELECT k, v FROM S")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reopened(spark, sf_dir)


@query("snapshot_override", f"{RESOLVED} SELECT k, v FROM S")
def snapshot_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reopened(spark, sf_dir, TableConfigOverride(cache="none", merge_batch=100))


@query("export_import", f"{RESOLVED} SELECT k, v FROM S")
def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reopened(spark, sf_dir, through=True)


# Merges


@query("compact_mid_level", f"{RESOLVED} SELECT k, v, blob FROM S")
def compact_mid_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer half of the log merged, the older half as it is."""
    log = events_log(spark, sf_dir)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    return level_state(log.where(F.col("seq") <= half).unionByName(merged_log(log.where(F.col("seq") > half), SUM)), SUM).select("k", "v", "blob")


@query("compact_last_level", f"{RESOLVED} SELECT k, v, blob, 'I' AS op FROM S")
def compact_last_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of it: one insert per live key."""
    return merged_log(events_log(spark, sf_dir), SUM, last_level=True).select("k", "v", "blob", "op")


@query("compacted_table", f"{RESOLVED} SELECT k, v, blob FROM S")
def compacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, 4)
    table.compact(2)
    table.compact()
    return _shown(table)


# The tables' own operations, from their handles


def _log_rows(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """events as a batch of updates."""
    return events_log(spark, sf_dir).where(where).select(F.col("seq").alias("ordinal"), "k", "op", "v", F.col("blob").cast("binary").alias("blob"))


LIST = list(range(0, 240, 3)) * 2

_LIST_SQL = f"{RESOLVED}, P AS (SELECT (i // 3 + 80 * r)::INT AS ordinal, i AS k FROM (SELECT unnest(range(0, 240, 3)) AS i), (SELECT unnest([0, 1]) AS r))"


@query("table_lookups", _LIST_SQL + " SELECT P.ordinal, P.k, S.k IS NOT NULL AS found, v, blob IS NOT NULL AS has_blob FROM P LEFT JOIN S ON P.k = S.k")
def table_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys, some of them absent and each of them twice."""
    found = _table(spark, sf_dir, 2).lookups(LIST)
    return spark.createDataFrame([(i, k, r.found, r.value, r.blob is not None) for i, (k, r) in enumerate(zip(LIST, found))], "ordinal int, k bigint, found boolean, v bigint, has_blob boolean")


@query("table_members", _LIST_SQL + " SELECT P.ordinal, P.k, S.k IS NOT NULL AS member FROM P LEFT JOIN S ON P.k = S.k")
def table_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir).members(LIST)
    return spark.createDataFrame([(i, k, m) for i, (k, m) in enumerate(zip(LIST, found))], "ordinal int, k bigint, member boolean")


@query("table_single_lookups", f"{RESOLVED}, P AS (SELECT unnest([0, 3, 100000000]) AS k) SELECT P.k, S.k IS NOT NULL AS member, v FROM P LEFT JOIN S ON P.k = S.k")
def table_single_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    return spark.createDataFrame([(k, table.member(k), table.lookup(k).value) for k in (0, 3, 100_000_000)], "k int, member boolean, v bigint")


@query("table_lookup_frame", _LOOKED + "ordinal, K.k, S.k IS NOT NULL AS found, v FROM K LEFT JOIN S ON K.k = S.k")
def table_lookup_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys as a DataFrame."""
    return _table(spark, sf_dir, 3).lookup_frame(_keys(spark, sf_dir)).select("ordinal", "k", "found", "v")


@query("table_range_lookup", "SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders WHERE o_orderkey >= 40 AND o_orderkey <= 90")
def table_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(Session.open(spark, session_root(spark)))
    table.updates(orders_log(spark, sf_dir).select(F.col("seq").alias("ordinal"), "k", "op", "v", F.lit(None).cast("binary").alias("blob")))
    return spark.createDataFrame([(e.key, e.value) for e in table.range_lookup(Range(40, 90, True))], "k bigint, v bigint")


_CHANGES = [(1, "I", 11, "a"), (2, "I", 12, None), (1, "U", 5, None), (3, "U", 6, None), (4, "D", None, None), (5, "D", None, None), (1_000_007, "I", 1, "z"), (6, "U", 2, None), (7, "I", 3, "c"), (8, "D", None, None)]


@query("table_updates_by_method", f"WITH {EVENTS_LOG}, M AS (SELECT * FROM L UNION ALL SELECT * FROM (VALUES {_values(_CHANGES)}) t(k, seq, op, v, blob)), {state_sql('S', 'M')} SELECT k, v, blob FROM S")
def table_updates_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inserts, upsert, upserts, deletes, insert, update and delete, one after another; they wait in the buffer."""
    table = _table(spark, sf_dir)
    table.inserts([(1, 11, b"a"), (2, 12)])
    table.upsert(1, 5)
    table.upserts([(3, 6)])
    table.deletes([4, 5])
    table.insert(1_000_007, 1, b"z")
    table.update(6, Upsert(2))
    table.updates([(7, Insert(3, b"c"))])
    table.delete(8)
    return _shown(table)


@query("write_buffer_flushed", f"SELECT k, v, blob, 0 AS held FROM (WITH {EVENTS_LOG}, M AS (SELECT * FROM L UNION ALL SELECT * FROM (VALUES {_values(_CHANGES)}) t(k, seq, op, v, blob)), {state_sql('S', 'M')} SELECT k, v, blob FROM S)")
def write_buffer_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer of five entries becomes a run twice."""
    table = _table(spark, sf_dir, config=TableConfig(write_buffer=5, merge_batch=5))
    for k, op, v, b in _CHANGES:
        table.update(k, Insert(v, b and b.encode()) if op == "I" else Upsert(v) if op == "U" else Delete())
    return _shown(table).withColumn("held", F.lit(len(table.content.buffer)))


def _small_batches(spark: SparkSession, sf_dir: str, schedule: str) -> Table:
    """The first events, ten to a batch, and the others behind them."""
    table = Table(Session.open(spark, session_root(spark)), INT64, "bigint", SUM, TableConfig(write_buffer=10, merge_batch=10, merge_schedule=schedule))
    first = events_log(spark, sf_dir).where("seq < 200").orderBy("seq").collect()
    change = {"I": lambda r: Insert(r["v"], r["blob"] and r["blob"].encode()), "U": lambda r: Upsert(r["v"]), "D": lambda r: Delete()}
    for at in range(0, len(first), 10):
        table.updates([(r["k"], change[r["op"]](r)) for r in first[at : at + 10]])
    table.updates(_log_rows(spark, sf_dir, "seq >= 200"))
    return table


_LEVELS = "SELECT k, v, blob, true AS few_runs FROM ("


@query("levels_one_shot", f"{_LEVELS}{RESOLVED} SELECT k, v, blob FROM S)")
def levels_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty runs of ten entries and a large one: levels merge at once, and the state stays."""
    table = _small_batches(spark, sf_dir, "one_shot")
    return _shown(table).withColumn("few_runs", F.lit(len(table.content.runs) <= 8))


@query("levels_incremental", f"{_LEVELS}{RESOLVED} SELECT k, v, blob FROM S)")
def levels_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where merges wait for credits."""
    table = _small_batches(spark, sf_dir, "incremental")
    table.supply_merge_credits(1_000_000)
    return _shown(table).withColumn("few_runs", F.lit(len(table.content.runs) <= 8))


# Blobs, wherever their entries have gone


@query("blob_after_compact", f"{RESOLVED} SELECT k, blob FROM S")
def blob_after_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, 3)
    table.compact()
    return _shown(table).select("k", "blob")


@query("blob_after_reopen", f"{RESOLVED} SELECT k, blob FROM S")
def blob_after_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, 2)
    snapshot.save_snapshot(table, "kept", "events by user")
    table.session.close()
    again = Session.restore(spark, table.session.root)
    return _shown(snapshot.open_table_from_snapshot(again, "kept", "events by user")).select("k", "blob")


@query("blob_of_union", f"SELECT k, blob FROM ({union_sql(2)})")
def blob_of_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(union.unions(_union_tables(spark, sf_dir))).select("k", "blob")


@query("blob_references", f"{RESOLVED} SELECT k, blob FROM S WHERE k < 40 AND blob IS NOT NULL")
def blob_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retrieve_blobs with a list of references."""
    table = _table(spark, sf_dir, 2)
    entries = [e for e in table.range_lookup(Range(0, 40)) if e.blob]
    return spark.createDataFrame([(e.key, b.decode()) for e, b in zip(entries, table.retrieve_blobs([e.blob for e in entries]))], "k bigint, blob string")


# Unions of handles


@query("unions_of_tables", union_sql(2))
def unions_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All work done now: the union has become runs."""
    out = union.unions(_union_tables(spark, sf_dir))
    if out.content.union is not None:
        raise AssertionError("the union was not folded into the levels")
    return _shown(out)


@query("union_migrated_then_updated", f"SELECT k, v + CASE WHEN k < 50 THEN 100 ELSE 0 END AS v FROM ({union_sql(2)}) UNION ALL SELECT x, 100 FROM (SELECT unnest(range(50)) AS x) WHERE x NOT IN (SELECT k FROM ({union_sql(2)}))")
def union_migrated_then_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = union.incremental_unions(_union_tables(spark, sf_dir))
    out.upserts([(k, 100) for k in range(50)])
    union.supply_union_credits(out, union.remaining_union_debt(out))
    out.compact()
    return out.state().select("k", "v")


@query("union_of_one", f"{RESOLVED} SELECT k, v, blob FROM S")
def union_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(union.unions([_table(spark, sf_dir)]))


@query("union_hot_keys", union_sql(2))
def union_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose hot keys are summed up where they lie."""
    log = events_log(spark, sf_dir)
    halves = [log.where(F.col("seq") % 2 == i) for i in range(2)]
    return union_state([level_state(x, SUM, hot_keys(x, 100)) for x in halves], SUM).select("k", "v", "blob")


@query("compact_hot_keys", f"{RESOLVED} SELECT k, v, blob FROM S")
def compact_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer half merged with its hot keys on a plan of their own."""
    log = events_log(spark, sf_dir)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    newer = log.where(F.col("seq") > half)
    return level_state(log.where(F.col("seq") <= half).unionByName(merged_log(newer, SUM, hot=hot_keys(newer, 100))), SUM).select("k", "v", "blob")


@query("compact_hot_keys_in_order", f"WITH {EVENTS_LOG}, {state_sql('S', 'L', 'concat')} SELECT k, v, blob FROM S")
def compact_hot_keys_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir).withColumn("v", F.col("v").cast("string"))
    return level_state(merged_log(log, concat(" "), hot=hot_keys(log, 100)), concat(" ")).select("k", "v", "blob")


# Cursors from their handles


@query("cursor_next", _ORDERED % 0 + " WHERE ordinal <= 3")
def cursor_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Cursor(_table(spark, sf_dir)) as cursor:
        rows = [e for _ in range(3) if (e := cursor.next())]
    return spark.createDataFrame([(i + 1, e.key, e.value) for i, e in enumerate(rows)], "ordinal bigint, k bigint, v bigint")


@query("cursor_take_while_keys", _ORDERED % 2 + " WHERE k < 20 AND ordinal <= 12")
def cursor_take_while_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """take_while on the key, with a bound on the number."""
    rows = Cursor(_table(spark, sf_dir), 2).take_while(12, lambda k: k < 20)
    return spark.createDataFrame([(i + 1, e.key, e.value) for i, e in enumerate(rows)], "ordinal bigint, k bigint, v bigint")


# Snapshots and sessions from their handles


@query("snapshot_listing", "SELECT 'one' AS name, false AS listed, false AS there UNION ALL SELECT 'two', true, true UNION ALL SELECT 'three', false, false")
def snapshot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    session = table.session
    for name in ("one", "two"):
        snapshot.save_snapshot(table, name, "events")
    snapshot.delete_snapshot(session, "one")
    names = snapshot.list_snapshots(session)
    return spark.createDataFrame([(n, n in names, snapshot.does_snapshot_exist(session, n)) for n in ("one", "two", "three")], "name string, listed boolean, there boolean")


@query("session_scopes", f"{RESOLVED} SELECT k, v, blob FROM S")
def session_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new session, closed behind its scope; then one that restores it."""
    root = session_root(spark)
    with Session.new(spark, root) as session, Table(session, INT64, "bigint", SUM) as table:
        table.updates(_log_rows(spark, sf_dir))
        with table.duplicate() as other:
            snapshot.save_snapshot(other, "kept", "events")
    return _shown(snapshot.open_table_from_snapshot(Session.restore(spark, root), "kept", "events"))


@query("snapshot_of_union", union_sql(2))
def snapshot_of_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union that is half paid, reopened."""
    out = union.incremental_unions(_union_tables(spark, sf_dir))
    union.supply_union_credits(out, union.remaining_union_debt(out) // 2)
    snapshot.save_snapshot(out, "half", "union")
    out.session.close()
    return _shown(snapshot.open_table_from_snapshot(Session.restore(spark, out.session.root), "half", "union"))


@query("simple_table", f"WITH {EVENTS_LOG}, N AS (SELECT k, seq, CASE WHEN op = 'D' THEN 'D' ELSE 'I' END AS op, v, NULL AS blob FROM L WHERE seq < 300), {state_sql('S', 'N', 'first')} SELECT k, v FROM S")
def simple_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts and deletes of plain values, through the simple handle and its cursor."""
    table = simple.SimpleTable(Session.open(spark, session_root(spark)))
    rows = events_log(spark, sf_dir).where("seq < 300").orderBy("seq").collect()
    table.updates([(r["k"], None if r["op"] == "D" else r["v"]) for r in rows])
    with table.cursor() as cursor:
        return spark.createDataFrame(cursor.take(10_000), "k bigint, v bigint")


@query("streamed_updates", f"{RESOLVED} SELECT k, v, blob FROM S")
def streamed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files into a table."""
    table = Table(Session.open(spark, session_root(spark)), INT64, "bigint", SUM)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    log = as_log(source).select(F.col("seq").alias("ordinal"), "k", "op", "v", F.col("blob").cast("binary").alias("blob"))
    _, name = table.session.fresh("stream")
    ingest(log, table).option("checkpointLocation", f"{table.session.root}/active/{name}").trigger(availableNow=True).start().awaitTermination()
    return _shown(table)


LAWS = ["key identity", "key identity up to slicing", "key order", "value identity", "value identity up to slicing", "pack slice", "resolve associativity", "resolve compatibility", "resolve valid output"]


@query("laws", " UNION ALL ".join(f"SELECT '{x}' AS law, true AS holds" for x in LAWS))
def laws_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine laws on user numbers, names and event values of the data."""
    users = [r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().orderBy("user_id").limit(30).collect()]
    users += [-1, -(2**63), 2**63 - 1]
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name").orderBy("c_name").limit(20).collect()] + ["", "\u00e9"]
    raw = [n.encode() for n in names]
    holds = [
        laws.key_identity(spark, INT64, users) and laws.key_identity(spark, UTF8, names),
        laws.key_identity_up_to_slicing(spark, INT64, users) and laws.key_identity_up_to_slicing(spark, UTF8, names),
        laws.key_order(spark, INT64, users) and laws.key_order(spark, UTF8, names),
        laws.value_identity(spark, INT64, users) and laws.value_identity(spark, BYTES, list(map(bytearray, raw))),
        laws.value_identity_up_to_slicing(spark, INT64, users) and laws.value_identity_up_to_slicing(spark, UTF8, names),
        laws.pack_slice(spark, list(zip(raw, raw[1:], raw[2:]))),
        laws.resolve_associativity(spark, SUM, users[:4], "bigint") and laws.resolve_associativity(spark, concat("-"), names[:3], "string"),
        laws.resolve_compatibility(spark, FIRST, users, INT64) and laws.resolve_compatibility(spark, MAX, [1, -5, 9], INT32),
        laws.resolve_valid_output(spark, concat(""), names, UTF8) and laws.resolve_valid_output(spark, SUM, users[:9], INT64),
    ]
    return spark.createDataFrame(list(zip(LAWS, holds)), "law string, holds boolean")
