from pyspark.sql import functions as F

from keelstone.functions.codecs import INT64
from keelstone.functions.resolvers import SUM
from keelstone.operators.session import Session
from keelstone.operators.table import Table
from keelstone.plans.resolve import level_state
from keelstone.sources.logs import events_log
from keelstone.sources.scratch import session_root
from keelstone.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


def test_a_stream_of_updates_gives_the_batch_result(spark, tmp_path):
    log = events_log(spark, SF)
    rows = log.select(F.col("seq").alias("ordinal"), "k", "op", "v", F.col("blob").cast("binary").alias("blob"))
    for i in range(3):
        rows.where(F.col("ordinal").between(i * 400, i * 400 + 399)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with Session.open(spark, session_root(spark)) as session:
        table = Table(session, INT64, "bigint", SUM)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = ingest(stream, table).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert len(table.content.runs) == 3
        assert sorted(map(tuple, table.state().select("k", "v").collect())) == sorted(map(tuple, level_state(log, SUM).select("k", "v").collect()))


def test_a_replayed_batch_is_skipped_also_after_a_restart(spark, tmp_path):
    from keelstone.operators import snapshot

    rows = [(i, i % 5, "U", i, None) for i in range(20)]
    spark.createDataFrame(rows, "ordinal bigint, k bigint, op string, v bigint, blob binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    root = session_root(spark)

    def run(table, at):
        stream = spark.readStream.schema("ordinal bigint, k bigint, op string, v bigint, blob binary").parquet(str(tmp_path / "in"))
        assert ingest(stream, table, "numbers").option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r["k"], r["v"]) for r in table.state().collect())

    with Session.open(spark, root) as session:
        table = Table(session, INT64, "bigint", SUM)
        want = run(table, "cp")
        snapshot.save_snapshot(table, "s", "l")
    with Session.restore(spark, root) as session:
        # Without the checkpoint the same batch comes again.
        assert run(snapshot.open_table_from_snapshot(session, "s", "l"), "cp2") == want
