from collections import Counter

import pyarrow as pa

import corpus_pipeline
from keelstone.llm import language, mixing, packing, secrets
from tests.llm.test_jaccard import brute as kept_by_all_pairs

SF = "/root/testdata/sf0.001"


def test_every_stage_against_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows, was = out.collect(), before.collect()
        if name != "packing":
            assert out.columns == names
        if name == "language":
            verdict = {r["doc_id"]: r for r in language.identify(before).collect()}
            sure = {d for d, r in verdict.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
            assert sure <= {r["doc_id"] for r in rows} <= {d for d, r in verdict.items() if r["lang_pred"] != "und"}
            assert len(rows) >= 0.95 * len(was)
        if name == "near_duplicates":
            assert sorted((r["doc_id"] for r in rows), key=str) == kept_by_all_pairs([(r["doc_id"], r["text"]) for r in was])
            assert set(rows) <= set(was)
        if name == "secrets":
            assert len(rows) == len(was)
            assert not secrets.scan(out).where("is_secret").count()
            changed = {r["doc_id"] for r in set(rows) - set(was)}
            assert changed == {r["id"] for r in secrets.scan(before).where("is_secret").collect()}
        if name == "mixing":
            taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["size"]}
            assert Counter(r["doc_id"] for r in rows) == Counter({d: n for d, n in taken.items() if n})
            assert set(rows) <= set(was)
        if name == "packing":
            want = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pieces(before, packing.public_tokenizers.path(packing.VOCABULARY)).withColumnRenamed("id", "doc_id").collect())
            assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == want
        before = out


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names, and an empty table."""
    clear = "the and with that from which this have " * 6
    rows = [(i, f"{clear} number {i} of " + f"w{i} " * 20, "en", f"s{i % 3}", 9) for i in range(30)]
    rows += [(1, None, None, None, None), (None, clear, "en", None, 3), (None, clear, "en", None, 3), (40, "", "en", "s1", 0), (41, "long " * 60_000, None, "s2", 1), (41, "long " * 60_000, None, "s2", 1), (42, " \n\x0b", "en", "s0", 2)]
    extra = [(r, "x", 7, 1.5) for r in range(len(rows))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k long, root string, key int, times double"
    docs = spark.createDataFrame([(*r, *e) for r, e in zip(rows, extra)], schema)
    for table in (docs, docs.limit(0)):
        before = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, before, SF)
            out.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
            if k < 4:
                assert out.columns == docs.columns
            assert bool(out.count()) == (table is docs)
            before = out


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]


def test_stages_with_python_hand_over_few_bytes_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, f"the and with that {i}", "en", "s", 9) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    large = spark.range(0, 400, 1, 1).selectExpr("repeat('some text ', 10000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    try:
        for stage in (corpus_pipeline.tell_language, corpus_pipeline.drop_near_duplicates, corpus_pipeline.pack_sequences):
            spark.conf.unset(key)
            stage(spark, docs, SF)
            assert 36e6 < sum(found := [r["bytes"] for r in large.mapInArrow(sizes, "bytes long").collect()]) < 44e6
            assert max(found) < 1.2 * (8 << 20)
        spark.conf.set(key, "1m")
        corpus_pipeline.pack_sequences(spark, docs, SF)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
