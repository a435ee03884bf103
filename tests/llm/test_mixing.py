from collections import Counter

import pandas as pd
import pytest

from keelstone.llm import mixing
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, None, "y"), (3, "", "y"), (4, "w " * 900, "z"), (None, "one two 3 #4", None),
    (5, "one two 3 #4", None), (6, "p q r\x0bs\x0ct", "b"), (7, "été café x", "x"),
]


def test_documents_match_sql(spark):
    assert same(mixing.op4_mix(spark, SF), mixing.ORACLE, SF) == 200


@pytest.mark.parametrize("bands, finer", [(64, 4096), (1, 2)])
def test_odd_rows_match_sql(spark, monkeypatch, bands, finer):
    monkeypatch.setattr(mixing, "BANDS", bands)
    monkeypatch.setattr(mixing, "FINER", finer)
    df = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id long, text string, source string, size int, key string")
    pdf = pd.DataFrame(ROWS, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    assert same(mixing.mix(df), mixing.ORACLE, documents=pdf) == len(ROWS)
    assert mixing.mix(df.limit(0)).count() == 0


def test_many_rows_at_the_cutoff_match_sql(spark):
    """A third of a source are rows of null id and one size, which share a key, and many more repeat in full."""
    rows = [(None, f"w{i} two three", "x") for i in range(300)] + [(7, "one two", "x")] * 200 + [(i, "a b c d " * (i % 5), "xyz"[i % 3]) for i in range(100, 400)]
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert same(mixing.mix(df), mixing.ORACLE, documents=pdf) == len(rows)
    sizes = Counter()
    for r in mixing.repeated(df).collect():
        sizes[r["source"]] += len(r["text"].split())
    total = sum(sizes.values())
    assert abs(total - sum(len(t.split()) for _, t, _ in rows)) <= 3 * 20


def fill(sizes, cap=3):
    """Targets by giving out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in stopped else level * weight[s] for s in names}
        stopped |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 2, None: 5}, {"a": 0, "b": 7}, {"a": 5}, {"a": 900, "b": 10, "c": 500, "d": 3, "e": 1, "f": 77}])
def test_targets_equal_repeated_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(fill(sizes))


def test_taken_words_come_near_the_targets(spark):
    rows = mixing.op4_mix(spark, SF).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (_, target), own in by.items():
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)


def test_repeated_rows_are_the_taken_ones(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id long, text string, source string, size int, n string")
    out = mixing.repeated(df)
    assert out.columns == df.columns
    words = lambda t: len((t or "").encode().split())
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += words(r["text"])
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["taken"]
    assert +got == +want and sum(want.values()) > 0
    assert mixing.repeated(df.limit(0)).count() == 0
