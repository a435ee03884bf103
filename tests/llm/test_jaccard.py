import random

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from keelstone.llm import jaccard, simhash

SF = "/root/testdata/sf0.01"


def brute(rows, similarity=0.8):
    """(id, text) -> the ids of the kept rows, from all pairs; positions for null ids."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and (n := len(a & b)) >= similarity * (len(a) + len(b) - n) - 1e-9:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        least[top(i)] = min(least.get(top(i), key), key)
    return sorted((None if none else d for none, d in least.values()), key=str)


def test_stage_keeps_what_all_pairs_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == brute(rows)


def test_links_equal_all_pairs():
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(60)]
    sets = [np.unique(np.array([x if rnd.random() < 0.93 else rnd.getrandbits(64) for x in base], np.uint64)) for _ in range(50)] + [np.array([i], np.uint64) for i in (1, 1, 2)]

    def classes(pairs):
        up = list(range(len(sets)))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [x if u == y else u for u in up]
        return up

    want = classes((i, j) for i in range(len(sets)) for j in range(i) if jaccard.similar(sets[i], sets[j], 0.8))
    got = classes(links := jaccard.similar_links(sets, 0.8))
    assert {tuple(u == v for v in want) for u in want} == {tuple(u == v for v in got) for u in got} and len(links) == len(sets) - len(set(want))


def test_large_shards_are_dealt_out(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 10)
    rows = {"token": np.full(200, 5), "k": np.arange(200) * 7919, "fp": np.full(200, 77), "n": np.full(200, 10), "left": np.full(200, 10)}
    pairs = simhash.shard_links(rows, np.zeros(0, np.int64), 0.8, 3)
    assert 200 - 30 < pairs.num_rows < 200


@pytest.mark.parametrize("group", [2048, 7])
def test_chains_common_passages_and_edges(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    monkeypatch.setattr(jaccard, "GROUP", group)
    assert simhash.shard_links({"token": np.full(9, 5), "k": np.arange(9), "fp": np.full(9, 77), "n": np.full(9, 10), "left": np.full(9, 10)}, np.array([4]), 0.8, 3).num_rows == 7
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line = [word() for _ in range(30)]
    rows, text = [], [word() for _ in range(60)]
    for i in range(40):  # each a near copy of the one before, not of all
        rows.append((100 + i, " ".join(text)))
        text = text[2:] + [word(), word()]
    rows += [(200 + i, " ".join(line + [word() for _ in range(rnd.choice([4, 6, 8, 40]))])) for i in range(60)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "w " * 500), (8, "W " * 20)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, k int")
    assert sorted((r["doc_id"] for r in simhash.keep_one(df).collect()), key=str) == brute(rows)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_null_and_repeated_ids_are_judged_by_their_texts(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey"
    rows = [(1, a), (5, a), (5, b), (None, a), (None, b.upper()), (None, c), (None, c), (7, "x y z"), (7, "p q r"), (8, "p q r")]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, best_id int, _nulls string")
    out = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()), key=str)
    assert out == sorted([(1, a), (5, b), (7, "x y z"), (7, "p q r"), (None, c)], key=str)
    assert simhash.keep_one(df).columns == df.columns and {r["_nulls"] for r in simhash.keep_one(df).collect()} == {"x"}


def test_no_pair_of_a_crowded_shard_is_lost():
    """More than four times SHARD texts under a shingle, of which each has one partner."""
    m = 4 * simhash.SHARD + 2
    fp = np.repeat(np.random.default_rng(3).integers(0, 2**63, m // 2), 2)
    rows = {"token": np.full(m, 5), "k": np.random.default_rng(4).permutation(m) * 7919, "fp": fp, "n": np.full(m, 10), "left": np.full(m, 10)}
    pairs = simhash.shard_links(rows, np.zeros(0, np.int64), 0.8, 0)
    assert {frozenset(x) for x in zip(*(c.to_pylist() for c in pairs.columns))} == {frozenset(x) for x in rows["k"].reshape(-1, 2).tolist()}


def test_parts_of_a_crowded_shingle_meet_pairwise(spark, monkeypatch):
    """Texts with one shingle only, which is common: all are similar, whatever parts they are dealt to."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "SHARD", 2)
    monkeypatch.setattr(simhash, "CROWD", 2, raising=False)
    cased = ["".join(c.upper() if i >> b & 1 else c for b, c in enumerate("abcde")) for i in range(32)]
    rows = [(i, " ".join(x)) for i, x in enumerate(cased)] + [(100 + i, f"other words {i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = simhash.candidates(jaccard.keyed_texts(df), 5, 0.8).collect()
    up = {x: x for r in links for x in r}
    for r in links:
        a, b = up[r["a"]], up[r["b"]]
        up = {x: a if y == b else y for x, y in up.items()}
    assert len(up) == 32 and len(set(up.values())) == 1
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [0, 100, 101, 102]
