import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from keelstone.llm import substrings

SF = "/root/testdata/sf0.001"


def brute(rows, window=35):
    at = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in at for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, at):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_documents_match_plain_counting(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    want = brute(rows)
    assert got(substrings.op2_substrings(spark, SF)) == want
    assert sum(r[2] > 0 for r in want) > 10


PASSAGE = " ".join(f"p{i}" for i in range(60))
ODD = [
    (1, " ".join(f"a{i}" for i in range(40))), (1, " ".join(f"a{i}" for i in range(40))), (2, None), (3, " \n"), (None, "x " * 100),
    (4, " ".join(f"b{i % 50}" for i in range(170))), (5, "one two"), (6, " ".join(f"c{i}" for i in range(20_000))), (7, " ".join(f"c{i}" for i in range(500, 560)) + "\x0b\x0cend"),
    (8, " ".join(f"d{i}" for i in range(35))), (9, "lead " + " ".join(f"d{i}" for i in range(34))), (10, "\xa0" + " ".join(f"d{i}" for i in range(35))),
] + [(100 + i, f"l{i} m{i} " + PASSAGE + f" r{i} s{i}") for i in range(40)]


@pytest.mark.parametrize("common_least, held", [(5, 8192), (10**9, 8192), (5, 3), (10**9, 3)])
def test_odd_rows(spark, monkeypatch, common_least, held):
    monkeypatch.setattr(substrings, "HELD_ROWS", held)
    df = spark.createDataFrame([(*r, 0, "k") for r in ODD], "doc_id long, text string, start long, uid string")
    out = substrings.remove_repeats(df, with_text=True, share=1.0, common_least=common_least)
    assert got(out) == brute(ODD)
    assert {r["text"] for r in out.where("doc_id = 1 or doc_id = 103").collect()} == {"", "l3 m3 r3 s3"}
    assert got(substrings.remove_repeats(df.limit(0))) == []


@pytest.mark.parametrize("held", [8192, 40])
def test_a_passage_in_a_third_and_many_copies(spark, monkeypatch, held):
    """Copies, near copies and one passage, through all the ways that windows are counted."""
    monkeypatch.setattr(substrings, "HELD_ROWS", held)
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rnd.randrange(400)) for _ in range(n))
    copied, near = text(90), text(120).split()
    rows = [(i, copied) for i in range(300)]
    rows += [(1000 + i, " ".join(near[: i % 60 + 1] + [f"n{i}"] + near[i % 60 + 1 :])) for i in range(300)]
    rows += [(2000 + i, text(rnd.randrange(20)) + " " + PASSAGE + " " + text(rnd.randrange(60))) for i in range(300)]
    rows += [(3000 + i, text(50)) for i in range(30)] + [(None, None)] * 40
    rnd.shuffle(rows)
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), share=1.0, common_least=30)
    assert got(out) == brute(rows)


def test_windows_of_equal_words_share_a_minimiser():
    import numpy as np

    words = [f"w{i % 90}".encode() for i in range(400)]
    _, v = substrings.minimisers(words, np.array([], np.uint64))
    assert all(v[i] == v[i + 90] for i in range(len(v) - 90))
    cover = [(a, n) for a, n, _, p in substrings.super_k_mers(b" ".join(words), np.array([], np.uint64)) if p.count(b" ") == n + 33]
    assert [a for a, _ in cover] == [0, *np.cumsum([n for _, n in cover])[:-1]] and sum(n for _, n in cover) == 366
