import random

import numpy as np
import pyarrow.parquet as pq
from xxhash import xxh64_intdigest

from keelstone.llm import simhash

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(id, text) -> {id: (fingerprint, component)} by comparing all pairs."""

    def fp(text):
        ws = [w.encode() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")] if False else (text or "").encode().lower().split()
        grams = [ws[i : i + 3] for i in range(len(ws) - 2)] or ([ws] if ws else [])
        hs = [xxh64_intdigest(b" ".join(g), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d if d is not None else -1, format(fps[i], "016x"), least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_documents_match_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert got(simhash.op8_simhash(spark, SF)) == brute(rows)


def test_nulls_empty_ties_and_extra_columns(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, " \n\t"), (None, "a b c d"), (4, "x"), (5, "X"), (6, "word " * 5000), (None, "zzz yyy")]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, fp string, root int")
    assert got(simhash.near_duplicates(df)) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "4", "6", "None"])


def test_large_groups_are_split_without_loss(spark):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    values = {centre}
    while len(values) < 300:
        x = centre
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            x ^= 1 << b
        values.add(x)
    values |= {rnd.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash.signed(x),) for x in values], "fp long")

    def classes(pairs):
        up = {simhash.signed(x): simhash.signed(x) for x in values}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[top(a)] = top(b)
        out = {}
        for x in up:
            out.setdefault(top(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    vs = sorted(values)
    want = classes((simhash.signed(a), simhash.signed(b)) for i, a in enumerate(vs) for b in vs[:i] if (a ^ b).bit_count() <= 3)
    for shard in (32, 4096):
        found = [tuple(r) for r in simhash.links(df, shard=shard).collect()]
        assert classes(found) == want
        assert len(found) < 4 * 36 * len(values)


def test_finer_masks_lose_no_near_pair():
    rnd = random.Random(1)
    for m in simhash.masks(1000) + simhash.masks(1 << 25)[:6]:
        assert all(x & m == 0 for x in simhash.finer(m)) and sum(simhash.finer(m)) == (1 << 64) - 1 - m
        for _ in range(50):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample([b for b in range(64) if not m >> b & 1], 3):
                b ^= 1 << bit
            assert any(a & x == b & x for x in simhash.finer(m))


def test_batched_tree_equals_plain_tree():
    rnd = np.random.default_rng(5)
    x = np.unique(np.concatenate([rnd.integers(0, 1 << 63, 40).astype(np.uint64), np.uint64(77) ^ (np.uint64(1) << rnd.integers(0, 64, 50).astype(np.uint64))]))
    big, small = simhash.spanning(x, 3), simhash._spanning_small(x, 3)
    assert len(big) == len(small)
    for a, b in big:
        assert (a ^ b).bit_count() <= 3
