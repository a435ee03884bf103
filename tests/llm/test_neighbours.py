import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from keelstone.llm import neighbours

SF = "/root/testdata/sf0.1"


def brute(ids, x, k=20, every=20):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = x @ q
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_recall_on_all_queries(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)
    want, got = brute(ids, x), {}
    for r in neighbours.op5_neighbours(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        for _, v, s in rows:
            assert math.isclose(s, x[ids == q][0] @ x[ids == v][0], rel_tol=1e-12)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def probed(f, q, want):
    """The likeliest leaves by the sums of all their planes, until their rows are enough."""
    q = np.append(q / np.linalg.norm(q), 0).astype(np.float32)
    far = (1.702 * neighbours.REACH) * (f.normals @ q - f.offsets) / f.spreads
    costs = []
    for t in range(f.trees):
        for leaf in range(f.inner + 1):
            k, cost = leaf + f.inner, 0.0
            while k:
                up = (k - 1) // 2
                cost += np.logaddexp(0, far[t, up]) - (0 if k == 2 * up + 1 else far[t, up])
                k = up
            costs.append((cost, t, leaf))
    out, rows = [], 0
    for _, t, leaf in sorted(costs):
        if rows >= want:
            return sorted(out)
        out.append((t, leaf))
        rows += f.sizes[t, leaf]


def test_leaves_and_a_query_s_work_at_two_sizes():
    """Leaves stay small, and a query looks at as many rows in 12,000 vectors as in 48,000."""
    x = np.random.default_rng(1).standard_normal((48_000, 16))
    longest = np.linalg.norm(x, axis=1).max()
    for n in (12_000, 48_000):
        f = neighbours.Forest(x[:n][:16_000], 6, math.ceil(math.log2(n / 48)), longest)
        leaves = f.leaves(x[:n])
        f.sizes = np.stack([np.bincount(leaves[:, t], minlength=f.inner + 1) for t in range(6)])
        assert f.sizes.max() < 300
        assert probed(f, x[5], 900) == sorted(f.probes(x[5], 900))
        hit, looked = [], []
        for q in range(0, 400, 10):
            found = np.zeros(n, bool)
            probes = f.probes(x[q], 4_000)
            assert len(set(probes)) == len(probes)
            looked.append(sum(int(f.sizes[p]) for p in probes))
            for t, c in probes:
                found |= leaves[:, t] == c
            s = x[:n] @ x[q]
            s[q] = -np.inf
            hit.append(found[np.argsort(-s)[:20]].mean())
        assert 4_000 <= min(looked) <= max(looked) < 4_300
        assert np.mean(hit) > 0.9
    assert len(set(f.probes(x[3], 10**9))) == np.count_nonzero(f.sizes)


def test_recall_on_50_000_vectors(spark):
    """Vectors without any structure, the hardest case, and tight clusters of several lengths."""
    rnd = np.random.default_rng(3)
    for kind in ("even", "clustered"):
        x = rnd.standard_normal((50_000, 64))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "even" else x * 0.3 + rnd.standard_normal((500, 64))[rnd.integers(0, 500, 50_000)] * rnd.uniform(0.5, 1.5, (50_000, 1))).astype(np.float32)
        ids = np.arange(50_000)
        df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))
        got = {}
        for r in neighbours.nearest(df, every=500).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        want = brute(ids, x.astype(np.float64), every=500)
        assert got.keys() == want.keys()
        recall = np.mean([len(got[q] & {v for v, _ in want[q]}) / 20 for q in want])
        print(kind, recall)
        assert recall >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, -0.5 * (i % 3)]) for i in range(0, 90)]
    rows += [(200 + i, [3.0, 1.0, 0.0]) for i in range(60)]  # one vector in very many rows
    rows += [(0, [0.0, 1.0, 0.0]), (500, None), (520, [0.0, 0.0, 0.0]), (540, [1.0, None, 2.0]), (560, [nan, 1.0, 1.0]), (580, [1.0, inf, 1.0]), (None, [1.0, 1.0, 1.0]), (600, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "vec_id long, embedding array<double>, rank int, score string")
    good = {i: v for i, v in rows if i is not None and v is not None and len(v) == 3 and None not in v and all(map(math.isfinite, v)) and any(v)}
    ids, x = np.array(list(good)), np.array(list(good.values()))
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: [(v, s) for _, v, s in sorted(rs)] for q, rs in got.items()} == brute(ids, x)
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = {r["vec_id"] for r in neighbours.nearest(df.where("vec_id in (0, 1, 2)")).collect()}
    assert few == {1, 2}


def test_large_tie_groups_go_to_the_smaller_id(spark):
    rnd = np.random.default_rng(8)
    for x in (rnd.choice([-1.0, 1.0], (3000, 32)), rnd.integers(1, 3, (3000, 32)) * (rnd.random((3000, 32)) < 0.2) * 0.1):
        x[:, 0] = 1.0
        ids = rnd.permutation(3000)
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
        got = {}
        for r in neighbours.nearest(df, every=50, candidates=10**9).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        # Scores in component order, as the operator states them.
        for q, rows in got.items():
            s = np.zeros(len(x))
            for d in range(x.shape[1]):
                s += x[ids == q][0, d] * x[:, d]
            want = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
            assert [v for _, v in sorted(rows)] == want
        assert len(got) == 60
