import numpy as np
import pyarrow.parquet as pq
import pytest

from keelstone.llm import quality

SF = "/root/testdata/sf0.1"


def test_toxic_and_poor_documents_go_and_clean_ones_stay(spark):
    """Three quarters of the labels train, the others are held out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels.where("doc_id % 4 > 0")).collect()}
    assert len(got) == 10_000
    kept = {0: [], 1: []}
    toxic = []
    for r in pq.read_table(f"{SF}/labels.parquet").to_pylist():
        if r["doc_id"] % 4 == 0:
            good = int(r["quality"] == 1 and r["toxic"] == 0)
            kept[good].append(got[r["doc_id"]]["kept"])
            if r["toxic"]:
                toxic.append(got[r["doc_id"]]["kept"])
    print("kept good", np.mean(kept[1]), "kept bad", np.mean(kept[0]), "kept toxic", np.mean(toxic))
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.2 and np.mean(toxic) < 0.25


def test_rates_equal_plain_sums(spark):
    rows = [("a", "x", 0.9, 1), ("a", "x", 0.8, None), ("a", "y", 0.1, 0), (None, "x", 0.5, None), ("b", None, 0.2, None), ("b", "z", 0.3, 0)]
    df = spark.createDataFrame(rows, "host string, path string, p double, good int")
    got = {(r["host"], r["path"]): (r["host_rate"], r["path_rate"]) for r in quality.posteriors(df, 0.6).collect()}
    sums = {}
    for h, p, q, g in rows:
        n, k = sums.get((h, p), (0, 0))
        w = 1 if g is None else 2
        sums[h, p] = (n + w, k + w * (q if g is None else g))
    hosts = {}
    for (h, _), (n, k) in sums.items():
        a, b = hosts.get(h, (0, 0))
        hosts[h] = (a + n, b + k)

    def weight(groups):
        total = sum(n for n, _, _ in groups)
        spread = sum(n * (r - p) ** 2 for n, r, p in groups) / total
        noise = sum(n * p * (1 - p) for n, _, p in groups) / total
        inv = len(groups) / total
        share = max(1e-9, spread / noise - inv) / max(1e-9, 1 - inv)
        return min(500.0, max(5.0, 1 / share - 1))

    w = weight([(n, k / n, 0.6) for n, k in hosts.values()])
    host = {h: (k + 0.6 * w) / (n + w) for h, (n, k) in hosts.items()}
    v = weight([(n, k / n, host[h]) for (h, _), (n, k) in sums.items()])
    for (h, p), (n, k) in sums.items():
        assert got[h, p] == pytest.approx((host[h], (k + host[h] * v) / (n + v)))


def test_the_query_against_one_by_one(spark):
    """Training as the operator does it; evidence, rates, posteriors and verdicts of every document by plain sums."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(quality.labelled(docs, labels, "doc_id", "text"))
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    good = {r["doc_id"]: int(r["quality"] == 1 and not r["toxic"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    base = min(0.99, max(0.01, np.mean(list(good.values()))))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    odds = lambda p: np.log(p / (1 - p))
    z = {r["doc_id"]: model.logit((r["text"] or "").encode()) for r in rows}
    paths, hosts = {}, {}
    for r in rows:
        n, k = paths.get((r["source"], r["lang"]), (0, 0))
        g = good.get(r["doc_id"])
        paths[r["source"], r["lang"]] = (n + (1 if g is None else 2), k + (sigmoid(z[r["doc_id"]] + odds(base)) if g is None else 2 * g))
    for (h, _), (n, k) in paths.items():
        hosts[h] = tuple(np.add(hosts.get(h, (0, 0)), (n, k)))

    def weight(groups):
        total = sum(n for n, _, _ in groups)
        spread, noise = sum(n * (r - p) ** 2 for n, r, p in groups) / total, sum(n * p * (1 - p) for n, _, p in groups) / total
        share = max(1e-9, spread / noise - len(groups) / total) / max(1e-9, 1 - len(groups) / total)
        return min(500.0, max(5.0, 1 / share - 1))

    w = weight([(n, k / n, base) for n, k in hosts.values()])
    host = {h: (k + base * w) / (n + w) for h, (n, k) in hosts.items()}
    v = weight([(n, k / n, host[h]) for (h, _), (n, k) in paths.items()])
    rate = {p: (k + host[p[0]] * v) / (n + v) for p, (n, k) in paths.items()}
    got = {r["doc_id"]: r for r in quality.op6_quality(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, own = got[r["doc_id"]], rate[r["source"], r["lang"]]
        want = sigmoid(z[r["doc_id"]] + odds(min(0.999, max(0.001, own))))
        assert (g["evidence"], g["host_rate"], g["path_rate"], g["posterior"]) == pytest.approx((z[r["doc_id"]], host[r["source"]], own, want))
        assert g["kept"] == (g["posterior"] >= quality.LEAST)


def test_sparse_paths_are_shrunk_to_their_host(spark):
    good, bad = " ".join(f"fine{i % 9} prose words" for i in range(30)), "### spam $$$ " * 40
    rows = [(i, good if i % 2 else bad, "clean" if i % 2 else "dirty", "p") for i in range(200)] + [(500, "neutral words here", "clean", "new"), (501, "neutral words here", "dirty", "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert got[500]["path_rate"] > 0.8 > 0.3 > got[501]["path_rate"]
    assert got[500]["evidence"] == got[501]["evidence"] and got[500]["posterior"] > got[501]["posterior"]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (None, "", "a", "x"), (2, "word " * 40_000, "a", "x"), (2, "word " * 40_000, "a", "x"), (3, "\x0b", "b", None)]
    df = spark.createDataFrame([(*r, 0, "k", 1.0) for r in rows], "doc_id long, text string, source string, lang string, kept int, host string, p double")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (2, 1, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 5 and all(0 <= r["posterior"] <= 1 and r["kept"] is not None for r in got)
    assert all(r["path_rate"] == pytest.approx(0.5) and r["evidence"] == 0 for r in quality.classify(df, labels.limit(0)).collect())
    assert quality.classify(df.limit(0), labels).count() == 0
