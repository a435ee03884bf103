"""Quality by hierarchical empirical Bayes: document evidence, hosts and paths."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm.common import as_table, documents, map_batches, utf8

#: Labelled documents that the document classifier is trained on, at most, and
#: the longest that is taken (in characters).
TRAIN_DOCS = 8_000
TRAIN_CHARS = 100_000
BUCKETS = 1 << 18
ROUNDS, RATE, RIDGE = 150, 0.2, 0.1
#: A word bears on the evidence if its log odds differ from zero by so many
#: standard errors, in at least so many training documents.
CLEAR, SEEN = 3.5, 8
#: Weight, in documents, of the global prior in a host's posterior and of the
#: host's posterior in a path's, within these bounds.
WEIGHTS = (5.0, 500.0)
#: A labelled document counts as much as so many classified ones.
LABEL_WEIGHT = 2.0
#: Documents of at least this posterior are kept.
LEAST = 0.6
DENSE = 10


def dense(text: bytes, words: list[bytes]) -> list[float]:
    """Shares of symbols, digits, repeated lines and words, capitals and marks, and the sizes of words and text."""
    n = max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = n - len(text.translate(None, b"#*$%&|<>{}[]@^~=_\\"))
    digits = n - len(text.translate(None, b"0123456789"))
    return [
        1.0,
        min(1.0, 8 * symbols / n),
        min(1.0, 8 * digits / n),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(words)) / max(1, len(words)),
        np.log1p(len(words)) / 8,
        min(4.0, n / max(1, len(words)) / 8),
        min(1.0, 2 * (n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n),
        min(1.0, 16 * text.count(b"!") / n),
        min(1.0, 16 * text.count(b"|") / n),
    ]


def hashed(words: list[bytes]) -> np.ndarray:
    """Buckets of a text's distinct words (letters only, lower case), without repeats."""
    forms = {w.strip(b".,;:!?\"'()#*$%&|<>").lower() for w in words}
    return np.unique(np.fromiter((crc32(w) % BUCKETS for w in forms if w), np.int64))


@dataclass
class Evidence:
    """A logistic model over hashed words and a few dense numbers."""

    words: np.ndarray
    numbers: np.ndarray

    def logit(self, text: bytes | None) -> float:
        ws = (text or b"").split()
        h = hashed(ws)
        return float(self.words[h].sum() + np.dot(dense(text or b"", ws), self.numbers))


def fit(rows: list[tuple[bytes, int]]) -> Evidence:
    """Trained on (text, good) pairs by gradient steps with per-weight rates; without rows of both classes there is no evidence either way."""
    model = Evidence(np.zeros(BUCKETS), np.zeros(DENSE))
    if not rows:
        return model
    buckets, numbers = zip(*((hashed(ws := t.split()), dense(t, ws)) for t, _ in rows))
    x = np.array(numbers)
    y = np.array([g for _, g in rows], float)
    flat, owner = np.concatenate(buckets), np.repeat(np.arange(len(rows)), list(map(len, buckets)))
    share = y.mean()
    if not 0 < share < 1:
        return model
    up = np.bincount(flat, weights=y[owner], minlength=BUCKETS)
    down = np.bincount(flat, minlength=BUCKETS) - up
    odds = np.log((up + 0.5) / (y.sum() + 1)) - np.log((down + 0.5) / (len(y) - y.sum() + 1))
    clear = (up + down >= SEEN) & (np.abs(odds) >= CLEAR * np.sqrt(1 / (up + 0.5) + 1 / (down + 0.5)))
    used = clear[flat]
    flat, owner = flat[used], owner[used]
    # Both classes weigh the same, so that the evidence is a likelihood ratio.
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    seen_w, seen_n = np.full(BUCKETS, 1e-6), np.full(DENSE, 1e-6)
    for _ in range(ROUNDS):
        s = np.bincount(owner, weights=model.words[flat], minlength=len(rows)) + x @ model.numbers
        err = weight * (y - 1 / (1 + np.exp(-np.clip(s, -30, 30)))) / len(rows)
        g = np.bincount(flat, weights=err[owner], minlength=BUCKETS) - RIDGE / len(rows) * model.words
        h = err @ x - RIDGE / len(rows) * model.numbers
        seen_w += g * g
        seen_n += h * h
        model.words += RATE * g / np.sqrt(seen_w)
        model.numbers += RATE * h / np.sqrt(seen_n)
    return model


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> list[tuple[bytes, int]]:
    """At most TRAIN_DOCS labelled (text, good) pairs, chosen by a hash of the id; good: of quality and not toxic."""
    good = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("_good"))
    # At most TRAIN_DOCS ids.
    chosen = F.broadcast(good.orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_DOCS).select(F.col(id_col).alias("id"), F.col("_good").alias("good")))
    texts = docs.where(F.length(text_col).between(1, TRAIN_CHARS)).select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    rows = texts.join(chosen, "id").collect()
    return [(bytes(r["text"]), r["good"]) for r in sorted(rows, key=lambda r: (r["id"], bytes(r["text"])))]


def _weight(groups: DataFrame, rate: Column, prior: Column, n: Column) -> float:
    """A prior's weight from how far the groups' rates lie from it (method of moments)."""
    row = groups.agg(F.sum(n * (rate - prior) * (rate - prior)) / F.sum(n), F.sum(n * prior * (1 - prior)) / F.sum(n), F.sum(F.lit(1.0)) / F.sum(n)).first()
    if None in tuple(row) or row[1] <= 0:
        return WEIGHTS[0]
    spread, noise, inv = row
    share = max(1e-9, spread / noise - inv) / max(1e-9, 1 - inv)
    return min(WEIGHTS[1], max(WEIGHTS[0], 1 / share - 1))


def posteriors(rows: DataFrame, base: float) -> DataFrame:
    """(host, path, path_rate): grouped sums, shrunk from path to host to the global prior.

    rows: (host, path, p, good), good being null without a label. Sums are
    taken per path first, added up before the shuffle; hosts are summed from
    paths, so that a host in a third of all rows is a few rows by then.
    """
    seen = F.when(F.col("good").isNull(), F.lit(1.0)).otherwise(LABEL_WEIGHT)
    paths = rows.groupBy("host", "path").agg(F.sum(seen).alias("n"), F.sum(seen * F.coalesce(F.col("good").cast("double"), F.col("p"))).alias("k"))
    paths = as_table(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    over = _weight(hosts, F.col("hk") / F.col("hn"), F.lit(base), F.col("hn"))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("hk") + base * over) / (F.col("hn") + over)).alias("host_rate"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    inner = _weight(both, F.col("k") / F.col("n"), F.col("host_rate"), F.col("n"))
    return both.select("host", "path", "host_rate", ((F.col("k") + F.col("host_rate") * inner) / (F.col("n") + inner)).alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per document: id, evidence, host_rate, path_rate, posterior, kept.

    evidence is the classifier's logit under even odds. A first posterior takes
    the labels' global odds as its prior; its sums by path and host, shrunk
    towards the level above, give each path its rate; the posterior takes that
    rate's odds as the document's prior. kept: LEAST or more.

    A null text has the evidence of an empty one; a text of any length is read
    as a whole; null hosts and paths are a
    host and a path of their own; null ids and repeated rows are judged like
    others; without labels there is no evidence and every rate is one half; an
    empty table gives an empty result. Other columns are ignored.
    """
    model = fit(labelled(docs, labels, id_col, text_col))
    marks = labels.where(F.col("quality").isNotNull()).agg(F.avg(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double"))).first()[0]
    base = min(0.99, max(0.01, 0.5 if marks is None else marks))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(t: pa.Table) -> pa.Table:
        z = [shared.value.logit(x) for x in t["text"].to_pylist()]
        return pa.table({c: t[c] for c in ("id", "host", "path")} | {"evidence": pa.array(z, pa.float64())})

    narrow = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), utf8(text_col).alias("text"))
    rows = as_table(map_batches(narrow, run, f"id {kinds[id_col]}, host {kinds[host_col]}, path {kinds[path_col]}, evidence double"), "evidence")
    prior = float(np.log(base / (1 - base)))
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    good = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    seen = rows.withColumn("p", p).join(good, F.col("id") == F.col("lid"), "left").select("host", "path", "p", "good")
    rates = posteriors(seen, base).withColumnRenamed("host", "h2").withColumnRenamed("path", "p2")
    out = rows.join(rates, F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")))
    r = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("path_rate")))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(r / (1 - r)))))
    return out.select(F.col("id").alias(id_col), "evidence", "host_rate", "path_rate", posterior.alias("posterior"), (posterior >= LEAST).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
