"""Exact Jaccard similarity of word shingles: what SimHash candidates are held against."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keelstone.llm.common import as_table, give_back, utf8

SHINGLE = 5
SIMILARITY = 0.8
#: Texts that a task remembers having passed on.
SEEN = 200_000
#: Rows of ids that are broadcast to the texts, at most; more meet them in a shuffle.
BROADCAST = 2_000_000
#: Texts, and their bytes, of a candidate group that one task compares; larger groups are dealt out in parts that meet pairwise.
GROUP, GROUP_BYTES = 2_048, 16 << 20


def hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 values of a text's word shingles, repeats included.

    A-Z are lower-cased. Fewer words than a shingle, none included: the whole
    sequence is the one shingle.
    """
    words = (text or b"").lower().split()
    grams = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    return np.fromiter((xxh64_intdigest(b" ".join(g)) for g in grams), np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Their set, sorted."""
    return np.unique(hashes(text, size))


def least_shared(n: int, similarity: float) -> int:
    """Shingles that a set of n has in common with every set as similar, at least."""
    return max(1, math.ceil(similarity * n - 1e-9))


def prefix(values: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first values in an order of all shingles (those of sorted ``common`` last).

    Two sets of the similarity share a value of their prefixes, whichever
    shingles are called common.
    """
    at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
    last = common[at] == values if len(common) else np.zeros(len(values), bool)
    return np.concatenate([values[~last], values[last]])[: len(values) - least_shared(len(values), similarity) + 1]


def possible(n: np.ndarray, left: np.ndarray, m: np.ndarray, rest: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m values can be similar if the first one they share has left and rest values from it on.

    A similar pair meets under the first value it shares, which is in both
    prefixes; nothing before it counts.
    """
    need = similarity / (1 + similarity) * (n + m) - 1e-6
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (np.minimum(left, rest) >= need)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < least_shared(max(len(a), len(b)), similarity):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets that similar pairs join, at most one fewer than there are sets."""
    sizes = np.array(list(map(len, sets)))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label, out = np.arange(len(sets)), []
    for i, s in enumerate(sets[:-1]):
        a, b = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
        met = np.concatenate([owner[x:y] for x, y in zip(a.tolist(), b.tolist())])
        both = np.bincount(met, minlength=len(sets))[i + 1 :]
        near = i + 1 + np.flatnonzero(both >= similarity * (sizes[i] + sizes[i + 1 :] - both) - 1e-9)
        for x in np.unique(label[near]):
            if x != label[i]:
                out.append((i, int(near[label[near] == x][0])))
                label[label == x] = label[i]
    return out


def small(table: DataFrame) -> DataFrame:
    """The written table as a broadcast if its few columns of ids have no more than BROADCAST rows; as it is beyond that."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def text_key(text: Column) -> Column:
    """64 bits of a text's digest; null is a text of its own."""
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("string")), 1, 16), 16, -10).cast("long"), F.lit(0))


def keyed_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(text_key(F.col(text_col)).alias("k"), utf8(text_col).alias("text"))


class Seen:
    """Which texts a task meets for the first time (of the last SEEN texts, that is)."""

    def __init__(self) -> None:
        self.keys: set[int] = set()

    def new(self, t: pa.Table | pa.RecordBatch) -> pa.Table | pa.RecordBatch:
        first = []
        for k in t.column("k").to_pylist():
            first.append(k not in self.keys)
            self.keys.add(k)
        if len(self.keys) > SEEN:
            self.keys.clear()
        return t.filter(pa.array(first, pa.bool_()))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """texts(k, text), each at least once, but no copies from within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        yield from map(seen.new, batches)

    return texts.mapInArrow(run, "k long, text binary")


def checked(texts: DataFrame, members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) among the texts of each candidate group that join all those that similar pairs join.

    members: (k, root). All texts of a group meet in one task, once each, and
    all its pairs are compared. A group beyond GROUP or GROUP_BYTES is dealt out
    in parts, each of which meets each other one in a task of its own.
    """
    lengths = texts.groupBy("k").agg(F.max(F.octet_length("text")).alias("size"))
    sizes = members.join(lengths, "k").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = sizes.select("root", F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP), F.ceil(F.col("size") / GROUP_BYTES)).cast("int").alias("s"))
    own = F.pmod(F.xxhash64("k"), F.col("s")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.least(own, j) * F.col("s") + F.greatest(own, j))
    dealt = as_table(members.join(parts, "root").select("root", F.explode(pairs).alias("pair"), "k"), "dealt")
    rows = distinct_texts(texts).join(small(dealt), "k").select("root", "pair", "k", "text")
    ordered = rows.repartition("root", "pair").sortWithinPartitions("root", "pair", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, sets = None, [], []

        def met() -> pa.RecordBatch:
            found = similar_links(sets, similarity) if len(sets) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in x], pa.int64()) for x in (a, b)], ["a", "b"])

        for batch in batches:
            for root, pair, k, x in zip(*(batch.column(c).to_pylist() for c in ("root", "pair", "k", "text"))):
                if (root, pair) != last:
                    if len(sets) > 1:
                        yield met()
                    last, keys, sets = (root, pair), [], []
                if not keys or keys[-1] != k:
                    keys.append(k)
                    sets.append(shingles(x, shingle))
        if len(sets) > 1:
            yield met()
        sets.clear()
        give_back()

    return ordered.mapInArrow(run, "a long, b long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(k, ...) with their component's root; a text without one is its own."""
    return rows.join(roots, rows.k == roots.node, "left").select(*rows.columns, F.coalesce("root", "k").alias("root"))


def least_rows(docs: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of docs, the first row by (id, nulls last, text key) of each component in roots(node: text key, root); a text without a root is its own.

    What goes is found from ids and keys, and only that is joined back, so that
    texts needn't move where it is little. Rows equal in id and text: any one.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values()).withColumn("k", text_key(F.col(names[text_col])))
    narrow = as_table(rows.groupBy("k", F.col(names[id_col]).alias("id")).agg(F.count("*").alias("times")), "ids")
    least = _rooted(narrow.select("k", F.struct(F.col("id").isNull().alias("none"), "id", "k").alias("of")), roots)
    best = least.groupBy("root").agg(F.min("of").alias("best"))
    gone = least.join(best, "root").where(F.col("of") != F.col("best")).select(F.col("k").alias("gk"), F.col("of.id").alias("gid"))
    match = (F.col("k") == F.col("gk")) & F.col(names[id_col]).eqNullSafe(F.col("gid"))
    kept = rows.join(small(as_table(gone, "gone")), match, "left_anti")
    again = as_table(narrow.where("times > 1").select(F.col("k").alias("gk"), F.col("id").alias("gid")), "again")
    if not again.isEmpty():
        again = small(again)
        kept = kept.join(again, match, "left_anti").unionByName(kept.join(again, match, "left_semi").dropDuplicates(["k"]))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
