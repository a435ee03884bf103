"""Approximate nearest neighbours from a forest of random-projection trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstone.llm.common import as_table

TREES = 8
#: Vectors that the trees' planes are fitted on, at most; every vector is indexed.
FIT_ROWS = 32_768
#: Vectors of a leaf that the depth aims at, and the deepest tree (which bounds the broadcast forest).
LEAF = 64
MAX_DEPTH = 15
#: A query's queue gives out leaves until they hold so many rows, whatever the table's size.
CANDIDATES = 20_480
#: Leaves that travel as one group, in powers of two: their numbers fit a 64-bit mask.
GROUP_BITS = 6
#: Spread of a near neighbour around the query, in a node's own spreads: what the queue goes by.
REACH = 0.5
NEAREST = 20
EVERY = 20
#: Rows of a group that one task holds; larger groups are dealt out in parts.
BLOCK = 8_192
#: Found pairs that a task holds before it cuts them down.
HELD = 500_000
#: Candidates kept beyond k + 1, for queries whose id has several vectors.
SLACK = 3
#: Pairs that are scored exactly at a time.
PAIRS = 500_000


class Forest:
    """Trees of planes over ``dim`` components: ``normals`` (trees, nodes, dim), ``offsets`` and ``spreads`` (trees, nodes), nodes in heap order.

    Vectors are divided by ``longest`` and get a component that makes all
    lengths 1; queries have length 1 and a zero there: the largest inner
    products are then the nearest vectors.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, longest: float, seed: int = 5) -> None:
        self.depth, self.trees, self.inner, self.longest = depth, trees, (1 << depth) - 1, longest
        rng = np.random.default_rng(seed)
        x = self.lengthened(sample)
        self.normals = np.zeros((trees, self.inner, x.shape[1]), np.float32)
        self.offsets = np.zeros((trees, self.inner), np.float32)
        self.spreads = np.ones((trees, self.inner), np.float32)
        self.sizes = np.ones((trees, self.inner + 1), np.int64)
        for t in range(trees):
            rows = {0: np.arange(len(x))}
            for k in range(self.inner):
                own = rows.pop(k)
                v, self.offsets[t, k], self.spreads[t, k] = self._plane(x[own], rng)
                self.normals[t, k] = v
                right = x[own] @ v > self.offsets[t, k]
                rows[2 * k + 1], rows[2 * k + 2] = own[~right], own[right]

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest]).astype(np.float32)

    @staticmethod
    def _plane(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, float]:
        """The direction between two centres of some of the rows, split at the median; and the rows' spread along it."""
        dim = x.shape[1]
        v = rng.standard_normal(dim)
        if len(x) > 1:
            some = x[rng.choice(len(x), min(len(x), 64), replace=False)]
            a, b = some[0], some[1]
            for _ in range(2):
                side = (some - (a + b) / 2) @ (a - b) > 0
                if side.all() or not side.any():
                    break
                a, b = some[side].mean(axis=0), some[~side].mean(axis=0)
            v = a - b if (a != b).any() else v
        v = (v / np.linalg.norm(v)).astype(np.float32)
        if not len(x):
            return v, 0.0, 1.0
        along = x @ v
        return v, float(np.median(along)), float(along.std()) or 1.0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of every vector in every tree."""
        x = self.lengthened(x)
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.offsets[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - self.inner
        return out

    def probes(self, q: np.ndarray, want: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that one queue over all trees gives out first, until their rows are ``want`` or more.

        A branch's place in the queue is how unlikely it is that a near
        neighbour lies there: the sum over the planes on the way to it, each by
        the query's distance from the plane in the node's spreads.
        """
        q = q / np.abs(q).max()
        q = np.append(q / np.linalg.norm(q), 0).astype(np.float32)
        far = (1.702 * REACH) * (self.normals @ q - self.offsets) / self.spreads
        left = np.logaddexp(0, far)
        to_left, to_right = left.tolist(), (left - far).tolist()
        queue = [(0.0, t, 0) for t in range(self.trees)]
        inner, pop, push, out, rows = self.inner, heapq.heappop, heapq.heappush, [], 0
        while queue and rows < want:
            cost, t, k = pop(queue)
            # Down the likelier side at once: it is the next in the queue as far as its cost stays below the queue's first.
            while k < inner:
                a, b = cost + to_left[t][k], cost + to_right[t][k]
                k = 2 * k + 1
                if b < a:
                    push(queue, (a, t, k))
                    cost, k = b, k + 1
                else:
                    push(queue, (b, t, k + 1))
                    cost = a
                if queue[0][0] < cost:
                    push(queue, (cost, t, k))
                    break
            else:
                if n := int(self.sizes[t, k - inner]):
                    out.append((t, k - inner))
                    rows += n
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part: an id, and a vector without null or non-finite components that isn't zero.

    Of vectors of several lengths only those of the commonest take part (the
    longest of equals).
    """
    v = F.col("v")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(ok)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best_of(query: np.ndarray, vid: np.ndarray, least: np.ndarray, score: np.ndarray, keep: int, slip: float) -> tuple[np.ndarray, ...]:
    """Each query's candidates, each once, that can be among its ``keep`` highest: scores are right within ``slip``."""
    order = np.lexsort((-score, vid, query))
    query, vid, least, score = query[order], vid[order], least[order], score[order]
    once = np.append(True, (query[1:] != query[:-1]) | (vid[1:] != vid[:-1])) if len(query) else np.zeros(0, bool)
    query, vid, least, score = query[once], vid[once], least[once], score[once]
    order = np.lexsort((-score, query))
    query, vid, least, score = query[order], vid[order], least[order], score[order]
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    many = np.diff(np.append(starts, len(query)))
    edge = np.where(many >= keep, score[np.minimum(starts + keep, starts + many) - 1], -np.inf)
    top = score >= np.repeat(edge, many) - 2 * slip
    return query[top], vid[top], least[top], score[top]


def slip_of(dim: int, a: float, b: float) -> float:
    """How far the sum of ``dim`` products of vectors of lengths a and b can be off, in whichever order it is taken."""
    return 4 * (dim + 1) * np.finfo(float).eps * a * b


def highest(s: np.ndarray, q: np.ndarray, c: np.ndarray, least: np.ndarray, keep: int, slip: float, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every score in s that can be among its row's ``keep`` highest, by (score, least id).

    s holds the products of q and c within ``slip``; -inf: not looked at.
    ``edge`` holds scores that ``keep`` others are known to reach, and is
    raised here. Where more than a few are that close, their scores are summed
    in component order, as ``_expand`` does, and the cut is exact.
    """
    near = (s >= (edge - 2 * slip)[:, None]) & (s > -np.inf)
    if (many := np.flatnonzero(np.count_nonzero(near, axis=1) >= 2 * keep)).size:
        edge[many] = np.maximum(edge[many], np.partition(s[many], s.shape[1] - keep, axis=1)[:, s.shape[1] - keep])
        near[many] &= s[many] >= (edge[many] - 2 * slip)[:, None]
    i, j = np.nonzero(near)
    if len(i) <= (2 * keep + 4) * len(s):
        return i, j
    out = []
    for at in range(0, len(i), PAIRS):
        # Whole rows only, so that a row's cut sees all its pairs.
        lo, hi = (np.searchsorted(i, i[min(x, len(i) - 1)]) if x < len(i) else len(i) for x in (at, at + PAIRS))
        a, b = i[lo:hi], j[lo:hi]
        score = np.zeros(len(a))
        for d in range(q.shape[1]):
            score += q[a, d] * c[b, d]
        order = np.lexsort((least[b], -score, a))
        a, b = a[order], b[order]
        first = np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1]) if len(a) else [], np.arange(len(a)), 0))
        top = np.arange(len(a)) - first < keep
        out.append((a[top], b[top]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = NEAREST,
    every: int = EVERY,
    trees: int = TREES,
    candidates: int = CANDIDATES,
    fit_rows: int = FIT_ROWS,
    leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own. The forest's planes are fitted on at most
    ``fit_rows`` rows (so the broadcast forest has a bound) and every row is
    filed in every tree. A query takes leaves, likeliest first over all trees,
    until they hold ``candidates`` rows: its work doesn't grow with the table.
    These rows are ranked by the exact inner product of the original vectors in
    double precision; ties go to the smaller id.

    Equal vectors are one candidate that stands for its k + 1 least ids, and
    one query that stands for all its ids: no id beyond those can be among the
    k nearest, and a vector in a third of all rows makes no large leaf.

    Rows with a null id, or a vector that is null, zero or has null or
    non-finite components, take no part. Rows that repeat an id and vector are
    one row; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    number = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    # Vectors are sorted by their hash before they are compared component by component.
    rows = as_table(usable(vectors, id_col, vec_col).select(F.col("id").cast("long"), "v").withColumn("h", F.xxhash64("v")).distinct(), "vectors")
    by = Window.partitionBy("h", "v").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    # A vector's number is its least id and, for an id with several vectors, the vector's hash.
    kept = first.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    peak = F.array_max(F.transform("v", F.abs)).alias("peak")
    kept = as_table(kept.select("h", "v", "ids", F.xxhash64(F.col("ids")[0], "v").alias("vid"), peak), "candidates")
    # Lengths by way of the largest component, so that no square overflows.
    length = F.col("peak") * F.sqrt(F.aggregate(F.transform("v", lambda x: x / F.col("peak")), F.lit(0.0), lambda acc, x: acc + x * x))
    total, longest, dim = kept.agg(F.count("*"), F.max(length), F.max(F.size("v"))).first()
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not total:
        return spark.createDataFrame([], schema)
    depth = max(1, min(MAX_DEPTH, math.ceil(math.log2(max(1, total / leaf)))))
    low = min(depth, GROUP_BITS)
    part = kept.select("v") if total <= fit_rows else kept.select("v").orderBy(F.xxhash64("v")).limit(fit_rows)
    fitted = matrix(part.toArrow()["v"])
    forest = Forest(fitted[np.lexsort(fitted.T)], trees, depth, longest)
    numbered = kept.select("h", "vid", F.col("ids")[0].alias("least"), "v")
    forest.sizes = leaf_sizes(numbered, forest)
    parts = -(-forest.sizes.reshape(trees, -1, 1 << low).sum(axis=2) // BLOCK)
    shared, keep, slip = spark.sparkContext.broadcast(forest), k + 1 + SLACK, slip_of(dim, longest, longest)
    most = 1 << 20  # parts that a group can have

    def cells(tree: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        return tree * (1 << depth - low) + (leaves >> low)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            x, vid = matrix(t["v"]), t["vid"].to_numpy()
            leaves = shared.value.leaves(x).ravel()
            at, cell = np.repeat(np.arange(len(x)), trees), cells(np.tile(np.arange(trees), len(x)), leaves)
            own = (vid[at].astype(np.uint64) % np.maximum(1, parts.ravel()[cell]).astype(np.uint64)).astype(np.int64)
            yield cell_rows(cell * most + own, vid[at], t["least"].to_numpy()[at], x[at], leaves & (1 << low) - 1, np.zeros(len(at), np.int64), number)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            x, vid, least = matrix(t["v"]), t["vid"].to_numpy(), t["least"].to_numpy()
            for lo in range(0, len(x), 256):
                at, to, mask = [], [], []
                for i, q in enumerate(x[lo : lo + 256], lo):
                    wanted: dict[int, int] = {}
                    for tree, n in shared.value.probes(q, candidates):
                        cell = tree * (1 << depth - low) + (n >> low)
                        wanted[cell] = wanted.get(cell, 0) | 1 << (n & (1 << low) - 1)
                    for cell, bits in wanted.items():
                        for p in range(int(parts.ravel()[cell])):
                            at.append(i)
                            to.append(cell * most + p)
                            mask.append(bits)
                yield cell_rows(np.array(to, np.int64), vid[at], least[at], x[at], np.full(len(at), 1 << low), np.array(mask, np.uint64).view(np.int64), number)

    cell_schema = "cell long, vid long, least long, v binary, leaf int, mask long"
    queries = asked.select("h", "v").distinct().join(numbered, ["h", "v"]).select("vid", "least", "v")
    filed = numbered.select("vid", "least", "v").mapInArrow(file, cell_schema).unionByName(queries.mapInArrow(ask, cell_schema))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell and leaf, the queries last: each meets the rows of the leaves in its mask."""
        block, cell, found, edges = [], None, [], {}

        def meet(vid: np.ndarray, x: np.ndarray, masks: np.ndarray) -> None:
            bv, bl, bx, leaves = (np.concatenate([c[n] for c in block]) for n in range(4))
            starts = np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1]))
            ends = np.append(starts[1:], len(leaves))
            for at in range(0, len(x), 256):
                q, mask, ids = x[at : at + 256], masks[at : at + 256], vid[at : at + 256]
                s = np.full((len(q), len(bx)), -np.inf)
                for a, e in zip(starts, ends):
                    if (who := np.flatnonzero(mask >> np.uint64(leaves[a]) & np.uint64(1))).size:
                        s[who, a:e] = q[who] @ bx[a:e].T
                # A group's rows are of one tree, so that no candidate counts twice towards an edge.
                edge = np.array([edges.get(v, -np.inf) for v in ids.tolist()])
                i, j = highest(s, q, bx, bl, keep, slip, edge)
                edges.update(zip(ids.tolist(), edge.tolist()))
                found.append((ids[i], bv[j], bl[j], s[i, j]))

        def merged(final: bool = False) -> Iterator[pa.RecordBatch]:
            """What the task's cells have found so far goes down to each query's best; out of hand, or at the end, it leaves."""
            if found and (final or sum(len(f[0]) for f in found) > HELD):
                best = best_of(*(np.concatenate(c) for c in zip(*found)), keep, slip)
                found.clear()
                if final or len(best[0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query", "vid", "least", "score"])
                else:
                    found.append(best)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            at, vid, least, leaf_of, masks, x = t["cell"].to_numpy(), t["vid"].to_numpy(), t["least"].to_numpy(), t["leaf"].to_numpy(), t["mask"].to_numpy().view(np.uint64), unpacked(b.column("v"), number)
            asks = leaf_of == 1 << low
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, e in zip([0, *cuts], [*cuts, len(at)]):
                if at[a] != cell:
                    block, cell = [], at[a]
                if not asks[a]:
                    block.append((vid[a:e], least[a:e], x[a:e], leaf_of[a:e]))
                elif block:
                    meet(vid[a:e], x[a:e], masks[a:e])
                    yield from merged()
        yield from merged(final=True)

    scored = filed.repartition("cell").sortWithinPartitions("cell", "leaf").mapInArrow(rank, "query long, vid long, least long, score double")
    best = scored.groupBy("query", "vid").agg(F.max("score").alias("score"))
    place = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    edge = F.coalesce(F.max(F.when(F.col("n") == keep, F.col("score"))).over(Window.partitionBy("query")), F.lit(float("-inf")))
    found = place.withColumn("edge", edge).where(F.col("score") >= F.col("edge") - 2 * slip)
    return _expand(found, kept, asked, k).select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")


def cell_rows(cells: np.ndarray, vid: np.ndarray, least: np.ndarray, x: np.ndarray, leaf: np.ndarray, mask: np.ndarray, number: str) -> pa.RecordBatch:
    data = np.ascontiguousarray(x, np.float32 if number == "float" else np.float64)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (data.itemsize * x.shape[1])
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(vid), pa.array(least), packed, pa.array(leaf.astype(np.int32)), pa.array(mask)], ["cell", "vid", "least", "v", "leaf", "mask"])


def unpacked(column: pa.BinaryArray, number: str) -> np.ndarray:
    """The vectors of ``cell_rows`` as rows of doubles."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(np.float32 if number == "float" else np.float64).reshape(len(column), -1).astype(np.float64)


def leaf_sizes(numbered: DataFrame, forest: Forest) -> np.ndarray:
    """Rows of every leaf of every tree: one number a leaf goes to the driver."""
    shared, trees, width = numbered.sparkSession.sparkContext.broadcast(forest), forest.trees, forest.inner + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(trees * width, np.int64)
        for b in batches:
            leaves = shared.value.leaves(matrix(pa.Table.from_batches([b])["v"])) + np.arange(trees) * width
            counts += np.bincount(leaves.ravel(), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["leaf", "n"])

    sums = numbered.select("v").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(trees * width, np.int64)
    out[sums["leaf"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(trees, width)


def _expand(found: DataFrame, kept: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """From vectors to ids: exact scores in component order, ties to the smaller id."""
    q = kept.select(F.col("vid").alias("query"), F.col("v").alias("qv"))
    c = kept.select("vid", "ids", F.col("v").alias("cv"))
    exact = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    pairs = found.select("query", "vid").join(q, "query").join(c, "vid").select("query", "qv", F.explode("ids").alias("vec_id"), exact.alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    mine = asked.select(F.col("id").alias("query_id"), "h", "v").join(kept.select("h", "v", F.col("vid").alias("query")), ["h", "v"]).select("query_id", "query")
    per = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = mine.join(lists, "query").where(F.col("vec_id") != F.col("query_id"))
    return hits.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
