"""SimHash near-duplicates: fingerprints linked by BK-trees, then components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keelstone.llm import jaccard
from keelstone.llm.common import as_table, documents, give_back, map_batches, utf8
from keelstone.llm.components import components
from keelstone.llm.jaccard import SHINGLE, SIMILARITY

RADIUS = 3
#: Bits within which the fingerprints of similar texts lie: those of similarity
#: 0.8 are 10 bits apart on average, and beyond 16 once in fifty pairs.
NEAR = 16
#: Texts of one in so many are looked at for common shingles; those in so many
#: of them are common, and at most so many are told to the tasks.
SAMPLE, COMMON, TOLD = 16, 3, 250_000
#: A group of more fingerprints than this is dealt out as several shard trees.
SHARD = 4096
#: The same for the texts under a shingle, and rows that a task hands on at a time there.
CROWD, ROWS = 16_384, 1 << 17
#: Below this many fingerprints a tree is walked one query at a time.
SMALL = 48


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted.

    A-Z are lower-cased. Fewer words than a shingle: the whole sequence is the
    one shingle. No words, or null: 0. A bit is set if it is set in over half
    of the shingles' XXH64 values.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return majority(np.fromiter((xxh64_intdigest(b" ".join(g), seed) for g in grams), np.uint64))


def majority(h: np.ndarray) -> int:
    """The number whose bits are set in over half of the numbers."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[at : at + (1 << 14)])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def near(self, x: int, radius: int) -> list[int]:
        """Every value within the radius; only edges that can lead there are followed."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                todo += [c for e, c in children.items() if -radius <= d - e <= radius]
        return found

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while (d := (x ^ node[0]).bit_count()) and (child := node[1].get(d)):
            node = child
        if d:
            node[1][d] = (x, {})


def spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between distinct values that join all those that the radius joins.

    A forest: at most one link fewer than there are values, whatever the
    number of pairs within the radius.
    """
    if len(values) <= SMALL:
        return _spanning_small(values, radius)
    return [(int(values[i]), int(values[j])) for i, j in walked(values, radius)]


def walked(values: np.ndarray, radius: int, allowed: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between places of values, as ``spanning``; allowed(i, js): which links count besides."""
    every = np.arange(len(values), dtype=np.int32)
    label, out = every.copy(), []
    # A tree over the rows `own` (its root first), walked by all queries at once:
    # those asked at the node above whose distance from it suits the tree's edge.
    todo = [(every, every, None, 0)]
    while todo:
        own, asked, far, edge = todo.pop()
        if far is not None:
            asked = asked[np.abs(far - edge) <= radius]
        if (label[own] == label[own[0]]).all():
            # All of the tree is joined: it has nothing for queries joined to it.
            asked = asked[label[asked] != label[own[0]]]
        if not asked.size:
            continue
        root, rest = own[0], own[1:]
        far = np.bitwise_count(values[asked] ^ values[root]).astype(np.int8)
        hit = asked[far <= radius]
        if allowed is not None:
            hit = hit[allowed(root, hit)]
        met, first = np.unique(label[hit], return_index=True)
        new = met != label[root]
        if new.any():
            out += [(int(root), int(i)) for i in hit[first[new]]]
            joins = np.zeros(len(values), bool)
            joins[met[new]] = True
            label[joins[label]] = label[root]
        if rest.size:
            edges = np.bitwise_count(values[rest] ^ values[root]).astype(np.int8)
            todo += [(rest[edges == e], asked, far, e) for e in np.unique(edges)]
    return out


def _spanning_small(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    tree, up, out = BKTree(), {}, []

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for x in values.tolist():
        up[x] = x
        for y in tree.near(x, radius):
            if (a := top(x)) != (b := top(y)):
                up[b] = a
                out.append((x, y))
        tree.add(x)
    return out


def masks(count: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of which one at least leaves two near values equal.

    The 64 bits fall into k blocks; values that differ in at most ``radius``
    bits agree on some k - radius of them. More values: more blocks, so that
    the groups stay small. Every choice is exact.
    """
    k = radius + (1 if count < 1 << 21 else 2 if count < 1 << 30 else 3)
    return [sum(x) for x in combinations(blocks(list(range(64)), k), k - radius)]


def blocks(bits: list[int], k: int) -> list[int]:
    """Masks of k runs of these bits."""
    cuts = [len(bits) * i // k for i in range(k + 1)]
    return [sum(1 << x for x in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks over the bits that ``mask`` leaves out, of which one at least leaves two near values equal."""
    return blocks([b for b in range(64) if not mask >> b & 1], radius + 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) among distinct 64-bit values(fp long).

    Values that share one of ``masks`` meet in a group; each group is a shard
    with a BK-tree of its own. The trees travel to the tasks that hold their
    queries rather than to every executor, as the fingerprints of a whole
    corpus have no size bound that a broadcast could rest on. A group of over
    ``shard`` values is told apart by the bits that its mask leaves out: near
    values agree on one of ``finer``. What is still as large is dealt out as
    several trees, each of which meets each other one's values in a task of its
    own.
    """
    chosen = masks(values.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(chosen)])
    spread = values.select("fp", F.inline(keys))
    crowded = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("t", "key")
    if not crowded.isEmpty():
        # Each of a crowded group's values goes to radius + 1 groups, whose keys hold both masks' bits.
        sub = F.lit(None).cast("array<struct<t:int,key:bigint>>")
        for i, m in enumerate(chosen):
            own = [F.struct(F.lit(len(chosen) + i * (radius + 1) + j).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m | x))).alias("key")) for j, x in enumerate(finer(m, radius))]
            sub = F.when(F.col("t") == i, F.array(*own)).otherwise(sub)
        apart = spread.join(crowded, ["t", "key"], "left_semi").select("fp", F.inline(sub))
        spread = spread.join(crowded, ["t", "key"], "left_anti").select("fp", "t", "key").unionByName(apart)
    sizes = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    largest = sizes.agg(F.max("n")).first()[0]
    if largest is None:
        return values.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if largest <= shard:
        grouped = spread.withColumn("pair", F.lit(0))
        by = ["t", "key"]
    else:
        large = sizes.where(F.col("n") > shard).select("t", "key", F.ceil(F.col("n") / shard).cast("int").alias("s"))
        own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.least(own, j) * F.col("s") + F.greatest(own, j))
        grouped = spread.join(large, ["t", "key"], "left").select("fp", "t", "key", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"))
        by = ["t", "key", "pair"]
    ordered = grouped.repartition(*by).sortWithinPartitions("t", "key", "pair", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["t", "key", "pair"], "fp"):
            if found := spanning(np.unique(group.view(np.uint64)), radius):
                flat = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], value: str) -> Iterator[np.ndarray]:
    """Runs of two or more values under equal keys; rows come sorted by key."""
    last, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        vs = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
        new = np.zeros(len(vs), bool)
        for k in ks:
            new[1:] |= k[1:] != k[:-1]
        first = tuple(k[0] for k in ks)
        new[0] = first != last
        starts = np.flatnonzero(new)
        head = starts[0] if starts.size else len(vs)
        if head:
            kept.append(vs[:head])
        if starts.size:
            if sum(map(len, kept)) > 1:
                yield np.concatenate(kept)
            ends = np.append(starts[1:], len(vs))
            for i in np.flatnonzero(ends[:-1] - starts[:-1] > 1):
                yield vs[starts[i] : ends[i]]
            kept = [vs[starts[-1] :]]
        last = tuple(k[-1] for k in ks)
    if sum(map(len, kept)) > 1:
        yield np.concatenate(kept)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint, component_id.

    component_id is the least id reachable over links of at most ``radius``
    differing bits, the document's own included. Nulls: a null text has
    fingerprint zero and is linked like any other; a null id is never the
    least unless its component has no other. Repeated rows give repeated
    result rows, an empty table an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))

    def run(t: pa.Table) -> pa.Table:
        fp = np.fromiter((fingerprint(x) for x in t["text"].to_pylist()), np.uint64, t.num_rows)
        return pa.table({"id": t["id"], "fp": fp.view(np.int64)})

    prints = as_table(map_batches(narrow, run, f"id {kind}, fp long"), "prints")
    distinct = as_table(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct-prints")
    found = components(as_table(links(distinct.select("fp"), radius), "links"), "components")
    placed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    of = placed.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(texts: DataFrame, shingle: int, similarity: float, radius: int = NEAR) -> DataFrame:
    """Links (a, b) among the keys of texts(k, text) that join all candidates for the similarity.

    Candidates share a shingle of their prefixes (two sets of the similarity
    always do), can be similar by their sizes and the shingle's places, and
    have fingerprints within ``radius`` bits. The texts under a shingle are a
    shard with a BK-tree over their fingerprints, walked by all of them. Common
    shingles come last in the order, so that prefixes hold them only in texts
    made of little else. A shard of over CROWD texts, by what a sample of them
    shows, is dealt out in parts, each of which meets each other one in a task
    of its own, so that all its pairs still meet; the sample decides only how
    the work is shared.
    """

    # Every task gets a copy of its own.
    seen = jaccard.Seen()

    def flat(t: pa.Table, common: np.ndarray | None, parts: np.ndarray | None) -> Iterator[pa.Table]:
        t = seen.new(t)
        if not t.num_rows:
            return
        all_hashes = [jaccard.hashes(x, shingle) for x in t["text"].to_pylist()]
        fp = np.fromiter(map(majority, all_hashes), np.uint64, len(all_hashes))
        sets = [np.unique(h) for h in all_hashes]
        size = np.array(list(map(len, sets)), np.int32)
        if common is not None:
            sets = [jaccard.prefix(s, common, similarity) for s in sets]
        at = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        left = np.concatenate([n - np.arange(len(s)) for n, s in zip(size, sets)]).astype(np.int32)
        tokens, k = np.concatenate(sets), t["k"].to_numpy()
        many = np.ones(len(tokens), np.int64)
        if common is not None and len(common):
            place = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            many = np.where(common[place] == tokens, parts[place], 1)
        # So many tokens at a time that their rows, one for each part that a text meets, stay few.
        for step in np.split(np.arange(len(tokens)), np.flatnonzero(np.diff(np.cumsum(many) // ROWS)) + 1):
            row, salt = dealt(k[at[step]], tokens[step], many[step])
            row = step[row]
            yield pa.table({"token": tokens.view(np.int64)[row], "salt": salt, "k": k[at[row]], "fp": fp.view(np.int64)[at[row]], "n": size[at[row]], "left": left[row]})

    schema = "token long, salt long, k long, fp long, n int, left int"
    some = map_batches(texts.where(F.pmod("k", F.lit(SAMPLE)) == 0), lambda t: flat(t, None, None), schema, 128).select("token", "k").distinct()
    often = some.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(TOLD).toArrow()
    order = np.argsort(often["token"].to_numpy().view(np.uint64))
    common = often["token"].to_numpy().view(np.uint64)[order]
    parts = np.maximum(1, -(-often["count"].to_numpy()[order] * SAMPLE // CROWD))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shingle and part; a shard may go on in the next batch."""
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            cols = {c: b.column(c).to_numpy() for c in b.schema.names}
            held = cols if held is None else {c: np.concatenate([held[c], cols[c]]) for c in cols}
            if not len(held["k"]):
                continue
            cuts = np.flatnonzero((held["token"][1:] != held["token"][:-1]) | (held["salt"][1:] != held["salt"][:-1])) + 1
            if len(cuts):
                yield shard_links({c: v[: cuts[-1]] for c, v in held.items()}, cuts[:-1], similarity, radius)
                held = {c: v[cuts[-1] :] for c, v in held.items()}
        if held is not None and len(held["k"]):
            yield shard_links(held, np.zeros(0, np.int64), similarity, radius)
        held = None
        give_back()

    rows = map_batches(texts, lambda t: flat(t, common, parts), schema, 128)
    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(meet, "a long, b long").distinct()


def dealt(k: np.ndarray, token: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, salt): each row once for each of its shard's parts, which it meets under that salt.

    A text's own part is another one under each shingle. Two texts of a shard
    have one salt in common at least, whichever parts they are in.
    """
    mixed = (k.view(np.uint64) ^ token.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    own = np.repeat((mixed % parts.astype(np.uint64)).astype(np.int64), parts)
    of, place = np.repeat(parts, parts), np.repeat(np.arange(len(parts)), parts)
    other = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return place, np.minimum(own, other) * of + np.maximum(own, other)


def shard_links(rows: dict[str, np.ndarray], cuts: np.ndarray, similarity: float, radius: int) -> pa.RecordBatch:
    """Links (a, b), a below b, that join what all pairs join within each shard of rows(k, fp, n, left), cut at ``cuts``; of any size."""
    k, fp, n, left = rows["k"], rows["fp"].view(np.uint64), rows["n"].astype(np.int64), rows["left"].astype(np.int64)
    starts = np.append(0, cuts).astype(np.int64)
    many = np.diff(np.append(starts, len(k)))
    # Shards of two need no tree.
    i = starts[many == 2]
    good = (np.bitwise_count(fp[i] ^ fp[i + 1]) <= radius) & jaccard.possible(n[i], left[i], n[i + 1], left[i + 1], similarity)
    found = [np.column_stack([k[i[good]], k[i[good] + 1]])]
    for a, m in zip(starts[many > 2].tolist(), many[many > 2].tolist()):
        kk, nn, ll = k[a : a + m], n[a : a + m], left[a : a + m]
        if links := walked(fp[a : a + m], radius, lambda r, js, nn=nn, ll=ll: jaccard.possible(nn[r], ll[r], nn[js], ll[js], similarity)):
            found.append(kk[np.array(links)])
    pairs = np.sort(np.concatenate(found), axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = NEAR) -> DataFrame:
    """docs without near-duplicates: one row of each component of similar texts.

    Two texts are linked if the Jaccard similarity of their sets of word
    shingles is ``similarity`` or more. BK-trees over the fingerprints of these
    shingles find candidates within ``radius`` bits (see ``candidates``); the
    groups that candidates join are then compared exactly, all pairs, so that
    no link is wrong, and one is lost only if the fingerprints of a pair, and
    of all chains of candidates between the two, lie further apart.

    The row of least id stays, null ids last, then that of least text key; of
    rows equal in both, any one. Rows are judged by their texts alone, so null
    and repeated ids do no harm. Null, empty and blank texts are similar to
    each other and to no other text. Texts are told apart by 64 bits of their
    digest, and are read as a whole, of any length. An empty table gives an
    empty result; no other column is looked at.
    """
    texts = jaccard.keyed_texts(docs, text_col)
    groups_of = components(as_table(candidates(texts, shingle, similarity, radius), "candidates"), "candidate-components")
    members = as_table(groups_of.select(F.col("node").alias("k"), "root"), "members")
    found = as_table(jaccard.checked(texts, members, shingle, similarity), "similar")
    return jaccard.least_rows(docs, components(found, "similar-components"), id_col, text_col)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
