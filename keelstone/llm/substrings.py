"""Exact removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keelstone.llm.common import as_table, documents, map_batches, utf8

WINDOW = 35
#: Words of a minimiser.
MINIMISER = 4
#: Share of the documents in which common m-mers are looked for.
SAMPLE = 1 / 64
#: One found this often in that share is common ...
COMMON = 48
#: ... if it is also more than this share of all those found: so many at most,
#: eight bytes each.
MOST_COMMON = 2_000_000
#: Strings, and their packed bytes, of one minimiser that a task holds; more of
#: them are summed up by string, and beyond that counted window by window.
HELD_ROWS, HELD_BYTES = 8_192, 4 << 20
#: Bounds of the documents that the packer's dictionary is made from.
PACK_DOCS, PACK_CHARS = 200, 20_000


def m_mers(words: list[bytes], m: int = MINIMISER) -> np.ndarray:
    """A well-mixed number for each run of m words."""
    h = np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))
    grams = np.zeros(max(0, len(words) - m + 1), np.uint64)
    for j in range(m):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : len(grams) + j]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return grams ^ grams >> np.uint64(32)


def listed(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the numbers are in the sorted list."""
    return common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams if common.size else np.zeros(len(grams), bool)


def minimisers(words: list[bytes], common: np.ndarray, window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, np.ndarray]:
    """(position, value) of each window's minimiser: its least m-mer, the leftmost of equals.

    Common m-mers come last in the order: a window takes one only if it has no
    other, so that a passage in very many documents draws no window that
    reaches beyond it into its own bucket.
    """
    grams = m_mers(words, m)
    order = grams >> np.uint64(1)
    if common.size:
        order = order | listed(grams, common).astype(np.uint64) << np.uint64(63)
    views = np.lib.stride_tricks.sliding_window_view(order, window - m + 1)
    at = np.concatenate([views[i : i + 8192].argmin(axis=1) + i for i in range(0, len(views), 8192)]) + np.concatenate([np.arange(min(8192, len(views) - i)) for i in range(0, len(views), 8192)])
    return at, grams[at]


def super_k_mers(text: bytes, common: np.ndarray, window: int = WINDOW, m: int = MINIMISER) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, windows, minimiser, packed words) of each run of windows with one minimiser."""
    words = text.split()
    if len(words) < window:
        return
    at, value = minimisers(words, common, window, m)
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    packed = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.array([len(w) for w in words])).tolist()
    ends = ends.tolist()
    values = value.view(np.int64).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield a, b - a, values[a], packed[starts[a] : ends[b + window - 2]]


class Packer:
    """Packs short strings with a shared dictionary: equal strings have equal packed bytes."""

    def __init__(self, samples: list[bytes], size: int = 1 << 16) -> None:
        self.dictionary = b""
        if len(samples) >= 100:
            self.dictionary = zstandard.train_dictionary(size, samples).as_bytes()

    @cached_property
    def _codecs(self) -> tuple:
        shared = zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None
        return zstandard.ZstdCompressor(level=3, dict_data=shared, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=shared)

    def __getstate__(self) -> dict:
        return {"dictionary": self.dictionary}

    def pack(self, x: bytes) -> bytes:
        return self._codecs[0].compress(x)

    def unpack(self, x: bytes) -> bytes:
        return self._codecs[1].decompress(x)


def windows(packed: bytes, window: int = WINDOW) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def repeated(rows: list[tuple[bytes, int]], unpack: Callable[[bytes], bytes], window: int = WINDOW) -> dict[bytes, list[tuple[int, int]]]:
    """Runs (first, number) of the repeated windows of each packed string; rows: (packed, times) of one minimiser."""
    times = Counter()
    for packed, n in rows:
        times[packed] += n
    if len(times) == 1:
        ((packed, n),) = times.items()
        return {packed: [(0, unpack(packed).count(b" ") + 2 - window)]} if n > 1 else {}
    own = {packed: windows(unpack(packed), window) for packed in times}
    counts = Counter()
    for packed, n in times.items():
        for w in own[packed]:
            counts[w] += n
    out = {}
    for packed, ws in own.items():
        runs: list[list[int]] = []
        for i, w in enumerate(ws):
            if counts[w] > 1:
                if runs and sum(runs[-1]) == i:
                    runs[-1][1] += 1
                else:
                    runs.append([i, 1])
        if runs:
            out[packed] = [tuple(r) for r in runs]
    return out


def by_minimiser(batches: Iterator[pa.RecordBatch], held_rows: int, held_bytes: int) -> Iterator[tuple[int, bool, list[tuple]]]:
    """(minimiser, whole, rows) of rows that come sorted by ``mini``; each row: the other columns.

    A lone row that stands once can't repeat and is passed over, unless it is
    common: others of its kind went elsewhere. A minimiser
    whose rows outgrow the two bounds, or that is common (``salt``
    above 0), comes in several lists, ``whole`` false.
    """
    last, kept, size, split = None, [], 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        mini, times = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("mini", "times"))
        starts = np.flatnonzero(np.append(True, mini[1:] != mini[:-1]))
        many = np.diff(np.append(starts, len(mini)))
        lone = (many == 1) & (times[starts] == 1)
        if "salt" in batch.schema.names:
            lone &= batch.column(batch.schema.get_field_index("salt")).to_numpy()[starts] == 0
        lone[-1] = False
        lone[0] &= mini[0] != last
        cols = batch.filter(pa.array(np.repeat(~lone, many))).to_pydict()
        salt = cols.pop("salt", None) or [0] * len(cols["mini"])
        for m, common, *row in zip(cols.pop("mini"), salt, *cols.values()):
            if m != last:
                if kept:
                    yield last, not split, kept
                last, kept, size, split = m, [], 0, common > 0
            kept.append(tuple(row))
            size += len(row[-1])
            if len(kept) >= held_rows or size >= held_bytes:
                yield last, False, kept
                kept, size, split = [], 0, True
        yield None, True, []  # so that the caller gets its turn with every batch
    if kept:
        yield last, not split, kept


def common_m_mers(docs: DataFrame, window: int, m: int, share: float = SAMPLE, least: int = COMMON) -> np.ndarray:
    """M-mers that many texts share, found in a share of the documents.

    At most MOST_COMMON of them. They decide which way a window goes, never
    whether it counts as repeated.
    """

    def run(t: pa.Table) -> pa.Table:
        words = [x.split() for x in t["text"].to_pylist() if x]
        grams = [m_mers(w, m) for w in words if len(w) >= window]
        value, n = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint64), return_counts=True)
        return pa.table({"gram": value.view(np.int64)[n > 1], "n": n[n > 1]})

    counts = as_table(map_batches(docs.sample(share, seed=17), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "m-mers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") > max(least, total // MOST_COMMON)).select("gram").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def pack_samples(docs: DataFrame, window: int, m: int, share: float) -> list[bytes]:
    """Strings for the packer's dictionary, from at most PACK_DOCS documents of at most PACK_CHARS bytes."""
    rows = docs.sample(share, seed=19).where(F.length("text").between(1, PACK_CHARS)).select("text").limit(PACK_DOCS).collect()
    return [p for r in rows for *_, p in super_k_mers(bytes(r["text"]), np.zeros(0, np.uint64), window, m)]


RUNS = "array<struct<start: bigint, n: bigint>>"


def repeated_runs(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, share: float = SAMPLE, common_least: int = COMMON) -> DataFrame:
    """(uid, runs array of (start, n)): windows that occur more than once; docs: (uid, text binary).

    Windows that share a minimiser travel as one packed string to its bucket,
    where rows are sorted and equal windows are counted as whole word
    sequences. Copies of a text within a batch travel once with their number,
    and so does a string found twice there: its places, known to be repeated,
    travel without it, dealt out evenly.
    Strings of common minimisers are dealt out by string and place, and meet in
    two steps: a string found twice is repeated as a whole, its places leave at
    once, and only the string with its count goes on to the minimiser's bucket;
    one found once goes there with its place. Minimisers that outgrow a task's
    bounds go the same way, and what outgrows them in the second step is
    counted window by window in an aggregation that can spill.
    """
    common = common_m_mers(docs, window, m, share, common_least)
    packer = Packer(pack_samples(docs, window, m, share))
    held = HELD_ROWS, HELD_BYTES

    def cut(t: pa.Table) -> Iterator[pa.Table]:
        texts: dict[bytes, list] = {}
        for u, x in zip(t["uid"].to_pylist(), t["text"].to_pylist()):
            texts.setdefault(u, [0, x])[0] += 1
        rows: list[tuple] = []
        places: dict[bytes, list[tuple]] = {}
        for u, (n, x) in texts.items():
            for start, many, mini, string in super_k_mers(x or b"", common, window, m):
                places.setdefault(string, []).append((u, n, start, many, mini))
        met: list[tuple] = []
        for string, own in places.items():
            if len(own) > 1:
                rows.append((None, sum(r[1] for r in own), 0, own[0][3], own[0][4], string))
                met += own
            else:
                rows.append((*own[0], string))
        uid, times, start, many, mini, strings = list(zip(*rows)) or [()] * 6
        mini = np.array(mini, np.int64)
        hot = listed(mini.view(np.uint64), common)
        # The batch takes part in the place, so that copies in many batches are dealt out too.
        batch = xxh64_intdigest(t["uid"][0].as_py()) >> 32 if t.num_rows else 0
        salt = [1 + xxh64_intdigest(x) % 32 * 32 + xxh64_intdigest(u or b"", batch + a) % 32 if h else 0 for u, a, x, h in zip(uid, start, strings, hot.tolist())]
        packed = [packer.pack(x) for x in strings]
        yield cut_rows(mini, salt, uid, start, many, times, packed)
        if met:
            uid, times, start, many, _ = zip(*met)
            spread = np.fromiter((xxh64_intdigest(u, a) for u, a in zip(uid, start)), np.uint64).view(np.int64)
            yield cut_rows(spread, [-1] * len(met), uid, start, many, times, [None] * len(met))

    cuts = map_batches(docs, cut, "mini long, salt int, uid binary, start long, many int, times long, packed binary", 1024)
    ordered = cuts.repartition("mini", "salt").sortWithinPartitions("mini", "packed")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        string, total, first = (None, None), 0, None
        known: list[pa.RecordBatch] = []
        for mini, whole, rows in by_minimiser(without_places(batches, known), *held):
            while known:
                done = known.pop().to_pydict()
                yield _batch([(None, u, None, None, None, _runs([(0, n)], a)) for u, a, n in zip(done["uid"], done["start"], done["many"])])
            if whole:
                found = repeated([(x, n) for *_, n, x in rows], packer.unpack, window)
                out += [(None, u, None, None, None, _runs(found[x], a)) for u, a, _, _, x in rows if u and x in found]
            else:
                for u, a, many, n, x in rows:
                    if (mini, x) != string:
                        if total:
                            out.append((string[0], *(first[:2] if first else (None, None)), total, string[1], None))
                        string, total, first = (mini, x), 0, None
                    total += n
                    if total == 1:
                        first = (u, a, many)
                        continue
                    if first:
                        out.append((None, first[0], None, None, None, _runs([(0, first[2])], first[1])))
                        first = None
                    if u:
                        out.append((None, u, None, None, None, _runs([(0, many)], a)))
            if len(out) > 4096:
                yield _batch(out)
                out = []
        if total:
            out.append((string[0], *(first[:2] if first else (None, None)), total, string[1], None))
        for batch in known:
            done = batch.to_pydict()
            out += [(None, u, None, None, None, _runs([(0, n)], a)) for u, a, n in zip(done["uid"], done["start"], done["many"])]
        yield _batch(out)

    schema = f"mini long, uid binary, start long, times long, packed binary, runs {RUNS}"
    met = as_table(ordered.mapInArrow(count, schema), "repeats")
    again = met.where("mini IS NOT NULL").repartition("mini").sortWithinPartitions("mini").select("mini", "uid", "start", "times", "packed")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for mini, whole, rows in by_minimiser(batches, *held):
            if whole:
                found = repeated([(x, n) for *_, n, x in rows], packer.unpack, window)
                out += [(None, u, None, None, None, _runs(found[x], a)) for u, a, _, x in rows if u and x in found]
            else:
                out += [(mini, u, a, n, x, None) for u, a, n, x in rows]
            if len(out) > 4096:
                yield _batch(out)
                out = []
        yield _batch(out)

    weighed = as_table(again.mapInArrow(weigh, schema), "weighed")
    runs = met.where("mini IS NULL").select("uid", "runs").unionByName(weighed.where("mini IS NULL").select("uid", "runs")).distinct()
    over = weighed.where("mini IS NOT NULL")
    if over.isEmpty():
        return runs
    found = _by_window(over.groupBy("packed").agg(F.sum("times").alias("times")), packer, window)
    places = over.where("uid IS NOT NULL").select("uid", "start", _key("packed")).distinct()
    shift = F.transform("runs", lambda r: F.struct((F.col("start") + r["start"]).alias("start"), r["n"].alias("n")))
    return runs.unionByName(places.join(found, "pid").select("uid", shift.alias("runs")))


def cut_rows(mini: np.ndarray, salt: list, uid: list, start: list, many: list, times: list, packed: list) -> pa.Table:
    """Strings with their place (uid null: places that travel by themselves), or places alone (packed null, salt -1)."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    names = ("mini", "salt", "uid", "start", "many", "times", "packed")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, (mini, salt, uid, start, many, times, packed), kinds)})


def without_places(batches: Iterator[pa.RecordBatch], places: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' strings; rows that are places alone are put aside."""
    for b in batches:
        alone = b.column(b.schema.get_field_index("packed")).is_null()
        if alone.true_count:
            places.append(b.filter(alone))
            b = b.filter(pc.invert(alone))
        yield b


def _runs(runs: list[tuple[int, int]], at: int) -> list[dict]:
    return [{"start": at + a, "n": n} for a, n in runs]


def _key(column: str) -> Column:
    return F.unhex(F.md5(column)).alias("pid")


def _by_window(strings: DataFrame, packer: Packer, window: int) -> DataFrame:
    """(pid, runs) of strings(packed, times), each string once: windows by a 128-bit digest are counted in one aggregation."""

    def cut(t: pa.Table) -> Iterator[pa.Table]:
        pid, at, times, digest = [], [], [], []
        for x, n in zip(t["packed"].to_pylist(), t["times"].to_pylist()):
            ws = windows(packer.unpack(x), window)
            pid += [hashlib.md5(x).digest()] * len(ws)
            at += range(len(ws))
            times += [n] * len(ws)
            digest += [hashlib.md5(w).digest() for w in ws]
        yield pa.table({"pid": pa.array(pid, pa.binary()), "at": pa.array(at, pa.int64()), "times": pa.array(times, pa.int64()), "digest": pa.array(digest, pa.binary())})

    each = map_batches(strings.select("packed", "times"), cut, "pid binary, at long, times long, digest binary", 256)
    often = each.groupBy("digest").agg(F.sum("times").alias("all")).where(F.col("all") > 1).select("digest")
    hit = each.join(often, "digest", "left_semi").groupBy("pid").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    return hit.select("pid", F.transform("ats", lambda a: F.struct(a.alias("start"), F.lit(1).cast("long").alias("n"))).alias("runs"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["mini", "uid", "start", "times", "packed", "runs"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = MINIMISER, with_text: bool = False, share: float = SAMPLE, common_least: int = COMMON
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (and text, if asked for).

    A word goes if it is in a window of ``window`` words whose word sequence
    also starts anywhere else, in the same document or another one; all windows
    are judged on the input. Words are separated by ASCII white space and kept
    words are joined by one space.

    What is removed from a text depends on the text and the corpus alone, so
    rows are known by a digest of their text: equal texts share their windows'
    fate and repeated rows count as often as they stand. A text of any length
    is cut as a whole, in the task that holds it. A null text has no words; null ids are carried along; an empty table gives an empty result;
    columns besides the two named are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).withColumn("uid", F.unhex(F.md5(F.coalesce("text", F.lit(b"")))))
    runs = repeated_runs(rows.select("uid", "text"), window, m, share, common_least)
    lists = as_table(runs.groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")

    def cut(t: pa.Table) -> pa.Table:
        out = []
        for x, runs in zip(t["text"].to_pylist(), t["runs"].to_pylist()):
            words = (x or b"").split()
            if runs:
                gone = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    gone[r["start"]] += 1
                    gone[r["start"] + r["n"] + window - 1] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                kept = [w for w, s in zip(words, stay.tolist()) if s]
            else:
                kept = words
            text = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text))
        n, removed, digest, texts = zip(*out)
        cols = {"id": t["id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(cols | ({"text": pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())} if with_text else {}))

    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return map_batches(rows.join(lists, "uid", "left").select("id", "text", "runs"), cut, schema, 512).withColumnRenamed("id", id_col)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
