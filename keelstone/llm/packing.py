"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstone.llm.common import as_table, documents, map_batches, utf8

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"


class ByteBPE:
    """Ids of a byte-level BPE vocabulary file, special strings handled as its library does.

    The merges run in a ranked BPE encoder over the same vocabulary; the file's
    added tokens are cut out first, as the file's own library does by default.
    """

    def __init__(self, path: str) -> None:
        import re

        import tiktoken

        spec = json.load(open(path))
        shown = byte_alphabet()
        back = {c: b for b, c in shown.items()}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            if ranks.get(text.encode()) == i:
                del ranks[text.encode()]
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text, as unsigned 32-bit numbers."""
        if not self.cut.search(text):
            return self.bpe.encode_to_numpy(text, disallowed_special=())
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += [self.bpe.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, self.bpe.encode_to_numpy(text[at:], disallowed_special=())])


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times) for counts of pieces by length.

    Each bin is filled greedily: the longest piece left, then again and again
    the longest that fits. Then its shortest piece is taken out and the gap,
    expanded by it, gets the two unpacked pieces that fill it best, if they
    fill it more tightly than that piece did; the longer first piece wins ties.
    A bin is repeated as often as the counts allow, which is what packing one
    by one would do. The work depends on the number of distinct lengths, not on
    the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while (have := np.flatnonzero(left)).size:
        lengths = [int(have[-1])]
        left[lengths[0]] -= 1
        gap = capacity - lengths[0]
        while gap and (fits := np.flatnonzero(left[: gap + 1])).size:
            lengths.append(int(fits[-1]))
            left[lengths[-1]] -= 1
            gap -= lengths[-1]
        if gap and len(lengths) > 1:
            least, room = lengths[-1], gap + lengths[-1]
            pair = _best_pair(left, room)
            if pair and sum(pair) > least:
                left[least] += 1
                lengths[-1:] = pair
                for x in pair:
                    left[x] -= 1
        used = {x: lengths.count(x) for x in set(lengths)}
        times = 1 + min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= (times - 1) * n
        out.append((lengths, times))
    return out


def _best_pair(left: np.ndarray, room: int) -> list[int] | None:
    """The two lengths left that fill room best, the longer as long as can be."""
    have = np.flatnonzero(left[:room])
    if not have.size:
        return None
    have = have[have > 0]
    # For each first length the longest second that is no longer and still fits.
    at = np.searchsorted(have, np.minimum(room - have, have), side="right") - 1
    at[(at >= 0) & (have[np.maximum(at, 0)] == have) & (left[have] < 2)] -= 1
    sums = np.where(at >= 0, have + have[np.maximum(at, 0)], -1)
    if not sums.size or sums.max() < 0:
        return None
    i = np.flatnonzero(sums == sums.max())[-1]
    return [int(have[i]), int(have[at[i]])]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, task, turn (and ids, if asked for).

    A document is its ids and END_ID; a longer one is cut into pieces of
    capacity ids, of which the first may be shorter. A null text is empty.
    turn numbers the pieces of a length within the task that makes them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Every task gets a copy of its own.
    turns = np.zeros(capacity + 1, np.int64)

    def run(t: pa.Table) -> pa.Table:
        bpe, rows = encoder(path), []
        keys, parts = [], []
        for k, raw in enumerate(t["text"].to_pylist()):
            ids = np.append(bpe.ids((raw or b"").decode("utf-8", "replace")), np.uint32(END_ID)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            starts = [0, *range(first, len(ids), capacity)]
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                keys.append(k)
                rows.append((i, a, b - a, zlib.crc32(ids[a:b].tobytes()), turns[b - a]))
                turns[b - a] += 1
                if with_ids:
                    parts.append(ids[a:b].tolist())
        cols = list(zip(*rows)) or [[], [], [], [], []]
        out = {"id": t["id"].take(pa.array(keys, pa.int64())), "piece": pa.array(cols[0], pa.int32())}
        out |= {n: pa.array(c, pa.int64()) for n, c in zip(("start", "length", "ids_crc32", "turn"), cols[1:])}
        out["task"] = pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())
        return pa.table(out | ({"ids": pa.array(parts, pa.list_(pa.int64()))} if with_ids else {}))

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, turn long, task int" + ", ids array<long>" * with_ids
    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), run, schema, 256)


def pack(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece with its sequence_id and offset there.

    Lengths are whole numbers up to capacity, so the table of counts by length
    has at most ``capacity`` rows however many documents there are. That table
    comes to the driver, which packs it, and returns as a table of slots: the
    n-th piece of a length goes to the n-th slot of that length. The tasks that
    make the pieces number them by length, and sums over the tasks before give
    each its first number: no length, however common, and no group of equal
    documents is ordered or gathered.

    A null text is an empty document, one END_ID; a text of any length is
    encoded as a whole in the task that holds it; null ids and repeated rows
    are documents like others; an empty table gives an empty result; columns
    besides the two named are ignored. Reruns over the same files and splits
    give each piece the same place.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    cut = as_table(pieces(docs, path, id_col, text_col, capacity, with_ids), "pieces")
    spark = docs.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(best_two_fit(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(starts, ["length", "task"]).withColumn("rank", F.col("first") + F.col("turn"))
    # A length has few runs of equal slots: their number depends on the lengths alone.
    table = spark.createDataFrame(slots, "length long, runs array<struct<until:long,first:long,sequence:long,offset:long>>").hint("broadcast")
    run = F.element_at(F.filter("runs", lambda r: F.col("rank") < r["until"]), 1)
    placed = ranked.join(table, "length").withColumn("run", run)
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"),
        F.col("run.offset").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def _slots(bins: list[tuple[list[int], int]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Per length its runs of slots (until, first, sequence, offset), in the order of ranks."""
    out: dict[int, list] = {}
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            mine = out.setdefault(x, [])
            first = mine[-1][0] if mine else 0
            mine.append((first + times, first, sequence, offset))
            offset += x
        sequence += times
    return list(out.items())


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
