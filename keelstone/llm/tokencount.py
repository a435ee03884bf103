"""Token counts from distinct pre-tokens, without materialising ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm.common import as_table, documents, map_batches, utf8

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Texts, and bytes of texts, whose pre-tokens are taken together.
BATCH_ROWS = 8192
BATCH_BYTES = 8 << 20
#: Pre-tokens whose counts every task holds, at most, and the longest of them
#: in characters: those in the most batches of texts. Others are joined.
TOLD, TOLD_CHARS = 500_000, 64
#: What the library writes for a space.
MARK = "▁"


class Pieces:
    """Pieces of whole texts, counted by pre-token.

    A pre-token is a run of spaces and the run of other characters behind it.
    No piece of the vocabulary has a space mark behind another character, so no
    merge crosses the start of a pre-token, and the pieces of a text are those
    of its pre-tokens. Where a vocabulary lacks that property (``splits`` is
    false) each text is one pre-token.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        crossing = any(re.search(f"[^{MARK}]{MARK}", x) for x in names)
        encode = lambda t: self.library.encode(t, out_type=str)
        # One mark stands before the text, and spaces are kept as they are.
        self.splits = not crossing and MARK in names and encode("  a  b ") == [*encode("  a"), *encode(" b"), MARK] and encode("a") != encode(" a")

    def parts(self, text: str) -> list[str]:
        """Pre-tokens as texts whose own pieces are counted; an empty one stands for a lone mark."""
        if not self.splits:
            return [text] if text else []
        if not text:
            return []
        found = text.replace(MARK, " ").split(" ")
        if "" not in found:
            return found
        # Each pre-token gives up one space: the library puts a mark there itself.
        return [x[1:] for x in re.findall(" +[^ ]+| +$", " " + text.replace(MARK, " "))]

    def counts(self, distinct: list[str]) -> np.ndarray:
        out = np.fromiter(map(len, self.library.encode(distinct, num_threads=1)), np.int64, len(distinct))
        return np.where([x == "" for x in distinct], 1, out) if "" in distinct else out


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def frequencies(texts: list[str], pieces: Pieces) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pre-tokens, document, pre-token number, times) of some texts."""
    lists = [pieces.parts(t) for t in texts]
    flat = pa.array([p for ps in lists for p in ps], pa.string()).dictionary_encode()
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(ps) for ps in lists])
    width = max(1, len(flat.dictionary))
    pairs, times = np.unique(doc * width + flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return flat.dictionary, pairs // width, pairs % width, times


def portions(column: pa.ChunkedArray) -> Iterator[list[bytes]]:
    """The texts in portions of at most BATCH_BYTES; a longer text is one of its own."""
    kept, size = [], 0
    for x in column.to_pylist():
        x = x or b""
        if kept and size + len(x) > BATCH_BYTES:
            yield kept
            kept, size = [], 0
        kept.append(x)
        size += len(x)
    if kept:
        yield kept


def counted(texts: DataFrame, path: str) -> DataFrame:
    """(part, pieces, seen) for every distinct pre-token of texts(text binary): its pieces are counted once; seen: in how many portions it is."""

    def distinct(t: pa.Table) -> Iterator[pa.Table]:
        pieces = pieces_of(path)
        for raw in portions(t["text"]):
            yield pa.table({"part": frequencies([x.decode("utf-8", "replace") for x in raw], pieces)[0].cast(pa.binary())})

    def count(t: pa.Table) -> pa.Table:
        n = pieces_of(path).counts([x.decode() for x in t["part"].to_pylist()])
        return pa.table({"part": t["part"], "seen": t["seen"], "pieces": pa.array(n)})

    parts = map_batches(texts, distinct, "part binary", BATCH_ROWS).groupBy("part").agg(F.count("*").alias("seen"))
    return as_table(map_batches(parts, count, "part binary, seen long, pieces long", BATCH_ROWS), "pre-tokens")


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, told: int = TOLD) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit.

    Counts equal the library's for the whole text, without begin or end tokens.
    The pieces of each distinct pre-token of the corpus are counted once. The
    ``told`` commonest pre-tokens' counts go to every task (so many short
    strings are the bound) and meet the documents' frequencies there; the rest
    of the frequencies, rare by then, meet theirs in a join. No document's ids
    are ever made. A lost task is simply run again.

    A null text is empty; null ids and repeated rows are counted like others; a
    text of any length is taken apart as a whole in the task that holds it; an
    empty table gives an empty result; other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    table = counted(rows.select("text"), path)
    # A part can be a whole long run without a space: such are left to the join.
    common = table.where(F.length("part") <= TOLD_CHARS).orderBy(F.desc("seen"), "part").limit(told).select("part", "pieces").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((common["part"].combine_chunks(), common["pieces"].to_numpy()))

    def join(t: pa.Table) -> Iterator[pa.Table]:
        pieces, (known, counts), at = pieces_of(path), shared.value, 0
        for raw in portions(t["text"]):
            parts, doc, number, times = frequencies([x.decode("utf-8", "replace") for x in raw], pieces)
            place = pc.index_in(parts.cast(pa.binary()), known).fill_null(-1).to_numpy(zero_copy_only=False)
            per = np.where(place >= 0, counts[np.maximum(place, 0)] if len(counts) else 0, 0)
            sums = np.bincount(doc, weights=per[number] * times, minlength=len(raw)).astype(np.int64)
            rare = place[number] < 0
            ends = np.searchsorted(doc[rare], np.arange(len(raw) + 1))
            rest = pa.StructArray.from_arrays([parts.cast(pa.binary()).take(pa.array(number[rare])), pa.array(times[rare])], ["part", "times"])
            yield pa.table({
                "row": t["row"].slice(at, len(raw)), "id": t["id"].slice(at, len(raw)), "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "n_tokens": pa.array(sums),
                "rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest),
            })
            at += len(raw)

    schema = f"row long, id {kind}, n_bytes long, n_tokens long, rare array<struct<part: binary, times: bigint>>"
    met = as_table(map_batches(rows.withColumn("row", F.monotonically_increasing_id()), join, schema, BATCH_ROWS), "token-sums")
    out = met.select("row", "id", "n_bytes", "n_tokens")
    rest = met.select("row", F.inline("rare"))
    if not rest.isEmpty():
        more = rest.join(table.select("part", "pieces"), "part").groupBy("row").agg(F.sum(F.col("pieces") * F.col("times")).alias("more"))
        out = out.join(more, "row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
