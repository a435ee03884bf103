import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from keelstone.llm import packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity=1024):
    """texts: (id, text) list; every piece placed once, gapless, with the file's own ids."""
    own = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t in texts:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(spark):
    texts = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    rows = packing.op1_pack(spark, SF).collect()
    used = check(rows, texts)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_odd_rows(spark):
    texts = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x <|endoftext|> y"), (4, "word " * 5000), (5, "<|endoftext|>"), (6, "Ünïcödé 漢字 🙂 \n\n\t x"), (7, "tick " * 1023)]
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, length int, slice int")
    for parts in (1, 3, 40):
        check(packing.pack(df.repartition(parts)).collect(), texts)
    assert packing.pack(df.limit(0)).count() == 0
    ids = [i for r in sorted(packing.pack(df.where("doc_id = 4"), with_ids=True).collect(), key=lambda r: r["start"]) for i in r["ids"]]
    assert Tokenizer.from_file(PATH).decode(ids[:-1]) == "word " * 5000


def one_by_one(lengths, capacity):
    """The same rule, a piece at a time."""
    left = sorted(lengths)
    bins = []
    while left:
        b = [left.pop()]
        while fits := [x for x in left if x <= capacity - sum(b)]:
            b.append(max(fits))
            left.remove(b[-1])
        gap = capacity - sum(b)
        if gap and len(b) > 1:
            room, best = gap + b[-1], None
            for a in sorted(set(left), reverse=True):
                rest = list(left)
                rest.remove(a)
                for c in sorted({x for x in rest if x <= a and a + x <= room}, reverse=True)[:1]:
                    if best is None or a + c > sum(best):
                        best = (a, c)
            if best and sum(best) > b[-1]:
                for x in best:
                    left.remove(x)
                left = sorted([*left, b.pop()])
                b += best
        bins.append(sorted(b))
    return sorted(bins)


def test_counts_pack_as_single_pieces_do():
    rnd = random.Random(4)
    for _ in range(60):
        lengths = [rnd.choice([rnd.randint(1, 30), 11, 7]) for _ in range(rnd.randint(0, 60))]
        got = sorted(sorted(b) for b, n in packing.best_two_fit(Counter(lengths), 30) for _ in range(n))
        assert got == one_by_one(lengths, 30)
        assert Counter(x for b in got for x in b) == Counter(lengths)
        assert all(sum(b) <= 30 for b in got)
