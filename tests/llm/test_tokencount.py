import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from keelstone.llm import tokencount

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def brute(rows):
    out = []
    for d, t in rows:
        n = len(LIB.encode(t or ""))
        out.append((str(d), len((t or "").encode()), n, n > 4096))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect())


def test_documents_match_the_library(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert got(tokencount.op3_tokens(spark, SF)) == brute(rows)


@pytest.mark.parametrize("told", [tokencount.TOLD, 40, 0])
def test_odd_rows(spark, told):
    rows = [
        (1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "  two  spaces "), (4, "word " * 9000), (5, " "), (6, "   "), (7, "\n\n \t x\r\n"), (8, "<s> </s> <unk> <0x0A>"),
        (9, "▁ ▁▁x a▁"), (10, "漢字かな🙂 é  x　y"), (11, "x" * 5000), (12, "1234 5678 9"),
    ]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, n_tokens int, id string")
    assert got(tokencount.count_tokens(df, told=told)) == brute(rows)
    assert tokencount.count_tokens(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é▁ \n\t<>s/0x漢🙂  "), max_size=30), max_size=5))
def test_any_text_matches_the_library(texts):
    p = tokencount.pieces_of(PATH)
    assert p.splits
    parts, doc, number, times = tokencount.frequencies(texts, p)
    per = p.counts(parts.to_pylist())
    assert [int((per[number] * times)[doc == i].sum()) for i in range(len(texts))] == [len(LIB.encode(t)) for t in texts]
