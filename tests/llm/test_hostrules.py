import pandas as pd

from keelstone.llm import hostrules
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "a b c d e f g h " * 5, "x"), (1, "a b c d e f g h " * 5, "x"), (2, None, "y"), (3, "", "y"), (4, LONG, "z"), (None, "one two # 3", None),
    (5, "x\nx\n\ny \n y\nx", None), (6, "p q r\x0bs\x0ct\n" * 3, "b"), (7, "été café x " * 30, "x"), (8, "a " * 8, "z"), (9, "a " * 9, "z"),
    (10, " ".join(f"t{i}" for i in range(40)) + " " + " ".join(f"t{i}" for i in range(30, 40)), "z"),
]


def test_documents_match_sql(spark):
    assert same(hostrules.op9_host_rules(spark, SF), hostrules.ORACLE, SF) == 200


def test_odd_rows_match_sql(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id long, text string, source string, words int, host string")
    pdf = pd.DataFrame(ROWS, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    assert same(hostrules.judge(df), hostrules.ORACLE, documents=pdf) == len(ROWS)
    assert hostrules.judge(df.limit(0)).count() == 0


def test_repeats_equal_a_plain_count(spark):
    def plain(text):
        w = (text or "").split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = {}
        for i, g in enumerate(grams):
            seen.setdefault(g, []).append(i)
        return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})

    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = sorted((str(r["doc_id"]), r["n_repeat_words"]) for r in hostrules.judge(df).collect())
    assert got == sorted((str(d), plain(t.encode().replace(b"\xc2\xa0", b"_").decode() if t else t)) for d, t, _ in ROWS)


def test_a_bad_host_loses_its_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "spam " * 40, "bad") for i in range(60)] + [(100, clean, "bad")] + [(200 + i, clean + f" {i}", "good") for i in range(60)] + [(300, clean, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in hostrules.judge(df).collect() if r["kept"]}
    assert kept == {200 + i for i in range(60)} | {300}
