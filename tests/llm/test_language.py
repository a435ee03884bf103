import itertools
import re
from zlib import crc32

import numpy as np
import pytest

from keelstone.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language.op10_language(spark, SF).collect()}
    assert len(got) == 1000
    right = n = 0
    for r in docs.select("doc_id", "lang").collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= g["score"] <= 1
        if g["held_out"] and g["lang_pred"] != "und":
            n += 1
            right += g["lang_pred"] == r["lang"]
    assert n > 250 and right / n > 0.97


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(2)
    e, steps = rng.random((5, 3)) + 0.1, rng.standard_normal((3, 3))
    seqs = [[0, 1, 4, 2], [3], [2, 2, 1]]
    total, _, joint, sure = language.marginals(e, np.concatenate(seqs).astype(int), np.array([4, 1, 3]), steps, each=True)
    pairs = np.zeros((3, 3))
    for s, got in zip(seqs, total):
        want = np.zeros(3)
        z, own = 0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=len(s)):
            p = np.prod([e[w, k] for w, k in zip(s, path)]) * np.exp(sum(steps[a, b] for a, b in zip(path, path[1:])))
            z += p
            for k in path:
                want[k] += p
            for a, b in zip(path, path[1:]):
                own[a, b] += p
        assert got == pytest.approx(want / z)
        pairs += own / z
    assert joint == pytest.approx(pairs)


def test_code_switched_text_is_split_by_word():
    train = [("the cat sat on the mat with another thing", "en"), ("der hund ist nicht schlecht und sehr groß", "de")] * 5
    f = language.fit(train)
    ws = "the thing sat on the mat der hund ist sehr schlecht".split()
    _, p, _, _ = language.marginals(f.emission(ws), np.arange(len(ws)), np.array([len(ws)]), f.steps, each=True)
    assert [f.labels[k] for k in p.argmax(axis=1)] == ["en"] * 6 + ["de"] * 5
    assert f.steps.trace() > f.steps.sum() - f.steps.trace()


def one_by_one(field, text):
    """(lang_pred, score) of a text: features, factors, forward and backward in plain loops."""
    n = len(field.labels)
    ws = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if any(map(str.isalpha, w))]
    if not ws:
        return "und", 0.0
    e = []
    for w in ws:
        names = [f"p{w[:i]}" for i in (1, 2, 3)] + [f"s{w[-i:]}" for i in (1, 2, 3, 4)] + [f"w{w}"]
        names += [f"g<{w}>"[:1] + f"<{w}>"[i : i + m] for m in (2, 3) for i in range(len(w) + 3 - m)]
        rows = [crc32(x.encode()) % language.BUCKETS for x in names] + [language.BUCKETS + k for k in field.lexicon.get(w, ())]
        s = [sum(field.weights[r, k] for r in rows) for k in range(n)]
        e.append([max(np.exp(x - max(s)), 1e-12) for x in s])
    step = np.exp(field.steps)
    norm = lambda v: [x / sum(v) for x in v]
    ahead = [norm(e[0])]
    for x in e[1:]:
        ahead.append(norm([x[k] * sum(ahead[-1][j] * step[j, k] for j in range(n)) for k in range(n)]))
    back, mean = [1.0] * n, [0.0] * n
    for a, x in zip(reversed(ahead), reversed(e)):
        p = norm([u * v for u, v in zip(a, back)])
        mean = [m + y / len(ws) for m, y in zip(mean, p)]
        back = norm([sum(step[j, k] * x[k] * back[k] for k in range(n)) for j in range(n)])
    return field.labels[int(np.argmax(mean))], max(mean)


def test_the_query_against_one_by_one(spark):
    """Training as the operator does it; features and inference of every document in plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    field = language.fit(language.training_texts(docs))
    got = {r["doc_id"]: r for r in language.op10_language(spark, "/root/testdata/sf0.001").collect()}
    rows = [r for r in docs.collect() if len(r["text"] or "") < 3000]
    assert len(rows) > 100
    for r in rows:
        lang, score = one_by_one(field, r["text"] or "")
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)


def test_every_letter_of_a_long_word_counts():
    assert language.features("a" * 50 + "tion") != language.features("a" * 50 + "ung")
    rows = [("xa" * 30 + "tion " + "the of", "en"), ("xa" * 30 + "keit " + "der und", "de")] * 8
    f = language.fit(rows)
    for end, lang in (("tion", "en"), ("keit", "de")):
        assert one_by_one(f, "xa" * 30 + end)[0] == lang


def test_a_text_of_three_languages_stays(spark):
    rows = [(i, t, x) for i in range(60) for x, t in [[("en", "the and with that from which"), ("de", "nicht und der die eine wird"), ("fr", "les des une est dans pour")][i % 3]]]
    mixed = "the and with that from which nicht und der die eine wird les des une est dans pour"
    df = spark.createDataFrame([*rows, (99, mixed, "en")], "doc_id long, text string, lang string")
    assert language.identify(df).where("doc_id = 99").first()["score"] < 0.5
    assert language.accepted(df).count() == 61
    assert language.accepted(df.selectExpr("doc_id", "text", "cast(null as string) lang")).count() == 61


def test_odd_rows(spark):
    rows = [(i, "the and with that", "en") for i in range(20)] + [(i, "nicht und der die", "de") for i in range(20, 40)]
    rows += [(50, None, "en"), (51, " 12 ½ ### ", "en"), (52, "", None), (None, "the and", "de"), (53, "und der", None), (54, "the and " * 30_000, "en"), (53, "und der", None)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in language.identify(df).collect())
    assert len(got) == len(rows)
    for want in [("50", "und"), ("51", "und"), ("52", "und"), ("None", "en"), ("53", "de"), ("54", "en")]:
        assert want in got
    assert language.identify(df.limit(0)).count() == 0
    assert {r[0] for r in language.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null")).select("lang_pred").collect()} <= {"", "und"}
    kept = language.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
