"""Language of texts from a linear-chain conditional random field over words."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstone.llm.common import documents, map_batches, utf8

#: Labelled documents of each language that the field is trained on, at most,
#: and the longest that is taken (in characters).
TRAIN_DOCS = 120
TRAIN_CHARS = 100_000
#: Training sequences: so many, each of spans from documents of any language.
SEQUENCES, SPANS, SPAN = 500, 4, 30
ROUNDS = 30
#: Hashed weights, and words of each language's lexicon.
BUCKETS = 1 << 15
LEXICON = 200
#: A task forgets the words it has met beyond this number, or so many characters.
KNOWN, KNOWN_CHARS = 100_000, 4 << 20
#: Words that take their steps together, about.
TOGETHER = 400_000
UNKNOWN = "und"
#: The pipeline's stage rejects documents below this score.
MIN_SCORE = 0.5

WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return WORDS.findall(text.lower())


def features(word: str) -> list[int]:
    """Affixes, character n-grams and the word itself, hashed; all of it, however long."""
    marked = f"<{word}>"
    names = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3, 4)] + [f"w{word}"]
    names += ["g" + marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    return [crc32(x.encode("utf-8", "replace")) % BUCKETS for x in names]


@dataclass
class Field:
    """Weights of hashed features (buckets + lexicon, labels) and of label transitions."""

    labels: list[str]
    lexicon: dict[str, tuple[int, ...]]
    weights: np.ndarray
    steps: np.ndarray

    def rows(self, word: str) -> list[int]:
        """Rows of ``weights`` that a word's features have; lexicon rows come last."""
        return features(word) + [BUCKETS + k for k in self.lexicon.get(word, ())]

    def emission(self, words: list[str]) -> np.ndarray:
        """(words, labels): each word's factor for each label, the largest 1."""
        out = np.zeros((len(words), len(self.labels)))
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and end - at < 4096 and (end == at or size + len(words[end]) <= 1 << 16):
                size += len(words[end])
                end += 1
            lists = [self.rows(w) for w in words[at:end]]
            s = np.add.reduceat(self.weights[np.concatenate(lists)], np.cumsum([0, *map(len, lists)])[:-1], axis=0)
            out[at:end] = np.maximum(np.exp(s - s.max(axis=1, keepdims=True)), 1e-12)
            at = end
        return out


def marginals(emission: np.ndarray, types: np.ndarray, lengths: np.ndarray, steps: np.ndarray, each: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once.

    types: the sequences' word numbers end to end. Returns each sequence's sum
    of label probabilities over its words and, if asked for, each word's and the
    expected number of steps from label to label; last, each sequence's sum of
    its words' largest probabilities. All sequences take a step together, the
    longest first, so that those that have ended drop off the end.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    n = emission.shape[1]
    trans = np.exp(steps - steps.max())
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    alpha = np.zeros((len(types), n))
    now = None
    for t, a in enumerate(active):
        at = starts[:a] + t
        now = emission[types[at]] if t == 0 else (now[:a] @ trans) * emission[types[at]]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    total, sure = np.zeros((len(lengths), n)), np.zeros(len(lengths))
    beta, joint = np.ones((len(lengths), n)), np.zeros((n, n))
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        p = alpha[at] * beta[:a]
        p /= p.sum(axis=1, keepdims=True)
        total[order[:a]] += p
        sure[order[:a]] += p.max(axis=1)
        if each:
            alpha[at] = p
        ahead = beta[:a] * emission[types[at]]
        if each and t:
            both = alpha[at - 1][:, :, None] * trans * ahead[:, None, :]
            joint += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = ahead @ trans.T
        beta[:a] = back / back.sum(axis=1, keepdims=True)
    return total, alpha if each else None, joint, sure


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Field:
    """A field learned from (text, language) pairs.

    Sequences are spans of documents of all languages one after another, so
    that the transitions see code switches. Weights follow the gradient of the
    log likelihood (observed minus expected counts) with per-weight rates.
    """
    labels = sorted({lang for _, lang in texts})
    own: dict[str, list[list[str]]] = {x: [] for x in labels}
    for text, lang in texts:
        if ws := words_of(text):
            own[lang].append(ws)
    labels = [x for x in labels if own[x]]
    counts = {x: {} for x in labels}
    for x in labels:
        for ws in own[x]:
            for w in set(ws):
                counts[x][w] = counts[x].get(w, 0) + 1
    lexicon: dict[str, list[int]] = {}
    for k, x in enumerate(labels):
        for w in sorted(counts[x], key=lambda w: (-counts[x][w], w))[:LEXICON]:
            lexicon.setdefault(w, []).append(k)
    field = Field(labels, {w: tuple(k) for w, k in lexicon.items()}, np.zeros((BUCKETS + len(labels), len(labels))), np.zeros((len(labels), len(labels))))
    if len(labels) < 2:
        return field
    rnd = random.Random(seed)
    numbers: dict[str, int] = {}
    types, gold, lengths = [], [], []
    for _ in range(SEQUENCES):
        size = 0
        for _ in range(SPANS):
            k = rnd.randrange(len(labels))
            ws = rnd.choice(own[labels[k]])
            at = rnd.randrange(max(1, len(ws) - SPAN + 1))
            for w in ws[at : at + SPAN]:
                types.append(numbers.setdefault(w, len(numbers)))
                gold.append(k)
                size += 1
        lengths.append(size)
    types, gold, lengths = np.array(types), np.array(gold), np.array(lengths)
    lists = [field.rows(w) for w in numbers]
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), list(map(len, lists)))
    first = np.zeros(len(types), bool)
    first[np.cumsum(lengths) - lengths] = True
    pairs = np.flatnonzero(~first)
    n, seen_w, seen_s = len(labels), np.full_like(field.weights, 1e-3), np.full_like(field.steps, 1e-3)
    observed = np.zeros((n, n))
    np.add.at(observed, (gold[pairs - 1], gold[pairs]), 1)
    for _ in range(ROUNDS):
        s = np.add.reduceat(field.weights[flat], np.cumsum([0, *map(len, lists)])[:-1], axis=0)
        e = np.maximum(np.exp(s - s.max(axis=1, keepdims=True)), 1e-12)
        _, p, joint, _ = marginals(e, types, lengths, field.steps, each=True)
        err = -p
        err[np.arange(len(gold)), gold] += 1
        by_type = np.stack([np.bincount(types, weights=err[:, k], minlength=len(lists)) for k in range(n)], axis=1)
        grad = np.stack([np.bincount(flat, weights=by_type[owner, k], minlength=len(field.weights)) for k in range(n)], axis=1) - 0.01 * field.weights
        step = observed - joint - 0.1 * field.steps
        seen_w += grad * grad
        seen_s += step * step
        field.weights += 0.3 * grad / np.sqrt(seen_w)
        field.steps += 0.3 * step / np.sqrt(seen_s)
    return field


def training_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, language) pairs of each, chosen by a hash of the id.

    Documents whose crc32(id as text) mod 3 is 1 are held out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # Chosen from ids and lengths; the texts of the chosen are then looked up by id.
    chosen = rows.where(F.length("text").between(1, TRAIN_CHARS)).select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    # At most per_language ids of each language.
    ids = F.broadcast(chosen.select("id").distinct())
    found = rows.where(F.length("text").between(1, TRAIN_CHARS)).join(ids, "id", "left_semi").select("id", "text", "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (str(r["id"]), r["lang"], r["text"]))]


def held_out(id_column) -> F.Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 3 == 1


def classify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id with lang_pred and score.

    Every word with a letter is labelled by forward-backward over the whole
    text, of any length; lang_pred has the largest mean probability, which is
    the score. A text that is null or has no letter is ``und`` with score 0.
    Null ids and repeated rows are classified like others; an empty table gives
    an empty result; other columns are ignored.
    """
    return _verdicts(docs, field, [id_col], text_col).drop("sure").toDF(id_col, "lang_pred", "score")


def _verdicts(docs: DataFrame, field: Field, columns: list[str], text_col: str) -> DataFrame:
    """The named columns as c0, c1, ... (so that no name clashes) with lang_pred, score and sure.

    sure is the mean over the words of each one's largest probability: in
    code-switched text it is high where the score, a language's share, is not.
    """
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS rows of weights
    known: dict[str, int] = {}
    state = {"emission": np.zeros((0, max(1, len(field.labels)))), "chars": 0}

    def run(t: pa.Table) -> pa.Table:
        model: Field = shared.value
        if len(known) > KNOWN or state["chars"] > KNOWN_CHARS:
            known.clear()
            state.update(emission=state["emission"][:0], chars=0)
        lists, new = [], []
        for raw in t[text].cast(pa.binary()).to_pylist() if model.labels else []:
            mine = []
            for w in words_of((raw or b"").decode("utf-8", "replace")):
                k = known.get(w)
                if k is None:
                    # Numerals such as fractions are word characters but no letters.
                    k = known[w] = len(state["emission"]) + len(new) if any(map(str.isalpha, w)) else -1
                    if k >= 0:
                        new.append(w)
                if k >= 0:
                    mine.append(k)
            lists.append(mine)
        if new:
            state["emission"] = np.concatenate([state["emission"], model.emission(new)])
            state["chars"] += sum(map(len, new))
        pred, score, sure = [UNKNOWN] * t.num_rows, np.zeros(t.num_rows), np.zeros(t.num_rows)
        # The longest first, so that texts of like length take their steps together.
        some = sorted((i for i, x in enumerate(lists) if x), key=lambda i: -len(lists[i]))
        while some:
            n, size = 0, 0
            while n < len(some) and (not n or size + len(lists[some[n]]) <= TOGETHER):
                size += len(lists[some[n]])
                n += 1
            part, some = some[:n], some[n:]
            lengths = np.array([len(lists[i]) for i in part])
            total, _, _, most = marginals(state["emission"], np.concatenate([np.array(lists[i], np.int64) for i in part]), lengths, model.steps)
            for i, m, x in zip(part, total / lengths[:, None], most / lengths):
                pred[i], score[i], sure[i] = model.labels[int(m.argmax())], min(1.0, float(m.max())), x
        return pa.table({f"c{k}": t[f"c{k}"] for k in range(len(columns))} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score), "sure": pa.array(sure)})

    def forget() -> None:
        known.clear()
        state.update(emission=state["emission"][:0].copy(), chars=0)

    # The text travels once, also where it is one of the columns.
    text = f"c{columns.index(text_col)}" if text_col in columns else "text"
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], *([] if text_col in columns else [utf8(text_col).alias("text")]))
    schema = ", ".join([*(f"c{k} {types[c]}" for k, c in enumerate(columns)), "lang_pred string", "score double", "sure double"])
    return map_batches(rows, run, schema, 4096, forget)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every document; see ``classify``.

    The field is learned from documents that aren't held out and have a
    language. A null id is held out of neither, and not learned from.
    """
    field = fit(training_texts(docs, id_col, text_col, lang_col))
    out = classify(docs, field, id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, all columns unchanged, whose words' languages are told with a mean probability of ``least`` or more.

    That is each word's own most likely language, so that a text of several
    languages stays. Texts that are null or have no letter go. Where no row has
    a usable label nothing can be told, and every row stays; repeated rows and
    null ids are judged by their texts; an empty table gives an empty result.
    """
    field = fit(training_texts(docs, id_col, text_col, lang_col))
    if not field.labels:
        return docs
    # The text travels with its verdict, so that nothing is joined back by an id.
    out = _verdicts(docs, field, docs.columns, text_col).where((F.col("lang_pred") != UNKNOWN) & (F.col("sure") >= least))
    return out.drop("lang_pred", "score", "sure").toDF(*docs.columns)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
