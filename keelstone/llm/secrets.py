"""Secret scans with a random forest against false findings, in DataFrame functions."""

from __future__ import annotations

import random
import string

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm.common import as_table, documents

# Words that name a secret, words of paths that hold none, words
# that candidates which are names rather than secrets are made of, and common
# letter pairs of prose.
NAMING = "key|token|secret|passw|passphrase|pwd|auth|credential|bearer"
HARMLESS_PATHS = "test|example|sample|doc|fixture|mock"
DICTIONARY = "index|image|file|page|user|mail|table|version|data|date|time|http|https|www|com|org|net|html|example|sample|test|demo|config|default|value|number|name|report|final|draft|copy|model|release|update|server|host|local|media|photo|video|chapter|section|figure|group|order|invoice|phone|street|null|none|true|false|required|your|here|change|windows|street"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|ch|ll|be|ma|si|om|ur"

#: What a candidate can be, each as (what stands before it, itself). Every
#: expression takes time in proportion to the text, however long a run is.
SHAPES = {
    # The value assigned to a naming word, whatever it is made of.
    "assigned": (f"(?i:{NAMING})[A-Za-z_-]{{0,20}}[\"']?\\s{{0,3}}[:=]\\s{{0,3}}[\"']?", "[^\\s\"'`,;<>()]{4,}+"),
    # The password of a connection string.
    "connection": ("://[^\\s:/@\"']{1,64}:", "[^\\s@/\"']{3,}+(?=@)"),
    # A private key, header to footer.
    "block": ("", "-----BEGIN [A-Z ]{0,30}+PRIVATE KEY-----(?:[A-Za-z0-9+/=\\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"),
    # A run of 16 or more key characters with a digit, or a capital behind a small letter.
    "run": ("(?<![A-Za-z0-9+/_.~-])", "(?=[A-Za-z+/_.~-]*+[0-9]|[A-Z0-9+/_.~-]*+[a-z][a-z0-9+/_.~-]*+[A-Z])[A-Za-z0-9+/_.~-]{16,}+={0,2}"),
    # A run of 8 or more with a digit, a small letter and a capital.
    "mixed": (
        "(?<![A-Za-z0-9!@#$%^&*+/_.~-])",
        "(?=[A-Za-z!@#$%^&*+/_.~-]*+[0-9])(?=[A-Z0-9!@#$%^&*+/_.~-]*+[a-z])(?=[a-z0-9!@#$%^&*+/_.~-]*+[A-Z])[A-Za-z0-9!@#$%^&*+/_.~-]{8,}+",
    ),
}
CANDIDATE = "|".join(f"({before})({itself})" for before, itself in SHAPES.values())
#: Signs that stand around a candidate while a text is taken apart; in the text itself they count as spaces.
OPEN, SHUT = "\x01", "\x02"
#: Characters on either side of a candidate that are looked at as its neighbours.
AROUND = 80
MARK = "[SECRET]"
MIN_SCORE = 0.5
#: Size of the forest, and of the labelled findings that it is trained on.
TREES, DEPTH, FINDINGS = 32, 9, 4000

FEATURES = ["f_length", "f_digits", "f_upper", "f_symbols", "f_distinct", "f_runs", "f_hex", "f_pairs", "f_vowels", "f_covered", "f_longest", "f_path", "f_before", "f_assigned", "f_after", "f_connection", "f_block"]


def plain(text: Column) -> Column:
    return F.translate(text.cast("string"), OPEN + SHUT, "  ")


def pieces(text: Column) -> Column:
    """The text cut at its candidates: what lies between them at even places, candidates at odd ones."""
    each = range(1, 2 * len(SHAPES) + 1, 2)
    put = "".join(f"${i}" for i in each) + OPEN + "".join(f"${i + 1}" for i in each) + SHUT
    return F.split(F.regexp_replace(plain(text), CANDIDATE, put), f"[{OPEN}{SHUT}]")


def text_key(path: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(path, F.lit("")), F.lit(OPEN), text))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """A row per candidate: id, text_key, path, ordinal, candidate, before, after.

    A candidate is what one of SHAPES finds, the first in its order where they
    begin at one place; ordinal counts a text's candidates from 0. before holds
    up to two words, after up to one, and what is glued to the candidate.
    Texts without a candidate go after one pass of the expressions.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(plain(F.col("text")).rlike(CANDIDATE)).select("id", "path", text_key(F.col("path"), F.col("text")).alias("text_key"), pieces(F.col("text")).alias("pieces"))
    at = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))

    def found(i: Column) -> Column:
        before = F.regexp_extract(F.right(at(i - 1), F.lit(AROUND)), "(?:\\S+\\s+){0,2}\\S*\\z", 0)
        after = F.regexp_extract(F.left(at(i + 1), F.lit(AROUND)), "\\A\\S*\\s*\\S*", 0)
        return F.struct(((i - 1) / 2).cast("int").alias("ordinal"), at(i).alias("candidate"), before.alias("before"), after.alias("after"))

    # Each candidate takes its neighbours along, so that no row holds the whole text again.
    hits = rows.select("id", "path", "text_key", F.explode(F.transform(F.sequence(F.lit(1), F.size("pieces") - 2, F.lit(2)), found)).alias("f"))
    return hits.select("id", "path", "text_key", "f.*")


def described(rows: DataFrame) -> DataFrame:
    """rows(candidate, before, after, path) with the numbers in FEATURES."""
    rows = rows.withColumn("_c", F.col("candidate")).withColumn("_l", F.lower("_c"))
    n = F.length("_c")
    without = lambda col, p: F.length(F.regexp_replace(col, p, ""))
    letters = F.greatest(F.lit(1), F.length(F.regexp_replace("_l", "[^a-z]", "")))
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace("_c", "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    before = F.lower(F.coalesce("before", F.lit("")))
    longest = F.array_max(F.transform(F.split("_l", "[^a-z]+"), lambda x: F.length(x)))
    return rows.select(
        *[x for x in rows.columns if x not in ("_c", "_l")],
        F.length("candidate").cast("double").alias("f_length"),
        (1 - without("_c", "[0-9]") / n).alias("f_digits"),
        (1 - without("_c", "[A-Z]") / n).alias("f_upper"),
        (without("_c", "[A-Za-z0-9]") / n).alias("f_symbols"),
        (F.size(F.array_distinct(F.split("_c", ""))) / F.least(n, F.lit(40))).alias("f_distinct"),
        (F.length(runs) / n).alias("f_runs"),
        flag(F.col("_l").rlike("^[0-9a-f]+$") & F.col("_l").rlike("[a-f]")).alias("f_hex"),
        ((letters - F.length(F.regexp_replace(F.regexp_replace("_l", "[^a-z]", ""), PAIRS, ""))) / letters).alias("f_pairs"),
        ((letters - F.length(F.regexp_replace(F.regexp_replace("_l", "[^a-z]", ""), "[aeiou]", ""))) / letters).alias("f_vowels"),
        ((F.length("_l") - without("_l", DICTIONARY)) / n).alias("f_covered"),
        (longest / n).cast("double").alias("f_longest"),
        flag(F.lower("path").rlike(HARMLESS_PATHS)).alias("f_path"),
        flag(before.rlike(NAMING)).alias("f_before"),
        flag(before.rlike("[=:]\\W*$")).alias("f_assigned"),
        flag(F.lower(F.coalesce("after", F.lit(""))).rlike(NAMING)).alias("f_after"),
        flag(before.rlike("://[^\\s/]*:$")).alias("f_connection"),
        flag(F.col("_c").startswith("-----BEGIN")).alias("f_block"),
    )


def labelled_findings(count: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label) made by rule, half of them secrets (label 1).

    Secrets: random hex, base64 and letter-digit keys, with and without prefix,
    also without a digit, mostly behind a naming word; passwords of mixed or
    altered words that are assigned or stand in connection strings; private
    keys. False findings: numbers, dates, host names, file names, identifiers,
    placeholders, runs, repeats and prose words with digits, some of them
    behind a naming word too; plain words assigned to one; product names.
    """
    rnd = random.Random(seed)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    syllables = ["ta", "re", "on", "mi", "lo", "ver", "ent", "sch", "ion", "que", "al", "der", "ing", "os", "pa", "thi", "ou", "en"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    named = DICTIONARY.split("|")
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    altered = lambda: word().capitalize().translate(str.maketrans("aeos", "430$")) + pick("!&#_.%", rnd.randint(0, 2)) + pick(digits + "!?", rnd.randint(1, 4))
    jumbled = lambda: pick(upper + lower + digits + "!@#$%^&*", rnd.randint(8, 15))
    keys = [
        lambda: pick("0123456789abcdef", rnd.choice([32, 40, 40, 64, 24])),
        lambda: pick(upper + lower + digits + "+/", rnd.choice([24, 40, 44, 64])) + rnd.choice(["", "=", "=="]),
        lambda: rnd.choice(["AKIA", "ASIA"]) + pick(upper + digits, 16),
        lambda: rnd.choice(["ghp_", "sk-", "xoxb-", "pk_live_", "glpat-", ""]) + pick(upper + lower + digits, rnd.choice([20, 36, 48])),
        lambda: "eyJ" + pick(upper + lower + digits + "_-", 30) + "." + pick(upper + lower + digits + "_-", 40) + "." + pick(upper + lower + digits + "_-", 43),
        lambda: pick(upper + lower, rnd.choice([16, 20, 24, 32])),
        lambda: pick("0123456789abcdef", 40),
    ]
    short = [altered, jumbled, lambda: pick(lower + digits, rnd.randint(8, 15)), lambda: pick(upper + lower + digits, rnd.randint(8, 15)), lambda: word().capitalize() + pick(digits, 4) + "!"]
    runs = [
        lambda: pick(digits, rnd.randint(16, 24)),
        lambda: f"20{pick(digits, 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)}T1{pick(digits, 1)}.{pick('012345', 1)}{pick(digits, 1)}.00",
        lambda: f"{rnd.choice(['mail', 'www', 'host'])}{pick(digits, rnd.randint(1, 3))}.{word()}.{rnd.choice(['com', 'org', 'example.com', 'example.net'])}",
        lambda: f"{word()}.{pick(digits, 2)}.{rnd.choice(named)}.{word()}{word()}",
        lambda: "_".join([rnd.choice(named), word(), pick(digits, rnd.randint(1, 4)), rnd.choice(named), word()]),
        lambda: "-".join([word(), word(), rnd.choice(named), word(), pick(digits, rnd.randint(1, 6))]) + rnd.choice(["", ".png", ".html", ".txt"]),
        lambda: pick("xX0", 1) * rnd.randint(12, 20) + pick(digits, 4),
        lambda: (word() + word() + word() + word() + word())[: rnd.randint(15, 30)] + pick(digits, rnd.randint(1, 3)),
        lambda: f"{word()}{word()}{pick('=/-', 3)}{word()}{word()}.{pick(digits, 1)}",
        lambda: ".".join(pick(digits, rnd.randint(1, 3)) for _ in range(6)),
        lambda: pick(lower + upper, 1) * rnd.choice([16, 30, 90, 700]) + pick(digits, rnd.randint(1, 3)),
        lambda: (word() + pick(digits, 1) + word()) * rnd.choice([3, 8, 90]),
        lambda: "".join([word(), rnd.choice(named).capitalize(), word().capitalize(), rnd.choice(named).capitalize(), word().capitalize()]),
        lambda: "/".join([word(), word().capitalize(), rnd.choice(named), word() + word(), word().capitalize()]),
    ]
    plain = [
        word, lambda: word() + word(), lambda: rnd.choice(named), lambda: rnd.choice(["null", "none", "true", "false", "required", "changeme", "xxxxxxxx", "********", "your-key-here", "optional", "string", "hidden"]),
        lambda: f"{rnd.choice(named)}_{word()}", lambda: f"${{{word().upper()}_{rnd.choice(named).upper()}}}", lambda: pick(digits, rnd.randint(4, 6)), lambda: f"{word()}.{word()}", lambda: f"get_{word()}_{rnd.choice(named)}",
    ]
    product = [lambda: f"{word().capitalize()}{pick(digits, rnd.randint(1, 2))}{word().capitalize()}{word()}", lambda: f"{pick(upper, 2)}-{pick(digits, 4)}{pick(lower, 1)}-{word()}", lambda: f"{word().capitalize()}{word()}{pick('19', 1)}{pick(digits, 3)}", lambda: f"{word()}.{pick(digits, 2)}@mail{pick(digits, 1)}.{word()}.Com", lambda: f"{word().capitalize()}.{pick(digits, 1)}.{word().capitalize()}"]
    block = lambda: "-----BEGIN " + rnd.choice(["RSA ", "EC ", "OPENSSH ", ""]) + "PRIVATE KEY-----" + rnd.choice(["", "\n" + pick(upper + lower + digits + "+/", 64) + "\n" + pick(upper + lower + digits + "+/", 40) + "=\n-----END PRIVATE KEY-----"])
    names = lambda: f"{word()} {rnd.choice(['token', 'api_key', 'secret', 'password', 'auth', 'DB_PASSWORD', 'passwd', 'secretKey'])}{rnd.choice([' = ', ': ', '=', ' : '])}{rnd.choice(['', chr(34), chr(39)])}"
    prose = lambda: f"{word()} {word()} {rnd.choice(['', '=', '(', chr(34)])}"
    link = lambda: f"{rnd.choice(['postgres', 'mysql', 'redis', 'amqp', 'https'])}://{word()}:"
    one = lambda many: rnd.choice(many)()
    places = ["", "web", "crawl", "docs/guide", "tests/fixtures", "app/main"]
    out = []
    for i in range(count):
        r = rnd.random()
        if label := i % 2:
            text, before = (one(keys), names() if rnd.random() < 0.8 else prose()) if r < 0.55 else (one(short), names()) if r < 0.78 else (one(short + keys), link()) if r < 0.9 else (block(), prose())
        else:
            text, before = (one(runs), names() if rnd.random() < 0.1 else prose()) if r < 0.55 else (one(plain), names()) if r < 0.8 else (one(product), prose()) if r < 0.95 else (one([lambda: "password", lambda: "pass", lambda: "<password>", lambda: "${PASSWORD}", lambda: "xxxx", lambda: "8080"]), link())
        out.append((text, before, word(), rnd.choice(places), label))
    return out


def train(spark: SparkSession, findings: DataFrame | None = None) -> RandomForestClassificationModel:
    """A forest fitted on findings(candidate, before, after, path, label); by default on those made by rule."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "candidate string, before string, after string, path string, label int").coalesce(1)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=13)
    stages = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest])
    return stages.fit(described(findings).withColumn("label", F.col("label").cast("double"))).stages[-1]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """A row per candidate: id, text_key, ordinal, candidate, score, is_secret.

    score is the forest's share of votes that the candidate is a secret;
    is_secret: MIN_SCORE or more. Null and empty texts have no candidates, a
    null path is a path without a word, null ids and repeated rows are scanned
    like others, texts and candidates of any length are read as a whole, an
    empty table gives an empty result, other columns are ignored. Nothing but
    finding rows leaves the scan, and no row needs another one, so there is no
    shuffle.
    """
    model = model or train(docs.sparkSession)
    rows = described(candidates(docs, id_col, text_col, path_col))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.select("id", "text_key", "ordinal", "candidate", score.alias("score"), (score >= MIN_SCORE).alias("is_secret"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", size_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret in the text replaced by MARK, and size_col set to the new length.

    Secrets are replaced where they were found and nowhere else (and the two
    control characters OPEN and SHUT by spaces in a text with one). All rows stay;
    rows without a secret are unchanged, null and empty texts among them. Texts
    meet their findings by a digest of path and text, so that null and repeated
    ids do no harm; an empty table gives an empty result.
    """
    spots = as_table(scan(docs, id_col, text_col, path_col).where("is_secret").select("text_key", "ordinal").distinct(), "secrets")
    own = spots.groupBy("text_key").agg(F.collect_set("ordinal").alias("_secrets"))
    # Columns by number, so that no name clashes.
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    text = F.col(names[text_col])
    key = text_key(F.col(names[path_col]).cast("string"), text.cast("string"))
    joined = docs.toDF(*names.values()).join(own, key == F.col("text_key"), "left")
    hidden = lambda p, i: F.when((i % 2 == 1) & F.array_contains("_secrets", ((i - 1) / 2).cast("int")), F.lit(MARK)).otherwise(p)
    clean = F.array_join(F.transform(pieces(text), hidden), "")
    out = {c: F.col(n) for c, n in names.items()}
    out[text_col] = F.when(F.col("_secrets").isNull(), text).otherwise(clean)
    if size_col in names:
        out[size_col] = F.when(F.col("_secrets").isNull(), out[size_col]).otherwise(F.length(clean).cast(docs.schema[size_col].dataType))
    return joined.select(*[v.alias(c) for c, v in out.items()])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document by id, number, length and digest, with score and verdict."""
    found = scan(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "ordinal", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
