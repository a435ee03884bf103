"""Mixing sources to target weights by weighted sampling, in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstone.llm.common import SPACES, as_table, documents, word_list

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its own size.
MAX_EPOCHS = 3
#: Bands of keys: so many to each step of the key's logarithm, and each again in so many.
BANDS, FINER = 64, 4096
#: A document's quality weight is never below this.
MIN_QUALITY = 0.05


def quality(text: Column) -> Column:
    """Share of a text's characters in words that are neither digits nor symbols, squared."""
    t = F.coalesce(text, F.lit(""))
    solid = F.translate(t, SPACES, "")
    plain = F.translate(solid, "0123456789#*$%&|<>", "")
    share = F.length(plain) / F.greatest(F.lit(1), F.length(solid))
    return F.greatest(F.lit(MIN_QUALITY), share * share)


def uniform(key: Column, size: Column) -> Column:
    """A number in (0, 1) that any engine gets from the id: md5, first 12 hex digits."""
    text = F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), size.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size).

    The total size is shared by weight; a target stops at max_epochs times its
    source's size and the excess goes to the others by weight, until none is
    above. That is filling to a level: sources are met in the order of
    size / weight, and the first that the level of the rest doesn't fill up
    ends it. One row per source is ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * max_epochs
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    filled = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum(cap).over(by_cap), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(by_cap), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    # The first source in that order that keeps below its cap; later ones have lower levels.
    fits = filled.withColumn("level", F.max(F.when(level <= cap / F.col("weight"), level)).over(everything))
    return fits.select("source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    weight_of: Column | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    A source's target is met by whole epochs of all its documents first. The
    rest is a weighted sample without replacement: a document of quality w gets
    the key -ln(u) / w, and documents come in the order of their keys while
    their sizes' prefix sum is within the rest (the one that crosses it is
    taken if that comes nearer). taken counts words, repeats included.

    Null texts have size 0 and are never short of their target; null sources
    are one source, the last; null ids and repeated rows are documents like
    others; texts of any length are read as a whole; an empty table gives an
    empty result. Other columns are ignored. No source is ordered or moved:
    see ``cutoffs``.
    """
    rows = as_table(keyed(docs, id_col, text_col, source_col, weight_of), "keys")
    out = drawn(rows, cutoffs(rows, weights), ["id"])
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def words_in(text_col: str) -> Column:
    return F.size(word_list(F.col(text_col).cast("string"))).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_of: Column | None = None, keep: bool = False) -> DataFrame:
    """id, source, size and key of every row; ``keep``: beside its own columns."""
    w = weight_of if weight_of is not None else quality(F.col(text_col).cast("string"))
    rows = docs.select(*(docs.columns if keep else []), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), w.alias("w"))
    return rows.withColumn("key", -F.log(uniform(F.col("id"), F.col("size"))) / F.col("w")).drop("w")


def cutoffs(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source (s1): source_size, target, epochs, and the key ``cut`` up to which documents are taken once more.

    The documents that a prefix sum takes are those before one key. Sizes are
    summed by bands of keys (added up before the shuffle) and the bands'
    prefix sums show the one that crosses the rest; that is done again with
    finer bands, and then with the few keys left. No source is ordered. Keys
    below ``cut`` are taken, those above not; of the ``ties`` rows at it the
    sums ``start`` with; ``at_cut`` is the verdict if it is one row.
    """
    whole = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(whole, weights).withColumnRenamed("source", "s1")
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("start", F.lit(0).cast("long"))
    plan = as_table(plan, "targets")
    place = F.log("key") * BANDS
    band = F.floor(place)
    finer = F.floor((place - band) * FINER)
    step = plan
    for name, by in (("band", band), ("finer", finer), ("cut", F.col("key"))):
        sums = rows.withColumn(name, by) if name != "cut" else rows.withColumn("cut", F.col("key"))
        # Only what lies in the band found so far.
        inside = F.col("source").eqNullSafe(F.col("s1"))
        for found, value in (("band", band), ("finer", finer)):
            if found in step.columns:
                inside &= value == F.col(f"{found}")
        met = sums.withColumnRenamed(name, f"{name}_").join(step, inside)
        totals = met.groupBy("s1", f"{name}_").agg(F.sum("size").alias("all"), F.count("*").alias("ties"))
        before = Window.partitionBy("s1").orderBy(f"{name}_").rowsBetween(Window.unboundedPreceding, -1)
        upto = totals.withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0)))
        base = step.select(F.col("s1").alias("s2"), F.col("start").alias("base"), "rest")
        crossed = upto.join(base, F.col("s1").eqNullSafe(F.col("s2"))).where(F.col("base") + F.col("before") + F.col("all") > F.col("rest"))
        first = crossed.groupBy("s2").agg(F.min(F.struct(F.col(f"{name}_").alias("at"), (F.col("base") + F.col("before")).alias("start"), "ties", "all")).alias("x"))
        first = first.select(F.col("s2").alias("s3"), F.col("x.at").alias(name), F.col("x.start").alias("start"), F.col("x.ties").alias("ties"), F.col("x.all").alias("all"))
        step = as_table(step.drop("start", "ties", "all").join(first, F.col("s1").eqNullSafe(F.col("s3"))).drop("s3"), "crossed")
    cut = step.select(F.col("s1").alias("s4"), "cut", "start", "ties", (F.col("start") + F.col("all") / 2 <= F.col("rest")).alias("at_cut"))
    return as_table(plan.drop("start").join(cut, F.col("s1").eqNullSafe(F.col("s4")), "left").drop("s4"), "cutoffs")


def drawn(rows: DataFrame, cuts: DataFrame, order: list[str]) -> DataFrame:
    """rows(source, size, key, ...) with their source's target and ``times``, how often the mix takes each.

    A row is compared with its source's cutoff, one row per source. Several
    rows at the cutoff itself have one key (repeated rows, null ids of one
    size): these alone are ordered, by ``order`` and size.
    """
    met = rows.join(cuts, F.col("source").eqNullSafe(F.col("s1")))
    tied = (F.col("key") == F.col("cut")) & (F.col("ties") > 1)
    more = F.when(F.col("cut").isNull() | (F.col("key") < F.col("cut")), 1).when((F.col("key") == F.col("cut")) & F.col("at_cut"), 1).otherwise(0)
    if cuts.where("ties > 1").isEmpty():
        return met.withColumn("times", F.col("epochs") + more)
    upto = F.col("start") + F.coalesce(F.sum("size").over(Window.partitionBy("s1").orderBy(*order, "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = met.where(tied).withColumn("upto", upto).withColumn("times", F.col("epochs") + (F.col("upto") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("upto")
    return met.where(~F.coalesce(tied, F.lit(False))).withColumn("times", F.col("epochs") + more).unionByName(some)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs as the mix takes them: each row as often as ``mix`` says, those not taken left out.

    Rows are judged where they lie, against their source's cutoff, so that no
    text is moved and null and repeated ids do no harm. An empty table gives
    an empty result; all columns are kept unchanged.
    """
    cuts = cutoffs(as_table(keyed(docs, id_col, text_col, source_col), "keys"), weights)
    # Columns by number, so that no name clashes.
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = keyed(docs.toDF(*names.values()), names[id_col], names[text_col], names[source_col], keep=True)
    taken = drawn(rows, cuts, ["id", names[text_col]]).where("times > 0")
    again = taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return again.select(*[F.col(n).alias(c) for c, n in names.items()])


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS solid,
         length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D0-9#*$%&|<>]', '', 'g')) AS plain
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || size::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
           / greatest({MIN_QUALITY}::DOUBLE, (plain::DOUBLE / greatest(1, solid)) * (plain::DOUBLE / greatest(1, solid))) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS weight FROM s
), c AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum({MAX_EPOCHS} * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY {MAX_EPOCHS} * source_size::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max((total - cap_before)::DOUBLE / (all_weight - weight_before))
    FILTER ((total - cap_before)::DOUBLE / (all_weight - weight_before) <= {MAX_EPOCHS} * source_size::DOUBLE / weight) AS level FROM c
), t AS (
  SELECT source, source_size, least({MAX_EPOCHS} * source_size::DOUBLE, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM c, l
), e AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + (upto + size / 2 <= rest)::INT))::BIGINT AS taken FROM p
"""
