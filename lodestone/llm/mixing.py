"""Mixing sources to target weights.

Sizes are summed per source; targets follow the weights and stop at a multiple of what the source
holds, the excess being shared again by weight. A document is emitted floor(rate) times plus one
copy whose hash-seeded Bernoulli draw succeeds with the fraction as its probability.

Sharing again until no target is above its limit has a closed form: targets are
min(limit, level x weight), so with sources in order of limit / weight, those up to some place are
full and the rest share what is left. Running sums over that order, one row per source, find it.

Defined results: null text has size 0; null source is a source, last in order; rows with a null or
repeated id are rows like any other (equal ids draw alike); an empty table gives no rows; a source
without words has target 0 and rate 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import trimmed, words

#: Production parameters: weights by place in code-point order, repeating; share of all sizes; limit of a source in its own sizes.
WEIGHTS, SHARE_PERCENT, MOST_REPEATS, SEED = (3, 1, 2), 150, 2, "mix-1"


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("_source"), trimmed(F.col(text_col)).alias("_t"), *more)
    return t.withColumn("size", F.when(F.col("_t") == "", 0).otherwise(F.size(words(F.col("_t")))).cast("long")).drop("_t")


def source_targets(per_source: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT, most=MOST_REPEATS) -> DataFrame:
    """(_source, source_size) to (_source, source_size, target). One row per source passes its windows."""
    place = W.orderBy(F.col("_source").asc_nulls_last())
    s = per_source.withColumn("_place", (F.row_number().over(place) - 1) % len(weights))
    s = s.withColumn("_weight", F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("_place") + 1).cast("long"))
    s = s.withColumn("_limit", most * F.col("source_size"))
    everything = W.partitionBy(F.lit(1))
    order = W.orderBy(F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("_total", F.sum("source_size").over(everything) * (share_percent / 100.0))
    level = (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_weight").over(after)
    s = s.withColumn("_level", level)
    # the first place whose level does not exceed its limit decides for itself and all after it
    s = s.withColumn("_fits", F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.col("_level")))
    chosen = F.first("_fits", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return s.select("_source", "source_size", F.coalesce(F.least(chosen * F.col("_weight"), F.col("_limit").cast("double")), F.col("_limit").cast("double")).alias("target"))


def draw(seed: str = SEED):
    """A number in [0, 1) from the document's id: 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def planned(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", *more) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, and the columns in more."""
    d = sizes(docs, id_col, text_col, source_col, *more)
    per_source = sizes(docs, id_col, text_col, source_col).groupBy("_source").agg(F.sum("size").alias("source_size"))
    t = source_targets(per_source).withColumnRenamed("_source", "_of")
    j = d.join(t, d["_source"].eqNullSafe(t["_of"]), "left")  # few rows per source: broadcast below Spark's limit, else a join that splits hot sources
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    j = j.withColumn("_rate", rate)
    return j.withColumn("copies", (F.floor("_rate") + (draw() < F.col("_rate") - F.floor("_rate")).cast("long")).cast("long")).drop("_source", "_of", "_rate")


def mixture(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix takes it."""
    p = planned(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return p.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
