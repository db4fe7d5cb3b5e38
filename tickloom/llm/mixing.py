"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Every source has a target (its weighted share of all words, at most `max_epochs` times its own words, the excess
reshared) and a schedule, the density 1 + g(2t - 1) over training time t in [0, 1]. Its integral, the source's
cumulative demand (1 - g)t + g t^2, is inverted at each copy's midpoint, which gives the copy its training position;
the corpus is range-sorted by that position.

A source's documents are read in the order of a hash of their id. Running totals are taken in two levels, over
(source, hash bucket) totals and then inside a bucket, so that a source with most of the rows is many tasks.

Defined cases: null text has no words; a null source is a source of its own, last in order; rows with no words or
that the mix does not reach take 0 words and have no position, sorting last; equal rows count as separate
documents; an empty table gives an empty table. Columns of the input are kept; those added are dropped first where
the input has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import word_count

ADDED = ("size", "source_size", "target", "taken", "copies", "position")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", word_count(F.col(text)))


def targets(docs: DataFrame, source: str = "source", weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: its words, weight class and target.

    With r = limit / weight in rising order, sources below the water level take their limit and the rest share what
    is left by weight; the level is the first at which no source that shares stands above its limit. The windows run
    over one row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", "_no").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_ratio", "_no").rowsBetween(0, Window.unboundedFollowing)
    per = docs.groupBy(_key(source).alias("_key"), F.col(source).alias("_source")).agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_no", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    per = per.withColumn("_class", F.col("_no") % len(weights))
    per = per.withColumn("_weight", F.array(*[F.lit(w) for w in weights])[F.col("_class")])
    per = per.withColumn("_limit", F.col("source_size") * max_epochs)
    per = per.withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_weight").over(onward)
    per = per.withColumn("_level", level)
    per = per.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_no", "_level"))).over(every)["_level"])
    share = F.when(F.col("_ratio") <= F.col("_level"), F.col("_limit").cast("double")).otherwise(F.col("_level") * F.col("_weight"))
    return per.select("_key", "source_size", "_class", share.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights=(1, 2, 3), max_epochs: int = 3,
        slopes=(-0.6, 0.0, 0.6), buckets: int = 4096) -> DataFrame:
    """`docs` with a `size` column (see `sized`), plus source_size, target, taken, copies and position.

    A source is read in whole passes while its target allows, then once more up to the remainder: one document of the
    source is cut there, so that the words taken add up to the target to within one word. `copies` counts the passes
    that a document takes part in; `position` is that of its first copy; slopes are the g of the weight classes.
    """
    kept = F.struct(*[c for c in docs.columns if c not in ADDED]).alias("row")
    hashed = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    keys = docs.select(kept, F.col(doc_id).alias("_doc"), "size", _key(source).alias("_key"), hashed.alias("_hash"))
    keys = keys.withColumn("_bucket", F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") % buckets)
    per_bucket = keys.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("_key", "_bucket", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_start"))
    starts = starts.join(targets(docs, source, weights, max_epochs), "_key")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_hash", "_doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keys.join(starts, ["_key", "_bucket"])
    rows = rows.withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(max_epochs))
    rest = F.greatest(F.round(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long"), F.lit(0))
    part = F.greatest(F.least(F.col("_rest") - F.col("_before"), F.col("size")), F.lit(0))
    rows = rows.withColumn("_passes", passes).withColumn("_rest", rest)
    rows = rows.withColumn("_part", F.when(F.col("_passes") < max_epochs, part).otherwise(F.lit(0)))
    rows = rows.withColumn("taken", F.col("size") * F.col("_passes") + F.col("_part"))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("_passes") + (F.col("_part") > 0).cast("long")).otherwise(F.lit(0)))
    first = F.when(F.col("_passes") > 0, F.col("size")).otherwise(F.col("_part"))
    demand = F.least((F.col("_before") + first / 2) / F.col("target"), F.lit(1.0))
    slope = F.array(*[F.lit(float(g)) for g in slopes])[F.col("_class") % len(slopes)]
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, inverted(demand, slope)))
    return rows.select("row.*", *ADDED)


def inverted(demand: Column, slope: Column) -> Column:
    """The time t at which the cumulative demand (1 - g)t + g t^2 reaches `demand`."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * demand)
    return F.when(slope == 0, demand).otherwise((root - (1 - slope)) / (2 * F.when(slope != 0, slope)))


def ordered(mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Training order: a range sort by position, documents that are not taken last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), doc_id)


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
