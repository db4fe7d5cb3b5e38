"""As-of alignment: irregular series onto bars with one sort, never a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Carry, Series, add
from tickloom.functions.scalar import clip, flag, seconds


def as_of(left: DataFrame, right: DataFrame, values: Sequence[str], keys: Sequence[str] = ("pair",),
          on: str = "ts", backfill: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Each left row takes the last non-null right value at or before it.

    ``backfill`` also fills the head from the first later value, which looks ahead.
    ``tie`` orders right rows of equal time; the last one wins.
    """
    cols = left.columns
    stacked = (
        left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*cols).alias("_left"),
                    *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in tie],
                    *[F.lit(None).cast(right.schema[v].dataType).alias(f"_r_{v}") for v in values])
        .unionByName(
            right.select(*keys, on, F.lit(0).alias("_side"), *tie,
                         *[F.col(v).alias(f"_r_{v}") for v in values]),
            allowMissingColumns=True))
    s = Series.of(stacked, keys, [on, "_side", *tie])
    s = s.apply(Carry({v: ("last", F.col(f"_r_{v}")) for v in values}))
    if backfill:
        s = s.apply(Carry({f"_next_{v}": ("last", F.col(f"_r_{v}")) for v in values}, reverse=True))
    out = [F.coalesce(v, f"_next_{v}").alias(v) if backfill else F.col(v) for v in values]
    return s.df.where("_side = 1").select("_left.*", *out)


def event_distances(bars: DataFrame, events: DataFrame, buffer_min: float = 15.0,
                    horizon_min: float = 1440.0) -> DataFrame:
    """Minutes to the next event after, and since the last event at or before, each time, and its surprise.

    Events concern the whole market, so the work is done once per distinct bar time.
    ``events``: ts, actual, forecast, prior, event_id; of equal times the highest id counts.
    """
    times = bars.select("ts").distinct()
    surprise = F.when(F.abs("prior") > 1e-9, clip((F.col("actual") - F.col("forecast")) / F.abs("prior"), -5.0, 5.0))
    hits = events.select("ts", "event_id", F.struct(
        F.col("ts").alias("at"), surprise.alias("s"), (F.col("actual") - F.col("forecast")).alias("raw")).alias("hit"))
    stacked = (times.withColumn("_side", F.lit(1))
                    .unionByName(hits.withColumn("_side", F.lit(0)), allowMissingColumns=True))
    s = Series.of(stacked, [], ["ts", "_side", "event_id"]).apply(
        Carry({"_last": ("last", F.col("hit"))}),
        Carry({"_next": ("last", F.col("hit.at"))}, reverse=True))
    ahead = (seconds(F.col("_next")) - seconds(F.col("ts"))) / 60
    since = (seconds(F.col("ts")) - seconds(F.col("_last.at"))) / 60
    far = F.lit(horizon_min)
    near = s.df.where("_side = 1").select(
        "ts",
        F.coalesce(clip(ahead, 0.0, horizon_min), far).alias("eco_minutes_to_next"),
        F.coalesce(clip(since, 0.0, horizon_min), far).alias("eco_minutes_since_last"),
        F.coalesce("_last.s", F.lit(0.0)).alias("eco_surprise_norm"),
        F.coalesce("_last.raw", F.lit(0.0)).alias("eco_surprise"),
        flag((ahead <= buffer_min) | (since <= buffer_min)).alias("eco_release_flag"))
    return bars.join(near, "ts")


def blackout(bars: DataFrame, events: DataFrame, buffer_min: float = 15.0) -> DataFrame:
    """news_ok = 0 within the buffer of any event, both ends included, else 1."""
    near = event_distances(bars, events, buffer_min)
    hit = (F.col("eco_minutes_to_next") <= buffer_min) | (F.col("eco_minutes_since_last") <= buffer_min)
    return near.withColumn("news_ok", 1.0 - flag(hit)).select(*bars.columns, "news_ok")


def fill_forward(left: DataFrame, right: DataFrame, values: Sequence[str], keys: Sequence[str] = ("pair",),
                 on: str = "ts") -> DataFrame:
    """Exact-key lookup, then the last found value carries forward."""
    found = left.join(right.select(*keys, on, *values), [*keys, on], "left")
    s = Series.of(found, keys, [on]).apply(Carry({f"_f_{v}": ("last", F.col(v)) for v in values}))
    return s.df.withColumns({v: F.col(f"_f_{v}") for v in values}).drop(*[f"_f_{v}" for v in values])


def delayed(s: Series, signal: str, bars: int, out: str = "executed") -> Series:
    """Signal seen ``bars`` rows later; the first rows see the first signal."""
    first = F.when(F.col("_i") == 1, F.col(signal))
    return (s.indexed("_i").apply(
        add(bars, lambda w: {"_lagged": F.lag(signal, bars).over(w)}),
        Carry({"_first": ("last", first)}))
        .map(lambda f: f.withColumn(out, F.when(F.col("_i") <= bars, F.col("_first"))
                                          .otherwise(F.col("_lagged")))
                        .drop("_lagged", "_first", "_i")))
