"""Ticks to OHLCV bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bar_aggregates(order: Column) -> list[Column]:
    return [
        F.min_by("mid", order).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.avg("spread").alias("spread_avg"),
        F.max_by("bid", order).alias("bid_close"),
        F.max_by("ask", order).alias("ask_close"),
        F.count(F.lit(1)).alias("n_ticks"),
    ]


def to_bars(ticks: DataFrame, freq: str = "1 minute", tie: str | None = None) -> DataFrame:
    """One bar per pair and non-empty bin, left-closed and left-labelled.

    With unique times per pair the order is the time alone, a fixed-width buffer that
    keeps both aggregation phases hash based; ``tie`` names a column that orders equal times.
    """
    order = F.struct("ts", tie) if tie else F.col("ts")
    return (ticks.groupBy("pair", F.window("ts", freq).alias("w"))
                 .agg(*bar_aggregates(order))
                 .select("pair", F.col("w.start").alias("ts"), "open", "high", "low", "close",
                         "volume", "spread_avg", "bid_close", "ask_close", "n_ticks"))
