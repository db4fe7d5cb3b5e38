"""The block layout gives the results of one window per key."""

import random

import pytest
from conftest import SF
from oracle import _cell
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.core.series import Carry, Series, Step, add, number_rows, rolling, windowed_sums
from tickloom.operators import asof, features as W

# One query per way of using a series: frames back and ahead, carries both ways, positions, joins.
NAMES = ["repair_spikes", "quality_report", "chronological_split", "event_distances", "as_of_join_backfilled",
         "fill_forward", "delayed_signal", "macd", "rsi", "fractional_difference", "options_proxies", "correlation_regime",
         "triple_barrier", "reward_labels", "walk_forward_folds", "contrastive_partners", "equity_curve",
         "compounded_curve", "rolling_trade_stats", "demotion", "page_hinkley_first", "ks_two_sample",
         "monte_carlo_shuffle", "monte_carlo_bootstrap", "alert_cooldown", "order_book", "population_stability", "standard_scaling", "recency_bias", "sequences", "rolling_hurst"]


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())


def _close(a, b):
    if a == b:
        return True
    return a[0] == b[0] == 2 and abs(float(a[1]) - float(b[1])) <= 2e-6 * max(1.0, abs(float(a[1])))


@pytest.mark.parametrize("name", NAMES)
def test_query_in_blocks(spark, name):
    fn = entry.queries()[name]
    whole = _rows(fn(spark, SF))
    spark.conf.set("spark.tickloom.blockRows", "64")
    try:
        split = _rows(fn(spark, SF))
    finally:
        spark.conf.unset("spark.tickloom.blockRows")
    assert len(whole) == len(split)
    bad = [(a, b) for a, b in zip(whole, split) if not all(_close(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:2]


def _skewed(spark, n=3000):
    """One key with most rows, all of its rows at three times, a lone row in another key, and a null key."""
    rng = random.Random(3)
    rows = [("hot", i % 3, i, rng.random() if i % 7 else None) for i in range(n)]
    rows += [("b", i, i, rng.random()) for i in range(40)] + [("one", 0, 0, 1.0)] + [(None, i, i, 2.0) for i in range(5)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "pair string, ts int, id int, x double").repartition(7)


def test_row_numbers_with_ties_and_skew(spark):
    got = number_rows(_skewed(spark), ["pair"], ["ts", "id"]).select("pair", "ts", "id", "_rn").collect()
    by = {}
    for r in got:
        by.setdefault(r.pair, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"hot": 3000, "b": 40, "one": 1, None: 5}
    for rows in by.values():
        rows.sort(key=lambda r: (r.ts, r.id))
        assert [r._rn for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("rows", [16, 100])
def test_steps_and_carries(spark, rows):
    steps = [add(29, lambda w: {"m": rolling(F.avg, F.col("x"), w, 30, 5)}),
             Step(lambda f, w: f.withColumn("d", F.col("m") - F.lag("m", 3).over(w)), before=3),
             add(0, lambda w: {"ahead": F.sum("x").over(w.rowsBetween(1, 12))}, after=12),
             Carry({"s": ("sum", F.col("x")), "n": ("count", F.col("x")), "hi": ("max", F.col("x")),
                    "lo": ("min", F.col("x")), "l": ("last", F.col("x"))}),
             Carry({"rs": ("sum", F.col("x")), "rl": ("last", F.col("x"))}, reverse=True)]
    df = _skewed(spark)
    run = lambda b: windowed_sums(Series.of(df, ["pair"], ["ts", "id"], b).apply(*steps),
                                  {"w": (F.col("x"), 25)}).df
    whole, split = _rows(run(None)), _rows(run(rows))
    assert len(whole) == len(split)
    assert all(_close(x, y) for a, b in zip(whole, split) for x, y in zip(a, b))


def test_ewm_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    x = np.random.default_rng(1).normal(1.0, 0.01, 4000).cumsum()
    pdf = pd.DataFrame({"pair": "p", "ts": range(4000), "close": x})
    out = W.macd(Series.of(spark.createDataFrame(pdf), ["pair"], ["ts"])).df.orderBy("ts").toPandas()
    line = pdf.close.ewm(span=12, adjust=False).mean() - pdf.close.ewm(span=26, adjust=False).mean()
    assert np.abs(out.macd - line).max() < 1e-9
    assert np.abs(out.macd_sig - line.ewm(span=9, adjust=False).mean()).max() < 1e-9


def test_as_of_ties_take_the_last(spark):
    left = spark.createDataFrame([("p", 1), ("p", 5)], "pair string, ts int")
    right = spark.createDataFrame([("p", 1, 1, 10.0), ("p", 1, 2, 20.0), ("p", 6, 1, 30.0)], "pair string, ts int, seq int, v double")
    got = {r.ts: r.v for r in asof.as_of(left, right, ["v"], tie=["seq"]).collect()}
    assert got == {1: 20.0, 5: 20.0}
