"""What a query does with rows that are many: pieces, slices and stage tables."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.core import series
from tickloom.core.series import Carry, Series, add
from tickloom.operators import distribution as D, performance as P, risk as R
from tickloom.streaming import guards as G


# --- simulations ----------------------------------------------------------------

def test_a_long_key_is_reordered_in_memory(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("every trade of every path would be written")
    monkeypatch.setattr(D, "simulated_paths", refused)
    n = (1 << 20) + 5
    trades = spark.range(n).select(F.lit("a").alias("strategy"), F.col("id").alias("trade_id"), (F.pmod(F.col("id") * 37, F.lit(101)) - 50.0).alias("pnl"))
    got = D.simulations(trades, ["strategy"], "trade_id", "pnl", 2, chunk=1).collect()
    total = sum((k * 37) % 101 - 50.0 for k in range(n)) / 10_000
    assert sorted(r.sim for r in got) == [1, 2]
    assert all(r.total_return == pytest.approx(total) for r in got)
    assert got[0].max_dd != got[1].max_dd


@pytest.mark.parametrize("n", [1, 1000, (1 << 16) + 1, 300_000])
def test_pieces_make_the_same_path(n):
    rng = np.random.default_rng(n)
    pnl, u = rng.normal(0.0, 0.01, n), rng.integers(0, 1 << 64, n, np.uint64)
    u[: n // 2] = u[: n // 2] % np.uint64(50)
    path = pnl[np.argsort(u.view(np.int64), kind="stable")]
    assert np.array_equal(np.concatenate(list(D._shuffled(pnl, lambda lo, hi: u[lo:hi]))), path)
    for compound, start in ((False, 10.0), (True, 1.0)):
        whole = D._path_figures([path], start, 252.0, compound)
        parts = D._path_figures(np.array_split(path, min(n, 7)), start, 252.0, compound)
        assert parts == pytest.approx(whole, rel=1e-9, abs=1e-12)


# --- series ------------------------------------------------------------------------

def _written(monkeypatch, module):
    """Columns of each table that is written while a query is built."""
    seen, write = [], module.landed
    monkeypatch.setattr(module, "landed", lambda df, tag="stage": seen.append(df.columns) or write(df, tag))
    return seen


def _trades(spark, n=2000):
    rng = random.Random(5)
    rows = [(k, i, f"t{i:05d}", rng.gauss(0.1, 1.0)) for k in ("a", "b", None) for i in range(n)]
    return spark.createDataFrame(rows, "strategy string, ts int, trade_id string, pnl double")


def test_carries_write_totals_only(spark, monkeypatch):
    seen = _written(monkeypatch, series)
    s = Series.of(_trades(spark), ["strategy"], ["ts"], 64)
    P.equity_curve(s).df.collect()
    assert [c for c in seen if "pnl" in c] == [["strategy", "ts", "trade_id", "pnl", "_row"]]


def test_rows_of_carries_are_dealt_once(spark):
    s = P.equity_curve(Series.of(_trades(spark), ["strategy"], ["ts"]))
    plan = s.frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_reward_deals_rows_once(spark):
    t = _trades(spark).withColumn("cost", F.lit(0.1))
    s = P.risk_adjusted_reward(P.equity_curve(Series.of(t, ["strategy"], ["ts"]).lending(P.REWARD_LOOK_BACK)))
    plan = s.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sums_deal_rows_once(spark):
    s = series.windowed_sums(Series.of(_trades(spark), ["strategy"], ["ts"]), {"w": (F.col("pnl"), 7)})
    assert s.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("rows, lent", [(16, 16), (64, 40), (100, 14), (10_000, 30)])
def test_lent_rows_give_the_same_values(spark, rows, lent):
    """Carries, steps that use up the lent rows, and all that cannot use them."""
    t = _trades(spark, 300).withColumn("x", F.when(F.col("ts") % 7 != 0, F.col("pnl")))
    def run(s):
        s = s.apply(Carry({"s": ("sum", F.col("x")), "n": ("count", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "l": ("last", F.col("x"))}))
        s = s.map(lambda f: f.withColumn("d", F.col("hi") - F.col("s"))).apply(Carry({"top": ("max", F.col("d"))}))
        s = s.apply(add(4, lambda w: {"back": F.lag("top", 4).over(w)}))
        s = series.windowed_sums(s, {"w": (F.col("d"), 5)})
        s = s.apply(Carry({"late": ("sum", F.col("w"))}), add(0, lambda w: {"next": F.lead("late", 2).over(w)}, after=2), Carry({"rs": ("sum", F.col("x"))}, reverse=True))
        return {(r.strategy, r.ts): r for r in s.indexed().df.collect()}
    want = run(Series.of(t, ["strategy"], ["ts"], rows))
    got = run(Series.of(t, ["strategy"], ["ts"], rows).lending(lent))
    assert got.keys() == want.keys() and len(got) == 900
    for k, r in want.items():
        assert got[k].asDict().keys() == r.asDict().keys()
        assert all((a is None) == (b is None) and (a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9)) for a, b in zip(r, (got[k][c] for c in r.asDict())))


def _falls(rows, rule):
    """First row whose window's drawdown is over the limit, by a plain loop: (ts, drawdown)."""
    half = -(-rule.window // 2)
    for i in range(rule.min_trades - 1, len(rows)):
        peak, worst = float("-inf"), 0.0
        for _, e in rows[max(0, i - half + 1) : i + 1]:
            if e is not None:
                peak = max(peak, e)
                worst = max(worst, (peak - e) / max(peak, 1e-9))
        if worst > rule.max_drawdown:
            return rows[i][0], worst
    return None


@pytest.mark.parametrize("level", [100.0, 4.0, -100.0])
def test_drawdown_of_few_windows_only(spark, level):
    rule = P.DemotionRule(sharpe_floor=-1e9, win_rate_floor=-1.0, max_drawdown=0.08 if level > 50 else 1.5, window=40, min_trades=12)
    rng = random.Random(11)
    keys = {k: [] for k in ("early", "late", "never", None)}
    for k, rows in keys.items():
        e = level
        for i in range(600):
            e += 0.001 if k == "never" or (k == "late" and i < 500) else rng.gauss(0.0, 1.0)
            rows.append((i, None if i % 97 == 5 else e))
    df = spark.createDataFrame([(k, i, 1.0, e) for k, rows in keys.items() for i, e in rows], "pair string, ts int, pnl double, equity double")
    got = {r.pair: (r.ts, r.max_drawdown) for r in P.demotion(Series.of(df, block_rows=64), rule).collect()}
    want = {k: f for k, rows in keys.items() if (f := _falls(rows, rule))}
    assert got.keys() == want.keys()
    for k, (ts, dd) in want.items():
        assert got[k][0] == ts and got[k][1] == pytest.approx(dd, rel=1e-9)


# --- guards --------------------------------------------------------------------------

def test_guards_hold_slices_of_a_block():
    rows = pd.DataFrame({"_key": ["a"] * 250 + ["b"] * 30, "_blk": [0] * 100 + [1] * 150 + [0] * 30, "x": range(280)})
    frames = [rows.iloc[i : i + 33] for i in range(0, 280, 33)]
    cut = list(G._slices(iter(frames), 64))
    assert [(first, len(f)) for first, f in cut] == [(True, 64), (False, 36), (True, 64), (False, 64), (False, 22), (True, 30)]
    assert [x for _, f in cut for x in f["x"]] == list(range(280))


def test_guard_over_many_slices(spark):
    n = (1 << 16) * 2 + 100
    df = spark.range(n).select(F.lit("a").alias("account"), F.col("id").alias("ts"), F.when(F.pmod("id", F.lit(7919)) < 20, 100.0).otherwise(-1.0).alias("value"))
    guard = G.page_hinkley(threshold=500.0)
    got = [r.ts for r in G.guard_batch(df, guard, ["account"], ["ts"]).where("alarm").orderBy("ts").collect()]
    x = np.where(np.arange(n) % 7919 < 20, 100.0, -1.0)
    want = np.flatnonzero(guard.advance(guard.initial, [x])[1][0])
    assert len(want) > 10 and got == want.tolist()


def test_stream_takes_turns(spark, tmp_path):
    """Rows go through in order once the watermark of the turns before has passed them; state and held rows are tables, by turn."""
    df = spark.createDataFrame([], "k string, ts timestamp, value double")
    guard = G.page_hinkley(threshold=3.0, min_rows=2)
    stream = G.guard_stream(df, guard, ["k"], ["ts"], delay="10 seconds")
    time = lambda t: (pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(seconds=t)).to_pydatetime()
    value = lambda t: 2.0 if t % 7 < 3 else -1.0
    turns = {0: [8, 3, 21], 2: [5, 30, 12], 4: [11, 25, 40, 2, None], 6: [70, 33]}
    for number, times in turns.items():
        rows = spark.createDataFrame([(k, None if t is None else time(t), 0.0 if t is None else value(t)) for t in times for k in ("a", None)], df.schema)
        for _ in range(2 if number in (2, 6) else 1):
            stream.turn(rows, number, str(tmp_path / "turns"), str(tmp_path / "out"))
    stream.turn(None, 7, str(tmp_path / "turns"), str(tmp_path / "out"))
    got = {n: sorted((r.k or "", r.ts.timestamp() - time(0).timestamp() if r.ts else -1.0, r.alarm) for r in spark.read.parquet(f"{tmp_path}/out/turn-{n}").collect()) for n in (2, 4, 6, 7)}
    # Watermarks of the turns: none, 11, 20, 30 and 60; in turn 4 the rows at 11 and 2 are late, one has no time.
    passed = {2: [3, 5, 8], 4: [12, None], 6: [21, 25, 30], 7: [33, 40]}
    order = [t for ts in passed.values() for t in ts]
    alarms = dict(zip(order, guard.advance(guard.initial, [np.array([0.0 if t is None else value(t) for t in order])])[1][0]))
    assert any(alarms.values())
    assert got == {n: sorted((k, -1.0 if t is None else float(t), bool(alarms[t])) for t in ts for k in ("a", "")) for n, ts in passed.items()}


def test_stream_goes_through_in_blocks(spark, tmp_path):
    n = 3000
    df = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds("id").alias("ts"), F.when(F.pmod("id", F.lit(79)) < 5, 9.0).otherwise(-1.0).alias("value"))
    guard = G.page_hinkley(threshold=30.0)
    stream = G.guard_stream(df, guard, ["k"], ["ts"])
    spark.conf.set("spark.tickloom.blockRows", "100")
    try:
        stream.turn(df.where("ts < timestamp_seconds(1500)"), 0, str(tmp_path / "turns"), str(tmp_path / "out"))
        stream.turn(df.where("ts >= timestamp_seconds(1500)"), 2, str(tmp_path / "turns"), str(tmp_path / "out"))
        stream.turn(None, 3, str(tmp_path / "turns"), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.tickloom.blockRows")
    got = [r.alarm for r in spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").orderBy("ts").collect()]
    x = np.where(np.arange(n) % 79 < 5, 9.0, -1.0)
    assert sum(got) > 10 and got == guard.advance(guard.initial, [x])[1][0].tolist()


# --- order slices -----------------------------------------------------------------------

def test_trajectory_once_for_each_number_of_slices(spark):
    orders = spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 3), ("c", 1.0, 5), ("d", 1.0, None), (None, 4.0, 5)], "order_id string, lots double, n int")
    out = R.slice_orders(orders, "order_id", slices=F.col("n"))
    assert "sinh" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    sums = {r.order_id: (r.n, r.lots) for r in out.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.sum("slice_lots").alias("lots")).collect()}
    assert {k: n for k, (n, _) in sums.items()} == {"a": 3, "b": 3, "c": 5, None: 5}
    assert all(sums[k][1] == pytest.approx(x) for k, x in (("a", 1.0), ("b", 2.0), ("c", 1.0), (None, 4.0)))
