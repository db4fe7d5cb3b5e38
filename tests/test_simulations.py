"""Simulated paths against a plain loop, in memory and as sorted series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.core import series
from tickloom.operators import distribution as D

SIMS = 5


def plain(pnl, drawn, method, compound):
    """Figures of one path; drawn: the random number of each trade."""
    n = len(pnl)
    if method == "shuffle":
        path = [pnl[k] for k in sorted(range(n), key=lambda k: (drawn[k], k))]
    else:
        path = [pnl[math.floor((u % (1 << 64) >> 11) / (1 << 53) * n)] for u in drawn]
    scale = 1.0 if compound else 10_000.0
    ret = [x / scale for x in path]
    mean = sum(ret) / n
    dev = math.sqrt(sum((x - mean) ** 2 for x in ret) / n)
    equity, falls, eq = [], [], 1.0 if compound else 10_000.0
    peak = None if compound else eq
    for x in path:
        eq = eq * (1 + x) if compound else eq + x
        peak = eq if peak is None else max(peak, eq)
        equity.append(eq)
        falls.append(eq / peak - 1 if compound else (peak - eq) / peak)
    if compound:
        return mean / dev * math.sqrt(252) if dev > 1e-15 else 0.0, min(falls), eq - 1
    return mean / (dev + 1e-9) * math.sqrt(252), max(falls), sum(path) / 10_000


@pytest.mark.parametrize("held", [1 << 20, 50])
@pytest.mark.parametrize("method, compound", [("shuffle", False), ("bootstrap", True)])
def test_paths_against_a_loop(spark, method, compound, held):
    rnd = random.Random(3)
    scale = 0.01 if compound else 100.0
    rows = [(s, f"t{k:04d}", rnd.gauss(0.02, 1) * scale) for s, n in (("a", 80), ("b", 40), ("c", 1)) for k in range(n)]
    trades = spark.createDataFrame([*rows, ("a", "x", None), (None, "y", 1.0)], "strategy string, trade_id string, pnl double")
    got = {(r.strategy, r.sim): r for r in D.simulations(trades, ["strategy"], "trade_id", "pnl", SIMS, method, compound=compound, held=held, chunk=2).collect()}
    grid = spark.range(1, SIMS + 1).select(F.col("id").alias("sim")).crossJoin(spark.range(1, 81).select(F.col("id").alias("_i")))
    u = {(r.sim, r._i): r.u for r in grid.select("sim", "_i", D._draw(42).alias("u")).collect()}
    assert set(got) == {(s, k) for s in "abc" for k in range(1, SIMS + 1)}
    for (s, sim), r in got.items():
        pnl = [x for name, _, x in rows if name == s]
        want = plain(pnl, [u[sim, i] for i in range(1, len(pnl) + 1)], method, compound)
        assert (r.sharpe, r.max_dd, r.total_return) == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_no_trades(spark):
    none = spark.createDataFrame([], "strategy string, trade_id string, pnl double")
    assert D.simulations(none, ["strategy"], "trade_id", "pnl", SIMS).count() == 0


SHAPES = {
    "even": lambda rng, n: rng.normal(0.0, 1.0, n), "up": lambda rng, n: rng.normal(0.2, 1.0, n), "down": lambda rng, n: rng.normal(-0.2, 1.0, n),
    "whole numbers": lambda rng, n: rng.integers(-1, 2, n) * 1.0, "nothing": lambda rng, n: np.zeros(n), "wins": lambda rng, n: np.abs(rng.normal(0.0, 1.0, n)),
    "losses": lambda rng, n: -np.abs(rng.normal(0.0, 1.0, n)), "heavy": lambda rng, n: rng.standard_cauchy(n), "rare": lambda rng, n: np.where(rng.random(n) < 0.001, -300.0, 0.3)}


@pytest.mark.parametrize("n", [D.FEW + 1, 40_000, D.STEPS * D.STRETCHES + 1])
@pytest.mark.parametrize("shape", SHAPES)
def test_figures_of_many_trades_without_their_paths(monkeypatch, shape, n):
    """Sorting only what can decide the drawdown, and stretches side by side, give the figures of the whole path."""
    monkeypatch.setattr(D, "SORTED", 1 << 12)
    pnl, sims = SHAPES[shape](np.random.default_rng(n), n), range(3, 6)
    cases = [(pnl, "shuffle", start, False) for start in (10.0, 1e5)] + [(np.clip(pnl / 1000, -0.9, 0.9), "bootstrap", 10_000.0, True)]
    for values, method, start, compound in cases:
        got = D._figures(values, sims, method, 42, start, 252.0, compound)
        for begin, (_, *figures) in zip(D._begins(42, sims), got, strict=True):
            drawn = lambda lo, hi, begin=begin: D.hashed_longs(np.arange(lo + 1, hi + 1, dtype=np.uint64), begin)
            path = D._shuffled(values, drawn) if method == "shuffle" else D._drawn_again(values, drawn)
            assert figures == pytest.approx(D._path_figures(path, start, 252.0, compound), rel=1e-7, abs=1e-9)


def test_shuffle_sorts_little_of_a_long_path(monkeypatch):
    n, seen, sort = 300_000, [], np.argsort
    pnl = np.random.default_rng(1).normal(0.0, 1.0, n)
    monkeypatch.setattr(D.np, "argsort", lambda a, *args, **kw: seen.append(len(a)) or sort(a, *args, **kw))
    D._figures(pnl, range(1, 5), "shuffle", 42, 1e6, 252.0, False)
    assert 0 < sum(seen) < n


@pytest.mark.parametrize("method, compound", [("shuffle", False), ("bootstrap", True)])
def test_no_path_of_a_long_key_is_written(spark, monkeypatch, method, compound):
    """Keys over ``held`` give the same figures; what is written grows with the trades, not with the simulations."""
    rng = random.Random(8)
    rows = [(k, f"t{i:06d}", rng.gauss(0.0, 0.01)) for k, n in (("a", 9000), ("b", 5000), ("c", 30)) for i in range(n)]
    rng.shuffle(rows)
    trades = spark.createDataFrame(rows, "strategy string, trade_id string, pnl double").repartition(5)
    written, write = [], D.landed
    for module in (D, series):
        monkeypatch.setattr(module, "landed", lambda df, tag="stage": written.append(out := write(df, tag)) or out)
    read = lambda held: {(r.strategy, r.sim): tuple(r)[2:] for r in D.simulations(trades, ["strategy"], "trade_id", "pnl", 40, method, compound=compound, held=held).collect()}
    dealt = read(1 << 22)
    assert read(100) == dealt and len(dealt) == 120
    assert max(df.count() for df in written) < 100
    monkeypatch.undo()
    paths, names = D.simulated_paths(trades, ["strategy"], "trade_id", "pnl", 2, method)
    for r in D.simulate(paths, names, compound=compound).collect():
        assert dealt[r.strategy, r.sim] == pytest.approx((r.sharpe, r.max_dd, r.total_return), rel=1e-6, abs=1e-9)
