"""Equity curves, trade statistics, monitoring and promotion."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.core.series import Carry, Series, Step, add, same, sums_step, windowed_sums
from tickloom.core.storage import landed, lookup
from tickloom.functions.scalar import normal_cdf, seconds

MINUTES_A_YEAR = 252 * 24 * 60
BARS_A_YEAR = 252 * 1440


def _part(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


# --- curves -------------------------------------------------------------------

def equity_curve(s: Series, pnl: str = "pnl", start: float = 10_000.0, out: str = "equity",
                 peak_from_start: bool = False) -> Series:
    """Additive equity, running peak and drawdown; the peak may include the starting equity."""
    s = s.apply(Carry({"_cum": ("sum", F.col(pnl))}))
    s = s.map(lambda f: f.withColumn(out, F.lit(start) + F.col("_cum")).drop("_cum"))
    s = s.apply(Carry({"peak": ("max", F.col(out))}))
    if peak_from_start:
        s = s.map(lambda f: f.withColumn("peak", F.greatest("peak", F.lit(start))))
    return s.map(lambda f: f.withColumn("drawdown", _part(F.col("peak") - F.col(out), F.col("peak"))))


def compounded(s: Series, ret: str = "ret", out: str = "equity") -> Series:
    """Running product of 1+r and its drawdown (<= 0).

    The product is carried as a log magnitude, a sign count and a zero count, so returns
    of -100 % and below stay exact in sign.
    """
    g = 1 + F.col(ret)
    s = s.apply(Carry({"_log": ("sum", F.when(g != 0, F.ln(F.abs(g)))),
                       "_neg": ("count", F.when(g < 0, 1)), "_zero": ("count", F.when(g == 0, 1))}))
    sign = F.when(F.col("_zero") > 0, 0.0).when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    s = s.map(lambda f: f.withColumn(out, sign * F.exp(F.coalesce("_log", F.lit(0.0)))).drop("_log", "_neg", "_zero"))
    s = s.apply(Carry({"peak": ("max", F.col(out))}))
    return s.map(lambda f: f.withColumn("drawdown", _part(F.col(out), F.col("peak")) - 1))


def sharpe(ret: Column, annual: float, sample: bool = False, eps: float | None = 1e-9) -> Column:
    """Mean over deviation, annualised; with ``eps`` None a zero deviation gives 0."""
    dev = F.stddev_samp(ret) if sample else F.stddev_pop(ret)
    if eps is None:
        return F.when(dev > 0, F.avg(ret) / dev * math.sqrt(annual)).otherwise(0.0)
    return F.avg(ret) / (dev + eps) * math.sqrt(annual)


def signal_return(signal: Column, ret: Column, hold_is_long: bool = False) -> Column:
    """0 buy, 2 sell, 1 hold. ``hold_is_long`` counts hold as long."""
    if hold_is_long:
        return F.signum(1.5 - signal) * ret
    return F.when(signal == 0, ret).when(signal == 2, -ret).otherwise(0.0)


# --- reports ------------------------------------------------------------------

def _wins(pnl: Column) -> dict[str, Column]:
    won, lost = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    return {"wins": F.count(won), "gain": F.coalesce(F.sum(won), F.lit(0.0)), "avg_win": F.avg(won),
            "losses": F.count(lost), "loss": F.coalesce(F.sum(lost), F.lit(0.0)), "avg_loss": F.avg(lost)}


def trade_performance(trades: Series, start: float = 10_000.0) -> DataFrame:
    """Trade-log report per key. Needs pnl (exit cost already deducted), commission, ts, exit_ts.

    ``net_pnl_usd`` subtracts the commission once more; ``total_pnl_usd`` does not.
    """
    s = equity_curve(trades, start=start)
    s = s.apply(add(1, lambda w: {"_ret": _part(F.col("equity"), F.lag("equity").over(w)) - 1}))
    w = _wins(F.col("pnl"))
    held = F.coalesce((seconds(F.col("exit_ts")) - seconds(F.col("ts"))) / 60, F.lit(0.0))
    ratio = F.abs(w["avg_win"]) / F.greatest(F.abs(w["avg_loss"]), F.lit(0.01))
    n = F.count(F.lit(1))
    return s.df.groupBy(*trades.keys).agg(
        (F.sum("pnl") / start * 100).alias("total_return_pct"),
        F.sum("pnl").alias("total_pnl_usd"),
        F.sum("commission").alias("total_commission_usd"),
        (F.sum("pnl") - F.sum("commission")).alias("net_pnl_usd"),
        n.alias("n_trades"),
        (w["wins"] / n * 100).alias("win_rate_pct"),
        F.coalesce(w["avg_win"], F.lit(0.0)).alias("avg_win_usd"),
        F.coalesce(w["avg_loss"], F.lit(0.0)).alias("avg_loss_usd"),
        F.coalesce(ratio, F.lit(0.0)).alias("win_loss_ratio"),
        sharpe(F.col("_ret"), MINUTES_A_YEAR, sample=True, eps=None).alias("sharpe_ratio"),
        (F.max((F.col("peak") - F.col("equity")) / (F.col("peak") + 1e-9)) * 100).alias("max_drawdown_pct"),
        F.avg(held).alias("avg_holding_minutes"),
        F.when(w["losses"] == 0, float("inf"))
         .otherwise(w["gain"] / F.greatest(F.abs(w["loss"]), F.lit(0.01))).alias("profit_factor"))


def curve_report(curve: Series, equity: str = "equity", pnl: str = "pnl") -> DataFrame:
    """Return, Sharpe, Calmar, drawdown and win rate of an equity curve per key."""
    s = curve.apply(Carry({"_peak": ("max", F.col(equity))}),
                    add(1, lambda w: {"_ret": _part(F.col(equity), F.lag(equity).over(w)) - 1}))
    first, last = F.min_by(equity, "_rn"), F.max_by(equity, "_rn")
    dd = F.min(_part(F.col(equity), F.col("_peak")) - 1)
    return s.frame.groupBy(*curve.keys).agg(
        ((_part(last, first) - 1) * 100).alias("total_return"),
        F.round(sharpe(F.col("_ret"), BARS_A_YEAR, sample=True, eps=None), 3).alias("sharpe"),
        F.round(F.abs(F.avg("_ret") * BARS_A_YEAR / (F.abs(dd) + 1e-9)), 3).alias("calmar"),
        F.round(dd * 100, 2).alias("max_drawdown"),
        F.round(F.avg(F.when(F.col(pnl) > 0, 1.0).otherwise(0.0)) * 100, 1).alias("win_rate"),
        F.count(F.lit(1)).alias("n_trades"),
        F.min("ts").alias("start"), F.max("ts").alias("end"))


def windowed_report(trades: Series, cutoff: Column, start: float = 10_000.0) -> DataFrame:
    """All-time metrics next to those of trades closed at or after the cutoff, and model versions.

    The recent drawdown starts from the equity just before the first recent trade.
    """
    recent = F.col("exit_ts") >= cutoff
    s = equity_curve(trades, start=start, peak_from_start=True)
    s = s.map(lambda f: f.withColumn("_before", F.col("equity") - F.col("pnl")))
    s = s.apply(Carry({"_rpeak": ("max", F.when(recent, F.greatest("_before", "equity")))}))
    out = []
    for prefix, cond in (("all", F.lit(True)), ("recent", recent)):
        pnl = F.when(cond, F.col("pnl"))
        w = _wins(pnl)
        n = F.count(pnl)
        dd = F.col("drawdown") if prefix == "all" else _part(F.col("_rpeak") - F.col("equity"), F.col("_rpeak"))
        out += [n.alias(f"{prefix}_n_trades"),
                (w["wins"] / F.nullif(n, F.lit(0))).alias(f"{prefix}_win_rate"),
                F.coalesce(w["avg_win"], F.lit(0.0)).alias(f"{prefix}_avg_win_usd"),
                F.coalesce(w["avg_loss"], F.lit(0.0)).alias(f"{prefix}_avg_loss_usd"),
                (w["gain"] / F.greatest(F.abs(w["loss"]), F.lit(1.0))).alias(f"{prefix}_profit_factor"),
                F.when(n > 1, sharpe(pnl, 252)).otherwise(0.0).alias(f"{prefix}_sharpe"),
                F.max(F.when(cond, dd)).alias(f"{prefix}_max_drawdown"),
                F.sum(pnl).alias(f"{prefix}_total_pnl")]
    return s.frame.groupBy(*trades.keys).agg(
        *out, F.max_by("equity", "_rn").alias("final_equity"),
        F.array_sort(F.collect_set("model_ver")).alias("model_versions"))


def prediction_report(predictions: DataFrame, by: Sequence[str], annual: float = 1.0) -> DataFrame:
    """Directional accuracy and the ratio of mean to deviation of sign(prediction) * outcome."""
    r = F.signum("pred") * F.col("y")
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.signum("pred") == F.signum("y"), 1.0).otherwise(0.0)).alias("dir_acc"),
        (F.avg(r) / (F.stddev_pop(r) + 1e-8) * annual).alias("sharpe_proxy"))


def leaderboard(folds: DataFrame) -> DataFrame:
    """Per run and model over fold rows: run, model, fold, best_metric, epochs, best_acc."""
    return folds.groupBy("run", "model").agg(
        F.count(F.lit(1)).alias("folds"), F.floor(F.avg("epochs")).alias("mean_epochs"),
        F.max("best_metric").alias("best_metric"), F.avg("best_metric").alias("mean_metric"),
        F.coalesce(F.stddev_samp("best_metric"), F.lit(0.0)).alias("std_metric"),
        F.min("best_metric").alias("min_metric"), F.max("best_acc").alias("best_acc"))


def regime_concentration(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of each regime's summed P&L in the total magnitude; the dominant regime per key."""
    sums = trades.groupBy(*by, "regime").agg(F.sum("pnl").alias("_p"))
    size = F.abs("_p")
    return sums.groupBy(*by).agg(
        (F.max(size) / (F.sum(size) + 1e-9)).alias("max_regime_conc"),
        F.max_by("regime", F.struct(size, "regime")).alias("dominant_regime"))


def held_out_scores(df: Series, pred: str = "pred", ret: str = "ret", scale_by: float = 10_000.0) -> DataFrame:
    """Accuracy, Sharpe, win rate, and both the additive and the compounded drawdown."""
    s = df.map(lambda f: f.withColumn("_r", F.col(pred) * F.col(ret)))
    s = equity_curve(s, "_r", start=scale_by, out="_eq")
    s = s.map(lambda f: f.withColumn("_add_dd", F.col("drawdown")).drop("peak", "drawdown"))
    s = compounded(s, "_r", "_cum")
    hit = F.when(F.signum(pred) == F.signum(ret), 1.0).otherwise(0.0)
    return s.df.groupBy(*df.keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(hit).alias("directional_accuracy"),
        sharpe(F.col("_r"), 252).alias("sharpe"), sharpe(F.col("_r"), BARS_A_YEAR).alias("sharpe_by_bar"),
        F.max("_add_dd").alias("max_drawdown"), F.min("drawdown").alias("max_drawdown_compounded"),
        F.avg(F.when(F.col("_r") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


@dataclass(frozen=True)
class ShadowRule:
    bars: int = 2000
    min_sharpe_gain: float = 0.1
    max_drawdown_worse: float = 0.02
    min_agreement: float = 0.6
    hold_is_long: bool = False


def shadow_comparison(signals: Series, rule: ShadowRule = ShadowRule()) -> DataFrame:
    """Candidate against live model over the same bars, with the promotion verdict."""
    s = signals.map(lambda f: f.withColumns({
        "_live": signal_return(F.col("live"), F.col("ret"), rule.hold_is_long),
        "_cand": signal_return(F.col("candidate"), F.col("ret"), rule.hold_is_long)}))
    for m in ("live", "cand"):
        s = compounded(s, f"_{m}", f"_eq_{m}")
        s = s.map(lambda f, m=m: f.withColumn(f"_dd_{m}", F.col("drawdown")).drop("peak", "drawdown"))
    ratio = lambda c: F.when(F.stddev_pop(c) < 1e-10, 0.0).otherwise(
        F.avg(c) / F.stddev_pop(c) * math.sqrt(BARS_A_YEAR))
    out = s.df.groupBy(*signals.keys).agg(
        F.count(F.lit(1)).alias("bars_evaluated"), ratio("_live").alias("live_sharpe"),
        ratio("_cand").alias("cand_sharpe"), F.min("_dd_live").alias("live_max_dd"),
        F.min("_dd_cand").alias("cand_max_dd"),
        F.avg(F.when(F.col("live") == F.col("candidate"), 1.0).otherwise(0.0)).alias("signal_agreement"))
    out = out.withColumns({"sharpe_improvement": F.col("cand_sharpe") - F.col("live_sharpe"),
                           "dd_delta": F.col("cand_max_dd") - F.col("live_max_dd")})
    good = ((F.col("sharpe_improvement") >= rule.min_sharpe_gain)
            & (F.col("dd_delta") >= -rule.max_drawdown_worse)
            & (F.col("signal_agreement") >= rule.min_agreement))
    return out.withColumn("status", F.when(F.col("bars_evaluated") < rule.bars, "insufficient_data")
                                     .when(good, "promote").otherwise("keep_live"))


# --- rolling monitoring ---------------------------------------------------------

def _recent(prefix: str, value: Column, rows: int) -> dict[str, tuple[Column, int]]:
    return {f"{prefix}n": (F.when(value.isNotNull(), 1), rows), f"{prefix}s": (value, rows),
            f"{prefix}q": (value * value, rows)}


def _mean_dev(prefix: str) -> tuple[Column, Column, Column]:
    """Count, mean and population deviation from the sums of ``_recent``."""
    n, total, square = (F.col(f"{prefix}{k}") for k in "nsq")
    mean = total / F.nullif(n, F.lit(0))
    var = square / F.nullif(n, F.lit(0)) - mean * mean
    return n, mean, F.sqrt(F.greatest(var, F.lit(0.0)))


def rolling_trade_stats(s: Series, win: int = 100, sharpe_rows: int = 200, rate_rows: int = 200,
                        min_rows: int = 10) -> Series:
    """Win rate, Sharpe and trades per hour over the last trades; partial windows count.

    Trades are in the order of ``ts``, so where none is ``rate_rows`` back the earliest one is among those a block holds.
    """
    won = F.when(F.col("pnl") > 0, 1).otherwise(0)

    def opened(w):
        earliest = F.min("ts").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return {"_from": F.coalesce(F.lag("ts", rate_rows - 1).over(w), earliest)}

    s = s.indexed("_i").apply(sums_step(s.keys, {"_won": (won, win), **_recent("_p", F.col("pnl"), sharpe_rows)}),
                              add(rate_rows - 1, opened))
    n, mean, dev = _mean_dev("_p")
    k = F.least(F.col("_i"), F.lit(rate_rows))
    hours = (seconds(F.col("ts")) - seconds(F.col("_from"))) / 3600
    return s.map(lambda f: f.withColumns({
        "win_rate": F.col("_won") / F.least(F.col("_i"), F.lit(win)),
        "rolling_sharpe": F.when((n >= min_rows) & (dev > 1e-9), mean / dev * math.sqrt(252)).otherwise(0.0),
        "trades_per_hour": F.when(k >= 2, k / F.greatest(hours, F.lit(1 / 60)))})
        .drop("_i", "_won", "_pn", "_ps", "_pq", "_from"))


# Rows that ``risk_adjusted_reward`` looks back by default: a run of its window and the one before it.
REWARD_LOOK_BACK = 200


def risk_adjusted_reward(s: Series, window: int = 100, risk_free: float = 0.05 / 252, annual: float = 252.0,
                         dd_penalty: float = 0.5, cost_penalty: float = 0.3) -> Series:
    """Rolling Sharpe of pnl - cost, less penalties for drawdown and cost; 0 on the first row.

    Needs pnl, cost, equity; the peak starts at 1. A series that lends two windows of rows is not dealt again.
    """
    s = s.map(lambda f: f.withColumn("_net", F.col("pnl") - F.col("cost")))
    s = s.apply(Carry({"_peak": ("max", F.greatest(F.col("equity"), F.lit(1.0)))}))

    s = windowed_sums(s, _recent("_w", F.col("_net"), window))
    n, mean, dev = _mean_dev("_w")
    ratio = (mean - risk_free) / (dev + 1e-9) * math.sqrt(annual)
    dd = F.greatest((F.col("_peak") - F.col("equity")) / F.col("_peak"), F.lit(0.0))
    value = ratio - dd_penalty * dd - cost_penalty * F.abs("cost")
    return s.map(lambda f: f.withColumn("reward", F.when(n < 2, 0.0).otherwise(value))
                            .drop("_net", "_peak", "_wn", "_ws", "_wq"))


@dataclass(frozen=True)
class DemotionRule:
    sharpe_floor: float = 0.5
    win_rate_floor: float = 0.45
    max_drawdown: float = 0.10
    window: int = 300
    min_trades: int = 30


def demotion(s: Series, rule: DemotionRule = DemotionRule()) -> DataFrame:
    """First trade per key at which a rolling floor is broken. Needs pnl and equity.

    Each trade updates the equity window twice (trade and bar), so the drawdown covers
    the equity of the last window/2 trades, with the peak taken inside that window.
    """
    half = -(-rule.window // 2)
    won = F.when(F.col("pnl") > 0, 1).otherwise(0)
    full = s.indexed("_i")
    s = full.map(lambda f: f.drop(*(c for c in s.order if c not in s.keys)))
    s = s.apply(sums_step(s.keys, {"_won": (won, rule.window), **_recent("_p", F.col("pnl"), rule.window)}),
                add(half - 1, lambda w: {"_top": F.max("equity").over(w.rowsBetween(-(half - 1), 0))}))
    n, mean, dev = _mean_dev("_p")
    s = s.map(lambda f: f.withColumns({
        "_n": n, "sharpe": F.when((n >= 10) & (dev > 1e-9), mean / dev * math.sqrt(252)).otherwise(0.0),
        "win_rate": F.col("_won") / n, "_part": F.floor((F.col("_i") - 1) / half)}))
    low_sharpe = F.col("sharpe") < rule.sharpe_floor
    low_wins = F.col("win_rate") < rule.win_rate_floor
    ready = F.col("_n") >= min(rule.min_trades, rule.window)

    # A row's own fall from the peak of its window is at most the window's drawdown, and a window in which no row has
    # fallen so far, or below zero, has none: the first row that surely fires ends the search, and only the rows around
    # such falls up to there need their window's drawdown.
    fell = (F.col("_top") - F.col("equity")) / F.greatest("_top", F.lit(1e-9)) > rule.max_drawdown
    sure = ready & (low_sharpe | low_wins | fell)
    marks = landed(s.frame.where(sure | fell | (F.col("equity") <= 0)).groupBy(*s.keys, "_part").agg(
        F.min(F.when(sure, F.col("_i"))).alias("_sure")), "marks")
    stop = landed(marks.groupBy(*s.keys).agg(F.min("_sure").alias("_stop")), "stops")
    known = marks.join(stop, same(marks, stop, s.keys)).where(F.col("_stop").isNull() | (F.col("_part") * half < F.col("_stop")))
    near = landed(known.select(*[marks[c].alias(f"_of_{c}") for c in s.keys], "_stop", F.explode(
        F.array(*[F.col("_part") + d for d in (-1, 0, 1)])).alias("_near")).distinct(), "near")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in s.keys], F.col("_part") == F.col("_near"))
    found = s.frame.join(near, on).where("_stop is null or _i <= _stop").drop("_near", "_stop", "_part", *[f"_of_{c}" for c in s.keys])

    def fn(f: DataFrame, w):
        f = f.withColumn("_eq", F.collect_list("equity").over(w.rowsBetween(-(half - 1), 0)))
        start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("dd"))

        def fall(acc, e):
            peak = F.greatest(acc.peak, e)
            return F.struct(peak.alias("peak"),
                            F.greatest(acc.dd, (peak - e) / F.greatest(peak, F.lit(1e-9))).alias("dd"))
        return f.withColumn("max_drawdown", F.aggregate("_eq", start, fall, lambda acc: acc.dd)).drop("_eq")

    deep = F.col("max_drawdown") > rule.max_drawdown
    fired = s.with_frame(found).apply(Step(fn, before=half - 1)).frame.where(ready & (low_sharpe | low_wins | deep))
    picked = landed(fired.groupBy(*s.keys).agg(F.min_by(F.struct(
        "_rn", "sharpe", "win_rate", "max_drawdown", low_sharpe.alias("sharpe_low"),
        low_wins.alias("win_rate_low"), deep.alias("drawdown_high")), "_i").alias("_f")), "fired")
    picked = picked.select(*[F.col(c).alias(f"_of_{c}") for c in s.keys], "_f.*").withColumnRenamed("_rn", "_at")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in s.keys], F.col("_rn") == F.col("_at"))
    return full.frame.select(*dict.fromkeys([*s.keys, *s.order]), "_rn").join(picked, on).select(
        *s.keys, *s.order, "sharpe", "win_rate", "max_drawdown", "sharpe_low", "win_rate_low", "drawdown_high")


def first_alarm(s: Series, value: Column, delta: float = 0.005, threshold: float = 50.0, min_rows: int = 30) -> DataFrame:
    """First row per key where the running sum of value - delta rises above its minimum by the threshold."""
    s = s.apply(Carry({"_m": ("sum", value - delta), "_n": ("count", F.lit(1))}))
    s = s.apply(Carry({"_min": ("min", F.col("_m"))}))
    rise = F.col("_m") - F.least("_min", F.lit(0.0))
    fired = s.df.where((F.col("_n") >= min_rows) & (rise > threshold))
    picked = fired.groupBy(*s.keys).agg(F.min_by(
        F.struct(F.col("_n").alias("row"), *s.order, rise.alias("statistic")), "_n").alias("_f"))
    return picked.select(*s.keys, "_f.*")


def monitoring_snapshot(s: Series, start: float = 10_000.0) -> DataFrame:
    """Latest equity, session P&L, drawdown, win rate, Sharpe and trade rate per key."""
    s = equity_curve(s, start=start, peak_from_start=True)
    s = rolling_trade_stats(s)
    row = F.max_by(F.struct(
        F.col("ts"), "equity", (F.col("equity") - start).alias("pnl_session"),
        F.greatest("drawdown", F.lit(0.0)).alias("drawdown"), "win_rate",
        F.col("rolling_sharpe").alias("sharpe"), "trades_per_hour"), "_rn").alias("_s")
    return s.frame.groupBy(*s.keys).agg(row, F.count(F.lit(1)).alias("n_trades")).select(*s.keys, "_s.*", "n_trades")


# --- promotion --------------------------------------------------------------------

def probabilistic_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: float | Column = 0.0) -> Column:
    """Probability that the true Sharpe beats the benchmark; 0.5 with too little data."""
    var = (1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)
    z = (sr - benchmark) / F.sqrt(F.greatest(var, F.lit(1e-12)))
    return F.when((n < 5) | (var <= 0), 0.5).otherwise(normal_cdf(z))


def deflated_sharpe(sr: Column, trials: int, n: Column, skew: Column, kurt: Column) -> Column:
    """Against the expected best of several trials; one trial returns the Sharpe itself."""
    if trials <= 1:
        return sr
    euler, root = 0.5772156649, math.sqrt(2 * math.log(trials))
    return probabilistic_sharpe(sr, n, skew, kurt, (1 - euler) * root + euler / root)


@dataclass(frozen=True)
class GateRule:
    min_sharpe: float = 1.5
    min_sharpe_emergency: float = 1.3
    min_profit_factor: float = 1.5
    max_drawdown: float = 0.20
    min_trades: int = 500
    max_regime_conc: float = 0.75
    max_cost_pct: float = 0.30
    strict: bool = False


def gate_metrics(trades: Series, start: float = 10_000.0, annual: float = 252.0) -> DataFrame:
    """Inputs of the gate per key, from trade history with pnl, cost and regime."""
    s = equity_curve(trades, start=start)
    pnl = F.col("pnl")
    w = _wins(pnl)
    base = s.df.groupBy(*trades.keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.when(F.count(F.lit(1)) > 1, sharpe(pnl, annual, eps=None)).otherwise(0.0).alias("sharpe"),
        (w["gain"] / F.greatest(F.abs(w["loss"]), F.lit(1e-9))).alias("profit_factor"),
        F.max("drawdown").alias("max_drawdown"), w["gain"].alias("gross_pnl"),
        F.sum("cost").alias("transaction_costs"),
        F.skewness("pnl").alias("skewness"), (F.kurtosis("pnl") + 3).alias("kurtosis"))
    return base.join(regime_concentration(trades.frame, trades.keys), trades.keys)


def promotion_gate(metrics: DataFrame, rule: GateRule = GateRule(), trials: int = 1, emergency: bool = False,
                   normal_moments: bool = True) -> DataFrame:
    """Seven criteria, optionally an eighth, the list of failures and the verdict.

    ``normal_moments`` takes skewness 0 and kurtosis 3 in the Sharpe probability.
    """
    least = rule.min_sharpe_emergency if emergency else rule.min_sharpe
    n = F.col("n_trades")
    skew = F.lit(0.0) if normal_moments else F.col("skewness")
    kurt = F.lit(3.0) if normal_moments else F.col("kurtosis")
    f = metrics.withColumns({
        "cost_pct": F.col("transaction_costs") / F.greatest(F.abs("gross_pnl"), F.lit(1e-9)),
        "psr": probabilistic_sharpe(F.col("sharpe"), n, skew, kurt)})
    strict = rule.strict and trials > 1
    f = f.withColumn("dsr", deflated_sharpe(F.col("sharpe"), trials, n, skew, kurt) if strict else F.lit(-1.0))
    checks = {
        "sharpe_ok": F.col("sharpe") >= least,
        "pf_ok": F.col("profit_factor") >= rule.min_profit_factor,
        "dd_ok": F.col("max_drawdown") <= rule.max_drawdown,
        "sample_ok": n >= rule.min_trades,
        "regime_ok": F.col("max_regime_conc") <= rule.max_regime_conc,
        "cost_ok": F.col("cost_pct") <= rule.max_cost_pct,
        "psr_ok": F.col("psr") > 0.5,
        "dsr_ok": (F.col("dsr") > 0.5) if strict else F.lit(True),
    }
    f = f.withColumns(checks)
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]))
    return f.withColumn("failed", failed).withColumn("promoted", F.size("failed") == 0)


def importance_shift(importance: DataFrame, k: int = 5, threshold: float = 0.3,
                     by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of the top-k features that changed since the previous cycle."""
    rank = F.row_number().over(Window.partitionBy(*by, "cycle").orderBy(F.col("importance").desc(), "feature"))
    tops = (importance.withColumn("_k", rank).where(F.col("_k") <= k)
            .groupBy(*by, "cycle").agg(F.array_sort(F.collect_set("feature")).alias("top")))
    w = Window.partitionBy(*by).orderBy("cycle")
    f = tops.withColumn("_prev", F.lag("top").over(w))
    shift = 1 - F.size(F.array_intersect("top", "_prev")) / F.size("top")
    return f.select(*by, "cycle", "top", F.when(F.col("_prev").isNotNull(), shift).alias("shift"),
                    F.array_except("top", "_prev").alias("entered"), F.array_except("_prev", "top").alias("left"),
                    F.coalesce(shift > threshold, F.lit(False)).alias("alert"))


# --- ensembles, logs, histograms -------------------------------------------------------

def ensemble_confidence(predictions: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Mean and deviation over models per row; confidence is 1 - deviation over the largest deviation."""
    per = predictions.groupBy(*keys).agg(F.avg("pred").alias("mean"), F.stddev_samp("pred").alias("std"))
    # The largest deviation is one row, so it is broadcast.
    top = per.agg(F.greatest(F.max("std"), F.lit(1e-6)).alias("_top"), F.lit(1).alias("_one"))
    f = per.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").drop("_one")
    f = f.withColumn("confidence", 1 - F.col("std") / F.col("_top"))
    return f.withColumn("signal", F.when(F.col("confidence") > threshold, F.col("mean")).otherwise(0.0)).drop("_top")


def ensemble_diversity(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean pairwise correlation of model outputs, from the variance of the summed z-scores.

    A model whose output never changes correlates with none and is left out; null with fewer than two others.
    """
    stats = predictions.groupBy("model").agg(F.avg("pred").alias("_m"), F.stddev_samp("pred").alias("_s"))
    z = lookup(predictions, stats, ["model"]).groupBy(*keys).agg(
        F.sum(_part(F.col("pred") - F.col("_m"), F.col("_s"))).alias("_z"), F.count(F.when(F.col("_s") > 0, 1)).alias("_k"))
    k = F.max("_k")
    return z.agg((_part(F.var_samp("_z") - k, (k * (k - 1)).cast("double"))).alias("mean_correlation"))


def trade_log(trades: DataFrame) -> DataFrame:
    """Readable direction, number of scale-ins, and P&L in dollars from pips."""
    return trades.withColumns({
        "direction": F.when(F.col("direction") > 0, "Long").otherwise("Short"),
        "n_scale_adds": F.size("scale_additions").cast("bigint"),
        "pnl_usd": F.col("pnl_pips") * F.col("lots") * 10})


# Upper bounds of the latency histogram, in milliseconds.
LATENCY_BOUNDS = (1, 2, 3, 5, 8, 13, 21, 34, 55)


def histogram(df: DataFrame, value: Column, by: Sequence[str], bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts per upper bound; every bound appears, the last one is infinite."""
    edges = [*map(float, bounds), float("inf")]
    one = df.groupBy(*by).agg(*[F.count_if(value <= b).alias(f"_{i}") for i, b in enumerate(edges)])
    rows = F.array(*[F.struct(F.lit(b).alias("upper"), F.col(f"_{i}").alias("n")) for i, b in enumerate(edges)])
    return one.select(*by, F.inline(rows))
