"""Position sizing, execution cost, order slicing and portfolio risk."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Series, Step, add
from tickloom.core.storage import landed, lookup
from tickloom.functions.scalar import at_least, clip

# Standard normal quantiles and densities by confidence level.
NORMAL = {0.95: (1.6448536269514722, 0.10313564037537139), 0.99: (2.3263478740408408, 0.026652142203457956)}


# --- sizing ---------------------------------------------------------------------

def kelly(win_prob: Column, ratio: Column) -> Column:
    return win_prob - F.try_divide(1 - win_prob, ratio)


def fractional_kelly(full: Column, fraction: float = 0.25) -> Column:
    return clip(full * fraction, 0.0, 1.0)


def vol_scalar(dev: Column, target: float = 0.10) -> Column:
    return clip(target / (dev * math.sqrt(252) + 1e-9), 0.1, 3.0)


def square_root_impact(lots: Column, adv: float = 1000.0, coef: float = 0.1) -> Column:
    return coef * F.sqrt(lots / (adv + 1e-9))


def _recent_deviation(ret: str, rows: int, least: int) -> Step:
    frame = lambda w: w.rowsBetween(-(rows - 1), 0)
    return add(rows - 1, lambda w: {
        "_dev": F.when(F.count(ret).over(frame(w)) >= least, F.stddev_pop(ret).over(frame(w)))})


def _hundredths(x: Column) -> Column:
    """Nearest hundredth, halves to even."""
    return F.rint(x * 100) / 100


@dataclass(frozen=True)
class SizeRule:
    equity: float = 10_000.0
    fraction: float = 0.25
    max_pct: float = 0.05
    target_vol: float = 0.10
    pip_risk: float = 20.0
    lot_size: float = 10_000.0


def kelly_positions(s: Series, rule: SizeRule = SizeRule(), ret: str = "ret", lookback: int = 20) -> DataFrame:
    """Lots, risk and impact per row. Needs win_prob, win_loss_ratio, atr and a return."""
    full = kelly(F.col("win_prob"), F.col("win_loss_ratio"))
    part = fractional_kelly(full, rule.fraction)
    f = s.apply(_recent_deviation(ret, lookback, 2)).df.withColumns({
        "full_kelly": full, "frac_kelly": part,
        "vol_scalar": F.coalesce(vol_scalar(F.col("_dev"), rule.target_vol), F.lit(1.0))})
    f = f.withColumn("risk_usd", rule.equity * F.least(F.col("frac_kelly") * F.col("vol_scalar"), F.lit(rule.max_pct)))
    pip_value = rule.lot_size * 0.0001
    stop = F.greatest(F.lit(rule.pip_risk), F.col("atr") / 0.0001 * 1.5)
    lots = _hundredths(clip(F.col("risk_usd") / (stop * pip_value), 0.01, rule.equity / rule.lot_size * 0.2))
    return (f.withColumn("lots", lots)
             .withColumn("impact_usd", square_root_impact(F.col("lots")) * pip_value * F.col("lots")).drop("_dev"))


@dataclass(frozen=True)
class RegimeRule:
    base: float = 0.25
    highest: float = 0.40
    lowest: float = 0.05
    crisis_corr: float = 0.70
    crisis_scale: float = 0.50
    trending: float = 0.60
    mean_reverting: float = 0.40
    trend_bonus: float = 1.20
    reversion_scale: float = 0.75
    target_vol: float = 0.10
    max_pct: float = 0.05
    lot_size: float = 10_000.0
    pip: float = 0.0001


def regime_positions(s: Series, rule: RegimeRule = RegimeRule(), ret: str = "ret") -> DataFrame:
    """Kelly lots scaled by regime. Needs equity, win_prob, win_loss_ratio, atr, corr_avg, hurst, corr_break."""
    p, h = F.col("win_prob"), F.col("hurst")
    crisis = (F.col("corr_avg") > rule.crisis_corr) | (F.col("corr_break") > 0)
    scale = (F.when(crisis, rule.crisis_scale).otherwise(1.0)
             * F.when(h > rule.trending, rule.trend_bonus)
                .when(h < rule.mean_reverting, rule.reversion_scale).otherwise(1.0))
    full = F.greatest(F.lit(0.0), p - (1 - p) / F.greatest(F.col("win_loss_ratio"), F.lit(0.01)))
    f = s.apply(_recent_deviation(ret, 60, 20)).df.withColumns({
        "regime_scale": clip(scale, rule.lowest / rule.base, rule.highest / rule.base),
        "vol_scalar": F.coalesce(vol_scalar(F.col("_dev"), rule.target_vol), F.lit(1.0))})
    f = f.withColumn("kelly", clip(full * rule.base * F.col("regime_scale"), rule.lowest, rule.highest))
    f = f.withColumn("risk_usd", F.col("equity") * F.least(F.col("kelly") * F.col("vol_scalar"), F.lit(rule.max_pct)))
    stop = F.greatest(F.lit(10.0), F.col("atr") / rule.pip * 1.5)
    most = F.col("equity") / rule.lot_size * 0.3
    lots = F.greatest(F.least(F.col("risk_usd") / (stop * rule.lot_size * rule.pip), most), F.lit(0.01))
    name = (F.when(F.col("corr_avg") > rule.crisis_corr, "crisis").when(h > rule.trending, "trending")
             .when(h < rule.mean_reverting, "mean_rev").otherwise("normal"))
    return f.withColumns({"lots": _hundredths(F.least(lots, most)), "regime": name}).drop("_dev")


# --- execution ------------------------------------------------------------------

def execution_price(direction: Column, lots: Column, slippage_pips: float = 0.5, pip: float = 0.0001,
                    daily_lots: float = 500.0, use_book: bool = True, impact: bool = True) -> Column:
    """Side of the book (or mid with half spread), plus slippage and square-root impact."""
    base = (F.when(direction > 0, F.col("ask_close")).otherwise(F.col("bid_close")) if use_book
            else F.col("close") + direction * F.col("spread_avg") / 2)
    price = base + direction * slippage_pips * pip
    if impact:
        price = price + F.when(lots > 0, direction * F.col("spread_avg") * F.sqrt(F.abs(lots) / daily_lots)).otherwise(0.0)
    return price


def commission(lots: Column, per_lot: float = 3.5) -> Column:
    return F.abs(lots) * per_lot


@dataclass(frozen=True)
class SliceRule:
    sigma: float = 0.0001
    eta: float = 2.5e-7
    gamma: float = 2.5e-8
    risk_aversion: float = 1e-6

    @property
    def kappa(self) -> float:
        return math.sqrt(max(self.risk_aversion * self.sigma ** 2 / self.eta, 0.0))


def split_rule(lots: Column, urgency: Column) -> tuple[Column, Column]:
    """(split?, slices) by size and urgency."""
    big = lots > 2.0
    should = (F.when(big, True).when(urgency == "urgent", lots > 0.5)
               .when(urgency == "patient", lots > 0.3).otherwise(lots > 0.5))
    n = F.when(big, 10).when(urgency == "urgent", 3).when(urgency == "patient", 15).otherwise(5)
    return should, n


def slice_orders(orders: DataFrame, order_id: str, lots: str = "lots", slices: Column | None = None,
                 rule: SliceRule = SliceRule()) -> DataFrame:
    """One row per slice: sinh trajectory scaled to the order's lots. The trajectory depends only on the number of
    slices, so it is computed once for each number that occurs."""
    n = F.lit(10) if slices is None else slices
    k = rule.kappa
    left = lambda t, size: F.sinh(F.lit(k) * (size - t)) / (F.sinh(F.lit(k) * size) + 1e-12)
    raw = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda t: F.when(
        k * F.col("_n") < 1e-6, 1.0 / F.col("_n")).otherwise(
        at_least(F.when(t == 1, 1.0).otherwise(left(t - 1, F.col("_n"))) - left(t, F.col("_n")), 0.0)))
    total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
    f = orders.withColumn("_n", n)
    shares = landed(f.select("_n").distinct().withColumn("_raw", raw).withColumn("_total", total), "shares")
    return (f.join(shares, "_n").select(order_id, F.col(lots), F.col("_n").alias("n_slices"), "_total", F.posexplode("_raw").alias("p", "_x"))
             .select(order_id, lots, "n_slices", (F.col("p") + 1).alias("slice"),
                     (F.col("_x") * F.col(lots) / F.col("_total")).alias("slice_lots")))


def impact_cost(slices: DataFrame, order_id: str, lots: str = "lots", pip_value: float = 10.0,
                rule: SliceRule = SliceRule()) -> DataFrame:
    pips = (rule.gamma * F.max(lots) + rule.eta * F.sum(F.pow("slice_lots", 2))) / 0.0001
    return slices.groupBy(order_id).agg(
        F.count(F.lit(1)).alias("n_slices"), F.round(pips, 4).alias("impact_pips"),
        F.round(pips * pip_value * F.max(lots), 4).alias("total_cost_usd"))


# --- portfolio ------------------------------------------------------------------

def portfolio_summary(positions: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    per = positions.groupBy(*by, "pair").agg(F.sum("lots").alias("lots"))
    return per.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", "lots")))).alias("positions"),
        F.sum(F.abs("lots")).alias("total_lots"), F.signum(F.sum("lots")).alias("net_direction"))


def portfolio_var(returns: DataFrame, positions: DataFrame, equity: float, confidence: float = 0.99,
                  horizon: int = 1, pip_value: float = 10.0, rows: int = 500) -> DataFrame:
    """VaR, CVaR and mean pairwise correlation over the last common times of all held pairs.

    w'Cov w is the variance of the weighted return sum, and the mean correlation follows
    from the variance of the summed z-scores, so pairs are never joined with each other. A pair
    whose returns do not vary correlates with none and is left out of the mean.
    """
    z, density = NORMAL[confidence]
    held = positions.where(F.abs("lots") > 0.001)
    n = held.agg(F.count(F.lit(1)).alias("_p"))
    both = returns.where(F.col("ret").isNotNull()).join(held.select("pair", "lots"), "pair")
    times = both.groupBy("ts").agg(F.count_distinct("pair").alias("_have"))
    recent = (times.join(F.broadcast(n), F.col("_have") == F.col("_p")).orderBy(F.col("ts").desc()).limit(rows).select("ts"))
    used = both.join(recent, "ts")
    stats = used.groupBy("pair").agg(F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s"))
    sums = lookup(used, stats, ["pair"]).groupBy("ts").agg(
        F.sum(F.col("ret") * F.col("lots") * pip_value).alias("_wr"),
        F.sum(F.try_divide(F.col("ret") - F.col("_m"), F.col("_s"))).alias("_zz"), F.count(F.when(F.col("_s") > 0, 1)).alias("_k"))
    spread = F.sqrt(F.greatest(F.var_pop("_wr"), F.lit(0.0)) * horizon)
    k = F.max("_k")
    return sums.agg(
        F.count(F.lit(1)).alias("n_times"),
        F.round(z * spread / max(equity, 1.0), 6).alias("var_pct"), F.round(z * spread, 4).alias("var_usd"),
        F.round(spread * density / (1 - confidence), 4).alias("cvar_usd"),
        F.when(k > 1, F.round(F.try_divide(F.var_pop("_zz") - k, (k * (k - 1)).cast("double")), 3)).otherwise(0.0).alias("correlation_avg"))


def max_allowed_lots(returns: Series, var_usd: DataFrame, equity: float, max_var: float = 0.02,
                     confidence: float = 0.99, horizon: int = 1, pip_value: float = 10.0, rows: int = 60) -> DataFrame:
    """Largest lots per pair that keep the book inside its risk budget (``var_usd`` is the one-row VaR)."""
    z, _ = NORMAL[confidence]
    s = returns.apply(_recent_deviation("ret", rows, 1))
    last = s.df.groupBy(*returns.keys).agg(F.max_by("_dev", F.struct(*returns.order)).alias("_dev"))
    unit = F.col("_dev") * math.sqrt(horizon) * pip_value
    used = var_usd.select(F.lit(1).alias("_one"), F.col("var_usd").alias("_used"))
    left = F.greatest(F.lit(equity * max_var) - F.col("_used"), F.lit(0.0))
    cap = F.when(unit < 1e-9, 5.0).otherwise(F.round(clip(left / (z * unit), 0.01, 10.0), 2))
    return last.withColumn("_one", F.lit(1)).join(F.broadcast(used), "_one").select(*returns.keys, cap.alias("max_lots"))
