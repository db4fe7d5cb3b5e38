"""Cross-asset, macro and correlation-regime features."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.core.series import Carry, Series, Step, add, rolling
from tickloom.functions.scalar import clip, flag

# Assets whose features the core matrix carries.
ASSETS = ("DXY", "US10Y", "DE10Y", "US2Y", "WTI", "GOLD", "COPPER", "IRON_ORE", "SPX", "NASDAQ100", "VIX", "BTC")
# Spread name -> (first yield, second yield); carry name -> (spread, sign).
YIELD_SPREADS = {
    "spread_us_de": ("US10Y", "DE10Y"), "spread_us_jp": ("US10Y", "JP10Y"), "spread_us_gb": ("US10Y", "GB10Y"),
    "spread_us_au": ("AU10Y", "US10Y"), "spread_us_ca": ("US10Y", "CA10Y"),
}
CARRIES = {
    "carry_eur": ("spread_us_de", -1), "carry_jpy": ("spread_us_jp", 1), "carry_gbp": ("spread_us_gb", -1),
    "carry_aud": ("spread_us_au", 1), "carry_cad": ("spread_us_ca", -1),
}
EPS = 1e-9


def wide_panel(long: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(asset, ts, value) to one column per named asset; the names come from the caller."""
    return (long.where(F.col("asset").isin(*assets)).groupBy("ts")
                .agg(*[F.max(F.when(F.col("asset") == a, F.col("value"))).alias(a) for a in assets]))


def attach_panel(bars: DataFrame, panel: DataFrame, assets: Sequence[str], backfill: bool = False) -> DataFrame:
    """Each bar takes every asset's last value at or before it, worked once per distinct time."""
    times = bars.select("ts").distinct().withColumn("_side", F.lit(1))
    stacked = times.unionByName(panel.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    s = Series.of(stacked, [], ["ts", "_side"]).apply(
        Carry({f"_a_{a}": ("last", F.col(a)) for a in assets}))
    if backfill:
        s = s.apply(Carry({f"_b_{a}": ("last", F.col(a)) for a in assets}, reverse=True))
    values = [(F.coalesce(f"_a_{a}", f"_b_{a}") if backfill else F.col(f"_a_{a}")).alias(a) for a in assets]
    return bars.join(s.df.where("_side = 1").select("ts", *values), "ts")


def asset_returns(assets: Sequence[str], lags: Sequence[int] = (1, 5, 15)) -> list[Step]:
    def ret(w):
        logs = {a: F.ln(F.col(a)) - F.ln(F.lag(a).over(w)) for a in [*assets, "close"]}
        return {(f"{a}_ret" if a != "close" else "_fx"): x for a, x in logs.items()}
    return [add(1, ret), add(max(lags), lambda w: {
        f"{a}_ret_l{n}": F.lag(f"{a}_ret", n).over(w) for a in assets for n in lags})]


def panel_returns(times: DataFrame, panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(ts, asset..): log return of every asset from each distinct time to the next one."""
    levels = attach_panel(times.select("ts").distinct(), panel, assets)
    s = Series.of(levels, [], ["ts"]).apply(
        add(1, lambda w: {f"_r_{a}": F.ln(F.col(a)) - F.ln(F.lag(a).over(w)) for a in assets}))
    return s.df.select("ts", *[F.col(f"_r_{a}").alias(a) for a in assets])


def _moments(x: Column, y: Column, w, rows: int) -> dict[str, Column]:
    """Sums over the complete pairs of the last ``rows`` rows.

    Returns centre on zero, so plain sums lose nothing, and a window of sums stays small
    enough as generated code to be compiled for a dozen assets at once.
    """
    frame = w.rowsBetween(-(rows - 1), 0)
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    total = lambda c: F.sum(c).over(frame)
    return {"n": F.count(x * y).over(frame), "x": total(px), "y": total(py),
            "xx": total(px * px), "yy": total(py * py), "xy": total(x * y)}


def _corr_of(m: dict[str, Column], least: int) -> Column:
    """Correlation from the sums; null with too few pairs or when one side does not vary."""
    vx, vy = m["n"] * m["xx"] - m["x"] * m["x"], m["n"] * m["yy"] - m["y"] * m["y"]
    varies = (vx > 1e-12 * m["n"] * m["xx"]) & (vy > 1e-12 * m["n"] * m["yy"])
    return F.when((m["n"] >= least) & varies, (m["n"] * m["xy"] - m["x"] * m["y"]) / (F.sqrt(vx) * F.sqrt(vy)))


def rolling_corr(x: str, y: str, out: str, rows: int, least: int) -> list[Step]:
    """Correlation of the complete pairs among the last ``rows`` rows."""
    names = ("n", "x", "y", "xx", "yy", "xy")
    col = {k: F.col(f"_m_{k}") for k in names}
    return [add(rows - 1, lambda w: {f"_m_{k}": c for k, c in _moments(F.col(x), F.col(y), w, rows).items()}),
            Step(lambda f, w: f.withColumn(out, _corr_of(col, least)).drop(*[f"_m_{k}" for k in names]))]


def asset_links(assets: Sequence[str], window: int = 60) -> list[Step]:
    """Rolling correlation and beta of each asset's return against the pair's own return."""
    least = max(5, window // 4)
    names = ("n", "x", "y", "xx", "yy", "xy")
    fx = F.col("_fx")

    def sums(w):
        out = {"_fx_var": rolling(F.var_samp, fx, w, window, least)}
        for a in assets:
            out.update({f"_{k}_{a}": c for k, c in _moments(F.col(f"{a}_ret"), fx, w, window).items()})
        return out

    def links(f: DataFrame, w):
        out = {}
        for a in assets:
            m = {k: F.col(f"_{k}_{a}") for k in names}
            cov = F.when(m["n"] >= least, (m["xy"] - m["x"] * m["y"] / m["n"]) / (m["n"] - 1))
            out[f"{a}_corr"], out[f"{a}_beta"] = _corr_of(m, least), cov / (F.col("_fx_var") + EPS)
        return f.withColumns(out).drop("_fx_var", *[f"_{k}_{a}" for k in names for a in assets])
    return [add(window - 1, sums), Step(links)]


def macro_links(window: int = 60, regime_window: int = 240) -> list[Step]:
    """Yield spreads and changes, risk-off share, gold-dollar correlation break, commodity lead."""
    least, regime_least = max(5, window // 4), max(5, regime_window // 4)

    def first(f: DataFrame, w):
        f = f.withColumns({"yield_spread_us_de_10y": F.col("US10Y") - F.col("DE10Y"),
                           "us_2s10s_spread": F.col("US10Y") - F.col("US2Y")})
        diff = lambda c: F.col(c) - F.lag(c).over(w)
        return f.withColumns({
            "yield_spread_us_de_10y_chg": diff("yield_spread_us_de_10y"),
            "us_2s10s_spread_chg": diff("us_2s10s_spread"),
            "risk_off_signal": (flag(F.col("SPX_ret") < 0) + flag(F.col("VIX_ret") > 0)) / 2,
            "commodity_fx_lead": 0.6 * F.lag("COPPER_ret").over(w) + 0.4 * F.lag("WTI_ret").over(w)})

    corr = F.col("gold_dxy_corr")
    second = add(regime_window - 1, lambda w: {
        "gold_dxy_corr_break": F.abs(corr - rolling(F.avg, corr, w, regime_window, regime_least))})
    return [Step(first, before=1), *rolling_corr("GOLD_ret", "DXY_ret", "gold_dxy_corr", window, least), second]


def break_scores(lookback: int = 60, risk_lookback: int = 30) -> Step:
    """Rolling z-scores, clipped to +-6, that drive the regime-break probability."""
    def z(w, c, lb):
        x, least = F.col(c), max(10, lb // 4)
        return clip((x - rolling(F.avg, x, w, lb, least)) / (rolling(F.stddev_samp, x, w, lb, least) + EPS), -6.0, 6.0)

    return add(lookback - 1, lambda w: {
        "gold_break_z": z(w, "gold_dxy_corr_break", lookback),
        "curve_chg_z": z(w, "us_2s10s_spread_chg", lookback),
        "yield_chg_z": z(w, "yield_spread_us_de_10y_chg", lookback),
        "risk_off_z": z(w, "risk_off_signal", risk_lookback)})


def closed_form_break_probability() -> Column:
    score = (0.8 * F.coalesce("gold_break_z", F.lit(0.0)) + 0.5 * F.coalesce("risk_off_z", F.lit(0.0))
             + 0.3 * F.coalesce(F.abs("curve_chg_z"), F.lit(0.0)))
    return 1 / (1 + F.exp(-clip(score, -8.0, 8.0)))


def gates(prob: str = "regime_break_prob") -> dict[str, Column]:
    p = F.col(prob)
    return {"gate_gold_weight": clip(0.2 + 0.8 * p, 0.0, 1.0),
            "gate_yield_weight": clip(1.0 - 0.7 * p, 0.0, 1.0),
            "gate_risk_weight": clip(0.3 + 0.7 * p, 0.0, 1.0)}


def fitted_break_probability(scored: DataFrame, train_until: str | None = None, min_rows: int = 80) -> DataFrame:
    """Logistic model of the pseudo-label on rows up to ``train_until``, over all pairs together.

    With too few complete rows or one class, the closed form is used. Incomplete rows get 0.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cols = ["gold_break_z", "curve_chg_z", "yield_chg_z", "risk_off_z"]
    stressed = (F.col("risk_off_z") > 0.5) | (F.abs("curve_chg_z") > 1.0)
    labelled = scored.withColumn("_y", flag((F.col("gold_break_z") > 1.0) & stressed))
    whole = labelled.dropna(subset=cols)
    train = whole if train_until is None else whole.where(F.col("ts") <= F.lit(train_until).cast("timestamp_ntz"))
    rows, ones = train.agg(F.count(F.lit(1)), F.sum("_y")).first()
    if rows < min_rows or not 0 < (ones or 0) < rows:
        return labelled.withColumn("regime_break_prob", closed_form_break_probability()).drop("_y")
    assembler = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=500, regParam=1.0 / rows,
                               standardization=False, probabilityCol="_p",
                               rawPredictionCol="_raw", predictionCol="_c").fit(assembler.transform(train))
    out = model.transform(assembler.transform(labelled))
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return (out.withColumn("regime_break_prob", F.when(complete, vector_to_array("_p")[1]).otherwise(0.0))
               .drop("_x", "_y", "_p", "_raw", "_c"))


def macro_yields(momentum: Sequence[int] = (5, 20), vol: int = 20) -> Step:
    """Yield spreads, carries, and momentum/deviation of the primary spread, in rows."""
    def fn(f: DataFrame, w):
        f = f.withColumns({s: F.col(a) - F.col(b) for s, (a, b) in YIELD_SPREADS.items()})
        primary = F.col("spread_us_de")
        return f.withColumns({
            **{c: F.col(s) * sign for c, (s, sign) in CARRIES.items()},
            **{f"yield_momentum_{n}d": primary - F.lag(primary, n).over(w) for n in momentum},
            f"yield_vol_{vol}d": F.coalesce(rolling(F.stddev_samp, primary, w, vol), F.lit(0.0))})
    return Step(fn, before=max(*momentum, vol - 1))


def correlation_regime(returns: Sequence[str], window: int = 60) -> list[Step]:
    """Mean and dispersion of pairwise correlations over the previous ``window`` rows, z-score and break."""
    pairs = list(combinations(returns, 2))
    whole = F.lit(True)
    for c in returns:
        whole = whole & F.col(c).isNotNull()

    def sums(w):
        frame = w.rowsBetween(-window, -1)
        part = {a: F.when(whole, F.col(a)) for a in returns}
        out = {"_n": F.count(F.when(whole, 1)).over(frame), "_rows": F.count(F.lit(1)).over(frame)}
        for a in returns:
            out[f"_x_{a}"], out[f"_xx_{a}"] = F.sum(part[a]).over(frame), F.sum(part[a] * part[a]).over(frame)
        out.update({f"_xy{i}": F.sum(part[a] * part[b]).over(frame) for i, (a, b) in enumerate(pairs)})
        return out

    def corr(f: DataFrame, w):
        full = (F.col("_n") >= window // 2) & (F.col("_rows") == window)

        def one(i, a, b):
            m = {"n": F.col("_n"), "x": F.col(f"_x_{a}"), "y": F.col(f"_x_{b}"), "xx": F.col(f"_xx_{a}"),
                 "yy": F.col(f"_xx_{b}"), "xy": F.col(f"_xy{i}")}
            return F.when(full, _corr_of(m, 2))
        f = f.withColumns({f"_c{i}": one(i, a, b) for i, (a, b) in enumerate(pairs)})
        return f.drop("_n", "_rows", *[f"_x_{a}" for a in returns], *[f"_xx_{a}" for a in returns],
                      *[f"_xy{i}" for i in range(len(pairs))])

    def stats(f: DataFrame, w):
        cs = F.array(*[F.col(f"_c{i}") for i in range(len(pairs))])
        n = float(len(pairs))
        mean = F.aggregate(cs, F.lit(0.0), lambda a, x: a + x) / n
        f = f.withColumns({"corr_avg": mean, "_corrs": cs})
        var = F.aggregate("_corrs", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("corr_avg"), 2)) / n
        return f.withColumn("corr_dispersion", F.sqrt(var)).drop(*[f"_c{i}" for i in range(len(pairs))])

    def z(f: DataFrame, w):
        x = F.col("corr_avg")
        f = f.withColumn("corr_zscore", (x - rolling(F.avg, x, w, 3 * window))
                         / (rolling(F.stddev_samp, x, w, 3 * window) + EPS))
        return f.withColumn("corr_break", flag(F.abs("corr_zscore") > 2.0))
    return [add(window, sums), Step(corr), Step(stats), Step(z, before=3 * window - 1)]


def eigen_ratio(df: DataFrame, n_assets: int) -> DataFrame:
    """Largest over second-largest absolute eigenvalue of each row's correlation matrix, in Arrow batches."""
    upper = np.triu_indices(n_assets, 1)

    @pandas_udf("double")
    def ratio(corrs: pd.Series) -> pd.Series:
        out = np.full(len(corrs), np.nan)
        ok = corrs.map(lambda c: c is not None and not any(v is None or v != v for v in c)).to_numpy(bool)
        if ok.any():
            m = np.tile(np.eye(n_assets), (int(ok.sum()), 1, 1))
            vals = np.stack(corrs[ok].to_list()).astype(float)
            m[:, upper[0], upper[1]] = vals
            m[:, upper[1], upper[0]] = vals
            eig = np.sort(np.abs(np.linalg.eigvalsh(m)), axis=1)
            out[ok] = eig[:, -1] / (eig[:, -2] + EPS)
        return pd.Series(out)
    r = ratio("_corrs")
    return df.withColumn("corr_eigenratio", F.when(~F.isnan(r), r)).drop("_corrs")
