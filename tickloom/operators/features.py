"""Rolling microstructure, volatility and momentum features of bars.

Every function returns steps for ``Series.apply``; frames are null until full.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Carry, Series, Step, add, rolling
from tickloom.functions.scalar import at_least, clip, flag, seconds

EPS = 1e-9


def _log_return(w, price: str = "close", lag: int = 1) -> Column:
    return F.ln(price) - F.ln(F.lag(price, lag).over(w))


def order_flow_imbalance(window: int = 20) -> Step:
    side = F.when(F.col("volume") != 0, F.signum(F.col("close") - F.col("open")))
    return add(window - 1, lambda w: {"ofi": rolling(F.avg, side, w, window)})


def arrival_rate(window: int = 30, rate: str | None = "n_ticks") -> list[Step]:
    """z-score of the tick count, or of volume over its rolling mean when ``rate`` is None."""
    def raw(w):
        if rate:
            return {"_rate": F.col(rate).cast("double")}
        vol = F.col("volume")
        return {"_rate": vol / (rolling(F.avg, vol, w, window) + EPS)}

    r = F.col("_rate")
    z = Step(lambda f, w: f.withColumn("tar", (r - rolling(F.avg, r, w, window))
                                       / (rolling(F.stddev_samp, r, w, window) + EPS)).drop("_rate"),
             before=window - 1)
    return [add(window - 1, raw), z]


def true_range_average(window: int = 6) -> list[Step]:
    def tr(w):
        prev = F.lag("close").over(w)
        return {"_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                                  F.abs(F.col("low") - prev))}
    mean = Step(lambda f, w: f.withColumn(f"atr_{window}", rolling(F.avg, F.col("_tr"), w, window)).drop("_tr"),
                before=window - 1)
    return [add(1, tr), mean]


def log_return(out: str = "ret", price: str = "close", lag: int = 1) -> Step:
    return add(lag, lambda w: {out: _log_return(w, price, lag)})


def realised_volatility(window: int = 20, ret: str = "ret") -> Step:
    return add(window - 1, lambda w: {f"vol_{window}": rolling(F.stddev_samp, F.col(ret), w, window)})


def bollinger(window: int = 20, width: float = 2.0) -> Step:
    close = F.col("close")

    def fn(w):
        mid, dev = rolling(F.avg, close, w, window), rolling(F.stddev_samp, close, w, window)
        up, lo = mid + width * dev, mid - width * dev
        return {"bb_mid": mid, "bb_upper": up, "bb_lower": lo,
                "bb_width": (up - lo) / (mid + EPS),
                "bb_pct": clip((close - lo) / (up - lo + EPS), 0.0, 1.0)}
    return add(window - 1, fn)


def rsi(period: int = 14) -> list[Step]:
    d = F.col("_diff")

    def fn(f: DataFrame, w):
        gain = rolling(F.avg, F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), w, period)
        loss = rolling(F.avg, F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), w, period) + EPS
        return f.withColumn(f"rsi_{period}", 100 - 100 / (1 + gain / loss)).drop("_diff")
    return [add(1, lambda w: {"_diff": F.col("close") - F.lag("close").over(w)}),
            Step(fn, before=period - 1)]


def lagged_returns(lags: Sequence[int] = (5, 20, 60)) -> Step:
    return add(max(lags), lambda w: {f"ret_{n}": _log_return(w, lag=n) for n in lags})


def ewm(s: Series, specs: dict[str, tuple[Column, int]], index: str | None = None) -> Series:
    """Exponential averages y = a*x + (1-a)*y_prev, first value x: name -> (expression, span).

    Rows are cut by position into runs long enough that a run's start weighs under 1e-9
    at its end. Each run is scanned alone; the average entering a run is the weighted
    sum of the three runs before it, exact to double precision. Expressions must not be null.
    """
    decay = {name: 1 - 2 / (span + 1) for name, (_, span) in specs.items()}
    run = max(math.ceil(math.log(1e-9) / math.log(d)) for d in decay.values())
    if index is None:
        s = s.indexed("_pos")
        index = "_pos"
    pos = F.col(index) - 1
    f = s.frame.withColumns({"_run": F.floor(pos / run), "_at": F.pmod(pos, F.lit(run)).cast("double")})
    from pyspark.sql import Window

    w = (Window.partitionBy(*s.keys, "_run").orderBy(*s.order)
               .rowsBetween(Window.unboundedPreceding, 0))
    own = {}
    for name, (x, span) in specs.items():
        a = 2 / (span + 1)
        weight = F.when(F.col(index) == 1, 1.0).otherwise(a)
        own[f"_own_{name}"] = (F.sum(weight * x * F.pow(F.lit(decay[name]), -F.col("_at"))).over(w)
                               * F.pow(F.lit(decay[name]), F.col("_at")))
    f = f.withColumns(own)
    ends = (f.groupBy(*s.keys, "_run").agg(*[F.max_by(f"_own_{n}", "_at").alias(f"_end_{n}") for n in specs])
             .withColumn("_back", F.explode(F.array(*[F.lit(i) for i in range(3)]))))
    inflow = (ends.groupBy(*s.keys, (F.col("_run") + 1 + F.col("_back")).alias("_run"))
                  .agg(*[F.sum(F.col(f"_end_{n}") * F.pow(F.lit(decay[n] ** run), F.col("_back"))).alias(f"_in_{n}")
                         for n in specs]))
    joined = f.join(inflow, [*s.keys, "_run"], "left")
    out = {n: F.col(f"_own_{n}") + F.coalesce(f"_in_{n}", F.lit(0.0)) * F.pow(F.lit(decay[n]), F.col("_at") + 1)
           for n in specs}
    drop = ["_run", "_at", *[f"_own_{n}" for n in specs], *[f"_in_{n}" for n in specs]]
    drop += ["_pos"] if index == "_pos" else []
    return s.with_frame(joined.withColumns(out).drop(*drop))


def macd(s: Series, fast: int = 12, slow: int = 26, signal: int = 9) -> Series:
    s = s.indexed("_macd_i")
    s = ewm(s, {"_fast": (F.col("close"), fast), "_slow": (F.col("close"), slow)}, "_macd_i")
    s = s.map(lambda f: f.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow"))
    s = ewm(s, {"macd_sig": (F.col("macd"), signal)}, "_macd_i")
    return s.map(lambda f: f.withColumn("macd_hist", F.col("macd") - F.col("macd_sig")).drop("_macd_i"))


def tick_volume_imbalance(window: int = 20) -> list[Step]:
    tick, vol = F.col("_tick"), F.col("volume").cast("double")

    def parts(w):
        tick = F.signum(F.col("close") - F.lag("close").over(w))
        return {"_tick": tick, "_vmean": rolling(F.avg, vol, w, window)}

    def flows(w):
        flat = vol * 0.5 * flag(tick == 0)
        buy, sell = vol * flag(tick > 0) + flat, vol * flag(tick < 0) + flat
        return {"tvi_buy": rolling(F.sum, buy, w, window), "tvi_sell": rolling(F.sum, sell, w, window),
                "tvi_impact": rolling(F.avg, tick * vol / (F.col("_vmean") + EPS), w, window)}

    def ratios(f: DataFrame, w):
        b, s = F.col("tvi_buy"), F.col("tvi_sell")
        return f.withColumns({"tvi_imbalance": (b - s) / (b + s + EPS),
                              "tvi_ratio": clip(b / (s + EPS), 0.0, 5.0)}).drop("_tick", "_vmean")
    return [add(window - 1, parts), add(window - 1, flows), Step(ratios)]


def trend_score(window: int = 20) -> list[Step]:
    """Range volatility over close-to-close volatility, and the trend proxies built on it."""
    price = lambda c: F.greatest(F.col(c), F.lit(1e-12))

    def parts(w):
        prev = F.lag(price("close")).over(w)
        return {"_hl2": F.pow(F.ln(price("high") / price("low")), 2), "_cc": F.ln(price("close") / prev)}

    def fn(f: DataFrame, w):
        parkinson = F.sqrt(rolling(F.avg, F.col("_hl2"), w, window, 2) / (4 * math.log(2)))
        dev = rolling(F.stddev_samp, F.col("_cc"), w, window, 2)
        ratio = F.coalesce(at_least(parkinson / (dev + 1e-8), 0.01), F.lit(1.0))
        f = f.withColumn("parkinson_trend_ratio", ratio)
        f = f.withColumn("hurst", 0.5 + 0.25 * F.tanh(F.col("parkinson_trend_ratio") - 1.0))
        return f.withColumn("regime_label", regime_label(F.col("hurst"))).drop("_hl2", "_cc")
    return [add(1, parts), Step(fn, before=window - 1)]


def regime_label(h: Column, high: float = 0.6, low: float = 0.4) -> Column:
    return F.when(h > high, 1.0).when(h < low, -1.0).otherwise(0.0)


def options_proxies(window: int = 20, zero_off_side: bool = False) -> list[Step | Carry]:
    """Range volatility, return skew, short/long volatility ratio, up/down deviation difference.

    The up (down) deviation covers the last ``window`` up (down) returns, at least five,
    and holds between them. ``zero_off_side`` reports 0 on rows that are not up moves.
    """
    r, year = F.col("_r"), math.sqrt(252)

    def parts(w):
        gk = (0.5 * F.pow(F.ln("high") - F.ln("low"), 2)
              - (2 * math.log(2) - 1) * F.pow(_log_return(w), 2))
        return {"_r": _log_return(w), "_gk": gk}

    def skew(w):
        n = window
        scale = math.sqrt(n * (n - 1)) / (n - 2)
        short, long = rolling(F.stddev_samp, r, w, 5), rolling(F.stddev_samp, r, w, 60)
        return {"iv_proxy": F.sqrt(rolling(F.avg, F.col("_gk"), w, window)) * year,
                "skew_proxy": rolling(F.skewness, r, w, window) * scale,
                "term_proxy": clip(short * year / (long * year + EPS), 0.3, 3.0)}

    counts = Carry({"_nu": ("count", F.when(r > 0, r)), "_nd": ("count", F.when(r < 0, r))})
    return [add(1, parts), add(59, skew), counts]


def side_deviations(s: Series, window: int = 20, min_periods: int = 5) -> Series:
    """Deviation of the last ``window`` returns of each sign, held until the next one.

    Returns of one sign form their own series, so each is windowed alone and joined back.
    """
    key = [*s.keys, *s.order]
    base = s
    for out, cond in (("_up", F.col("_r") > 0), ("_dn", F.col("_r") < 0)):
        part = Series.of(base.df.where(cond).select(*key, "_r"), s.keys, s.order, s.block_rows)
        dev = part.apply(add(window - 1, lambda w, out=out: {
            out: rolling(F.stddev_samp, F.col("_r"), w, window, min_periods)})).df.drop("_r")
        s = s.with_frame(s.frame.join(dev, key, "left"))
    return s


def risk_reversal(s: Series, window: int = 20, zero_off_side: bool = False) -> Series:
    s = side_deviations(s, window)
    s = s.apply(Carry({"_up_held": ("last", F.col("_up")), "_dn_held": ("last", F.col("_dn"))}))
    up = F.col("_up") if zero_off_side else F.col("_up_held")
    rr = (up - F.col("_dn_held")) * math.sqrt(252)
    return s.map(lambda f: f.withColumn("risk_reversal", clip(F.coalesce(rr, F.lit(0.0)), -0.05, 0.05) / 0.05)
                            .drop("_up", "_dn", "_up_held", "_dn_held"))


def positioning(long: str = "long_noncom", short: str = "short_noncom", lag: int = 7) -> Step:
    net = (F.col(long) - F.col(short)) / (F.col(long) + F.col(short) + EPS)

    def fn(f: DataFrame, w):
        f = f.withColumn("cot_net", net)
        return f.withColumns({
            "cot_noncom_net": F.col("cot_net"),
            "cot_extreme": flag(F.abs("cot_net") > 0.7),
            "cot_change": F.coalesce(F.col("cot_net") - F.lag("cot_net", lag).over(w), F.lit(0.0))})
    return Step(fn, before=lag)


def decayed(score: str, out: str, rate: float = 0.1) -> list[Carry | Step]:
    """Last non-zero score times exp(-rate * seconds since it); 0 before the first."""
    hit = F.when(F.col(score) != 0, F.struct(F.col("ts").alias("at"), F.col(score).alias("v")))
    fade = F.exp(-rate * (seconds(F.col("ts")) - seconds(F.col("_hit.at"))))
    return [Carry({"_hit": ("last", hit)}),
            Step(lambda f, w: f.withColumn(out, F.coalesce(F.col("_hit.v") * fade, F.lit(0.0))).drop("_hit"))]


def buzz(count: str, window: int = 5) -> Step:
    return add(window - 1, lambda w: {"buzz": F.coalesce(rolling(F.sum, F.col(count), w, window), F.lit(0.0))})


def fracdiff_weights(d: float = 0.4, threshold: float = 1e-5) -> list[float]:
    """Weights of the binomial series of (1-B)**d, newest first, cut below the threshold."""
    weights, k = [1.0], 1
    while True:
        nxt = weights[-1] * (k - 1 - d) / k
        if abs(nxt) < threshold:
            return weights
        weights.append(nxt)
        k += 1


def fractional_difference(s: Series, d: float = 0.4, threshold: float = 1e-5, price: str = "close",
                          out: str = "close_ffd", oldest_first: bool = False) -> Series:
    """Fixed-width fractional difference; null until the window is full.

    ``oldest_first`` gives the weight 1 to the oldest price instead of the newest.
    """
    weights = fracdiff_weights(d, threshold)
    return s.weighted(price, weights if oldest_first else weights[::-1], out)
