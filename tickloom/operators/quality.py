"""Tick hygiene, filters, splits and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Carry, Series, Step, add, rolling
from tickloom.core.storage import lookup
from tickloom.functions.scalar import flag, pip_size, seconds

TICK_COLUMNS = ("bid", "ask", "mid", "spread", "volume", "pair", "source")

# Words that mark a high-impact economic release.
HIGH_IMPACT = (
    "NFP", "NonFarm", "Non-Farm", "Payroll",
    "CPI", "Inflation", "Core CPI",
    "FOMC", "Fed", "Interest Rate Decision",
    "GDP", "Gross Domestic",
    "PMI", "Purchasing Managers",
    "ECB", "European Central",
    "BOE", "Bank of England",
    "BOJ", "Bank of Japan",
    "RBA", "Reserve Bank of Australia",
    "Retail Sales",
    "Unemployment", "Jobless",
)

# Multiple of the average range admitted in each curriculum phase.
PHASES = {"low_vol": 0.7, "normal_vol": 1.5, "high_vol": 3.0, "full": None}


def enforce_schema(df: DataFrame, pair: str | None = None, source: str | None = None) -> DataFrame:
    """Unified tick columns; rows whose bid is not below the ask are dropped."""
    have = set(df.columns)
    if not {"bid", "ask"} <= have:
        raise ValueError(f"bid and ask are required, got {sorted(have)}")
    derived = {
        "mid": (F.col("bid") + F.col("ask")) / 2,
        "spread": F.col("ask") - F.col("bid"),
        "volume": F.lit(1.0),
    }
    df = df.withColumns({c: x for c, x in derived.items() if c not in have})
    tags = {c: F.lit(v) for c, v in (("pair", pair), ("source", source)) if v is not None}
    df = df.withColumns(tags) if tags else df
    return df.where("bid < ask").select("ts", *TICK_COLUMNS)


def to_utc(ts: Column, zone: str | Column | None = None) -> Column:
    """Instant in UTC: a zone-less value is UTC already unless a zone is given."""
    return ts.cast("timestamp") if zone is None else F.to_utc_timestamp(ts, zone)


def repair_spikes(z: float = 8.0, window: int = 60) -> Step:
    """Replace mid by the rolling median where it is more than z deviations off the rolling mean.

    The frame holds the row itself, so |z| cannot exceed (n-1)/sqrt(n): 7.6 for 60 rows.
    Prices are collected only near flagged rows.
    """
    def fn(f: DataFrame, w):
        mid = F.col("mid")
        f = f.withColumn("_dev", F.abs(mid - rolling(F.avg, mid, w, window))
                         / (rolling(F.stddev_samp, mid, w, window) + 1e-9))
        f = f.withColumn("_bad", F.coalesce(F.col("_dev") > z, F.lit(False)))
        f = f.withColumn("_near", F.max("_bad").over(w.rowsBetween(0, window - 1)))
        f = f.withColumn("_mids", F.collect_list(F.when(F.col("_near"), mid))
                         .over(w.rowsBetween(-(window - 1), 0)))
        ordered = F.array_sort("_mids")
        median = (F.get(ordered, F.lit((window - 1) // 2)) + F.get(ordered, F.lit(window // 2))) / 2
        half = (F.col("ask") - F.col("bid")) / 2
        fixed = F.when(F.col("_bad"), median).otherwise(mid)
        return f.withColumns({
            "bid": F.when(F.col("_bad"), fixed - half).otherwise(F.col("bid")),
            "ask": F.when(F.col("_bad"), fixed + half).otherwise(F.col("ask")),
            "mid": fixed, "repaired": F.col("_bad"),
        }).drop("_dev", "_bad", "_near", "_mids")
    return Step(fn, before=2 * (window - 1), after=window - 1)


def standardise(df: DataFrame, z: float = 8.0, window: int = 60) -> DataFrame:
    """Required columns, derived mid, spike repair, positive spread only."""
    if not {"bid", "ask"} <= set(df.columns):
        raise ValueError(f"bid and ask are required, got {df.columns}")
    if "mid" not in df.columns:
        df = df.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    fixed = Series.of(df).apply(repair_spikes(z, window)).df
    return (fixed.drop("repaired").withColumn("spread", F.col("ask") - F.col("bid"))
                 .where("spread > 0"))


def in_session(ts: Column, start: str = "07:00", end: str = "21:00") -> Column:
    """Weekday and clock time within [start, end], to the second."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    as_seconds = lambda s: int(s[:2]) * 3600 + int(s[3:5]) * 60
    return clock.between(as_seconds(start), as_seconds(end)) & (F.weekday(ts) < 5)


def in_hours(ts: Column, hours: Sequence[int] = tuple(range(7, 18))) -> Column:
    return F.hour(ts).isin(*hours)


def quality_report(ticks: Series) -> DataFrame:
    gap = add(1, lambda w: {"_gap": seconds(F.col("ts")) - seconds(F.lag("ts").over(w))})
    pip = F.first(pip_size(F.col("pair")))
    bad = F.count_if(F.expr("spread <= 0")) + F.count_if(F.expr("bid >= ask"))
    return (ticks.apply(gap).df.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n_ticks"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.round(F.avg("spread") / pip, 3).alias("avg_spread_pips"),
        F.round(F.min("spread") / pip, 3).alias("min_spread_pips"),
        F.round(F.max("spread") / pip, 3).alias("max_spread_pips"),
        F.round(F.avg("_gap"), 3).alias("avg_gap_seconds"),
        F.round(F.max("_gap"), 1).alias("max_gap_seconds"),
        F.count_if(F.expr("_gap > 60")).alias("n_gaps_over_1min"),
        F.count_if(F.expr("spread <= 0")).alias("n_spread_anomalies"),
        F.count_if(F.expr("bid >= ask")).alias("n_bid_ask_inversions"),
        F.round(100 * (1 - bad / F.count(F.lit(1))), 2).alias("quality_score"),
    ))


def chronological_split(s: Series, ratio: float = 0.7) -> DataFrame:
    """Tag each row train or test: the first floor(n * ratio) rows of a key are train."""
    sizes = s.frame.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = s.indexed("_pos").df
    return (lookup(rows, sizes, s.keys)
                .withColumn("part", F.when(F.col("_pos") <= F.floor(F.col("_n") * F.lit(ratio)), "train")
                                     .otherwise("test"))
                .drop("_pos", "_n"))


def in_period(ts: Column, start: str, end: str) -> Column:
    return ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def hold_out(df: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(development rows, held-out rows); both ends of the period are held out."""
    inside = in_period(F.col("ts"), start, end)
    return df.where(~inside), df.where(inside)


def leak_report(df: DataFrame, start: str, end: str, by: Sequence[str] = ("pair",)) -> DataFrame:
    leaked = F.count_if(in_period(F.col("ts"), start, end))
    return df.groupBy(*by).agg(leaked.alias("leaked_rows"), (leaked == 0).alias("clean"))


def curriculum_filter(df: DataFrame, phase: str, atr_col: str, avg_atr: Column | float) -> DataFrame:
    limit = PHASES[phase]
    avg = F.lit(avg_atr) if isinstance(avg_atr, float) else avg_atr
    return df if limit is None else df.where(F.abs(F.col(atr_col)) <= limit * avg)


def curriculum_phases(df: DataFrame, atr_col: str, avg_atr: Column | float, name: str = "phase") -> DataFrame:
    """Each row once for every phase that takes it, in one scan."""
    size, avg = F.abs(F.col(atr_col)), F.lit(avg_atr) if isinstance(avg_atr, float) else avg_atr
    taken = [F.lit(phase) if limit is None else F.when(size <= limit * avg, F.lit(phase)) for phase, limit in PHASES.items()]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*taken))))


def high_impact(event: Column, words: Sequence[str] = HIGH_IMPACT) -> Column:
    pattern = "|".join(rf"\Q{w.lower()}\E" for w in words)
    return F.lower(event).rlike(pattern)


def vol_ok(atr_col: str = "atr_6", mult: float = 3.0, lookback: int = 60) -> Step:
    atr = F.col(atr_col)
    return add(lookback - 1, lambda w: {"vol_ok": flag(atr <= mult * rolling(F.avg, atr, w, lookback))})


def vol_spike(atr_col: str = "atr_6", mult: float = 2.0, lookback: int = 60) -> Step:
    atr = F.col(atr_col)
    return add(lookback - 1, lambda w: {
        "vol_spike": F.coalesce(atr > mult * rolling(F.avg, atr, w, lookback), F.lit(False))})


def sentiment_gate(signal: Column, bias: Column, threshold: float = 0.3) -> Column:
    """0 buy, 1 hold, 2 sell: a strong bias turns the opposing signal into hold."""
    return (F.when((bias > threshold) & (signal == 2), 1)
             .when((bias < -threshold) & (signal == 0), 1)
             .otherwise(signal))


def return_correlations(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """Correlation of every two pairs' returns at common times: (pair, other, corr), each two once.

    Rows meet by time; a time has one row per pair, so pairs, not rows, are what multiplies.
    """
    a = returns.select("ts", "pair", F.col(ret).alias("_x"))
    b = returns.select("ts", F.col("pair").alias("other"), F.col(ret).alias("_y"))
    both = a.join(b, "ts").where(F.col("pair") < F.col("other"))
    return both.groupBy("pair", "other").agg(F.corr("_x", "_y").alias("corr"))


def exposure_gate(signals: DataFrame, correlations: DataFrame, max_exposure: float = 1.5,
                  min_corr: float = 0.6) -> DataFrame:
    """Hold entries whose own lots plus same-direction correlated lots reach the limit.

    ``signals``: ts, pair, lots (signed position), signal. ``correlations``: pair, other, corr,
    each unordered pair stated once. Rows meet on (ts, other pair), an equi-join.
    """
    corr = correlations.where(F.col("corr") >= min_corr)
    both = corr.unionByName(corr.select(F.col("other").alias("pair"), F.col("pair").alias("other"), "corr"))
    side = F.when(F.col("signal") == 0, 1).when(F.col("signal") == 2, -1).otherwise(0)
    wanted = signals.withColumn("_side", side).where("_side <> 0")
    others = signals.select("ts", F.col("pair").alias("other"), F.col("lots").alias("_lots"))
    linked = (wanted.select("ts", "pair", "_side").join(both, "pair").join(others, ["ts", "other"])
                    .where(F.signum("_lots") == F.col("_side"))
                    .groupBy("ts", "pair").agg(F.sum(F.abs("_lots") * F.col("corr")).alias("_linked")))
    total = F.abs("lots") + F.coalesce("_linked", F.lit(0.0))
    return (signals.join(linked, ["ts", "pair"], "left")
                   .withColumn("exposure", total)
                   .withColumn("gated_signal", F.when((side != 0) & (total >= max_exposure), 1)
                                                .otherwise(F.col("signal")))
                   .drop("_linked"))


def fill_clean(columns: Sequence[str]) -> list[Step | Carry]:
    """Infinite to null, forward fill, then zero."""
    inf = float("inf")
    tidy = add(0, lambda w: {c: F.when((F.abs(F.col(c)) == inf) | F.isnan(c), None).otherwise(F.col(c))
                             for c in columns})
    return [tidy, Carry({f"_fill_{c}": ("last", F.col(c)) for c in columns}),
            Step(lambda f, w: f.withColumns({c: F.coalesce(f"_fill_{c}", F.lit(0.0)) for c in columns})
                               .drop(*[f"_fill_{c}" for c in columns]))]


def load_summary(ticks: DataFrame, requested: DataFrame) -> DataFrame:
    """Row count and time range for every requested pair, loaded or not."""
    found = ticks.groupBy("pair").agg(F.count(F.lit(1)).alias("ticks"), F.min("ts").alias("first_ts"),
                                      F.max("ts").alias("last_ts"),
                                      F.count("ts").alias("_with_ts"))
    return (requested.join(found, "pair", "left")
                     .withColumn("ticks", F.coalesce("ticks", F.lit(0)))
                     .withColumn("ts_usable", F.coalesce(F.col("_with_ts") == F.col("ticks"), F.lit(False)))
                     .drop("_with_ts"))
