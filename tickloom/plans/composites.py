"""Operators chained into whole preparations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Series
from tickloom.core.storage import landed
from tickloom.functions import scalar as S
from tickloom.operators import asof, book, cross_asset as X, features as W, fractal as H, quality as Q
from tickloom.operators.bars import to_bars


@dataclass(frozen=True)
class BarSpec:
    freq: str = "1 minute"
    session: bool = True
    start: str = "07:00"
    end: str = "21:00"
    fractional: bool = True
    order: float = 0.4
    threshold: float = 1e-5


def clean_bars(ticks: DataFrame, spec: BarSpec = BarSpec()) -> DataFrame:
    """Ticks to bars, session hours only, fractional difference of the close, complete rows.

    Rolling frames then run over the remaining rows, so they span nights and weekends.
    """
    bars = to_bars(ticks, spec.freq, tie="tick_id" if "tick_id" in ticks.columns else None)
    if spec.session:
        bars = bars.where(Q.in_session(F.col("ts"), spec.start, spec.end))
    if spec.fractional:
        bars = W.fractional_difference(Series.of(bars), spec.order, spec.threshold).df
    return bars.dropna()


@dataclass(frozen=True)
class FeatureSpec:
    atr: int = 6
    ofi: int = 20
    arrival: int = 30
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    bands: int = 20
    lags: tuple[int, ...] = (5, 20, 60)
    vol_mult: float = 3.0
    news_minutes: float = 15.0
    decay: float = 0.1
    assets: tuple[str, ...] = X.ASSETS
    corr_window: int = 60
    regime_window: int = 240
    embedding_dims: int = 8


def feature_columns(spec: FeatureSpec = FeatureSpec()) -> list[str]:
    """Names of the core matrix, a function of the configuration alone."""
    cols = ["ofi", "obi_proxy", "tar", f"atr_{spec.atr}", "vol_20", "bb_mid", "bb_upper", "bb_lower", "bb_width",
            "bb_pct", f"rsi_{spec.rsi}", "macd", "macd_sig", "macd_hist", *[f"ret_{n}" for n in spec.lags], "spread_pips"]
    for a in spec.assets:
        cols += [f"{a}_ret", *[f"{a}_ret_l{k}" for k in (1, 5, 15)], f"{a}_corr", f"{a}_beta"]
    cols += ["yield_spread_us_de_10y", "yield_spread_us_de_10y_chg", "us_2s10s_spread", "us_2s10s_spread_chg",
             "risk_off_signal", "gold_dxy_corr", "gold_dxy_corr_break", "commodity_fx_lead", "vol_ok", "news_ok",
             "regime_break_prob", "gate_gold_weight", "gate_yield_weight", "gate_risk_weight",
             "sentiment_decayed", "eco_surprise", "buzz", *[f"fb_{i}" for i in range(spec.embedding_dims)],
             "time_sin", "time_cos", "day_sin", "day_cos", "london_ny"]
    return cols


def core_features(bars: DataFrame, panel: DataFrame, releases: DataFrame | None = None, scores: DataFrame | None = None,
                  articles: DataFrame | None = None, embeddings: DataFrame | None = None,
                  spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Core feature matrix; rows with any null are dropped.

    ``panel``: wide daily series by asset. ``releases``: economic events. ``scores`` (pair, ts, score) and
    ``articles`` (pair, ts, n): taken at or before each bar; a score decays from the time it was given.
    ``embeddings`` (pair, ts, fb_0..): exact times. Missing inputs give constant columns.
    """
    f = X.attach_panel(bars, panel, spec.assets)
    f = asof.event_distances(f, releases, spec.news_minutes) if releases is not None else f
    if scores is not None:
        stamped = scores.where("score <> 0").select("pair", "ts", F.col("score").alias("_score"), F.col("ts").alias("_score_at"))
        f = asof.as_of(f, stamped, ["_score", "_score_at"])
    if articles is not None:
        f = asof.as_of(f, articles.select("pair", "ts", F.col("n").cast("double").alias("_articles")), ["_articles"])
    if embeddings is not None:
        f = f.join(embeddings, ["pair", "ts"], "left")

    # The aligned inputs are written once: the window stages then plan and run on one narrow table.
    s = W.macd(Series.of(landed(f, "aligned")), *spec.macd)
    s = s.apply(W.order_flow_imbalance(spec.ofi), *W.arrival_rate(spec.arrival), *W.true_range_average(spec.atr),
                W.log_return("_lr"), W.realised_volatility(20, "_lr"), W.bollinger(spec.bands), *W.rsi(spec.rsi),
                W.lagged_returns(spec.lags), *X.asset_returns(spec.assets), *X.asset_links(spec.assets, spec.corr_window),
                *X.macro_links(spec.corr_window, spec.regime_window), X.break_scores(),
                Q.vol_ok(f"atr_{spec.atr}", spec.vol_mult))
    if articles is not None:
        s = s.map(lambda g: g.withColumn("_articles", F.coalesce("_articles", F.lit(0.0)))).apply(W.buzz("_articles"))
    f = s.df
    near = F.lit(spec.news_minutes)
    news = (1.0 - S.flag((F.col("eco_minutes_to_next") <= near) | (F.col("eco_minutes_since_last") <= near))
            if releases is not None else F.lit(1.0))
    fade = F.exp(-spec.decay * (S.seconds(F.col("ts")) - S.seconds(F.col("_score_at")))) if scores is not None else None
    have = set(f.columns)
    fixed = {
        "obi_proxy": S.range_position(), "spread_pips": S.spread_pips(f.columns), "news_ok": news,
        "regime_break_prob": X.closed_form_break_probability(),
        "sentiment_decayed": F.coalesce(F.col("_score") * fade, F.lit(0.0)) if scores is not None else F.lit(0.0),
        "eco_surprise": F.col("eco_surprise") if releases is not None else F.lit(0.0),
        **({} if articles is not None else {"buzz": F.lit(0.0)}),
        **{f"fb_{i}": F.coalesce(f"fb_{i}", F.lit(0.0)) if f"fb_{i}" in have else F.lit(0.0)
           for i in range(spec.embedding_dims)},
        **S.cyclic_time(F.col("ts")), "london_ny": S.london_ny(F.col("ts")),
    }
    f = f.withColumns(fixed).withColumns(X.gates())
    return f.select("pair", "ts", *feature_columns(spec)).dropna()


def advanced_features(bars: DataFrame, base: DataFrame, returns: Sequence[str], positions: DataFrame | None = None,
                      books: DataFrame | None = None, corr_window: int = 60, window: int = 20,
                      trend_window: int = 50) -> DataFrame:
    """Second matrix on the rows of the first one; infinite and missing values forward filled, then zero.

    ``positions`` (pair, ts, long_noncom, short_noncom) as of each bar; ``books`` (pair, ts, bids, asks) at exact
    times. Columns of an absent input are left out.
    """
    f = base.select("pair", "ts", *returns).join(bars, ["pair", "ts"])
    if positions is not None:
        f = asof.as_of(f, positions, ["long_noncom", "short_noncom"])
    out = ["tvi_buy", "tvi_sell", "tvi_imbalance", "tvi_ratio", "tvi_impact", "corr_avg", "corr_dispersion",
           "corr_zscore", "parkinson_trend_ratio", "hurst", "fractal_dim", "regime_label", "iv_proxy", "skew_proxy",
           "term_proxy", "risk_reversal"]
    s = Series.of(f).apply(*W.tick_volume_imbalance(window), *X.correlation_regime(returns, corr_window),
                           *W.trend_score(trend_window), *W.options_proxies(window))
    s = W.risk_reversal(s, window)
    s = H.fractal_dimension(s)
    if positions is not None:
        s = s.apply(W.positioning())
        out += ["cot_net", "cot_noncom_net", "cot_extreme", "cot_change"]
    if books is not None:
        s = s.with_frame(s.frame.join(books.select("pair", "ts", "bids", "asks"), ["pair", "ts"], "left"))
        levels = book.book_features()
        s = s.map(lambda g: g.withColumns(levels))
        out += list(levels)
    s = s.apply(*Q.fill_clean(out))
    clock = {**S.session_flags(F.col("ts")), **S.cyclic_time(F.col("ts"), ("tod", "dow")),
             "corr_break": S.flag(F.abs("corr_zscore") > 2.0)}
    return s.df.withColumns(clock).select("pair", "ts", *out, *clock)
