"""Queries on rolling, cross-asset, macro, regime and calendar features of bars."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from tickloom.core.series import Series, add
from tickloom.functions import scalar as S
from tickloom.operators import cross_asset as X, features as W, fractal as H
from tickloom.plans import adapters as A
from tickloom.plans.registry import query

W_ALL = "WINDOW w AS (PARTITION BY pair ORDER BY ts)"


def roll(agg: str, x: str, n: int, least: int | None = None, order: str = "ts") -> str:
    """Framed aggregate, null until enough non-null rows."""
    over = f"OVER (PARTITION BY pair ORDER BY {order} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} >= {n if least is None else least} THEN {agg}({x}) {over} END"


def _bars(spark, sf, *steps, out):
    return A.bar_series(spark, sf).apply(*steps).df.select("pair", "ts", *out)


@query("order_flow", f"""WITH {A.BARS}, s AS (SELECT *, CASE WHEN volume <> 0 THEN sign("close" - open) END AS d FROM bars)
    SELECT pair, ts, {roll('avg', 'd', 20)} AS ofi FROM s""", "pair, ts")
def order_flow(spark, sf):
    return _bars(spark, sf, W.order_flow_imbalance(), out=["ofi"])


@query("arrival_rate", f"""WITH {A.BARS}, a AS (SELECT *, n_ticks::DOUBLE AS r FROM bars),
    b AS (SELECT *, volume / ({roll('avg', 'volume', 30)} + 1e-9) AS v FROM a)
    SELECT pair, ts, (r - {roll('avg', 'r', 30)}) / ({roll('stddev_samp', 'r', 30)} + 1e-9) AS tar,
           (v - {roll('avg', 'v', 30)}) / ({roll('stddev_samp', 'v', 30)} + 1e-9) AS volume_tar FROM b""", "pair, ts")
def arrival_rate(spark, sf):
    s = A.bar_series(spark, sf).apply(*W.arrival_rate(30, rate=None))
    s = s.map(lambda f: f.withColumnRenamed("tar", "volume_tar")).apply(*W.arrival_rate(30))
    return s.df.select("pair", "ts", "tar", "volume_tar")


TR = f"""t AS (SELECT *, greatest(high - low, abs(high - lag("close") OVER w), abs(low - lag("close") OVER w)) AS tr,
    ln("close" / lag("close") OVER w) AS r, "close" - lag("close") OVER w AS d FROM bars {W_ALL})"""


@query("true_range", f"WITH {A.BARS}, {TR} SELECT pair, ts, {roll('avg', 'tr', 6)} AS atr_6 FROM t", "pair, ts")
def true_range(spark, sf):
    return _bars(spark, sf, *W.true_range_average(6), out=["atr_6"])


@query("realised_volatility", f"WITH {A.BARS}, {TR} SELECT pair, ts, {roll('stddev_samp', 'r', 20)} AS vol_20 FROM t", "pair, ts")
def realised_volatility(spark, sf):
    return _bars(spark, sf, W.log_return(), W.realised_volatility(20), out=["vol_20"])


BB = f"""m AS (SELECT pair, ts, "close", {roll('avg', '"close"', 20)} AS bb_mid, {roll('stddev_samp', '"close"', 20)} AS sd FROM bars),
    b AS (SELECT *, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower FROM m)"""


@query("bollinger", f"""WITH {A.BARS}, {BB} SELECT pair, ts, bb_mid, bb_upper, bb_lower, (bb_upper - bb_lower) / (bb_mid + 1e-9) AS bb_width,
    CASE WHEN sd IS NOT NULL THEN least(greatest(("close" - bb_lower) / (bb_upper - bb_lower + 1e-9), 0), 1) END AS bb_pct FROM b""", "pair, ts")
def bollinger(spark, sf):
    return _bars(spark, sf, W.bollinger(), out=["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct"])


@query("rsi", f"""WITH {A.BARS}, {TR}, g AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END AS up, CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END AS dn FROM t)
    SELECT pair, ts, 100 - 100 / (1 + {roll('avg', 'up', 14)} / ({roll('avg', 'dn', 14)} + 1e-9)) AS rsi_14 FROM g""", "pair, ts", 6)
def rsi(spark, sf):
    return _bars(spark, sf, *W.rsi(14), out=["rsi_14"])


@query("macd", f"""WITH RECURSIVE {A.BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) AS rn FROM bars),
    e AS (SELECT pair, ts, rn, "close" AS f, "close" AS s, 0.0::DOUBLE AS g FROM n WHERE rn = 1
      UNION ALL SELECT n.pair, n.ts, n.rn, e.f + 2 / 13::DOUBLE * (n."close" - e.f), e.s + 2 / 27::DOUBLE * (n."close" - e.s),
        e.g + 0.2::DOUBLE * (e.f + 2 / 13::DOUBLE * (n."close" - e.f) - e.s - 2 / 27::DOUBLE * (n."close" - e.s) - e.g)
      FROM e JOIN n ON n.pair = e.pair AND n.rn = e.rn + 1)
    SELECT pair, ts, f - s AS macd, g AS macd_sig, f - s - g AS macd_hist FROM e""", "pair, ts")
def macd(spark, sf):
    return W.macd(A.bar_series(spark, sf)).df.select("pair", "ts", "macd", "macd_sig", "macd_hist")


@query("lagged_returns", f"""WITH {A.BARS} SELECT pair, ts, ln("close") - ln(lag("close", 5) OVER w) AS ret_5,
    ln("close") - ln(lag("close", 20) OVER w) AS ret_20, ln("close") - ln(lag("close", 60) OVER w) AS ret_60 FROM bars {W_ALL}""", "pair, ts")
def lagged_returns(spark, sf):
    return _bars(spark, sf, W.lagged_returns(), out=["ret_5", "ret_20", "ret_60"])


@query("flagship", f"""WITH {A.BARS}, {TR}, {BB} SELECT t.pair, t.ts, t.open, t.high, t.low, t."close", t.volume, t.n_ticks,
    {roll('avg', 'tr', 6).replace('pair ORDER BY ts', 't.pair ORDER BY t.ts')} AS atr_6,
    {roll('stddev_samp', 'r', 20).replace('pair ORDER BY ts', 't.pair ORDER BY t.ts')} AS vol_20, bb_mid, bb_upper, bb_lower,
    ln(t."close") - ln(lag(t."close", 5) OVER (PARTITION BY t.pair ORDER BY t.ts)) AS ret_5 FROM t JOIN b ON t.pair = b.pair AND t.ts = b.ts""",
       "pair, ts, n_ticks")
def flagship(spark, sf):
    """Hourly bars with volatility and momentum per pair."""
    return _bars(spark, sf, *W.true_range_average(6), W.log_return(), W.realised_volatility(20), W.bollinger(),
                 W.lagged_returns((5,)), out=["open", "high", "low", "close", "volume", "n_ticks", "atr_6", "vol_20",
                                              "bb_mid", "bb_upper", "bb_lower", "ret_5"])


# --- cross-asset ---------------------------------------------------------------------

PANEL = f"""{A.ASSETS}, aligned AS (
    SELECT b.pair, b.ts, b."close", {', '.join(f'''(SELECT arg_max(value, a.ts) FROM assets a WHERE a.asset = '{n}' AND a.ts <= b.ts) AS "{n}"''' for n in A.ASSET_NAMES)}
    FROM bars b)"""


def panel_on_bars(spark, sf, names=A.ASSET_NAMES):
    panel = X.wide_panel(A.assets(spark, sf), names)
    return Series.of(X.attach_panel(A.bars(spark, sf).select("pair", "ts", "close"), panel, names))


@query("asset_alignment", f"WITH {A.BARS}, {PANEL} SELECT * FROM aligned", "pair, ts")
def asset_alignment(spark, sf):
    return panel_on_bars(spark, sf).df


_RET = ", ".join(f'ln("{n}") - ln(lag("{n}") OVER w) AS "{n}_ret"' for n in A.PANEL_ASSETS)
RETS = f"""{PANEL}, rets AS (SELECT *, {_RET}, ln("close") - ln(lag("close") OVER w) AS fx FROM aligned {W_ALL})"""


def _corr(a: str, b: str, n: int, least: int) -> str:
    over = f"OVER (PARTITION BY pair ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"""CASE WHEN count("{a}" + "{b}") {over} >= {least} THEN corr("{a}", "{b}") {over} END"""


def _link_sql() -> str:
    over = "OVER (PARTITION BY pair ORDER BY ts ROWS 59 PRECEDING)"
    cols = []
    for n in A.PANEL_ASSETS:
        cols.append(f'"{n}_ret"')
        cols += [f'lag("{n}_ret", {k}) OVER w AS "{n}_ret_l{k}"' for k in (1, 5, 15)]
        cols.append(f'{_corr(f"{n}_ret", "fx", 60, 15)} AS "{n}_corr"')
        cols.append(f'''CASE WHEN count("{n}_ret" + fx) {over} >= 15 THEN covar_samp("{n}_ret", fx) {over} END
            / (CASE WHEN count(fx) {over} >= 15 THEN var_samp(fx) {over} END + 1e-9) AS "{n}_beta"''')
    return f"SELECT pair, ts, {', '.join(cols)} FROM rets {W_ALL}"


@query("cross_asset", f"WITH {A.BARS}, {RETS} {_link_sql()}", "pair, ts", 7)
def cross_asset(spark, sf):
    s = panel_on_bars(spark, sf).apply(*X.asset_returns(A.PANEL_ASSETS), *X.asset_links(A.PANEL_ASSETS))
    out = [f"{n}_{c}" for n in A.PANEL_ASSETS for c in ("ret", "ret_l1", "ret_l5", "ret_l15", "corr", "beta")]
    return s.df.select("pair", "ts", *out)


LINKS = f"""{RETS}, lk AS (SELECT *, "US10Y" - "DE10Y" AS yield_spread_us_de_10y, "US10Y" - "US2Y" AS us_2s10s_spread,
      ((coalesce("SPX_ret" < 0, false))::INT + (coalesce("VIX_ret" > 0, false))::INT) / 2 AS risk_off_signal,
      {_corr('GOLD_ret', 'DXY_ret', 60, 15)} AS gold_dxy_corr,
      0.6::DOUBLE * lag("COPPER_ret") OVER w + 0.4::DOUBLE * lag("WTI_ret") OVER w AS commodity_fx_lead FROM rets {W_ALL}),
  lk2 AS (SELECT *, yield_spread_us_de_10y - lag(yield_spread_us_de_10y) OVER w AS yield_spread_us_de_10y_chg,
      us_2s10s_spread - lag(us_2s10s_spread) OVER w AS us_2s10s_spread_chg,
      abs(gold_dxy_corr - {roll('avg', 'gold_dxy_corr', 240, 60)}) AS gold_dxy_corr_break FROM lk {W_ALL})"""
LINK_COLS = ["yield_spread_us_de_10y", "yield_spread_us_de_10y_chg", "us_2s10s_spread", "us_2s10s_spread_chg",
             "risk_off_signal", "gold_dxy_corr", "gold_dxy_corr_break", "commodity_fx_lead"]


def _links(spark, sf):
    return panel_on_bars(spark, sf).apply(*X.asset_returns(A.PANEL_ASSETS), *X.macro_links())


@query("macro_links", f"WITH {A.BARS}, {LINKS} SELECT pair, ts, {', '.join(LINK_COLS)} FROM lk2", "pair, ts", 8)
def macro_links(spark, sf):
    return _links(spark, sf).df.select("pair", "ts", *LINK_COLS)


def _z(c, n, least):
    z = f"({c} - {roll('avg', c, n, least)}) / ({roll('stddev_samp', c, n, least)} + 1e-9)"
    return f"CASE WHEN {z} IS NOT NULL THEN least(greatest({z}, -6), 6) END"


BREAK = f"""{LINKS}, zs AS (SELECT pair, ts, {_z('gold_dxy_corr_break', 60, 15)} AS gold_break_z, {_z('us_2s10s_spread_chg', 60, 15)} AS curve_chg_z,
      {_z('yield_spread_us_de_10y_chg', 60, 15)} AS yield_chg_z, {_z('risk_off_signal', 30, 10)} AS risk_off_z FROM lk2),
  pr AS (SELECT *, 1 / (1 + exp(-least(greatest(0.8::DOUBLE * coalesce(gold_break_z, 0) + 0.5::DOUBLE * coalesce(risk_off_z, 0)
      + 0.3::DOUBLE * coalesce(abs(curve_chg_z), 0), -8), 8))) AS regime_break_prob FROM zs)"""


@query("regime_break_closed", f"""WITH {A.BARS}, {BREAK} SELECT *, least(greatest(0.2::DOUBLE + 0.8::DOUBLE * regime_break_prob, 0), 1) AS gate_gold_weight,
    least(greatest(1 - 0.7::DOUBLE * regime_break_prob, 0), 1) AS gate_yield_weight,
    least(greatest(0.3::DOUBLE + 0.7::DOUBLE * regime_break_prob, 0), 1) AS gate_risk_weight FROM pr""", "pair, ts", 6)
def regime_break_closed(spark, sf):
    s = _links(spark, sf).apply(X.break_scores())
    f = s.df.withColumn("regime_break_prob", X.closed_form_break_probability()).withColumns(X.gates())
    return f.select("pair", "ts", "gold_break_z", "curve_chg_z", "yield_chg_z", "risk_off_z", "regime_break_prob",
                    "gate_gold_weight", "gate_yield_weight", "gate_risk_weight")


@query("regime_break_fitted")
def regime_break_fitted(spark, sf):
    """Logistic regime model fitted on the first three weeks."""
    s = _links(spark, sf).apply(X.break_scores())
    f = X.fitted_break_probability(s.df, "2024-01-21 00:00:00").withColumns(X.gates())
    return f.select("pair", "ts", "regime_break_prob", "gate_gold_weight", "gate_yield_weight", "gate_risk_weight")


@query("macro_yields", f"""WITH {A.BARS}, {PANEL}, sp AS (SELECT pair, ts, {', '.join(f'"{a}" - "{b}" AS {s}' for s, (a, b) in X.YIELD_SPREADS.items())} FROM aligned)
    SELECT *, {', '.join(f'{sign} * {s} AS {c}' for c, (s, sign) in X.CARRIES.items())},
    spread_us_de - lag(spread_us_de, 5) OVER w AS yield_momentum_5d, spread_us_de - lag(spread_us_de, 20) OVER w AS yield_momentum_20d,
    coalesce({roll('stddev_samp', 'spread_us_de', 20)}, 0) AS yield_vol_20d FROM sp {W_ALL}""", "pair, ts")
def macro_yields(spark, sf):
    s = panel_on_bars(spark, sf).apply(X.macro_yields())
    return s.df.select("pair", "ts", *X.YIELD_SPREADS, *X.CARRIES, "yield_momentum_5d", "yield_momentum_20d", "yield_vol_20d")


REGIME_ASSETS = A.PANEL_ASSETS


def _regime_sql() -> str:
    cols = [f"{a}_ret" for a in REGIME_ASSETS]
    whole = " + ".join(f'"{c}"' for c in cols)
    frame = "OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
    cs = ", ".join(f"""CASE WHEN n >= 30 AND m = 60 THEN corr(CASE WHEN ok IS NOT NULL THEN "{a}" END, CASE WHEN ok IS NOT NULL THEN "{b}" END) {frame} END AS c{i}"""
                   for i, (a, b) in enumerate(combinations(cols, 2)))
    k = len(list(combinations(cols, 2)))
    mean = "(" + " + ".join(f"c{i}" for i in range(k)) + f") / {k}"
    var = "(" + " + ".join(f"pow(c{i} - corr_avg, 2)" for i in range(k)) + f") / {k}"
    return f"""o AS (SELECT *, {whole} AS ok FROM rets), oc AS (SELECT *, count(ok) {frame} AS n, count(*) {frame} AS m FROM o),
      cc AS (SELECT pair, ts, {cs} FROM oc), ca AS (SELECT *, {mean} AS corr_avg FROM cc),
      cd AS (SELECT *, sqrt({var}) AS corr_dispersion FROM ca),
      cz AS (SELECT *, (corr_avg - {roll('avg', 'corr_avg', 180)}) / ({roll('stddev_samp', 'corr_avg', 180)} + 1e-9) AS corr_zscore FROM cd)"""


@query("correlation_regime", f"""WITH {A.BARS}, {RETS}, {_regime_sql()} SELECT pair, ts, corr_avg, corr_dispersion, corr_zscore,
    CASE WHEN abs(corr_zscore) > 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS corr_break FROM cz""", "pair, ts", 7)
def correlation_regime(spark, sf):
    return _regime(spark, sf).df.select("pair", "ts", "corr_avg", "corr_dispersion", "corr_zscore", "corr_break")


def _regime(spark, sf):
    s = panel_on_bars(spark, sf).apply(*X.asset_returns(A.PANEL_ASSETS, (1,)))
    return s.apply(*X.correlation_regime([f"{a}_ret" for a in REGIME_ASSETS], 60))


@query("correlation_eigen_ratio")
def correlation_eigen_ratio(spark, sf):
    return X.eigen_ratio(_regime(spark, sf).df.select("pair", "ts", "corr_avg", "_corrs"), len(REGIME_ASSETS))


# --- price shape -----------------------------------------------------------------------

TVI = f"""t0 AS (SELECT *, sign("close" - lag("close") OVER w) AS tick, {roll('avg', 'volume', 20)} AS vm FROM bars {W_ALL}),
  t1 AS (SELECT *, volume * coalesce(tick > 0, false)::INT + volume * 0.5::DOUBLE * coalesce(tick = 0, false)::INT AS buy,
     volume * coalesce(tick < 0, false)::INT + volume * 0.5::DOUBLE * coalesce(tick = 0, false)::INT AS sell, tick * volume / (vm + 1e-9) AS imp FROM t0),
  t2 AS (SELECT *, {roll('sum', 'buy', 20)} AS tvi_buy, {roll('sum', 'sell', 20)} AS tvi_sell, {roll('avg', 'imp', 20)} AS tvi_impact FROM t1)"""


@query("tick_volume_imbalance", f"""WITH {A.BARS}, {TVI} SELECT pair, ts, tvi_buy, tvi_sell, (tvi_buy - tvi_sell) / (tvi_buy + tvi_sell + 1e-9) AS tvi_imbalance,
    CASE WHEN tvi_buy IS NOT NULL THEN least(greatest(tvi_buy / (tvi_sell + 1e-9), 0), 5) END AS tvi_ratio, tvi_impact FROM t2""", "pair, ts")
def tick_volume_imbalance(spark, sf):
    return _bars(spark, sf, *W.tick_volume_imbalance(), out=["tvi_buy", "tvi_sell", "tvi_imbalance", "tvi_ratio", "tvi_impact"])


@query("trend_score", f"""WITH {A.BARS}, h AS (SELECT *, pow(ln(high / low), 2) AS hl, ln("close" / lag("close") OVER w) AS cc FROM bars {W_ALL}),
    q AS (SELECT pair, ts, coalesce(greatest(CASE WHEN sd IS NOT NULL THEN sqrt(p / (4 * ln(2))) / (sd + 1e-8) END, CASE WHEN sd IS NOT NULL THEN 0.01 END), 1) AS tr FROM (
      SELECT pair, ts, {roll('avg', 'hl', 50, 2)} AS p, {roll('stddev_samp', 'cc', 50, 2)} AS sd FROM h))
    SELECT pair, ts, tr AS parkinson_trend_ratio, 0.5 + 0.25 * tanh(tr - 1) AS hurst,
      CASE WHEN 0.5 + 0.25 * tanh(tr - 1) > 0.6 THEN 1.0 WHEN 0.5 + 0.25 * tanh(tr - 1) < 0.4 THEN -1.0 ELSE 0.0 END::DOUBLE AS regime_label FROM q""", "pair, ts", 8)
def trend_score(spark, sf):
    return _bars(spark, sf, *W.trend_score(50), out=["parkinson_trend_ratio", "hurst", "regime_label"])


def _hurst_sql(tag: str, base: str, x: str, n: int, step: int, name: str) -> str:
    """Rescaled range over two chunks per lag, from explicit chunk rows; held from one due row to the next."""
    g = "PARTITION BY pair, ts, lag, c"
    return f"""{tag}q AS (SELECT * FROM (SELECT pair, ts, row_number() OVER (PARTITION BY pair ORDER BY ts) AS rn,
        list({x}) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS s FROM {base}) WHERE rn > {n} AND (rn - 1 - {n}) % {step} = 0),
      {tag}e AS (SELECT pair, ts, lag, c, s, unnest(range(1, lag + 1)) AS i FROM {tag}q, range(4, {min(50, n // 2)}) a(lag), range(0, 2) b(c)),
      {tag}v AS (SELECT pair, ts, lag, c, i, s[{n} - 2 * lag + c * lag + i] AS v FROM {tag}e),
      {tag}m AS (SELECT *, v - avg(v) OVER g AS d, stddev_pop(v) OVER g AS sd FROM {tag}v WINDOW g AS ({g})),
      {tag}w AS (SELECT *, sum(d) OVER ({g} ORDER BY i ROWS UNBOUNDED PRECEDING) AS walk FROM {tag}m),
      {tag}r AS (SELECT pair, ts, lag, c, any_value(sd) AS sd, max(walk) - min(walk) AS spread FROM {tag}w GROUP BY pair, ts, lag, c),
      {tag}t AS (SELECT pair, ts, lag, avg(spread / sd) AS rs FROM {tag}r WHERE sd >= 1e-12 AND spread > 0 GROUP BY pair, ts, lag),
      {tag}k AS (SELECT *, 3 + row_number() OVER (PARTITION BY pair, ts ORDER BY lag) AS nth FROM {tag}t),
      {tag}h AS (SELECT pair, ts, CASE WHEN count(*) < 4 THEN 0.5 ELSE coalesce(least(greatest(regr_slope(ln(rs), ln(nth)), 0.1), 0.9), 0.5) END AS h FROM {tag}k GROUP BY pair, ts),
      {tag}d AS (SELECT {tag}q.pair, {tag}q.ts, coalesce(h, 0.5) AS h FROM {tag}q LEFT JOIN {tag}h ON {tag}h.pair = {tag}q.pair AND {tag}h.ts = {tag}q.ts),
      {tag}o AS (SELECT b.pair, b.ts, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY b.pair ORDER BY b.ts), 0.5)::DOUBLE AS {name}
        FROM {base} b LEFT JOIN {tag}d ON {tag}d.pair = b.pair AND {tag}d.ts = b.ts)"""


def _curve_length_sql(tag: str, base: str, x: str, n: int, name: str) -> str:
    return f"""{tag}p AS (SELECT pair, ts, list({x}) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS s FROM {base}),
      {tag}l AS (SELECT pair, ts, k, (SELECT avg(abs(s[j + k + 1] - s[j + 1])) * {n - 1} / (count(*) * k * k) FROM range(0, {n} - k, k) r(j) WHERE j + k < {n}) AS lm
        FROM {tag}p, range(1, {n // 2}) t(k) WHERE len(s) = {n}),
      {tag}f AS (SELECT pair, ts, least(greatest(-regr_slope(ln(greatest(lm, 1e-12)), ln(k)), 1), 2) AS f FROM {tag}l GROUP BY pair, ts),
      {tag}c AS (SELECT {tag}p.pair, {tag}p.ts, coalesce(f, 1.5)::DOUBLE AS {name} FROM {tag}p LEFT JOIN {tag}f ON {tag}f.pair = {tag}p.pair AND {tag}f.ts = {tag}p.ts)"""


@query("rolling_hurst", f"""WITH {A.BARS}, {_hurst_sql('h', 'bars', '"close"', 120, 20, 'hurst')} SELECT * FROM ho""", "pair, ts", 6)
def rolling_hurst(spark, sf):
    return H.rolling_hurst(A.bar_series(spark, sf)).df.select("pair", "ts", "hurst")


@query("fractal_dimension", f"""WITH {A.BARS}, p AS (SELECT pair, ts, list("close") OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS s FROM bars),
    k AS (SELECT pair, ts, k, (SELECT avg(abs(s[j + k + 1] - s[j + 1])) * 29 / (count(*) * k * k) FROM range(0, 30 - k, k) r(j) WHERE j + k < 30) AS lm
          FROM p, range(1, 15) t(k) WHERE len(s) = 30),
    f AS (SELECT pair, ts, least(greatest(-regr_slope(ln(greatest(lm, 1e-12)), ln(k)), 1), 2) AS fd FROM k GROUP BY pair, ts)
    SELECT p.pair, p.ts, coalesce(fd, 1.5) AS fractal_dim FROM p LEFT JOIN f ON f.pair = p.pair AND f.ts = p.ts""", "pair, ts", 7)
def fractal_dimension(spark, sf):
    return H.fractal_dimension(A.bar_series(spark, sf)).df.select("pair", "ts", "fractal_dim")


HURSTS = ", ".join(_hurst_sql(f"h{n}", "lr", "lr", n, 1, f"hurst_{n}") + ", " + _curve_length_sql(f"f{n}", "lr", "lr", n, f"fractal_{n}") for n in (30, 60, 120))


@query("hurst_fractal", f"""WITH {A.BARS}, lr AS (SELECT pair, ts, coalesce(ln("close") - ln(lag("close") OVER (PARTITION BY pair ORDER BY ts)), 0) AS lr FROM bars), {HURSTS}
    SELECT pair, ts, hurst_30, hurst_60, hurst_120, fractal_30, fractal_60, fractal_120, CASE WHEN hurst_60 > 0.55 THEN 1.0 ELSE 0.0 END::DOUBLE AS trending,
      CASE WHEN hurst_60 < 0.45 THEN 1.0 ELSE 0.0 END::DOUBLE AS mean_reverting
    FROM h30o JOIN h60o USING (pair, ts) JOIN h120o USING (pair, ts) JOIN f30c USING (pair, ts) JOIN f60c USING (pair, ts) JOIN f120c USING (pair, ts)""", "pair, ts", 6)
def hurst_fractal(spark, sf):
    out = [f"{m}_{n}" for n in (30, 60, 120) for m in ("hurst", "fractal")]
    return H.hurst_fractal(A.bar_series(spark, sf)).df.select("pair", "ts", *out, "trending", "mean_reverting")


def _skew_sql() -> str:
    over = "OVER (PARTITION BY pair ORDER BY ts ROWS 19 PRECEDING)"
    m = [f"avg(pow(r, {k})) {over}" for k in (1, 2, 3)]
    m2, m3 = f"({m[1]} - pow({m[0]}, 2))", f"({m[2]} - 3 * {m[0]} * {m[1]} + 2 * pow({m[0]}, 3))"
    return f"CASE WHEN count(r) {over} = 20 THEN {m3} / pow({m2}, 1.5) * sqrt(20 * 19) / 18 END"


OPT = f"""o0 AS (SELECT *, ln("close" / lag("close") OVER w) AS r, 0.5 * pow(ln(high) - ln(low), 2) - (2 * ln(2) - 1) * pow(ln("close") - ln(lag("close") OVER w), 2) AS gk FROM bars {W_ALL}),
  up AS (SELECT pair, ts, {roll('stddev_samp', 'r', 20, 5)} AS v FROM o0 WHERE r > 0), dn AS (SELECT pair, ts, {roll('stddev_samp', 'r', 20, 5)} AS v FROM o0 WHERE r < 0),
  o1 AS (SELECT o0.*, up.v AS u, dn.v AS d FROM o0 LEFT JOIN up ON up.pair = o0.pair AND up.ts = o0.ts LEFT JOIN dn ON dn.pair = o0.pair AND dn.ts = o0.ts),
  o2 AS (SELECT pair, ts, sqrt(g) * sqrt(252) AS iv_proxy, sk AS skew_proxy,
      CASE WHEN s60 IS NOT NULL THEN least(greatest(s5 * sqrt(252) / (s60 * sqrt(252) + 1e-9), 0.3), 3) END AS term_proxy,
      least(greatest(coalesce((uh - dh) * sqrt(252), 0), -0.05), 0.05) / 0.05 AS risk_reversal,
      least(greatest(coalesce((u - dh) * sqrt(252), 0), -0.05), 0.05) / 0.05 AS risk_reversal_up_rows FROM (
    SELECT *, {roll('avg', 'gk', 20)} AS g, {_skew_sql()} AS sk, {roll('stddev_samp', 'r', 5)} AS s5, {roll('stddev_samp', 'r', 60)} AS s60,
      last_value(u IGNORE NULLS) OVER w AS uh, last_value(d IGNORE NULLS) OVER w AS dh FROM o1 {W_ALL}))"""


@query("options_proxies", f"WITH {A.BARS}, {OPT.replace('sqrt(g)', 'CASE WHEN g >= 0 THEN sqrt(g) END')} SELECT * FROM o2", "pair, ts", 6)
def options_proxies(spark, sf):
    s = A.bar_series(spark, sf).apply(*W.options_proxies(20))
    s = W.risk_reversal(s, 20)
    s = W.risk_reversal(s.map(lambda f: f.withColumnRenamed("risk_reversal", "_rr")), 20, zero_off_side=True)
    f = s.df.select("pair", "ts", "iv_proxy", "skew_proxy", "term_proxy", F.col("_rr").alias("risk_reversal"),
                    F.col("risk_reversal").alias("risk_reversal_up_rows"))
    return f.withColumn("iv_proxy", F.when(~F.isnan("iv_proxy"), F.col("iv_proxy")))


@query("positioning", f"""WITH {A.BARS}, p AS (SELECT pair, ts, sum(volume) OVER w10 AS l, sum(n_ticks * 10) OVER w10 AS s FROM bars
      WINDOW w10 AS (PARTITION BY pair ORDER BY ts ROWS 9 PRECEDING)), n AS (SELECT pair, ts, (l - s) / (l + s + 1e-9) AS cot_net FROM p)
    SELECT pair, ts, cot_net, cot_net AS cot_noncom_net, CASE WHEN abs(cot_net) > 0.7 THEN 1.0 ELSE 0.0 END::DOUBLE AS cot_extreme,
      coalesce(cot_net - lag(cot_net, 7) OVER w, 0) AS cot_change FROM n {W_ALL}""", "pair, ts")
def positioning(spark, sf):
    books = add(9, lambda w: {"long_noncom": F.sum("volume").over(w.rowsBetween(-9, 0)),
                              "short_noncom": F.sum(F.col("n_ticks") * 10).over(w.rowsBetween(-9, 0)).cast("double")})
    return _bars(spark, sf, books, W.positioning(), out=["cot_net", "cot_noncom_net", "cot_extreme", "cot_change"])


@query("fractional_difference", f"""WITH {A.MINUTE_BARS}, wts AS (SELECT list(w ORDER BY k DESC) AS ws FROM (
      SELECT k, coalesce((SELECT product((i - 1 - 0.4::DOUBLE) / i) FROM range(1, k + 1) t(i)), 1) AS w FROM range(0, 2000) r(k)) WHERE abs(w) >= 1e-5),
    p AS (SELECT pair, ts, list("close") OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1457 PRECEDING AND CURRENT ROW) AS xs FROM mbars)
    SELECT pair, ts, CASE WHEN len(xs) = len(ws) THEN list_dot_product(xs, ws) END AS close_ffd FROM p, wts""", "pair, ts")
def fractional_difference(spark, sf):
    """Minute bars and the whole window of 1,458 weights."""
    s = W.fractional_difference(Series.of(A.minute_bars(spark, sf)), 0.4, 1e-5)
    return s.df.select("pair", "ts", "close_ffd")


# --- clocks, scores and row-wise features ------------------------------------------------

@query("session_clock", f"""WITH {A.TICKS}, m AS (SELECT tick_id, hour(ts) * 60 + minute(ts) AS m, isodow(ts) - 1 AS d, hour(ts) AS h FROM ticks)
    SELECT tick_id, (m < 540)::INT::DOUBLE AS sess_tokyo, (m >= 420 AND m < 960)::INT::DOUBLE AS sess_london, (m >= 720 AND m < 1260)::INT::DOUBLE AS sess_ny,
      (m >= 1260 OR m < 360)::INT::DOUBLE AS sess_sydney, (m >= 780 AND m < 960)::INT::DOUBLE AS sess_ln_ny,
      ((m >= 420 AND m < 435) OR (m >= 720 AND m < 735))::INT::DOUBLE AS sess_open, sin(2 * pi() * m / 1440) AS time_sin, cos(2 * pi() * m / 1440) AS time_cos,
      sin(2 * pi() * d / 5) AS day_sin, cos(2 * pi() * d / 5) AS day_cos, (h BETWEEN 13 AND 17)::INT::DOUBLE AS london_ny FROM m""", "tick_id")
def session_clock(spark, sf):
    ts = F.col("ts")
    cols = {**S.session_flags(ts), **S.cyclic_time(ts), "london_ny": S.london_ny(ts)}
    return A.ticks(spark, sf).select("tick_id", *[c.alias(n) for n, c in cols.items()])


@query("range_position", f"""WITH {A.BARS} SELECT pair, ts, least(greatest(("close" - low) / (high - low + 1e-9), 0), 1) AS obi_proxy,
    spread_avg / 0.0001::DOUBLE AS spread_pips, (ask_close - bid_close) / 0.0001::DOUBLE AS close_spread_pips FROM bars""", "pair, ts", 6)
def range_position(spark, sf):
    b = A.bars(spark, sf)
    return b.select("pair", "ts", S.range_position().alias("obi_proxy"),
                    S.spread_pips(b.columns, S.pip_size(F.col("pair"))).alias("spread_pips"),
                    S.spread_pips(["ask_close", "bid_close"]).alias("close_spread_pips"))


@query("score_decay", f"""WITH {A.BARS}, r AS (SELECT pair, ts, CASE WHEN n_ticks >= 6 THEN round("close" - open, 5) ELSE 0 END AS raw, n_ticks::DOUBLE AS c FROM bars),
    l AS (SELECT *, last_value(CASE WHEN raw <> 0 THEN raw END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN raw <> 0 THEN ts END IGNORE NULLS) OVER w AS hit FROM r {W_ALL})
    SELECT pair, ts, coalesce(v * exp(-0.0001::DOUBLE * date_diff('second', hit, ts)), 0) AS decayed, coalesce({roll('sum', 'c', 5)}, 0) AS buzz FROM l""", "pair, ts")
def score_decay(spark, sf):
    s = A.bar_series(spark, sf).map(lambda f: f.withColumns({
        "raw": F.when(F.col("n_ticks") >= 6, F.round(F.col("close") - F.col("open"), 5)).otherwise(0.0),
        "cnt": F.col("n_ticks").cast("double")}))
    return s.apply(*W.decayed("raw", "decayed", 0.0001), W.buzz("cnt")).df.select("pair", "ts", "decayed", "buzz")
