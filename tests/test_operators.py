"""Operators against small definitions written from the formulas, and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.core.series import Series
from tickloom.functions import scalar as S
from tickloom.operators import causality, cross_asset as X, distribution as D, features as W, fractal as H
from tickloom.operators import labels as L, performance as P, quality as Q, risk as R
from tickloom.plans import adapters as A, composites as C
from tickloom.streaming import guards as G, ticks as T


def _walk(n=400, seed=42):
    rng = np.random.default_rng(seed)
    close = 1.085 + rng.normal(0, 1e-4, n).cumsum()
    return pd.DataFrame({"pair": "EURUSD", "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "open": np.r_[close[0], close[:-1]],
                         "high": close + 1e-4, "low": close - 1e-4, "close": close, "volume": rng.integers(10, 99, n).astype(float),
                         "spread_avg": 5e-5, "bid_close": close - 3e-5, "ask_close": close + 3e-5})


@pytest.fixture(scope="module")
def bars(spark):
    pdf = _walk()
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    path = __import__("tickloom.core.storage", fromlist=["landed"]).landed(df)
    return pdf, path


def _series(df, *keys):
    return df.orderBy("ts").toPandas()


def test_spike_is_repaired(spark):
    n = 200
    mid = np.full(n, 1.085) + np.random.default_rng(0).normal(0, 1e-5, n)
    pdf = pd.DataFrame({"pair": "p", "ts": range(n), "mid": mid, "bid": mid - 1e-5, "ask": mid + 1e-5})
    pdf.loc[100, ["mid", "bid", "ask"]] += 0.5
    out = Series.of(spark.createDataFrame(pdf)).apply(Q.repair_spikes(5.0, 60)).df.orderBy("ts").toPandas()
    assert abs(out.mid[100] - out.mid[99]) < 0.01 and out.repaired.sum() == 1
    assert abs(out.ask[100] - out.bid[100] - 2e-5) < 1e-9


def test_inverted_row_is_dropped(spark):
    raw = spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate([(1.085, 1.086), (1.086, 1.085)] + [(1.085, 1.086)] * 3)],
                                "ts int, bid double, ask double")
    assert Q.enforce_schema(raw, "p", "s").count() == 4
    with pytest.raises(ValueError):
        Q.enforce_schema(raw.drop("ask"))


def test_high_impact_words(spark):
    df = spark.createDataFrame([("US Non-Farm Employment",), ("CPI y/y",), ("Bank Holiday",)], "e string")
    assert [r[0] for r in df.select(Q.high_impact(F.col("e"))).collect()] == [True, True, False]


def test_features_against_pandas(bars):
    pdf, df = bars
    s = Series.of(df).apply(*W.true_range_average(6), W.bollinger(), *W.rsi(14), *W.options_proxies(20), W.order_flow_imbalance())
    out = _series(s.df)
    prev = pdf.close.shift()
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - prev).abs(), (pdf.low - prev).abs()], axis=1).max(axis=1)
    r = np.log(pdf.close / prev)
    d = pdf.close.diff()
    rsi = 100 - 100 / (1 + d.clip(lower=0).rolling(14).mean() / ((-d.clip(upper=0)).rolling(14).mean() + 1e-9))
    for got, want in ((out.atr_6, tr.rolling(6).mean()), (out.bb_mid, pdf.close.rolling(20).mean()), (out.rsi_14, rsi),
                      (out.skew_proxy, r.rolling(20).skew())):
        assert got.isna().sum() == want.isna().sum()
        assert (got - want).abs().max() < 1e-6


def test_fractional_weights():
    w = W.fracdiff_weights(0.4, 1e-3)
    assert len(w) == 55 and w[:3] == pytest.approx([1.0, -0.4, -0.12]) and len(W.fracdiff_weights(0.4, 1e-5)) == 1458


def test_hurst_and_fractal(bars):
    pdf, df = bars
    out = _series(H.fractal_dimension(H.rolling_hurst(Series.of(df), window=120, step=20)).df)

    def hurst(a):
        tau, lags = [], list(range(4, min(50, len(a) // 2)))
        for lag in lags:
            tail, rs = a[-2 * lag:], []
            for c in (tail[:lag], tail[lag:]):
                if c.std() > 1e-12:
                    z = np.cumsum(c - c.mean())
                    rs.append((z.max() - z.min()) / c.std())
            if rs:
                tau.append(np.mean(rs))
        return float(np.clip(np.polyfit(np.log(lags[:len(tau)]), np.log(tau), 1)[0], 0.1, 0.9))
    c = pdf.close.to_numpy()
    for i in (120, 240, 399):
        at = 120 + (i - 120) // 20 * 20
        assert out.hurst[i] == pytest.approx(hurst(c[at - 120:at]), abs=1e-9)
    assert (out.hurst[:120] == 0.5).all() and (out.fractal_dim[:30] == 1.5).all() and out.fractal_dim.between(1, 2).all()
    back = _series(H.rolling_hurst(Series.of(df), window=120, step=20, write_back=True).df)
    assert back.hurst[100] == out.hurst[120] and back.hurst[99] == 0.5


def test_granger_finds_the_planted_link(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(size=400)
    c = np.r_[0.0, 0.8 * a[:-1]] + 0.3 * rng.normal(size=400)
    panel = spark.createDataFrame(pd.DataFrame({"ts": range(400), "a": a, "b": b, "c": c}))
    got = {(r.src, r.dst): r for r in causality.granger(panel, ["a", "b", "c"], 3).collect()}
    assert len(got) == 6 and got["a", "c"].edge and got["a", "c"].p_value < 1e-8 and not got["b", "a"].edge

    def ols(y, xs):
        m = np.column_stack([np.ones(len(y)), *xs])
        return ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()
    lag = lambda v: [v[3 - k - 1:400 - k - 1] for k in range(3)]
    r0, r1 = ols(a[3:], lag(a)), ols(a[3:], lag(a) + lag(b))
    d2 = 397 - 7
    p = causality.f_tail((r0 - r1) / 3 / (r1 / d2), 3, d2)
    assert got["b", "a"].p_value == pytest.approx(p, abs=1e-7)


def test_f_tail_and_normal(spark):
    # Tabulated upper 5 % points of F.
    for f, d1, d2 in ((3.4780, 4, 10), (2.3683, 5, 60), (4.9646, 1, 10)):
        assert causality.f_tail(f, d1, d2) == pytest.approx(0.05, abs=2e-4)
    z = spark.createDataFrame([(v / 4,) for v in range(-36, 37)], "z double")
    for r in z.select("z", S.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=1e-12)


def test_folds_are_ordered_and_disjoint(bars):
    _, df = bars
    f = L.purged_folds(Series.of(df.select("pair", "ts")), 3, 30, 10).toPandas()
    for _, g in f.groupby("fold"):
        train, test = g[g.role == "train"].row, g[g.role == "test"].row
        assert train.max() + 30 < test.min() + 1 and not set(train) & set(test)
    single = L.walk_forward_folds(Series.of(df.select("pair", "ts")), 5, 60).toPandas()
    assert set(single.fold) == {0} and (single.role == "train").sum() == 320


def test_barriers_against_a_loop(bars):
    pdf, df = bars
    df = df.withColumn("atr_6", F.lit(4.5e-4))
    out = _series(Series.of(df).apply(L.triple_barrier(horizon=12)).df)
    full = _series(Series.of(df).apply(L.triple_barrier(horizon=12, skip_last=True)).df)
    c, long, short = (pdf[k].to_numpy() for k in ("close", "ask_close", "bid_close"))
    for i in range(400 - 12):
        path = c[i + 1:i + 13]
        up, dn = np.flatnonzero(path >= long[i] + 1.5 * 4.5e-4), np.flatnonzero(path <= long[i] - 4.5e-4)
        want = 0 if not len(up) + len(dn) else 1 if len(up) and (not len(dn) or up[0] < dn[0]) else -1
        assert out.reward_long[i] == want
        up, dn = np.flatnonzero(path <= short[i] - 1.5 * 4.5e-4), np.flatnonzero(path >= short[i] + 4.5e-4)
        want = 0 if not len(up) + len(dn) else 1 if len(up) and (not len(dn) or up[0] < dn[0]) else -1
        assert out.reward_short[i] == want
    assert out.label[388:].isna().all() and full.label[387] == 0


def test_no_look_ahead(spark):
    """Rows before a cut do not change when later rows disappear."""
    bars, panel = A.bars(spark, SF), X.wide_panel(A.assets(spark, SF), A.PANEL_ASSETS)
    spec = C.FeatureSpec(assets=A.PANEL_ASSETS, corr_window=20, regime_window=40)
    releases = A.releases(spark, SF)
    cut = "2024-01-20 00:00:00"
    run = lambda b: C.core_features(b, panel, releases, spec=spec).where(f"ts < timestamp_ntz'{cut}'").orderBy("pair", "ts").toPandas()
    whole, part = run(bars), run(bars.where(f"ts < timestamp_ntz'{cut}'"))
    assert len(whole) == len(part) > 50
    num = [c for c in whole.columns if c not in ("pair", "ts")]
    assert np.abs(whole[num].to_numpy() - part[num].to_numpy()).max() < 1e-9


def test_core_columns(spark):
    df = entry.queries()["core_features"](spark, SF)
    assert df.columns == ["pair", "ts", *C.feature_columns(C.FeatureSpec(assets=A.PANEL_ASSETS))]
    assert len(df.columns) > 40


def test_drift_is_seen(spark):
    rng = np.random.default_rng(2)
    long = lambda x: spark.createDataFrame(pd.DataFrame({"m": "m", "feature": "f", "value": x}))
    base, same, moved = rng.normal(size=1000), rng.normal(size=400), rng.normal(size=400) * 3 + 5
    keys = ["m", "feature"]
    psi = lambda x: D.psi(long(base), long(x), keys).first().psi
    e, edges = np.histogram(base, 10, density=True)
    for x in (same, moved):
        a, _ = np.histogram(x, edges, density=True)
        assert psi(x) == pytest.approx(float(((a - e) * np.log((a + 1e-6) / (e + 1e-6))).sum()), abs=1e-6)
    near, far = (D.ks_two_sample(long(base), long(x), keys).first() for x in (same, moved))
    grid = np.sort(np.r_[base, same])
    gap = np.abs(np.searchsorted(np.sort(base), grid, "right") / 1000 - np.searchsorted(np.sort(same), grid, "right") / 400).max()
    assert near.ks == pytest.approx(gap) and near.p_value > 0.01 and far.p_value < 1e-12
    rets = lambda m: spark.createDataFrame(pd.DataFrame({"m": "m", "ret": rng.normal(m, 0.01, 300)}))
    v = D.drift_verdict(D.psi(long(base), long(moved), keys), D.ks_two_sample(long(base), long(moved), keys), rets(0.01), rets(-0.01), ["m"]).first()
    assert v.drift_detected and set(v.reasons) == {"psi", "ks", "sharpe_drop"}


def test_compounding_through_zero_and_below(spark):
    r = [0.1, -1.5, 0.2, -1.0, 0.5]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(r)], "pair string, ts int, ret double")
    out = P.compounded(Series.of(df)).df.orderBy("ts").toPandas()
    assert np.allclose(out.equity, np.cumprod(1 + np.array(r)))


def test_gate(spark):
    row = lambda *v: spark.createDataFrame([("m", *v)], "model string, sharpe double, profit_factor double, max_drawdown double, n_trades long, "  # noqa: E731
                                           "max_regime_conc double, gross_pnl double, transaction_costs double")
    good = P.promotion_gate(row(1.8, 1.7, 0.12, 700, 0.0, 1.0, 0.0)).first()
    bad = P.promotion_gate(row(1.2, 1.1, 0.30, 200, 0.0, 1.0, 0.0)).first()
    assert good.promoted and not bad.promoted and bad.failed == ["sharpe_ok", "pf_ok", "dd_ok", "sample_ok"]
    assert P.promotion_gate(row(1.4, 1.7, 0.12, 700, 0.0, 1.0, 0.0), emergency=True).first().promoted


def test_losing_model_is_demoted(spark):
    df = spark.createDataFrame([("m", i, -100.0, 9000.0) for i in range(35)], "model string, ts int, pnl double, equity double")
    d = P.demotion(Series.of(df, ["model"])).first()
    assert d.ts == 29 and d.win_rate_low


def test_drawdown_actions(spark):
    df = spark.createDataFrame([("a", i, "d", e, p) for i, (e, p) in enumerate([(10000.0, 0.0), (9800.0, -200.0), (9450.0, -350.0), (8900.0, -550.0), (9000.0, 100.0)])],
                               "account string, ts int, day string, equity double, pnl double")
    g = G.drawdown_guard(start=10_000.0, daily=0.2)
    out = G.run_guard(G.account_columns(Series.of(df, ["account"]), 10_000.0), g).orderBy("ts").collect()
    assert [r.action for r in out] == ["continue", "continue", "reduce_50", "close_all", "halt"]


def test_stream_equals_batch(spark):
    q = entry.queries()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(q["drawdown_guard"](spark, SF)) == key(q["drawdown_guard_stream"](spark, SF))


@pytest.mark.parametrize("guard,values", [
    (G.page_hinkley(threshold=3.0, min_rows=5), {"value": [(i * 7) % 5 - 1.2 for i in range(200)]}),
    (G.cooldown_guard(10.0), {"at": [float(i * 3 + i % 2) for i in range(200)], "force": [i % 31 == 0 for i in range(200)]}),
    (G.retrain_guard(50), {"drift": [i % 60 == 7 for i in range(200)]})])
def test_guards_stream_equals_batch(spark, tmp_path, guard, values):
    """Files in no order of time, one per micro-batch; the batch form in several blocks of one key."""
    start = pd.Timestamp("2024-01-01", tz="UTC")
    pdf = pd.DataFrame({"k": ["k0" if i % 10 else "k1" for i in range(200)], "ts": [start + pd.Timedelta(seconds=i) for i in range(200)], **values})
    df = spark.createDataFrame(pdf)
    for i in (3, 0, 2, 4, 1):
        df.where(F.pmod(F.unix_timestamp("ts"), F.lit(5)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    close = df.limit(1).withColumns({"k": F.lit("close"), "ts": F.expr("ts + INTERVAL 9 DAYS")})
    live = T.drain(G.guard_stream(stream, guard, ["k"], ["ts"], delay="1 day"), "guards", lambda: close.write.mode("append").parquet(str(tmp_path / "in")))
    batch = G.run_guard(Series.of(df, ["k"], block_rows=17), guard)
    key = lambda d: sorted(map(tuple, d.where("k <> 'close'").select("k", "ts", *guard.outputs).collect()))
    whole = G.run_guard(Series.of(df, ["k"]), guard)
    assert len(key(live)) == 200 and key(live) == key(batch) == key(whole)


def test_nothing_to_divide_by(spark):
    """A key that has lost everything, a constant model and a flat pair do not stop the others."""
    pnl = spark.createDataFrame([("gone", i, -50.0 if i < 2 else 0.0) for i in range(5)] + [("ok", i, 10.0) for i in range(5)], "k string, ts int, pnl double")
    s = P.equity_curve(Series.of(pnl, ["k"]), start=100.0, peak_from_start=True)
    assert {r.k: r.drawdown for r in s.df.where("ts = 4").collect()} == {"gone": 1.0, "ok": 0.0}
    zero = P.equity_curve(Series.of(pnl.where("k = 'gone'"), ["k"]), start=50.0)
    assert [r.drawdown for r in zero.df.orderBy("ts").collect()][0] is None
    trades = pnl.withColumns({"commission": F.lit(0.0), "exit_ts": F.current_timestamp(), "ts": F.timestamp_seconds("ts")})
    report = {r.k: r for r in P.trade_performance(Series.of(trades, ["k"]), start=100.0).collect()}
    assert report["gone"].total_pnl_usd == -100.0 and report["ok"].n_trades == 5
    curve = {r.k: r for r in P.curve_report(Series.of(s.df.select("k", "ts", "equity", "pnl"), ["k"])).collect()}
    assert curve["gone"].total_return == pytest.approx(-100.0) and curve["ok"].total_return > 0
    lost = P.compounded(Series.of(pnl.select("k", "ts", F.lit(-1.0).alias("ret")), ["k"])).df
    assert lost.where("equity <> 0").count() == 0
    models = spark.createDataFrame([(m, t, v) for t in range(6) for m, v in (("a", float(t)), ("b", float(t * t)), ("flat", 1.0))], "model string, ts int, pred double")
    want = np.corrcoef(np.arange(6.0), np.arange(6.0) ** 2)[0, 1]
    assert P.ensemble_diversity(models, ["ts"]).first().mean_correlation == pytest.approx(want)
    assert P.ensemble_diversity(models.where("model = 'flat'"), ["ts"]).first().mean_correlation is None
    rets = spark.createDataFrame([(p, t, 0.0 if p == "flat" else (t % 5 - 2) * 1e-4 * (1 if p == "x" else -1)) for t in range(40) for p in ("x", "y", "flat")], "pair string, ts int, ret double")
    book = spark.createDataFrame([(p, 1.0) for p in ("x", "y", "flat")], "pair string, lots double")
    one = R.portfolio_var(rets, book, 10_000.0).first()
    assert one.n_times == 40 and one.correlation_avg == pytest.approx(-1.0)
    assert spark.range(1).select(R.kelly(F.lit(0.6), F.lit(0.0)).alias("k")).first().k is None


def test_var_grows_with_the_book(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3e-4, (80, 2))
    rets = spark.createDataFrame(pd.DataFrame({"pair": ["EURUSD"] * 80 + ["GBPUSD"] * 80, "ts": [*range(80)] * 2, "ret": x.T.ravel()}))
    book = lambda a: spark.createDataFrame([("EURUSD", a), ("GBPUSD", a)], "pair string, lots double")
    one, two = (R.portfolio_var(rets, book(a), 10_000.0).first() for a in (0.5, 1.0))
    want = 2.3263478740408408 * (x @ [5.0, 5.0]).std()
    assert one.var_usd == pytest.approx(want, abs=1e-4) and two.var_usd == pytest.approx(2 * want, abs=1e-4)
    assert one.correlation_avg == pytest.approx(np.corrcoef(x.T)[0, 1], abs=6e-4)


def test_schedule_sums_to_the_order(spark):
    o = spark.createDataFrame([("a", 3.0), ("b", 0.4)], "id string, lots double")
    s = R.slice_orders(o, "id").groupBy("id").agg(F.sum("slice_lots").alias("t"), F.count("*").alias("n")).collect()
    assert {(r.id, round(r.t, 9), r.n) for r in s} == {("a", 3.0, 10), ("b", 0.4, 10)}


def test_slippage_sign(spark):
    f = spark.createDataFrame([(1.1002, 1.1, 1), (1.0998, 1.1, -1), (1.0999, 1.1, 1)], "fill_price double, requested_price double, direction int")
    pips = lambda literal: [round(r[0], 6) for r in f.select(D.adverse_slippage(literal)).collect()]
    assert pips(False) == [2.0, 2.0, 0.0] and pips(True) == [0.0, 0.0, 1.0]


def test_regime_fit(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=["gold_break_z", "curve_chg_z", "yield_chg_z", "risk_off_z"])
    pdf["ts"] = pd.date_range("2024-01-01", periods=300, freq="min")
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    p = X.fitted_break_probability(df).toPandas()
    assert p.regime_break_prob.between(0, 1).all()
    hot = (p.gold_break_z > 1) & ((p.risk_off_z > 0.5) | (p.curve_chg_z.abs() > 1))
    assert p.regime_break_prob[hot].mean() > p.regime_break_prob[~hot].mean() + 0.2
    few = X.fitted_break_probability(df.limit(20)).toPandas()
    assert few.regime_break_prob.between(0, 1).all()


def test_eigen_ratio(spark):
    rng = np.random.default_rng(4)
    corr = np.corrcoef(rng.normal(size=(4, 50)))
    eig = np.sort(np.abs(np.linalg.eigvalsh(corr)))
    rows = [(0, corr[np.triu_indices(4, 1)].tolist()), (1, [None] * 6), (2, None)]
    df = spark.createDataFrame(rows, "ts int, _corrs array<double>")
    got = {r.ts: r.corr_eigenratio for r in X.eigen_ratio(df, 4).collect()}
    assert got[0] == pytest.approx(eig[-1] / (eig[-2] + 1e-9)) and got[1] is None and got[2] is None


def test_curriculum_phases_are_the_filters_of_each_phase(spark):
    from tickloom.operators import quality as Q

    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.5, -0.7, 1.0, -2.0, 3.5, None])], "i int, atr double")
    avg = df.agg(F.avg("atr")).scalar()
    got = sorted((r["phase"], r["i"]) for r in Q.curriculum_phases(df, "atr", avg).collect())
    value = df.agg(F.avg("atr")).first()[0]
    assert got == sorted((p, r["i"]) for p in Q.PHASES for r in Q.curriculum_filter(df, p, "atr", value).collect())
    assert Q.curriculum_phases(df.limit(0), "atr", 1.0).count() == 0


def test_clean_bars_with_all_weights(spark):
    days = pd.bdate_range("2024-01-01", periods=3)
    ts = [d + pd.Timedelta(hours=7, minutes=int(m)) for d in days for m in range(600)]
    mid = 1.1 + np.random.default_rng(5).normal(0, 1e-4, len(ts)).cumsum()
    ticks = pd.DataFrame({"pair": "EURUSD", "ts": ts, "bid": mid - 1e-5, "ask": mid + 1e-5, "mid": mid, "spread": 2e-5, "volume": 1.0})
    weights = [1.0]
    while abs(weights[-1] * (len(weights) - 1 - 0.4) / len(weights)) >= 1e-5:
        weights.append(weights[-1] * (len(weights) - 1 - 0.4) / len(weights))
    got = C.clean_bars(spark.createDataFrame(ticks)).orderBy("ts").toPandas()
    assert len(weights) == 1458 and len(got) == len(ts) - 1457
    for k, x in enumerate(got["close_ffd"]):
        assert x == pytest.approx(sum(w * mid[1457 + k - j] for j, w in enumerate(weights)), abs=1e-9)
