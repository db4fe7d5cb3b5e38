"""Queries on trades, equity, monitoring, promotion, drift, simulation, slippage and risk."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.core.series import Series, add
from tickloom.core.storage import fresh_path
from tickloom.functions import scalar as S
from tickloom.operators import distribution as D, performance as P, risk as R
from tickloom.operators.quality import chronological_split
from tickloom.plans import adapters as A
from tickloom.plans.catalog_features import W_ALL
from tickloom.plans.registry import plain, query
from tickloom.sources import files

START = 1_000_000.0
O = "PARTITION BY strategy ORDER BY ts, trade_id"  # noqa: E741

CURVE = f"""{A.TRADES}, c0 AS (SELECT *, {START} + sum(pnl) OVER (PARTITION BY strategy ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS equity FROM trades),
  c1 AS (SELECT *, max(equity) OVER ({O} ROWS UNBOUNDED PRECEDING) AS peak, equity / lag(equity) OVER ({O}) - 1 AS r FROM c0)"""


@query("equity_curve", f"WITH {CURVE} SELECT strategy, ts, trade_id, equity, peak, (peak - equity) / peak AS drawdown FROM c1", "strategy, ts, trade_id", 6)
def equity_curve(spark, sf):
    return P.equity_curve(A.trade_series(spark, sf, "pnl"), start=START).df.select(
        "strategy", "ts", "trade_id", "equity", "peak", "drawdown")


@query("compounded_curve", f"""WITH {A.TRADES}, c AS (SELECT strategy, ts, trade_id, exp(sum(ln(1 + pnl / {START})) OVER ({O} ROWS UNBOUNDED PRECEDING)) AS equity FROM trades)
    SELECT *, equity / max(equity) OVER ({O} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM c""", "strategy, ts, trade_id", 8)
def compounded_curve(spark, sf):
    s = A.trade_series(spark, sf, "pnl").map(lambda f: f.withColumn("ret", F.col("pnl") / START))
    return P.compounded(s).df.select("strategy", "ts", "trade_id", "equity", "drawdown")


@query("trade_performance", f"""WITH {CURVE}, a AS (SELECT strategy, sum(pnl) AS p, sum(commission) AS c, count(*) AS n, count(*) FILTER (pnl > 0) AS w,
      avg(pnl) FILTER (pnl > 0) AS aw, avg(pnl) FILTER (pnl < 0) AS al, sum(pnl) FILTER (pnl > 0) AS g, sum(pnl) FILTER (pnl < 0) AS l,
      avg(r) AS m, stddev_samp(r) AS s, max((peak - equity) / (peak + 1e-9)) AS dd, avg(date_diff('second', ts, exit_ts) / 60) AS held FROM c1 GROUP BY strategy)
    SELECT strategy, n AS n_trades, p / {START} * 100 AS total_return_pct, p AS total_pnl_usd, c AS total_commission_usd, p - c AS net_pnl_usd, w / n * 100 AS win_rate_pct,
      aw AS avg_win_usd, al AS avg_loss_usd, abs(aw) / greatest(abs(al), 0.01) AS win_loss_ratio, m / s * sqrt(252 * 24 * 60) AS sharpe_ratio,
      dd * 100 AS max_drawdown_pct, held AS avg_holding_minutes, g / greatest(abs(l), 0.01) AS profit_factor FROM a""", "strategy, n_trades", 6)
def trade_performance(spark, sf):
    return P.trade_performance(A.trade_series(spark, sf, "pnl", "commission", "exit_ts"), START)


@query("curve_report", f"""WITH {CURVE}, p AS (SELECT *, equity / peak - 1 AS dd FROM c1)
    SELECT strategy, count(*) AS n_trades, min(ts) AS "start", max(ts) AS "end", (arg_max(equity, (ts, trade_id)) / arg_min(equity, (ts, trade_id)) - 1) * 100 AS total_return,
      round(avg(r) / stddev_samp(r) * sqrt(252 * 1440), 3) AS sharpe, round(abs(avg(r) * 252 * 1440 / (abs(min(dd)) + 1e-9)), 3) AS calmar,
      round(min(dd) * 100, 2) AS max_drawdown, round(avg((pnl > 0)::INT) * 100, 1) AS win_rate FROM p GROUP BY strategy""",
       'strategy, n_trades, "start", "end"', 6)
def curve_report(spark, sf):
    return P.curve_report(P.equity_curve(A.trade_series(spark, sf, "pnl"), start=START).map(lambda f: f.drop("peak", "drawdown")))


def _metrics_sql(prefix, cond, dd):
    p = f"CASE WHEN {cond} THEN pnl END"
    return f"""count({p}) AS {prefix}_n_trades, count(*) FILTER ({cond} AND pnl > 0) / nullif(count({p}), 0) AS {prefix}_win_rate,
      coalesce(avg(pnl) FILTER ({cond} AND pnl > 0), 0) AS {prefix}_avg_win_usd, coalesce(avg(pnl) FILTER ({cond} AND pnl < 0), 0) AS {prefix}_avg_loss_usd,
      coalesce(sum(pnl) FILTER ({cond} AND pnl > 0), 0) / greatest(abs(coalesce(sum(pnl) FILTER ({cond} AND pnl < 0), 0)), 1) AS {prefix}_profit_factor,
      avg({p}) / (stddev_pop({p}) + 1e-9) * sqrt(252) AS {prefix}_sharpe, max({dd}) FILTER ({cond}) AS {prefix}_max_drawdown, sum({p}) AS {prefix}_total_pnl"""


@query("windowed_report", f"""WITH {CURVE}, b AS (SELECT *, greatest(peak, {START}) AS pk, exit_ts >= '2001-10-01' AS rec,
      max(CASE WHEN exit_ts >= '2001-10-01' THEN greatest(equity, equity - pnl) END) OVER ({O} ROWS UNBOUNDED PRECEDING) AS rpk FROM c1)
    SELECT strategy, {_metrics_sql('all', 'true', '(pk - equity) / pk')}, {_metrics_sql('recent', 'rec', '(rpk - equity) / rpk')},
      arg_max(equity, (ts, trade_id)) AS final_equity, string_agg(DISTINCT model_ver, ',' ORDER BY model_ver) AS model_versions FROM b GROUP BY strategy""",
       "strategy, all_n_trades, recent_n_trades, model_versions", 6)
def windowed_report(spark, sf):
    r = P.windowed_report(A.trade_series(spark, sf, "pnl", "exit_ts", "model_ver"),
                          F.lit("2001-10-01").cast("timestamp_ntz"), START)
    return r.withColumn("model_versions", F.array_join("model_versions", ","))


@query("prediction_report", f"""WITH {A.BASIC}, p AS (SELECT pair, m.model, CASE m.model WHEN 'ret_5' THEN ret_5 WHEN 'ret_20' THEN ret_20 ELSE ofi END AS pred, fwd AS y
      FROM basic, (VALUES ('ret_5'), ('ret_20'), ('ofi')) m(model)), q AS (SELECT *, sign(pred) * y AS r FROM p WHERE pred IS NOT NULL AND y IS NOT NULL)
    SELECT pair, model, count(*) AS n, avg((sign(pred) = sign(y))::INT) AS dir_acc, avg(r) / (stddev_pop(r) + 1e-8) AS sharpe_proxy FROM q GROUP BY 1, 2""",
       "pair, model, n", 8)
def prediction_report(spark, sf):
    return P.prediction_report(_predictions(spark, sf), ["pair", "model"])


def _predictions(spark, sf):
    f = A.basic_features(spark, sf).df
    return (f.unpivot(["pair", "ts", "fwd"], ["ret_5", "ret_20", "ofi"], "model", "pred")
             .withColumnRenamed("fwd", "y").where("pred is not null and y is not null"))


FOLDS = """f AS (SELECT 'run_' || l_linestatus AS run, l_returnflag AS model, l_linenumber AS fold, avg(l_discount) AS best_metric,
    count(*) AS epochs, max(l_tax) AS best_acc FROM lineitem GROUP BY 1, 2, 3)"""


@query("leaderboard", f"""WITH {FOLDS} SELECT run, model, count(*) AS folds, floor(avg(epochs))::BIGINT AS mean_epochs, max(best_metric) AS best_metric,
    avg(best_metric) AS mean_metric, stddev_samp(best_metric) AS std_metric, min(best_metric) AS min_metric, max(best_acc) AS best_acc FROM f GROUP BY 1, 2""",
       "run, model, folds, mean_epochs")
def leaderboard(spark, sf):
    """Fold logs written as nested JSON per run and model, read back by file name."""
    path = fresh_path(spark, "logs")
    line = A.table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(
        F.avg("l_discount").alias("best_metric"), F.count(F.lit(1)).alias("n"), F.max("l_tax").alias("acc"))
    history = F.create_map(F.lit("train_loss"), F.array_repeat(F.lit(0.5).cast("double"), F.col("n").cast("int")),
                           F.lit("dir_acc"), F.array(F.lit(0.0), F.col("acc")))
    logs = line.select(F.concat(F.lit("run_"), "l_linestatus").alias("run"), F.col("l_returnflag").alias("model"),
                       F.col("l_linenumber").alias("fold"), "best_metric", history.alias("history"))
    logs.write.json(path)
    raw = spark.read.schema("run string, model string, fold int, best_metric double, history map<string, array<double>>").json(path)
    return P.leaderboard(files.fold_rows(raw))


@query("regime_concentration", f"""WITH {A.TRADES}, s AS (SELECT strategy, regime, sum(pnl) AS p FROM trades GROUP BY 1, 2)
    SELECT strategy, arg_max(regime, abs(p)) AS dominant_regime, max(abs(p)) / (sum(abs(p)) + 1e-9) AS max_regime_conc FROM s GROUP BY strategy""",
       "strategy, dominant_regime")
def regime_concentration(spark, sf):
    return P.regime_concentration(A.trades(spark, sf), ["strategy"])


DISAGREE = f"""{A.BASIC}, p AS (SELECT pair, ts, unnest(['a', 'b', 'c']) AS model, unnest([ret_5 * 100, ret_20 * 100, ofi]) AS pred FROM basic
    WHERE ret_5 IS NOT NULL AND ret_20 IS NOT NULL AND ofi IS NOT NULL)"""


@query("ensemble_confidence", f"""WITH {DISAGREE}, s AS (SELECT pair, ts, avg(pred) AS mean, stddev_samp(pred) AS std FROM p GROUP BY 1, 2),
    c AS (SELECT *, 1 - std / greatest(max(std) OVER (), 1e-6) AS confidence FROM s)
    SELECT pair, ts, mean, std, confidence, CASE WHEN confidence > 0.5 THEN mean ELSE 0 END AS signal FROM c""", "pair, ts", 8)
def ensemble_confidence(spark, sf):
    return P.ensemble_confidence(_ensemble(spark, sf), ["pair", "ts"])


@query("ensemble_diversity", f"""WITH {DISAGREE}, w AS (SELECT a.model AS m1, b.model AS m2, corr(a.pred, b.pred) AS c FROM p a JOIN p b USING (pair, ts)
    WHERE a.model < b.model GROUP BY 1, 2) SELECT avg(c) AS mean_correlation FROM w""", "", 8)
def ensemble_diversity(spark, sf):
    return P.ensemble_diversity(_ensemble(spark, sf), ["pair", "ts"])


def _ensemble(spark, sf):
    f = A.basic_features(spark, sf).df.select(
        "pair", "ts", (F.col("ret_5") * 100).alias("a"), (F.col("ret_20") * 100).alias("b"), F.col("ofi").alias("c")).dropna()
    return f.unpivot(["pair", "ts"], ["a", "b", "c"], "model", "pred")


HELD = f"""{A.BASIC}, h AS (SELECT pair, ts, sign(ret_5) AS pred, fwd AS ret, sign(ret_5) * fwd AS r FROM basic
    WHERE ret_5 IS NOT NULL AND fwd IS NOT NULL AND ts >= '2024-01-20'),
  hc AS (SELECT *, 10000 + sum(r) OVER w AS eq, exp(sum(ln(1 + r)) OVER w) AS cu FROM h WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  hd AS (SELECT *, max(eq) OVER w AS pe, max(cu) OVER w AS pc FROM hc WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


@query("held_out_scores", f"""WITH {HELD} SELECT pair, count(*) AS n_samples, avg((sign(pred) = sign(ret))::INT) AS directional_accuracy,
    avg(r) / (stddev_pop(r) + 1e-9) * sqrt(252) AS sharpe, avg(r) / (stddev_pop(r) + 1e-9) * sqrt(252 * 1440) AS sharpe_by_bar,
    max((pe - eq) / pe) AS max_drawdown, min(cu / pc - 1) AS max_drawdown_compounded, avg((r > 0)::INT) AS win_rate FROM hd GROUP BY pair""",
       "pair, n_samples", 8)
def held_out_scores(spark, sf):
    f = A.basic_features(spark, sf).df.where("ret_5 is not null and fwd is not null and ts >= '2024-01-20'")
    return P.held_out_scores(Series.of(f.select("pair", "ts", F.signum("ret_5").alias("pred"), F.col("fwd").alias("ret"))))


SIG = "CASE WHEN {0} > 0 THEN 0 WHEN {0} < 0 THEN 2 ELSE 1 END"


def _shadow_sql(live, cand):
    return f"""WITH {A.BASIC}, s AS (SELECT pair, ts, {SIG.format('ret_5')} AS l, {SIG.format('ret_20')} AS c, fwd AS ret FROM basic
      WHERE ret_5 IS NOT NULL AND ret_20 IS NOT NULL AND fwd IS NOT NULL),
    r AS (SELECT *, {live} AS lr, {cand} AS cr FROM s),
    q AS (SELECT *, exp(sum(ln(1 + lr)) OVER w) AS le, exp(sum(ln(1 + cr)) OVER w) AS ce FROM r WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, le / max(le) OVER w - 1 AS ld, ce / max(ce) OVER w - 1 AS cd FROM q WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT pair, count(*) AS bars_evaluated, avg(lr) / stddev_pop(lr) * sqrt(252 * 1440) AS live_sharpe, avg(cr) / stddev_pop(cr) * sqrt(252 * 1440) AS cand_sharpe,
      min(ld) AS live_max_dd, min(cd) AS cand_max_dd, avg((l = c)::INT) AS signal_agreement FROM d GROUP BY pair)
    SELECT *, cand_sharpe - live_sharpe AS sharpe_improvement, cand_max_dd - live_max_dd AS dd_delta, CASE WHEN bars_evaluated < 500 THEN 'insufficient_data'
      WHEN cand_sharpe - live_sharpe >= 0.1 AND cand_max_dd - live_max_dd >= -0.02 AND signal_agreement >= 0.6 THEN 'promote' ELSE 'keep_live' END AS status FROM a"""


def _shadow(spark, sf, **rule):
    sig = lambda c: F.when(F.col(c) > 0, 0).when(F.col(c) < 0, 2).otherwise(1)
    f = A.basic_features(spark, sf).df.where("ret_5 is not null and ret_20 is not null and fwd is not null")
    s = Series.of(f.select("pair", "ts", sig("ret_5").alias("live"), sig("ret_20").alias("candidate"), F.col("fwd").alias("ret")))
    return P.shadow_comparison(s, P.ShadowRule(bars=500, **rule))


@query("shadow_comparison", _shadow_sql("CASE l WHEN 0 THEN ret WHEN 2 THEN -ret ELSE 0 END", "CASE c WHEN 0 THEN ret WHEN 2 THEN -ret ELSE 0 END"),
       "pair, bars_evaluated, status", 6)
def shadow_comparison(spark, sf):
    return _shadow(spark, sf)


@query("shadow_comparison_hold_long", _shadow_sql("sign(1.5 - l) * ret", "sign(1.5 - c) * ret"), "pair, bars_evaluated, status", 6)
def shadow_comparison_hold_long(spark, sf):
    return _shadow(spark, sf, hold_is_long=True)


# --- rolling monitoring -----------------------------------------------------------------

ROLL = f"""rs AS (SELECT *, avg((pnl > 0)::INT) OVER ({O} ROWS 99 PRECEDING) AS win_rate, count(*) OVER w200 AS k, avg(pnl) OVER w200 AS m, stddev_pop(pnl) OVER w200 AS s,
    date_diff('second', first_value(ts) OVER w200, ts) / 3600 AS hrs FROM c1 WINDOW w200 AS ({O} ROWS 199 PRECEDING)),
  rt AS (SELECT *, CASE WHEN k >= 10 AND s > 1e-9 THEN m / s * sqrt(252) ELSE 0 END AS rolling_sharpe, CASE WHEN k >= 2 THEN k / greatest(hrs, 1 / 60) END AS trades_per_hour FROM rs)"""


@query("rolling_trade_stats", f"WITH {CURVE}, {ROLL} SELECT strategy, ts, trade_id, win_rate, rolling_sharpe, trades_per_hour FROM rt",
       "strategy, ts, trade_id", 6)
def rolling_trade_stats(spark, sf):
    return P.rolling_trade_stats(A.trade_series(spark, sf, "pnl")).df.select(
        "strategy", "ts", "trade_id", "win_rate", "rolling_sharpe", "trades_per_hour")


@query("monitoring_snapshot", f"""WITH {CURVE}, {ROLL} SELECT strategy, ts, n_trades, equity, equity - {START} AS pnl_session,
      (greatest(peak, {START}) - equity) / greatest(peak, {START}) AS drawdown, win_rate, rolling_sharpe AS sharpe, trades_per_hour FROM (
    SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts DESC, trade_id DESC) AS last, count(*) OVER (PARTITION BY strategy) AS n_trades FROM rt) WHERE last = 1""",
       "strategy, ts, n_trades", 6)
def monitoring_snapshot(spark, sf):
    return P.monitoring_snapshot(A.trade_series(spark, sf, "pnl"), START)


@query("risk_adjusted_reward", f"""WITH {CURVE}, n AS (SELECT *, pnl - cost AS net, max(equity / {START}) OVER ({O} ROWS UNBOUNDED PRECEDING) AS pk FROM c1),
    q AS (SELECT *, count(*) OVER w AS k, (avg(net) OVER w - 0.05::DOUBLE / 252) / (stddev_pop(net) OVER w + 1e-9) * sqrt(252) AS ratio FROM n WINDOW w AS ({O} ROWS 99 PRECEDING))
    SELECT strategy, ts, trade_id, CASE WHEN k < 2 THEN 0 ELSE ratio - 0.5 * greatest((greatest(pk, 1) - equity / {START}) / greatest(pk, 1), 0) - 0.3::DOUBLE * abs(cost) END AS reward FROM q""",
       "strategy, ts, trade_id", 6)
def risk_adjusted_reward(spark, sf):
    s = P.equity_curve(A.trade_series(spark, sf, "pnl", "cost").lending(P.REWARD_LOOK_BACK), start=START)
    s = s.map(lambda f: f.withColumn("equity", F.col("equity") / START))
    return P.risk_adjusted_reward(s).df.select("strategy", "ts", "trade_id", "reward")


@query("demotion", f"""WITH {CURVE}, x AS (SELECT *, row_number() OVER ({O}) AS rn FROM c1),
    q AS (SELECT *, count(*) OVER w AS k, avg((pnl > 0)::INT) OVER w AS win_rate, avg(pnl) OVER w / nullif(stddev_pop(pnl) OVER w, 0) * sqrt(252) AS sh,
      list(equity) OVER ({O} ROWS 149 PRECEDING) AS eqs FROM x WINDOW w AS ({O} ROWS 299 PRECEDING)),
    d AS (SELECT *, CASE WHEN k >= 10 THEN coalesce(sh, 0) ELSE 0 END AS sharpe FROM q),
    f AS (SELECT * FROM d WHERE k >= 30 AND (sharpe < 0.5 OR win_rate < 0.45)),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY rn) AS j FROM f) WHERE j = 1)
    SELECT strategy, ts, trade_id, sharpe, win_rate, (SELECT max((list_max(eqs[1:i]) - eqs[i]) / list_max(eqs[1:i])) FROM range(1, len(eqs) + 1) t(i)) AS max_drawdown,
      sharpe < 0.5 AS sharpe_low, win_rate < 0.45 AS win_rate_low, false AS drawdown_high FROM o""",
       "strategy, ts, trade_id, sharpe_low, win_rate_low, drawdown_high", 6)
def demotion(spark, sf):
    return P.demotion(P.equity_curve(A.trade_series(spark, sf, "pnl"), start=START))


@query("demotion_by_drawdown", f"""WITH {CURVE}, x AS (SELECT *, row_number() OVER ({O}) AS rn, list(equity) OVER ({O} ROWS 149 PRECEDING) AS eqs FROM c1),
    d AS (SELECT strategy, ts, trade_id, rn, list_max(list_transform(range(1, len(eqs) + 1), lambda i: (list_max(eqs[1:i]) - eqs[i]) / list_max(eqs[1:i]))) AS max_drawdown FROM x WHERE rn >= 30)
    SELECT strategy, arg_min(ts, rn) AS ts, arg_min(trade_id, rn) AS trade_id, arg_min(max_drawdown, rn) AS max_drawdown, false AS sharpe_low, false AS win_rate_low, true AS drawdown_high
    FROM d WHERE max_drawdown > 0.0004::DOUBLE GROUP BY strategy""",
       "strategy, ts, trade_id, sharpe_low, win_rate_low, drawdown_high", 6)
def demotion_by_drawdown(spark, sf):
    """The other two floors out of reach, and a limit that these small swings can break."""
    rule = P.DemotionRule(sharpe_floor=-1e9, win_rate_floor=-1.0, max_drawdown=0.0004)
    return P.demotion(P.equity_curve(A.trade_series(spark, sf, "pnl"), start=START), rule).drop("sharpe", "win_rate")


@query("page_hinkley_first", f"""WITH {A.TRADES}, m AS (SELECT *, row_number() OVER ({O}) AS n, sum(-pnl - 0.005::DOUBLE) OVER ({O} ROWS UNBOUNDED PRECEDING) AS s FROM trades),
    q AS (SELECT *, s - least(min(s) OVER ({O} ROWS UNBOUNDED PRECEDING), 0) AS statistic FROM m)
    SELECT strategy, min(n) AS row, arg_min(ts, n) AS ts, arg_min(trade_id, n) AS trade_id, arg_min(statistic, n) AS statistic FROM q WHERE n >= 30 AND statistic > 500 GROUP BY strategy""",
       "strategy, row, ts, trade_id", 6)
def page_hinkley_first(spark, sf):
    return P.first_alarm(A.trade_series(spark, sf, "pnl"), -F.col("pnl"), threshold=500.0)


# --- promotion -------------------------------------------------------------------------

GATE = f"""{CURVE}, g AS (SELECT strategy, count(*) AS n_trades, avg(pnl) / stddev_pop(pnl) * sqrt(252) AS sharpe,
    sum(pnl) FILTER (pnl > 0) AS gp, abs(sum(pnl) FILTER (pnl < 0)) AS gl, max((peak - equity) / peak) AS max_drawdown, sum(cost) AS tc,
    skewness(pnl) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) AS sk, kurtosis_pop(pnl) + 3 AS ku FROM c1 GROUP BY strategy),
  rg AS (SELECT strategy, arg_max(regime, abs(p)) AS dominant_regime, max(abs(p)) / (sum(abs(p)) + 1e-9) AS conc FROM (
    SELECT strategy, regime, sum(pnl) AS p FROM trades GROUP BY 1, 2) GROUP BY strategy)"""


def _phi(z: str) -> str:
    """Normal distribution function by Simpson's rule over 4000 steps."""
    f = f"exp(-pow(({z}) * i / 4000, 2) / 2)"
    return (f"(SELECT 0.5 + ({z}) / 4000 / 3 / sqrt(2 * pi()) * sum({f} * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            "FROM range(0, 4001) t(i))")


@query("probabilistic_sharpe", f"""WITH {GATE}, s AS (SELECT *, sharpe / 16 AS sr FROM g),
    z AS (SELECT *, sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n_trades - 1)) AS sd FROM s)
    SELECT strategy, n_trades, sr, sk AS skewness, ku AS kurtosis, {_phi('least(greatest(sr / sd, -12), 12)')} AS psr,
      {_phi('least(greatest((sr - 0.01) / sd, -12), 12)')} AS psr_above, {_phi('least(greatest((sr - ((1 - 0.5772156649) * sqrt(2 * ln(10)) + 0.5772156649 / sqrt(2 * ln(10)))) / sd, -8), 12)')} AS dsr FROM z""",
       "strategy, n_trades", 7)
def probabilistic_sharpe(spark, sf):
    m = P.gate_metrics(A.trade_series(spark, sf, "pnl", "cost", "regime"), START)
    sr, n, sk, ku = F.col("sharpe") / 16, F.col("n_trades"), F.col("skewness"), F.col("kurtosis")
    return m.select("strategy", "n_trades", sr.alias("sr"), "skewness", "kurtosis", P.probabilistic_sharpe(sr, n, sk, ku).alias("psr"),
                    P.probabilistic_sharpe(sr, n, sk, ku, 0.01).alias("psr_above"), P.deflated_sharpe(sr, 10, n, sk, ku).alias("dsr"))


@query("promotion_gate", f"""WITH {GATE}, j AS (SELECT g.*, conc, dominant_regime, gp / greatest(gl, 1e-9) AS pf, tc / greatest(abs(gp), 1e-9) AS cp,
      sharpe / sqrt((1 + 0.5 * sharpe * sharpe) / (n_trades - 1)) AS z FROM g JOIN rg USING (strategy)),
    q AS (SELECT *, {_phi('least(greatest(z, -12), 12)')} AS psr FROM j)
    SELECT strategy, n_trades, dominant_regime, sharpe, pf AS profit_factor, max_drawdown, conc AS max_regime_conc, cp AS cost_pct, psr,
      concat_ws(',', CASE WHEN sharpe < 1.5 THEN 'sharpe_ok' END, CASE WHEN pf < 1.5 THEN 'pf_ok' END, CASE WHEN max_drawdown > 0.2 THEN 'dd_ok' END, CASE WHEN n_trades < 500 THEN 'sample_ok' END,
        CASE WHEN conc > 0.75 THEN 'regime_ok' END, CASE WHEN cp > 0.3 THEN 'cost_ok' END, CASE WHEN psr <= 0.5 THEN 'psr_ok' END) AS failed,
      sharpe >= 1.5 AND pf >= 1.5 AND max_drawdown <= 0.2 AND n_trades >= 500 AND conc <= 0.75 AND cp <= 0.3 AND psr > 0.5 AS promoted FROM q""",
       "strategy, n_trades, dominant_regime, failed, promoted", 6)
def promotion_gate(spark, sf):
    m = P.gate_metrics(A.trade_series(spark, sf, "pnl", "cost", "regime"), START)
    g = P.promotion_gate(m).withColumn("failed", F.array_join("failed", ","))
    return g.select("strategy", "n_trades", "dominant_regime", "sharpe", "profit_factor", "max_drawdown", "max_regime_conc",
                    "cost_pct", "psr", "failed", "promoted")


IMPORTANCE = f"""{A.BASIC}, il AS (SELECT pair AS model, (day(ts) - 1) // 7 AS cycle, unnest(['ofi', 'atr_6', 'ret_5', 'ret_20', 'volume', 'spread_avg']) AS feature,
    unnest([ofi, atr_6, ret_5, ret_20, volume, spread_avg]) AS x, fwd FROM basic),
  imp AS (SELECT model, cycle, feature, abs(corr(x, fwd)) AS importance FROM il WHERE x IS NOT NULL AND fwd IS NOT NULL GROUP BY 1, 2, 3),
  tp AS (SELECT model, cycle, list(feature ORDER BY feature) AS top FROM (SELECT *, row_number() OVER (PARTITION BY model, cycle ORDER BY importance DESC, feature) AS k FROM imp) WHERE k <= 3 GROUP BY 1, 2),
  lg AS (SELECT *, lag(top) OVER (PARTITION BY model ORDER BY cycle) AS prev FROM tp)"""


@query("importance_shift", f"""WITH {IMPORTANCE} SELECT model, cycle, array_to_string(top, ',') AS top, CASE WHEN prev IS NOT NULL THEN 1 - len(list_intersect(top, prev)) / len(top) END AS shift,
    CASE WHEN prev IS NOT NULL THEN array_to_string(list_sort(list_filter(top, lambda f: NOT list_contains(prev, f))), ',') END AS entered, prev IS NOT NULL AND 1 - len(list_intersect(top, prev)) / len(top) > 0.3 AS alert FROM lg""",
       "model, cycle, top, entered, alert", 6)
def importance_shift(spark, sf):
    cols = ["ofi", "atr_6", "ret_5", "ret_20", "volume", "spread_avg"]
    cycle = F.floor((F.dayofmonth("ts") - 1) / 7).alias("cycle")
    long = A.basic_features(spark, sf).df.select(F.col("pair").alias("model"), cycle, "fwd", *cols).unpivot(
        ["model", "cycle", "fwd"], cols, "feature", "x").where("x is not null and fwd is not null")
    imp = long.groupBy("model", "cycle", "feature").agg(F.abs(F.corr("x", "fwd")).alias("importance"))
    out = P.importance_shift(imp, k=3)
    return out.select("model", "cycle", F.array_join("top", ",").alias("top"), "shift",
                      F.array_join(F.array_sort("entered"), ",").alias("entered"), "alert")


# --- drift --------------------------------------------------------------------------------

DRIFT_COLS = ["ofi", "atr_6", "ret_5", "ret_20", "volume"]
DRIFT = f"""{A.BASIC}, pt AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) <= floor(count(*) OVER (PARTITION BY pair) * 0.7::DOUBLE) AS base FROM basic),
  lv AS (SELECT pair, base, unnest({DRIFT_COLS}) AS feature, unnest([{', '.join(DRIFT_COLS)}]) AS v FROM pt),
  dv AS (SELECT * FROM lv WHERE v IS NOT NULL)"""


def _drift_sides(spark, sf):
    f = chronological_split(A.basic_features(spark, sf))
    both = f.unpivot(["pair", "part"], DRIFT_COLS, "feature", "value")
    return both.where("part = 'train'").drop("part"), both.where("part = 'test'").drop("part"), f


@query("population_stability", f"""WITH {DRIFT}, ed AS (SELECT pair, feature, min(v) AS lo, max(v) AS hi FROM dv WHERE base GROUP BY 1, 2),
    bn AS (SELECT pair, feature, lo, hi, base, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS b FROM dv JOIN ed USING (pair, feature) WHERE v BETWEEN lo AND hi),
    ct AS (SELECT pair, feature, any_value(hi - lo) AS w, g.b, count(*) FILTER (base AND bn.b = g.b) / count(*) FILTER (base) AS e, count(*) FILTER (NOT base AND bn.b = g.b) / count(*) FILTER (NOT base) AS a
      FROM bn, range(10) g(b) GROUP BY pair, feature, g.b),
    ds AS (SELECT pair, feature, e, a, e / (w / 10) + 1e-6 AS de, a / (w / 10) + 1e-6 AS da FROM ct)
    SELECT pair, feature, sum((da - de) * ln(da / de)) AS psi, sum((a - e) * ln((a + 1e-6) / (e + 1e-6))) AS psi_share FROM ds GROUP BY 1, 2""", "pair, feature", 4)
def population_stability(spark, sf):
    base, live, _ = _drift_sides(spark, sf)
    d = D.psi(base, live, ["pair", "feature"])
    p = D.psi(base, live, ["pair", "feature"], density=False).withColumnRenamed("psi", "psi_share")
    return d.join(p, ["pair", "feature"])


KS = """ks0 AS (SELECT pair, feature, v, count(*) FILTER (base) AS x, count(*) FILTER (NOT base) AS y FROM dv GROUP BY 1, 2, 3),
  ks1 AS (SELECT *, sum(x) OVER w AS cx, sum(y) OVER w AS cy, sum(x) OVER (PARTITION BY pair, feature) AS nx, sum(y) OVER (PARTITION BY pair, feature) AS ny FROM ks0
    WINDOW w AS (PARTITION BY pair, feature ORDER BY v)),
  ks AS (SELECT pair, feature, nx::BIGINT AS n_baseline, ny::BIGINT AS n_live, max(abs(cx / nx - cy / ny)) AS ks FROM ks1 GROUP BY 1, 2, 3, 4),
  kp AS (SELECT *, (SELECT 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * pow(ks * sqrt(n_baseline * n_live / (n_baseline + n_live)), 2))) FROM range(1, 101) t(k)) AS tail FROM ks)"""


@query("ks_two_sample", f"""WITH {DRIFT}, {KS} SELECT pair, feature, n_baseline, n_live, ks, least(greatest(tail, 0), 1) AS p_value FROM kp""",
       "pair, feature, n_baseline, n_live", 8)
def ks_two_sample(spark, sf):
    base, live, _ = _drift_sides(spark, sf)
    return D.ks_two_sample(base, live, ["pair", "feature"])


@query("drift_verdict", f"""WITH {DRIFT}, {KS}, ed AS (SELECT pair, feature, min(v) AS lo, max(v) AS hi FROM dv WHERE base GROUP BY 1, 2),
    bn AS (SELECT pair, feature, base, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS b FROM dv JOIN ed USING (pair, feature) WHERE v BETWEEN lo AND hi),
    ct AS (SELECT pair, feature, g.b, count(*) FILTER (base AND bn.b = g.b) / count(*) FILTER (base) + 1e-6 AS e, count(*) FILTER (NOT base AND bn.b = g.b) / count(*) FILTER (NOT base) + 1e-6 AS a
      FROM bn, range(10) g(b) GROUP BY pair, feature, g.b),
    ps AS (SELECT pair, max(p) AS psi_max FROM (SELECT pair, feature, sum((a - e) * ln(a / e)) AS p FROM ct GROUP BY 1, 2) GROUP BY pair),
    kk AS (SELECT pair, min(least(greatest(tail, 0), 1)) AS ks_min_pvalue FROM kp GROUP BY pair),
    sh AS (SELECT pair, avg(fwd) FILTER (base) / (stddev_pop(fwd) FILTER (base) + 1e-9) * sqrt(252) - avg(fwd) FILTER (NOT base) / (stddev_pop(fwd) FILTER (NOT base) + 1e-9) * sqrt(252) AS sharpe_drop FROM pt GROUP BY pair)
    SELECT pair, psi_max, ks_min_pvalue, sharpe_drop, concat_ws(',', CASE WHEN sharpe_drop > 0.5 THEN 'sharpe_drop' END, CASE WHEN psi_max > 0.2 THEN 'psi' END, CASE WHEN ks_min_pvalue < 0.05 THEN 'ks' END) AS reasons,
      sharpe_drop > 0.5 OR psi_max > 0.2 OR ks_min_pvalue < 0.05 AS drift_detected FROM ps JOIN kk USING (pair) JOIN sh USING (pair)""", "pair, reasons, drift_detected", 7)
def drift_verdict(spark, sf):
    base, live, f = _drift_sides(spark, sf)
    ret = lambda part: f.where(F.col("part") == part).select("pair", F.col("fwd").alias("ret"))
    keys = ["pair", "feature"]
    v = D.drift_verdict(D.psi(base, live, keys, density=False), D.ks_two_sample(base, live, keys), ret("train"), ret("test"), ["pair"])
    return v.withColumn("reasons", F.array_join("reasons", ","))


# --- Monte Carlo ---------------------------------------------------------------------------

N_SIMS = 1000


@query("monte_carlo_shuffle", digits=6)
def monte_carlo_shuffle(spark, sf):
    sims = D.simulations(A.trades(spark, sf), ["strategy"], "trade_id", "pnl", N_SIMS, start=START)
    return D.simulation_summary(sims, ["strategy"])


@query("monte_carlo_bootstrap", digits=6)
def monte_carlo_bootstrap(spark, sf):
    t = A.trades(spark, sf).withColumn("pnl", F.col("pnl") / START)
    sims = D.simulations(t, ["strategy"], "trade_id", "pnl", N_SIMS, "bootstrap", compound=True)
    orig = t.groupBy("strategy").agg(P.sharpe(F.col("pnl"), 252, eps=None).alias("sharpe"))
    return D.simulation_summary(sims, ["strategy"], orig)


# --- slippage --------------------------------------------------------------------------------

def _fit_sql(slip):
    return f"""sl AS (SELECT *, {slip} AS slip FROM fills WHERE lots > 0.001),
  ft AS (SELECT brand, count(*) AS n_fills, exp(regr_intercept(ln(greatest(slip, 0.01)), ln(lots / 5000 + 1e-9))) AS alpha,
    least(greatest(regr_slope(ln(greatest(slip, 0.01)), ln(lots / 5000 + 1e-9)), 0.3), 1) AS beta FROM sl GROUP BY brand),
  se AS (SELECT brand, session, avg(slip) AS m FROM sl GROUP BY 1, 2),
  ff AS (SELECT brand, session, n_fills, alpha, beta, CASE WHEN m > 0 AND alpha * pow(1 / 5000, beta) > 0 THEN m / (alpha * pow(1 / 5000, beta)) END AS session_factor FROM se JOIN ft USING (brand))"""


MOVE = "(fill_price - requested_price) * direction / 0.0001::DOUBLE"


@query("session_slippage", f"""WITH {A.FILLS}, {_fit_sql(f'greatest({MOVE}, 0)')} SELECT *,
    least(greatest(alpha * pow(2 / 5000, beta) * coalesce(session_factor, 1.5) * (1 + 0.3 * greatest(1.4 - 1, 0)), 0), 10) AS predicted_pips FROM ff""",
       "brand, session, n_fills", 5)
def session_slippage(spark, sf):
    return _session_fit(spark, sf, False)


def _session_fit(spark, sf, literal):
    fit = D.fit_session_slippage(A.fills(spark, sf), ["brand"], literal_sign=literal)
    pips = D.session_slippage(F.lit(2.0), F.col("alpha"), F.col("beta"), F.col("session_factor"), F.lit(1.4))
    return fit.withColumn("predicted_pips", pips)


@query("session_slippage_literal_sign", f"""WITH {A.FILLS}, {_fit_sql(f'-least({MOVE}, 0)')} SELECT *,
    least(greatest(alpha * pow(2 / 5000, beta) * coalesce(session_factor, 1.5) * (1 + 0.3 * greatest(1.4 - 1, 0)), 0), 10) AS predicted_pips FROM ff""",
       "brand, session, n_fills", 5)
def session_slippage_literal_sign(spark, sf):
    return _session_fit(spark, sf, True)


@query("power_slippage", f"""WITH {A.FILLS}, s AS (SELECT brand, lots, greatest({MOVE}, 0) AS slip FROM fills),
    f AS (SELECT brand, count(*) AS n_fills, exp(regr_intercept(ln(slip), ln(lots / 1000))) AS alpha, regr_slope(ln(slip), ln(lots / 1000)) AS beta, regr_r2(ln(slip), ln(lots / 1000)) AS r2 FROM s WHERE lots > 0 AND slip > 0 GROUP BY brand)
    SELECT brand, n_fills, alpha, beta, round(r2, 4) AS r_squared, alpha * pow(2 / 1000, beta) AS predicted_pips FROM f""", "brand, n_fills", 4)
def power_slippage(spark, sf):
    f = A.fills(spark, sf).withColumn("slip", D.adverse_slippage())
    fit = D.fit_slippage(f, ["brand"])
    return fit.withColumn("predicted_pips", D.power_slippage(F.lit(2.0), F.col("alpha"), F.col("beta")))


# --- sizing, execution, portfolio ----------------------------------------------------------------

SIZE = f"""{A.BASIC}, sz AS (SELECT pair, ts, ln("close") - ln(lag("close") OVER (PARTITION BY pair ORDER BY ts)) AS ret, 0.5 + ofi / 4 AS win_prob, 1 + bb AS win_loss_ratio, atr_6 AS atr,
    10000 + 1000 * ofi AS equity, ofi AS corr_avg, 0.5 + ret_5 * 10 AS hurst, CASE WHEN ret_20 > 0.02 THEN 1.0 ELSE 0.0 END AS corr_break FROM (
      SELECT *, least(greatest(("close" - low) / (high - low + 1e-9), 0), 1) AS bb FROM basic)),
  sy AS (SELECT * FROM sz WHERE win_prob IS NOT NULL AND hurst IS NOT NULL AND corr_break IS NOT NULL AND ret IS NOT NULL AND atr IS NOT NULL)"""


def _sizing(spark, sf):
    from tickloom.operators import features as W

    s = A.basic_features(spark, sf).apply(W.log_return("ret"))
    f = s.df.select("pair", "ts", "ret", (0.5 + F.col("ofi") / 4).alias("win_prob"), (1 + S.range_position()).alias("win_loss_ratio"),
                    F.col("atr_6").alias("atr"), (10000 + 1000 * F.col("ofi")).alias("equity"), F.col("ofi").alias("corr_avg"),
                    (0.5 + F.col("ret_5") * 10).alias("hurst"), F.when(F.col("ret_20").isNotNull(), S.flag(F.col("ret_20") > 0.02)).alias("corr_break"))
    return Series.of(f.dropna())


@query("kelly_positions", f"""WITH {SIZE.replace("CASE WHEN ret_20 > 0.02 THEN 1.0 ELSE 0.0 END", "CASE WHEN ret_20 > 0.02 THEN 1.0 WHEN ret_20 IS NOT NULL THEN 0.0 END")},
    v AS (SELECT *, count(*) OVER w AS k, stddev_pop(ret) OVER w AS sd FROM sy WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 19 PRECEDING)),
    f AS (SELECT *, win_prob - (1 - win_prob) / win_loss_ratio AS full_kelly, CASE WHEN k < 2 THEN 1 ELSE least(greatest(0.1::DOUBLE / (sd * sqrt(252) + 1e-9), 0.1), 3) END AS vol_scalar FROM v),
    g AS (SELECT *, least(greatest(full_kelly * 0.25, 0), 1) AS frac_kelly FROM f), h AS (SELECT *, 10000 * least(frac_kelly * vol_scalar, 0.05) AS risk_usd FROM g),
    l AS (SELECT *, round_even(least(greatest(risk_usd / greatest(20, atr / 0.0001::DOUBLE * 1.5), 0.01), 0.2) * 100, 0) / 100 AS lots FROM h)
    SELECT pair, ts, full_kelly, frac_kelly, vol_scalar, risk_usd, lots, 0.1::DOUBLE * sqrt(lots / (1000 + 1e-9)) * lots AS impact_usd FROM l""", "pair, ts", 6)
def kelly_positions(spark, sf):
    return R.kelly_positions(_sizing(spark, sf)).select("pair", "ts", "full_kelly", "frac_kelly", "vol_scalar", "risk_usd", "lots", "impact_usd")


@query("regime_positions", f"""WITH {SIZE.replace("CASE WHEN ret_20 > 0.02 THEN 1.0 ELSE 0.0 END", "CASE WHEN ret_20 > 0.02 THEN 1.0 WHEN ret_20 IS NOT NULL THEN 0.0 END")},
    v AS (SELECT *, count(*) OVER w AS k, stddev_pop(ret) OVER w AS sd FROM sy WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 59 PRECEDING)),
    f AS (SELECT *, greatest(0, win_prob - (1 - win_prob) / greatest(win_loss_ratio, 0.01)) AS fk, CASE WHEN k < 20 THEN 1 ELSE least(greatest(0.1::DOUBLE / (sd * sqrt(252) + 1e-9), 0.1), 3) END AS vol_scalar,
      least(greatest(CASE WHEN corr_avg > 0.7 OR corr_break > 0 THEN 0.5 ELSE 1 END * CASE WHEN hurst > 0.6 THEN 1.2 WHEN hurst < 0.4 THEN 0.75 ELSE 1 END, 0.05::DOUBLE / 0.25), 0.4::DOUBLE / 0.25) AS regime_scale FROM v),
    g AS (SELECT *, least(greatest(fk * 0.25 * regime_scale, 0.05), 0.4) AS kelly FROM f), h AS (SELECT *, equity * least(kelly * vol_scalar, 0.05) AS risk_usd FROM g)
    SELECT pair, ts, CASE WHEN corr_avg > 0.7 THEN 'crisis' WHEN hurst > 0.6 THEN 'trending' WHEN hurst < 0.4 THEN 'mean_rev' ELSE 'normal' END AS regime, regime_scale, vol_scalar, kelly, risk_usd,
      round_even(least(greatest(least(risk_usd / greatest(10, atr / 0.0001::DOUBLE * 1.5), equity / 10000 * 0.3), 0.01), equity / 10000 * 0.3) * 100, 0) / 100 AS lots FROM h""", "pair, ts, regime", 6)
def regime_positions(spark, sf):
    return R.regime_positions(_sizing(spark, sf)).select("pair", "ts", "regime", "regime_scale", "vol_scalar", "kelly", "risk_usd", "lots")


@query("execution_cost", f"""WITH {A.BARS}, o AS (SELECT *, CASE WHEN "close" >= open THEN 1 ELSE -1 END AS d, volume / 100 AS lots FROM bars)
    SELECT pair, ts, d AS direction, CASE WHEN d > 0 THEN ask_close ELSE bid_close END + d * 0.5 * 0.0001::DOUBLE + d * spread_avg * sqrt(lots / 500) AS price,
      "close" + d * spread_avg / 2 + d * 0.5 * 0.0001::DOUBLE AS mid_price, lots * 3.5 AS commission FROM o""", "pair, ts, direction", 8)
def execution_cost(spark, sf):
    b = A.bars(spark, sf).withColumn("direction", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)).withColumn("lots", F.col("volume") / 100)
    d, lots = F.col("direction"), F.col("lots")
    return b.select("pair", "ts", "direction", R.execution_price(d, lots).alias("price"),
                    R.execution_price(d, lots, use_book=False, impact=False).alias("mid_price"), R.commission(lots).alias("commission"))


SLICES = """o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT AS cents, l_quantity / 10 AS lots,
    CASE l_returnflag WHEN 'A' THEN 'urgent' WHEN 'N' THEN 'patient' ELSE 'normal' END AS urgency FROM lineitem),
  q AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) AS order_id,
    CASE WHEN lots > 2 THEN 10 WHEN urgency = 'urgent' THEN 3 WHEN urgency = 'patient' THEN 15 ELSE 5 END AS n_slices FROM o),
  kp AS (SELECT sqrt(1e-6 * pow(0.0001::DOUBLE, 2) / 2.5e-7) AS kappa),
  sl AS (SELECT order_id, lots, n_slices, t.slice, CASE WHEN kappa * n_slices < 1e-6 THEN 1 / n_slices ELSE
      greatest(CASE WHEN slice = 1 THEN 1 ELSE sinh(kappa * (n_slices - slice + 1)) / (sinh(kappa * n_slices) + 1e-12) END - sinh(kappa * (n_slices - slice)) / (sinh(kappa * n_slices) + 1e-12), 0) END AS x
    FROM q, kp, range(1, 16) t(slice) WHERE slice <= n_slices),
  sc AS (SELECT order_id, lots, n_slices, slice, x * lots / sum(x) OVER (PARTITION BY order_id) AS slice_lots FROM sl)"""


def _slices(spark, sf):
    line = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    line.append(F.rint(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    o = A.table(spark, sf, "lineitem").select(
        F.concat_ws("-", *line).alias("order_id"), (F.col("l_quantity") / 10).alias("lots"),
        F.when(F.col("l_returnflag") == "A", "urgent").when(F.col("l_returnflag") == "N", "patient").otherwise("normal").alias("urgency"))
    _, n = R.split_rule(F.col("lots"), F.col("urgency"))
    return R.slice_orders(o, "order_id", slices=n)


@query("order_slices", f"WITH {SLICES} SELECT order_id, n_slices, slice::INT AS slice, lots, slice_lots FROM sc", "order_id, n_slices, slice", 6)
def order_slices(spark, sf):
    return _slices(spark, sf).select("order_id", "n_slices", "slice", "lots", "slice_lots")


@query("impact_cost", f"""WITH {SLICES}, p AS (SELECT order_id, count(*) AS n_slices, max(lots) AS lots, (2.5e-8 * max(lots) + 2.5e-7 * sum(slice_lots * slice_lots)) / 0.0001::DOUBLE AS pips FROM sc GROUP BY order_id)
    SELECT order_id, n_slices, round(pips, 4) AS impact_pips, round(pips * 10 * lots, 4) AS total_cost_usd FROM p""", "order_id, n_slices", 4)
def impact_cost(spark, sf):
    return R.impact_cost(_slices(spark, sf), "order_id")


@query("portfolio_summary", """WITH p AS (SELECT o_orderpriority AS account, n_name AS pair, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_totalprice / 100000) AS lots
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT account, count(*) AS n_pairs, arg_min(lots, pair) AS first_pair_lots, sum(abs(lots)) AS total_lots, sign(sum(lots))::DOUBLE AS net_direction FROM p GROUP BY account""",
       "account, n_pairs", 5)
def portfolio_summary(spark, sf):
    o, c, n = (A.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    pos = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("o_orderpriority").alias("account"), F.col("n_name").alias("pair"),
        (F.when(F.col("o_orderstatus") == "F", -1).otherwise(1) * F.col("o_totalprice") / 100000).alias("lots"))
    s = R.portfolio_summary(pos)
    return s.select("account", F.size("positions").cast("bigint").alias("n_pairs"),
                    F.element_at(F.map_values("positions"), 1).alias("first_pair_lots"), "total_lots", "net_direction")


BOOK = [("click", 1.0), ("error", -0.8), ("purchase", 0.5), ("signup", 0.3)]
VAR = f"""{A.BARS}, r AS (SELECT pair, ts, ln("close") - ln(lag("close") OVER w) AS ret FROM bars {W_ALL}),
  b AS (SELECT * FROM (VALUES ('click', 1.0::DOUBLE), ('error', -0.8), ('purchase', 0.5), ('signup', 0.3)) t(pair, lots)),
  u AS (SELECT r.*, lots FROM r JOIN b USING (pair) WHERE ret IS NOT NULL),
  tt AS (SELECT ts FROM u GROUP BY ts HAVING count(*) = 4 ORDER BY ts DESC LIMIT 500),
  x AS (SELECT u.* FROM u JOIN tt USING (ts)),
  cv AS (SELECT a.pair AS p, c.pair AS q, any_value(a.lots) * any_value(c.lots) * 100 * covar_pop(a.ret, c.ret) AS wcw, corr(a.ret, c.ret) AS rho FROM x a JOIN x c USING (ts) GROUP BY 1, 2),
  vr AS (SELECT sqrt(sum(wcw)) AS s, avg(rho) FILTER (p < q) AS rho FROM cv)"""


def _var(spark, sf):
    from tickloom.operators import features as W

    s = A.bar_series(spark, sf).apply(W.log_return("ret"))
    rets = s.df.select("pair", "ts", "ret").where("ret is not null")
    book = spark.createDataFrame(BOOK, "pair string, lots double")
    return rets, R.portfolio_var(rets, book, 10_000.0)


@query("portfolio_var", f"""WITH {VAR} SELECT (SELECT count(*) FROM tt) AS n_times, round(2.3263478740408408 * s / 10000, 6) AS var_pct, round(2.3263478740408408 * s, 4) AS var_usd,
    round(s * 0.026652142203457956 / 0.01, 4) AS cvar_usd, round(rho, 3) AS correlation_avg FROM vr""", "n_times", 6)
def portfolio_var(spark, sf):
    return _var(spark, sf)[1]


@query("max_allowed_lots", f"""WITH {VAR}, l AS (SELECT pair, stddev_pop(ret) * 10 AS s1 FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts DESC) AS k FROM r WHERE ret IS NOT NULL) WHERE k <= 60 GROUP BY pair)
    SELECT pair, round(least(greatest(greatest(200 - round(2.3263478740408408 * s, 4), 0) / (2.3263478740408408 * s1), 0.01), 10), 2) AS max_lots FROM l, vr""", "pair", 6)
def max_allowed_lots(spark, sf):
    rets, var = _var(spark, sf)
    return R.max_allowed_lots(Series.of(rets), var.select("var_usd"), 10_000.0)


@query("granger_edges")
def granger_edges(spark, sf):
    from tickloom.operators import causality, cross_asset as X

    panel = X.panel_returns(A.bars(spark, sf), X.wide_panel(A.assets(spark, sf), A.ASSET_NAMES), A.ASSET_NAMES)
    return causality.granger(panel, A.ASSET_NAMES)


# --- trade rows and histograms --------------------------------------------------------------------

@query("trade_log", f"""WITH {CURVE}, l AS (SELECT *, split_part(trade_id, '-', 2)::BIGINT AS adds FROM c1)
    SELECT strategy, trade_id, CASE WHEN regime = 'O' THEN 'Long' ELSE 'Short' END AS direction, adds AS n_scale_adds, pnl / 10 * lots * 10 AS pnl_usd
    FROM l""", "strategy, trade_id, direction, n_scale_adds", 8)
def trade_log(spark, sf):
    """Trades with nested scale-ins, as many as the line number says."""
    n = F.split_part("trade_id", F.lit("-"), F.lit(2)).cast("int")
    adds = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("step"), (F.col("lots") / i).alias("lots")))
    f = A.trades(spark, sf).withColumn("scale_additions", adds).withColumn("direction", F.when(F.col("regime") == "O", 1).otherwise(-1)).withColumn("pnl_pips", F.col("pnl") / 10)
    return P.trade_log(f).select("strategy", "trade_id", "direction", "n_scale_adds", "pnl_usd")


@plain("latency_histogram", """SELECT event_type, b::DOUBLE AS upper, count(*) FILTER (value <= b) AS n FROM events, (VALUES (1), (2), (3), (5), (8), (13), (21), (34), (55), ('inf'::DOUBLE)) t(b) GROUP BY 1, 2""")
def latency_histogram(spark, sf):
    return P.histogram(A.table(spark, sf, "events"), F.col("value"), ["event_type"])


@query("regime_normalised", f"""WITH {A.BARS} SELECT pair, ts, high / (high + low + "close" + 1e-9) AS trending, low / (high + low + "close" + 1e-9) AS neutral,
    "close" / (high + low + "close" + 1e-9) AS mean_reverting, least(greatest(("close" - 1.05::DOUBLE) * 40, -1), 1) AS sentiment FROM bars""", "pair, ts")
def regime_normalised(spark, sf):
    parts = S.normalised([F.col("high"), F.col("low"), F.col("close")])
    names = ("trending", "neutral", "mean_reverting")
    return A.bars(spark, sf).select("pair", "ts", *[p.alias(n) for p, n in zip(parts, names)],
                                    S.clip((F.col("close") - 1.05) * 40, -1.0, 1.0).alias("sentiment"))


_SIDE = "list_sort(list({{'o': {0}, 'v': volume, 'p': {1}}}) OVER (PARTITION BY pair ORDER BY ts, tick_id ROWS 9 PRECEDING))"
BOOKS = f"""{A.TICKS}, bk AS (SELECT tick_id, {_SIDE.format('-bid', 'bid')} AS b, {_SIDE.format('ask', 'ask')} AS a FROM ticks),
  tp AS (SELECT tick_id, b, a, list_sum(list_transform(b[1:5], lambda x: x.v)) AS bd, list_sum(list_transform(a[1:5], lambda x: x.v)) AS ad,
    list_max(list_transform(b[1:5], lambda x: x.v)) AS bm, list_max(list_transform(a[1:5], lambda x: x.v)) AS am FROM bk)"""


@query("order_book", f"""WITH {BOOKS} SELECT tick_id, bd AS ob_bid_depth, ad AS ob_ask_depth, (bd - ad) / (bd + ad + 1e-9) AS ob_imbalance,
    (a[1].p - b[1].p) / 0.0001::DOUBLE AS ob_spread_pip, (bm > 3 * bd / len(b[1:5]))::INT::DOUBLE AS ob_bid_wall, (am > 3 * ad / len(a[1:5]))::INT::DOUBLE AS ob_ask_wall,
    (b[1].p * a[1].v + a[1].p * b[1].v) / (b[1].v + a[1].v + 1e-9) AS microprice FROM tp""", "tick_id", 6)
def order_book(spark, sf):
    """A book per tick: the quotes of the last ten ticks, best first on each side."""
    from tickloom.operators import book

    def side(w, key, price):
        quotes = F.collect_list(F.struct(key.alias("o"), F.col("volume").alias("v"), F.col(price).alias("price"))).over(w.rowsBetween(-9, 0))
        return F.transform(F.array_sort(quotes), lambda q: F.struct(q.price.alias("price"), q.v.alias("quantity")))
    s = Series.of(A.ticks(spark, sf), order=["ts", "tick_id"]).apply(
        add(9, lambda w: {"bids": side(w, -F.col("bid"), "bid"), "asks": side(w, F.col("ask"), "ask")}))
    return s.df.select("tick_id", *[c.alias(n) for n, c in book.book_features().items()])
