"""Queries on text scores, embeddings, streams, guards and whole preparations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.core.series import Series
from tickloom.core.storage import fresh_path, landed
from tickloom.functions import scalar as S
from tickloom.operators import cross_asset as X, sentiment as T
from tickloom.plans import adapters as A, composites as C
from tickloom.plans.catalog_features import BB, RETS, TR, W_ALL, roll
from tickloom.plans.registry import UNROUNDED, plain, query
from tickloom.streaming import guards as G, ticks as L


# --- text -------------------------------------------------------------------------------

def _score(text):
    return T.lexicon_score(text, A.QUERY_BULLISH, A.QUERY_BEARISH)


def _scored(spark, sf):
    return T.score_once(A.headlines(spark, sf), "text", _score).drop("text")


@query("lexicon_scores", f"WITH {A.HEADLINES} SELECT doc_id, source, ts, score FROM scored", "doc_id, source, ts")
def lexicon_scores(spark, sf):
    return _scored(spark, sf)


@query("weighted_scores", f"""WITH {A.HEADLINES} SELECT source, least(greatest(sum(score * (abs(score) + 0.01::DOUBLE)) / sum(abs(score) + 0.01::DOUBLE), -1), 1) AS sentiment
    FROM scored GROUP BY source""", "source", 8)
def weighted_scores(spark, sf):
    return T.weighted_score(_scored(spark, sf), ["source"])


@query("recency_bias", f"""WITH {A.HEADLINES}, r AS (SELECT *, exp(-0.001::DOUBLE * (row_number() OVER (PARTITION BY source ORDER BY ts DESC, doc_id DESC) - 1)) AS w FROM scored)
    SELECT source, sum(score * w) / sum(w) AS bias FROM r GROUP BY source""", "source", 8)
def recency_bias(spark, sf):
    return T.recency_bias(Series.of(_scored(spark, sf), ["source"], ["ts", "doc_id"]))


@query("headlines_to_bars", f"""WITH {A.BARS}, {A.HEADLINES}, h AS (SELECT date_trunc('hour', ts) AS ts, avg(score) AS s FROM scored GROUP BY 1),
    j AS (SELECT pair, bars.ts, s FROM bars LEFT JOIN h ON h.ts = bars.ts),
    l AS (SELECT pair, ts, last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN s <> 0 THEN ts END IGNORE NULLS) OVER w AS hit FROM j {W_ALL})
    SELECT pair, ts, CASE WHEN v IS NULL THEN 0 ELSE least(greatest(v * exp(-0.0001::DOUBLE * date_diff('second', hit, ts)), -1), 1) END AS sentiment FROM l""", "pair, ts", 8)
def headlines_to_bars(spark, sf):
    return T.headlines_to_bars(A.bars(spark, sf).select("pair", "ts"), _scored(spark, sf), "1 hour", 0.0001)


@query("reply_scores", """WITH n AS (SELECT conv_id, turn, nullif(regexp_extract(text, '-?[0-9]+\\.?[0-9]*', 0), '')::DOUBLE AS x FROM conversations)
    SELECT conv_id, turn, CASE WHEN x IS NOT NULL THEN least(greatest(x, -1), 1) END AS score FROM n""", "conv_id, turn")
def reply_scores(spark, sf):
    return A.table(spark, sf, "conversations").select("conv_id", "turn", S.first_number(F.col("text")).alias("score"))


MATRIX = T.projection_matrix(64, 8)


@query("embedding_projection", "WITH " + f"""p AS (SELECT vec_id, {', '.join(f"list_dot_product(embedding::DOUBLE[], [{', '.join(repr(float(v)) + '::DOUBLE' for v in col)}]) AS fb_{i}" for i, col in enumerate(MATRIX))} FROM embeddings)
    SELECT *, tanh(fb_0) AS bias FROM p""", "vec_id", 8)
def embedding_projection(spark, sf):
    cols = T.project(F.col("embedding"), MATRIX)
    return A.table(spark, sf, "embeddings").select("vec_id", *[c.alias(n) for n, c in cols.items()], F.tanh(cols["fb_0"]).alias("bias"))


# --- streams -----------------------------------------------------------------------------

def _messages(spark, sf, frame, tag):
    """Table rows as JSON message files, read back as a stream of text."""
    path = fresh_path(spark, tag)
    frame.select(F.to_json(F.struct(*frame.columns)).alias("value")).write.text(path)
    return spark.readStream.schema("value string").text(path)


@query("stream_store_ticks", f"WITH {A.TICKS} SELECT pair, ts, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread, volume FROM ticks", "pair, ts")
def stream_store_ticks(spark, sf):
    """Tick messages consumed into the partitioned tick table."""
    t = A.ticks(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), "pair", "bid", "ask", "volume")
    table = fresh_path(spark, "live-ticks")
    q = L.store_ticks(L.tick_messages(_messages(spark, sf, t, "tick-topic")), table, f"{table}-checkpoint")
    q.awaitTermination()
    return spark.read.parquet(table).select("pair", "ts", "bid", "ask", "mid", "spread", "volume")


@plain("stream_store_news", "SELECT TIMESTAMP '2024-01-01' + to_minutes(12 * doc_id) AS ts, md5(text) AS headline_key, source FROM documents WHERE text IS NOT NULL")
def stream_store_news(spark, sf):
    h = A.headlines(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("text").alias("headline"),
                                      F.lit(0.0).alias("sentiment"), "source")
    table = fresh_path(spark, "live-news")
    L.store_news(L.news_messages(_messages(spark, sf, h, "news-topic")), table, f"{table}-checkpoint").awaitTermination()
    return spark.read.parquet(table).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.md5(F.col("headline").cast("binary")).alias("headline_key"), "source")


def _event_stream(spark, sf):
    """The events table as a stream of ticks with instants."""
    schema = A.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("double")
    half = 0.0001 * (1 + k) / 2
    mid = 1 + F.col("value") / 1000
    return raw.select(F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), (mid - half).alias("bid"),
                      (mid + half).alias("ask"), (F.col("user_id") + 1).cast("double").alias("volume"))


@query("stream_live_bars", f"""WITH {A.BARS}, e AS (SELECT max(ts) - INTERVAL '10 minutes' AS wm FROM ticks)
    SELECT bars.* FROM bars, e WHERE ts + INTERVAL '1 hour' <= wm""", "pair, ts, n_ticks")
def stream_live_bars(spark, sf):
    """Bars a stream has closed; those still open at its end are not out yet."""
    b = L.drain(L.live_bars(_event_stream(spark, sf), "1 hour", "10 minutes"), "live-bars")
    return b.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- guards ---------------------------------------------------------------------------------

def _accounts(spark, sf):
    """Equity of each event type: start 1000, pnl = 20 - value."""
    from tickloom.operators.performance import equity_curve

    e = A.table(spark, sf, "events").select(F.col("event_type").alias("account"), "ts", "event_id", ((20 - F.col("value")) / 8).alias("pnl"))
    s = equity_curve(Series.of(e, ["account"], ["ts", "event_id"]), start=20_000.0)
    s = s.map(lambda f: f.select("account", "ts", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "equity", "pnl", "_rn"))
    return G.account_columns(s, 20_000.0)


GUARD = """WITH RECURSIVE e0 AS (SELECT event_type AS account, ts, event_id, (20 - value) / 8 AS pnl FROM events),
  e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, 20000 + sum(pnl) OVER (PARTITION BY account ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS equity,
    row_number() OVER (PARTITION BY account ORDER BY ts, event_id) AS rn FROM e0),
  s AS (SELECT account, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS day, 20000::DOUBLE AS equity, 20000::DOUBLE AS peak, 20000::DOUBLE AS base, 0 AS losses, false AS halted, 0 AS lft,
      ''::VARCHAR AS action, 0::DOUBLE AS dd, 0::DOUBLE AS dl FROM (SELECT DISTINCT account FROM e)
    UNION ALL SELECT account, rn, event_id, day, equity, peak, CASE WHEN halted AND lft = 1 THEN equity ELSE base END, losses,
      CASE WHEN halted THEN lft > 1 ELSE action = 'close_all' END, CASE WHEN halted THEN lft - 1 WHEN action = 'close_all' THEN 20 ELSE lft END, action, dd, dl FROM (
      SELECT *, CASE WHEN halted THEN 'halt' WHEN dd >= 0.1 OR dl >= 0.03 THEN 'close_all' WHEN dd >= 0.05 THEN 'reduce_50' WHEN losses >= 5 THEN 'reduce_size' ELSE 'continue' END AS action FROM (
        SELECT *, greatest(0, (peak - equity) / peak) AS dd, greatest(0, (base - equity) / base) AS dl FROM (
          SELECT e.account, e.rn, e.event_id, e.day, e.equity, greatest(s.peak, e.equity) AS peak, CASE WHEN s.day <> e.day THEN s.equity ELSE s.base END AS base,
            CASE WHEN e.pnl < 0 THEN CASE WHEN s.day <> e.day THEN 0 ELSE s.losses END + 1 WHEN e.pnl > 0 THEN 0 WHEN s.day <> e.day THEN 0 ELSE s.losses END AS losses, s.halted, s.lft
          FROM s JOIN e ON e.account = s.account AND e.rn = s.rn + 1))))
  SELECT account, event_id, action, losses AS consec_losses, dd, dl AS daily_loss, CASE action WHEN 'reduce_50' THEN 0.5::DOUBLE WHEN 'reduce_size' THEN greatest(0.25::DOUBLE, 1 - 0.15::DOUBLE * (losses - 4)) WHEN 'continue' THEN 1 ELSE 0 END::DOUBLE AS size_multiplier FROM s WHERE rn > 0"""


@query("drawdown_guard", GUARD, "account, event_id, action, consec_losses", 11)
def drawdown_guard(spark, sf):
    out = G.run_guard(_accounts(spark, sf), G.drawdown_guard(start=20_000.0))
    return out.select("account", "event_id", "action", "dd", "daily_loss", "consec_losses", "size_multiplier")


@query("drawdown_guard_stream", GUARD, "account, event_id, action, consec_losses", 11)
def drawdown_guard_stream(spark, sf):
    """The same guard as a stream of files that are not in order of time, a few per micro-batch.

    Any row may be overtaken by any other here, so the delay is the whole period; a closing row far ahead moves
    the watermark past the last one.
    """
    path = fresh_path(spark, "accounts")
    a = _accounts(spark, sf).df.withColumn("ts", F.col("ts").cast("timestamp"))
    a.withColumn("_part", F.crc32(F.col("event_id").cast("string").cast("binary")) % 6).repartition(6, "_part").drop("_part").write.parquet(path)
    closing = a.groupBy().agg(F.max("ts").alias("ts")).select(F.lit("closing").alias("account"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in a.schema.fields if f.name not in ("account", "ts")]
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = L.drain(G.guard_stream(stream, G.drawdown_guard(start=20_000.0), ["account"], ["ts", "event_id"], delay="100 days"),
                  "guard", lambda: closing.select("*", *empty).select(*a.columns).coalesce(1).write.mode("append").parquet(path))
    return out.select("account", "event_id", "action", "dd", "daily_loss", "consec_losses", "size_multiplier")


@plain("page_hinkley_alarms", """WITH RECURSIVE e AS (SELECT event_type AS account, event_id, value - 50 AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
    s AS (SELECT account, event_id, rn, x - 0.005::DOUBLE AS tot, least(0, x - 0.005::DOUBLE) AS low, 1 AS n, false AS alarm FROM e WHERE rn = 1
      UNION ALL SELECT account, event_id, rn, CASE WHEN hit THEN 0 ELSE t END, CASE WHEN hit THEN 0 ELSE l END, CASE WHEN hit THEN 0 ELSE m END, hit FROM (
        SELECT *, m >= 30 AND t - l > 1500 AS hit FROM (SELECT e.account, e.event_id, e.rn, s.tot + e.x - 0.005::DOUBLE AS t, least(s.low, s.tot + e.x - 0.005::DOUBLE) AS l, s.n + 1 AS m
          FROM s JOIN e ON e.account = s.account AND e.rn = s.rn + 1)))
    SELECT account, event_id, alarm FROM s""")
def page_hinkley_alarms(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("event_type").alias("account"), "ts", "event_id", (F.col("value") - 50).alias("value"))
    return G.guard_batch(e, G.page_hinkley(threshold=1500.0), ["account"], ["ts", "event_id"]).select("account", "event_id", "alarm")


@plain("alert_cooldown", """WITH RECURSIVE e AS (SELECT event_type AS alert_type, event_id, epoch_us(ts) / 1e6 AS at_s, value > 150 AS force, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
    s AS (SELECT alert_type, event_id, rn, at_s AS last, true AS sent FROM e WHERE rn = 1
      UNION ALL SELECT e.alert_type, e.event_id, e.rn, CASE WHEN e.force OR e.at_s - s.last >= 3600 THEN e.at_s ELSE s.last END, e.force OR e.at_s - s.last >= 3600
      FROM s JOIN e ON e.alert_type = s.alert_type AND e.rn = s.rn + 1)
    SELECT alert_type, event_id, sent FROM s""")
def alert_cooldown(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("event_type").alias("alert_type"), "ts", "event_id", (F.col("value") > 150).alias("force"))
    return G.cooldown(e, order=["ts", "event_id"], gap_seconds=3600.0).select("alert_type", "event_id", "sent")


@plain("retrain_points", f"""WITH {A.BARS} SELECT pair, ts, CASE WHEN row_number() OVER (PARTITION BY pair ORDER BY ts) % 100 = 0 THEN 'scheduled'
    WHEN n_ticks > 7 THEN 'drift' ELSE '' END AS reason FROM bars""")
def retrain_points(spark, sf):
    s = A.bar_series(spark, sf).map(lambda f: f.withColumn("drift", F.col("n_ticks") > 7))
    return G.retrain_points(s, every=100).select("pair", "ts", "reason")


# --- whole preparations ---------------------------------------------------------------------------

def _clean_bars_sql(threshold: str, weights: int) -> str:
    return f"""WITH {A.MINUTE_BARS}, wts AS (SELECT list(w ORDER BY k DESC) AS ws FROM (
      SELECT k, coalesce((SELECT product((i - 1 - 0.4::DOUBLE) / i) FROM range(1, k + 1) t(i)), 1) AS w FROM range(0, 2000) r(k)) WHERE abs(w) >= {threshold}),
    b AS (SELECT * FROM mbars WHERE isodow(ts) < 6 AND hour(ts) * 60 + minute(ts) BETWEEN 420 AND 1260),
    p AS (SELECT *, list("close") OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN {weights - 1} PRECEDING AND CURRENT ROW) AS xs FROM b)
    SELECT * EXCLUDE (xs, ws), list_dot_product(xs, ws) AS close_ffd FROM p, wts WHERE len(xs) = len(ws)"""


@query("clean_bars", _clean_bars_sql("1e-5", 1458), "pair, ts, n_ticks")
def clean_bars(spark, sf):
    """Minute bars in session hours; no row until a pair has as many of them as there are weights."""
    return C.clean_bars(A.ticks(spark, sf))


@query("clean_bars_short_memory", _clean_bars_sql("1e-4", 282), "pair, ts, n_ticks")
def clean_bars_short_memory(spark, sf):
    return C.clean_bars(A.ticks(spark, sf), C.BarSpec(threshold=1e-4))


SPEC = C.FeatureSpec(assets=A.PANEL_ASSETS)


def _core(spark, sf):
    panel = X.wide_panel(A.assets(spark, sf), A.PANEL_ASSETS)
    bars = landed(A.bars(spark, sf), "bars")
    arts = bars.select("pair", "ts", F.col("n_ticks").alias("n"))
    # A score is a few seconds old when its bar is stamped, so that what is left of it shows.
    given = F.timestamp_seconds(F.unix_timestamp("ts") - 5 - F.col("n_ticks") % 10).cast(bars.schema["ts"].dataType)
    score = bars.select("pair", given.alias("ts"), F.round(F.col("close") - F.col("open"), 5).alias("score"))
    vectors = A.table(spark, sf, "embeddings").select(
        "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"fb_{i}") for i in range(SPEC.embedding_dims)])
    named = bars.select("pair", "ts", (F.hour("ts") * 31 + F.col("n_ticks")).cast("long").alias("vec_id"))
    return C.core_features(bars, panel, A.releases(spark, sf), score, arts, named.join(vectors, "vec_id").drop("vec_id"), SPEC)


def _core_sql() -> str:
    parts = ["order_flow", "arrival_rate", "true_range", "realised_volatility", "bollinger", "rsi", "macd", "lagged_returns",
             "cross_asset", "macro_links", "regime_break_closed", "event_distances", "blackout", "vol_filters", "range_position"]
    joins = " ".join(f"JOIN ({UNROUNDED[p]}) q_{p} USING (pair, ts)" for p in parts)
    own = f"""WITH {A.BARS} SELECT pair, ts, round("close" - open, 5) * exp(-0.1 * (5 + n_ticks % 10)) AS sentiment_decayed, coalesce({roll('sum', 'n_ticks', 5)}, 0)::DOUBLE AS buzz,
      sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS time_sin, cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS time_cos,
      sin(2 * pi() * (isodow(ts) - 1) / 5) AS day_sin, cos(2 * pi() * (isodow(ts) - 1) / 5) AS day_cos, (hour(ts) BETWEEN 13 AND 17)::INT::DOUBLE AS london_ny, {', '.join(f'coalesce(embedding[{i + 1}]::DOUBLE, 0) AS fb_{i}' for i in range(SPEC.embedding_dims))}
      FROM bars LEFT JOIN embeddings ON vec_id = hour(ts) * 31 + n_ticks"""
    return f"""SELECT * FROM (SELECT pair, ts, {', '.join(f'"{c}"' for c in C.feature_columns(SPEC))} FROM ({own}) own {joins}) WHERE COLUMNS(*) IS NOT NULL"""


# Where a bar's own score is zero, the one before has decayed below any digit an hour later.
@query("core_features", _core_sql(), "pair, ts", 8)
def core_features(spark, sf):
    return _core(spark, sf)


RETURNS = [f"{a}_ret" for a in A.PANEL_ASSETS]


def _advanced_sql() -> str:
    """The second matrix from the parts' SQL, run over the rows of the first one."""
    from tickloom.plans import catalog_features as CF

    base = f"""bars AS (SELECT b.*, {', '.join(f'"{r}"' for r in RETURNS)} FROM (WITH {A.BARS} SELECT * FROM bars) b JOIN ({UNROUNDED['core_features']}) c USING (pair, ts)),
      rets AS (SELECT * FROM bars)"""
    inner = lambda name: UNROUNDED[name].replace(f"WITH {A.BARS}, ", "WITH ").replace(f"WITH {A.BARS}", "")
    ctes = f"""{CF.TVI}, {CF._regime_sql()}, {CF.OPT.replace('sqrt(g)', 'CASE WHEN g >= 0 THEN sqrt(g) END')},
      trend AS ({inner('trend_score')}), fract AS ({inner('fractal_dimension')}),
      pos AS (SELECT pair, ts, volume AS l, n_ticks * 50 AS s FROM (WITH {A.BARS} SELECT * FROM bars) WHERE n_ticks >= 4),
      cot0 AS (SELECT b.pair, b.ts, (l - s) / (l + s + 1e-9) AS cot_net FROM bars b ASOF LEFT JOIN pos ON b.pair = pos.pair AND b.ts >= pos.ts),
      cot AS (SELECT *, cot_net AS cot_noncom_net, CASE WHEN abs(cot_net) > 0.7 THEN 1.0 ELSE 0.0 END::DOUBLE AS cot_extreme, coalesce(cot_net - lag(cot_net, 7) OVER w, 0) AS cot_change FROM cot0 {W_ALL})"""
    filled = ["tvi_buy", "tvi_sell", "tvi_imbalance", "tvi_ratio", "tvi_impact", "corr_avg", "corr_dispersion", "corr_zscore",
              "parkinson_trend_ratio", "hurst", "fractal_dim", "regime_label", "iv_proxy", "skew_proxy", "term_proxy", "risk_reversal",
              "cot_net", "cot_noncom_net", "cot_extreme", "cot_change"]
    raw = """SELECT t2.pair, t2.ts, tvi_buy, tvi_sell, (tvi_buy - tvi_sell) / (tvi_buy + tvi_sell + 1e-9) AS tvi_imbalance,
      CASE WHEN tvi_buy IS NOT NULL THEN least(greatest(tvi_buy / (tvi_sell + 1e-9), 0), 5) END AS tvi_ratio, tvi_impact, corr_avg, corr_dispersion, corr_zscore,
      parkinson_trend_ratio, hurst, fractal_dim, regime_label, iv_proxy, skew_proxy, term_proxy, risk_reversal, cot_net, cot_noncom_net, cot_extreme, cot_change
      FROM t2 JOIN cz USING (pair, ts) JOIN trend USING (pair, ts) JOIN fract USING (pair, ts) JOIN o2 USING (pair, ts) JOIN cot USING (pair, ts)"""
    held = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0)::DOUBLE AS {c}" for c in filled)
    m = "(hour(ts) * 60 + minute(ts))"
    clock = f"""({m} < 540)::INT::DOUBLE AS sess_tokyo, ({m} >= 420 AND {m} < 960)::INT::DOUBLE AS sess_london, ({m} >= 720 AND {m} < 1260)::INT::DOUBLE AS sess_ny,
      ({m} >= 1260 OR {m} < 360)::INT::DOUBLE AS sess_sydney, ({m} >= 780 AND {m} < 960)::INT::DOUBLE AS sess_ln_ny, (({m} >= 420 AND {m} < 435) OR ({m} >= 720 AND {m} < 735))::INT::DOUBLE AS sess_open,
      sin(2 * pi() * {m} / 1440) AS tod_sin, cos(2 * pi() * {m} / 1440) AS tod_cos, sin(2 * pi() * (isodow(ts) - 1) / 5) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 5) AS dow_cos"""
    return f"""WITH {base}, {ctes}, adv AS ({raw}), fl AS (SELECT pair, ts, {held} FROM adv {W_ALL})
      SELECT *, CASE WHEN abs(corr_zscore) > 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS corr_break, {clock} FROM fl"""


@query("advanced_features", _advanced_sql(), "pair, ts", 6)
def advanced_features(spark, sf):
    base = landed(_core(spark, sf), "core")
    pos = A.bars(spark, sf).where("n_ticks >= 4").select(
        "pair", "ts", F.col("volume").alias("long_noncom"), (F.col("n_ticks") * 50).cast("double").alias("short_noncom"))
    return C.advanced_features(A.bars(spark, sf), base, RETURNS, pos)
