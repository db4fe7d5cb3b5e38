"""Market-shaped views of the driver tables, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.core.series import Series, add
from tickloom.functions.scalar import unit_hash
from tickloom.operators.bars import to_bars

# Asset name by order priority (1-5) and status (F, O, P).
ASSET_NAMES = ("DXY", "US10Y", "DE10Y", "US2Y", "WTI", "GOLD", "COPPER", "IRON_ORE", "SPX", "NASDAQ100",
               "VIX", "JP10Y", "GB10Y", "AU10Y", "CA10Y")
PANEL_ASSETS = ASSET_NAMES[:11]
STATUSES = ("F", "O", "P")
PAIRS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return (table(spark, sf_dir, "events")
            .select(F.col("event_type").alias("pair"), "ts", (1 + F.col("value") / 1000).alias("mid"),
                    (0.0001 * (1 + k)).alias("spread"), (F.col("user_id") + 1).cast("double").alias("volume"),
                    F.lit("events").alias("source"), F.col("event_id").alias("tick_id"))
            .withColumns({"bid": F.col("mid") - F.col("spread") / 2, "ask": F.col("mid") + F.col("spread") / 2}))


TICKS = """ticks AS (
  SELECT *, mid - spread / 2 AS bid, mid + spread / 2 AS ask FROM (
    SELECT event_type AS pair, ts, 1 + value / 1000 AS mid,
           0.0001::DOUBLE * (1 + json_extract_string(props, '$.k')::DOUBLE) AS spread,
           (user_id + 1)::DOUBLE AS volume, 'events' AS source, event_id AS tick_id FROM events))"""


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(ticks(spark, sf_dir), "1 minute", tie="tick_id")


MINUTE_BARS = TICKS + """, mbars AS (
  SELECT pair, date_trunc('minute', ts) AS ts, arg_min(mid, (ts, tick_id)) AS open, max(mid) AS high, min(mid) AS low,
         arg_max(mid, (ts, tick_id)) AS "close", sum(volume) AS volume, avg(spread) AS spread_avg,
         arg_max(bid, (ts, tick_id)) AS bid_close, arg_max(ask, (ts, tick_id)) AS ask_close, count(*) AS n_ticks
  FROM ticks GROUP BY pair, date_trunc('minute', ts))"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(ticks(spark, sf_dir), "1 hour", tie="tick_id")


BARS = TICKS + """, bars AS (
  SELECT pair, date_trunc('hour', ts) AS ts, arg_min(mid, (ts, tick_id)) AS open, max(mid) AS high, min(mid) AS low,
         arg_max(mid, (ts, tick_id)) AS "close", sum(volume) AS volume, avg(spread) AS spread_avg,
         arg_max(bid, (ts, tick_id)) AS bid_close, arg_max(ask, (ts, tick_id)) AS ask_close, count(*) AS n_ticks
  FROM ticks GROUP BY pair, date_trunc('hour', ts))"""


def bar_series(spark: SparkSession, sf_dir: str) -> Series:
    return Series.of(bars(spark, sf_dir))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Economic events: the heavy error events."""
    k = F.get_json_object("props", "$.k").cast("double")
    return (table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (k >= 80))
            .select("ts", "event_id", F.col("value").alias("actual"), k.alias("forecast"),
                    (F.col("user_id") + 1).cast("double").alias("prior")))


RELEASES = """releases AS (
  SELECT ts, event_id, value AS actual, k AS forecast, (user_id + 1)::DOUBLE AS prior FROM (
    SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events WHERE event_type = 'error') WHERE k >= 80)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (asset, ts, value): order totals per priority and status; one order day is 18 minutes of January 2024."""
    names = F.array(*[F.lit(a) for a in ASSET_NAMES])
    at = (F.substring("o_orderpriority", 1, 1).cast("int") - 1) * 3 + F.array_position(
        F.array(*[F.lit(s) for s in STATUSES]), F.col("o_orderstatus")).cast("int")
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    ts = F.timestamp_seconds(F.lit(1704067200) + day * 18 * 60).cast("timestamp_ntz")
    return (table(spark, sf_dir, "orders").select(F.element_at(names, at).alias("asset"), ts.alias("ts"), "o_totalprice")
            .groupBy("asset", "ts").agg((F.sum("o_totalprice") / 100000).alias("value")))


ASSETS = f"""assets AS (
  SELECT list_extract({list(ASSET_NAMES)}, (left(o_orderpriority, 1)::INT - 1) * 3
           + list_position({list(STATUSES)}, o_orderstatus)) AS asset,
         TIMESTAMP '2024-01-01' + to_minutes(18 * date_diff('day', DATE '1995-01-01', o_orderdate::DATE)) AS ts,
         sum(o_totalprice) / 100000 AS value
  FROM orders GROUP BY 1, 2)"""


TRADE_KEYS = ["strategy"]
TRADE_ORDER = ["ts", "trade_id"]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades from order lines. The order, line, part, supplier and price together name a trade."""
    line = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    line.append(F.rint(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    cents = F.rint(F.col("l_extendedprice") * 100)
    points = F.rint(F.col("l_discount") * 100) - 5
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("strategy"), F.col("l_linestatus").alias("regime"), F.col("l_shipdate").alias("ts"),
        F.concat_ws("-", *line).alias("trade_id"), (cents * points / 1000000).alias("pnl"),
        (F.col("l_tax") * F.col("l_quantity")).alias("cost"), (F.col("l_quantity") / 10).alias("lots"),
        (F.col("l_tax") * F.col("l_quantity")).alias("commission"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("l_linenumber") * 30)).alias("exit_ts"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("model_ver"))


TRADES = """trades AS (
  SELECT l_returnflag AS strategy, l_linestatus AS regime, l_shipdate AS ts,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS trade_id,
         round(l_extendedprice * 100) * (round(l_discount * 100) - 5) / 1000000 AS pnl,
         l_tax * l_quantity AS cost, l_quantity / 10 AS lots, l_tax * l_quantity AS commission,
         l_shipdate + to_minutes(l_linenumber * 30) AS exit_ts, 'v' || l_linenumber AS model_ver
  FROM lineitem)"""


def trade_series(spark: SparkSession, sf_dir: str, *columns: str) -> Series:
    df = trades(spark, sf_dir)
    df = df.select(*TRADE_KEYS, *TRADE_ORDER, *columns) if columns else df
    return Series.of(df, TRADE_KEYS, TRADE_ORDER)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    return joined.select(
        (F.col("l_quantity") / 10).alias("lots"), F.col("p_retailprice").alias("requested_price"),
        (F.col("p_retailprice") * (1 + (F.col("l_tax") - 0.04) / 100)).alias("fill_price"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("direction"),
        F.col("l_returnflag").alias("session"), F.col("p_brand").alias("brand"))


FILLS = """fills AS (
  SELECT l_quantity / 10 AS lots, p_retailprice AS requested_price,
         p_retailprice * (1 + (l_tax - 0.04) / 100) AS fill_price,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS direction, l_returnflag AS session, p_brand AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# Words for the lexicon query; the default words do not occur in the test texts.
QUERY_BULLISH = ("the", "with", "this")
QUERY_BEARISH = ("and", "was", "for")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 720).cast("timestamp_ntz")
    return table(spark, sf_dir, "documents").select("doc_id", ts.alias("ts"), "source", "text")


def _sql_words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


HEADLINES = f"""headlines AS (
  SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(12 * doc_id) AS ts, source, text FROM documents),
words AS (
  SELECT doc_id, ts, source, list_distinct(string_split_regex(lower(text), '\\s+')) AS ws FROM headlines),
scored AS (
  SELECT doc_id, ts, source, CASE WHEN up + dn > 0 THEN (up - dn) / (up + dn)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (
    SELECT doc_id, ts, source, len(list_intersect(ws, {_sql_words(QUERY_BULLISH)})) AS up,
           len(list_intersect(ws, {_sql_words(QUERY_BEARISH)})) AS dn FROM words))"""


def basic_features(spark: SparkSession, sf_dir: str) -> Series:
    """Bars with a few features, the input of label, drift and prediction queries."""
    from tickloom.operators import features as W

    return bar_series(spark, sf_dir).apply(
        W.order_flow_imbalance(20), *W.true_range_average(6), W.lagged_returns((5, 20)),
        add(1, lambda w: {"fwd": F.ln(F.lead("close").over(w)) - F.ln("close")}, after=1))


BASIC = BARS + """, basic0 AS (
  SELECT *, CASE WHEN volume <> 0 THEN sign("close" - open) END AS side, lag("close") OVER w AS pc,
         ln("close") - ln(lag("close", 5) OVER w) AS ret_5, ln("close") - ln(lag("close", 20) OVER w) AS ret_20,
         ln(lead("close") OVER w) - ln("close") AS fwd
  FROM bars WINDOW w AS (PARTITION BY pair ORDER BY ts)),
basic AS (
  SELECT * EXCLUDE (side, pc, ofi_n, ofi_a, tr_n, tr_a, tr),
         CASE WHEN ofi_n = 20 THEN ofi_a END AS ofi, CASE WHEN tr_n = 6 THEN tr_a END AS atr_6 FROM (
    SELECT *, count(side) OVER w20 AS ofi_n, avg(side) OVER w20 AS ofi_a, count(tr) OVER w6 AS tr_n, avg(tr) OVER w6 AS tr_a
    FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM basic0)
    WINDOW w20 AS (PARTITION BY pair ORDER BY ts ROWS 19 PRECEDING), w6 AS (PARTITION BY pair ORDER BY ts ROWS 5 PRECEDING)))"""
