"""Queries on ticks, bars, quality, storage and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.core.series import Series, add
from tickloom.core.storage import fresh_path, landed
from tickloom.operators import asof, bars as B, features as W, quality as Q
from tickloom.plans import adapters as A
from tickloom.plans.registry import plain, query
from tickloom.sources import files, tables

TICK_SQL = "bid, ask, mid, spread, volume"


# --- bars -------------------------------------------------------------------------

@query("bars_hourly", f"WITH {A.BARS} SELECT * FROM bars", "pair, ts, n_ticks")
def bars_hourly(spark, sf):
    return A.bars(spark, sf)


@query("bars_15min", f"""WITH {A.TICKS} SELECT pair, time_bucket(INTERVAL '15 minutes', ts) AS ts,
    arg_min(mid, ts) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, ts) AS "close", sum(volume) AS volume,
    avg(spread) AS spread_avg, arg_max(bid, ts) AS bid_close, arg_max(ask, ts) AS ask_close, count(*) AS n_ticks
    FROM ticks GROUP BY 1, 2""", "pair, ts, n_ticks")
def bars_15min(spark, sf):
    return B.to_bars(A.ticks(spark, sf), "15 minutes", tie="tick_id")


# --- sources and sinks: derived files are written, then read through the loader ------

def _stored_csv(spark, sf, tag, columns, header, sep=","):
    path = f"{fresh_path(spark, tag)}.csv"
    A.ticks(spark, sf).select(*columns).write.csv(path, header=header, sep=sep)
    return path


@query("load_tick_file", f"""WITH {A.TICKS} SELECT pair, ts, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread, volume
    FROM ticks WHERE ask - bid > 0""", "pair, ts")
def load_tick_file(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    path = _stored_csv(spark, sf, "ticks", [stamp, "pair", "bid", "ask", "volume"], True)
    return files.load_ticks(spark, path).select("pair", "ts", *TICK_SQL.split(", "))


@query("load_tick_parquet", f"""WITH {A.TICKS} SELECT pair, ts, bid, ask, mid, ask - bid AS spread, volume FROM ticks
    WHERE ask - bid > 0""", "pair, ts")
def load_tick_parquet(spark, sf):
    path = f"{fresh_path(spark, 'ticks')}.parquet"
    A.ticks(spark, sf).select(F.col("ts").alias("timestamp"), "pair", "bid", "ask", "mid", "volume").write.parquet(path)
    return files.load_ticks(spark, path).select("pair", "ts", *TICK_SQL.split(", "))


EXPORT_SQL = f"""WITH {A.TICKS}, kept AS (
    SELECT *, date_trunc('milliseconds', ts) AS ms FROM ticks),
  firsts AS (SELECT pair, ms, min(tick_id) AS tick_id FROM kept GROUP BY pair, ms)
  SELECT k.pair, k.ms AS ts, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread, volume, 'export' AS source
  FROM kept k JOIN firsts f ON k.tick_id = f.tick_id AND k.pair = f.pair"""


@query("load_tick_exports", EXPORT_SQL, "pair, ts, source")
def load_tick_exports(spark, sf):
    """Semicolon exports with one clock column and comma exports with two, in pair folders, every row exported twice."""
    path = fresh_path(spark, "exports")
    t = A.ticks(spark, sf).withColumn("folder", F.col("pair"))
    one = t.select("folder", F.concat_ws(";", F.date_format("ts", "yyyyMMdd HH:mm:ss.SSS"), "bid", "ask", "volume").alias("value"))
    two = t.select("folder", F.concat_ws(",", F.date_format("ts", "yyyy.MM.dd"), F.date_format("ts", "HH:mm:ss.SSS"),
                                         "bid", "ask", "volume").alias("value"))
    for part in (one, two):
        part.repartition("folder").write.mode("append").partitionBy("folder").text(path)
    raw = files.load_tick_exports(spark, path).withColumn("pair", F.regexp_replace("pair", "^folder=", ""))
    return files.first_per_time(raw)


@query("load_bar_exports", f"""WITH {A.BARS} SELECT ts, bid_close AS bid, ask_close AS ask, (bid_close + ask_close) / 2 AS mid,
    ask_close - bid_close AS spread, volume, pair, 'bar_export' AS source FROM bars WHERE bid_close < ask_close""",
       "ts, pair, source")
def load_bar_exports(spark, sf):
    """Bars of every pair exported as bid/ask bar files, a folder for each pair, and read back at once."""
    path = fresh_path(spark, "bar-exports")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DateTime")
    sides = [F.col(c).alias(f"{s}{n}") for s, c in (("Bid", "bid_close"), ("Ask", "ask_close"))
             for n in ("Open", "High", "Low", "Close")]
    A.bars(spark, sf).select(stamp, *sides, F.col("volume").alias("Volume"), "pair").write.partitionBy("pair").csv(path, header=True)
    return files.load_bar_exports(spark, path)


@query("decode_hour_blobs", f"""WITH {A.TICKS} SELECT pair, date_trunc('milliseconds', ts) AS ts, round(bid * 100000) / 100000 AS bid, round(ask * 100000) / 100000 AS ask, volume
    FROM ticks""", "pair, ts")
def decode_hour_blobs(spark, sf):
    """Ticks packed into LZMA hour blobs batch by batch, then decoded."""
    import lzma

    import numpy as np
    import pandas as pd

    def pack(batches):
        kind = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("av", ">f4"), ("bv", ">f4")])
        for b in batches:
            out = []
            for (pair, hour), g in b.groupby(["pair", "hour"], sort=False):
                rec = np.zeros(len(g), dtype=kind)
                rec["ms"] = g["ms"]
                rec["ask"], rec["bid"] = np.rint(g["ask"] * 100000), np.rint(g["bid"] * 100000)
                rec["av"] = rec["bv"] = g["volume"]
                out.append((pair, hour, lzma.compress(rec.tobytes(), preset=0)))
            yield pd.DataFrame(out, columns=["pair", "hour", "content"])
    t = A.ticks(spark, sf).select("pair", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
                                  F.floor(F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(3600000000)) / 1000).alias("ms"),
                                  "bid", "ask", "volume")
    return files.decode_hours(t.mapInPandas(pack, "pair string, hour timestamp_ntz, content binary"))


@query("top_ticks", f"""WITH {A.TICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY spread DESC, tick_id) AS rank FROM ticks)
    SELECT pair, rank, tick_id, spread FROM r WHERE rank <= 10""", "pair, rank, tick_id")
def top_ticks(spark, sf):
    """Ten widest ticks per pair."""
    return tables.top_per_key(A.ticks(spark, sf).select("pair", "tick_id", "spread"), ["pair"], [("spread", False), ("tick_id", True)], 10)


@plain("hour_sets", f"""WITH {A.TICKS}, a AS (SELECT date_trunc('hour', ts) AS ts FROM ticks WHERE pair = 'click'), b AS (SELECT date_trunc('hour', ts) AS ts FROM ticks WHERE pair = 'view')
    SELECT 'both' AS part, ts FROM (SELECT ts FROM a INTERSECT SELECT ts FROM b) UNION ALL SELECT 'only_first', ts FROM (SELECT ts FROM a EXCEPT SELECT ts FROM b)
    UNION ALL SELECT 'either', ts FROM (SELECT ts FROM a UNION SELECT ts FROM b)""")
def hour_sets(spark, sf):
    """Hours two pairs share, hours only the first has, and hours either has."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    a, b = (A.ticks(spark, sf).where(F.col("pair") == p).select(hour) for p in ("click", "view"))
    parts = {"both": a.intersect(b), "only_first": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("part"), "ts")
        out = df if out is None else out.unionByName(df)
    return out


@query("pick_source", f"""WITH {A.TICKS}, s AS (
    SELECT pair, ts, bid, ask, 0 AS prio, 'deep' AS src FROM ticks WHERE spread > 0.0095::DOUBLE AND pair < 'purchase'
    UNION ALL SELECT pair, ts, bid, ask, 1, 'broad' FROM ticks)
  SELECT pair, ts, bid, ask, src FROM s JOIN (SELECT pair, min(prio) AS prio FROM s GROUP BY pair) USING (pair, prio)""",
       "pair, ts, src")
def pick_source(spark, sf):
    t = A.ticks(spark, sf).select("pair", "ts", "bid", "ask", "spread")
    deep = t.where("spread > 0.0095D and pair < 'purchase'").withColumn("src", F.lit("deep"))
    broad = t.withColumn("src", F.lit("broad"))
    return files.pick_source({"deep": deep, "broad": broad}).drop("spread")


@query("daily_panel", f"""WITH {A.ASSETS}, s AS (
    SELECT asset, 'first' AS provider, 1 AS prio, ts, value FROM assets WHERE asset <> 'VIX' UNION ALL
    SELECT asset, 'second', 2, ts, value * 2 FROM assets),
  b AS (SELECT s.* FROM s JOIN (SELECT asset, min(prio) AS prio FROM s GROUP BY asset) USING (asset, prio)),
  r AS (SELECT *, ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AS inside,
               bool_or(ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') OVER (PARTITION BY asset) AS any_in FROM b)
  SELECT asset, provider, ts, value FROM r WHERE inside OR NOT any_in""", "asset, provider, ts")
def daily_panel(spark, sf):
    """Cached daily files of two providers; the first one lacks an asset."""
    path = fresh_path(spark, "daily")
    a = A.assets(spark, sf)
    first = a.where("asset <> 'VIX'").withColumns({"provider": F.lit("first"), "prio": F.lit(1)})
    second = a.withColumns({"provider": F.lit("second"), "prio": F.lit(2), "value": F.col("value") * 2})
    first.unionByName(second).write.parquet(path)
    return files.daily_panel(spark.read.parquet(path), "2024-01-05", "2024-01-20")


@query("indicator_events", """SELECT o_orderdate AS ts, o_orderpriority AS event, o_totalprice AS actual, o_totalprice * 0.99::DOUBLE AS forecast,
    o_totalprice * 0.98::DOUBLE AS prior, 'High' AS impact FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1999-12-31'""",
       "ts, event, impact", 4)
def indicator_events(spark, sf):
    """Indicator documents built from orders, each with a readable item and two broken ones."""
    item = lambda d, v: F.struct(d.alias("date"), v.alias("value"))
    day, value = F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("%.2f", "o_totalprice")
    docs = A.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("event"),
        F.array(item(F.lit("no date"), value), item(day, value), item(day, F.lit("."))).alias("data"))
    return files.indicator_events(docs, "1996-01-01", "1999-12-31")


@query("store_ticks_once", f"WITH {A.TICKS} SELECT pair, ts, source, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread, volume FROM ticks",
       "pair, ts, source")
def store_ticks_once(spark, sf):
    """The same ticks inserted twice, the second time after a partial first load."""
    path = fresh_path(spark, "tick-table")
    t = A.ticks(spark, sf).select("pair", "ts", "bid", "ask", "volume", "source")
    tables.write_ticks(t.where("bid > 1.03"), path)
    tables.write_ticks(t, path)
    return spark.read.parquet(path).select("pair", "ts", "source", *TICK_SQL.split(", "))


@query("read_bar_range", f"""WITH {A.BARS} SELECT * FROM (SELECT pair, ts, open, high, low, "close", n_ticks FROM bars
    WHERE pair = 'view' AND ts BETWEEN '2024-01-03' AND '2024-01-25' ORDER BY ts DESC LIMIT 100)""", "pair, ts, n_ticks")
def read_bar_range(spark, sf):
    path = fresh_path(spark, "bar-table")
    tables.write_bars(A.bars(spark, sf), path, "1h")
    rows = tables.read_range(spark.read.parquet(path), "view", "2024-01-03 00:00:00", "2024-01-25 00:00:00", 100, "1h")
    return rows.select("pair", "ts", "open", "high", "low", "close", "n_ticks")


@query("latest_tick", f"""WITH {A.TICKS} SELECT pair, arg_max(bid, ts) AS bid, arg_max(ask, ts) AS ask, max(ts) AS ts
    FROM ticks GROUP BY pair""", "pair, ts")
def latest_tick(spark, sf):
    return tables.latest(A.ticks(spark, sf).select("pair", "ts", "bid", "ask"))


@query("convert_once", f"WITH {A.TICKS} SELECT pair, count(*) AS n, sum(bid) AS bids FROM ticks GROUP BY pair", "pair, n", 5)
def convert_once(spark, sf):
    path = fresh_path(spark, "converted")
    t = A.ticks(spark, sf).select("pair", "ts", "bid", "ask")
    tables.convert_once(t, path)
    tables.convert_once(t.withColumn("bid", F.lit(0.0)), path)
    return spark.read.parquet(path).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.sum("bid").alias("bids"))


@query("append_decisions", f"""WITH {A.BASIC} SELECT pair, ts, CASE WHEN ret_5 > 0 THEN 'BUY' ELSE 'SELL' END AS action, ret_5
    FROM basic WHERE ret_5 IS NOT NULL""", "pair, ts, action", 9)
def append_decisions(spark, sf):
    path = fresh_path(spark, "decisions")
    d = A.basic_features(spark, sf).df.where("ret_5 is not null").select(
        "pair", "ts", F.when(F.col("ret_5") > 0, "BUY").otherwise("SELL").alias("action"), "ret_5")
    tables.append_decisions(d, path)
    schema = "pair string, ts timestamp_ntz, action string, ret_5 double"
    return spark.read.schema(schema).json(path).drop("date")


# --- quality and filters ------------------------------------------------------------

@query("enforce_schema", f"""WITH {A.TICKS} SELECT ts, bid, ask - 0.002::DOUBLE AS ask, (bid + ask - 0.002::DOUBLE) / 2 AS mid,
    ask - 0.002::DOUBLE - bid AS spread, 1.0::DOUBLE AS volume, pair, 'feed' AS source FROM ticks WHERE bid < ask - 0.002::DOUBLE""",
       "ts, pair, source")
def enforce_schema(spark, sf):
    raw = A.ticks(spark, sf).select("ts", "pair", "bid", (F.col("ask") - F.lit(0.002)).alias("ask"))
    return Q.enforce_schema(raw, source="feed")


@plain("utc_times", """SELECT event_id, ts AS utc_ts, ts - INTERVAL '5 hours' AS from_fixed_zone FROM events""")
def utc_times(spark, sf):
    return A.table(spark, sf, "events").select(
        "event_id", Q.to_utc(F.col("ts")).cast("timestamp_ntz").alias("utc_ts"),
        Q.to_utc(F.col("ts").cast("timestamp"), "+05:00").cast("timestamp_ntz").alias("from_fixed_zone"))


@query("repair_spikes", f"""WITH {A.TICKS}, z AS (
    SELECT *, count(mid) OVER w AS n, avg(mid) OVER w AS m, stddev_samp(mid) OVER w AS s, median(mid) OVER w AS med FROM ticks
    WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 59 PRECEDING)),
  f AS (SELECT *, n = 60 AND abs(mid - m) / (s + 1e-9) > 4 AS bad FROM z)
  SELECT pair, ts, bad AS repaired, CASE WHEN bad THEN med ELSE mid END AS mid,
         CASE WHEN bad THEN med - (ask - bid) / 2 ELSE bid END AS bid,
         CASE WHEN bad THEN med + (ask - bid) / 2 ELSE ask END AS ask FROM f""", "pair, ts, repaired")
def repair_spikes(spark, sf):
    s = Series.of(A.ticks(spark, sf)).apply(Q.repair_spikes(4.0, 60))
    return s.df.select("pair", "ts", "repaired", "mid", "bid", "ask")


@query("standardise", f"WITH {A.TICKS} SELECT pair, ts, bid, ask, mid, ask - bid AS spread FROM ticks WHERE ask - bid > 0", "pair, ts")
def standardise(spark, sf):
    return Q.standardise(A.ticks(spark, sf)).select("pair", "ts", "bid", "ask", "mid", "spread")


@query("session_bars", f"""WITH {A.TICKS} SELECT pair, ts, mid, hour(ts) BETWEEN 7 AND 17 AS in_hours FROM ticks
    WHERE ts::TIME >= '07:00' AND date_trunc('second', ts)::TIME <= '21:00' AND isodow(ts) < 6""", "pair, ts, in_hours")
def session_bars(spark, sf):
    return A.ticks(spark, sf).where(Q.in_session(F.col("ts"))).select(
        "pair", "ts", "mid", Q.in_hours(F.col("ts")).alias("in_hours"))


@query("quality_report", f"""WITH {A.TICKS}, g AS (
    SELECT *, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY pair ORDER BY ts)) / 1e6 AS gap FROM ticks)
  SELECT pair, count(*) AS n_ticks, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(spread) / 0.0001::DOUBLE, 3) AS avg_spread_pips,
    round(min(spread) / 0.0001::DOUBLE, 3) AS min_spread_pips, round(max(spread) / 0.0001::DOUBLE, 3) AS max_spread_pips,
    round(avg(gap), 3) AS avg_gap_seconds, round(max(gap), 1) AS max_gap_seconds,
    count(*) FILTER (gap > 60) AS n_gaps_over_1min, count(*) FILTER (spread <= 0) AS n_spread_anomalies,
    count(*) FILTER (bid >= ask) AS n_bid_ask_inversions,
    round(100 * (1 - (count(*) FILTER (spread <= 0) + count(*) FILTER (bid >= ask)) / count(*)), 2) AS quality_score
  FROM g GROUP BY pair""", "pair, n_ticks, first_ts, last_ts, n_gaps_over_1min, n_spread_anomalies, n_bid_ask_inversions")
def quality_report(spark, sf):
    return Q.quality_report(Series.of(A.ticks(spark, sf)))


@query("chronological_split", f"""WITH {A.BARS} SELECT pair, ts, "close", CASE WHEN row_number() OVER (PARTITION BY pair ORDER BY ts)
    <= floor(count(*) OVER (PARTITION BY pair) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM bars""", "pair, ts, part")
def chronological_split(spark, sf):
    return Q.chronological_split(A.bar_series(spark, sf)).select("pair", "ts", "close", "part")


@query("hold_out", f"""WITH {A.BARS} SELECT pair, ts, "close", CASE WHEN ts BETWEEN '2024-01-20' AND '2024-01-25' THEN 'held_out' ELSE 'dev' END AS part
    FROM bars""", "pair, ts, part")
def hold_out(spark, sf):
    dev, held = Q.hold_out(A.bars(spark, sf), "2024-01-20", "2024-01-25")
    both = dev.withColumn("part", F.lit("dev")).unionByName(held.withColumn("part", F.lit("held_out")))
    return both.select("pair", "ts", "close", "part")


@plain("leak_report", f"""WITH {A.BARS} SELECT pair, count(*) FILTER (ts BETWEEN '2024-01-20' AND '2024-01-25') AS leaked_rows,
    count(*) FILTER (ts BETWEEN '2024-01-20' AND '2024-01-25') = 0 AS clean FROM bars GROUP BY pair""")
def leak_report(spark, sf):
    return Q.leak_report(A.bars(spark, sf), "2024-01-20", "2024-01-25")


@query("curriculum_filter", f"""WITH {A.BASIC}, m AS (SELECT avg(atr_6) AS m FROM basic)
    SELECT pair, ts, atr_6, phase FROM basic, m, (VALUES ('low_vol', 0.7::DOUBLE), ('normal_vol', 1.5), ('high_vol', 3.0)) p(phase, mult)
    WHERE abs(atr_6) <= mult * m UNION ALL SELECT pair, ts, atr_6, 'full' FROM basic""", "pair, ts, phase")
def curriculum_filter(spark, sf):
    f = landed(A.basic_features(spark, sf).df.select("pair", "ts", "atr_6"), "curriculum")
    return Q.curriculum_phases(f, "atr_6", f.agg(F.avg("atr_6")).scalar())


@plain("high_impact", """SELECT p_partkey, lower(p_name || ' ' || p_type) SIMILAR TO '.*(ring|gdp|promo|pmi|fed).*' AS high FROM part""")
def high_impact(spark, sf):
    words = ("Ring", "GDP", "PROMO", "PMI", "Fed")
    return A.table(spark, sf, "part").select(
        "p_partkey", Q.high_impact(F.concat_ws(" ", "p_name", "p_type"), words).alias("high"))


VOL = f"""WITH {A.BASIC}, v AS (SELECT pair, ts, atr_6, count(atr_6) OVER w AS n, avg(atr_6) OVER w AS m FROM basic
    WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 59 PRECEDING))"""


@query("vol_filters", VOL + """ SELECT pair, ts, CASE WHEN n = 60 AND atr_6 <= 3.0::DOUBLE * m THEN 1.0 ELSE 0.0 END::DOUBLE AS vol_ok,
    coalesce(n = 60 AND atr_6 > 2.0::DOUBLE * m, false) AS vol_spike FROM v""", "pair, ts, vol_spike")
def vol_filters(spark, sf):
    s = A.basic_features(spark, sf).apply(Q.vol_ok(), Q.vol_spike())
    return s.df.select("pair", "ts", "vol_ok", "vol_spike")


@plain("spike_routing", VOL + """ SELECT pair, CASE WHEN coalesce(n = 60 AND atr_6 > 2.0::DOUBLE * m, false) THEN 'fast' ELSE 'slow' END AS route,
    count(*) AS n FROM v GROUP BY 1, 2""")
def spike_routing(spark, sf):
    s = A.basic_features(spark, sf).apply(Q.vol_spike())
    route = F.when(F.col("vol_spike"), "fast").otherwise("slow").alias("route")
    return s.df.groupBy("pair", route).agg(F.count(F.lit(1)).alias("n"))


@plain("sentiment_gate", f"""WITH {A.BASIC}, s AS (SELECT pair, ts, ofi, CASE WHEN ret_5 > 0 THEN 0 WHEN ret_5 < 0 THEN 2 ELSE 1 END AS sig FROM basic)
    SELECT pair, ts, sig, CASE WHEN ofi > 0.3 AND sig = 2 THEN 1 WHEN ofi < -0.3 AND sig = 0 THEN 1 ELSE sig END AS gated FROM s""")
def sentiment_gate(spark, sf):
    f = A.basic_features(spark, sf).df.withColumn("sig", F.when(F.col("ret_5") > 0, 0).when(F.col("ret_5") < 0, 2).otherwise(1))
    return f.select("pair", "ts", "sig", Q.sentiment_gate(F.col("sig"), F.col("ofi")).alias("gated"))


@query("exposure_gate", f"""WITH {A.BASIC}, p AS (
    SELECT pair, ts, round(ofi * 2, 2) AS lots, CASE WHEN ret_5 > 0 THEN 0 WHEN ret_5 < 0 THEN 2 ELSE 1 END AS signal
    FROM basic WHERE ofi IS NOT NULL AND ret_5 IS NOT NULL),
  c AS (SELECT * FROM (SELECT x.pair AS a, y.pair AS b, round(corr(x.ret_5, y.ret_5), 6) AS corr FROM basic x JOIN basic y ON x.ts = y.ts AND x.pair < y.pair
          WHERE x.ret_5 IS NOT NULL AND y.ret_5 IS NOT NULL GROUP BY 1, 2) WHERE corr >= 0.01),
  cc AS (SELECT a, b, corr FROM c UNION ALL SELECT b, a, corr FROM c),
  e AS (SELECT p.pair, p.ts, p.lots, p.signal, abs(p.lots) + coalesce((
          SELECT sum(abs(o.lots) * cc.corr) FROM cc JOIN p o ON o.pair = cc.b AND o.ts = p.ts WHERE cc.a = p.pair
            AND sign(o.lots) = CASE p.signal WHEN 0 THEN 1 WHEN 2 THEN -1 END), 0) AS exposure FROM p)
  SELECT pair, ts, lots, CASE WHEN signal = 1 THEN abs(lots) ELSE exposure END AS exposure,
         CASE WHEN signal <> 1 AND exposure >= 1.5 THEN 1 ELSE signal END AS gated_signal FROM e""", "pair, ts, gated_signal")
def exposure_gate(spark, sf):
    """Correlations are those of the returns at hand; they are weak here, so the limit is low."""
    f = A.basic_features(spark, sf).df.where("ret_5 is not null")
    corr = Q.return_correlations(f, "ret_5").withColumn("corr", F.round("corr", 6))
    f = f.where("ofi is not null").select(
        "pair", "ts", F.round(F.col("ofi") * 2, 2).alias("lots"),
        F.when(F.col("ret_5") > 0, 0).when(F.col("ret_5") < 0, 2).otherwise(1).alias("signal"))
    return Q.exposure_gate(f, corr, min_corr=0.01).select("pair", "ts", "lots", "exposure", "gated_signal")


@query("fill_clean", f"""WITH {A.BASIC}, x AS (SELECT pair, ts, ofi, CASE WHEN "close" = open THEN NULL ELSE 1 / ("close" - open) END AS inv FROM basic)
    SELECT pair, ts, coalesce(last_value(ofi IGNORE NULLS) OVER w, 0) AS ofi, coalesce(last_value(inv IGNORE NULLS) OVER w, 0) / 1e6 AS inv FROM x
    WINDOW w AS (PARTITION BY pair ORDER BY ts)""", "pair, ts")
def fill_clean(spark, sf):
    move = F.col("close") - F.col("open")
    s = A.basic_features(spark, sf).map(lambda f: f.withColumn(
        "inv", F.when(move == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), move))))
    return s.apply(*Q.fill_clean(["ofi", "inv"])).df.select("pair", "ts", "ofi", (F.col("inv") / 1e6).alias("inv"))


@plain("load_summary", f"""WITH {A.TICKS}, r AS (SELECT DISTINCT pair FROM ticks UNION SELECT n_name FROM nation)
    SELECT r.pair, count(t.ts) AS ticks, min(ts) AS first_ts, max(ts) AS last_ts, count(t.ts) > 0 AS ts_usable
    FROM r LEFT JOIN ticks t ON t.pair = r.pair GROUP BY r.pair""")
def load_summary(spark, sf):
    t = A.ticks(spark, sf)
    asked = t.select("pair").distinct().union(A.table(spark, sf, "nation").select("n_name"))
    return Q.load_summary(t, asked)


# --- joins ----------------------------------------------------------------------------

@query("as_of_join", f"""WITH {A.BARS}, r AS (SELECT ts, pair, ask FROM ticks WHERE spread > 0.009::DOUBLE)
    SELECT b.pair, b.ts, b."close", r.ask AS wide_ask FROM bars b ASOF LEFT JOIN r ON b.pair = r.pair AND b.ts >= r.ts""", "pair, ts")
def as_of_join(spark, sf):
    right = A.ticks(spark, sf).where("spread > 0.009D").select("pair", "ts", F.col("ask").alias("wide_ask"))
    return asof.as_of(A.bars(spark, sf).select("pair", "ts", "close"), right, ["wide_ask"])


@query("as_of_join_backfilled", f"""WITH {A.BARS}, r AS (SELECT ts, pair, ask FROM ticks WHERE spread > 0.009::DOUBLE),
    f AS (SELECT pair, arg_min(ask, ts) AS head FROM r GROUP BY pair)
    SELECT b.pair, b.ts, coalesce(r.ask, head) AS wide_ask FROM bars b ASOF LEFT JOIN r ON b.pair = r.pair AND b.ts >= r.ts
    LEFT JOIN f ON f.pair = b.pair""", "pair, ts")
def as_of_join_backfilled(spark, sf):
    right = A.ticks(spark, sf).where("spread > 0.009D").select("pair", "ts", F.col("ask").alias("wide_ask"))
    return asof.as_of(A.bars(spark, sf).select("pair", "ts"), right, ["wide_ask"], backfill=True)


DIST = f"""WITH {A.BARS}, {A.RELEASES}, d AS (
    SELECT b.pair, b.ts, (epoch_us(n.ts) / 1e6 - epoch_us(b.ts) / 1e6) / 60 AS ahead, (epoch_us(b.ts) / 1e6 - epoch_us(p.ts) / 1e6) / 60 AS since,
           p.actual, p.forecast, p.prior
    FROM bars b ASOF LEFT JOIN releases n ON b.ts < n.ts ASOF LEFT JOIN releases p ON b.ts >= p.ts)"""


@query("event_distances", DIST + """ SELECT pair, ts, CASE WHEN ahead < 1440 THEN ahead ELSE 1440 END AS eco_minutes_to_next,
    CASE WHEN since < 1440 THEN since ELSE 1440 END AS eco_minutes_since_last,
    CASE WHEN abs(prior) > 1e-9 THEN least(greatest((actual - forecast) / abs(prior), -5), 5) ELSE 0 END AS eco_surprise_norm, coalesce(actual - forecast, 0) AS eco_surprise,
    CASE WHEN ahead <= 15 OR since <= 15 THEN 1.0 ELSE 0.0 END::DOUBLE AS eco_release_flag FROM d""", "pair, ts")
def event_distances(spark, sf):
    return asof.event_distances(A.bars(spark, sf).select("pair", "ts"), A.releases(spark, sf))


@query("blackout", f"""WITH {A.BARS}, {A.RELEASES} SELECT pair, ts, CASE WHEN EXISTS (SELECT 1 FROM releases r
    WHERE r.ts BETWEEN bars.ts - INTERVAL '15 minutes' AND bars.ts + INTERVAL '15 minutes') THEN 0.0 ELSE 1.0 END::DOUBLE AS news_ok FROM bars""", "pair, ts")
def blackout(spark, sf):
    return asof.blackout(A.bars(spark, sf).select("pair", "ts"), A.releases(spark, sf))


@query("fill_forward", f"""WITH {A.BARS}, j AS (SELECT b.pair, b.ts, r."close" AS big FROM bars b LEFT JOIN bars r ON r.pair = b.pair AND r.ts = b.ts AND r.n_ticks >= 4)
    SELECT pair, ts, last_value(big IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts) AS busy_close FROM j""", "pair, ts")
def fill_forward(spark, sf):
    b = A.bars(spark, sf)
    busy = b.where("n_ticks >= 4").select("pair", "ts", F.col("close").alias("busy_close"))
    return asof.fill_forward(b.select("pair", "ts"), busy, ["busy_close"])


@plain("delayed_signal", f"""WITH {A.BARS}, s AS (SELECT pair, ts, CASE WHEN "close" > open THEN 0 WHEN "close" < open THEN 2 ELSE 1 END AS sig,
      row_number() OVER (PARTITION BY pair ORDER BY ts) AS rn FROM bars)
    SELECT a.pair, a.ts, a.sig, b.sig AS executed FROM s a JOIN s b ON a.pair = b.pair AND b.rn = greatest(a.rn - 2, 1)""")
def delayed_signal(spark, sf):
    sig = F.when(F.col("close") > F.col("open"), 0).when(F.col("close") < F.col("open"), 2).otherwise(1)
    s = A.bar_series(spark, sf).map(lambda f: f.select("pair", "ts", *(["_rn"] if "_rn" in f.columns else []), sig.alias("sig")))
    return asof.delayed(s, "sig", 2).df
