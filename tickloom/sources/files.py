"""File formats: tick and bar exports, hour blobs, daily series, indicators, run logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.core.storage import lookup
from tickloom.operators.quality import enforce_schema, standardise

TICK_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType()), T.StructField("pair", T.StringType()),
    T.StructField("bid", T.DoubleType()), T.StructField("ask", T.DoubleType()),
    T.StructField("mid", T.DoubleType()), T.StructField("spread", T.DoubleType()),
    T.StructField("volume", T.DoubleType()), T.StructField("source", T.StringType()),
])

# Price divisor of hour blobs by pair; every other pair uses DEFAULT_POINT.
POINTS = {"USDJPY": 1000, "EURJPY": 1000, "GBPJPY": 1000}
DEFAULT_POINT = 100000

# Column names of headerless bid/ask bar exports.
BAR_COLUMNS = ("dt", "bo", "bh", "bl", "bc", "ao", "ah", "al", "ac", "vol")

# Accepted clock formats of tick exports.
CLOCKS = ("yyyyMMdd HH:mm:ss[.SSSSSS][.SSS]", "yyyy.MM.dd HH:mm:ss[.SSSSSS][.SSS]",
          "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]")


def _clock(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(c)) for c in CLOCKS]).cast("timestamp_ntz")


def load_ticks(spark: SparkSession, path: str, pair: str | None = None, z: float = 8.0) -> DataFrame:
    """Tick file with timestamp, bid, ask and optionally mid, volume, pair; Parquet, CSV or TXT."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix in ("csv", "txt"):
        header = spark.read.text(path).head(1)
        names = [c.strip() for c in header[0][0].split(",")] if header else []
        kinds = {"timestamp": "timestamp_ntz", "pair": "string", "source": "string"}
        schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in names)
        df = spark.read.csv(path, header=True, schema=schema)
    else:
        raise ValueError(f"unsupported tick file format: {suffix}")
    df = df.withColumnRenamed("timestamp", "ts")
    if "pair" not in df.columns:
        df = df.withColumn("pair", F.lit(pair))
    return standardise(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), z)


def parse_tick_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Headerless export lines, ';' or ',' separated, with one clock column or a date and a time.

    The separator and the width are read per line, so files of both kinds mix. Lines with
    another width raise; lines with an unreadable clock are dropped.
    """
    parts = F.split(F.col(value), F.when(F.contains(F.col(value), F.lit(";")), ";").otherwise(","))
    n = F.size("_p")
    text = F.when(n == 4, F.get("_p", F.lit(0))).when(
        n == 5, F.concat_ws(" ", F.get("_p", F.lit(0)), F.get("_p", F.lit(1)))).otherwise(
        F.raise_error(F.concat(F.lit("unexpected tick line width: "), n.cast("string"))))
    at = lambda back: F.trim(F.get("_p", n - F.lit(back))).try_cast("double")
    return (lines.withColumn("_p", parts).withColumns({"ts": _clock(text), "bid": at(3), "ask": at(2), "volume": at(1)})
                 .drop("_p", value).where("ts is not null"))


def load_tick_exports(spark: SparkSession, path: str, source: str = "export", pair: str | None = None) -> DataFrame:
    """All export files of a folder; the pair is given or the name of the file's folder."""
    lines = spark.read.text(path, recursiveFileLookup=True)
    name = F.lit(pair) if pair else F.regexp_extract(F.col("_file"), r"([^/]+)/[^/]+$", 1)
    raw = parse_tick_lines(lines.withColumn("_file", F.col("_metadata.file_path"))
                                .withColumn("_at", F.monotonically_increasing_id()))
    ticks = raw.withColumn("pair", name)
    tagged = ticks.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.col("ask") - F.col("bid"))
    return tagged.withColumn("source", F.lit(source)).where("bid < ask").select(
        "ts", "bid", "ask", "mid", "spread", "volume", "pair", "source", "_file", "_at")


def first_per_time(ticks: DataFrame, start: str | None = None, end: str | None = None,
                   order: Sequence[str] = ("_file", "_at")) -> DataFrame:
    """Inclusive time range, then the first row of every (pair, time) in file order.

    Done by an aggregate with partial results, so many copies of one time never meet in one task.
    """
    if start:
        ticks = ticks.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        ticks = ticks.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    rest = [c for c in ticks.columns if c not in ("pair", "ts", *order)]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return ticks.groupBy("pair", "ts").agg(picked).select("pair", "ts", "_r.*")


def load_bar_exports(spark: SparkSession, path: str, pair: str | None = None, source: str = "bar_export") -> DataFrame:
    """Bid/ask bar CSV, with a header in any case or without one, as ticks at the bar close.

    Without a close, the middle of high and low stands in. A row with any missing value is dropped.
    Without ``pair`` the files of all pairs are read at once, each pair's in its folder ``pair=...``.
    """
    first = spark.read.text(path).head(1)[0][0].split(",")
    headed = not first[0].strip()[:1].isdigit()
    names = [c.strip().lower() for c in first] if headed else list(BAR_COLUMNS)
    schema = ", ".join(f"`{c}` {'string' if i == 0 else 'double'}" for i, c in enumerate(names))
    df = spark.read.csv(path, header=headed, schema=schema)
    find = lambda long, short: next((c for c in names if long in c or c == short), None)

    def price(side, s):
        close = find(f"{side}close", f"{s}c")
        if close:
            return F.col(close)
        return (F.col(find(f"{side}hi", f"{s}h")) + F.col(find(f"{side}lo", f"{s}l"))) / 2
    df = df.withColumn("ts", F.coalesce(_clock(F.col(names[0])), F.col(names[0]).try_cast("timestamp_ntz")))
    volume = find("volume", "vol")
    out = df.dropna(how="any").select(
        "ts", price("bid", "b").alias("bid"), price("ask", "a").alias("ask"),
        *([F.col(volume).alias("volume")] if volume else []), *([] if pair else [F.col("pair").cast("string").alias("pair")]))
    return enforce_schema(out, pair, source)


def decode_hours(blobs: DataFrame) -> DataFrame:
    """LZMA hour blobs (pair, hour, content) to ticks: 20-byte big-endian records.

    A blob is one hour of one pair; rows of blobs spread over tasks.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import lzma

        record = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("av", ">f4"), ("bv", ">f4")])
        for b in batches:
            for pair, hour, content in zip(b["pair"], b["hour"], b["content"]):
                raw = lzma.decompress(content) if content else b""
                t = np.frombuffer(raw, dtype=record, count=len(raw) // record.itemsize)
                point = POINTS.get(pair, DEFAULT_POINT)
                volume = (t["av"].astype("f8") + t["bv"].astype("f8")) / 2
                yield pd.DataFrame({
                    "pair": pair, "ts": pd.Timestamp(hour) + pd.to_timedelta(t["ms"].astype("i8"), unit="ms"),
                    "bid": t["bid"].astype("f8") / point, "ask": t["ask"].astype("f8") / point,
                    "volume": volume.round(2)})
    return blobs.select("pair", "hour", "content").mapInPandas(
        decode, "pair string, ts timestamp_ntz, bid double, ask double, volume double")


def load_hour_blobs(spark: SparkSession, path: str, source: str = "hour_blobs", suffix: str = "bi5") -> DataFrame:
    """Folder tree pair/yyyy/mm/dd/HHh_ticks.<suffix>, month counted from 00, as ticks."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", f"*.{suffix}").load(path))
    shape = rf"([A-Z]+)/(\d{{4}})/(\d{{2}})/(\d{{2}})/(\d{{2}})h_ticks\.{suffix}$"
    part = lambda i: F.regexp_extract("path", shape, i)
    hour = F.make_timestamp_ntz(part(2).cast("int"), part(3).cast("int") + 1, part(4).cast("int"),
                                part(5).cast("int"), F.lit(0), F.lit(0))
    blobs = files.select(part(1).alias("pair"), hour.alias("hour"), "content")
    return enforce_schema(decode_hours(blobs), source=source)


def preferred(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """Rows of the lowest-priority-number provider that has any, per key."""
    best = rows.groupBy(key).agg(F.min(priority).alias("_best"))
    return lookup(rows, best, [key]).where(F.col(priority) == F.col("_best")).drop("_best")


def pick_source(sources: dict[str, DataFrame], source: str = "auto") -> DataFrame:
    """A named source, or per pair the first of the listed sources that has rows."""
    if source != "auto":
        if source not in sources:
            raise ValueError(f"unknown source {source!r}; one of {sorted(sources)} or auto")
        return sources[source]
    stacked = None
    for i, df in enumerate(sources.values()):
        df = df.withColumn("_prio", F.lit(i))
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    return preferred(stacked, "pair", "_prio").drop("_prio")


def daily_panel(series: DataFrame, start: str, end: str) -> DataFrame:
    """(asset, provider, prio, ts, value) to one provider per asset, clipped to the range.

    An asset with nothing inside the range keeps its whole series.
    """
    inside = F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    whole = series.where("ts is not null and value is not null")
    best = whole.groupBy("asset").agg(F.min("prio").alias("_best"))
    hits = whole.groupBy("asset", "prio").agg(F.max(inside).alias("_any"))
    chosen = best.join(hits, (best["asset"] == hits["asset"]) & (best["_best"] == hits["prio"])).select(
        best["asset"], "_best", "_any")
    return (lookup(whole, chosen, ["asset"]).where((F.col("prio") == F.col("_best")) & (inside | ~F.col("_any")))
                 .select("asset", "provider", "ts", "value"))


def load_daily_series(spark: SparkSession, path: str, providers: Sequence[str] = ("stooq", "yahoo")) -> DataFrame:
    """Cached ``<asset>_<provider>_<symbol>.csv`` files with timestamp,value."""
    raw = spark.read.csv(path, header=True, schema="timestamp string, value string").withColumn(
        "_f", F.col("_metadata.file_name"))
    known = "|".join(providers)
    provider = F.regexp_extract("_f", rf"_({known})_", 1)
    prio = F.array_position(F.array(*[F.lit(p) for p in providers]), provider)
    return raw.select(F.regexp_extract("_f", rf"^(.*?)_(?:{known})_", 1).alias("asset"), provider.alias("provider"),
                      prio.alias("prio"), F.col("timestamp").try_cast("timestamp_ntz").alias("ts"),
                      F.col("value").try_cast("double").alias("value"))


def indicator_events(docs: DataFrame, start: str, end: str) -> DataFrame:
    """Indicator documents (event, data array of date/value) to event rows inside the range.

    Real forecast and prior values are taken when present, else 0.99 and 0.98 of the actual.
    """
    item = docs.select("event", F.explode("data").alias("d"))
    fields = item.schema["d"].dataType.names
    actual = F.col("d.value").try_cast("double")
    given = lambda name, share: (F.coalesce(F.col(f"d.{name}").try_cast("double"), actual * share)
                                 if name in fields else actual * share)
    rows = item.select(F.col("d.date").try_cast("timestamp_ntz").alias("ts"), "event", actual.alias("actual"),
                       given("forecast", 0.99).alias("forecast"), given("prior", 0.98).alias("prior"),
                       F.lit("High").alias("impact"))
    return rows.where(F.col("actual").isNotNull() & F.col("ts").between(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def load_indicators(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """``<event>.json`` files holding {"data": [{"date", "value"}]}; unreadable items are skipped."""
    schema = "data array<struct<date: string, value: string, forecast: string, prior: string>>"
    docs = spark.read.schema(schema).json(path, multiLine=True).withColumn(
        "event", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    return indicator_events(docs, start, end)


def fold_rows(logs: DataFrame) -> DataFrame:
    """(run, model, fold, best_metric, history) to epochs and best accuracy per fold."""
    acc = F.try_element_at("history", F.lit("dir_acc"))
    loss = F.try_element_at("history", F.lit("train_loss"))
    return logs.select("run", "model", "fold", "best_metric", F.coalesce(F.size(loss), F.lit(0)).alias("epochs"),
                       F.coalesce(F.array_max(acc), F.lit(0.0)).alias("best_acc"))


def load_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """``<run>_<model>_cv.json`` fold logs, one row per fold with its epochs and best accuracy."""
    schema = "fold int, best_metric double, history map<string, array<double>>"
    logs = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*_cv.json").withColumn(
        "_f", F.col("_metadata.file_name"))
    return fold_rows(logs.withColumns({"run": F.regexp_extract("_f", r"^(.*)_[^_]+_cv\.json$", 1),
                                       "model": F.regexp_extract("_f", r"([^_]+)_cv\.json$", 1)}))


def load_fold_configs(spark: SparkSession, path: str) -> DataFrame:
    """``<model>_fold<n>_config.json`` files, best checkpoint metric per model."""
    logs = spark.read.schema("best_val_sharpe_proxy double").json(
        path, multiLine=True, pathGlobFilter="*_fold*_config.json").withColumn("_f", F.col("_metadata.file_name"))
    return logs.groupBy(F.regexp_extract("_f", r"^(.*)_fold", 1).alias("model")).agg(
        F.count(F.lit(1)).alias("configs"), F.max("best_val_sharpe_proxy").alias("best_checkpoint"))
