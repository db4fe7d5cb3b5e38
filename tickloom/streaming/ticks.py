"""Tick and news topics, live bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.core.storage import fresh_path
from tickloom.operators.bars import bar_aggregates
from tickloom.sources import tables
from tickloom.streaming.guards import GuardStream

TICK_MESSAGE = "time timestamp, pair string, bid double, ask double, volume double"
NEWS_MESSAGE = "time timestamp, headline string, sentiment double, source string"


def topic(spark: SparkSession, servers: str, name: str, start: str = "latest") -> DataFrame:
    """Raw message text of a Kafka topic; needs the Kafka connector on the cluster."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
                 .option("subscribe", name).option("startingOffsets", start).load()
                 .select(F.col("value").cast("string").alias("value")))


def tick_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON tick messages to ticks; unreadable messages are dropped."""
    m = F.from_json(value, TICK_MESSAGE)
    return (raw.select(m.alias("m")).select(F.col("m.time").alias("ts"), "m.pair", "m.bid", "m.ask", "m.volume")
               .where("ts is not null and pair is not null and bid is not null and ask is not null"))


def news_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    m = F.from_json(value, NEWS_MESSAGE)
    return (raw.select(m.alias("m")).select(F.col("m.time").alias("ts"), "m.headline", "m.sentiment", "m.source")
               .where("ts is not null and headline is not null"))


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], batch: str | None = None) -> StreamingQuery:
    """Apply a function to every micro-batch; without an interval, what is available now is processed."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    w = w.trigger(processingTime=batch) if batch else w.trigger(availableNow=True)
    return w.start()


def store_ticks(stream: DataFrame, table: str, checkpoint: str, source: str = "topic", batch: str | None = None) -> StreamingQuery:
    """Write each micro-batch once per (pair, time, source); a replayed batch adds nothing."""
    def each(rows: DataFrame, _: int) -> None:
        stored = rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "pair", "bid", "ask", "volume",
                             F.lit(source).alias("source"))
        tables.write_ticks(stored, table)
    return run(stream, checkpoint, each, batch)


def store_news(stream: DataFrame, table: str, checkpoint: str, batch: str | None = None) -> StreamingQuery:
    w = stream.withColumn("date", F.to_date("ts")).writeStream.format("parquet").partitionBy("date").option(
        "path", table).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=batch) if batch else w.trigger(availableNow=True)).start()


def live_bars(ticks: DataFrame, freq: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """OHLCV bars of a tick stream by event time; a bar appears once no tick within ``late`` can change it."""
    timed = ticks.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})
    return (timed.withWatermark("ts", late).groupBy("pair", F.window("ts", freq).alias("w"))
                 .agg(*bar_aggregates(F.col("ts")))
                 .select("pair", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume",
                         "spread_avg", "bid_close", "ask_close", "n_ticks"))


def drain(stream: DataFrame | GuardStream, tag: str, closing: Callable[[], None] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now into a table of the shared folder and read it back.

    ``closing`` may add rows to the source after that, and the stream goes on from its checkpoint.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, tag)
    for more in (None, closing) if closing else (None,):
        if more:
            more()
        if isinstance(stream, GuardStream):
            _taken(stream, path)
            continue
        (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
               .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination())
    if isinstance(stream, GuardStream):
        return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")
    return spark.read.schema(stream.schema).parquet(path)


def _taken(stream: GuardStream, path: str) -> None:
    """Turns of a guard: one for each micro-batch that there is now, and one that lets go of what those have moved the watermark past."""
    spark = stream.sparkSession
    # The folder is there even if no row comes out.
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/out/none")
    last = []

    def each(rows: DataFrame, batch: int) -> None:
        stream.turn(rows, 2 * batch, f"{path}/turns", f"{path}/out")
        last.append(batch)
    run(stream.df, f"{path}/checkpoint", each).awaitTermination()
    if last:
        stream.turn(None, 2 * last[-1] + 1, f"{path}/turns", f"{path}/out")
