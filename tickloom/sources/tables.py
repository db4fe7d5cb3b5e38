"""Partitioned Parquet tables of ticks, bars, sequences and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TICK_KEY = ("pair", "ts", "source")
BAR_KEY = ("pair", "freq", "ts")


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table as it is, read with a known schema; None if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _by_day(df: DataFrame) -> DataFrame:
    """Rows of a (pair, day) together in few files; a day too big for one task is split."""
    return df.hint("rebalance", "pair", "date")


def _append(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append rows whose key is not stored yet; only the touched day partitions are read back."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in key]
    fresh = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*")
    fresh = fresh.select(*df.columns, F.to_date("ts").alias("date"))
    stored = _stored(spark, path, fresh.schema)
    if stored is not None:
        known = stored.join(fresh.select("pair", "date").distinct(), ["pair", "date"], "left_semi")
        fresh = fresh.join(known.select(*key), list(key), "left_anti")
    (_by_day(fresh).sortWithinPartitions("pair", "date", "ts")
          .write.mode("append").partitionBy("pair", "date").parquet(path))


def write_ticks(df: DataFrame, path: str) -> None:
    """Store ticks once per (pair, time, source); mid and spread are computed on write."""
    rows = df.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})
    _append(rows, path, TICK_KEY)


def write_bars(df: DataFrame, path: str, freq: str) -> None:
    _append(df.withColumn("freq", F.lit(freq)), path, BAR_KEY)


def convert_once(df: DataFrame, path: str) -> None:
    """Write the table unless it is there already."""
    _by_day(df.withColumn("date", F.to_date("ts"))).write.mode("ignore").partitionBy("pair", "date").parquet(path)


def replace_days(df: DataFrame, path: str) -> None:
    """Overwrite exactly the (pair, day) partitions present in the rows."""
    (_by_day(df.withColumn("date", F.to_date("ts"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("pair", "date").parquet(path))


def read_range(table: DataFrame, pair: str, start: str | None = None, end: str | None = None,
               limit: int | None = None, freq: str | None = None) -> DataFrame:
    """Rows of a pair inside [start, end], ascending; with ``limit`` only the last so many."""
    rows = table.where(F.col("pair") == pair)
    if freq is not None:
        rows = rows.where(F.col("freq") == freq)
    dated = "date" in table.columns
    for bound, op in ((start, ">="), (end, "<=")):
        if bound:
            rows = rows.where(f"ts {op} timestamp_ntz'{bound}'")
            if dated:
                rows = rows.where(f"date {op} date'{bound[:10]}'")
    rest = [c for c in rows.columns if c != "ts"]  # equal times have an order too
    if limit is not None:
        rows = rows.orderBy(F.col("ts").desc(), *[F.col(c).desc() for c in rest]).limit(limit)
    return rows.orderBy("ts", *rest)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], k: int) -> DataFrame:
    """First ``k`` rows per key by (column, ascending?) order, with their rank.

    Every task keeps its own best ``k`` first, so a hot key sends few rows.
    """
    from pyspark.sql import Window

    by = [F.col(c) if up else F.col(c).desc() for c, up in order]
    local = Window.partitionBy(*keys, "_task").orderBy(*by)
    near = df.withColumn("_task", F.spark_partition_id()).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)
    w = Window.partitionBy(*keys).orderBy(*by)
    return (near.drop("_task", "_r").withColumn("rank", F.row_number().over(w).cast("bigint"))
                .where(F.col("rank") <= k))


def latest(ticks: DataFrame) -> DataFrame:
    """Newest tick of every pair in one pass."""
    rest = [c for c in ticks.columns if c != "pair"]
    return ticks.groupBy("pair").agg(F.max_by(F.struct(*rest), F.struct("ts", *rest)).alias("_t")).select("pair", "_t.*")


def write_sequences(df: DataFrame, path: str) -> None:
    """Rows of (pair, ts, X, y) and a manifest of row counts per pair beside them."""
    df.write.mode("overwrite").partitionBy("pair").parquet(path)
    counts = df.sparkSession.read.parquet(path).groupBy("pair").agg(F.count(F.lit(1)).alias("rows"))
    counts.write.mode("overwrite").parquet(f"{path}_manifest")


def check_sequences(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Stored rows per pair against the manifest, with windows of a wrong length counted."""
    found = spark.read.parquet(path).groupBy("pair").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.size("X") != length).alias("wrong_length"),
        F.count_if(F.expr("y is null")).alias("missing_y"))
    both = spark.read.parquet(f"{path}_manifest").join(found, "pair", "full")
    ok = (F.col("rows") == F.col("found")) & (F.col("wrong_length") == 0) & (F.col("missing_y") == 0)
    return both.withColumn("ok", F.coalesce(ok, F.lit(False)))


def append_decisions(df: DataFrame, path: str) -> None:
    """Decision rows as JSON lines, one folder per day."""
    df.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").json(path)
