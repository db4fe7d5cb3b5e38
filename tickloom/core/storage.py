"""Tables written between stages, in the folder the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only where the driver is the executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tickloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tickloom/{tag}-{uuid.uuid4().hex}"


def landed(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write once and read back: cuts lineage, survives lost executors, keeps column pruning."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-key totals back to the rows they came from; adaptive execution picks the join and splits hot keys."""
    return big.join(small, list(keys), how)
