"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tickloom-llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a session whose executors are in the driver's process may leave it unset; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


_gathering: list[list[str]] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is ever written to it twice."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _gathering:
        paths.append(path)
    return path


@contextlib.contextmanager
def paths_made() -> Iterator[list[str]]:
    """The stage paths that are given out inside the block."""
    paths: list[str] = []
    _gathering.append(paths)
    try:
        yield paths
    finally:
        _gathering.remove(paths)


def drop(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Delete stage tables, but for those that `keep` reads."""
    read = keep.inputFiles() if keep is not None and paths else []
    for path in paths:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in file for file in read):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that later work does not recompute it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key written as text, modulo `parts`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts
