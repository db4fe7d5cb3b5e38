"""Corpus pipeline: documents in, a clean and mixed training order out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet in the shared folder and
read again as the next one's docs. All but the last return the columns of documents. A stage begins by dropping the
tables that the stage before it worked with, unless its docs still read them.

Defined cases beyond those of the operators: of near copies the row with the smallest id stays, rows without an id come
last; of rows that repeat an id and text one stays; a document that loses all of its text to the span stage stays, empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, mixing, near_copies, run_index, toxicity
from tickloom.llm.common import drop, landed, paths_made, table
from tickloom.llm.queries import toxicity_model


_tables: list[str] = []


def staged(work: Callable) -> Callable:
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _tables, docs)
        with paths_made() as made:
            out = work(spark, docs, sf_dir)
        _tables[:] = made
        return out
    return stage


@staged
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3."""
    score = "toxicity_" + "_" * max(map(len, docs.columns))
    model = toxicity_model(spark, docs.select("doc_id", "text"), sf_dir)
    return toxicity.scored(docs, model, score).where(F.col(score) < 0.3).select(*docs.columns)


@staged
def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 and more over five-word shingles, the row with the smallest id.

    Candidates come from covering masks over fingerprints of the shingles, wider than those of op6's own contract.
    """
    return near_copies.without_near_copies(docs)


@staged
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that start earlier too."""
    cut = run_index.deduplicated(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


@staged
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, decontaminate.indexes(table(spark, sf_dir, "benchmark")))


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, in training order, with their words taken, copies and position."""
    return mixing.ordered(mixing.mix(mixing.sized(docs)).where("taken > 0"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_similar),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

# Scores of a trained model, reachability and byte spans are not for SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
