"""User functions over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def score_with(df: DataFrame, model_fn: Callable, columns: Sequence[str], out: str = "signal",
               out_type: str = "long") -> DataFrame:
    """Apply ``model_fn(matrix) -> vector`` to the columns, one Arrow batch at a time."""
    columns = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: model_fn(b[columns].to_numpy())})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out}` {out_type}")
