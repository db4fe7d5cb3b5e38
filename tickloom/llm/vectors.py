"""Rows of vectors as binary blocks, for operators that work on matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: str) -> Column:
    return F.transform(F.col(vector), lambda c: c.cast("double"))


def whole(vector: str) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    finite = F.forall(doubles(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def blob(mat: np.ndarray) -> bytes:
    """Single precision where that is exact, else double."""
    small = mat.astype(np.float32)
    return (small if (small == mat).all() else mat).tobytes()


def unblob(data: bytes, rows: int, dim: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * rows * dim else np.float64
    return np.frombuffer(data, kind).reshape(rows, dim).astype(np.float64)


def by_size(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Table]]:
    """(dim, rows) of one partition in its order, cut by the column `dim` into tables of at most `rows`."""
    held: dict[int, list[pa.RecordBatch]] = {}
    count: dict[int, int] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            own = batch.filter(pa.array(dims == dim)) if len(np.unique(dims)) > 1 else batch
            while len(own):
                take = own.slice(0, rows - count.get(dim, 0))
                held.setdefault(dim, []).append(take)
                count[dim] = count.get(dim, 0) + len(take)
                own = own.slice(len(take))
                if count[dim] == rows:
                    yield int(dim), pa.Table.from_batches(held.pop(dim))
                    count.pop(dim)
        if sum(count.values()) >= 4 * rows:  # many lengths
            for dim in [*held]:
                yield int(dim), pa.Table.from_batches(held.pop(dim))
            count.clear()
    for dim, parts in held.items():
        yield int(dim), pa.Table.from_batches(parts)


def one(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    return table.column(name).combine_chunks()


def to_slots(df: DataFrame, slots: int) -> DataFrame:
    """Every row once for each slot."""
    return df.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))


def dealt(df: DataFrame, key: str, slots: int) -> DataFrame:
    return df.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)))


def best_rows(rows: pa.Table, group: list[str], k: int) -> pa.Table:
    """The k highest scores of each group, ties to the smaller vec_id."""
    keys = [rows.column(c).to_numpy() for c in group]
    score, ids = rows.column("score").to_numpy(), rows.column("vec_id").to_numpy()
    # Integer scores are turned round without a sign: the least 64-bit number has no opposite.
    order = np.lexsort([ids, ~score if score.dtype == np.int64 else -score, *keys[::-1]])
    if not len(order):
        return rows
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    head = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
    return rows.take(pa.array(order[place < k]))
