"""Exact top-k search by tiled matrix products.

Vectors are turned into integers, packed into blocks of one length (`shard` rows of candidates, `tile` rows of
queries), and every query block meets every shard once. A tile is one matrix product; its k best entries per query
are selected inside it and, tree-wise, merged: first over the shards of a slot, then by ranks over the slots.

Products run in double precision where every partial sum stays below 2^53, else in exact integers.

Defined cases: null vectors, vectors with null or non-finite components and rows without an id take no part; only
vectors of equal length are compared; an empty vector scores 0; a query's own id is no candidate of its own, in any of
its rows; rows that repeat an id are candidates each, and a repeated query is one query per distinct vector; scores
beyond 64 bits saturate; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import landed

LOW, HIGH = -(2**63), 2**63 - 1
# Shards that may share a slot, and bytes of a block's vectors: a task holds one slot's shards while query blocks pass.
SLOT_SHARDS, BLOCK_BYTES = 32, 1 << 23


def quantized(vectors: DataFrame, vec_id: str, vector: str, factor: int = 256) -> DataFrame:
    """(vec_id, dim, v): floor(factor * x) of each component, rows that take no part left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c * factor).cast("double"))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), v.alias("v"))


def _packed(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Rows of one partition, packed by length into blocks of at most `rows`."""
    waiting: dict[int, list] = {}
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            ids, mat = part["vec_id"].to_numpy(), np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), dim)
            held = waiting.setdefault(dim, [])
            held.append((ids, mat))
            if sum(len(i) for i, _ in held) >= _block_rows(dim, rows):
                yield from _blocks(dim, held, _block_rows(dim, rows))
                waiting[dim] = []
    for dim, held in waiting.items():
        if held:
            yield from _blocks(dim, held, _block_rows(dim, rows))


def _block_rows(dim: int, rows: int) -> int:
    return max(1, min(rows, BLOCK_BYTES // (8 * max(1, dim))))


def _blocks(dim: int, held: list, rows: int) -> Iterator[pd.DataFrame]:
    ids, mat = np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
    order = np.argsort(ids, kind="stable")
    for at in range(0, len(ids), rows):
        take = order[at : at + rows]
        kind = np.float32 if np.abs(mat[take]).max(initial=0) < 2**24 else np.float64
        yield pd.DataFrame({"dim": [dim], "ids": [ids[take].tobytes()], "mat": [mat[take].astype(kind).tobytes()]})


def _unpacked(ids: bytes, mat: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(mat) == 4 * dim * len(own) else np.float64
    return own, np.frombuffer(mat, kind).reshape(len(own), dim).astype(np.float64)


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(block, dim, ids, mat): the vectors of each partition in binary blocks, ids rising inside a block."""
    blocks = vectors.mapInPandas(lambda it: _packed(it, rows), "dim int, ids binary, mat binary")
    return landed(blocks.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T as 64-bit integers, exact (saturating where a value needs more bits)."""
    bound = q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0)
    if bound < 2**53:
        return np.rint(q @ c.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    return np.array([[min(max(s, LOW), HIGH) for s in row] for row in exact], dtype=np.int64).reshape(len(q), len(c))


def selected(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of each row's k best, ties to the smaller id; `ids` rise, an own id is no candidate."""
    rows, n = scores.shape
    allowed = ids[None, :] != own[:, None]
    take = min(k, n)
    edge = np.partition(np.where(allowed, scores, LOW), n - take, axis=1)[:, n - take]
    r, c = np.nonzero(allowed & (scores >= edge[:, None]))
    s = scores[r, c]
    order = np.lexsort((c, -(s.astype(np.float64)), r)) if np.abs(s).max(initial=0) < 2**53 else np.array(sorted(range(len(s)), key=lambda i: (r[i], -int(s[i]), c[i])), dtype=np.int64)
    r, c, s = r[order], c[order], s[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < k
    return r[keep], ids[c[keep]], s[keep]


def _best(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    merged = pd.concat(parts).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return merged[merged.groupby("query_id").cumcount() < k]


def _tiles(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """One (query block, shard) product per row, k best each; the lists of a query block that meets shard after shard merge."""
    block, found = None, []
    for batch in batches:
        for now, dim, q_ids, q_mat, c_ids, c_mat in batch[["q_block", "dim", "q_ids", "q_mat", "ids", "mat"]].itertuples(index=False):
            if now != block and found:
                yield _best(found, k)
                found = []
            if now != block:
                block, (own, q) = now, _unpacked(q_ids, q_mat, dim)
            ids, c = _unpacked(c_ids, c_mat, dim)
            r, best, s = selected(products(q, c), ids, own, k)
            found.append(pd.DataFrame({"query_id": own[r], "vec_id": best, "score": s}))
            found = [_best(found, k)] if len(found) > 8 else found
    if found:
        yield _best(found, k)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, tile: int = 512, shard: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates; inputs as `quantized` gives them.

    Blocks, not rows, are paired: shards are dealt to slots (some for each core, up to 32 shards in one), each query
    block is repeated once per slot, and the two meet by slot and length. What is shuffled is the shards, once, and the
    queries times the number of slots. Both sides are sorted, never broadcast: the planner knows the size of the query
    blocks, not that they are repeated.
    """
    shards = packed(candidates, shard)
    n = shards.count()
    slots = max(1, min(n, max(3 * candidates.sparkSession.sparkContext.defaultParallelism, -(-n // SLOT_SHARDS))))
    shards = shards.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots).cast("long"))).drop("block")
    blocks = packed(queries.dropDuplicates(["vec_id", "v"]), tile)
    blocks = blocks.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    pairs = blocks.join(shards.hint("merge"), ["dim", "slot"])
    best = pairs.mapInPandas(lambda it: _tiles(it, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
