"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its `prefix` nearest pivots out of `pivots`. The index of a shard posts every
vector in the inverted file of each of those pivots, with the pivot's rank in its order. A query reads the files of its
own nearest pivots only: a vector that shares pivot p with it gains prefix - max(rank in one, rank in the other), and
the footrule distance of the two prefixes (an absent pivot has rank `prefix`) is prefix * (prefix + 1) less twice the
sum of what is gained. The share `rerank` of the shard (at least `least` vectors, and all that tie with the last of
them) with the smallest distances is reranked by the exact inner product; the best of all shards are merged.

Nearness is the inner product, which is no distance where lengths differ. Vectors therefore get one component more,
sqrt(M^2 - |x|^2) with M the greatest length, 0 for queries: all are of length M then, and the order of inner products
is the order of angles.

Pivots are a bounded sample of the rows: of each of `pivots` hash classes of ids the row with the least hash. All else
covers every row. Shards are pieces of the input's partitions; they are joined to blocks of queries once, and only
whole blocks are shuffled.

Defined cases: null and zero vectors, vectors with null or non-finite components and rows without an id take no part;
only vectors of equal length are compared; of rows that share an id each is a candidate, and the least vector is the
query; a query's own id is no candidate of its own, in any row; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import vectors as V
from tickloom.llm.common import landed


def rows_of(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, dim, v, norm) of the rows that take part."""
    x = vectors.where(F.col(vec_id).isNotNull() & V.whole(vector))
    x = x.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), V.doubles(vector).alias("v"))
    x = x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))
    return x.where("norm > 0")


def pivot_blocks(rows: DataFrame, pivots: int) -> DataFrame:
    """(dim, most, p_mat): one block of pivots for each length of vectors, and the greatest length."""
    keyed = rows.withColumn("h", F.xxhash64("vec_id", F.lit("pivot"))).withColumn("class", F.pmod("h", F.lit(pivots)))
    least = keyed.groupBy("dim", "class").agg(F.min("h").alias("h"), F.max("norm").alias("most"))
    most = least.groupBy("dim").agg(F.max("most").alias("most"))
    chosen = keyed.join(least.select("dim", "class", "h"), ["dim", "class", "h"], "left_semi")
    chosen = chosen.groupBy("dim", "class").agg(F.min("v").alias("v")).join(most, "dim")

    def run(table: pa.Table) -> pa.Table:
        dim, most = table.column("dim")[0].as_py(), table.column("most")[0].as_py()
        table = table.sort_by("class")
        return pa.table({"dim": pa.array([dim], pa.int32()), "most": [most], "p_mat": pa.array([V.matrix(V.one(table, "v"), dim).tobytes()], pa.binary())})

    return chosen.groupBy("dim").applyInArrow(run, "dim int, most double, p_mat binary")


def orders(mat: np.ndarray, pivots: np.ndarray, most: float, prefix: int, query: bool) -> np.ndarray:
    """Each row's nearest pivots, nearest first."""
    def extra(m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(most * most - (m * m).sum(axis=1), 0.0))

    near = mat @ pivots.T
    if not query:
        near += extra(mat)[:, None] * extra(pivots)[None, :]
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class Posted:
    """Pivot inverted files of one shard, each in the order of ranks."""

    def __init__(self, prefix: int, row: np.ndarray, rank: np.ndarray, cuts: np.ndarray):
        self.prefix, self.row, self.most, self.cuts = prefix, row.astype(np.int64), (prefix - rank).astype(np.int32), cuts

    @staticmethod
    def files(order: np.ndarray, pivots: int) -> dict:
        """The posted rows and ranks, and where each pivot's file begins."""
        rows, prefix = order.shape
        pivot, rank = order.ravel().astype(np.int64), np.tile(np.arange(prefix), rows)
        by = np.argsort(pivot * prefix + rank, kind="stable")
        return {"prefix": pa.array([prefix], pa.int32()), "row": [(by // prefix).astype(np.uint32).tobytes()], "rank": [(by % prefix).astype(np.uint16).tobytes()],
                "cuts": [np.searchsorted(pivot[by], np.arange(pivots + 1)).tobytes()]}

    @classmethod
    def read(cls, r: dict) -> Posted:
        return cls(r["prefix"], *(np.frombuffer(r[c], kind) for c, kind in (("row", np.uint32), ("rank", np.uint16), ("cuts", np.int64))))

    def shared(self, query: np.ndarray, rows: int) -> np.ndarray:
        """What each row gains from the pivots that it shares with a query."""
        gain = np.zeros(rows, np.int32)
        for at, pivot in enumerate(query):
            a, b = self.cuts[pivot], self.cuts[pivot + 1]
            gain[self.row[a:b]] += np.minimum(self.most[a:b], self.prefix - at)  # a file holds a row once
        return gain


INDEX = "shard long, dim int, ids binary, mat binary, prefix int, row binary, rank binary, cuts binary"


def index(rows: DataFrame, pivots: DataFrame, prefix: int, shard: int) -> DataFrame:
    """The shards with their posted orders, written to the shared folder."""
    n = rows.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, t in V.by_size(batches, shard):
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [t.column("vec_id").to_numpy().tobytes()], "mat": [V.blob(V.matrix(V.one(t, "v"), dim))]})

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = np.frombuffer(r["p_mat"]).reshape(-1, r["dim"])
                mat = V.unblob(r["mat"], len(r["ids"]) // 8, r["dim"])
                files = Posted.files(orders(mat, p, r["most"], prefix, False), len(p))
                yield pa.RecordBatch.from_pydict({"shard": [r["shard"]], "dim": pa.array([r["dim"]], pa.int32()), "ids": [r["ids"]], "mat": [r["mat"]], **files})

    packed = rows.select("vec_id", "dim", "v").coalesce(max(1, -(-n // shard))).mapInArrow(pack, "dim int, ids binary, mat binary")
    packed = landed(packed.withColumn("shard", F.monotonically_increasing_id()), "vector-shards")
    return landed(packed.join(pivots, "dim").mapInArrow(post, INDEX), "pivot-files")


def nearest(ids: np.ndarray, mat: np.ndarray, posted: Posted, own: int, q: np.ndarray, order: np.ndarray, k: int, rerank: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows of one shard among those that the footrule distance ranks first."""
    rows = len(ids)
    gain = posted.shared(order, rows)
    take = min(rows, max(least, int(np.ceil(rerank * rows))))
    edge = np.partition(gain, rows - take)[rows - take]
    chosen = np.flatnonzero((gain >= edge) & (ids != own))
    score = (mat[chosen] * q).sum(axis=1)  # row by row in one order, so that equal vectors have equal scores
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        chosen, score = chosen[score >= kth], score[score >= kth]
    best = np.lexsort((ids[chosen], -score))[:k]
    return ids[chosen[best]], score[best]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = 256,
           prefix: int = 64, rerank: float = 0.2, least: int = 512, shard: int = 8192, tile: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, the k nearest candidates that the index finds."""
    rows = landed(rows_of(candidates, vec_id, vector), "index-vectors")
    pivot = landed(pivot_blocks(rows, pivots), "pivots")
    shards = index(rows, pivot, prefix, shard)
    slots = max(1, shards.count())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, t in V.by_size(batches, tile):
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "q_ids": [t.column("vec_id").to_numpy().tobytes()], "q_mat": [V.blob(V.matrix(V.one(t, "v"), dim))]})

    asked = rows_of(queries, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    tiles = asked.mapInArrow(pack, "dim int, q_ids binary, q_mat binary").join(pivot, "dim")
    pairs = V.to_slots(landed(tiles, "query-blocks"), slots).join(V.dealt(shards, "shard", slots), ["dim", "slot"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                dim, ids, own = r["dim"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                p = np.frombuffer(r["p_mat"]).reshape(-1, dim)
                mat, q = V.unblob(r["mat"], len(ids), dim), V.unblob(r["q_mat"], len(own), dim)
                posted = Posted.read(r)
                for i, order in enumerate(orders(q, p, r["most"], prefix, True)):
                    found, score = nearest(ids, mat, posted, own[i], q[i], order, k, rerank, least)
                    out.append(pa.table([pa.array(np.full(len(found), own[i])), pa.array(found), pa.array(score)], schema=FOUND))
            if out:
                yield from V.best_rows(pa.concat_tables(out).combine_chunks(), ["query_id"], k).to_batches()

    best = pairs.mapInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
