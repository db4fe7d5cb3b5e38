"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

Vectors are integers floor(factor * x). Candidates are range-sorted along the Hilbert curve through all dimensions
(`bits` bits of each component between the table's least and greatest), cut into blocks of up to `block` rows, and
written as Parquet: one row a block, with its ids, labels, matrix, and its zone map (least and greatest value of each
dimension, and its labels). Zone maps are read without the matrices, by column pruning.

An anchor has windows: score ranges of which it wants the k best rows, of its own label (positives) or of other labels
(negatives). Interval arithmetic over a zone map bounds the scores of an anchor against a block from both sides; a
block is read for those anchors only for which its bounds meet a window and its labels can serve. First each anchor
reads, for each page of zone maps, the one block of the best bound for each window; the k-th score found narrows the
window for all other blocks. Nothing is read in part or dropped, so results are exact.

Positives are the first `positives` rows of the anchor's label; the window of a positive with score p holds the scores s
with low * p <= 100 * s <= high * p.

Defined cases: rows without an id, a label, or a vector of finite components take no part; only vectors of equal length
are compared; rows that repeat id, label and vector are one; of rows that share an id but differ, each is an anchor and
a candidate, but none is a candidate of its own id; an anchor without positives or with nothing in its windows gives no
row; scores saturate at 64 bits; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import vectors as V
from tickloom.llm.common import landed
from tickloom.llm.topk import HIGH, LOW, products

PAGE, TILE = 256, 256  # zone maps of a page, anchors of a tile
HELD = 1 << 18  # rows found that a task holds before it passes them on


def quantized(rows: DataFrame, vec_id: str, vector: str, label: str, factor: int = 256) -> DataFrame:
    """(vec_id, label, dim, v) of the rows that take part."""
    x = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & V.whole(vector))
    v = F.transform(V.doubles(vector), lambda c: F.floor(c * factor).cast("double"))
    return x.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.size(vector).alias("dim"), v.alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of `bits`-bit cells, as rows of big-endian bytes.

    The rotations of the sub-cubes are undone from the coarsest bit down, the result is Gray-decoded over the axes, and
    the bits of all axes are interleaved, coarsest first.
    """
    rows, dim = cells.shape
    x = cells.T.astype(np.uint32)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for axis in range(dim):
            on = (x[axis] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, swap)
            x[axis] ^= swap
    for axis in range(1, dim):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(rows, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    plain = np.stack([(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)])  # level, axis, row
    return np.packbits(plain.reshape(bits * dim, rows).T.astype(np.uint8), axis=1)


ROWS = "vec_id long, label long, dim int, v array<double>, key binary"
BLOCKS = "dim int, n int, ids binary, labels binary, mat binary, lo binary, hi binary"


def blocks_of(rows: DataFrame, block: int, bits: int) -> DataFrame:
    """The rows as Parquet blocks along the curve."""
    ends = rows.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    low, wide = ends["lo"] or 0.0, max((ends["hi"] or 0.0) - (ends["lo"] or 0.0), 1e-300)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = batch.column("dim").to_numpy(), np.full(len(batch), b"", object)
            for dim in np.unique(dims[dims > 0]):
                own = np.flatnonzero(dims == dim)
                mat = V.matrix(batch.column("v").take(pa.array(own)), int(dim))
                cells = np.minimum((mat - low) / wide * (1 << bits), (1 << bits) - 1).astype(np.uint32)
                keys[own] = [k.tobytes() for k in hilbert_keys(cells, bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for dim, t in V.by_size(batches, block):
            ids, labels, mat = t.column("vec_id").to_numpy(), t.column("label").to_numpy(), V.matrix(V.one(t, "v"), dim)
            order = np.lexsort([labels, ids])
            ids, labels, mat = ids[order], labels[order], mat[order]
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "labels": [labels.tobytes()],
                "mat": [V.blob(mat)], "lo": [mat.min(axis=0).tobytes()], "hi": [mat.max(axis=0).tobytes()]})

    keyed = landed(rows.mapInArrow(key, ROWS), "hilbert-keys")
    # Equal rows meet in one range whatever their number: only the first of each stays. Different rows of one cell are spread by id.
    once = keyed.dropDuplicates(["vec_id", "label", "v"])
    parts = max(1, -(-keyed.count() // (8 * block)))
    sorted_rows = once.repartitionByRange(parts, "dim", "key", "vec_id").sortWithinPartitions("dim", "key", "vec_id")
    return landed(sorted_rows.mapInArrow(pack, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "hilbert-blocks")


def pages_of(blocks: DataFrame) -> DataFrame:
    """Zone maps, many to a row: (page, dim, blocks, lo, hi, and the (label, block) pairs in order)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, t in V.by_size(batches, PAGE):
            labels = [np.unique(np.frombuffer(x, np.int64)) for x in t.column("labels").to_pylist()]
            at, label = np.repeat(np.arange(len(labels)), [len(x) for x in labels]), np.concatenate(labels)
            order = np.lexsort([at, label])
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "blocks": [t.column("block").to_numpy().tobytes()], "lo": [b"".join(t.column("lo").to_pylist())],
                "hi": [b"".join(t.column("hi").to_pylist())], "of_label": [label[order].tobytes()], "of_block": [at[order].tobytes()]})

    zones = blocks.select("dim", "block", "labels", "lo", "hi").coalesce(8)
    return landed(zones.mapInArrow(pack, "dim int, blocks binary, lo binary, hi binary, of_label binary, of_block binary").withColumn("page", F.monotonically_increasing_id()), "zone-pages")


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor against any vector within each zone, rounded outwards."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    slack = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T * 2.0**-40
    return plus @ lo.T + minus @ hi.T - slack, plus @ hi.T + minus @ lo.T + slack


def served(labels: np.ndarray, of_label: np.ndarray, of_block: np.ndarray, n: int, same: bool) -> np.ndarray:
    """Whether each block holds a row of each anchor's label, or one of another label."""
    kinds = np.bincount(of_block, minlength=n)
    out = np.empty((len(labels), n), bool)
    for label in np.unique(labels):
        has = np.zeros(n, bool)
        has[of_block[np.searchsorted(of_label, label) : np.searchsorted(of_label, label, side="right")]] = True
        out[labels == label] = has if same else kinds > has
    return out


TILES = "dim int, aids binary, own binary, labels binary, mat binary, low binary, high binary"


def tiles_of(anchors: DataFrame) -> DataFrame:
    """Anchors (aid, vec_id, label, dim, v, low, high: arrays of windows) packed in the order of the curve."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, t in V.by_size(batches, TILE):
            n = len(t)
            width = max(len(x) for x in t.column("low").to_pylist())
            low, high = np.full((n, width), HIGH), np.full((n, width), LOW)  # what is not there is an empty window
            for i, (a, b) in enumerate(zip(t.column("low").to_pylist(), t.column("high").to_pylist(), strict=True)):
                low[i, : len(a)], high[i, : len(b)] = a, b
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "aids": [t.column("aid").to_numpy().tobytes()], "own": [t.column("vec_id").to_numpy().tobytes()],
                "labels": [t.column("label").to_numpy().tobytes()], "mat": [V.blob(V.matrix(V.one(t, "v"), dim))], "low": [low.tobytes()], "high": [high.tobytes()]})

    parts = max(1, -(-anchors.count() // (4 * TILE)))
    return landed(anchors.repartitionByRange(parts, "aid").sortWithinPartitions("aid").mapInArrow(pack, TILES), "anchor-tiles")


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def needs(tiles: DataFrame, pages: DataFrame, same: bool, seeds: bool) -> DataFrame:
    """(block and the anchors that must read it), by the bounds; with `seeds` only the best block of each page and window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim, blocks, own = r["dim"], _longs(r["blocks"]), _longs(r["own"])
                n, m = len(blocks), len(own)
                q, aids, labels = V.unblob(r["mat"], m, dim), _longs(r["aids"]), _longs(r["labels"])
                low, high = (_longs(r[c]).reshape(m, -1) for c in ("low", "high"))
                least, most = bounds(q, *(np.frombuffer(r[c]).reshape(n, dim) for c in ("lo", "hi")))
                serves = served(labels, _longs(r["of_label"]), _longs(r["of_block"]), n, same)
                wanted = np.zeros((m, n), bool)
                for a, b in zip(low.T[:, :, None], high.T[:, :, None], strict=True):
                    meets = serves & (most >= a) & (least <= b)
                    if seeds:
                        best = np.where(meets, np.minimum(most, b), -np.inf).argmax(axis=1)
                        meets &= np.arange(n)[None, :] == best[:, None]
                    wanted |= meets
                out = []
                for k in np.flatnonzero(wanted.any(axis=0)):
                    w = wanted[:, k]
                    out.append({"block": int(blocks[k]), "dim": dim, "aids": aids[w].tobytes(), "own": own[w].tobytes(), "labels": labels[w].tobytes(),
                                "mat": V.blob(q[w]), "low": low[w].tobytes(), "high": high[w].tobytes()})
                yield pa.RecordBatch.from_pylist(out, NEEDS)

    slots = max(1, pages.count())
    both = V.to_slots(tiles, slots).join(V.dealt(pages.select("dim", "page", "blocks", "lo", "hi", "of_label", "of_block"), "page", slots), ["dim", "slot"])
    return both.mapInArrow(run, f"block long, {TILES}")


NEEDS = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("aids", "own", "labels", "mat", "low", "high"))])
FOUND = pa.schema([("aid", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def read(wanted: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(aid, window, vec_id, score): the k best rows in each window, of each batch of blocks that a task reads."""
    def one_block(r: dict) -> pa.Table:
        dim, own, ids = r["dim"], _longs(r["own"]), _longs(r["c_ids"])
        q, c = V.unblob(r["mat"], len(own), dim), V.unblob(r["c_mat"], len(ids), dim)
        score = products(q, c)
        fits = (_longs(r["labels"])[:, None] == _longs(r["c_labels"])[None, :]) == same
        fits &= own[:, None] != ids[None, :]
        aids, parts = _longs(r["aids"]), []
        for w, (a, b) in enumerate(zip(_longs(r["low"]).reshape(len(own), -1).T, _longs(r["high"]).reshape(len(own), -1).T, strict=True)):
            in_window = fits & (score >= a[:, None]) & (score <= b[:, None])
            take = min(k, len(ids))
            edge = np.partition(np.where(in_window, score, LOW), len(ids) - take, axis=1)[:, len(ids) - take]
            at, row = np.nonzero(in_window & (score >= edge[:, None]))
            parts.append(pa.table([pa.array(aids[at]), pa.array(np.full(len(at), w), pa.int32()), pa.array(ids[row]), pa.array(score[at, row])], schema=FOUND))
        return V.best_rows(pa.concat_tables(parts).combine_chunks(), ["aid", "window"], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append(one_block(r))
                size += len(held[-1])
                if size >= HELD:
                    held = [V.best_rows(pa.concat_tables(held).combine_chunks(), ["aid", "window"], k)]
                    size = len(held[0])
                    if size >= HELD // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from V.best_rows(pa.concat_tables(held).combine_chunks(), ["aid", "window"], k).to_batches()

    content = blocks.select("block", F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("mat").alias("c_mat"))
    return wanted.join(content, "block").mapInArrow(run, "aid long, window int, vec_id long, score long")


def best(anchors: DataFrame, blocks: DataFrame, pages: DataFrame, same: bool, k: int) -> DataFrame:
    """(aid, window, rank, vec_id, score) of the k best rows in each window of each anchor, landed."""
    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("aid", "window").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = ranked(read(needs(tiles_of(anchors), pages, same, True), blocks, same, k)).where(F.col("rank") == k)
    kth = first.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    narrowed = anchors.join(kth, "aid", "left").withColumn("low", F.transform("low", lambda a, i: F.greatest(a, F.coalesce(F.col("kth")[i], a)))).drop("kth")
    return landed(ranked(read(needs(tiles_of(narrowed), pages, same, False), blocks, same, k)), "found")


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = 1024, bits: int = 4) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rows as `quantized` gives them.

    Anchors are the rows whose id is divisible by `every`.
    """
    blocks = blocks_of(rows, block, bits)
    pages = pages_of(blocks)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = _longs(r["ids"])
                own = np.flatnonzero(ids % every == 0)
                mat = V.unblob(r["mat"], len(ids), r["dim"])[own]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * r["dim"], pa.int32()), pa.array(mat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(_longs(r["labels"])[own]), pa.array(np.full(len(own), r["dim"]), pa.int32()), flat], ["vec_id", "label", "dim", "v"])

    anchors = blocks.select("dim", "ids", "labels", "mat").mapInArrow(unpack, "vec_id long, label long, dim int, v array<double>")
    anchors = landed(anchors.withColumn("aid", F.monotonically_increasing_id()), "anchors")
    all_scores = [F.array(F.lit(x)).alias(c) for c, x in (("low", LOW), ("high", HIGH))]
    near = best(anchors.select("*", *all_scores), blocks, pages, True, positives)

    rest = F.pmod("positive_score", F.lit(100))
    hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    near = near.select("aid", F.col("rank").alias("at"), F.col("vec_id").alias("positive_id"), F.greatest("score", F.lit(LOW + 100)).alias("positive_score"))
    near = near.withColumns({"low": hundreds * low + F.ceil(rest * low / 100), "high": hundreds * high + F.floor(rest * high / 100)})
    windows = near.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("w"))
    windows = anchors.join(windows, "aid").select("*", F.col("w.low").alias("low"), F.col("w.high").alias("high")).drop("w")
    found = best(landed(windows, "anchor-windows"), blocks, pages, False, negatives)
    found = found.select("aid", (F.col("window") + 1).alias("at"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("aid", "at", "positive_id", "positive_score").join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    return found.join(named, ["aid", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
