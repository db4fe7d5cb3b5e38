"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits by majority over the XXH64 values of a document's word shingles. Each bit position i gets a
nonzero vector phi(i) of r + 1 bits; table v keeps the positions with <phi(i), v> = 1 (mod 2). Any r positions leave a
nonzero v orthogonal to all of theirs, so a pair that differs in r bits or fewer agrees in all bits that table v keeps:
every pair within the radius collides in one of the 2^(r+1) - 1 tables.

Only distinct fingerprints are hashed; copies follow theirs. Inside a bucket no list of pairs is formed: a bucket of
up to `bucket` fingerprints gives the spanning forest of its links, from blocks of exact distances. A larger one is
linked through shared neighbours instead, by joins over all executors: with A the values one flip or less away from a
fingerprint and B those two flips away, in the bits that the table leaves free, any value in an A joins all
fingerprints that reach it, since 1 + 2 <= 3. That is exact for radius 3, and linear in the bucket.

Components come from alternating large-star and small-star steps, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle
has are one shingle; repeated rows give a row each; rows with a null id are members but never give a component its
name (null if all of its members have none); an empty table gives no rows; long texts are hashed piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import landed

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
PIECE = 1 << 21


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of buf[start:end] for each slice: array arithmetic per length below 32 bytes, the library beyond."""
    padded = buf + b"\0" * 8
    u64 = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    u32 = np.ndarray(len(buf) + 1, "<u4", padded, strides=(1,))
    u8 = np.frombuffer(padded, np.uint8)
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(lengths, 255).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(33))
    for n in range(32):
        rows = order[bounds[n] : bounds[n + 1]]
        if not len(rows):
            continue
        at, h = starts[rows], np.full(len(rows), np.uint64(SEED + n) + P5)
        for lane in range(n // 8):
            h ^= _rotl(u64[at + 8 * lane] * P2, 31) * P1
            h = _rotl(h, 27) * P1 + P4
        done = n // 8 * 8
        if n - done >= 4:
            h ^= u32[at + done].astype(np.uint64) * P1
            h = _rotl(h, 23) * P2 + P3
            done += 4
        for i in range(done, n):
            h ^= u8[at + i].astype(np.uint64) * P5
            h = _rotl(h, 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[rows] = h ^ (h >> np.uint64(32))
    for i in order[bounds[32] :]:
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]], SEED)
    return out


def normalized(text: str | None) -> bytes:
    """A-Z lower-cased, words joined by single spaces."""
    return BLANKS.sub(b" ", (text or "").encode().translate(LOWER)).strip(b" ")


def _pieces(norm: bytes, shingle: int) -> Iterator[bytes]:
    """A long text in word-aligned pieces that overlap by shingle - 1 words, so that each shingle is in one piece."""
    at = 0
    while len(norm) - at > PIECE:
        cut = norm.find(b" ", at + PIECE)
        if cut < 0:
            break
        after = cut
        for _ in range(shingle - 1):
            after = norm.find(b" ", after + 1) if after >= 0 else -1
        if after < 0:
            break
        yield norm[at:after]
        at = cut + 1
    yield norm[at:]


def shingle_hashes(pieces: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of the (nonempty) pieces, and where those of each piece begin."""
    buf = b" ".join(pieces)
    blanks = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(buf)]])
    words = np.array([p.count(b" ") + 1 for p in pieces])
    shingles = np.maximum(words - shingle + 1, 1)
    first = np.repeat(np.cumsum(words) - words, shingles)
    begin = np.cumsum(shingles) - shingles
    first += np.arange(len(first)) - np.repeat(begin, shingles)
    last = first + np.repeat(np.minimum(words, shingle) - 1, shingles)
    return xxh64(buf, starts[first], ends[last]), begin


def _bit_counts(pieces: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Set bits by position, and number of shingles, of each (nonempty) piece."""
    h, begin = shingle_hashes(pieces, shingle)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, begin, axis=0, dtype=np.int64), np.diff(np.r_[begin, len(h)])


def _fingerprints(texts: Iterator[str | None], shingle: int) -> Iterator[np.ndarray]:
    """Fingerprints of texts, in chunks of a few megabytes."""
    sums, totals, pending, owner, size = [], [], [], [], 0

    def counted() -> None:
        if pending:
            bits, n = _bit_counts(pending, shingle)
            for k, row, m in zip(owner, bits, n, strict=True):
                sums[k] += row
                totals[k] += m

    def closed() -> np.ndarray:
        if not sums:
            return np.empty(0, np.uint64)
        on = (2 * np.array(sums) > np.array(totals)[:, None]).astype(np.uint8)
        return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()

    for text in texts:
        sums.append(np.zeros(64, np.int64))
        totals.append(0)
        norm = normalized(text)
        for piece in _pieces(norm, shingle) if norm else ():
            pending.append(piece)
            owner.append(len(sums) - 1)
            size += len(piece)
            if size >= PIECE:
                counted()
                pending, owner, size = [], [], 0
        if len(sums) >= 1000:
            counted()
            yield closed()
            sums, totals, pending, owner, size = [], [], [], [], 0
    counted()
    yield closed()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit fingerprints, as signed longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            fps = np.concatenate(list(_fingerprints(texts, shingle)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """One mask per nonzero v; phi(i) runs through the nonzero vectors in turn."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (v & (1 + i % n)).bit_count() % 2) for v in range(1, n + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each linked group among the fingerprints, by breadth-first search."""
    left = np.unique(fps)
    a, b = [], []
    while len(left) > 1:
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                queue.extend(found)
                a.append(found)
                b.append(np.full(len(found), root))
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _through_neighbours(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Links of (t, fp) rows of large buckets, by the values that two fingerprints both reach (radius 3)."""
    def flips(mask: int) -> Column:
        free = [1 << i for i in range(64) if not mask >> i & 1]
        pairs = [x | y for x, y in combinations(free, 2)]
        return F.concat(F.array(*[F.struct(F.lit(_signed(f)).alias("flip"), F.lit(1).alias("one")) for f in (0, *free)]),
                        F.array(*[F.struct(F.lit(_signed(f)).alias("flip"), F.lit(0).alias("one")) for f in pairs]))

    spark = rows.sparkSession
    moves = spark.range(1)
    for t, mask in enumerate(masks):
        moves = moves.withColumn(f"m{t}", flips(mask))
    each = moves.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"m{t}").alias("m")) for t in range(len(masks))])).alias("x"))
    each = each.select("x.t", F.explode("x.m").alias("m")).select("t", "m.flip", "m.one")
    reached = rows.join(F.broadcast(each), "t").select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "one")
    met = reached.groupBy("z").agg(F.min("fp").alias("root"), F.max("fp").alias("top"), F.max("one").alias("one"))
    met = met.where((F.col("one") == 1) & (F.col("root") < F.col("top"))).select("z", "root")
    return reached.join(met, "z").where(F.col("fp") != F.col("root")).select(F.col("fp").alias("a"), F.col("root").alias("b")).distinct()


def links(fps: DataFrame, radius: int = 3, bucket: int = 4096) -> DataFrame:
    """(a, b) with a > b: links that connect exactly those distinct fingerprints (column fp) that the radius connects.

    A bucket beyond `bucket` members goes through shared neighbours, which is exact for radius 3 only.
    """
    if radius != 3:
        raise ValueError("the way for large buckets is exact for radius 3")
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("x"))
    keyed = keyed.select("fp", "x.t", "x.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    sizes = landed(sizes, "simhash-buckets")
    pairs = sizes.where((F.col("n") == 2) & _near(F.col("lo"), F.col("hi"), radius)).select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    members = keyed.join(sizes.where("n > 2").select("t", "key", "n"), ["t", "key"])
    grouped = members.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest(x.values.to_numpy(), radius) for x in batch.column(0)]
            a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = pairs.union(grouped.mapInArrow(run, "a long, b long"))
    if sizes.where(F.col("n") > bucket).limit(1).count():
        out = out.union(_through_neighbours(members.where(F.col("n") > bucket).select("t", "fp"), masks))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of (a, b) edges with the smallest node of its component; roots have no row."""
    edges = landed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        edges = landed(small.distinct(), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3,
                    bucket: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest id reachable over links."""
    rows = landed(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    firsts = landed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(firsts.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    named = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
