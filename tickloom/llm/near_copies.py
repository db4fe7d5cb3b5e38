"""Near copies: covering masks over wide fingerprints for candidates, exact Jaccard similarity for links.

A document is the set of its shingles' hashes; equal sets are one. Its fingerprint has 128 bits, each by majority over
the set, so that sets of similarity 0.8 differ in some 19 of them. The bits are cut into parts of `WIDTH` in `CUTS`
ways, and each part has the covering masks of `RADIUS`: two fingerprints that differ in `RADIUS` bits or fewer of some
part agree in all bits that one of its masks keeps, and meet in that bucket. Pairs at 4 * RADIUS + 3 bits or fewer meet
always; most beyond do (README: recall). Of those that meet, pairs within `CUTOFF` bits are candidates. Entries are
dealt in binary blocks of 16 bytes a fingerprint and mask, and a bucket passes on trees of candidates, not pairs.

Trees make groups. In each of `ROUNDS` rounds one set of a group, its pivot, is compared with the sets of the group that
are not linked to it; groups that the links make one are done. So a group of near copies costs one comparison for each
member, whatever its size. What is left is compared in tiles of up to 2 * `TILE` sets, each held by a task: sets outside a
tile's most frequent component look for partners within `CUTOFF` bits, and a tile passes on the links that join
components, so that no pairs are listed. Only groups of over `TILES` blocks list pairs, of sets that met in a bucket. Only
similarities of 0.8 and more, counted on whole texts, link.

Words are those of the fingerprints: A-Z lower-cased, cut at ASCII white space.

Defined cases: null and empty texts are the empty set and alike; fewer words than a shingle has are one shingle; the
least row of a component is the one with the smallest id, then the smallest set hash, then the first of equal rows; rows
without an id come last, so they name a component only if all of its rows lack one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import landed
from tickloom.llm.simhash import PIECE, _pieces, components, covering_masks, normalized, shingle_hashes

WIDTH, RADIUS, CUTS, CUTOFF = 32, 3, 2, 28
ROUNDS = 2
OVER, UNDER = 4, 5  # the similarity as a fraction, 0.8
FLUSH, SHARD_BYTES = 1 << 13, 1 << 23
SMALL = 4096  # sets of a group that are compared by their fingerprints all with all
TILE, TILE_SHINGLES = 2048, 1 << 21  # sets, and their shingles, of a block; two blocks make a tile
TILES = 64  # blocks of a group that meet all with all
NEAR = 16  # members of a bucket that are compared with the next ones all at once; larger buckets one by one


def sets(texts: Iterator[str | None], shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, hashed in chunks of a few megabytes."""
    parts: list[list[np.ndarray]] = []
    pending, owner, size = [], [], 0

    def hashed() -> None:
        if pending:
            h, begin = shingle_hashes(pending, shingle)
            for k, own in zip(owner, np.split(h, begin[1:]), strict=True):
                parts[k].append(np.unique(own))

    for text in texts:
        parts.append([])
        norm = normalized(text)
        for piece in _pieces(norm, shingle) if norm else ():
            pending.append(piece)
            owner.append(len(parts) - 1)
            size += len(piece)
            if size >= PIECE:
                hashed()
                pending, owner, size = [], [], 0
        if len(parts) >= 1000:
            hashed()
            yield from (np.unique(np.concatenate(p)) if len(p) != 1 else p[0] for p in (p or [np.empty(0, np.uint64)] for p in parts))
            parts, pending, owner, size = [], [], [], 0
    hashed()
    yield from (np.unique(np.concatenate(p)) if len(p) != 1 else p[0] for p in (p or [np.empty(0, np.uint64)] for p in parts))


def _set_hash(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word(h: np.ndarray) -> np.uint64:
    """The majority of each bit."""
    on = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) * 2 > len(h)
    return np.packbits(on).view(np.uint64)[0]


def fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return _word(s), _word(_mixed(s))


def _cut(w0: np.ndarray, w1: np.ndarray, cut: int) -> np.ndarray:
    """The 128 bits as four 32-bit parts: as they stand (cut 0), or every fourth bit (cut 1)."""
    if cut == 0:
        return np.stack([w0 >> np.uint64(32), w0 & np.uint64(0xFFFFFFFF), w1 >> np.uint64(32), w1 & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
    bits = np.unpackbits(np.column_stack([w0, w1]).view(np.uint8).reshape(len(w0), 16), axis=1)
    return np.stack([np.packbits(np.ascontiguousarray(bits[:, k::4]), axis=1).view(np.uint32).ravel() for k in range(4)])


MASKS = np.array(covering_masks(RADIUS, WIDTH), np.uint32)


def tables(w0: np.ndarray, w1: np.ndarray, masks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(table, key of each fingerprint in it)."""
    for cut in range(CUTS):
        for k, part in enumerate(_cut(w0, w1, cut)):
            for m, mask in enumerate(masks):
                yield (cut * 4 + k) * len(masks) + m, part & mask


def _distance(w0: np.ndarray, w1: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(w0[a] ^ w0[b]).astype(np.int64) + np.bitwise_count(w1[a] ^ w1[b])


def trees(key: np.ndarray, w0: np.ndarray, w1: np.ndarray, cutoff: int) -> np.ndarray:
    """For rows sorted by key, the first row of each row's tree of candidates within its key."""
    n = len(key)
    root = np.arange(n)
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.empty(0, np.int64)
    size = np.diff(np.r_[head, n])
    own = np.repeat(size <= NEAR, size)
    a, b = [], []
    for step in range(1, min(NEAR, n)):
        at = np.flatnonzero(own[: n - step] & (key[: n - step] == key[step:]))
        at = at[_distance(w0, w1, at, at + step) <= cutoff]
        a.append(at)
        b.append(at + step)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    while len(a):  # the least row reaches all of its tree
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    for h, m in zip(head[size > NEAR], size[size > NEAR], strict=True):
        left = np.arange(h, h + m)
        while len(left) > 1:
            first, left, queue = left[0], left[1:], [left[0]]
            while queue and len(left):
                near = _distance(w0, w1, left, np.full(len(left), queue.pop())) <= cutoff
                queue.extend(left[near])
                root[left[near]] = first
                left = left[~near]
    return root


DEALT = pa.schema([("shard", pa.int64()), ("tabled", pa.int32()), ("fps", pa.binary())])
MET = pa.schema([(c, pa.int64()) for c in ("bucket", "tree", "w0", "w1")])


def met(nodes: DataFrame, masks: np.ndarray, cutoff: int) -> DataFrame:
    """(bucket, tree, w0, w1): distinct fingerprints that met a candidate, in each bucket; landed."""
    shards = max(1, -(-nodes.count() * CUTS * 4 * len(masks) * 16 // SHARD_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            w0, w1 = (np.concatenate([h[k] for h in held]).view(np.uint64) for k in (0, 1))
            both = np.column_stack([w0, w1])
            for table, key in tables(w0, w1, masks):
                shard = (_mixed(key.astype(np.uint64) + np.uint64(table << 32)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), table), pa.int32()), pa.array([both[order[cuts[k] : cuts[k + 1]]].tobytes() for k in used], pa.binary())], schema=DEALT)

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += len(batch)
            if size >= FLUSH:
                yield from flushed()
                held, size = [], 0
        if held:
            yield from flushed()

    def meet(table: pa.Table) -> pa.Table:
        by: dict[int, list[bytes]] = {}
        for t, fps in zip(table.column("tabled").to_pylist(), table.column("fps").to_pylist(), strict=True):
            by.setdefault(t, []).append(fps)
        out = []
        for t, parts in by.items():
            both = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
            w0, w1 = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            part = _cut(w0, w1, t // (4 * len(masks)))[t // len(masks) % 4]
            key = part & masks[t % len(masks)]
            order = np.lexsort((w1, w0, key))
            key, w0, w1 = key[order], w0[order], w1[order]
            root = trees(key, w0, w1, cutoff)
            kept = np.bincount(root, minlength=len(root))[root] > 1
            bucket = key[kept].astype(np.int64) + (t << 32)
            out.append(pa.table([pa.array(bucket), pa.array(w0[root[kept]].view(np.int64)), pa.array(w0[kept].view(np.int64)), pa.array(w1[kept].view(np.int64))], schema=MET))
        return pa.concat_tables(out)

    dealt = nodes.mapInArrow(deal, "shard long, tabled int, fps binary")
    return landed(dealt.groupBy("shard").applyInArrow(meet, "bucket long, tree long, w0 long, w1 long"), "copy-buckets")


def _alike(both: int | np.ndarray, a: int, b: int | np.ndarray) -> bool | np.ndarray:
    return UNDER * both >= OVER * (a + b - both)


def _sizes_fit(a: Column, b: Column) -> Column:
    return UNDER * F.least(a, b) >= OVER * F.greatest(a, b)


def verified(pairs: DataFrame, shingle: int) -> DataFrame:
    """(a, b) of the pairs (a, b, ta, tb) whose texts are similar; equal `tb` that follow each other are hashed once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            own = sets((x.as_py() for x in batch.column(2)), shingle)
            for b, s, text in zip(batch.column(1).to_pylist(), own, batch.column(3), strict=True):
                if b != last:
                    last, held = b, next(sets(iter([text.as_py()]), shingle))
                keep.append(_alike(len(np.intersect1d(s, held, assume_unique=True)), len(s), len(held)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def linked(sids: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, masks: np.ndarray, cutoff: int) -> DataFrame:
    """(node, root): set hashes with the smallest one of their component; roots have no row.

    sids: (sid, n, w0, w1), each once; texts_of gives (sid, text) for a table of (sid, ...).
    """
    spark = sids.sparkSession
    buckets = met(sids.select("w0", "w1").distinct(), masks, cutoff)
    node = F.xxhash64("w0", "w1")
    edges = buckets.groupBy("bucket", "tree").agg(F.min(node).alias("low"), F.collect_set(node).alias("all")).select("low", F.explode("all").alias("a"))
    groups = components(contracted(edges.select("a", F.col("low").alias("b"))))
    own = sids.withColumn("node", node).join(groups.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = own.groupBy("label").count().where("count > 1").select("label")
    own = landed(own.join(several, "label"), "copy-groups")
    texts = landed(own.join(texts_of(own.select("sid")), "sid").select("sid", "label", "n", "text"), "copy-texts")
    links = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    left = landed(own.select("sid", "label", "n", F.col("sid").alias("root")), "copy-members")
    at = F.struct(F.xxhash64("sid"), "sid")
    done = spark.createDataFrame([], "sid long")
    for _ in range(ROUNDS):
        pivots = left.join(done, "sid", "left_anti").groupBy("label").agg(F.min(F.struct(at.alias("at"), "sid", "n", "root")).alias("p"))
        pivots = landed(pivots.select("label", F.col("p.sid").alias("b"), F.col("p.n").alias("nb"), F.col("p.root").alias("rb")), "copy-pivots")
        if not pivots.limit(1).count():
            break
        named = texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")).join(pivots, "b")
        members = left.select("sid", "label", "root").join(texts.drop("label"), "sid")
        pairs = members.join(named, "label").where((F.col("root") != F.col("rb")) & _sizes_fit(F.col("n"), F.col("nb")))
        found = verified(pairs.select(F.col("sid").alias("a"), "b", F.col("text").alias("ta"), "tb"), shingle)
        links = landed(links.union(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "copy-links")
        done = done.union(pivots.select(F.col("b").alias("sid")))
        roots = components(links)
        left = left.drop("root").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        open_groups = left.groupBy("label").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("label")
        left = landed(left.join(open_groups, "label"), "copy-members")
    sizes = left.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("n") / TILE_SHINGLES))
    sizes = landed(sizes.select("label", blocks.cast("int").alias("blocks")), "copy-sizes")
    if not sizes.limit(1).count():
        return roots
    links = links.union(joined(left.join(sizes.where(F.col("blocks") <= TILES), "label"), own, texts, shingle, cutoff))
    if (beyond := sizes.where(F.col("blocks") > TILES)).limit(1).count():
        pairs = landed(candidates(left.join(beyond.select("label"), "label"), own, buckets, cutoff), "copy-pairs")
        a, b = (texts.select(F.col("sid").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        links = links.union(verified(pairs.join(a, "a").join(b, "b"), shingle))
    return components(landed(links, "copy-links"))


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b) edges with the same components: each node and its neighbours b are tied to the least of those neighbours,
    so that the many trees of one group leave few different edges to the steps that follow."""
    by = edges.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("all"))
    ties = by.select(F.explode(F.array_union("all", F.array("a"))).alias("a"), F.col("least").alias("b"))
    return ties.where("a <> b").distinct()


def joined(left: DataFrame, own: DataFrame, texts: DataFrame, shingle: int, cutoff: int) -> DataFrame:
    """(a, b), a > b: links that join the components (root) of each group's sets, from tiles of two of its `blocks`."""
    rows = left.join(own.select("sid", "w0", "w1"), "sid").join(texts.select("sid", "text"), "sid")
    block, other = F.pmod(F.xxhash64("sid"), "blocks"), F.col("other")
    others = F.sequence(F.lit(0), F.greatest(F.col("blocks") - 2, F.lit(0)))  # a group of one block is one tile
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    other = F.when(other < F.col("block"), other).otherwise(other + 1)
    tiled = rows.select("label", F.least("block", other).alias("lo"), F.greatest("block", other).alias("hi"), "sid", "root", "w0", "w1", "text")

    def run(table: pa.Table) -> pa.Table:
        sid, root, w0, w1 = (table.column(c).to_numpy() for c in ("sid", "root", "w0", "w1"))
        own = list(sets((x.as_py() for x in table.column("text")), shingle))
        a, b = joins(root, w0.view(np.uint64), w1.view(np.uint64), own, cutoff)
        return pa.table([pa.array(np.maximum(sid[a], sid[b])), pa.array(np.minimum(sid[a], sid[b]))], ["a", "b"])

    return tiled.groupBy("label", "lo", "hi").applyInArrow(run, "a long, b long")


def joins(root: np.ndarray, w0: np.ndarray, w1: np.ndarray, own: list[np.ndarray], cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of similar sets within `cutoff` bits that make one component of all that such links connect, given those
    of equal `root`. A set that has come to the most frequent component need not look for partners any more."""
    _, comp, members = np.unique(root, return_inverse=True, return_counts=True)
    main = members.argmax()
    size = np.array([len(s) for s in own])
    begin = np.cumsum(size) - size
    kinds, value = np.unique(np.concatenate(own), return_inverse=True)
    held = np.zeros(len(kinds), bool)
    a, b = [], []
    for p in np.flatnonzero(comp != main):
        if comp[p] == main:
            continue
        far = np.bitwise_count(w0 ^ w0[p]).astype(np.int64) + np.bitwise_count(w1 ^ w1[p])
        fit = UNDER * np.minimum(size, size[p]) >= OVER * np.maximum(size, size[p])
        near = np.flatnonzero((comp != comp[p]) & (far <= cutoff) & fit & (size > 0))
        if not len(near):
            continue
        n = size[near]
        first = np.cumsum(n) - n
        mine = value[begin[p] : begin[p] + size[p]]
        held[mine] = True
        both = np.add.reduceat(held[value[np.repeat(begin[near] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        held[mine] = False
        alike = near[_alike(both, size[p], n)]
        reached, one = np.unique(comp[alike], return_index=True)
        a += [p] * len(one)
        b += alike[one].tolist()
        comp[np.isin(comp, np.r_[reached, comp[p]])] = main if main in reached else comp[p]
    return np.array(a, np.int64), np.array(b, np.int64)


def candidates(left: DataFrame, own: DataFrame, buckets: DataFrame, cutoff: int) -> DataFrame:
    """(a, b), a > b: sets within `cutoff` bits that are not linked yet: of a group of up to `SMALL` sets all, each pair
    once, of a larger one those that met in a bucket."""
    open_sets = left.join(own.select("sid", "w0", "w1"), "sid")
    sizes = open_sets.groupBy("label").agg(F.count("*").alias("size"))
    open_sets = landed(open_sets.join(sizes, "label").select("label", "size", "sid", "n", "root", "w0", "w1"), "copy-open")
    whole = F.xxhash64("w0", "w1")
    small = open_sets.where(F.col("size") <= SMALL).select(F.col("label").alias("bucket"), F.lit(0).cast("long").alias("tree"), "sid", "n", "root", "w0", "w1")
    large = open_sets.where(F.col("size") > SMALL).drop("label", "size")
    members = buckets.join(large, ["w0", "w1"]).select("bucket", "tree", "sid", "n", "root", "w0", "w1")
    members = members.union(large.select(whole, whole, "sid", "n", "root", "w0", "w1"))  # equal fingerprints
    mixed = members.groupBy("bucket", "tree").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket", "tree")
    members = landed(members.join(mixed, ["bucket", "tree"]), "copy-mixed")

    def pairs(rows: DataFrame) -> DataFrame:
        # Of two roots one is not the tree's most frequent: only rows outside of that one look for partners.
        main = rows.groupBy("bucket", "tree", "root").count().groupBy("bucket", "tree").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        rows = rows.join(main, ["bucket", "tree"])
        outside = rows.where("root <> main")
        others = rows.select("bucket", "tree", *(F.col(c).alias(f"o_{c}") for c in ("sid", "n", "root", "w0", "w1")))
        apart = F.bit_count(F.col("w0").bitwiseXOR(F.col("o_w0"))) + F.bit_count(F.col("w1").bitwiseXOR(F.col("o_w1")))
        once = (F.col("o_root") == F.col("main")) | (F.col("sid") > F.col("o_sid"))
        near = once & (F.col("root") != F.col("o_root")) & (apart <= cutoff) & _sizes_fit(F.col("n"), F.col("o_n"))
        return outside.join(others, ["bucket", "tree"]).where(near).select(F.greatest("sid", "o_sid").alias("a"), F.least("sid", "o_sid").alias("b"))

    return pairs(small).union(pairs(members)).distinct()


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                        masks: np.ndarray = MASKS, cutoff: int = CUTOFF) -> DataFrame:
    """The least row of each component, all columns as they are."""
    columns = docs.columns
    free = "_" * (1 + max(map(len, columns)))  # no column begins with this
    extra = [free + c for c in ("sid", "n", "w0", "w1")]
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in sets((x.as_py() for x in batch.column(at)), shingle):
                found.append((_set_hash(s), len(s), *(int(np.int64(w.view(np.int64))) for w in fingerprint(s))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.int64()) for k in range(4))], [*columns, *extra])

    hashed = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in extra)]))
    whole = landed(hashed.withColumn(free + "rid", F.monotonically_increasing_id()), "copy-documents")
    rows = whole.select(F.col(doc_id).alias("doc_id"), *(F.col(free + c).alias(c) for c in ("sid", "n", "w0", "w1", "rid")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sid", "rid")
    sids = landed(rows.groupBy("sid").agg(F.min("n").alias("n"), F.min("w0").alias("w0"), F.min("w1").alias("w1"), F.min("rid").alias("rid"), F.min(order).alias("first")), "copy-sets")

    def texts_of(asked: DataFrame) -> DataFrame:
        one = landed(sids.join(asked, "sid", "left_semi").select("sid", "rid"), "copy-asked")
        return whole.select(F.col(free + "rid").alias("rid"), F.col(text).alias("text")).join(one, "rid").select("sid", "text")

    roots = linked(sids.select("sid", "n", "w0", "w1"), texts_of, shingle, masks, cutoff)
    kept = sids.join(roots.withColumnRenamed("node", "sid"), "sid", "left").groupBy(F.coalesce("root", "sid")).agg(F.min("first").alias("first"))
    gone = landed(rows.select("rid").join(kept.select(F.col("first.rid").alias("rid")), "rid", "left_anti"), "copy-gone")
    return whole.join(gone.withColumnRenamed("rid", free + "rid"), free + "rid", "left_anti").select(*columns)
