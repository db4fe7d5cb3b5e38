"""Ranked lexical search, term at a time with a limited number of accumulators.

Documents are read once and become blocks: for each document its length and those of its terms that may occur in the
query set, with their counts. What may occur is told by a bitmap of hashed query terms, `BITS` bits whatever the
number of queries; it only spares room, since terms meet the queries by their text. Document frequencies, the number
of documents and of terms are sums over all blocks.

A block of documents meets each block of queries once. There the terms of a query are worked off rarest first. A
document's partial score is its accumulator; as long as the greatest scores that the remaining terms can give add up
to at least the k-th best partial score, a document may still get an accumulator. From then on no new one is made, and
the remaining terms only update those that there are, so their scores are exact. No other document can reach the k-th.

Scores are integers: w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 100 - b + (b n N) div L, and a term scores
w * ((10^9 tf) div (1000 tf + 8 m)); b is 90, N counts documents with a term, L all of their terms, n one document's.

Defined cases: null and empty texts, and texts without a term, have no term and are not counted; each row is a document
of its own, one without an id is last among equals; items that repeat id and text are one, items that share an id but
differ are told apart by their text and are all returned; an item without a term, or whose terms no document holds, and
scores of 0 give no row; empty tables give no rows. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import vectors as V
from tickloom.llm.common import landed

# Digits, letters and all bytes beyond ASCII make terms; A-Z are lower-cased.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BITS = 1 << 23
DOCS, POSTINGS = 8192, 1 << 20  # a block of documents ends with either
QUERY_TERMS = 1 << 16  # terms of a block of queries, about
ZERO = np.int64(0)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM).split()


def items_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, terms): the distinct terms of each item, landed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).dropDuplicates(["item_id", "text"])
    rows = rows.mapInArrow(run, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)
    return landed(rows.withColumn("item", F.monotonically_increasing_id()), "queries")


def bitmap(vocabulary: DataFrame) -> np.ndarray:
    """Which hashes the terms have: BITS bits, gathered in pieces of 4 KB each."""
    piece = vocabulary.select((F.crc32("term") % BITS).alias("h")).selectExpr("h div 32768 AS piece", "h % 32768 AS at")
    out = np.zeros(BITS, bool)
    for r in piece.groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        out[r["piece"] << 15 : r["piece"] + 1 << 15] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").astype(bool)
    return out


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def doc_blocks(docs: DataFrame, bits: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(block, docs, length, content): content holds (doc_id, n, terms, counts) of each document as an Arrow stream; landed."""
    packed = np.packbits(bits, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").tobytes()
        ids, n, ends, found, counts = [], [], [0], [], []

        def closed() -> pa.RecordBatch:
            lists = pa.array(ends, pa.int32())
            batch = pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "terms": pa.ListArray.from_arrays(lists, pa.array(found, pa.binary())),
                "counts": pa.ListArray.from_arrays(lists, pa.array(counts, pa.int64()))})
            out = pa.RecordBatch.from_pydict({"docs": [len(ids)], "length": [sum(n)], "content": pa.array([_ipc(batch)], pa.binary())})
            for x in (ids, n, found, counts):
                x.clear()
            ends[:] = [0]
            return out

        for batch in batches:
            for i, t in zip(*batch.columns, strict=True):
                words = terms(t.as_py())
                if not words:
                    continue
                ids.append(i.as_py())
                n.append(len(words))
                for word, count in Counter(words).items():
                    if known[zlib.crc32(word) % BITS]:
                        found.append(word)
                        counts.append(count)
                ends.append(len(found))
                if len(ids) >= DOCS or len(found) >= POSTINGS:
                    yield closed()
        if ids:
            yield closed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(run, "docs long, length long, content binary")
    return landed(rows.withColumn("block", F.monotonically_increasing_id()), "document-blocks")


def frequencies(blocks: DataFrame) -> DataFrame:
    """(term, df), summed up in every block first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                counted = pc.value_counts(_read(content.as_py()).column("terms").flatten())
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["term", "df"])

    return blocks.select("content").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_blocks(items: DataFrame, weighted: DataFrame, n_terms: int) -> DataFrame:
    """(q_block, queries): queries holds (item, terms, weights), rarest term first, as an Arrow stream; landed."""
    rows = items.select("item", F.explode("terms").alias("term")).join(weighted, "term").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "term"))).alias("t"))
    rows = rows.withColumn("q_block", F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n_terms // QUERY_TERMS)))))

    def pack(table: pa.Table) -> pa.Table:
        lists = V.one(table, "t")
        flat = lists.flatten()
        batch = pa.RecordBatch.from_pydict({
            "item": V.one(table, "item"), "terms": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())], pa.int32()), flat.field("term")),
            "weights": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())], pa.int32()), pc.negate(flat.field("w")))})
        return pa.table({"q_block": V.one(table, "q_block").slice(0, 1), "queries": pa.array([_ipc(batch)], pa.binary())})

    return landed(rows.select("q_block", "item", "t").groupBy("q_block").applyInArrow(pack, "q_block long, queries binary"), "query-blocks")


def ranked_terms(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that may be among the k best, from the (documents, scores) lists of terms, rarest first.

    Every score is above 0. Documents that tie with the k-th keep their accumulators.
    """
    rest = np.r_[np.cumsum([s.max(initial=ZERO) for _, s in lists][::-1])[::-1], 0] if lists else np.zeros(1, np.int64)
    score = np.zeros(docs, np.int64)
    limited = False
    for at, (doc, gain) in enumerate(lists):
        if not limited:
            partial = score[score > 0]
            limited = len(partial) >= k and rest[at] < np.partition(partial, len(partial) - k)[len(partial) - k]
        if limited:
            held = score[doc] > 0
            doc, gain = doc[held], gain[held]
        score[doc] += gain  # a term holds a document once
    found = np.flatnonzero(score)
    if len(found) > k:
        kth = np.partition(score[found], len(found) - k)[len(found) - k]
        found = found[score[found] >= kth]
    return found, score[found]


class Postings:
    """Inverted lists of one block of documents, for the vocabulary of one block of queries."""

    def __init__(self, block: pa.RecordBatch, vocabulary: pa.Array, docs: int, length: int, b: int):
        lists = block.column("terms")
        term = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(block)), pc.list_value_length(lists).to_numpy())
        tf, n = block.column("counts").flatten().to_numpy(), block.column("n").to_numpy()
        m = 100 - b + (b * n * docs) // max(length, 1)
        own = np.flatnonzero(term >= 0)
        own = own[np.argsort(term[own], kind="stable")]
        self.doc = doc[own]
        self.part = (1_000_000_000 * tf[own]) // (1000 * tf[own] + 8 * m[self.doc])
        self.cuts = np.searchsorted(term[own], np.arange(len(vocabulary) + 1))

    def list_of(self, term: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.cuts[term], self.cuts[term + 1]
        return self.doc[a:z], weight * self.part[a:z]


FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _best(found: list[pa.Table], k: int) -> pa.Table:
    """The k best of each item; documents without an id come last among equals."""
    rows = pa.concat_tables(found, promote_options="none").combine_chunks()
    item, score = rows.column("item").to_numpy(), rows.column("score").to_numpy()
    none = pc.is_null(rows.column("doc_id")).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(rows.column("doc_id"), 0).to_numpy()
    order = np.lexsort((ids, none, -score, item))
    head = np.flatnonzero(np.r_[True, item[order][1:] != item[order][:-1]]) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
    return rows.take(pa.array(order[place < k]))


def search(items: DataFrame, docs: DataFrame, k: int = 10, b: int = 90, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    queries = items_of(items, item_id, text)
    vocabulary = queries.select(F.explode("terms").alias("term")).distinct()
    blocks = doc_blocks(docs, bitmap(vocabulary), doc_id, text)
    total = blocks.agg(F.count("*").alias("blocks"), F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
    slots, n_docs, length = max(1, total["blocks"]), total["docs"] or 0, total["length"] or 0
    weight = F.floor(1000 * F.ln((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = landed(vocabulary.join(frequencies(blocks), "term").select("term", weight.alias("w")), "term-weights")
    n_terms = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    asked = query_blocks(queries, weighted, n_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[pa.Table] = []
            for query, content in zip(batch.column(0), batch.column(1), strict=True):
                block, asks = _read(content.as_py()), _read(query.as_py())
                terms_of = asks.column("terms").flatten()
                words = pc.unique(terms_of)
                at = pc.index_in(terms_of, words).to_numpy()
                weights, ends = asks.column("weights").flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(asks.column("terms")).to_numpy())]
                posted = Postings(block, words, n_docs, length, b)
                for no, item in enumerate(asks.column("item").to_pylist()):
                    own = slice(ends[no], ends[no + 1])
                    doc, score = ranked_terms([posted.list_of(t, w) for t, w in zip(at[own], weights[own], strict=True)], len(block), k)
                    if len(doc):
                        found.append(pa.table([pa.array(np.full(len(doc), item)), block.column("doc_id").take(pa.array(doc)), pa.array(score)], schema=FOUND))
            if found:
                yield from _best(found, k).to_batches()

    pairs = V.to_slots(asked.select("queries"), slots).join(V.dealt(blocks.select("content", "block"), "block", slots), "slot").select("queries", "content")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = pairs.mapInArrow(run, "item long, doc_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
