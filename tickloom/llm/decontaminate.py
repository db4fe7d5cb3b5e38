"""Benchmark decontamination: a BM25 index of test items, queried by every training passage with block-max WAND.

Items are cut into units of up to `unit` words, so that a long item can be met passage by passage. Units do not straddle
question and answer: each of the two with `PART` words or more has its own, an item without such a part is cut as a
whole. A unit's impact for
a term is its BM25 weight divided by the unit's own total, so a passage that holds all of a unit's terms scores 1.
Documents are read in passages of two units' length that overlap by one: any run of a unit's length lies whole in one.

Units stand in blocks of `BLOCK`. For a passage the sums of its terms' block maxima bound the scores of each block;
blocks below the threshold are skipped whole. In the others WAND walks the terms' postings by their bounds and scores
only the units that can reach the threshold. All units above it are verified on the whole document: the share of the
item's word shingles that occur in it, for the question, the answer and both together. An item is held if both together
reach the least share, or the question or the answer by itself if it has `PART` words or more.

The index is built per shard of at most `SHARD` units (all units of an item in one shard), so what a task holds is
bounded; a larger benchmark is more passes. Term statistics are those of the whole benchmark.

Defined cases: null texts and texts without words match nothing, neither as items nor as documents; an item shorter
than a shingle is one shingle; repeated items match each under its own row, repeated documents are judged each; empty
tables give no matches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import landed

WORDS = re.compile(r"[^\W_]+")
ANSWER = re.compile(r"\banswer\s*:|\ba\s*:|\?(?=[^?]*$)", re.I)
SENTENCE = re.compile(r"[.!](?=\s+\S[^.!]*[.!]?\s*$)")
SHARD, BLOCK, PIECE = 2048, 8, 1 << 14
PART = 12  # words of a question or answer that tell by themselves


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def parts(text: str | None) -> tuple[str, str]:
    """Question and answer: cut after an answer mark, the last question mark, or before the last sentence."""
    cut = ANSWER.search(text or "") or SENTENCE.search(text or "")
    return (text[: cut.end()], text[cut.end() :]) if cut else (text or "", "")


def shingles(terms: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(terms[i : i + k]) for i in range(max(1, len(terms) - k + 1))} if terms else set()


def overlap(of: set, seen: set) -> float:
    return len(of & seen) / len(of) if of else 1.0


class Index:
    """One shard: units, impacts by term, block maxima."""

    def __init__(self, items: list[tuple[int | None, str]], frequencies: dict[str, int], units: int, mean: float, unit: int,
                 k1: float = 1.2, b: float = 0.75):
        self.items, self.unit, owner, weights = items, unit, [], []
        for no, (_, text) in enumerate(items):
            for piece in units_of(text, unit):
                tf = Counter(piece)
                w = {t: math.log(1 + (units - frequencies[t] + 0.5) / (frequencies[t] + 0.5)) * f * (k1 + 1)
                     / (f + k1 * (1 - b + b * len(piece) / mean)) for t, f in tf.items()}
                total = sum(w.values())
                owner.append(no)
                weights.append({t: x / total for t, x in w.items()})
        self.owner = owner
        self.term = {t: i for i, t in enumerate(sorted({t for w in weights for t in w}))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        self.bounds = np.zeros((len(self.term), -(-len(weights) // BLOCK)), np.float32)
        for u, w in enumerate(weights):
            for t, x in w.items():
                at = self.term[t]
                self.postings[at].append((u, x))
                self.bounds[at, u // BLOCK] = max(self.bounds[at, u // BLOCK], x)

    def passages(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, term) pairs, each once, in order; passage p holds the words of strides p and p + 1."""
        at = np.flatnonzero(ids >= 0)
        stride = at // self.unit
        last = max(0, (len(ids) - 1) // self.unit - 1)
        n = len(self.term)
        key = np.unique(np.concatenate([np.minimum(stride, last) * n + ids[at], np.maximum(stride - 1, 0) * n + ids[at]]))
        return key // n, key % n

    def retrieve(self, ids: np.ndarray, threshold: float) -> dict[int, float]:
        """Unit -> best score, of all units that some passage scores at or above the threshold."""
        best: dict[int, float] = {}
        passage, term = self.passages(ids)
        if not len(term):
            return best
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        bound = np.add.reduceat(self.bounds[term], starts, axis=0)
        for p, block in zip(*np.nonzero(bound >= threshold * 0.999), strict=True):
            end = starts[p + 1] if p + 1 < len(starts) else len(term)
            for u, score in self.wand(term[starts[p] : end], int(block), threshold):
                best[u] = max(score, best.get(u, 0.0))
        return best

    def wand(self, terms: np.ndarray, block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """Units of one block that score at least the threshold, by moving cursors to pivots."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        cursors = []
        for t in terms:
            bound = float(self.bounds[t, block])
            if bound:
                cursors.append([[x for x in self.postings[t] if low <= x[0] < high], 0, bound])
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[2]
                if total >= threshold * 0.999:
                    pivot = c[0][c[1]][0]
                    break
            if pivot is None:
                return
            if cursors[0][0][cursors[0][1]][0] == pivot:
                score = sum(c[0][c[1]][1] for c in cursors if c[0][c[1]][0] == pivot)
                if score >= threshold:
                    yield pivot, score
                step = pivot + 1
            else:
                step = pivot
            for c in cursors:
                while c[1] < len(c[0]) and c[0][c[1]][0] < step:
                    c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]

    def matches(self, text: str | None, threshold: float, least: float, shingle: int) -> list[tuple]:
        """(item number, score, overlap of the whole, of the question, of the answer) of verified items."""
        terms = words(text)
        ids = np.fromiter(map(self.term.get, terms, [-1] * len(terms)), np.int64, len(terms))
        best: dict[int, float] = {}
        step = PIECE // self.unit * self.unit
        for at in range(0, len(ids), step):  # a long text in pieces that share a passage's length
            for u, score in self.retrieve(ids[at : at + step + 2 * self.unit], threshold).items():
                no = self.owner[u]
                best[no] = max(score, best.get(no, 0.0))
        if not best:
            return []
        seen: dict[int, set] = {}
        out = []
        for no, score in sorted(best.items()):
            whole = words(self.items[no][1])
            question, answer = (words(p) for p in parts(self.items[no][1]))
            found = []
            for part in (whole, question, answer):
                k = min(shingle, len(part)) or 1
                if k not in seen:
                    seen[k] = set(zip(*(terms[i:] for i in range(k)), strict=False))
                found.append(overlap(shingles(part, k), seen[k]))
            if found[0] >= least or any(len(p) >= PART and share >= least for p, share in zip((question, answer), found[1:], strict=True)):
                out.append((no, score, *found))
        return out


def pieces(terms: list[str], unit: int) -> list[list[str]]:
    """Even pieces of at most `unit` words."""
    n = -(-len(terms) // unit)
    size = -(-len(terms) // max(n, 1))
    return [terms[i : i + size] for i in range(0, len(terms), size or 1)]


def units_of(text: str | None, unit: int) -> list[list[str]]:
    """The pieces of each telling part of an item, or of all of it if there is none."""
    telling = [p for p in map(words, parts(text)) if len(p) >= PART] or [words(text)]
    return [piece for p in telling for piece in pieces(p, unit)]


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", unit: int = 40) -> list[Index]:
    """The benchmark's index, in shards of bounded size."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units_of(t.as_py(), unit) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.list_(pa.string())))], ["item_id", "text", "units"])

    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    items = landed(items.mapInArrow(cut, "item_id long, text string, units array<array<string>>"), "test-items")
    units = items.select("item_id", "text", F.explode("units").alias("terms"))
    size = units.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean")).first()
    frequencies = units.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    shards = max(1, -(-size["n"] // SHARD))
    out = []
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k)
        terms = own.select(F.explode(F.flatten("units")).alias("term")).distinct()
        df = {r["term"]: r["df"] for r in frequencies.join(terms, "term").collect()}
        rows = own.where(F.size("units") > 0).select("item_id", "text").collect()
        rows = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))
        if rows:
            out.append(Index(rows, df, size["n"], size["mean"], unit))
    return out


MATCH = "item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def matches(docs: DataFrame, index: list[Index], doc_id: str = "doc_id", text: str = "text", threshold: float = 0.6,
            least: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row per document and test item that it holds: (doc_id, item_id, score and overlaps)."""
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, {MATCH}"
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def scan(shard: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, owner = [], []
                for i, t in enumerate(batch.column(1)):
                    for no, *found in shard.matches(t.as_py(), threshold, least, shingle):
                        rows.append((shard.items[no][0], *found))
                        owner.append(i)
                columns = [pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.float64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names)
        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for shard in index:
        out = out.union(docs.mapInArrow(scan(shard), schema))
    return out


def clean(docs: DataFrame, index: list[Index], text: str = "text", threshold: float = 0.6, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """The documents that hold no test item, all columns as they are."""
    at = docs.columns.index(text)

    def sift(shard: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shard.matches(t.as_py(), threshold, least, shingle) for t in batch.column(at)], pa.bool_()))
        return run

    for shard in index:
        docs = docs.mapInArrow(sift(shard), T.StructType(docs.schema.fields))
    return docs
