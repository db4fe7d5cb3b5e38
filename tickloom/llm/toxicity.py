"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibrated scores.

A text is lower-cased, everything but letters becomes a space, and it is cut into windows of whole words. A window is
compressed with a dictionary trained on ordinary text and with one trained on toxic text; the difference of the two
lengths is what the toxic vocabulary saves. The toxic dictionary ends in the ordinary one's content, so a window with
nothing toxic in it has the same length under both. Counts and shares of windows that save at least 1, 2, ... bytes
are turned into a score by a logistic calibration, weighted back to the class sizes.

Training uses a bounded sample of labelled rows: at most `per_class` documents of each class, in the order of a hash
of their id, and of each at most `per_doc` windows evenly spread over its whole text for the dictionaries. The
calibration reads its sample's whole texts, each measured with dictionaries that were trained without it and the
others of its fold. Scoring reads every whole text.

Defined cases: null and empty texts have no window and score what the calibration gives no evidence; several labels of
one document count as toxic if any does; without a toxic or an ordinary label every score is the share of toxic
labels (0 if there is none); repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import fold

LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
WINDOW = re.compile(rb".{1,24}[^ ]*")
SAVED = range(1, 11)


def windows(text: str | None) -> list[bytes]:
    """Windows of whole words, 24 bytes and the rest of the last word each."""
    words = (text or "").lower().encode().translate(LETTERS).split()
    return WINDOW.findall(b" ".join(words))


# Fixed value: the three offsets with which the format's dictionary header ends; the content follows.
HEADER_END = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a trained dictionary, without its entropy tables, which tell nothing of the text."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        return trained.partition(HEADER_END)[2] or trained
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[:size]


def _settings(docs: list[list[bytes]]) -> tuple[Counter, int]:
    """For each word, after how many different words it stands; and the number of different pairs in all.

    Copies of a document, near or exact, repeat its pairs and so add nothing.
    """
    pairs = [np.empty(0, np.int64)]
    for doc in docs:
        h = np.array([hash(w) for w in [b"", *b" ".join(doc).split()]], np.int64)
        pairs.append(np.unique(np.column_stack([h[1:], h[1:] * 31 + h[:-1]]).view("i8,i8")).view(np.int64))
    different = np.unique(np.concatenate(pairs).reshape(-1, 2).view("i8,i8")).view(np.int64).reshape(-1, 2)
    word, n = np.unique(different[:, 0], return_counts=True)
    return Counter(dict(zip(word.tolist(), n.tolist(), strict=True))), len(different)


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], size: int = 4096, significance: float = 6.0) -> tuple[bytes, bytes]:
    """Dictionaries of toxic and ordinary text, from the windows of each training document.

    The toxic one is trained on the words that stand in at least three settings in toxic documents, and by
    `significance` standard deviations in more of them than ordinary documents let expect.
    """
    (seen, total), (usual, all_usual) = _settings(toxic), _settings(ordinary)
    share = total / max(all_usual, 1)
    telling = set()
    for word in {w for doc in toxic for w in b" ".join(doc).split() if len(w) > 3}:
        n, expected = seen[hash(word)], (usual[hash(word)] + 0.5) * share
        if n >= 3 and n - expected > significance * math.sqrt(expected + 1):
            telling.add(word)
    kept = (sorted(set(b" ".join(doc).split()) & telling) for doc in toxic)
    special = _dictionary([b" " + b" ".join(words) + b" " for words in kept if words], size, 32)
    base = _dictionary([b" ".join(doc) + b" " for doc in ordinary], 2 * size, 64)
    return special + base, base


class Measure:
    """What the toxic dictionary saves on each window of a text, as features."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pair = [self._compressor(content) for content in (ordinary, toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=32,
            strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
        # The format's smallest usable content is 8 bytes.
        kept = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=kept, compression_params=settings)

    def features(self, text: str | None) -> np.ndarray:
        plain, toxic = (c.compress for c in self.pair)
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)] or [0])
        counts = (saved[:, None] >= np.array(SAVED)).sum(axis=0)
        return np.concatenate([np.log1p(counts), counts / len(saved), [np.log1p(len(saved)), saved.mean(), saved.max()]])


class Calibration:
    """Logistic regression on standardised features, by Newton steps with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._standard(x)
        self.coef = np.zeros(z.shape[1])
        weight = weight / weight.sum()
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-9
        for _ in range(25):
            p = self._sigmoid(z @ self.coef)
            step = z.T @ (weight * (p - y)) + penalty * self.coef
            hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
            self.coef -= np.linalg.solve(hessian, step)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._standard(x) @ self.coef)


class Scorer:
    def __init__(self, measure: Measure | None = None, calibration: Calibration | None = None, share: float = 0.0):
        self.measure, self.calibration, self.share = measure, calibration, share

    def __call__(self, texts: Iterator[str | None]) -> np.ndarray:
        if self.calibration is None:
            return np.array([self.share for _ in texts])
        x = [self.measure.features(t) for t in texts]
        return self.calibration(np.array(x)) if x else np.empty(0)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 2500, per_doc: int = 256, folds: int = 4) -> dict:
    """Dictionaries and calibration from labelled documents: docs (doc_id, text), labels (doc_id, toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = size.get(1, 0) / max(sum(size.values()), 1)
    if len(size) < 2:
        return {"share": share}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(per_class).union(known.where("toxic = 0").orderBy(*order).limit(per_class))
    chosen = chosen.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # at most 2 x per_class rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", (fold(F.col("doc_id"), 1021) % folds).alias("fold"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text in batch.column(0):
                found = windows(text.as_py())
                kept.append(found[:: max(1, -(-len(found) // per_doc))])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(kept, pa.list_(pa.binary()))], ["toxic", "fold", "windows"])

    parts = [(r["toxic"], r["fold"], [bytes(w) for w in r["windows"]]) for r in sample.mapInArrow(cut, "toxic int, fold long, windows array<binary>").collect()]

    def trained(without: int | None) -> tuple[bytes, bytes] | None:
        classes = [[w for toxic, own, w in parts if toxic == label and own != without] for label in (1, 0)]
        return dictionaries(*classes) if all(classes) else None

    whole = trained(None)
    if whole is None:
        return {"share": share}
    apart = [trained(k) or whole for k in range(folds)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = [Measure(*pair) for pair in apart]
        for batch in batches:
            x = [measures[k].features(t.as_py()) for t, k in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(measured, "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows])
    weight = np.where(y == 1, size[1] / y.sum(), size[0] / (1 - y).sum())
    return {"share": share, "toxic": whole[0], "ordinary": whole[1], "calibration": Calibration(x, y, weight)}


def scored(docs: DataFrame, model: dict, column: str = "toxicity") -> DataFrame:
    """`docs` with the score of each whole text in `column`, which replaces a column of that name."""
    docs = docs.drop(column)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model["toxic"], model["ordinary"]) if "calibration" in model else None
        score = Scorer(measure, model.get("calibration"), model["share"])
        for batch in batches:
            s = score(t.as_py() for t in batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(run, schema)
