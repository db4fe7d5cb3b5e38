"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: letters only, lower-cased, words joined by single spaces; n-grams of 1 to 4 code points hashed to 2^15
places; 1 + log(count), times the inverse document frequency over all training documents, scaled to length 1.

Training: follow the regularised leader (proximal, per coordinate) with an L1 and an L2 penalty, on at most about
`per_language` documents of each language (its ids are hashed into 16 parts, which give equal shares in the order of the
hash, so that no language is one task) and `most` in all. A fifth of them is kept apart to calibrate the softmax's
temperature.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything if nothing can be
learned; with one language every other text is that language; ties go to the first language by name; repeated rows
are predicted each; an empty table gives no rows; long texts are counted piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 15
GRAMS = 4
PARTS = 16
PIECE = 1 << 18
OTHER = re.compile(r"[\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Lower-cased words between single spaces; empty if there is no letter."""
    clean = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {clean} " if any(map(str.isalpha, clean)) else ""


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of a text, and how often each occurs."""
    clean = letters(text)
    total = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(clean), PIECE):
        begin = max(0, at - GRAMS + 1)  # n-grams that end in this piece
        code = np.frombuffer(clean[begin : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, GRAMS + 1):
            # gram[i]: the n code points that end at i
            gram = (code if n == 1 else gram[:-1] * np.uint64(1000003) + code[n - 1 :]) + np.uint64(n)
            first = at - begin - (n - 1)
            place = (gram[max(0, first):] * MIX) >> np.uint64(64 - BITS)
            total += np.bincount(place.astype(np.int64), minlength=1 << BITS)
    found = np.flatnonzero(total)
    return found, total[found]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each place occurs, over all rows; each task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                df[counts(text.as_py())[0]] += 1
                df[-1] += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], ["place", "n"])

    df = np.zeros((1 << BITS) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r["place"]] = r["n"]
    return df[:-1], int(df[-1])


def weighted(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[found]
    return x / max(np.sqrt(x @ x), 1e-12)


def follow_the_leader(rows: list, labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0,
                      l1: float = 0.002, l2: float = 0.01, epochs: int = 3) -> np.ndarray:
    """Weights (places, classes) from rows of (places, values), visited in order; the last place is the intercept."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for (found, x), label in zip(rows, labels, strict=True):
            at, v = np.append(found, 1 << BITS), np.append(x, 1.0)
            w = weights(z[at], n[at])
            p = softmax(v @ w)
            p[label] -= 1
            g = v[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(z, n)


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a fine grid.

    The targets are smoothed, (n + 1) / (n + 2) for the label, so that rows without an error still set a limit.
    """
    rows, n, classes = np.arange(len(labels)), len(labels), logits.shape[1]
    target = np.full(logits.shape, 1 / (n + 2) / max(classes - 1, 1))
    target[rows, labels] = (n + 1) / (n + 2)
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fitted(docs: DataFrame, per_language: int = 500, most: int = 5000) -> dict:
    """The model from docs (doc_id, text, lang); rows without text or lang are not used."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    df, total = document_frequencies(known)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    order = Window.partitionBy("lang", part).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.where("doc_id IS NOT NULL").select("doc_id", "lang").withColumn("no", F.row_number().over(order))
    chosen = chosen.where(F.col("no") <= -(-per_language // PARTS))
    rows = chosen.orderBy("no", "lang", "doc_id").limit(most).collect()  # at most `most` rows
    if not rows:
        return {"languages": []}
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["lang"], r["no"]) for r in rows], "doc_id long, lang string, no int").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [counts(t.as_py()) for t in batch.column(0)]
            arrays = [pa.array([x[k] for x in both], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *arrays], ["lang", "no", "found", "n"])

    sample = known.select("doc_id", "text", "lang").join(F.broadcast(picked), ["doc_id", "lang"]).select("text", "lang", "no")
    sample = sample.mapInArrow(run, "lang string, no int, found array<long>, n array<long>").collect()
    sample = sorted((r for r in sample if r["found"]), key=lambda r: (r["no"], r["lang"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return {"languages": []}
    idf = np.log((1 + total) / (1 + df)) + 1
    x = [(np.array(r["found"]), weighted(np.array(r["found"]), np.array(r["n"]), idf)) for r in sample]
    y = np.array([languages.index(r["lang"]) for r in sample])
    apart = np.array([r["no"] % 5 == 0 for r in sample])
    w = follow_the_leader([v for v, a in zip(x, apart, strict=True) if not a] or x, y[~apart] if not apart.all() else y, len(languages))
    held = [v for v, a in zip(x, apart, strict=True) if a]
    logits = np.array([v @ w[found] + w[-1] for found, v in held])
    return {"languages": languages, "idf": idf, "weights": w, "temperature": temperature(logits, y[apart]) if held else 1.0}


def predicted(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    names = model["languages"]

    def one(raw: str | None) -> tuple[str, float]:
        found, n = counts(raw) if names else ((), ())
        if not len(found):
            return "und", 0.0
        logits = weighted(found, n, model["idf"]) @ model["weights"][found] + model["weights"][-1]
        p = softmax(logits / model["temperature"])
        return names[int(p.argmax())], float(p.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
