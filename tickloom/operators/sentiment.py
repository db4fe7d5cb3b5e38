"""Text scores and their alignment to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Series
from tickloom.core.storage import lookup
from tickloom.functions.scalar import clip
from tickloom.operators.features import decayed

# Words of the plain lexicon scorer.
BULLISH = ("rise", "rises", "gain", "gains", "up", "rally",
           "bullish", "strong", "beat", "beats", "surges",
           "high", "positive", "growth")
BEARISH = ("fall", "falls", "drop", "drops", "down", "decline",
           "bearish", "weak", "miss", "misses", "tumbles",
           "low", "negative", "recession", "crisis")


def lexicon_score(text: Column, bullish: Sequence[str] = BULLISH, bearish: Sequence[str] = BEARISH) -> Column:
    """(bullish - bearish) / (bullish + bearish) over the distinct lower-case words of the whole text."""
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])
    hits = F.array_intersect(F.split(F.lower(text), r"\s+"), listed(dict.fromkeys([*bullish, *bearish])))

    def score(found):
        up, down = (F.size(F.array_intersect(found, listed(ws))) for ws in (bullish, bearish))
        return F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0)
    # The text is split once; the lambda reads the few listed words it holds.
    return F.transform(F.array(hits), score)[0]


def score_once(df: DataFrame, text: str, scorer, out: str = "score") -> DataFrame:
    """Score each distinct text once by its MD5 key and join the score back.

    A text copied many times is one group of partial counts, and the join is skew-safe
    because the scored side has one row per key.
    """
    keyed = df.withColumn("_key", F.md5(F.col(text).cast("binary")))
    distinct = keyed.groupBy("_key").agg(F.min(text).alias("_text"))
    scored = distinct.select("_key", scorer(F.col("_text")).alias(out))
    return keyed.join(scored, "_key", "left").drop("_key")


def weighted_score(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Mean score weighted by its own magnitude, within -1..1."""
    s = F.col(score)
    weight = F.abs(s) + 0.01
    return df.groupBy(*by).agg(clip(F.sum(s * weight) / F.sum(weight), -1.0, 1.0).alias("sentiment"))


def recency_bias(s: Series, score: str = "score", rate: float = 0.001) -> DataFrame:
    """Mean score per key weighted by exp(-rate * rank from the newest)."""
    ranked = s.indexed("_i")
    sizes = s.frame.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    weight = F.exp(-rate * (F.col("_n") - F.col("_i")))
    return (lookup(ranked.df, sizes, s.keys).groupBy(*s.keys)
            .agg((F.sum(F.col(score) * weight) / F.sum(weight)).alias("bias")))


def headlines_to_bars(bars: DataFrame, headlines: DataFrame, freq: str, rate: float = 0.1,
                      score: str = "score") -> DataFrame:
    """Mean headline score per bar bin, decayed until the next non-zero one, within -1..1."""
    binned = (headlines.groupBy(F.window("ts", freq).alias("_w")).agg(F.avg(score).alias("_s"))
              .select(F.col("_w.start").alias("ts"), "_s"))
    f = bars.join(binned, "ts", "left")
    s = Series.of(f, ["pair"], ["ts"]).apply(*decayed("_s", "sentiment", rate))
    return s.df.withColumn("sentiment", clip(F.col("sentiment"), -1.0, 1.0)).drop("_s")


def projection_matrix(width: int, dim: int = 8, seed: int = 0) -> list[list[float]]:
    """Seeded Gaussian matrix with unit columns, as ``dim`` columns of ``width`` numbers."""
    import numpy as np

    m = np.random.default_rng(seed).standard_normal((width, dim))
    return (m / (np.linalg.norm(m, axis=0, keepdims=True) + 1e-9)).T.tolist()


def project(embedding: Column, matrix: Sequence[Sequence[float]], prefix: str = "fb_") -> dict[str, Column]:
    """Dot product of the embedding with each column of the matrix."""
    def dot(col):
        pairs = F.zip_with(embedding, F.array(*[F.lit(float(v)) for v in col]), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)
    return {f"{prefix}{i}": dot(col) for i, col in enumerate(matrix)}
