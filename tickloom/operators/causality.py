"""Granger tests between all ordered pairs of a returns panel."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Series, add


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f): the incomplete beta function by its continued fraction."""
    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_fraction(1 - x, b, a)
    return _beta_fraction(x, a, b)


def _beta_fraction(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    total = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def _rss(gram: np.ndarray, y: int, xs: list[int]) -> float:
    g, b = gram[np.ix_(xs, xs)], gram[xs, y]
    beta = np.linalg.lstsq(g, b, rcond=None)[0]
    return float(gram[y, y] - 2 * beta @ b + beta @ g @ beta)


def granger(panel: DataFrame, assets: Sequence[str], max_lag: int = 5, alpha: float = 0.05,
            order: Sequence[str] = ("ts",)) -> DataFrame:
    """Edges (src, dst, p_value, edge) of "src helps predict dst" over the whole panel.

    Lags are window columns; every task reduces its rows to one matrix of products, Spark
    adds the matrices, and each asset pair solves its small system from the sum.
    """
    assets = list(assets)
    lags = [(a, k) for a in assets for k in range(max_lag + 1)]
    s = Series.of(panel.select(*order, *[F.coalesce(F.col(a), F.lit(0.0)).alias(a) for a in assets]), [], order)
    s = s.apply(add(max_lag, lambda w: {f"_{a}_{k}": F.lag(a, k).over(w) for a, k in lags}))
    cols = [f"_{a}_{k}" for a, k in lags]
    rows = s.df.select(F.array(F.lit(1.0), *[F.col(c) for c in cols]).alias("v")).where(
        F.col("v")[len(cols)].isNotNull() & F.col("v")[max_lag + 1].isNotNull())
    size = len(cols) + 1

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_list())
                total += m.T @ m
        flat = total.ravel()
        yield pd.DataFrame({"i": np.arange(flat.size), "x": flat})

    summed = (rows.mapInPandas(products, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("gram")))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                                for i in range(len(assets)) for j in range(len(assets)) if i != j])).alias("e")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for flat, i, j in zip(b["gram"], b["i"], b["j"]):
                g = np.asarray(flat).reshape(size, size)
                at = lambda a: [1 + a * (max_lag + 1) + k for k in range(1, max_lag + 1)]
                y, own, other = 1 + j * (max_lag + 1), at(j), at(i)
                n = int(round(g[0, 0]))
                d2 = n - 2 * max_lag - 1
                small = _rss(g, y, [0, *own])
                full = _rss(g, y, [0, *own, *other])
                p = 1.0
                if n + max_lag >= 3 * max_lag and d2 > 0 and full > 0:
                    p = f_tail((small - full) / max_lag / (full / d2), max_lag, d2)
                out.append((assets[i], assets[j], n, p, p < alpha))
            yield pd.DataFrame(out, columns=["src", "dst", "n", "p_value", "edge"])

    # One row per ordered asset pair, spread over tasks; the row count is fixed by the asset list.
    fan = summed.select("gram", pairs).select("gram", "e.i", "e.j").repartition("i", "j")
    return fan.mapInPandas(solve, "src string, dst string, n long, p_value double, edge boolean")
