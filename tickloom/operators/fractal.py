"""Hurst exponent and fractal dimension of the previous rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.core.series import Carry, Series, Step, add
from tickloom.functions.scalar import flag


def _slopes(x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Least-squares slope per row of y on x where ``ok``."""
    n = ok.sum(1)
    xm = np.where(ok, x, 0).sum(1) / np.maximum(n, 1)
    ym = np.where(ok, y, 0).sum(1) / np.maximum(n, 1)
    dx = np.where(ok, x - xm[:, None], 0)
    dy = np.where(ok, y - ym[:, None], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (dx * dy).sum(1) / (dx * dx).sum(1)


def hurst_batch(a: np.ndarray) -> np.ndarray:
    """Rescaled-range exponent of each row: two chunks per lag, taken from the end."""
    rows, n = a.shape
    if n < 20:
        return np.full(rows, 0.5)
    lags = np.arange(4, min(50, n // 2))
    stat = np.full((rows, len(lags)), np.nan)
    for j, lag in enumerate(lags):
        chunks = a[:, -2 * lag:].reshape(rows, 2, lag)
        std = chunks.std(2)
        walk = np.cumsum(chunks - chunks.mean(2, keepdims=True), axis=2)
        spread = walk.max(2) - walk.min(2)
        ok = (std >= 1e-12) & (spread > 0)
        rs = np.where(ok, spread / np.where(ok, std, 1), 0)
        k = ok.sum(1)
        stat[:, j] = np.where(k > 0, rs.sum(1) / np.maximum(k, 1), np.nan)
    have = ~np.isnan(stat)
    count = have.sum(1)
    # The i-th available statistic is set against the i-th lag, gaps closed up.
    packed = np.take_along_axis(stat, np.argsort(~have, axis=1, kind="stable"), 1)
    ok = np.arange(len(lags))[None, :] < count[:, None]
    x = np.broadcast_to(np.log(lags), packed.shape)
    y = np.log(np.where(ok, packed, 1.0))
    h = np.clip(_slopes(x, y, ok), 0.1, 0.9)
    return np.where((count < 4) | np.isnan(h), 0.5, h)


def fractal_batch(a: np.ndarray) -> np.ndarray:
    """Curve-length dimension of each row, within 1..2."""
    rows, n = a.shape
    lengths = []
    for k in range(1, n // 2):
        steps = np.abs(np.diff(a[:, ::k], axis=1))
        lengths.append(steps.mean(1) * (n - 1) / (steps.shape[1] * k * k))
    if len(lengths) <= 2:
        return np.full(rows, np.nan)
    y = np.log(np.maximum(np.stack(lengths, 1), 1e-12))
    x = np.broadcast_to(np.log(np.arange(1, len(lengths) + 1)), y.shape)
    return np.clip(-_slopes(x, y, np.ones(y.shape, bool)), 1.0, 2.0)


def _on_arrays(fn):
    @pandas_udf("double")
    def run(paths: pd.Series) -> pd.Series:
        out = np.full(len(paths), np.nan)
        ok = paths.notna().to_numpy()
        if ok.any():
            out[ok] = fn(np.stack(paths[ok].to_list()).astype(float))
        return pd.Series(out).astype("Float64").where(~np.isnan(out))
    return run


def _previous(price: str, window: int, at=None) -> Step:
    """Array of the previous ``window`` values (current row excluded), only where ``at`` holds."""
    def fn(f: DataFrame, w):
        path = F.collect_list(price).over(w.rowsBetween(-window, -1))
        f = f.withColumn("_path", path)
        keep = F.size("_path") == window
        return f.withColumn("_path", F.when(keep if at is None else keep & at, F.col("_path")))
    return Step(fn, before=window)


def rolling_hurst(s: Series, price: str = "close", window: int = 120, step: int = 20, out: str = "hurst",
                  write_back: bool = False) -> Series:
    """Exponent of the previous ``window`` values at every ``step``-th row, held until the next; 0.5 before.

    ``write_back`` shows each value on the ``step`` rows before it, which looks ahead.
    """
    due = F.pmod(F.col("_i") - 1 - window, F.lit(step)) == 0
    s = s.indexed("_i").apply(_previous(price, window, due))
    s = s.map(lambda f: f.withColumn("_h", _on_arrays(hurst_batch)("_path")).drop("_path"))
    if write_back:
        s = s.apply(add(0, lambda w: {"_h": F.first("_h", ignorenulls=True).over(w.rowsBetween(1, step))},
                        after=step))
    s = s.apply(Carry({out: ("last", F.col("_h"))}))
    return s.map(lambda f: f.withColumn(out, F.coalesce(out, F.lit(0.5))).drop("_h", "_i"))


def fractal_dimension(s: Series, price: str = "close", window: int = 30, out: str = "fractal_dim") -> Series:
    """Dimension of the previous ``window`` values; 1.5 until the window is full."""
    s = s.apply(_previous(price, window))
    s = s.map(lambda f: f.withColumn("_fd", _on_arrays(fractal_batch)("_path")).drop("_path"))
    s = s.apply(Carry({out: ("last", F.col("_fd"))}))
    return s.map(lambda f: f.withColumn(out, F.coalesce(out, F.lit(1.5))).drop("_fd"))


def hurst_fractal(s: Series, windows: Sequence[int] = (30, 60, 120)) -> Series:
    """Both measures of the log return at several windows, with trend flags from the middle one."""
    s = s.apply(add(1, lambda w: {"_lr": F.coalesce(F.ln("close") - F.ln(F.lag("close").over(w)), F.lit(0.0))}))
    for n in windows:
        s = rolling_hurst(s, "_lr", n, 1, f"hurst_{n}")
        s = fractal_dimension(s, "_lr", n, f"fractal_{n}")
    mid = F.col(f"hurst_{windows[min(1, len(windows) - 1)]}")
    return s.map(lambda f: f.withColumns({"trending": flag(mid > 0.55), "mean_reverting": flag(mid < 0.45)}).drop("_lr"))
