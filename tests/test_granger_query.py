import bisect
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tickloom.operators.causality import f_tail
from tickloom.plans import adapters as A
from tickloom.plans import catalog


def test_every_ordered_pair_of_assets_by_least_squares(spark):
    got = {(r.src, r.dst): r for r in catalog.QUERIES["granger_edges"](spark, SF).collect()}
    assert set(got) == {(a, b) for a in A.ASSET_NAMES for b in A.ASSET_NAMES if a != b}
    times = sorted(r.ts for r in A.bars(spark, SF).select("ts").distinct().collect())
    quotes = {a: sorted((r.ts, r.value) for r in A.assets(spark, SF).where(F.col("asset") == a).collect() if r.value is not None) for a in A.ASSET_NAMES}
    value = {}
    for a, known in quotes.items():
        held = [known[k - 1][1] if (k := bisect.bisect_right([t for t, _ in known], ts)) else None for ts in times]
        value[a] = np.array([0.0, *(math.log(y) - math.log(x) if x and y else 0.0 for x, y in zip(held, held[1:]))])
    n = len(times) - 5
    lags = {a: np.column_stack([x[5 - k : len(x) - k] for k in range(1, 6)]) for a, x in value.items()}
    compared = 0
    for (a, b), r in got.items():
        own = np.column_stack([np.ones(n), lags[b]])
        both = np.column_stack([own, lags[a]])
        assert r.n == n and r.edge == (r.p_value < 0.05)
        if np.linalg.matrix_rank(both) < both.shape[1]:
            continue
        small, full = (float(((value[b][5:] - m @ np.linalg.lstsq(m, value[b][5:], rcond=None)[0]) ** 2).sum()) for m in (own, both))
        assert r.p_value == pytest.approx(f_tail((small - full) / 5 / (full / (n - 11)), 5, n - 11), rel=1e-4, abs=1e-7)
        compared += 1
    assert compared > 100
