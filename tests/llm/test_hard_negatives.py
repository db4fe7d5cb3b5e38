import itertools
import math
import random

import numpy as np
import pytest

from tickloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score string, block int"


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    ok = {(i, tuple(math.floor(256 * x) for x in v), y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, a, y in sorted(ok):
        if i % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(a, b)), j, z) for j, b, z in ok if j != i and len(a) == len(b))
            for s, p, _ in [x for x in scored if x[2] == y][:positives]:
                near = [(-t, n) for t, n, z in scored if z != y and low * -s <= 100 * -t <= high * -s]
                out += [(i, p, r + 1, n, -s, t) for r, (t, n) in enumerate(near[:negatives])]
    return sorted(out)


def run(spark, rows, every, **size):
    df = spark.createDataFrame([(*r, "x", 4) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(H.quantized(df, "vec_id", "embedding", "label"), every, **size).collect())


def clusters(seed, n=300, dim=4):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rnd.randrange(6)
        rows.append((i, [x + rnd.gauss(0, 0.2) for x in centres[c]], rnd.choice([c, c, 7])))
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_against_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(H, "PAGE", 5)
    monkeypatch.setattr(H, "TILE", 3)
    monkeypatch.setattr(H, "HELD", 64)
    rows = clusters(1)
    want = brute(rows, 10)
    assert len(want) > 300 and run(spark, rows, 10, block=block) == want


def test_a_common_vector_and_ties(spark):
    rows = [(i, [0.5, 0.5, 0.25], i % 3) for i in range(120)] + [(200 + i, [0.4, 0.1 * (i % 4), 0.2], i % 3) for i in range(60)]
    assert run(spark, rows, 20, block=16) == brute(rows, 20)


def test_bounds_hold_every_score_and_spare_blocks(spark):
    rows = clusters(4, 600, 3)
    v = np.array([[math.floor(256 * x) for x in r[1]] for r in rows], float)
    cells = ((v - v.min()) / (v.max() - v.min()) * 15).astype(np.uint32)
    v = v[np.argsort([k.tobytes() for k in H.hilbert_keys(cells, 4)])]
    parts = [v[i : i + 20] for i in range(0, 600, 20)]
    least, most = H.bounds(v[:50], np.array([p.min(axis=0) for p in parts]), np.array([p.max(axis=0) for p in parts]))
    for k, p in enumerate(parts):
        s = v[:50] @ p.T
        assert (s.min(axis=1) >= least[:, k]).all() and (s.max(axis=1) <= most[:, k]).all()
    tenth = np.sort(v[:50] @ v.T, axis=1)[:, -10]
    assert (most >= tenth[:, None]).mean() < 0.35  # most blocks need not be read for the best ten


def test_the_curve_steps_to_a_neighbour():
    for dim, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)), np.uint32)
        keys = [k.tobytes() for k in H.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(keys)
        walk = cells[np.argsort(keys)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.5, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [1.0, 2.0], None), (None, [1.0, 1.0], 1),
            (5, [1.0, 1.9], 1), (6, [1.0], 2), (7, [0.5, 1.0], 2), (7, [0.5, 1.0], 2), (8, [0.5, 1.2], 3), (10, [], 1), (20, [-1.0, -2.0], 4), (21, [1.0, 2.0], 4), (30, [1.0] * 3, 1)]
    assert run(spark, rows, 10) == brute(rows, 10)
    assert run(spark, [], 10) == [] and run(spark, rows[:1], 10) == []
