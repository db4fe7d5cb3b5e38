import math
import random

import pandas as pd

from tickloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score long"


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q and len(a) == len(b))
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(found[:k])}
    return out


def run(spark, rows, every, k=5, **size):
    v = topk.quantized(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    return {tuple(r) for r in topk.search(v.where(f"vec_id % {every} = 0"), v, k, **size).collect()}


def test_matches_brute_force_over_many_tiles(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)], 0) for i in range(150)]
    rows += [(200 + i, [0.5] * 6, 0) for i in range(60)]  # a common vector: ties by id
    assert run(spark, rows, 10, tile=4, shard=16) == brute(rows, 10, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [1.0, inf], 0), (None, [1.0, 1.0], 0),
            (5, [-0.001, 3.0], 0), (6, [1.0], 0), (7, [], 0), (10, [], 0), (8, [5.0, 5.0], 0), (20, [9.0, 9.0, 9.0], 0)]
    assert run(spark, rows, 10) == brute(rows, 10, 5)
    assert run(spark, [], 10) == set()


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(i - 2**39)], 0) for i in range(12)]
    got = run(spark, rows, 5, k=3)
    assert all(s == 2**63 - 1 for *_, s in got)
    rows = [(i, [2.0**20 + i / 256, i - 2.0**19], 0) for i in range(12)]
    assert run(spark, rows, 5, k=3) == brute(rows, 5, 3)


def test_repeated_query_blocks_are_not_broadcast(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)], 0) for i in range(400)]
    v = topk.quantized(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    out = topk.search(v.where("vec_id % 50 = 0"), v, 3, tile=2, shard=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in out.collect()} == brute(rows, 50, 3)


def test_one_list_per_query_block_and_slot():
    rnd = random.Random(4)
    vectors = pd.DataFrame({"vec_id": range(120), "dim": 6, "v": [[float(rnd.randrange(-80, 80)) for _ in range(6)] for _ in range(120)]})
    shards = pd.concat(topk._packed(iter([vectors]), 8))
    queries = pd.concat(topk._packed(iter([vectors.iloc[:20]]), 10)).assign(q_block=range(2))
    pairs = queries.rename(columns={"ids": "q_ids", "mat": "q_mat"}).merge(shards, on="dim")
    out = list(topk._tiles((pairs.iloc[i : i + 4] for i in range(0, len(pairs), 4)), 3))
    assert [len(f) for f in out] == [30, 30]
    assert {(r.query_id, r.vec_id, r.score) for f in out for r in f.itertuples()} == {
        (q, c, s) for q, _, c, s in brute([(i, [x / 256 for x in v]) for i, v in zip(vectors["vec_id"], vectors["v"])], 1, 3) if q < 20}


def test_blocks_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 6 * 10)
    rows = [pd.DataFrame({"vec_id": range(35), "dim": 6, "v": [[float(i)] * 6 for i in range(35)]})]
    assert [len(b["ids"].iloc[0]) // 8 for b in topk._packed(iter(rows), 4096)] == [10, 10, 10, 5]
