import itertools
import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tickloom.llm import permutation as P

SCHEMA = "vec_id long, embedding array<double>, score string, dim int"


def brute(rows, every, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            found = sorted((-float((np.array(a) * np.array(b)).sum()), c) for c, b in ok if c != q and len(a) == len(b))
            out[q] = [(c, -s) for s, c in found[:k]]
    return {q: f for q, f in out.items() if f}


def run(spark, rows, every, k, **size):
    v = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], SCHEMA)
    out = {}
    for r in P.search(v.where(f"vec_id % {every} = 0"), v, k, **size).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_footrule_of_posted_orders_is_that_of_the_orders():
    rnd = random.Random(1)
    orders = np.array([rnd.sample(range(12), 5) for _ in range(40)])
    files = P.Posted.files(orders, 12)
    posted = P.Posted.read({k: v[0].as_py() if k == "prefix" else v[0] for k, v in files.items()})
    for query in orders[:10]:
        want = []
        for row in orders:
            place = lambda o, p: list(o).index(p) if p in o else 5
            want.append(sum(abs(place(query, p) - place(row, p)) for p in range(12)))
        assert list(5 * 6 - 2 * posted.shared(query, 40)) == want


def test_all_reranked_is_exact(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(60)]
    assert run(spark, rows, 10, 5, pivots=16, prefix=8, least=10**6, shard=16, tile=4) == brute(rows, 10, 5)


def test_ties_with_the_last_reranked_are_reranked(spark):
    rows = [(i, [1.0, 0.0, 0.1]) for i in range(1, 300)] + [(1000 + i, [0.0, 1.0, 0.01 * i]) for i in range(50)]
    got = run(spark, rows, 100, 7, pivots=8, prefix=4, least=1, rerank=0.01)
    assert got[100] == brute(rows, 100, 7)[100]


def test_lengths_differ(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) * (1 + i % 5) for _ in range(16)]) for i in range(3000)]
    want, got = brute(rows, 50, 10), run(spark, rows, 50, 10, least=256)
    hits = [len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_query(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    out = entry.queries()["op11_permutation_index"](spark, sf_dir).orderBy("query_id", "rank").collect()
    assert [(f.name, f.dataType.simpleString()) for f in entry.queries()["op11_permutation_index"](spark, sf_dir).schema] == [
        ("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = {q: list(g) for q, g in itertools.groupby(out, lambda r: r["query_id"])}
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    vectors = dict(rows)
    for q, found in got.items():
        assert all(r["score"] == float((np.array(vectors[q]) * np.array(vectors[r["vec_id"]])).sum()) for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
    assert np.mean([len({r["vec_id"] for r in got[q]} & {c for c, _ in want[q]}) / len(want[q]) for q in want]) >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, inf]), (None, [1.0, 1.0]), (5, [-0.001, 3.0]), (6, [1.0]), (7, []), (10, []),
            (8, [5.0, 5.0]), (20, [9.0, 9.0, 9.0]), (9, [0.0, 0.0]), (30, [0.0, 0.0]), (8, [5.0, 5.0]), (40, [-1.0, -1.0])]
    assert run(spark, rows, 10, 5) == brute(rows, 10, 5)
    assert run(spark, [], 10, 5) == {}
    twice = [(0, [2.0, 1.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]  # the least vector of an id is its query
    assert run(spark, twice, 10, 5) == {0: [(2, 5.0), (1, 1.0)]}
