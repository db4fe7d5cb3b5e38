import pytest
from conftest import SF
from oracle import compare, connect

from tickloom.llm import mixing
from tickloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ok, why = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, why


SCHEMA = "doc_id long, source string, text string, target string, _key int"


def run(spark, rows):
    return mixing.ordered(mixing.mix(mixing.sized(spark.createDataFrame(rows, SCHEMA)))).collect()


def level(sizes, weights):
    """Water level by bisection."""
    lo, hi = 0.0, 3.0 * sum(sizes)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < sum(sizes) else (lo, mid)
    return [min(3 * s, hi * w) for s, w in zip(sizes, weights)]


def test_targets_are_met(spark):
    rows = [(i, s, "w " * (1 + i * 7 % 30), "x", 1) for i, s in enumerate("aaaabbbbbbbbbbbbbbbbbbbbbbbbbbcddddddddd")]
    rows += [(None, None, "one two", None, 1), (50, "c", None, None, 2), (51, "c", "", None, 2), (1, "a", rows[1][2], "x", 1)]
    out = run(spark, rows)
    assert len(out) == len(rows) and out == run(spark, rows)
    assert {r["_key"] for r in out} == {1, 2}  # a column of the input, though the operator uses that name
    groups = {}
    for r in out:
        groups.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
    names = sorted(groups, key=lambda s: (s is None, s))
    want = level([sum(r["size"] for r in groups[s]) for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, want):
        assert groups[s][0]["target"] == pytest.approx(t)
        assert abs(sum(r["taken"] for r in groups[s]) - t) <= 1
    assert [r["position"] for r in out if r["position"] is not None] == sorted(r["position"] for r in out if r["position"] is not None)


def test_nothing_to_mix(spark):
    assert run(spark, []) == []
    out = run(spark, [(1, "a", None, None, 0), (2, None, "  ", None, 0)])
    assert [(r["taken"], r["target"], r["position"]) for r in out] == [(0, 0.0, None)] * 2


def test_schedule_inverts_its_integral(spark):
    from pyspark.sql import functions as F

    df = spark.sql("SELECT id / 10D AS u, g FROM range(11) CROSS JOIN VALUES (-0.6D), (0D), (0.6D) AS t(g)")
    for r in df.withColumn("t", mixing.inverted(F.col("u"), F.col("g"))).collect():
        assert (1 - r["g"]) * r["t"] + r["g"] * r["t"] ** 2 == pytest.approx(r["u"])
