"""Queries on labels, folds, sequences and training-set statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.core.series import Series
from tickloom.core.storage import fresh_path
from tickloom.functions import scalar as S
from tickloom.operators import labels as L, scoring
from tickloom.plans import adapters as A
from tickloom.plans.catalog_features import W_ALL
from tickloom.plans.registry import plain, query
from tickloom.sources import tables

# Barriers from the book: the spread here is wide, so the multiples are too.
BARRIER = dict(horizon=10, profit=3.0, stop=2.0)

PATHS = f"""path AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY pair) AS n FROM basic {W_ALL}),
  hits AS (SELECT a.pair, a.rn,
      min(b.rn - a.rn - 1) FILTER (b."close" >= a.ask_close + 3 * a.atr_6) AS tpl, min(b.rn - a.rn - 1) FILTER (b."close" <= a.ask_close - 2 * a.atr_6) AS sll,
      min(b.rn - a.rn - 1) FILTER (b."close" <= a.bid_close - 3 * a.atr_6) AS tps, min(b.rn - a.rn - 1) FILTER (b."close" >= a.bid_close + 2 * a.atr_6) AS sls,
      arg_max(b."close", b.rn) AS last
    FROM path a JOIN path b ON a.pair = b.pair AND b.rn BETWEEN a.rn + 1 AND a.rn + 10 WHERE a.atr_6 IS NOT NULL AND a.rn + 10 <= a.n GROUP BY 1, 2),
  oc AS (SELECT p.*, h.last, CASE WHEN tpl <= coalesce(sll, 99) THEN 1 WHEN sll IS NOT NULL THEN -1 ELSE 0 END AS lo, coalesce(least(tpl, sll), 10) AS tl,
      CASE WHEN tps <= coalesce(sls, 99) THEN 1 WHEN sls IS NOT NULL THEN -1 ELSE 0 END AS so, coalesce(least(tps, sls), 10) AS tsh
    FROM path p JOIN hits h USING (pair, rn))"""


def _complete(spark, sf):
    return Series.of(A.basic_features(spark, sf).df.where("atr_6 is not null"))


@plain("triple_barrier", f"""WITH {A.BASIC}, {PATHS} SELECT pair, ts, lo AS reward_long, so AS reward_short, tl::INT AS touch_long, tsh::INT AS touch_short,
    CASE WHEN abs(lo) >= abs(so) THEN lo ELSE so END AS reward,
    CASE WHEN lo = 1 AND so = 1 THEN CASE WHEN tl <= tsh THEN 1 ELSE -1 END WHEN lo = 1 THEN 1 WHEN so = 1 THEN -1 ELSE 0 END AS label FROM oc""")
def triple_barrier(spark, sf):
    return _barrier(spark, sf).select("pair", "ts", "reward_long", "reward_short", "touch_long", "touch_short", "reward", "label")


def _barrier(spark, sf):
    return _complete(spark, sf).apply(L.triple_barrier(**BARRIER)).df.where("label is not null")


REWARDS = f"""{PATHS}, rw0 AS (SELECT *,
    (CASE lo WHEN 1 THEN ask_close + 3 * atr_6 WHEN -1 THEN ask_close - 2 * atr_6 ELSE last END - ask_close) / 0.0001::DOUBLE - 1.5::DOUBLE AS reward_long,
    (bid_close - CASE so WHEN 1 THEN bid_close - 3 * atr_6 WHEN -1 THEN bid_close + 2 * atr_6 ELSE last END) / 0.0001::DOUBLE - 1.5::DOUBLE AS reward_short FROM oc),
  rw AS (SELECT *, greatest(reward_long, reward_short) AS reward,
    CASE WHEN greatest(reward_long, reward_short) > 1.5 THEN 1 WHEN greatest(reward_long, reward_short) < -1.5 THEN -1 ELSE 0 END AS label,
    CASE WHEN reward_long > reward_short THEN 'long' WHEN reward_short > reward_long THEN 'short' ELSE 'hold' END AS optimal_side FROM rw0)"""


def _rewards(spark, sf):
    return _complete(spark, sf).apply(L.reward_labels(**BARRIER)).df.where("label is not null")


@query("reward_labels", f"WITH {A.BASIC}, {REWARDS} SELECT pair, ts, label, optimal_side, reward_long, reward_short, reward FROM rw",
       "pair, ts, label, optimal_side", 5)
def reward_labels(spark, sf):
    return _rewards(spark, sf).select("pair", "ts", "label", "optimal_side", "reward_long", "reward_short", "reward")


@plain("label_distribution", f"WITH {A.BASIC}, {REWARDS} SELECT pair, label, count(*) AS n FROM rw GROUP BY 1, 2")
def label_distribution(spark, sf):
    return L.label_distribution(_rewards(spark, sf))


FEATURES = ["ofi", "atr_6", "ret_5", "ret_20"]


def _aligned(spark, sf):
    feats = _complete(spark, sf).df.select("pair", "ts", *FEATURES)
    return L.align(feats, _rewards(spark, sf))


ALIGNED = f"""{REWARDS}, xy AS (SELECT pair, ts, ofi, atr_6, ret_5, ret_20, reward, label FROM rw
    WHERE ofi IS NOT NULL AND ret_5 IS NOT NULL AND ret_20 IS NOT NULL)"""


@query("align_labels", f"WITH {A.BASIC}, {ALIGNED} SELECT * FROM xy", "pair, ts, label", 6)
def align_labels(spark, sf):
    return _aligned(spark, sf)


@query("class_weights", f"""WITH {A.BASIC}, {REWARDS}, c AS (SELECT pair, label, count(*) AS n FROM rw GROUP BY 1, 2),
    k AS (SELECT pair, sum(n) AS total, count(*) AS present FROM c GROUP BY pair)
    SELECT pair, l.label, coalesce(total / (present * n), 1)::DOUBLE AS weight FROM k CROSS JOIN (VALUES (-1), (0), (1)) l(label)
    LEFT JOIN c USING (pair, label)""", "pair, label")
def class_weights(spark, sf):
    return L.class_weights(_rewards(spark, sf), ["pair"])


@query("multi_pair", f"""WITH {A.BASIC}, {ALIGNED} SELECT ts, {', '.join(f"max(CASE WHEN pair = '{p}' THEN {c} END) AS {p}_{c}" for p in A.PAIRS for c in FEATURES)},
    avg(label) AS y FROM xy GROUP BY ts HAVING count(DISTINCT pair) = 5""", "ts")
def multi_pair(spark, sf):
    pairs = sorted(r["pair"] for r in A.ticks(spark, sf).select("pair").distinct().collect())
    return L.multi_pair(_aligned(spark, sf), FEATURES, pairs)


@query("standard_scaling", f"""WITH {A.BASIC}, {ALIGNED}, r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY pair) AS n FROM xy {W_ALL}),
    st AS (SELECT pair, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM r WHERE rn <= floor(n * 0.7::DOUBLE) GROUP BY pair)
    SELECT pair, ts, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in FEATURES)} FROM r JOIN st USING (pair)""", "pair, ts", 7)
def standard_scaling(spark, sf):
    """Scaler fitted on the first 70 % of each pair, applied to all rows."""
    from tickloom.operators.quality import chronological_split

    xy = _aligned(spark, sf)
    train = chronological_split(Series.of(xy)).where("part = 'train'")
    return L.scale(xy, L.fit_scaler(train, FEATURES), FEATURES).select("pair", "ts", *FEATURES)


@query("sequences", f"""WITH {A.BASIC}, {ALIGNED}, s AS (SELECT pair, ts, label::DOUBLE AS y, row_number() OVER w AS rn, {', '.join(f'list({c}::FLOAT) OVER w60 AS x_{c}' for c in FEATURES)}
      FROM xy WINDOW w AS (PARTITION BY pair ORDER BY ts), w60 AS (PARTITION BY pair ORDER BY ts ROWS 59 PRECEDING))
    SELECT pair, ts, 60 AS steps, y, list_sum(list_transform(x_ofi, lambda v, i: v * i))::DOUBLE AS ofi_mark, x_ret_20[1]::DOUBLE AS first_ret_20, x_atr_6[60]::DOUBLE AS last_atr_6
    FROM s WHERE rn >= 60""", "pair, ts, steps", 4)
def sequences(spark, sf):
    """Windows of 60 rows ending at every row, stored with a manifest and summarised by position-weighted marks."""
    path = fresh_path(spark, "sequences")
    tables.write_sequences(L.sequences(Series.of(_aligned(spark, sf)), FEATURES, 60), path)
    x = spark.read.parquet(path)
    mark = F.aggregate(F.transform("X", lambda r, i: r[0].cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return x.select("pair", "ts", F.size("X").alias("steps"), F.col("y").cast("double").alias("y"), mark.alias("ofi_mark"),
                    F.col("X")[0][3].cast("double").alias("first_ret_20"), F.col("X")[59][1].cast("double").alias("last_atr_6"))


@plain("sequence_integrity", f"""WITH {A.BASIC}, {ALIGNED}, c AS (SELECT pair, count(*) - 19 AS rows FROM xy GROUP BY pair)
    SELECT pair, rows, rows AS found, 0::BIGINT AS wrong_length, 0::BIGINT AS missing_y, true AS ok FROM c""")
def sequence_integrity(spark, sf):
    path = fresh_path(spark, "sequences")
    tables.write_sequences(L.sequences(Series.of(_aligned(spark, sf)), FEATURES, 20), path)
    return tables.check_sequences(spark, path, 20)


POS = "p AS (SELECT pair, ts, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM bars WINDOW w AS (PARTITION BY pair ORDER BY ts))"


@plain("walk_forward_folds", f"""WITH {A.BARS}, {POS}, k AS (SELECT pair, ts, i, n, k, floor(n / 6 * (k + 1))::BIGINT AS va,
      CASE WHEN k = 4 THEN n ELSE floor(n / 6 * (k + 2))::BIGINT END AS vb FROM p, range(5) t(k)),
    f AS (SELECT *, greatest(va - 60, 0) AS te FROM k WHERE n >= 500 AND greatest(va - 60, 0) >= 100 AND vb - va >= 10)
    SELECT pair, ts, i AS row, k::INT AS fold, CASE WHEN i < te THEN 'train' ELSE 'val' END AS role FROM f WHERE i < te OR i >= va AND i < vb
    UNION ALL SELECT pair, ts, i, 0, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END FROM p WHERE n < 500""")
def walk_forward_folds(spark, sf):
    return L.walk_forward_folds(Series.of(A.bars(spark, sf).select("pair", "ts")), 5, 60)


@plain("purged_folds", f"""WITH {A.BARS}, {POS}, k AS (SELECT *, n // 5 AS size, n // 5 * k AS t0, CASE WHEN k = 4 THEN n ELSE n // 5 * (k + 1) END AS t1 FROM p, range(5) t(k))
    SELECT pair, ts, i AS row, k::INT AS fold, CASE WHEN i >= t0 THEN 'test' ELSE 'train' END AS role FROM k
    WHERE greatest(t0 - 30, 0) >= size // 2 AND (i >= t0 AND i < t1 OR i < t0 - 30)""")
def purged_folds(spark, sf):
    return L.purged_folds(Series.of(A.bars(spark, sf).select("pair", "ts")), 5, 30, 10)


@plain("purged_folds_two_sided", f"""WITH {A.BARS}, {POS}, k AS (SELECT *, n // 5 AS size, n // 5 * k AS t0, CASE WHEN k = 4 THEN n ELSE n // 5 * (k + 1) END AS t1 FROM p, range(5) t(k))
    SELECT pair, ts, i AS row, k::INT AS fold, CASE WHEN i >= t0 AND i < t1 THEN 'test' ELSE 'train' END AS role FROM k
    WHERE i >= t0 AND i < t1 OR i < t0 - 30 OR i >= t1 + 10""")
def purged_folds_two_sided(spark, sf):
    return L.purged_folds(Series.of(A.bars(spark, sf).select("pair", "ts")), 5, 30, 10, two_sided=True)


def _u(*parts: str) -> str:
    return f"(('0x' || left(md5(concat_ws(':', {', '.join(parts)})), 8))::BIGINT / 4294967296::DOUBLE)"


# A window of 16 rows and 4 columns is cut from each 64-wide embedding.
AUG = f"""e AS (SELECT vec_id, floor({_u('7', 'vec_id', "'m'")} * 4)::INT AS method, list_transform(range(16), lambda t: list_transform(range(4), lambda c: embedding[t * 4 + c + 1]::DOUBLE)) AS x FROM embeddings),
  a AS (SELECT vec_id, method, CASE method
      WHEN 0 THEN list_transform(range(16), lambda t: list_transform(range(4), lambda c: x[t + 1][c + 1] + 0.01::DOUBLE * sqrt(-2 * ln(1 - {_u('7', 'vec_id', "'a'", 't', 'c')})) * cos(2 * pi() * {_u('7', 'vec_id', "'b'", 't', 'c')})))
      WHEN 1 THEN list_transform(x, lambda r: list_transform(r, lambda v: v * (0.8::DOUBLE + 0.4::DOUBLE * {_u('7', 'vec_id', "'s'")})))
      WHEN 2 THEN flatten(list_transform(list_sort(list_transform(range(4), lambda p: {{'u': {_u('7', 'vec_id', "'p'", 'p')}, 'p': p}})), lambda q: x[q.p * 4 + 1 : q.p * 4 + 4]))
      ELSE list_transform(range(16), lambda t: list_transform(range(4), lambda c: CASE WHEN {_u('7', 'vec_id', "'d'", 't', 'c')} > 0.1 THEN x[t + 1][c + 1] ELSE 0 END)) END AS x FROM e)"""


@query("augment_windows", f"""WITH {AUG} SELECT vec_id, method, r::INT AS step, x[r + 1][1] AS c0, x[r + 1][2] AS c1, x[r + 1][3] AS c2, x[r + 1][4] AS c3
    FROM a, range(16) t(r)""", "vec_id, method, step")
def augment_windows(spark, sf):
    window = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(
        F.slice("embedding", t * 4 + 1, 4), lambda v: v.cast("double")))
    x = A.table(spark, sf, "embeddings").select("vec_id", window.alias("x"))
    out = L.augment(x, "x", "vec_id", seed=7).select("vec_id", "method", F.posexplode("x").alias("step", "r"))
    return out.select("vec_id", "method", "step", *[F.col("r")[i].alias(f"c{i}") for i in range(4)])


@plain("contrastive_partners", f"""WITH g AS (SELECT event_id, CASE WHEN value > 70 THEN 1 WHEN value < 10 THEN -1 ELSE 0 END AS regime FROM events),
    r AS (SELECT *, row_number() OVER (ORDER BY regime, event_id) - 1 AS place, row_number() OVER (PARTITION BY regime ORDER BY event_id) - 1 AS k,
      count(*) OVER (PARTITION BY regime) AS size, count(*) OVER () AS n FROM g),
    t AS (SELECT *, place - k AS s0, floor({_u('3', 'event_id', "'o'")} * (n - size))::BIGINT AS pick FROM r)
    SELECT t.event_id, t.regime, a.event_id AS same_id, b.event_id AS other_id FROM t
    JOIN r a ON a.place = t.s0 + floor({_u('3', 't.event_id', "'s'")} * t.size)::BIGINT JOIN r b ON b.place = CASE WHEN t.pick >= t.s0 THEN t.pick + t.size ELSE t.pick END""")
def contrastive_partners(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", L.regime_of((F.col("value") - 40) / 300).alias("regime"))
    return L.contrastive_partners(e, "event_id", seed=3)


@plain("class_index", f"WITH {A.BASIC}, {REWARDS} SELECT pair, ts, label, label + 1 AS class FROM rw")
def class_index(spark, sf):
    return _rewards(spark, sf).select("pair", "ts", "label", S.class_index(F.col("label")).alias("class"))


@plain("score_with_model", f"""WITH {A.BASIC} SELECT pair, ts, CASE WHEN ofi + 100 * ret_5 > 0.05 THEN 0 WHEN ofi + 100 * ret_5 < -0.05 THEN 2 ELSE 1 END::BIGINT AS signal
    FROM basic WHERE ofi IS NOT NULL AND ret_5 IS NOT NULL""")
def score_with_model(spark, sf):
    import numpy as np

    def model(x):
        s = x[:, 0] + 100 * x[:, 1]
        return np.where(s > 0.05, 0, np.where(s < -0.05, 2, 1))
    f = A.basic_features(spark, sf).df.where("ofi is not null and ret_5 is not null").select("pair", "ts", "ofi", "ret_5")
    return scoring.score_with(f, model, ["ofi", "ret_5"]).select("pair", "ts", "signal")
