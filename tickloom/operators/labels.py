"""Forward-looking labels and the training-set shapes built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Carry, Series, Step, add
from tickloom.core.storage import lookup
from tickloom.functions.scalar import unit_hash


def _touch(path: str, hit) -> Column:
    """1-based position of the first price that satisfies ``hit``; 0 if none does."""
    return F.array_position(F.transform(path, hit), F.lit(True))


def _first(a: Column, b: Column) -> Column:
    """+1 when barrier a is met first (also on the same row), -1 when b is, 0 when neither."""
    return F.when((a > 0) & ((b == 0) | (a <= b)), 1).when(b > 0, -1).otherwise(0)


def _barriers(profit: float, stop: float, atr: str):
    long, short, range_ = F.col("ask_close"), F.col("bid_close"), F.col(atr)
    return {"tp_l": long + profit * range_, "sl_l": long - stop * range_,
            "tp_s": short - profit * range_, "sl_s": short + stop * range_}


def _touches(b: dict[str, Column]) -> dict[str, Column]:
    return {"_tpl": _touch("_path", lambda p: p >= b["tp_l"]), "_sll": _touch("_path", lambda p: p <= b["sl_l"]),
            "_tps": _touch("_path", lambda p: p <= b["tp_s"]), "_sls": _touch("_path", lambda p: p >= b["sl_s"])}


def triple_barrier(atr: str = "atr_6", horizon: int = 10, profit: float = 1.5, stop: float = 1.0,
                   skip_last: bool = False) -> Step:
    """First barrier met by the next ``horizon`` closes, for an entry at the ask and one at the bid.

    Rows without a full horizon get null labels. ``skip_last`` leaves the last full row unscanned.
    """
    def fn(f: DataFrame, w):
        ahead = F.collect_list("close").over(w.rowsBetween(1, horizon + 1))
        f = f.withColumn("_ahead", ahead).withColumn("_path", F.slice("_ahead", 1, horizon))
        f = f.withColumns(_touches(_barriers(profit, stop, atr)))
        full = F.size("_path") == horizon
        scanned = (F.size("_ahead") > horizon) if skip_last else F.lit(True)
        lo = F.when(scanned, _first(F.col("_tpl"), F.col("_sll"))).otherwise(0)
        so = F.when(scanned, _first(F.col("_tps"), F.col("_sls"))).otherwise(0)
        at = lambda o, tp, sl: F.when(o == 1, F.col(tp) - 1).when(o == -1, F.col(sl) - 1).otherwise(horizon)
        f = f.withColumns({"reward_long": F.when(full, lo), "reward_short": F.when(full, so),
                           "touch_long": F.when(full, at(lo, "_tpl", "_sll")).cast("int"),
                           "touch_short": F.when(full, at(so, "_tps", "_sls")).cast("int")})
        up, dn = F.col("reward_long") == 1, F.col("reward_short") == 1
        return f.withColumns({
            "reward": F.when(F.abs("reward_long") >= F.abs("reward_short"), F.col("reward_long"))
                       .otherwise(F.col("reward_short")),
            "label": F.when(~full, None)
                      .when(up & dn, F.when(F.col("touch_long") <= F.col("touch_short"), 1).otherwise(-1))
                      .when(up, 1).when(dn, -1).otherwise(0)}).drop("_ahead", "_path", "_tpl", "_sll", "_tps", "_sls")
    return Step(fn, after=horizon + 1)


def reward_labels(atr: str = "atr_6", horizon: int = 10, profit: float = 1.5, stop: float = 1.0,
                  cost_pips: float = 1.5, pip: float = 0.0001) -> Step:
    """Net pips of a long and a short entry closed at the first barrier or the horizon.

    The label says whether the better side pays more than the cost, not which side it is.
    """
    def fn(f: DataFrame, w):
        b = _barriers(profit, stop, atr)
        f = f.withColumn("_path", F.collect_list("close").over(w.rowsBetween(1, horizon)))
        f = f.withColumns(_touches(b))
        full = F.size("_path") == horizon
        last = F.get("_path", F.lit(horizon - 1))
        exit_of = lambda tp, sl, tpx, slx: (F.when(_first(F.col(tp), F.col(sl)) == 1, tpx)
                                            .when(_first(F.col(tp), F.col(sl)) == -1, slx).otherwise(last))
        long = (exit_of("_tpl", "_sll", b["tp_l"], b["sl_l"]) - F.col("ask_close")) / pip - cost_pips
        short = (F.col("bid_close") - exit_of("_tps", "_sls", b["tp_s"], b["sl_s"])) / pip - cost_pips
        f = f.withColumns({"reward_long": F.when(full, long), "reward_short": F.when(full, short)})
        rl, rs = F.col("reward_long"), F.col("reward_short")
        f = f.withColumn("reward", F.when(full, F.greatest(rl, rs)))
        r = F.col("reward")
        return f.withColumns({
            "label": F.when(full, F.when(r > cost_pips, 1).when(r < -cost_pips, -1).otherwise(0)),
            "optimal_side": F.when(full, F.when(rl > rs, "long").when(rs > rl, "short").otherwise("hold")),
        }).drop("_path", "_tpl", "_sll", "_tps", "_sls")
    return Step(fn, after=horizon)


def label_distribution(labels: DataFrame, by: Sequence[str] = ("pair",)) -> DataFrame:
    return labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))


def align(features: DataFrame, labels: DataFrame, keys: Sequence[str] = ("pair", "ts")) -> DataFrame:
    """Features with reward and label of the same pair and time; incomplete rows dropped."""
    return features.join(labels.select(*keys, "reward", "label"), list(keys)).dropna()


def class_weights(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n / (classes present * class count) for -1, 0, 1; 1.0 for a class that does not occur."""
    y = F.rint("label").cast("int")
    one = labels.where(y.isin(-1, 0, 1)).groupBy(*by).agg(
        *[F.count_if(y == c).alias(f"_n{c + 1}") for c in (-1, 0, 1)])
    total = F.col("_n0") + F.col("_n1") + F.col("_n2")
    present = sum(F.when(F.col(f"_n{i}") > 0, 1).otherwise(0) for i in range(3))
    rows = F.array(*[F.struct(F.lit(i - 1).alias("label"),
                              F.when(F.col(f"_n{i}") > 0, total / (present * F.col(f"_n{i}"))).otherwise(1.0)
                              .alias("weight")) for i in range(3)])
    return one.select(*by, F.inline(rows))


def fit_scaler(train: DataFrame, columns: Sequence[str], by: Sequence[str] = ("pair",)) -> DataFrame:
    """Mean and population deviation of each column per key, one row per key."""
    return train.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                                  *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str], by: Sequence[str] = ("pair",)) -> DataFrame:
    """Standardise with a fitted scaler; a constant column is only centred."""
    unit = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return (lookup(df, scaler, by)
              .withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / unit(c) for c in columns})
              .drop(*[f"_{p}_{c}" for c in columns for p in "ms"]))


def sequences(s: Series, columns: Sequence[str], length: int, target: str = "label", stride: int = 1) -> DataFrame:
    """Windows of ``length`` rows labelled by their last row, one every ``stride`` rows.

    Wide rows exist only in the output, so a sink should follow directly.
    """
    def fn(f: DataFrame, w):
        row = F.array(*[F.col(c).cast("float") for c in columns])
        return f.withColumn("X", F.collect_list(row).over(w.rowsBetween(-(length - 1), 0)))
    s = s.indexed("_i").apply(Step(fn, before=length - 1))
    return (s.df.where((F.col("_i") >= length) & (F.pmod(F.col("_i") - length, F.lit(stride)) == 0))
                .select(*s.keys, *s.order, "X", F.col(target).cast("float").alias("y")))


def multi_pair(features: DataFrame, columns: Sequence[str], pairs: Sequence[str]) -> DataFrame:
    """Features of all pairs side by side at the times every pair has, with the mean label."""
    cells = [F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{p}_{c}") for p in pairs for c in columns]
    return (features.where(F.col("pair").isin(*pairs)).groupBy("ts")
                    .agg(*cells, F.avg("label").alias("y"), F.count_distinct("pair").alias("_p"))
                    .where(F.col("_p") == len(pairs)).drop("_p"))


def _positions(s: Series) -> DataFrame:
    sizes = s.frame.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    return lookup(s.indexed("_rn0").df, sizes, s.keys).withColumn("_i", F.col("_rn0") - 1).drop("_rn0")


def walk_forward_folds(s: Series, folds: int = 5, embargo: int = 60, val_split: float = 0.2,
                       min_train: int = 100, min_val: int = 10) -> DataFrame:
    """Expanding training window, embargo, next slice for validation: one row per (fold, role, row).

    Short series, or ones where no fold is large enough, get a single split as fold 0.
    """
    n, i = F.col("_n"), F.col("_i")
    edge = lambda k: n if k == folds + 1 else F.floor(F.lit(float(k)) * (n / F.lit(folds + 1)))
    options, usable = [], []
    for k in range(folds):
        va, vb = edge(k + 1), edge(k + 2)
        train_end = F.greatest(va - embargo, F.lit(0))
        ok = (train_end >= min_train) & (vb - va >= min_val)
        usable.append(ok)
        role = F.when(i < train_end, "train").when((i >= va) & (i < vb), "val")
        options.append(F.when(ok & role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    any_ok = usable[0]
    for u in usable[1:]:
        any_ok = any_ok | u
    short = n < max(embargo + folds * 2, 500)
    cut = F.floor(n * F.when(short, 1 - val_split).otherwise(0.8))
    single = F.array(F.struct(F.lit(0).alias("fold"), F.when(i < cut, "train").otherwise("val").alias("role")))
    picks = F.when(short | ~any_ok, single).otherwise(F.array_compact(F.array(*options)))
    return _positions(s).select(*s.keys, *s.order, F.col("_i").alias("row"), F.inline(picks))


def purged_folds(s: Series, splits: int = 5, purge: int = 30, embargo: int = 10, two_sided: bool = False) -> DataFrame:
    """Test slices with a purge before and an embargo after; training rows precede the slice.

    ``two_sided`` also trains on rows after the embargo.
    """
    n, i = F.col("_n"), F.col("_i")
    size = F.floor(n / splits)
    options = []
    for k in range(splits):
        start = size * k
        stop = n if k == splits - 1 else start + size
        before = F.greatest(start - purge, F.lit(0))
        trained = before + (F.greatest(n - stop - embargo, F.lit(0)) if two_sided else 0)
        in_train = (i < before) | ((i >= stop + embargo) if two_sided else F.lit(False))
        role = F.when((i >= start) & (i < stop), "test").when(in_train, "train")
        ok = trained >= F.floor(size / 2)
        options.append(F.when(ok & role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    return _positions(s).select(*s.keys, *s.order, F.col("_i").alias("row"),
                                F.inline(F.array_compact(F.array(*options))))


def augment(df: DataFrame, x: str, row_id: str, seed: int = 0, jitter: float = 0.01,
            scale_range: tuple[float, float] = (0.8, 1.2), segments: int = 4, dropout: float = 0.1) -> DataFrame:
    """One of jitter, scale, segment permutation or dropout per window, fixed by seed and row id."""
    s, rid = F.lit(seed), F.col(row_id)
    u = lambda *k: unit_hash(s, rid, *[F.lit(p) if isinstance(p, str) else p for p in k])
    each = lambda fn: F.transform(x, lambda row, t: F.transform(row, lambda v, c: fn(v, t, c)))
    lo, hi = scale_range

    def noisy(v, t, c):
        radius = F.sqrt(-2 * F.ln(1 - u("a", t, c)))
        return v + jitter * radius * F.cos(2 * math.pi * u("b", t, c))

    factor = lo + (hi - lo) * u("s")
    length = F.size(x)
    seg = F.greatest(F.floor(length / segments).cast("int"), F.lit(1))
    ids = F.sequence(F.lit(0), F.ceil(length / seg).cast("int") - 1)
    ranked = F.array_sort(F.transform(ids, lambda p: F.struct(u("p", p).alias("u"), p.alias("p"))))
    permuted = F.flatten(F.transform(ranked, lambda q: F.slice(F.col(x), q.p * seg + 1, seg)))
    method = F.floor(u("m") * 4).cast("int")
    return df.withColumn("method", method).withColumn(
        x, F.when(F.col("method") == 0, each(noisy))
            .when(F.col("method") == 1, each(lambda v, t, c: v * factor))
            .when(F.col("method") == 2, permuted)
            .otherwise(each(lambda v, t, c: F.when(u("d", t, c) > dropout, v).otherwise(0.0 * v))))


def regime_of(y: Column, edge: float = 0.1) -> Column:
    return F.when(y > edge, 1).when(y < -edge, -1).otherwise(0)


def contrastive_partners(df: DataFrame, row_id: str, regime: str = "regime", seed: int = 0) -> DataFrame:
    """A hashed partner from the same regime and one from another, found by position with equi-joins.

    With a single regime the other partner is the row itself.
    """
    s = Series.of(df, [regime], [row_id]).indexed("_rank")
    sizes = df.groupBy(regime).agg(F.count(F.lit(1)).alias("_size"))
    offsets = Series.of(sizes, [], [regime]).apply(
        Carry({"_upto": ("sum", F.col("_size"))}), Carry({"_from": ("sum", F.col("_size"))}, reverse=True)).df
    offsets = offsets.withColumn("_all", F.col("_upto") + F.col("_from") - F.col("_size")).drop("_from")
    placed = lookup(s.df, offsets, [regime])
    start = F.col("_upto") - F.col("_size")
    others = F.col("_all") - F.col("_size")
    pick = F.floor(unit_hash(F.lit(seed), F.col(row_id), F.lit("o")) * others)
    placed = placed.withColumns({
        "_place": start + F.col("_rank") - 1,
        "_same": start + F.floor(unit_hash(F.lit(seed), F.col(row_id), F.lit("s")) * F.col("_size")),
        "_other": F.when(others == 0, start + F.col("_rank") - 1)
                   .when(pick >= start, pick + F.col("_size")).otherwise(pick)})
    book = placed.select("_place", F.col(row_id).alias("_id"))
    same = book.select(F.col("_place").alias("_same"), F.col("_id").alias("same_id"))
    other = book.select(F.col("_place").alias("_other"), F.col("_id").alias("other_id"))
    return placed.join(same, "_same").join(other, "_other").select(*df.columns, "same_id", "other_id")
