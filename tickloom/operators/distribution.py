"""Distribution drift, resampling and slippage fits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.core.series import Carry, Series
from tickloom.core.storage import landed, lookup
from tickloom.functions.scalar import clip
from tickloom.operators.performance import compounded, equity_curve, sharpe


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long form: one row per key and feature."""
    return df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], "feature", "value")


# --- drift ------------------------------------------------------------------------

def psi(baseline: DataFrame, live: DataFrame, keys: Sequence[str], bins: int = 10, density: bool = True,
        eps: float = 1e-6) -> DataFrame:
    """Stability index per key of ``value`` over equal-width bins of the baseline range.

    Density based by default; ``density=False`` uses proportions. Live values outside
    the baseline range are not counted. Both sides are counted before they meet.
    """
    keys = list(keys)
    edges = baseline.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    both = (baseline.select(*keys, "value", F.lit(1).alias("_b"))
            .unionByName(live.select(*keys, "value", F.lit(0).alias("_b"))).where("value is not null"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1))
    counted = (lookup(both, edges, keys).where("value between _lo and _hi and _hi > _lo")
               .groupBy(*keys, at.alias("_bin"), "_lo", "_hi")
               .agg(F.sum("_b").alias("_e"), F.sum(1 - F.col("_b")).alias("_a")))
    grid = counted.groupBy(*keys, "_lo", "_hi").agg(
        F.sum("_e").alias("_ne"), F.sum("_a").alias("_na"),
        F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("_e", "_a").alias("c")))).alias("_m"))
    scale = width if density else F.lit(1.0)

    def share(n, total):
        return F.coalesce(F.try_divide(n, total * scale), F.lit(0.0)) + eps

    def term(i):
        c = F.try_element_at("_m", i)
        e, a = share(F.coalesce(c["_e"], F.lit(0)), F.col("_ne")), share(F.coalesce(c["_a"], F.lit(0)), F.col("_na"))
        return (a - e) * F.ln(a / e)
    ids = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    return grid.select(*keys, F.aggregate(F.transform(ids, term), F.lit(0.0), lambda s, x: s + x).alias("psi"))


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """P(K > x) of the Kolmogorov distribution by its alternating series."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(
        k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.04, 1.0).otherwise(clip(2 * total, 0.0, 1.0))


def ks_two_sample(baseline: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest distance between two empirical distributions per key, with its asymptotic p-value.

    Equal values are counted together first; the running counts then work on distinct values.
    """
    keys = list(keys)
    both = (baseline.select(*keys, "value", F.lit(1).alias("_b"))
            .unionByName(live.select(*keys, "value", F.lit(0).alias("_b"))).where("value is not null"))
    counts = both.groupBy(*keys, "value").agg(F.sum("_b").alias("_x"), F.sum(1 - F.col("_b")).alias("_y"))
    sizes = counts.groupBy(*keys).agg(F.sum("_x").alias("n_baseline"), F.sum("_y").alias("n_live"))
    run = Series.of(counts, keys, ["value"]).apply(
        Carry({"_cx": ("sum", F.col("_x")), "_cy": ("sum", F.col("_y"))})).df
    gap = F.abs(F.col("_cx") / F.col("n_baseline") - F.col("_cy") / F.col("n_live"))
    out = (lookup(run, sizes.where("n_baseline > 0 and n_live > 0"), keys)
              .groupBy(*keys, "n_baseline", "n_live").agg(F.max(gap).alias("ks")))
    root = F.sqrt(F.col("n_baseline") * F.col("n_live") / (F.col("n_baseline") + F.col("n_live")))
    return out.withColumn("p_value", kolmogorov_tail(root * F.col("ks")))


@dataclass(frozen=True)
class DriftRule:
    psi: float = 0.2
    ks_p: float = 0.05
    sharpe_drop: float = 0.5
    min_returns: int = 30


def drift_verdict(psi_scores: DataFrame, ks: DataFrame, baseline_ret: DataFrame, live_ret: DataFrame,
                  keys: Sequence[str], rule: DriftRule = DriftRule()) -> DataFrame:
    """Flags and reasons per key from the stability index, the distance test and the Sharpe drop."""
    ratio = lambda c: F.avg(c) / (F.stddev_pop(c) + 1e-9) * math.sqrt(252)
    p = psi_scores.groupBy(*keys).agg(F.max("psi").alias("psi_max"))
    k = ks.groupBy(*keys).agg(F.min("p_value").alias("ks_min_pvalue"))
    b = baseline_ret.groupBy(*keys).agg(ratio("ret").alias("_base"))
    v = live_ret.groupBy(*keys).agg(ratio("ret").alias("_live"), F.count("ret").alias("_n"))
    drop = F.when(F.col("_n") > rule.min_returns, F.col("_base") - F.col("_live")).otherwise(0.0)
    out = p.join(k, list(keys)).join(b, list(keys)).join(v, list(keys)).withColumn("sharpe_drop", drop)
    reasons = F.array_compact(F.array(
        F.when(F.col("sharpe_drop") > rule.sharpe_drop, F.lit("sharpe_drop")),
        F.when(F.col("psi_max") > rule.psi, F.lit("psi")),
        F.when(F.col("ks_min_pvalue") < rule.ks_p, F.lit("ks"))))
    return (out.withColumn("reasons", reasons).withColumn("drift_detected", F.size("reasons") > 0)
               .drop("_base", "_live", "_n"))


# --- Monte Carlo ------------------------------------------------------------------

def _draw(seed: int) -> Column:
    """The random number of a trade (_i) in a simulation (sim)."""
    return F.xxhash64(F.lit(seed).cast("long"), F.col("sim").cast("long"), F.col("_i").cast("long"))


# Trades of a piece, as a power of two: what is packed, hashed and sorted at once.
PIECE_BITS = 16
# Trades that are hashed at once (their numbers stay in a core's cache), that are counted into buckets at once, and that
# are sorted at once; bytes of the buckets' numbers kept for several simulations at once.
HASHED, COUNTED, SORTED, KEPT_BYTES = 1 << 15, 1 << 19, 1 << 21, 100_000_000
# Shape of the drawn values that run side by side: a row for each step, a column for each stretch of the path.
STEPS, STRETCHES = 32, 4096
# Keys of fewer trades run through their whole paths.
FEW = 4096

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rounds(x: np.ndarray) -> np.ndarray:
    """The part of XXH64 of 64-bit numbers that does not depend on the hash so far; ``x`` is overwritten."""
    x *= P2
    low = x >> np.uint64(33)
    x <<= np.uint64(31)
    x |= low
    x *= P1
    return x


def _mixed(rounds: np.ndarray, seed: np.ndarray, out: np.ndarray, other: np.ndarray) -> np.ndarray:
    """XXH64 into ``out`` from ``_rounds`` and the hash so far; ``other`` is scratch of the same length."""
    np.bitwise_xor(rounds, seed + P5 + np.uint64(8), out=out)
    np.right_shift(out, np.uint64(37), out=other)
    out <<= np.uint64(27)
    out |= other
    out *= P1
    out += P4
    for bits, prime in ((33, P2), (29, P3)):
        np.right_shift(out, np.uint64(bits), out=other)
        out ^= other
        out *= prime
    np.right_shift(out, np.uint64(32), out=other)
    out ^= other
    return out


def hashed_longs(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit numbers, as ``xxhash64`` computes it column by column; ``seed`` holds the hash so far."""
    rounds = _rounds(x.copy())
    return _mixed(rounds, seed, np.empty_like(rounds), np.empty_like(rounds))


def _begins(seed: int, sims: Sequence[int]) -> list[np.ndarray]:
    """The hash of seed and simulation, for each simulation."""
    base = hashed_longs(np.array([seed], np.int64).view(np.uint64), np.array([42], np.uint64))
    return [hashed_longs(np.array([sim], np.uint64), base) for sim in sims]


def _ratio(mean: float, dev: float, start: float, annual: float, compound: bool) -> float:
    if compound:
        return mean / dev * math.sqrt(annual) if dev > 0 else 0.0
    return mean / start / (dev / start + 1e-9) * math.sqrt(annual)


def _path_figures(parts: Iterable[np.ndarray], start: float, annual: float, compound: bool) -> tuple[float, float, float]:
    """Sharpe, largest drawdown and total return of one path, given piece by piece in order, as ``simulate`` has them."""
    n, mean, square, total, negative, zero = 0, 0.0, 0.0, 0.0, 0, False
    peak, worst = -math.inf if compound else start, None
    for pnl in parts:
        k, step = len(pnl), pnl.mean() - mean
        square += pnl.var() * k + step * step * n * k / (n + k)
        mean, n = mean + step * k / (n + k), n + k
        if compound:
            g = 1 + pnl
            gone, below = np.maximum.accumulate(g == 0) | zero, negative + np.cumsum(g < 0)
            run = total + np.cumsum(np.log(np.abs(np.where(g == 0, 1.0, g))))
            eq = np.where(gone, 0.0, 1.0 - 2.0 * (below % 2)) * np.exp(run)
            zero, negative = gone[-1], below[-1]
        else:
            run = total + np.cumsum(pnl)
            eq = start + run
        tops = np.maximum(np.maximum.accumulate(eq), peak)
        total, peak = run[-1], tops[-1]
        if compound:
            fall = eq[tops != 0] / tops[tops != 0] - 1
            if len(fall):
                worst = fall.min() if worst is None else np.minimum(worst, fall.min())
        else:
            fall = ((tops - eq) / tops).max()
            worst = fall if worst is None else np.maximum(worst, fall)
    return _ratio(mean, math.sqrt(square / n), start, annual, compound), worst, eq[-1] - 1 if compound else total / start


def _shuffled(pnl: np.ndarray, drawn: Callable[[int, int], np.ndarray]) -> Iterator[np.ndarray]:
    """The values by ascending signed random number, a range of the numbers at a time, so that only ranges are held and sorted."""
    n, ranges = len(pnl), -(-len(pnl) // SORTED)
    if n <= 1 << PIECE_BITS:
        yield pnl[np.argsort(drawn(0, n).view(np.int64), kind="stable")]
        return
    for r in range(ranges):
        first, last = np.uint64((r << 64) // ranges), np.uint64(((r + 1 << 64) // ranges) - 1)
        keys, values = [], []
        for lo in range(0, n, 1 << PIECE_BITS):
            u = drawn(lo, min(n, lo + (1 << PIECE_BITS))) ^ np.uint64(1 << 63)
            own = np.flatnonzero((u >= first) & (u <= last))
            keys.append(u[own])
            values.append(pnl[lo + own])
        order = np.argsort(np.concatenate(keys), kind="stable")
        if len(order):
            yield np.concatenate(values)[order]


def _drawn_again(pnl: np.ndarray, drawn: Callable[[int, int], np.ndarray]) -> Iterator[np.ndarray]:
    """As many values as there are, drawn with replacement."""
    n = len(pnl)
    for lo in range(0, n, 1 << PIECE_BITS):
        u = drawn(lo, min(n, lo + (1 << PIECE_BITS)))
        yield pnl[np.floor((u >> np.uint64(11)) / float(1 << 53) * n).astype(np.int64)]


def _moments(pnl: np.ndarray) -> tuple[float, float]:
    """Mean and population deviation, piece by piece."""
    n, mean, square = 0, 0.0, 0.0
    for lo in range(0, len(pnl), COUNTED):
        part = pnl[lo : lo + COUNTED]
        k, step = len(part), part.mean() - mean
        square += part.var() * k + step * step * n * k / (n + k)
        mean, n = mean + step * k / (n + k), n + k
    return mean, math.sqrt(square / n)


def _bucket_bits(n: int) -> int:
    return min(16, max(1, n.bit_length() - 6))


def _counted(pnl: np.ndarray, begins: Sequence[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each simulation: the bucket of each trade, by the first bits of its random number, and by bucket the sum of the values and of their sizes."""
    n, sign = len(pnl), np.uint64(1 << (bits - 1))
    buckets = np.empty((len(begins), n), np.uint16)
    sums, sizes = np.zeros((len(begins), 1 << bits)), np.zeros((len(begins), 1 << bits))
    out, other, at = np.empty(HASHED, np.uint64), np.empty(HASHED, np.uint64), np.empty(COUNTED, np.int64)
    for lo in range(0, n, COUNTED):
        hi = min(n, lo + COUNTED)
        rounds, size = np.empty(hi - lo, np.uint64), np.abs(pnl[lo:hi])
        for a in range(lo, hi, HASHED):
            b = min(hi, a + HASHED)
            rounds[a - lo : b - lo] = _rounds(np.arange(a + 1, b + 1, dtype=np.uint64))
        for k, begin in enumerate(begins):
            for a in range(0, hi - lo, HASHED):
                b = min(hi - lo, a + HASHED)
                u = _mixed(rounds[a:b], begin, out[: b - a], other[: b - a])
                np.right_shift(u, np.uint64(64 - bits), out=u)
                np.bitwise_xor(u, sign, out=at[a:b].view(np.uint64))
            buckets[k, lo:hi] = at[: hi - lo]
            sums[k] += np.bincount(at[: hi - lo], weights=pnl[lo:hi], minlength=1 << bits)
            sizes[k] += np.bincount(at[: hi - lo], weights=size, minlength=1 << bits)
    return buckets, sums, sizes


def _worst_fall(pnl: np.ndarray, begin: np.ndarray, buckets: np.ndarray, sums: np.ndarray, sizes: np.ndarray, start: float) -> float:
    """Largest drawdown of the values in the order of their random numbers, exactly, sorting only what can decide it.

    The equity between two buckets is known from their sums, and within a bucket it stays between its start less the
    losses and its start plus the gains. Buckets whose lowest point cannot reach the largest fall between buckets, and
    whose highest point cannot be the peak of one that can, are passed over; all others are put in order.
    """
    bits = len(sums).bit_length() - 1
    ends = start + np.cumsum(sums)
    begun = np.concatenate([[start], ends[:-1]])
    low, high = begun - (sizes - sums) / 2, begun + (sizes + sums) / 2
    slack = 1e-9 * (start + np.abs(ends).max() + sizes.max())
    low, high = low - slack, high + slack
    least = np.maximum.accumulate(begun)
    most = np.maximum.accumulate(high)
    top = np.maximum(least, ends)
    known = max(0.0, (1 - np.maximum(ends / top, ends / most)).max() - 1e-9)
    reach = 1 - np.minimum(low / most, low / least)
    deep = (sizes > 0) & (reach >= known)
    at = np.flatnonzero(deep)
    if not len(at):
        return 0.0
    behind = np.searchsorted(at, np.arange(len(sums)), side="right")
    limit = np.append(least[at], np.inf)[behind]
    wanted = deep | ((sizes > 0) & (high >= limit))
    chosen, each = np.flatnonzero(wanted), max(1, SORTED * len(sums) // len(pnl))
    worst, peak = 0.0, start
    for lo in range(0, len(chosen), each):
        some = np.zeros(len(sums), bool)
        some[chosen[lo : lo + each]] = True
        index = np.concatenate([a + np.flatnonzero(some[buckets[a : a + COUNTED]]) for a in range(0, len(pnl), COUNTED)])
        u = hashed_longs((index + 1).astype(np.uint64), begin) ^ np.uint64(1 << 63)
        order = np.argsort(u)
        if (u[order[1:]] == u[order[:-1]]).any():
            order = np.argsort(u, kind="stable")
        own, values = buckets[index[order]], pnl[index[order]]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        run = np.cumsum(values)
        equity = run + np.repeat(begun[own[first]] - (run[first] - values[first]), np.diff(np.append(first, len(own))))
        tops = np.maximum(np.maximum.accumulate(equity), peak)
        peak = tops[-1]
        tops = np.maximum(tops, least[own])
        worst = max(worst, ((tops - equity) / tops)[deep[own]].max(initial=0.0))
    return worst


def _shuffled_figures(pnl: np.ndarray, begins: Sequence[np.ndarray], start: float, annual: float) -> Iterator[tuple[float, float, float]]:
    """Figures of reordered values; mean, deviation and sum do not depend on the order."""
    mean, dev = _moments(pnl)
    ratio, total, bits = _ratio(mean, dev, start, annual, False), mean * len(pnl) / start, _bucket_bits(len(pnl))
    together = int(max(1, min(16, KEPT_BYTES // (2 * len(pnl)))))
    for lo in range(0, len(begins), together):
        some = begins[lo : lo + together]
        for begin, *counted in zip(some, *_counted(pnl, some, bits), strict=True):
            yield ratio, _worst_fall(pnl, begin, *counted, start), total


def _drawn_figures(pnl: np.ndarray, begins: Sequence[np.ndarray], annual: float) -> Iterator[tuple[float, float, float]]:
    """Figures of values drawn with replacement and compounded, all of them above -1.

    In logarithms a fall is a difference, so stretches of values run side by side, each for its sum, its highest and
    lowest point and its largest fall, and meet in order afterwards.
    """
    n = len(pnl)
    side = min(STRETCHES, -(-n // STEPS))
    whole = STEPS * side
    # Deviations are summed from a value near the middle, so that draws of one value have none.
    few = pnl[:: -(-n // FEW)]
    mid = np.partition(few, len(few) // 2)[len(few) // 2]
    scale = np.float64(n) * 2.0**-53
    out, other = np.empty(whole, np.uint64), np.empty(whole, np.uint64)
    drawn, spread = np.empty((STEPS, side)), np.empty((STEPS, side))
    # The trade of each place: stretches are columns, so one step of all of them lies together.
    places = (np.arange(STEPS, dtype=np.uint64)[:, None] + np.arange(side, dtype=np.uint64)[None, :] * np.uint64(STEPS)).ravel()
    carried = [[0.0, -math.inf, 0.0, 0.0, 0.0] for _ in begins]
    for lo in range(0, n, whole):
        rounds = _rounds(places + np.uint64(lo + 1))
        left = (places >= np.uint64(n - lo)).reshape(STEPS, side) if n - lo < whole else None
        for begin, state in zip(begins, carried, strict=True):
            for a in range(0, whole, HASHED):
                u = _mixed(rounds[a : a + HASHED], begin, out[a : a + HASHED], other[a : a + HASHED])
                u >>= np.uint64(11)
                x = other[a : a + HASHED].view(np.float64)
                np.multiply(u.view(np.int64), scale, out=x)
                np.take(pnl, x.astype(np.int64), out=drawn.reshape(-1)[a : a + HASHED], mode="clip")
            np.subtract(drawn, mid, out=spread)
            np.log1p(drawn, out=drawn)
            if left is not None:
                spread[left] = drawn[left] = 0.0
            base, peak, worst, shift, square = state
            flat = spread.reshape(-1)
            shift, square = shift + flat.sum(), square + flat @ flat
            run = drawn[0].copy()
            top, bottom, fall, gap = run.copy(), run.copy(), np.zeros(side), np.empty(side)
            for step in drawn[1:]:
                run += step
                np.maximum(top, run, out=top)
                np.minimum(bottom, run, out=bottom)
                np.subtract(run, top, out=gap)
                np.minimum(fall, gap, out=fall)
            ends = base + np.cumsum(run)
            begun = np.concatenate([[base], ends[:-1]])
            tops = np.maximum(np.maximum.accumulate(begun + top), peak)
            before = np.concatenate([[peak], tops[:-1]])
            worst = min(worst, fall.min(), (begun + bottom - before)[np.isfinite(before)].min(initial=0.0))
            state[:] = ends[-1], tops[-1], worst, shift, square
    for total, _, worst, shift, square in carried:
        dev = math.sqrt(max(square / n - (shift / n) ** 2, 0.0))
        with np.errstate(over="ignore"):
            yield _ratio(mid + shift / n, dev, 1.0, annual, True), math.expm1(worst), float(np.expm1(total))


def _figures(pnl: np.ndarray, sims: Sequence[int], method: str, seed: int, start: float, annual: float, compound: bool) -> list[tuple]:
    """(sim, Sharpe, largest drawdown, total return) of each simulation of one key."""
    begins, many = _begins(seed, sims), len(pnl) > FEW and bool(np.isfinite(pnl.sum()))
    if many and method == "shuffle" and not compound and start > 0:
        found = _shuffled_figures(pnl, begins, start, annual)
    elif many and method != "shuffle" and compound and pnl.min() > -1:
        found = _drawn_figures(pnl, begins, annual)
    else:
        def path(begin):
            drawn = lambda lo, hi: hashed_longs(np.arange(lo + 1, hi + 1, dtype=np.uint64), begin)
            return _shuffled(pnl, drawn) if method == "shuffle" else _drawn_again(pnl, drawn)
        found = (_path_figures(path(begin), start, annual, compound) for begin in begins)
    return [(sim, *figures) for sim, figures in zip(sims, found, strict=True)]


def _packed(batches: Iterator[pa.RecordBatch], keys: Sequence[str], value: str) -> Iterator[pa.RecordBatch]:
    """Values of sorted rows as plain numbers, in pieces of one key each."""
    def piece():
        values = np.concatenate(held)
        return pa.RecordBatch.from_arrays([*own, pa.array([len(values)], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=[*keys, "_count", "_values"])

    own, held, n = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, values = [batch.column(batch.schema.get_field_index(k)) for k in keys], batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
        turns = np.zeros(batch.num_rows, bool)
        for c in columns:
            turns[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(turns), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            now = [c.slice(lo, 1) for c in columns]
            if held and (n >= 1 << PIECE_BITS or any(a != b for a, b in zip(own, now))):
                yield piece()
                held, n = [], 0
            own, held, n = now, [*held, values[lo:hi]], n + hi - lo
    if held:
        yield piece()


def simulations(trades: DataFrame, keys: Sequence[str], trade_id: str, value: str, n_sims: int, method: str = "shuffle",
                seed: int = 42, start: float = 10_000.0, annual: float = 252.0, compound: bool = False,
                held: int = 1 << 22, chunk: int | None = None) -> DataFrame:
    """Sharpe, largest drawdown and total return of every simulated path: (keys, sim, sharpe, max_dd, total_return).

    The trades are sorted once and packed as plain numbers; a task reorders or draws those of one key in memory, 8 bytes a
    trade and what it sorts, for ``chunk`` of the simulations (by default so many that there are four tasks a core). The
    numbers of keys of up to ``held`` trades are dealt to their tasks, those of longer keys are read from the packed table
    by each task. No path is written. Trades without a value or without a key take no part.
    """
    keys, spark = list(keys), trades.sparkSession
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, value)])
    trades = trades.where(known).select(*keys, trade_id, value)
    sizes = landed(trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    rows = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    tasks = min(512, 4 * spark.sparkContext.defaultParallelism)
    even = F.greatest(F.lit(1), F.ceil(F.col("_n") * tasks / max(rows, 1)))
    share = (F.lit(-(-n_sims // chunk)) if chunk else F.least(F.lit(n_sims), even)).cast("int").alias("_chunks")
    kept = ", ".join(f"`{k}` {trades.schema[k].dataType.simpleString()}" for k in keys)
    # Ranges of at most a million rows, so that sorting one does not spill.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (1 << 20)))
    ranged = trades.withColumn(value, F.col(value).cast("double")).repartitionByRange(ranges, *keys, trade_id).sortWithinPartitions(*keys, trade_id)
    pieces = ranged.select(*keys, value).mapInArrow(lambda it: _packed(it, keys, value), f"{kept}, _count long, _values binary")
    pieces = landed(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    result = f"{kept}, sim int, sharpe double, max_dd double, total_return double"

    def figures(key: Sequence[pa.Array], pnl: np.ndarray, part: int, parts: int) -> pa.Table:
        sims = range(part * n_sims // parts + 1, (part + 1) * n_sims // parts + 1)
        sims, *found = zip(*_figures(pnl, sims, method, seed, start, annual, compound), strict=True)
        named = [pa.concat_arrays([k] * len(sims)) for k in key]
        return pa.table([*named, pa.array(sims, pa.int32()), *(pa.array(f, pa.float64()) for f in found)],
                        names=[*keys, "sim", "sharpe", "max_dd", "total_return"])

    def dealt(key: tuple, table: pa.Table) -> pa.Table:
        blobs, order = table.column("_values"), np.argsort(table.column("_row").to_numpy())
        pnl = np.concatenate([np.frombuffer(blobs[int(k)].as_buffer(), float) for k in order])
        return figures([pa.array([k.as_py()], k.type) for k in key[:-2]], pnl, key[-2].as_py(), key[-1].as_py())

    few = lookup(pieces, sizes.where(F.col("_n") <= held).select(*keys, share), keys)
    fan = few.select("*", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    out = fan.select(*keys, "_chunk", "_chunks", "_row", "_values").groupBy(*keys, "_chunk", "_chunks").applyInArrow(dealt, result)

    long_keys = sizes.where(F.col("_n") > held).select(*keys, "_n", share).collect()
    for key in long_keys:
        of = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(key[k]).cast(trades.schema[k].dataType)) for k in keys])
        placed = pieces.where(of).select("_row", "_count").orderBy("_row").collect()
        starts = dict(zip([r["_row"] for r in placed], np.cumsum([0, *[r["_count"] for r in placed]]).tolist()))

        for part in range(key["_chunks"]):
            def read(batches: Iterator[pa.RecordBatch], n=key["_n"], starts=starts, part=part, parts=key["_chunks"]) -> Iterator[pa.RecordBatch]:
                pnl, named = np.empty(n), None
                for batch in batches:
                    for k, row in enumerate(batch.column(batch.schema.get_field_index("_row")).to_pylist()):
                        values = np.frombuffer(batch.column(batch.schema.get_field_index("_values"))[k].as_buffer(), float)
                        pnl[starts[row] : starts[row] + len(values)] = values
                        named = named or [batch.column(batch.schema.get_field_index(c)).slice(k, 1) for c in keys]
                if named:
                    yield from figures(named, pnl, part, parts).to_batches()
            out = out.unionByName(pieces.where(of).select(*keys, "_row", "_values").coalesce(1).mapInArrow(read, result))
    return out


def simulated_paths(trades: DataFrame, keys: Sequence[str], trade_id: str, value: str, n_sims: int,
                    method: str = "shuffle", seed: int = 42) -> tuple[Series, DataFrame]:
    """Every trade of a key once per simulation, in hashed order, or drawn with replacement.

    Returns the paths, keyed by one number per (key, simulation) so that they spread over tasks
    and sort on numbers alone, and the table that maps path numbers back to key and simulation.
    """
    keys = list(keys)
    trades = trades.where(F.col(value).isNotNull())
    rows = Series.of(trades.select(*keys, F.col(trade_id), F.col(value).alias("pnl")), keys, [trade_id])
    rows = rows.indexed("_i").df.drop(trade_id)
    sizes = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ids = Series.of(sizes, [], keys).indexed("_k").df
    sims = F.explode(F.sequence(F.lit(1), F.lit(n_sims))).alias("sim")
    path = (F.col("_k") * (n_sims + 1) + F.col("sim")).alias("path")
    names = ids.select(*keys, "_k", sims).select(*keys, "sim", path)
    # Rows multiply by the number of simulations next, so they are first spread evenly by position.
    tasks = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = lookup(rows, ids, keys).select("_k", "_n", "_i", "pnl").repartition(tasks, "_i")
    fan = numbered.select("_k", "_n", "_i", "pnl", sims).withColumn("_u", _draw(seed))
    if method == "shuffle":
        return Series.of(fan.select(path, "_u", "_i", "pnl"), ["path"], ["_u", "_i"]), names
    draws = fan.select("_k", path, F.col("_i").alias("_slot"),
                       (F.floor(F.shiftrightunsigned("_u", 11) / F.lit(float(1 << 53)) * F.col("_n")) + 1).alias("_i"))
    drawn = draws.join(numbered.select("_k", "_i", "pnl"), ["_k", "_i"]).select("path", "_slot", "pnl")
    return Series.of(drawn, ["path"], ["_slot"]), names


def simulate(paths: Series, names: DataFrame, start: float = 10_000.0, annual: float = 252.0,
             compound: bool = False) -> DataFrame:
    """Sharpe, largest drawdown and total return of each simulated path."""
    pnl = F.col("pnl")
    if compound:
        s = compounded(paths, "pnl", "_eq")
        out = s.df.groupBy("path").agg(
            sharpe(pnl, annual, eps=None).alias("sharpe"), F.min("drawdown").alias("max_dd"),
            (F.max_by("_eq", paths.order[-1]) - 1).alias("total_return"))
    else:
        s = equity_curve(paths, "pnl", start, "_eq", peak_from_start=True)
        out = s.df.groupBy("path").agg(
            sharpe(pnl / start, annual).alias("sharpe"), F.max("drawdown").alias("max_dd"),
            (F.sum(pnl) / start).alias("total_return"))
    return out.join(names, "path").drop("path")


def simulation_summary(sims: DataFrame, keys: Sequence[str], original: DataFrame | None = None,
                       confidence: float = 0.95) -> DataFrame:
    """Percentiles over simulations; with the original Sharpe also its rank and the robust flag."""
    a = (1 - confidence) / 2
    pct = lambda c, q: F.percentile(c, q)
    if original is not None:
        sims = sims.join(original.select(*keys, F.col("sharpe").alias("_orig")), list(keys))
    cols = [F.count(F.lit(1)).alias("n_simulations"), F.avg("sharpe").alias("sharpe_mean"),
            pct("sharpe", a).alias("sharpe_low"), pct("sharpe", 0.5).alias("sharpe_median"),
            pct("sharpe", 1 - a).alias("sharpe_high"), F.avg("max_dd").alias("max_dd_mean"),
            pct("max_dd", a).alias("max_dd_low"), pct("max_dd", 0.5).alias("max_dd_median"),
            pct("max_dd", 1 - a).alias("max_dd_high"), F.avg("total_return").alias("total_return_mean"),
            F.avg(F.when(F.col("sharpe") > 1, 1.0).otherwise(0.0)).alias("prob_sharpe_above_1"),
            F.avg(F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0)).alias("prob_sharpe_above_0")]
    if original is not None:
        rank = F.avg(F.when(F.col("sharpe") < F.col("_orig"), 1.0).otherwise(0.0))
        cols += [rank.alias("sharpe_percentile"), ((rank > 0.75) & (pct("sharpe", 0.05) > 0)).alias("robust")]
    return sims.groupBy(*keys).agg(*cols)


# --- slippage ---------------------------------------------------------------------

def adverse_slippage(literal_sign: bool = False, pip: float = 0.0001) -> Column:
    """Pips lost against the requested price. ``literal_sign`` counts a buy above request as zero."""
    move = (F.col("fill_price") - F.col("requested_price")) * F.col("direction") / pip
    return -F.least(move, F.lit(0.0)) if literal_sign else F.greatest(move, F.lit(0.0))


def fit_session_slippage(fills: DataFrame, by: Sequence[str], adv: float = 5000.0, literal_sign: bool = False,
                         defaults: tuple[float, float] = (0.5, 0.5), min_fills: int = 10) -> DataFrame:
    """alpha and beta of slippage = alpha * (lots/adv)^beta per key, and a multiplier per session."""
    f = fills.withColumn("_slip", adverse_slippage(literal_sign)).where("lots > 0.001")
    x, y = F.ln(F.col("lots") / adv + 1e-9), F.ln(F.greatest("_slip", F.lit(0.01)))
    fit = f.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fills"), F.regr_slope(y, x).alias("_b"),
                             F.regr_intercept(y, x).alias("_a"))
    enough = F.col("n_fills") >= min_fills
    fit = fit.select(*by, "n_fills", F.when(enough, F.exp("_a")).otherwise(defaults[0]).alias("alpha"),
                     F.when(enough, clip(F.col("_b"), 0.3, 1.0)).otherwise(defaults[1]).alias("beta"))
    sess = f.groupBy(*by, "session").agg(F.avg("_slip").alias("_mean"))
    ref = F.col("alpha") * F.pow(F.lit(1.0 / adv), F.col("beta"))
    return sess.join(fit, list(by)).select(
        *by, "session", "n_fills", "alpha", "beta",
        F.when((F.col("_mean") > 0) & (ref > 0), F.col("_mean") / ref).alias("session_factor"))


def session_slippage(lots: Column, alpha: Column, beta: Column, factor: Column, spread_pips: Column,
                     urgency: float = 1.0, adv: float = 5000.0) -> Column:
    """Expected pips, 0 to 10; an unknown session counts 1.5."""
    wide = 1 + 0.3 * F.greatest(spread_pips - 1, F.lit(0.0))
    return clip(alpha * F.pow(lots / adv, beta) * F.coalesce(factor, F.lit(1.5)) * wide * urgency, 0.0, 10.0)


def fit_slippage(fills: DataFrame, by: Sequence[str], adv: float = 1000.0) -> DataFrame:
    """alpha, beta and R^2 per key over fills with positive size and slippage; defaults below five."""
    ok = fills.where((F.col("lots") > 0) & (F.col("slip") > 0))
    x, y = F.ln(F.col("lots") / adv), F.ln("slip")
    n = F.count(F.lit(1))
    return ok.groupBy(*by).agg(
        n.alias("n_fills"), F.when(n >= 5, F.exp(F.regr_intercept(y, x))).otherwise(0.1).alias("alpha"),
        F.when(n >= 5, F.regr_slope(y, x)).otherwise(0.5).alias("beta"),
        F.when(n >= 5, F.round(F.regr_r2(y, x), 4)).alias("r_squared"))


def power_slippage(lots: Column, alpha: Column, beta: Column, adv: float = 1000.0) -> Column:
    return alpha * F.pow(F.greatest(lots / adv, F.lit(1e-9)), beta)
