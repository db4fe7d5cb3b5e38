"""Ordered series: window work that stays parallel when one key holds most rows.

Rows are range-partitioned on (key, order), numbered exactly per key, and windows run per
(key, block of row numbers); a block borrows the few rows its frames need from its
neighbours, and unbounded frames take a carry from the totals of earlier blocks. The
layout is the same at every size; ``spark.tickloom.blockRows`` sets the rows of a block.
Frames are ordered by row number, so a chain of carries is dealt and sorted once, and only
the totals of its blocks, not its rows, are written between two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.core.storage import landed

BLOCK_ROWS = 1_000_000
# Times a table may be dealt anew before a carry writes it instead of running the steps before it twice.
MAX_PASSES = 2


@dataclass(frozen=True)
class Step:
    """Window expressions that look at most ``before`` rows back and ``after`` ahead."""

    fn: Callable[[DataFrame, WindowSpec], DataFrame]
    before: int = 0
    after: int = 0


@dataclass(frozen=True)
class Carry:
    """Running aggregates from the first row: name -> (sum|count|max|min|last, expression).

    ``reverse`` runs from the last row backwards. ``last`` skips nulls.
    """

    aggs: dict[str, tuple[str, Column]] = field(default_factory=dict)
    reverse: bool = False


def _running(kind: str, x: Column) -> Column:
    return {
        "sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }[kind](x)


def _merge(kind: str, carry: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carry + own, own, carry)
    if kind == "max":
        return F.greatest(carry, own)
    if kind == "min":
        return F.least(carry, own)
    return F.coalesce(own, carry)


def same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols], F.lit(True))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_rn``, the exact 1-based position in the key, whatever the key skew.

    As many sorted ranges are written as the session has shuffle partitions (adaptive execution
    merges small ones); per key and range the rows of earlier ranges are added up. These few sums
    are written too, so that their size is known and the rows stay where they are when they meet.
    """
    ranged = (df.repartitionByRange(*keys, *order)
                .sortWithinPartitions(*keys, *order)
                .withColumn("_row", F.monotonically_increasing_id()))
    table = landed(ranged, "ordered").withColumn("_rp", F.shiftright("_row", 33))
    earlier = Window.partitionBy(*keys).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    parts = (table.groupBy(*keys, "_rp")
                  .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_lo"))
                  .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
                  .drop("_n"))
    parts = landed(parts.toDF(*[f"_of_{c}" for c in parts.columns]), "ranges")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "_rp")])
    rn = F.col("_row") - F.col("_of__lo") + F.col("_of__start") + 1
    return table.join(parts, on).select(*df.columns, rn.alias("_rn"))


class Series:
    """A DataFrame with its series key and total order."""

    def __init__(self, frame: DataFrame, keys, order, block_rows: int, passes: int = MAX_PASSES + 1, laid: bool = False):
        self.frame, self.keys, self.order = frame, list(keys), list(order)
        self.block_rows = block_rows
        # Times the rows were dealt anew since they were last written, and whether they lie by (key, _own) now.
        self.passes, self.laid = passes, laid

    @classmethod
    def of(cls, df: DataFrame, keys=("pair",), order=("ts",), block_rows: int | None = None):
        rows = block_rows or int(df.sparkSession.conf.get("spark.tickloom.blockRows", str(BLOCK_ROWS)))
        frame = number_rows(df, keys, order).withColumn("_own", F.floor((F.col("_rn") - 1) / F.lit(rows)))
        return cls(frame, keys, order, rows, 0)

    @property
    def df(self) -> DataFrame:
        return self.frame.drop("_rn", "_own")

    def with_frame(self, frame: DataFrame) -> Series:
        return Series(frame, self.keys, self.order, self.block_rows)

    def _dealt(self, frame: DataFrame, passes: int, laid: bool) -> Series:
        return Series(frame, self.keys, self.order, self.block_rows, passes, laid)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Series:
        """Row-wise change: columns only, no rows added, dropped or moved."""
        return self._dealt(fn(self.frame), self.passes, self.laid)

    def apply(self, *steps: Step | Carry) -> Series:
        s = self
        for kind, group in groupby(steps, key=type):
            if kind is Step:
                s = s._windows(list(group))
            else:
                for carry in group:
                    s = s._carry(carry)
        return s

    def indexed(self, name: str = "rn") -> Series:
        """Row number within the key, from 1."""
        return self.map(lambda f: f.withColumn(name, F.col("_rn")))

    def lending(self, before: int) -> Series:
        """The same series, dealt once with the ``before`` rows that each block borrows, for carries and steps that follow."""
        f, rows = self._lent(before, 0)
        return LentSeries(f.drop("_home"), self, before, before) if 0 < before and rows == self.block_rows else self

    def _lent(self, before: int, after: int) -> tuple[DataFrame, int]:
        """Rows with the blocks that use them (_blk) and the one they belong to (_home), and the rows of a block."""
        rows = max(self.block_rows, before, after)
        home, at = F.floor((F.col("_rn") - 1) / F.lit(rows)), F.pmod(F.col("_rn") - 1, F.lit(rows))
        users = F.array_compact(F.array(
            home, F.when(at >= rows - before, home + 1), F.when(at < after, home - 1)))
        return self.frame.withColumn("_home", home).withColumn("_blk", F.explode(users)), rows

    def _windows(self, steps: list[Step]) -> Series:
        w = Window.partitionBy(*self.keys, "_blk").orderBy("_rn")
        f, rows = self._lent(sum(s.before for s in steps), sum(s.after for s in steps))
        # Dealt here, so that a step whose first window is finer than a block does not deal the rows twice.
        f = reduce(lambda g, s: s.fn(g, w), steps, f.repartition(*self.keys, "_blk")).where(F.col("_blk") == F.col("_home")).drop("_home")
        laid = rows == self.block_rows
        f = f.drop("_own").withColumnRenamed("_blk", "_own") if laid else f.drop("_blk")
        return self._dealt(f, self.passes + 1, laid)

    def weighted(self, column: str, weights: Sequence[float], out: str) -> Series:
        """Sum of the last ``len(weights)`` values times their weights, oldest first; null until there are so many.

        Each block is one convolution over its rows and the few it borrows, however long the weights are.
        """
        n = len(weights)
        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.frame.schema.fields]
        names = [*self.frame.columns, out]
        turned = np.asarray(weights, float)[::-1]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_rn")
            x = pdf[column].to_numpy(float)
            full = np.full(len(x), np.nan)
            if len(x) >= n:
                full[n - 1 :] = np.convolve(x, turned, "valid")
            pdf[out] = pd.Series(full, index=pdf.index).astype(object).where(~np.isnan(full), None)
            return pdf.loc[pdf["_blk"] == pdf["_home"], names]

        f = self._lent(n - 1, 0)[0].groupBy(*self.keys, "_blk").applyInPandas(run, ", ".join([*kept, f"`{out}` double"]))
        return self.with_frame(f)

    def _carry(self, carry: Carry) -> Series:
        if self.passes > MAX_PASSES:
            return self._dealt(landed(self.frame, "blocks"), 0, False)._carry(carry)
        f = self.frame
        w = (Window.partitionBy(*self.keys, "_own").orderBy(F.col("_rn").desc() if carry.reverse else "_rn")
                   .rowsBetween(Window.unboundedPreceding, 0))
        own = f.withColumns(
            {f"_own_{n}": _running(k, x).over(w) for n, (k, x) in carry.aggs.items()})
        pick = F.min_by if carry.reverse else F.max_by
        totals = f.groupBy(*self.keys, "_own").agg(*[
            (pick(x, F.when(x.isNotNull(), F.col("_rn"))) if k == "last" else _running(k, x))
            .alias(f"_tot_{n}") for n, (k, x) in carry.aggs.items()])
        step = F.col("_own").desc() if carry.reverse else F.col("_own")
        past = (Window.partitionBy(*self.keys).orderBy(step)
                      .rowsBetween(Window.unboundedPreceding, -1))
        # Written, so that the carries after this one find them and their small size is known to the join.
        totals = landed(totals.select(*self.keys, "_own", *[
            _running("sum" if k == "count" else k, F.col(f"_tot_{n}")).over(past).alias(f"_in_{n}")
            for n, (k, _) in carry.aggs.items()]), "totals")
        joined = own.join(totals, same(own, totals, [*self.keys, "_own"]), "left")
        out = joined.select(
            *[own[c] for c in f.columns],
            *[_merge(k, F.col(f"_in_{n}"), F.col(f"_own_{n}")).alias(n)
              for n, (k, _) in carry.aggs.items()])
        return self._dealt(out, self.passes + (not self.laid), True)


class LentSeries(Series):
    """A series whose blocks (``_blk``) already hold the rows they borrow from the block before (``_own``).

    Carries start at the first borrowed row, so that steps after them find carried values in the borrowed rows too, and
    nothing is dealt again. Steps use up the borrowed rows; what looks further, ahead or runs backwards goes by ``frame``.
    """

    def __init__(self, wide: DataFrame, like: Series, dealt: int, before: int):
        self.wide, self.keys, self.order, self.block_rows = wide, like.keys, like.order, like.block_rows
        # Rows that a block holds of the one before, and how many of them have all their columns.
        self.dealt, self.before, self.passes, self.laid = dealt, before, 1, True

    @property
    def frame(self) -> DataFrame:
        return self.wide.where(F.col("_blk") == F.col("_own")).drop("_own").withColumnRenamed("_blk", "_own")

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Series:
        wide = fn(self.wide)
        return LentSeries(wide, self, self.dealt, self.before) if {"_blk", "_own", "_rn"} <= set(wide.columns) else super().map(fn)

    def _windows(self, steps: list[Step]) -> Series:
        before = sum(s.before for s in steps)
        if before > self.before or any(s.after for s in steps):
            return super()._windows(steps)
        w = Window.partitionBy(*self.keys, "_blk").orderBy("_rn")
        return LentSeries(reduce(lambda g, s: s.fn(g, w), steps, self.wide), self, self.dealt, self.before - before)

    def _carry(self, carry: Carry) -> Series:
        if carry.reverse or self.before < self.dealt:
            return super()._carry(carry)
        f = self.wide
        w = Window.partitionBy(*self.keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
        own = f.withColumns({f"_own_{n}": _running(k, x).over(w) for n, (k, x) in carry.aggs.items()})
        # Totals of the rows that a block lends and of those before them: a block begins where the one before it lends.
        lends = F.pmod(F.col("_rn") - 1, F.lit(self.block_rows)) >= self.block_rows - self.dealt
        totals = f.where(F.col("_blk") == F.col("_own")).groupBy(*self.keys, "_own", lends.alias("_lends")).agg(*[
            (F.max_by(x, F.when(x.isNotNull(), F.col("_rn"))) if k == "last" else _running(k, x))
            .alias(f"_tot_{n}") for n, (k, x) in carry.aggs.items()])
        past = Window.partitionBy(*self.keys).orderBy("_own", "_lends").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*self.keys, (F.col("_own") + 1).alias("_blk"), "_lends", *[
            _running("sum" if k == "count" else k, F.col(f"_tot_{n}")).over(past).alias(f"_in_{n}")
            for n, (k, _) in carry.aggs.items()])
        totals = landed(totals.where("_lends").drop("_lends"), "totals")
        joined = own.join(totals, same(own, totals, [*self.keys, "_blk"]), "left")
        out = joined.select(
            *[own[c] for c in f.columns],
            *[_merge(k, F.col(f"_in_{n}"), F.col(f"_own_{n}")).alias(n) for n, (k, _) in carry.aggs.items()])
        return LentSeries(out, self, self.dealt, self.before)


def rolling(agg: Callable[[Column], Column], x: Column, w: WindowSpec, rows: int,
            min_periods: int | None = None) -> Column:
    """Aggregate of the last ``rows`` rows; null until enough of them are non-null."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) >= (rows if min_periods is None else min_periods),
                  agg(x).over(frame))


def windowed_sums(s: Series, sums: dict[str, tuple[Column, int]]) -> Series:
    """Sums over the last ``rows`` rows, fewer at the start: name -> (expression, rows); nulls count 0."""
    return s.apply(sums_step(s.keys, sums))


def sums_step(keys: Sequence[str], sums: dict[str, tuple[Column, int]]) -> Step:
    """Step that adds sums over the last ``rows`` rows: name -> (expression, rows); nulls count 0.

    A window is the tail of one run of ``rows`` rows plus the head of the next, both read from
    running sums inside the run, so the cost per row does not grow with the window and the
    error does not grow with the series. A block borrows the whole run before its first window.
    """
    def fn(f: DataFrame, w: WindowSpec) -> DataFrame:
        for rows in sorted({n for _, n in sums.values()}):
            names = {name: F.coalesce(x, F.lit(0)) for name, (x, n) in sums.items() if n == rows}
            run = Window.partitionBy(*keys, "_blk", "_run")
            head = run.orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
            f = f.withColumn("_run", F.floor((F.col("_rn") - 1) / rows)).withColumns(
                {f"_h_{n}": F.sum(x).over(head) for n, x in names.items()}).withColumns(
                {f"_t_{n}": F.sum(x).over(run) for n, x in names.items()})
            tail = lambda n, rows=rows: F.lag(F.col(f"_t_{n}") - F.col(f"_h_{n}"), rows).over(w)
            f = f.withColumns({n: F.col(f"_h_{n}") + F.coalesce(tail(n), F.lit(0)) for n in names})
            f = f.drop("_run", *[f"_{p}_{n}" for n in names for p in "ht"])
        return f
    return Step(fn, before=2 * max(n for _, n in sums.values()))


def add(before: int, fn: Callable[[WindowSpec], dict[str, Column]], after: int = 0) -> Step:
    """Step that only adds columns."""
    return Step(lambda f, w: f.withColumns(fn(w)), before, after)
