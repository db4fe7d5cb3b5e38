"""Sequential guards per key: drawdown exits, change alarms, alert cooldown, retraining.

A guard advances over arrays: ``(state, columns) -> (state, output columns)``, moving from one event (halt,
alarm, sent alert) to the next instead of from row to row. What is not sequential (peak, loss streak, day
opening) is computed as columns before.

The batch form cuts a key into blocks and runs all blocks at once, each from a guessed state; a block whose
predecessor ended in another state than it was given runs again, until none does. Guards forget: after a halt,
a new day, an alarm or a quiet gap the state no longer depends on where the block began, so few blocks run
again, and no key is one task. A task passes over its sorted blocks a slice at a time, so its Python process
holds a few slices however long the blocks are. The stream form writes the rows of each micro-batch once, sorted by time,
and sends those that the watermark has passed through the same blocks, from the state in which the batch before left each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.core.series import Carry, Series, add
from tickloom.core.storage import landed
from tickloom.functions.scalar import seconds


# Rows of a block that go through a guard at once; cut from the block's first row on, so that every pass cuts alike.
SLICE_ROWS = 1 << 16


@dataclass(frozen=True)
class Guard:
    """``state`` and ``out`` are schemas without nulls; ``columns`` are read as arrays."""

    initial: tuple
    state: str
    columns: tuple[str, ...]
    out: str
    advance: Callable[[tuple, list[np.ndarray]], tuple[tuple, list[np.ndarray]]]

    @property
    def outputs(self) -> list[str]:
        return [c.split()[0] for c in self.out.split(", ")]

    @property
    def states(self) -> list[str]:
        return [c.split()[0] for c in self.state.split(", ")]

    def over(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        state, values = self.advance(state, [rows[c].to_numpy() for c in self.columns])
        plain = tuple(x.item() if isinstance(x, np.generic) else x for x in state)
        return plain, rows.assign(**dict(zip(self.outputs, values)))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def _slices(frames: Iterator[pd.DataFrame], size: int = SLICE_ROWS) -> Iterator[tuple[bool, pd.DataFrame]]:
    """(first of its block, rows): the rows of sorted blocks, cut every ``size`` rows of a block."""
    held, n, block, first = [], 0, None, True
    for pdf in frames:
        turns = (pdf["_key"] != pdf["_key"].shift()) | (pdf["_blk"] != pdf["_blk"].shift())
        starts = [*np.flatnonzero(turns), len(pdf)]
        for lo, hi in zip(starts, starts[1:]):
            part = pdf.iloc[lo:hi]
            now = (part["_key"].iloc[0], part["_blk"].iloc[0])
            if now != block:
                if n:
                    yield first, pd.concat(held)
                held, n, block, first = [], 0, now, True
            held, n = [*held, part], n + len(part)
            while n >= size:
                rows = pd.concat(held)
                yield first, rows.iloc[:size]
                held, n, first = [rows.iloc[size:]], n - size, False
    if n:
        yield first, pd.concat(held)


def guard_batch(df: DataFrame, guard: Guard, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Run a guard over a table, in blocks of each key's rows."""
    s = Series.of(df, keys, order)
    return run_guard(s, guard)


def run_guard(s: Series, guard: Guard) -> DataFrame:
    """Run a guard over a series; the loop ends when every block began where the one before it ended."""
    return _guarded(s, guard)[0]


def _guarded(s: Series, guard: Guard, begun: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with the guard's columns, and the state in which each key ends; ``begun``: the states in which keys begin, if not the initial one.

    States are tables of _key and the columns of the state.
    """
    frame = s.frame.withColumnRenamed("_own", "_blk")
    rows = landed(frame.select("*", F.to_json(F.struct(*s.keys)).alias("_key")), "guard-rows")
    entry, states = [f"_in_{c}" for c in guard.states], guard.states
    kept = [*s.df.columns, *guard.outputs]
    state_of = ", ".join(f"_in_{c}" for c in guard.state.split(", ")) + ", " + ", ".join(f"_out_{c}" for c in guard.state.split(", "))

    def ended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = ["_key", "_blk", *entry, *(f"_out_{c}" for c in states)]
        done = None
        for first, pdf in _slices(frames):
            if first:
                if done:
                    yield pd.DataFrame([(*done, *state)], columns=named)
                state = tuple(pdf[c].iloc[0] for c in entry)
                done = (pdf["_key"].iloc[0], pdf["_blk"].iloc[0], *state)
            state, _ = guard.over(state, pdf)
        if done:
            yield pd.DataFrame([(*done, *state)], columns=named)

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for first, pdf in _slices(frames):
            state, out = guard.over(tuple(pdf[c].iloc[0] for c in entry) if first else state, pdf)
            yield out[kept]

    def sorted_blocks(f: DataFrame) -> DataFrame:
        return f.repartition("_key", "_blk").sortWithinPartitions("_key", "_blk", "_rn")

    def run(given: DataFrame) -> DataFrame:
        needed = rows.select("_key", "_blk", "_rn", *guard.columns)
        ends = sorted_blocks(needed.join(given, ["_key", "_blk"])).mapInPandas(ended, f"_key string, _blk long, {state_of}")
        return landed(ends, "guard-states")

    initial = [F.lit(v).cast(c.split()[1]).alias(f"_in_{c.split()[0]}") for v, c in zip(guard.initial, guard.state.split(", "))]
    first = rows.select("_key", "_blk").distinct().select("_key", "_blk", *initial)
    if begun is not None:
        # A key's first block begins as told; the others are guessed.
        named = begun.select("_key", F.lit(0).cast("long").alias("_blk"), *[F.col(c).alias(f"_old_{c}") for c in states])
        first = first.join(named, ["_key", "_blk"], "left").select("_key", "_blk", *[F.coalesce(f"_old_{c}", f"_in_{c}").alias(f"_in_{c}") for c in states])
    known = run(landed(first, "guard-states"))
    ahead = Window.partitionBy("_key").orderBy("_blk")
    while True:
        found = known.withColumns({f"_now_{c}": F.coalesce(F.lag(f"_out_{c}").over(ahead), F.col(f"_in_{c}")) for c in states})
        moved = F.lit(False)
        for c in states:
            moved = moved | ~F.col(f"_now_{c}").eqNullSafe(F.col(f"_in_{c}"))
        again = found.where(moved).select("_key", "_blk", *[F.col(f"_now_{c}").alias(f"_in_{c}") for c in states])
        if not again.limit(1).count():
            break
        redone = run(again)
        known = landed(known.join(redone.select("_key", "_blk"), ["_key", "_blk"], "left_anti").unionByName(redone), "guard-states")
    given = known.select("_key", "_blk", *entry)
    ends = known.groupBy("_key").agg(*[F.max_by(f"_out_{c}", "_blk").alias(c) for c in states])
    return sorted_blocks(rows.join(given, ["_key", "_blk"])).mapInPandas(through, _schema(s.df, guard.out)), ends


def guard_stream(df: DataFrame, guard: Guard, keys: Sequence[str], order: Sequence[str], time: str = "ts",
                 delay: str = "0 seconds") -> GuardStream:
    """Run a guard over a stream whose rows may come up to ``delay`` out of order; ``ticks.drain`` runs it.

    Rows are held until the watermark has passed their ``time`` and then go through in order; what is newer
    than the last watermark comes out when a later row, of any key, moves it on. Rows that the watermark had passed
    before they came are dropped; rows without a time go through at once, after the others of their batch.
    """
    return GuardStream(df, guard, list(keys), list(order), time, delay)


@dataclass(frozen=True)
class GuardStream:
    """A guard over a stream, turn by turn. A micro-batch is a turn, and so is the end of what is available (no rows).

    As in Spark's stateful operators, a turn's watermark comes from the rows of the turns before. All it keeps are tables
    named by the turn: its rows sorted by time, the state of every key, its watermark. A repeated turn writes them anew.
    """

    df: DataFrame
    guard: Guard
    keys: list[str]
    order: list[str]
    time: str
    delay: str

    @property
    def sparkSession(self):  # noqa: N802
        return self.df.sparkSession

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(_schema(self.df, self.guard.out))

    def turn(self, rows: DataFrame | None, number: int, folder: str, out: str) -> None:
        """Take the rows of turn ``number`` and write what the watermark has passed to a folder of ``out``."""
        spark = rows.sparkSession if rows is not None else self.sparkSession
        at = lambda kind, k: f"{folder}/{kind}/turn={k}"
        marks = spark.read.schema("turn long, mark long, seen long, top long, states long").option("recursiveFileLookup", True)
        past = [] if number == 0 else marks.parquet(f"{folder}/marks").where(F.col("turn") < number).orderBy("turn").collect()
        late, mark = (past[-1]["mark"], past[-1]["seen"]) if past else (None, None)
        seen, stated = mark, past[-1]["states"] if past else None
        ms = F.unix_millis(F.col(self.time).cast("timestamp"))
        top = None
        undated = F.col(self.time).isNull()
        if rows is not None:
            known = rows if late is None else rows.where(undated | (F.unix_micros(F.col(self.time).cast("timestamp")) > late * 1000))
            known.repartitionByRange(self.time).sortWithinPartitions(self.time).write.mode("overwrite").parquet(at("rows", number))
            span = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {self.delay}) AS ms").first()["ms"]
            top = spark.read.schema(self.df.schema).parquet(at("rows", number)).agg(F.max(ms)).first()[0]
            seen = max(x for x in (seen, top - span) if x is not None) if top is not None else seen
        read = spark.read.schema(self.df.schema)
        turns = [r["turn"] for r in past if r["top"] is not None and (late is None or r["top"] > late)]
        parts = []
        if turns and mark is not None and (late is None or mark > late):
            parts.append(read.parquet(*[at("rows", k) for k in turns]).where((ms <= mark) if late is None else (ms > late) & (ms <= mark)))
        if rows is not None:
            parts.append(read.parquet(at("rows", number)).where(undated if mark is None else undated | (ms <= mark)))
        done = reduce(DataFrame.unionByName, parts) if parts else None
        if done is not None and done.limit(1).count():
            begun = spark.read.parquet(at("states", stated)) if stated is not None else None
            # What has no value for a column of the order comes last.
            order = [x for c in self.order for x in (f"_no_{c}", c)]
            s = Series.of(done.withColumns({f"_no_{c}": F.col(c).isNull() for c in self.order}), self.keys, order)
            result, ends = _guarded(s, self.guard, begun)
            result.select(*self.schema.names).write.mode("overwrite").parquet(f"{out}/turn-{number}")
            ends = ends if begun is None else ends.unionByName(begun.join(ends, "_key", "left_anti"))
            ends.write.mode("overwrite").parquet(at("states", number))
            stated = number
        row = spark.createDataFrame([(number, mark, seen, top, stated)], "turn long, mark long, seen long, top long, states long")
        row.coalesce(1).write.mode("overwrite").parquet(at("marks", number))


# --- drawdown exits ------------------------------------------------------------------

def account_columns(s: Series, start: float) -> Series:
    """Columns that the drawdown guard reads, from (day, equity, pnl): peak with the start, equity at the end of
    the day before (null but for a day's first row) and losing trades in a row within the day."""
    turn = lambda w: F.lag("day").over(w).isNotNull() & ~F.lag("day").over(w).eqNullSafe(F.col("day"))
    s = s.apply(add(1, lambda w: {"opening": F.when(turn(w), F.lag("equity").over(w)), "_new": turn(w)}),
                Carry({"_peak": ("max", F.col("equity")), "_lost": ("sum", (F.col("pnl") < 0).cast("int"))}))
    own = (F.col("pnl") < 0).cast("int")
    base = F.when(F.col("pnl") > 0, F.col("_lost")).when(F.col("_new"), F.col("_lost") - own)
    s = s.apply(Carry({"_base": ("last", base)}))
    return s.map(lambda f: f.withColumns({
        "peak": F.greatest("_peak", F.lit(start)), "losses": (F.col("_lost") - F.coalesce("_base", F.lit(0))).cast("int")})
        .drop("_peak", "_lost", "_base", "_new"))


def _below(top: np.ndarray, equity: np.ndarray) -> np.ndarray:
    """Share lost against ``top``; nothing where there was nothing to lose."""
    return np.maximum(np.divide(top - equity, top, out=np.zeros(len(top)), where=top > 0), 0.0)


def drawdown_guard(soft: float = 0.05, hard: float = 0.10, daily: float = 0.03, max_losses: int = 5,
                   recovery: int = 20, start: float = 1.0) -> Guard:
    """Action and size multiplier after each update, from the columns of ``account_columns``.

    State: the equity that the day's loss is measured against, and how many updates of a halt are left.
    """
    def advance(state, columns):
        equity, peak, opening, losses = (np.asarray(c, float) for c in columns)
        n = len(equity)
        at = np.arange(n)
        drop = _below(peak, equity)
        opened = np.maximum.accumulate(np.where(np.isnan(opening), -1, at)) if n else at
        base, left = state
        measured, halted, closes = np.empty(n), np.zeros(n, bool), np.zeros(n, bool)
        row = 0
        while row < n:
            # The rest of a halt, or the stretch up to the next exit.
            until = min(n, row + left) if left else n
            ref = np.where(opened[row:until] >= row, opening[opened[row:until]], base)
            loss = _below(ref, equity[row:until])
            if left:
                halted[row:until] = True
                left -= until - row
                base = equity[until - 1] if not left else ref[-1]
            else:
                hits = np.flatnonzero((drop[row:until] >= hard) | (loss >= daily))
                if len(hits):
                    until = row + hits[0] + 1
                    closes[until - 1], left = True, recovery
                base = ref[until - row - 1]
            measured[row:until] = loss[: until - row]
            row = until
        open_ = ~halted & ~closes
        mild, streak = open_ & (drop >= soft), open_ & (drop < soft) & (losses >= max_losses)
        action = np.select([halted, closes, mild, streak], ["halt", "close_all", "reduce_50", "reduce_size"], "continue")
        size = np.select([halted | closes, mild, streak], [0.0, 0.5, np.maximum(0.25, 1 - 0.15 * (losses - max_losses + 1))], 1.0)
        return (base, left), [action, drop, measured, losses.astype(np.int32), size]
    return Guard((start, 0), "base double, left int", ("equity", "peak", "opening", "losses"),
                 "action string, dd double, daily_loss double, consec_losses int, size_multiplier double", advance)


# --- change alarm ----------------------------------------------------------------------

def page_hinkley(column: str = "value", delta: float = 0.005, threshold: float = 50.0, min_rows: int = 30) -> Guard:
    """Alarm when the running sum of value - delta exceeds its minimum by the threshold; then start over.

    State: the excess over the minimum, and the rows since the start as far as they still matter.
    """
    def advance(state, columns):
        x = np.asarray(columns[0], float) - delta
        excess, n = state
        alarm, row, step = np.zeros(len(x), bool), 0, 1024
        while row < len(x):
            part = excess + np.cumsum(x[row : row + step])
            over = part - np.minimum(np.minimum.accumulate(part), 0.0)
            hits = np.flatnonzero((over > threshold) & (n + 1 + np.arange(len(over)) >= min_rows))
            if len(hits):
                row += hits[0] + 1
                alarm[row - 1], excess, n, step = True, 0.0, 0, 1024
            else:
                row, n, excess, step = row + len(over), min(n + len(over), min_rows), float(over[-1]), step * 2
        return (excess, n), [alarm]
    return Guard((0.0, 0), "excess double, n int", (column,), "alarm boolean", advance)


# --- alert cooldown ------------------------------------------------------------------------

def cooldown_guard(gap_seconds: float = 300.0) -> Guard:
    """Send an alert unless one of its type went out less than the gap ago; ``force`` always sends.

    Rows come in the order of ``at``. State: the time of the last alert sent.
    """
    def advance(state, columns):
        at, forced = np.asarray(columns[0], float), np.flatnonzero(np.asarray(columns[1], bool))
        sent, last, row = np.zeros(len(at), bool), state[0], 0
        while row < len(at):
            due = max(row, int(np.searchsorted(at, last + gap_seconds)))
            k = np.searchsorted(forced, row)
            due = min(due, int(forced[k])) if k < len(forced) else due
            if due >= len(at):
                break
            sent[due], last, row = True, float(at[due]), due + 1
        return (last,), [sent]
    return Guard((float("-inf"),), "last double", ("at", "force"), "sent boolean", advance)


def cooldown(alerts: DataFrame, keys: Sequence[str] = ("alert_type",), order: Sequence[str] = ("ts",),
             gap_seconds: float = 300.0) -> DataFrame:
    """Batch cooldown over alerts with ``ts`` and ``force``."""
    timed = alerts.withColumns({"at": seconds(F.col("ts")), "force": F.coalesce("force", F.lit(False))})
    return guard_batch(timed, cooldown_guard(gap_seconds), keys, order).drop("at")


# --- retraining --------------------------------------------------------------------------------

def retrain_guard(every: int = 10_000) -> Guard:
    """Reason to retrain at each row, from the row count since the last scheduled run or a drift flag."""
    def advance(state, columns):
        n = state[0] + 1 + np.arange(len(columns[0]))
        reason = np.where(n % every == 0, "scheduled", np.where(np.asarray(columns[0], bool), "drift", ""))
        return ((state[0] + len(n)) % every,), [reason]
    return Guard((0,), "n int", ("drift",), "reason string", advance)


def retrain_points(s: Series, drift: str | Column = "drift", every: int = 10_000) -> DataFrame:
    """Batch form: the schedule depends only on the row number, so no state is needed."""
    due = F.pmod(F.col("_i"), F.lit(every)) == 0
    f = s.indexed("_i").df
    flag = F.col(drift) if isinstance(drift, str) else drift
    return f.withColumn("reason", F.when(due, "scheduled").when(flag, "drift").otherwise("")).drop("_i")
