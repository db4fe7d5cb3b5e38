"""Column expressions: clipping, clocks, pips, probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pip size by pair; every other pair uses DEFAULT_PIP.
PIP_SIZES = {
    "EURUSD": 0.0001, "GBPUSD": 0.0001, "USDJPY": 0.01,
    "AUDUSD": 0.0001, "USDCAD": 0.0001, "USDCHF": 0.0001,
}
DEFAULT_PIP = 0.0001


def clip(x: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def flag(cond: Column) -> Column:
    """1.0 where true, else 0.0 (also where unknown)."""
    return F.when(cond, 1.0).otherwise(0.0)


def pip_size(pair: Column) -> Column:
    sizes = F.create_map(*[F.lit(v) for kv in PIP_SIZES.items() for v in kv])
    return F.coalesce(F.try_element_at(sizes, pair), F.lit(DEFAULT_PIP))


def seconds(ts: Column) -> Column:
    """Seconds since the epoch with microseconds kept; reads zone-less values as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_flags(ts: Column) -> dict[str, Column]:
    """Trading-session flags from the UTC clock, as 0.0/1.0."""
    m = minute_of_day(ts)
    between = lambda a, b: (m >= int(a * 60)) & (m < int(b * 60))
    return {
        "sess_tokyo": flag(between(0, 9)),
        "sess_london": flag(between(7, 16)),
        "sess_ny": flag(between(12, 21)),
        "sess_sydney": flag((m >= 21 * 60) | (m < 6 * 60)),
        "sess_ln_ny": flag(between(13, 16)),
        "sess_open": flag(between(7, 7.25) | between(12, 12.25)),
    }


def cyclic_time(ts: Column, prefix: tuple[str, str] = ("time", "day")) -> dict[str, Column]:
    day = F.lit(2 * math.pi) * minute_of_day(ts) / 1440
    week = F.lit(2 * math.pi) * F.weekday(ts) / 5
    clock, dow = prefix
    return {f"{clock}_sin": F.sin(day), f"{clock}_cos": F.cos(day),
            f"{dow}_sin": F.sin(week), f"{dow}_cos": F.cos(week)}


def london_ny(ts: Column) -> Column:
    return flag(F.hour(ts).between(13, 17))


def range_position(high="high", low="low", close="close") -> Column:
    return clip((F.col(close) - F.col(low)) / (F.col(high) - F.col(low) + 1e-9), 0.0, 1.0)


def spread_pips(columns: Sequence[str], pip: Column | float = DEFAULT_PIP) -> Column:
    """Spread in pips from the best column present."""
    pip = F.lit(pip) if isinstance(pip, float) else pip
    if "spread_avg" in columns:
        return F.col("spread_avg") / pip
    if {"ask_close", "bid_close"} <= set(columns):
        return (F.col("ask_close") - F.col("bid_close")) / pip
    return F.lit(0.5)


def class_index(label: Column) -> Column:
    return F.least(F.greatest(F.rint(label + 1), F.lit(0.0)), F.lit(2.0)).cast("int")


def first_number(reply: Column) -> Column:
    """First number in a text, clipped to -1..1; null when there is none."""
    found = F.regexp_extract(reply, r"-?\d+\.?\d*", 0)
    return clip(F.when(found != "", found).try_cast("double"), -1.0, 1.0)


def bucket_index(x: Column, edges: Sequence[float]) -> Column:
    """Index of the first upper edge >= x; len(edges) beyond the last."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(x <= edges[i], i).otherwise(out)
    return out


def normalised(parts: Sequence[Column]) -> list[Column]:
    total = sum(parts[1:], parts[0]) + 1e-9
    return [p / total for p in parts]


def normal_cdf(z: Column, terms: int = 150) -> Column:
    """Standard normal distribution function: 1/2 + density * sum of z^(2k+1) / (1*3*...*(2k+1))."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.struct(z.alias("term"), z.alias("total")),
        lambda acc, k: F.struct((acc.term * z * z / (2 * k + 1)).alias("term"),
                                (acc.total + acc.term * z * z / (2 * k + 1)).alias("total")),
        lambda acc: acc.total)
    near = 0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(near)


def unit_hash(*parts: Column) -> Column:
    """Number in [0, 1) fixed by its inputs: the first 8 hex digits of an MD5 over 2**32."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
