"""Operators with memory that have an exact set-based form, and greedy selection, which has none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators import windows as X
from tidemark.operators.grid import w


def _upto() -> WindowSpec:
    return w().rowsBetween(Window.unboundedPreceding, 0)


def hysteresis(df: DataFrame, on: Column, off: Column, reset: Column, name: str) -> DataFrame:
    """1 from a row where `on` holds until one where `off` does; a reset row gives NULL and starts again from 0.

    Off is tried on rows that are in, on on rows that are out. Where only one holds, or on a reset, the state is known; since the last
    such row, each row where both hold turns it over, so a running parity gives the state without a loop.
    """
    on, off = F.coalesce(on, F.lit(False)), F.coalesce(off, F.lit(False))
    known = F.when(reset, 0).when(on & ~off, 1).when(off & ~on, 0)
    df = df.withColumns({"_known": known, "_both": F.when(~reset & on & off, 1).otherwise(0), "_reset": reset})
    df = df.withColumn("_flips", F.sum("_both").over(_upto()))
    df = df.withColumn("_last", F.last(F.when(F.col("_known").isNotNull(), F.struct(F.col("_known").alias("k"), F.col("_flips").alias("f"))), ignorenulls=True).over(_upto()))
    state = F.pmod(F.coalesce(F.col("_last.k"), F.lit(0)) + F.col("_flips") - F.coalesce(F.col("_last.f"), F.lit(0)), F.lit(2))
    return df.withColumn(name, F.when(~F.col("_reset"), state.cast("double"))).drop("_known", "_both", "_reset", "_flips", "_last")


def donchian(df: DataFrame, n: int, name: str) -> DataFrame:
    """In at a close at or above the highest of the n closes before it, out at or below the lowest of half as many; NULL without them."""
    half = max(2, n // 2)
    hi, lo = X.rolling("max", "close", n, n, upto=-1), X.rolling("min", "close", half, half, upto=-1)
    df = df.withColumns({"_hi": hi, "_lo": lo})
    missing = F.col("close").isNull() | F.col("_hi").isNull() | F.col("_lo").isNull()
    return hysteresis(df, F.col("close") >= F.col("_hi"), F.col("close") <= F.col("_lo"), missing, name).drop("_hi", "_lo")


def ensemble(df: DataFrame, channels=(10, 20, 30, 60, 90), returns=(7, 14, 28, 56), name: str = "ensemble") -> DataFrame:
    """Mean of channel states and signs of past returns, NULL if any part is."""
    for n in channels:
        df = donchian(df, n, f"_d{n}")
    signs = [(F.col("close") / F.lag("close", n).over(w()) > 1).cast("double") for n in returns]
    parts = [F.col(f"_d{n}") for n in channels] + signs
    return df.withColumn(name, sum(parts[1:], parts[0]) / len(parts)).drop(*[f"_d{n}" for n in channels])


def cusum(df: DataFrame, increment: Column, name: str = "cusum") -> DataFrame:
    """S = max(0, S + increment): running sum over its own running minimum, which is 0 at most."""
    df = df.withColumn("_c", F.sum(F.coalesce(increment, F.lit(0.0))).over(_upto()))
    return df.withColumn(name, F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(_upto()))).drop("_c")


def latched(condition: Column) -> Column:
    """True from the first row on where the condition held."""
    return F.max(F.coalesce(condition, F.lit(False)).cast("int")).over(_upto()) == 1


def monitor(df: DataFrame, mean: float, worse: float, sd: float, limit: float, recent: int = 50, least: int = 30) -> DataFrame:
    """CUSUM of standardised shortfalls and an upper bound of the recent mean; DISABLED once either gives out, for good.

    df: symbol, ts, net. k is half the shift that is to be noticed.
    """
    k = max((mean - worse) / (2 * sd), 1e-3)
    df = cusum(df, -(F.col("net") - mean) / sd - k)
    frame = w().rowsBetween(-(recent - 1), 0)
    n, m, s = F.count("net").over(frame), F.avg("net").over(frame), F.stddev_samp("net").over(frame)
    df = df.withColumn("recent_ucb", F.when(n >= least, m + 2 * s / F.sqrt(n)))
    return df.withColumn("disabled", latched((F.col("cusum") > limit) | (F.col("recent_ucb") < 0)))


def siegmund_arl(limit: float, k: float, shift: float = 0.0) -> float:
    """Average run length of a one-sided CUSUM of unit normal steps with drift shift - k."""
    d, b = shift - k, limit + 1.166
    if abs(d) < 1e-9:
        return b * b
    return (math.exp(-2 * d * b) + 2 * d * b - 1) / (2 * d * d)


def cusum_limit(k: float, arl: float = 3000.0) -> float:
    """The limit with the wanted average run length, by bisection."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if siegmund_arl(mid, k) < arl else (lo, mid)
    return (lo + hi) / 2


def cooldown(events: DataFrame, gap: int, at: str = "k") -> DataFrame:
    """Of each symbol's events those at least `gap` after the last one kept. events: symbol, at (long) and payload columns.

    Which event is kept depends on all before it, so events - sparse by nature - are walked in order, by a binary search for each kept one.
    """
    rest = [c for c in events.columns if c not in ("symbol", at)]
    events = events.select("symbol", F.col(at).cast("long").alias(at), *rest)

    def keep(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in (at, *rest)])
        times, kept, i = group.column(at).to_numpy(), [], 0
        while i < len(times):
            kept.append(i)
            i = max(i + 1, int(np.searchsorted(times, times[i] + gap)))
        return group.take(pa.array(kept, pa.int64()))

    return events.groupBy("symbol").applyInArrow(keep, events.schema)


def trades(sim: DataFrame) -> DataFrame:
    """(symbol, ts, side, net) of each run of one position; the first flat row's cost is the exit of the run before it.

    sim: symbol, ts, pos, net.
    """
    before = F.coalesce(F.lag("pos").over(w()), F.lit(0.0))
    df = sim.withColumns({"_before": before})
    df = df.withColumn("_run", F.sum(((F.col("pos") != 0) & (F.col("pos") != F.col("_before"))).cast("int")).over(_upto()))
    kept = df.where((F.col("pos") != 0) | (F.col("_before") != 0))
    return kept.groupBy("symbol", "_run").agg(F.min("ts").alias("ts"), F.min_by("pos", "ts").alias("side"), F.sum("net").alias("net")).drop("_run")
