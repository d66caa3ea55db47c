"""Calendar events, round numbers, chart patterns and volatility forecasts."""

from __future__ import annotations

from itertools import groupby

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import w

# Days on which the New York exchange is closed, by month and day, besides weekends and moving holidays.
FIXED_HOLIDAYS = [(1, 1), (6, 19), (7, 4), (12, 25)]
SPAN, TOLERANCE, OLD_ENOUGH, APART = 38, 0.015, 3, 22
BANDWIDTHS = [0.5 + 0.1 * k for k in range(96)]


def new_york_closes(days: DataFrame, closed: DataFrame) -> DataFrame:
    """16:00 in New York of each trading day, as UTC. days and closed: day (date)."""
    open_ = days.where(F.weekday("day") < 5).join(closed, "day", "left_anti")
    return open_.select("day", F.to_utc_timestamp(F.to_timestamp_ntz(F.concat(F.col("day").cast("string"), F.lit(" 16:00:00"))).cast("timestamp"), "America/New_York").cast("timestamp_ntz").alias("ts"))


def last_friday(day: Column) -> Column:
    """Last Friday of the day's month: the monthly expiry."""
    end = F.last_day(day)
    return F.date_sub(end, F.pmod(F.weekday(end) - 4, F.lit(7)).cast("int"))


def round_step(reference: Column) -> Column:
    """Half a power of ten below the reference's magnitude."""
    return F.pow(F.lit(10.0), F.floor(F.log10(reference)) - 1) / 2


def round_breaks(bars: DataFrame, reference: str, offset: float = 0.0, share: float = 0.001) -> DataFrame:
    """+1 where a close breaks a round level upwards by `share`, -1 downwards. offset moves the levels, for controls."""
    step = round_step(F.col(reference))
    shift = offset * 2 * step
    before = F.lag("close").over(w())
    level = F.floor((before - shift) / step) * step + shift
    df = bars.withColumns({"_b": before, "_lo": level, "_hi": level + step})
    up = (F.col("close") >= F.col("_hi") * (1 + share)) & (F.col("_b") < F.col("_hi"))
    down = (F.col("close") <= F.col("_lo") * (1 - share)) & (F.col("_b") > F.col("_lo"))
    return df.withColumn("signal", F.when(F.coalesce(up, F.lit(False)), 1).when(F.coalesce(down, F.lit(False)), -1).otherwise(0)).drop("_b", "_lo", "_hi")


def smallest_tick(bars: DataFrame) -> DataFrame:
    """(symbol, day, tick): the smallest positive move of the day before."""
    move = F.abs(F.col("close") - F.lag("close").over(w()))
    day = bars.withColumn("_m", move).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min(F.when(F.col("_m") > 0, F.col("_m"))).alias("_t"))
    return day.select("symbol", "day", F.lag("_t").over(Window.partitionBy("symbol").orderBy("day")).alias("tick"))


def _smooth(y: np.ndarray) -> np.ndarray:
    """Kernel regression on time; the bandwidth of the least leave-one-out error, narrowed."""
    t = np.arange(len(y), dtype=float)
    square = (t[:, None] - t[None, :]) ** 2
    best, error = BANDWIDTHS[0], math.inf
    for h in BANDWIDTHS:
        k = np.exp(-square / (2 * h * h))
        np.fill_diagonal(k, 0.0)
        e = float(np.mean((y - k @ y / np.maximum(k.sum(axis=1), 1e-300)) ** 2))
        if e < error:
            best, error = h, e
    k = np.exp(-square / (2 * (0.3 * best) ** 2))
    return k @ y / k.sum(axis=1)


def _extrema(smooth: np.ndarray, closes: np.ndarray) -> list[tuple[int, int, float]]:
    """(+1 for a maximum or -1, position, close), alternating.

    A turn of the smoothed path stands for the most extreme close among its own and its two neighbouring bars. Turns whose close is one of
    the last OLD_ENOUGH bars are not confirmed yet. Of turns of one kind in a row the most extreme counts, the first of equals.
    """
    slope = np.sign(np.diff(smooth))
    turns = []
    for i in np.flatnonzero(slope[:-1] * slope[1:] < 0) + 1:
        kind = int(slope[i - 1])
        at = int(i - 1 + np.argmax(kind * closes[i - 1 : i + 2]))
        if at < len(closes) - OLD_ENOUGH:
            turns.append((kind, at, float(closes[at])))
    return [max(run, key=lambda t: t[0] * t[2]) for _, run in groupby(turns, key=lambda t: t[0])]


def _pattern(turns: list[tuple[int, int, float]]) -> int:
    """-1 for head and shoulders in the last five turns or a double top, +1 for their mirrors, 0 otherwise.

    A double is the first turn of the window and the most extreme later one of its kind, more than APART bars on.
    """
    near = lambda x, y: abs(x - y) <= TOLERANCE * (x + y) / 2
    if len(turns) >= 5:
        side, (a, b, c, d, e) = turns[-5][0], [t[2] for t in turns[-5:]]
        if near(a, e) and near(b, d) and side * (c - a) > 0 and side * (c - e) > 0:
            return -side
    if turns:
        side, at, price = turns[0]
        later = [side * t[2] for t in turns[1:] if t[0] == side and t[1] - at > APART]
        if later and near(price, side * max(later)):
            return -side
    return 0


def chart_patterns(bars: DataFrame) -> DataFrame:
    """(symbol, ts, signal) of kernel-smoothed patterns in windows of SPAN bars; after a signal SPAN bars are left out.

    A search over extrema of a smoothed path has no relational form: each symbol's series goes through pandas, one at a time.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["close"]).sort_values("ts")
        close, out, free = pdf["close"].to_numpy(float), [], 0
        for end in range(SPAN, len(close) + 1):
            if end - 1 < free:
                continue
            part = close[end - SPAN : end]
            if signal := _pattern(_extrema(_smooth(part), part)):
                out.append((pdf["symbol"].iloc[0], pdf["ts"].iloc[end - 1], signal))
                free = end - 1 + SPAN
        return pd.DataFrame(out, columns=["symbol", "ts", "signal"])

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(one, "symbol string, ts timestamp_ntz, signal int")


def realised_features(df: DataFrame, variance: str, day: int, week: int, month: int) -> dict[str, Column]:
    """Log means of past variance over a day, a week and a month: the inputs of the forecast."""
    mean = lambda n: F.when(F.count(variance).over(w().rowsBetween(-n, -1)) >= n, F.avg(variance).over(w().rowsBetween(-n, -1)))
    return {"har_day": F.ln(mean(day) + 1e-12), "har_week": F.ln(mean(week) + 1e-12), "har_month": F.ln(mean(month) + 1e-12)}


def least_squares(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """Coefficients of y on xs with an intercept for each group: sums in one aggregate, a small solve for each group's row."""
    cols = ["_one", *xs]
    d = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])).withColumn("_one", F.lit(1.0))
    k = len(cols)
    sums = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(c) * F.col(y)).alias(f"v{i}") for i, c in enumerate(cols)]
    g = d.groupBy(*by).agg(F.count("*").alias("n"), *sums)

    def solve(it):
        for pdf in it:
            out = []
            for _, r in pdf.iterrows():
                m = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        m[i, j] = m[j, i] = r[f"g{i}_{j}"]
                beta = np.linalg.lstsq(m, np.array([r[f"v{i}"] for i in range(k)]), rcond=None)[0]
                out.append((*[r[b] for b in by], int(r["n"]), *map(float, beta)))
            yield pd.DataFrame(out, columns=[*by, "n", "intercept", *[f"b_{x}" for x in xs]])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return g.mapInPandas(solve, ", ".join([f"{b} {kinds[b]}" for b in by] + ["n long", "intercept double"] + [f"b_{x} double" for x in xs]))


def qlike(actual: Column, forecast: Column) -> Column:
    ratio = actual / forecast
    return ratio - F.ln(ratio) - 1
