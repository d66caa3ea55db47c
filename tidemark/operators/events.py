"""Event signals (-1, 0, +1 for each bar), outcomes and matched placebos."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as X
from tidemark.operators.grid import at_time, w
from tidemark.operators.labels import log_fill


def no_gaps(n: int) -> Column:
    return X.trailing_sum(F.col("gap").cast("double"), n) == 0


def true(c: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(c, F.lit(False))


def z_score(n: int) -> Column:
    """Move of n rows in units of the per-row scale `sigma`."""
    return X.log_return(n) / (F.col("sigma") * math.sqrt(n) + 1e-12)


def with_sigma(grid: DataFrame, n: int) -> DataFrame:
    """Log close and a trailing root mean square of one-row moves."""
    df = grid.withColumn("lc", X.log_close())
    df = df.withColumn("r2", F.pow(F.col("lc") - F.lag("lc").over(w()), 2.0))
    return df.withColumn("sigma", F.sqrt(X.rolling("avg", "r2", n, n)))


def reversal(n: int, at: Column) -> Column:
    """Against the last n rows' move, on rows where `at` holds."""
    return F.when(true(at & no_gaps(n)), -F.signum(X.log_return(n))).otherwise(0.0)


def flow_reversal(n: int, k: float, percentile: str, share: float = 0.8) -> Column:
    """Against a large move that flow of the same sign, unusual in size, went with."""
    r = X.log_return(n)
    hit = (F.signum(X.imbalance(n)) == F.signum(r)) & (F.abs(z_score(n)) >= k) & (F.col(percentile) >= share) & no_gaps(n)
    return F.when(true(hit), -F.signum(r)).otherwise(0.0)


def cascade(n: int, k: float, intensity: str, flow: float = 0.3, times: float = 3.0) -> Column:
    z, imb = z_score(n), X.imbalance(n)
    busy = (F.col(intensity) >= times) & no_gaps(n)
    return F.when(true((z <= -k) & (imb <= -flow) & busy), 1.0).when(true((z >= k) & (imb >= flow) & busy), -1.0).otherwise(0.0)


def sweep_reclaim(n: int, age: int, ratio: str, wick: float = 0.5, times: float = 2.0) -> Column:
    """Through an extreme that is at least `age` rows old and back inside, with a long wick and much volume."""
    frame = w().rowsBetween(-(n - 1), -age)
    least = n - age - max(1, (n - age) // 10)
    hi = F.when(F.count("high").over(frame) >= least, F.max("high").over(frame))
    lo = F.when(F.count("low").over(frame) >= least, F.min("low").over(frame))
    span = F.col("high") - F.col("low") + 1e-12
    before = F.exp(F.lag("lc").over(w()))
    upper, lower = (F.col("high") - F.greatest("close", before)) / span, (F.least("close", before) - F.col("low")) / span
    much = F.col(ratio) >= times
    up = true((F.col("high") > hi) & (F.col("close") < hi) & (upper >= wick) & much)
    down = true((F.col("low") < lo) & (F.col("close") > lo) & (lower >= wick) & much)
    return F.when(up, -1.0).when(down, 1.0).otherwise(0.0)


def breakout(n: int, flow: int) -> Column:
    """A close beyond the highest or lowest of the n rows before, with flow on its side."""
    hi, lo = X.rolling("max", "high", n, n * 9 // 10, upto=-1), X.rolling("min", "low", n, n * 9 // 10, upto=-1)
    imb = X.imbalance(flow)
    return F.when(true((F.col("close") > hi) & (imb > 0)), 1.0).when(true((F.col("close") < lo) & (imb < 0)), -1.0).otherwise(0.0)


def weekend(hours: int = 52, past: int = 26, least: int = 20, k: float = 1.5) -> Column:
    """Monday 00:00 against the move since Friday 20:00, if it is large beside those of the weekends before.

    Needs a column weekend_move on those rows only, and is used over them.
    """
    frame = w().rowsBetween(-past, -1)
    sd = F.when(F.count("weekend_move").over(frame) >= least, F.stddev_pop("weekend_move").over(frame))
    z = F.col("weekend_move") / (sd + 1e-12)
    return F.when(true(F.abs(z) >= k), -F.signum("weekend_move")).otherwise(0.0)


def own_or_market(n: int, k: float, market: str, breadth: str) -> dict[str, Column]:
    """A large move alone is faded, one of the whole market followed."""
    r, z = X.log_return(n), z_score(n)
    big = (F.abs(z) >= k) & no_gaps(n)
    same = F.when(r > 0, F.col(breadth)).otherwise(1 - F.col(breadth))
    alone = big & (same < 0.5) & (F.abs(r - F.col(market)) / (F.col("sigma") * math.sqrt(n) + 1e-12) >= 3)
    return {"own": F.when(true(alone), -F.signum(r)).otherwise(0.0), "market": F.when(true(big & (same >= 0.8)), F.signum(r)).otherwise(0.0)}


def outcomes(events: DataFrame, bars: DataFrame, horizon: int, latency: int, step: str) -> DataFrame:
    """Directional log return from latency rows after the event over the horizon; no gap may lie in between.

    events: symbol, ts, dir. bars: a complete grid with sigma.
    """
    n, unit = step.split()
    side = bars.withColumn("fill", log_fill()).withColumn("_g", F.sum(F.col("gap").cast("int")).over(w().rowsBetween(Window.unboundedPreceding, 0)))
    shift = lambda k: f"{int(n) * k} {unit}"
    df = events.join(side.select("symbol", "ts", F.col("_g").alias("g0"), "sigma"), ["symbol", "ts"])
    df = at_time(df, side, shift(latency), "fill", "entry")
    df = at_time(df, side, shift(latency + horizon), "fill", "exit")
    df = at_time(df, side, shift(latency + horizon), "_g", "g1")
    ret = (F.col("exit") - F.col("entry")) * F.col("dir")
    return df.where("g1 = g0").select("symbol", "ts", "dir", ret.alias("ret"), (F.col("sigma") * math.sqrt(horizon)).alias("sigma_h"), F.hour("ts").alias("hour")).where("ret IS NOT NULL")


def placebo(events: DataFrame, pool: DataFrame, per_event: int) -> DataFrame:
    """Times of the same hour and scale tercile with the event's direction; the pool is taken as it is, events included.

    pool: symbol, ts, sigma. Ranks within strata and a fixed index instead of random draws: an equi join, no theta join.
    """
    cut = pool.groupBy("symbol").agg(F.percentile("sigma", F.array(F.lit(0.333), F.lit(0.667))).alias("_q"))
    stratum = lambda df: df.join(F.broadcast(cut), "symbol").withColumns({"_h": F.hour("ts"), "_t": (F.col("sigma") >= F.col("_q")[0]).cast("int") + (F.col("sigma") >= F.col("_q")[1]).cast("int")})
    keys = ["symbol", "_h", "_t"]
    p = stratum(pool)
    p = p.withColumns({"_i": F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1})
    sizes = p.groupBy(*keys).agg(F.count("*").alias("_n"))
    e = stratum(events.join(pool, ["symbol", "ts"])).withColumn("_e", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)
    e = e.join(sizes, keys).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(per_event - 1)))).withColumn("_i", F.pmod(F.col("_e") * 7919 + F.col("_j") * 104729, F.col("_n")))
    return e.select(*keys, "_i", F.col("ts").alias("event_ts"), "dir").join(p.select(*keys, "_i", "ts"), [*keys, "_i"]).select("symbol", "event_ts", "ts", "dir")
