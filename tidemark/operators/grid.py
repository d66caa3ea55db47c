"""Resampling, grid completion, gaps and as-of alignment. One shuffle on symbol serves every window of a chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SUMS = ["volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]


def w() -> WindowSpec:
    """A symbol's rows in order of time: the one specification that lets consecutive windows share a sort."""
    return Window.partitionBy("symbol").orderBy("ts")


def rows(n: int, upto: int = 0):
    """The last n rows up to `upto` rows from the current one."""
    return w().rowsBetween(upto - n + 1, upto)


def complete(bars: DataFrame, step: str) -> DataFrame:
    """Every step between a symbol's first and last bar; on gaps prices are NULL, sums 0 and gap is true."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("ts"))
    joined = grid.join(bars, ["symbol", "ts"], "left")
    return joined.withColumn("gap", F.col("close").isNull()).fillna(0, subset=[c for c in SUMS if c in bars.columns])


def resample(bars: DataFrame, rule: str, step: str, offset: str = "0 hours", drop_unfinished: bool = True) -> DataFrame:
    """Right-closed, right-labelled bars of `rule` from bars of `step`; the unfinished last bar is dropped, a partial first is kept."""
    opened = F.col("ts") - F.expr(f"INTERVAL {step}")
    seen = F.col("close").isNotNull()
    out = bars.withColumn("gap", F.col("gap") if "gap" in bars.columns else F.lit(False)).groupBy("symbol", F.window(opened, rule, rule, offset).alias("w")).agg(
        F.min_by("open", F.when(seen, F.col("ts"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(seen, F.col("ts"))).alias("close"), *[F.sum(c).alias(c) for c in SUMS],
        F.avg(F.col("gap").cast("double")).alias("gap_frac"), F.max("ts").alias("last"),
    )
    out = out.withColumn("ts", F.col("w.end").cast("timestamp_ntz"))
    if drop_unfinished:
        newest = Window.partitionBy("symbol")
        out = out.withColumn("newest", F.max("last").over(newest)).where(F.col("ts") <= F.col("newest"))
    return out.select("symbol", "ts", "open", "high", "low", "close", *SUMS, "gap_frac")


def gap_runs(grid: DataFrame) -> DataFrame:
    """(symbol, start, end, length) of each run of gap rows."""
    run = F.row_number().over(w()) - F.row_number().over(Window.partitionBy("symbol", "gap").orderBy("ts"))
    return grid.withColumn("run", run).where("gap").groupBy("symbol", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("length")).drop("run")


def quality(grid: DataFrame) -> DataFrame:
    """Per symbol: rows, missing share, longest gap, bars without volume or with impossible prices, largest one-step move."""
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    real = grid.where(~F.col("gap")).withColumn("move", F.abs(F.ln("close") - F.ln(F.lag("close").over(w()))))
    base = grid.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.avg(F.col("gap").cast("double")).alias("missing"))
    seen = real.groupBy("symbol").agg(F.count_if(F.col("volume") <= 0).alias("no_volume"), F.count_if(bad).alias("bad_prices"), F.max("move").alias("largest_move"))
    longest = gap_runs(grid).groupBy("symbol").agg(F.max("length").alias("longest_gap"))
    return base.join(seen, "symbol", "left").join(longest, "symbol", "left").fillna(0, subset=["longest_gap", "no_volume", "bad_prices"])


def ffill(column: str | Column, limit: int | None = None) -> Column:
    """Last value that is not NULL, at most limit rows old."""
    return F.last(column, ignorenulls=True).over(w().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def asof(left: DataFrame, right: DataFrame, columns: Sequence[str], by: Sequence[str] = ("symbol",), max_age: str | None = None) -> DataFrame:
    """For each left (by, ts) the columns of the last right row with ts at or before it, as they are, NULLs included.

    Union, one sort by (by, ts) and a running last: n log n, without a range join. max_age: an interval; older rows give NULLs.
    A right row at the very time counts. left keeps its other columns.
    """
    keys = list(by)
    payload = F.struct(F.col("ts").alias("asof_ts"), *columns)
    own = [c for c in left.columns if c not in (*keys, "ts")]
    a = left.select(*keys, "ts", F.lit(1).alias("side"), F.struct(*own).alias("own") if own else F.lit(None).alias("own"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("payload"))
    b = right.select(*keys, "ts", F.lit(0).alias("side"), F.lit(None).cast(a.schema["own"].dataType).alias("own"), payload.alias("payload"))
    order = Window.partitionBy(*keys).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("found", F.last("payload", ignorenulls=True).over(order)).where("side = 1")
    fresh = F.lit(True) if max_age is None else F.col("ts") - F.col("found.asof_ts") <= F.expr(f"INTERVAL {max_age}")
    return out.select(*keys, "ts", *([F.col(f"own.{c}").alias(c) for c in own]), *[F.when(fresh, F.col(f"found.{c}")).alias(c) for c in ("asof_ts", *columns)])


def at_time(df: DataFrame, lookup: DataFrame, shift: str, column: str, name: str) -> DataFrame:
    """Equi lookup of column at ts + shift; NULL if there is no such row."""
    side = lookup.select("symbol", (F.col("ts") - F.expr(f"INTERVAL {shift}")).alias("ts"), F.col(column).alias(name))
    return df.join(side, ["symbol", "ts"], "left")
