"""Cross-sections: terciles, weekly books, momentum, regressions by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as X
from tidemark.operators.grid import rows, w


def terciles(df: DataFrame, value: str, name: str = "leg") -> DataFrame:
    """+1 for the highest third of a date's values, -1 for the lowest, 0 else; n // 3 each, ties by symbol."""
    per = Window.partitionBy("ts")
    high, low = F.row_number().over(per.orderBy(F.desc(value), "symbol")), F.row_number().over(per.orderBy(value, F.desc("symbol")))
    third = F.floor(F.count(value).over(per) / 3)
    seen = df.where(F.col(value).isNotNull()).withColumns({"_h": high, "_l": low, "_t": third})
    return seen.withColumn(name, F.when(F.col("_h") <= F.col("_t"), 1).when(F.col("_l") <= F.col("_t"), -1).otherwise(0)).drop("_h", "_l", "_t")


def target_weights(legs: DataFrame, leg: str = "leg") -> DataFrame:
    """Equal weights within a date's long leg."""
    n = F.sum((F.col(leg) == 1).cast("int")).over(Window.partitionBy("ts"))
    return legs.withColumn("weight", F.when(F.col(leg) == 1, 1.0 / F.nullif(n, F.lit(0))).otherwise(0.0))


def weekly_turnover(weights: DataFrame, cost: Column) -> DataFrame:
    """(ts, turnover, cost): change of target weights against the week before, with symbols that left or entered.

    weights: symbol, ts (a week's start), weight; a symbol that is missing has weight 0. Full outer by (symbol, week).
    """
    now = weights.select("symbol", "ts", "weight")
    before = weights.select("symbol", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts"), F.col("weight").alias("old"))
    both = now.join(before, ["symbol", "ts"], "full").fillna(0.0, subset=["weight", "old"])
    weeks = now.select("ts").distinct()
    moved = both.join(F.broadcast(weeks), "ts", "left_semi").groupBy("ts").agg(F.sum(F.abs(F.col("weight") - F.col("old"))).alias("turnover"))
    return moved.withColumn("cost", F.col("turnover") * cost)


def momentum_book(prices: DataFrame, lookback: int, one_side: float) -> DataFrame:
    """(ts, gross, turnover, net): the next week's mean return of the highest third by past return, less costs."""
    x = prices.withColumns({"mom": F.ln(F.col("close") / F.lag("close", lookback).over(w())), "fwd": F.lead("close").over(w()) / F.col("close") - 1})
    picked = target_weights(terciles(x.where("mom IS NOT NULL AND fwd IS NOT NULL"), "mom"))
    gross = picked.groupBy("ts").agg(F.sum(F.col("weight") * F.col("fwd")).alias("gross"))
    moved = weekly_turnover(picked.where("weight > 0"), F.lit(one_side))
    return gross.join(moved, "ts", "left").fillna(0.0, subset=["turnover", "cost"]).withColumn("net", F.col("gross") - F.col("cost"))


def drifted_book(prices: DataFrame, weights: DataFrame, one_side: float) -> DataFrame:
    """As momentum_book, but turnover counts from where prices have carried the old weights.

    weights: symbol, ts, weight with fwd, the simple return until the next week.
    """
    total = Window.partitionBy("ts")
    grown = weights.withColumn("_g", F.col("weight") * (1 + F.coalesce("fwd", F.lit(0.0))))
    drift = grown.withColumn("old", F.col("_g") / F.nullif(F.sum("_g").over(total), F.lit(0.0)))
    carried = drift.select("symbol", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts"), "old")
    both = weights.select("symbol", "ts", "weight").join(carried, ["symbol", "ts"], "full").fillna(0.0, subset=["weight", "old"])
    moved = both.join(F.broadcast(weights.select("ts").distinct()), "ts", "left_semi").groupBy("ts").agg(F.sum(F.abs(F.col("weight") - F.col("old"))).alias("turnover"))
    gross = weights.groupBy("ts").agg(F.sum(F.col("weight") * F.col("fwd")).alias("gross"))
    return gross.join(moved, "ts").withColumn("net", F.col("gross") - F.col("turnover") * one_side)


def nearness(n: int, least: int) -> Column:
    """Close over the highest close of the last n rows."""
    return F.col("close") / X.rolling("max", "close", n, least)


def largest_moves(n: int, least: int, column: str = "ret") -> Column:
    return X.rolling("max", column, n, least)


def residual_volatility(n: int, y: str = "ret", x: str = "mkt") -> Column:
    """Standard deviation of what a trailing regression on the market leaves, from window sums."""
    f = rows(n)
    sd, r = F.stddev_samp(y).over(f), F.corr(y, x).over(f)
    return F.when(F.count(y).over(f) >= n, sd * F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))


def month_window(ts: Column, start_offset: int, days: int = 4) -> Column:
    """1 within `days` days from a month's start plus an offset (negative: the end of the month before)."""
    day = F.to_date(ts)
    dist = F.datediff(day, F.trunc(day, "month"))
    to_next = F.datediff(day, F.add_months(F.trunc(day, "month"), 1))
    inside = lambda d: (d >= start_offset) & (d < start_offset + days)
    return (inside(dist) | inside(to_next)).cast("int")


def circular_shift(df: DataFrame, column: str, by: int, name: str) -> DataFrame:
    """The column moved on by `by` rows within a symbol, from the end to the beginning: one equi join on row numbers."""
    all_ = Window.partitionBy("symbol")
    x = df.withColumns({"_k": F.row_number().over(w()) - 1, "_n": F.count("*").over(all_)})
    side = x.select("symbol", F.pmod(F.col("_k") + by, F.col("_n")).alias("_k"), F.col(column).alias(name))
    return x.join(side, ["symbol", "_k"]).drop("_k", "_n")


def efficiency_gate(n: int, reference: int, p: float = 0.5) -> dict[str, Column]:
    """Net move over path, and whether it reaches the given quantile of its own past."""
    path = X.rolling("sum", "absr", n)
    ratio = F.abs(F.ln(F.col("close") / F.lag("close", n).over(w()))) / F.nullif(path, F.lit(0.0))
    return {"ratio": ratio, "gate": F.coalesce(F.col("ratio") >= X.rolling_quantile("ratio", reference, p), F.lit(False))}


def jump_exclusion(moves: DataFrame, share: float = 0.8) -> DataFrame:
    """(symbol, week, jump, kept): a week's largest squared move over their sum, and whether it is within the week's quantile.

    moves: symbol, ts, r.
    """
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    own = moves.where("r IS NOT NULL").groupBy("symbol", week.alias("week")).agg((F.max(F.col("r") * F.col("r")) / F.nullif(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).alias("jump"))
    cut = own.groupBy("week").agg(F.percentile("jump", F.lit(share)).alias("_cut"))
    return own.join(cut, "week").select("symbol", "week", "jump", (F.col("jump") <= F.col("_cut")).alias("kept"))
