"""Paper accounts, trial ledgers and scans: keyed state as tables, each step one plan over all accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def copy_calls(accounts: DataFrame, calls: DataFrame, seen: DataFrame, now: Column, fresh: str, stake: float, fee: float) -> DataFrame:
    """Positions that accounts open: fresh calls not copied before, one for each configuration, in order, while cash lasts.

    accounts: account, cash. calls: account, key, config, symbol, signal_time, price. The cash limit is sequential but linear: calls are
    ranked and the running sum of stakes is held against the cash.
    """
    new = calls.join(seen.select("account", "key"), ["account", "key"], "left_anti").where(F.col("signal_time") >= now - F.expr(f"INTERVAL {fresh}"))
    first = Window.partitionBy("account", "config").orderBy("signal_time", "key")
    one = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy("account").orderBy("signal_time", "key").rowsBetween(Window.unboundedPreceding, 0)
    cost = stake * (1 + fee)
    ranked = one.join(accounts, "account").withColumn("_spent", F.count("*").over(order) * F.lit(cost))
    return ranked.where(F.col("_spent") <= F.col("cash")).select("account", "key", "config", "symbol", "signal_time", "price", F.lit(stake).alias("stake"), (F.lit(stake) / F.col("price")).alias("qty"), F.lit(stake * fee).alias("fee"))


def close_due(positions: DataFrame, prices: DataFrame, now: Column, fee: float) -> DataFrame:
    """Positions whose time is over, sold at the price if there is one: key, proceeds, net share."""
    due = positions.where(F.col("exit_time") <= now).join(prices, "symbol", "left").where("price_now IS NOT NULL")
    proceeds = F.col("qty") * F.col("price_now") * (1 - fee)
    return due.select("account", "key", "config", "symbol", proceeds.alias("proceeds"), (proceeds / (F.col("qty") * F.col("price") * (1 + fee)) - 1).alias("net"))


def account_value(accounts: DataFrame, holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Cash and holdings at the latest prices; NULL if a held symbol has none."""
    worth = holdings.join(prices, "symbol", "left").groupBy("account").agg(F.sum(F.col("qty") * F.col("price")).alias("held"), F.count_if(F.col("price").isNull()).alias("missing"))
    return accounts.join(worth, "account", "left").select("account", F.when(F.coalesce("missing", F.lit(0)) == 0, F.col("cash") + F.coalesce("held", F.lit(0.0))).alias("value"))


def config_stats(trades: DataFrame) -> DataFrame:
    """Trades, wins, net and fees for each configuration."""
    return trades.groupBy("config").agg(F.count("*").alias("trades"), F.count_if(F.col("net") > 0).alias("wins"), F.sum("net").alias("net"), F.sum("fee").alias("fees"))


def go_live(value: DataFrame, days: int = 90, trades: int = 30) -> DataFrame:
    """Whether an account may go live: value has account, days, trades, profit, hold_profit, validated."""
    tests = {"days": F.col("days") >= days, "trades": F.col("trades") >= trades, "profitable": F.col("profit") > 0, "beats_hold": F.col("profit") > F.col("hold_profit"), "validated": F.col("validated")}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items()]))
    return value.select("account", failed.alias("failed"), (F.size(failed) == 0).alias("ready"))


def missed_windows(cursor: DataFrame, now: Column, longest: str, least: str) -> DataFrame:
    """(account, from, to) to replay after a break: none if shorter than `least`, the last `longest` otherwise."""
    gap = now - F.col("cursor")
    return cursor.where(gap > F.expr(f"INTERVAL {least}")).select("account", F.greatest(F.col("cursor"), now - F.expr(f"INTERVAL {longest}")).alias("from"), now.alias("to"))


def ledger_matrix(returns: DataFrame, ids: list[str]) -> DataFrame:
    """Wide table of trial returns by time, missing periods 0. returns: id, ts, ret; ids are the columns that are wanted."""
    return returns.groupBy("ts").pivot("id", ids).agg(F.first("ret")).fillna(0.0, subset=ids)


def save_json(report: DataFrame, path: str) -> None:
    """Reports as JSON lines; NaN becomes null."""
    clean = report.select([F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in report.dtypes])
    clean.write.mode("overwrite").json(path)


def append_daily(rows: DataFrame, path: str) -> None:
    """Append to a table partitioned by symbol and date."""
    rows.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("symbol", "date").parquet(path)


def registry(spark: SparkSession, path: str, summary: DataFrame) -> DataFrame:
    """Stored configurations with the verdict of the summary where it has one (it is adjusted for the number of trials)."""
    stored = spark.read.json(path)
    return stored.join(summary.select("config", F.col("verdict").alias("adjusted")), "config", "left").withColumn("verdict", F.coalesce("adjusted", "verdict")).drop("adjusted")


def scan_status(rows: DataFrame) -> DataFrame:
    """BUY, AVOID, WAIT or NOT VALIDATED from verdict, direction, confidence and threshold."""
    sure = F.col("confidence") >= F.col("threshold")
    status = F.when(F.col("verdict") != "POSSIBLE EDGE", "NOT VALIDATED").when(sure & (F.col("direction") == "UP"), "BUY").when(sure & (F.col("direction") == "DOWN"), "AVOID").otherwise("WAIT")
    rank = F.when(status == "BUY", 0).when(status == "AVOID", 1).when(status == "WAIT", 2).otherwise(3)
    return rows.withColumns({"status": status, "rank": rank}).orderBy("rank", F.desc("confidence"), "symbol")


def edge_verdict(p_value: Column, strategy: Column, hold: Column) -> Column:
    """Significance and profit together."""
    profit = (strategy > 0) & (strategy > hold)
    return F.when((p_value < 0.05) & profit, "POSSIBLE EDGE").when(p_value < 0.05, "NO PROFIT").when(profit, "UNPROVEN").otherwise("NO EDGE")


def toy_backtest(rows: DataFrame, every: int, fee: float) -> DataFrame:
    """Each symbol's every n-th row's position and return, a fee on each change, compounded. rows: symbol, k, pos, ret."""
    order = Window.partitionBy("symbol").orderBy("k")
    x = rows.where(F.pmod(F.col("k"), F.lit(every)) == 0).withColumn("_step", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(order), F.lit(0))))
    growth = 1 + F.col("pos") * F.col("ret") - F.col("_step") * fee
    return x.groupBy("symbol").agg(F.sum("_step").alias("changes"), (F.product(growth) - 1).alias("total"))


def choose_threshold(table: DataFrame, least: int = 30, fallback: float = 0.5) -> DataFrame:
    """The threshold of the greatest strategy return among those with enough calls; the first of equals."""
    ok = table.where(F.col("calls") >= least)
    best = ok.agg(F.max_by("threshold", F.struct("strategy_return", -F.col("threshold"))).alias("t"))
    return best.select(F.coalesce("t", F.lit(fallback)).alias("threshold"))
