"""Live side: data health, books, vetoes, consensus, paper trades and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import w


def data_health(grid: DataFrame, now: Column, stale: str, most_gaps: float, jump: float, recent: int) -> DataFrame:
    """Per symbol over the last rows: age, gap share, largest one-row move, and what is wrong."""
    last = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    df = grid.withColumn("_move", F.abs(F.ln("close") - F.ln(F.lag("close").over(w())))).withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= recent)
    a = df.groupBy("symbol").agg(F.max(F.when(~F.col("gap"), F.col("ts"))).alias("last_ts"), F.avg(F.col("gap").cast("double")).alias("gaps"), F.coalesce(F.max("_move"), F.lit(0.0)).alias("jump"))
    tests = [(F.coalesce(now - F.col("last_ts") > F.expr(f"INTERVAL {stale}"), F.lit(True)), "stale"), (F.col("gaps") > most_gaps, "gaps"), (F.col("jump") > jump, "jump")]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))
    return a.select("symbol", "last_ts", "gaps", "jump", F.concat_ws(",", problems).alias("problems"), (F.size(problems) == 0).alias("ok"))


def book_walk(levels: DataFrame, notional: float) -> DataFrame:
    """(book, side, vwap, filled): average price to fill a notional, level by level. levels: book, side ('ask'/'bid'), px, qty.

    Running notional per side; NULL vwap if the book is too thin. One window over each book's levels.
    """
    order = Window.partitionBy("book", "side").orderBy(F.when(F.col("side") == "ask", F.col("px")).otherwise(-F.col("px")))
    x = levels.withColumn("_v", F.col("px") * F.col("qty")).withColumn("_before", F.sum("_v").over(order) - F.col("_v"))
    take = F.greatest(F.lit(0.0), F.least(F.col("_v"), F.lit(notional) - F.col("_before")))
    agg = x.withColumn("_t", take).groupBy("book", "side").agg(F.sum("_t").alias("filled"), F.sum(F.col("_t") / F.col("px")).alias("_q"))
    return agg.select("book", "side", "filled", F.when(F.col("filled") >= notional - 1e-9, F.col("filled") / F.col("_q")).alias("vwap"))


def book_summary(levels: DataFrame, notional: float) -> DataFrame:
    """Spread and impact of buying and selling, in basis points of the middle."""
    top = levels.groupBy("book").agg(F.min(F.when(F.col("side") == "ask", F.col("px"))).alias("ask"), F.max(F.when(F.col("side") == "bid", F.col("px"))).alias("bid"))
    fills = book_walk(levels, notional).groupBy("book").agg(F.max(F.when(F.col("side") == "ask", F.col("vwap"))).alias("buy"), F.max(F.when(F.col("side") == "bid", F.col("vwap"))).alias("sell"))
    mid = (F.col("ask") + F.col("bid")) / 2
    return top.join(fills, "book").select("book", ((F.col("ask") - F.col("bid")) / mid * 1e4).alias("spread_bps"), ((F.col("buy") / mid - 1) * 1e4).alias("buy_impact_bps"), ((1 - F.col("sell") / mid) * 1e4).alias("sell_impact_bps"))


def consensus(signals: DataFrame, health: DataFrame) -> DataFrame:
    """One verdict per symbol. signals: symbol, specialist, action (LONG/SHORT/NO TRADE), view, validated, expected_edge_bps.

    Unhealthy data or validated signals of both directions give NO TRADE; else the validated action of the greatest edge.
    """
    live = F.col("validated") & F.col("action").isin("LONG", "SHORT")
    g = signals.groupBy("symbol").agg(
        F.max((live & (F.col("action") == "LONG")).cast("int")).alias("_l"), F.max((live & (F.col("action") == "SHORT")).cast("int")).alias("_s"),
        F.max_by("action", F.when(live, F.struct("expected_edge_bps", "specialist"))).alias("_a"), F.max(F.when(live, F.col("expected_edge_bps"))).alias("edge_bps"),
        F.count_if(F.col("view") > 0).alias("views_up"), F.count_if(F.col("view") < 0).alias("views_down"), F.count("*").alias("views"),
    ).join(health.select("symbol", "ok"), "symbol", "left")
    verdict = F.when(~F.coalesce("ok", F.lit(False)), "NO TRADE").when((F.col("_l") == 1) & (F.col("_s") == 1), "NO TRADE").when(F.col("_l") + F.col("_s") > 0, F.col("_a")).otherwise("NO TRADE")
    agreement = F.greatest("views_up", "views_down") / F.col("views")
    return g.select("symbol", verdict.alias("verdict"), F.when(verdict != "NO TRADE", F.col("edge_bps")).alias("edge_bps"), agreement.alias("agreement"))


def new_only(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not seen before, once each."""
    return rows.join(seen.select(key), key, "left_anti").dropDuplicates([key])


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order: a partial aggregate, not a sort of all rows."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def resolve_paper(trades: DataFrame, bars: DataFrame, cost: float) -> DataFrame:
    """Open trades closed by the prices at their entry and exit times; without either price a trade whose time is over is void.

    trades: key, symbol, side, entry_ts, exit_ts. bars: symbol, ts, close.
    """
    now = bars.groupBy("symbol").agg(F.max("ts").alias("_now"))
    price = bars.select("symbol", "ts", "close")
    df = trades.join(price.select("symbol", F.col("ts").alias("entry_ts"), F.col("close").alias("entry_price")), ["symbol", "entry_ts"], "left")
    df = df.join(price.select("symbol", F.col("ts").alias("exit_ts"), F.col("close").alias("exit_price")), ["symbol", "exit_ts"], "left").join(F.broadcast(now), "symbol", "left")
    due = F.coalesce(F.col("exit_ts") <= F.col("_now"), F.lit(False))
    priced = F.col("entry_price").isNotNull() & F.col("exit_price").isNotNull()
    status = F.when(~due, "open").when(priced, "closed").otherwise("void")
    net = F.when(status == "closed", F.col("side") * F.ln(F.col("exit_price") / F.col("entry_price")) - cost)
    return df.select("key", "symbol", "side", "entry_ts", "exit_ts", "entry_price", "exit_price", status.alias("status"), net.alias("net"))


def rebalance(accounts: DataFrame, prices: DataFrame, targets: DataFrame, fee: float, least: float = 1.0) -> DataFrame:
    """Orders that bring an account's holdings to equity * exposure / coins, sells first; nothing if a price is missing.

    accounts: account, cash, holdings map(symbol, qty). targets: account, symbol, exposure.
    """
    held = accounts.select("account", "cash", F.explode_outer("holdings").alias("symbol", "qty")).where("symbol IS NOT NULL")
    both = targets.join(held.select("account", "symbol", "qty"), ["account", "symbol"], "full").join(prices, "symbol", "left").join(accounts.select("account", "cash"), "account")
    per = Window.partitionBy("account")
    df = both.withColumns({"qty": F.coalesce("qty", F.lit(0.0)), "exposure": F.coalesce("exposure", F.lit(0.0))})
    df = df.withColumns({"_all": F.min(F.col("price").isNotNull().cast("int")).over(per), "_coins": F.greatest(F.sum((F.col("exposure") > 0).cast("int")).over(per), F.lit(1)), "_equity": F.col("cash") + F.sum(F.col("qty") * F.col("price")).over(per)})
    delta = F.col("_equity") * F.col("exposure") / F.col("_coins") - F.col("qty") * F.col("price")
    df = df.where("_all = 1").withColumn("delta", delta).where(F.abs("delta") >= least)
    order = per.orderBy((F.col("delta") > 0).cast("int"), "symbol")
    return df.select("account", "symbol", F.when(F.col("delta") < 0, "SELL").otherwise("BUY").alias("side"), F.abs("delta").alias("value"), (F.abs("delta") * fee).alias("fee"), F.row_number().over(order).alias("step"))


def regime_snapshot(grid: DataFrame, short: int, long: int) -> DataFrame:
    """Last row per symbol: short and long volatility, their ratio, and the trend's direction."""
    r = F.ln("close") - F.ln(F.lag("close").over(w()))
    df = grid.where(~F.col("gap")).withColumn("_r", r)
    s, l = (F.stddev_samp("_r").over(w().rowsBetween(-(n - 1), 0)) for n in (short, long))
    df = df.withColumns({"vol_short": s, "vol_long": l, "trend": F.when(F.col("close") > F.avg("close").over(w().rowsBetween(-(long - 1), 0)), "up").otherwise("down")})
    pick = F.max_by(F.struct("ts", "vol_short", "vol_long", "trend"), "ts")
    state = F.when(F.col("r.vol_short") > 1.5 * F.col("r.vol_long"), "high").when(F.col("r.vol_short") < F.col("r.vol_long") / 1.5, "low").otherwise("normal")
    return df.groupBy("symbol").agg(pick.alias("r")).select("symbol", "r.*", state.alias("volatility"))
