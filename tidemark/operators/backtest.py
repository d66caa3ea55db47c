"""Costs, positions, simulation, portfolios, folds and margin searches. All are set-based: no loop over rows, symbols or margins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import w
from tidemark.operators.state import trades

# Fee in basis points, funding per 8 hours in basis points, short selling.
COSTS = {"spot_taker": (10.0, 0.0, False), "spot_taker_bnb": (7.5, 0.0, False), "perp_taker": (5.0, 1.0, True), "perp_maker": (2.0, 1.0, True), "zero_cost": (0.0, 0.0, True)}
IMPACT = {"BTCUSDT": 1.0, "ETHUSDT": 1.0}
OTHER_IMPACT = 3.0
PROBABILITY_MARGINS = [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10, 0.12, 0.15]
EDGE_MARGINS = [x / 1e4 for x in (0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0, 50.0)]
MINUTES_PER_YEAR = 365.25 * 24 * 60


@dataclass(frozen=True)
class CostModel:
    name: str

    @property
    def fee(self) -> float:
        return COSTS[self.name][0]

    @property
    def allow_short(self) -> bool:
        return COSTS[self.name][2]

    def one_side(self, symbol: str = "symbol") -> Column:
        """Fee and impact of one side as a fraction; without cost there is no impact either."""
        if self.name == "zero_cost":
            return F.lit(0.0)
        impact = F.lit(OTHER_IMPACT)
        for s, bp in IMPACT.items():
            impact = F.when(F.col(symbol) == s, F.lit(bp)).otherwise(impact)
        return (self.fee + impact) / 1e4

    def holding(self, minutes: int) -> float:
        """Funding that a long position pays over the holding time; shorts pay none."""
        return COSTS[self.name][1] / 1e4 * minutes / 480


def from_probability(p: Column, margin: Column | float, allow_short: bool) -> Column:
    margin = F.lit(margin) if isinstance(margin, float) else margin
    pos = F.when(p >= 0.5 + margin, 1)
    if allow_short:
        pos = F.when(p <= 0.5 - margin, -1).when(p >= 0.5 + margin, 1)
    return F.when((margin == 0) & (p == 0.5), 0).otherwise(pos.otherwise(0))


def expected_edge(p: Column, sigma: Column) -> Column:
    return (2 * p - 1) * sigma * math.sqrt(2 / math.pi)


def from_edge(p: Column, sigma: Column, round_trip: Column, margin: Column | float, allow_short: bool) -> Column:
    e = expected_edge(p, sigma)
    pos = F.when(e > round_trip + margin, 1)
    if allow_short:
        pos = F.when(-e > round_trip + margin, -1).when(e > round_trip + margin, 1)
    return pos.otherwise(0)


def simulate(df: DataFrame, cost: CostModel, minutes: int) -> DataFrame:
    """symbol, ts, pos, fwd_ret to pos, gross, cost, net. A time gap closes and reopens; a missing return is flat."""
    allowed = F.col("pos").cast("double") if cost.allow_short else F.greatest(F.col("pos").cast("double"), F.lit(0.0))
    df = df.withColumn("pos", F.when(F.col("fwd_ret").isNull(), 0.0).otherwise(allowed))
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    joined = F.coalesce(F.col("ts") - F.lag("ts").over(w()) == step, F.lit(False))
    goes_on = F.coalesce(F.lead("ts").over(w()) - F.col("ts") == step, F.lit(False))
    before = F.when(joined, F.lag("pos").over(w())).otherwise(0.0)
    turnover = F.abs(F.col("pos") - before) + F.when(goes_on, 0.0).otherwise(F.abs("pos"))
    paid = turnover * cost.one_side() + F.greatest(F.col("pos"), F.lit(0.0)) * cost.holding(minutes)
    df = df.withColumns({"gross": F.col("pos") * F.coalesce("fwd_ret", F.lit(0.0)), "cost": paid})
    return df.withColumn("net", F.col("gross") - F.col("cost"))


def portfolio(sim: DataFrame) -> DataFrame:
    """(ts, ret): mean simple return over symbols, as a log return."""
    return sim.groupBy("ts").agg(F.log1p(F.avg(F.expm1("net"))).alias("ret"))


def drawdown(df: DataFrame, column: str, by: str) -> DataFrame:
    """Equity, peak (0 at least) and drawdown of cumulative log returns."""
    order = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.sum(F.coalesce(column, F.lit(0.0))).over(order))
    df = df.withColumn("peak", F.greatest(F.max("equity").over(order), F.lit(0.0)))
    return df.withColumn("dd", F.expm1(F.col("equity") - F.col("peak")))


def sharpe(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.avg(x) / sd).otherwise(0.0)


def sortino(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2.0)))
    return F.when(down > 0, F.avg(x) / down).otherwise(0.0)


def trading_stats(sim: DataFrame, minutes: int) -> DataFrame:
    """One row: coverage, trades, hit rate, edge per trade, portfolio return, Sharpe, Sortino, drawdown, profit factor, cost share."""
    per_year = MINUTES_PER_YEAR / minutes
    rows = sim.agg(F.count("*").alias("rows"), F.count_if(F.col("pos") != 0).alias("active_rows"), F.sum("cost").alias("_c"), F.sum(F.abs("gross")).alias("_g"))
    t = trades(sim).agg(F.count("*").alias("trades"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), (F.avg("net") * 1e4).alias("ev_bps"), F.sum(F.greatest(F.col("net"), F.lit(0.0))).alias("_gain"), F.sum(F.greatest(-F.col("net"), F.lit(0.0))).alias("_loss"))
    port = drawdown(portfolio(sim).withColumn("all", F.lit(1)), "ret", "all")
    p = port.agg(F.count("*").alias("periods"), F.sum("ret").alias("total_logret"), (sharpe("ret") * math.sqrt(per_year)).alias("sharpe_ann"), (sortino("ret") * math.sqrt(per_year)).alias("sortino_ann"), F.min("dd").alias("max_drawdown"))
    one = rows.crossJoin(t).crossJoin(p)  # three single rows
    return one.select("periods", "rows", "active_rows", (F.col("active_rows") / F.col("rows")).alias("coverage"), "trades", "hit_rate", "ev_bps", "total_logret", "sharpe_ann", "sortino_ann", "max_drawdown", F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")).alias("profit_factor"), (F.col("_c") / F.greatest(F.col("_g"), F.lit(1e-12))).alias("cost_share"))


def margins(spark: SparkSession, values: list[float]) -> DataFrame:
    """A table of at most a dozen margins."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "ord int, margin double")


def margin_table(df: DataFrame, values: list[float], position: Column, round_trip: Column, least: int = 30, z: float = 1.0) -> DataFrame:
    """For each margin: trades, clustered mean and standard error by ts, and whether it is the choice.

    df: ts, fwd_ret and what `position` uses; `position` may use the column margin. Every row meets every margin (a fixed dozen).
    """
    m = F.broadcast(margins(df.sparkSession, values))
    each = df.join(m).withColumn("pos", position).where(F.col("pos") != 0).withColumn("net", F.col("pos") * F.col("fwd_ret") - round_trip)
    by_ts = each.groupBy("ord", "margin", "ts").agg(F.sum("net").alias("s"), F.count("*").alias("n"))
    total = by_ts.groupBy("ord", "margin").agg(F.sum("n").alias("trades"), F.sum("s").alias("sum"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    ev = F.col("sum") / F.col("trades")
    square = F.col("ss") - 2 * ev * F.col("sn") + ev * ev * F.col("nn")  # sum of (s - ev * n)**2
    se = F.sqrt(F.col("k") / (F.col("k") - 1) * F.greatest(square, F.lit(0.0))) / F.col("trades")
    out = total.where((F.col("trades") >= least) & (F.col("k") > 1)).select("ord", "margin", "trades", ev.alias("ev"), se.alias("se"), (ev - z * se).alias("lcb"))
    best = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "ord")  # a dozen rows
    scored = out.withColumn("score", F.when(F.col("lcb") > 0, F.col("lcb") * F.col("trades")).otherwise(F.lit(-1.0)))
    return scored.withColumn("chosen", (F.row_number().over(best) == 1) & (F.col("lcb") > 0)).drop("score")


def fold_table(times: DataFrame, min_train_days: int, test_days: int, valid_share: float = 0.2, rolling_days: int | None = None) -> DataFrame:
    """(fold, lo, v_start, test_start, test_end) from the first and last time of a table: a few dozen rows."""
    span = times.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    day = lambda n: F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))
    starts = span.select("a", "b", F.explode(F.sequence(F.col("a") + day(min_train_days), F.col("b"), F.expr(f"INTERVAL {test_days} DAYS"))).alias("test_start")).where(F.col("test_start") < F.col("b"))
    lo = F.col("a") if rolling_days is None else F.greatest(F.col("a"), F.col("test_start") - day(rolling_days))
    number = Window.partitionBy(F.lit(1)).orderBy("test_start")
    return starts.select(F.row_number().over(number).alias("fold"), lo.alias("lo"), "test_start", (F.col("test_start") + day(test_days)).alias("test_end"), F.lit(valid_share).alias("share"))


def fold_members(df: DataFrame, folds: DataFrame, embargo: str) -> DataFrame:
    """(fold, part, columns of df): fit, valid and test rows, purged by label_end and embargo. df: symbol, ts, label_end.

    Folds are few, so the range condition is a broadcast join; validation is the last share of the training time.
    """
    gap = F.expr(f"INTERVAL {embargo}")
    both = df.join(F.broadcast(folds), (F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("test_end")))
    train = (F.col("ts") < F.col("test_start") - gap) & (F.col("label_end") < F.col("test_start"))
    part = F.when(F.col("ts") >= F.col("test_start"), "test").when(train, "train")
    both = both.withColumn("part", part).where("part IS NOT NULL")
    edges = both.where("part = 'train'").groupBy("fold").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    both = both.join(F.broadcast(edges), "fold")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cut = F.timestamp_micros((seconds("_a") + (1 - F.col("share")) * (seconds("_b") - seconds("_a"))).cast("long")).cast("timestamp_ntz")
    both = both.withColumn("v_start", cut)
    fit = (F.col("ts") < F.col("v_start") - gap) & (F.col("label_end") < F.col("v_start"))
    final = F.when(F.col("part") == "test", "test").when(F.col("ts") >= F.col("v_start"), "valid").when(fit, "fit")
    return both.withColumn("part", final).where("part IS NOT NULL").select("fold", "part", "v_start", "test_start", *df.columns)


def cost_table(spark: SparkSession, minutes: int) -> DataFrame:
    """(cost, allow_short, fee, holding) of every cost model: a handful of rows."""
    return spark.createDataFrame([(n, s, f / 1e4, x / 1e4 * minutes / 480) for n, (f, x, s) in COSTS.items()], "cost_model string, allow_short boolean, fee double, holding double")


def landscape(rows: DataFrame, minutes: dict[str, int]) -> DataFrame:
    """Trades, mean net and hit rate for each horizon and cost model. rows: symbol, pos, horizon, fwd_ret.

    Each traded row is charged a full round trip; it meets the handful of cost models in a broadcast join.
    """
    spark = rows.sparkSession
    costs = None
    for horizon, m in minutes.items():
        one = cost_table(spark, m).withColumn("horizon", F.lit(horizon))
        costs = one if costs is None else costs.unionByName(one)
    impact = F.when(F.col("cost_model") == "zero_cost", 0.0).otherwise(OTHER_IMPACT / 1e4)
    x = rows.where("pos <> 0 AND fwd_ret IS NOT NULL").join(F.broadcast(costs), "horizon").where(F.col("allow_short") | (F.col("pos") > 0))
    net = F.col("pos") * F.col("fwd_ret") - 2 * (F.col("fee") + impact) - F.when(F.col("pos") > 0, F.col("holding")).otherwise(0.0)
    return x.withColumn("net", net).groupBy("horizon", "cost_model").agg(F.count("*").alias("n"), (F.avg("net") * 1e4).alias("net_bps"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"))


def evidence(trades_: DataFrame, least: int = 30, z: float = 1.6448536269514722) -> DataFrame:
    """Per symbol: trades, mean, day-clustered z and whether the evidence holds. trades_: symbol, ts, net."""
    days = trades_.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.sum("net").alias("s"), F.count("*").alias("c"))
    a = days.groupBy("symbol").agg(F.sum("c").alias("n"), F.sum("s").alias("sum"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("c")).alias("sc"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    m = F.col("sum") / F.col("n")
    se = F.sqrt(F.col("k") / (F.col("k") - 1) * F.greatest(F.col("ss") - 2 * m * F.col("sc") + m * m * F.col("cc"), F.lit(0.0))) / F.col("n")
    out = a.where("k > 1").select("symbol", "n", m.alias("mean"), (m / F.nullif(se, F.lit(0.0))).alias("z"))
    return out.withColumn("passed", F.coalesce((F.col("n") >= least) & (F.col("mean") > 0) & (F.col("z") > z), F.lit(False)))
