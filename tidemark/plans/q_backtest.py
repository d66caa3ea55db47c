"""Queries over trend states, costs, simulations, folds and portfolios."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import labels as L
from tidemark.operators import state as T
from tidemark.operators import windows as X
from tidemark.operators.grid import w
from tidemark.plans import sql as Q
from tidemark.plans.q_bars import _over, _w
from tidemark.plans.registry import query, rounded
from tidemark.sources import tables as S


def _donchian(n: int) -> str:
    """The sequential rule, row by row, as a recursive query."""
    h = max(2, n // 2)
    return f"""z{n} AS (SELECT symbol, k, close, CASE WHEN count(close) {_over(n, -1)} >= {n} THEN max(close) {_over(n, -1)} END AS hi, CASE WHEN count(close) {_over(h, -1)} >= {h} THEN min(close) {_over(h, -1)} END AS lo FROM n),
 s{n} AS (SELECT symbol, k, CAST(NULL AS INTEGER) AS s FROM z{n} WHERE k = 1
   UNION ALL SELECT z.symbol, z.k, CASE WHEN z.hi IS NULL OR z.lo IS NULL THEN NULL WHEN coalesce(s.s, 0) = 1 THEN CASE WHEN z.close <= z.lo THEN 0 ELSE 1 END ELSE CASE WHEN z.close >= z.hi THEN 1 ELSE 0 END END FROM s{n} s JOIN z{n} z ON z.symbol = s.symbol AND z.k = s.k + 1)"""


_N = f"{Q.DAILY}, n AS (SELECT *, row_number() {_w} AS k FROM o)"


@query(f"WITH RECURSIVE {_N}, {_donchian(20)} SELECT n.symbol, n.ts, CAST(s.s AS DOUBLE) AS state FROM n JOIN s20 s ON s.symbol = n.symbol AND s.k = n.k")
def donchian_state(spark, sf):
    return T.donchian(S.daily(spark, sf).select("symbol", "ts", "close"), 20, "state").select("symbol", "ts", "state")


_CH, _RT = (10, 20, 30), (7, 14, 28)
_ENS = f"WITH RECURSIVE {_N}, {', '.join(_donchian(c) for c in _CH)}, q AS (SELECT n.symbol, n.ts, n.k, n.close, n.open, ({' + '.join(f's{c}.s' for c in _CH)} + {' + '.join(f'(n.close / r{x}.close > 1)::INT' for x in _RT)}) / 6.0 AS ens FROM n {' '.join(f'JOIN s{c} ON s{c}.symbol = n.symbol AND s{c}.k = n.k' for c in _CH)} {' '.join(f'LEFT JOIN n r{x} ON r{x}.symbol = n.symbol AND r{x}.k = n.k - {x}' for x in _RT)})"


def _ensemble(spark, sf):
    return T.ensemble(S.daily(spark, sf).select("symbol", "ts", "open", "close"), _CH, _RT, "ens")


@query(f"{_ENS} SELECT symbol, ts, round(ens, 6) AS ens FROM q")
def trend_ensemble(spark, sf):
    return rounded(_ensemble(spark, sf).select("symbol", "ts", "ens"))


def weights(spark, sf):
    """Weight from trend state over trailing volatility, and its daily net return at the next open."""
    df = _ensemble(spark, sf)
    df = df.withColumn("ret", F.ln("close") - F.ln(F.lag("close").over(w())))
    sd = X.rolling("stddev_samp", "ret", 20) * math.sqrt(365)
    df = df.withColumn("weight", F.coalesce(F.col("ens") * F.least(F.lit(1.0), 0.5 / sd), F.lit(0.0)))
    fill = F.ln(F.lead("open").over(w()))
    df = df.withColumn("fill", fill).withColumn("fwd", F.lead("fill").over(w()) - F.col("fill"))
    turn = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w()), F.lit(0.0)))
    return df.withColumn("net", F.log1p(F.col("weight") * F.expm1("fwd") - turn * B.CostModel("spot_taker").one_side()))


_WTS = f"""{_ENS}, v AS (SELECT *, ln(close) - ln(lag(close) {_w}) AS ret, ln(lead(open) {_w}) AS fill FROM q),
 x AS (SELECT *, coalesce(ens * least(1.0, 0.5 / (CASE WHEN count(ret) {_over(20)} >= 20 THEN stddev_samp(ret) {_over(20)} END * sqrt(365))), 0) AS weight, lead(fill) {_w} - fill AS fwd FROM v),
 y AS (SELECT *, ln(1 + (weight * (exp(fwd) - 1) - abs(weight - coalesce(lag(weight) {_w}, 0)) * 0.0013)) AS net FROM x)"""


@query(f"{_WTS} SELECT symbol, ts, round(weight, 6) AS weight, round(net, 6) AS net FROM y")
def trend_weights_backtest(spark, sf):
    return rounded(weights(spark, sf).select("symbol", "ts", "weight", "net"))


@query(f"""{_WTS}, f AS (SELECT symbol, min(ts) + INTERVAL 365 DAY AS a FROM y WHERE net IS NOT NULL GROUP BY symbol), p AS (SELECT y.ts, ln(1 + avg(exp(net) - 1)) AS ret FROM y JOIN f ON f.symbol = y.symbol AND y.ts >= f.a WHERE net IS NOT NULL GROUP BY y.ts),
 e AS (SELECT ts, ret, sum(ret) OVER (ORDER BY ts) AS equity FROM p), m AS (SELECT *, greatest(max(equity) OVER (ORDER BY ts), 0) AS peak FROM e)
SELECT count(*) AS days, round(avg(ret) / stddev_samp(ret) * sqrt(365), 6) AS sharpe, round(min(exp(equity - peak) - 1), 6) AS max_drawdown, round(sum(ret), 6) AS total FROM m""")
def trend_portfolio(spark, sf):
    """Equal weights over symbols with a year of history: annualised Sharpe and drawdown."""
    y = weights(spark, sf).where("net IS NOT NULL")
    first = Window.partitionBy("symbol")
    y = y.withColumn("a", F.min("ts").over(first)).where(F.col("ts") >= F.col("a") + F.expr("INTERVAL 365 DAYS"))
    p = B.drawdown(B.portfolio(y).withColumn("all", F.lit(1)), "ret", "all")
    return rounded(p.agg(F.count("*").alias("days"), (B.sharpe("ret") * math.sqrt(365)).alias("sharpe"), F.min("dd").alias("max_drawdown"), F.sum("ret").alias("total")))


def positions(spark, sf):
    """Hourly positions from a fixed rule: long after a fall, short after a rise, with 1-hour returns to the next bar."""
    bars = S.hourly(spark, sf)
    change = F.ln("close") - F.ln(F.lag("close").over(w()))
    pos = F.when(change < -0.5, 1).when(change > 0.5, -1).otherwise(0)
    own = bars.select("symbol", "ts", pos.alias("pos"))
    return own.join(L.forward_returns(bars.select("symbol", "ts"), bars, "1 HOUR", "0 HOURS").select("symbol", "ts", "fwd_ret"), ["symbol", "ts"])


_SIM = f"""WITH {Q.HOURLY}, f AS (SELECT *, ln(coalesce(CASE WHEN volume > 0 AND quote_volume / volume BETWEEN low * 0.999 AND high * 1.001 THEN quote_volume / volume END, close)) AS fill, ln(close) - ln(lag(close) {_w}) AS c FROM e),
 r AS (SELECT a.symbol, a.ts, b.fill - a.fill AS r, CASE WHEN b.fill IS NULL THEN 0 WHEN a.c < -0.5 THEN 1.0 WHEN a.c > 0.5 THEN -1.0 ELSE 0 END AS pos FROM f a LEFT JOIN f b ON b.symbol = a.symbol AND b.ts = a.ts + INTERVAL 1 HOUR),
 l AS (SELECT *, CASE WHEN ts - lag(ts) {_w} = INTERVAL 1 HOUR THEN lag(pos) {_w} ELSE 0 END AS before, coalesce(lead(ts) {_w} - ts = INTERVAL 1 HOUR, false) AS goes_on FROM r),
 s AS (SELECT symbol, ts, pos, pos * coalesce(r, 0) AS gross, (abs(pos - before) + CASE WHEN goes_on THEN 0 ELSE abs(pos) END) * 0.0008 + greatest(pos, 0) * 0.0001 * 60 / 480 AS cost FROM l), sim AS (SELECT *, gross - cost AS net FROM s)"""


def _sim(spark, sf):
    return B.simulate(positions(spark, sf), B.CostModel("perp_taker"), 60)


@query(f"{_SIM} SELECT symbol, ts, CAST(pos AS DOUBLE) AS pos, round(gross, 6) + 0.0 AS gross, round(cost, 7) AS cost, round(net, 6) + 0.0 AS net FROM sim")
def simulate_costs(spark, sf):
    s = _sim(spark, sf)
    return s.select("symbol", "ts", "pos", (F.round("gross", 6) + 0.0).alias("gross"), F.round("cost", 7).alias("cost"), (F.round("net", 6) + 0.0).alias("net"))


_TR = f"""{_SIM}, i AS (SELECT *, coalesce(lag(pos) {_w}, 0) AS b FROM sim), j AS (SELECT *, sum((pos <> 0 AND pos <> b)::INT) {_w} AS run FROM i), t AS (SELECT symbol, run, min(ts) AS ts, first(pos ORDER BY ts) AS side, sum(net) AS net FROM j WHERE pos <> 0 OR b <> 0 GROUP BY 1, 2)"""


@query(f"{_TR} SELECT symbol, ts, CAST(side AS DOUBLE) AS side, round(net, 6) AS net FROM t")
def trade_islands(spark, sf):
    return rounded(T.trades(_sim(spark, sf)))


_PORT = f"{_SIM}, p AS (SELECT ts, ln(1 + avg(exp(net) - 1)) AS ret FROM sim GROUP BY ts), q AS (SELECT *, sum(ret) OVER (ORDER BY ts) AS equity FROM p), m AS (SELECT *, greatest(max(equity) OVER (ORDER BY ts), 0) AS peak FROM q)"


@query(f"{_PORT} SELECT ts, round(ret, 6) AS ret FROM p")
def portfolio_returns(spark, sf):
    return rounded(B.portfolio(_sim(spark, sf)))


@query(f"{_PORT} SELECT ts, round(equity, 6) AS equity, round(peak, 6) AS peak, round(exp(equity - peak) - 1, 6) AS dd FROM m")
def drawdown(spark, sf):
    return rounded(B.drawdown(B.portfolio(_sim(spark, sf)).withColumn("all", F.lit(1)), "ret", "all").select("ts", "equity", "peak", "dd"))


_YR = math.sqrt(365.25 * 24)


@query(f"""{_PORT}, i AS (SELECT *, coalesce(lag(pos) {_w}, 0) AS b FROM sim), j AS (SELECT *, sum((pos <> 0 AND pos <> b)::INT) {_w} AS run FROM i), t AS (SELECT symbol, run, sum(net) AS net FROM j WHERE pos <> 0 OR b <> 0 GROUP BY 1, 2)
SELECT (SELECT count(*) FROM p) AS periods, (SELECT count(*) FROM sim) AS rows, (SELECT count(*) FROM sim WHERE pos <> 0) AS active_rows, round((SELECT avg((pos <> 0)::INT) FROM sim), 6) AS coverage, (SELECT count(*) FROM t) AS trades,
 round((SELECT avg((net > 0)::INT) FROM t), 6) AS hit_rate, round((SELECT avg(net) * 1e4 FROM t), 5) AS ev_bps, round((SELECT sum(ret) FROM p), 6) AS total_logret, round((SELECT avg(ret) / stddev_samp(ret) * {_YR} FROM p), 5) AS sharpe_ann,
 round((SELECT avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * {_YR} FROM p), 5) AS sortino_ann, round((SELECT min(exp(equity - peak) - 1) FROM m), 6) AS max_drawdown, round((SELECT sum(greatest(net, 0)) / sum(greatest(-net, 0)) FROM t), 6) AS profit_factor,
 round((SELECT sum(cost) / sum(abs(gross)) FROM sim), 6) AS cost_share""")
def trading_stats(spark, sf):
    s = B.trading_stats(_sim(spark, sf), 60)
    return s.select([F.round(c, 5 if c in ("ev_bps", "sharpe_ann", "sortino_ann") else 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(f"""{_SIM} SELECT CASE WHEN grouping(symbol) = 0 THEN symbol END AS symbol, CASE WHEN grouping(month(ts)) = 0 THEN CAST(month(ts) AS DOUBLE) END AS month, CAST(grouping(symbol) * 2 + grouping(month(ts)) AS BIGINT) AS slice, count(*) AS n, CAST(sum((pos <> 0)::INT) AS BIGINT) AS active, round(sum(net), 6) AS net
FROM sim GROUP BY GROUPING SETS ((symbol), (month(ts)), ())""")
def grouping_sets_report(spark, sf):
    """Slices by symbol, by month and in total from one pass."""
    _sim(spark, sf).withColumn("month", F.month("ts").cast("double")).createOrReplaceTempView("tidemark_sim")
    return rounded(spark.sql("SELECT symbol, month, grouping_id(symbol, month) AS slice, count(*) AS n, count_if(pos <> 0) AS active, sum(net) AS net FROM tidemark_sim GROUP BY GROUPING SETS ((symbol), (month), ())"))


def _decisions(spark, sf):
    """A probability from a fixed formula, its return, and a fixed scale."""
    bars = S.daily(spark, sf)
    fwd = L.forward_returns(bars.select("symbol", "ts"), bars, "1 DAY", "0 DAYS").select("symbol", "ts", "fwd_ret")
    p = F.round(1 / (1 + F.exp((F.ln("close") - F.ln(F.lag("close").over(w()))) * 0.5)), 4)
    return bars.select("symbol", "ts", p.alias("p")).join(fwd, ["symbol", "ts"]).where("p IS NOT NULL AND fwd_ret IS NOT NULL")


_DEC = f"""WITH {Q.DAILY}, f AS (SELECT *, ln(coalesce(CASE WHEN volume > 0 AND quote_volume / volume BETWEEN low * 0.999 AND high * 1.001 THEN quote_volume / volume END, close)) AS fill, round(1 / (1 + exp((ln(close) - ln(lag(close) {_w})) * 0.5)), 4) AS p FROM o),
 c AS (SELECT a.symbol, a.ts, a.p, b.fill - a.fill AS fwd_ret FROM f a JOIN f b ON b.symbol = a.symbol AND b.ts = a.ts + INTERVAL 1 DAY WHERE a.p IS NOT NULL)"""


def _grid_sql(margins: list[float], pos: str, rt: float) -> str:
    values = ", ".join(f"({i}, {m}::DOUBLE)" for i, m in enumerate(margins))
    return f"""{_DEC}, m AS (SELECT * FROM (VALUES {values}) v(ord, margin)), x AS (SELECT ord, margin, ts, {pos} AS pos, fwd_ret FROM c, m), y AS (SELECT ord, margin, ts, sum(pos * fwd_ret - {rt}) AS s, count(*) AS n FROM x WHERE pos <> 0 GROUP BY 1, 2, 3),
 e AS (SELECT ord, margin, sum(n) AS trades, sum(s) / sum(n) AS ev, count(*) AS k FROM y GROUP BY 1, 2), z AS (SELECT e.ord, e.margin, any_value(trades) AS trades, any_value(ev) AS ev, sqrt(any_value(k) / (any_value(k) - 1) * sum(pow(s - ev * n, 2))) / any_value(trades) AS se FROM e JOIN y ON y.ord = e.ord GROUP BY 1, 2),
 q AS (SELECT *, ev - se AS lcb FROM z WHERE trades >= 30)
SELECT CAST(ord AS INTEGER) AS ord, margin, CAST(trades AS BIGINT) AS trades, round(ev, 6) AS ev, round(se, 6) AS se, round(lcb, 6) AS lcb, lcb > 0 AND row_number() OVER (ORDER BY CASE WHEN lcb > 0 THEN lcb * trades ELSE -1 END DESC, ord) = 1 AS chosen FROM q"""


@query(_grid_sql(B.PROBABILITY_MARGINS, "CASE WHEN margin = 0 AND p = 0.5 THEN 0 WHEN p <= 0.5 - margin THEN -1 WHEN p >= 0.5 + margin THEN 1 ELSE 0 END", 0.0016))
def threshold_grid(spark, sf):
    return rounded(B.margin_table(_decisions(spark, sf), B.PROBABILITY_MARGINS, B.from_probability(F.col("p"), F.col("margin"), True), F.lit(0.0016)))


@query(_grid_sql(B.EDGE_MARGINS, f"CASE WHEN -((2 * p - 1) * 0.02 * {math.sqrt(2 / math.pi)}) > 0.0016 + margin THEN -1 WHEN (2 * p - 1) * 0.02 * {math.sqrt(2 / math.pi)} > 0.0016 + margin THEN 1 ELSE 0 END", 0.0016))
def ev_margin_grid(spark, sf):
    return rounded(B.margin_table(_decisions(spark, sf), B.EDGE_MARGINS, B.from_edge(F.col("p"), F.lit(0.02), F.lit(0.0016), F.col("margin"), True), F.lit(0.0016)))


def _members(spark, sf):
    rows = S.daily(spark, sf).select("symbol", "ts", (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("label_end"))
    return B.fold_members(rows, B.fold_table(rows, 730, 365), "2 DAYS")


_FOLD = f"""WITH {Q.DAILY}, r AS (SELECT symbol, ts, ts + INTERVAL 5 DAY AS label_end FROM o), s AS (SELECT unnest(generate_series(min(ts) + INTERVAL 730 DAY, max(ts), INTERVAL 365 DAY)) AS t0, max(ts) AS b, min(ts) AS a FROM r),
 f AS (SELECT row_number() OVER (ORDER BY t0) AS fold, t0, a FROM s WHERE t0 < b), x AS (SELECT f.fold, f.t0, r.*, CASE WHEN ts >= t0 THEN 'test' WHEN ts < t0 - INTERVAL 2 DAY AND label_end < t0 THEN 'train' END AS part FROM r JOIN f ON r.ts < f.t0 + INTERVAL 365 DAY),
 v AS (SELECT fold, min(ts) + to_microseconds(CAST(0.8 * (epoch_us(max(ts)) - epoch_us(min(ts))) AS BIGINT)) AS v0 FROM x WHERE part = 'train' GROUP BY fold),
 m AS (SELECT x.fold, x.t0, v0, symbol, ts, label_end, CASE WHEN part = 'test' THEN 'test' WHEN part = 'train' AND ts >= v0 THEN 'valid' WHEN part = 'train' AND ts < v0 - INTERVAL 2 DAY AND label_end < v0 THEN 'fit' END AS part FROM x JOIN v ON v.fold = x.fold)"""


@query(f"{_FOLD} SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM m WHERE part IS NOT NULL GROUP BY 1, 2")
def walk_forward_folds(spark, sf):
    return _members(spark, sf).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(f"{_FOLD} SELECT CAST(fold AS INTEGER) AS fold, max(label_end) FILTER (part IN ('fit', 'valid')) < min(ts) FILTER (part = 'test') AS clean, max(label_end) FILTER (part = 'fit') < min(ts) FILTER (part = 'valid') AS clean_valid FROM m WHERE part IS NOT NULL GROUP BY 1")
def purge_check(spark, sf):
    end = lambda parts: F.max(F.when(F.col("part").isin(parts), F.col("label_end")))
    first = lambda part: F.min(F.when(F.col("part") == part, F.col("ts")))
    return _members(spark, sf).groupBy("fold").agg((end(["fit", "valid"]) < first("test")).alias("clean"), (end(["fit"]) < first("valid")).alias("clean_valid"))


@query(f"""{_SIM}, t AS (SELECT *, row_number() {_w} AS k FROM sim), c AS (SELECT symbol, ts, k, net, sum(-(net - 0.001) / 0.5 - 0.01) {_w} AS c FROM t), d AS (SELECT *, c - least(0, min(c) {_w}) AS cusum, CASE WHEN count(net) {_over(50)} >= 30 THEN avg(net) {_over(50)} + 2 * stddev_samp(net) {_over(50)} / sqrt(count(net) {_over(50)}) END AS ucb FROM c)
SELECT symbol, ts, round(cusum, 5) AS cusum, round(ucb, 6) AS recent_ucb, max(coalesce(cusum > 5 OR ucb < 0, false)::INT) {_w} = 1 AS disabled FROM d""")
def cusum_monitor(spark, sf):
    m = T.monitor(_sim(spark, sf), 0.001, -0.009, 0.5, 5.0)
    return m.select("symbol", "ts", F.round("cusum", 5).alias("cusum"), F.round("recent_ucb", 6).alias("recent_ucb"), "disabled")
