"""Queries over accounts, ledgers, scans, calendars, patterns and volatility forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import accounts as A
from tidemark.operators import backtest as B
from tidemark.operators import engine as G
from tidemark.operators import labels as L
from tidemark.operators import models as ML
from tidemark.operators import patterns as N
from tidemark.operators import portfolio as P
from tidemark.operators import state as T
from tidemark.operators.grid import w
from tidemark.plans import sql as Q
from tidemark.plans.q_bars import _w
from tidemark.plans.q_backtest import _SIM, _sim
from tidemark.plans.registry import query, rounded
from tidemark.sources import synthetic
from tidemark.sources import tables as S

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _calls(spark, sf):
    e = S.table(spark, sf, "events")
    calls = e.where("event_type = 'purchase'").select((F.col("user_id") % 20).alias("account"), F.col("event_id").cast("string").alias("key"), (F.col("event_id") % 7).cast("string").alias("config"), F.col("event_type").alias("symbol"), F.col("ts").alias("signal_time"), F.col("value").alias("price"))
    accounts = e.select((F.col("user_id") % 20).alias("account")).distinct().withColumn("cash", 100.0 + F.col("account") * 40)
    seen = e.where("event_id % 11 = 0").select((F.col("user_id") % 20).alias("account"), F.col("event_id").cast("string").alias("key"))
    return accounts, calls, seen


@query(f"""WITH c AS (SELECT user_id % 20 AS account, event_id, event_id % 7 AS config, ts, value FROM events WHERE event_type = 'purchase' AND event_id % 11 <> 0 AND ts >= {_NOW} - INTERVAL 5 DAY),
 o AS (SELECT *, row_number() OVER (PARTITION BY account, config ORDER BY ts, event_id::VARCHAR) AS n FROM c), r AS (SELECT *, count(*) OVER (PARTITION BY account ORDER BY ts, event_id::VARCHAR ROWS UNBOUNDED PRECEDING) * 100.13 AS spent FROM o WHERE n = 1)
SELECT account, event_id::VARCHAR AS key, config::VARCHAR AS config, round(100.0 / value, 6) AS qty, round(0.13, 6) AS fee FROM r WHERE spent <= 100 + account * 40""")
def account_copy_calls(spark, sf):
    accounts, calls, seen = _calls(spark, sf)
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return rounded(A.copy_calls(accounts, calls, seen, now, "5 DAYS", 100.0, 0.0013).select("account", "key", "config", "qty", "fee"))


@query("""WITH h AS (SELECT o_custkey % 50 AS account, o_orderpriority AS symbol, count(*) AS qty FROM orders GROUP BY 1, 2), p AS (SELECT o_orderpriority AS symbol, max(o_totalprice) AS price FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
 v AS (SELECT account, sum(qty * price) AS held, count(*) FILTER (price IS NULL) AS missing FROM h LEFT JOIN p ON p.symbol = h.symbol GROUP BY account) SELECT account, round(CASE WHEN missing = 0 THEN 1000 + held END, 4) AS value FROM v""")
def account_values(spark, sf):
    o = S.table(spark, sf, "orders")
    held = o.groupBy((F.col("o_custkey") % 50).alias("account"), F.col("o_orderpriority").alias("symbol")).agg(F.count("*").alias("qty"))
    prices = o.where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.max("o_totalprice").alias("price"))
    accounts = held.select("account").distinct().withColumn("cash", F.lit(1000.0))
    return A.account_value(accounts, held, prices).select("account", F.round("value", 4).alias("value"))


@query("""WITH h AS (SELECT o_custkey % 50 AS account, o_orderpriority AS symbol, count(*) * 0.001 AS qty FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2), p AS (SELECT o_orderpriority AS symbol, max(o_totalprice) AS price FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
 e AS (SELECT account, 1000 + sum(qty * price) AS equity FROM h JOIN p ON p.symbol = h.symbol GROUP BY account), d AS (SELECT h.account, h.symbol, equity * 0.5 / (SELECT count(*) FROM h x WHERE x.account = h.account) - qty * price AS delta FROM h JOIN p ON p.symbol = h.symbol JOIN e ON e.account = h.account)
SELECT account, symbol, CASE WHEN delta < 0 THEN 'SELL' ELSE 'BUY' END AS side, round(abs(delta), 2) AS value, round(abs(delta) * 0.0013, 5) AS fee, CAST(row_number() OVER (PARTITION BY account ORDER BY (delta > 0)::INT, symbol) AS INTEGER) AS step FROM d WHERE abs(delta) >= 1""")
def account_rebalance(spark, sf):
    o = S.table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'")
    held = o.groupBy((F.col("o_custkey") % 50).alias("account"), F.col("o_orderpriority").alias("symbol")).agg((F.count("*") * 0.001).alias("qty"))
    prices = o.groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.max("o_totalprice").alias("price"))
    accounts = held.groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "qty"))).alias("holdings")).withColumn("cash", F.lit(1000.0))
    orders = G.rebalance(accounts, prices, held.select("account", "symbol", F.lit(0.5).alias("exposure")), 0.0013)
    return orders.select("account", "symbol", "side", F.round("value", 2).alias("value"), F.round("fee", 5).alias("fee"), "step")


@query(f"{_SIM}, i AS (SELECT *, coalesce(lag(pos) {_w}, 0) AS b FROM sim), j AS (SELECT *, sum((pos <> 0 AND pos <> b)::INT) {_w} AS run FROM i), t AS (SELECT symbol AS config, run, sum(net) AS net, sum(cost) AS fee FROM j WHERE pos <> 0 OR b <> 0 GROUP BY 1, 2) SELECT config, count(*) AS trades, count(*) FILTER (net > 0) AS wins, round(sum(net), 6) AS net FROM t GROUP BY config")
def config_stats(spark, sf):
    t = T.trades(_sim(spark, sf)).select(F.col("symbol").alias("config"), "net", F.lit(0.0).alias("fee"))
    return rounded(A.config_stats(t).select("config", "trades", "wins", "net"))


@query(f"{_SIM} SELECT ts, " + ", ".join(f"round(coalesce(max(net) FILTER (symbol = '{s}'), 0), 6) AS \"{s}\"" for s in ("click", "purchase", "view")) + " FROM sim WHERE symbol IN ('click', 'purchase', 'view') GROUP BY ts")
def ledger_returns_matrix(spark, sf):
    names = ["click", "purchase", "view"]
    r = _sim(spark, sf).where(F.col("symbol").isin(names)).select(F.col("symbol").alias("id"), "ts", F.col("net").alias("ret"))
    return rounded(A.ledger_matrix(r, names))


@query(f"{_SIM}, k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k, pos, gross FROM sim), q AS (SELECT symbol, k, CASE WHEN pos = 0 THEN 0 ELSE gross / pos END AS ret, pos FROM k WHERE k % 4 = 0), d AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY k), 0)) AS step FROM q) SELECT symbol, CAST(sum(step) AS DOUBLE) AS changes, round(product(1 + pos * ret * 0.1 - step * 0.001) - 1, 6) AS total FROM d GROUP BY symbol")
def toy_backtest(spark, sf):
    order = Window.partitionBy("symbol").orderBy("ts")
    x = _sim(spark, sf).select("symbol", (F.row_number().over(order) - 1).alias("k"), "pos", (F.when(F.col("pos") == 0, 0.0).otherwise(F.col("gross") / F.col("pos")) * 0.1).alias("ret"))
    return rounded(A.toy_backtest(x, 4, 0.001))


@query("""WITH t AS (SELECT * FROM (VALUES (0.5, 400, 0.01), (0.55, 60, 0.04), (0.6, 5, 0.2), (0.65, 31, 0.04)) v(threshold, calls, strategy_return)) SELECT CAST(threshold AS DOUBLE) AS threshold FROM t WHERE calls >= 30 ORDER BY strategy_return DESC, threshold LIMIT 1""")
def choose_threshold(spark, sf):
    t = spark.createDataFrame([(0.5, 400, 0.01), (0.55, 60, 0.04), (0.6, 5, 0.2), (0.65, 31, 0.04)], "threshold double, calls int, strategy_return double")
    return A.choose_threshold(t)


@query("""SELECT c_custkey AS id, CASE WHEN p < 0.05 AND s > 0 AND s > h THEN 'POSSIBLE EDGE' WHEN p < 0.05 THEN 'NO PROFIT' WHEN s > 0 AND s > h THEN 'UNPROVEN' ELSE 'NO EDGE' END AS verdict FROM (SELECT c_custkey, (c_acctbal + 1000) / 11000.0 AS p, c_custkey % 5 - 2 AS s, c_custkey % 3 - 1 AS h FROM customer)""")
def edge_verdicts(spark, sf):
    c = S.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), A.edge_verdict((F.col("c_acctbal") + 1000) / 11000.0, F.col("c_custkey") % 5 - 2, F.col("c_custkey") % 3 - 1).alias("verdict"))


@query("""SELECT DISTINCT (o_orderdate::DATE)::TIMESTAMP AS day, (last_day(o_orderdate) - CAST((isodow(last_day(o_orderdate)) - 5 + 7) % 7 AS INTEGER))::TIMESTAMP AS expiry FROM orders""")
def options_expiry(spark, sf):
    d = S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(F.col("d").cast("timestamp_ntz").alias("day"), N.last_friday(F.col("d")).cast("timestamp_ntz").alias("expiry"))


@query("""SELECT DISTINCT (o_orderdate::DATE)::TIMESTAMP AS day, timezone('UTC', timezone('America/New_York', o_orderdate::DATE + INTERVAL 16 HOUR)) AS ts FROM orders WHERE isodow(o_orderdate) < 6 AND NOT (month(o_orderdate) = 12 AND dayofmonth(o_orderdate) = 25)""")
def new_york_closes(spark, sf):
    days = S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    closed = days.where((F.month("day") == 12) & (F.dayofmonth("day") == 25))
    return N.new_york_closes(days, closed).select(F.col("day").cast("timestamp_ntz").alias("day"), "ts")


@query(f"""WITH {Q.HOURLY}, x AS (SELECT *, lag(close) {_w} AS b, pow(10.0, floor(log10(20.0)) - 1) / 2 AS s FROM e), y AS (SELECT *, floor(b / s) * s AS lo FROM x)
SELECT symbol, ts, CAST(CASE WHEN coalesce(close >= (lo + s) * 1.001 AND b < lo + s, false) THEN 1 WHEN coalesce(close <= lo * 0.999 AND b > lo, false) THEN -1 ELSE 0 END AS INTEGER) AS signal FROM y""")
def round_number_breaks(spark, sf):
    e = S.hourly(spark, sf).withColumn("ref", F.lit(20.0))
    return N.round_breaks(e, "ref").select("symbol", "ts", F.col("signal").cast("int").alias("signal"))


@query(f"WITH {Q.HOURLY}, m AS (SELECT symbol, ts, abs(close - lag(close) {_w}) AS m FROM e), d AS (SELECT symbol, date_trunc('day', ts) AS day, min(m) FILTER (m > 0) AS t FROM m GROUP BY 1, 2) SELECT symbol, day, round(lag(t) OVER (PARTITION BY symbol ORDER BY day), 6) AS tick FROM d")
def smallest_ticks(spark, sf):
    return rounded(N.smallest_tick(S.hourly(spark, sf)).select("symbol", F.col("day").cast("timestamp_ntz").alias("day"), "tick"))


@query()
def kernel_patterns(spark, sf):
    return N.chart_patterns(S.hourly(spark, sf))


def _mean(n: int) -> str:
    o = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"ln(CASE WHEN count(v) {o} >= {n} THEN avg(v) {o} END + 1e-12)"


@query(f"""WITH {Q.DAILY}, v AS (SELECT symbol, ts, pow(ln(close) - ln(open), 2) AS v FROM o), h AS (SELECT symbol, ts, {_mean(5)} AS a, {_mean(22)} AS b, ln(v + 1e-12) AS y FROM v), z AS (SELECT * FROM h WHERE a IS NOT NULL AND b IS NOT NULL),
 m AS (SELECT symbol, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ya, covar_pop(b, y) AS yb FROM z GROUP BY symbol)
SELECT symbol, n, round((ya * bb - yb * ab) / (aa * bb - ab * ab), 4) AS b_a, round((yb * aa - ya * ab) / (aa * bb - ab * ab), 4) AS b_b, round(my - (ya * bb - yb * ab) / (aa * bb - ab * ab) * ma - (yb * aa - ya * ab) / (aa * bb - ab * ab) * mb, 4) AS intercept FROM m""")
def har_volatility(spark, sf):
    """Log variance on its own past means, one regression per symbol."""
    v = S.daily(spark, sf).select("symbol", "ts", F.pow(F.ln("close") - F.ln("open"), 2.0).alias("v"))
    f = N.realised_features(v, "v", 5, 22, 22)
    x = v.select("symbol", "ts", f["har_day"].alias("a"), f["har_week"].alias("b"), F.ln(F.col("v") + 1e-12).alias("y"))
    out = N.least_squares(x, "y", ["a", "b"], ["symbol"])
    return out.select("symbol", "n", *[F.round(c, 4).alias(c) for c in ("b_a", "b_b", "intercept")])


@query(f"""WITH {Q.DAILY}, v AS (SELECT symbol, ts, pow(ln(close) - ln(open), 2) + 1e-6 AS v FROM o), f AS (SELECT symbol, v, lag(v) {_w} AS p FROM v) SELECT symbol, count(*) AS n, round(avg(v / p - ln(v / p) - 1) / 1e6, 6) AS qlike FROM f WHERE p IS NOT NULL GROUP BY symbol""")
def qlike_loss(spark, sf):
    v = S.daily(spark, sf).select("symbol", "ts", (F.pow(F.ln("close") - F.ln("open"), 2.0) + 1e-6).alias("v")).withColumn("p", F.lag("v").over(w())).where("p IS NOT NULL")
    return rounded(v.groupBy("symbol").agg(F.count("*").alias("n"), (F.avg(N.qlike(F.col("v"), F.col("p"))) / 1e6).alias("qlike")))


_F20, _F60 = ("OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN %d PRECEDING AND CURRENT ROW)" % n for n in (19, 59))


@query(f"""WITH {Q.DAILY}, x AS (SELECT *, abs(ln(close) - ln(lag(close) {_w})) AS absr FROM o), y AS (SELECT symbol, ts, abs(ln(close / lag(close, 20) {_w})) / nullif(CASE WHEN count(absr) {_F20} >= 20 THEN sum(absr) {_F20} END, 0) AS ratio FROM x)
SELECT symbol, ts, round(ratio, 6) AS ratio, coalesce(ratio >= CASE WHEN count(ratio) {_F60} >= 60 THEN quantile_cont(ratio, 0.5) {_F60} END, false) AS gate FROM y""")
def efficiency_gate(spark, sf):
    o = S.daily(spark, sf).withColumn("absr", F.abs(F.ln("close") - F.ln(F.lag("close").over(w()))))
    g = P.efficiency_gate(20, 60)
    return rounded(o.withColumn("ratio", g["ratio"]).select("symbol", "ts", "ratio", g["gate"].alias("gate")))


@query(f"""WITH {Q.HOURLY}, r AS (SELECT symbol, ts, ln(close) - ln(lag(close) {_w}) AS r FROM e), j AS (SELECT symbol, date_trunc('week', ts) AS week, max(r * r) / sum(r * r) AS jump FROM r WHERE r IS NOT NULL GROUP BY 1, 2)
SELECT symbol, week, round(jump, 6) AS jump, jump <= quantile_cont(jump, 0.8) OVER (PARTITION BY week) AS kept FROM j""")
def jump_exclusion(spark, sf):
    r = S.hourly(spark, sf).select("symbol", "ts", (F.ln("close") - F.ln(F.lag("close").over(w()))).alias("r"))
    return rounded(P.jump_exclusion(r))


@query()
def synthetic_candles(spark, sf):
    return synthetic.candles(spark, 500)


@query()
def calibration_slope(spark, sf):
    return spark.createDataFrame([ML.calibration_slope(S.labelled(spark, sf))], "slope double, intercept double")


_FILLS = f"""WITH {Q.HOURLY}, f AS (SELECT *, ln(coalesce(CASE WHEN volume > 0 AND quote_volume / volume BETWEEN low * 0.999 AND high * 1.001 THEN quote_volume / volume END, close)) AS fill, ln(close) - ln(lag(close) {_w}) AS c FROM e),
 p AS (SELECT symbol, ts, fill, CASE WHEN c < -0.5 THEN 1 WHEN c > 0.5 THEN -1 ELSE 0 END AS pos FROM f), r AS (SELECT p.symbol, p.ts, h.h, p.pos, x.fill - n.fill AS r FROM (p CROSS JOIN (VALUES (1), (4), (12)) h(h)) JOIN f n ON n.symbol = p.symbol AND n.ts = p.ts + INTERVAL 1 HOUR JOIN f x ON x.symbol = p.symbol AND x.ts = p.ts + to_hours(1 + h.h) WHERE pos <> 0),
 m AS (SELECT * FROM (VALUES ('spot_taker', 10.0, 0.0, false, 3.0), ('spot_taker_bnb', 7.5, 0.0, false, 3.0), ('perp_taker', 5.0, 1.0, true, 3.0), ('perp_maker', 2.0, 1.0, true, 3.0), ('zero_cost', 0.0, 0.0, true, 0.0)) m(cost_model, fee, funding, short, impact)),
 z AS (SELECT h || 'h' AS horizon, cost_model, pos * r - 2 * (fee + impact) / 1e4 - CASE WHEN pos > 0 THEN funding / 1e4 * h * 60 / 480 ELSE 0 END AS net FROM r, m WHERE short OR pos > 0)"""


@query(f"{_FILLS} SELECT horizon, cost_model, count(*) AS n, round(avg(net) * 1e4, 3) AS net_bps, round(avg((net > 0)::INT), 6) AS hit_rate FROM z GROUP BY 1, 2")
def study_landscape(spark, sf):
    """Every horizon under every cost model, from one table of decisions."""
    bars = S.hourly(spark, sf)
    change = F.ln("close") - F.ln(F.lag("close").over(w()))
    pos = bars.select("symbol", "ts", F.when(change < -0.5, 1).when(change > 0.5, -1).otherwise(0).alias("pos"))
    rows = None
    for h in (1, 4, 12):
        one = pos.join(L.forward_returns(bars.select("symbol", "ts"), bars, f"{h} HOURS", "1 HOUR").select("symbol", "ts", "fwd_ret"), ["symbol", "ts"]).withColumn("horizon", F.lit(f"{h}h"))
        rows = one if rows is None else rows.unionByName(one)
    out = B.landscape(rows, {f"{h}h": h * 60 for h in (1, 4, 12)})
    return out.select("horizon", "cost_model", "n", F.round("net_bps", 3).alias("net_bps"), F.round("hit_rate", 6).alias("hit_rate"))


@query(f"""{_SIM}, i AS (SELECT *, coalesce(lag(pos) {_w}, 0) AS b FROM sim), j AS (SELECT *, sum((pos <> 0 AND pos <> b)::INT) {_w} AS run FROM i), t AS (SELECT symbol, run, min(ts) AS ts, sum(net) AS net FROM j WHERE pos <> 0 OR b <> 0 GROUP BY 1, 2),
 d AS (SELECT symbol, date_trunc('day', ts) AS day, sum(net) AS s, count(*) AS c FROM t GROUP BY 1, 2), a AS (SELECT symbol, sum(c) AS n, sum(s) / sum(c) AS m, count(*) AS k FROM d GROUP BY symbol), v AS (SELECT a.symbol, any_value(n) AS n, any_value(m) AS m, sqrt(any_value(k) / (any_value(k) - 1) * sum(pow(s - m * c, 2))) / any_value(n) AS se FROM a JOIN d ON d.symbol = a.symbol GROUP BY a.symbol)
SELECT symbol, CAST(n AS BIGINT) AS n, round(m, 6) AS mean, round(m / se, 5) AS z, n >= 30 AND m > 0 AND m / se > 1.6448536269514722 AS passed FROM v""")
def evidence_gate(spark, sf):
    e = B.evidence(T.trades(_sim(spark, sf)))
    return e.select("symbol", "n", F.round("mean", 6).alias("mean"), F.round("z", 5).alias("z"), "passed")


@query(f"""WITH {Q.HOURLY}, u AS (SELECT symbol, ts, close, 0 AS later FROM e WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT symbol, ts, open, 1 FROM e WHERE ts >= TIMESTAMP '2024-01-18') SELECT symbol, ts, round(last(close ORDER BY later), 6) AS p FROM u GROUP BY 1, 2""")
def out_of_sample_history(spark, sf):
    """Test predictions and those made after training, the later of two for one time."""
    e = S.hourly(spark, sf)
    cut = lambda t: F.lit(t).cast("timestamp_ntz")
    test = e.where(F.col("ts") < cut("2024-01-20")).select("symbol", "ts", F.col("close").alias("p"), F.lit(0).alias("later"))
    after = e.where(F.col("ts") >= cut("2024-01-18")).select("symbol", "ts", F.col("open").alias("p"), F.lit(1).alias("later"))
    return rounded(test.unionByName(after).groupBy("symbol", "ts").agg(F.max_by("p", "later").alias("p")))
