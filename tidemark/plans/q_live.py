"""Queries over cross-sections, set operations, the live engine, paper trades, scalars, models and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as Z
from tidemark.operators import engine as G
from tidemark.operators import models as ML
from tidemark.operators import portfolio as P
from tidemark.operators.grid import w
from tidemark.plans import sql as Q
from tidemark.plans.q_bars import _over, _roll, _w, hourly_grid
from tidemark.plans.registry import query, rounded
from tidemark.sources import tables as S
from tidemark.streaming import streams

_MOM = f"WITH {Q.WEEKLY}, x AS (SELECT symbol, ts, close, ln(close / lag(close, 4) {_w}) AS mom, lead(close) {_w} / close - 1 AS fwd FROM l), y AS (SELECT * FROM x WHERE mom IS NOT NULL AND fwd IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol) AS h, row_number() OVER (PARTITION BY ts ORDER BY mom, symbol DESC) AS lo, count(*) OVER (PARTITION BY ts) // 3 AS n FROM y), g AS (SELECT symbol, ts, fwd, CASE WHEN h <= n THEN 1 WHEN lo <= n THEN -1 ELSE 0 END AS leg FROM t), v AS (SELECT *, CASE WHEN leg = 1 THEN 1.0 / sum((leg = 1)::INT) OVER (PARTITION BY ts) ELSE 0 END AS weight FROM g)"


def _weeks(spark, sf):
    x = S.weekly_suppliers(spark, sf)
    x = x.withColumns({"mom": F.ln(F.col("close") / F.lag("close", 4).over(w())), "fwd": F.lead("close").over(w()) / F.col("close") - 1})
    return P.target_weights(P.terciles(x.where("mom IS NOT NULL AND fwd IS NOT NULL"), "mom"))


@query(f"{_MOM} SELECT symbol, ts, CAST(leg AS INTEGER) AS leg FROM g")
def xsection_terciles(spark, sf):
    return _weeks(spark, sf).select("symbol", "ts", F.col("leg").cast("int").alias("leg"))


@query(f"{_MOM}, p AS (SELECT symbol, ts, weight FROM v WHERE weight > 0), b AS (SELECT coalesce(a.ts, o.ts) AS ts, coalesce(a.weight, 0) AS n, coalesce(o.weight, 0) AS o FROM p a FULL JOIN (SELECT symbol, ts + INTERVAL 7 DAY AS ts, weight FROM p) o ON o.symbol = a.symbol AND o.ts = a.ts), k AS (SELECT ts, sum(abs(n - o)) AS turnover FROM b WHERE ts IN (SELECT ts FROM p) GROUP BY ts), r AS (SELECT ts, sum(weight * fwd) AS gross FROM v GROUP BY ts) SELECT r.ts, round(gross, 6) AS gross, round(coalesce(turnover, 0), 6) AS turnover, round(coalesce(turnover, 0) * 0.0013, 6) AS cost, round(gross - coalesce(turnover, 0) * 0.0013, 6) AS net FROM r LEFT JOIN k ON k.ts = r.ts")
def xsection_momentum(spark, sf):
    return rounded(P.momentum_book(S.weekly_suppliers(spark, sf), 4, 0.0013))


@query(f"{_MOM}, p AS (SELECT symbol, ts, weight, fwd FROM v WHERE weight > 0), d AS (SELECT symbol, ts + INTERVAL 7 DAY AS ts, weight * (1 + fwd) / sum(weight * (1 + fwd)) OVER (PARTITION BY ts) AS o FROM p), b AS (SELECT coalesce(p.ts, d.ts) AS ts, coalesce(weight, 0) AS n, coalesce(o, 0) AS o FROM p FULL JOIN d ON d.symbol = p.symbol AND d.ts = p.ts), k AS (SELECT ts, sum(abs(n - o)) AS turnover FROM b GROUP BY ts), r AS (SELECT ts, sum(weight * fwd) AS gross FROM p GROUP BY ts) SELECT r.ts, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - turnover * 0.0013, 6) AS net FROM r JOIN k ON k.ts = r.ts")
def weekly_book(spark, sf):
    held = _weeks(spark, sf).where("weight > 0").select("symbol", "ts", "weight", "fwd")
    return rounded(P.drifted_book(S.weekly_suppliers(spark, sf), held, 0.0013))


@query(f"WITH {Q.WEEKLY} SELECT symbol, ts, round(close / ({_roll('max', 'close', 26, 20)}), 6) AS nearness FROM l")
def nearness_high(spark, sf):
    return rounded(S.weekly_suppliers(spark, sf).select("symbol", "ts", P.nearness(26, 20).alias("nearness")))


@query(f"WITH {Q.WEEKLY}, r AS (SELECT symbol, ts, ln(close) - ln(lag(close) {_w}) AS ret FROM l), m AS (SELECT ts, avg(ret) AS mkt FROM r GROUP BY ts), x AS (SELECT r.*, mkt FROM r JOIN m ON m.ts = r.ts WHERE ret IS NOT NULL) SELECT symbol, ts, round({_roll('max', 'ret', 12, 10)}, 6) AS largest, round(CASE WHEN count(ret) {_over(12)} >= 12 THEN stddev_samp(ret) {_over(12)} * sqrt(greatest(1 - pow(corr(ret, mkt) {_over(12)}, 2), 0)) END, 5) AS residual FROM x")
def max_effect(spark, sf):
    r = S.weekly_suppliers(spark, sf).select("symbol", "ts", (F.ln("close") - F.ln(F.lag("close").over(w()))).alias("ret"))
    x = r.join(F.broadcast(r.groupBy("ts").agg(F.avg("ret").alias("mkt"))), "ts").where("ret IS NOT NULL")
    return x.select("symbol", "ts", F.round(P.largest_moves(12, 10), 6).alias("largest"), F.round(P.residual_volatility(12), 5).alias("residual"))


@query(f"WITH {Q.DAILY}, r AS (SELECT ts, avg(ln(close) - ln(open)) AS ret FROM o GROUP BY ts), f AS (SELECT *, (dayofmonth(ts) - 1 BETWEEN -1 AND 2 OR datediff('day', (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE, ts::DATE) BETWEEN -1 AND 2)::INT AS inside FROM r) SELECT CAST(inside AS INTEGER) AS inside, count(*) AS n, round(avg(ret), 6) AS mean FROM f GROUP BY inside")
def turn_of_month(spark, sf):
    r = S.daily(spark, sf).groupBy("ts").agg(F.avg(F.ln("close") - F.ln("open")).alias("ret")).withColumn("inside", P.month_window(F.col("ts"), -1))
    return rounded(r.groupBy("inside").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")))


@query(f"WITH {Q.HOURLY}, k AS (SELECT *, row_number() {_w} - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM e) SELECT a.symbol, a.ts, b.close AS shifted FROM k a JOIN k b ON b.symbol = a.symbol AND (b.k + 100) % b.n = a.k")
def circular_shift(spark, sf):
    return P.circular_shift(S.hourly(spark, sf).select("symbol", "ts", "close"), "close", 100, "shifted").select("symbol", "ts", "shifted")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def dedup_latest(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "event_id", "ts").withColumn("at", F.struct("ts", "event_id"))
    return G.latest(e, "user_id", "at").select("user_id", "event_id", "ts")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-29')")
def anti_join_seen(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "event_type", "ts")
    return G.new_only(e.where("event_type = 'purchase'").select("user_id"), e.where("event_type = 'click' AND ts >= TIMESTAMP_NTZ '2024-01-29'").select("user_id"), "user_id")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_union, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_first,
 (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'view')) AS n_all""")
def set_ops_panel(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "event_type")
    one = lambda t: e.where(F.col("event_type") == t).select("user_id")
    a, b = one("click"), one("view")
    marks = a.distinct().withColumn("a", F.lit(1)).join(b.distinct().withColumn("b", F.lit(1)), "user_id", "full")
    n = marks.agg(F.count("*").alias("n_union"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_first"))
    return n.crossJoin(a.unionByName(b).agg(F.count("*").alias("n_all")))


_NOW = "TIMESTAMP '2024-01-30 12:00:00'"


@query(f"""WITH {Q.HOURLY_GRID}, m AS (SELECT *, abs(ln(close) - ln(lag(close) {_w})) AS mv, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM g), a AS (SELECT symbol, max(ts) FILTER (NOT gap) AS last_ts, avg(gap::INT) AS gaps, coalesce(max(mv), 0) AS jump FROM m WHERE r <= 24 GROUP BY symbol)
SELECT symbol, last_ts, round(gaps, 6) AS gaps, round(jump, 6) AS jump, concat_ws(',', CASE WHEN coalesce({_NOW} - last_ts > INTERVAL 3 HOUR, true) THEN 'stale' END, CASE WHEN gaps > 0.02 THEN 'gaps' END, CASE WHEN jump > 2.0 THEN 'jump' END) AS problems, NOT (coalesce({_NOW} - last_ts > INTERVAL 3 HOUR, true) OR gaps > 0.02 OR jump > 2.0) AS ok FROM a""")
def data_health(spark, sf):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return rounded(G.data_health(hourly_grid(spark, sf), now, "3 HOURS", 0.02, 2.0, 24))


@query(f"""WITH {Q.HOURLY}, r AS (SELECT *, ln(close) - ln(lag(close) {_w}) AS r FROM e), s AS (SELECT symbol, ts, stddev_samp(r) {_over(24)} AS vol_short, stddev_samp(r) {_over(168)} AS vol_long, CASE WHEN close > avg(close) {_over(168)} THEN 'up' ELSE 'down' END AS trend, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM r)
SELECT symbol, ts, round(vol_short, 6) AS vol_short, round(vol_long, 6) AS vol_long, trend, CASE WHEN vol_short > 1.5 * vol_long THEN 'high' WHEN vol_short < vol_long / 1.5 THEN 'low' ELSE 'normal' END AS volatility FROM s WHERE k = 1""")
def regime_snapshot(spark, sf):
    return rounded(G.regime_snapshot(hourly_grid(spark, sf), 24, 168))


@query(f"""WITH s AS (SELECT CAST(user_id % 50 AS VARCHAR) AS symbol, event_type AS specialist, CASE WHEN avg(value) > 20.5 THEN 'LONG' WHEN avg(value) < 19.5 THEN 'SHORT' ELSE 'NO TRADE' END AS action, CASE WHEN avg(value) > 20 THEN 1 ELSE -1 END AS view, count(*) % 3 = 0 AS validated, round(avg(value), 3) AS e FROM events GROUP BY 1, 2),
 g AS (SELECT symbol, coalesce(bool_or(validated AND action = 'LONG'), false) AS l, coalesce(bool_or(validated AND action = 'SHORT'), false) AS s, first(action ORDER BY e DESC, specialist DESC) FILTER (validated AND action <> 'NO TRADE') AS a, max(e) FILTER (validated AND action <> 'NO TRADE') AS edge, count(*) FILTER (view > 0) AS up, count(*) FILTER (view < 0) AS down, count(*) AS n FROM s GROUP BY symbol),
 v AS (SELECT *, CASE WHEN CAST(symbol AS INTEGER) % 7 = 0 THEN 'NO TRADE' WHEN l AND s THEN 'NO TRADE' WHEN l OR s THEN a ELSE 'NO TRADE' END AS verdict FROM g) SELECT symbol, verdict, CASE WHEN verdict <> 'NO TRADE' THEN edge END AS edge_bps, round(greatest(up, down) / n, 6) AS agreement FROM v""")
def consensus(spark, sf):
    e = S.table(spark, sf, "events").select((F.col("user_id") % 50).cast("string").alias("symbol"), F.col("event_type").alias("specialist"), "value")
    a = e.groupBy("symbol", "specialist").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    signals = a.select("symbol", "specialist", F.when(F.col("m") > 20.5, "LONG").when(F.col("m") < 19.5, "SHORT").otherwise("NO TRADE").alias("action"), F.when(F.col("m") > 20, 1).otherwise(-1).alias("view"), (F.col("n") % 3 == 0).alias("validated"), F.round("m", 3).alias("expected_edge_bps"))
    health = a.select("symbol").distinct().withColumn("ok", F.col("symbol").cast("int") % 7 != 0)
    return rounded(G.consensus(signals, health))


@query(f"""WITH {Q.HOURLY}, t AS (SELECT symbol || ts::VARCHAR AS key, symbol, CASE WHEN hour(ts) % 2 = 0 THEN 1 ELSE -1 END AS side, ts AS entry_ts, ts + INTERVAL 6 HOUR AS exit_ts FROM e WHERE hour(ts) % 6 = 0), n AS (SELECT symbol, max(ts) AS now FROM e GROUP BY symbol)
SELECT t.symbol, t.entry_ts, CAST(side AS INTEGER) AS side, CASE WHEN exit_ts > now THEN 'open' WHEN x.close IS NOT NULL AND a.close IS NOT NULL THEN 'closed' ELSE 'void' END AS status, round(CASE WHEN exit_ts <= now AND x.close IS NOT NULL THEN side * ln(x.close / a.close) - 0.0016 END, 6) AS net
FROM t JOIN e a ON a.symbol = t.symbol AND a.ts = t.entry_ts LEFT JOIN e x ON x.symbol = t.symbol AND x.ts = t.exit_ts JOIN n ON n.symbol = t.symbol""")
def paper_resolve(spark, sf):
    bars = S.hourly(spark, sf).select("symbol", "ts", "close")
    t = bars.where(F.hour("ts") % 6 == 0).select(F.concat("symbol", F.col("ts").cast("string")).alias("key"), "symbol", F.when(F.hour("ts") % 2 == 0, 1).otherwise(-1).alias("side"), F.col("ts").alias("entry_ts"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("exit_ts"))
    return rounded(G.resolve_paper(t, bars, 0.0016).select("symbol", "entry_ts", "side", "status", "net"))


@query("""WITH l AS (SELECT l_orderkey AS book, CASE WHEN l_linenumber % 2 = 0 THEN 'ask' ELSE 'bid' END AS side, CASE WHEN l_linenumber % 2 = 0 THEN 100 + l_discount * 100 + l_linenumber * 0.01 ELSE 99 - l_discount * 100 - l_linenumber * 0.01 END AS px, l_quantity AS qty FROM lineitem),
 r AS (SELECT *, sum(px * qty) OVER (PARTITION BY book, side ORDER BY CASE WHEN side = 'ask' THEN px ELSE -px END) - px * qty AS b FROM l), t AS (SELECT *, greatest(0, least(px * qty, 3000 - b)) AS t FROM r)
SELECT book, side, round(sum(t), 4) AS filled, round(CASE WHEN sum(t) >= 3000 - 1e-9 THEN sum(t) / sum(t / px) END, 6) AS vwap FROM t GROUP BY 1, 2""")
def book_walk(spark, sf):
    n = F.col("l_linenumber")
    ask = n % 2 == 0
    levels = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.when(ask, "ask").otherwise("bid").alias("side"), F.when(ask, 100 + F.col("l_discount") * 100 + n * 0.01).otherwise(99 - F.col("l_discount") * 100 - n * 0.01).alias("px"), F.col("l_quantity").alias("qty"))
    return G.book_walk(levels, 3000.0).select("book", "side", F.round("filled", 4).alias("filled"), F.round("vwap", 6).alias("vwap"))


@query("""SELECT event_id, CASE WHEN m < 60 THEN m::VARCHAR || ' min' WHEN m % 1440 = 0 AND m >= 2880 THEN CAST(m / 1440 AS BIGINT)::VARCHAR || ' day' || CASE WHEN m = 1440 THEN '' ELSE 's' END ELSE CAST(floor(m / 60) AS BIGINT)::VARCHAR || ' hour' || CASE WHEN m = 60 THEN '' ELSE 's' END END AS hold,
 CASE WHEN p > -0.01 AND p <= 1/3 THEN 'low' WHEN p > 1/3 AND p <= 2/3 THEN 'mid' WHEN p > 2/3 AND p <= 1.01 THEN 'high' END AS volatility, CASE WHEN value > 20 THEN 'up' ELSE 'down' END AS trend, round(greatest(least(value, 25.0), 5.0), 6) AS clipped FROM (SELECT event_id, value, (1 + event_id % 97) * 15 AS m, (event_id % 100) / 99.0 AS p FROM events)""")
def scalar_functions(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", "value", ((1 + F.col("event_id") % 97) * 15).alias("m"), ((F.col("event_id") % 100) / 99.0).alias("p"))
    return e.select("event_id", Z.hold_text(F.col("m")).alias("hold"), Z.volatility_regime(F.col("p")).alias("volatility"), Z.trend_regime(F.col("value") - 20).alias("trend"), F.round(Z.clip(F.col("value"), 5.0, 25.0), 6).alias("clipped"))


@query()
def normal_cdf_column(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", (F.col("value") / 10 - 2).alias("x"))
    return e.select("event_id", F.round(Z.normal_cdf(F.col("x")), 9).alias("cdf"))


@query(f"""WITH {Q.HOURLY} SELECT symbol, ts, CAST(CASE WHEN r > 1 THEN 2 WHEN r > 0 THEN 1 ELSE 0 END AS INTEGER) AS status, row_number() OVER (PARTITION BY ts ORDER BY CASE WHEN r > 1 THEN 2 WHEN r > 0 THEN 1 ELSE 0 END DESC, abs(r) DESC, symbol) AS place FROM (SELECT symbol, ts, round(ln(close) - ln(lag(close) {_w}), 6) AS r FROM e) WHERE r IS NOT NULL""")
def scanner_order(spark, sf):
    """Rows of a scan by status, then confidence."""
    r = S.hourly(spark, sf).select("symbol", "ts", F.round(F.ln("close") - F.ln(F.lag("close").over(w())), 6).alias("r")).where("r IS NOT NULL")
    status = F.when(F.col("r") > 1, 2).when(F.col("r") > 0, 1).otherwise(0)
    order = Window.partitionBy("ts").orderBy(F.desc("status"), F.desc(F.abs("r")), "symbol")
    return r.withColumn("status", status).select("symbol", "ts", "status", F.row_number().over(order).cast("bigint").alias("place"))


@query()
def ml_logistic_walk_forward(spark, sf):
    return ML.walk_forward(ML.quality_features(spark, sf), 4)


@query()
def ml_calibrate(spark, sf):
    return ML.calibrated(ML.walk_forward(ML.quality_features(spark, sf), 4))


@query()
def ml_calibrate_isotonic(spark, sf):
    return ML.calibrated(ML.walk_forward(ML.quality_features(spark, sf), 4), "isotonic")


@query()
def ml_walk_forward_decisions(spark, sf):
    """Fit, calibrate, gate and decide, fold by fold."""
    return ML.decided(ML.calibrated(ML.walk_forward(ML.quality_features(spark, sf), 4)))


@query()
def ml_perceptron_walk_forward(spark, sf):
    return ML.walk_forward(ML.quality_features(spark, sf), 2, "perceptron")


@query()
def ml_forest_importance(spark, sf):
    return ML.permutation_importance(ML.quality_features(spark, sf))


@query()
def stream_closed_bars(spark, sf):
    return streams.closed_bars(spark, sf)


@query()
def stream_cusum(spark, sf):
    return streams.cusum_stream(spark, sf)
