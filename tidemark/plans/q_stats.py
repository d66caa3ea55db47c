"""Queries over measures, tests, bootstraps and event studies."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators import state as T
from tidemark.operators import stats as M
from tidemark.operators import windows as X
from tidemark.operators.grid import w
from tidemark.plans import sql as Q
from tidemark.plans.q_backtest import _PORT, _SIM, _sim
from tidemark.plans.q_bars import _over, _tsum, _w, hourly_grid
from tidemark.plans.registry import query, rounded
from tidemark.sources import tables as S

_C = f"WITH {Q.LABELLED}"
_LL = "-(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))"


@query(f"{_C} SELECT count(*) AS n, round(avg({_LL}), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(y), 6) AS base_rate FROM c")
def log_loss_brier(spark, sf):
    return rounded(M.scores(S.labelled(spark, sf)))


_EDGES = ", ".join(f"quantile_cont(p, {i / 10})" for i in range(11))
_REL = f"""{_C}, e AS (SELECT [{_EDGES}] AS q FROM c), d AS (SELECT list_sort(list_distinct(q)) AS q FROM e), b AS (SELECT c.*, greatest(len(list_filter(d.q, lambda z: z < c.p)) - 1, 0) AS bin FROM c, d),
 r AS (SELECT bin, avg(p) AS p_mean, avg(y) AS y_mean, count(*) AS n FROM b GROUP BY bin)"""


@query(f"{_REL} SELECT CAST(bin AS INTEGER) AS bin, round(p_mean, 6) AS p_mean, round(y_mean, 6) AS y_mean, n FROM r")
def reliability_table(spark, sf):
    return rounded(M.reliability(S.labelled(spark, sf)))


@query(f"{_REL} SELECT round(sum(n * abs(p_mean - y_mean)) / sum(n), 6) AS ece FROM r")
def reliability_ece(spark, sf):
    return rounded(M.ece(M.reliability(S.labelled(spark, sf))))


@query(f"{_C}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM c) SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def auc_ranks(spark, sf):
    return rounded(M.auc(S.labelled(spark, sf)))


@query(f"""{_C}, k AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM c)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM k""")
def confusion_metrics(spark, sf):
    return rounded(M.confusion(S.labelled(spark, sf)))


@query(f"""{_PORT}, mo AS (SELECT count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd FROM p), ce AS (SELECT avg(pow(ret - mu, 2)) AS m2, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4 FROM p, mo)
SELECT n, round(mu, 6) AS mean, round(sd, 6) AS sd, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / pow(m2, 2), 5) AS kurt FROM mo, ce""")
def return_moments(spark, sf):
    from tidemark.operators import backtest as B

    m = B.portfolio(_sim(spark, sf)).agg(*M.moments("ret"))
    return m.select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("skew", 6).alias("skew"), F.round("kurt", 5).alias("kurt"))


@query()
def deflated_sharpe(spark, sf):
    from tidemark.operators import backtest as B

    p = B.portfolio(_sim(spark, sf))
    return spark.createDataFrame([(float(n), float(M.deflated_sharpe(p, "ret", n, 0.01))) for n in (1, 10, 100)], "trials double, dsr double")


_NWT = " + ".join(f"2 * (1 - {k} / 7.0) * coalesce(d * lag(d, {k}) {_w}, 0)" for k in range(1, 7))


@query(f"{_SIM}, a AS (SELECT symbol, ts, net - avg(net) OVER (PARTITION BY symbol) AS d, avg(net) OVER (PARTITION BY symbol) AS m FROM sim), t AS (SELECT symbol, m, d * d + {_NWT} AS t FROM a) SELECT symbol, count(*) AS n, round(max(m), 6) AS mean, round(sum(t) / count(*), 6) AS variance FROM t GROUP BY symbol")
def newey_west(spark, sf):
    return rounded(M.newey_west(_sim(spark, sf), "net", 6, "symbol"))


@query()
def diebold_mariano(spark, sf):
    c = S.labelled(spark, sf).select(F.col("doc_id").alias("ts"), M.logloss(F.col("y"), F.lit(0.5)).alias("a"), M.logloss(F.col("y"), F.col("p")).alias("b"))
    gain, p = M.diebold_mariano(c, "a", "b")
    return spark.createDataFrame([(gain, p)], "gain double, p_value double")


@query(f"""{_PORT}, x AS (SELECT ts, ret, lag(ret) OVER (ORDER BY ts) AS a, lag(ret, 24) OVER (ORDER BY ts) AS b FROM p), z AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL),
 gm AS (SELECT avg(ret) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, ret) AS ya, covar_pop(b, ret) AS yb FROM z)
SELECT round((ya * bb - yb * ab) / (aa * bb - ab * ab), 5) AS beta_a, round((yb * aa - ya * ab) / (aa * bb - ab * ab), 5) AS beta_b, round(my - (ya * bb - yb * ab) / (aa * bb - ab * ab) * ma - (yb * aa - ya * ab) / (aa * bb - ab * ab) * mb, 5) AS alpha, (SELECT count(*) FROM z) AS n FROM gm""")
def hac_ols(spark, sf):
    """Coefficients against the closed form; t values are tested against a direct computation."""
    from tidemark.operators import backtest as B

    order = Window.partitionBy(F.lit(1)).orderBy("ts")
    p = B.portfolio(_sim(spark, sf)).select("ts", "ret", F.lag("ret").over(order).alias("a"), F.lag("ret", 24).over(order).alias("b"))
    beta, _, n = M.hac_ols(p, "ret", ["a", "b"], 5)
    return spark.createDataFrame([tuple(round(float(b), 5) for b in beta) + (n,)], "alpha double, beta_a double, beta_b double, n long")


_PV = "pv AS (SELECT c_custkey AS id, round((c_acctbal + 1000) / 11000.0, 6) AS p FROM customer)"


@query(f"""WITH {_PV}, r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM pv)
SELECT id, p, round(max(least(1, (m - r + 1) * p)) OVER (ORDER BY r), 6) AS holm, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM r""")
def holm_bh(spark, sf):
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round((F.col("c_acctbal") + 1000) / 11000.0, 6).alias("p"))
    return rounded(M.holm_bh(c))


@query(f"""{_SIM}, k AS (SELECT symbol AS config, row_number() {_w} - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n, net AS ret FROM sim),
 b AS (SELECT config, CASE WHEN t < (n % 6) * (n // 6 + 1) THEN t // (n // 6 + 1) ELSE n % 6 + (t - (n % 6) * (n // 6 + 1)) // (n // 6) END AS block, ret FROM k),
 sp AS (SELECT row_number() OVER () - 1 AS split, [a, b, c] AS x FROM (SELECT a.v AS a, b.v AS b, c.v AS c FROM range(6) a(v), range(6) b(v), range(6) c(v) WHERE a.v < b.v AND b.v < c.v ORDER BY 1, 2, 3)),
 m AS (SELECT split, config, list_contains(x, block) AS ins, avg(ret) / (stddev_samp(ret) + 1e-12) AS v FROM b, sp GROUP BY 1, 2, 3), v AS (SELECT split, config, max(v) FILTER (ins) AS i, max(v) FILTER (NOT ins) AS o FROM m GROUP BY 1, 2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY i DESC, config) AS best, rank() OVER (PARTITION BY split ORDER BY o) AS k, count(*) OVER (PARTITION BY split) AS n FROM v)
SELECT count(*) AS splits, round(avg((k / (n + 1.0) <= 0.5)::INT), 6) AS pbo FROM rk WHERE best = 1""")
def pbo_cscv(spark, sf):
    s = _sim(spark, sf).select(F.col("symbol").alias("config"), F.row_number().over(w()).alias("t"), F.count("*").over(Window.partitionBy("symbol")).alias("n_t"), F.col("net").alias("ret")).withColumn("t", F.col("t") - 1)
    return rounded(M.pbo(s).agg(F.count("*").alias("splits"), F.avg(F.col("below").cast("double")).alias("pbo")))


@query(f"""WITH {Q.WEEKLY}, x AS (SELECT symbol, ts, ln(close) - ln(lag(close) {_w}) AS mom, ln(lead(close) {_w}) - ln(close) AS fwd FROM l), z AS (SELECT *, avg(mom) OVER (PARTITION BY ts) AS m, stddev_pop(mom) OVER (PARTITION BY ts) AS s, count(*) OVER (PARTITION BY ts) AS n FROM x WHERE mom IS NOT NULL AND fwd IS NOT NULL)
SELECT ts, count(*) AS n, round(regr_slope(fwd, (mom - m) / s), 6) AS slope FROM z WHERE n >= 3 AND s > 0 GROUP BY ts""")
def fama_macbeth(spark, sf):
    weeks = S.weekly_suppliers(spark, sf)
    x = weeks.select("symbol", "ts", (F.ln("close") - F.ln(F.lag("close").over(w()))).alias("mom"), (F.ln(F.lead("close").over(w())) - F.ln("close")).alias("fwd")).where("mom IS NOT NULL AND fwd IS NOT NULL")
    return rounded(M.fama_macbeth(x, "fwd", "mom"))


_EV = f"""WITH {Q.HOURLY_GRID}, f AS (SELECT *, ln(last_value(close IGNORE NULLS) {_w}) AS lc FROM g), v AS (SELECT *, pow(lc - lag(lc) {_w}, 2) AS r2, row_number() {_w} AS k FROM f),
 s AS (SELECT *, sqrt(CASE WHEN count(r2) {_over(48)} >= 48 THEN avg(r2) {_over(48)} END) AS sigma, ({_tsum('gap::INT', 4)}) = 0 AS clean, lc - lag(lc, 4) {_w} AS r4, CASE WHEN ({_tsum('quote_volume', 4)}) > 0 THEN ({_tsum('2 * taker_buy_quote - quote_volume', 4)}) / ({_tsum('quote_volume', 4)}) END AS imb FROM v)"""


def _event_grid(spark, sf):
    return E.with_sigma(hourly_grid(spark, sf), 48)


@query(f"{_EV} SELECT symbol, ts, CASE WHEN coalesce(hour(ts) % 4 = 0 AND clean AND r4 IS NOT NULL, false) THEN -sign(r4) ELSE 0 END + 0.0 AS signal FROM s")
def event_reversal_control(spark, sf):
    g = _event_grid(spark, sf)
    sig = E.reversal(4, F.hour("ts") % 4 == 0)
    return g.select("symbol", "ts", F.coalesce(sig, F.lit(0.0)).alias("signal")).select("symbol", "ts", (F.col("signal") + 0.0).alias("signal"))


_P4 = f"{_EV}, a AS (SELECT *, abs(imb) AS ai FROM s), d AS (SELECT symbol, k, (k - 1) // 24 AS b, ai FROM a WHERE (k - 1) % 2 = 0 AND ai IS NOT NULL), q AS (SELECT a.*, CASE WHEN ai IS NOT NULL THEN (SELECT CASE WHEN count(*) >= 30 THEN avg((d.ai < a.ai)::INT) END FROM d WHERE d.symbol = a.symbol AND d.b BETWEEN (a.k - 1) // 24 - 5 AND (a.k - 1) // 24 - 1) END AS pct FROM a), fr AS (SELECT *, CASE WHEN coalesce(sign(imb) = sign(r4) AND abs(r4 / (sigma * 2 + 1e-12)) >= 0.3 AND pct >= 0.5 AND clean, false) THEN -sign(r4) ELSE 0 END AS signal FROM q)"


def _flow(spark, sf):
    g = _event_grid(spark, sf).withColumn("ai", F.abs(X.imbalance(4)))
    g = X.trailing_percentile(g, "ai", 24, 5, 2, "pct")
    return g.withColumn("signal", E.flow_reversal(4, 0.3, "pct", 0.5)).withColumn("k", F.row_number().over(w()))


@query(f"{_P4} SELECT symbol, ts, signal + 0.0 AS signal FROM fr WHERE signal <> 0")
def event_flow_reversal(spark, sf):
    return _flow(spark, sf).where("signal <> 0").select("symbol", "ts", "signal")


_CD = f"""WITH RECURSIVE {_P4[5:]}, n AS (SELECT symbol, k, ts, signal FROM fr WHERE signal <> 0), kept AS (SELECT symbol, min(k) AS k FROM n GROUP BY symbol UNION ALL SELECT t.symbol, (SELECT min(n.k) FROM n WHERE n.symbol = t.symbol AND n.k >= t.k + 12) AS k FROM kept t WHERE t.k IS NOT NULL),
 ev AS (SELECT n.symbol, n.ts, n.k, n.signal AS dir FROM n JOIN kept ON kept.symbol = n.symbol AND kept.k = n.k)"""


def _events(spark, sf):
    return T.cooldown(_flow(spark, sf).where("signal <> 0").select("symbol", "k", "ts", F.col("signal").alias("dir")), 12)


@query(f"{_CD} SELECT symbol, k, ts, dir + 0.0 AS dir FROM ev")
def event_cooldown(spark, sf):
    return _events(spark, sf).select("symbol", "k", "ts", "dir")


_FILL = "ln(coalesce(CASE WHEN volume > 0 AND quote_volume / volume BETWEEN low * 0.999 AND high * 1.001 THEN quote_volume / volume END, close))"
_OUT = f"""{_CD}, fl AS (SELECT symbol, ts, k, gap, {_FILL} AS fill, sum(gap::INT) {_w} AS gs, sigma FROM s),
 oc AS (SELECT ev.symbol, ev.ts, ev.dir, (b.fill - a.fill) * ev.dir AS ret, c.sigma * sqrt(6) AS sigma_h, hour(ev.ts) AS hour FROM ev JOIN fl c ON c.symbol = ev.symbol AND c.k = ev.k JOIN fl a ON a.symbol = ev.symbol AND a.k = ev.k + 1 JOIN fl b ON b.symbol = ev.symbol AND b.k = ev.k + 7 WHERE b.gs = c.gs)"""


def _outcomes(spark, sf):
    return E.outcomes(_events(spark, sf).select("symbol", "ts", "dir"), _event_grid(spark, sf), 6, 1, "1 HOURS")


@query(f"{_OUT} SELECT symbol, ts, dir + 0.0 AS dir, round(ret, 6) AS ret, round(sigma_h, 6) AS sigma_h, CAST(hour AS INTEGER) AS hour FROM oc")
def event_outcomes(spark, sf):
    return rounded(_outcomes(spark, sf))


_BRK = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"


@query(f"""{_EV} SELECT symbol, ts, CASE WHEN close > CASE WHEN count(high) {_BRK} >= 21 THEN max(high) {_BRK} END AND imb > 0 THEN 1.0 WHEN close < CASE WHEN count(low) {_BRK} >= 21 THEN min(low) {_BRK} END AND imb < 0 THEN -1.0 ELSE 0.0 END AS signal FROM s""")
def event_breakout(spark, sf):
    return _event_grid(spark, sf).select("symbol", "ts", E.breakout(24, 4).alias("signal"))


@query(f"""{_EV}, t AS (SELECT *, {" + ".join(f"coalesce(lag(trades, {24 * d}) {_w}, 0)" for d in range(1, 8))} AS ps, {" + ".join(f"(lag(trades, {24 * d}) {_w} IS NOT NULL)::INT" for d in range(1, 8))} AS pn FROM s), i AS (SELECT *, CASE WHEN pn >= 6 AND ps > 0 THEN trades / (ps / pn) END AS busy, r4 / (sigma * 2 + 1e-12) AS z FROM t)
SELECT symbol, ts, CASE WHEN z <= -0.5 AND imb <= -0.1 AND busy >= 1.2 AND clean THEN 1.0 WHEN z >= 0.5 AND imb >= 0.1 AND busy >= 1.2 AND clean THEN -1.0 ELSE 0.0 END AS signal FROM i""")
def event_cascade(spark, sf):
    g = _event_grid(spark, sf).withColumn("busy", X.same_clock_ratio("trades", 24))
    return g.select("symbol", "ts", E.cascade(4, 0.5, "busy", 0.1, 1.2).alias("signal"))


_SWP = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND 4 PRECEDING)"


@query(f"""{_EV}, h AS (SELECT *, CASE WHEN count(high) {_SWP} >= 18 THEN max(high) {_SWP} END AS hi, CASE WHEN count(low) {_SWP} >= 18 THEN min(low) {_SWP} END AS lo, exp(lag(lc) {_w}) AS b, high - low + 1e-12 AS span FROM s)
SELECT symbol, ts, CASE WHEN high > hi AND close < hi AND (high - greatest(close, b)) / span >= 0.1 THEN -1.0 WHEN low < lo AND close > lo AND (least(close, b) - low) / span >= 0.1 THEN 1.0 ELSE 0.0 END AS signal FROM h""")
def event_sweep(spark, sf):
    g = _event_grid(spark, sf).withColumn("much", F.lit(9.0))
    return g.select("symbol", "ts", E.sweep_reclaim(24, 4, "much", 0.1).alias("signal"))


@query(f"""WITH {Q.HOURLY_GRID}, f AS (SELECT symbol, ts, ln(last_value(close IGNORE NULLS) {_w}) AS lc FROM g), m AS (SELECT symbol, ts, lc - lag(lc, 52) {_w} AS mv FROM f), x AS (SELECT * FROM m WHERE isodow(ts) = 1 AND hour(ts) = 0 AND mv IS NOT NULL),
 z AS (SELECT *, CASE WHEN count(mv) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING) >= 2 THEN stddev_pop(mv) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING) END AS sd FROM x)
SELECT symbol, ts, CASE WHEN coalesce(abs(mv / (sd + 1e-12)) >= 0.5, false) THEN -sign(mv) ELSE 0 END + 0.0 AS signal FROM z""")
def event_weekend(spark, sf):
    g = hourly_grid(spark, sf).withColumn("lc", X.log_close()).withColumn("weekend_move", X.log_return(52))
    mondays = g.where((F.weekday(F.col("ts").cast("date")) == 0) & (F.hour("ts") == 0) & F.col("weekend_move").isNotNull())
    return mondays.select("symbol", "ts", E.weekend(least=2, k=0.5).alias("signal"))


@query(f"""{_CD}, pool AS (SELECT symbol, ts, sigma FROM s WHERE NOT gap AND sigma IS NOT NULL), c AS (SELECT symbol, quantile_cont(sigma, 0.333) AS q1, quantile_cont(sigma, 0.667) AS q2 FROM pool GROUP BY symbol),
 p AS (SELECT pool.symbol, ts, hour(ts) AS h, (sigma >= q1)::INT + (sigma >= q2)::INT AS t FROM pool JOIN c ON c.symbol = pool.symbol), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, h, t ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, h, t) AS n FROM p),
 en AS (SELECT r.symbol, r.h, r.t, r.n, ev.ts, ev.dir, row_number() OVER (PARTITION BY r.symbol, r.h, r.t ORDER BY ev.ts) - 1 AS e FROM ev JOIN r ON r.symbol = ev.symbol AND r.ts = ev.ts)
SELECT en.symbol, en.ts AS event_ts, r.ts, en.dir + 0.0 AS dir FROM en, range(3) j(j) JOIN r ON r.symbol = en.symbol AND r.h = en.h AND r.t = en.t AND r.i = (en.e * 7919 + j.j * 104729) % r.n""".replace("FROM en, range(3) j(j) JOIN r", "FROM (en CROSS JOIN range(3) j(j)) JOIN r"))
def placebo_match(spark, sf):
    pool = _event_grid(spark, sf).where("NOT gap AND sigma IS NOT NULL").select("symbol", "ts", "sigma")
    return E.placebo(_events(spark, sf).select("symbol", "ts", "dir"), pool, 3)


_BOOT = "SELECT b, sum(y.s) / sum(y.c) AS mean FROM x CROSS JOIN range(200) r(b) JOIN x y ON y.i = (b * 7919 + x.i * 104729 + b * x.i * 31) % x.n GROUP BY b"


def _blocks(src: str, value: str, key: str) -> str:
    return f"k AS (SELECT {key} AS k, sum({value}) AS s, count({value}) AS c FROM {src} GROUP BY 1), x AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, s, c FROM k)"


@query(f"{_SIM}, {_blocks('sim', 'net', 'date_trunc(\'day\', ts)')}, o AS ({_BOOT}) SELECT b, round(mean, 6) AS mean FROM o")
def day_bootstrap(spark, sf):
    return rounded(M.block_bootstrap(_sim(spark, sf), "net", F.date_trunc("day", "ts"), 200))


@query(f"{_SIM}, {_blocks('sim', 'net', 'date_trunc(\'week\', ts)')}, o AS ({_BOOT}) SELECT b, round(mean, 6) AS mean FROM o")
def week_bootstrap(spark, sf):
    return rounded(M.block_bootstrap(_sim(spark, sf), "net", F.date_trunc("week", "ts"), 200))


@query(f"""{_SIM}, d AS (SELECT date_trunc('day', ts) AS k, sum(net) FILTER (symbol = 'click') AS sa, count(net) FILTER (symbol = 'click') AS ca, sum(net) FILTER (symbol = 'view') AS sb, count(net) FILTER (symbol = 'view') AS cb FROM sim GROUP BY 1),
 x AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, * FROM d) SELECT b, round(sum(y.sa) / sum(y.ca) - sum(y.sb) / sum(y.cb), 6) AS delta FROM x CROSS JOIN range(200) r(b) JOIN x y ON y.i = (b * 7919 + x.i * 104729 + b * x.i * 31) % x.n GROUP BY b""")
def delta_bootstrap(spark, sf):
    """Difference of means of two samples over jointly drawn days."""
    s = _sim(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    one = lambda name: F.when(F.col("symbol") == name, F.col("net"))
    days = s.groupBy("day").agg(F.sum(one("click")).alias("sa"), F.count(one("click")).alias("ca"), F.sum(one("view")).alias("sb"), F.count(one("view")).alias("cb"))
    all_ = Window.partitionBy(F.lit(1))
    days = days.withColumns({"i": F.row_number().over(all_.orderBy("day")) - 1, "n": F.count("*").over(all_)})
    drawn = days.select("i", "n").join(F.broadcast(spark.range(200).withColumnRenamed("id", "b"))).withColumn("j", M.pick(F.col("b"), F.col("i"), F.col("n")))
    got = drawn.join(F.broadcast(days.select(F.col("i").alias("j"), "sa", "ca", "sb", "cb")), "j").groupBy("b")
    return rounded(got.agg((F.sum("sa") / F.sum("ca") - F.sum("sb") / F.sum("cb")).alias("delta")))


@query(f"""{_PORT}, x AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER () AS n, ret FROM p), y AS (SELECT b, t, n, CASE WHEN t = 0 OR (b * 7907 + t * 7901 + b * t * 13) % 1000 < 111 THEN t END AS s FROM x CROSS JOIN range(50) r(b)),
 z AS (SELECT b, t, n, last_value(s IGNORE NULLS) OVER (PARTITION BY b ORDER BY t) AS s FROM y), dr AS (SELECT b, ((b * 7919 + s * 104729 + b * s * 31) % n + t - s) % n AS j FROM z) SELECT b, round(avg(x.ret), 6) AS mean FROM dr JOIN x ON x.t = dr.j GROUP BY b""")
def stationary_bootstrap(spark, sf):
    from tidemark.operators import backtest as B

    return rounded(M.stationary_bootstrap(B.portfolio(_sim(spark, sf)), "ret", 9.0, 50))


@query(f"{_OUT}, su AS (SELECT symbol, count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS days, avg(ret) * 1e4 AS gross_bps, avg(ret - 0.0016) * 1e4 AS net_bps, avg((ret > 0.0016)::INT) AS hit_rate, avg(ret / sigma_h) AS in_sigma FROM oc GROUP BY symbol) SELECT symbol, n, days, round(gross_bps, 4) AS gross_bps, round(net_bps, 4) AS net_bps, round(hit_rate, 6) AS hit_rate, round(in_sigma, 6) AS in_sigma FROM su")
def event_summary(spark, sf):
    o = _outcomes(spark, sf).withColumn("net", F.col("ret") - 0.0016)
    a = o.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct(F.date_trunc("day", "ts")).alias("days"), (F.avg("ret") * 1e4).alias("gross_bps"), (F.avg("net") * 1e4).alias("net_bps"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.avg(F.col("ret") / F.col("sigma_h")).alias("in_sigma"))
    return a.select("symbol", "n", "days", F.round("gross_bps", 4).alias("gross_bps"), F.round("net_bps", 4).alias("net_bps"), F.round("hit_rate", 6).alias("hit_rate"), F.round("in_sigma", 6).alias("in_sigma"))
