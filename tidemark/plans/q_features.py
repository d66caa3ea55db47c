"""Queries over feature families, fills and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as V
from tidemark.operators import labels as L
from tidemark.operators import windows as X
from tidemark.plans import sql as Q
from tidemark.plans.q_bars import _over, _roll, _times, _tsum, _w, daily_grid, hourly_grid
from tidemark.plans.registry import query, rounded
from tidemark.sources import tables as S

_P = f"""WITH {Q.HOURLY_GRID}, f AS (SELECT *, ln(last_value(close IGNORE NULLS) {_w}) AS lc, 2 * taker_buy_quote - quote_volume AS sqv, coalesce(pow(ln(high) - ln(low), 2) / (4 * ln(2)), 0) AS pk FROM g),
 h AS (SELECT *, coalesce(lc - lag(lc) {_w}, 0) AS r FROM f), p AS (SELECT *, r * r AS r2, abs(r) AS absr, sqv * r AS sr, sqv * sqv AS ss FROM h)"""


def _ok(n: int) -> str:
    return f"({_tsum('gap::INT', n)}) <= 0.05 * {n}"


def _ret(n: int) -> str:
    return f"(lc - lag(lc, {n}) {_w})"


def _mom(n: int) -> str:
    z = f"CASE WHEN {_ok(n)} THEN {_ret(n)} END"
    return f"round({z}, 6) AS mom__ret_{n}, round(({z}) / (sqrt(({_tsum('r2', 24)}) / 24) * sqrt({n}) + 1e-12), 6) AS mom__z_{n}"


@query(f"{_P} SELECT symbol, ts, {_mom(4)}, {_mom(24)}, {_mom(72)} FROM p")
def feat_momentum(spark, sf):
    p = V.prepared(hourly_grid(spark, sf))
    return rounded(p.select("symbol", "ts", *[c.alias(n) for n, c in V.momentum((4, 24, 72), 24).items()]))


def _rv(n: int) -> str:
    return f"sqrt(({_tsum('r2', n)}) / {n})"


@query(f"""{_P} SELECT symbol, ts, {", ".join(f"round(CASE WHEN {_ok(n)} THEN ln({_rv(n)} + 1e-12) END, 6) AS vol__rv_{n}" for n in (6, 24, 168))}, round(ln(sqrt(({_tsum('pk', 24)}) / 24) + 1e-12), 6) AS vol__parkinson_24,
 round(ln(({_rv(6)} + 1e-12) / ({_rv(24)} + 1e-12)), 6) AS vol__ratio_6_24, round(ln(({_rv(24)} + 1e-12) / ({_rv(168)} + 1e-12)), 6) AS vol__ratio_24_168,
 round(ln(({_rv(24)} + 1e-12) / (sqrt(({_tsum('pk', 24)}) / 24) + 1e-12)), 6) AS vol__rv_vs_range_24 FROM p""")
def feat_volatility(spark, sf):
    p = V.prepared(hourly_grid(spark, sf))
    return rounded(p.select("symbol", "ts", *[c.alias(n) for n, c in V.volatility((6, 24, 168), 24).items()]))


_SAME = " + ".join(f"coalesce(lag(q6, {24 * d}) {_w}, 0)" for d in range(1, 8))


@query(f"""{_P}, q AS (SELECT symbol, ts, {_tsum('quote_volume', 6)} AS q6, {_tsum('quote_volume', 24)} AS q24, {_tsum('quote_volume', 240)} AS qm, {_tsum('trades', 6)} AS n6, {_tsum('trades', 240)} AS nm FROM p)
SELECT symbol, ts, round(ln((q6 * 40 + 1) / (qm + 1)), 6) AS act__qvol_6_vs_month, round(ln((q24 * 10 + 1) / (qm + 1)), 6) AS act__qvol_day_vs_month, round(ln((n6 * 40 + 1) / (nm + 1)), 6) AS act__trades_6_vs_month,
 round(ln((q6 / greatest(n6, 1) + 1) / (qm / greatest(nm, 1) + 1)), 6) AS act__tradesize_6_vs_month, round(ln((q6 * 7 + 1) / ({_SAME} + 1)), 6) AS act__qvol_6_vs_samehour FROM q""")
def feat_activity(spark, sf):
    p = V.prepared(hourly_grid(spark, sf)).withColumn("q_short", X.trailing_sum("quote_volume", 6))
    return rounded(p.select("symbol", "ts", *[c.alias(n) for n, c in V.activity(6, 24, 240).items()]))


def _imb(n: int) -> str:
    return f"CASE WHEN {_ok(n)} AND ({_tsum('quote_volume', n)}) > 0 THEN ({_tsum('sqv', n)}) / (({_tsum('quote_volume', n)}) + 1e-12) END"


def _mean(x: str) -> str:
    return f"(({_tsum(x, 24)}) / 24)"


_LAM = f"(({_mean('sr')} - {_mean('sqv')} * {_mean('r')}) / ({_mean('ss')} - {_mean('sqv')} * {_mean('sqv')} + 1e-12))"


@query(f"""{_P} SELECT symbol, ts, {", ".join(f"round({_imb(n)}, 6) AS flow__imb_{n}, round(({_imb(n)}) * 3 - CASE WHEN {_ok(n)} THEN tanh({_ret(n)} / ({_rv(24)} * sqrt({n}) + 1e-12)) END, 6) AS flow__absorb_{n}" for n in (6, 24))},
 round(CASE WHEN {_ok(24)} THEN sign({_LAM}) * ln(1 + abs({_LAM} * {_mean('quote_volume')}) * 1e4) END, 4) AS flow__impact_24, round(({_imb(6)}) - ({_imb(24)}), 6) AS flow__imb_trend FROM p""")
def feat_order_flow(spark, sf):
    p = V.prepared(hourly_grid(spark, sf))
    cols = V.order_flow((6, 24), 24)
    return p.select("symbol", "ts", *[F.round(c, 4 if "impact" in n else 6).alias(n) for n, c in cols.items()])


_PR = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {Q.DAILY_GRID}, s AS (SELECT *, CASE WHEN count(high) {_PR} >= 18 THEN max(high) {_PR} END AS hi, CASE WHEN count(low) {_PR} >= 18 THEN min(low) {_PR} END AS lo FROM d)
SELECT symbol, ts, round((close - low) / nullif(high - low, 0), 6) AS shape__clv_1d, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS shape__upwick_1d, round((least(open, close) - low) / nullif(high - low, 0), 6) AS shape__lowwick_1d,
 coalesce(low < lo AND close > lo, false)::INT::DOUBLE - coalesce(high > hi AND close < hi, false)::INT::DOUBLE AS shape__sweep_1d, coalesce(close > hi, false)::INT::DOUBLE - coalesce(close < lo, false)::INT::DOUBLE AS shape__breakout_1d FROM s""")
def feat_bar_shape(spark, sf):
    return rounded(V.bar_shape(daily_grid(spark, sf), "1d"))


@query(f"""WITH {Q.HOURLY_GRID} SELECT symbol, ts, {", ".join(f"round((close - ({_roll('min', 'low', 24 * n, int(21.6 * n))})) / nullif(({_roll('max', 'high', 24 * n, int(21.6 * n))}) - ({_roll('min', 'low', 24 * n, int(21.6 * n))}), 0), 6) AS range__pos_{n}d" for n in (1, 7))},
 round(ln(close / ({_roll('max', 'high', 336, 302)})), 6) AS range__dd_from_14d_high FROM g""")
def feat_range_position(spark, sf):
    return rounded(hourly_grid(spark, sf).select("symbol", "ts", *[c.alias(n) for n, c in V.range_position((1, 7), 24, 14).items()]))


@query(f"""{_P} SELECT symbol, ts, {", ".join(f"round(CASE WHEN {_ok(n)} THEN abs({_ret(n)}) / (({_tsum('absr', n)}) + 1e-12) END, 6) AS regime__efficiency_{n}" for n in (4, 24, 168))} FROM p""")
def feat_regime(spark, sf):
    p = V.prepared(hourly_grid(spark, sf))
    return rounded(p.select("symbol", "ts", *[c.alias(n) for n, c in V.regime((4, 24, 168)).items()]))


@query(f"""WITH {Q.HOURLY} SELECT symbol, ts, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS cal__hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS cal__hour_cos, (isodow(ts) >= 6)::INT::DOUBLE AS cal__weekend,
 round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS cal__dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS cal__dow_cos FROM e""")
def feat_calendar(spark, sf):
    return rounded(S.hourly(spark, sf).select("symbol", "ts", *[c.alias(n) for n, c in V.calendar().items()]))


@query(f"""WITH {Q.HOURLY_GRID}, f AS (SELECT *, ln(last_value(close IGNORE NULLS) {_w}) AS lc FROM g), x AS (SELECT symbol, ts, lc - lag(lc, 6) {_w} AS x FROM f)
SELECT a.symbol, a.ts, round(avg((b.x > 0)::INT), 6) AS xa__breadth_6, round(avg(b.x), 6) AS xa__mkt_6, round(stddev_samp(b.x), 6) AS xa__dispersion_6, round(any_value(a.x) - avg(b.x), 6) AS xa__rel_6,
 round((SELECT x FROM x l WHERE l.symbol = 'click' AND l.ts = a.ts), 6) AS xa__lead_6 FROM x a LEFT JOIN x b ON b.ts = a.ts AND b.symbol <> a.symbol GROUP BY a.symbol, a.ts""")
def feat_cross_asset(spark, sf):
    g = hourly_grid(spark, sf).withColumn("lc", X.log_close())
    return rounded(V.cross_asset(g, 6, "click"))


@query(f"""WITH {Q.HOURLY}, k AS (SELECT *, row_number() {_w} - 1 AS k FROM e), r AS (SELECT symbol, ts, k - 1 AS k, close - lag(close) {_w} AS x FROM k), q AS (SELECT symbol, ts, k, greatest(x, 0) AS u, greatest(-x, 0) AS d FROM r WHERE x IS NOT NULL),
 z AS (SELECT symbol, ts, k, first_value(u) {_w} * pow(13/14, k) + pow(13/14, k) * sum(CASE WHEN k > 0 THEN u / 14 * pow(13/14, -k) ELSE 0 END) {_w} AS g, first_value(d) {_w} * pow(13/14, k) + pow(13/14, k) * sum(CASE WHEN k > 0 THEN d / 14 * pow(13/14, -k) ELSE 0 END) {_w} AS l FROM q),
 m AS (SELECT symbol, ts, k, close, first_value(close) {_w} * pow(11/13, k) + pow(11/13, k) * sum(CASE WHEN k > 0 THEN close * 2/13 * pow(11/13, -k) ELSE 0 END) {_w} AS f, first_value(close) {_w} * pow(25/27, k) + pow(25/27, k) * sum(CASE WHEN k > 0 THEN close * 2/27 * pow(25/27, -k) ELSE 0 END) {_w} AS s FROM k),
 n AS (SELECT *, f - s AS m FROM m), o AS (SELECT *, first_value(m) {_w} * pow(0.8, k) + pow(0.8, k) * sum(CASE WHEN k > 0 THEN m * 0.2 * pow(0.8, -k) ELSE 0 END) {_w} AS ms FROM n)
SELECT o.symbol, o.ts, round(CASE WHEN z.k >= 13 AND l > 0 THEN 100 - 100 / (1 + g / l) END, 4) AS ta__rsi_1h, round((m - ms) / close, 4) AS ta__macdhist_1h, round(f / s - 1, 5) AS ta__ema_gap_1h FROM o LEFT JOIN z ON z.symbol = o.symbol AND z.ts = o.ts""")
def feat_classic_indicators(spark, sf):
    t = V.classic_indicators(S.hourly(spark, sf), "1h")
    return t.select("symbol", "ts", F.round("ta__rsi_1h", 4).alias("ta__rsi_1h"), F.round("ta__macdhist_1h", 4).alias("ta__macdhist_1h"), F.round("ta__ema_gap_1h", 5).alias("ta__ema_gap_1h"))


@query(f"""WITH {Q.DAILY} SELECT symbol, ts, {", ".join(f"round(ln(close / lag(close, {n}) {_w}), 6) AS trend__ret_{n}d" for n in (14, 28, 56))},
 round((close - CASE WHEN count(close) {_PR} >= 18 THEN min(close) {_PR} END) / nullif(max(close) {_PR} - min(close) {_PR}, 0), 6) AS trend__donchian_pos_20d, round(ln(close / ({_roll('avg', 'close', 50, 45)})), 6) AS trend__dist_ma50 FROM o""")
def feat_long_trend(spark, sf):
    return rounded(S.daily(spark, sf).select("symbol", "ts", *[c.alias(n) for n, c in V.long_trend((14, 28, 56), (20,), ((50, 45),)).items()]))


@query(f"""WITH {Q.DAILY} SELECT symbol, ts, {", ".join(f"round(close / lag(close, {n}) {_w} - 1, 6) AS return_{n}" for n in (1, 3, 6))}, round(close / ({_roll('avg', 'close', 20, 20)}) - 1, 6) AS sma_gap,
 round(CASE WHEN count(close) {_over(20)} >= 20 THEN coalesce((close - (avg(close) {_over(20)} - 2 * stddev_pop(close) {_over(20)})) / nullif(4 * stddev_pop(close) {_over(20)}, 0), 0.5) END, 6) AS bb_position,
 round(volume / nullif({_roll('avg', 'volume', 20, 20)}, 0), 6) AS volume_ratio, round((close - open) / nullif(high - low, 0), 6) AS body, round((high - low) / close, 6) AS range_share, round(close / lag(close) {_w} - 1, 6) AS return_now FROM o""")
def feat_classroom(spark, sf):
    o = S.daily(spark, sf)
    return rounded(o.select("symbol", "ts", *[c.alias(n) for n, c in V.classroom(o).items()]))


@query(f"""WITH {Q.HOURLY}, {"t AS (SELECT s.symbol, unnest(generate_series(s.a, s.b, INTERVAL 7 HOUR)) AS ts FROM (SELECT symbol, min(ts) - INTERVAL 5 HOUR AS a, max(ts) AS b FROM e GROUP BY symbol) s)"},
 v AS (SELECT symbol, ts, (isodow(ts) >= 6)::INT::DOUBLE AS cal__weekend FROM e) SELECT t.symbol, t.ts, v.cal__weekend FROM t ASOF LEFT JOIN v ON v.symbol = t.symbol AND v.ts <= t.ts""")
def feat_family_projection(spark, sf):
    """Families by prefix, aligned to decision times."""
    bars = S.hourly(spark, sf)
    wide = bars.select("symbol", "ts", *[c.alias(n) for n, c in V.calendar().items()], F.col("close").alias("mom__x"))
    kept = [c for c in V.families(wide.columns, ["cal"]) if c.endswith("weekend")]
    return V.at_decisions(_times(bars), wide.select("symbol", "ts", *kept))


_FILL = "ln(coalesce(CASE WHEN volume > 0 AND quote_volume / volume BETWEEN low * 0.999 AND high * 1.001 THEN quote_volume / volume END, close))"


@query(f"WITH {Q.HOURLY} SELECT symbol, ts, round({_FILL}, 6) AS fill FROM e")
def fill_vwap(spark, sf):
    return rounded(S.hourly(spark, sf).select("symbol", "ts", L.log_fill().alias("fill")))


@query(f"""WITH {Q.HOURLY}, x AS (SELECT *, taker_buy_quote / nullif(taker_buy_base, 0) AS b, (quote_volume - taker_buy_quote) / nullif(volume - taker_buy_base, 0) AS s FROM e)
SELECT symbol, ts, round(CASE WHEN b BETWEEN low * 0.999 AND high * 1.001 THEN b ELSE high END, 4) AS buy_fill, round(CASE WHEN s BETWEEN low * 0.999 AND high * 1.001 THEN s ELSE low END, 4) AS sell_fill FROM x""")
def fill_aggressor(spark, sf):
    return rounded(S.hourly(spark, sf).select("symbol", "ts", *[c.alias(n) for n, c in L.aggressor_fills().items()]), 4)


@query(f"""WITH {Q.HOURLY}, f AS (SELECT symbol, ts, {_FILL} AS fill FROM e)
SELECT e.symbol, e.ts, e.ts + INTERVAL 1 HOUR AS entry_ts, e.ts + INTERVAL 5 HOUR AS exit_ts, round(x.fill - n.fill, 6) AS fwd_ret FROM e LEFT JOIN f n ON n.symbol = e.symbol AND n.ts = e.ts + INTERVAL 1 HOUR LEFT JOIN f x ON x.symbol = e.symbol AND x.ts = e.ts + INTERVAL 5 HOUR""")
def forward_return(spark, sf):
    bars = S.hourly(spark, sf)
    return rounded(L.forward_returns(bars.select("symbol", "ts"), bars, "4 HOURS", "1 HOUR"))


@query(f"WITH {Q.DAILY} SELECT symbol, ts, CASE WHEN lead(close, 5) {_w} IS NOT NULL THEN (lead(close, 5) {_w} > close)::INT::DOUBLE END AS target FROM o")
def direction_target(spark, sf):
    return S.daily(spark, sf).select("symbol", "ts", L.direction_target(5).cast("double").alias("target"))


@query(f"""WITH {Q.DAILY}, n AS (SELECT *, ln(close) AS lc, row_number() {_w} AS k, count(*) OVER (PARTITION BY symbol) AS m FROM o),
 t AS (SELECT a.symbol, a.k, min(CASE WHEN ln(b.high) - a.lc >= 0.5 THEN b.k - a.k END) AS fu, min(CASE WHEN ln(b.low) - a.lc <= -0.5 THEN b.k - a.k END) AS fd, max(CASE WHEN b.k = a.k + 8 THEN ln(b.close) - a.lc END) AS last
       FROM n a JOIN n b ON b.symbol = a.symbol AND b.k > a.k AND b.k <= a.k + 8 GROUP BY 1, 2),
 u AS (SELECT n.symbol, n.ts, n.k + 8 <= n.m AS ok, CASE WHEN n.k + 8 > n.m THEN 0 WHEN fd IS NOT NULL AND (fu IS NULL OR fd <= fu) THEN -1 WHEN fu IS NOT NULL THEN 1 ELSE 0 END AS label, fu, fd, last FROM n LEFT JOIN t ON t.symbol = n.symbol AND t.k = n.k)
SELECT symbol, ts, label, round(CASE WHEN NOT ok THEN NULL WHEN label = 1 THEN 0.5 WHEN label = -1 THEN -0.5 ELSE last END, 6) AS tb_ret, CAST(CASE WHEN label = 1 THEN fu WHEN label = -1 THEN fd ELSE 8 END AS INTEGER) AS bars_held FROM u""")
def triple_barrier(spark, sf):
    return rounded(L.triple_barrier(S.daily(spark, sf), 8, F.lit(0.5), F.lit(0.5)))


_REPLAY = f"""WITH {Q.DAILY}, n AS (SELECT *, row_number() {_w} AS k, count(*) OVER (PARTITION BY symbol) AS m FROM o),
 t AS (SELECT a.symbol, a.k, min(CASE WHEN b.high >= a.close * 1.6 THEN b.k - a.k END) AS ft, min(CASE WHEN b.low <= a.close * 0.7 THEN b.k - a.k END) AS fs, max(CASE WHEN b.k = a.k + 6 THEN b.close END) AS last
       FROM n a JOIN n b ON b.symbol = a.symbol AND b.k > a.k AND b.k <= a.k + 6 GROUP BY 1, 2),
 u AS (SELECT n.symbol, n.ts, n.close, n.k, CASE WHEN fs IS NOT NULL AND (ft IS NULL OR fs <= ft) THEN 'stop' WHEN ft IS NOT NULL THEN 'target' ELSE 'timeout' END AS outcome, ft, fs, last FROM n JOIN t ON t.symbol = n.symbol AND t.k = n.k WHERE n.k + 6 <= n.m),
 v AS (SELECT *, CASE outcome WHEN 'stop' THEN fs WHEN 'target' THEN ft ELSE 6 END AS held FROM u),
 x AS (SELECT v.symbol, v.ts, outcome, CAST(held AS INTEGER) AS bars_held, CASE outcome WHEN 'stop' THEN least(b.open, v.close * 0.7) WHEN 'target' THEN v.close * 1.6 ELSE v.last END / v.close - 1 - 0.002 AS net, b.close / v.close - 1 - 0.002 AS hold_net FROM v JOIN n b ON b.symbol = v.symbol AND b.k = v.k + v.held)"""


@query(f"{_REPLAY} SELECT symbol, ts, outcome, bars_held, round(net, 6) AS net, round(hold_net, 6) AS hold_net FROM x")
def plan_replay(spark, sf):
    return rounded(L.replay(S.daily(spark, sf), 0.6, 0.3, 0.001, 6))


@query(f"""{_REPLAY}, s AS (SELECT symbol, count(*) AS n, avg((outcome = 'target')::INT) AS win_rate, avg((outcome = 'stop')::INT) AS loss_rate, avg((outcome = 'timeout')::INT) AS timeout_rate, avg(bars_held) AS avg_bars, avg(net) AS avg_net, median(net) AS median_net,
   avg((net > 0)::INT) AS share_profitable, avg(hold_net) AS hold_avg_net, avg(net - hold_net) AS levels_vs_hold, 2 * stddev_samp(net) AS e, 2 * stddev_samp(net - hold_net) AS d, greatest(1.0, count(*) / avg(bars_held)) AS n_eff FROM x GROUP BY symbol),
 z AS (SELECT * REPLACE (e / sqrt(n_eff) AS e, d / sqrt(n_eff) AS d) FROM s)
SELECT symbol, n, round(win_rate, 6) AS win_rate, round(loss_rate, 6) AS loss_rate, round(timeout_rate, 6) AS timeout_rate, round(avg_bars, 6) AS avg_bars, round(avg_net, 6) AS avg_net, round(median_net, 6) AS median_net, round(share_profitable, 6) AS share_profitable,
 round(hold_avg_net, 6) AS hold_avg_net, round(levels_vs_hold, 6) AS levels_vs_hold, round(n_eff, 6) AS n_eff, round(avg_net - e, 6) AS avg_net_low, round(avg_net + e, 6) AS avg_net_high, round(levels_vs_hold - d, 6) AS levels_vs_hold_low, round(levels_vs_hold + d, 6) AS levels_vs_hold_high,
 round(0.302 / 0.9, 6) AS break_even, round(0.3 / 0.9, 6) AS random_walk, CASE WHEN n_eff < 10 THEN 'NOT ENOUGH HISTORY' WHEN avg_net + e < 0 THEN 'LOSES ON AVERAGE' WHEN avg_net - e > 0 THEN 'HELD UP IN THE PAST' ELSE 'NO PROVEN EDGE' END AS verdict FROM z""")
def plan_summary(spark, sf):
    return rounded(L.plan_summary(L.replay(S.daily(spark, sf), 0.6, 0.3, 0.001, 6), 0.6, 0.3, 0.001))


@query(f"WITH {Q.DAILY}, x AS (SELECT symbol, ts, lag(close, 28) {_w} AS a, lead(close, 5) {_w} AS b FROM o) SELECT symbol, count(*) AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY symbol")
def dataset_rows(spark, sf):
    """Rows that have every feature and a label."""
    o = S.daily(spark, sf).select("symbol", "ts", *[c.alias(n) for n, c in V.long_trend((28,), (), ()).items()], L.direction_target(5).cast("double").alias("y"))
    return L.clean(o, ["trend__ret_28d", "y"]).groupBy("symbol").agg(F.count("*").alias("n"))


