"""Queries over bars, grids, trailing windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import grid as G
from tidemark.operators import windows as X
from tidemark.operators.grid import w
from tidemark.plans import sql as Q
from tidemark.plans.registry import query, rounded
from tidemark.sources import tables as S

_R = ", ".join(f"round({c}, 6) AS {c}" for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote"))


def hourly_grid(spark: SparkSession, sf: str) -> DataFrame:
    return G.complete(S.hourly(spark, sf), "1 HOUR")


def daily_grid(spark: SparkSession, sf: str) -> DataFrame:
    return G.complete(S.daily(spark, sf), "1 DAY")


@query(f"WITH {Q.HOURLY} SELECT symbol, ts, trades, {_R} FROM e")
def bars_resample(spark, sf):
    return rounded(S.hourly(spark, sf).select(*S.BAR_COLUMNS))


_FOUR = """, x AS (SELECT symbol, to_timestamp(floor((epoch(ts) - 3600) / 14400) * 14400 + 14400)::TIMESTAMP AS w, * EXCLUDE (symbol) FROM g)
SELECT symbol, w AS ts, round(first(open ORDER BY ts) FILTER (close IS NOT NULL), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low,
  round(last(close ORDER BY ts) FILTER (close IS NOT NULL), 6) AS close, round(sum(volume), 6) AS volume, round(sum(quote_volume), 6) AS quote_volume,
  CAST(sum(trades) AS BIGINT) AS trades, round(sum(taker_buy_base), 6) AS taker_buy_base, round(sum(taker_buy_quote), 6) AS taker_buy_quote, round(avg(gap::INT), 6) AS gap_frac
FROM x GROUP BY symbol, w HAVING w <= (SELECT max(ts) FROM g y WHERE y.symbol = x.symbol)"""


@query(f"WITH {Q.HOURLY_GRID}{_FOUR}")
def bars_four_hours(spark, sf):
    return rounded(G.resample(hourly_grid(spark, sf), "4 hours", "1 HOUR"))


@query(
    f"WITH {Q.HOURLY_GRID}"
    + _FOUR.replace("floor((epoch(ts) - 3600) / 14400) * 14400 + 14400", "floor((epoch(ts) - 3600 - 28800) / 86400) * 86400 + 86400 + 28800")
)
def bars_daily_offset(spark, sf):
    return rounded(G.resample(hourly_grid(spark, sf), "1 day", "1 HOUR", "8 hours"))


@query(f"""WITH {Q.HOURLY_GRID}, r AS (SELECT *, abs(ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS move FROM e),
 i AS (SELECT symbol, gap, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, gap ORDER BY ts) AS k FROM g),
 l AS (SELECT symbol, max(n) AS longest_gap FROM (SELECT symbol, k, count(*) AS n FROM i WHERE gap GROUP BY 1, 2) GROUP BY 1)
SELECT g.symbol, count(*) AS n_rows, round(avg(g.gap::INT), 6) AS missing, (SELECT count(*) FROM e WHERE e.symbol = g.symbol AND volume <= 0) AS no_volume,
 (SELECT count(*) FROM e WHERE e.symbol = g.symbol AND (high < greatest(open, close) OR low > least(open, close))) AS bad_prices,
 round((SELECT max(move) FROM r WHERE r.symbol = g.symbol), 6) AS largest_move, coalesce((SELECT longest_gap FROM l WHERE l.symbol = g.symbol), 0) AS longest_gap
FROM g GROUP BY g.symbol""")
def bars_quality(spark, sf):
    return rounded(G.quality(hourly_grid(spark, sf)).select("symbol", "n_rows", "missing", "no_volume", "bad_prices", "largest_move", "longest_gap"))


@query(f"WITH {Q.HOURLY_GRID} SELECT symbol, ts, gap, trades, {_R} FROM g")
def grid_fill(spark, sf):
    return rounded(hourly_grid(spark, sf).select(*S.BAR_COLUMNS, "gap"))


@query(f"""WITH {Q.DAILY_GRID}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, gap ORDER BY ts) AS k FROM d)
SELECT symbol, min(ts) AS start, max(ts) AS "end", count(*) AS length FROM i WHERE gap GROUP BY symbol, k""")
def gap_runs(spark, sf):
    return G.gap_runs(daily_grid(spark, sf))


@query(f"""WITH {Q.DAILY_GRID} SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close3,
 last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS close FROM d""")
def ffill_limit3(spark, sf):
    return daily_grid(spark, sf).select("symbol", "ts", G.ffill("close", 3).alias("close3"), G.ffill("close").alias("close"))


_LC = f"WITH {Q.HOURLY_GRID}, f AS (SELECT *, ln(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts)) AS lc FROM g)"
_w = "OVER (PARTITION BY symbol ORDER BY ts)"


@query(f"{_LC} SELECT symbol, ts, round(lc - lag(lc, 1) {_w}, 6) AS r1, round(lc - lag(lc, 24) {_w}, 6) AS r24 FROM f")
def log_returns(spark, sf):
    g = hourly_grid(spark, sf).withColumn("lc", X.log_close())
    return rounded(g.select("symbol", "ts", X.log_return(1).alias("r1"), X.log_return(24).alias("r24")))


def _over(n: int, upto: int = 0) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 - upto} PRECEDING AND {-upto} {'PRECEDING' if upto else 'PRECEDING'})".replace("AND 0 PRECEDING", "AND CURRENT ROW")


def _tsum(x: str, n: int) -> str:
    return f"CASE WHEN count(*) {_over(n)} >= {n} THEN sum(coalesce({x}, 0)) {_over(n)} END"


@query(f"WITH {Q.HOURLY_GRID} SELECT symbol, ts, round({_tsum('volume', 24)}, 6) AS v24, round({_tsum('volume', 168)}, 5) AS v168 FROM g")
def window_sum(spark, sf):
    g = X.trailing_sum_long(hourly_grid(spark, sf).withColumn("v24", X.trailing_sum("volume", 24)), "volume", 168, "v168")
    return g.select("symbol", "ts", F.round("v24", 6).alias("v24"), F.round("v168", 5).alias("v168"))


@query(f"WITH {Q.HOURLY_GRID} SELECT symbol, ts, {_tsum('gap::INT', 24)} <= 0.05 * 24 AS ok FROM g")
def window_valid(spark, sf):
    return hourly_grid(spark, sf).select("symbol", "ts", X.valid(24).alias("ok"))


@query(f"WITH {Q.HOURLY_GRID} SELECT symbol, ts, round(CASE WHEN {_tsum('quote_volume', 12)} > 0 THEN {_tsum('2 * taker_buy_quote - quote_volume', 12)} / {_tsum('quote_volume', 12)} END, 6) AS imb FROM g")
def taker_imbalance(spark, sf):
    return rounded(hourly_grid(spark, sf).select("symbol", "ts", X.imbalance(12).alias("imb")))


_PAST = [f"lag(volume, {24 * d}) {_w}" for d in range(1, 8)]


@query(f"""WITH {Q.HOURLY_GRID}, p AS (SELECT symbol, ts, volume, {" + ".join(f"(({x}) IS NOT NULL)::INT" for x in _PAST)} AS n, {" + ".join(f"coalesce({x}, 0)" for x in _PAST)} AS s FROM g)
SELECT symbol, ts, round(CASE WHEN n >= 6 AND s > 0 THEN volume / (s / n) END, 6) AS ratio FROM p""")
def same_clock_ratio(spark, sf):
    return rounded(hourly_grid(spark, sf).select("symbol", "ts", X.same_clock_ratio("volume", 24).alias("ratio")))


@query(f"""WITH {Q.HOURLY_GRID}, k AS (SELECT *, row_number() {_w} - 1 AS k FROM g), r AS (SELECT symbol, k // 24 AS b, volume AS v FROM k WHERE k % 4 = 0)
SELECT k.symbol, k.ts, (SELECT CASE WHEN count(*) >= 15 THEN round(avg((r.v < k.volume)::INT), 6) END FROM r WHERE r.symbol = k.symbol AND r.b BETWEEN k.k // 24 - 5 AND k.k // 24 - 1) AS pct FROM k""")
def trailing_pctile(spark, sf):
    return rounded(X.trailing_percentile(hourly_grid(spark, sf), "volume", 24, 5, 4, "pct").select("symbol", "ts", "pct"))


@query(f"""WITH {Q.HOURLY_GRID}, q AS (SELECT symbol, date_trunc('day', ts) AS day, first(volume ORDER BY ts) AS v FROM g WHERE NOT gap GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM q)
SELECT g.symbol, g.ts, CASE WHEN NOT g.gap THEN (SELECT CASE WHEN count(*) >= 5 THEN round(avg((p.v < g.volume)::INT), 6) END FROM n p WHERE p.symbol = n.symbol AND p.i BETWEEN n.i - 20 AND n.i - 1) END AS pct
FROM g LEFT JOIN n ON n.symbol = g.symbol AND n.day = date_trunc('day', g.ts)""")
def vol_pctile_days(spark, sf):
    g = hourly_grid(spark, sf).withColumn("v", F.when(~F.col("gap"), F.col("volume")))
    return rounded(X.day_percentile(g, "v", 20, 5).select("symbol", "ts", "pct"))


def _roll(f: str, x: str, n: int, least: int, upto: int = 0) -> str:
    return f"CASE WHEN count({x}) {_over(n, upto)} >= {least} THEN {f}({x}) {_over(n, upto)} END"


@query(f"WITH {Q.DAILY_GRID} SELECT symbol, ts, round({_roll('max', 'close', 20, 12)}, 6) AS hi, round({_roll('min', 'close', 20, 12)}, 6) AS lo, round({_roll('avg', 'close', 20, 12)}, 6) AS mean, round({_roll('stddev_samp', 'close', 20, 12)}, 4) AS sd FROM d")
def rolling_stats_minperiods(spark, sf):
    d = daily_grid(spark, sf)
    return d.select("symbol", "ts", F.round(X.rolling("max", "close", 20, 12), 6).alias("hi"), F.round(X.rolling("min", "close", 20, 12), 6).alias("lo"), F.round(X.rolling("avg", "close", 20, 12), 6).alias("mean"), F.round(X.rolling("stddev_samp", "close", 20, 12), 4).alias("sd"))


@query(f"WITH {Q.DAILY} SELECT symbol, ts, round(CASE WHEN count(close) {_over(30)} >= 30 THEN quantile_cont(close, 0.8) {_over(30)} END, 4) AS q80 FROM o")
def rolling_quantile(spark, sf):
    return S.daily(spark, sf).select("symbol", "ts", F.round(X.rolling_quantile("close", 30, 0.8), 4).alias("q80"))


@query(f"WITH {Q.DAILY} SELECT symbol, ts, max(high) {_over(97)} AS hi FROM o QUALIFY row_number() {_w} >= 97")
def rolling_max_blocks(spark, sf):
    return X.rolling_max_long(S.daily(spark, sf), "high", 97, "hi").where("hi IS NOT NULL").select("symbol", "ts", "hi")


_PRIOR = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {Q.DAILY_GRID} SELECT symbol, ts, CASE WHEN count(high) {_PRIOR} >= 12 THEN max(high) {_PRIOR} END AS prior_high,
 coalesce(close > CASE WHEN count(high) {_PRIOR} >= 12 THEN max(high) {_PRIOR} END, false) AS breakout FROM d""")
def prior_extreme_breakout(spark, sf):
    prior = X.rolling("max", "high", 20, 12, upto=-1)
    return daily_grid(spark, sf).select("symbol", "ts", prior.alias("prior_high"), F.coalesce(F.col("close") > prior, F.lit(False)).alias("breakout"))


def _ewm_sql(x: str, alpha: float, table: str, adjust: bool = False) -> str:
    """Closed form over rows without missing values: a running sum of x / decay**k, scaled back."""
    d = 1 - alpha
    if adjust:
        return f"sum({x} * pow({d}, -k)) {_w} / sum(pow({d}, -k)) {_w}"
    return f"(first_value({x}) {_w} + sum(CASE WHEN k > 0 THEN {alpha} * {x} * pow({d}, -k) ELSE 0 END) {_w} - first_value({x}) {_w} * 0) * 1".replace(f"first_value({x}) {_w} + sum", f"first_value({x}) {_w} * pow({d}, k) + pow({d}, k) * sum").replace(f" - first_value({x}) {_w} * 0) * 1", ")")


_K = f"WITH {Q.HOURLY}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k FROM e)"


@query(f"{_K} SELECT symbol, ts, round(CASE WHEN k >= 11 THEN {_ewm_sql('close', 2 / 13, 'k')} END, 5) AS ema FROM k")
def ewm_span(spark, sf):
    return X.ewm(S.hourly(spark, sf).select("symbol", "ts", "close"), "close", "ema", span=12, least=12).select("symbol", "ts", F.round("ema", 5).alias("ema"))


@query(f"""{_K}, r AS (SELECT symbol, ts, k - 1 AS k, pow(ln(close) - lag(ln(close)) {_w}, 2) AS r2 FROM k), q AS (SELECT * FROM r WHERE r2 IS NOT NULL)
SELECT symbol, ts, round(sqrt({_ewm_sql('r2', 0.06696700846319259, 'q', True)}), 6) AS vol FROM q""")
def ewm_halflife_vol(spark, sf):
    e = S.hourly(spark, sf).select("symbol", "ts", F.pow(F.ln("close") - F.lag(F.ln("close")).over(w()), 2.0).alias("r2")).where("r2 IS NOT NULL")
    return X.ewm(e, "r2", "v", halflife=10, adjust=True).select("symbol", "ts", F.round(F.sqrt("v"), 6).alias("vol"))


@query(f"""{_K}, r AS (SELECT symbol, ts, k - 1 AS k, close - lag(close) {_w} AS x FROM k), q AS (SELECT symbol, ts, k, greatest(x, 0) AS up, greatest(-x, 0) AS down FROM r WHERE x IS NOT NULL),
 z AS (SELECT symbol, ts, k, {_ewm_sql('up', 1 / 14, 'q')} AS gain, {_ewm_sql('down', 1 / 14, 'q')} AS loss FROM q)
SELECT k.symbol, k.ts, round(CASE WHEN z.k >= 13 THEN CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) ELSE 100 END END, 5) AS rsi FROM k LEFT JOIN z ON z.symbol = k.symbol AND z.ts = k.ts""")
def rsi_wilder(spark, sf):
    return X.rsi(S.hourly(spark, sf).select("symbol", "ts", "close")).select("symbol", "ts", F.round("rsi", 5).alias("rsi"))


@query(f"""{_K}, z AS (SELECT symbol, ts, k, {_ewm_sql('close', 2 / 13, 'k')} - {_ewm_sql('close', 2 / 27, 'k')} AS m FROM k),
 y AS (SELECT symbol, ts, k - 25 AS k, m FROM z WHERE k >= 25), s AS (SELECT *, {_ewm_sql('m', 0.2, 'y')} AS s FROM y)
SELECT k.symbol, k.ts, round(s.m, 4) AS macd, round(CASE WHEN s.k >= 8 THEN s.m - s.s END, 4) AS macd_hist FROM k LEFT JOIN s ON s.symbol = k.symbol AND s.ts = k.ts""")
def macd(spark, sf):
    return X.macd(S.hourly(spark, sf).select("symbol", "ts", "close")).select("symbol", "ts", F.round("macd", 4).alias("macd"), F.round("macd_hist", 4).alias("macd_hist"))


@query(f"WITH {Q.HOURLY} SELECT symbol, ts, round({_roll('avg', 'close', 20, 20)}, 5) AS bb_mid, round({_roll('avg', 'close', 20, 20)} + 2 * {_roll('stddev_pop', 'close', 20, 20)}, 5) AS bb_upper FROM e")
def bollinger(spark, sf):
    b = X.bollinger()
    return S.hourly(spark, sf).select("symbol", "ts", F.round(b["bb_mid"], 5).alias("bb_mid"), F.round(b["bb_upper"], 5).alias("bb_upper"))


_TR = f"greatest(high - low, abs(high - lag(close) {_w}), abs(low - lag(close) {_w}))"


@query(f"WITH {Q.DAILY}, t AS (SELECT symbol, ts, {_TR} AS tr FROM o) SELECT symbol, ts, round({_roll('avg', 'tr', 14, 14)}, 4) AS atr FROM t")
def average_true_range(spark, sf):
    t = S.daily(spark, sf).withColumn("tr", X.true_range())
    return t.select("symbol", "ts", F.round(X.rolling("avg", "tr", 14, 14), 4).alias("atr"))


_T7 = f"t AS (SELECT s.symbol, unnest(generate_series(s.a, s.b, INTERVAL 7 HOUR)) AS ts FROM (SELECT symbol, min(ts) - INTERVAL 5 HOUR AS a, max(ts) AS b FROM e GROUP BY symbol) s)"


def _times(bars: DataFrame) -> DataFrame:
    span = bars.groupBy("symbol").agg((F.min("ts") - F.expr("INTERVAL 5 HOURS")).alias("a"), F.max("ts").alias("b"))
    return span.select("symbol", F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 HOURS"))).alias("ts"))


@query(f"WITH {Q.HOURLY}, {_T7} SELECT t.symbol, t.ts, e.ts AS asof_ts, e.close FROM t ASOF LEFT JOIN e ON e.symbol = t.symbol AND e.ts <= t.ts")
def asof_features(spark, sf):
    bars = S.hourly(spark, sf)
    return G.asof(_times(bars), bars, ["close"])


@query(f"WITH {Q.HOURLY}, {_T7} SELECT t.symbol, t.ts, CASE WHEN t.ts - e.ts <= INTERVAL 1 HOUR THEN e.close END AS close FROM t ASOF LEFT JOIN e ON e.symbol = t.symbol AND e.ts <= t.ts")
def asof_stale(spark, sf):
    bars = S.hourly(spark, sf)
    return G.asof(_times(bars), bars, ["close"], max_age="1 HOUR").drop("asof_ts")


@query(f"WITH {Q.HOURLY} SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM e GROUP BY symbol")
def last_per_symbol(spark, sf):
    return S.hourly(spark, sf).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


@query(f"WITH {Q.HOURLY} SELECT symbol, round(corr(close, p), 6) AS autocorr FROM (SELECT symbol, close, lag(close) {_w} AS p FROM e) GROUP BY symbol")
def autocorrelation(spark, sf):
    e = S.hourly(spark, sf).withColumn("p", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    return rounded(e.groupBy("symbol").agg(F.corr("close", "p").alias("autocorr")))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props_extract(spark, sf):
    return S.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT date_trunc('day', ts) AS timestamp, last(value ORDER BY event_id) AS close, count(*) AS n FROM events GROUP BY 1""")
def scan_csv_schema(spark, sf):
    """Event rows through the CSV typing path: text in, typed candles out, the last line of a timestamp wins."""
    e = S.table(spark, sf, "events").select(F.col("event_id").alias("line"), F.date_trunc("day", "ts").cast("timestamp_ntz").cast("string").alias("timestamp"), *[F.col("value").cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")])
    n = e.groupBy(F.col("timestamp").cast("timestamp_ntz").alias("timestamp")).agg(F.count("*").alias("n"))
    return S.typed_candles(e).select("timestamp", "close").join(n, "timestamp")
