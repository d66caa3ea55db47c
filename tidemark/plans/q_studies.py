"""Composite studies: market-wide events, book summaries, go-live checks, close-outs, ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import accounts as A
from tidemark.operators import engine as G
from tidemark.operators import events as E
from tidemark.operators import features as V
from tidemark.operators import models as ML
from tidemark.operators import stats as M
from tidemark.plans import sql as Q
from tidemark.plans.q_bars import _w, hourly_grid
from tidemark.plans.q_stats import _EV
from tidemark.plans.registry import query, rounded
from tidemark.sources import tables as S


@query(f"""{_EV}, mk AS (SELECT a.symbol, a.ts, avg(b.r4) AS mkt, avg((b.r4 > 0)::INT) AS br FROM s a JOIN s b ON b.ts = a.ts AND b.symbol <> a.symbol GROUP BY 1, 2),
 z AS (SELECT s.*, mkt, br, r4 / (sigma * 2 + 1e-12) AS z, abs(r4 - mkt) / (sigma * 2 + 1e-12) AS d, CASE WHEN r4 > 0 THEN br ELSE 1 - br END AS same FROM s LEFT JOIN mk ON mk.symbol = s.symbol AND mk.ts = s.ts)
SELECT symbol, ts, CASE WHEN abs(z) >= 0.5 AND clean AND same < 0.5 AND d >= 3 THEN -sign(r4) ELSE 0 END + 0.0 AS own, CASE WHEN abs(z) >= 0.5 AND clean AND same >= 0.8 THEN sign(r4) ELSE 0 END + 0.0 AS market FROM z""")
def event_own_or_market(spark, sf):
    """Large moves alone are faded, those of the whole market followed."""
    g = E.with_sigma(hourly_grid(spark, sf), 48)
    side = V.cross_asset(g, 4, "click").select("symbol", "ts", F.col("xa__mkt_4").alias("mkt"), F.col("xa__breadth_4").alias("br"))
    s = E.own_or_market(4, 0.5, "mkt", "br")
    return g.join(side, ["symbol", "ts"], "left").select("symbol", "ts", (s["own"] + 0.0).alias("own"), (s["market"] + 0.0).alias("market"))


_LEVELS = """WITH l AS (SELECT l_orderkey AS book, CASE WHEN l_linenumber % 2 = 0 THEN 'ask' ELSE 'bid' END AS side, CASE WHEN l_linenumber % 2 = 0 THEN 100 + l_discount * 100 + l_linenumber * 0.01 ELSE 99 - l_discount * 100 - l_linenumber * 0.01 END AS px, l_quantity AS qty FROM lineitem)"""


def levels(spark, sf):
    n = F.col("l_linenumber")
    ask = n % 2 == 0
    return S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.when(ask, "ask").otherwise("bid").alias("side"), F.when(ask, 100 + F.col("l_discount") * 100 + n * 0.01).otherwise(99 - F.col("l_discount") * 100 - n * 0.01).alias("px"), F.col("l_quantity").alias("qty"))


@query(f"""{_LEVELS}, r AS (SELECT *, sum(px * qty) OVER (PARTITION BY book, side ORDER BY CASE WHEN side = 'ask' THEN px ELSE -px END) - px * qty AS b FROM l), t AS (SELECT *, greatest(0, least(px * qty, 2000 - b)) AS t FROM r),
 v AS (SELECT book, side, CASE WHEN sum(t) >= 2000 - 1e-9 THEN sum(t) / sum(t / px) END AS vwap FROM t GROUP BY 1, 2), p AS (SELECT book, min(px) FILTER (side = 'ask') AS a, max(px) FILTER (side = 'bid') AS d FROM l GROUP BY book)
SELECT p.book, round((a - d) / ((a + d) / 2) * 1e4, 5) AS spread_bps, round(((SELECT vwap FROM v WHERE v.book = p.book AND side = 'ask') / ((a + d) / 2) - 1) * 1e4, 5) AS buy_impact_bps, round((1 - (SELECT vwap FROM v WHERE v.book = p.book AND side = 'bid') / ((a + d) / 2)) * 1e4, 5) AS sell_impact_bps FROM p""")
def book_summary(spark, sf):
    b = G.book_summary(levels(spark, sf), 2000.0)
    return b.select("book", *[F.round(c, 5).alias(c) for c in ("spread_bps", "buy_impact_bps", "sell_impact_bps")])


@query("""WITH v AS (SELECT c_custkey AS account, c_custkey % 200 AS days, c_custkey % 60 AS trades, c_acctbal AS profit, 2000.0 AS hold, c_custkey % 3 = 0 AS ok FROM customer)
SELECT account, concat_ws(',', CASE WHEN NOT days >= 90 THEN 'days' END, CASE WHEN NOT trades >= 30 THEN 'trades' END, CASE WHEN NOT profit > 0 THEN 'profitable' END, CASE WHEN NOT profit > hold THEN 'beats_hold' END, CASE WHEN NOT ok THEN 'validated' END) AS failed, days >= 90 AND trades >= 30 AND profit > 0 AND profit > hold AND ok AS ready FROM v""")
def account_go_live(spark, sf):
    k = F.col("c_custkey")
    v = S.table(spark, sf, "customer").select(k.alias("account"), (k % 200).alias("days"), (k % 60).alias("trades"), F.col("c_acctbal").alias("profit"), F.lit(2000.0).alias("hold_profit"), (k % 3 == 0).alias("validated"))
    return A.go_live(v).select("account", F.concat_ws(",", "failed").alias("failed"), "ready")


@query(f"""WITH {Q.HOURLY}, p AS (SELECT symbol, arg_max(close, ts) AS now FROM e GROUP BY symbol) SELECT e.symbol, e.ts, round(1000.0 / e.close * p.now * 0.9987 / (1000.0 / e.close * e.close * 1.0013) - 1, 6) AS net FROM e JOIN p ON p.symbol = e.symbol WHERE e.ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-10 00:00:00'""")
def account_close_due(spark, sf):
    e = S.hourly(spark, sf)
    positions = e.select(F.lit(1).alias("account"), F.col("ts").cast("string").alias("key"), F.lit("c").alias("config"), "symbol", "ts", F.col("close").alias("price"), (1000.0 / F.col("close")).alias("qty"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("exit_time"))
    prices = e.groupBy("symbol").agg(F.max_by("close", "ts").alias("price_now"))
    closed = A.close_due(positions, prices, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 0.0013)
    return rounded(closed.select("symbol", F.col("key").cast("timestamp_ntz").alias("ts"), "net"))


@query(f"""WITH {Q.HOURLY}, r AS (SELECT symbol, ts, CASE WHEN c > 0.5 THEN 'UP' ELSE 'DOWN' END AS d, round(abs(c) / 5, 4) AS k, CASE WHEN symbol IN ('click', 'view') THEN 'POSSIBLE EDGE' ELSE 'UNPROVEN' END AS v FROM (SELECT symbol, ts, ln(close) - ln(lag(close) {_w}) AS c FROM e) WHERE c IS NOT NULL)
SELECT symbol, ts, CASE WHEN v <> 'POSSIBLE EDGE' THEN 'NOT VALIDATED' WHEN k >= 0.2 AND d = 'UP' THEN 'BUY' WHEN k >= 0.2 THEN 'AVOID' ELSE 'WAIT' END AS status FROM r""")
def scan_status(spark, sf):
    c = F.ln("close") - F.ln(F.lag("close").over(E.w()))
    r = S.hourly(spark, sf).select("symbol", "ts", c.alias("c")).where("c IS NOT NULL")
    r = r.select("symbol", "ts", F.when(F.col("c") > 0.5, "UP").otherwise("DOWN").alias("direction"), F.round(F.abs("c") / 5, 4).alias("confidence"), F.lit(0.2).alias("threshold"), F.when(F.col("symbol").isin("click", "view"), "POSSIBLE EDGE").otherwise("UNPROVEN").alias("verdict"))
    return A.scan_status(r).select("symbol", "ts", "status")


@query()
def study_ablation(spark, sf):
    """Loss of AUC in walk-forward prediction when a group of features is left out."""
    df = ML.quality_features(spark, sf)
    groups = {"all": [], "length": ["len_log", "words_log"], "shape": ["upper", "digits", "lines"]}
    rows = []
    for name, out in groups.items():
        x = df.withColumns({c: F.lit(0.0) for c in out}) if out else df
        rows.append((name, M.auc(ML.walk_forward(x, 3)).first()[0]))
    return spark.createDataFrame(rows, "left_out string, auc double")
