"""Hand-computed cases, sequential reimplementations and no-look-ahead tests."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as Z
from tidemark.operators import backtest as B
from tidemark.operators import features as V
from tidemark.operators import grid as G
from tidemark.operators import labels as L
from tidemark.operators import models as D
from tidemark.operators import patterns as P
from tidemark.operators import state as T
from tidemark.operators import stats as M
from tidemark.sources import synthetic as Y
from tidemark.operators import windows as X
from tidemark.sources import tables as S

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double"


def bars(spark, closes, highs=None, lows=None, opens=None, symbol="A"):
    rows = []
    for i, c in enumerate(closes):
        hi, lo, op = (highs or closes)[i], (lows or closes)[i], (opens or closes)[i]
        rows.append((symbol, T0 + dt.timedelta(hours=i), op, hi, lo, c, 1.0, c, 1, 0.5, None if c is None else c / 2))
    return spark.createDataFrame(rows, BAR)


def replayed(bars_, reward, risk, cost, most, long):
    """The plan walked bar by bar."""
    out, side = [], 1 if long else -1
    for i in range(len(bars_) - most):
        entry = bars_[i][3]
        target, stop = entry * (1 + side * reward), entry * (1 - side * risk)
        for k, (o, h, lo, c) in enumerate(bars_[i + 1 : i + most + 1], 1):
            if (lo <= stop) if long else (h >= stop):
                kind, price = "stop", (min if long else max)(o, stop)
            elif (h >= target) if long else (lo <= target):
                kind, price = "target", target
            elif k == most:
                kind, price = "timeout", c
            else:
                continue
            out.append((kind, k, side * (price / entry - 1) - 2 * cost, side * (c / entry - 1) - 2 * cost))
            break
    return out


@pytest.mark.parametrize("long", [True, False])
def test_replay(spark, long):
    rng = random.Random(21)
    series, last = [], 50.0
    for _ in range(120):
        opened = last * (1 + rng.choice([0, 0, 0.001, -0.03, 0.03]))
        last = opened * (1 + rng.gauss(0, 0.01))
        series.append((opened, max(opened, last) * 1.004, min(opened, last) * 0.996, last))
    o, h, lo, c = map(list, zip(*series, strict=True))
    got = [tuple(r) for r in L.replay(bars(spark, c, h, lo, o), 0.025, 0.02, 0.0005, 3, long).orderBy("ts").select("outcome", "bars_held", "net", "hold_net").collect()]
    want = replayed(series, 0.025, 0.02, 0.0005, 3, long)
    assert [g[:2] for g in got] == [x[:2] for x in want] and {g[0] for g in got} == {"stop", "target", "timeout"}
    assert np.allclose([g[2:] for g in got], [x[2:] for x in want])


def test_side_of():
    assert L.side_of(10, 9, 12) == "long" and L.side_of(10, 12, 9) == "short"
    for bad in ((10, 11, 12), (10, 10, 12), (10, 9, -1), (10, 9, float("nan"))):
        with pytest.raises(ValueError):
            L.side_of(*bad)


def test_full_windows_only(spark):
    assert L.replay(bars(spark, [100.0] * 10), 0.02, 0.01, 0.001, 4).count() == 6


def test_break_even_and_size():
    assert L.break_even(0.02, 0.01, 0) == pytest.approx(1 / 3) and L.break_even(0.02, 0.01, 0.001) == pytest.approx(0.4) and L.break_even(0.001, 0.01, 0.01) == 1.0
    assert L.position_size(1000, 0.01, 100, 98, 0.0) == pytest.approx(5)


def test_target(spark):
    got = [r[0] for r in bars(spark, [10.0, 11.0, 10.5, 10.5, 12.0]).withColumn("t", L.direction_target(1)).orderBy("ts").select("t").collect()]
    assert got == [1, 0, 0, 1, None]


def test_holm_and_bh(spark):
    got = {round(r["p"], 2): (r["holm"], r["bh"]) for r in M.holm_bh(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")).collect()}
    assert got[0.01][0] == pytest.approx(0.03) and got[0.03][0] == pytest.approx(0.06) and got[0.04][0] == pytest.approx(0.06) and got[0.04][1] == pytest.approx(0.04)


def test_rsi_extremes(spark):
    up, down = ([100.0 + s * i for i in range(40)] for s in (1, -1))
    for closes, want in ((up, 100.0), (down, 0.0)):
        last = X.rsi(bars(spark, closes).select("symbol", "ts", "close")).orderBy(F.desc("ts")).first()
        assert last["rsi"] == pytest.approx(want)


def test_probability_rule(spark):
    df = spark.createDataFrame([(x,) for x in (0.4, 0.5, 0.52, 0.6)], "p double")
    got = [r[0] for r in df.select(B.from_probability(F.col("p"), 0.05, True)).collect()]
    assert got == [-1, 0, 0, 1]
    assert [r[0] for r in df.select(B.from_probability(F.col("p"), 0.0, True)).collect()] == [-1, 0, 1, 1]


def test_edge_rule(spark):
    df = spark.createDataFrame([(0.55, 0.002), (0.55, 0.05), (0.45, 0.05)], "p double, s double")
    assert [r[0] for r in df.select(B.from_edge(F.col("p"), F.col("s"), F.lit(0.002), 0.0, True)).collect()] == [0, 1, -1]


@pytest.mark.parametrize("kind", ["spot_taker", "perp_taker"])
def test_costs_are_the_sequential_rule(spark, kind):
    rng = random.Random(31)
    hours, at = [], 0
    for _ in range(60):
        at += rng.choice([1, 1, 1, 3])
        hours.append((at, rng.choice([-1, 0, 1, 1])))
    cost, one_side, an_hour = B.CostModel(kind), {"spot_taker": 13e-4, "perp_taker": 8e-4}[kind], {"spot_taker": 0.0, "perp_taker": 1e-4 / 8}[kind]
    want, before, last = 0.0, 0, None
    for k, (h, pos) in enumerate(hours):
        pos = pos if cost.allow_short else max(pos, 0)
        before = before if last == h - 1 else 0
        closes = k + 1 == len(hours) or hours[k + 1][0] != h + 1
        want += (abs(pos - before) + closes * abs(pos)) * one_side + max(pos, 0) * an_hour
        before, last = pos, h
    rows = [("A", T0 + dt.timedelta(hours=h), p, 0.0) for h, p in hours]
    sim = B.simulate(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, pos int, fwd_ret double"), cost, 60)
    assert sim.agg(F.sum("cost")).first()[0] == pytest.approx(want)


def test_hysteresis_is_the_sequential_rule(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(20):
        closes = [None if rng.random() < 0.05 else round(100 + rng.gauss(0, 2) + (rng.random() < 0.3) * 2, 1) for _ in range(60)]
        rows += [(f"s{s}", T0 + dt.timedelta(days=i), c) for i, c in enumerate(closes)]
        state = 0
        for i, c in enumerate(closes):
            hi, lo = closes[max(0, i - 4) : i], closes[max(0, i - 2) : i]
            if c is None or len(hi) < 4 or None in hi or len(lo) < 2 or None in lo:
                state, want[f"s{s}", i] = 0, None
                continue
            state = (0 if c <= min(lo) else 1) if state else (1 if c >= max(hi) else 0)
            want[f"s{s}", i] = float(state)
    df = T.donchian(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double"), 4, "state")
    assert {(r["symbol"], (r["ts"] - T0).days): r["state"] for r in df.collect()} == want


def test_cooldown_is_greedy(spark):
    rng = random.Random(5)
    rows = [(s, k, float(k)) for s in "ab" for k in sorted(rng.sample(range(200), 60))]
    got = sorted((r["symbol"], r["k"]) for r in T.cooldown(spark.createDataFrame(rows, "symbol string, k long, x double"), 7).collect())
    want = []
    for s in "ab":
        last = -(10**9)
        for _, k, _ in sorted(r for r in rows if r[0] == s):
            if k - last >= 7:
                want.append((s, k))
                last = k
    assert got == want


def test_cusum_closed_form(spark):
    rng = random.Random(7)
    xs = [rng.gauss(0, 1) for _ in range(100)]
    df = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), x) for i, x in enumerate(xs)], "symbol string, ts timestamp_ntz, x double")
    got, s = [r["cusum"] for r in T.cusum(df, F.col("x") - 0.2).orderBy("ts").collect()], 0.0
    for x, g in zip(xs, got, strict=True):
        s = max(0.0, s + x - 0.2)
        assert g == pytest.approx(s, abs=1e-9)


def test_hac_t_values(spark):
    rng = np.random.default_rng(1)
    x, e = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 0.5 * x + e
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "ts long, x double, y double")
    beta, t, n = M.hac_ols(df, "y", ["x"], 3)
    design = np.column_stack([np.ones(200), x])
    b = np.linalg.solve(design.T @ design, design.T @ y)
    s = design * (y - design @ b)[:, None]
    v = s.T @ s
    for k in range(1, 4):
        g = s[k:].T @ s[:-k]
        v += (1 - k / 4) * (g + g.T)
    inv = np.linalg.inv(design.T @ design)
    assert n == 200 and np.allclose(beta, b) and np.allclose(t, b / np.sqrt(np.diag(inv @ v @ inv)))


def test_scalars():
    assert M.binomial_tail(8, 10) == pytest.approx(56 / 1024)
    assert M.probabilistic_sharpe(0.0, 100, 0, 3) == pytest.approx(0.5)
    assert M.expected_max_sharpe(1, 1.0) == 0.0 and M.expected_max_sharpe(10, 1.0) > 1.4
    assert T.siegmund_arl(T.cusum_limit(0.5), 0.5) == pytest.approx(3000, rel=1e-6)


def test_price_text(spark):
    got = [r[0] for r in spark.createDataFrame([(61234.5,), (4.07e-06,)], "p double").select(Z.price_text(F.col("p"))).collect()]
    assert got == ["61,234.50", "0.0000040700"]


def test_features_use_the_past_only(spark):
    rng = random.Random(11)
    closes = [100.0]
    for _ in range(120):
        closes.append(closes[-1] * math.exp(rng.gauss(0, 0.01)))
    other = [c if i <= 80 else c * 1.5 for i, c in enumerate(closes)]

    def build(cs):
        df = V.prepared(G.complete(bars(spark, cs), "1 HOUR"))
        cols = V.momentum((4, 24), 24) | V.volatility((6, 24), 24) | V.order_flow((6, 24), 24) | V.regime((4, 24))
        return df.select("ts", *[c.alias(n) for n, c in cols.items()]).orderBy("ts").toPandas()

    a, b = build(closes), build(other)
    assert a.iloc[:81].equals(b.iloc[:81]) and not a.iloc[81:].equals(b.iloc[81:])


def test_logarithm_of_zero(spark):
    """A low of zero is an infinite range and a close of zero an infinite fall, as in the SQL; neither counts as missing."""
    got = [r[0] for r in spark.createDataFrame([(0.0,), (-1.0,), (None,), (math.e,)], "p double").select(X.ln("p")).collect()]
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2:] == [None, 1.0]
    closes = [100.0 + i % 3 for i in range(40)]
    df = V.prepared(G.complete(bars(spark, closes, lows=[0.0 if i == 30 else c for i, c in enumerate(closes)]), "1 HOUR"))
    rows = df.select("ts", *[c.alias(n) for n, c in V.volatility((6, 24), 24).items()]).orderBy("ts").collect()
    assert [r["vol__parkinson_24"] == math.inf for r in rows[23:]] == [False] * 7 + [True] * 10
    assert [r["vol__rv_vs_range_24"] == -math.inf for r in rows[23:]] == [False] * 7 + [True] * 10
    fall = V.prepared(G.complete(bars(spark, [0.0 if i == 20 else c for i, c in enumerate(closes)]), "1 HOUR"))
    rows = fall.select("ts", *[c.alias(n) for n, c in V.volatility((6, 24), 24).items()]).orderBy("ts").collect()
    assert rows[20]["vol__rv_6"] == math.inf and rows[26]["vol__rv_6"] == math.inf and rows[27]["vol__rv_6"] < 0 and rows[27]["vol__ratio_6_24"] == -math.inf


def test_cross_asset_with_an_infinite_fall(spark):
    parts = [G.complete(bars(spark, [c, c, last], symbol=n), "1 HOUR") for n, c, last in (("A", 1.0, 0.0), ("B", 2.0, 4.0), ("C", 3.0, 3.0))]
    g = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("lc", X.log_close())
    got = {r["symbol"]: r for r in V.cross_asset(g, 1, "B").where(F.col("ts") == F.lit(T0 + dt.timedelta(hours=2))).collect()}
    assert got["A"]["xa__mkt_1"] == pytest.approx(math.log(2) / 2) and got["A"]["xa__dispersion_1"] == pytest.approx(math.log(2) / math.sqrt(2))
    assert got["A"]["xa__rel_1"] == -math.inf and got["B"]["xa__mkt_1"] == -math.inf and got["B"]["xa__rel_1"] == math.inf


def test_gap_masks_features(spark):
    df = bars(spark, [100.0 + i for i in range(60)]).where(~F.hour("ts").between(5, 9) | (F.col("ts") > F.lit(T0 + dt.timedelta(hours=24))))
    g = V.prepared(G.complete(df, "1 HOUR"))
    row = {r["ts"]: r["x"] for r in g.select("ts", V.momentum((4,), 24)["mom__ret_4"].alias("x")).collect()}
    assert row[T0 + dt.timedelta(hours=10)] is None and row[T0 + dt.timedelta(hours=20)] is not None


def test_csv_candles(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("Timestamp,OPEN,High,Low,Close,Volume\n1704070800000,2,2,2,2,1\n2024-01-01 00:00:00,1,1,1,1,1\n1704070800000,3,3,3,3,1\n")
    rows = S.candles_csv(spark, str(path)).collect()
    assert [r["close"] for r in rows] == [1.0, 3.0] and rows[1]["timestamp"] == dt.datetime(2024, 1, 1, 1)


def test_kline_arrays(spark):
    df = spark.createDataFrame([('[1704067200000,"1.5","2","1","1.7","10",1704067259999,"17","3","4","6.8"]',)], "raw string")
    r = S.kline_arrays(df).first()
    assert (r["open_time"], r["close"], r["trades"]) == (1704067200000, 1.7, 3)


def test_entry_imports_without_a_session():
    import importlib

    assert "bars_resample" in importlib.import_module("__spark_entry__").queries()


def test_cumulated_and_halo_are_the_global_ones(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = random.Random(5)
    xs = [(i, T0 + dt.timedelta(hours=i), rng.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(xs, "k long, ts timestamp_ntz, v double").repartition(5)
    got = sorted(map(tuple, M.cumulated(df.withColumns({"a": F.col("v"), "b": F.col("v")}), "ts", sums=["v"], tops=["a"], lows=["b"]).select("k", "run_v", "run_a", "run_b").collect()))
    v = np.array([x[2] for x in xs])
    assert np.allclose(got, np.stack([np.arange(200), v.cumsum(), np.maximum.accumulate(v), np.minimum.accumulate(v[::-1])[::-1]], axis=1))
    d = v - v.mean()
    want = (d @ d + sum(2 * (1 - k / 6) * (d[k:] @ d[:-k]) for k in range(1, 6))) / 200
    assert M.newey_west(df, "v", 5).first()["variance"] == pytest.approx(want)


def test_holm_and_bh_of_many_with_ties(spark):
    rng = random.Random(6)
    ps = [round(rng.random() ** 3, 2) for _ in range(300)]
    got = {r["p"]: (r["holm"], r["bh"]) for r in M.holm_bh(spark.createDataFrame([(p,) for p in ps], "p double")).collect()}
    order, m, top = sorted(ps), len(ps), 0.0
    for r, p in enumerate(order):
        top = max(top, min(1.0, (m - r) * p))
        assert got[p][0] >= top - 1e-9
        assert got[p][1] == pytest.approx(min(1.0, *[q * m / (k + 1) for k, q in enumerate(order) if k >= r]))
    assert got[order[0]][0] == pytest.approx(min(1.0, m * order[0]))


def test_calibration_by_folds(spark):
    rng = random.Random(9)
    rows = [(k // 300, k, float(rng.random() < 1 / (1 + math.exp(-z))), 1 / (1 + math.exp(-3 * z))) for k, z in ((k, rng.gauss(0, 1)) for k in range(900))]
    pred = spark.createDataFrame(rows, "fold int, ts long, y double, p double")
    for method in ("platt", "isotonic", "none"):
        got = D.calibrated(pred, method).toPandas()
        assert len(got) == 900 and np.allclose(got[got.fold == 0].p, got[got.fold == 0].p_raw.clip(1e-6, 1 - 1e-6))
        late = got[got.fold == 2]
        loss = lambda p, late=late: -(late.y * np.log(p) + (1 - late.y) * np.log(1 - p)).mean()
        assert (loss(late.p) < loss(late.p_raw.clip(1e-6, 1 - 1e-6))) == (method != "none")
    done = D.decided(D.calibrated(pred)).toPandas()
    assert not done[done.fold == 0].pos.any() and done[done.fold == 2].skilled.all() and done[done.fold == 2].pos.any()


def test_turns_and_patterns():
    closes = np.array([10, 11, 13, 12, 9, 8, 9, 12, 16, 12, 9, 8.05, 9, 12, 13.05, 12, 10, 9, 8, 7], dtype=float)
    turns = P._extrema(closes, closes)
    assert [(k, i) for k, i, _ in turns] == [(1, 2), (-1, 5), (1, 8), (-1, 11), (1, 14)] and P._pattern(turns) == -1
    assert P._pattern(P._extrema(20 - closes, 20 - closes)) in (0, 1)
    assert P._extrema(closes[:16], closes[:16])[-1][1] == 11  # the last bars do not confirm a turn


def test_synthetic_series(spark):
    long, short = (Y.candles(spark, n, ("A", "B")).toPandas() for n in (300, 100))
    for name, own in long.groupby("symbol"):
        tail = short[short.symbol == name]
        assert np.allclose(own.tail(100).close.to_numpy(), tail.close.to_numpy()) and len(tail) == 100
        assert (own.high >= own[["open", "close"]].max(axis=1)).all() and (own.low <= own[["open", "close"]].min(axis=1)).all()
    assert Y.candles(spark, 10_050).count() == 10_050
