"""Feature families over a complete grid. Windows are in rows; every value at t uses rows up to t only.

Columns are named family__name, so that families are taken or left out by prefix. Each family is a chain of column expressions over one
window specification: one shuffle and one sort by (symbol, ts) serve all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as X
from tidemark.operators.grid import asof, w

EPS = X.EPS
PI2 = 2 * math.pi


def prepared(grid: DataFrame) -> DataFrame:
    """The grid with log close (filled), one-row return r, its square, its size, and signed quote volume."""
    df = grid.withColumn("lc", X.log_close()).withColumn("lc_seen", X.ln("close"))
    df = df.withColumn("r", F.coalesce(F.col("lc") - F.lag("lc").over(w()), F.lit(0.0)))
    range2 = F.pow(X.ln("high") - X.ln("low"), 2.0) / (4 * math.log(2))
    return df.withColumns({"r2": F.col("r") * F.col("r"), "absr": F.abs("r"), "pk": F.coalesce(range2, F.lit(0.0)), "sqv": 2 * F.col("taker_buy_quote") - F.col("quote_volume")})


def masked(value: Column, n: int) -> Column:
    return F.when(X.valid(n), value)


def momentum(windows: Iterable[int], day: int) -> dict[str, Column]:
    sigma = F.sqrt(X.trailing_sum("r2", day) / day)
    out = {}
    for n in windows:
        ret = masked(X.log_return(n), n)
        out[f"mom__ret_{n}"] = ret
        out[f"mom__z_{n}"] = ret / (sigma * math.sqrt(n) + EPS)
    return out


def volatility(windows: Iterable[int], day: int) -> dict[str, Column]:
    rv = {n: F.sqrt(X.trailing_sum("r2", n) / n) for n in windows}
    out = {f"vol__rv_{n}": masked(X.ln(v + EPS), n) for n, v in rv.items()}
    pk = F.sqrt(X.trailing_sum("pk", day) / day)
    out[f"vol__parkinson_{day}"] = X.ln(pk + EPS)
    steps = sorted(rv)
    for a, b in zip(steps, steps[1:], strict=False):
        out[f"vol__ratio_{a}_{b}"] = X.ln((rv[a] + EPS) / (rv[b] + EPS))
    out[f"vol__rv_vs_range_{day}"] = X.ln((rv[day] + EPS) / (pk + EPS))
    return out


def activity(short: int, day: int, month: int) -> dict[str, Column]:
    """Quote volume and trades of the last rows against the last month and the same hours of the last week; needs a column q_short."""
    q, n = ({k: X.trailing_sum(c, k) for k in (short, day, month)} for c in ("quote_volume", "trades"))
    size = lambda k: q[k] / F.greatest(n[k], F.lit(1.0))
    # q_short: the short sum as a column, since a lag of a window needs it materialised
    week = sum((F.coalesce(F.lag("q_short", day * d).over(w()), F.lit(0.0)) for d in range(1, 8)), F.lit(0.0))
    scale = month // short
    return {
        f"act__qvol_{short}_vs_month": F.ln((q[short] * scale + 1) / (q[month] + 1)),
        "act__qvol_day_vs_month": F.ln((q[day] * (month // day) + 1) / (q[month] + 1)),
        f"act__trades_{short}_vs_month": F.ln((n[short] * scale + 1) / (n[month] + 1)),
        f"act__tradesize_{short}_vs_month": F.ln((size(short) + 1) / (size(month) + 1)),
        f"act__qvol_{short}_vs_samehour": F.ln((q[short] * 7 + 1) / (week + 1)),
    }


def order_flow(windows: Iterable[int], day: int) -> dict[str, Column]:
    sigma = F.sqrt(X.trailing_sum("r2", day) / day)
    out, imb = {}, {}
    for n in windows:
        q = X.trailing_sum("quote_volume", n)
        ok = X.valid(n) & (q > 0)
        raw = X.trailing_sum("sqv", n) / (q + EPS)
        imb[n] = F.when(ok, raw)
        out[f"flow__imb_{n}"] = imb[n]
        out[f"flow__absorb_{n}"] = F.when(ok, raw * 3 - F.tanh(X.log_return(n) / (sigma * math.sqrt(n) + EPS)))
    mean = lambda c: X.trailing_sum(c, day) / day
    cov = mean(F.col("sqv") * F.col("r")) - mean("sqv") * mean("r")
    var = mean(F.col("sqv") * F.col("sqv")) - mean("sqv") * mean("sqv")
    slope = cov / (var + EPS)
    out[f"flow__impact_{day}"] = masked(F.signum(slope) * F.log1p(F.abs(slope * mean("quote_volume")) * 1e4), day)
    first, last = min(imb), max(imb)
    out["flow__imb_trend"] = imb[first] - imb[last]
    return out


def bar_shape(bars: DataFrame, tag: str, n: int = 20) -> DataFrame:
    """Close location, wicks, sweeps and breakouts of finished bars; without a prior extreme the last two are 0, not NULL."""
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    hi, lo = X.rolling("max", "high", n, n - 2, upto=-1), X.rolling("min", "low", n, n - 2, upto=-1)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    bars = bars.withColumns({"_hi": hi, "_lo": lo})
    return bars.select(
        "symbol", "ts", ((F.col("close") - F.col("low")) / span).alias(f"shape__clv_{tag}"), ((F.col("high") - F.greatest("open", "close")) / span).alias(f"shape__upwick_{tag}"),
        ((F.least("open", "close") - F.col("low")) / span).alias(f"shape__lowwick_{tag}"),
        (flag((F.col("low") < F.col("_lo")) & (F.col("close") > F.col("_lo"))) - flag((F.col("high") > F.col("_hi")) & (F.col("close") < F.col("_hi")))).alias(f"shape__sweep_{tag}"),
        (flag(F.col("close") > F.col("_hi")) - flag(F.col("close") < F.col("_lo"))).alias(f"shape__breakout_{tag}"),
    )


def range_position(days: Iterable[int], per_day: int, high_days: int) -> dict[str, Column]:
    out = {}
    for d in days:
        n = per_day * d
        hi, lo = X.rolling("max", "high", n, int(n * 0.9)), X.rolling("min", "low", n, int(n * 0.9))
        out[f"range__pos_{d}d"] = (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0))
    out[f"range__dd_from_{high_days}d_high"] = F.ln(F.col("close") / X.rolling("max", "high", per_day * high_days, int(per_day * high_days * 0.9)))
    return out


def regime(windows: Iterable[int]) -> dict[str, Column]:
    """Net move over path length."""
    return {f"regime__efficiency_{n}": masked(F.abs(X.log_return(n)) / (X.trailing_sum("absr", n) + EPS), n) for n in windows}


def calendar() -> dict[str, Column]:
    hour = F.hour("ts") + F.minute("ts") / 60
    day = F.weekday(F.col("ts").cast("date"))
    return {"cal__hour_sin": F.sin(PI2 * hour / 24), "cal__hour_cos": F.cos(PI2 * hour / 24), "cal__weekend": (day >= 5).cast("double"), "cal__dow_sin": F.sin(PI2 * day / 7), "cal__dow_cos": F.cos(PI2 * day / 7)}


def cross_asset(df: DataFrame, n: int, leader: str) -> DataFrame:
    """Breadth, mean, dispersion and own move against the other symbols, and the leader's move. df: lc.

    Totals by time minus the row's own: no join of symbols with each other.
    """
    df = df.select("symbol", "ts", X.log_return(n).alias("x"))
    one = F.col("x").isNotNull().cast("int")
    at = Window.partitionBy("ts")

    def others(c: Column) -> Column:
        """Sum over the other rows of the time. Infinities are counted: the row's own can't be taken off a sum."""
        number = F.when(F.abs(c) < math.inf, c).otherwise(0.0)
        up, down, none = (F.count_if(t).over(at) - F.coalesce(t.cast("int"), F.lit(0)) > 0 for t in (c == math.inf, c == -math.inf, F.isnan(c)))
        return F.when(none | (up & down), math.nan).when(up, math.inf).when(down, -math.inf).otherwise(F.sum(number).over(at) - number)

    tot = {"n": F.sum(one).over(at) - one, "up": F.sum((F.col("x") > 0).cast("int")).over(at) - F.coalesce((F.col("x") > 0).cast("int"), F.lit(0)), "s": others(F.col("x")), "ss": others(F.col("x") * F.col("x")), "lead": F.max(F.when(F.col("symbol") == leader, F.col("x"))).over(at)}
    df = df.withColumns({f"_{k}": v for k, v in tot.items()})
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    var = F.when(F.col("_n") > 1, (F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1))
    return df.select("symbol", "ts", F.when(F.col("_n") > 0, F.col("_up") / F.col("_n")).alias(f"xa__breadth_{n}"), mean.alias(f"xa__mkt_{n}"), F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias(f"xa__dispersion_{n}"), (F.col("x") - mean).alias(f"xa__rel_{n}"), F.col("_lead").alias(f"xa__lead_{n}"))


def classic_indicators(bars: DataFrame, tag: str) -> DataFrame:
    """RSI (NULL without losses), MACD histogram and EMA gap without a minimum history, %B."""
    change = F.col("close") - F.lag("close").over(w())
    df = bars.select("symbol", "ts", "close", F.greatest(change, F.lit(0.0)).alias("u"), F.greatest(-change, F.lit(0.0)).alias("d"))
    df = df.withColumn("u", F.when(F.lag("close").over(w()).isNotNull(), F.col("u"))).withColumn("d", F.when(F.lag("close").over(w()).isNotNull(), F.col("d")))
    df = X.ewm_many(df, {"g": {"column": "u", "alpha": 1 / 14, "least": 14}, "l": {"column": "d", "alpha": 1 / 14, "least": 14}, "f": {"column": "close", "alpha": 2 / 13}, "s": {"column": "close", "alpha": 2 / 27}})
    df = X.ewm_many(df.withColumn("m", F.col("f") - F.col("s")), {"ms": {"column": "m", "alpha": 0.2}})
    mid, sd = X.rolling("avg", "close", 20), X.rolling("stddev_pop", "close", 20)
    return df.select("symbol", "ts", F.when(F.col("l") > 0, 100 - 100 / (1 + F.col("g") / F.col("l"))).alias(f"ta__rsi_{tag}"), ((F.col("m") - F.col("ms")) / F.col("close")).alias(f"ta__macdhist_{tag}"), ((F.col("close") - (mid - 2 * sd)) / F.nullif(4 * sd, F.lit(0.0))).alias(f"ta__bbpctb_{tag}"), (F.col("f") / F.col("s") - 1).alias(f"ta__ema_gap_{tag}"))


def long_trend(returns: Iterable[int], channels: Iterable[int], averages: Iterable[tuple[int, int]]) -> dict[str, Column]:
    c = F.col("close")
    out = {f"trend__ret_{n}d": F.ln(c / F.lag("close", n).over(w())) for n in returns}
    for n in channels:
        hi, lo = X.rolling("max", "close", n, n - 2, upto=-1), X.rolling("min", "close", n, n - 2, upto=-1)
        out[f"trend__donchian_pos_{n}d"] = (c - lo) / F.nullif(hi - lo, F.lit(0.0))
    for n, least in averages:
        out[f"trend__dist_ma{n}"] = F.ln(c / X.rolling("avg", "close", n, least))
    return out


def classroom(df: DataFrame) -> dict[str, Column]:
    """Returns, averages, volume ratios and candle shape of a plain candle table."""
    c = F.col("close")
    span = F.col("high") - F.col("low")
    mid, sd = X.rolling("avg", "close", 20), X.rolling("stddev_pop", "close", 20)
    ret = c / F.lag("close").over(w()) - 1
    return {
        **{f"return_{k}": c / F.lag("close", k).over(w()) - 1 for k in (1, 3, 6)},
        "sma_gap": c / X.rolling("avg", "close", 20) - 1,
        "bb_position": F.when(sd.isNotNull(), F.coalesce((c - (mid - 2 * sd)) / F.nullif(4 * sd, F.lit(0.0)), F.lit(0.5))),
        "volume_ratio": F.col("volume") / F.nullif(X.rolling("avg", "volume", 20), F.lit(0.0)),
        "body": (c - F.col("open")) / F.nullif(span, F.lit(0.0)),
        "range_share": span / c,
        "return_now": ret,
    }


def at_decisions(times: DataFrame, frame: DataFrame) -> DataFrame:
    """The last finished row of a feature frame at each decision time."""
    columns = [c for c in frame.columns if c not in ("symbol", "ts")]
    return asof(times, frame, columns).drop("asof_ts")


def families(columns: Iterable[str], wanted: Iterable[str]) -> list[str]:
    """Columns of the wanted families, by prefix."""
    heads = tuple(f"{f}__" for f in wanted)
    return [c for c in columns if c.startswith(heads)]
