"""Scalar functions: formats, buckets, guarded arithmetic, normal distribution."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def divide(a: Column, b: Column) -> Column:
    """NULL where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def volatility_regime(p: Column) -> Column:
    """low, mid or high by thirds of a percentile; NULL outside (-0.01, 1.01]."""
    return F.when((p > -0.01) & (p <= 1 / 3), "low").when((p > 1 / 3) & (p <= 2 / 3), "mid").when((p > 2 / 3) & (p <= 1.01), "high")


def trend_regime(x: Column) -> Column:
    """up or down; a missing value is down."""
    return F.when(F.coalesce(x > 0, F.lit(False)), "up").otherwise("down")


def price_text(p: Column) -> Column:
    """A price with about five significant digits, grouped by thousands."""
    digits = lambda d: F.format_number(p, d)
    size = F.floor(F.log10(F.abs(p))).cast("int")
    small = F.when(size == 0, digits(4))
    for k in range(1, 12):
        small = small.when(size == -k, digits(4 + k))
    return F.when(p.isNull() | (p == 0), F.when(p == 0, "0.00")).when(F.abs(p) >= 1000, digits(2)).when(F.abs(p) >= 100, digits(2)).when(F.abs(p) >= 10, digits(3)).otherwise(small)


def hold_text(minutes: Column) -> Column:
    """A holding time in the largest whole unit: minutes below two hours, hours below two days, else days."""
    one = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    return F.when(minutes < 60, F.concat(minutes.cast("bigint").cast("string"), F.lit(" min"))).when((minutes % 1440 == 0) & (minutes >= 2880), one(minutes / 1440, "day")).otherwise(one(minutes / 60, "hour"))


def config_name(symbol: Column, interval: Column, horizon: Column) -> Column:
    return F.concat_ws("_", F.upper(symbol), interval, F.concat(F.lit("h"), horizon.cast("string")))


def stable_id(*parts: Column) -> Column:
    """A short stable key: SHA-1 of the parts as JSON."""
    return F.substring(F.sha1(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))), 1, 16)


def _cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))


def normal_cdf(c: Column) -> Column:
    """Spark has no erf; Arrow batches go through math.erf."""
    return F.pandas_udf(_cdf, "double")(c)


def normal_cdf_scalar(x: float) -> float:
    return NormalDist().cdf(x)


def normal_ppf_scalar(p: float) -> float:
    return NormalDist().inv_cdf(p)
