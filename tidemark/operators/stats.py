"""Classification measures, tests and bootstraps. Heavy sums run as aggregates; the driver finishes with a handful of numbers."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORMAL = NormalDist()
RANGES, BLOCK = 64, 1 << 16
EULER = 0.5772156649015329


def logloss(y: Column, p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def scores(df: DataFrame) -> DataFrame:
    """n, log loss, Brier score and base rate of (y, p)."""
    return df.agg(F.count("*").alias("n"), F.avg(logloss(F.col("y"), F.col("p"))).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2.0)).alias("brier"), F.avg("y").alias("base_rate"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-frequency bins by value, ties together: edges are exact percentiles, repeated edges count once."""
    edges = df.agg(F.array_distinct(F.percentile("p", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    marked = df.join(F.broadcast(edges)).withColumn("bin", F.greatest(F.size(F.filter("edges", lambda z: z < F.col("p"))) - 1, F.lit(0)))
    return marked.groupBy("bin").agg(F.avg("p").alias("p_mean"), F.avg("y").alias("y_mean"), F.count("*").alias("n"))


def ece(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("p_mean") - F.col("y_mean"))) / F.sum("n")).alias("ece"))


def ranges(df: DataFrame, by: str) -> DataFrame:
    """df with _part, the number of the range of `by` that a row is in: RANGES ranges of about as many rows each, null first."""
    number = F.col(by).cast("timestamp").cast("double") if df.schema[by].dataType.typeName().startswith("timestamp") else F.col(by).cast("double")
    cuts = df.agg(F.percentile_approx(number, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    return df.withColumn("_part", sum((F.coalesce(number > c, F.lit(False)).cast("int") for c in sorted(set(cuts))), F.lit(0)))


def cumulated(df: DataFrame, by: str, sums: list[str] = (), tops: list[str] = (), lows: list[str] = ()) -> DataFrame:
    """df with run_<c>: the sum or maximum of c over the rows up to a row in order of `by`, or the minimum over those from it on.

    Ranges of `by` are worked off apart; what they hand on is a row each. Values of `by` should differ (a tie is cut at random).
    """
    parted = ranges(df, by)
    up, down = (Window.partitionBy("_part").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ([by], [F.desc(by)]))
    before, after = (Window.partitionBy(F.lit(1)).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (["_part"], [F.desc("_part")]))
    few = parted.groupBy("_part").agg(F.count("*").alias("_rows"), *[f(c).alias(f"_{c}") for f, own in ((F.sum, sums), (F.max, tops), (F.min, lows)) for c in own])  # RANGES rows
    few = few.select("_part", *[F.sum(f"_{c}").over(before).alias(f"_{c}") for c in sums], *[F.max(f"_{c}").over(before).alias(f"_{c}") for c in tops], *[F.min(f"_{c}").over(after).alias(f"_{c}") for c in lows])
    joined = parted.join(F.broadcast(few), "_part")
    run = {f"run_{c}": F.sum(c).over(up) + F.coalesce(f"_{c}", F.lit(0)) for c in sums} | {f"run_{c}": F.greatest(F.max(c).over(up), f"_{c}") for c in tops} | {f"run_{c}": F.least(F.min(c).over(down), f"_{c}") for c in lows}
    return joined.select(*df.columns, *[v.alias(k) for k, v in run.items()])


def with_halo(df: DataFrame, by: str, rows: int) -> DataFrame:
    """df in blocks of BLOCK rows in order of `by` (_block, _r the row's number), each begun by the `rows` rows before it (_halo)."""
    parted = ranges(df, by)
    few = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # RANGES rows
    few = few.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = parted.join(F.broadcast(few), "_part").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1)
    block, size = F.floor(F.col("_r") / max(BLOCK, rows)), max(BLOCK, rows)
    both = F.when(F.pmod(F.col("_r"), F.lit(size)) >= size - rows, F.array(block, block + 1)).otherwise(F.array(block))
    return numbered.withColumn("_block", F.explode(both)).withColumn("_halo", F.col("_block") != block).drop("_part", "_before")


def auc(df: DataFrame) -> DataFrame:
    """Area under the curve with ties, from counts per value: rows are aggregated by p before anything is ordered."""
    by_p = df.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    run = cumulated(by_p, "p", sums=["neg"]).withColumn("lower", F.col("run_neg") - F.col("neg"))
    total = run.agg(F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    return total.select(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("u") / (F.col("a") * F.col("b"))).alias("auc"))


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1; a measure without cases is 0."""
    yes, true = F.col("p") >= threshold, F.col("y") == 1
    c = df.agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def moments(column: str) -> list[Column]:
    """n, mean, standard deviation, biased skewness and Pearson kurtosis."""
    return [F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.skewness(column).alias("skew"), (F.kurtosis(column) + 3).alias("kurt")]


def probabilistic_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    if n < 3:
        return float("nan")
    return NORMAL.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(max(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)))


def expected_max_sharpe(trials: int, variance: float) -> float:
    if trials < 2 or variance <= 0:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / trials) + EULER * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(df: DataFrame, column: str, trials: int, variance: float) -> float:
    """Probability that the Sharpe ratio beats the best that luck alone would give among the trials."""
    r = df.agg(*moments(column)).first()
    if not r or r["n"] < 3:
        return float("nan")
    sr = r["mean"] / r["sd"] if r["sd"] else 0.0
    return probabilistic_sharpe(sr, r["n"], r["skew"] or 0.0, r["kurt"] or 3.0, expected_max_sharpe(trials, variance))


def lags_for(n: int) -> int:
    return int(4 * (n / 100) ** (2 / 9))


def newey_west(df: DataFrame, column: str, lags: int, by: str | None = None) -> DataFrame:
    """(n, mean, variance) of a series in order of ts: Bartlett-weighted autocovariances of the demeaned values."""
    if by:
        key, order = by, Window.partitionBy(by).orderBy("ts")
        x = df.where(F.col(column).isNotNull()).select(key, "ts", F.col(column).alias("x"), F.lit(False).alias("_halo"))
    else:
        key, order = "_all", Window.partitionBy("_block").orderBy("_r")
        x = with_halo(df.where(F.col(column).isNotNull()).select("ts", F.col(column).alias("x")), "ts", lags).withColumn("_all", F.lit(1))
    means = x.where("NOT _halo").groupBy(key).agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    x = x.join(means if by else F.broadcast(means), key).withColumn("d", F.col("x") - F.col("m"))
    terms = F.col("d") * F.col("d")
    for k in range(1, lags + 1):
        terms = terms + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col("d") * F.lag("d", k).over(order), F.lit(0.0))
    out = x.withColumn("t", terms).where("NOT _halo").groupBy(key).agg(F.max("n").alias("n"), F.max("m").alias("mean"), (F.sum("t") / F.max("n")).alias("variance"))
    return out if by else out.drop("_all")


def diebold_mariano(df: DataFrame, a: str, b: str) -> tuple[float, float]:
    """Mean of loss a minus loss b, and the one-sided p-value that it is above 0; NaN under 20 rows."""
    d = df.select("ts", (F.col(a) - F.col(b)).alias("d")).where("d IS NOT NULL")
    n = d.count()
    if n < 20:
        return float("nan"), float("nan")
    r = newey_west(d, "d", lags_for(n)).first()
    if r["variance"] <= 0:
        return r["mean"], float("nan")
    return r["mean"], 1 - NORMAL.cdf(r["mean"] / math.sqrt(r["variance"] / n))


def hac_ols(df: DataFrame, y: str, xs: list[str], lags: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(coefficients with the intercept first, t values, n). Two aggregates: the Gram matrix, then lagged score products."""
    cols = ["_one", *xs]
    d = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])).select("ts", F.col(y).alias("_y"), F.lit(1.0).alias("_one"), *xs)
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    g = d.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs], *[F.sum(F.col(c) * F.col("_y")) for c in cols], F.count("*")).first()
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, g, strict=False):
        gram[i, j] = gram[j, i] = v
    beta = np.linalg.solve(gram, np.array(g[len(pairs) : len(pairs) + k]))
    u = F.col("_y") - sum((float(b) * F.col(c) for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
    d = d.withColumn("_u", u)
    order = Window.partitionBy("_block").orderBy("_r")
    score = {c: F.col(c) * F.col("_u") for c in cols}
    d = with_halo(d.select("ts", *[s.alias(f"s{i}") for i, s in enumerate(score.values())]), "ts", lags)
    sums, at = [], []
    for lag in range(lags + 1):
        for i in range(k):
            for j in range(k):
                d = d.withColumn(f"p{lag}_{i}_{j}", F.col(f"s{i}") * (F.col(f"s{j}") if not lag else F.lag(f"s{j}", lag).over(order)))
                sums.append(F.sum(F.when(~F.col("_halo"), F.col(f"p{lag}_{i}_{j}"))))
                at.append((lag, i, j))
    s = np.zeros((k, k))
    for (lag, i, j), v in zip(at, d.agg(*sums).first(), strict=True):
        weight = 1 - lag / (lags + 1)
        s[i, j] += weight * (v or 0.0)
        if lag:
            s[j, i] += weight * (v or 0.0)
    inverse = np.linalg.inv(gram)
    return beta, beta / np.sqrt(np.diag(inverse @ s @ inverse)), int(g[-1])


def holm_bh(df: DataFrame, p: str = "p") -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values: running extremes over the different values; ties share theirs."""
    by_p = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_k"))
    m = F.broadcast(by_p.agg(F.sum("_k").alias("_m")))
    ranked = cumulated(by_p, p, sums=["_k"]).join(m)
    ranked = ranked.withColumns({"_h": F.least(F.lit(1.0), (F.col("_m") - F.col("run__k") + F.col("_k")) * F.col(p)), "_b": F.col(p) * F.col("_m") / F.col("run__k")})
    run = cumulated(ranked, p, tops=["_h"], lows=["_b"])
    return df.join(run.select(p, F.col("run__h").alias("holm"), F.least(F.lit(1.0), "run__b").alias("bh")), p, "left").select(*df.columns, "holm", "bh")


def has_skill(df: DataFrame, base_rate: float, alpha: float = 0.10) -> bool:
    """Whether the log loss of p (ts, y, p) is below that of the base rate by a one-sided Diebold-Mariano test at level alpha."""
    loss = lambda q: -(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))
    clipped = lambda q: F.greatest(F.least(q, F.lit(1 - 1e-6)), F.lit(1e-6))
    gain, p_value = diebold_mariano(df.select("ts", loss(clipped(F.lit(float(base_rate)))).alias("a"), loss(clipped(F.col("p"))).alias("b")), "a", "b")
    return bool(gain > 0 and p_value < alpha)


def pbo(df: DataFrame, blocks: int = 6) -> DataFrame:
    """(split, below) for each choice of half the blocks: whether the best configuration in them is below the middle outside.

    df: config, t (0-based row number), n_t (rows), ret. Only counts, sums and squares per block enter the splits.
    """
    size, extra = F.floor(F.col("n_t") / blocks), F.col("n_t") % blocks
    block = F.when(F.col("t") < extra * (size + 1), F.floor(F.col("t") / (size + 1))).otherwise(extra + F.floor((F.col("t") - extra * (size + 1)) / size))
    parts = df.groupBy("config", block.cast("int").alias("block")).agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    splits = [(i, b, b in chosen) for i, chosen in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    table = df.sparkSession.createDataFrame(splits, "split int, block int, inside boolean")
    both = parts.join(F.broadcast(table), "block").groupBy("split", "config", "inside").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.col("s") / F.col("n")
    both = both.withColumn("metric", mean / (F.sqrt(F.greatest((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0))) + 1e-12))
    wide = both.groupBy("split", "config").agg(F.max(F.when(F.col("inside"), F.col("metric"))).alias("ins"), F.max(F.when(~F.col("inside"), F.col("metric"))).alias("out"))
    per = Window.partitionBy("split")
    best = F.row_number().over(per.orderBy(F.desc("ins"), "config"))
    ranked = wide.withColumns({"_best": best, "_low": F.rank().over(per.orderBy("out")), "_same": F.count("*").over(Window.partitionBy("split", "out")), "_n": F.count("*").over(per)})
    rank = F.col("_low") + (F.col("_same") - 1) / 2
    return ranked.where("_best = 1").select("split", F.col("config").alias("best"), (rank / (F.col("_n") + 1) <= 0.5).alias("below"))


def fama_macbeth(df: DataFrame, y: str, x: str) -> DataFrame:
    """(ts, slope) of standardised x per date; dates with fewer than 3 rows or no spread are left out."""
    m = Window.partitionBy("ts")
    z = (F.col(x) - F.avg(x).over(m)) / F.nullif(F.stddev_pop(x).over(m), F.lit(0.0))
    d = df.withColumns({"_z": z, "_n": F.count("*").over(m)}).where("_n >= 3 AND _z IS NOT NULL")
    return d.groupBy("ts").agg(F.regr_slope(y, "_z").alias("slope"), F.count("*").alias("n"))


def pick(b: Column, i: Column, n: Column) -> Column:
    """A position in 0..n-1 for draw i of bootstrap b: fixed arithmetic, so that any engine draws the same."""
    return F.pmod(b * 7919 + i * 104729 + b * i * 31, n)


def block_bootstrap(df: DataFrame, value: str, key: Column, draws: int) -> DataFrame:
    """(b, mean): ratio of sums over blocks drawn with replacement. Rows are summed per block first; draws meet blocks, not rows."""
    blocks = df.groupBy(key.alias("_k")).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    order = Window.partitionBy(F.lit(1)).orderBy("_k")  # blocks are days or weeks
    blocks = blocks.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    drawn = blocks.select("i", "n").join(F.broadcast(df.sparkSession.range(draws).withColumnRenamed("id", "b"))).withColumn("j", pick(F.col("b"), F.col("i"), F.col("n")))
    got = drawn.join(F.broadcast(blocks.select(F.col("i").alias("j"), "s", "c")), "j")
    return got.groupBy("b").agg((F.sum("s") / F.sum("c")).alias("mean"))


def stationary_bootstrap(df: DataFrame, value: str, mean_block: float, draws: int) -> DataFrame:
    """(b, mean) over resampled series of the same length: blocks start where a fixed hash says so and run on, modulo n.

    df: ts, value. The start of the block is carried forward by a running last.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("ts")
    x = df.select("ts", F.col(value).alias("x")).withColumn("t", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    every = x.select("t", "n").join(F.broadcast(df.sparkSession.range(draws).withColumnRenamed("id", "b")))
    fresh = (F.col("t") == 0) | (F.pmod(F.col("b") * 7907 + F.col("t") * 7901 + F.col("b") * F.col("t") * 13, F.lit(1000)) < round(1000 / max(mean_block, 1.0)))
    start = F.when(fresh, F.struct(F.col("t").alias("at"), pick(F.col("b"), F.col("t"), F.col("n")).alias("from")))
    run = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    drawn = every.withColumn("_s", F.last(start, ignorenulls=True).over(run)).withColumn("j", F.pmod(F.col("_s.from") + F.col("t") - F.col("_s.at"), F.col("n")))
    return drawn.join(x.select(F.col("t").alias("j"), "x"), "j").groupBy("b").agg(F.avg("x").alias("mean"))


def mean_p_value(boots: DataFrame, mean: float, draws: int) -> float:
    """Share of draws at least twice the mean, 1 / draws at least."""
    n = boots.where(F.col("mean") - mean >= mean).count()
    return max(n / draws, 1 / draws)


def binomial_tail(hits: int, n: int, p: float = 0.5) -> float:
    """Probability of at least `hits` of n."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p) for k in range(hits, n + 1)]
    return min(1.0, sum(map(math.exp, logs)))
