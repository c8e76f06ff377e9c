"""Weighted, rank and matrix statistics, tests, outliers, scales, clusters over columns of any length."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles, rank, with_running


def covariance_matrix(df: DataFrame, columns: list[str], correlation: bool = False) -> DataFrame:
    """a, b, value of every pair, from one pass over the table; a constant column has no correlation."""
    pairs = list(combinations_with_replacement(columns, 2))
    x = {c: F.col(c).cast("double") for c in columns}

    def cell(a, b):
        cov = F.covar_pop(x[a], x[b])
        return F.try_divide(cov, F.sqrt(F.var_pop(x[a]) * F.var_pop(x[b]))) if correlation else cov

    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a, b).alias("value")) for a, b in pairs]).alias("m"))
    return one.select(F.explode("m").alias("m")).select("m.a", "m.b", "m.value")


def weighted_median(df: DataFrame, value: str, weight: str) -> DataFrame:
    """The first value at which half the weight is reached."""
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).groupBy("v").agg(F.sum("w").alias("w"))
    half = rows.agg((F.sum("w") / 2).alias("half"))
    running = with_running(rows, [F.col("v")], "reached", F.col("w"))
    return running.join(F.broadcast(half)).filter("reached >= half").agg(F.min("v").alias("weighted_median"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks: a rank is the standard one and half the other peers."""

    def ranked(rows, c, name):
        counts = rows.groupBy(F.col(c).alias(f"_{name}")).agg(F.count(F.lit(1)).alias("peers"))
        places = with_running(counts, [F.col(f"_{name}")], "upto", F.col("peers"))
        places = places.select(f"_{name}", (F.col("upto") - (F.col("peers") - 1) / 2).alias(name))
        return rows.join(places, F.col(c) == F.col(f"_{name}")).drop(f"_{name}")

    both = ranked(ranked(df.select(a, b).dropna(), a, "ra"), b, "rb")
    r = F.try_divide(F.covar_pop("ra", "rb"), F.sqrt(F.var_pop("ra") * F.var_pop("rb")))
    return both.agg(r.alias("spearman"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau-a without comparing all pairs: discordance is counted digit by digit of the second column's rank.

    Rows are ranked by a and by b (dense). A pair is decided at the highest bit in which its b ranks
    differ; inside a group of equal higher bits, each row with bit 0 counts the rows with bit 1 that
    come strictly before and strictly after it in a. There are as many digits as the distinct values of b need.
    """
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    rows = rank(rank(rows, "a", "ra", "dense"), "b", "rb", "dense")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    digits = max(1, int(rows.agg(F.max("rb")).first()[0] or 1).bit_length())
    bits = rows.select("ra", F.explode(F.transform(F.sequence(F.lit(0), F.lit(digits - 1)), lambda i: F.struct(i.alias("i"), ((F.col("rb") / F.pow(F.lit(2.0), i)).cast("long")).alias("high")))).alias("p"))
    bits = bits.select("ra", "p.i", (F.col("p.high") % 2).alias("bit"), F.floor(F.col("p.high") / 2).alias("group"))
    cells = bits.groupBy("i", "group", "ra").agg(F.count_if(F.col("bit") == 0).alias("zeros"), F.count_if(F.col("bit") == 1).alias("ones"))
    # ra strictly below; the groups of the highest bits are whole tables of distinct ra, so they are cut into slices of 65,536 ranks
    cells = cells.withColumn("slice", F.floor(F.col("ra") / (1 << 16)))
    group, slices = Window.partitionBy("i", "group"), Window.partitionBy("i", "group").orderBy("slice")
    totals = cells.groupBy("i", "group", "slice").agg(F.sum("ones").alias("here"))
    totals = totals.select("i", "group", "slice", (F.sum("here").over(slices) - F.col("here")).alias("before"), F.sum("here").over(group).alias("all"))
    inside = Window.partitionBy("i", "group", "slice").orderBy("ra").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(totals, ["i", "group", "slice"])
    below = F.col("before") + F.coalesce(F.sum("ones").over(inside), F.lit(0))
    above = F.col("all") - below - F.col("ones")
    score = cells.withColumn("s", F.col("zeros") * (above - below)).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    return score.join(n).select((F.col("s") / (F.col("n") * (F.col("n") - 1) / 2)).alias("kendall"))


def outliers_iqr(df: DataFrame, value: str, multiplier: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than multiplier times their distance."""
    q = quantiles(df, value, [0.25, 0.75])
    x, low, high = F.col(value), F.col("q")[0], F.col("q")[1]
    return df.join(F.broadcast(q)).filter((x < low - multiplier * (high - low)) | (x > high + multiplier * (high - low))).drop("q")


def outliers_z(df: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    m = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return df.join(F.broadcast(m)).withColumn("z", z).filter(F.abs("z") > threshold).drop("_mean", "_sd")


def normalise(df: DataFrame, value: str) -> DataFrame:
    """min_max, z_score and robust scales beside each row."""
    x = F.col(value).cast("double")
    f = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd")).join(quantiles(df, value, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q"))  # one row each
    out = df.join(F.broadcast(f)).withColumn("min_max", F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    out = out.withColumn("z_score", F.try_divide(x - F.col("_mean"), F.col("_sd"))).withColumn("robust", F.try_divide(x - F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0]))
    return out.drop("_lo", "_hi", "_mean", "_sd", "_q")


def avedev(df: DataFrame, value: str, partition: list[str] = ()) -> DataFrame:
    """Mean distance from the mean, of the whole table or of each group."""
    if partition:
        means = df.groupBy(*partition).agg(F.avg(value).alias("_mean"))
        return df.join(means, list(partition)).groupBy(*partition).agg(F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("avedev"))
    m = df.agg(F.avg(value).alias("_mean"))
    return df.join(F.broadcast(m)).agg(F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("avedev"))


def trimmed_mean(df: DataFrame, value: str, share: float, partition: list[str] = ()) -> DataFrame:
    """int(n * share / 2) values go from each end: counts by distinct value, so equal values need no order.

    With partition, of each group: a window over its distinct values, sorted by Spark, none of them collected.
    """
    if partition:
        counts = df.filter(F.col(value).isNotNull()).groupBy(*partition, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        whole = Window.partitionBy(*partition)
        upto, n = F.sum("_k").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), F.sum("_k").over(whole)
        placed = counts.withColumn("_upto", upto).withColumn("_n", n).withColumn("_cut", F.floor(F.col("_n") * share / 2))
        kept = F.greatest(F.lit(0), F.least(F.col("_upto"), F.col("_n") - F.col("_cut")) - F.greatest(F.col("_upto") - F.col("_k"), F.col("_cut")))
        return placed.groupBy(*partition).agg((F.sum(F.col("_v") * kept) / F.sum(kept)).alias("trimmed_mean"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    running = with_running(counts, [F.col("v")], "upto", F.col("k"))
    n = counts.agg(F.sum("k").alias("n"))
    cut = F.floor(F.col("n") * share / 2)
    kept = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("n") - cut) - F.greatest(F.col("upto") - F.col("k"), cut))
    return running.join(F.broadcast(n)).agg((F.sum(F.col("v") * kept) / F.sum(kept)).alias("trimmed_mean"))


def percent_rank(df: DataFrame, value: str, name: str = "percent_rank") -> DataFrame:
    """Share of values below, of all others."""
    n = df.agg(F.count(value).alias("_n"))
    return rank(df, value, "_rank").join(F.broadcast(n)).withColumn(name, F.try_divide(F.col("_rank") - 1, F.col("_n") - 1)).drop("_rank", "_n")


def poly_fit(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Least squares: the power sums come from one pass, the small system is solved on the driver."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    row = df.agg(*[F.sum(F.pow(a, p)).alias(f"s{p}") for p in range(2 * degree + 1)], *[F.sum(F.pow(a, p) * b).alias(f"t{p}") for p in range(degree + 1)]).first()
    import numpy as np

    matrix = np.array([[row[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.solve(matrix, np.array([row[f"t{i}"] for i in range(degree + 1)])).tolist()


def welch(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """t and its degrees of freedom (a whole number) for the means of two groups."""
    x = lambda g: F.when(F.col(group) == g, F.col(value).cast("double"))
    m = df.agg(*[f(x(g)).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    freedom = F.pow(e0 + e1, 2) / (F.pow(e0, 2) / (F.col("n0") - 1) + F.pow(e1, 2) / (F.col("n1") - 1))
    return m.select(F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(e0 + e1)).alias("t"), F.rint(freedom).alias("freedom"))


def normal_pdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Series near the middle, continued fraction in the tails: no Python on the executors."""
    z = (x - mean) / sd
    a = F.abs(z)
    term = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("t"), a.alias("s")), lambda s, k: F.struct((s["t"] * a * a / (2 * k + 1)).alias("t"), (s["s"] + s["t"] * a * a / (2 * k + 1)).alias("s")))
    middle = 0.5 + normal_pdf(a) * term["s"]
    tail = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: 60 - k), a, lambda s, k: a + k / s)
    upper = F.when(a < 4, middle).otherwise(1 - normal_pdf(a) / tail)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def kmeans_1d(df: DataFrame, value: str, k: int, rounds: int = 100) -> list[float]:
    """Centres by Lloyd from rank seeds: each round is one aggregate over distinct values; k numbers are on the driver."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        centres = list(quantiles(df, value, [(2 * i + 1) / (2 * k) for i in range(k)]).first().q)
        for _ in range(rounds):
            nearest = F.array_min(F.array(*[F.struct(F.abs(F.col("v") - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]
            means = {r.i: r.m for r in counts.groupBy(nearest.alias("i")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).collect()}
            after = [means.get(i, c) for i, c in enumerate(centres)]
            if after == centres:
                break
            centres = after
    finally:
        counts.unpersist()
    return centres


def seeded(seed: int, *keys: Column) -> Column:
    """A hash of the seed and the keys that any engine has: MD5 of them, colons between."""
    return F.md5(F.concat_ws(":", F.lit(seed), *keys))


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows, the same ones for a seed: the least hashes, k of each task before the shuffle."""
    return df.withColumn("_h", seeded(seed, F.col(key))).orderBy("_h", key).limit(k).drop("_h")


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_h", seeded(seed, F.col(key))).orderBy("_h", key).drop("_h")


def score(df: DataFrame, criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """Weighted sum of min-max scores: criteria have a weight and whether more is better."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in criteria for n, f in (("lo", F.min), ("hi", F.max))])
    total = F.lit(0.0)
    for c, (weight, more) in criteria.items():
        share = F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))
        total = total + weight * (share if more else 1 - share)
    return df.join(F.broadcast(ends)).withColumn("score", total).drop(*ends.columns)


