"""Trends, tests, confidence, percentile conventions, simulation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.finance import bisect
from .ordered import quantiles
from .statistics import normal_cdf, seeded


def trend(df: DataFrame, partition: list[str], x: str, y: str, future: list[float], exponential: bool = False) -> DataFrame:
    """x, projected for each future x, from a line (or exponential curve) fitted to each group."""
    b = F.ln(F.when(F.col(y) > 0, F.col(y))) if exponential else F.col(y).cast("double")
    a = F.col(x).cast("double")
    fit = df.groupBy(*partition).agg(F.regr_slope(b, a).alias("_s"), F.regr_intercept(b, a).alias("_i"))
    rows = fit.withColumn("x", F.explode(F.array(*[F.lit(float(v)) for v in future])))
    line = F.col("_s") * F.col("x") + F.col("_i")
    return rows.withColumn("projected", F.exp(line) if exponential else line).drop("_s", "_i")


def t_cdf(t: Column, freedom: int, steps: int = 2000) -> Column:
    """Student's distribution for a whole number of degrees, by Simpson's rule on the angle atan(t / sqrt(n))."""
    # with t = sqrt(n) tan(a) the density is a power of the cosine, over a bounded range
    scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(math.pi)
    top = F.atan(F.abs(t) / math.sqrt(freedom))
    h = top / steps
    f = lambda i: F.pow(F.cos(i * h), freedom - 1) * F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2)
    area = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(steps)), f), F.lit(0.0), lambda s, v: s + v) * h / 3 * scale
    return F.when(t >= 0, 0.5 + area).otherwise(0.5 - area)


def t_inv(p: float, freedom: int) -> Column:
    return bisect(lambda x: t_cdf(x, freedom, 200) - p, F.lit(-1000.0), F.lit(1000.0), 60)


def normal_inv(p: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    return mean + sd * bisect(lambda x: normal_cdf(x) - p, F.lit(-40.0), F.lit(40.0), 80)


def one_sample(df: DataFrame, value: str, mean: float) -> DataFrame:
    """t and two-tailed p of a column's mean; the figures are one row, p is made from it."""
    m = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    row = m.first()
    if row.n < 2 or not row.s:
        raise ValueError("two different values are needed")
    t = (row.m - mean) / (row.s / math.sqrt(row.n))
    return m.select(F.lit(t).alias("t"), (2 * (1 - t_cdf(F.lit(abs(t)), row.n - 1))).alias("p"))


def mean_interval(df: DataFrame, partition: list[str], value: str, z: float) -> DataFrame:
    """mean less and more z standard errors, group by group (z of the normal curve, or t for small groups)."""
    error = F.stddev_samp(value) / F.sqrt(F.count(value)) * z
    return df.groupBy(*partition).agg((F.avg(value) - error).alias("low"), (F.avg(value) + error).alias("high"))


def percentile_exclusive(df: DataFrame, partition: list[str], value: str, p: float) -> DataFrame:
    """At place p * (n + 1), between neighbours; blank outside the first and last."""
    x = F.col(value).cast("double")
    counts = df.filter(x.isNotNull()).groupBy(*partition, x.alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    whole = Window.partitionBy(*partition)
    upto, n = F.sum("_k").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), F.sum("_k").over(whole)
    rows = counts.withColumn("_upto", upto).withColumn("_n", n)
    place = F.lit(p) * (F.col("_n") + 1)
    at = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("_v")))  # the value at a place, from 1
    low, high, n, place_ = at(F.floor(place)), at(F.floor(place) + 1), F.max("_n"), F.max(place)
    out = F.when((place_ >= 1) & (place_ <= n), low + (place_ - F.floor(place_)) * (F.coalesce(high, low) - low))
    return rows.groupBy(*partition).agg(out.alias("percentile"))


def nearest_rank(df: DataFrame, partition: list[str], value: str, p: float) -> DataFrame:
    """The value at place ceil(p * n), the first for p = 0."""
    return df.groupBy(*partition).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CAST({value} AS DOUBLE))").alias("percentile"))


def simulate(spark: SparkSession, model, ranges: list[tuple[float, float]], trials: int, seed: int, percentiles: tuple[int, ...] = (5, 50, 95)) -> DataFrame:
    """mean, least, greatest and percentiles of model(inputs) over uniform draws; a trial's draws hang on seed and number only."""
    unit = lambda k: F.conv(F.substring(seeded(seed, F.lit(k), F.col("id")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    draws = spark.range(trials).select(*[(low + (high - low) * unit(k)).alias(f"x{k}") for k, (low, high) in enumerate(ranges)])
    out = draws.select(model(*[F.col(f"x{k}") for k in range(len(ranges))]).alias("y"))
    figures = out.agg(F.avg("y").alias("mean"), F.min("y").alias("least"), F.max("y").alias("greatest"))
    found = figures.join(quantiles(out, "y", [p / 100 for p in percentiles]))  # one row each
    return found.select("mean", "least", "greatest", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(percentiles)])


def bootstrap(df: DataFrame, seed: int) -> DataFrame:
    """About as many rows, drawn with replacement in each task."""
    return df.sample(withReplacement=True, fraction=1.0, seed=seed)
