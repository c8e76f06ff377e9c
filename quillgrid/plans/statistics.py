"""Statistics of whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as S
from .common import rounded, table

c = F.col
_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def cov_matrix(spark, d):
    return S.covariance_matrix(table(spark, d, "lineitem"), _COLUMNS).select("a", "b", rounded(c("value"), "value", 6))


def corr_matrix(spark, d):
    return S.covariance_matrix(table(spark, d, "lineitem"), _COLUMNS, True).select("a", "b", rounded(c("value"), "value", 6))


def weighted_median(spark, d):
    return S.weighted_median(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


def spearman(spark, d):
    return S.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(rounded(c("spearman"), "spearman", 6))


def kendall(spark, d):
    return S.kendall(table(spark, d, "customer"), "c_nationkey", "c_acctbal").select(rounded(c("kendall"), "kendall", 6))


def outliers_iqr(spark, d):
    return S.outliers_iqr(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.2)


def outliers_z(spark, d):
    return S.outliers_z(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 1.3).select("l_orderkey", "l_linenumber", "l_extendedprice", rounded(c("z"), "z"))


def normalise(spark, d):
    out = S.normalise(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.select("c_custkey", *[rounded(c(x), x, 6) for x in ("min_max", "z_score", "robust")])


def average_deviation(spark, d):
    return S.avedev(table(spark, d, "lineitem"), "l_extendedprice").select(rounded(c("avedev"), "avedev"))


def trimmed_mean(spark, d):
    return S.trimmed_mean(table(spark, d, "customer"), "c_acctbal", 0.2).select(rounded(c("trimmed_mean"), "trimmed_mean"))


def percent_rank(spark, d):
    out = S.percent_rank(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.select("c_custkey", rounded(c("percent_rank"), "percent_rank", 8))


def welch_test(spark, d):
    return S.welch(table(spark, d, "orders"), "o_orderstatus", "o_totalprice", "F", "O").select(rounded(c("t"), "t"), rounded(c("freedom"), "freedom", 0))


def normal_curve(spark, d):
    x = (c("p_size") - 25) / 5
    return table(spark, d, "part").select("p_partkey", rounded(S.normal_pdf(x), "pdf", 8), rounded(S.normal_cdf(x) + S.normal_cdf(-x), "whole", 8))


def scorecard(spark, d):
    out = S.score(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": (0.4, True), "p_retailprice": (0.6, False)})
    return out.select("p_partkey", rounded(c("score"), "score", 6))


def poly_fit(spark, d):
    a = S.poly_fit(table(spark, d, "lineitem"), "l_quantity", "l_discount", 1)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(a)], "power int, coefficient double")


def kmeans(spark, d):
    centres = S.kmeans_1d(table(spark, d, "lineitem"), "l_quantity", 3)
    return spark.createDataFrame(list(enumerate(centres)), "cluster int, centre double")


def sample(spark, d):
    return S.sample_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 50, 7)


_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i:]]
SQL = {
    "sample": "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws(':', 7, o_orderkey)), o_orderkey LIMIT 50",
    "kmeans": """WITH RECURSIVE v AS (SELECT l_quantity::DOUBLE AS v, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
        r AS (SELECT 0 AS i, (SELECT quantile_cont(l_quantity::DOUBLE, [1 / 6, 0.5, 5 / 6]) FROM lineitem) AS c
        UNION ALL SELECT i + 1, [coalesce(sum(v * n) FILTER (k = 1) / sum(n) FILTER (k = 1), any_value(c[1])),
            coalesce(sum(v * n) FILTER (k = 2) / sum(n) FILTER (k = 2), any_value(c[2])),
            coalesce(sum(v * n) FILTER (k = 3) / sum(n) FILTER (k = 3), any_value(c[3]))]
        FROM (SELECT i, c, v, n, CASE WHEN abs(v - c[1]) <= least(abs(v - c[2]), abs(v - c[3])) THEN 1 WHEN abs(v - c[2]) <= abs(v - c[3]) THEN 2 ELSE 3 END AS k FROM r, v WHERE i < 100) GROUP BY i)
        SELECT unnest([0, 1, 2])::INTEGER AS cluster, unnest(c) AS centre FROM r WHERE i = 100""",
    "cov_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 6) AS value FROM lineitem" for a, b in _PAIRS),
    "corr_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM lineitem" for a, b in _PAIRS),
    "weighted_median": "SELECT min(v) AS weighted_median FROM (SELECT l_extendedprice AS v, sum(l_quantity) OVER (ORDER BY l_extendedprice) AS r, sum(l_quantity) OVER () / 2 AS h FROM lineitem) WHERE r >= h",
    "spearman": """SELECT round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
        rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)""",
    "kendall": """SELECT round(sum(sign(a.c_nationkey - b.c_nationkey) * sign(a.c_acctbal - b.c_acctbal)) / (any_value(n) * (any_value(n) - 1) / 2), 6) AS kendall FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey, (SELECT count(*) AS n FROM customer)""",
    "outliers_iqr": """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
        WHERE l_extendedprice < a - 0.2 * (b - a) OR l_extendedprice > b + 0.2 * (b - a)""",
    "outliers_z": """SELECT l_orderkey, l_linenumber, l_extendedprice, round((l_extendedprice - m) / s, 4) AS z FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) WHERE abs((l_extendedprice - m) / s) > 1.3""",
    "normalise": """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS min_max, round((c_acctbal - m) / s, 6) AS z_score, round((c_acctbal - q[2]) / (q[3] - q[1]), 6) AS robust FROM customer,
        (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)""",
    "average_deviation": "SELECT round(avg(abs(l_extendedprice - m)), 4) AS avedev FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)",
    "trimmed_mean": """SELECT round(avg(v), 4) AS trimmed_mean FROM (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) AS r, count(*) OVER () AS n FROM customer) WHERE r > floor(n * 0.2 / 2) AND r <= n - floor(n * 0.2 / 2)""",
    "percent_rank": "SELECT c_custkey, round(percent_rank() OVER (ORDER BY c_acctbal), 8) AS percent_rank FROM customer",
    "welch_test": """SELECT round((m0 - m1) / sqrt(e0 + e1), 4) AS t, round(pow(e0 + e1, 2) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)), 0) AS freedom FROM (SELECT avg(x) FILTER (WHERE g = 'F') AS m0, avg(x) FILTER (WHERE g = 'O') AS m1,
        var_samp(x) FILTER (WHERE g = 'F') / count(*) FILTER (WHERE g = 'F') AS e0, var_samp(x) FILTER (WHERE g = 'O') / count(*) FILTER (WHERE g = 'O') AS e1, count(*) FILTER (WHERE g = 'F') AS n0, count(*) FILTER (WHERE g = 'O') AS n1
        FROM (SELECT o_orderstatus AS g, o_totalprice AS x FROM orders))""",
    "normal_curve": "SELECT p_partkey, round(exp(-pow((p_size - 25) / 5, 2) / 2) / sqrt(2 * pi()), 8) AS pdf, 1.0::DOUBLE AS whole FROM part",
    "scorecard": """SELECT p_partkey, round(0.4 * (p_size - a) / (b - a) + 0.6 * (1 - (p_retailprice - x) / (y - x)), 6) AS score FROM part, (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS x, max(p_retailprice) AS y FROM part)""",
    "poly_fit": "SELECT 0 AS power, round(regr_intercept(l_discount, l_quantity), 6) AS coefficient FROM lineitem UNION ALL SELECT 1, round(regr_slope(l_discount, l_quantity), 6) FROM lineitem",
}
QUERIES = {name: globals()[name] for name in SQL}
