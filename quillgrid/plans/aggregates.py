"""Aggregate, criteria and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.criteria import all_of, any_of, criterion
from .common import rounded, table

c = F.col


def agg_basic(spark, d):
    x = c("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        rounded(A.SUM(x).column(), "total", 2), A.COUNT(x).column("n"), rounded(A.AVERAGE(x).column(), "mean"), A.MIN(x).column("least"), A.MAX(x).column("greatest")
    )


def sumifs(spark, d):
    x, flag, qty, ship = c("l_extendedprice"), c("l_returnflag"), c("l_quantity"), c("l_linestatus")
    return table(spark, d, "lineitem").agg(
        rounded(A.SUMIFS(x, (flag, "R"), (qty, ">=25")).column(), "sum_r", 2),
        A.COUNTIFS((flag, "<>R"), (ship, "=O")).column("count_not_r"),
        rounded(A.AVERAGEIFS(x, (qty, "<10")).column(), "mean_small"),
        A.MAXIFS(x, (flag, "a")).column("max_a"), A.MINIFS(x, (flag, "N"), (qty, ">49")).column("min_n"),
        rounded(A.SUMIF(qty, ">40").column(), "sumif_qty", 2), A.COUNTIF(flag, "N").column("countif_n"), rounded(A.AVERAGEIF(flag, "A", x).column(), "averageif_a"),
    )


def countif_wildcard(spark, d):
    t = c("p_type")
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_if(criterion(t, "*brass")).alias("brass"), F.count_if(criterion(t, "<>s*")).alias("not_s"), F.count_if(criterion(c("p_size"), "<=10")).alias("small"))


def database_functions(spark, d):
    rows = ({"o_orderstatus": "F", "o_totalprice": ">100000"}, {"o_orderpriority": "1*"})
    x = c("o_totalprice")
    return table(spark, d, "orders").agg(
        rounded(A.DSUM(x, *rows).column(), "dsum", 2), rounded(A.DAVERAGE(x, *rows).column(), "daverage"), A.DCOUNT(x, *rows).column("dcount"),
        A.DMIN(x, *rows).column("dmin"), A.DMAX(x, *rows).column("dmax"),
    )


def dget_single(spark, d):
    x = c("r_regionkey")
    many = A.DGET(x, {"r_name": "A*"})
    return table(spark, d, "region").agg(A.DGET(x, {"r_name": "asia"}).column("one"), A.DGET(x, {"r_name": "nowhere"}).code("none_code"), many.code("many_code"))


def stat_family(spark, d):
    x = c("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        rounded(A.MEDIAN(x).column(), "median"), rounded(A.MODE(x).column(), "mode"), rounded(A.STDEV(x).column(), "stdev"), rounded(A.STDEVP(x).column(), "stdevp"),
        rounded(A.VAR(x).column(), "var_s"), rounded(A.VARP(x).column(), "var_p"), rounded(A.DEVSQ(x).column(), "devsq", 2), rounded(A.SKEW(x).column(), "skew"),
        rounded(A.GEOMEAN(x).column(), "geomean"), rounded(A.HARMEAN(x).column(), "harmean"),
        rounded(A.PERCENTILE(x, 0.9).column(), "p90"), rounded(A.QUARTILE(x, 1).column(), "q1"),
    )


def large_small(spark, d):
    x = c("c_acctbal")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(A.LARGE(x, 3).column("third_largest"), A.SMALL(x, 2).column("second_smallest"), A.LARGE(x, 100000).code("too_far"))


def regression_family(spark, d):
    y, x = c("l_extendedprice"), c("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        rounded(A.SLOPE(y, x).column(), "slope"), rounded(A.INTERCEPT(y, x).column(), "intercept"), rounded(A.RSQ(y, x).column(), "rsq", 6), rounded(A.CORREL(y, x).column(), "correl", 6),
        rounded(A.COVAR(y, x).column(), "covar", 3), rounded(A.FORECAST(60, y, x).column(), "forecast_60", 3),
    )


def regression_flat(spark, d):
    y, one = c("l_extendedprice"), c("l_quantity") * 0 + 1
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(A.SLOPE(y, one).code("slope_code"), A.CORREL(one, y).column("correl_flat"), A.RSQ(one, y).column("rsq_flat"))


def sum_of_pairs(spark, d):
    x, y = c("l_quantity"), c("l_discount")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        rounded(A.SUMPRODUCT(x, y).column(), "sumproduct", 3), rounded(A.SUMXMY2(x, y).column(), "sumxmy2", 2), rounded(A.SUMX2MY2(x, y).column(), "sumx2my2", 2), rounded(A.SUMX2PY2(x, y).column(), "sumx2py2", 2)
    )


def product_of_rates(spark, d):
    return table(spark, d, "region").agg(A.PRODUCT(c("r_regionkey") + 1).column("product"), A.PRODUCT(F.lit(None).cast("double")).code("empty_code"))


def textjoin_groups(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(A.TEXTJOIN("; ", True, c("n_name"), c("n_nationkey")).column("names"))


def subtotal_visible(spark, d):
    shown = all_of((c("l_returnflag"), "<>A"), (c("l_quantity"), ">5"))
    x = c("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        *[rounded(A.SUBTOTAL(code, x, shown).column(), f"subtotal_{code}", 2) for code in (1, 2, 4, 5, 9)]
    )


def filter_rows(spark, d):
    keep = any_of({"c_mktsegment": "B*", "c_acctbal": ">0"}, {"c_acctbal": "<-900"})
    return table(spark, d, "customer").filter(keep).select("c_custkey", "c_mktsegment", "c_acctbal")


def weighted_stats(spark, d):
    x, w = c("l_extendedprice"), c("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(rounded(A.weighted_mean(x, w), "weighted_mean", 3), rounded(A.weighted_std(x, w), "weighted_std", 2))


def entropy_gini(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("p_brand").agg(F.sum("n").alias("total"))
    return counts.join(totals, "p_brand").groupBy("p_brand").agg(rounded(F.sum(A.entropy(c("n"), c("total"))), "entropy"), rounded(1 - F.sum(F.pow(c("n") / c("total"), 2)), "gini"))


SQL = {
    "agg_basic": "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*)::DOUBLE AS n, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS greatest FROM lineitem GROUP BY 1",
    "sumifs": """SELECT round(sum(l_extendedprice) FILTER (WHERE upper(l_returnflag) = 'R' AND l_quantity >= 25), 2) AS sum_r,
        (count(*) FILTER (WHERE upper(l_returnflag) <> 'R' AND upper(l_linestatus) = 'O'))::DOUBLE AS count_not_r,
        round(avg(l_extendedprice) FILTER (WHERE l_quantity < 10), 4) AS mean_small, max(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS max_a,
        min(l_extendedprice) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 49) AS min_n, round(sum(l_quantity) FILTER (WHERE l_quantity > 40), 2) AS sumif_qty,
        (count(*) FILTER (WHERE l_returnflag = 'N'))::DOUBLE AS countif_n, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 4) AS averageif_a FROM lineitem""",
    "countif_wildcard": "SELECT p_brand, count(*) FILTER (WHERE upper(p_type) LIKE '%BRASS') AS brass, count(*) FILTER (WHERE NOT upper(p_type) LIKE 'S%') AS not_s, count(*) FILTER (WHERE p_size <= 10) AS small FROM part GROUP BY 1",
    "database_functions": """SELECT round(sum(o_totalprice), 2) AS dsum, round(avg(o_totalprice), 4) AS daverage, count(*)::DOUBLE AS dcount, min(o_totalprice) AS dmin, max(o_totalprice) AS dmax
        FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority LIKE '1%'""",
    "dget_single": "SELECT (SELECT r_regionkey FROM region WHERE upper(r_name) = 'ASIA') AS one, '#VALUE!' AS none_code, CASE WHEN count(*) FILTER (WHERE r_name LIKE 'A%') > 1 THEN '#NUM!' END AS many_code FROM region",
    "stat_family": """SELECT l_linestatus, round(median(l_quantity), 4) AS median, round(first(m), 4) AS mode, round(stddev_samp(l_quantity), 4) AS stdev, round(stddev_pop(l_quantity), 4) AS stdevp,
        round(var_samp(l_quantity), 4) AS var_s, round(var_pop(l_quantity), 4) AS var_p, round(var_pop(l_quantity) * count(*), 2) AS devsq, round(skewness(l_quantity), 4) AS skew,
        round(exp(avg(ln(l_quantity))), 4) AS geomean, round(count(*) / sum(1 / l_quantity), 4) AS harmean, round(quantile_cont(l_quantity, 0.9), 4) AS p90, round(quantile_cont(l_quantity, 0.25), 4) AS q1
        FROM lineitem JOIN (SELECT l_linestatus AS s, arg_min(q, (-k, q)) AS m FROM (SELECT l_linestatus, l_quantity AS q, count(*) AS k FROM lineitem GROUP BY 1, 2) GROUP BY 1) ON s = l_linestatus GROUP BY 1""",
    "large_small": """SELECT c_nationkey, max(c_acctbal) FILTER (WHERE down = 3) AS third_largest, max(c_acctbal) FILTER (WHERE up = 2) AS second_smallest, '#NUM!' AS too_far FROM
        (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS down, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS up FROM customer) GROUP BY 1""",
    "regression_family": """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(pow(corr(l_extendedprice, l_quantity), 2), 6) AS rsq,
        round(corr(l_extendedprice, l_quantity), 6) AS correl, round(covar_pop(l_extendedprice, l_quantity), 3) AS covar,
        round(regr_slope(l_extendedprice, l_quantity) * 60 + regr_intercept(l_extendedprice, l_quantity), 3) AS forecast_60 FROM lineitem GROUP BY 1""",
    "regression_flat": "SELECT l_linestatus, '#DIV/0!' AS slope_code, 0.0::DOUBLE AS correl_flat, 0.0::DOUBLE AS rsq_flat FROM lineitem GROUP BY 1",
    "sum_of_pairs": """SELECT l_returnflag, round(sum(l_quantity * l_discount), 3) AS sumproduct, round(sum((l_quantity - l_discount) * (l_quantity - l_discount)), 2) AS sumxmy2,
        round(sum(l_quantity * l_quantity - l_discount * l_discount), 2) AS sumx2my2, round(sum(l_quantity * l_quantity + l_discount * l_discount), 2) AS sumx2py2 FROM lineitem GROUP BY 1""",
    "product_of_rates": "SELECT product(r_regionkey + 1) AS product, '#VALUE!' AS empty_code FROM region",
    "textjoin_groups": "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1",
    "subtotal_visible": """SELECT l_linestatus, round(avg(x), 2) AS subtotal_1, count(x)::DOUBLE AS subtotal_2, round(max(x), 2) AS subtotal_4, round(min(x), 2) AS subtotal_5, round(sum(x), 2) AS subtotal_9
        FROM (SELECT l_linestatus, CASE WHEN l_returnflag <> 'A' AND l_quantity > 5 THEN l_extendedprice END AS x FROM lineitem) GROUP BY 1""",
    "filter_rows": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE (upper(c_mktsegment) LIKE 'B%' AND c_acctbal > 0) OR c_acctbal < -900",
    "weighted_stats": """SELECT l_returnflag, round(sum(x * w) / sum(w), 3) AS weighted_mean, round(sqrt(sum(w * x * x) / sum(w) - pow(sum(x * w) / sum(w), 2)), 2) AS weighted_std
        FROM (SELECT l_returnflag, l_extendedprice AS x, l_quantity AS w FROM lineitem) GROUP BY 1""",
    "entropy_gini": """SELECT p_brand, round(sum(-n / t * log2(n / t)), 4) AS entropy, round(1 - sum(pow(n / t, 2)), 4) AS gini FROM
        (SELECT p_brand, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS t FROM part GROUP BY p_brand, p_size) GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
