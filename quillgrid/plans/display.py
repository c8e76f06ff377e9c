"""Display, rules and inference over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as P
from ..operators import inference as I
from ..operators import rules as R
from .common import rounded, table

c = F.col


def number_words(spark, d):
    return table(spark, d, "customer").select("c_custkey", P.spell_integer(c("c_custkey") % 20).column("word"), P.spell_integer(F.lit(1203045)).column("long_word"), P.spell_money(F.lit(1.05)).column("money"), P.spell_integer(F.lit(0.5)).code("refused"))


def locale_numbers(spark, d):
    x = F.floor("c_acctbal")
    shown = F.when(x.isNotNull(), P.render_number(x, "de", 1))
    return table(spark, d, "customer").select("c_custkey", shown.alias("german"), P.parse_number(shown, "de").column("back"), P.parse_number(F.lit("1,23,4"), "en").code("refused"), F.when(x.isNotNull(), P.number_format(x, "#,##0;(#,##0)")).alias("coded"), P.number_format(c("c_custkey") / 8, "0%").alias("percent"))


def currencies(spark, d):
    rates = {"EUR": 1.0, "USD": 1.25, "JPY": 160.0}
    return table(spark, d, "orders").select("o_orderkey", rounded(P.convert_currency(c("o_totalprice"), "USD", "JPY", rates).column(), "yen", 2), P.convert_currency(1, "USD", "XXX", rates).code("code"))


def heat_bands(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    ends = rows.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return rows.join(F.broadcast(ends)).select("c_custkey", P.band(c("c_acctbal"), c("lo"), c("hi"), 5).alias("band"))


def text_charts(spark, d):
    """A line of the twelve months' orders, and a bar for each month."""
    months = table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = months.agg(F.array_sort(F.collect_list(F.struct("m", "n"))).alias("all"), F.max("n").alias("most"))
    line = P.sparkline(F.transform("all", lambda s: s["n"]))
    return whole.select(F.explode("all").alias("x"), line.alias("line"), "most").select(c("x.m").alias("m"), "line", P.bar(c("x.n") / c("most"), 0.0, 1.0, 40).alias("bar"))


def validation_audit(spark, d):
    rules = {"status": R.allowed("o_orderstatus", ["F", "O"]), "price": R.between("o_totalprice", 5000, 300000), "priority": R.meets("o_orderpriority", "<>1*")}
    return R.audit(table(spark, d, "orders"), "o_orderkey", rules)


def conditional_styles(spark, d):
    rules = [(c("l_quantity") > 45, "bold", True), (R.meets("l_returnflag", "=R"), "red", False), (c("l_discount") > 0.05, "italic", False), (c("l_quantity") < 0, "never", False)]
    return R.style_census(table(spark, d, "lineitem"), rules)


def slicer(spark, d):
    rows = table(spark, d, "orders")
    return R.slicer_state(R.slicer(rows, "o_orderstatus", ["P"]), "o_orderpriority", "o_orderkey", ["5-LOW"])


def outline_levels(spark, d):
    out = R.outline(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", [(1, 50, False), (10, 20, True), (60, 70, False)])
    return out.groupBy("level", "hidden").agg(F.count(F.lit(1)).alias("n"))


def trend_lines(spark, d):
    yearly = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    a = I.trend(yearly, ["o_orderpriority"], "y", "v", [2002, 2003]).withColumn("kind", F.lit("line"))
    b = I.trend(yearly, ["o_orderpriority"], "y", "v", [2002], True).withColumn("kind", F.lit("curve"))
    return a.unionByName(b).select("o_orderpriority", "kind", "x", rounded(c("projected"), "projected", 2))


def mean_intervals(spark, d):
    out = I.mean_interval(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 1.96)
    return out.select("l_returnflag", rounded(c("low"), "low", 3), rounded(c("high"), "high", 3))


def percentile_methods(spark, d):
    rows = table(spark, d, "customer")
    a = I.percentile_exclusive(rows, ["c_nationkey"], "c_acctbal", 0.3).withColumnRenamed("percentile", "exclusive")
    b = I.nearest_rank(rows, ["c_nationkey"], "c_acctbal", 0.3).withColumnRenamed("percentile", "nearest")
    return a.join(b, "c_nationkey").select("c_nationkey", rounded(c("exclusive"), "exclusive"), "nearest")


def one_sample_test(spark, d):
    return I.one_sample(table(spark, d, "customer"), "c_acctbal", 4500.0).select(rounded(c("t"), "t"), c("p").between(0, 1).alias("is_share"))


def monte_carlo(spark, d):
    return I.simulate(spark, lambda a, b: a + b, [(0, 1), (10, 20)], 20_000, 5)


_DRAW = "('0x' || substr(md5(concat_ws(':', 5, {}, id)), 1, 13))::BIGINT / 4503599627370496::DOUBLE"
SQL = {
    "monte_carlo": f"""SELECT avg(y) AS mean, min(y) AS least, max(y) AS greatest, quantile_cont(y, 0.05) AS p5, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.95) AS p95
        FROM (SELECT {_DRAW.format(0)} + 10 + 10 * {_DRAW.format(1)} AS y FROM range(20000) AS t(id))""",
    "number_words": """SELECT c_custkey, ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'][c_custkey % 20 + 1] AS word,
        'one million two hundred three thousand forty-five' AS long_word, 'one dollar and 05/100' AS money, '#VALUE!' AS refused FROM customer""",
    "locale_numbers": """SELECT c_custkey, translate(format('{:,.1f}', floor(c_acctbal)), ',.', '.,') AS german, floor(c_acctbal) AS back, '#VALUE!' AS refused,
        CASE WHEN floor(c_acctbal) < 0 THEN '(' || format('{:,}', (-floor(c_acctbal))::BIGINT) || ')' ELSE format('{:,}', floor(c_acctbal)::BIGINT) END AS coded,
        CASE WHEN c_custkey * 25 % 2 = 1 AND (c_custkey * 25 // 2) % 2 = 0 THEN (c_custkey * 25 // 2)::VARCHAR ELSE round(c_custkey * 12.5)::BIGINT::VARCHAR END || '%' AS percent FROM customer""",
    "currencies": "SELECT o_orderkey, round(o_totalprice / 1.25 * 160, 2) AS yen, '#N/A' AS code FROM orders",
    "heat_bands": "SELECT c_custkey, least(floor((c_acctbal - lo) / (hi - lo) * 5), 4)::INTEGER AS band FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)",
    "text_charts": """WITH n AS (SELECT month(o_orderdate)::INTEGER AS m, count(*)::DOUBLE AS n FROM orders GROUP BY 1), e AS (SELECT min(n) AS lo, max(n) AS hi FROM n)
        SELECT m, (SELECT string_agg(' .:-=+*#'[coalesce(round_even((n - lo) / nullif(hi - lo, 0) * 7, 0), 7)::INTEGER + 1], '' ORDER BY m) FROM n, e) AS line, '|' || repeat('#', floor(n / hi * 40 + 0.5)::INTEGER) AS bar FROM n, e""",
    "validation_audit": """SELECT o_orderkey, 'status' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE o_totalprice NOT BETWEEN 5000 AND 300000
        UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority LIKE '1%'""",
    "conditional_styles": """SELECT 'bold' AS style, count(*) AS n FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'red', count(*) FROM lineitem WHERE l_quantity <= 45 AND l_returnflag = 'R'
        UNION ALL SELECT 'italic', count(*) FROM lineitem WHERE l_quantity <= 45 AND l_discount > 0.05 UNION ALL SELECT 'never', 0""",
    "slicer": "SELECT o_orderpriority AS label, min(o_orderkey) AS first_seen, o_orderpriority <> '5-LOW' AS \"on\" FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "outline_levels": """SELECT CASE WHEN s_suppkey BETWEEN 10 AND 20 THEN 2 WHEN s_suppkey BETWEEN 1 AND 50 OR s_suppkey BETWEEN 60 AND 70 THEN 1 ELSE 0 END AS level, s_suppkey BETWEEN 10 AND 20 AS hidden, count(*) AS n FROM supplier GROUP BY 1, 2""",
    "trend_lines": """WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), f AS (SELECT o_orderpriority, regr_slope(v, y) AS s, regr_intercept(v, y) AS i, regr_slope(ln(v), y) AS es, regr_intercept(ln(v), y) AS ei FROM y GROUP BY 1)
        SELECT o_orderpriority, 'line' AS kind, x.x::DOUBLE AS x, round(s * x.x + i, 2) AS projected FROM f, (VALUES (2002), (2003)) AS x(x) UNION ALL SELECT o_orderpriority, 'curve', 2002, round(exp(es * 2002 + ei), 2) FROM f""",
    "mean_intervals": """SELECT l_returnflag, round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 3) AS low, round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 3) AS high FROM lineitem GROUP BY 1""",
    "percentile_methods": """SELECT c_nationkey, round(CASE WHEN p < 1 OR p > n THEN NULL ELSE v[floor(p)::INTEGER] + (p - floor(p)) * (coalesce(v[floor(p)::INTEGER + 1], v[floor(p)::INTEGER]) - v[floor(p)::INTEGER]) END, 4) AS exclusive, v[ceil(round(0.3 * n, 9))::INTEGER] AS nearest
        FROM (SELECT c_nationkey, list_sort(list(c_acctbal)) AS v, count(*) AS n, 0.3 * (count(*) + 1) AS p FROM customer GROUP BY 1)""",
    "one_sample_test": "SELECT round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), 4) AS t, true AS is_share FROM customer",
}
QUERIES = {name: globals()[name] for name in SQL}
