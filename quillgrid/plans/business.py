"""Schedules, statements, graphs, grids, vectors and text files over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import business as B
from ..operators import cells as G
from ..operators import graph as R
from ..session import shared_base
from ..sources import text_files as X
from .common import rounded, table

c = F.col


def allocation(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("w"), F.lit(1000).alias("whole"))
    return B.allocate(rows, ["o_custkey"], "whole", "w", "o_orderkey").select("o_orderkey", "allocated")


def amortization(spark, d):
    loans = table(spark, d, "customer").select("c_custkey", (F.floor(F.abs("c_acctbal")) + 100).alias("loan"))
    return B.amortize(loans, "loan", 0.01, 12)


def depreciation(spark, d):
    assets = table(spark, d, "part").select("p_partkey", c("p_retailprice").alias("cost"), (c("p_retailprice") / 10).alias("salvage"))
    out = None
    for method in ("straight", "digits", "declining"):
        one = B.depreciate(assets, "cost", "salvage", 5, method).select("p_partkey", F.lit(method).alias("method"), "year", rounded(c("charge"), "charge"), rounded(c("book"), "book"))
        out = one if out is None else out.unionByName(one)
    return out


def cash_flows(spark, d):
    yearly = _yearly(spark, d)
    out = B.cashflow(yearly, ["o_orderpriority"], "period", "flow", 0.05)
    return out.select("o_orderpriority", "period", rounded(c("discounted"), "discounted", 2), rounded(c("cumulative"), "cumulative", 2), "payback")


def _yearly(spark, d):
    sums = table(spark, d, "orders").groupBy("o_orderpriority", (F.year("o_orderdate") - 1995).alias("period")).agg(F.sum("o_totalprice").alias("t"))
    return sums.select("o_orderpriority", "period", F.when(c("period") == 0, -3 * c("t")).otherwise(c("t")).alias("flow"))


def _section():
    return F.element_at(F.array(*[F.lit(x) for x in ("revenue", "revenue", "cogs", "operating", "other")]), (c("l_linenumber") % 5 + 1).cast("int"))


def income_statement(spark, d):
    out = B.income_statement(table(spark, d, "lineitem"), ["l_returnflag"], _section(), "l_extendedprice")
    return out.select("l_returnflag", *[rounded(c(x), x, 2) for x in ("revenue", "cogs", "gross_profit", "operating_income", "net_income")], rounded(c("gross_margin"), "gross_margin", 6))


def balance_sheet(spark, d):
    names = ("current_assets", "longterm_assets", "current_liabilities", "longterm_liabilities", "equity")
    section = F.element_at(F.array(*[F.lit(x) for x in names]), (c("l_linenumber") % 5 + 1).cast("int"))
    out = B.balance_sheet(table(spark, d, "lineitem"), ["l_linestatus"], section, "l_extendedprice")
    return out.select("l_linestatus", rounded(c("assets"), "assets", 2), rounded(c("liabilities"), "liabilities", 2), rounded(c("imbalance"), "imbalance", 2), rounded(c("current_ratio"), "current_ratio", 6), rounded(c("working_capital"), "working_capital", 2))


def budget_variance(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.lit(4500.0).alias("budget"), c("s_acctbal").alias("actual"))
    return B.variance_lines(rows, "budget", "actual", c("s_suppkey") % 2 == 0).select("s_suppkey", rounded(c("variance"), "variance", 2), rounded(c("variance_share"), "variance_share"), "verdict")


def unit_prices(spark, d):
    out = B.unit_prices(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size", "p_partkey")
    return out.select("p_partkey", rounded(c("unit_price"), "unit_price", 6), "place", rounded(c("saving"), "saving", 6))


def grade_book(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", (c("event_id") % 101).cast("double").alias("score"))
    out = B.grades(rows, "user_id", "event_type", "score", {"purchase": 0.5, "view": 0.2, "click": 0.3}, 1)
    return out.select("user_id", "percentage", "letter", "error")


def pay_run(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") + 500).alias("gross"), F.lit(100.0).alias("pre"), F.lit(50.0).alias("post"))
    out = B.paystubs(rows, "gross", "pre", "post", [(0.0, 0.1), (1000.0, 0.2)])
    return out.select("s_suppkey", rounded(c("taxable"), "taxable", 2), rounded(c("tax") + c("net"), "rest", 2))


def installment_plan(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.floor(F.abs("s_acctbal")).alias("owed"))
    return B.installments(rows, "owed", 7).groupBy("s_suppkey").agg(rounded(F.sum("payment"), "total", 2), rounded(F.max("payment") - F.min("payment"), "spread", 2))


def _tree(spark, d):
    """Each order waits for the orders with half its rank and a third of it: a deep, wide graph."""
    keys = table(spark, d, "supplier").select(c("s_suppkey").alias("k"))
    return keys.filter("k > 1").select(F.floor(c("k") / 2).alias("src"), c("k").alias("dst")).unionByName(keys.filter("k > 3").select(F.floor(c("k") / 3).alias("src"), c("k").alias("dst")))


def dependency_levels(spark, d):
    return R.levels(_tree(spark, d))


def edit_cone(spark, d):
    return R.reach(_tree(spark, d), spark.createDataFrame([(7,)], "node long"))


def critical_path(spark, d):
    tasks = table(spark, d, "supplier").select(c("s_suppkey").alias("task"), (c("s_suppkey") % 7 + 1).cast("double").alias("duration"))
    return R.critical_path(tasks, _tree(spark, d)).select("task", "start", "finish", "slack", (c("slack") == 0).alias("critical"))


def snapshot_diff(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    later = rows.filter("c_custkey % 50 <> 0").withColumn("c_name", F.when(c("c_custkey") % 7 == 0, F.lit(None)).otherwise(c("c_name"))).withColumn("c_nationkey", F.when(c("c_custkey") % 9 == 0, c("c_nationkey") + 1).otherwise(c("c_nationkey")))
    return G.snapshot_diff(G.to_cells(rows, "c_custkey"), G.to_cells(later, "c_custkey")).groupBy("kind", "column").agg(F.count(F.lit(1)).alias("n"))


def range_total(spark, d):
    cells = G.to_cells(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name"), "p_partkey")
    out = G.range_fold(cells, 100, 0, 1500, 1)
    return out.select(rounded(c("total"), "total", 2), "n", "least", "greatest")


def what_if(spark, d):
    rows = table(spark, d, "region").select("r_regionkey", (c("r_regionkey") * 1000 + 1000).cast("double").alias("base"))
    net = {"net": c("base") * (1 - c("discount")) * (1 + c("tax"))}
    a = G.data_table(rows, {"discount": [0, 0.1, 0.2], "tax": [0.05, 0.07]}, net).select("r_regionkey", F.lit("table").alias("scenario"), rounded(c("net"), "net"))
    b = G.scenarios(rows, {"low": {"discount": 0.3, "tax": 0.05}, "high": {"discount": 0.0, "tax": 0.1}}, net).select("r_regionkey", "scenario", rounded(c("net"), "net"))
    return a.unionByName(b)


def goal_seek(spark, d):
    goal = c("c_acctbal") * c("c_acctbal") + 8
    x = G.goal_seek(lambda v: v * v * v, goal, 0.0, 1e6)
    return table(spark, d, "customer").select("c_custkey", x.alias("root"))


def vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("v"))
    return rows.select("vec_id", rounded(A.norm(c("v")), "length", 5), rounded(A.dot(c("v"), F.reverse("v")), "with_reverse", 5), rounded(A.angle_between(c("v"), F.transform("v", lambda x: -x)), "angle", 5))


def gram_matrix(spark, d):
    """X'X of all vectors: outer products added in each task, then between tasks."""
    rows = table(spark, d, "embeddings").select(F.posexplode(c("embedding").cast("array<double>")).alias("i", "x"), c("embedding").cast("array<double>").alias("v"))
    cells = rows.groupBy("i").agg(*[F.sum(c("x") * F.get("v", F.lit(j))).alias(f"j{j}") for j in range(8)])
    return cells.select("i", *[rounded(c(f"j{j}"), f"j{j}", 5) for j in range(8)])


def polygons(spark, d):
    x, y = c("p_size").cast("double"), (c("p_partkey") % 13 + 1).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    zero = F.lit(0.0)
    shape = F.array(point(zero, zero), point(x, zero), point(x, y), point(zero, y))
    return table(spark, d, "part").select("p_partkey", A.signed_area(shape).alias("area"), A.orientation(F.reverse(shape)).alias("turned"), A.point_in_polygon(F.lit(5.0), F.lit(5.0), shape).alias("inside"), rounded(A.distance(zero, zero, x, y), "diagonal"))


def matrices(spark, d):
    a, b = c("p_size").cast("double"), (c("p_partkey") % 7).cast("double")
    m = F.array(F.array(a, b), F.array(b, a))
    return table(spark, d, "part").select("p_partkey", rounded(A.determinant(m), "det"), rounded(A.trace(A.multiply(m, m)), "trace_squared"), A.inverse(m).isNull().alias("singular"), rounded(A.trace(A.add(A.scale(m, 2.0), A.identity(2))), "trace_sum"))


def probabilities(spark, d):
    k = c("p_size") % 10
    return table(spark, d, "part").select("p_partkey", rounded(A.binomial_pmf(k, F.lit(10), 0.3), "binomial", 8), rounded(A.poisson_pmf(k, 2.5), "poisson", 8), rounded(A.poly_eval([1.0, 2.0, 3.0], k.cast("double")), "poly"))


def csv_round_trip(spark, d):
    """The table written as CSV and read back as text, its cells inferred again."""
    path = f"{shared_base(spark, 'spark-csv-')}/csv-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.lpad(c("c_nationkey").cast("string"), 5, "0").alias("code"), (c("c_custkey") % 2 == 0).alias("even"), F.concat(F.lit('a "quoted", '), c("c_mktsegment")).alias("note"))
    X.write_csv(rows, path)
    back = X.infer_columns(X.read_csv(spark, path))
    return back.select(c("c_custkey.num").alias("custkey"), c("c_name.txt").alias("name"), c("code.txt").alias("code"), c("even.bool").alias("even"), c("note.txt").alias("note"))


def markdown(spark, d):
    text = X.to_markdown(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "n int, line string")


def json_records(spark, d):
    return X.records(table(spark, d, "nation").select("n_nationkey", "n_name"))


_TREE = "(SELECT s_suppkey // 2 AS src, s_suppkey AS dst FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey // 3, s_suppkey FROM supplier WHERE s_suppkey > 3)"
_SECTIONS = lambda *names: "[" + ", ".join(f"'{n}'" for n in names) + "][l_linenumber % 5 + 1]"
_IS = _SECTIONS("revenue", "revenue", "cogs", "operating", "other")
_BS = _SECTIONS("current_assets", "longterm_assets", "current_liabilities", "longterm_liabilities", "equity")
SQL = {
    "allocation": """SELECT o_orderkey, CAST(f + CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY e - f DESC, o_orderkey) <= 1000 - sum(f) OVER (PARTITION BY o_custkey) THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM (
        SELECT o_orderkey, o_custkey, e, floor(e) AS f FROM (SELECT o_orderkey, o_custkey, 1000 * floor(o_totalprice) / sum(floor(o_totalprice)) OVER (PARTITION BY o_custkey) AS e FROM orders))""",
    "depreciation": """WITH a AS (SELECT p_partkey, p_retailprice AS c, p_retailprice / 10 AS s, y.y::INTEGER AS y FROM part, range(1, 6) AS y(y))
        SELECT p_partkey, 'straight' AS method, y AS year, round((c - s) / 5, 4) AS charge, round(c - (c - s) / 5 * y, 4) AS book FROM a
        UNION ALL SELECT p_partkey, 'digits', y, round((c - s) * (6 - y) / 15, 4), round(c - (c - s) * (y * 6 - y * (y + 1) / 2) / 15, 4) FROM a
        UNION ALL SELECT p_partkey, 'declining', y, round(greatest(c * pow(0.6, y - 1), s) - greatest(c * pow(0.6, y), s), 4), round(greatest(c * pow(0.6, y), s), 4) FROM a""",
    "cash_flows": """WITH y AS (SELECT o_orderpriority, CAST(year(o_orderdate) - 1995 AS INTEGER) AS period, sum(o_totalprice) * CASE WHEN year(o_orderdate) = 1995 THEN -3 ELSE 1 END AS flow FROM orders GROUP BY o_orderpriority, year(o_orderdate)),
        q AS (SELECT *, flow / pow(1.05, period) AS dis, sum(flow / pow(1.05, period)) OVER (PARTITION BY o_orderpriority ORDER BY period) AS cum FROM y)
        SELECT o_orderpriority, period, round(dis, 2) AS discounted, round(cum, 2) AS cumulative, min(CASE WHEN cum >= 0 THEN period END) OVER (PARTITION BY o_orderpriority) AS payback FROM q""",
    "income_statement": f"""SELECT l_returnflag, round(r, 2) AS revenue, round(g, 2) AS cogs, round(r - g, 2) AS gross_profit, round(r - g - o, 2) AS operating_income, round(r - g - o + x, 2) AS net_income, round((r - g) / r, 6) AS gross_margin FROM (
        SELECT l_returnflag, sum(v) FILTER (WHERE s = 'revenue') AS r, sum(v) FILTER (WHERE s = 'cogs') AS g, sum(v) FILTER (WHERE s = 'operating') AS o, sum(v) FILTER (WHERE s = 'other') AS x FROM (SELECT l_returnflag, l_extendedprice AS v, {_IS} AS s FROM lineitem) GROUP BY 1)""",
    "balance_sheet": f"""SELECT l_linestatus, round(a + b, 2) AS assets, round(e + f, 2) AS liabilities, round(a + b - e - f - q, 2) AS imbalance, round(a / e, 6) AS current_ratio, round(a - e, 2) AS working_capital FROM (
        SELECT l_linestatus, sum(v) FILTER (WHERE s = 'current_assets') AS a, sum(v) FILTER (WHERE s = 'longterm_assets') AS b, sum(v) FILTER (WHERE s = 'current_liabilities') AS e, sum(v) FILTER (WHERE s = 'longterm_liabilities') AS f,
        sum(v) FILTER (WHERE s = 'equity') AS q FROM (SELECT l_linestatus, l_extendedprice AS v, {_BS} AS s FROM lineitem) GROUP BY 1)""",
    "budget_variance": """SELECT s_suppkey, round(v, 2) AS variance, round(v / 4500, 4) AS variance_share, CASE WHEN v = 0 THEN 'on budget' WHEN (s_suppkey % 2 = 0 AND v < 0) OR (s_suppkey % 2 = 1 AND v > 0) THEN 'favourable' ELSE 'unfavourable' END AS verdict
        FROM (SELECT s_suppkey, s_acctbal - 4500 AS v FROM supplier)""",
    "unit_prices": """SELECT p_partkey, round(u, 6) AS unit_price, row_number() OVER (PARTITION BY p_brand ORDER BY u, p_partkey)::INTEGER AS place, round((max(u) OVER (PARTITION BY p_brand) - min(u) OVER (PARTITION BY p_brand)) / max(u) OVER (PARTITION BY p_brand), 6) AS saving
        FROM (SELECT *, p_retailprice / p_size AS u FROM part)""",
    "grade_book": """SELECT user_id, p AS percentage, CASE WHEN p >= 90 THEN 'A' WHEN p >= 80 THEN 'B' WHEN p >= 70 THEN 'C' WHEN p >= 60 THEN 'D' WHEN p IS NOT NULL THEN 'F' END AS letter, CASE WHEN p IS NULL THEN '#VALUE!' END AS error
        FROM (SELECT user_id, CASE WHEN min(n) > 1 THEN sum(m * w) / sum(w) END AS p FROM (
        SELECT user_id, event_type, any_value(n) AS n, avg(s) FILTER (WHERE r > 1) AS m, (CASE event_type WHEN 'purchase' THEN 0.5 WHEN 'view' THEN 0.2 ELSE 0.3 END)::DOUBLE AS w FROM (
        SELECT user_id, event_type, event_id % 101 AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 101) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WHERE event_type IN ('purchase', 'view', 'click')) GROUP BY 1, 2) GROUP BY 1)""",
    "pay_run": "SELECT s_suppkey, round(abs(s_acctbal) + 400, 2) AS taxable, round(abs(s_acctbal) + 350, 2) AS rest FROM supplier",
    "installment_plan": "SELECT s_suppkey, round(floor(abs(s_acctbal)), 2) AS total, CASE WHEN (floor(abs(s_acctbal)) * 100)::BIGINT % 7 = 0 THEN 0 ELSE 0.01 END::DOUBLE AS spread FROM supplier",
    "dependency_levels": f"""WITH RECURSIVE p(node, n) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey = 1 UNION SELECT e.dst, p.n + 1 FROM p JOIN {_TREE} e ON e.src = p.node) SELECT node, max(n)::INTEGER AS level FROM p GROUP BY 1""",
    "edit_cone": f"WITH RECURSIVE p(node) AS (SELECT 7::BIGINT UNION SELECT e.dst FROM p JOIN {_TREE} e ON e.src = p.node) SELECT node FROM p",
    "critical_path": f"""WITH RECURSIVE p(node, t) AS (SELECT s_suppkey, 0::DOUBLE FROM supplier WHERE s_suppkey <= 1 UNION SELECT e.dst, p.t + (e.src % 7 + 1)::DOUBLE FROM p JOIN {_TREE} e ON e.src = p.node)
        , b(node, t) AS (SELECT s_suppkey, 0::DOUBLE FROM supplier UNION SELECT e.src, b.t + (e.dst % 7 + 1)::DOUBLE FROM b JOIN {_TREE} e ON e.dst = b.node),
        s AS (SELECT node AS task, max(t) AS start, max(t) + node % 7 + 1 AS finish FROM p GROUP BY node), r AS (SELECT node AS task, max(t) AS after FROM b GROUP BY node)
        SELECT task, start, finish, (SELECT max(finish) FROM s) - finish - after AS slack, (SELECT max(finish) FROM s) = finish + after AS critical FROM s JOIN r USING (task)""",
    "snapshot_diff": """SELECT CASE WHEN gone OR (col = 0 AND c_custkey % 7 = 0) THEN 'removed' ELSE 'changed' END AS kind, col AS column, count(*) AS n FROM (SELECT c_custkey, c_custkey % 50 = 0 AS gone, c.c::INTEGER AS col FROM customer, range(0, 3) AS c(c))
        WHERE gone OR (col = 0 AND c_custkey % 7 = 0) OR (col = 1 AND c_custkey % 9 = 0) GROUP BY 1, 2""",
    "range_total": "SELECT round(sum(p_size) + sum(p_retailprice), 2) AS total, 2 * count(*) AS n, least(min(p_size), min(p_retailprice)) AS least, greatest(max(p_size), max(p_retailprice)) AS greatest FROM part WHERE p_partkey BETWEEN 100 AND 1500",
    "what_if": """SELECT r_regionkey, 'table' AS scenario, round((r_regionkey * 1000 + 1000)::DOUBLE * (1 - d.d) * (1 + t.t), 4) AS net FROM region, (VALUES (0), (0.1), (0.2)) AS d(d), (VALUES (0.05), (0.07)) AS t(t)
        UNION ALL SELECT r_regionkey, s.n, round((r_regionkey * 1000 + 1000)::DOUBLE * (1 - s.d) * (1 + s.t), 4) FROM region, (VALUES ('low', 0.3, 0.05), ('high', 0.0, 0.1)) AS s(n, d, t)""",
    "goal_seek": "SELECT c_custkey, cbrt(c_acctbal * c_acctbal + 8) AS root FROM customer",
    "amortization": """WITH RECURSIVE l AS (SELECT c_custkey, (floor(abs(c_acctbal)) + 100)::DOUBLE AS loan FROM customer),
        a(c_custkey, loan, pay, number, payment, interest, principal_part, balance) AS (
        SELECT c_custkey, loan, round_even(loan * 0.01::DOUBLE / (1 - pow(1.01::DOUBLE, -12)) * 100, 0) / 100, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, loan FROM l
        UNION ALL SELECT c_custkey, loan, pay, number + 1, part + i, i, part, round_even((balance - part) * 100, 0) / 100 FROM (
        SELECT *, CASE WHEN number + 1 = 12 THEN balance ELSE round_even((pay - i) * 100, 0) / 100 END AS part FROM (SELECT *, round_even(balance * 0.01::DOUBLE * 100, 0) / 100 AS i FROM a WHERE number < 12)))
        SELECT c_custkey, loan::BIGINT AS loan, number, payment, interest, principal_part, balance FROM a WHERE number > 0""",
    "vectors": """SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS length, round(list_dot_product(v, list_reverse(v)), 5) AS with_reverse, round(pi(), 5) AS angle FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
    "gram_matrix": "SELECT CAST(i - 1 AS INTEGER) AS i, " + ", ".join(f"round(sum(v[i] * v[{j + 1}]), 5) AS j{j}" for j in range(8)) + " FROM (SELECT embedding::DOUBLE[] AS v FROM embeddings), range(1, 65) AS r(i) GROUP BY 1",
    "polygons": "SELECT p_partkey, (p_size * (p_partkey % 13 + 1))::DOUBLE AS area, 'clockwise' AS turned, p_size >= 5 AND p_partkey % 13 + 1 >= 5 AS inside, round(sqrt(pow(p_size, 2) + pow(p_partkey % 13 + 1, 2)), 4) AS diagonal FROM part",
    "matrices": """SELECT p_partkey, round(a * a - b * b, 4) AS det, round(2 * (a * a + b * b), 4) AS trace_squared, a = b AS singular, round(4 * a + 2, 4) AS trace_sum FROM (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 7)::DOUBLE AS b FROM part)""",
    "probabilities": """SELECT p_partkey, round(factorial(10) / factorial(k) / factorial(10 - k) * pow(0.3, k) * pow(0.7, 10 - k), 8) AS binomial, round(exp(-2.5) * pow(2.5, k) / factorial(k), 8) AS poisson, round(1 + 2 * k + 3 * k * k, 4)::DOUBLE AS poly
        FROM (SELECT p_partkey, p_size % 10 AS k FROM part)""",
    "csv_round_trip": """SELECT c_custkey::DOUBLE AS custkey, c_name AS name, lpad(c_nationkey::VARCHAR, 5, '0') AS code, c_custkey % 2 = 0 AS even, 'a "quoted", ' || c_mktsegment AS note FROM customer""",
    "markdown": """SELECT 0 AS n, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '| ---: | --- |' UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS INTEGER), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region""",
    "json_records": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS record FROM nation""",
}
QUERIES = {name: globals()[name] for name in SQL}
