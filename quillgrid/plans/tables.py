"""Pivots, lookups, set operations, deduplication, sorts and reshaping over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import tables as T
from .common import rounded, table

c = F.col


def pivot_margins(spark, d):
    out = T.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "AVERAGE", "l_linestatus")
    return out.select("row_label", "column_label", rounded(c("value"), "value"), "level")


def pivot_sum(spark, d):
    out = T.pivot(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "SUM")
    return out.select("row_label", rounded(c("value"), "value", 2), "level")


def pivot_wide(spark, d):
    out = T.pivot_wide(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "SUM", ["F", "O"])
    return out.select("l_returnflag", rounded(c("F"), "f", 2), rounded(c("O"), "o", 2))


def crosstab_count(spark, d):
    return T.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


def crosstab_sum(spark, d):
    out = T.crosstab(table(spark, d, "events").withColumn("v", F.when(c("event_id") % 10 == 0, "n/a").otherwise(c("value").cast("string"))), "event_type", "user_id", "v")
    return out.select("event_type", "user_id", rounded(c("total"), "total", 2), "excluded", "margin")


def consolidate_regions(spark, d):
    a = table(spark, d, "customer").select(c("c_nationkey").alias("label"), c("c_acctbal").alias("value"))
    b = table(spark, d, "supplier").select(c("s_nationkey").alias("label"), c("s_acctbal").alias("value"))
    out = T.consolidate([a, b], "label", "value", "SUM")
    return out.select("label", rounded(c("value"), "value", 2), "first_seen")


def vlookup_exact(spark, d):
    left = table(spark, d, "orders").select("o_orderkey", (c("o_custkey") * 2).alias("k"))
    out = T.lookup(left, table(spark, d, "customer"), "k", "c_custkey", ["c_name", "c_acctbal"], order="c_custkey")
    return out.withColumn("code", F.when(~c("found"), "#N/A"))


def xlookup_first_last(spark, d):
    left = table(spark, d, "customer").select("c_custkey")
    right = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    first = T.lookup(left, right, "c_custkey", "o_custkey", ["o_orderkey"], "first", "o_orderkey").withColumnRenamed("o_orderkey", "first_order").drop("found")
    return T.lookup(first, right, "c_custkey", "o_custkey", ["o_orderkey", "o_totalprice"], "last", "o_orderkey").withColumnRenamed("o_orderkey", "last_order")


def xlookup_fold_case(spark, d):
    left = table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("k"))
    return T.lookup(left, table(spark, d, "nation").select("n_name", "n_regionkey"), "k", "n_name", ["n_regionkey"], fold_case=True, order="n_regionkey")


def stairs_lookup(spark, d):
    return T.lookup_stairs(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", [(10_000.0, "small"), (100_000.0, "middle"), (250_000.0, "large")], "tier")


def as_of_join(spark, d):
    events = table(spark, d, "events")
    buys = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("paid"))
    return T.as_of(events.select("event_id", "user_id", "ts"), buys, "ts", "ts", "paid", ["user_id"]).drop("ts")


def set_union(spark, d):
    a, b = _keys(spark, d)
    return T.union(a, b, "key", "ord").select("key", "side")


def _keys(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal < 5000").select(c("c_nationkey").alias("key"), c("c_custkey").alias("ord"))
    b = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(c("s_nationkey").alias("key"), c("s_suppkey").alias("ord"))
    return a, b


def set_intersection(spark, d):
    return T.intersection(*_keys(spark, d), "key", "ord")


def set_difference(spark, d):
    return T.difference(*_keys(spark, d), "key", "ord")


def unique_first_seen(spark, d):
    return T.unique(table(spark, d, "orders"), "o_custkey", "o_orderkey")


def dedup_first(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return T.dedup(rows, ["o_custkey", "o_orderpriority"], ["o_orderkey"])


def column_profile(spark, d):
    out = T.profile(table(spark, d, "orders"), "o_totalprice")
    return out.select("filled", "empty", "distinct_values", "least", "greatest", rounded(c("mean"), "mean"))


def fuzzy_best_match(spark, d):
    left = table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit("S")).alias("label"))
    return T.best_match(left, table(spark, d, "customer"), "label", "c_mktsegment", 0.5).select("needle", "match", rounded(c("similarity"), "similarity"))


def table_totals(spark, d):
    out = T.totals(table(spark, d, "lineitem"), {"l_quantity": "SUM", "l_discount": "MAX", "l_tax": "AVERAGE", "l_partkey": "COUNT"})
    return out.select(rounded(c("l_quantity"), "l_quantity", 2), "l_discount", rounded(c("l_tax"), "l_tax", 6), "l_partkey")


def transpose_small(spark, d):
    rows = table(spark, d, "region").select(c("r_name").alias("k"), c("r_regionkey").cast("double").alias("number"), F.length("r_name").cast("double").alias("letters"))
    out = T.transpose(rows, "k", ["number", "letters"])
    return out.select("column", *[c(x).alias(x.lower().replace(" ", "_")) for x in out.columns if x != "column"])


def filter_view(spark, d):
    out = T.visible(table(spark, d, "lineitem"), c("l_returnflag") == "R", "l_extendedprice")
    return out.select("shown", "hidden", rounded(c("shown_sum"), "shown_sum", 2), rounded(c("whole_sum"), "whole_sum", 2))


def top_of_groups(spark, d):
    return O.top(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", 5, ["o_orderpriority"], tie="o_orderkey")


def top_of_all(spark, d):
    return O.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, tie="o_orderkey")


def take_last(spark, d):
    return O.take(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [c("o_orderkey")], -30)


def drop_first(spark, d):
    return O.drop(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [c("o_totalprice"), c("o_orderkey")], 1000)


def choose_rows(spark, d):
    return O.choose_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [c("o_orderkey")], [3, 1, 1, 1200])


SQL = {
    "pivot_margins": """SELECT l_returnflag AS row_label, l_linestatus AS column_label, round(avg(l_extendedprice), 4) AS value,
        ['cell', 'row', 'column', 'grand'][grouping(l_returnflag, l_linestatus)::INTEGER + 1] AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "pivot_sum": "SELECT o_orderpriority AS row_label, round(sum(o_totalprice), 2) AS value, CASE WHEN grouping(o_orderpriority) = 1 THEN 'grand' ELSE 'row' END AS level FROM orders GROUP BY ROLLUP (o_orderpriority)",
    "pivot_wide": "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS f, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS o FROM lineitem GROUP BY 1",
    "crosstab_count": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS margin FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "crosstab_sum": """SELECT event_type, user_id, round(coalesce(sum(value) FILTER (WHERE event_id % 10 <> 0), 0), 2) AS total, count(*) FILTER (WHERE event_id % 10 = 0) AS excluded,
        grouping(event_type, user_id)::BIGINT AS margin FROM events GROUP BY CUBE (event_type, user_id)""",
    "consolidate_regions": """SELECT label, round(sum(v), 2) AS value, min(r)::INTEGER AS first_seen FROM (SELECT c_nationkey AS label, c_acctbal AS v, 0 AS r FROM customer
        UNION ALL SELECT s_nationkey, s_acctbal, 1 FROM supplier) GROUP BY 1""",
    "vlookup_exact": "SELECT o_orderkey, o_custkey * 2 AS k, c_name, c_acctbal, c_custkey IS NOT NULL AS found, CASE WHEN c_custkey IS NULL THEN '#N/A' END AS code FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2",
    "xlookup_first_last": """SELECT c_custkey, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order, arg_max(o_totalprice, o_orderkey) AS o_totalprice, count(o_orderkey) > 0 AS found
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "xlookup_fold_case": "SELECT n_nationkey, lower(n_name) AS k, n_regionkey, true AS found FROM nation",
    "stairs_lookup": """SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice >= 250000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'middle' WHEN o_totalprice >= 10000 THEN 'small' END AS tier FROM orders""",
    "as_of_join": """SELECT e.event_id, e.user_id, b.paid FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b
        ON e.user_id = b.user_id AND e.ts >= b.ts""",
    "set_union": "SELECT key, min(side)::INTEGER AS side FROM (SELECT c_nationkey AS key, 0 AS side FROM customer WHERE c_acctbal < 5000 UNION ALL SELECT s_nationkey, 1 FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY 1",
    "set_intersection": "SELECT c_nationkey AS key, min(c_custkey) AS first_seen FROM customer WHERE c_acctbal < 5000 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY 1",
    "set_difference": "SELECT c_nationkey AS key, min(c_custkey) AS first_seen FROM customer WHERE c_acctbal < 5000 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY 1",
    "unique_first_seen": "SELECT o_custkey AS key, min(o_orderkey) AS first_seen FROM orders GROUP BY 1",
    "dedup_first": "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1",
    "column_profile": "SELECT count(o_totalprice) AS filled, count(*) - count(o_totalprice) AS empty, count(DISTINCT o_totalprice) AS distinct_values, min(o_totalprice) AS least, max(o_totalprice) AS greatest, round(avg(o_totalprice), 4) AS mean FROM orders",
    "fuzzy_best_match": """SELECT needle, CASE WHEN s >= 0.5 THEN cand END AS match, round(s, 4) AS similarity FROM (
        SELECT needle, cand, 1 - levenshtein(upper(needle), upper(cand)) / greatest(length(needle), length(cand)) AS s FROM (SELECT DISTINCT c_mktsegment || 'S' AS needle FROM customer), (SELECT DISTINCT c_mktsegment AS cand FROM customer))
        QUALIFY row_number() OVER (PARTITION BY needle ORDER BY s DESC, cand) = 1""",
    "table_totals": "SELECT round(sum(l_quantity), 2) AS l_quantity, max(l_discount) AS l_discount, round(avg(l_tax), 6) AS l_tax, count(*)::DOUBLE AS l_partkey FROM lineitem",
    "transpose_small": """SELECT 'number' AS column, max(r_regionkey) FILTER (WHERE r_name = 'AFRICA')::DOUBLE AS africa, max(r_regionkey) FILTER (WHERE r_name = 'AMERICA')::DOUBLE AS america, max(r_regionkey) FILTER (WHERE r_name = 'ASIA')::DOUBLE AS asia,
        max(r_regionkey) FILTER (WHERE r_name = 'EUROPE')::DOUBLE AS europe, max(r_regionkey) FILTER (WHERE r_name = 'MIDDLE EAST')::DOUBLE AS middle_east FROM region
        UNION ALL SELECT 'letters', 6, 7, 4, 6, 11""",
    "filter_view": """SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS shown, count(*) FILTER (WHERE l_returnflag <> 'R') AS hidden, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 2) AS shown_sum,
        round(sum(l_extendedprice), 2) AS whole_sum FROM lineitem""",
    "top_of_groups": "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 5",
    "top_of_all": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "take_last": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 30",
    "drop_first": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 1000",
    "choose_rows": "SELECT o_orderkey, o_totalprice, p.place::INTEGER AS place FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) JOIN (VALUES (1, 3), (2, 1), (3, 1), (4, 1200)) AS p(place, n) USING (n)",
}
QUERIES = {name: globals()[name] for name in SQL}
