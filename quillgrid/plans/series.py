"""Ranks, windows, shares, seasons, runs, intervals, bins and costing over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import series as S
from .common import rounded, table

c = F.col


def rank_methods(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("v"))
    for method, down in (("standard", False), ("dense", True), ("ordinal", False)):
        rows = O.rank(rows, "v", method, method, down, tie="c_custkey")
    return rows


def rank_in_groups(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.floor("c_acctbal").alias("v"))
    rows = O.rank(rows, "v", "standard_rank", "standard", True, ["c_nationkey"])
    return O.rank(rows, "v", "dense_rank", "dense", True, ["c_nationkey"])


def running_total(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = O.cumulative(rows, [c("o_orderdate"), c("o_orderkey")], "o_totalprice", "running")
    return out.select("o_orderkey", rounded(c("running"), "running", 2))


def running_by_group(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(c("event_id") % 7 != 0, c("value")).alias("v"))
    return O.cumulative(rows, [c("ts"), c("event_id")], "v", "running", ["user_id"]).select("event_id", rounded(c("running"), "running", 3))


def moving_windows(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(c("event_id") % 11 != 0, c("value")).alias("v"))
    order = [c("ts"), c("event_id")]
    rows = O.moving(rows, order, "v", 3, "mean_3", "avg", ["user_id"])
    rows = O.moving(rows, order, "v", 5, "sum_5", "sum", ["user_id"])
    return rows.select("event_id", rounded(c("mean_3"), "mean_3", 3), rounded(c("sum_5"), "sum_5", 3))


def moving_whole_table(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return O.moving(rows, [c("o_orderkey")], "o_totalprice", 7, "mean_7").select("o_orderkey", rounded(c("mean_7"), "mean_7", 3))


def changes(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = O.period_change(rows, [c("ts"), c("event_id")], "value", ["user_id"])
    return out.select("event_id", rounded(c("change"), "change"), rounded(c("change_pct"), "change_pct", 3))


def growth_rates(spark, d):
    yearly = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("total"))
    out = S.growth(yearly, "y", "total", ["o_orderpriority"])
    return out.select("o_orderpriority", "periods", rounded(c("total_growth"), "total_growth", 6), rounded(c("cagr"), "cagr", 6))


def pareto(spark, d):
    out = S.pareto(table(spark, d, "lineitem").select(c("l_suppkey").alias("k"), "l_extendedprice"), "k", "l_extendedprice")
    return out.select("k", rounded(c("value"), "value", 2), rounded(c("share"), "share", 8), rounded(c("cumulative"), "cumulative", 6), "vital")


def abc_classes(spark, d):
    out = S.abc(table(spark, d, "lineitem").select(c("l_suppkey").alias("k"), "l_extendedprice"), "k", "l_extendedprice")
    return out.select("k", "abc_class")


def waterfall(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", (c("value") - 50).alias("delta"))
    out = S.waterfall(rows, [c("ts"), c("event_id")], "delta", 100.0, ["user_id"])
    return out.select("event_id", rounded(c("base"), "base", 3), rounded(c("top"), "top", 3), "direction")


def seasonal_indices(spark, d):
    out = S.seasonal_indices(table(spark, d, "orders"), F.month("o_orderdate"), "o_totalprice")
    return out.select("season", rounded(c("season_index"), "season_index", 6))


def run_length(spark, d):
    return S.runs(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


def runs_expanded(spark, d):
    runs = S.runs(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return S.expand_runs(runs, "value", "length").groupBy("user_id", "value").agg(F.count(F.lit(1)).alias("n"))


def _intervals(spark, d):
    day = F.datediff(c("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", day.alias("s"), (day + c("o_orderkey") % 60 + 1).alias("e"))


def intervals_merge(spark, d):
    return S.merge_intervals(_intervals(spark, d), ["o_custkey"], "s", "e").drop("island")


def intervals_gaps(spark, d):
    return S.gaps(_intervals(spark, d), ["o_custkey"], "s", "e")


def intervals_conflicts(spark, d):
    return S.conflicts(_intervals(spark, d), ["o_custkey"], "o_orderkey", "s", "e").select("o_orderkey", "overlaps")


def hist_equal_width(spark, d):
    out = S.equal_width(table(spark, d, "orders"), "o_totalprice", 20)
    return out.select("bin", rounded(c("low"), "low", 3), rounded(c("high"), "high", 3), "n")


def quantile_bins(spark, d):
    return S.quantile_bins(table(spark, d, "orders"), "o_totalprice", 8, [c("o_orderkey")])


def frequency(spark, d):
    return S.frequency(table(spark, d, "lineitem"), "l_quantity", [10.0, 20.0, 40.0])


def aging(spark, d):
    days = F.datediff(F.lit("1998-08-02").cast("date"), c("o_orderdate").cast("date")) % 200 - 20
    out = S.aging(table(spark, d, "orders").withColumn("days", days), "days", "o_totalprice")
    return out.select("bucket", rounded(c("total"), "total", 2), "n")


def _ledger(spark, d):
    buy = c("event_id") % 3 != 0
    return table(spark, d, "events").select("user_id", "event_id", F.when(buy, "buy").otherwise("sell").alias("kind"), F.when(buy, 2.0).otherwise(1.0).alias("qty"), F.floor("value").cast("double").alias("cost"))


def inventory_fifo(spark, d):
    return S.fifo(_ledger(spark, d), ["user_id"], ["event_id"], "kind", "qty", "cost").select("user_id", rounded(c("cogs"), "cogs", 2), rounded(c("ending_value"), "ending_value", 2), "oversold")


def inventory_lifo(spark, d):
    return S.stack_costing(_ledger(spark, d), ["user_id"], ["event_id"], "kind", "qty", "cost").select("user_id", rounded(c("cogs"), "cogs", 2), rounded(c("ending_value"), "ending_value", 2))


def inventory_average(spark, d):
    return S.stack_costing(_ledger(spark, d), ["user_id"], ["event_id"], "kind", "qty", "cost", "average").select("user_id", rounded(c("cogs"), "cogs", 2), rounded(c("ending_value"), "ending_value", 2))


def exponential_smoothing(spark, d):
    return S.smooth(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 0.3, block=16).select("user_id", "event_id", "smoothed")


def holt(spark, d):
    out = S.holt(table(spark, d, "events"), ["user_id"], "event_id", "value", 0.3, 0.1, 2)
    return out.select("user_id", "level", "trend", "forecast")


_ISLANDS = """SELECT o_custkey, min(s)::INTEGER AS "start", max(e) AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS island FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (
    SELECT o_orderkey, o_custkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + o_orderkey % 60 + 1 AS e FROM orders))) GROUP BY o_custkey, island"""
_RUNS = """SELECT user_id, run, any_value(event_type) AS value, count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM (
    SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run"""
_W = "PARTITION BY user_id ORDER BY ts, event_id"
_PARETO = """SELECT k, v, v / sum(v) OVER () AS share, sum(v) OVER (ORDER BY v DESC, k DESC ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum FROM (SELECT l_suppkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)"""
SQL = {
    "rank_methods": """SELECT c_custkey, floor(c_acctbal)::BIGINT AS v, rank() OVER (ORDER BY floor(c_acctbal)) AS standard, dense_rank() OVER (ORDER BY floor(c_acctbal) DESC) AS dense,
        row_number() OVER (ORDER BY floor(c_acctbal), c_custkey) AS ordinal FROM customer""",
    "rank_in_groups": """SELECT c_custkey, c_nationkey, floor(c_acctbal)::BIGINT AS v, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal) DESC)::INTEGER AS standard_rank,
        dense_rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal) DESC)::INTEGER AS dense_rank FROM customer""",
    "running_total": "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders",
    "running_by_group": f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round(sum(CASE WHEN event_id % 7 <> 0 THEN value END) OVER ({_W} ROWS UNBOUNDED PRECEDING), 3) END AS running FROM events",
    "moving_windows": f"""SELECT event_id, CASE WHEN count(v) OVER ({_W} ROWS 2 PRECEDING) = 3 THEN round(avg(v) OVER ({_W} ROWS 2 PRECEDING), 3) END AS mean_3,
        CASE WHEN count(v) OVER ({_W} ROWS 4 PRECEDING) = 5 THEN round(sum(v) OVER ({_W} ROWS 4 PRECEDING), 3) END AS sum_5 FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events)""",
    "moving_whole_table": "SELECT o_orderkey, CASE WHEN count(*) OVER (ORDER BY o_orderkey ROWS 6 PRECEDING) = 7 THEN round(avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS 6 PRECEDING), 3) END AS mean_7 FROM orders",
    "changes": f"""SELECT event_id, round(value - lag(value) OVER ({_W}), 4) AS change, round((value - lag(value) OVER ({_W})) / nullif(lag(value) OVER ({_W}), 0), 3) AS change_pct FROM events""",
    "growth_rates": """SELECT o_orderpriority, count(*) - 1 AS periods, round(arg_max(t, y) / arg_min(t, y) - 1, 6) AS total_growth, round(pow(arg_max(t, y) / arg_min(t, y), 1.0 / (count(*) - 1)) - 1, 6) AS cagr
        FROM (SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2) GROUP BY 1""",
    "pareto": f"SELECT k, round(v, 2) AS value, round(share, 8) AS share, round(cum, 6) AS cumulative, cum - share < 0.8 AS vital FROM ({_PARETO})",
    "abc_classes": f"SELECT k, CASE WHEN cum <= 0.8 + 1e-12 THEN 'A' WHEN cum <= 0.95 + 1e-12 THEN 'B' ELSE 'C' END AS abc_class FROM ({_PARETO})",
    "waterfall": f"""SELECT event_id, round(100 + t - (value - 50), 3) AS base, round(100 + t, 3) AS top, CASE WHEN value - 50 >= 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT *, sum(value - 50) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS t FROM events)""",
    "seasonal_indices": "SELECT season, round(m / avg(m) OVER (), 6) AS season_index FROM (SELECT month(o_orderdate)::INTEGER AS season, avg(o_totalprice) AS m FROM orders GROUP BY 1)",
    "run_length": _RUNS,
    "runs_expanded": "SELECT user_id, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2",
    "intervals_merge": _ISLANDS,
    "intervals_gaps": f"""SELECT o_custkey, "end" AS gap_start, nxt::INTEGER AS gap_end FROM (SELECT *, lead("start") OVER (PARTITION BY o_custkey ORDER BY "start") AS nxt FROM ({_ISLANDS})) WHERE nxt IS NOT NULL""",
    "intervals_conflicts": """WITH i AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + o_orderkey % 60 + 1 AS e FROM orders)
        SELECT a.o_orderkey, count(b.o_orderkey) AS overlaps FROM i a LEFT JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND a.s < b.e AND b.s < a.e GROUP BY 1""",
    "hist_equal_width": """SELECT b AS bin, round(lo + b * w, 3) AS low, round(lo + (b + 1) * w, 3) AS high, count(*) AS n FROM (SELECT lo, w, least(floor((o_totalprice - lo) / w), 19)::INTEGER AS b
        FROM orders, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders)) GROUP BY ALL""",
    "quantile_bins": """WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n, count(*) OVER () AS t FROM orders),
        e AS (SELECT DISTINCT v FROM o, range(8) AS r(i) WHERE n = r.i * t // 8 + 1), x AS (SELECT v AS low, coalesce(lead(v) OVER (ORDER BY v), (SELECT max(v) FROM o)) AS high, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS bin FROM e)
        SELECT bin, low, high, count(*) AS n FROM x JOIN o ON v >= low AND (v < high OR bin = (SELECT max(bin) FROM x)) GROUP BY ALL""",
    "frequency": "SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END AS place, count(*) AS n FROM lineitem GROUP BY 1",
    "aging": """SELECT CASE WHEN days < 0 THEN 'not due' WHEN days < 30 THEN '0-30' WHEN days < 60 THEN '30-60' WHEN days < 90 THEN '60-90' ELSE '90+' END AS bucket, round(sum(o_totalprice), 2) AS total, count(*) AS n
        FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') % 200 - 20 AS days FROM orders) GROUP BY 1""",
    "inventory_fifo": """WITH e AS (SELECT user_id, event_id, event_id % 3 <> 0 AS buy, floor(value) AS cost FROM events), s AS (SELECT user_id, count(*) FILTER (WHERE NOT buy)::DOUBLE AS sold, 2.0 * count(*) FILTER (WHERE buy) AS bought FROM e GROUP BY 1),
        l AS (SELECT user_id, cost, 2.0 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM e WHERE buy),
        g AS (SELECT user_id, cost, greatest(0, least(2.0, sold - (upto - 2.0))) AS gone, sold, bought FROM l JOIN s USING (user_id))
        SELECT user_id, round(sum(gone * cost), 2) AS cogs, round(sum((2.0 - gone) * cost), 2) AS ending_value, any_value(sold) > any_value(bought) AS oversold FROM g GROUP BY 1""",
}
_NUMBERED = "e AS (SELECT user_id, event_id, value, floor(value) AS cost, event_id % 3 <> 0 AS buy, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
SQL |= {
    # a sold unit is the unit bought last at the same height of the stack
    "inventory_lifo": """WITH u AS (SELECT user_id, event_id, k.k, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE -1 END AS step, floor(value) AS cost FROM events, range(1, 3) AS k(k) WHERE event_id % 3 <> 0 OR k.k = 1),
        s AS (SELECT *, sum(step) OVER w AS depth FROM u WINDOW w AS (PARTITION BY user_id ORDER BY event_id, k ROWS UNBOUNDED PRECEDING)),
        h AS (SELECT *, depth - least(0, min(depth) OVER (PARTITION BY user_id ORDER BY event_id, k ROWS UNBOUNDED PRECEDING)) AS height FROM s),
        b AS (SELECT *, coalesce(lag(height) OVER (PARTITION BY user_id ORDER BY event_id, k), 0) AS before FROM h),
        p AS (SELECT *, CASE WHEN step < 0 AND before > 0 THEN last_value(CASE WHEN step > 0 THEN cost END IGNORE NULLS) OVER (PARTITION BY user_id, greatest(height, before) ORDER BY event_id, k ROWS UNBOUNDED PRECEDING) END AS sold FROM b)
        SELECT user_id, round(coalesce(sum(sold), 0), 2) AS cogs, round(coalesce(sum(cost) FILTER (WHERE step > 0), 0) - coalesce(sum(sold), 0), 2) AS ending_value FROM p GROUP BY 1""",
    "inventory_average": f"""WITH RECURSIVE {_NUMBERED}, a(user_id, n, units, worth, cogs) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM e
        UNION ALL SELECT user_id, e.n, CASE WHEN buy THEN units + 2 ELSE units - 1 END, CASE WHEN buy THEN worth + 2 * cost ELSE worth - unit END, CASE WHEN buy THEN cogs ELSE cogs + unit END
        FROM (SELECT *, CASE WHEN units = 0 THEN 0 ELSE worth / units END AS unit FROM a) a JOIN e USING (user_id) WHERE e.n = a.n + 1)
        SELECT user_id, round(arg_max(cogs, n), 2) AS cogs, round(arg_max(worth, n), 2) AS ending_value FROM a GROUP BY 1""",
    "exponential_smoothing": f"""WITH RECURSIVE {_NUMBERED}, a(user_id, event_id, n, smoothed) AS (SELECT user_id, event_id, n, value::DOUBLE FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.event_id, e.n, 0.3::DOUBLE * value + 0.7::DOUBLE * smoothed FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1) SELECT user_id, event_id, smoothed FROM a""",
    "holt": f"""WITH RECURSIVE {_NUMBERED}, a(user_id, n, level, trend) AS (SELECT x.user_id, 1::BIGINT, x.value::DOUBLE, (y.value - x.value)::DOUBLE FROM e x JOIN e y ON x.user_id = y.user_id AND x.n = 1 AND y.n = 2
        UNION ALL SELECT user_id, n, l, 0.1::DOUBLE * (l - level) + 0.9::DOUBLE * trend FROM (SELECT e.user_id, e.n, level, trend, 0.3::DOUBLE * value + 0.7::DOUBLE * (level + trend) AS l FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1))
        SELECT user_id, arg_max(level, n) AS level, arg_max(trend, n) AS trend, arg_max(level, n) + 2 * arg_max(trend, n) AS forecast FROM a GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
