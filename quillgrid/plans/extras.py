"""Calculators one by one: units, axes, ranges in a row, bills, seasons, and the functions that no other query uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import dates as D
from ..functions import display as P
from ..functions import finance as M
from ..functions import logic as L
from ..functions import lookups as K
from ..functions import maths as N
from ..functions import text as T
from ..operators import business as B
from ..operators import cells as G
from ..operators import graph as R
from ..operators import ordered as O
from ..operators import series as S
from ..operators import statistics as Q
from .common import spread, table

c = F.col

_PAIRS = [(a, b) for units in N.UNITS.values() for a, b in zip(units, [*list(units)[1:], list(units)[0]])]
_RANGES = [(0.0, 30.0), (0.0, 9.0), (-1.0, 1.0), (5.0, 5.0), (0.0, 0.07), (-120.0, 340.0), (3.0, 1999.0), (1e6, 2.5e6), (-0.5, 0.0), (12.0, 12.9)]


def unit_codes(spark, d):
    """Each unit into the next of its family, one unknown code, one pair of two families."""
    pairs = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in [*_PAIRS, ("lb", "kg"), ("hr", "m")]])
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.explode(pairs).alias("u")).select("p_partkey", "p_size", "u.*")
    done = N.CONVERT(c("p_size"), c("source"), c("target"))
    return rows.select("p_partkey", "source", "target", done.column("converted"), done.code("error"))


def axis_ticks(spark, d):
    return spark.createDataFrame([(i, float(t)) for i, (a, b) in enumerate(_RANGES) for t in P.nice_ticks(a, b)], "n int, tick double")


def range_lookups(spark, d):
    """Over ranges in a row: [10, 20, 30, 30, 40], and a table of three columns."""
    x = (c("p_size") % 6 * 10).cast("double")
    keys = F.array(*[F.lit(float(v)) for v in (10, 20, 30, 30, 40)])
    names = F.array(*[F.lit(v) for v in ("a", "b", "c", "d", "e")])
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ((10, 1, 5), (20, 2, 6), (30, 3, 7))])
    values = F.array(x, x + 5, x * 2, F.lit(7.0), F.lit(1.0), F.lit(20.0))
    m, v, near = K.MATCH(x, keys), K.VLOOKUP(x, rows, 3), K.VLOOKUP(x + 5, rows, 2, True)
    return table(spark, d, "part").select(
        "p_partkey", m.column("place"), m.code("place_error"), K.INDEX(keys, m).column("found"), K.INDEX(rows, 2, 4).code("outside"), v.column("cell"), v.code("cell_error"), near.column("near"), near.code("near_error"),
        K.HLOOKUP(x / 10, F.array(keys, keys), 1).code("top_error"), K.HLOOKUP(F.lit(20.0), rows, 1).code("no_top"), K.HLOOKUP(F.lit(5.0), rows, 2).column("below"), K.XLOOKUP(x, keys, names, "none").column("first"), K.XLOOKUP(x, keys, names, "none", True).column("last"),
        K.RANK(x, keys).column("rank"), K.RANK(x, keys, True).column("rank_up"), K.RANK(x, keys).code("rank_error"), K.PERCENTRANK(keys, x + 5).column("share"), K.PERCENTRANK(keys, x + 5).code("share_error"),
        K.TRIMMEAN(values, 0.4).column("trimmed"), K.AVEDEV(values).column("deviation"),
    )


def deviation_by_group(spark, d):
    rows = table(spark, d, "lineitem")
    return Q.avedev(rows, "l_extendedprice", ["l_returnflag"]).join(Q.trimmed_mean(rows, "l_extendedprice", 0.2, ["l_returnflag"]), "l_returnflag")


def bill_split(spark, d):
    bills = table(spark, d, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("bill"))
    return B.split_evenly(bills, "s_suppkey", "bill", 3, 0.0, 0.25)


def bill_by_order(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("o"))
    return B.split_by_order(orders, "o_custkey", "o_orderkey", "o", 0.0, 0.5)


def seasons_removed(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    month = F.month("o_orderdate")
    indices = S.seasonal_indices(rows, month, "o_totalprice")
    out = S.reseasonalize(S.deseasonalize(rows, month, "o_totalprice", indices), month, "adjusted", indices)
    return out.select("o_orderkey", "adjusted", "seasonal")


def compression(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return S.compression_ratio(rows, ["user_id"], ["ts", "event_id"], "event_type")


def class_counts(spark, d):
    return S.class_totals(S.abc(table(spark, d, "lineitem").select(c("l_suppkey").alias("k"), "l_extendedprice"), "k", "l_extendedprice")).select("abc_class", c("n").cast("long").alias("n"))


def variance_total(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.lit(4500.0).alias("budget"), F.floor("s_acctbal").cast("double").alias("actual"))
    return B.net_variance(B.variance_lines(rows, "budget", "actual", c("s_suppkey") % 2 == 0))


def color_scales(spark, d):
    """Bands and colors around a midpoint of 1,000."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    ends = rows.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    placed = rows.join(F.broadcast(ends)).withColumn("band", P.band_around(c("c_acctbal"), c("lo"), F.lit(1000.0), c("hi"), 4))
    return placed.select("c_custkey", "band", P.color_between((c("band") + 4) / 8, (255, 255, 255), (0, 127, 255)).alias("color"))


def gantt_rows(spark, d):
    keys = table(spark, d, "supplier").select(c("s_suppkey").alias("task"), (c("s_suppkey") % 7 + 1).cast("double").alias("duration"))
    edges = keys.filter("task > 1").select(F.floor(c("task") / 2).alias("src"), c("task").alias("dst"))
    plan = R.critical_path(keys, edges).withColumn("critical", c("slack") == 0)
    return B.gantt(plan, 16)


def prime_steps(spark, d):
    n = c("p_partkey")
    return spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", N.next_prime(n % 100).column("next"), N.next_prime(n, 0).code("refused"), N.product_of(N.prime_factors(n + 1)).alias("product"))


def linear_systems(spark, d):
    """[[a, b], [b, a]] x = [1, 0.7]: no answer where a = b, and no unknown that is zero but for rounding."""
    a, b = c("p_size").cast("double"), (c("p_partkey") % 7).cast("double")
    x = A.solve(F.array(F.array(a, b), F.array(b, a)), F.array(F.lit(1.0), F.lit(0.7)))
    return table(spark, d, "part").select("p_partkey", F.get(x, F.lit(0)).alias("x"), F.get(x, F.lit(1)).alias("y"))


def optimum(spark, d):
    """The valley of (x - a)^2 + 3 and the peak of its mirror."""
    a = c("p_size").cast("double")
    parts = spread(table(spark, d, "part").select("p_partkey", "p_size"))
    low = M.minimize(lambda x: (x - a) * (x - a) + 3, F.lit(-100.0), F.lit(100.0))
    high = M.maximize(lambda x: -(x + a) * (x + a), F.lit(-100.0), F.lit(100.0))
    return parts.select("p_partkey", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def number_signs(spark, d):
    x = c("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", N.SUBTRACT(x, 30).column("less"), N.PERCENT(x).column("percent"), N.NEGATE(x).column("negative"), N.OCT2DEC("17").column("oct"), N.BIN2DEC("101").column("bin"), L.ISNONTEXT(x).column("no_text"), L.ISLOGICAL(x > 5).column("logical"),
        L.compare("<", x, 30).column("below"), L.compare(">=", x, 30).column("not_below"),
    )


def finance_extras(spark, d):
    v = F.floor(F.abs("c_acctbal")) + 100
    flows, serials = F.array(-v, v * 0.5, v * 0.7), F.array(F.lit(100), F.lit(465), F.lit(830))
    tax = M.extract_tax(v, 0.25)
    return table(spark, d, "customer").select(
        "c_custkey", M.roi(v * 3, v * 2).column("roi"), M.break_even(v, 7, 2).column("even"), M.effective_continuous(0.05).alias("effective"), M.nominal_continuous(0.05).alias("nominal"), M.markup_to_margin(v / 100).alias("margin"), M.margin_to_markup(100 / (v + 100)).alias("markup"),
        tax["net"].alias("net"), tax["tax"].alias("tax"), M.savings_balance(v, 10, 0.01, 24).alias("saved"), M.required_contribution(0, v, 0.01, 24).alias("needed"), M.cumipmt(0.01, 12, v, 1, 12).alias("interest"), M.cumprinc(0.01, 12, v, 1, 12).alias("principal"),
        M.macaulay_duration(v, 0.05, 3, 0.04).alias("duration"), M.xnpv(F.lit(0.1), flows, serials).alias("dated"), M.mirr(flows, 0.1, 0.1).column("mirr"),
    )


def date_extras(spark, d):
    day = F.add_months(c("o_orderdate").cast("date"), 120)  # serials begin in 2000
    s, year, month = D.to_serial(day), F.year(day), F.month(day)
    seconds = c("o_orderkey") * 37
    return table(spark, d, "orders").select(
        "o_orderkey", D.month_name(month).alias("month"), D.days_in_month(year, month).alias("days"), D.is_leap(year).alias("leap"), D.days_in_year(year).alias("year_days"), D.year_fraction(s, s + 100, "actual/360").column("fraction"),
        F.size(D.weekly(s, s + 100)).alias("weeks"), F.size(D.monthly(s, s + 100)).alias("months"), D.parse_duration(D.format_duration(seconds)).column("seconds"), D.parse_duration(F.lit("5x")).code("refused"),
    )


def text_extras(spark, d):
    name = c("p_name")
    code = F.lpad((c("p_partkey") % 1000).cast("string"), 12, "978030640615")
    return table(spark, d, "part").select(
        "p_partkey", F.concat(T.pad_right(name, 60), F.lit("|")).alias("padded"), F.concat(T.center(F.lit("ab"), 7), F.lit("|")).alias("centred"), (F.array_max(F.transform(T.wrap_text(name, 12), F.char_length)) <= 12).alias("wrapped"), T.isbn13_valid(F.concat(code, (c("p_partkey") % 10).cast("string"))).alias("isbn13"),
        T.isbn10_valid(F.lit("0-306-40615-2")).alias("isbn10"), T.isbn10_valid(F.lit("0306406153")).alias("wrong10"),
    )


def three_sheets(spark, d):
    """One cell of three of five sheets."""
    cells = table(spark, d, "nation").select(F.concat(F.lit("s"), c("n_regionkey").cast("string")).alias("sheet"), (c("n_nationkey") % 5).alias("row"), F.lit(0).alias("column"), c("n_nationkey").cast("string").alias("value"))
    return G.across_sheets(cells, ["s0", "s1", "s3"], 2, 0)


def sorted_top(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return O.sort_rows(rows, ("s_nationkey", True), ("s_acctbal", False), ("s_suppkey", False)).limit(40)


_UNITS = "(VALUES " + ", ".join(f"('{u}', '{f}', {s}::DOUBLE, {o}::DOUBLE)" for f, units in {
    "length": {"m": (1, 0), "km": (1000, 0), "cm": (0.01, 0), "mm": (0.001, 0), "mi": (1609.344, 0), "yd": (0.9144, 0), "ft": (0.3048, 0), "in": (0.0254, 0)},
    "mass": {"g": (1, 0), "kg": (1000, 0), "mg": (0.001, 0), "lbm": (453.59237, 0), "oz": (28.349523125, 0)},
    "time": {"sec": (1, 0), "min": (60, 0), "hr": (3600, 0), "day": (86400, 0)},
    "temperature": {"C": (1, 273.15), "F": ("(5.0 / 9.0)", "(459.67 * 5.0 / 9.0)"), "K": (1, 0)},
}.items() for u, (s, o) in units.items()) + ") AS {0}(unit, family, scale, zero)"
_VALUES = "[x, x + 5, x * 2, 7, 1, 20]"
_TREE = "(SELECT s_suppkey // 2 AS src, s_suppkey AS dst FROM supplier WHERE s_suppkey > 1)"
SQL = {
    "unit_codes": f"""SELECT p_partkey, u.s AS source, u.t AS target, CASE WHEN a.family = b.family THEN (p_size * a.scale + a.zero - b.zero) / b.scale END AS converted, CASE WHEN a.family = b.family THEN NULL ELSE '#N/A' END AS error
        FROM part, (VALUES {", ".join(str(p) for p in [*_PAIRS, ("lb", "kg"), ("hr", "m")])}) AS u(s, t) LEFT JOIN {_UNITS.format("a")} ON a.unit = u.s LEFT JOIN {_UNITS.format("b")} ON b.unit = u.t""",
    "axis_ticks": f"""WITH r AS (SELECT n, lo, CASE WHEN hi = lo THEN lo + 1 ELSE hi END AS hi FROM (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_RANGES))}) AS r(n, lo, hi)),
        p AS (SELECT *, (hi - lo) / 4 AS raw, pow(10, floor(log10((hi - lo) / 4))) AS power FROM r),
        s AS (SELECT *, power * CASE WHEN raw / power < 1.5 THEN 1 WHEN raw / power < 3 THEN 2 WHEN raw / power < 7 THEN 5 ELSE 10 END AS step FROM p)
        SELECT n, round(i.i * step, 10) AS tick FROM s, range(-100, 2000) AS i(i) WHERE i.i >= floor(lo / step) AND (i.i - 1) * step < hi - 1e-9""",
    "range_lookups": f"""SELECT p_partkey, CASE x WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 30 THEN 3 WHEN 40 THEN 5 END::DOUBLE AS place, CASE WHEN x IN (0, 50) THEN '#N/A' END AS place_error, CASE WHEN x IN (10, 20, 30, 40) THEN x END AS found, '#VALUE!' AS outside,
        CASE x WHEN 10 THEN 5 WHEN 20 THEN 6 WHEN 30 THEN 7 END::DOUBLE AS cell, CASE WHEN x IN (10, 20, 30) THEN NULL ELSE '#N/A' END AS cell_error, CASE WHEN x < 10 THEN NULL ELSE least(x / 10, 3) END::DOUBLE AS near, CASE WHEN x = 0 THEN '#N/A' END AS near_error,
        '#N/A' AS top_error, '#N/A' AS no_top, 6.0::DOUBLE AS below, CASE x WHEN 10 THEN 'a' WHEN 20 THEN 'b' WHEN 30 THEN 'c' WHEN 40 THEN 'e' ELSE 'none' END AS "first", CASE x WHEN 10 THEN 'a' WHEN 20 THEN 'b' WHEN 30 THEN 'd' WHEN 40 THEN 'e' ELSE 'none' END AS "last",
        CASE x WHEN 10 THEN 5 WHEN 20 THEN 4 WHEN 30 THEN 2 WHEN 40 THEN 1 END::DOUBLE AS rank, CASE x WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 30 THEN 3 WHEN 40 THEN 5 END::DOUBLE AS rank_up, CASE WHEN x IN (0, 50) THEN '#N/A' END AS rank_error,
        CASE x WHEN 10 THEN 0.125 WHEN 20 THEN 0.375 WHEN 30 THEN 0.875 END::DOUBLE AS share, CASE WHEN x IN (10, 20, 30) THEN NULL ELSE '#N/A' END AS share_error, list_avg(list_sort({_VALUES})[2:5]) AS trimmed,
        list_avg(list_transform({_VALUES}, lambda y: abs(y - list_avg({_VALUES})))) AS deviation FROM (SELECT p_partkey, (p_size % 6 * 10)::DOUBLE AS x FROM part)""",
    "deviation_by_group": """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, avg(l_extendedprice) OVER g AS m, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER g AS n FROM lineitem WINDOW g AS (PARTITION BY l_returnflag))
        SELECT l_returnflag, avg(abs(v - m)) AS avedev, avg(v) FILTER (WHERE r > floor(n * 0.2 / 2) AND r <= n - floor(n * 0.2 / 2)) AS trimmed_mean FROM r GROUP BY 1""",
    "bill_split": "SELECT s_suppkey, k.k::INTEGER AS diner, (t // 3 + CASE WHEN k.k <= t % 3 THEN 1 ELSE 0 END) / 100 AS share FROM (SELECT s_suppkey, (floor(s_acctbal) * 125)::BIGINT AS t FROM supplier WHERE s_acctbal >= 0), range(1, 4) AS k(k)",
    "bill_by_order": """WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS v, sum(floor(o_totalprice)) OVER (PARTITION BY o_custkey) * 150 AS t FROM orders), e AS (SELECT *, t * v / sum(v) OVER (PARTITION BY o_custkey) AS e FROM o)
        SELECT o_custkey, o_orderkey, (floor(e) + CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY e - floor(e) DESC, o_orderkey) <= t - sum(floor(e)) OVER (PARTITION BY o_custkey) THEN 1 ELSE 0 END) / 100 AS share FROM e""",
    "seasons_removed": """WITH m AS (SELECT month(o_orderdate) AS season, avg(o_totalprice) AS m FROM orders GROUP BY 1), i AS (SELECT season, m / avg(m) OVER () AS i FROM m)
        SELECT o_orderkey, o_totalprice / i AS adjusted, o_totalprice AS seasonal FROM orders JOIN i ON season = month(o_orderdate)""",
    "compression": """SELECT user_id, sum(new) / count(*) AS ratio FROM (SELECT user_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events) GROUP BY 1""",
    "class_counts": """WITH p AS (SELECT sum(v) OVER (ORDER BY v DESC, k DESC ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum FROM (SELECT l_suppkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1))
        SELECT l.l AS abc_class, count(cum) AS n FROM (VALUES ('A'), ('B'), ('C')) AS l(l) LEFT JOIN p ON l.l = CASE WHEN cum <= 0.8 + 1e-12 THEN 'A' WHEN cum <= 0.95 + 1e-12 THEN 'B' ELSE 'C' END GROUP BY 1""",
    "variance_total": "SELECT sum(floor(s_acctbal) - 4500) AS net_variance FROM supplier",
    "color_scales": """WITH b AS (SELECT c_custkey, CASE WHEN v < 1000 THEN -least(floor((1000 - v) / (1000 - lo) * 4) + 1, 4) WHEN v > 1000 THEN least(floor((v - 1000) / (hi - 1000) * 4) + 1, 4) ELSE 0 END::INTEGER AS band
        FROM (SELECT c_custkey, c_acctbal AS v, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () AS hi FROM customer))
        SELECT c_custkey, band, '#' || printf('%02X%02X', round_even(255 - 255 * (band + 4) / 8, 0)::INTEGER, round_even(255 - 128 * (band + 4) / 8, 0)::INTEGER) || 'FF' AS color FROM b""",
    "gantt_rows": f"""WITH RECURSIVE p(node, t) AS (SELECT s_suppkey, 0::DOUBLE FROM supplier WHERE s_suppkey <= 1 UNION SELECT e.dst, p.t + (e.src % 7 + 1)::DOUBLE FROM p JOIN {_TREE} e ON e.src = p.node),
        b(node, t) AS (SELECT s_suppkey, 0::DOUBLE FROM supplier UNION SELECT e.src, b.t + (e.dst % 7 + 1)::DOUBLE FROM b JOIN {_TREE} e ON e.dst = b.node),
        s AS (SELECT node, max(t) AS s, max(t) + node % 7 + 1 AS f FROM p GROUP BY 1), r AS (SELECT node, max(t) AS a FROM b GROUP BY 1),
        x AS (SELECT node, s, (SELECT max(f) FROM s) AS e, f, (SELECT max(f) FROM s) - f - a AS slack FROM s JOIN r USING (node)),
        y AS (SELECT node, s, slack, round_even(s / e * 16, 0)::INTEGER AS c0, round_even(f / e * 16, 0)::INTEGER AS c1, round_even(slack / e * 16, 0)::INTEGER AS c2 FROM x)
        SELECT node AS task, s AS start, repeat(' ', c0) || CASE WHEN c0 = c1 THEN '*' ELSE repeat(CASE WHEN slack = 0 THEN '#' ELSE '=' END, c1 - c0) END || repeat('.', c2) || CASE WHEN slack = 0 THEN ' (critical)' ELSE '' END AS bar FROM y""",
    "prime_steps": """WITH p AS (SELECT a.a AS p FROM range(2, 120) AS a(a) WHERE NOT EXISTS (SELECT 1 FROM range(2, 12) AS b(b) WHERE b.b < a.a AND a.a % b.b = 0))
        SELECT p_partkey, (SELECT min(p) FROM p WHERE p > p_partkey % 100) AS next, '#NUM!' AS refused, p_partkey + 1 AS product FROM part""",
    "linear_systems": "SELECT p_partkey, CASE WHEN a <> b THEN (a - 0.7::DOUBLE * b) / (a * a - b * b) END AS x, CASE WHEN a <> b THEN (0.7::DOUBLE * a - b) / (a * a - b * b) END AS y FROM (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 7)::DOUBLE AS b FROM part)",
    "optimum": "SELECT p_partkey, p_size::DOUBLE AS low, -p_size::DOUBLE AS high FROM part",
    "number_signs": """SELECT l_orderkey, l_linenumber, l_quantity - 30 AS less, l_quantity / 100 AS percent, -l_quantity AS negative, 15.0::DOUBLE AS oct, 5.0::DOUBLE AS bin, true AS no_text, true AS logical, l_quantity < 30 AS below, l_quantity >= 30 AS not_below FROM lineitem""",
    "finance_extras": """SELECT c_custkey, 0.5::DOUBLE AS roi, v / 5 AS even, exp(0.05) - 1 AS effective, ln(1.05) AS nominal, v / 100 / (1 + v / 100) AS margin, 100 / (v + 100) / (1 - 100 / (v + 100)) AS markup, round_even(v * 100 / 1.25, 0) / 100 AS net, (v * 100 - round_even(v * 100 / 1.25, 0)) / 100 AS tax,
        v * pow(1.01, 24) + 10 * (pow(1.01, 24) - 1) / 0.01 AS saved, v * 0.01 / (pow(1.01, 24) - 1) AS needed, v - 12 * v * 0.01 / (1 - pow(1.01, -12)) AS interest, -v AS principal,
        (0.05 / 1.04 + 2 * 0.05 / pow(1.04, 2) + 3 * 1.05 / pow(1.04, 3)) / (0.05 / 1.04 + 0.05 / pow(1.04, 2) + 1.05 / pow(1.04, 3)) AS duration, -v + v * 0.5 / 1.1 + v * 0.7 / pow(1.1, 2) AS dated, sqrt(0.5 * 1.1 + 0.7) - 1 AS mirr
        FROM (SELECT c_custkey, (floor(abs(c_acctbal)) + 100)::DOUBLE AS v FROM customer)""",
    "date_extras": """SELECT o_orderkey, monthname(o_orderdate) AS month, day(last_day(o_orderdate))::INTEGER AS days, day(last_day(make_date(year(o_orderdate), 2, 1))) = 29 AS leap, CASE WHEN day(last_day(make_date(year(o_orderdate), 2, 1))) = 29 THEN 366 ELSE 365 END::INTEGER AS year_days,
        100 / 360::DOUBLE AS fraction, 15 AS weeks, (SELECT count(*) FROM range(0, 6) AS i(i) WHERE o_orderdate::DATE + to_months(i.i::INTEGER) <= o_orderdate::DATE + 100)::INTEGER AS months, o_orderkey * 37 AS seconds, '#VALUE!' AS refused
        FROM (SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 10 YEAR)::DATE AS o_orderdate FROM orders)""",
    "text_extras": r"""SELECT p_partkey, rpad(p_name, greatest(60, length(p_name))::INTEGER, ' ') || '|' AS padded, '  ab   |' AS centred, len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 12)) = 0 AS wrapped, (list_sum(list_transform(range(1, 14), lambda i: isbn[i]::INTEGER * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) = 0 AS isbn13, true AS isbn10, false AS wrong10
        FROM (SELECT *, substr('978030640615', 1, 12 - length((p_partkey % 1000)::VARCHAR)) || (p_partkey % 1000)::VARCHAR || (p_partkey % 10)::VARCHAR AS isbn FROM part)""",
    "three_sheets": "SELECT sum(n_nationkey)::DOUBLE AS total, count(*) AS n, avg(n_nationkey) AS mean, min(n_nationkey)::DOUBLE AS least, max(n_nationkey)::DOUBLE AS greatest FROM nation WHERE n_regionkey IN (0, 1, 3) AND n_nationkey % 5 = 2",
    "sorted_top": "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_acctbal, s_suppkey LIMIT 40",
}
QUERIES = {name: globals()[name] for name in SQL}
