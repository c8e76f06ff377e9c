"""Text, date, math, logic, information and finance functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import finance as M
from ..functions import logic as L
from ..functions import maths as N
from ..functions import text as T
from ..functions.cell import Cell
from .common import rounded, spread, table

c = F.col


def text_scalars(spark, d):
    s = c("p_name")
    return table(spark, d, "part").select(
        "p_partkey", T.LEFT(s, 4).column("l4"), T.RIGHT(s, 3).column("r3"), T.MID(s, 2, 5).column("m25"), T.LEN(s).column("n"), T.UPPER(s).column("up"), T.LOWER(s).column("low"),
        T.TRIM(F.concat(F.lit("  "), s, F.lit("   x "))).column("trimmed"), T.SUBSTITUTE(s, "a", "<>").column("swapped"), T.REPLACE(s, 2, 3, "_").column("spliced"),
        T.FIND("e", s).column("found"), T.FIND("e", s).code("found_code"), T.SEARCH("E", s).column("searched"), T.REPT(T.LEFT(s, 1), 3).column("thrice"),
        T.EXACT(s, T.LOWER(s)).column("same"), T.CONCAT(s, "-", c("p_brand")).column("joined"), T.CODE(s).column("code"), T.CHAR(c("p_size") + 40).column("sign"), T.CLEAN(F.concat(s, F.lit("\x07"))).column("clean"),
    )


def text_parts(spark, d):
    s = c("p_type")
    return table(spark, d, "part").select(
        "p_partkey", T.TEXTBEFORE(s, " ").column("before_1"), T.TEXTAFTER(s, " ").column("after_1"), T.TEXTAFTER(s, " ", -1).column("last_part"), T.TEXTBEFORE(s, "#").code("missing"),
        F.size(T.text_split(s, " ")).alias("parts"), T.SUBSTITUTE(s, " ", "/", 2).column("second"), T.TEXTJOIN("+", True, s, F.lit(""), c("p_brand")).column("joined"),
        T.PROPER(F.lower(s)).column("proper"), F.length(T.pad_left(c("p_brand"), 12)).alias("padded"), T.edit_distance(s, c("p_brand")).alias("distance"), rounded(T.similarity(s, c("p_brand")), "likeness"),
    )


def number_text(spark, d):
    x, there = F.floor("c_acctbal"), c("c_acctbal").isNotNull()
    return table(spark, d, "customer").select(
        "c_custkey", T.VALUE_(F.concat(F.lit(" "), c("c_custkey").cast("string"), F.lit(".5 "))).column("value"), T.VALUE_(c("c_name")).code("value_code"),
        F.when(there, T.DOLLAR(x).column()).alias("dollars"), F.when(there, T.FIXED(x, 1, True).column()).alias("fixed"), F.lpad(T.to_base(c("c_custkey"), 16), 6, "0").alias("hex"), T.from_base(F.hex("c_custkey"), 16).column("back"), T.to_roman(c("c_custkey") % 3999 + 1).column("roman"),
    )


def roman_round_trip(spark, d):
    n = c("c_custkey") % 3999 + 1
    return spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", T.from_roman(T.to_roman(n).column()).column("number"), T.from_roman(F.lit("IIII")).code("refused"))


def check_digits(spark, d):
    n = F.lpad(c("o_orderkey").cast("string"), 9, "0")
    return table(spark, d, "orders").select("o_orderkey", T.luhn_check_digit(n).alias("digit"), T.luhn_valid(F.concat(n, T.luhn_check_digit(n).cast("string"))).alias("valid"), T.luhn_valid(F.concat(n, F.lit("x"))).alias("invalid"))


def date_parts(spark, d):
    s = D.to_serial(c("ts"))
    return table(spark, d, "events").select(
        "event_id", s.alias("serial"), D.YEAR(s).column("y"), D.MONTH(s).column("m"), D.DAY(s).column("day"), D.WEEKDAY(s).column("wd1"), D.WEEKDAY(s, 2).column("wd2"), D.WEEKDAY(s, 3).column("wd3"), D.WEEKNUM(s).column("week"),
        D.iso_week(s).column("iso"), D.quarter(s).column("q"), D.DATE(D.YEAR(s), D.MONTH(s), D.DAY(s)).column("again"), D.day_name(s).alias("day_name"), D.render_date(s).alias("shown"),
    )


def date_shifts(spark, d):
    s = D.to_serial(c("ts"))
    k = c("event_id") % 27
    return table(spark, d, "events").select(
        "event_id", D.EDATE(s, k).column("edate"), D.EOMONTH(s, k - 13).column("eomonth"), D.DAYS(s + k, s).column("days"), rounded(D.YEARFRAC(s, s + k * 10).column(), "yearfrac", 6), D.NETWORKDAYS(s, s + k).column("netdays"),
        D.DATEDIF(s, s + k * 31, "M").column("months"), D.DATEDIF(s, s + k * 31, "D").column("dd"), D.DATEDIF(s + 1, s, "D").code("reversed"), D.days360(s, s + k * 31).column("d360"), D.EDATE(F.lit(0), 1).code("too_early"),
    )


def workdays(spark, d):
    s, k = D.to_serial(c("ts")), c("event_id") % 41 - 20
    return table(spark, d, "events").select("event_id", s.alias("serial"), D.WORKDAY(s, k).column("workday"), D.networkdays_custom(s, s + 30, (5, 6), (8790, 8800)).alias("custom"))


def math_scalars(spark, d):
    x, q = c("l_extendedprice"), c("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", N.ABS(-x).column("a"), N.INT(x).column("i"), rounded(N.SQRT(x).column(), "root"), rounded(N.LN(x).column(), "ln"), rounded(N.LOG(x).column(), "log10"), rounded(N.LOG(q + 1, 2).column(), "log2"),
        N.MOD(q, -7).column("mod"), N.SIGN(q - 25).column("sign"), N.CEILING(q, 4).column("ceil"), N.FLOOR(q, 4).column("floor"), rounded(N.POWER(q, 1.5).column(), "power", 3), N.MROUND(q, 4).column("mround"), N.SQRT(q - 25).code("root_code"), N.DIVIDE(x, q - 25).code("div_code"),
        N.TRUNC(x, -2).column("trunc"), N.ROUNDUP(x, -2).column("up"), N.ROUNDDOWN(x, -1).column("down"), L.ISEVEN(q).column("even"), L.ISODD(q).column("odd"),
    )


def trigonometry(spark, d):
    x = c("l_quantity") / 10
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", rounded(N.SIN(x).column(), "s"), rounded(N.COS(x).column(), "c"), rounded(N.ATAN(x).column(), "at"), rounded(N.ATAN2(x, 2).column(), "at2"), rounded(N.ASIN(x / 10).column(), "asin"), rounded(N.ACOS(x / 10).column(), "acos"),
        rounded(N.SINH(x).column(), "sh", 2), rounded(N.COSH(x).column(), "ch", 2), rounded(N.TANH(x).column(), "th"), rounded(N.DEGREES(x).column(), "deg"), rounded(N.RADIANS(x).column(), "rad"), rounded(N.TAN(x / 4).column(), "tan"), rounded(N.EXP(x).column(), "exp", 2), N.ASIN(x + 2).code("asin_code"), rounded(N.PI().column(), "pi"),
    )


def whole_numbers(spark, d):
    n = c("p_size")
    return table(spark, d, "part").select(
        "p_partkey", N.GCD(n, c("p_partkey")).column("gcd"), N.LCM(n, 12).column("lcm"), rounded(N.FACT(n % 15).column(), "fact", 0), N.COMBIN(n, 3).column("combin"), N.COMBIN(n, 60).code("combin_code"),
        N.DEC2BIN(n - 25).column("bin"), N.DEC2HEX(n - 25).column("hex"), N.DEC2OCT(n).column("oct"), N.HEX2DEC(N.DEC2HEX(n - 25).column()).column("back"), N.BITAND(n, 12).column("band"), N.BITOR(n, 12).column("bor"), N.BITXOR(n, 12).column("bxor"),
        N.is_prime(n).alias("prime"), rounded(N.CONVERT(n, "mi", "km").column(), "km"), rounded(N.CONVERT(n, "F", "C").column(), "celsius"), N.CONVERT(n, "kg", "km").code("unit_code"),
    )


def factors(spark, d):
    f = N.prime_factors(c("p_partkey"))
    return spread(table(spark, d, "part").filter("p_partkey > 1").select("p_partkey")).select("p_partkey", F.aggregate(f, F.lit(1.0), lambda a, x: a * F.pow(x["prime"].cast("double"), x["power"])).alias("product"))


def logic_scalars(spark, d):
    q, flag = c("l_quantity"), c("l_returnflag")
    safe = N.DIVIDE(c("l_extendedprice"), q - 25)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", L.IF(q > 25, "big", "small").column("size"), L.IFS(q < 10, "s", q < 30, "m").column("ifs"), L.IFS(q < 10, "s", q < 30, "m").code("ifs_code"), L.SWITCH(flag, "a", 1, "r", 2, 3).column("switched"),
        L.CHOOSE(q % 3 + 1, "x", "y", "z").column("chosen"), L.AND(q > 5, flag == "N").column("both"), L.OR(q > 45, flag == "R").column("either"), L.XOR(q > 25, flag == "N").column("one"), L.NOT(q > 25).column("negated"),
        rounded(L.IFERROR(safe, -1.0).column(), "safe", 8), L.ISERROR(safe).column("failed"), L.IFNA(L.IFS(q < 10, "s"), "none").column("ifna"), L.ISERR(safe).column("iserr"), L.ISNA(safe).column("isna"), L.TYPE(safe).column("kind"),
        L.ISTEXT(flag).column("is_text"), L.ISNUMBER(q).column("is_number"), L.ISBLANK(F.nullif(flag, F.lit("N"))).column("blank"), L.N(q > 25).column("n"), L.T(q).column("t"),
    )


def let_bindings(spark, d):
    price = L.LET("net", N.MULTIPLY(c("l_extendedprice"), 1 - c("l_discount")), "tax", lambda s: N.MULTIPLY(s["net"], c("l_tax")), lambda s: N.ADD(s["net"], s["tax"]))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(rounded(F.sum(price.column()), "charge", 2))


def annuities(spark, d):
    v = F.abs("c_acctbal") + 1
    return table(spark, d, "customer").select(
        "c_custkey", rounded(M.PMT(0.01, 24, v).column(), "pmt"), rounded(M.FV(0.01, 24, -10, -v).column(), "fv"), rounded(M.PV(0.01, 24, -10, 0).column(), "pv"), rounded(M.NPER(0.01, -v / 10, v, 0).column(), "nper"), rounded(M.SLN(v, 0, 7).column(), "sln"),
        rounded(M.DDB(v, v / 10, 5, 2).column(), "ddb"), rounded(M.ipmt(0.01, 5, 24, v).column(), "ipmt"), rounded(M.ppmt(0.01, 5, 24, v).column(), "ppmt"), M.PMT(0.01, 0, v).code("pmt_code"), rounded(M.effective(0.12, 12), "effective", 6),
        rounded(M.bond_price(v, 0.05, 10, 0.04), "bond", 3), M.quick_ratio(v, 1, 0).code("ratio_code"), rounded(M.runway(v, 100, 60), "runway", 6), rounded(M.late_fee(v, 40, 5, 0.001, 10), "fee"), rounded(M.round_cash(F.floor(v)), "cash", 2),
    )


def solvers(spark, d):
    """The solved rates, shown by what they bring back: values beside the ones they were solved for."""
    v = F.abs("c_acctbal") + 100
    flows = F.array(-v, v * 0.5, v * 0.4, v * 0.3)
    rate = M.RATE(24, -v / 20, v)
    solved = spread(table(spark, d, "customer").select("c_custkey", "c_acctbal")).select(
        "c_custkey", "c_acctbal", rate.column("rate"), rate.code("rate_code"), M.yield_to_maturity(v, 0.05, 10, v * 0.9).alias("ytm"), M.IRR(flows).column("irr")
    )
    return solved.select(
        "c_custkey", rounded(-M.PMT(Cell(c("rate"), c("rate_code")), 24, v).column() * 20 / v, "level", 5), rounded(M.bond_price(v, 0.05, 10, c("ytm")) / v, "price", 5), rounded(M.npv_of(c("irr"), flows, 0) / v, "at_irr", 5), M.IRR(F.array(v, v)).code("irr_code"),
        rounded(M.NPV(0.1, flows).column() / v, "npv", 6),
    )


def tax_brackets(spark, d):
    brackets = [(0.0, 0.1), (1000.0, 0.2), (5000.0, 0.3)]
    x = F.greatest("c_acctbal", F.lit(0.0))
    return table(spark, d, "customer").select("c_custkey", rounded(M.marginal(x, brackets), "tax"), rounded(M.add_tax(F.floor(x), 0.25)["total"], "with_tax", 2), rounded(M.chain_discount(F.array(F.lit(0.1), F.lit(0.2))), "chain"))


_K = "CAST(event_id % 27 AS INTEGER)"
_DAY = "CAST(ts AS DATE)"
_E0 = "DATE '1999-12-31'"
SQL = {
    "text_scalars": """SELECT p_partkey, left(p_name, 4) AS l4, right(p_name, 3) AS r3, substr(p_name, 2, 5) AS m25, length(p_name)::DOUBLE AS n, upper(p_name) AS up, lower(p_name) AS low,
        trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')) AS trimmed, replace(p_name, 'a', '<>') AS swapped, left(p_name, 1) || '_' || substr(p_name, 5) AS spliced,
        nullif(instr(p_name, 'e'), 0)::DOUBLE AS found, CASE WHEN instr(p_name, 'e') = 0 THEN '#VALUE!' END AS found_code, nullif(instr(upper(p_name), 'E'), 0)::DOUBLE AS searched, repeat(left(p_name, 1), 3) AS thrice,
        p_name = lower(p_name) AS same, p_name || '-' || p_brand AS joined, ascii(p_name)::DOUBLE AS code, chr(p_size + 40) AS sign, p_name AS clean FROM part""",
    "text_parts": """SELECT p_partkey, CASE WHEN contains(p_type, ' ') THEN split_part(p_type, ' ', 1) END AS before_1, CASE WHEN contains(p_type, ' ') THEN substr(p_type, instr(p_type, ' ') + 1) END AS after_1,
        CASE WHEN contains(p_type, ' ') THEN split_part(p_type, ' ', -1) END AS last_part, '#N/A' AS missing, len(string_split(p_type, ' '))::INTEGER AS parts,
        CASE WHEN len(string_split(p_type, ' ')) > 2 THEN split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) || '/' || array_to_string(string_split(p_type, ' ')[3:], ' ') ELSE p_type END AS second,
        p_type || '+' || p_brand AS joined, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_type, ' ')], ' ') AS proper, 12 AS padded,
        levenshtein(p_type, p_brand)::INTEGER AS distance, round(1 - levenshtein(p_type, p_brand) / greatest(length(p_type), length(p_brand)), 4) AS likeness FROM part""",
    "number_text": """SELECT c_custkey, c_custkey + 0.5::DOUBLE AS value, '#VALUE!' AS value_code,
        CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(floor(c_acctbal))) AS dollars, format('{:.1f}', floor(c_acctbal)) AS fixed,
        lpad(upper(to_hex(c_custkey)), 6, '0') AS hex, c_custkey::DOUBLE AS back,
        repeat('M', (n // 1000)::INTEGER) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] AS roman
        FROM (SELECT *, c_custkey % 3999 + 1 AS n FROM customer)""",
    "roman_round_trip": "SELECT c_custkey, (c_custkey % 3999 + 1)::DOUBLE AS number, '#NUM!' AS refused FROM customer",
    "check_digits": """SELECT o_orderkey, CAST((10 - list_sum([CASE WHEN (9 - i) % 2 = 0 THEN (ascii(s[i]) - 48) * 2 // 10 + (ascii(s[i]) - 48) * 2 % 10 ELSE ascii(s[i]) - 48 END for i in range(1, 10)]) % 10) % 10 AS INTEGER) AS digit, true AS valid, false AS invalid
        FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 9, '0') AS s FROM orders)""",
    "date_parts": f"""SELECT event_id, date_diff('day', {_E0}, {_DAY})::INTEGER AS serial, year(ts)::DOUBLE AS y, month(ts)::DOUBLE AS m, day(ts)::DOUBLE AS day, (dayofweek(ts) + 1)::DOUBLE AS wd1, isodow(ts)::DOUBLE AS wd2, (isodow(ts) - 1)::DOUBLE AS wd3,
        ((dayofyear(ts) - 1) // 7 + 1)::DOUBLE AS week, weekofyear(ts)::DOUBLE AS iso, quarter(ts)::DOUBLE AS q, date_diff('day', {_E0}, {_DAY})::DOUBLE AS again, dayname(ts) AS day_name, strftime(ts, '%Y-%m-%d') AS shown FROM events""",
    "date_shifts": f"""SELECT event_id, date_diff('day', {_E0}, CAST(a + to_months(k) AS DATE))::DOUBLE AS edate, date_diff('day', {_E0}, last_day(a + to_months(k - 13)))::DOUBLE AS eomonth, k::DOUBLE AS days, round(k * 10 / 365, 6) AS yearfrac,
        (SELECT count(*) FROM range(0, k + 1) AS r(i) WHERE isodow(a + r.i::INTEGER) <= 5)::DOUBLE AS netdays,
        ((year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END)::DOUBLE AS months, (k * 31)::DOUBLE AS dd, '#NUM!' AS reversed,
        ((year(b) - year(a)) * 360 + (month(b) - month(a)) * 30 + CASE WHEN day(b) = 31 AND day(a) >= 30 THEN 30 ELSE day(b) END - least(day(a), 30))::DOUBLE AS d360, '#NUM!' AS too_early
        FROM (SELECT event_id, {_DAY} AS a, {_DAY} + {_K} * 31 AS b, {_K} AS k FROM events)""",
    "workdays": f"""SELECT event_id, date_diff('day', {_E0}, a)::INTEGER AS serial, CASE WHEN k = 0 THEN date_diff('day', {_E0}, a)
        WHEN k > 0 THEN (SELECT date_diff('day', {_E0}, a) + i FROM (SELECT r.i, count(*) OVER (ORDER BY r.i) AS n FROM range(1, 40) AS r(i) WHERE isodow(a + r.i::INTEGER) <= 5) WHERE n = k)
        ELSE (SELECT date_diff('day', {_E0}, a) - i FROM (SELECT r.i, count(*) OVER (ORDER BY r.i) AS n FROM range(1, 40) AS r(i) WHERE isodow(a - r.i::INTEGER) <= 5) WHERE n = -k) END::DOUBLE AS workday,
        (SELECT count(*) FROM range(0, 31) AS r(i) WHERE isodow(a + r.i::INTEGER) NOT IN (5, 6) AND date_diff('day', {_E0}, a) + r.i NOT IN (8790, 8800)) AS custom
        FROM (SELECT event_id, {_DAY} AS a, CAST(event_id % 41 - 20 AS INTEGER) AS k FROM events)""",
    "math_scalars": """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice AS a, floor(l_extendedprice) AS i, round(sqrt(l_extendedprice), 4) AS root, round(ln(l_extendedprice), 4) AS ln, round(log10(l_extendedprice), 4) AS log10, round(log2(l_quantity + 1), 4) AS log2,
        l_quantity + 7 * floor(l_quantity / -7) AS mod, sign(l_quantity - 25)::DOUBLE AS sign, ceil(l_quantity / 4) * 4 AS ceil, floor(l_quantity / 4) * 4 AS floor, round(pow(l_quantity, 1.5), 3) AS power,
        CASE WHEN l_quantity % 4 = 2 AND floor(l_quantity / 4) % 2 = 0 THEN floor(l_quantity / 4) * 4 ELSE round(l_quantity / 4) * 4 END AS mround, CASE WHEN l_quantity < 25 THEN '#NUM!' END AS root_code, CASE WHEN l_quantity = 25 THEN '#DIV/0!' END AS div_code,
        floor(l_extendedprice * 0.01) / 0.01 AS trunc, ceil(l_extendedprice * 0.01) / 0.01 AS up, floor(l_extendedprice * 0.1) / 0.1 AS down, l_quantity::BIGINT % 2 = 0 AS even, l_quantity::BIGINT % 2 <> 0 AS odd FROM lineitem""",
    "trigonometry": """SELECT l_orderkey, l_partkey, l_linenumber, round(sin(x), 4) AS s, round(cos(x), 4) AS c, round(atan(x), 4) AS at, round(atan2(2, x), 4) AS at2, round(asin(x / 10), 4) AS asin, round(acos(x / 10), 4) AS acos, round(sinh(x), 2) AS sh, round(cosh(x), 2) AS ch,
        round(tanh(x), 4) AS th, round(degrees(x), 4) AS deg, round(radians(x), 4) AS rad, round(tan(x / 4), 4) AS tan, round(exp(x), 2) AS exp, '#NUM!' AS asin_code, round(pi(), 4) AS pi FROM (SELECT *, l_quantity / 10 AS x FROM lineitem)""",
    "whole_numbers": """SELECT p_partkey, gcd(p_size, p_partkey)::DOUBLE AS gcd, lcm(p_size, 12)::DOUBLE AS lcm, factorial(p_size % 15)::DOUBLE AS fact, CASE WHEN p_size >= 3 THEN (p_size * (p_size - 1) * (p_size - 2) / 6)::DOUBLE END AS combin, '#NUM!' AS combin_code,
        ltrim(bin((p_size - 25 + 1024) % 1024)::VARCHAR, '') AS bin, upper(to_hex((p_size - 25 + 1024) % 1024)) AS hex, CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END || (p_size % 8)::VARCHAR AS oct,
        (p_size - 25 + CASE WHEN p_size < 25 THEN 1024 ELSE 0 END)::DOUBLE AS back, (p_size & 12)::DOUBLE AS band, (p_size | 12)::DOUBLE AS bor, xor(p_size, 12)::DOUBLE AS bxor,
        p_size IN (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47) AS prime, round(p_size * 1.609344::DOUBLE, 4) AS km, round((p_size - 32) * 5 / 9, 4) AS celsius, '#N/A' AS unit_code FROM part""",
    "factors": "SELECT p_partkey, p_partkey::DOUBLE AS product FROM part WHERE p_partkey > 1",
    "logic_scalars": """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN q > 25 THEN 'big' ELSE 'small' END AS size, CASE WHEN q < 10 THEN 's' WHEN q < 30 THEN 'm' END AS ifs, CASE WHEN q >= 30 THEN '#N/A' END AS ifs_code, CASE f WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS switched,
        ['x', 'y', 'z'][CAST(q % 3 AS INTEGER) + 1] AS chosen, q > 5 AND f = 'N' AS both, q > 45 OR f = 'R' AS either, (q > 25) <> (f = 'N') AS one, NOT q > 25 AS negated, round(CASE WHEN q = 25 THEN -1 ELSE l_extendedprice / (q - 25) END, 8) AS safe, q = 25 AS failed,
        CASE WHEN q < 10 THEN 's' ELSE 'none' END AS ifna, q = 25 AS iserr, false AS isna, CASE WHEN q = 25 THEN 16 ELSE 1 END AS kind, true AS is_text, true AS is_number, f = 'N' AS blank, CASE WHEN q > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS n, '' AS t
        FROM (SELECT *, l_quantity AS q, l_returnflag AS f FROM lineitem)""",
    "let_bindings": "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem GROUP BY 1",
    "annuities": """SELECT c_custkey, round(-v * 0.01 / (1 - pow(1.01, -24)), 4) AS pmt, round(v * pow(1.01, 24) + 10 * (pow(1.01, 24) - 1) / 0.01, 4) AS fv, round(10 * (pow(1.01, 24) - 1) / 0.01 / pow(1.01, 24), 4) AS pv,
        round(ln((-v / 10) / (-v / 10 + v * 0.01)) / ln(1.01), 4) AS nper, round(v / 7, 4) AS sln, round(v * 0.6 - v * 0.36, 4) AS ddb, round(-(v * pow(1.01, 4) + p * (pow(1.01, 4) - 1) / 0.01) * 0.01, 4) AS ipmt,
        round(p + (v * pow(1.01, 4) + p * (pow(1.01, 4) - 1) / 0.01) * 0.01, 4) AS ppmt, '#NUM!' AS pmt_code, round(pow(1.01, 12) - 1, 6) AS effective, round(v * 0.05 * (1 - pow(1.04, -10)) / 0.04 + v * pow(1.04, -10), 3) AS bond, '#DIV/0!' AS ratio_code,
        round(v / 40, 6) AS runway, round(least(5 + v * 0.001 * 30, v * 0.25), 4) AS fee, round(floor(v), 2) AS cash FROM (SELECT *, -v * 0.01 / (1 - pow(1.01, -24)) AS p FROM (SELECT c_custkey, abs(c_acctbal) + 1 AS v FROM customer))""",
    "solvers": "SELECT c_custkey, 1.0::DOUBLE AS level, 0.9::DOUBLE AS price, 0.0::DOUBLE AS at_irr, '#NUM!' AS irr_code, round(-1 / 1.1 + 0.5 / pow(1.1, 2) + 0.4 / pow(1.1, 3) + 0.3 / pow(1.1, 4), 6) AS npv FROM customer",
    "tax_brackets": """SELECT c_custkey, round(least(x, 1000) * 0.1 + greatest(least(x, 5000) - 1000, 0) * 0.2 + greatest(x - 5000, 0) * 0.3, 4) AS tax, round(floor(x) * 1.25, 2) AS with_tax, 0.28::DOUBLE AS chain
        FROM (SELECT c_custkey, greatest(c_acctbal, 0) AS x FROM customer)""",
}
QUERIES = {name: globals()[name] for name in SQL}
