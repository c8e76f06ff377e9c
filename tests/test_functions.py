"""Worksheet functions against values known from hand and from their rules."""

import math

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import arrays as A
from quillgrid.functions import dates as D
from quillgrid.functions import finance as M
from quillgrid.functions import logic as L
from quillgrid.functions import maths as N
from quillgrid.functions import text as T
from quillgrid.functions.cell import Cell, of


@pytest.fixture(scope="module")
def show(spark):
    """The value of a Cell or Column, an error as its code."""

    def run(*cells):
        row = spark.range(1).select(*[F.coalesce(c.code(), F.to_json(F.struct(c.column("v")))).alias(f"c{i}") if isinstance(c, Cell) else F.to_json(F.struct(c.alias("v"))).alias(f"c{i}") for i, c in enumerate(cells)]).first()
        import json

        out = [x if x.startswith("#") else json.loads(x).get("v") for x in row]
        return out if len(out) > 1 else out[0]

    return run


def test_text(show):
    assert show(T.LEFT("abc", 2), T.LEFT("abc", -1), T.RIGHT("abc", 0), T.MID("abc", 0, 1), T.MID("abc", 2, 9)) == ["ab", "#VALUE!", "", "#VALUE!", "bc"]
    assert show(T.TRIM("  a \t b  "), T.PROPER("o'neil mc-donald"), T.CLEAN("a\x07b"), T.REPT("ab", 3), T.REPT("ab", 9999)) == ["a b", "O'Neil Mc-Donald", "ab", "ababab", "#VALUE!"]
    assert show(T.SUBSTITUTE("aaa", "a", "b"), T.SUBSTITUTE("aaa", "a", "b", 2), T.SUBSTITUTE("aaa", "aa", "b", 2), T.SUBSTITUTE("x", "", "b"), T.SUBSTITUTE("aaa", "a", "b", 0)) == ["bbb", "aba", "ab", "x", "#VALUE!"]
    assert show(T.FIND("b", "abc"), T.FIND("B", "abc"), T.SEARCH("B", "abc"), T.FIND("", "abc", 2), T.FIND("a", "abc", 5)) == [2, "#VALUE!", 2, 2, "#VALUE!"]
    assert show(T.TEXTBEFORE("a-b-c", "-", 2), T.TEXTBEFORE("a-b-c", "-", -1), T.TEXTAFTER("a-b-c", "-", -1), T.TEXTAFTER("a.b", "."), T.TEXTBEFORE("abc", "-"), T.TEXTBEFORE("abc", "")) == ["a-b", "a-b", "c", "b", "#N/A", "#VALUE!"]
    assert show(T.REPLACE("abcdef", 2, 3, "_"), T.CHAR(65), T.CHAR(10), T.CODE("A"), T.VALUE_(" 1_000 "), T.VALUE_("x"), T.VALUE_("1e3")) == ["a_ef", "A", "#VALUE!", 65, 1000, "#VALUE!", 1000]
    assert show(T.DOLLAR(-1234.5), T.FIXED(1234.567, 1), T.FIXED(1234.567, 1, True), T.CONCAT("a", 1, None), T.TEXTJOIN("-", True, "a", "", "b"), T.TEXTJOIN("-", False, "a", "", "b")) == ["-$1,234.50", "1,234.6", "1234.6", "a1", "a-b", "a--b"]
    assert show(T.to_roman(1994), T.from_roman(F.lit("MCMXCIV")), T.from_roman(F.lit("IIX")), T.to_roman(0), T.from_base(F.lit("FF"), 16), T.from_base(F.lit("2"), 2)) == ["MCMXCIV", 1994, "#NUM!", "#NUM!", 255, "#NUM!"]
    assert show(T.isbn10_valid(F.lit("0-306-40615-2")), T.isbn13_valid(F.lit("978-0-306-40615-7")), T.luhn_valid(F.lit("4539 1488 0343 6467")), T.luhn_check_digit(F.lit("7992739871"))) == [True, True, True, 3]
    assert show(T.wrap_text(F.lit("the quick brown fox"), 9), T.center(F.lit("ab"), 5), T.pad_left(F.lit("abc"), 2)) == [["the quick", "brown fox"], " ab  ", "abc"]


def test_numbers(show):
    assert show(N.MOD(-3, 2), N.MOD(3, -2), N.MOD(1, 0), N.DIVIDE(1, 0), N.POWER(0, -1), N.POWER(-8, 1 / 3), N.SQRT(-1)) == [1, -1, "#DIV/0!", "#DIV/0!", "#NUM!", "#NUM!", "#NUM!"]
    assert show(N.CEILING(7, 3), N.FLOOR(7, 3), N.CEILING(7, 0), N.CEILING(7, -3), N.CEILING(-7, -3), N.MROUND(10, 4), N.MROUND(5, -2), N.MROUND(5, 0)) == [9, 6, "#DIV/0!", "#NUM!", -9, 8, "#NUM!", 0]
    assert show(N.FACT(5), N.FACT(171), N.FACT(0), N.COMBIN(5, 2), N.COMBIN(2, 5), N.COMBIN(5, 0), N.GCD(12, 18, 8), N.LCM(4, 6), N.LCM(0, 5), N.GCD(1.5)) == [120, "#NUM!", 1, 10, "#NUM!", 1, 2, 12, 0, "#NUM!"]
    assert show(N.DEC2BIN(-1), N.DEC2HEX(-1), N.DEC2BIN(512), N.BIN2DEC("1111111111"), N.BIN2DEC("2"), N.BITAND(6, 3), N.BITXOR(6, -1)) == ["1111111111", "3FF", "#NUM!", -1, "#NUM!", 2, "#NUM!"]
    assert show(N.LOG(8, 1), N.ATAN2(0, 0), N.EXP(1000), N.ASIN(2)) == ["#NUM!", "#DIV/0!", "#NUM!", "#NUM!"]
    assert show(N.TRUNC(-1.57, 1), N.ROUNDUP(1.21, 1), N.ROUND(2.5), N.LOG(8, 2), N.ATAN2(1, 1)) == pytest.approx([-1.5, 1.3, 2, 3, math.pi / 4])
    assert show(N.CONVERT(1, "mi", "km"), N.CONVERT(212, "F", "C"), N.CONVERT(0, "C", "K")) == pytest.approx([1.609344, 100, 273.15])
    assert show(N.CONVERT(1, "kg", "km"), N.CONVERT(1, "KM", "m")) == ["#N/A", "#N/A"]
    assert show(N.prime_factors(F.lit(360)), N.is_prime(F.lit(97)), N.is_prime(F.lit(1))) == [[{"prime": 2, "power": 3}, {"prime": 3, "power": 2}, {"prime": 5, "power": 1}], True, False]


def test_logic(show):
    error = N.DIVIDE(1, 0)
    assert show(L.IF(True, 1, error), L.IF(False, error, 2), L.IF(error, 1, 2), L.IFERROR(error, 7), L.IFNA(error, 7), L.IFNA(L.NA(), 7)) == [1, 2, "#DIV/0!", 7, "#DIV/0!", 7]
    assert show(L.AND(False, error), L.OR(True, error), L.XOR(True, True, True), L.NOT(0)) == ["#DIV/0!", "#DIV/0!", True, True]
    assert show(L.SWITCH("A", "a", 1, 9), L.SWITCH("x", "a", 1), L.CHOOSE(2, "p", "q"), L.CHOOSE(3, "p", "q"), L.IFS(False, 1, True, 2), L.IFS(False, 1)) == [1, "#N/A", "q", "#VALUE!", 2, "#N/A"]
    assert show(L.TYPE(1.0), L.TYPE("x"), L.TYPE(True), L.TYPE(error), L.ISERR(L.NA()), L.ISNA(L.NA()), L.ISBLANK(F.lit(None)), L.ISNUMBER("1"), L.ISTEXT("1"), L.ISLOGICAL(True)) == [1, 2, 4, 16, False, True, True, False, True, True]
    assert show(L.LET("x", 2, "y", lambda s: N.MULTIPLY(s["x"], 3), lambda s: N.ADD(s["x"], s["y"])), L.N(True), L.N("x"), L.T(5), L.T("t"), L.ISEVEN(-2.5)) == [8, 1, 0, "", "t", True]
    assert show(L.compare("=", F.lit("ab"), F.lit("ab")), of(F.lit(1.5))) == [True, 1.5]


def test_dates(show):
    assert show(D.DATE(2000, 1, 1), D.DATE(2024, 2, 30), D.DATE(1999, 12, 31), D.DATE(2024, 2, 29)) == [1, "#NUM!", "#NUM!", 8826]
    jan31 = D.DATE(2024, 1, 31)
    assert show(D.render_date(D.EDATE(jan31, 1)), D.render_date(D.EOMONTH(jan31, 1)), D.WEEKDAY(1), D.WEEKDAY(1, 2), D.WEEKDAY(1, 9), D.YEAR(0)) == ["2024-02-29", "2024-02-29", 7, 6, "#NUM!", "#NUM!"]
    assert show(D.DATEDIF(D.DATE(2024, 1, 31), D.DATE(2024, 2, 29), "M"), D.DATEDIF(D.DATE(2023, 3, 1), D.DATE(2024, 2, 29), "Y"), D.DATEDIF(5, 4, "D"), D.DATEDIF(4, 5, "Q")) == [0, 0, "#NUM!", "#NUM!"]
    assert show(D.NETWORKDAYS(1, 7), D.WORKDAY(1, 1), D.WORKDAY(1, -1), D.WORKDAY(7, -5), D.WEEKNUM(8), D.NETWORKDAYS(7, 1)) == [5, 3, "#NUM!", "#NUM!", 2, "#NUM!"]
    assert show(D.monthly(D.DATE(2023, 1, 31), D.DATE(2023, 4, 30)), D.format_duration(F.lit(93784)), D.parse_duration(F.lit("1d 2h 3m 4s")), D.parse_duration(F.lit("4s 1d")), D.days360(D.DATE(2024, 1, 31), D.DATE(2024, 3, 31))) == [[8432, 8460, 8491, 8521], "1d 2h 3m 4s", 93784, "#VALUE!", 60]


def test_finance(show):
    assert show(M.PMT(0, 10, 1000), M.PMT(0.1, 2, 1000), M.FV(0, 3, -10, 0), M.NPER(0, -100, 1000, 0), M.SLN(1000, 100, 9), M.DDB(1000, 100, 5, 1)) == pytest.approx([-100, -576.190476, 30, 10, 100, 400])
    assert show(M.PMT(0.1, 0, 1), M.IRR(F.array(F.lit(1.0), F.lit(2.0))), M.RATE(10, 5, 100), M.DDB(1, 0, 5, 6)) == ["#NUM!", "#NUM!", "#NUM!", "#NUM!"]
    flows = F.array(*[F.lit(float(x)) for x in (-100, 60, 60)])
    assert show(M.IRR(flows), M.NPV(0.1, F.array(F.lit(110.0))), M.RATE(24, -50, 1000), M.mirr(flows, 0.1, 0.12)) == pytest.approx([0.1306623862, 100, 0.015130844, 0.127829774], rel=1e-6)
    dates = F.array(F.lit(1), F.lit(366), F.lit(731))
    assert show(M.xnpv(F.lit(0.1), flows, dates), M.xirr(flows, dates), M.bond_price(1000, 0.05, 10, 0.05), M.yield_to_maturity(1000, 0.05, 10, 1000), M.macaulay_duration(1000, 0.05, 2, 0.05)) == pytest.approx([4.1322314, 0.1306623862, 1000, 0.05, 1.952380952], rel=1e-6)
    assert show(M.marginal(F.lit(2500.0), [(0, 0.1), (1000, 0.2), (2000, 0.3)]), M.chain_discount(F.array(F.lit(0.1), F.lit(0.2))), M.round_cash(F.lit(1.02)), M.effective(F.lit(0.12), 12), M.nominal(F.lit(0.12682503), 12), M.cumprinc(0.01, 12, 1000, 1, 12)) == pytest.approx([450, 0.28, 1.0, 0.12682503, 0.12, -1000], rel=1e-6)


def test_arrays(show):
    a, b = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    assert show(A.cross(a, b), A.dot(a, b), A.angle_between(a, b)) == [[0, 0, 1], 0, pytest.approx(math.pi / 2)]
    assert show(A.binomial_cdf(F.lit(10), F.lit(10), 0.3), A.poisson_cdf(F.lit(60), 2.5), A.poly_eval([1, 2, 3], F.lit(2.0)), A.binomial_pmf(F.lit(11), F.lit(10), 0.3)) == pytest.approx([1, 1, 17, 0])
