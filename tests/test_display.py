import math

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import display as P
from quillgrid.operators import inference as I
from quillgrid.operators import rules as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_words_and_formats(spark):
    say = lambda x: P.spell_integer(F.lit(x)).rendered()
    assert one(spark, say(0), say(21), say(-21), say(100), say(999_999), say(10**12 + 5), say(0.5)) == ("zero", "twenty-one", "#VALUE!", "one hundred", "nine hundred ninety-nine thousand nine hundred ninety-nine", "one trillion five", "#VALUE!")
    assert one(spark, P.spell_money(F.lit(12.05)).column(), P.render_number(F.lit(1234.5), "fr"), P.number_format(F.lit(-1234.5), "0.00;(0.0)"), P.number_format(F.lit(0.256), "0.0%")) == ("twelve dollars and 05/100", "1 234,50", "(1234.5)", "25.6%")
    back = lambda s, k: P.parse_number(F.lit(s), k).rendered()
    assert one(spark, back("1.234,5", "de"), back("1,234", "en"), back("12,34", "en"), back("", "en")) == ("1234.5", "1234", "#VALUE!", "#VALUE!")
    assert one(spark, P.sparkline(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.5))), P.bar(F.lit(-1.0), -2, 2, 4), P.bar(F.lit(2.0), 0, 4, 4)) == (" #=", " #|", "|##")
    assert P.nice_ticks(0, 9) == [0, 2, 4, 6, 8, 10] and P.nice_ticks(0, 30) == [0, 10, 20, 30] and P.nice_ticks(5, 5)[0] <= 5 and P.nice_ticks(-1, 1)[0] <= -1
    for refused in ((1, 0, 5), (0, 1, 1)):
        with pytest.raises(ValueError):
            P.nice_ticks(*refused)
    assert one(spark, P.spell_money(F.lit(-1.0)).rendered(), P.color_between(F.lit(0.5), (0, 0, 0), (255, 255, 254)), P.band_around(F.lit(0.0), F.lit(-8.0), F.lit(2.0), F.lit(2.0))) == ("#VALUE!", "#80807F", -1)
    assert P.axis(spark.createDataFrame([(4.0,), (9.0,)], "v double"), "v") == P.nice_ticks(0, 9)


def test_rules(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 50, None)], "k int, v int, s string")
    assert [tuple(r) for r in R.audit(df, "k", {"range": R.between("v", 0, 10), "list": R.allowed("s", ["a"])}).orderBy("k").collect()] == [(2, "list"), (3, "range")]
    got = R.styles(df, [(F.col("v") > 10, "x", True), (F.col("v") > 0, "y", False)]).orderBy("k").collect()
    assert [r.styles for r in got] == [["y"], [], ["x"]]
    assert [r.k for r in R.slicer(df, "s", ["a"]).collect()] == [2]
    with pytest.raises(ValueError):
        R.outline(df, "k", [(1, 5, False), (3, 8, False)])


def test_inference(spark):
    assert one(spark, I.t_cdf(F.lit(2.228138852), 10), I.t_cdf(F.lit(-12.7062047), 1), I.t_inv(0.975, 10), I.normal_inv(F.lit(0.975))) == pytest.approx((0.975, 0.025, 2.228138852, 1.959963985), rel=1e-6)
    df = spark.createDataFrame([(float(v),) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "v double")
    row = I.one_sample(df, "v", 4.0).first()
    assert row.t == pytest.approx(1 / (math.sqrt(32 / 7) / math.sqrt(8))) and 0.2 < row.p < 0.3
    lines = spark.createDataFrame([("g", float(x), 2.0 * x + 1) for x in range(1, 5)], "g string, x double, y double")
    assert I.trend(lines, ["g"], "x", "y", [10]).first().projected == pytest.approx(21)
    curve = lines.withColumn("y", F.pow(F.lit(3.0), "x"))
    assert I.trend(curve, ["g"], "x", "y", [5], True).first().projected == pytest.approx(243)
