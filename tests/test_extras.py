import pytest
from pyspark.sql import functions as F

from quillgrid.functions import lookups as K
from quillgrid.functions import maths as N
from quillgrid.operators import business as B
from quillgrid.operators import ordered as O
from quillgrid.operators import series as S
from quillgrid.operators import statistics as Q


def test_units_and_lookups(spark):
    row = spark.range(1).select(
        N.CONVERT(1, "hr", "min").column("a"), N.CONVERT(1, "kg", "lbm").column("b"), N.CONVERT(1, "lb", "kg").code("c"), K.PERCENTRANK(F.array(F.lit(1.0), F.lit(3.0)), 2).column("d"),
        K.HLOOKUP("y", F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("1"), F.lit("2"))), 2).column("e"), K.RANK(9, F.array(F.lit(1.0))).code("f"), K.TRIMMEAN(F.array(F.lit(1.0)), 1.0).code("g"),
    ).first()
    assert row.a == 60 and row.b == pytest.approx(1 / 0.45359237) and (row.c, row.d, row.e, row.f, row.g) == ("#N/A", 0.5, "2", "#N/A", "#NUM!")


def test_grades_refuse(spark):
    rows = spark.createDataFrame([("a", "x", 50.0), ("a", "x", 100.0), ("b", "x", 70.0), ("c", "x", 80.0), ("c", "x", 60.0), ("c", "y", 10.0)], "s string, c string, v double")
    with pytest.raises(ValueError):
        B.grades(rows, "s", "c", "v", {"x": 0.5, "y": 0.4})
    got = {r.s: (r.percentage, r.letter, r.error) for r in B.grades(rows, "s", "c", "v", {"x": 0.5, "y": 0.5}, 1).collect()}
    assert got == {"a": (100.0, "A", None), "b": (None, None, "#VALUE!"), "c": (None, None, "#VALUE!")}


def test_long_series_and_many_ranks(spark):
    rows = spark.createDataFrame([("g", i, float(i * 7 % 11)) for i in range(1000)], "g string, i int, v double")
    level, want = None, []
    for i in range(1000):
        level = float(i * 7 % 11) if level is None else 0.2 * float(i * 7 % 11) + 0.8 * level
        want.append(level)
    got = [r.smoothed for r in S.smooth(rows, ["g"], "i", "v", 0.2, block=64).orderBy("i").collect()]
    assert got == pytest.approx(want, rel=1e-12)
    assert Q.kendall(spark.createDataFrame([(i, i) for i in range(64)], "a int, b int"), "a", "b").first().kendall == 1.0


def test_running_over_a_hot_first_key(spark):
    """A first key with most rows is cut by the second one; numbers are as in one global window."""
    rows = [(None if i % 17 == 0 else 5 if i % 4 else i % 9, None if i % 13 == 0 else f"k{i * 7919 % 1000:04d}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, s string, i int")
    order = [F.col("a"), F.col("s"), F.col("i")]
    for down in (False, True):
        numbered = O.with_ordinal(df, order, descending=down).collect()
        last = lambda v: (v is None, v if v is not None else 0)
        text = lambda v: (v is None, v or "")
        wanted = sorted(rows, key=lambda r: (last(r[0]), text(r[1]), r[2]), reverse=down)
        assert [(r.a, r.s, r.i) for r in sorted(numbered, key=lambda r: r.ord)] == wanted
    buckets = df.select(O._fine_buckets(df, order, 8).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert buckets < 700  # the hot key has 1,411 rows


def test_whole_quantiles_are_exact(spark):
    df = spark.createDataFrame([(float(i * i % 101),) for i in range(997)] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    assert O.quantiles(df, "v", shares).first().q == df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("q")).first().q
    assert O.quantiles(df.filter("false"), "v", [0.5]).first().q == [None]
