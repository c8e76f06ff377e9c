"""Steps whose cost or whose results went wrong on larger tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgrid.functions import aggregates as A
from quillgrid.functions import finance as M
from quillgrid.functions import maths as N
from quillgrid.functions import text as T
from quillgrid.operators import business as B
from quillgrid.operators import edits as E


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_factors_of_whole_batches(spark):
    """Each batch by numpy: no array of all odd numbers to the root in a row; none below one."""
    wanted = {360: {2: 3, 3: 2, 5: 1}, 1: {}, 2: {2: 1}, 4: {2: 2}, 1_199_999: {1_199_999: 1}, 2683 * 2683: {2683: 2}, 2 * 999_983: {2: 1, 999_983: 1}, 999_999_000_001: None, 999_983 * 999_979: {999_979: 1, 999_983: 1}, 1 << 39: {2: 39}}
    df = spark.createDataFrame([(k,) for k in wanted] + [(None,), (0,), (-12,)], "n long")
    f = N.prime_factors(F.col("n"))
    out = df.select("n", f.alias("f"), N.product_of(f).alias("product"))
    got = {r.n: r for r in out.collect()}
    for n, factors in wanted.items():
        assert got[n].product == n and (factors is None or [(x.prime, x.power) for x in got[n].f] == sorted(factors.items())), n
    assert got[None].f is None and got[0].f is None and got[-12].f is None
    assert "sequence" not in plan(df.select(f))
    dense = {r.n: math.prod(x.prime**x.power for x in r.f) for r in spark.range(1, 3000).select(F.col("id").alias("n"), N.prime_factors(F.col("id")).alias("f")).collect()}
    assert dense == {n: n for n in range(1, 3000)}


def test_next_prime_far_and_refused(spark):
    row = spark.range(1).select(N.next_prime(113).column("a"), N.next_prime(31397).column("b"), N.next_prime(1_000_000).code("c"), N.next_prime(7, 10).code("d"), N.next_prime(5, 7).column("e"), N.next_prime(-4).column("f")).first()
    assert tuple(row) == (127, 31469, "#NUM!", "#NUM!", 7, 2)


def test_few_steps_find_a_root(spark):
    """Twelve steps of halving alone leave 2**-12 of the bracket."""
    row = spark.range(1).select(
        M.bisect(lambda r: M.bond_price(1000, 0.05, 10, r) - 900, F.lit(-0.9999), F.lit(10.0), 12).alias("a"), M.bisect(lambda x: x * x * x - 8, F.lit(-5.0), F.lit(100.0), 20).alias("b"), M.bisect(lambda x: x - 2, F.lit(2.0), F.lit(3.0)).alias("c"),
        M.bisect(lambda x: x - 2, F.lit(1.0), F.lit(2.0)).alias("d"), M.bisect(lambda x: x + 1, F.lit(0.0), F.lit(7.0)).alias("e"), M.bisect(lambda x: F.lit(1.0) - x, F.lit(-3.0), F.lit(5.0)).alias("f"), M.bisect(lambda x: F.signum(x - 0.3), F.lit(0.0), F.lit(1.0)).alias("g"),
    ).first()
    assert tuple(row) == pytest.approx((0.06383471023, 2.0, 2.0, 2.0, 7.0, 1.0, 0.3), rel=1e-9)


def test_addresses_beyond_a_sheet(spark):
    df = spark.createDataFrame([(1_048_575, 5), (1_048_576, 0), (1_199_999, 16_383), (2**31 - 1, 1)], "r long, c int").select("r", "c", E.a1(F.col("r"), F.col("c")).alias("a"))
    got = df.select("r", "c", E.parse_a1(F.col("a"), 1 << 31).alias("p"), E.parse_a1(F.col("a")).isNull().alias("off")).orderBy("r").collect()
    assert [(r.p.row, r.p.col) for r in got] == [(r.r, r.c) for r in got] and [r.off for r in got] == [False, True, True, True]
    assert spark.range(1).select(E.parse_a1(F.lit("A2147483649"), 1 << 31).isNull()).first()[0]


def test_grades_do_not_hang_on_the_order_of_rows(spark):
    weights = {"a": 0.5, "b": 0.2, "c": 0.3}
    rows = [(f"s{i}", k, float((i * 37 + j * 11 + n * 13) % 101)) for i in range(200) for j, k in enumerate("cab") for n in range(3)]
    mean = lambda i, k: sum(v for s, c, v in rows if (s, c) == (f"s{i}", k)) / 3
    wanted = {f"s{i}": (mean(i, "a") * 0.5 + mean(i, "b") * 0.2 + mean(i, "c") * 0.3) / (0.5 + 0.2 + 0.3) for i in range(200)}
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "s string, c string, v double").repartition(parts, "v")
        assert {r.s: r.percentage for r in B.grades(df, "s", "c", "v", weights).collect()} == wanted


def test_a_flat_range_in_many_parts(spark):
    """Means of 49 ones are merged to 1 - 2**-53; that is no spread."""
    df = spark.range(49 * 3 + 64).select("id", F.lit(1.0).alias("one"), (F.col("id") * 1.1).alias("v")).repartitionByRange(4, F.when(F.col("id") < 147, F.floor(F.col("id") / 49)).otherwise(3))
    row = df.agg(A.SLOPE(F.col("v"), F.col("one")).code("slope"), A.INTERCEPT(F.col("v"), F.col("one")).code("intercept"), A.CORREL(F.col("one"), F.col("v")).column("r"), A.RSQ(F.col("one"), F.col("v")).column("rsq"), A.CORREL(F.col("v"), F.col("one")).code("code"), A.SKEW(F.col("one")).code("skew")).first()
    assert tuple(row) == ("#DIV/0!", "#DIV/0!", 0.0, 0.0, "#DIV/0!", "#DIV/0!")


def test_numerals_are_read_once(spark):
    n = F.col("id") + 1
    df = spark.range(3999).select((F.col("id") + 1).alias("n"), T.from_roman(F.lower(T.to_roman(n).column())).column("back"))
    assert all(r.n == r.back for r in df.collect())
    assert len(plan(df)) < 40_000  # each sign of a numeral wrote the whole numeral again
    refused = ["IIII", "VX", "IC", "", "MMMM", "XIIX", "CMCM", "A"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in refused], "s string").select(T.from_roman(F.col("s")).code("e")).collect()] == ["#NUM!"] * len(refused)
    assert spark.range(1).select(T.to_roman(0).code("a"), T.to_roman(4000).code("b")).first() == ("#NUM!", "#NUM!")


def customers(spark, tmp_path, rows):
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def like_sql(spark, name, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
    return sorted(map(repr, db.execute(entry.oracle_sql()[name]).fetchall())) == sorted(repr(tuple(r)) for r in entry.queries()[name](spark, folder).collect())


def test_number_text_of_large_keys_and_blanks(spark, tmp_path):
    assert like_sql(spark, "number_text", customers(spark, tmp_path, [(0, "a", -0.5), (16**6 - 1, "b", 1234.5), (16**6, "c", 10.0), (2**50 + 1, "d", None)]))
    assert spark.range(1).select(T.to_base(F.lit(2**53 + 1), 16)).first()[0] == "20000000000001"


def test_locale_numbers_of_blanks(spark, tmp_path):
    assert like_sql(spark, "locale_numbers", customers(spark, tmp_path, [(1, "a", -0.5), (899_999, "b", 1234567.5), (2, "c", None), (4 * 10**12 + 1, "d", 0.25)]))


def test_valleys_found_once(spark):
    """A step takes one new value of f, and the loop is written once, not once for each end."""
    low = M.minimize(lambda x: F.abs(x - F.col("id") / 7), F.lit(-100.0), F.lit(100.0))
    df = spark.range(20).select("id", low.alias("low"), M.maximize(lambda x: -(x + 3) * (x + 3), F.lit(-100.0), F.lit(100.0)).alias("high"), M.minimize(lambda x: x, F.lit(2.0), F.lit(5.0)).alias("end"))
    for r in df.collect():
        assert (r.low, r.high, r.end) == (pytest.approx(r.id / 7, abs=1e-7), pytest.approx(-3, abs=1e-7), pytest.approx(2, abs=1e-9))
    assert plan(spark.range(1).select(low.alias("low"))).count("aggregate(") == 1
