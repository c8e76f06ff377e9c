import pytest
from pyspark.sql import functions as F

from quillgrid.operators import edits as E
from quillgrid.operators import graph as R


def pyramid(spark):
    """A1=10, A2=20, B1=2*A1, B2=2*A2, C1=B1+B2, D1=A1+A2."""
    literals = spark.createDataFrame([("A1", 10.0), ("A2", 20.0)], "node string, value double")
    formulas = spark.createDataFrame([(n, "SUM") for n in ("B1", "B2", "C1", "D1")], "node string, fold string")
    edges = spark.createDataFrame([("A1", "B1", 2.0), ("A2", "B2", 2.0), ("B1", "C1", 1.0), ("B2", "C1", 1.0), ("A1", "D1", 1.0), ("A2", "D1", 1.0)], "src string, dst string, weight double")
    return literals, formulas, edges


def test_recalculation_sleeps_outside_the_cone(spark):
    literals, formulas, edges = pyramid(spark)
    full = R.recalculate(literals, formulas, edges)
    assert {r.node: r.value for r in full.collect()} == {"A1": 10, "A2": 20, "B1": 20, "B2": 40, "C1": 60, "D1": 30}
    edited = spark.createDataFrame([("A1", 100.0), ("A2", 20.0)], "node string, value double")
    again = R.recalculate(edited, formulas, edges, spark.createDataFrame([("A1",)], "node string"), full).collect()
    assert {r.node for r in again if r.evaluated} == {"B1", "C1", "D1"} and {r.node: r.value for r in again}["C1"] == 240


def test_cycles_and_errors(spark):
    literals, formulas, edges = pyramid(spark)
    loop = edges.unionByName(spark.createDataFrame([("C1", "B1", 1.0)], edges.schema))
    got = {r.node: r.error for r in R.recalculate(literals, formulas, loop).collect()}
    assert got == {"A1": None, "A2": None, "B1": "#CYCLE!", "B2": None, "C1": "#CYCLE!", "D1": None}
    values = spark.createDataFrame([("A1", "#REF!"), ("B1", "#REF!"), ("D1", "#NUM!")], "node string, error string")
    assert {r.node: r.born for r in R.error_origins(values, edges).collect()} == {"A1": True, "B1": False, "D1": True}
    assert R.fan_out(edges).first().src == "A1"


def test_loops_settle(spark):
    literals = spark.createDataFrame([("A1", 1000.0)], "node string, value double")
    formulas = spark.createDataFrame([("B1", "SUM"), ("C1", "SUM")], "node string, fold string")
    edges = spark.createDataFrame([("A1", "B1", 0.05), ("C1", "B1", 0.05), ("B1", "C1", 1.0)], "src string, dst string, weight double")
    got = {r.node: r.value for r in R.solve(literals, formulas, edges).collect()}
    assert got["B1"] == pytest.approx(1000 * 0.05 / 0.95, abs=1e-4)
    wild = edges.withColumn("weight", F.lit(2.0))
    assert {r.error for r in R.solve(literals, formulas, wild, rounds=5).collect()} == {None, "#NUM!"}


def test_edit_logs(spark):
    log = spark.createDataFrame([(1, 0, 0, "a", "x"), (2, 0, 0, "b", "y"), (3, 1, 0, "c", "x"), (4, 1, 0, None, "z")], "version int, row int, col int, value string, author string")
    show = lambda df, *n: sorted(tuple(r[c] for c in n) for r in df.collect())
    assert show(E.state(log), "row", "value") == [(0, "b")] and show(E.state(log, 3), "row", "value") == [(0, "b"), (1, "c")] and show(E.state(log, 1), "row", "value") == [(0, "a")]
    assert show(E.diff_since(log, 3), "row", "old", "new") == [(1, "c", None)] and show(E.diff_since(log, 1), "row", "old", "new") == [(0, "a", "b")]
    assert show(E.blame(log), "row", "author", "edits") == [(0, "y", 2), (1, "z", 2)]
    cells = E.state(log, 3)
    assert show(E.delete(E.insert(cells, 1, 2), 0, 1), "row", "value") == [(2, "c")]
    wounds = E.delete_edges(spark.createDataFrame([(0, 5), (1, 2), (9, 1)], "src_row int, dst_row int"), 1, 1)
    assert sorted(((r.src_row, r.dst_row, r.error) for r in wounds.collect()), key=str) == [(0, 4, None), (None, 1, "#REF!")]
    block = E.sequence_block(2)(spark)
    assert show(E.spill(cells, block, 2, 0), "row", "value") == [(0, "b"), (1, "c"), (2, "1.0"), (3, "2.0")]
    assert show(E.spill(cells, block, 5, 0).unionByName(cells.limit(0).select("row", "col", "value")), "row", "value")[-1] == (6, "2.0")
    taken = spark.createDataFrame([(3, 0, "t")], "row int, col int, value string")
    assert show(E.spill(taken, block, 2, 0), "row", "value") == [(2, "#SPILL!"), (3, "t")]
    assert show(E.guard(log, [(0, 0, 0, 9)], []), "version", "refused") == [(1, True), (2, True), (3, False), (4, False)]
    assert show(E.merge_anchor(cells, [(0, 0, 1, 1)]), "row", "anchor_row") == [(0, 0), (1, 0)]


def test_addresses(spark):
    want = {0: "A", 25: "Z", 26: "AA", 51: "AZ", 701: "ZZ", 702: "AAA", 16383: "XFD", 16384: None}
    got = spark.createDataFrame([(k,) for k in want], "k int").select("k", E.column_letters(F.col("k")).alias("s")).collect()
    assert {r.k: r.s for r in got} == want
    row = spark.range(1).select(E.parse_a1(F.lit("$b$12")).alias("a"), E.parse_a1(F.lit("A0")).alias("b"), E.parse_a1(F.lit("A1:B2")).alias("c")).first()
    assert tuple(row.a) == (11, 1, True, True) and row.b is None and row.c is None
