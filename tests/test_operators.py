"""Operators on the small fixtures of the worksheet vocabulary: errors, blanks, ties, order."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import aggregates as A
from quillgrid.functions.criteria import criterion
from quillgrid.operators import business as B
from quillgrid.operators import cells as G
from quillgrid.operators import graph as R
from quillgrid.operators import ordered as O
from quillgrid.operators import series as S
from quillgrid.operators import statistics as ST
from quillgrid.operators import tables as T
from quillgrid.sources import text_files as X

c = F.col


def rows(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_criteria(spark):
    df = spark.createDataFrame([("apples", 40.0), ("bread", 15.0), ("Apricots", 22.0), ("cheese", 8.0), ("apples", 10.0), (None, None)], "item string, qty double")
    count = lambda col, t: df.agg(A.COUNTIF(c(col), t).column("n")).first().n
    assert [count("item", t) for t in ("apples", "ap*", "<>zzz", "????s", "=cheese", "<>a*", ">b")] == [2, 3, 5, 0, 1, 2, 2]
    assert [count("qty", t) for t in (">10", "<>10", "=8", "<=15")] == [3, 4, 1, 3]
    assert [count("item", t) for t in ("<>5", "5")] == [5, 0]
    out = df.agg(A.SUMIF(c("item"), "ap*", c("qty")).column("s"), A.AVERAGEIF(c("item"), "mangoes", c("qty")).code("e")).first()
    assert tuple(out) == (72, "#DIV/0!")
    with pytest.raises(ValueError):
        criterion(c("item"), "")


def test_database_functions(spark):
    db = spark.createDataFrame([("Ada", "Eng", 120.0), ("Grace", "Eng", 130.0), ("Alan", "Ops", 90.0), ("Edsger", "Eng", 110.0), ("Barbara", "Ops", 95.0)], "Name string, Dept string, Salary double")
    crit = {"Dept": "Eng", "Salary": ">115"}
    x = c("Salary")
    assert tuple(db.agg(*[f(x, crit).column(n) for f, n in ((A.DSUM, "a"), (A.DAVERAGE, "b"), (A.DMIN, "c"), (A.DMAX, "d"), (A.DCOUNT, "e"))]).first()) == (250, 125, 120, 130, 2)
    none = {"Dept": "HR"}
    assert tuple(db.agg(A.DSUM(x, none).code("a"), A.DAVERAGE(x, none).code("b"), A.DCOUNT(x, none).column("c"), A.DGET(x, none).code("d"), A.DGET(x, crit).code("e"), A.DGET(x, {"Name": "ada"}).column("f")).first()) == ("#NUM!", "#DIV/0!", 0, "#VALUE!", "#NUM!", 120)


def test_aggregate_errors(spark):
    none = spark.createDataFrame([], "v double")
    x = c("v")
    got = none.agg(A.SUM(x).column("a"), A.COUNT(x).column("b"), A.AVERAGE(x).code("c"), A.MIN(x).code("d"), A.MEDIAN(x).code("e"), A.STDEV(x).code("f"), A.PRODUCT(x).code("g"), A.GEOMEAN(x).code("h")).first()
    assert tuple(got) == (0, 0, "#DIV/0!", "#DIV/0!", "#NUM!", "#NUM!", "#VALUE!", "#NUM!")
    df = spark.createDataFrame([(float(v), 5.0, 2 * v + 1.0) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "v double, flat double, y double")
    got = df.agg(A.MEDIAN(x).column("a"), A.MODE(x).column("b"), A.STDEVP(x).column("c"), A.LARGE(x, 2).column("d"), A.SMALL(x, 9).code("e"), A.SLOPE(c("y"), x).column("f"), A.SLOPE(x, c("flat")).code("g"), A.CORREL(c("flat"), x).column("h"), A.MODE(c("y") + x).column("i")).first()
    assert tuple(got) == (4.5, 4, pytest.approx(2), 7, "#NUM!", pytest.approx(2), "#DIV/0!", 0, 13)
    unique = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert unique.agg(A.MODE(x).code("m"), A.SKEW(x).code("s")).first() == ("#N/A", "#NUM!")


def test_pivot_margins_weigh_records(spark):
    df = spark.createDataFrame([("East", 100.0), ("East", 200.0), ("East", 300.0), ("West", 40.0), (None, 9.0)], "Region string, Sales double")
    got = {(r.row_label, r.level): r.value for r in T.pivot(df, "Region", "Sales", "AVERAGE").collect()}
    assert got == {("East", "row"): 200, ("West", "row"): 40, (None, "grand"): 160}
    df = spark.createDataFrame([("East", "Q1", 100.0), ("East", "Q2", 150.0), ("West", "Q1", 200.0), ("West", "Q2", 50.0), ("East", "Q1", 300.0), ("West", None, 1.0)], "r string, q string, s double")
    got = {(r.row_label, r.column_label, r.level): r.value for r in T.pivot(df, "r", "s", "SUM", "q").collect()}
    assert got[("East", "Q1", "cell")] == 400 and got[("East", None, "row")] == 550 and got[(None, "Q1", "column")] == 600 and got[(None, None, "grand")] == 801 and got[("West", "(blank)", "cell")] == 1


def test_lookups(spark):
    accounts = spark.createDataFrame([(1, "acct-1", "Ada"), (2, "acct-2", "Grace"), (3, "acct-1", "Alan"), (4, None, "none")], "ord int, acct string, owner string")
    keys = spark.createDataFrame([("ACCT-1",), ("acct-2",), ("zzz",), (None,)], "k string")
    first = {r.k: (r.owner, r.found) for r in T.lookup(keys, accounts, "k", "acct", ["owner"], "first", "ord", fold_case=True).collect()}
    last = {r.k: r.owner for r in T.lookup(keys, accounts, "k", "acct", ["owner"], "last", "ord", fold_case=True).collect()}
    assert first == {"ACCT-1": ("Ada", True), "acct-2": ("Grace", True), "zzz": (None, False), None: (None, False)} and last["ACCT-1"] == "Alan"
    stairs = T.lookup_stairs(spark.createDataFrame([(25,), (10,), (5,)], "v int"), "v", [(10, "a"), (20, "b"), (30, "c")], "s")
    assert rows(stairs, "s") == ["b", "a", None]
    with pytest.raises(ValueError):
        T.lookup_stairs(keys, "k", [(30, 1), (10, 2)], "s")


def test_sets_and_dedup(spark):
    a = spark.createDataFrame([(1, "Ada"), (2, "Grace"), (3, "Ada"), (4, None)], "ord int, key string")
    b = spark.createDataFrame([(1, "Grace"), (2, "Alan")], "ord int, key string")
    assert [r.key for r in T.union(a, b, "key", "ord").orderBy("side", "first_seen").collect()] == ["Ada", "Grace", "Alan"]
    assert rows(T.intersection(a, b, "key", "ord"), "key") == ["Grace"] and rows(T.difference(a, b, "key", "ord"), "key", "first_seen") == [("Ada", 1)]
    kept = T.dedup(spark.createDataFrame([(1, "Ada"), (2, "ada"), (3, None), (4, None)], "ord int, name string"), ["name"], ["ord"], fold_case=True)
    assert sorted(rows(kept, "ord")) == [1, 3]


def test_ranks_and_windows(spark):
    df = spark.createDataFrame([(1, 100), (2, 90), (3, 90), (4, 80), (5, None)], "i int, v int")
    for method, want in (("standard", [1, 2, 2, 4, None]), ("dense", [1, 2, 2, 3, None]), ("ordinal", [1, 2, 3, 4, None])):
        assert [r.k for r in O.rank(df, "v", "k", method, True, tie="i").orderBy("i").collect()] == want
    series = spark.createDataFrame([("g", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0])], "g string, i int, v double")
    assert [r.m for r in O.moving(series, [c("i")], "v", 2, "m", partition=["g"]).orderBy("i").collect()] == [None, None, None, 3.5]
    assert [r.m for r in O.moving(series, [c("i")], "v", 2, "m").orderBy("i").collect()] == [None, None, None, 3.5]
    assert [r.t for r in O.cumulative(series, [c("i")], "v", "t").orderBy("i").collect()] == [1, None, 4, 8]
    assert sorted(rows(O.choose_rows(df, [c("i")], [2, 2, 9]), "place", "v")) == [(1, 90), (2, 90)]
    assert sorted(rows(O.take(df, [c("i")], -2), "i")) == [4, 5] and sorted(rows(O.drop(df, [c("i")], -2), "i")) == [1, 2, 3]


def test_series(spark):
    abc = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 12.0), ("d", 5.0), ("e", 3.0)], "k string, v double")
    # labels break ties, so the order key is a number here
    keyed = abc.withColumn("k", F.ascii("k"))
    assert {chr(r.k): r.abc_class for r in S.abc(keyed, "k", "v").collect()} == {"a": "A", "b": "A", "c": "B", "d": "C", "e": "C"}
    spans = spark.createDataFrame([("g", 1, 4), ("g", 3, 6), ("g", 8, 9), ("g", 6, 6)], "g string, s int, e int")
    assert sorted(rows(S.merge_intervals(spans, ["g"], "s", "e"), "start", "end")) == [(1, 6), (8, 9)]
    assert rows(S.gaps(spans, ["g"], "s", "e"), "gap_start", "gap_end") == [(6, 8)]
    events = spark.createDataFrame([("g", 1, "buy", 10.0, 2.0), ("g", 2, "buy", 10.0, 3.0), ("g", 3, "sell", 15.0, 0.0)], "g string, i int, kind string, q double, cost double")
    assert rows(S.fifo(events, ["g"], ["i"], "kind", "q", "cost"), "cogs", "ending_value") == [(35, 15)]
    assert rows(S.stack_costing(events, ["g"], ["i"], "kind", "q", "cost"), "cogs", "ending_value") == [(40, 10)]
    assert rows(S.stack_costing(events, ["g"], ["i"], "kind", "q", "cost", "average"), "cogs", "ending_value") == [(37.5, 12.5)]
    smooth = S.smooth(spark.createDataFrame([("g", i, float(v)) for i, v in enumerate((1, 2, 3))], "g string, i int, v double"), ["g"], "i", "v", 0.5)
    assert [r.smoothed for r in smooth.orderBy("i").collect()] == [1, 1.5, 2.25]
    again = S.smooth(spark.createDataFrame([("g", i, float(v)) for i, v in enumerate((1, 2, 3))], "g string, i int, v double"), ["g"], "i", "v", 0.5, block=2)
    assert [r.smoothed for r in again.orderBy("i").collect()] == [1, 1.5, 2.25]


def test_statistics(spark):
    df = spark.createDataFrame([(float(i), float(j)) for i, j in enumerate((3, 1, 4, 1, 5, 9, 2, 6))], "a double, b double")
    pairs = [(i, j) for i in range(8) for j in range(i)]
    values = (3, 1, 4, 1, 5, 9, 2, 6)
    tau = sum((values[i] > values[j]) - (values[i] < values[j]) for i, j in pairs) / len(pairs)
    assert ST.kendall(df, "a", "b").first().kendall == pytest.approx(tau)
    assert ST.trimmed_mean(df, "b", 0.5).first().trimmed_mean == pytest.approx((2 + 3 + 4 + 5) / 4)
    got = spark.createDataFrame([(x,) for x in (-9.0, -1.0, 0.0, 1.96, 5.0)], "x double").select(ST.normal_cdf(c("x")).alias("p"))
    assert rows(got, "p") == pytest.approx([1.1285884e-19, 0.158655254, 0.5, 0.975002105, 1 - 2.866515719e-07], rel=1e-7)
    assert ST.kmeans_1d(df, "b", 2) == pytest.approx([(1 + 1 + 2 + 3) / 4, (4 + 5 + 6 + 9) / 4])


def test_graphs(spark):
    edges = spark.createDataFrame([("A", "C"), ("B", "C"), ("C", "D"), ("X", "Y"), ("Y", "X"), ("Y", "Z")], "src string, dst string")
    assert dict(rows(R.levels(edges), "node", "level")) == {"A": 0, "B": 0, "C": 1, "D": 2, "X": None, "Y": None, "Z": None}
    assert sorted(rows(R.reach(edges, spark.createDataFrame([("B",), ("X",)], "node string")), "node")) == ["B", "C", "D", "X", "Y", "Z"]
    tasks = spark.createDataFrame([("A", 3), ("B", 2), ("C", 2), ("D", 4)], "task string, duration int")
    got = {r.task: (r.start, r.finish, r.critical) for r in R.critical_path(tasks, edges.filter("src < 'X'")).collect()}
    assert got == {"A": (0, 3, True), "B": (0, 2, False), "C": (3, 5, True), "D": (5, 9, True)}


def test_business(spark):
    df = spark.createDataFrame([("g", i, 10, w) for i, w in enumerate((1, 1, 1))], "g string, i int, whole int, w int")
    assert [r.allocated for r in B.allocate(df, ["g"], "whole", "w", "i").orderBy("i").collect()] == [4, 3, 3]
    loan = B.amortize(spark.createDataFrame([(1000.0,)], "p double"), "p", 0.01, 12).orderBy("number").collect()
    assert loan[-1].balance == 0 and sum(r.principal_part for r in loan) == pytest.approx(1000) and loan[0].interest == 10
    book = B.depreciate(spark.createDataFrame([(1000.0, 0.0)], "c double, s double"), "c", "s", 5, "declining").orderBy("year").collect()
    assert book[-1].book == pytest.approx(77.76)
    pay = B.installments(spark.createDataFrame([(100.0,)], "b double"), "b", 3).orderBy("number").collect()
    assert [r.payment for r in pay] == [33.34, 33.33, 33.33]


def test_cells(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0)], "k int, x string, y double")
    cells = G.to_cells(df, "k")
    assert sorted(rows(cells, "row", "column", "value")) == [(1, 0, "a"), (1, 1, "2.0"), (2, 1, "3.0")]
    assert tuple(G.range_fold(cells, 1, 0, 2, 1).first()) == (5, 2, 2, 3)
    later = spark.createDataFrame([(1, 0, "b"), (2, 1, "3.0"), (5, 5, "new")], "row int, column int, value string")
    assert sorted(rows(G.snapshot_diff(cells, later), "row", "kind")) == [(1, "changed"), (1, "removed"), (5, "added")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('item,count,active,zip\napples,40,TRUE,00501\n"bread, ""rye""",15,FALSE,10001\n')
    df = X.read_csv(spark, str(tmp_path / "a.csv"))
    cells = X.infer_columns(df).orderBy("count.num").collect()
    assert cells[0].item.txt == 'bread, "rye"' and cells[0].active.bool is False and cells[1].zip.txt == "00501" and cells[0].zip.num == 10001
    assert X.import_report(df).first().asDict() == {"numbers": 3, "texts": 3, "booleans": 2, "blanks": 0, "zeros_protected": 1}
    (tmp_path / "f.txt").write_text("Widget  3   00042\nGadget  12  00007\nshort\n")
    spec = [X.FixedColumn("Item", 0, 8), X.FixedColumn("Qty", 8, 4), X.FixedColumn("Code", 12, 5)]
    assert rows(X.read_fixed(spark, str(tmp_path / "f.txt"), spec), "Item", "Qty", "Code") == [("Widget", "3", "00042"), ("Gadget", "12", "00007"), ("short", None, None)]
    (tmp_path / "long.txt").write_text("x" * 40)
    with pytest.raises(Exception, match="line too long"):
        X.read_fixed(spark, str(tmp_path / "long.txt"), spec).collect()
    assert X.to_html(spark.createDataFrame([("<a>", 1)], "s string, n int")) == '<table><thead><tr><th>s</th><th>n</th></tr></thead><tbody><tr><td>&lt;a&gt;</td><td class="num">1</td></tr></tbody></table>'


def test_streams(spark, tmp_path):
    from quillgrid.streaming import events as E

    src = spark.createDataFrame([("2024-01-01 00:00:10", "u", 1.0), ("2024-01-01 00:00:50", "u", 3.0), ("2024-01-01 00:01:10", "v", 5.0)], "ts string, user string, value double").withColumn("ts", F.to_timestamp("ts"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("w", E.windowed(stream, "ts", "1 minute", "1 minute", None, ["user"], [F.sum("value").alias("total")]), "complete"), ("l", E.smoothed(stream, "user", "ts", "value", 0.5), "update")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(rows(spark.table("w"), "user", "total")) == [("u", 4), ("v", 5)]
    assert sorted(rows(spark.table("l"), "user", "level")) == [("u", 2), ("v", 5)]
