"""Grids in long form: cells by (row, column), differences of two states, what-if tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.finance import bisect


def to_cells(df: DataFrame, key: str) -> DataFrame:
    """row, column, value (as text) of every cell that is not blank: a sparse store, one row a cell."""
    columns = [c for c in df.columns if c != key]
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.col(key).alias("row"), F.explode(cells).alias("c")).select("row", "c.column", "c.value").filter("value is not null")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells that were added, removed or changed between two states."""
    a, b = before.withColumnRenamed("value", "old"), after.withColumnRenamed("value", "new")
    both = a.join(b, ["row", "column"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.withColumn("kind", kind)


def range_fold(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """SUM, COUNT, MIN, MAX of the numbers in a rectangle, both ends included."""
    x = F.col("value").try_cast("double")
    inside = cells.filter(F.col("row").between(top, bottom) & F.col("column").between(left, right))
    return inside.agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def across_sheets(cells: DataFrame, sheets: list[str], row: int, column: int) -> DataFrame:
    """One cell of several sheets (sheet, row, column, value), folded."""
    x = F.col("value").try_cast("double")
    return cells.filter(F.col("sheet").isin(sheets) & (F.col("row") == row) & (F.col("column") == column)).agg(F.sum(x).alias("total"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def data_table(df: DataFrame, inputs: dict[str, list[float]], result: dict[str, Column]) -> DataFrame:
    """Every row under every combination of a few input values, which formulas see as columns."""
    out = df
    for name, values in inputs.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out.withColumns(result)


def scenarios(df: DataFrame, cases: dict[str, dict[str, float]], result: dict[str, Column]) -> DataFrame:
    """Every row under each named set of inputs."""
    names = sorted({k for c in cases.values() for k in c})
    array = F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(None if k not in c else float(c[k])).cast("double").alias(k) for k in names]) for n, c in cases.items()])
    return df.withColumn("_case", F.explode(array)).select(*df.columns, "_case.*").withColumns(result)


def goal_seek(f, target: Column, low: float, high: float) -> Column:
    """The input at which f comes to the target, row by row, f monotone between low and high."""
    return bisect(lambda x: f(x) - target, F.lit(low), F.lit(high))
