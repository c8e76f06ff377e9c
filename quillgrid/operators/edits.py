"""A grid as a log of edits: states, history, undo, structural edits, spills, protection.

Edits are rows (version, row, col, value[, author]) with rising versions; a null value clears the
cell. A state is the last edit of each cell up to a version, by a partial aggregate, so a batch of
edits is one job however many there are, and undo is a lower version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384


def column_letters(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA, up to XFD."""
    n = index.cast("int")
    first, second, third = n % 26, F.floor((n - 26) / 26) % 26, F.floor((n - 702) / 676)
    letter = lambda i: F.char(i + 65)
    return F.when(n < 26, letter(first)).when(n < 702, F.concat(letter(second), letter(first))).when(n < MAX_COLUMNS, F.concat(letter(third), letter(F.floor((n - 702) / 26) % 26), letter(first)))


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), (row + 1).cast("string"))


def parse_a1(text: Column, rows: int = MAX_ROWS) -> Column:
    """row, col, row_absolute, col_absolute of a reference; null where it is none.

    A sheet ends at MAX_ROWS; cells of a table may go on to ``rows``, 2**31 at most.
    """
    shape = r"^(\$?)([A-Za-z]{1,3})(\$?)([1-9][0-9]{0,9})$"
    letters = F.upper(F.regexp_extract(text, shape, 2))
    col = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1
    row = (F.regexp_extract(text, shape, 4).try_cast("long") - 1).cast("long")
    ok = text.rlike(shape) & (col < MAX_COLUMNS) & (row < min(rows, 1 << 31))
    row = F.when(row < 1 << 31, row).cast("int")
    return F.when(ok, F.struct(row.alias("row"), col.alias("col"), (F.regexp_extract(text, shape, 3) == "$").alias("row_absolute"), (F.regexp_extract(text, shape, 1) == "$").alias("col_absolute")))


def state(edits: DataFrame, version: int | None = None) -> DataFrame:
    """row, col, value, version of the cells that are there after a version (all of them by default)."""
    log = edits if version is None else edits.filter(F.col("version") <= version)
    last = log.groupBy("row", "col").agg(F.max(F.struct("version", "value")).alias("e"))
    return last.select("row", "col", F.col("e.value").alias("value"), F.col("e.version").alias("version")).filter("value is not null")


def diff_since(edits: DataFrame, version: int) -> DataFrame:
    """Cells whose value differs between a version and now: row, col, old, new."""
    at = lambda name, keep: F.max(F.when(keep, F.struct("version", "value")))["value"].alias(name)
    both = edits.groupBy("row", "col").agg(at("old", F.col("version") <= version), at("new", F.lit(True)))
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def blame(edits: DataFrame) -> DataFrame:
    """Who gave each cell its present value, when, and how often it was edited."""
    return edits.groupBy("row", "col").agg(F.max_by("author", "version").alias("author"), F.max("version").alias("version"), F.count(F.lit(1)).alias("edits"))


def insert(cells: DataFrame, at: int, n: int, axis: str = "row") -> DataFrame:
    """n rows (columns) before ``at``; what follows moves on."""
    return cells.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) + n).otherwise(F.col(axis)))


def delete(cells: DataFrame, at: int, n: int, axis: str = "row") -> DataFrame:
    """n rows (columns) from ``at`` on go; what follows moves up."""
    left = cells.filter(~F.col(axis).between(at, at + n - 1))
    return left.withColumn(axis, F.when(F.col(axis) >= at + n, F.col(axis) - n).otherwise(F.col(axis)))


def delete_edges(edges: DataFrame, at: int, n: int) -> DataFrame:
    """Edges (src_row, dst_row) after rows go: moved along, and wounded where what they read has gone."""
    move = lambda c: F.when(F.col(c) >= at + n, F.col(c) - n).otherwise(F.col(c))
    gone = F.col("src_row").between(at, at + n - 1)
    left = edges.filter(~F.col("dst_row").between(at, at + n - 1)).withColumn("error", F.when(gone, "#REF!"))
    return left.withColumn("src_row", F.when(~gone, move("src_row"))).withColumn("dst_row", move("dst_row"))


def spill(cells: DataFrame, block: DataFrame, row: int, col: int) -> DataFrame:
    """The block (row, col, value from 0) landed at an anchor, all of it or, if a cell is taken, #SPILL! at the anchor."""
    landed = block.select((F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), "value")
    taken = landed.join(cells.select("row", "col"), ["row", "col"], "left_semi").agg((F.count(F.lit(1)) > 0).alias("blocked"))
    out = landed.join(F.broadcast(taken))
    anchor = (F.col("row") == row) & (F.col("col") == col)
    shown = out.filter(~F.col("blocked") | anchor).select("row", "col", F.when(F.col("blocked"), F.lit("#SPILL!")).otherwise(F.col("value")).alias("value"))
    return cells.select("row", "col", "value").join(shown.select("row", "col"), ["row", "col"], "left_anti").unionByName(shown)


def sequence_block(n: int, start: float = 1.0, step: float = 1.0):
    """A column of n numbers, for ``spill``."""
    return lambda spark: spark.range(n).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), (F.lit(start) + F.col("id") * step).cast("string").alias("value"))


def inside(regions: list[tuple[int, int, int, int]]) -> Column:
    """Whether (row, col) is in one of a few rectangles (top, left, bottom, right)."""
    return reduce(lambda a, r: a | (F.col("row").between(r[0], r[2]) & F.col("col").between(r[1], r[3])), regions, F.lit(False))


def guard(edits: DataFrame, locked: list[tuple[int, int, int, int]], free: list[tuple[int, int, int, int]] = ()) -> DataFrame:
    """Edits with ``refused``: inside a locked rectangle and in no exception."""
    return edits.withColumn("refused", inside(locked) & ~inside(list(free)))


def merge_anchor(cells: DataFrame, merged: list[tuple[int, int, int, int]]) -> DataFrame:
    """Cells with the anchor of the merged rectangle they lie in: the cell that is shown for it."""
    row, col = F.col("row"), F.col("col")
    for top, left, bottom, right in merged:
        here = F.col("row").between(top, bottom) & F.col("col").between(left, right)
        row, col = F.when(here, top).otherwise(row), F.when(here, left).otherwise(col)
    return cells.withColumn("anchor_row", row).withColumn("anchor_col", col)
