"""Lookups and ranks over ranges held in a row: arrays, and arrays of rows.

For tables use ``operators.tables.lookup`` and ``operators.ordered``; these are for a sheet's small
ranges, which travel in array columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cell import NA, NUM, VALUE, Cell, number, of, result


def MATCH(key, keys: Column) -> Cell:
    """Place from 1 of the first equal key."""
    k = of(key)
    place = F.array_position(keys, k.value)
    return result(F.nullif(place, F.lit(0)).cast("double"), k, fails=[(F.coalesce(place == 0, F.lit(True)), NA)])


def INDEX(table: Column, row, column=None) -> Cell:
    """The cell at (row, column) of a range of rows, or at a place of a single range."""
    i, j = number(row), None if column is None else number(column)
    at = lambda a, n: F.get(a, n.value.cast("int") - 1)
    outside = (i.value < 1) | (i.value > F.size(table))
    if j is None:
        return result(at(table, i), i, fails=[(outside, VALUE)])
    return result(at(at(table, i), j), i, j, fails=[(outside | (j.value < 1) | (j.value > F.size(F.get(table, F.lit(0)))), VALUE)])


def VLOOKUP(key, table: Column, column: int, approximate: bool = False) -> Cell:
    """A column of the first row whose first cell is the key; approximate: of the last row not over it, keys rising."""
    k = of(key)
    firsts = F.transform(table, lambda r: F.get(r, F.lit(0)))
    outside = F.lit(column < 1) | (F.size(F.get(table, F.lit(0))) < column)
    if not approximate:
        hits = F.filter(table, lambda r: F.get(r, F.lit(0)) == k.value)
        return result(F.get(F.get(hits, F.lit(0)), F.lit(column - 1)), k, fails=[(outside, VALUE), (F.coalesce(F.size(hits) == 0, F.lit(True)), NA)])
    falls = F.exists(F.zip_with(firsts, F.slice(firsts, F.lit(2), F.greatest(F.size(firsts) - 1, F.lit(0))), lambda a, b: F.coalesce(b < a, F.lit(False))), lambda x: x)
    upto = F.filter(table, lambda r: F.get(r, F.lit(0)) <= k.value)
    return result(F.get(F.try_element_at(upto, F.lit(-1)), F.lit(column - 1)), k, fails=[(outside | falls, VALUE), (F.coalesce(F.size(upto) == 0, F.lit(True)), NA)])


def HLOOKUP(key, table: Column, row: int) -> Cell:
    """A row's cell in the first column whose top cell is the key."""
    k = of(key)
    place = F.array_position(F.get(table, F.lit(0)), k.value)
    outside = F.lit(row < 1) | (F.size(table) < row)
    return result(F.get(F.get(table, F.lit(row - 1)), (place - 1).cast("int")), k, fails=[(outside, VALUE), (F.coalesce(place == 0, F.lit(True)), NA)])


def XLOOKUP(key, keys: Column, results: Column, otherwise=None, last: bool = False) -> Cell:
    """The result beside the first (last) equal key, text in any case; errors among keys or results are given as Cells' columns.

    otherwise: what an unknown key has instead of #N/A.
    """
    k = of(key)
    fold = lambda x: F.upper(x.cast("string"))
    rows = F.filter(F.arrays_zip(keys.alias("k"), results.alias("r")), lambda p: fold(p["k"]) == fold(k.value))
    found = F.try_element_at(rows, F.lit(-1 if last else 1))["r"]
    missing = F.coalesce(F.size(rows) == 0, F.lit(True))
    uneven = F.size(keys) != F.size(results)
    if otherwise is None:
        return result(found, k, fails=[(uneven, VALUE), (missing, NA)])
    return result(F.when(missing, otherwise if isinstance(otherwise, Column) else F.lit(otherwise)).otherwise(found), k, fails=[(uneven, VALUE)])


def _numbers(values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: x.cast("double"))


def RANK(x, values: Column, ascending: bool = False) -> Cell:
    """1 and one more for each value that beats x; x has to be among them."""
    n, v = number(x), _numbers(values)
    beaten = F.size(F.filter(v, lambda y: y < n.value if ascending else y > n.value))
    return result((beaten + 1).cast("double"), n, fails=[(F.coalesce(~F.array_contains(v, n.value), F.lit(True)), NA)])


def PERCENTRANK(values: Column, x) -> Cell:
    """The share of the way that x is through the sorted values, between two of them in proportion."""
    n, v = number(x), F.sort_array(_numbers(values))
    below = F.size(F.filter(v, lambda y: y < n.value))
    low, high = F.get(v, below - 1), F.get(v, below)
    inside = F.when(high == n.value, below.cast("double")).otherwise(below - 1 + F.try_divide(n.value - low, high - low))
    outside = (n.value < F.get(v, F.lit(0))) | (n.value > F.try_element_at(v, F.lit(-1)))
    return result(F.try_divide(inside, F.size(v) - 1), n, fails=[(F.size(v) < 2, NUM), (F.coalesce(outside, F.lit(True)), NA)])


def TRIMMEAN(values: Column, share: float) -> Cell:
    """The mean without int(n * share / 2) values at either end."""
    v = F.sort_array(_numbers(values))
    off = F.floor(F.size(v) * share / 2).cast("int")
    kept = F.slice(v, off + 1, F.greatest(F.size(v) - 2 * off, F.lit(0)))
    mean = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, y: a + y), F.size(kept))
    return result(mean, fails=[(F.lit(not 0 <= share < 1) | (F.size(v) == 0), NUM)])


def AVEDEV(values: Column) -> Cell:
    v = _numbers(values)
    mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, y: a + y), F.size(v))
    return result(F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, y: a + F.abs(y - mean)), F.size(v)), fails=[(F.size(v) == 0, NUM)])
