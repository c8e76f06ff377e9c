"""Aggregates over columns, for ``agg``: a Cell of an aggregate Column and of its error code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cell import DIV0, NA, NUM, VALUE, Cell, number, result
from .criteria import all_of, any_of


def _d(x: Column) -> Column:
    return x.cast("double")


def _or(value: Column, code: str) -> Cell:
    return result(value, fails=[(value.isNull(), code)])


def SUM(x: Column):
    return Cell(F.coalesce(F.sum(_d(x)), F.lit(0.0)))


def COUNT(x: Column):
    return Cell(F.count(x).cast("double"))


def AVERAGE(x: Column):
    return _or(F.avg(_d(x)), DIV0)


def MIN(x: Column):
    return _or(F.min(_d(x)), DIV0)


def MAX(x: Column):
    return _or(F.max(_d(x)), DIV0)


def PRODUCT(x: Column):
    return _or(F.product(_d(x)), VALUE)


def MEDIAN(x: Column):
    return _or(F.percentile(_d(x), F.lit(0.5)), NUM)


def STDEV(x: Column):
    return result(F.stddev_samp(_d(x)), fails=[(F.count(x) < 2, NUM)])


def STDEVP(x: Column):
    return _or(F.stddev_pop(_d(x)), NUM)


def VAR(x: Column):
    return result(F.var_samp(_d(x)), fails=[(F.count(x) < 2, NUM)])


def VARP(x: Column):
    return _or(F.var_pop(_d(x)), NUM)


def DEVSQ(x: Column):
    return _or(F.var_pop(_d(x)) * F.count(x), NUM)


def SKEW(x: Column):
    n = F.count(x)
    flat = _flat(x, x)
    value = F.skewness(_d(x)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return result(value, fails=[(n < 3, NUM), (flat, DIV0)])


def MODE(x: Column):
    """The smallest of the most frequent; without a repeat there is none."""
    repeated = F.count(x) > F.count_distinct(x)
    return result(F.mode(_d(x), True), fails=[(~repeated, NA)])


def PERCENTILE(x: Column, k: float):
    if not 0 <= k <= 1:
        return Cell(F.lit(None).cast("double"), F.lit(NUM))
    return _or(F.percentile(_d(x), F.lit(float(k))), NUM)


def QUARTILE(x: Column, q: int):
    return PERCENTILE(x, int(q) / 4)


def LARGE(x: Column, k: int):
    """The k-th largest of a group of a sheet's size; over large tables use ``operators.ordered.top``."""
    return _kth(x, k, True)


def SMALL(x: Column, k: int):
    return _kth(x, k, False)


def _kth(x: Column, k: int, largest: bool):
    n = F.count(x)
    values = F.sort_array(F.collect_list(_d(x)), asc=not largest)
    return result(F.get(values, F.lit(k - 1)), fails=[((n < k) | F.lit(k < 1), NUM)])


def GEOMEAN(x: Column):
    return result(F.exp(F.avg(F.ln(_d(x)))), fails=[(F.coalesce(F.min(_d(x)) <= 0, F.lit(True)), NUM)])


def HARMEAN(x: Column):
    return result(F.count(x) / F.sum(F.try_divide(F.lit(1.0), _d(x))), fails=[(F.coalesce(F.min(_d(x)) <= 0, F.lit(True)), NUM)])


def COVAR(x: Column, y: Column):
    return _or(F.covar_pop(_d(x), _d(y)), DIV0)


def _spread(x: Column, y: Column):
    return F.var_pop(F.when(y.isNotNull(), _d(x)))


def _flat(x: Column, y: Column):
    """One value only. Not a spread of zero: merged means of equal values can differ in the last bit."""
    pairs = F.when(y.isNotNull(), _d(x))
    return F.min(pairs) == F.max(pairs)


def SLOPE(y: Column, x: Column):
    return result(F.regr_slope(_d(y), _d(x)), fails=[(F.regr_count(y, x) < 2, NUM), (_flat(x, y), DIV0)])


def INTERCEPT(y: Column, x: Column):
    return result(F.regr_intercept(_d(y), _d(x)), fails=[(F.regr_count(y, x) < 2, NUM), (_flat(x, y), DIV0)])


def CORREL(y: Column, x: Column):
    r = F.when(_flat(y, x), 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(_d(x), _d(y)), F.sqrt(_spread(x, y) * _spread(y, x))), F.lit(0.0)))
    return result(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), fails=[(F.regr_count(y, x) < 2, NUM), (_flat(x, y), DIV0)])


def RSQ(y: Column, x: Column):
    r = CORREL(y, x)
    return Cell(F.pow(r.value, 2), r.error)


def FORECAST(at, y: Column, x: Column):
    a, slope, intercept = number(at), SLOPE(y, x), INTERCEPT(y, x)
    return result(slope.value * a.value + intercept.value, a, slope)


def SUMPRODUCT(*columns: Column):
    out = F.lit(1.0)
    for c in columns:
        out = out * F.coalesce(_d(c), F.lit(0.0))
    return Cell(F.coalesce(F.sum(out), F.lit(0.0)))


def SUMXMY2(x: Column, y: Column):
    return Cell(F.coalesce(F.sum((_d(x) - _d(y)) * (_d(x) - _d(y))), F.lit(0.0)))


def SUMX2MY2(x: Column, y: Column):
    return Cell(F.coalesce(F.sum(_d(x) * _d(x) - _d(y) * _d(y)), F.lit(0.0)))


def SUMX2PY2(x: Column, y: Column):
    return Cell(F.coalesce(F.sum(_d(x) * _d(x) + _d(y) * _d(y)), F.lit(0.0)))


def TEXTJOIN(delimiter: str, skip_empty: bool, x: Column, order: Column):
    """Of a group's values in order: an array of one group, for groups of a sheet's size."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(x.cast("string"), F.lit("")).alias("v")))), lambda s: s["v"])
    return Cell(F.array_join(F.filter(items, lambda v: v != "") if skip_empty else items, delimiter))


def COUNTIFS(*pairs: tuple[Column, str]):
    return Cell(F.count_if(all_of(*pairs)).cast("double"))


def SUMIFS(x: Column, *pairs: tuple[Column, str]):
    return Cell(F.coalesce(F.sum(F.when(all_of(*pairs), _d(x))), F.lit(0.0)))


def AVERAGEIFS(x: Column, *pairs: tuple[Column, str]):
    return _or(F.avg(F.when(all_of(*pairs), _d(x))), DIV0)


def MAXIFS(x: Column, *pairs: tuple[Column, str]):
    return Cell(F.coalesce(F.max(F.when(all_of(*pairs), _d(x))), F.lit(0.0)))


def MINIFS(x: Column, *pairs: tuple[Column, str]):
    return Cell(F.coalesce(F.min(F.when(all_of(*pairs), _d(x))), F.lit(0.0)))


def COUNTIF(x: Column, text: str):
    return COUNTIFS((x, text))


def SUMIF(x: Column, text: str, values: Column | None = None):
    return SUMIFS(x if values is None else values, (x, text))


def AVERAGEIF(x: Column, text: str, values: Column | None = None):
    return AVERAGEIFS(x if values is None else values, (x, text))


def DSUM(field: Column, *criteria: dict[str, str]):
    return _or(F.sum(F.when(any_of(*criteria), _d(field))), NUM)


def DAVERAGE(field: Column, *criteria: dict[str, str]):
    return _or(F.avg(F.when(any_of(*criteria), _d(field))), DIV0)


def DCOUNT(field: Column, *criteria: dict[str, str]):
    return Cell(F.count(F.when(any_of(*criteria), _d(field))).cast("double"))


def DMIN(field: Column, *criteria: dict[str, str]):
    return _or(F.min(F.when(any_of(*criteria), _d(field))), NUM)


def DMAX(field: Column, *criteria: dict[str, str]):
    return _or(F.max(F.when(any_of(*criteria), _d(field))), NUM)


def DGET(field: Column, *criteria: dict[str, str]):
    """The one record's field: none is #VALUE!, several are #NUM!."""
    hits = F.count_if(any_of(*criteria))
    return result(F.max(F.when(any_of(*criteria), field)), fails=[(hits == 0, VALUE), (hits > 1, NUM)])


_SUBTOTALS = {1: "avg", 2: "count", 4: "max", 5: "min", 9: "sum"}


def SUBTOTAL(code: int, x: Column, visible: Column):
    """Of visible rows only."""
    if code not in _SUBTOTALS:
        return Cell(F.lit(None).cast("double"), F.lit(VALUE))
    value = getattr(F, _SUBTOTALS[code])(F.when(visible, _d(x)))
    return _or(value, DIV0) if code == 1 else Cell(value.cast("double"))


def entropy(count: Column, total: Column) -> Column:
    """Bits of one category's share, to be summed."""
    p = count / total
    return F.when(count > 0, -p * F.log2(p)).otherwise(0.0)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(_d(x) * _d(w)), F.sum(_d(w)))


def weighted_std(x: Column, w: Column) -> Column:
    """Population; by sums, in one pass."""
    mean = weighted_mean(x, w)
    return F.sqrt(F.greatest(F.try_divide(F.sum(_d(w) * _d(x) * _d(x)), F.sum(_d(w))) - mean * mean, F.lit(0.0)))
