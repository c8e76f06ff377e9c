"""Conditions, choices, kinds of values, and bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .cell import NA as NOT_AVAILABLE
from .cell import VALUE, Cell, first_error, number, of, result, truthy


def _choose(pairs: list[tuple], otherwise: Cell) -> Cell:
    """The first (condition, Cell) that holds; only its error counts."""
    value, error = otherwise.value, otherwise.error
    failing = error is not None or any(c.error is not None for _, c in pairs)
    for condition, cell in reversed(pairs):
        value = F.when(condition, cell.value).otherwise(value)
        if failing:
            error = F.when(condition, cell.code()).otherwise(F.lit(None).cast("string") if error is None else error)
    return Cell(value, error)


def _guarded(chosen: Cell, *conditions: Cell) -> Cell:
    given = first_error(*conditions)
    if given is None:
        return chosen
    return Cell(F.when(given.isNull(), chosen.value), F.coalesce(given, chosen.code()))


def IF(condition, then, otherwise=False):
    c = truthy(condition)
    return _guarded(_choose([(c.value, of(then))], of(otherwise)), c)


def IFS(*pairs):
    tests = [truthy(c) for c in pairs[::2]]
    chosen = _choose([(t.value, of(v)) for t, v in zip(tests, pairs[1::2])], Cell(F.lit(None), F.lit(NOT_AVAILABLE)))
    return _guarded(chosen, *tests)


def SWITCH(subject, *rest):
    """Text cases are compared without regard to case."""
    s, default = of(subject), of(rest[-1]) if len(rest) % 2 else Cell(F.lit(None), F.lit(NOT_AVAILABLE))
    fold = lambda c: F.upper(c.value.cast("string"))
    cases = [of(c) for c in rest[: len(rest) // 2 * 2 : 2]]
    chosen = _choose([(F.coalesce(fold(s) == fold(c), F.lit(False)), of(v)) for c, v in zip(cases, rest[1::2])], default)
    return _guarded(chosen, s)


def CHOOSE(index, *values):
    i = number(index)
    return _guarded(_choose([(F.floor(i.value) == n, of(v)) for n, v in enumerate(values, 1)], Cell(F.lit(None), F.lit(VALUE))), i)


def IFERROR(x, fallback):
    c, other = of(x), of(fallback)
    return c if c.error is None else _choose([(c.error.isNull(), Cell(c.value))], other)


def IFNA(x, fallback):
    c, other = of(x), of(fallback)
    return c if c.error is None else _choose([(F.coalesce(c.error != NOT_AVAILABLE, F.lit(True)), c)], other)


def _all(cells, combine):
    values = [truthy(c) for c in cells]
    return result(reduce(combine, [v.value for v in values]), *values)


def AND(*conditions):
    """No argument is skipped: the first error wins even beside a false one."""
    return _all(conditions, lambda a, b: a & b)


def OR(*conditions):
    return _all(conditions, lambda a, b: a | b)


def XOR(*conditions):
    return _all(conditions, lambda a, b: a != b)


def NOT(condition):
    c = truthy(condition)
    return result(~c.value, c)


def compare(op: str, a, b) -> Cell:
    """Two values of one kind; text without regard to case, a blank as zero."""
    x, y = of(a), of(b)
    left, right = x.value, y.value
    out = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return result(F.coalesce(out, F.lit(op == "<>")), x, y)


def ISBLANK(x):
    c = of(x)
    return Cell(c.value.isNull() if c.error is None else c.value.isNull() & c.error.isNull())


def ISERROR(x):
    c = of(x)
    return Cell(F.lit(False) if c.error is None else c.error.isNotNull())


def ISERR(x):
    c = of(x)
    return Cell(F.lit(False) if c.error is None else F.coalesce(c.error != NOT_AVAILABLE, F.lit(False)))


def ISNA(x):
    c = of(x)
    return Cell(F.lit(False) if c.error is None else F.coalesce(c.error == NOT_AVAILABLE, F.lit(False)))


def _kind(x, *names):
    c = of(x)
    is_kind = F.typeof(c.value).isin(*names) & c.value.isNotNull()
    return Cell(is_kind if c.error is None else is_kind & c.error.isNull())


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def ISNUMBER(x):
    return _kind(x, *_NUMBERS)


def ISTEXT(x):
    return _kind(x, "string")


def ISLOGICAL(x):
    return _kind(x, "boolean")


def ISNONTEXT(x):
    return Cell(~ISTEXT(x).value)


def ISEVEN(x):
    n = number(x)
    return result(n.value.cast("long") % 2 == 0, n)


def ISODD(x):
    n = number(x)
    return result(n.value.cast("long") % 2 != 0, n)


def N(x):
    c = of(x)
    return result(F.coalesce(F.when(F.typeof(c.value) == "string", 0.0).otherwise(c.value.cast("string").try_cast("double")), F.when(c.value.cast("string") == "true", 1.0), F.lit(0.0)), c)


def T(x):
    c = of(x)
    return result(F.when((F.typeof(c.value) == "string") & c.value.isNotNull(), c.value.cast("string")).otherwise(""), c)


def NA():
    return Cell(F.lit(None), F.lit(NOT_AVAILABLE))


def TYPE(x):
    c = of(x)
    kind = F.typeof(c.value)
    plain = F.when(c.value.isNull(), 1).when(kind == "string", 2).when(kind == "boolean", 4).otherwise(1)
    return Cell(plain if c.error is None else F.when(c.error.isNotNull(), 16).otherwise(plain))


def LET(*arguments):
    """LET("name", value, ..., body): body is a function of the bindings, later values too if they are functions."""
    scope: dict[str, Cell] = {}
    for name, value in zip(arguments[:-1:2], arguments[1:-1:2]):
        scope[name] = of(value(scope) if callable(value) else value)
    return of(arguments[-1](scope))
