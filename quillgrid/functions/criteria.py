"""The criteria language: ``>10``, ``<>x``, ``=ap*``, ``Eng`` as predicates over columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPERATORS = ("<>", "<=", ">=", "<", ">", "=")


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def criterion(column: Column, text: str, numeric: bool | None = None) -> Column:
    """True where the column meets the criterion; blanks never do.

    A number in the criterion compares as a number; other text compares without regard to case, and
    ``*`` and ``?`` are wildcards after ``=``, ``<>`` or nothing. numeric says whether the column has
    numbers (text in a column of text never equals a number, so ``<>5`` holds for it).
    """
    operator = next((o for o in _OPERATORS if text.startswith(o)), "")
    body = text[len(operator):]
    if not body and not operator:
        raise ValueError("the criterion is empty")
    operator = operator or "="
    value = _number(body)
    if value is not None:
        x = column.try_cast("double") if numeric is not False else F.lit(None).cast("double")
        y = F.lit(value)
        out = {"=": x == y, "<>": x.isNull() | (x != y), "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[operator]
    else:
        x, y = F.upper(column.cast("string")), F.lit(body.upper())
        if operator in ("=", "<>") and re.search(r"[*?]", body):
            pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in body.upper()) + "$"
            like = x.rlike(pattern)
            out = like if operator == "=" else ~like
        else:
            out = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[operator]
    return F.coalesce(column.isNotNull() & out, F.lit(False))


def all_of(*pairs: tuple[Column, str]) -> Column:
    out = F.lit(True)
    for column, text in pairs:
        out = out & criterion(column, text)
    return out


def any_of(*rows: dict[str, str]) -> Column:
    """Rows of a criteria block: each an AND over its columns, joined by OR."""
    out = F.lit(False)
    for row in rows:
        out = out | all_of(*[(F.col(c), t) for c, t in row.items()])
    return out
