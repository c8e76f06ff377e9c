"""Values that carry errors: a value column with a companion column for the error code.

A worksheet function takes and gives Cells. The error of a result is the first error of its arguments
in order, then its own; where no argument can fail the companion is absent and costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DIV0, VALUE, REF, NAME, CYCLE, NUM, NA = "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#CYCLE!", "#NUM!", "#N/A"


@dataclass(frozen=True)
class Cell:
    value: Column
    error: Column | None = None

    def column(self, name: str | None = None) -> Column:
        """The value, null where there is an error."""
        out = self.value if self.error is None else F.when(self.error.isNull(), self.value)
        return out.alias(name) if name else out

    def code(self, name: str | None = None) -> Column:
        """The error code, null where there is none."""
        out = F.lit(None).cast("string") if self.error is None else self.error
        return out.alias(name) if name else out

    def struct(self, name: str) -> Column:
        return F.struct(self.column("value"), self.code("error")).alias(name)

    def rendered(self, name: str | None = None) -> Column:
        """As a sheet shows it: the error code, or the value as text."""
        out = F.coalesce(self.code(), render(self.column()))
        return out.alias(name) if name else out


def of(x: Any) -> Cell:
    """A Cell of a Cell, a Column, or a literal (text is a literal; name columns with F.col)."""
    return x if isinstance(x, Cell) else Cell(x if isinstance(x, Column) else F.lit(x))


def number(x: Any) -> Cell:
    """Numeric operand: booleans are 1 and 0, blanks are 0."""
    c = of(x)
    return Cell(F.coalesce(c.value.cast("double"), F.lit(0.0)), c.error)


def first_error(*cells: Cell) -> Column | None:
    errors = [c.error for c in cells if c.error is not None]
    return F.coalesce(*errors) if len(errors) > 1 else errors[0] if errors else None


def result(value: Column, *cells: Cell, fails: list[tuple[Column, str]] = ()) -> Cell:
    """A value of ``cells``; fails: (condition, code) of its own errors, the first that holds."""
    own = None
    for condition, code in fails:
        own = F.when(condition, F.lit(code)) if own is None else own.when(condition, F.lit(code))
    given = first_error(*cells)
    error = own if given is None else given if own is None else F.coalesce(given, own)
    if error is not None:
        value = F.when(error.isNull(), value)
    return Cell(value, error)


def bad(x: Column) -> Column:
    """Neither a number nor finite."""
    return ~F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))  # NaN is above infinity


def bound(x: Column, f) -> Column:
    """f of x with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def truthy(x: Any) -> Cell:
    """A condition: booleans as they are, numbers that are not zero; blank is false."""
    c = of(x)
    return Cell(F.coalesce(c.value.cast("boolean"), F.lit(False)), c.error)


def render(x: Column) -> Column:
    """Text of a value: whole numbers below 1e15 without a fraction, booleans in capitals, blanks empty."""
    text = x.cast("string")
    as_number = x.try_cast("double")
    whole = text.rlike(r"^-?[0-9]+\.0$|^-?[0-9.]+E[0-9]+$") & (F.abs(as_number) < 1e15) & (as_number == F.floor(as_number))
    return F.coalesce(F.when(whole, as_number.cast("decimal(18,0)").cast("string")).when(text.isin("true", "false"), F.upper(text)).otherwise(text), F.lit(""))
