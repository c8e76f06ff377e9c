"""Rules over columns: validation audits, conditional styles, slicers, hidden spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.criteria import criterion


def allowed(column: str, values: list) -> Column:
    return F.col(column).isin(values)


def between(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


def meets(column: str, text: str) -> Column:
    return criterion(F.col(column), text)


def audit(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of every breach, all rules in one pass; a blank breaks none."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def styles(df: DataFrame, rules: list[tuple[Column, str, bool]], name: str = "styles") -> DataFrame:
    """The styles of the rules that hold, in order of priority; a rule that stops ends the list."""
    stopped, parts = F.lit(False), []
    for condition, style, stops in rules:
        holds = F.coalesce(condition, F.lit(False))
        parts.append(F.when(holds & ~stopped, F.lit(style)))
        if stops:
            stopped = stopped | holds
    return df.withColumn(name, F.array_compact(F.array(*parts)))


def style_census(df: DataFrame, rules: list[tuple[Column, str, bool]]) -> DataFrame:
    """How many rows each style has; rules that never hold come back with zero."""
    styled = styles(df, rules).select("styles")
    return styled.agg(F.array(*[F.struct(F.lit(s).alias("style"), F.count_if(F.array_contains("styles", s)).alias("n")) for _, s, _ in rules]).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def slicer(df: DataFrame, column: str, off: list[str]) -> DataFrame:
    """Rows whose label is there and not switched off; labels that come later are on."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(off)) if off else df.filter(F.col(column).isNotNull())


def slicer_state(df: DataFrame, column: str, order: str, off: list[str]) -> DataFrame:
    """Each label, where it was first seen, and whether it is on."""
    seen = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.min(order).alias("first_seen"))
    return seen.withColumn("on", ~F.col("label").isin(off) if off else F.lit(True))


def outline(df: DataFrame, row: str, groups: list[tuple[int, int, bool]]) -> DataFrame:
    """level and hidden of rows under nested groups (start, end, collapsed); groups are a short list."""
    for i, (a, b, _) in enumerate(groups):
        if any(not (b < p or q < a or (p <= a and b <= q) or (a <= p and q <= b)) or (a, b) == (p, q) for p, q, _ in groups[:i]):
            raise ValueError("groups have to nest or stand apart")
    level, hidden = F.lit(0), F.lit(False)
    for a, b, collapsed in groups:
        inside = F.col(row).between(a, b)
        level = level + inside.cast("int")
        hidden = hidden | inside if collapsed else hidden
    return df.withColumn("level", level).withColumn("hidden", hidden)
