"""Pivots, cross tables, lookups, set operations, deduplication, consolidation, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOLDS = {
    "SUM": lambda x: F.sum(x), "COUNT": lambda x: F.count(x).cast("double"), "AVERAGE": lambda x: F.avg(x),
    "MIN": lambda x: F.min(x), "MAX": lambda x: F.max(x),
}


def pivot(df: DataFrame, row: str, value: str, fold: str = "SUM", column: str | None = None) -> DataFrame:
    """row_label, [column_label,] value, level: cells and margins, all folded from the records.

    Margins are no folds of folds: an average's margin weighs every record. level: cell, row, column,
    grand. Rows without a label go; columns without one are ``(blank)``.
    """
    x = F.col(value).cast("double")
    rows = df.filter(F.col(row).isNotNull()).select(F.col(row).cast("string").alias("row_label"), x.alias("v"), *([F.coalesce(F.col(column).cast("string"), F.lit("(blank)")).alias("column_label")] if column else []))
    if not column:
        out = rows.rollup("row_label").agg(_FOLDS[fold]("v").alias("value"), F.grouping("row_label").alias("g"))
        return out.withColumn("level", F.when(F.col("g") == 1, "grand").otherwise("row")).drop("g")
    out = rows.cube("row_label", "column_label").agg(_FOLDS[fold]("v").alias("value"), F.grouping_id().alias("g"))
    return out.withColumn("level", F.element_at(F.array(F.lit("cell"), F.lit("row"), F.lit("column"), F.lit("grand")), (F.col("g") + 1).cast("int"))).drop("g")


def pivot_wide(df: DataFrame, row: str, column: str, value: str, fold: str = "SUM", columns: list | None = None) -> DataFrame:
    """One column for each label; give the labels where they are known, that saves a pass."""
    grouped = df.groupBy(row)
    return (grouped.pivot(column, columns) if columns else grouped.pivot(column)).agg(_FOLDS[fold](F.col(value).cast("double")))


def crosstab(df: DataFrame, row: str, column: str, value: str | None = None) -> DataFrame:
    """Counts, or sums with the number of values that are no numbers, by pair, with all margins."""
    if value is None:
        return df.cube(row, column).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("margin"))
    x = F.col(value).cast("string").try_cast("double")
    return df.cube(row, column).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.count_if(x.isNull()).alias("excluded"), F.grouping_id().alias("margin"))


def consolidate(regions: list[DataFrame], label: str, value: str, fold: str = "SUM") -> DataFrame:
    """Label and value of several tables folded by label; first_seen orders the labels."""
    tagged = [r.select(F.lit(i).alias("region"), F.col(label).alias("label"), F.col(value).cast("double").alias("v")) for i, r in enumerate(regions)]
    rows = reduce(DataFrame.unionByName, tagged).filter("label is not null")
    return rows.groupBy("label").agg(_FOLDS[fold]("v").alias("value"), F.min("region").alias("first_seen"))


def lookup(left: DataFrame, right: DataFrame, key: str, right_key: str, take: list[str], which: str = "first", order: str | None = None, fold_case: bool = False) -> DataFrame:
    """left with ``take`` columns of the first (last) matching row of right, and ``found``.

    The right side is cut to one row a key before the join, by a partial aggregate, so a key that
    many rows have costs one row a task; Spark broadcasts the rest where it is small.
    """
    k = lambda c: F.upper(c) if fold_case else c
    place = F.col(order) if order else F.lit(0)
    pick = F.min_by if which == "first" else F.max_by
    # among equal places the least row, so the pick is the same each time
    rows = F.struct(*[F.col(c).alias(c) for c in take])
    one = right.filter(F.col(right_key).isNotNull()).groupBy(k(F.col(right_key)).alias("_key")).agg(pick(rows, F.struct(place, rows)).alias("_hit"))
    out = left.join(one, k(F.col(key)) == F.col("_key"), "left")
    return out.select(*[F.col(c) for c in left.columns], *[F.col(f"_hit.{c}").alias(c) for c in take], F.col("_key").isNotNull().alias("found"))


def lookup_stairs(left: DataFrame, key: str, stairs: list[tuple[float, object]], name: str) -> DataFrame:
    """The value of the last stair not above the key (a short list, given on the driver); blank below the first."""
    if [s for s, _ in stairs] != sorted(s for s, _ in stairs):
        raise ValueError("the stairs have to rise")
    out = F.lit(None)
    for step, value in stairs:
        out = F.when(F.col(key) >= step, F.lit(value)).otherwise(out)
    return left.withColumn(name, out)


def as_of(left: DataFrame, right: DataFrame, on: str, right_on: str, take: str, by: list[str]) -> DataFrame:
    """left with ``take`` of the last right row at or before it, group by group: one union, one window."""
    a = left.withColumn("_at", F.col(on)).withColumn("_side", F.lit(1)).withColumn("_take", F.lit(None).cast(right.schema[take].dataType))
    b = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.col(take).alias("_take"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_take", F.last("_take", ignorenulls=True).over(w)).filter("_side = 1")
    return out.withColumnRenamed("_take", take if take not in left.columns else f"{take}_as_of").drop("_at", "_side")


def _distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(order).alias("first_seen"))


def union(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys, left ones first; side and first_seen give the order."""
    both = left.select(key, order, F.lit(0).alias("side")).unionByName(right.select(key, order, F.lit(1).alias("side")))
    seen = both.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct("side", F.col(order).alias("first_seen"))).alias("s"))
    return seen.select("key", "s.side", "s.first_seen")


def intersection(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    return _distinct(left, key, order).join(right.select(F.col(key).alias("key")).distinct(), "key", "left_semi")


def difference(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    return _distinct(left, key, order).join(right.select(F.col(key).alias("key")).filter("key is not null").distinct(), "key", "left_anti")


def unique(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values with where each was first seen."""
    return _distinct(df, key, order)


def dedup(df: DataFrame, keys: list[str], order: list[str], fold_case: bool = False) -> DataFrame:
    """The first row of each composite key (a blank is a key), by a partial aggregate rather than a window."""
    part = [F.upper(F.col(k)) if fold_case and df.schema[k].dataType.typeName() == "string" else F.col(k) for k in keys]
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*order, *rest)
    first = df.groupBy(*[p.alias(f"_k{i}") for i, p in enumerate(part)]).agg(F.min(row).alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def profile(df: DataFrame, column: str) -> DataFrame:
    """filled, empty, distinct, least, greatest, mean of a column, in one pass."""
    c = F.col(column)
    x = c.try_cast("double") if df.schema[column].dataType.typeName() == "string" else c.cast("double")
    return df.agg(F.count(c).alias("filled"), F.count_if(c.isNull()).alias("empty"), F.count_distinct(c).alias("distinct_values"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.avg(x).alias("mean"))


def best_match(left: DataFrame, right: DataFrame, column: str, candidate: str, threshold: float = 0.6, max_candidates: int = 10_000) -> DataFrame:
    """For each distinct text the most similar candidate at or over the threshold, the smallest on ties.

    Candidates are a dimension of checked size, held as one array beside each text.
    """
    names = sorted(r[0] for r in right.select(candidate).filter(F.col(candidate).isNotNull()).distinct().limit(max_candidates + 1).collect())
    if len(names) > max_candidates:
        raise ValueError(f"over {max_candidates} candidates: block them by a common key first")
    texts = left.select(F.col(column).alias("needle")).filter("needle is not null").distinct()
    a = F.upper("needle")
    score = lambda c: F.when(F.greatest(F.length(a), F.length(c)) == 0, 1.0).otherwise(1 - F.levenshtein(a, F.upper(c)) / F.greatest(F.length(a), F.length(c)))
    scored = F.transform(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda c: F.struct((-score(c)).alias("s"), c.alias("match")))
    best = texts.withColumn("best", F.array_min(scored))
    return best.select("needle", F.when(-F.col("best.s") >= threshold, F.col("best.match")).alias("match"), (-F.col("best.s")).alias("similarity"))


def totals(df: DataFrame, folds: dict[str, str]) -> DataFrame:
    """One fold for each column, in one pass."""
    return df.agg(*[_FOLDS[f](F.col(c).cast("double")).alias(c) for c, f in folds.items()])


def transpose(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, key, value) rows turned: one row for each old column, one column for each key; keys are few."""
    long = df.unpivot([key], columns, "column", "value")
    return long.groupBy("column").pivot(key).agg(F.first("value"))


def visible(df: DataFrame, criteria: Column, value: str) -> DataFrame:
    """Rows and sum that a filter leaves, beside the whole."""
    v = F.col(value).cast("double")
    return df.agg(F.count_if(criteria).alias("shown"), F.count_if(~criteria).alias("hidden"), F.sum(F.when(criteria, v)).alias("shown_sum"), F.sum(v).alias("whole_sum"))
