"""Series: shares, classes, growth, smoothing, seasons, runs, intervals, bins, costing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_ordinal, with_running


def pareto(df: DataFrame, label: str, value: str, threshold: float = 0.8) -> DataFrame:
    """label, value, share, cumulative, vital: from the largest on, vital until the threshold is crossed."""
    rows = df.groupBy(label).agg(F.sum(value).alias("value"))
    total = rows.agg(F.sum("value").alias("_total"))
    out = with_running(rows, [F.col("value"), F.col(label)], "_running", F.col("value"), descending=True).join(F.broadcast(total))
    out = out.withColumn("share", F.col("value") / F.col("_total")).withColumn("cumulative", F.col("_running") / F.col("_total"))
    return out.withColumn("vital", F.col("cumulative") - F.col("share") < threshold).drop("_running", "_total")


def abc(df: DataFrame, label: str, value: str, a: float = 0.8, b: float = 0.95) -> DataFrame:
    """Classes A, B, C by cumulative share."""
    c = F.col("cumulative")
    return pareto(df, label, value).withColumn("abc_class", F.when(c <= a + 1e-12, "A").when(c <= b + 1e-12, "B").otherwise("C")).drop("vital")


def waterfall(df: DataFrame, order: list[Column], delta: str, start: float, partition: list[str]) -> DataFrame:
    """base, top, direction of each bar of a running total."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("top", F.lit(start) + F.sum(delta).over(w)).withColumn("base", F.col("top") - F.col(delta))
    return out.withColumn("direction", F.when(F.col(delta) >= 0, "up").otherwise("down"))


def growth(df: DataFrame, order: str, value: str, partition: list[str]) -> DataFrame:
    """total_growth and the compound rate a period, from first to last of each group."""
    ends = df.groupBy(*partition).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), (F.count(value) - 1).alias("periods"))
    ratio = F.try_divide(F.col("last_value"), F.col("first_value"))
    rate = F.when((F.col("first_value") > 0) & (F.col("last_value") > 0) & (F.col("periods") > 0), F.pow(ratio, 1 / F.col("periods")) - 1)
    return ends.withColumn("total_growth", ratio - 1).withColumn("cagr", rate)


def _ordered_array(value: str, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda s: s["v"])


def smooth(df: DataFrame, partition: list[str], order: str, value: str, alpha: float, block: int = 512) -> DataFrame:
    """Every row with ``smoothed``: simple exponential smoothing of each series, rows with a blank value left out.

    A level is linear in the one before: after n rows it is (1 - alpha)^n of that and a weighted sum. So a series is cut
    into blocks of ``block`` rows; sums inside a block are a window, what a block hands on is one number, and
    only these numbers are folded in order. No series is held in one row.
    """
    keep = 1 - alpha
    whole = Window.partitionBy(*partition).orderBy(order)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(whole) - 1)
    rows = rows.withColumn("_block", F.floor(F.col("_n") / block)).withColumn("_i", (F.col("_n") % block).cast("int"))
    # the first value of a series is its first level
    weight = F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.lit(float(alpha)))
    own = Window.partitionBy(*partition, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    near = F.collect_list(weight * F.col(value).cast("double")).over(own)  # at most ``block`` numbers
    rows = rows.withColumn("_sum", F.aggregate(near, F.lit(0.0), lambda a, x: a * keep + x))
    ends = rows.groupBy(*partition, "_block").agg(F.max_by("_sum", "_n").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = F.aggregate(F.coalesce(F.collect_list(F.struct("_sum", "_rows")).over(before), F.array()), F.lit(0.0), lambda a, e: a * F.pow(F.lit(keep), e["_rows"]) + e["_sum"])
    ends = ends.select(*partition, "_block", handed.alias("_before"))
    out = rows.join(ends, [*partition, "_block"])
    return out.withColumn("smoothed", F.col("_sum") + F.col("_before") * F.pow(F.lit(keep), F.col("_i") + 1)).drop("_n", "_block", "_i", "_sum", "_before")


def holt(df: DataFrame, partition: list[str], order: str, value: str, alpha: float, beta: float, ahead: int = 1) -> DataFrame:
    """level, trend and forecast of double smoothing, from the second value on."""
    rows = df.groupBy(*partition).agg(_ordered_array(value, order).alias("series")).filter(F.size("series") >= 2)
    first, second = F.get("series", F.lit(0)), F.get("series", F.lit(1))
    start = F.struct(first.alias("level"), (second - first).alias("trend"))

    def step(s, x):
        level = alpha * x + (1 - alpha) * (s["level"] + s["trend"])
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * s["trend"]).alias("trend"))

    rows = rows.withColumn("s", F.aggregate(F.slice("series", F.lit(2), F.size("series") - 1), start, step))
    return rows.select(*partition, F.col("s.level").alias("level"), F.col("s.trend").alias("trend"), (F.col("s.level") + ahead * F.col("s.trend")).alias("forecast"))


def seasonal_indices(df: DataFrame, season: Column, value: str) -> DataFrame:
    """Season averages over the average of them all, so they add up to the number of seasons."""
    means = df.groupBy(season.alias("season")).agg(F.avg(value).alias("mean"))
    return means.join(F.broadcast(means.agg(F.avg("mean").alias("grand")))).select("season", (F.col("mean") / F.col("grand")).alias("season_index"))


def deseasonalize(df: DataFrame, season: Column, value: str, indices: DataFrame, name: str = "adjusted") -> DataFrame:
    """value over its season's index (of ``seasonal_indices``: one row a season, so it is broadcast); blank for an index of 0."""
    return _by_season(df, season, indices).withColumn(name, F.try_divide(F.col(value), F.col("_index"))).drop("_index")


def reseasonalize(df: DataFrame, season: Column, value: str, indices: DataFrame, name: str = "seasonal") -> DataFrame:
    return _by_season(df, season, indices).withColumn(name, F.col(value) * F.col("_index")).drop("_index")


def _by_season(df: DataFrame, season: Column, indices: DataFrame) -> DataFrame:
    known = indices.select(F.col("season").alias("_season"), F.col("season_index").alias("_index"))
    return df.withColumn("_own", season).join(F.broadcast(known), F.col("_own") == F.col("_season"), "left").drop("_own", "_season")


def compression_ratio(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours for each value, group by group."""
    return runs(df, partition, order, value).groupBy(*partition).agg((F.count(F.lit(1)) / F.sum("length")).alias("ratio"))


def class_totals(classes: DataFrame) -> DataFrame:
    """How many items ``abc`` has in A, B and C; none is 0."""
    names = classes.sparkSession.createDataFrame([("A",), ("B",), ("C",)], "abc_class string")
    counts = classes.groupBy("abc_class").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "abc_class", "left").select("abc_class", F.coalesce("n", F.lit(0)).alias("n"))


def runs(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: run, value, length."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*partition, "run").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("length"))


def expand_runs(df: DataFrame, value: str, length: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != length], F.posexplode(F.array_repeat(F.lit(1), F.col(length).cast("int"))).alias("place", "_one")).drop("_one")


def merge_intervals(df: DataFrame, partition: list[str], start: str, end: str) -> DataFrame:
    """Touching and overlapping intervals as one, group by group."""
    w = Window.partitionBy(*partition).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*partition, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"))


def gaps(df: DataFrame, partition: list[str], start: str, end: str) -> DataFrame:
    """Holes between merged intervals."""
    merged = merge_intervals(df, partition, start, end)
    w = Window.partitionBy(*partition).orderBy("start")
    out = merged.withColumn("gap_end", F.lead("start").over(w)).withColumnRenamed("end", "gap_start")
    return out.filter("gap_end is not null").select(*partition, "gap_start", "gap_end")


def conflicts(df: DataFrame, partition: list[str], order: str, start: str, end: str) -> DataFrame:
    """For each interval how many earlier-numbered ones of its group overlap it (touching does not count).

    Sweep, not pairs: openings before its end less closings up to its start.
    """
    points = df.select(*partition, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("opens"), F.lit(0).alias("closes")), F.struct(F.col(end).alias("at"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))).alias("p")).select(*partition, "p.*")
    points = points.groupBy(*partition, "at").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    w = Window.partitionBy(*partition).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("opened", F.sum("opens").over(w) - F.col("opens")).withColumn("closed", F.sum("closes").over(w))
    a = points.select(*partition, F.col("at").alias(end), "opened")
    b = points.select(*partition, F.col("at").alias(start), "closed")
    return df.join(a, [*partition, end]).join(b, [*partition, start]).withColumn("overlaps", F.col("opened") - F.col("closed") - 1).drop("opened", "closed")


def equal_width(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), low, high, n; half open, the last closed."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null").join(F.broadcast(ends))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    return rows.groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin"), "lo", "hi").agg(F.count("v").alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def quantile_bins(df: DataFrame, value: str, bins: int, order: list[Column]) -> DataFrame:
    """Edges at the ordered values number i * n // bins; equal edges fall together. bin, low, high, n."""
    rows = df.filter(F.col(value).isNotNull())
    numbered = with_ordinal(rows.select(F.col(value).cast("double").alias("v"), *[o.alias(f"o{i}") for i, o in enumerate(order)]), [F.col("v"), *[F.col(f"o{i}") for i in range(len(order))]], "n")
    total = rows.count()
    wanted = sorted({i * total // bins + 1 for i in range(bins)})
    edges = sorted({r.v for r in numbered.filter(F.col("n").isin(wanted)).select("v").collect()})
    if not edges:
        return numbered.select(F.lit(0).alias("bin"), F.col("v").alias("low"), F.col("v").alias("high"), F.lit(0).cast("long").alias("n")).limit(0)
    top = rows.agg(F.max(value).cast("double")).first()[0]
    place, low, high = F.lit(0), F.lit(edges[0]), F.lit(edges[1] if len(edges) > 1 else top)
    for i, e in enumerate(edges[1:], 1):
        place = F.when(F.col("v") >= e, i).otherwise(place)
        low = F.when(F.col("v") >= e, e).otherwise(low)
        high = F.when(F.col("v") >= e, edges[i + 1] if i + 1 < len(edges) else top).otherwise(high)
    return numbered.groupBy(place.alias("bin"), low.alias("low"), high.alias("high")).agg(F.count("v").alias("n"))


def frequency(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """How many values are at most each edge and over the one before; place len(edges) is the overflow."""
    place = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        place = F.when(F.col(value) <= e, i).otherwise(place)
    return df.filter(F.col(value).isNotNull()).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def aging(df: DataFrame, days: str, amount: str, bounds: tuple[int, ...] = (0, 30, 60, 90)) -> DataFrame:
    """Amounts by age [low, high); negative ages are not due."""
    label = F.when(F.col(days) < bounds[0], "not due")
    for low, high in zip(bounds, bounds[1:]):
        label = label.when(F.col(days) < high, f"{low}-{high}")
    return df.groupBy(label.otherwise(f"{bounds[-1]}+").alias("bucket")).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))


def fifo(df: DataFrame, partition: list[str], order: list[str], kind: str, qty: str, cost: str) -> DataFrame:
    """Cost of what was sold, first in first out, and value of what is left, for each group.

    The units bought before a lot and the units sold in all say how much of the lot went: no fold over
    events, only a running sum.
    """
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sold = df.filter(F.col(kind) == "sell").groupBy(*partition).agg(F.sum(qty).alias("sold"))
    lots = df.filter(F.col(kind) == "buy").withColumn("bought", F.sum(qty).over(w))
    lots = lots.join(sold, partition, "left").withColumn("sold", F.coalesce("sold", F.lit(0.0)))
    gone = F.greatest(F.lit(0.0), F.least(F.col(qty), F.col("sold") - (F.col("bought") - F.col(qty))))
    out = lots.groupBy(*partition).agg(F.sum(gone * F.col(cost)).alias("cogs"), F.sum((F.col(qty) - gone) * F.col(cost)).alias("ending_value"), F.sum(qty).alias("bought"), F.max("sold").alias("sold"))
    return out.withColumn("oversold", F.col("sold") > F.col("bought"))


def stack_costing(df: DataFrame, partition: list[str], order: list[str], kind: str, qty: str, cost: str, method: str = "lifo") -> DataFrame:
    """LIFO or moving average: the outcome hangs on every step, so a group's events are folded in order."""
    events = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), (F.col(kind) == "buy").alias("buy"), F.col(qty).cast("double").alias("q"), F.col(cost).cast("double").alias("c"))))
    rows = df.groupBy(*partition).agg(events.alias("events"))
    if method == "average":
        start = F.struct(F.lit(0.0).alias("units"), F.lit(0.0).alias("value"), F.lit(0.0).alias("cogs"))

        def step(s, e):
            unit = F.coalesce(F.try_divide(s["value"], s["units"]), F.lit(0.0))
            return F.when(e["buy"], F.struct((s["units"] + e["q"]).alias("units"), (s["value"] + e["q"] * e["c"]).alias("value"), s["cogs"].alias("cogs"))).otherwise(F.struct((s["units"] - e["q"]).alias("units"), (s["value"] - e["q"] * unit).alias("value"), (s["cogs"] + e["q"] * unit).alias("cogs")))

        rows = rows.withColumn("s", F.aggregate("events", start, step))
        return rows.select(*partition, F.col("s.cogs").alias("cogs"), F.col("s.value").alias("ending_value"))
    layers = F.array().cast("array<struct<q:double,c:double>>")
    start = F.struct(layers.alias("layers"), F.lit(0.0).alias("cogs"))

    def sell(s, e):
        def pop(t, layer):
            used = F.least(layer["q"], t["want"])
            rest = F.when(layer["q"] > used, F.concat(F.array(F.struct((layer["q"] - used).alias("q"), layer["c"].alias("c"))), t["layers"])).otherwise(t["layers"])
            return F.struct(rest.alias("layers"), (t["want"] - used).alias("want"), (t["cogs"] + used * layer["c"]).alias("cogs"))

        done = F.aggregate(F.reverse(s["layers"]), F.struct(layers.alias("layers"), e["q"].alias("want"), s["cogs"].alias("cogs")), pop)
        return F.struct(done["layers"].alias("layers"), done["cogs"].alias("cogs"))

    def step(s, e):
        return F.when(e["buy"], F.struct(F.concat(s["layers"], F.array(F.struct(e["q"].alias("q"), e["c"].alias("c")))).alias("layers"), s["cogs"].alias("cogs"))).otherwise(sell(s, e))

    rows = rows.withColumn("s", F.aggregate("events", start, step))
    left = F.aggregate("s.layers", F.lit(0.0), lambda a, x: a + x["q"] * x["c"])
    return rows.select(*partition, F.col("s.cogs").alias("cogs"), left.alias("ending_value"))
