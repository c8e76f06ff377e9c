"""Order-sensitive operators over whole tables, without putting a table into one task.

A global window would send every row to one partition. Here the first order key is cut at quantiles
into buckets, windows run inside the buckets, and the few totals of the buckets are added on: the
cut is a function of the key alone, so a recomputed task gives the same rows. With ``partition`` the
windows are Spark's own, one for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, key: Column, n: int) -> Column:
    """Bucket number of a numeric, date or time key, rising with it; nulls in a bucket of their own, last."""
    x = _as_double(df, key)
    return _bucket_of(x, sorted(set(_cuts(df, x, n))))


def _cuts(df: DataFrame, x: Column, n: int) -> list[float]:
    """n - 1 quantiles, repeated where one value has the share of several."""
    if n < 2:
        return []
    return df.select(F.percentile_approx(x, [i / n for i in range(1, n)], max(1000, 10 * n)).alias("q")).first().q or []


def _bucket_of(x: Column, cuts: list[float]) -> Column:
    array = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    return F.when(x.isNull(), len(cuts) + 1).otherwise(F.size(F.filter(array, lambda c: c < x)))


def _fine_buckets(df: DataFrame, order: list[Column], n: int) -> Column:
    """Bucket number rising with all of the order; a value that has several buckets' share of the first key is cut by the second one.

    A second key is a number, date, time or text (by its first six bytes); hot values with other second
    keys, and rows that tie in what is cut, stay in one bucket.
    """
    x = _as_double(df, order[0])
    cuts = _cuts(df, x, n)
    shares = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1}
    bucket = _bucket_of(x, sorted(set(cuts)))
    second = _code(df, order[1]) if len(order) > 1 else None
    if not shares or second is None:
        return bucket
    most = max(shares.values()) + 1
    quantiles = F.percentile_approx("code", [i / most for i in range(1, most)], max(1000, 10 * most))
    found = df.select(x.alias("x"), second.alias("code")).filter(F.col("x").isin(list(shares))).groupBy("x").agg(quantiles.alias("q")).collect()  # fewer rows than buckets
    part = F.lit(0)
    for row in found:
        chosen = sorted(set((row.q or [])[:: -(-most // (shares[row.x] + 1))]))
        inside = F.when(second.isNull(), most).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in chosen]).cast("array<double>"), lambda c: c < second)))
        part = F.when(x == row.x, inside + 1).otherwise(part)  # smaller values of the bucket stay before
    return bucket * (most + 2) + F.coalesce(part, F.lit(0))


def _code(df: DataFrame, key: Column) -> Column | None:
    """A number that never falls where the key rises; None for other types."""
    kind = df.select(key.alias("k")).schema["k"].dataType.typeName()
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(key), 1, 12), 12, "0"), 16, 10).cast("double")
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz"):
        return _as_double(df, key)
    return None


def _as_double(df: DataFrame, key: Column) -> Column:
    kind = df.select(key.alias("k")).schema["k"].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(key.cast("timestamp")).cast("double")
    return key.cast("double")


def _size(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_running(df: DataFrame, order: list[Column], name: str, value: Column, descending: bool = False) -> DataFrame:
    """Adds the running sum of value (ordinal: value 1) over the whole table in the order given.

    order: the first key is numeric, a date or a time; the rest break ties. Descending turns all keys:
    nulls are last, and first if descending.
    """
    bucket = _fine_buckets(df, order, _size(df))
    rows = df.withColumn("_bucket", -bucket if descending else bucket).withColumn("_value", value)
    keys = [c.desc_nulls_first() if descending else c.asc_nulls_last() for c in order]
    inside = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # one row a bucket: not over twice the shuffle partitions and a few
    totals = rows.groupBy("_bucket").agg(F.sum("_value").alias("_total"))
    before = totals.select("_bucket", (F.sum("_total").over(Window.orderBy("_bucket")) - F.col("_total")).alias("_before"))
    out = rows.withColumn(name, F.sum("_value").over(inside)).join(F.broadcast(before), "_bucket")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_value", "_before")


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ord", descending: bool = False) -> DataFrame:
    """Row numbers from 1 over the whole table."""
    return with_running(df, order, name, F.lit(1).cast("long"), descending)


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with ``q``: exact inclusive percentiles of a whole table, between neighbours; no task holds all distinct values."""
    v = F.col(value).cast("double")
    counts = df.select(v.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("peers"))
    placed = with_running(counts, [F.col("v")], "upto", F.col("peers")).join(F.broadcast(counts.agg(F.sum("peers").alias("n"))))
    at = lambda place: F.max(F.when((F.col("upto") - F.col("peers") <= place) & (place < F.col("upto")), F.col("v")))
    place = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    found = placed.agg(F.max("n").alias("n"), *[at(F.floor(p)).alias(f"lo{i}") for i, p in enumerate(place)], *[at(F.ceil(p)).alias(f"hi{i}") for i, p in enumerate(place)])
    low, high = [F.col(f"lo{i}") for i in range(len(shares))], [F.col(f"hi{i}") for i in range(len(shares))]
    return found.select(F.array(*[F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi) for p, lo, hi in zip(place, low, high)]).alias("q"))


def cumulative(df: DataFrame, order: list[Column], value: str, name: str, partition: list[str] = ()) -> DataFrame:
    """Running total; blanks stay blank and do not break it."""
    x = F.col(value).cast("double")
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.when(x.isNotNull(), F.sum(x).over(w)))
    out = with_running(df, order, name, F.coalesce(x, F.lit(0.0)))
    return out.withColumn(name, F.when(x.isNotNull(), F.col(name)))


def rank(df: DataFrame, value: str, name: str, method: str = "standard", descending: bool = False, partition: list[str] = (), tie: str | None = None) -> DataFrame:
    """standard (1, 2, 2, 4), dense (1, 2, 2, 3) or ordinal (ties by ``tie``) ranks; blanks have none."""
    x = F.col(value)
    if partition:
        keys = [x.desc_nulls_last() if descending else x.asc_nulls_last(), *([F.col(tie)] if method == "ordinal" and tie else [])]
        w = Window.partitionBy(*partition).orderBy(*keys)
        f = {"standard": F.rank, "dense": F.dense_rank, "ordinal": F.row_number}[method]
        return df.withColumn(name, F.when(x.isNotNull(), f().over(w)))
    bucket = _buckets(df, x, _size(df))
    rows = df.withColumn("_bucket", -bucket if descending else bucket)
    # equal values are in one bucket, so a rank inside it and the counts before it give the whole
    order = x.desc() if descending else x.asc()
    keys = [order, *([F.col(tie)] if method == "ordinal" and tie else [])]
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    f = {"standard": F.rank, "dense": F.dense_rank, "ordinal": F.row_number}[method]
    weight = F.count_distinct(x) if method == "dense" else F.count(x)
    totals = rows.groupBy("_bucket").agg(weight.alias("_total"))
    before = totals.select("_bucket", (F.sum("_total").over(Window.orderBy("_bucket")) - F.col("_total")).alias("_before"))
    out = rows.withColumn(name, f().over(inside)).join(F.broadcast(before), "_bucket")
    return out.withColumn(name, F.when(x.isNotNull(), F.col(name) + F.col("_before"))).drop("_bucket", "_before")


def moving(df: DataFrame, order: list[Column], value: str, window: int, name: str, f: str = "avg", partition: list[str] = ()) -> DataFrame:
    """Trailing ``window`` rows; blank until it is full and where it has a gap.

    Over a whole table rows are numbered first and cut into blocks; the last window - 1 rows of a
    block also go to the next one.
    """
    x = F.col(value).cast("double")
    agg = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[f]
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(window - 1), 0)
        full = (F.count(F.lit(1)).over(w) == window) & (F.count(x).over(w) == window)
        return df.withColumn(name, F.when(full, agg(x).over(w)))
    block = max(10_000, 4 * window)
    rows = with_ordinal(df, order, "_n")
    own = F.floor((F.col("_n") - 1) / block)
    also = F.when((F.col("_n") - 1) % block >= block - (window - 1), F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_own", own).withColumn("_block", F.explode(also))
    w = Window.partitionBy("_block").orderBy("_n").rowsBetween(-(window - 1), 0)
    full = (F.count(F.lit(1)).over(w) == window) & (F.count(x).over(w) == window)
    return rows.withColumn(name, F.when(full, agg(x).over(w))).filter("_block = _own").drop("_n", "_own", "_block")


def period_change(df: DataFrame, order: list[Column], value: str, partition: list[str]) -> DataFrame:
    """change and change_pct against the row before; blank at gaps, the share also after a zero."""
    before = F.lag(value).over(Window.partitionBy(*partition).orderBy(*order))
    change = F.col(value) - before
    return df.withColumn("change", change).withColumn("change_pct", F.try_divide(change, before))


def top(df: DataFrame, value: str, k: int, partition: list[str] = (), descending: bool = True, tie: str | None = None) -> DataFrame:
    """The k largest (smallest) rows; of each group with partition. Spark keeps k rows a task before shuffling."""
    keys = [F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last(), *([F.col(tie)] if tie else [])]
    if not partition:
        return df.filter(F.col(value).isNotNull()).orderBy(*keys).limit(k)
    w = Window.partitionBy(*partition).orderBy(*keys)
    return df.filter(F.col(value).isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def sort_rows(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """By several (column, descending); blanks sink either way."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys])


def take(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order, the last for a negative n."""
    return df.orderBy(*[c.asc_nulls_last() for c in order]).limit(n) if n >= 0 else df.orderBy(*[c.desc_nulls_first() for c in order]).limit(-n)


def drop(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """All but the first n rows, the last for a negative n."""
    numbered = with_ordinal(df, order, "_n", descending=n < 0)
    return numbered.filter(F.col("_n") > abs(n)).drop("_n")


def choose_rows(df: DataFrame, order: list[Column], places: list[int]) -> DataFrame:
    """Rows by their places from 1, repeats and any order allowed; ``place`` numbers the result."""
    wanted = df.sparkSession.createDataFrame([(i + 1, p) for i, p in enumerate(places)], "place int, _n long")
    return with_ordinal(df, order, "_n").join(F.broadcast(wanted), "_n").drop("_n")
