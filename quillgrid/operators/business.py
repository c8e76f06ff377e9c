"""Schedules, statements, allocation and grading as jobs over ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance
from ..functions.cell import VALUE


def allocate(df: DataFrame, partition: list[str], whole: str, weight: str, tie: str, name: str = "allocated") -> DataFrame:
    """A whole number dealt by weights, the largest remainders first; the parts add up to it, group by group."""
    g = Window.partitionBy(*partition)
    exact = F.col(whole) * F.col(weight) / F.sum(weight).over(g)
    rows = df.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    rows = rows.withColumn("_left", F.col(whole) - F.sum("_floor").over(g))
    place = F.row_number().over(g.orderBy((F.col("_exact") - F.col("_floor")).desc(), tie))
    return rows.withColumn(name, F.col("_floor") + F.when(place <= F.col("_left"), 1).otherwise(0)).drop("_exact", "_floor", "_left")


def amortize(df: DataFrame, principal: str, rate: float, periods: int) -> DataFrame:
    """number, payment, interest, principal_part, balance of each loan, rounded to cents; the last period takes the drift.

    Each balance hangs on the rounded one before it, so a loan is folded in its row, then exploded.
    """
    pay = F.rint(-finance.PMT(rate, periods, F.col(principal)).value * 100) / 100
    start = F.array(F.struct(F.lit(0).alias("number"), F.lit(0.0).alias("payment"), F.lit(0.0).alias("interest"), F.lit(0.0).alias("principal_part"), F.col(principal).cast("double").alias("balance")))

    def step(rows, k):
        before = F.element_at(rows, -1)["balance"]
        interest = F.rint(before * rate * 100) / 100
        part = F.when(k == periods, before).otherwise(F.rint((pay - interest) * 100) / 100)
        return F.concat(rows, F.array(F.struct(k.alias("number"), (part + interest).alias("payment"), interest.alias("interest"), part.alias("principal_part"), (F.rint((before - part) * 100) / 100).alias("balance"))))

    rows = df.withColumn("_rows", F.aggregate(F.sequence(F.lit(1), F.lit(periods)), start, step))
    return rows.select(*df.columns, F.explode(F.slice("_rows", F.lit(2), F.lit(periods))).alias("_r")).select(*df.columns, "_r.*")


def depreciate(df: DataFrame, cost: str, salvage: str, life: int, method: str = "straight") -> DataFrame:
    """year, charge, book of each asset: straight, digits (sum of years) or declining (double, floored at salvage)."""
    c, s = F.col(cost), F.col(salvage)
    rows = df.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(life))))
    y = F.col("year")
    if method == "straight":
        charge, book = (c - s) / life, c - (c - s) / life * y
    elif method == "digits":
        total = life * (life + 1) / 2
        charge, book = (c - s) * (life + 1 - y) / total, c - (c - s) * (y * (life + 1) - y * (y + 1) / 2) / total
    else:
        at = lambda k: F.greatest(c * F.pow(F.lit(1 - min(1.0, 2 / life)), k), F.least(s, c))
        charge, book = at(y - 1) - at(y), at(y)
    return rows.withColumn("charge", charge).withColumn("book", book)


def cashflow(df: DataFrame, partition: list[str], period: str, flow: str, rate: float) -> DataFrame:
    """discounted and cumulative of each period (0 is not discounted), and the period that pays back."""
    w = Window.partitionBy(*partition).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("discounted", F.col(flow) / F.pow(F.lit(1 + rate), F.col(period))).withColumn("cumulative", F.sum("discounted").over(w))
    return out.withColumn("payback", F.min(F.when(F.col("cumulative") >= 0, F.col(period))).over(Window.partitionBy(*partition)))


def income_statement(df: DataFrame, partition: list[str], section: Column, amount: str) -> DataFrame:
    """One pass over a ledger whose lines are revenue, cogs, operating or other."""
    total = lambda s: F.coalesce(F.sum(F.when(section == s, F.col(amount))), F.lit(0.0))
    out = df.groupBy(*partition).agg(total("revenue").alias("revenue"), total("cogs").alias("cogs"), total("operating").alias("operating"), total("other").alias("other"))
    out = out.withColumn("gross_profit", F.col("revenue") - F.col("cogs")).withColumn("operating_income", F.col("gross_profit") - F.col("operating")).withColumn("net_income", F.col("operating_income") + F.col("other"))
    return out.withColumn("gross_margin", F.try_divide(F.col("gross_profit"), F.col("revenue"))).withColumn("net_margin", F.try_divide(F.col("net_income"), F.col("revenue")))


def balance_sheet(df: DataFrame, partition: list[str], section: Column, amount: str) -> DataFrame:
    """Totals, imbalance and liquidity of lines that are current_assets, longterm_assets, current_liabilities, longterm_liabilities or equity."""
    names = ("current_assets", "longterm_assets", "current_liabilities", "longterm_liabilities", "equity")
    out = df.groupBy(*partition).agg(*[F.coalesce(F.sum(F.when(section == s, F.col(amount))), F.lit(0.0)).alias(s) for s in names])
    out = out.withColumn("assets", F.col("current_assets") + F.col("longterm_assets")).withColumn("liabilities", F.col("current_liabilities") + F.col("longterm_liabilities"))
    out = out.withColumn("imbalance", F.round(F.col("assets") - F.col("liabilities") - F.col("equity"), 10))
    return out.withColumn("current_ratio", F.try_divide(F.col("current_assets"), F.col("current_liabilities"))).withColumn("working_capital", F.col("current_assets") - F.col("current_liabilities"))


def variance_lines(df: DataFrame, budget: str, actual: str, is_cost: Column) -> DataFrame:
    """amount, share and verdict of actual against budget: costs are better below."""
    amount = F.col(actual) - F.col(budget)
    better = F.when(is_cost, amount < 0).otherwise(amount > 0)
    verdict = F.when(amount == 0, "on budget").when(better, "favourable").otherwise("unfavourable")
    return df.withColumn("variance", amount).withColumn("variance_share", F.try_divide(amount, F.col(budget))).withColumn("verdict", verdict)


def unit_prices(df: DataFrame, partition: list[str], price: str, quantity: str, tie: str) -> DataFrame:
    """Price by unit, its place in the group, and what the best saves against the worst."""
    out = df.withColumn("unit_price", F.try_divide(F.col(price), F.col(quantity)))
    g = Window.partitionBy(*partition)
    worst, best = F.max("unit_price").over(g), F.min("unit_price").over(g)
    return out.withColumn("place", F.row_number().over(g.orderBy("unit_price", tie))).withColumn("saving", F.try_divide(worst - best, worst))


def grades(df: DataFrame, student: str, category: str, score: str, weights: dict[str, float], drop_lowest: int = 0) -> DataFrame:
    """percentage over the categories that have scores, by weights that add up to 1, the lowest dropped in each; letter, error.

    A category whose scores would all be dropped has no average, and its student the error #VALUE!.
    """
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError(f"the weights add up to {sum(weights.values())}, not to 1")
    rows = df.filter(F.col(score).isNotNull() & F.col(category).isin(list(weights)))
    place = F.row_number().over(Window.partitionBy(student, category).orderBy(score))
    rows = rows.withColumn("_place", place) if drop_lowest else rows.withColumn("_place", F.lit(1))
    means = rows.groupBy(student, category).agg(F.avg(F.when(F.col("_place") > drop_lowest, F.col(score).cast("double"))).alias("mean"))
    # added in the order of the weights, so no bit hangs on the order in which a shuffle brings the categories
    here = [F.col(category) == name for name in weights]
    in_order = lambda values: reduce(lambda a, x: a + x, [F.coalesce(F.max(F.when(at, v)), F.lit(0.0)) for at, v in zip(here, values)])
    points, live = in_order([F.col("mean") * float(w) for w in weights.values()]), in_order([F.lit(float(w)) for w in weights.values()])
    out = means.groupBy(student).agg(F.when(F.count("mean") == F.count(F.lit(1)), F.try_divide(points, live)).alias("percentage"))
    p = F.col("percentage")
    out = out.withColumn("letter", F.when(p >= 90, "A").when(p >= 80, "B").when(p >= 70, "C").when(p >= 60, "D").when(p.isNotNull(), "F"))
    return out.withColumn("error", F.when(p.isNull(), VALUE))


def _bill(subtotal: Column, tax_rate: float, tip_rate: float, tip_on_pretax: bool) -> Column:
    if tax_rate < 0 or tip_rate < 0:
        raise ValueError("rates are not negative")
    tax = subtotal * tax_rate
    return F.rint((subtotal + tax + (subtotal if tip_on_pretax else subtotal + tax) * tip_rate) * 100)


def split_evenly(df: DataFrame, bill: str, subtotal: str, diners: int, tax_rate: float = 0.0, tip_rate: float = 0.0, tip_on_pretax: bool = True) -> DataFrame:
    """bill, diner, share of each bill, in cents that add up: the first diners have the odd ones."""
    if diners < 1:
        raise ValueError("a bill has a diner at least")
    cents = _bill(F.col(subtotal).cast("double"), tax_rate, tip_rate, tip_on_pretax).cast("long")
    rows = df.filter(F.col(subtotal) >= 0).select(bill, cents.alias("_cents"), F.explode(F.sequence(F.lit(1), F.lit(diners))).alias("diner"))
    return rows.select(bill, "diner", ((F.floor(F.col("_cents") / diners) + F.when(F.col("diner") <= F.col("_cents") % diners, 1).otherwise(0)) / 100).alias("share"))


def split_by_order(df: DataFrame, bill: str, diner: str, order: str, tax_rate: float = 0.0, tip_rate: float = 0.0, tip_on_pretax: bool = True) -> DataFrame:
    """bill, diner, share: each bill's cents by what its diners ordered, the largest remainders first."""
    whole = Window.partitionBy(bill)
    rows = df.filter(F.col(order) >= 0).select(bill, diner, F.col(order).cast("double").alias("_order"))
    rows = rows.withColumn("_cents", _bill(F.sum("_order").over(whole), tax_rate, tip_rate, tip_on_pretax)).filter(F.col("_cents") > 0)
    return allocate(rows, [bill], "_cents", "_order", diner, "_share").select(bill, diner, (F.col("_share") / 100).alias("share"))


def net_variance(lines: DataFrame) -> DataFrame:
    """The sum of all variances of ``variance_lines``."""
    return lines.agg(F.round(F.coalesce(F.sum("variance"), F.lit(0.0)), 10).alias("net_variance"))


def gantt(tasks: DataFrame, width: int = 40) -> DataFrame:
    """task, start and bar of each scheduled task (task, start, finish, slack, critical): # critical, = others, dots of slack, * for a point."""
    if width < 4:
        raise ValueError("a chart has four columns at least")
    end = tasks.agg(F.max("finish").alias("_end"))
    column = lambda x: F.rint(x / F.col("_end") * width).cast("int")
    first, last = column(F.col("start")), column(F.col("finish"))
    bar = F.when(last == first, F.lit("*")).otherwise(F.repeat(F.when(F.col("critical"), "#").otherwise("="), last - first))
    text = F.concat(F.repeat(F.lit(" "), first), bar, F.repeat(F.lit("."), column(F.col("slack"))), F.when(F.col("critical"), " (critical)").otherwise(""))
    return tasks.join(F.broadcast(end)).filter(F.col("_end") > 0).select("task", "start", text.alias("bar"))


def paystubs(df: DataFrame, gross: str, pretax: str, posttax: str, brackets: list[tuple[float, float]]) -> DataFrame:
    taxable = F.col(gross) - F.col(pretax)
    tax = F.rint(finance.marginal(taxable, brackets) * 100) / 100
    return df.withColumn("taxable", taxable).withColumn("tax", tax).withColumn("net", taxable - tax - F.col(posttax))


def installments(df: DataFrame, balance: str, count: int, odd_cents_first: bool = True) -> DataFrame:
    """number and payment of equal parts in cents; the odd cents come first, or last."""
    cents = F.rint(F.col(balance) * 100).cast("long")
    each, odd = F.floor(cents / count), cents % count
    rows = df.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(count))))
    extra = F.col("number") <= odd if odd_cents_first else F.col("number") > count - odd
    return rows.withColumn("payment", (each + F.when(extra, 1).otherwise(0)) / 100)
