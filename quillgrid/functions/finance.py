"""Annuities, depreciation, solvers, loans, bonds, and ratios, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cell import DIV0, NUM, Cell, bad, bound, number, result


def _numbers(*args):
    cells = [number(a) for a in args]
    return cells, [c.value for c in cells]


def _growth(rate: Column, periods: Column) -> Column:
    return F.pow(1 + rate, periods)


def PMT(rate, periods, pv):
    cells, (r, n, v) = _numbers(rate, periods, pv)
    level = F.when(r == 0, -v / F.nullif(n, F.lit(0.0))).otherwise(-v * r / F.nullif(1 - _growth(r, -n), F.lit(0.0)))
    return result(level, *cells, fails=[(n <= 0, NUM), (bad(level), NUM)])


def FV(rate, periods, payment, pv):
    cells, (r, n, p, v) = _numbers(rate, periods, payment, pv)
    out = F.when(r == 0, -(v + p * n)).otherwise(-(v * _growth(r, n) + p * (_growth(r, n) - 1) / F.nullif(r, F.lit(0.0))))
    return result(out, *cells, fails=[(bad(out), NUM)])


def PV(rate, periods, payment, fv):
    cells, (r, n, p, v) = _numbers(rate, periods, payment, fv)
    out = F.when(r == 0, -(v + p * n)).otherwise(-(v + p * (_growth(r, n) - 1) / F.nullif(r, F.lit(0.0))) / _growth(r, n))
    return result(out, *cells, fails=[(bad(out), NUM)])


def NPER(rate, payment, pv, fv):
    cells, (r, p, v, f) = _numbers(rate, payment, pv, fv)
    ratio = F.try_divide(p - f * r, p + v * r)
    out = F.when(r == 0, F.try_divide(-(v + f), p)).otherwise(F.ln(F.when(ratio > 0, ratio)) / F.when(r > -1, F.ln(1 + F.when(r > -1, r))))
    return result(out, *cells, fails=[(bad(out), NUM)])


def bisect(f, low: Column, high: Column, steps: int = 100) -> Column:
    """A root of a monotone f between low and high; f gives a Column of a Column.

    Each step halves the bracket and cuts it once more where an exponential through the three values is
    zero (Ridders), so about ten steps name f; a row is done when two such cuts agree to twelve digits, as the error
    falls with its square. The high end where no sign changes.
    """
    lo, hi = low.cast("double"), high.cast("double")

    def ends(at, to):
        out = F.when(F.signum(at) == 0, lo).when(F.signum(at) == F.signum(to), hi).when(F.signum(to) == 0, hi)
        return F.struct(lo.alias("lo"), hi.alias("hi"), at.alias("at"), to.alias("to"), F.lit(None).cast("double").alias("guess"), out.alias("root"))

    def cut(s, _):
        middle = (s["lo"] + s["hi"]) / 2

        def inner(m, value):
            share = F.signum(s["at"]) * F.signum(value) / F.sqrt(1 - F.try_divide(s["at"], value) * F.try_divide(s["to"], value))
            x = m + (m - s["lo"]) * share
            return bound(F.when((x > s["lo"]) & (x < s["hi"]), x).otherwise(m), lambda x: bound(f(x), lambda y: narrowed(m, value, x, y)))

        def narrowed(m, v, x, y):
            flips = F.signum(v) != F.signum(y)
            left = F.when(flips, F.least(m, x)).when(F.signum(y) == F.signum(s["at"]), F.greatest(m, x)).otherwise(s["lo"])
            right = F.when(flips, F.greatest(m, x)).when(F.signum(y) == F.signum(s["at"]), s["hi"]).otherwise(F.least(m, x))
            of = lambda p: F.when(p == m, v).when(p == x, y).when(p == s["lo"], s["at"]).otherwise(s["to"])
            near = F.coalesce(F.abs(x - s["guess"]) <= 1e-12 * F.abs(x), F.lit(False))
            root = F.when(v == 0, m).when((y == 0) | near, x)
            return bound(left, lambda a: bound(right, lambda b: F.struct(a.alias("lo"), b.alias("hi"), of(a).alias("at"), of(b).alias("to"), x.alias("guess"), root.alias("root"))))

        return F.when(s["root"].isNotNull(), s).otherwise(bound(middle, lambda m: bound(f(m), lambda v: inner(m, v))))

    start = bound(f(lo), lambda at: bound(f(hi), lambda to: ends(at, to)))
    return bound(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, cut), lambda done: F.coalesce(done["root"], (done["lo"] + done["hi"]) / 2))


def minimize(f, low: Column, high: Column, steps: int = 80) -> Column:
    """The input between low and high at which f, with one valley there, is least: golden sections, row by row.

    Each step keeps one of the two inner points with its value; a row is done when doubles have none between.
    """
    share = (5**0.5 - 1) / 2
    state = lambda a, l, r, b, at, to: F.struct(a.alias("a"), l.alias("l"), r.alias("r"), b.alias("b"), at.alias("at"), to.alias("to"))

    def narrow(s, _):
        below = bound(s["r"] - share * (s["r"] - s["a"]), lambda x: state(s["a"], x, s["l"], s["r"], f(x), s["at"]))
        above = bound(s["l"] + share * (s["b"] - s["l"]), lambda x: state(s["l"], s["r"], x, s["b"], s["to"], f(x)))
        return F.when(s["l"] >= s["r"], s).when(s["at"] < s["to"], below).otherwise(above)

    a, b = low.cast("double"), high.cast("double")
    first = lambda l, r: bound(f(l), lambda at: bound(f(r), lambda to: state(a, l, r, b, at, to)))
    start = bound(b - share * (b - a), lambda l: bound(a + share * (b - a), lambda r: first(l, r)))
    return bound(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, narrow), lambda end: (end["a"] + end["b"]) / 2)


def maximize(f, low: Column, high: Column, steps: int = 80) -> Column:
    return minimize(lambda x: -f(x), low, high, steps)


def RATE(periods, payment, pv):
    cells, (n, p, v) = _numbers(periods, payment, pv)
    balance = lambda r: F.when(F.abs(r) < 1e-12, v + p * n).otherwise(v + p * (1 - _growth(r, -n)) / r)
    low, high = F.lit(-0.999999), F.lit(1.0)
    crosses = F.signum(balance(low)) != F.signum(balance(high))
    return result(bisect(balance, low, high), *cells, fails=[((n <= 0) | ~crosses, NUM)])


def npv_of(rate: Column, flows: Column, first: int = 1) -> Column:
    """Present value of an array of flows; the first is discounted ``first`` periods."""
    return bound(1 + rate, lambda growth: F.aggregate(F.transform(flows, lambda x, i: x / F.pow(growth, i + first)), F.lit(0.0), lambda a, x: a + x))


def NPV(rate, flows: Column):
    cells, (r,) = _numbers(rate)
    return result(npv_of(r, flows), *cells, fails=[(r <= -1, NUM)])


def IRR(flows: Column):
    """Of an array of flows with both signs, between -0.99 and 10."""
    both = F.exists(flows, lambda x: x > 0) & F.exists(flows, lambda x: x < 0)
    value = lambda r: npv_of(r, flows, 0)
    crosses = F.signum(value(F.lit(-0.99))) != F.signum(value(F.lit(10.0)))
    return result(bisect(value, F.lit(-0.99), F.lit(10.0)), fails=[(F.coalesce(~(both & crosses), F.lit(True)), NUM)])


def xnpv(rate: Column, amounts: Column, serials: Column) -> Column:
    """Dated flows at actual/365 from the first date."""
    dated = lambda growth: F.zip_with(amounts, serials, lambda a, d: a / F.pow(growth, (d - F.element_at(serials, 1)) / 365.0))
    return bound(1 + rate, lambda growth: F.aggregate(dated(growth), F.lit(0.0), lambda s, x: s + x))


def xirr(amounts: Column, serials: Column) -> Cell:
    both = F.exists(amounts, lambda x: x > 0) & F.exists(amounts, lambda x: x < 0)
    return result(bisect(lambda r: xnpv(r, amounts, serials), F.lit(-0.9999), F.lit(100.0)), fails=[(~both, NUM)])


def mirr(amounts: Column, finance_rate: float, reinvest_rate: float) -> Cell:
    n = F.size(amounts) - 1
    costs = npv_of(F.lit(finance_rate), F.transform(amounts, lambda x: F.least(x, F.lit(0.0))), 0)
    gains = npv_of(F.lit(reinvest_rate), F.transform(amounts, lambda x: F.greatest(x, F.lit(0.0))), 0) * F.pow(F.lit(1 + reinvest_rate), n)
    return result(F.pow(F.try_divide(gains, -costs), 1 / n) - 1, fails=[((costs == 0) | (gains == 0) | (n < 1), DIV0)])


def SLN(cost, salvage, life):
    cells, (c, s, n) = _numbers(cost, salvage, life)
    return result(F.try_divide(c - s, n), *cells, fails=[(n == 0, DIV0)])


def DDB(cost, salvage, life, period):
    """Double-declining, never below salvage."""
    cells, (c, s, n, p) = _numbers(cost, salvage, life, period)
    wrong = (n <= 0) | (p < 1) | (p > n)
    factor = F.try_divide(F.lit(2.0), n)
    book = lambda k: F.greatest(c * F.pow(1 - F.least(factor, F.lit(1.0)), k), F.least(s, c))
    return result(book(p - 1) - book(p), *cells, fails=[(wrong, NUM)])


def ipmt(rate, period, periods, pv):
    """Interest in one payment: what the balance before it bears."""
    cells, (r, k, n, v) = _numbers(rate, period, periods, pv)
    level = PMT(r, n, v)
    before = v * _growth(r, k - 1) + level.value * F.when(r == 0, k - 1).otherwise((_growth(r, k - 1) - 1) / F.nullif(r, F.lit(0.0)))
    return result(-before * r, *cells, level, fails=[((k < 1) | (k > n), NUM)])


def ppmt(rate, period, periods, pv):
    level, interest = PMT(rate, periods, pv), ipmt(rate, period, periods, pv)
    return result(level.value - interest.value, level, interest)


def cumipmt(rate, periods, pv, start: int, end: int) -> Column:
    return F.aggregate(F.transform(F.sequence(F.lit(start), F.lit(end)), lambda k: ipmt(rate, k, periods, pv).value), F.lit(0.0), lambda a, x: a + x)


def cumprinc(rate, periods, pv, start: int, end: int) -> Column:
    return PMT(rate, periods, pv).value * (end - start + 1) - cumipmt(rate, periods, pv, start, end)


def bond_price(face, coupon, periods, rate) -> Column:
    _, (f, c, n, y) = _numbers(face, coupon, periods, rate)
    return F.when(y == 0, f + f * c * n).otherwise(f * c * (1 - _growth(y, -n)) / F.nullif(y, F.lit(0.0)) + f * _growth(y, -n))


def yield_to_maturity(face, coupon, periods, market) -> Column:
    return bisect(lambda y: bond_price(face, coupon, periods, y) - number(market).value, F.lit(-0.9999), F.lit(10.0))


def macaulay_duration(face, coupon, periods, rate) -> Column:
    _, (f, c, n, y) = _numbers(face, coupon, periods, rate)
    times = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: k * (f * c + F.when(k == n, f).otherwise(0.0)) / _growth(y, k))
    return F.aggregate(times, F.lit(0.0), lambda a, x: a + x) / bond_price(face, coupon, periods, rate)


def ratio(a, b) -> Cell:
    cells, (x, y) = _numbers(a, b)
    return result(F.try_divide(x, y), *cells, fails=[(y == 0, DIV0)])


#: current, debt-to-equity, equity and asset returns, turnover and margins are all one quotient
current_ratio = debt_to_equity = return_on_equity = return_on_assets = asset_turnover = gross_margin = net_margin = ratio


def quick_ratio(assets, inventory, liabilities) -> Cell:
    return ratio(number(assets).value - number(inventory).value, liabilities)


def cagr(begin, end, years) -> Cell:
    cells, (a, b, n) = _numbers(begin, end, years)
    return result(F.pow(F.try_divide(b, a), F.try_divide(F.lit(1.0), n)) - 1, *cells, fails=[((a <= 0) | (b <= 0) | (n <= 0), NUM)])


def roi(gain, cost) -> Cell:
    return ratio(number(gain).value - number(cost).value, cost)


def break_even(fixed, price, variable) -> Cell:
    return ratio(fixed, number(price).value - number(variable).value)


def effective(nominal, periods: int) -> Column:
    return F.pow(1 + number(nominal).value / periods, periods) - 1


def nominal(effective_rate, periods: int) -> Column:
    return periods * (F.pow(1 + number(effective_rate).value, 1 / periods) - 1)


def effective_continuous(rate) -> Column:
    return F.expm1(number(rate).value)


def nominal_continuous(rate) -> Column:
    return F.log1p(number(rate).value)


def markup_to_margin(markup) -> Column:
    m = number(markup).value
    return m / (1 + m)


def margin_to_markup(margin) -> Column:
    m = number(margin).value
    return F.try_divide(m, 1 - m)


def chain_discount(discounts: Column) -> Column:
    return 1 - F.aggregate(discounts, F.lit(1.0), lambda a, d: a * (1 - d))


def add_tax(pretax, rate) -> Column:
    """net, tax, total, at cents."""
    cents = F.rint(number(pretax).value * 100)
    tax = F.rint(cents * number(rate).value)
    return F.struct((cents / 100).alias("net"), (tax / 100).alias("tax"), ((cents + tax) / 100).alias("total"))


def extract_tax(total, rate) -> Column:
    cents = F.rint(number(total).value * 100)
    net = F.rint(cents / (1 + number(rate).value))
    return F.struct((net / 100).alias("net"), ((cents - net) / 100).alias("tax"), (cents / 100).alias("total"))


def round_cash(amount, denomination: float = 0.05) -> Column:
    step = round(denomination * 100)
    return F.rint(F.rint(number(amount).value * 100) / step) * step / 100


def late_fee(balance, days_late, flat: float, daily: float, grace: int = 0, cap: float = 0.25) -> Column:
    b, d = number(balance).value, number(days_late).value
    return F.when(d <= grace, 0.0).otherwise(F.least(flat + b * daily * (d - grace), b * cap))


def savings_balance(opening, contribution, rate, periods) -> Column:
    _, (o, c, r, n) = _numbers(opening, contribution, rate, periods)
    return o * _growth(r, n) + F.when(r == 0, c * n).otherwise(c * (_growth(r, n) - 1) / F.nullif(r, F.lit(0.0)))


def required_contribution(opening, target, rate, periods) -> Column:
    _, (o, t, r, n) = _numbers(opening, target, rate, periods)
    gap = t - o * _growth(r, n)
    return F.greatest(F.when(r == 0, gap / n).otherwise(gap * r / F.nullif(_growth(r, n) - 1, F.lit(0.0))), F.lit(0.0))


def runway(balance, spend, revenue) -> Column:
    """Months until the balance is gone; null where nothing is burnt."""
    burn = number(spend).value - number(revenue).value
    return F.when(burn > 0, number(balance).value / burn)


def marginal(amount: Column, brackets: list[tuple[float, float]]) -> Column:
    """Tax or commission by slices: brackets of (lower bound, rate) in rising order."""
    bounds = [b for b, _ in brackets[1:]] + [None]
    slices = [F.greatest((amount if high is None else F.least(amount, F.lit(float(high)))) - low, F.lit(0.0)) * rate for (low, rate), high in zip(brackets, bounds)]
    return sum(slices[1:], slices[0])
