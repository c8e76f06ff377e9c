"""Dates as whole serials: 1 is 2000-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cell import NUM, VALUE, Cell, number, result

_EPOCH = "1999-12-31"


def to_serial(date: Column) -> Column:
    return F.datediff(date.cast("date"), F.lit(_EPOCH).cast("date"))


def to_date(serial: Column) -> Column:
    return F.date_add(F.lit(_EPOCH).cast("date"), serial.cast("int"))


def _serial(x) -> Cell:
    n = number(x)
    return result(F.floor(n.value).cast("int"), n, fails=[(n.value < 1, NUM)])


def _part(f, x):
    s = _serial(x)
    return result(f(to_date(s.value)).cast("double"), s)


def DATE(year, month, day):
    y, m, d = number(year), number(month), number(day)
    text = F.format_string("%04d-%02d-%02d", *[c.value.cast("int") for c in (y, m, d)])
    date = F.when(m.value.between(1, 12) & d.value.between(1, 31) & y.value.between(2000, 9999), text).try_cast("date")
    return result(to_serial(date).cast("double"), y, m, d, fails=[(date.isNull(), NUM)])


def YEAR(x):
    return _part(F.year, x)


def MONTH(x):
    return _part(F.month, x)


def DAY(x):
    return _part(F.dayofmonth, x)


def WEEKDAY(x, kind: int = 1):
    if kind not in (1, 2, 3):
        return Cell(F.lit(None).cast("double"), F.lit(NUM))
    return _part({1: F.dayofweek, 2: lambda d: F.weekday(d) + 1, 3: F.weekday}[kind], x)


def WEEKNUM(x):
    """Blocks of seven days from the first of January."""
    return _part(lambda d: F.floor((F.dayofyear(d) - 1) / 7) + 1, x)


def iso_week(x):
    return _part(F.weekofyear, x)


def quarter(x):
    return _part(F.quarter, x)


def month_name(month) -> Column:
    return F.date_format(F.make_date(F.lit(2000), number(month).value.cast("int"), F.lit(1)), "MMMM")


def day_name(x) -> Column:
    return F.date_format(to_date(_serial(x).value), "EEEE")


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))))


def is_leap(year: Column) -> Column:
    y = year.cast("int")
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def days_in_year(year: Column) -> Column:
    return F.when(is_leap(year), 366).otherwise(365)


def render_date(x) -> Column:
    return F.date_format(to_date(_serial(x).value), "yyyy-MM-dd")


def _shifted(f, x, months):
    s, m = _serial(x), number(months)
    out = to_serial(f(F.add_months(to_date(s.value), m.value.cast("int"))))
    return result(out.cast("double"), s, m, fails=[(out < 1, NUM)])


def EDATE(x, months):
    return _shifted(lambda d: d, x, months)


def EOMONTH(x, months):
    return _shifted(F.last_day, x, months)


def DAYS(end, start):
    e, s = _serial(end), _serial(start)
    return result((e.value - s.value).cast("double"), e, s)


def YEARFRAC(start, end):
    s, e = _serial(start), _serial(end)
    return result(F.abs(e.value - s.value) / 365.0, s, e)


def _weekdays_before(serial: Column) -> Column:
    """Mondays to Fridays from serial 1 (a Saturday) up to the serial; Monday is serial 3."""
    n = serial - 2
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def NETWORKDAYS(start, end):
    """Weekdays of both ends and between, by week arithmetic."""
    s, e = _serial(start), _serial(end)
    return result((_weekdays_before(e.value) - _weekdays_before(s.value - 1)).cast("double"), s, e, fails=[(e.value < s.value, NUM)])


def WORKDAY(start, n):
    """n weekdays on, or back; 0 is the start itself."""
    s, k = _serial(start), number(n)
    steps = F.when(k.value < 0, F.ceil(k.value)).otherwise(F.floor(k.value)).cast("int")
    day = F.pmod(s.value - 3, F.lit(7))  # Monday 0
    # a start on a weekend counts from Friday when going on, from Monday when going back
    forward_from, back_from = F.least(day, F.lit(4)), F.when(day > 4, 0).otherwise(day)
    monday = s.value - day
    on = forward_from + steps
    ahead = monday + F.floor(on / 5) * 7 + F.pmod(on, F.lit(5))
    back = back_from + steps
    behind = F.when(day > 4, monday + 7).otherwise(monday) + F.floor(back / 5) * 7 + F.pmod(back, F.lit(5))
    out = F.when(steps == 0, s.value).when(steps > 0, ahead).otherwise(behind)
    return result(out.cast("double"), s, k, fails=[(out < 1, NUM)])


def DATEDIF(start, end, unit: str):
    s, e = _serial(start), _serial(end)
    a, b = to_date(s.value), to_date(e.value)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
    units = {"D": e.value - s.value, "M": months, "Y": F.floor(months / 12)}
    if unit.upper() not in units:
        return Cell(F.lit(None).cast("double"), F.lit(NUM))
    return result(units[unit.upper()].cast("double"), s, e, fails=[(e.value < s.value, NUM)])


def days360(start, end, european: bool = False):
    s, e = _serial(start), _serial(end)
    a, b = to_date(s.value), to_date(e.value)
    d1 = F.least(F.dayofmonth(a), F.lit(30))
    d2 = F.dayofmonth(b)
    d2 = F.least(d2, F.lit(30)) if european else F.when((d2 == 31) & (d1 == 30), 30).otherwise(d2)
    return result(((F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1).cast("double"), s, e)


def year_fraction(start, end, basis: str):
    if basis in ("actual/365", "actual/360"):
        d = DAYS(end, start)
        return result(d.value / float(basis[-3:]), d)
    if basis in ("30/360", "30e/360"):
        d = days360(start, end, basis == "30e/360")
        return result(d.value / 360.0, d)
    return Cell(F.lit(None).cast("double"), F.lit(VALUE))


def networkdays_custom(start, end, weekend: tuple[int, ...] = (6, 7), holidays: tuple[int, ...] = ()) -> Column:
    """Working days of both ends and between; weekend by 1 Monday .. 7 Sunday, holidays by serial; signed."""
    s, e = _serial(start).value, _serial(end).value
    low, high = F.least(s, e), F.greatest(s, e)
    total = high - low + 1
    for day in set(weekend):
        # serials of that weekday are 2 + day modulo 7
        total = total - (F.floor((high - 2 - day) / 7) - F.floor((low - 3 - day) / 7))
    off = [h for h in set(holidays) if (h - 3) % 7 + 1 not in set(weekend)]
    for h in off:
        total = total - F.when(F.lit(h).between(low, high), 1).otherwise(0)
    return F.when(e < s, -total).otherwise(total)


def daily(start, end, step: int = 1) -> Column:
    return F.sequence(_serial(start).value, _serial(end).value, F.lit(step))


def weekly(start, end, weeks: int = 1) -> Column:
    return daily(start, end, 7 * weeks)


def monthly(start, end, months: int = 1) -> Column:
    """From the start's own day each time, so 31 comes back after a short month."""
    s, e = _serial(start).value, _serial(end).value
    count = F.greatest(F.floor(F.months_between(F.last_day(to_date(e)), to_date(s)) / months), F.lit(0)).cast("int")
    dates = F.transform(F.sequence(F.lit(0), count), lambda i: to_serial(F.add_months(to_date(s), i * months)))
    return F.filter(dates, lambda d: d <= e)


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    parts = [(F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m"), (s % 60, "s")]
    text = F.concat_ws(" ", *[F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in parts])
    return F.when(s == 0, "0s").otherwise(text)


def parse_duration(text: Column) -> Cell:
    """``1d 2h 3m 4s`` in that order, each at most once."""
    shape = r"^\s*(?:(\d+)d)?\s*(?:(\d+)h)?\s*(?:(\d+)m)?\s*(?:(\d+)s)?\s*$"
    total = sum((F.coalesce(F.regexp_extract(text, shape, i).try_cast("long"), F.lit(0)) * k for i, k in ((1, 86400), (2, 3600), (3, 60), (4, 1))), F.lit(0))
    return result(total, fails=[(~text.rlike(shape) | (F.trim(text) == ""), VALUE)])
