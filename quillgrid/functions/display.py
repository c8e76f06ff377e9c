"""Numbers as people read them: words, locales, format codes, bars, bands, and currencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cell import NA, VALUE, Cell, number, of, result

#: English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["trillion", "billion", "million", "thousand", ""]

#: Thousands and decimal signs.
LOCALES = {"en": (",", "."), "de": (".", ","), "fr": (" ", ","), "ch": ("'", ".")}


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))


def _below_thousand(n: Column) -> Column:
    hundreds, rest = F.floor(n / 100), n % 100
    low = F.when(rest < 20, _pick(ONES, rest)).when(rest % 10 == 0, _pick(TENS, F.floor(rest / 10))).otherwise(F.concat(_pick(TENS, F.floor(rest / 10)), F.lit("-"), _pick(ONES, rest % 10)))
    return F.concat_ws(" ", F.when(hundreds > 0, F.concat(_pick(ONES, hundreds), F.lit(" hundred"))), F.when((rest > 0) | (n == 0), low))


def spell_integer(x) -> Cell:
    """Whole numbers from 0 below 10**15 in English; others are refused."""
    n = number(x)
    whole = F.abs(n.value).cast("long")
    parts = [F.when(F.floor(whole / 10 ** (3 * (4 - i))) % 1000 > 0, F.trim(F.concat(_below_thousand(F.floor(whole / 10 ** (3 * (4 - i))) % 1000), F.lit(f" {s}")))) for i, s in enumerate(SCALES)]
    text = F.when(whole == 0, "zero").otherwise(F.concat_ws(" ", *parts))
    return result(text, n, fails=[((n.value != F.floor(n.value)) | (n.value < 0) | (n.value >= 1e15), VALUE)])


#: Whole amounts in words; a fraction is refused, spell_money takes it.
spell_number = spell_integer


def spell_money(x) -> Cell:
    """``twelve dollars and 05/100``; negative amounts are refused."""
    n = number(x)
    cents = F.rint(F.abs(n.value) * 100).cast("long")
    dollars = spell_integer(F.floor(cents / 100) * F.when(n.value < 0, F.lit(None)).otherwise(1))
    text = F.concat(dollars.value, F.when(F.floor(cents / 100) == 1, " dollar").otherwise(" dollars"), F.lit(" and "), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("/100"))
    return result(text, n, dollars, fails=[(n.value < 0, VALUE)])


def cross_rate(source, target, rates: dict[str, float]) -> Cell:
    """Units of target for one of source."""
    return convert_currency(1.0, source, target, rates)


def render_number(x, locale: str, decimals: int = 2) -> Column:
    group, point = LOCALES[locale]
    return F.translate(F.format_number(number(x).value, decimals), ",.", group + point)


def parse_number(text: Column, locale: str) -> Cell:
    """Strict: groups of three, or none at all."""
    group, point = (f"\\{c}" for c in LOCALES[locale])
    shape = f"^-?([0-9]{{1,3}}({group}[0-9]{{3}})+|[0-9]+)({point}[0-9]+)?$"
    plain = F.translate(F.translate(text, LOCALES[locale][0], ""), LOCALES[locale][1], ".")
    return result(plain.try_cast("double"), fails=[(F.coalesce(~text.rlike(shape), F.lit(True)), VALUE)])


def number_format(x, code: str) -> Column:
    """Codes of ``0 # , . %`` with a second section, in brackets or not, for negatives."""
    sections = code.split(";")
    value = number(x).value

    def one(section: str, v: Column) -> Column:
        body = section.strip("()").rstrip("%")
        decimals = len(body.split(".")[1]) if "." in body else 0
        scaled = v * 100 if section.endswith("%") else v
        text = F.format_number(scaled, decimals)
        text = text if "," in body else F.replace(text, F.lit(","), F.lit(""))
        text = F.concat(text, F.lit("%")) if section.endswith("%") else text
        return F.concat(F.lit("("), text, F.lit(")")) if section.startswith("(") else text

    if len(sections) == 1:
        return F.when(value < 0, F.concat(F.lit("-"), one(code, -value))).otherwise(one(code, value))
    return F.when(value < 0, one(sections[1], -value)).otherwise(one(sections[0], value))


def convert_currency(amount, source, target, rates: dict[str, float]) -> Cell:
    """Through the base currency; rates are units for one of the base."""
    n, a, b = number(amount), of(source), of(target)
    table = F.create_map(*[F.lit(x) for kv in rates.items() for x in (kv[0], float(kv[1]))])
    p, q = F.try_element_at(table, a.value), F.try_element_at(table, b.value)
    return result(n.value / p * q, n, a, b, fails=[(p.isNull() | q.isNull(), NA)])


def bar(x: Column, least: float, most: float, width: int = 40) -> Column:
    """A text bar from zero; negatives point left of the axis."""
    unit = width / (max(most, 0.0) - min(least, 0.0))
    left = F.floor(F.greatest(-x, F.lit(0.0)) * unit + 0.5).cast("int")
    right = F.floor(F.greatest(x, F.lit(0.0)) * unit + 0.5).cast("int")
    pad = int(-min(least, 0.0) * unit + 0.5)
    return F.concat(F.lpad(F.repeat(F.lit("#"), left), pad, " "), F.lit("|"), F.repeat(F.lit("#"), right)) if pad else F.concat(F.lit("|"), F.repeat(F.lit("#"), right))


#: The levels of a sparkline, from the least to the greatest.
RAMP = " .:-=+*#"


def sparkline(series: Column) -> Column:
    """A level of the ramp for each number of an array; a flat one is at the top."""
    low, high = F.array_min(series), F.array_max(series)
    level = lambda x: F.coalesce(F.rint(F.try_divide(x - low, high - low) * (len(RAMP) - 1)), F.lit(len(RAMP) - 1.0))
    return F.array_join(F.transform(series, lambda x: F.substring(F.lit(RAMP), (level(x) + 1).cast("int"), F.lit(1))), "")


def band(x: Column, least: Column, most: Column, bands: int = 4) -> Column:
    """Which of the equal bands between least and most a number is in; a flat column is in the middle."""
    place = F.floor(F.try_divide(x - least, most - least) * bands)
    return F.coalesce(F.least(place, F.lit(bands - 1)), F.lit(bands // 2)).cast("int")


def band_around(x: Column, least: Column, middle: Column, most: Column, bands: int = 4) -> Column:
    """A scale with a midpoint: -bands to -1 below it, 0 on it, 1 to bands above; each half has its own span."""
    place = lambda far, near: F.least(F.floor(F.coalesce(F.try_divide(F.abs(x - near), F.abs(far - near)), F.lit(0.0)) * bands) + 1, F.lit(bands))
    return F.when(x < middle, -place(least, middle)).when(x > middle, place(most, middle)).otherwise(0).cast("int")


def color_between(share: Column, start: tuple[int, int, int], end: tuple[int, int, int]) -> Column:
    """``#RRGGBB`` on the way from one color to another."""
    part = lambda a, b: F.lpad(F.hex(F.rint(a + (b - a) * share).cast("int")), 2, "0")
    return F.concat(F.lit("#"), *[part(a, b) for a, b in zip(start, end)])


#: Steps of an axis by the leading digits that they stand for (the usual 1, 2, 5, 10).
_STEPS = ((1.5, 1), (3.0, 2), (7.0, 5), (math.inf, 10))


def nice_step(raw: float) -> float:
    """The step of 1, 2 or 5 times a power of ten next to a raw one."""
    if raw <= 0:
        raise ValueError("a step is positive")
    power = 10.0 ** math.floor(math.log10(raw))
    return power * next(step for upto, step in _STEPS if raw / power < upto)


def nice_ticks(low: float, high: float, target: int = 5) -> list[float]:
    """About ``target`` axis ticks that cover low to high; a point has an axis of length 1."""
    if high < low or target < 2:
        raise ValueError("an axis goes up and has two ticks at least")
    high = high if high > low else low + 1.0
    step = nice_step((high - low) / (target - 1))
    first = math.floor(low / step)
    last = math.ceil((high - 1e-9) / step)
    return [round(i * step, 10) for i in range(first, max(last, first) + 1)]


def axis(df: DataFrame, value: str, target: int = 5) -> list[float]:
    """Ticks for a column's bars, which begin at zero."""
    ends = df.agg(F.min(F.col(value).cast("double")).alias("low"), F.max(F.col(value).cast("double")).alias("high")).first()
    if ends.low is None:
        raise ValueError("no numbers, no axis")
    return nice_ticks(min(0.0, ends.low), max(0.0, ends.high), target)
