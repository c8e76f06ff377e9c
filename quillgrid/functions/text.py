"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cell import NA, NUM, VALUE, Cell, bad, bound, number, of, render, result


def _text(x) -> Cell:
    c = of(x)
    return Cell(F.coalesce(c.value.cast("string"), F.lit("")) if not isinstance(x, (int, float)) else render(c.value), c.error)


def _whole(x) -> Cell:
    n = number(x)
    return Cell(n.value.cast("int"), n.error)


def LEFT(text, n=1):
    t, k = _text(text), _whole(n)
    return result(F.substring(t.value, F.lit(1), k.value), t, k, fails=[(k.value < 0, VALUE)])


def RIGHT(text, n=1):
    t, k = _text(text), _whole(n)
    return result(F.right(t.value, k.value), t, k, fails=[(k.value < 0, VALUE)])


def MID(text, start, n):
    t, s, k = _text(text), _whole(start), _whole(n)
    return result(F.substring(t.value, F.greatest(s.value, F.lit(1)), F.greatest(k.value, F.lit(0))), t, s, k, fails=[((s.value < 1) | (k.value < 0), VALUE)])


def LEN(text):
    t = _text(text)
    return result(F.char_length(t.value).cast("double"), t)


def UPPER(text):
    t = _text(text)
    return result(F.upper(t.value), t)


def LOWER(text):
    t = _text(text)
    return result(F.lower(t.value), t)


def TRIM(text):
    t = _text(text)
    return result(F.trim(F.regexp_replace(t.value, r"\s+", " ")), t)


def _quoted(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _place(t: Column, needle: Column, nth: Column) -> Column:
    """Where the nth occurrence begins (1-based, overlapping ones count); 0 if there is none."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: F.substring(t, i, F.char_length(needle)) == needle)
    return F.coalesce(F.get(starts, nth - 1), F.lit(0))


def SUBSTITUTE(text, old, new, nth=None):
    t, o, w = _text(text), _text(old), _text(new)
    if nth is None:
        return result(F.when(o.value == "", t.value).otherwise(F.replace(t.value, o.value, w.value)), t, o, w)
    k = _whole(nth)
    at = _place(t.value, o.value, F.greatest(k.value, F.lit(1)))
    put = F.concat(F.substring(t.value, F.lit(1), at - 1), w.value, F.substring(t.value, at + F.char_length(o.value), F.char_length(t.value)))
    return result(F.when((o.value == "") | (at == 0), t.value).otherwise(put), t, o, w, k, fails=[(k.value < 1, VALUE)])


def REPLACE(text, start, n, new):
    t, s, k, w = _text(text), _whole(start), _whole(n), _text(new)
    at = F.greatest(s.value, F.lit(1))
    out = F.concat(F.substring(t.value, F.lit(1), at - 1), w.value, F.substring(t.value, at + F.greatest(k.value, F.lit(0)), F.greatest(F.char_length(t.value), F.lit(1))))
    return result(out, t, s, k, w, fails=[((s.value < 1) | (k.value < 0), VALUE)])


def _find(needle, hay, start, fold):
    n, h, s = _text(needle), _text(hay), _whole(start)
    a, b = (F.upper(n.value), F.upper(h.value)) if fold else (n.value, h.value)
    at = F.when(a == "", s.value).otherwise(F.call_function("locate", a, b, F.greatest(s.value, F.lit(1))))
    return result(at.cast("double"), n, h, s, fails=[((s.value < 1) | (s.value > F.char_length(b) + 1) | (at == 0), VALUE)])


def FIND(needle, hay, start=1):
    return _find(needle, hay, start, False)


def SEARCH(needle, hay, start=1):
    return _find(needle, hay, start, True)


def REPT(text, n):
    t, k = _text(text), _whole(n)
    too_long = (k.value < 0) | (k.value.cast("long") * F.char_length(t.value) > 10000)
    return result(F.repeat(t.value, F.when(too_long, 0).otherwise(k.value)), t, k, fails=[(too_long, VALUE)])


def TEXTJOIN(delimiter, skip_empty: bool, *parts):
    """Of values in a row; TEXTJOIN of a column is ``aggregates.TEXTJOIN``."""
    d, cells = _text(delimiter), [of(p) for p in parts]
    array = F.array(*[c.value.cast("string") for c in cells])
    kept = F.filter(array, lambda x: x.isNotNull() & (x != "")) if skip_empty else F.transform(array, lambda x: F.coalesce(x, F.lit("")))
    return result(F.aggregate(kept, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, d.value, x)), lambda a: F.coalesce(a, F.lit(""))), d, *cells)


def CONCAT(*parts):
    cells = [of(p) for p in parts]
    return result(F.concat(*[F.coalesce(c.value.cast("string"), F.lit("")) for c in cells]), *cells)


def PROPER(text):
    """A capital after anything that is no letter."""
    t = _text(text)
    runs = F.regexp_extract_all(t.value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return result(F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.char_length(r))))), ""), t)


def EXACT(a, b):
    x, y = _text(a), _text(b)
    return result(x.value == y.value, x, y)


def CHAR(code):
    k = _whole(code)
    return result(F.char(k.value), k, fails=[(~k.value.between(32, 126), VALUE)])


def CODE(text):
    t = _text(text)
    code = F.ascii(t.value)
    return result(code.cast("double"), t, fails=[(~code.between(32, 126), VALUE)])


def VALUE_(text):
    t = _text(text)
    plain = F.when(t.value.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)+(\.[0-9]*)?\s*$"), F.replace(t.value, F.lit("_"), F.lit(""))).otherwise(t.value)
    x = F.trim(plain).try_cast("double")
    return result(x, t, fails=[(x.isNull(), VALUE)])


def _cut(text, delimiter, n, before: bool):
    t, d, k = _text(text), _text(delimiter), _whole(n)
    parts = F.split(t.value, _quoted(d.value), -1)
    count = F.size(parts) - 1
    at = F.when(k.value > 0, k.value).otherwise(count + 1 + k.value)
    wrong = (d.value == "") | (k.value == 0)
    missing = (at < 1) | (at > count)
    safe = F.when(wrong | missing, 1).otherwise(at)
    # joined again with the delimiter of the row
    some = F.slice(parts, F.lit(1), safe) if before else F.slice(parts, safe + 1, F.greatest(F.size(parts) - safe, F.lit(0)))
    out = F.aggregate(some, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, d.value, x)))
    return result(F.coalesce(out, F.lit("")), t, d, k, fails=[(wrong, VALUE), (missing, NA)])


def TEXTBEFORE(text, delimiter, n=1):
    return _cut(text, delimiter, n, True)


def TEXTAFTER(text, delimiter, n=1):
    return _cut(text, delimiter, n, False)


def CLEAN(text):
    t = _text(text)
    return result(F.regexp_replace(t.value, r"[\x00-\x1F]", ""), t)


def _fixed(x: Column, decimals: int) -> Column:
    """Half-even at the decimals; thousands grouped."""
    if decimals >= 0:
        return F.format_number(F.abs(x), decimals)
    return F.format_number(F.abs(F.bround(x, decimals)), 0)


def DOLLAR(x, decimals: int = 2):
    n = number(x)
    return result(F.concat(F.when(n.value < 0, "-").otherwise(""), F.lit("$"), _fixed(n.value, decimals)), n)


def FIXED(x, decimals: int = 2, no_commas: bool = False):
    n = number(x)
    text = F.concat(F.when(n.value < 0, "-").otherwise(""), _fixed(n.value, decimals))
    return result(F.replace(text, F.lit(","), F.lit("")) if no_commas else text, n)


def text_split(text, delimiter: str):
    if not delimiter:
        raise ValueError("the delimiter is empty")
    return F.split(_text(text).value, _quoted(F.lit(delimiter)), -1)


def pad_left(text, width: int):
    t = _text(text).value
    return F.when(F.char_length(t) < width, F.lpad(t, width, " ")).otherwise(t)


def pad_right(text, width: int):
    t = _text(text).value
    return F.when(F.char_length(t) < width, F.rpad(t, width, " ")).otherwise(t)


def center(text, width: int):
    t = _text(text).value
    left = F.floor((F.lit(width) - F.char_length(t)) / 2).cast("int")
    return F.when(F.char_length(t) < width, F.rpad(F.concat(F.repeat(F.lit(" "), left), t), width, " ")).otherwise(t)


def wrap_text(text, width: int) -> Column:
    """Greedy lines of whole words; a longer word has a line of its own."""
    words = F.filter(F.split(F.trim(_text(text).value), r"\s+"), lambda w: w != "")
    start = F.array().cast("array<string>")
    def put(lines, w):
        fits = (F.size(lines) > 0) & (F.char_length(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))) + 1 + F.char_length(w) <= width)
        joined = F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), F.lit(" "), w)))
        return F.when(fits, joined).otherwise(F.concat(lines, F.array(w)))
    return F.aggregate(words, start, put)


def edit_distance(a, b) -> Column:
    return F.levenshtein(_text(a).value, _text(b).value)


def similarity(a, b) -> Column:
    x, y = _text(a).value, _text(b).value
    longest = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def luhn_valid(text) -> Column:
    digits = F.regexp_replace(_text(text).value, r"[ \-]", "")
    return digits.rlike("^[0-9]+$") & F.call_function("luhn_check", digits)


def _digits(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.when(c == "X", 10).otherwise(c.try_cast("int")))


def isbn13_valid(text) -> Column:
    s = F.regexp_replace(_text(text).value, r"[ \-]", "")
    total = F.aggregate(F.transform(_digits(s), lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return s.rlike("^[0-9]{13}$") & (total % 10 == 0)


def isbn10_valid(text) -> Column:
    s = F.upper(F.regexp_replace(_text(text).value, r"[ \-]", ""))
    total = F.aggregate(F.transform(_digits(s), lambda d, i: d * (10 - i)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return s.rlike("^[0-9]{9}[0-9X]$") & (total % 11 == 0)


def luhn_check_digit(text) -> Column:
    s = F.reverse(F.regexp_replace(_text(text).value, r"[ \-]", ""))
    doubled = F.transform(_digits(s), lambda d, i: F.when(i % 2 == 0, F.floor(d * 2 / 10) + d * 2 % 10).otherwise(d))
    return ((10 - F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0))) % 10) % 10).cast("int")


def to_base(n, base: int, width: int = 0) -> Column:
    digits = F.conv(F.abs(F.coalesce(of(n).value.cast("long"), F.lit(0))).cast("string"), 10, base)  # not by way of doubles, which end at 2**53
    padded = F.when(F.char_length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.when(number(n).value < 0, F.concat(F.lit("-"), padded)).otherwise(padded)


def from_base(text, base: int) -> Cell:
    s = F.upper(F.trim(_text(text).value))
    allowed = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:base]
    return result(F.conv(F.regexp_replace(s, "^-", ""), base, 10).cast("double") * F.when(s.startswith("-"), -1).otherwise(1), fails=[(~s.rlike(f"^-?[{allowed}]+$"), NUM)])


_ROMAN = [(1000, " M MM MMM"), (100, " C CC CCC CD D DC DCC DCCC CM"), (10, " X XX XXX XL L LX LXX LXXX XC"), (1, " I II III IV V VI VII VIII IX")]


def to_roman(n) -> Cell:
    k = _whole(n)
    digit = lambda v, value, signs: F.get(F.array(*[F.lit(x) for x in signs.split(" ")]), F.floor(v / value).cast("int") % 10)
    return result(bound(k.value, lambda v: F.concat(*[digit(v, value, signs) for value, signs in _ROMAN])), k, fails=[(~k.value.between(1, 3999), NUM)])


def from_roman(text) -> Cell:
    """Canonical numerals only: what does not come back from the number is refused."""
    units = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}

    def read(s):
        """The signs' values, less twice those before a larger one, each of which a canonical numeral has once."""
        counted = [(F.char_length(s) - F.char_length(F.replace(s, F.lit(sign), F.lit("")))) * value for sign, value in units.items()]
        less = [F.when(s.contains(pair), -2 * units[pair[0]]).otherwise(0) for pair in ("CM", "CD", "XC", "XL", "IX", "IV")]
        total = sum([*counted[1:], *less], counted[0])
        return bound(total, lambda t: F.when(s.rlike("^[MDCLXVI]+$") & F.coalesce(to_roman(t).column() == s, F.lit(False)), t.cast("double")))

    value = bound(F.upper(F.trim(_text(text).value)), read)
    return Cell(value, F.when(value.isNull(), F.lit(NUM)))
