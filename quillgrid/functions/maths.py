"""Arithmetic, rounding, trigonometry, number bases, bit and unit functions."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .cell import DIV0, NA, NUM, Cell, bad, number, of, result


def _apply(f, *args, fails=lambda *x: []):
    cells = [number(a) for a in args]
    values = [c.value for c in cells]
    out = f(*values)
    return result(out, *cells, fails=[*fails(*values), (bad(out), NUM)])


def ADD(a, b):
    return _apply(lambda x, y: x + y, a, b)


def SUBTRACT(a, b):
    return _apply(lambda x, y: x - y, a, b)


def MULTIPLY(a, b):
    return _apply(lambda x, y: x * y, a, b)


def DIVIDE(a, b):
    return _apply(lambda x, y: F.try_divide(x, y), a, b, fails=lambda x, y: [(y == 0, DIV0)])


def PERCENT(a):
    return _apply(lambda x: x / 100, a)


def POWER(a, b):
    return _apply(F.pow, a, b)


def NEGATE(a):
    return _apply(lambda x: -x, a)


def MOD(a, b):
    """The sign follows the divisor."""
    return _apply(lambda x, d: x - d * F.floor(F.try_divide(x, d)), a, b, fails=lambda x, d: [(d == 0, DIV0)])


def ABS(a):
    return _apply(F.abs, a)


def INT(a):
    return _apply(lambda x: F.floor(x).cast("double"), a)


def SIGN(a):
    return _apply(F.signum, a)


def SQRT(a):
    return _apply(lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), a, fails=lambda x: [(x < 0, NUM)])


def EXP(a):
    return _apply(F.exp, a)


def LN(a):
    return _apply(lambda x: F.ln(x), a, fails=lambda x: [(x <= 0, NUM)])


def LOG(a, base=10):
    return _apply(lambda x, b: F.ln(x) / F.nullif(F.ln(b), F.lit(0.0)), a, base, fails=lambda x, b: [((x <= 0) | (b <= 0) | (b == 1), NUM)])


def ROUND(a, digits: int = 0):
    """Half-even on the decimal value."""
    return _apply(lambda x: F.bround(x, digits), a)


def _scaled(f, a, digits: int):
    p = 10.0 ** digits
    return _apply(lambda x: F.signum(x) * f(F.abs(x) * p) / p, a)


def TRUNC(a, digits: int = 0):
    return _scaled(F.floor, a, digits)


ROUNDDOWN = TRUNC


def ROUNDUP(a, digits: int = 0):
    return _scaled(F.ceil, a, digits)


def _step(f, a, significance):
    wrong = lambda x, s: [(s == 0, DIV0), ((x > 0) & (s < 0), NUM)]
    return _apply(lambda x, s: f(F.try_divide(x, s)) * s, a, significance, fails=wrong)


def CEILING(a, significance):
    return _step(F.ceil, a, significance)


def FLOOR(a, significance):
    return _step(F.floor, a, significance)


def MROUND(a, multiple):
    mismatch = lambda x, m: [((m != 0) & (F.when(x > 0, m < 0).otherwise((x < 0) & (m > 0) | (x == 0) & (m > 0))), NUM)]
    return _apply(lambda x, m: F.when(m == 0, 0.0).otherwise(F.rint(F.try_divide(x, m)) * m), a, multiple, fails=mismatch)


def SIN(a):
    return _apply(F.sin, a)


def COS(a):
    return _apply(F.cos, a)


def TAN(a):
    return _apply(F.tan, a)


def ASIN(a):
    return _apply(F.asin, a, fails=lambda x: [(F.abs(x) > 1, NUM)])


def ACOS(a):
    return _apply(F.acos, a, fails=lambda x: [(F.abs(x) > 1, NUM)])


def ATAN(a):
    return _apply(F.atan, a)


def ATAN2(x, y):
    return _apply(lambda a, b: F.atan2(b, a), x, y, fails=lambda a, b: [((a == 0) & (b == 0), DIV0)])


def SINH(a):
    return _apply(F.sinh, a)


def COSH(a):
    return _apply(F.cosh, a)


def TANH(a):
    return _apply(F.tanh, a)


def DEGREES(a):
    return _apply(F.degrees, a)


def RADIANS(a):
    return _apply(F.radians, a)


def PI():
    return Cell(F.pi())


def _product(low: Column, high: Column) -> Column:
    return F.aggregate(F.sequence(low, high), F.lit(1.0), lambda a, i: a * i)


def FACT(n):
    k = number(n)
    wrong = (k.value < 0) | (k.value != F.floor(k.value)) | (k.value > 170)
    safe = F.when(wrong | (k.value < 1), 1).otherwise(k.value).cast("long")
    return result(_product(F.lit(1).cast("long"), safe), k, fails=[(wrong, NUM)])


def COMBIN(n, k):
    """A product of k ratios, rounded to the whole number it is."""
    a, b = number(n), number(k)
    wrong = (a.value < 0) | (b.value < 0) | (b.value > a.value) | (a.value != F.floor(a.value)) | (b.value != F.floor(b.value))
    few = F.when(wrong, 0).otherwise(F.least(b.value, a.value - b.value)).cast("long")
    base = F.when(wrong, 0).otherwise(a.value - few)
    out = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(few, F.lit(1).cast("long"))), F.lit(1.0), lambda acc, i: F.when(few < 1, acc).otherwise(acc * (base + i) / i))
    return result(F.rint(out), a, b, fails=[(wrong, NUM)])


def _gcd(a: Column, b: Column) -> Column:
    """Euclid: 64-bit numbers need under 93 steps."""
    state = F.struct(a.alias("a"), b.alias("b"))
    steps = F.sequence(F.lit(1), F.lit(92))
    done = F.aggregate(steps, state, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))
    return done["a"]


def _integers(values):
    cells = [number(v) for v in values]
    return cells, [F.when(c.value != F.floor(c.value), 0).otherwise(c.value).cast("long") for c in cells], [(reduce(lambda x, y: x | y, [(c.value != F.floor(c.value)) | (c.value < 0) for c in cells]), NUM)]


def GCD(*values):
    cells, whole, fails = _integers(values)
    return result(reduce(_gcd, whole).cast("double"), *cells, fails=fails)


def LCM(*values):
    cells, whole, fails = _integers(values)
    out = reduce(lambda a, b: F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.floor(a / F.nullif(_gcd(a, b), F.lit(0).cast("long"))).cast("long") * b), whole)
    return result(out.cast("double"), *cells, fails=fails)


def _to_base(n, base: int):
    """Ten bits of two's complement for every base."""
    k = number(n)
    wrong = (k.value < -512) | (k.value > 511) | (k.value != F.floor(k.value))
    return result(F.conv(F.pmod(F.when(wrong, 0).otherwise(k.value).cast("long"), F.lit(1024)).cast("string"), 10, base), k, fails=[(wrong, NUM)])


def DEC2BIN(n):
    return _to_base(n, 2)


def DEC2OCT(n):
    return _to_base(n, 8)


def DEC2HEX(n):
    return _to_base(n, 16)


def _from_base(text, base: int, digits: str):
    t = of(text)
    s = F.upper(F.trim(t.value.cast("string")))
    x = F.conv(s, base, 10).cast("double")
    signed = F.when((F.char_length(s) == 10) & (x >= 512), x - 1024).otherwise(x)
    return result(signed, t, fails=[(~s.rlike(f"^[{digits}]{{1,10}}$"), NUM)])


def BIN2DEC(text):
    return _from_base(text, 2, "01")


def OCT2DEC(text):
    return _from_base(text, 8, "0-7")


def HEX2DEC(text):
    return _from_base(text, 16, "0-9A-F")


def _bits(method: str, a, b):
    x, y = number(a), number(b)
    wrong = (x.value < 0) | (y.value < 0) | (x.value != F.floor(x.value)) | (y.value != F.floor(y.value))
    left, right = (F.when(wrong, 0).otherwise(c.value).cast("long") for c in (x, y))
    return result(getattr(left, method)(right).cast("double"), x, y, fails=[(wrong, NUM)])


def BITAND(a, b):
    return _bits("bitwiseAND", a, b)


def BITOR(a, b):
    return _bits("bitwiseOR", a, b)


def BITXOR(a, b):
    return _bits("bitwiseXOR", a, b)


#: Units by family, as (scale, offset) to the family's base unit: base = x * scale + offset.
UNITS = {
    "length": {"m": (1, 0), "km": (1000, 0), "cm": (0.01, 0), "mm": (0.001, 0), "mi": (1609.344, 0), "yd": (0.9144, 0), "ft": (0.3048, 0), "in": (0.0254, 0)},
    "mass": {"g": (1, 0), "kg": (1000, 0), "mg": (0.001, 0), "lbm": (453.59237, 0), "oz": (28.349523125, 0)},
    "time": {"sec": (1, 0), "min": (60, 0), "hr": (3600, 0), "day": (86400, 0)},
    "temperature": {"C": (1, 0), "F": (5 / 9, -160 / 9), "K": (1, -273.15)},
}


def CONVERT(x, source, target):
    n, a, b = number(x), of(source), of(target)
    rows = [(name, family, float(scale), float(offset)) for family, units in UNITS.items() for name, (scale, offset) in units.items()]
    table = F.create_map(*[y for name, family, scale, offset in rows for y in (F.lit(name), F.struct(F.lit(family).alias("family"), F.lit(scale).alias("scale"), F.lit(offset).alias("offset")))])
    p, q = F.try_element_at(table, a.value), F.try_element_at(table, b.value)
    unknown = p.isNull() | q.isNull() | (p["family"] != q["family"])
    return result((n.value * p["scale"] + p["offset"] - q["offset"]) / q["scale"], n, a, b, fails=[(F.coalesce(unknown, F.lit(True)), NA)])


def is_prime(n: Column) -> Column:
    """Trial division by 2 and odd numbers up to the root."""
    k = n.cast("long")
    odd = F.sequence(F.lit(3).cast("long"), F.greatest(F.floor(F.sqrt(k)), F.lit(3).cast("long")), F.lit(2).cast("long"))
    return (k > 1) & ((k == 2) | (k == 3) | ((k % 2 != 0) & ~F.exists(odd, lambda d: k % d == 0)))


@lru_cache(maxsize=2)
def _primes(top: int) -> np.ndarray:
    """All primes up to top."""
    sieve = np.arange(top + 1) > 1
    for d in range(2, math.isqrt(top) + 1):
        if sieve[d]:
            sieve[d * d :: d] = False
    return np.flatnonzero(sieve)


def _factors_of(batch: pa.Array) -> pa.Array:
    """Trial division of a whole batch by each prime; a number leaves once its rest is below the prime's square."""
    null = np.asarray(batch.is_null())
    n = batch.fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    rest, live, found = n.copy(), np.flatnonzero(n > 3), [(np.empty(0, "int64"),) * 3]
    for i, p in enumerate(_primes(1 << math.isqrt(int(n.max(initial=1).clip(1))).bit_length())):
        if i % 16 == 0:
            live = live[rest[live] >= p * p]
        if not live.size:
            break
        hit = live[rest[live] % p == 0]
        power, more = np.zeros(hit.size, "int64"), np.arange(hit.size)
        while more.size:
            rest[hit[more]] //= p
            power[more] += 1
            more = more[rest[hit[more]] % p == 0]
        found.append((hit, np.full(hit.size, p), power))
    last = np.flatnonzero(rest > 1)
    rows, primes, powers = (np.concatenate(x) for x in zip(*found, (last, rest[last], np.ones(last.size, "int64"))))
    order = np.argsort(rows, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n.size))]).astype("int32")
    pairs = pa.StructArray.from_arrays([pa.array(primes[order]), pa.array(powers[order].astype("int32"))], ["prime", "power"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs, mask=pa.array(null | (n < 1)))


def prime_factors(n: Column) -> Column:
    """array<struct<prime, power>> for n up to about 1e12, none for 1; null below it."""
    return F.arrow_udf(_factors_of, "array<struct<prime:bigint,power:int>>")(n.cast("long"))


def next_prime(n, ceiling: int = 1_000_000) -> Cell:
    """The first prime over n, up to the ceiling; gaps below 2**31 are shorter than 336. Near numbers are tried first, and none from the ceiling on."""
    k = number(n)
    base = F.greatest(F.floor(k.value), F.lit(1)).cast("long")
    first = lambda low, high: F.get(F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: base + i), is_prime), F.lit(0))
    found = F.when(base < ceiling, F.coalesce(first(1, 4), first(5, 14), first(15, 60), first(61, 336)))
    return result(found, k, fails=[(F.coalesce(found > ceiling, F.lit(True)), NUM)])


def product_of(factors: Column) -> Column:
    """The number that prime_factors came from."""
    power = lambda f: F.aggregate(F.array_repeat(f["prime"], f["power"]), F.lit(1).cast("long"), lambda a, x: a * x)
    return F.aggregate(factors, F.lit(1).cast("long"), lambda a, f: a * power(f))
