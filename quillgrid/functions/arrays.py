"""Vectors, matrices, polygons and bit sets held in array columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    x, y = [F.get(a, F.lit(i)) for i in range(3)], [F.get(b, F.lit(i)) for i in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def angle_between(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b)))))


def add(a: Column, b: Column) -> Column:
    """Of matrices, as arrays of rows."""
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda x, y: x - y))


def scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda r: F.transform(r, lambda x: x * factor))


def identity(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def trace(a: Column) -> Column:
    return _sum(F.transform(a, lambda r, i: F.get(r, i)))


def transpose(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(a, F.lit(0))) - 1), lambda j: F.transform(a, lambda r: F.get(r, j)))


def multiply(a: Column, b: Column) -> Column:
    columns = transpose(b)
    return F.transform(a, lambda r: F.transform(columns, lambda c: dot(r, c)))


def determinant(a: Column) -> Column:
    """Of square matrices a row each; elimination in numpy, Arrow batches."""
    return _solver("det")(a)


def inverse(a: Column) -> Column:
    """Null where the matrix is singular."""
    return _solver("inv")(a)


def solve(a: Column, constants: Column) -> Column:
    """x with a x = constants; null where the system is singular or the shapes differ."""
    return _solver("solve")(F.zip_with(a, constants, lambda row, c: F.concat(row, F.array(c))))


def _solver(kind: str):
    def batch(x: np.ndarray) -> list:
        """Matrices of one shape, together; for solve the last column has the constants."""
        m = x[:, :, : x.shape[1]]
        if m.shape[1] != m.shape[2]:
            return [None] * len(x)
        d = np.linalg.det(m)
        if kind == "det":
            return d.tolist()
        sound = np.isfinite(d) & (np.abs(d) > 1e-12 * np.maximum(1.0, np.abs(m).max((1, 2))) ** m.shape[1])
        out: list = [None] * len(x)
        if sound.any():
            found = np.linalg.inv(m[sound]) if kind == "inv" else np.linalg.solve(m[sound], x[sound][:, :, -1:])[:, :, 0]
            for i, row in zip(np.flatnonzero(sound), found.tolist()):
                out[i] = row
        return out

    @F.pandas_udf({"det": "double", "inv": "array<array<double>>", "solve": "array<double>"}[kind])
    def f(s: pd.Series) -> pd.Series:
        out, shapes = [None] * len(s), {}
        for i, m in enumerate(s):
            if m is not None and len(m) and all(r is not None and len(r) == len(m[0]) for r in m) and len(m[0]) == len(m) + (kind == "solve"):
                shapes.setdefault(len(m), []).append((i, m))
        for group in shapes.values():
            for (i, _), value in zip(group, batch(np.array([[list(map(float, r)) for r in m] for _, m in group]))):
                out[i] = value
        return pd.Series(out, dtype="float64" if kind == "det" else object)

    return f


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def signed_area(points: Column) -> Column:
    """Shoelace over array<struct<x, y>>, positive if counter-clockwise."""
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(1), F.lit(1)))
    return _sum(F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def orientation(points: Column) -> Column:
    a = signed_area(points)
    return F.when(a > 0, "counter-clockwise").when(a < 0, "clockwise").otherwise("degenerate")


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray casting; points on an edge are inside."""
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(1), F.lit(1)))
    edges = F.zip_with(points, turned, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    side = lambda e: (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (x - e["p"]["x"])
    on_edge = lambda e: (F.abs(side(e)) < 1e-12) & x.between(F.least(e["p"]["x"], e["q"]["x"]), F.greatest(e["p"]["x"], e["q"]["x"])) & y.between(F.least(e["p"]["y"], e["q"]["y"]), F.greatest(e["p"]["y"], e["q"]["y"]))
    crosses = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * F.try_divide(y - e["p"]["y"], e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])
    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def poly_eval(coefficients: list[float], x: Column) -> Column:
    """Horner; the coefficients rise with the power."""
    out = F.lit(0.0)
    for a in reversed(coefficients):
        out = out * x + F.lit(float(a))
    return out


def log_factorial(n: Column) -> Column:
    return _sum(F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda i: F.ln(i.cast("double"))))


def binomial_pmf(k: Column, n: Column, p: float) -> Column:
    logs = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    return F.when((k < 0) | (k > n), 0.0).otherwise(F.exp(logs))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    return _sum(F.transform(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(0))), lambda i: binomial_pmf(i, n, p)))


def poisson_pmf(k: Column, rate: float) -> Column:
    return F.when(k < 0, 0.0).otherwise(F.exp(k * math.log(rate) - rate - log_factorial(k)))


def poisson_cdf(k: Column, rate: float) -> Column:
    return _sum(F.transform(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(0))), lambda i: poisson_pmf(i, rate)))


def map_cells(grid: Column, f) -> Column:
    """f of every cell of an array of rows."""
    return F.transform(grid, lambda r: F.transform(r, f))


def by_row(grid: Column, f) -> Column:
    return F.transform(grid, f)


def by_column(grid: Column, f) -> Column:
    return F.transform(transpose(grid), f)


def reduce_cells(grid: Column, start: Column, f) -> Column:
    """Row by row, left to right."""
    return F.aggregate(F.flatten(grid), start, f)


def scan(values: Column, start: Column, f) -> Column:
    """All the steps of a reduction."""
    steps = F.aggregate(values, F.array(start), lambda a, x: F.concat(a, F.array(f(F.element_at(a, -1), x))))
    return F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0)))


def make_array(rows: int, columns: int, f) -> Column:
    """f(row, column), from 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda j: f(i, j)))


def bit_set(members: Column) -> Column:
    """A set of small whole numbers as a sorted array; unions, intersections and differences are Spark's."""
    return F.array_sort(F.array_distinct(F.filter(members, lambda x: x >= 0)))
