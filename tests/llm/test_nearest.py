import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.llm import nearest


def brute(rows, k):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    seen = set()
    for i, v in good:
        if i % 100 or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        found = []
        for j, u in good:
            if j != i and len(u) == len(v):
                total = 0.0
                for a, b in zip(v, u):
                    total += (a - b) * (a - b)
                found.append((math.sqrt(total), j))
        out += [(i, r, j, d) for r, (d, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype("f4").tolist()) for i in range(330)]
    rows += [(400, None), (500, [0.0] * 6), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (None, [1.0] * 6), (800, [1.0, 2.0]), (801, [1.5, 2.0]), (900, [])]
    rows += [(1001, rows[100][1]), (1002, rows[100][1]), (1003, rows[5][1]), rows[7], rows[7], rows[200], (1100, [1e-30] * 6), (1200, [1e30] * 6), (1201, [float("inf")] * 6)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, dim int, g int")
    stored = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = sorted(map(tuple, nearest.digest(frame).collect()))
    assert got == brute(stored, 10)
    few = nearest.usable(frame, "vec_id", "embedding")
    split = nearest.search(few.filter("vec_id % 100 = 0"), few.repartition(7), 10, broadcast_bytes=100)  # many blocks
    assert sorted(map(tuple, split.collect())) == got


def test_empty(spark):
    assert nearest.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_id_with_several_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(100, [1.0, 0.0]), (100, [0.0, 5.0]), (100, [0.0, 5.0]), *[(i, rng.normal(size=2).tolist()) for i in range(1, 60)], (7, [9.0, 9.0])]
    got = sorted(map(tuple, nearest.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert len(got) == 20 and got == brute(rows, 10)


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(100, [0.5, 2.0, 3.0])]
    got = sorted(map(tuple, nearest.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == brute(rows, 10)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.sampled_from([1e-6, 1.0, 1e6]))
def test_bounds_hold(seed, dim, size):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(5, dim)) * size, rng.normal(size=(7, dim)) * rng.choice([size, 1.0])
    b[0] = a[0]
    lower, upper = nearest._bounds(nearest.quantise(a), nearest.quantise(b))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert (lower <= true).all() and (true <= upper).all()
