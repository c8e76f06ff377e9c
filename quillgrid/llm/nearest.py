"""Exact k nearest vectors by a block matrix join: int8 tiles with error bounds, survivors again in floats.

Vectors are coded in int8. The queries' codes are broadcast, in blocks whose size is checked; candidates
stay where they are. A tile multiplies codes (as float32, whose sums of int8 products are exact here),
which gives every distance to within the two vectors' quantisation errors. Pairs whose lower bound is
beyond the k-th upper bound of their query cannot be among the nearest, first in a task, then over all
tasks. The ids of the others are joined to the original vectors, their distances computed in double
precision, and the k least of each query kept: Spark keeps them in every task, then merges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_BLOCK = 2048
_EXACT_DIMS = 1024  # so many products of int8 add up exactly in float32
_PAIRS = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vec (double), dim: without null, zero, or non-finite vectors and without null ids."""
    vec = F.col(vector_column).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id is not null and vec is not null")
    return rows.filter(finite & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))


def quantise(x: np.ndarray):
    """int8 codes (as float32), scale, squared length of the coded vectors and the length of what they miss."""
    scale = np.abs(x).max(1) / 127
    scale = np.where(scale > 0, scale, 1.0)  # a subnormal maximum
    code = np.rint(x / scale[:, None]).clip(-127, 127)
    miss = np.sqrt(((x - code * scale[:, None]) ** 2).sum(1))
    return code.astype(np.float32), scale, (code**2).sum(1) * scale**2, miss


def _bounds(q, c):
    """Lower and upper bounds of all distances between two quantised blocks."""
    product = np.zeros((len(q[0]), len(c[0])))
    for d in range(0, q[0].shape[1], _EXACT_DIMS):
        product += q[0][:, d : d + _EXACT_DIMS] @ c[0][:, d : d + _EXACT_DIMS].T
    square = q[2][:, None] + c[2][None, :] - 2 * (q[1][:, None] * c[1][None, :]) * product
    size = q[2][:, None] + c[2][None, :]
    distance = np.sqrt(np.maximum(square, 0))
    # what rounding can add: the square is off by some ulps of the sizes it was made from
    slack = q[3][:, None] + c[3][None, :] + np.minimum(np.sqrt(size * 1e-13), size * 1e-13 / np.maximum(distance, 1e-300)) + distance * 1e-12
    return distance - slack, distance + slack


def _by_dim(batch: pa.RecordBatch):
    """The rows of each vector length, as (dim, rows, matrix)."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        rows = batch.filter(pa.array(dims == dim))
        yield dim, rows, rows["vec"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def coded(rows: DataFrame) -> DataFrame:
    """vec_id, mark, dim, and the int8 code, scale, squared length and miss of each vector: its dim + 44 bytes."""

    def run(batches):
        for batch in batches:
            for dim, some, matrix in _by_dim(batch):
                code, scale, square, miss = quantise(matrix)
                codes = pa.array([r.tobytes() for r in code.astype(np.int8)], pa.binary())
                yield pa.RecordBatch.from_arrays([some["vec_id"], some["mark"], some["dim"], codes, pa.array(scale), pa.array(square), pa.array(miss)], ["vec_id", "mark", "dim", "code", "scale", "square", "miss"])

    return rows.select("vec_id", "mark", "dim", "vec").mapInArrow(run, "vec_id long, mark long, dim int, code binary, scale double, square double, miss double")


class _Search:
    """What one task knows of the queries of one length: their k least upper bounds, and the pairs that can be among the nearest."""

    def __init__(self, queries: tuple, k: int):
        self.ids, self.marks, self.codes, *self.rest = queries
        self.least = np.full((len(self.ids), k), np.inf)
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.held, self.k = 0, k

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        for at in range(0, len(ids), _BLOCK):
            some, block = ids[at : at + _BLOCK], quantise(matrix[at : at + _BLOCK])
            for q in range(0, len(self.ids), _BLOCK):
                part = slice(q, q + _BLOCK)
                lower, upper = _bounds((self.codes[part].astype(np.float32), *(x[part] for x in self.rest)), block)
                own = some[None, :] == self.ids[part, None]
                upper[own] = np.inf
                self.least[part] = np.partition(np.concatenate([self.least[part], upper], axis=1), self.k - 1, axis=1)[:, : self.k]
                i, j = np.nonzero((lower <= self.least[part].max(1)[:, None]) & ~own)
                self.pairs.append((i + q, some[j], lower[i, j], upper[i, j]))
                self.held += len(i)
        if self.held > 4 * self.least.size + (1 << 16):
            self.prune()

    def prune(self) -> None:
        q, ids, lower, upper = (np.concatenate(x) for x in zip(*self.pairs))
        near = lower <= self.least.max(1)[q]
        self.pairs, self.held = [(q[near], ids[near], lower[near], upper[near])], int(near.sum())

    def found(self):
        if self.pairs:
            self.prune()
            q, *rest = self.pairs[0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[q], self.marks[q], *rest)], schema=_PAIRS)


def _pairs(queries: pa.Table, candidates: DataFrame, k: int) -> DataFrame:
    """The pairs of these coded queries with candidates that can be among the k nearest, task by task."""
    by_dim = {}
    for dim in np.unique(queries["dim"].to_numpy()).tolist():
        some = queries.filter(pa.array(queries["dim"].to_numpy() == dim))
        codes = np.frombuffer(b"".join(some["code"].to_pylist()), np.int8).reshape(-1, dim)
        by_dim[dim] = (some["vec_id"].to_numpy(), some["mark"].to_numpy(), codes, *(some[c].to_numpy() for c in ("scale", "square", "miss")))
    sent = candidates.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches):
        searches = {dim: _Search(own, k) for dim, own in sent.value.items()}
        for batch in batches:
            for dim, some, matrix in _by_dim(batch):
                if dim in searches:
                    searches[dim].add(some["vec_id"].to_numpy(), matrix)
        for search in searches.values():
            yield from search.found()

    return candidates.select("vec_id", "dim", "vec").mapInArrow(run, "query_id long, mark long, vec_id long, lower double, upper double")


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, vec, dim) the k nearest candidates of its length.

    Both are as ``usable`` gives them. Queries over ``broadcast_bytes`` of codes are sent in several blocks,
    each of which passes over the candidates. Rows with a query's own id are no candidates of it; repeated
    candidate rows count as often as they are there. A repeated query counts once; an id with several vectors
    is a query with each, and has a list of its own for each. Ties go to the smaller id; fewer than k
    candidates give fewer rows, none give none.
    """
    queries = queries.withColumn("mark", F.xxhash64("vec")).dropDuplicates(["vec_id", "mark"])
    size = queries.agg(F.sum(F.col("dim") + 44)).first()[0] or 0
    n_blocks = 1 + int(size) // broadcast_bytes
    codes = coded(queries)
    near = None
    for n in range(n_blocks):
        block = codes.filter(F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n_blocks)) == n).toArrow()  # about broadcast_bytes
        found = _pairs(block, candidates, k)
        found = found if n_blocks == 1 else materialise(found, "pairs")
        near = found if near is None else near.unionAll(found)
    own = Window.partitionBy("query_id", "mark").orderBy("upper").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = near.withColumn("limit", F.nth_value("upper", k).over(own)).filter(F.col("limit").isNull() | (F.col("lower") <= F.col("limit")))
    near = near.select("query_id", "mark", "vec_id").distinct()
    asked = queries.select(F.col("vec_id").alias("query_id"), "mark", F.col("vec").alias("query"), F.col("dim").alias("query_dim"))
    both = near.join(asked, ["query_id", "mark"]).join(candidates.select("vec_id", "vec", "dim"), "vec_id").filter(F.col("dim") == F.col("query_dim"))
    squares = F.zip_with("query", "vec", lambda a, b: (a - b) * (a - b))
    scored = both.select("query_id", "mark", "vec_id", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)).alias("score"))
    order = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    rows = usable(embeddings, "vec_id", "embedding")
    return search(rows.filter(F.col("vec_id") % every == 0), rows, k)


ORACLE = """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
               AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    q AS (SELECT DISTINCT vec_id, vec FROM v WHERE vec_id % 100 = 0),
    p AS (SELECT q.vec_id AS query_id, q.vec, c.vec_id, list_distance(q.vec, c.vec) AS score
          FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, vec ORDER BY score, vec_id) AS rank, vec_id, score FROM p)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
