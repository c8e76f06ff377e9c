"""Mixing sources to target weights by Pfair scheduling.

Documents of each source come in blocks. With target weight w (of 1), block j of a source is released
at slot floor((j - 1) / w) and due at ceil(j / w); in each slot the released block with the earliest
deadline goes. So at every slot each source has had its weight's share to within one block. When a
source is used up, the others' weights are scaled to 1 and a new phase begins; every document gets
exactly one place.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_id

#: Weights are whole parts of this, so release times and deadlines are exact.
PARTS = 1 << 20


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    total = sum(weights.values())
    return {s: max(1, round(PARTS * w / total)) for s, w in weights.items()}


def schedule(blocks: dict[str, int], weights: dict[str, int], after: dict[str, str] | None = None) -> list[tuple[str, int, int, int, int, int]]:
    """(source, block, slot, release, deadline, phase) of every block, in order of the slots.

    after: for sources that enter only when another is used up, that other one.
    """
    out, slot, phase = [], 0, 0
    done = dict.fromkeys(blocks, 0)
    left = {s: n for s, n in blocks.items() if n > 0}
    while left:
        live = [s for s in left if (after or {}).get(s) not in left]
        total, begin = sum(weights[s] for s in live), slot
        turn = dict.fromkeys(live, 1)  # j of the next block in this phase
        waiting = [(0, s) for s in sorted(live)]  # by release
        ready: list[tuple[int, str]] = []  # by deadline
        ended = False
        while not ended:
            while waiting and waiting[0][0] <= slot - begin:
                _, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-turn[s] * total // weights[s]), s))
            due, s = heapq.heappop(ready)
            released = (turn[s] - 1) * total // weights[s]
            out.append((s, done[s], slot, begin + released, begin + due, phase))
            done[s], turn[s], left[s], slot = done[s] + 1, turn[s] + 1, left[s] - 1, slot + 1
            if left[s]:
                heapq.heappush(waiting, ((turn[s] - 1) * total // weights[s], s))
            else:
                del left[s]
                ended, phase = True, phase + 1
    return out


def _tiers(rows: DataFrame, given: dict[str, float], temperature: float, own: int, strata: int, tiers: int = 128) -> tuple[DataFrame, dict[str, float]]:
    """rows with the sources beyond the ``own`` largest and the given ones in pools '#0', '#1', ...; each pool's time.

    Document k of a source of weight w comes at time (k + u) / w, u from the source's hash, so at any time each
    source has had its weight's share to within one document. Pools are spans of that time, one after another, cut
    where sources end: a pool's documents over its span are the weight that its sources have together.
    """
    spark, stats = rows.sparkSession, rows.groupBy("pool").agg(F.count("*").alias("n"))
    names = {r.pool for r in stats.orderBy(F.desc("n"), "pool").limit(own).select("pool").collect()} | set(given)
    kept = F.broadcast(spark.createDataFrame([(p,) for p in sorted(names)], "pool string"))
    weight = F.lit(float(min(given.values()))) if given else F.pow("n", F.lit(float(temperature)))
    ends = stats.join(kept, "pool", "left_anti").select((F.col("n") / weight).alias("end"))
    found = ends.agg(F.percentile_approx("end", [i / tiers for i in range(1, tiers)], 10000).alias("cuts"), F.max("end").alias("last")).first()
    if found.last is None:
        return rows, {}
    edges = [0.0, *sorted({*found.cuts, found.last})]
    source = Window.partitionBy("pool")
    rest = rows.join(kept, "pool", "left_anti").withColumn("n", F.count("*").over(source)).withColumn("k", F.row_number().over(source.orderBy("order", "doc_key")))
    first = (F.pmod(F.xxhash64("pool", F.lit("first")), F.lit(1 << 20)) + 0.5) / (1 << 20)
    rest = rest.withColumn("due", (F.col("k") - 1 + first) / weight)
    upper = F.array(*[F.lit(e) for e in edges[1:]])
    rest = rest.withColumn("tier", F.least(F.size(F.filter(upper, lambda e: e <= F.col("due"))), F.lit(len(edges) - 2)))
    low, high = (F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("tier") + i) for i in (1, 2))
    inside = F.floor((F.col("due") - low) / (high - low) * strata)
    rest = rest.withColumn("stratum", F.least(inside, F.lit(strata - 1)).cast("long")).withColumn("pool", F.concat(F.lit("#"), F.col("tier").cast("string")))
    apart = rows.join(kept, "pool", "left_semi")
    return apart.unionByName(rest.select(*rows.columns)), {f"#{t}": edges[t + 1] - edges[t] for t in range(len(edges) - 1)}


def mix(
    documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block: int = 64,
    max_blocks: int = 1 << 16, max_sources: int = 1 << 12, per_stratum: int = 1 << 16,
) -> DataFrame:
    """All rows and columns of documents, with mix_position (dense, from 0), mix_block, mix_slot,
    mix_release, mix_deadline and mix_phase; columns of these names that were there go.

    weights: target weight of each source (others: the least given); without, document counts to the
    power ``temperature``. A block has ``block`` documents, or more where there would be over
    ``max_blocks``, so the schedule made on the driver has a bounded size. Of more than
    ``max_sources`` sources the largest ones and those with given weights are scheduled one by one; the
    others share pools, spread inside by their weights, and a pool has its live sources' weights. Inside a source
    documents come in order of their id's hash, numbered in spans of that order that have about ``per_stratum``
    documents or fewer; the places don't depend on it. A null source is a source; null ids and repeated rows have
    places of their own.
    """
    spark = documents.sparkSession
    names = [c for c in documents.columns if not c.startswith("mix_")]
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    n_sources, n_rows = documents.groupBy(name.alias("pool")).count().agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    strata = 1 << max(10, (-(-n_rows // per_stratum) - 1).bit_length())
    given = {f"={s}": w for s, w in (weights or {}).items()}
    rows = documents.select(F.struct(*[documents[c] for c in names]).alias("row"), name.alias("pool"), key_id().alias("doc_key"))
    rows = rows.withColumn("order", F.xxhash64("doc_key", F.lit("mix")))
    # a source is numbered stratum by stratum, so no task has a whole source; strata are spans of its order
    rows = rows.withColumn("stratum", F.shiftright("order", 65 - strata.bit_length())).withColumn("due", F.lit(0.0))
    spans: dict[str, float] = {}
    if n_sources > max_sources:
        rows, spans = _tiers(rows, given, temperature, max_sources, strata)
    counts = rows.groupBy("pool", "stratum").count()
    running = Window.partitionBy("pool").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("pool", "stratum", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("before"))
    sizes = {r.pool: r.n for r in counts.groupBy("pool").agg(F.sum("count").alias("n")).collect()}
    size = max(block, -(-sum(sizes.values()) // max_blocks))
    target = {p: given.get(p, min(given.values())) if given else math.pow(n, temperature) for p, n in sizes.items()}
    target |= {p: sizes[p] / span for p, span in spans.items() if p in sizes}
    chain = [p for p in spans if p in sizes]
    plan, start, taken = [], 0, dict.fromkeys(sizes, 0)
    for s, number, slot, release, deadline, phase in schedule({p: -(-n // size) for p, n in sizes.items()}, whole_weights(target) if target else {}, dict(zip(chain[1:], chain))):
        plan.append((s, number, slot, release, deadline, phase, start))
        part = min(size, sizes[s] - taken[s])
        taken[s], start = taken[s] + part, start + part
    shape = "pool string, mix_block long, mix_slot long, mix_release long, mix_deadline long, mix_phase long, start long"
    blocks = F.broadcast(spark.createDataFrame(plan, shape))  # at most max_blocks rows and one more for each source
    inside = Window.partitionBy("pool", "stratum").orderBy("due", "order", "doc_key")
    placed = rows.withColumn("n", F.row_number().over(inside)).join(before, ["pool", "stratum"])
    placed = placed.withColumn("index", F.col("before") + F.col("n") - 1).withColumn("mix_block", F.floor(F.col("index") / size))
    placed = placed.join(blocks, ["pool", "mix_block"])
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in names], (F.col("start") + F.col("index") % size).alias("mix_position"),
        "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_phase",
    )
