"""Dependencies as edges: levels, cycles, what an edit reaches, and the critical path of tasks.

Rounds of joins until nothing changes, each written to the checkpoint folder; nothing but counts
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def levels(edges: DataFrame) -> DataFrame:
    """node, level (null on or behind a cycle) of edges (src, dst): 0 without precedents, else one more than their highest."""
    edges = durable(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    done = durable(nodes.join(edges, nodes.node == edges.dst, "left_anti").withColumn("level", F.lit(0)))
    while True:
        # a node is ready once all its precedents have levels
        open_edges = edges.join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
        state = open_edges.join(done.select(F.col("node").alias("src"), "level"), "src", "left").groupBy("dst").agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("waiting"))
        ready = durable(state.filter("waiting = 0").select(F.col("dst").alias("node"), (F.col("level") + 1).cast("int").alias("level")))
        if ready.isEmpty():
            return nodes.join(done, "node", "left")
        done = durable(done.unionByName(ready))


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes that an edit of the seeds (node) reaches, themselves included."""
    edges = durable(edges.select("src", "dst").distinct())
    found = durable(seeds.select("node").distinct())
    front = found
    while True:
        following = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = durable(following.join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = durable(found.unionByName(front))


def critical_path(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """task, start, finish, slack, critical of tasks (task, duration) under edges (src before dst).

    Tasks on a cycle come back without times.
    """
    tasks = durable(tasks.select("task", F.col("duration").cast("double").alias("duration")))
    edges = durable(edges.select("src", "dst").distinct())

    def sweep(edges, offset):
        """Longest way to each task over the durations of those before it."""
        done = durable(tasks.join(edges, tasks.task == edges.dst, "left_anti").select("task", F.lit(0.0).alias("t")))
        while True:
            waiting = edges.join(done.select(F.col("task").alias("dst")), "dst", "left_anti")
            known = done.join(tasks, "task").select(F.col("task").alias("src"), (F.col("t") + F.col("duration")).alias("end"))
            state = waiting.join(known, "src", "left").groupBy("dst").agg(F.max("end").alias("t"), F.count_if(F.col("end").isNull()).alias("open"))
            ready = durable(state.filter("open = 0").select(F.col("dst").alias("task"), "t"))
            if ready.isEmpty():
                return done.withColumnRenamed("t", offset)
            done = durable(done.unionByName(ready))

    forward = sweep(edges, "start")
    backward = sweep(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "after")
    times = tasks.join(forward, "task", "left").join(backward, "task", "left").withColumn("finish", F.col("start") + F.col("duration"))
    end = times.agg(F.max("finish").alias("end"))
    out = times.join(F.broadcast(end)).withColumn("slack", F.col("end") - F.col("after") - F.col("finish"))
    return out.select("task", "start", "finish", "slack", (F.abs("slack") < 1e-9).alias("critical"))


_FOLDS = {"SUM": F.sum, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "PRODUCT": F.product}


def _step(edges: DataFrame, formulas: DataFrame, known: DataFrame) -> DataFrame:
    """Values of formulas from the values of what they read; the first error (by code) wins."""
    read = edges.join(known.select(F.col("node").alias("src"), "value", "error"), "src")
    x = F.col("value") * F.col("weight")
    folded = read.groupBy("dst").agg(*[f(x).alias(name) for name, f in _FOLDS.items()], F.min("error").alias("error"))
    pick = F.coalesce(*[F.when(F.col("fold") == name, F.col(name)) for name in _FOLDS])
    out = folded.join(formulas, folded.dst == formulas.node)
    return out.select("node", F.when(F.col("error").isNull(), pick).alias("value"), "error")


def recalculate(literals: DataFrame, formulas: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """node, value, error, evaluated of a grid whose formulas fold what they read.

    literals (node, value); formulas (node, fold: SUM, AVERAGE, MIN, MAX, PRODUCT); edges (src, dst,
    weight). Each level is one join and one aggregate. With seeds (edited nodes) and the values
    before, only what the seeds reach is computed again; the rest sleeps. Formulas on or behind a
    cycle are #CYCLE!.
    """
    ranks = durable(levels(edges))
    work = formulas
    known = durable(literals.select("node", F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("evaluated")))
    if seeds is not None:
        cone = durable(reach(edges, seeds))
        work = durable(formulas.join(cone, "node", "left_semi"))
        asleep = before.join(formulas, "node", "left_semi").join(cone, "node", "left_anti")
        known = durable(known.unionByName(asleep.select("node", "value", "error", F.lit(False).alias("evaluated"))))
    staged = durable(work.join(ranks, "node", "left"))
    top = staged.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        mine = staged.filter(F.col("level") == level).drop("level")
        done = _step(edges.join(mine.select(F.col("node").alias("dst")), "dst", "left_semi"), mine, known)
        known = durable(known.unionByName(done.withColumn("evaluated", F.lit(True))))
    loops = staged.filter("level is null").select("node", F.lit(None).cast("double").alias("value"), F.lit("#CYCLE!").alias("error"), F.lit(True).alias("evaluated"))
    return known.unionByName(loops)


def solve(literals: DataFrame, formulas: DataFrame, edges: DataFrame, epsilon: float = 1e-6, rounds: int = 100) -> DataFrame:
    """Values of a grid with loops, by rounds over all formulas from zero until none moves by epsilon; #NUM! if they do not settle."""
    fixed = literals.select("node", F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("error"))
    now = durable(formulas.select("node", F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("error")))
    for _ in range(rounds):
        after = durable(_step(edges, formulas, fixed.unionByName(now)))
        moved = after.join(now.select("node", F.col("value").alias("old")), "node").agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0]
        now = after
        if moved is None or moved < epsilon:
            return fixed.unionByName(now)
    return fixed.unionByName(now.select("node", F.lit(None).cast("double").alias("value"), F.lit("#NUM!").alias("error")))


def fan_out(edges: DataFrame, k: int = 1) -> DataFrame:
    """The k nodes that most others read."""
    return edges.groupBy("src").agg(F.count_distinct("dst").alias("readers")).orderBy(F.desc("readers"), "src").limit(k)


def error_origins(values: DataFrame, edges: DataFrame) -> DataFrame:
    """node, error, born: whether an error arose there, or was read from a cell with the same one."""
    bad = values.filter("error is not null").select("node", "error")
    echoes = edges.join(bad.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "error").distinct()
    return bad.join(echoes.withColumn("echo", F.lit(True)), ["node", "error"], "left").select("node", "error", F.col("echo").isNull().alias("born"))
