"""Graphs as vertices (id) and edges (src, dst): validity, isolated vertices, layers, reachability, latest finish.

Iterations are joins over what changed in the last round. Each round is cut off by ``checkpoint`` into the folder that
``spark.checkpoint.dir`` names, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.dates import weekdays_after


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint below ``spark.checkpoint.dir``; a local master without that setting gets a temporary folder, a cluster an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestream-"))
    return df.checkpoint()


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that no edge touches."""
    touched = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return vertices.join(touched, "id", "left_anti")


def valid_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are vertices."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def gathered(parts: list[DataFrame], most: int = 40) -> list[DataFrame]:
    """The same rows in one table, once the parts of an iteration are many; until then no part is written again."""
    return parts if len(parts) < most else [cut(union(parts))]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, start: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(origin, id) for every vertex that an origin of ``start`` (column ``id``) reaches, itself included, breadth first."""
    front = cut(start.select(F.col("id").alias("origin"), "id").distinct())
    seen = [front]
    edge = cut(edges.select("src", "dst").distinct())
    for _ in range(most_rounds):
        step = front.join(edge, front["id"] == edge["src"]).select("origin", F.col("dst").alias("id")).distinct()
        front = cut(step.join(union(seen), ["origin", "id"], "left_anti"))
        if front.isEmpty():
            return union(seen)
        seen = gathered([*seen, front])
    raise RuntimeError(f"vertices further than {most_rounds} edges away")


def relaxed(start: DataFrame, edges: DataFrame, step: Callable[[Column], Column] = lambda v: v, most_rounds: int = 10_000) -> DataFrame:
    """(id, value): the least of a vertex's own value and what ``step`` makes of the values that reach it along the edges.

    ``start`` (id, value) has all vertices, with a null value where nothing is known. Only vertices whose value fell pass it on.
    """
    best = cut(start)
    fallen = best.where("value is not null")
    for _ in range(most_rounds):
        offered = fallen.join(edges, fallen["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(step(F.col("value"))).alias("offer"))
        fallen = cut(best.join(offered, "id").where("value is null or offer < value").select("id", F.col("offer").alias("value")))
        if fallen.isEmpty():
            return best
        best = cut(best.join(fallen.withColumnRenamed("value", "fell"), "id", "left").select("id", F.coalesce("fell", "value").alias("value")))
    raise RuntimeError(f"values still fall after {most_rounds} rounds")


def circles(edges: DataFrame) -> DataFrame:
    """(id, root) of the vertices on circles: those that reach each other have one root, the smallest of them.

    Strongly connected components by colouring. Vertices without edges in or out are trimmed. Then each takes the smallest
    vertex that reaches it as its colour; whatever reaches that vertex within the colour is its component. All components
    whose smallest vertex no smaller one reaches are found at once, and taken out.
    """
    left = cut(edges.select("src", "dst").where("src != dst").distinct())
    found = []
    while True:
        size = left.count()
        while size:
            left = cut(left.join(left.select(F.col("dst").alias("src")), "src", "left_semi").join(left.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
            before, size = size, left.count()
            if before == size:
                break
        if not size:
            return union(found) if found else left.select(F.col("src").alias("id"), F.col("src").alias("root"))
        colour = relaxed(left.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("value")), left)
        end = lambda side: colour.select(F.col("id").alias(side), F.col("value").alias(f"_{side}"))
        inside = cut(left.join(end("src"), "src").join(end("dst"), "dst").where("_src = _dst").select("src", "dst"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        parts = cut(relaxed(colour.select("id", F.when(F.col("id") == F.col("value"), F.col("value")).alias("value")), back).where("value is not null").select("id", F.col("value").alias("root")))
        several = parts.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
        found.append(cut(parts.join(several, "root", "left_semi").select("id", "root")))
        taken = parts.select(F.col("id").alias("src"))
        left = cut(inside.join(taken, "src", "left_anti").join(taken.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))


def closing_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) of the edges without which there is no circle: from a vertex to itself, and, among vertices that reach each
    other, those that do not lead further from the smallest of them (by steps, then by id)."""
    edge = cut(edges.select("src", "dst").distinct())
    on = circles(edge)
    end = lambda side: on.select(F.col("id").alias(side), F.col("root").alias(f"_{side}"))
    inside = cut(edge.where("src != dst").join(end("src"), "src").join(end("dst"), "dst").where("_src = _dst").select("src", "dst"))
    away = relaxed(on.select("id", F.when(F.col("id") == F.col("root"), 0).alias("value")), inside, lambda v: v + 1)
    steps = lambda side: away.select(F.col("id").alias(side), F.col("value").alias(f"_{side}"))
    placed = inside.join(steps("src"), "src").join(steps("dst"), "dst")
    return placed.where((F.col("_dst") < F.col("_src")) | ((F.col("_dst") == F.col("_src")) & (F.col("dst") < F.col("src")))).select("src", "dst").unionByName(edge.where("src = dst"))


def layers(vertices: DataFrame, edges: DataFrame, open_circles: bool = False) -> DataFrame:
    """(id, layer): the longest path that leads to a vertex. Edges from a vertex to itself do not count.

    A vertex gets its layer in the round in which its last predecessor has one, so there are as many rounds as layers; each
    writes its own layer only. Where circles are left, their vertices and those behind them get null, or, with
    ``open_circles``, the circles are opened at their ``closing_edges`` and the rounds begin again.
    """
    every, everyone = cut(valid_edges(vertices, edges).select("src", "dst").where("src != dst").distinct()), cut(vertices.select("id").distinct())
    edge, left = every, everyone
    done, layer = [], 0
    while True:
        blocked = edge.select(F.col("dst").alias("id")).distinct()
        ready = cut(left.join(blocked, "id", "left_anti").select("id", F.lit(layer).alias("layer")))
        if ready.isEmpty():
            if open_circles and not edge.isEmpty():
                # What lies on a circle may come before what has a layer by now, so all begins again.
                edge, left, open_circles = cut(every.join(closing_edges(edge), ["src", "dst"], "left_anti")), everyone, False
                done, layer = [], 0
                continue
            return union([*done, left.select("id", F.lit(None).cast("int").alias("layer"))])
        done = gathered([*done, ready])
        left = cut(left.join(ready, "id", "left_anti"))
        edge = cut(edge.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        layer += 1


def latest_reachable(activities: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, reach): the latest ``finish`` among an activity and all that follow it.

    Values flow backwards along the edges, and only vertices whose value rose pass it on: one row a vertex, not a row for
    each pair that the transitive closure has.
    """
    edge = edges.select("src", "dst").distinct()
    best = cut(activities.select("id", F.col("finish").alias("reach")))
    risen = best
    for _ in range(most_rounds):
        offered = risen.join(edge, risen["id"] == edge["dst"]).groupBy(F.col("src").alias("id")).agg(F.max("reach").alias("offer"))
        risen = cut(best.join(offered, "id").where("offer > reach").select("id", F.col("offer").alias("reach")))
        if risen.isEmpty():
            return best
        best = cut(best.join(risen.withColumnRenamed("reach", "risen"), "id", "left").select("id", F.coalesce("risen", "reach").alias("reach")))
    raise RuntimeError("the activities depend on each other in a circle")


def total_float(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reach, float_days, is_critical): weekdays from the latest reachable finish to the finish of the whole."""
    reach = latest_reachable(activities, edges)
    end = activities.agg(F.max("finish").alias("end"))
    days = weekdays_after(F.col("reach"), F.col("end"))
    return reach.crossJoin(F.broadcast(end)).select("id", "reach", days.alias("float_days"), (days == 0).alias("is_critical"))
