"""Exact quantiles by distributed selection, and circles of graphs, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import graph
from lodestream.operators.quantiles import exact_quantiles
from lodestream.operators.transform import execute

SHARES, NAMES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0], ["q0", "q25", "q50", "q75", "q90", "q100"]


def series():
    draw = np.random.default_rng(3)
    return {
        "normal": draw.normal(size=4000).tolist(),
        "wide": (10.0 ** draw.uniform(-300, 300, 3000)).tolist() + [-1e308, 5e-324],
        "ties": [1.0] * 3000 + [2.0] * 500 + [0.5],
        "one": [7.5] * 2500,
        "short": [3.0, 1.0, 2.0],
        "single": [4.0],
        "infinite": [math.inf, -math.inf] * 600 + [0.0, -0.0] * 400,
        None: draw.exponential(size=1500).tolist(),
    }


@pytest.mark.parametrize("limit", [50, 100_000])
def test_quantiles_equal_sorting(spark, limit):
    rows = [(k, v, "x") for k, values in series().items() for v in values] + [("nothing", None, "x"), ("short", None, "x")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double, q25 string").repartition(4)
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], F.col("v"), SHARES, NAMES, limit).collect()}
    assert len(out) == 9 and all(out["nothing"][n] is None for n in NAMES)
    for k, values in series().items():
        values = sorted(values)
        for share, name in zip(SHARES, NAMES):
            at = share * (len(values) - 1)
            lo, hi = values[math.floor(at)], values[math.ceil(at)]
            expected = lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
            assert out[k][name] == expected or math.isclose(out[k][name], expected, rel_tol=1e-12), (k, name)


def test_quantiles_of_everything_and_of_nothing(spark):
    df = spark.range(1001).select((F.col("id") % 100).cast("double").alias("v"))
    for limit in (10, 5000):
        assert tuple(exact_quantiles(df, [], F.col("v"), [0.5, 0.999], ["m", "n"], limit).first()) == (49.0 if limit else 0, 99.0)
    assert tuple(exact_quantiles(df.where("v < 0"), [], F.col("v"), [0.5], ["m"]).first()) == (None,)


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(float("nan"),)] * 30 + [(float(i),) for i in range(71)], "v double")
    out = exact_quantiles(df, [], F.col("v"), [0.5, 1.0], ["m", "top"], 5).first()
    assert out["m"] == 50.0 and math.isnan(out["top"])


def test_median_among_other_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 2.0), ("a", 4.0), (None, 5.0)], "`k.x` string, v double")
    out = execute("aggregate", df, {"group_by": ["k.x"], "aggregations": [{"column": "v", "function": f} for f in ("max", "median", "count")]})
    assert out.columns == ["k.x", "v_max", "v_median", "v_count"]
    assert sorted(map(tuple, out.collect())) == [("a", 9.0, 4.0, 3), ("b", 2.0, 2.0, 1)]
    assert tuple(execute("aggregate", df, {"aggregations": [{"column": "v", "function": "median", "output_name": "m"}]}).first()) == (4.0,)


# --- circles ----------------------------------------------------------------------------------------------------------


def reach(edges):
    out = {}
    for a in {x for e in edges for x in e}:
        seen, front = set(), {a}
        while front:
            front = {d for s, d in edges if s in front} - seen
            seen |= front
        out[a] = seen
    return out


def plain_circles(edges):
    edges = {(s, d) for s, d in edges if s != d}
    to = reach(edges)
    return {a: min(b for b in to[a] if a in to[b]) for a in to if a in to[a]}


def plain_closing(edges):
    root = plain_circles(edges)
    inside = {(s, d) for s, d in edges if s != d and s in root and root.get(d) == root[s]}
    steps, front = {v: 0 for v in root if root[v] == v}, {v for v in root if root[v] == v}
    while front:
        new = {d for s, d in inside if s in front and d not in steps}
        steps.update({d: 1 + min(steps[s] for s, e in inside if e == d and s in front) for d in new})
        front = new
    return {(s, d) for s, d in inside if (steps[d], d) < (steps[s], s)} | {(s, d) for s, d in edges if s == d}


def plain_layers(vertices, edges):
    edges = {(s, d) for s, d in edges if s in vertices and d in vertices and s != d}
    layer, left = {}, set(vertices)
    while left:
        ready = {v for v in left if not any(d == v and s in left for s, d in edges)}
        assert ready
        layer.update(dict.fromkeys(ready, max(layer.values(), default=-1) + 1))
        left -= ready
    return layer


def test_circles_and_layers_without_them(spark):
    draw = random.Random(1)
    n = 16
    edges = {(draw.randrange(n), draw.randrange(n)) for _ in range(20)} | {(50, 51), (51, 52), (52, 50), (52, 53), (53, 54), (54, 53), (55, 55)}
    vertices = set(range(56)) - {3}
    frame = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    assert {r["id"]: r["root"] for r in graph.circles(frame).collect()} == plain_circles(edges)
    closing = {(r["src"], r["dst"]) for r in graph.closing_edges(frame).collect()}
    assert closing == plain_closing(edges) and (52, 50) in closing and (54, 53) in closing
    valid = {(s, d) for s, d in edges if s in vertices and d in vertices and s != d}
    v = spark.createDataFrame([(i,) for i in vertices], "id bigint")
    found = {r["id"]: r["layer"] for r in graph.layers(v, frame, open_circles=True).collect()}
    # Only what lies on a circle or behind one is opened, so plain layers of the rest agree.
    assert found == plain_layers(vertices, valid - plain_closing(valid)) and None not in found.values()
    kept = {r["id"]: r["layer"] for r in graph.layers(v, frame).collect()}
    assert kept[50] is None and kept[53] is None


def test_circles_of_graphs_without(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(5)], "src bigint, dst bigint")
    assert graph.circles(path).count() == 0 and graph.closing_edges(path).count() == 0
    assert graph.circles(path.where("src < 0")).count() == 0
