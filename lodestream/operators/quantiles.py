"""Exact quantiles of any series, however long: distributed selection instead of one buffer of a series' values.

Short series, as counted, are sorted in one buffer of bounded size each. In a long one the wanted ranks are searched: rows
are counted between splitters that a mergeable sketch proposes, the gap that holds a rank becomes its new window, and so on
until a window is short enough to be sorted, or holds one value. Each round narrows a window to about the share of a gap.
The counts are exact, so the result does not depend on how good the sketch is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.graph import cut

#: A series or window of so many values is sorted in one buffer.
LIMIT = 100_000
GAPS = 64
BROADCAST_ROWS = 100_000
MOST_ROUNDS = 200


def _quoted(keys: Sequence[str]) -> list[str]:
    return [f"`{k}`" for k in keys]


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in _quoted(keys)])


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast if it was counted to be small; else the join is left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _selected(rows: DataFrame, ranks: DataFrame, limit: int) -> DataFrame:
    """(_g, _rank, _value): of each series ``_g`` the value ``_v`` of every wanted ``_rank`` (from 0 on)."""
    windows = cut(ranks.select("_g", "_rank", F.lit(0).cast("long").alias("_below"), F.lit(float("-inf")).alias("_lo"), F.lit(float("nan")).alias("_hi"), F.lit(None).cast("long").alias("_rows")))
    found = []
    for _ in range(MOST_ROUNDS):
        short = windows.where((F.col("_rows") <= limit) | (F.col("_lo") == F.col("_hi")))
        if not short.isEmpty():
            one = F.col("_lo") == F.col("_hi")
            found.append(short.where(one).select("_g", "_rank", F.col("_lo").alias("_value")))
            spans = _small(short.where(~one).select("_g", "_lo", "_hi").distinct())
            held = rows.join(spans, "_g").where("_v >= _lo and _v <= _hi").groupBy("_g", "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
            found.append(cut(held.join(short, ["_g", "_lo", "_hi"]).select("_g", "_rank", F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_value"))))
        windows = cut(windows.join(short.select("_g", "_rank"), ["_g", "_rank"], "left_anti"))
        if windows.isEmpty():
            return reduce(DataFrame.unionByName, found)
        spans = _small(windows.select("_g", "_lo", "_hi").distinct())
        inside = rows.join(spans, "_g").where("_v >= _lo and _v <= _hi").select("_g", "_lo", "_hi", "_v")
        cuts = inside.groupBy("_g", "_lo", "_hi").agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", [i / GAPS for i in range(GAPS + 1)], 10_000))).alias("_cuts"))
        # An odd gap is a splitter itself, so that a value that many rows share is found in one round.
        gap = F.aggregate("_cuts", F.lit(0), lambda n, c: n + F.when(c < F.col("_v"), 2).when(c == F.col("_v"), 1).otherwise(0))
        counted = inside.join(_small(cut(cuts)), ["_g", "_lo", "_hi"]).groupBy("_g", "_lo", "_hi", gap.alias("_gap")).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        # As many rows a window as there are gaps.
        before = F.coalesce(F.sum("_n").over(W.partitionBy("_g", "_lo", "_hi").orderBy("_gap").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        gaps = counted.withColumn("_before", before)
        hit = windows.join(gaps, ["_g", "_lo", "_hi"]).where((F.col("_rank") >= F.col("_below") + F.col("_before")) & (F.col("_rank") < F.col("_below") + F.col("_before") + F.col("_n")))
        windows = cut(hit.select("_g", "_rank", (F.col("_below") + F.col("_before")).alias("_below"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_n").alias("_rows")))
    raise RuntimeError(f"ranks not found in {MOST_ROUNDS} rounds")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], names: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """(keys, names): the quantiles of each series, linear between neighbours as ``percentile`` has them; null ones of nothing.

    Null values are left out, NaN is the largest value; null keys are a series of their own. Without keys there is one row.
    """
    # Inside, keys have names of their own, whatever characters theirs have.
    outer, keys = _quoted(keys), [f"_k{i}" for i in range(len(keys))]
    df = df.select(*[F.col(o).alias(k) for o, k in zip(outer, keys)], value.alias("_value"))
    value = F.col("_value")
    rows = df.select(*keys, value.cast("double").alias("_v")).where("_v is not null").withColumn("_v", F.col("_v") + F.lit(0.0))
    counts = df.groupBy(*keys).agg(F.count(value.cast("double")).alias("_n"))
    counts = cut(counts.withColumn("_g", F.monotonically_increasing_id()))
    long = counts.where(F.col("_n") > limit)
    buffered = lambda part: part.groupBy(*keys).agg(F.percentile("_v", [float(p) for p in shares]).alias("_q"))
    if long.isEmpty():
        direct = buffered(rows)
    else:
        listed = _small(long)
        same = _same(rows, long, keys) if keys else F.lit(True)
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), (F.col("_n") - 1) * F.lit(float(p))) for i, p in enumerate(shares)]))
        wanted = cut(long.select("_g", at.alias("_w")).select("_g", "_w._i", F.col("_w.col2").alias("_at")).withColumns({"_r0": F.floor("_at").cast("long"), "_r1": F.ceil("_at").cast("long")}))
        ranks = wanted.select("_g", F.explode(F.array("_r0", "_r1")).alias("_rank")).distinct()
        mine = cut(rows.join(listed, same).select("_g", "_v"))
        value_of = _selected(mine, ranks, limit)
        lower, upper = value_of.select("_g", F.col("_rank").alias("_r0"), F.col("_value").alias("_x")), value_of.select("_g", F.col("_rank").alias("_r1"), F.col("_value").alias("_y"))
        between = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise((F.col("_r1") - F.col("_at")) * F.col("_x") + (F.col("_at") - F.col("_r0")) * F.col("_y"))
        each = wanted.join(lower, ["_g", "_r0"]).join(upper, ["_g", "_r1"]).select("_g", "_i", between.alias("_q"))
        whole = each.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("_q"))
        selected = long.join(whole, "_g").select(*keys, "_q")
        direct = selected if not keys else buffered(rows.join(listed, same, "left_anti")).unionByName(selected)
    quantiles = [F.get("_q", i).alias(n) for i, n in enumerate(names)]
    if not keys:
        return direct.select(*quantiles)
    own = counts.select(*[F.col(k).alias(f"{k}_") for k in keys])
    same = reduce(lambda x, y: x & y, [F.col(f"{k}_").eqNullSafe(F.col(k)) for k in keys])
    return own.join(direct, same, "left").select(*[F.col(f"{k}_").alias(o[1:-1]) for k, o in zip(keys, outer)], *quantiles)


def joined_by(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two aggregates of the same rows side by side, the keys of ``a`` kept; null keys meet, and without keys there is one row
    on either side."""
    if not keys:
        return a.join(F.broadcast(b))
    theirs = b.select(*[F.col(k).alias(f"_their{i}") for i, k in enumerate(_quoted(keys))], *[F.col(f"`{c}`") for c in b.columns if c not in keys])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_their{i}")) for i, k in enumerate(_quoted(keys))])
    return a.join(theirs, same).drop(*[f"_their{i}" for i in range(len(keys))])
