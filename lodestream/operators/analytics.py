"""Aggregates, windows and joins that operational reports are made of.

``now`` is always a parameter: nothing here reads the clock, so a query gives the same result each time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.graph import cut

from lodestream.functions.dates import PERIODS
from lodestream.functions.numbers import ratio


# --- aggregates -------------------------------------------------------------------------------------------------------


def bucketed(df: DataFrame, time_col: str, period: str, metrics: Mapping[str, Column], label: str | None = None) -> DataFrame:
    """Metrics by hour, day, week (Monday), month or quarter, with the label of each bucket if asked for."""
    start, named = PERIODS[period]
    out = df.groupBy(start(F.col(time_col)).alias("bucket")).agg(*[c.alias(k) for k, c in metrics.items()])
    return out.withColumn(label, named(F.col("bucket"))) if label else out


def count_distinct_with_null(c: Column) -> Column:
    """Distinct values where null counts as one."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def gap_filled(df: DataFrame, day_col: str, start: Column, end: Column, fill: Mapping[str, object]) -> DataFrame:
    """One row for every day in [start, end]; days without a row get the fill values.

    The calendar is made of the two bounds alone, which are constants or one-row aggregates folded into literals.
    """
    days = df.sparkSession.range(1).select(F.explode(F.sequence(start.cast("date"), end.cast("date"))).alias(day_col))
    out = days.join(df, day_col, "left")
    return out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in fill.items()})


def share_of_total(df: DataFrame, keys: Sequence[str], hidden: Column | None = None) -> DataFrame:
    """Rows of each group and their percentage of all rows, those of hidden groups included in the whole."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    out = counted.withColumn("pct", F.round(ratio(F.col("n"), F.sum("n").over(W.partitionBy()), 100.0), 2))
    return out.where(~hidden) if hidden is not None else out


def peak_bucket(df: DataFrame, bucket_col: str, value_col: str) -> DataFrame:
    """The bucket of the largest value; of equal ones the first."""
    return df.orderBy(F.col(value_col).desc_nulls_last(), F.col(bucket_col).asc()).limit(1)


def modal_value(df: DataFrame, keys: Sequence[str], value_col: str, least_share: float = 0.0, fold_case: bool = True) -> DataFrame:
    """The most common non-blank value of each group, compared without case, in its most common spelling.

    Ties go to the smaller text. Groups where it holds less than ``least_share`` of the non-blank rows are left out.
    """
    value = F.trim(F.col(value_col).cast("string"))
    rows = df.select(*keys, value.alias("spelling")).where("spelling != ''").withColumn("folded", F.lower("spelling") if fold_case else F.col("spelling"))
    spelt = rows.groupBy(*keys, "folded", "spelling").agg(F.count("*").alias("n"))
    best = spelt.groupBy(*keys, "folded").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("n"), F.col("spelling").alias("s")))["s"].alias("value"))
    total = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ranked = best.withColumn("share", F.col("n") / F.sum("n").over(total)).withColumn("place", F.row_number().over(total.orderBy(F.col("n").desc(), "folded")))
    return ranked.where((F.col("place") == 1) & (F.col("share") >= least_share)).select(*keys, "value", "n", F.round("share", 4).alias("share"))


def top_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def two_level_rollup(df: DataFrame, group_col: str, member_col: str, metrics: Mapping[str, Column], top: int = 3) -> DataFrame:
    """Members summed up by group, with the top members of each group nested.

    ``metrics`` are the members' aggregates; each is added up by group, and the first orders the members.
    """
    members = df.groupBy(group_col, member_col).agg(*[c.alias(k) for k, c in metrics.items()])
    lead = next(iter(metrics))
    placed = members.withColumn("place", F.row_number().over(W.partitionBy(group_col).orderBy(F.col(lead).desc(), F.col(member_col).asc())))
    leaders = F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", F.col(member_col).alias("member"), F.col(lead).alias("value")))))
    return placed.groupBy(group_col).agg(F.count("*").alias("members"), *[F.sum(k).alias(k) for k in metrics], leaders.alias("leaders"))


def co_occurrence(df: DataFrame, a: str, b: str, top: int) -> DataFrame:
    """The most frequent pairs of values."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).orderBy(F.desc("n"), a, b).limit(top)


def recent_unique(df: DataFrame, value_col: str, order_col: str, n: int) -> DataFrame:
    """The first n distinct values, newest first."""
    return df.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.max(order_col).alias("last_seen")).orderBy(F.desc("last_seen"), value_col).limit(n)


# --- windows ----------------------------------------------------------------------------------------------------------


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order`` (newest first)."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def greatest_with_ties(df: DataFrame, keys: Sequence[str], value_col: str) -> DataFrame:
    """All rows that hold the largest value of their key, ties included."""
    return df.withColumn("_rank", F.rank().over(W.partitionBy(*keys).orderBy(F.col(value_col).desc()))).where("_rank = 1").drop("_rank")


def placed(df: DataFrame, order: Sequence[Column], place: str) -> DataFrame:
    """The place of every row among all, from 1 on: ranges of the order, their counts added up, and places inside ranges.

    No task holds more than a range. ``order`` must tell rows apart for the places to be the same on every run.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a range.
    before = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), "_range").withColumn(place, (F.col("_before") + F.col("_nth")).cast("int")).drop("_range", "_nth", "_before")


def ranked_then_filtered(df: DataFrame, order: Sequence[Column], keep: Column, place: str = "rank") -> DataFrame:
    """Places among all rows, then the filter: what is left keeps the place that it had."""
    return placed(df, order, place).where(keep)


def min_max(df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = (), invert: Sequence[str] = ()) -> DataFrame:
    """New columns with ``values`` scaled to 0 to 100 within the group; 50 where all are equal.

    Lowest and highest values come from a partial aggregation: one row for all, or one a group, joined back.
    """
    ends = [x for k, c in values.items() for x in (F.min(c).alias(f"_lo_{k}"), F.max(c).alias(f"_hi_{k}"))]
    if by:
        group = df.groupBy(*by).agg(*ends)
        joined = df.alias("l").join(group.alias("g"), [F.col(f"l.{k}").eqNullSafe(F.col(f"g.{k}")) for k in by]).drop(*[F.col(f"g.{k}") for k in by])
    else:
        joined = df.join(F.broadcast(df.agg(*ends)))

    def scaled(name: str, c: Column) -> Column:
        share = (c - F.col(f"_lo_{name}")) / F.nullif(F.col(f"_hi_{name}") - F.col(f"_lo_{name}"), F.lit(0))
        return F.coalesce((1 - share if name in invert else share) * 100, F.lit(50.0))

    return joined.withColumns({k: scaled(k, c) for k, c in values.items()}).drop(*[f"_{e}_{k}" for k in values for e in ("lo", "hi")])


def running_balance(df: DataFrame, keys: Sequence[str], order_col: str, delta: Column, carried: Column, name: str = "balance") -> DataFrame:
    """Brought forward plus all changes so far."""
    upto = W.partitionBy(*keys).orderBy(order_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.round(F.sum(delta).over(upto) + carried, 2))


def trailing(df: DataFrame, keys: Sequence[str], order_col: str, value_col: str, spans: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing means of the given numbers of rows, and the population deviation over the longest."""
    order = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order_col)
    means = {f"mean_{n}": F.avg(value_col).over(order.rowsBetween(-n + 1, 0)) for n in spans}
    return df.withColumns(means | {"volatility": F.stddev_pop(value_col).over(order.rowsBetween(-max(spans) + 1, 0))})


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each row, the columns that differ from the row before it in its group; none for the first."""
    window = W.partitionBy(*keys).orderBy(*order)
    before = {c: F.lag(F.col(c)).over(window) for c in columns}
    first = F.row_number().over(window) == 1
    differs = [F.when(~first & ~F.col(c).eqNullSafe(before[c]), F.lit(c)) for c in columns]
    return df.withColumn("changed", F.array_compact(F.array(*differs)))


# --- joins ------------------------------------------------------------------------------------------------------------


def coalesced_join(df: DataFrame, other: DataFrame, keys: Sequence[tuple[Column, Column, str]], values: Sequence[str]) -> DataFrame:
    """Left join by the first key that matches: (own key, other's key, name); ``matched_by`` tells which.

    Each key is an equi join of its own, so large tables stay hash joins; of several rows of the other side with one key
    the smallest values are taken, so rows never multiply. Blank keys match nothing.
    """
    out, found = df, []
    for i, (mine, theirs, name) in enumerate(keys):
        key = f"_key{i}"
        side = other.select(theirs.alias(key), *[F.col(v).alias(f"_v{i}_{v}") for v in values]).where(F.trim(key) != "")
        side = side.groupBy(key).agg(F.min(F.struct(*[f"_v{i}_{v}" for v in values])).alias(f"_hit{i}"))
        out = out.join(side, mine == F.col(key), "left").drop(key)
        found.append((f"_hit{i}", name))
    matched = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(n)) for h, n in found])
    picked = {v: F.coalesce(*[F.when(F.col(h).isNotNull(), F.col(f"{h}._v{i}_{v}")) for i, (h, _) in enumerate(found)]) for v in values}
    return out.withColumns(picked | {"matched_by": matched}).drop(*[h for h, _ in found])


def overlap_prorated(df: DataFrame, start_col: str, end_col: str, first: Column, last: Column, amount: Column, name: str = "prorated") -> DataFrame:
    """Rows whose [start, end] meets [first, last], with the amount's share of the days inside."""
    inside = F.datediff(F.least(F.col(end_col), last), F.greatest(F.col(start_col), first)) + 1
    whole = F.datediff(F.col(end_col), F.col(start_col)) + 1
    met = df.where((F.col(start_col) <= last) & (F.col(end_col) >= first))
    return met.withColumn("overlap_days", inside).withColumn(name, F.round(ratio(amount * inside, whole), 2))


def full_outer_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], a_cols: Sequence[str], b_cols: Sequence[str]) -> DataFrame:
    """Two keyed aggregates side by side; a key that one lacks has 0 there."""
    return a.join(b, list(keys), "full_outer").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in [*a_cols, *b_cols]])


def overlaid(base: DataFrame, override: DataFrame, keys: Sequence[str], value_col: str) -> DataFrame:
    """The base's value of a key, replaced by the override's where there is one; keys of either side."""
    over = override.select(*keys, F.col(value_col).alias("_over"))
    return base.join(over, list(keys), "full_outer").withColumn(value_col, F.coalesce("_over", value_col)).drop("_over")


def visible_rows(df: DataFrame, scope: str, user: str, owner_col: str, team: DataFrame | None = None, custom: Column | None = None) -> DataFrame:
    """Row-level visibility: own rows, a team's (semi join on ``team.user``), all, or by a condition; else none."""
    if scope == "personal":
        return df.where(F.col(owner_col) == user)
    if scope == "team" and team is not None:
        return df.join(team.select(F.col("user").alias(owner_col)), owner_col, "left_semi")
    if scope in ("organisation", "public"):
        return df
    if scope == "custom" and custom is not None:
        return df.where(custom)
    return df.limit(0)


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows where some column contains the text, without case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return df.where(hit)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 500, most: int = 500) -> DataFrame:
    """Page ``number`` (from 1) in a total order."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def shared_tokens(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_tokens: Column, b_tokens: Column, least: int = 2, same_ids: bool = True) -> DataFrame:
    """For each row of a the row of b that shares most tokens, at least ``least``; ties go to the smaller id.

    Tokens meet in an equi join; pairs are only those that share one. Give each distinct text once and join its rows back
    afterwards, or copies multiply. Without ``same_ids`` a row does not meet itself.
    """
    left = a.select(F.col(a_id), F.explode(F.array_distinct(a_tokens)).alias("token"))
    right = b.select(F.col(b_id), F.explode(F.array_distinct(b_tokens)).alias("token"))
    met = left.join(right, "token")
    met = met if same_ids else met.where(F.col(a_id) != F.col(b_id))
    pairs = met.groupBy(a_id, b_id).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return top_within(pairs, [a_id], [F.desc("shared"), F.col(b_id)], 1).drop("place")
