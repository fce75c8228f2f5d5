"""Keyed diffs, two-list comparisons, tolerant reconciliation and fuzzy matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions.numbers import ratio
from lodestream.functions.text import weighted_similarity
from lodestream.operators.graph import cut
from lodestream.operators.similarity import best_matches


def last_per_key(df: DataFrame, key: Column, columns: Sequence[str], order_col: str) -> DataFrame:
    """(key, columns) of the last row of each key in order; blank keys are left out."""
    keyed = df.select(key.alias("key"), F.struct(*columns).alias("row"), F.col(order_col).alias("_order")).where(F.trim("key") != "")
    return keyed.groupBy("key").agg(F.max_by("row", "_order").alias("row"))


def keyed_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], order_col: str) -> DataFrame:
    """added / removed / modified / unchanged for each key (upper case, trimmed; the last duplicate wins), with the
    changed fields as an array of (field, old, new)."""
    norm = F.upper(F.trim(F.col(key).cast("string")))
    a = last_per_key(old, norm, columns, order_col).withColumnRenamed("row", "old")
    b = last_per_key(new, norm, columns, order_col).withColumnRenamed("row", "new")
    both = a.join(b, "key", "full_outer")
    fields = [F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"old.{c}").cast("string").alias("old"), F.col(f"new.{c}").cast("string").alias("new"))) for c in columns]
    changed = F.array_compact(F.array(*fields))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    return both.select("key", status.alias("status"), F.when(status == "modified", changed).otherwise(F.expr("cast(array() as array<struct<field:string,old:string,new:string>>)")).alias("changes"))


def positional_diff(a: DataFrame, b: DataFrame, order_a: str, order_b: str, columns: Sequence[str], chunk: str | None = None) -> DataFrame:
    """Row i against row i in order, as far as the shorter list goes; only rows that differ.

    ``chunk`` names a column that cuts both lists into lists of their own (sheets, documents), which spreads the work.
    """
    keys = [chunk] if chunk else []
    number = lambda df, o: df.withColumn("pos", F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(o)))
    left = number(a, order_a).select(*keys, "pos", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = number(b, order_b).select(*keys, "pos", *[F.col(c).alias(f"{c}_b") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return left.join(right, [*keys, "pos"]).where(differs)


def compare_lists(left: DataFrame, right: DataFrame, key: Column, attributes: Mapping[str, float], first_by: str) -> DataFrame:
    """matched / mismatch / missing (left only) / extra (right only) by key, with the weighted similarity of attributes.

    The first duplicate of a key counts, by ``first_by``. Severity: high for missing, medium for extra and for a
    similarity below 0.5, low for other mismatches.
    """
    first = lambda df: df.select(key.alias("key"), F.struct(*[F.col(c).cast("string").alias(c) for c in attributes]).alias("row"), F.col(first_by).alias("_o")).where("key != ''").groupBy("key").agg(F.min_by("row", "_o").alias("row"))
    both = first(left).withColumnRenamed("row", "l").join(first(right).withColumnRenamed("row", "r"), "key", "full_outer")
    score = weighted_similarity({c: (F.col(f"l.{c}"), F.col(f"r.{c}")) for c in attributes}, attributes)
    equal = F.lit(True)
    for c in attributes:
        equal = equal & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(equal, "matched").otherwise("mismatch")
    out = both.select("key", status.alias("status"), F.when(status.isin("matched", "mismatch"), F.round(score, 4)).alias("similarity"))
    severity = F.when(F.col("status") == "missing", "high").when((F.col("status") == "extra") | ((F.col("status") == "mismatch") & (F.col("similarity") < 0.5)), "medium").when(F.col("status") == "mismatch", "low").otherwise("none")
    return out.withColumn("severity", severity)


def reconcile_amounts(mine: DataFrame, theirs: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """match / variance / mine_only / theirs_only by key, with the fields beyond the tolerance and their differences."""
    a = mine.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("a"))
    b = theirs.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("b"))
    both = a.join(b, list(keys), "full_outer")
    gaps = [F.round(F.coalesce(f"a.{f}", F.lit(0.0)) - F.coalesce(f"b.{f}", F.lit(0.0)), 2) for f in fields]
    off = F.array_compact(F.array(*[F.when(F.abs(g) > tolerance, F.lit(f)) for f, g in zip(fields, gaps)]))
    status = F.when(F.col("b").isNull(), "mine_only").when(F.col("a").isNull(), "theirs_only").when(F.size(off) > 0, "variance").otherwise("match")
    return both.select(*keys, status.alias("status"), F.when(status == "variance", off).otherwise(F.array().cast("array<string>")).alias("fields"), *[g.alias(f"{f}_gap") for f, g in zip(fields, gaps)])


# Tolerances of amounts (both must hold) and of hours, and the percentages from which a difference is a warning
# and critical.
AMOUNT_TOLERANCE, PERCENT_TOLERANCE, HOURS_TOLERANCE = "1.00", "0.5", "2.00"
WARNING_PERCENT, CRITICAL_PERCENT = "2.0", "10.0"


def field_variances(mine: DataFrame, theirs: DataFrame, keys: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """(keys, field, mine, theirs, diff, pct, severity): a row for every field beyond its tolerance of the keys on both sides.

    ``fields`` are name -> kind, ``hours`` or ``currency``. The difference (theirs - mine) is in cents, the percentage that of
    mine, or of theirs where mine is 0. A value that only one side has is a variance without a difference: info if theirs
    lacks it, a warning if mine does. All fields are compared in one join.
    """
    number = lambda f: F.col(f).cast("decimal(20,6)").alias(f)
    both = mine.select(*keys, F.struct(*map(number, fields)).alias("a")).join(theirs.select(*keys, F.struct(*map(number, fields)).alias("b")), list(keys))
    found = []
    for field, kind in fields.items():
        a, b = F.col(f"a.{field}"), F.col(f"b.{field}")
        diff = F.round(b - a, 2)
        base = F.when(a != 0, a).when(b != 0, b).otherwise(1)
        pct = F.round(F.try_divide(F.abs(diff), F.abs(base)) * 100, 2)
        exact = lambda text: F.lit(text).cast("decimal(10,2)")
        within = F.abs(diff) <= exact(HOURS_TOLERANCE) if kind == "hours" else (F.abs(diff) <= exact(AMOUNT_TOLERANCE)) & (pct <= exact(PERCENT_TOLERANCE))
        severity = F.when(b.isNull(), "info").when(a.isNull(), "warning").when(pct >= exact(CRITICAL_PERCENT), "critical").when(pct >= exact(WARNING_PERCENT), "warning").otherwise("info")
        out = F.struct(F.lit(field).alias("field"), a.cast("double").alias("mine"), b.cast("double").alias("theirs"), diff.cast("double").alias("diff"), pct.cast("double").alias("pct"), severity.alias("severity"))
        found.append(F.when((a.isNotNull() | b.isNotNull()) & ~F.coalesce(within, F.lit(False)), out))
    return both.select(*keys, F.inline(F.array_compact(F.array(*found))))


def variance_counts(variances: DataFrame) -> DataFrame:
    """(field, variances, critical, warning, info): the counters of ``field_variances`` by field."""
    kinds = ("critical", "warning", "info")
    return variances.groupBy("field").agg(F.count("*").alias("variances"), *[F.count_if(F.col("severity") == k).alias(k) for k in kinds])


def budget_variance(base: DataFrame, compare: DataFrame, keys: Sequence[str], amount: str, tight: float = 5.0) -> DataFrame:
    """Sums side by side: difference, percentage (100 where the base is 0 and the other is not) and a bucket."""
    total = lambda df, name: df.groupBy(*keys).agg(F.sum(amount).alias(name))
    both = total(base, "base").join(total(compare, "compare"), list(keys), "full_outer").na.fill(0.0, ["base", "compare"])
    gap = F.col("compare") - F.col("base")
    pct = F.when(F.col("base") != 0, F.round(ratio(gap, F.col("base"), 100.0), 2)).when(F.col("compare") > 0, 100.0).otherwise(0.0)
    bucket = F.when(pct > tight, "over").when(pct < -tight, "under").otherwise("on_track")
    return both.select(*keys, F.round("base", 2).alias("base"), F.round("compare", 2).alias("compare"), F.round(gap, 2).alias("variance"), pct.alias("variance_pct"), bucket.alias("bucket"))


def cascade_match(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, exact: Sequence[tuple[str, Column, Column]],
    texts: tuple[str, str] | None = None, least_words: float = 0.6, least_ratio: float = 0.85, measure: str = "blocks",
) -> DataFrame:
    """(left_id, right_id, matched_by): one stage after another, each seeing only rows that no earlier stage matched.

    Exact keys come first, in order. With ``texts`` (a column of either side) the rest is matched by the share of common words
    (``words:0.67``), then by the ratio of the whole texts (``text:0.91``): the best right row of all, ties to the smaller id.
    """
    rest, out = left, left.sparkSession.createDataFrame([], f"left_id {left.schema[left_id].dataType.simpleString()}, right_id {right.schema[right_id].dataType.simpleString()}, matched_by string")
    for name, a, b in exact:
        keys = right.select(b.alias("_k"), F.col(right_id)).where(F.trim("_k") != "").groupBy("_k").agg(F.min(right_id).alias("right_id"))
        hit = rest.select(F.col(left_id).alias("left_id"), a.alias("_k")).join(keys, "_k").select("left_id", "right_id", F.lit(name).alias("matched_by"))
        out = out.unionByName(hit)
        rest = rest.join(hit.select(F.col("left_id").alias(left_id)), left_id, "left_anti")
    for name, how, least in (("words", "words", least_words), ("text", measure, least_ratio)) if texts else ():
        rest = cut(rest)
        found = cut(best_matches(rest.where(F.trim(texts[0]) != ""), right.where(F.trim(texts[1]) != ""), left_id, right_id, *texts, least, how))
        out = out.unionByName(found.select("left_id", "right_id", F.format_string(f"{name}:%.2f", "score").alias("matched_by")))
        rest = rest.join(found.select(F.col("left_id").alias(left_id)), left_id, "left_anti")
    return out
