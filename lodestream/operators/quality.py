"""Data quality: completeness, back-fill plans, rule findings, consistency and confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.numbers import ratio
from lodestream.operators.analytics import modal_value


def is_blank(c: Column, na: Sequence[str] = ("", "n/a", "na", "-")) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*na)


def row_completeness(df: DataFrame, weights: Mapping[str, float], name: str = "completeness") -> DataFrame:
    """Weighted share of filled columns of each row, and the names of the blank ones."""
    got = F.lit(0.0)
    for c, w in weights.items():
        got = got + F.when(is_blank(F.col(c)), 0.0).otherwise(float(w))
    missing = F.array_compact(F.array(*[F.when(is_blank(F.col(c)), F.lit(c)) for c in weights]))
    return df.withColumns({name: F.round(got / float(sum(weights.values())), 4), "missing": missing})


def column_completeness(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Filled rows and their share for each column: one pass with one aggregate a column, then unpivoted."""
    counted = df.agg(F.count("*").alias("total"), *[F.count_if(~is_blank(F.col(c))).alias(c) for c in weights])
    long = counted.unpivot(["total"], list(weights), "column", "filled")
    weight = F.element_at(F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))]), F.col("column"))
    return long.select("column", weight.alias("weight"), "filled", "total", F.round(ratio(F.col("filled"), F.col("total")), 4).alias("pct"))


def backfill_plan(df: DataFrame, columns: Sequence[str], least_share: float = 0.6) -> DataFrame:
    """For each column the value that blank rows could take: the modal one, if it holds enough of the filled rows."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    blank = long.groupBy("column").agg(F.count_if(is_blank(F.col("value"))).alias("fillable_rows"))
    return modal_value(long.where(~is_blank(F.col("value"))), ["column"], "value", least_share).join(blank, "column").where("fillable_rows > 0")


@dataclass(frozen=True)
class Rule:
    """A named condition that good rows meet; null counts as good unless the rule says ``required``."""

    name: str
    column: str
    good: Column
    severity: str = "error"


def required(column: str) -> Rule:
    return Rule("required", column, ~is_blank(F.col(column)))


def pattern(column: str, regex: str) -> Rule:
    return Rule("pattern", column, F.coalesce(F.col(column).rlike(regex), F.lit(True)), "warning")


def within(column: str, low: float, high: float) -> Rule:
    return Rule("range", column, F.coalesce(F.col(column).between(low, high), F.lit(True)))


def ordered(low: str, high: str) -> Rule:
    return Rule("order", f"{low}<={high}", F.coalesce(F.col(low) <= F.col(high), F.lit(True)))


def inside(inner_low: str, inner_high: str, outer_low: str, outer_high: str) -> list[Rule]:
    """Both ranges are in order, and the inner one does not leave the outer one."""
    below = Rule("below", f"{inner_low}>={outer_low}", F.coalesce(F.col(inner_low) >= F.col(outer_low), F.lit(True)), "warning")
    above = Rule("above", f"{inner_high}<={outer_high}", F.coalesce(F.col(inner_high) <= F.col(outer_high), F.lit(True)), "warning")
    return [ordered(inner_low, inner_high), ordered(outer_low, outer_high), below, above]


def rising(*columns: str) -> list[Rule]:
    """Neighbours of a ladder of limits (such as LL, L, H, HH) are in order; a missing step breaks nothing."""
    return [ordered(a, b) for a, b in zip(columns, columns[1:])]


def findings(df: DataFrame, id_col: str, rules: Sequence[Rule]) -> DataFrame:
    """One row for each rule that a row breaks: all rules in one pass over the table."""
    broken = F.array_compact(F.array(*[F.when(~r.good, F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.lit(r.severity).alias("severity"))) for r in rules]))
    return df.select(id_col, F.explode(broken).alias("f")).select(id_col, "f.rule", "f.column", "f.severity")


def rule_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break each rule, and the share of good rows (100 for an empty table)."""
    counted = df.agg(F.count("*").alias("total"), *[F.count_if(~r.good).alias(f"{r.name}:{r.column}") for r in rules])
    long = counted.unpivot(["total"], [f"{r.name}:{r.column}" for r in rules], "rule", "broken")
    return long.select("rule", "broken", F.round(ratio(F.col("total") - F.col("broken"), F.col("total"), 100.0, 100.0), 2).alias("good_pct"))


def conflicting_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that carry more than one non-blank value."""
    rows = df.where(~is_blank(F.col(value)))
    return rows.groupBy(key).agg(F.count_distinct(F.trim(value)).alias("n_values"), F.array_join(F.sort_array(F.collect_set(F.trim(value))), "; ").alias("values")).where("n_values > 1")


def confidence(df: DataFrame, id_col: str, columns: Mapping[str, str], source_col: str, source_weight: Mapping[str, float], bonus: float = 0.1, default: float = 0.5) -> DataFrame:
    """Mean over the columns of a source's weight, plus or minus the bonus as the value fits its pattern, within 0..1;
    a blank cell counts 0."""
    base = F.coalesce(F.element_at(F.create_map(*[x for k, v in source_weight.items() for x in (F.lit(k), F.lit(v))]), F.col(source_col)), F.lit(default))
    total = F.lit(0.0)
    for c, regex in columns.items():
        fits = F.when(F.col(c).cast("string").rlike(regex), bonus).otherwise(-bonus)
        total = total + F.when(is_blank(F.col(c)), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + fits)))
    return df.select(id_col, F.round(total / len(columns), 4).alias("confidence"))
