"""Materialised aggregates that are refreshed from changes alone.

A view keeps for each group what can be merged: how many rows it has and, of every measure, sum, count, least and largest
value. A refresh adds what came and takes off what went. Only where a row went that held a least or largest value has the
group to be read again. Groups lie in hash buckets, and only buckets of changed groups are rewritten (``sources.parted``).

Sums are kept as decimals of six places, so that taking away what was added leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestream.sources.parted import drop_unused, read_parts, replace_parts, versions

KINDS = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class View:
    """``measures``: output -> (kind, column); ``where`` leaves rows out. ``root`` is a folder of the view alone."""

    root: str
    keys: Sequence[str]
    measures: Mapping[str, tuple[str, str]]
    where: str = "true"
    buckets: int = 64

    def __post_init__(self):
        if unknown := {k for k, _ in self.measures.values()} - set(KINDS):
            raise ValueError(f"unknown measures {sorted(unknown)}")

    @property
    def columns(self) -> list[str]:
        return sorted({c for k, c in self.measures.values()})

    def _partial(self, df: DataFrame, sign: int = 1) -> DataFrame:
        """The groups of ``df``: signed counts and sums, and extremes."""
        out = [(F.count("*") * sign).alias("_rows")]
        for c in self.columns:
            v = F.col(f"`{c}`").cast("double")
            out += [(F.count(v) * sign).alias(f"_n_{c}"), (F.coalesce(F.sum(v.cast("decimal(28,6)")), F.lit(0)) * sign).cast("decimal(38,6)").alias(f"_sum_{c}"), F.min(v).alias(f"_min_{c}"), F.max(v).alias(f"_max_{c}")]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        return df.where(self.where).groupBy(*self.keys).agg(*out).withColumn("part", bucket)

    def create(self, df: DataFrame) -> None:
        """Compute the view from all rows."""
        at = max(versions(df.sparkSession, self.root), default=-1) + 1
        state = self._partial(df)
        replace_parts(state, self.root, at, map(str, range(self.buckets)), at - 1)
        drop_unused(df.sparkSession, self.root)

    def refresh(self, added: DataFrame, removed: DataFrame, now: DataFrame) -> None:
        """Bring the view up to date: ``added`` and ``removed`` are the rows that came and went (an update is both), ``now``
        all rows after it, of which only groups that lost an extreme are read."""
        spark = now.sparkSession
        came, went = self._partial(added), self._partial(removed, -1)
        touched = [r["part"] for r in came.select("part").union(went.select("part")).distinct().collect()]  # at most the buckets
        if not touched:
            return
        schema = StructType([f for f in came.schema.fields if f.name != "part"])
        old = read_parts(spark, self.root, schema, touched)
        sums = ["_rows", *[f"_{s}_{c}" for c in self.columns for s in ("n", "sum")]]
        extremes = [f"_{s}_{c}" for c in self.columns for s in ("min", "max")]
        tagged = reduce(DataFrame.unionByName, [df.withColumn("_from", F.lit(n)) for n, df in (("old", old), ("came", came), ("went", went))])
        lost = F.lit(False)
        out = [F.sum(c).cast(old.schema[c].dataType).alias(c) for c in sums]
        for c in extremes:
            pick, at = (F.min, F.least) if c.startswith("_min") else (F.max, F.greatest)
            kept, gone = pick(F.when(F.col("_from") != "went", F.col(c))), pick(F.when(F.col("_from") == "went", F.col(c)))
            out.append(kept.alias(c))
            lost = lost | F.coalesce(gone.eqNullSafe(at(gone, kept)) & gone.isNotNull(), F.lit(False))
        merged = tagged.groupBy(*self.keys, "part").agg(*out, lost.alias("_lost")).where("_rows > 0")
        if any(kind in ("min", "max") for kind, _ in self.measures.values()):
            doubted = merged.where("_lost").select(*self.keys)
            fresh = self._partial(now.join(doubted, self._same(now, doubted), "left_semi"))
            merged = merged.where("not _lost").drop("_lost").unionByName(fresh)
        at = max(versions(spark, self.root)) + 1
        replace_parts(merged.select(*schema.names, "part"), self.root, at, touched, at - 1)
        drop_unused(spark, self.root)

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in self.keys])

    def read(self, spark: SparkSession, like: DataFrame) -> DataFrame:
        """The view (keys and measures); ``like`` has the types of the rows that it is made of."""
        state = read_parts(spark, self.root, StructType([f for f in self._partial(like).schema.fields if f.name != "part"]))
        value = {
            "count": lambda c: F.col(f"_n_{c}"),
            "sum": lambda c: F.col(f"_sum_{c}").cast("double"),
            "avg": lambda c: F.try_divide(F.col(f"_sum_{c}").cast("double"), F.col(f"_n_{c}")),
            "min": lambda c: F.col(f"_min_{c}"),
            "max": lambda c: F.col(f"_max_{c}"),
        }
        return state.select(*self.keys, F.col("_rows").alias("rows"), *[value[kind](c).alias(name) for name, (kind, c) in self.measures.items()])
