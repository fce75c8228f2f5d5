"""Anomaly detection over series held as rows (key, order, value), and its scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.quantiles import exact_quantiles, joined_by

# The templates of known patterns, and the weights of the methods in the risk score.
PATTERNS: dict[str, list[int]] = {
    "spike": [0, 0, 0, 10, 0, 0, 0, 0, 0, 0],
    "drop": [10, 10, 10, 0, 10, 10, 10, 10, 10, 10],
    "increasing": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
}
RISK_WEIGHTS = {"isolation_forest": 0.3, "statistical": 0.3, "pattern": 0.2, "prediction": 0.2}


def statistics(df: DataFrame, keys: Sequence[str], value_col: str) -> DataFrame:
    """Count, mean, deviations (population and sample) and exact quartiles of each series."""
    v, quartiles = F.col(value_col).cast("double"), ["q25", "median", "q75"]
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.stddev_samp(v).alias("std"))
    found = exact_quantiles(df, keys, v, [0.25, 0.5, 0.75], quartiles)
    return joined_by(out, found, keys).select(*[f"`{k}`" for k in keys], "n", "mean", "std_pop", "std", *quartiles)


def statistical(df: DataFrame, keys: Sequence[str], value_col: str, sigmas: float = 3.0, iqr_factor: float = 1.5, least: int = 10) -> DataFrame:
    """Rows with z-score, whether they are beyond ``sigmas`` or outside the quartile fences, and a confidence of 0 to 1.

    Series shorter than ``least`` have no anomalies. The statistics are aggregated by key and joined back, so a series is
    never gathered in one task.
    """
    stats = statistics(df, keys, value_col).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "mean", "std_pop", "q25", "q75")])
    v = F.col(value_col).cast("double")
    joined = df.join(stats, list(keys), "left") if keys else df.crossJoin(F.broadcast(stats))
    z = F.coalesce(F.try_divide(F.abs(v - F.col("_mean")), F.col("_std_pop")), F.lit(0.0))
    spread = (F.col("_q75") - F.col("_q25")) * iqr_factor
    outside = (v < F.col("_q25") - spread) | (v > F.col("_q75") + spread)
    enough = F.col("_n") >= least
    return joined.withColumns({
        "z_score": F.when(enough, z).otherwise(0.0),
        "is_anomaly": F.coalesce(enough & ((z > sigmas) | outside), F.lit(False)),
        "confidence": F.when(enough, F.least(z / 5, F.lit(1.0))).otherwise(0.0),
    }).drop(*[f"_{c}" for c in ("n", "mean", "std_pop", "q25", "q75")])


def last_values(df: DataFrame, keys: Sequence[str], order_col: str, value_col: str, n: int) -> DataFrame:
    """The last n values of each series as an array, oldest first."""
    newest = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(order_col))
    kept = df.withColumn("_p", F.row_number().over(newest)).where(F.col("_p") <= n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_p")).alias("p"), F.col(value_col).cast("double").alias("v"))))
    return kept.groupBy(*keys).agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def _correlation(a: Column, template: Sequence[float]) -> Column:
    """Pearson correlation of an array column with a constant series of the same length."""
    n = len(template)
    mean_t = sum(template) / n
    dev_t = [x - mean_t for x in template]
    norm_t = sum(x * x for x in dev_t) ** 0.5
    mean = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / n
    cross = F.lit(0.0)
    square = F.lit(0.0)
    for i, t in enumerate(dev_t):
        d = F.get(a, F.lit(i)) - mean
        cross, square = cross + d * t, square + d * d
    return F.try_divide(cross, F.sqrt(square) * norm_t)


def patterns(df: DataFrame, keys: Sequence[str], order_col: str, value_col: str, known: Mapping[str, Sequence[float]] = PATTERNS, least: float = 0.85) -> DataFrame:
    """The pattern that the last values of each series follow best, its correlation, and whether that is enough."""
    length = len(next(iter(known.values())))
    series = last_values(df, keys, order_col, value_col, length).where(F.size("values") == length)
    scores = F.array(*[F.struct(F.coalesce(_correlation(F.col("values"), t), F.lit(0.0)).alias("similarity"), F.lit(name).alias("name")) for name, t in known.items()])
    best = F.array_max(scores)
    return series.select(*keys, F.when(best["similarity"] > 0, best["name"]).alias("pattern"), F.round(F.greatest(best["similarity"], F.lit(0.0)), 6).alias("similarity"), (best["similarity"] >= least).alias("detected"))


def forecast(df: DataFrame, keys: Sequence[str], order_col: str, value_col: str, steps: int = 30) -> DataFrame:
    """Straight line from the last value along (mean of the last 7 - mean of the last 30), with an alarm if that trend is
    more than twice the deviation of the last 30."""
    last = last_values(df, keys, order_col, value_col, 30).where(F.size("values") >= 7)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
    short, long = mean(F.slice("values", -7, 7)), mean(F.col("values"))
    line = last.withColumns({"_long": long, "trend": short - long}).withColumn("volatility", F.sqrt(mean(F.transform("values", lambda x: (x - F.col("_long")) * (x - F.col("_long"))))))
    line = line.withColumns({"last": F.element_at("values", -1), "will_anomaly": F.abs("trend") > F.col("volatility") * 2})
    ahead = line.select(*keys, "last", "trend", "volatility", "will_anomaly", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return ahead.select(*keys, "step", F.round(F.col("last") + F.col("trend") * F.col("step"), 6).alias("predicted"), F.round("trend", 6).alias("trend"), F.round("volatility", 6).alias("volatility"), "will_anomaly")


def risk_score(confidences: Mapping[str, Column], default: float = 0.1) -> Column:
    """Sum of the methods' confidences by weight."""
    total = F.lit(0.0)
    for method, c in confidences.items():
        total = total + F.coalesce(c, F.lit(0.0)) * RISK_WEIGHTS.get(method, default)
    return total


def severity(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def cohort_outliers(df: DataFrame, id_col: str, limits: Mapping[str, float]) -> DataFrame:
    """Rows that exceed a factor of the mean of all, one row for each column; the means are one row, broadcast."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in limits])
    over = F.array_compact(F.array(*[F.when(F.col(c) > F.col(f"_{c}") * f, F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.col(f"_{c}").alias("mean"))) for c, f in limits.items()]))
    return df.crossJoin(F.broadcast(means)).select(id_col, F.explode(over).alias("o")).select(id_col, "o.metric", F.round("o.value", 4).alias("value"), F.round("o.mean", 4).alias("mean"))
