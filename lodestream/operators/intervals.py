"""Attendance: pairing of IN and OUT events into worked intervals, and the reports on top of it.

The pairing rule (a first IN opens, further INs are ignored, the next OUT closes, an OUT with nothing open is ignored) is
a window expression: of a sequence without the rows that repeat the kind before them, and without a leading OUT, each IN
pairs with the next row. No state machine and no Python are needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions.dates import clock, hours_between, is_late, second_of_day

FULL_DAY_HOURS = 8.0


def segments(events: DataFrame, keys: Sequence[str], time_col: str, kind_col: str, tie_col: str | None = None) -> DataFrame:
    """Rows (keys, start, end) of opened intervals; end is null where nothing closed it. Other kinds are ignored."""
    order = W.partitionBy(*keys).orderBy(time_col, *([tie_col] if tie_col else []), kind_col)
    known = events.where(F.col(kind_col).isin("IN", "OUT") & F.col(time_col).isNotNull())
    changed = known.withColumn("_before", F.lag(kind_col).over(order)).where(F.coalesce(F.col("_before") != F.col(kind_col), F.col(kind_col) == "IN"))
    paired = changed.withColumn("_next", F.lead(time_col).over(order))
    return paired.where(F.col(kind_col) == "IN").select(*keys, F.col(time_col).alias("start"), F.col("_next").alias("end"))


def paired_hours(events: DataFrame, keys: Sequence[str], time_col: str, kind_col: str, tie_col: str | None = None, now: Column | None = None, open_cap_hours: float = 0.0) -> DataFrame:
    """Hours by key: each segment is rounded to 2 decimals before they are added up; an open end counts up to the cap."""
    hours = hours_between(F.col("start"), F.col("end"))
    spans = segments(events, keys, time_col, kind_col, tie_col).withColumn("hours", hours)
    is_open = F.col("end").isNull()
    since = F.max(F.when(is_open, F.col("start")))
    credited = F.lit(0.0)
    if now is not None and open_cap_hours > 0:
        credited = F.coalesce(F.max(F.when(is_open, F.least(hours_between(F.col("start"), now), F.lit(open_cap_hours)))), F.lit(0.0))
    paired = spans.groupBy(*keys).agg(
        F.round(F.coalesce(F.sum("hours"), F.lit(0.0)) + credited, 2).alias("paired_hours"),
        F.count("end").alias("paired_segments"),
        F.max(is_open).alias("open_shift"),
        since.alias("open_since"),
    )
    punches = events.groupBy(*keys).agg(
        F.count_if(F.col(kind_col) == "IN").alias("punches_in"),
        F.count_if(F.col(kind_col) == "OUT").alias("punches_out"),
        F.min(F.when(F.col(kind_col) == "IN", F.col(time_col))).alias("first_in"),
        F.max(F.when(F.col(kind_col) == "OUT", F.col(time_col))).alias("last_out"),
    )
    zero = {"paired_hours": 0.0, "paired_segments": 0, "open_shift": False}
    return punches.join(paired, list(keys), "left").withColumns({k: F.coalesce(k, F.lit(v)) for k, v in zero.items()})


def daily_summary(events: DataFrame, person_col: str, time_col: str, kind_col: str, tie_col: str | None = None) -> DataFrame:
    """One row for each person and day: paired and elapsed hours, punches, and the flags late and full day."""
    dated = events.withColumn("date", F.to_date(time_col))
    days = paired_hours(dated, [person_col, "date"], time_col, kind_col, tie_col)
    return days.withColumns({
        "elapsed_hours": F.coalesce(hours_between(F.col("first_in"), F.col("last_out")), F.lit(0.0)),
        "is_late": is_late(F.col("first_in")),
        "is_full_day": F.col("paired_hours") >= FULL_DAY_HOURS,
    })


def touched_days(events: DataFrame, batch: DataFrame, person_col: str, time_col: str) -> DataFrame:
    """All events of the (person, day) pairs that a batch touches: what an incremental recompute must read."""
    day = F.to_date(time_col).alias("_day")
    keys = batch.select(person_col, day).distinct()
    return events.withColumn("_day", F.to_date(time_col)).join(keys, [person_col, "_day"], "left_semi").drop("_day")


def monthly_report(days: DataFrame, person_col: str) -> DataFrame:
    """Days nested by person and month, with totals, late days and mean hours of days with any."""
    detail = F.array_sort(F.collect_list(F.struct("date", "paired_hours", "is_late", "is_full_day")))
    return days.groupBy(person_col, F.trunc("date", "month").alias("month")).agg(
        F.count("*").alias("days"),
        F.round(F.sum("paired_hours"), 2).alias("total_hours"),
        # As decimals the mean is exact, so it rounds alike whatever the order of the rows.
        F.round(F.avg(F.when(F.col("paired_hours") > 0, F.col("paired_hours").cast("decimal(12,2)"))), 2).cast("double").alias("mean_hours"),
        F.count_if("is_late").alias("late_days"),
        F.count_if("is_full_day").alias("full_days"),
        clock(F.avg(second_of_day(F.col("first_in")))).alias("mean_first_in"),
        detail.alias("detail"),
    )


def live_status(events: DataFrame, person_col: str, time_col: str, kind_col: str, tie_col: str, now: Column, window_hours: int = 20) -> DataFrame:
    """The latest event of each person in the last hours: IN means present."""
    recent = events.where(F.col(kind_col).isin("IN", "OUT") & (F.col(time_col) > now - F.make_dt_interval(F.lit(0), F.lit(window_hours))) & (F.col(time_col) <= now))
    last = F.max_by(F.struct(F.col(kind_col).alias("kind"), F.col(time_col).alias("at")), F.struct(time_col, tie_col))
    return recent.groupBy(person_col).agg(last.alias("_last"), F.min(F.when(F.col(kind_col) == "IN", F.col(time_col))).alias("first_in")).select(
        person_col, F.when(F.col("_last.kind") == "IN", "present").otherwise("left").alias("status"), F.col("_last.at").alias("since"), is_late(F.col("first_in")).alias("is_late")
    )


def day_pivot(days: DataFrame, person_col: str, month_start: Column, value_col: str = "paired_hours") -> DataFrame:
    """Person by day of the month, 1 to 31, and the total; days without a row are null."""
    month = days.where(F.trunc("date", "month") == month_start).withColumn("_day", F.dayofmonth("date"))
    cells = month.groupBy(person_col).pivot("_day", list(range(1, 32))).agg(F.round(F.sum(value_col), 2))
    named = cells.select(person_col, *[F.col(f"`{d}`").alias(f"d{d:02d}") for d in range(1, 32)])
    total = F.lit(0.0)
    for d in range(1, 32):
        total = total + F.coalesce(f"d{d:02d}", F.lit(0.0))
    return named.withColumn("total", F.round(total, 2))


def month_pivot(days: DataFrame, person_col: str, year: int, value_col: str = "paired_hours") -> DataFrame:
    """Person by month, 1 to 12."""
    cells = days.where(F.year("date") == year).withColumn("_month", F.month("date")).groupBy(person_col).pivot("_month", list(range(1, 13))).agg(F.round(F.sum(value_col), 2))
    return cells.select(person_col, *[F.col(f"`{m}`").alias(f"m{m:02d}") for m in range(1, 13)])


def merged_codes(days: DataFrame, code: Column, date_col: str = "date", hours_col: str = "paired_hours") -> DataFrame:
    """Rows of codes that are equal once normalised, merged: one day each with the highest hours, totals recomputed."""
    keyed = days.withColumn("code", code)
    one = keyed.groupBy("code", date_col).agg(F.max(hours_col).alias("hours"))
    return one.groupBy("code").agg(
        F.count("*").alias("days"), F.round(F.sum("hours"), 2).alias("total_hours"), F.round(F.avg("hours"), 2).alias("mean_hours"), F.array_sort(F.collect_list(F.struct(F.col(date_col).alias("date"), "hours"))).alias("detail")
    )


def leave_calendar(requests: DataFrame, person_col: str, start_col: str, end_col: str, month_start: Column, order_col: str) -> DataFrame:
    """Weekdays of approved leave within a month; of overlapping requests the last in order counts."""
    last = F.last_day(month_start)
    met = requests.where((F.col(start_col) <= last) & (F.col(end_col) >= month_start))
    days = met.withColumn("date", F.explode(F.sequence(F.greatest(F.col(start_col), month_start), F.least(F.col(end_col), last)))).where(F.weekday("date") < 5)
    newest = F.row_number().over(W.partitionBy(person_col, "date").orderBy(F.desc(order_col)))
    return days.withColumn("_n", newest).where("_n = 1").drop("_n")
