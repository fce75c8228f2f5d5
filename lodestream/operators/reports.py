"""Reports by named metrics, visibility rules, period runs, project risk and schedule rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions.numbers import ratio

#: Metric name -> expression over actions (feature, module, success, duration_ms, ai, cost); the extension point of reports.
METRICS: dict[str, Column | None] = {}


def metrics() -> dict[str, Column]:
    """The registry, filled when a session is there."""
    if not METRICS:
        good = F.count_if(F.col("success"))
        METRICS.update(
            {
                "total_actions": F.count("*"),
                "total_ai_requests": F.count_if(F.col("ai")),
                "total_ai_cost_usd": F.coalesce(F.sum(F.when(F.col("ai"), F.col("cost"))), F.lit(0.0)),
                "distinct_features": F.count_distinct("feature"),
                "distinct_modules": F.count_distinct("module"),
                "success_rate_pct": ratio(good, F.count("*"), 100.0, 100.0),
                "session_minutes": F.floor(F.coalesce(F.sum("duration_ms"), F.lit(0)) / 60_000),
            }
        )
    return METRICS


def report(actions: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row of the named metrics for each group; without groups one row for all. Unknown names are errors."""
    known = metrics()
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(known)}")
    return actions.groupBy(*by).agg(*[known[n].alias(n) for n in names])


# --- rows that a user sees --------------------------------------------------------------------------------------------


def not_deleted(df: DataFrame, deleted: Column) -> DataFrame:
    """The default filter of soft deletion; a null mark is not deleted."""
    return df.where(~F.coalesce(deleted, F.lit(False)))


def owned_or_joined(projects: DataFrame, members: DataFrame, key: str, member_key: str, owner: Column, member: Column) -> DataFrame:
    """Projects that a user owns or is a member of, each once however often the user is listed."""
    mine = members.where(member).select(F.col(member_key).alias("_key")).distinct().withColumn("_in", F.lit(True))
    return projects.join(mine, F.col(key) == F.col("_key"), "left").where(F.coalesce(owner, F.lit(False)) | F.coalesce("_in", F.lit(False))).drop("_key", "_in")


def values_of(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of one column, nulls left out."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as a sorted array of structs; without any, an empty array."""
    kept = children.groupBy(F.col(child_key).alias("_key")).agg(F.sort_array(F.collect_set(F.struct(*fields))).alias("_many"))
    empty = F.array().cast(kept.schema["_many"].dataType)
    return parents.join(kept, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_many", empty)).drop("_key", "_many")


def backfilled(df: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """Nulls of ``column`` filled from ``known`` (key, column), one value a key: the smallest."""
    one = known.where(F.col(column).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(column).alias("_value"))
    return df.join(one, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce(column, "_value")).drop("_key", "_value")


# --- periods ----------------------------------------------------------------------------------------------------------


def with_previous(df: DataFrame, keys: Sequence[str], month: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the values of the same key in the month before (``previous_...``); 0 where there is none."""
    back = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.add_months(month, 1).alias("_month"), *[F.col(c).alias(f"previous_{c}") for c in columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(month) == F.col("_month")]
    return df.join(back, reduce(lambda a, b: a & b, on), "left").drop("_month", *[f"_{k}" for k in keys]).fillna(0, [f"previous_{c}" for c in columns])


def month_run(earnings: DataFrame, adjustments: DataFrame, carried: DataFrame, employee: str, deduction_percent: float = 10.0) -> DataFrame:
    """Payslips of a month: earnings, adjustments and what the month before left over, less a percentage of the gross.

    ``earnings`` (employee, hours, earned), ``adjustments`` (employee, amount), ``carried`` (employee, amount); whoever has
    any of them gets a slip. Amounts are rounded half up to cents.
    """
    cents = lambda c: F.round(F.coalesce(c, F.lit(0)).cast("decimal(20,6)"), 2)
    many = lambda df, name: df.groupBy(employee).agg(F.sum("amount").alias(name))
    base = earnings.groupBy(employee).agg(F.sum("hours").alias("hours"), F.sum("earned").alias("earned"))
    slips = base.join(many(adjustments, "adjusted"), employee, "full").join(many(carried, "carried"), employee, "full")
    gross = cents(F.col("earned")) + cents(F.col("adjusted")) + cents(F.col("carried"))
    out = slips.select(employee, cents(F.col("hours")).alias("hours"), cents(F.col("earned")).alias("earned"), cents(F.col("adjusted")).alias("adjusted"), cents(F.col("carried")).alias("carried"), gross.alias("gross"))
    deducted = F.round(F.col("gross") * F.lit(deduction_percent).cast("decimal(6,2)") / 100, 2)
    return out.withColumn("deductions", deducted).withColumn("net", F.col("gross") - F.col("deductions"))


def run_totals(slips: DataFrame) -> DataFrame:
    """One row: sums over all payslips, and how many there are."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("gross", "deductions", "net", "hours")]
    return slips.agg(*sums, F.count("*").alias("employees"))


def trailing_days(df: DataFrame, day: Column, today: Column, days_back: int, include_today: bool = False) -> DataFrame:
    """(day, n) for ``days_back`` days before ``today``, gaps as 0; today itself only if asked for."""
    first = F.date_sub(today, days_back)
    last = today if include_today else F.date_sub(today, 1)
    series = df.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    counted = df.where(day.between(first, last)).groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return series.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


# --- scores and rules -------------------------------------------------------------------------------------------------

# Weights of the risk score.
RISK_WEIGHTS = {"audit_delay_days": 0.15, "cars_open_ratio": 0.20, "obs_open_ratio": 0.10, "manhour_utilization": 0.15, "quality_cost": 0.15, "kpi_achievement": 0.10, "completion": 0.05, "quality_plan": 0.05, "cars_delayed_days": 0.03, "obs_delayed_days": 0.02}


def open_share(open_: Column, closed: Column) -> Column:
    """Open ones among all and one more; 0 without any."""
    return F.coalesce(open_, F.lit(0)) / (F.coalesce(open_, F.lit(0)) + F.coalesce(closed, F.lit(0)) + 1)


def project_risk(f: Mapping[str, Column]) -> Column:
    """Risk of a project from ten features, 0 to 100; days count up to 30, only use above what was allotted counts."""
    w, zero = RISK_WEIGHTS, F.lit(0.0)
    month = lambda c: F.least(c / 30, F.lit(1.0))
    parts = [
        month(f["audit_delay_days"]) * w["audit_delay_days"] * 100,
        f["cars_open_ratio"] * w["cars_open_ratio"] * 100,
        f["obs_open_ratio"] * w["obs_open_ratio"] * 100,
        F.greatest(f["manhour_utilization"] - 1, zero) * w["manhour_utilization"] * 100,
        F.least(f["quality_cost"] / 100_000, F.lit(1.0)) * w["quality_cost"] * 100,
        F.greatest(100 - f["kpi_achievement"], zero) * w["kpi_achievement"],
        F.when(f["completion"] < 90, (1 - f["completion"] / 100) * w["completion"] * 50).otherwise(zero),
        (1 - f["quality_plan"] / 100) * w["quality_plan"] * 100,
        month(f["cars_delayed_days"]) * w["cars_delayed_days"] * 100,
        month(f["obs_delayed_days"]) * w["obs_delayed_days"] * 100,
    ]
    return F.least(reduce(lambda a, b: a + b, parts), F.lit(100.0))


def plan_score(status: Column) -> Column:
    """0 without a quality plan, 30 while it is pending, else 100."""
    return F.when(F.coalesce(F.trim(status), F.lit("")) == "", 0).when(F.lower(status) == "pending", 30).otherwise(100)


def schedule_rules(activities: DataFrame, most_float: int = 21, most_days: int = 15) -> DataFrame:
    """(rule, severity, n) of a schedule (id, float_days, duration_days, is_milestone, links array of types), in one pass.

    A rule without offenders has severity ``pass``. Every activity but the first by id needs a link before it.
    """
    first = F.min("id")
    none = F.count_if(F.size("links") == 0)
    counted = activities.agg(
        F.count_if(F.col("float_days") < 0).alias("negative_float"),
        F.count_if(F.col("float_days") > most_float).alias("max_total_float"),
        F.count_if(~F.col("is_milestone") & (F.col("duration_days") > most_days)).alias("level4_duration"),
        F.coalesce(F.sum(F.size(F.filter("links", lambda x: x == "SF"))), F.lit(0)).alias("start_to_finish_links"),
        (none - F.coalesce(F.max_by((F.size("links") == 0).cast("int"), -F.col("id")), F.lit(0))).alias("missing_predecessors"),
        F.count_if(F.col("is_milestone")).alias("milestones"),
        first.alias("first"),
    )
    severity = {"negative_float": "critical", "max_total_float": "warning", "level4_duration": "warning", "start_to_finish_links": "critical", "missing_predecessors": "warning"}
    rules = [F.struct(F.lit(k).alias("rule"), F.when(F.col(k) > 0, v).otherwise("pass").alias("severity"), F.col(k).cast("long").alias("n")) for k, v in severity.items()]
    rules.append(F.struct(F.lit("milestones_present").alias("rule"), F.when(F.col("milestones") == 0, "critical").otherwise("pass").alias("severity"), F.col("milestones").cast("long").alias("n")))
    return counted.select(F.inline(F.array(*rules)))


# --- names, sizes, agents ---------------------------------------------------------------------------------------------

# Catalogue names whose sheet is named otherwise.
SHEETS = {"90 Degree Direction Change": "90DegLRElbow", "45 Degree Direction Change": "45DegElbow"}


def sheet_name(name: Column) -> Column:
    """A catalogue name as the name of its sheet: fixed replacements, else without spaces, ``°`` as Deg."""
    plain = F.replace(F.replace(name, F.lit(" "), F.lit("")), F.lit("°"), F.lit("Deg"))
    return reduce(lambda found, kv: F.when(name == kv[0], kv[1]).otherwise(found), SHEETS.items(), plain)


def plain_size(size: Column, digits: int = 3) -> Column:
    """A size without units: ``2"`` and ``DN2`` are 2; numbers lose trailing zeros, other text is trimmed; null is empty."""
    bare = F.trim(F.regexp_replace(F.coalesce(size, F.lit("")), 'DN|NPS|"', ""))
    number = bare.try_cast("double")
    shown = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", number), "0+$", ""), r"\.$", "")
    return F.when(number.isNull(), bare).otherwise(shown)


def plain_pressure(pressure: Column) -> Column:
    """The first number of a rating (``150#``, ``300 lbs``, ``PN16``); without one the text, trimmed; null is empty."""
    bare = F.trim(F.regexp_replace(F.coalesce(pressure, F.lit("")), "#|lbs|PN", ""))
    found = F.regexp_extract(bare, r"\d+", 0)
    return F.when(found == "", bare).otherwise(found)


def agent_parts(agent: Column) -> dict[str, Column]:
    """Browser, system and device of a user agent, by the first pattern that fits."""

    def first(rules: Sequence[tuple[str, str]], other: str) -> Column:
        return reduce(lambda found, rule: F.when(agent.rlike(rule[0]), rule[1]).otherwise(found), reversed(rules), F.lit(other))

    return {
        "browser": first([("(?i)edg", "Edge"), ("(?i)opr|opera", "Opera"), ("(?i)chrome", "Chrome"), ("(?i)firefox", "Firefox"), ("(?i)safari", "Safari")], "Other"),
        "system": first([("(?i)windows", "Windows"), ("(?i)android", "Android"), ("(?i)iphone|ipad", "iOS"), ("(?i)mac os", "macOS"), ("(?i)linux", "Linux")], "Other"),
        "device": first([("(?i)ipad|tablet", "tablet"), ("(?i)mobile|iphone|android", "mobile")], "desktop"),
    }


def session_states(events: DataFrame, user: str, time: str, now: Column, hours: int = 24) -> DataFrame:
    """One session a user: begun, last seen, activities, and whether it is still open ``hours`` after it was last seen.

    An event more than ``hours`` after the one before begins a new session, which takes the place of the old one.
    """
    span = F.make_dt_interval(F.lit(0), F.lit(hours))
    before = F.lag(time).over(W.partitionBy(user).orderBy(time))
    begins = F.when(before.isNull() | (F.col(time) > before + span), F.col(time))
    last = events.withColumn("_begins", begins).groupBy(user).agg(F.max("_begins").alias("begun"))
    mine = events.join(last, user).where(F.col(time) >= F.col("begun"))
    return mine.groupBy(user, "begun").agg(F.max(time).alias("last_seen"), F.count("*").alias("activities")).withColumn("open", F.col("last_seen") + span >= now)
