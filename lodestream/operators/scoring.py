"""Business scores as column expressions. Bands and weights are fixed values of the scoring rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions.numbers import ladder, ratio
from lodestream.functions.text import stable_unit
from lodestream.operators.analytics import min_max, placed

LEAD_WEIGHTS = {"company_size": 0.25, "industry_fit": 0.20, "budget_match": 0.25, "urgency": 0.15, "decision_authority": 0.15}
LEAD_GRADES = [(80, "A"), (60, "B"), (40, "C")]
SIZE_BANDS = [(1000, 100), (500, 80), (100, 60)]
BUDGET_BANDS = [(1_000_000, 100), (500_000, 80), (100_000, 60)]
CHAMPION_WEIGHTS = {"usage_frequency": 0.20, "feature_diversity": 0.15, "time_spent": 0.10, "ai_utilization": 0.25, "cost_efficiency": 0.15, "success_rate": 0.15}
CHAMPION_TIERS = [(90, "diamond"), (75, "platinum"), (60, "gold"), (40, "silver"), (20, "bronze")]
STAGE_PROBABILITY = {"lead": 10, "qualified": 25, "proposal": 50, "negotiation": 75, "closed_won": 100, "closed_lost": 0}
CHURN = {"contact": (90, 0.30), "health": (40, 0.25), "deals": 0.20}


def lead_score(size: Column, target_industry: Column, value: Column, days_to_close: Column, role: Column) -> tuple[Column, Column]:
    """Score of 0 to 100 and grade of a lead."""
    parts = {
        "company_size": ladder(size, SIZE_BANDS, 40, strict=True),
        "industry_fit": F.when(target_industry, 100).otherwise(60),
        "budget_match": ladder(value, BUDGET_BANDS, 40, strict=True),
        "urgency": F.when(days_to_close.isNull(), 30).when(days_to_close < 30, 100).when(days_to_close < 90, 75).otherwise(50),
        "decision_authority": F.when(role == "decision_maker", 100).when(role == "influencer", 75).otherwise(50),
    }
    total = F.lit(0.0)
    for k, w in LEAD_WEIGHTS.items():
        total = total + parts[k] * w
    return F.round(total, 1), ladder(F.round(total, 6), LEAD_GRADES, "D")


def churn_risk(days_since_contact: Column, health: Column, active_deals: Column) -> tuple[Column, Column]:
    """Risk of 0 to 100 and its level."""
    after, w_contact = CHURN["contact"]
    below, w_health = CHURN["health"]
    contact = F.when(days_since_contact > after, F.least(days_since_contact / 180, F.lit(1.0)) * w_contact).otherwise(0.0)
    weak = F.when(health < below, (1 - health / 100) * w_health).otherwise(0.0)
    idle = F.when(active_deals == 0, CHURN["deals"]).otherwise(0.0)
    score = F.least((contact + weak + idle) * 100, F.lit(100.0))
    return F.round(score, 1), F.when(score > 70, "high").when(score > 40, "medium").otherwise("low")


def win_probability(stage: Column, age_days: Column, health: Column, recent_activities: Column, days_since_quote: Column) -> Column:
    """Stage probability with adjustments for age, health, activity in 14 days and a fresh quote, within 0 to 100."""
    base = F.coalesce(F.element_at(F.create_map(*[x for k, v in STAGE_PROBABILITY.items() for x in (F.lit(k), F.lit(v))]), stage), F.lit(50))
    age = F.when(age_days > 180, -20).when(age_days > 90, -10).otherwise(0)
    fit = F.when(health > 70, 10).when(health < 40, -15).otherwise(0)
    active = F.when(recent_activities > 3, 15).when(recent_activities == 0, -20).otherwise(0)
    quote = F.when(days_since_quote < 7, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + age + fit + active + quote))


def champion_scores(stats: DataFrame, user_col: str) -> DataFrame:
    """Cohort-relative score: each part min-max scaled and rounded, then weighted; tiers, and places with two tie-breaks.

    ``stats`` has actions, features, minutes, ai_requests, ai_cost, success_rate for each user.
    """
    raw = stats.withColumn("_eff", F.when(F.col("ai_cost") > 0, F.col("actions") / F.col("ai_cost")).otherwise(F.col("actions").cast("double")))
    parts: Mapping[str, Column] = {
        "usage_frequency": F.col("actions"), "feature_diversity": F.col("features"), "time_spent": F.col("minutes"),
        "ai_utilization": F.col("ai_requests"), "cost_efficiency": F.col("_eff"),
    }
    # Parts are rounded as the nearest whole number of hundredths.
    scaled = min_max(raw, parts).withColumns({k: F.round(F.col(k) * 100) / 100 for k in [*parts, "success_rate"]})
    total = F.lit(0.0)
    for k, w in CHAMPION_WEIGHTS.items():
        total = total + F.col(k) * w
    # As a sum of binary fractions a half of a hundredth can lie just below itself; ten decimals hold it exactly.
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)).cast("decimal(30,10)"), 2).cast("double")
    out = scaled.withColumn("score", score).withColumn("tier", ladder(F.col("score"), CHAMPION_TIERS, "rookie"))
    return placed(out, [F.desc("score"), F.desc("ai_requests"), F.desc("features"), F.col(user_col)], "place").drop("_eff")


def user_status(last_seen: Column, now: Column) -> Column:
    """inactive / active within 7 days / recent within 30 / dormant."""
    days = F.datediff(now, last_seen)
    return F.when(last_seen.isNull(), "inactive").when(days <= 7, "active").when(days <= 30, "recent").otherwise("dormant")


def engagement(events: Column, failed: Column) -> tuple[Column, Column]:
    """Engagement of 0 to 100 and the share of failures."""
    return F.least(F.lit(100), events * 2), F.round(ratio(failed, events), 4)


def revision_risk(revision: Column, allowed: Column, unresolved_ratio: Column, idle_days: Column, carry_ratio: Column) -> Column:
    """0 to 100: nearness to the limit, unresolved comments, stagnation beyond 30 days, comments carried over."""
    near = F.coalesce(F.try_divide(revision, allowed) * 40, F.lit(0.0))
    idle = F.when(idle_days > 30, F.least(idle_days / 30 * 15, F.lit(20.0))).otherwise(0.0)
    return F.round(F.least(near + F.coalesce(unresolved_ratio, F.lit(0.0)) * 30 + idle + F.coalesce(carry_ratio, F.lit(0.0)) * 10, F.lit(100.0)), 2)


def stable_value(key: Column, low: float, high: float, step: float) -> Column:
    """A value of [low, high] that depends on the key alone, rounded to ``step``."""
    return F.round((stable_unit(key) * (high - low) + low) / step) * step


def recommendation_score(same_project: Column, name_similarity: Column, same_status: Column, age_days: Column) -> Column:
    """Project 0.45, name 0.35 or 0.2 by likeness, status 0.1, recency 0.1 or 0.05; at most 0.99."""
    name = F.when(name_similarity >= 0.8, 0.35).when(name_similarity >= 0.5, 0.2).otherwise(0.0)
    fresh = F.when(age_days <= 7, 0.10).when(age_days <= 30, 0.05).otherwise(0.0)
    return F.least(F.when(same_project, 0.45).otherwise(0.0) + name + F.when(same_status, 0.10).otherwise(0.0) + fresh, F.lit(0.99))


def complexity(comments: Column, carried: Column, urgent: Column, mean_length: Column) -> Column:
    """0 to 100 from a revision's number of comments, the shares carried over and urgent, and the comments' mean length."""
    share = lambda part: F.coalesce(F.try_divide(part, comments), F.lit(0.0)) * 25
    many = F.when(comments > 50, 30).when(comments > 20, 20).when(comments > 10, 10).otherwise(0)
    long = F.when(mean_length > 200, 20).when(mean_length > 100, 10).otherwise(0)
    return F.round(F.least(F.lit(100.0), many + share(carried) + share(urgent) + long), 2)
