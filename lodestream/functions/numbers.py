"""Numeric expressions: safe ratios, payroll and leave, engineering formulas, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, scale: float = 1.0, empty: float = 0.0) -> Column:
    """a / b times ``scale``; ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a * F.lit(scale), b), F.lit(empty))


def tolerant_decimal(c: Column, precision: int = 18, scale: int = 2) -> Column:
    return F.coalesce(c.cast("string").try_cast(f"decimal({precision},{scale})"), F.lit(0).cast(f"decimal({precision},{scale})"))


def ladder(value: Column, steps: list[tuple[float, object]], otherwise: object, strict: bool = False) -> Column:
    """The result of the first step whose bound the value reaches (or passes, if ``strict``); steps from high to low."""
    out = F.lit(otherwise)
    for bound, result in reversed(steps):
        out = F.when(value > bound if strict else value >= bound, F.lit(result)).otherwise(out)
    return out


# --- payroll and leave ------------------------------------------------------------------------------------------------


def gross_pay(*earnings: Column) -> Column:
    total = F.lit(0).cast("decimal(18,2)")
    for e in earnings:
        total = total + tolerant_decimal(e)
    return total.cast("decimal(18,2)")


def unpaid_leave(gross: Column, days: Column, days_in_month: int = 26) -> Column:
    return F.round(gross / days_in_month * days, 2).cast("decimal(18,2)")


def worked_days(hours: Column, hours_a_day: Column, holidays: Column, leave: Column) -> Column:
    return F.round(ratio(hours, hours_a_day) + holidays + leave, 2)


def leave_accrual(joined: Column, month_start: Column, entitlement: float, year_days: int, today: Column) -> Column:
    """Days of leave earned in a month: a twelfth, prorated by day in the month of joining, nothing before or ahead."""
    last = F.last_day(month_start)
    prorated = F.lit(entitlement) / year_days * (F.datediff(last, joined) + 1)
    return F.when((month_start > today) | (last < joined), 0.0).when(joined.isNotNull() & (joined >= month_start), F.round(prorated, 2)).otherwise(F.round(F.lit(entitlement / 12), 2))


def encashment(earned: Column, taken: Column, salary: Column, working_days: int) -> Column:
    return F.round(F.greatest(F.lit(0.0), earned - taken) * salary / working_days, 2)


# --- engineering (unit factors are fixed values) ----------------------------------------------------------------------

GPM_PER_M3H, PSI_PER_BAR, ATMOSPHERE_BAR, WATER_VAPOUR_BAR = 4.403, 14.504, 1.013, 0.023
GRAVITY, METRES_PER_BAR = 9.81, 10.2


def valve_cv(flow: Column, density: Column, drop: Column) -> Column:
    gravity = F.coalesce(F.nullif(density, F.lit(0.0)) / 1000, F.lit(1.0))
    return F.round(flow * GPM_PER_M3H * F.sqrt(F.try_divide(gravity, drop * PSI_PER_BAR)), 2)


def cavitation_index(pressure: Column, drop: Column, vapour: Column) -> Column:
    return F.when(drop > 0, F.round(F.try_divide(pressure + ATMOSPHERE_BAR - F.coalesce(vapour, F.lit(WATER_VAPOUR_BAR)), drop), 3))


def valve_noise(cv: Column, drop: Column, flow: Column, characteristic: Column) -> Column:
    power = cv * drop * flow / 100
    extra = F.when(characteristic == "equal_percentage", 2).when(characteristic == "quick_opening", 5).otherwise(0)
    return F.when(power <= 0, 0.0).otherwise(F.round(F.least(10 * F.log10(power) + 50 + extra, F.lit(120.0)), 1))


def pump_power(flow: Column, head: Column, efficiency: Column, density: Column) -> Column:
    return F.round(F.try_divide(density * GRAVITY * flow * head, efficiency * 3600), 2)


def npsh_available(suction: Column, vapour: Column, head: Column, velocity: Column) -> Column:
    return F.round((suction - vapour) * METRES_PER_BAR + head - velocity, 2)


def log_mean_difference(hot_in: Column, hot_out: Column, cold_in: Column, cold_out: Column) -> Column:
    a, b = hot_in - cold_out, hot_out - cold_in
    return F.when((a > 0) & (b > 0), F.when(F.abs(a - b) < 0.1, (a + b) / 2).otherwise(F.round(F.try_divide(a - b, F.log(F.try_divide(a, b))), 2)))


def heat_duty(flow: Column, heat: Column, t_in: Column, t_out: Column) -> Column:
    return F.round(flow * heat * F.abs(t_out - t_in) / 3600, 2)


def wall_thickness(diameter: Column, pressure: Column, stress: Column, joint: Column, corrosion: Column) -> Column:
    p = pressure / 10
    return F.round(F.try_divide(p * diameter / 2, stress * joint - p * 0.6) + corrosion, 2)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < math.inf), c)
