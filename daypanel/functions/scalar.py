"""Row-level expressions. All of them are built-in Spark functions, safe under ANSI mode."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; NULL where the divisor is zero."""
    return F.try_divide(top, bottom)


def clamp_nonnegative(value: Column) -> Column:
    """Negative values become 0. A missing value stays missing (``greatest`` alone would make it 0)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def rate_to_depth(rate: Column, area_km2: Column) -> Column:
    """Discharge in m3/s over an area in km2 as a depth in mm/day; NULL for a missing or non-positive area."""
    return F.when(area_km2 > 0, rate * F.lit(SECONDS_PER_DAY) / (area_km2 * F.lit(1e6)) * F.lit(1000.0))


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts; NULL instead of an error for parts that form no date."""
    first = F.make_date(year, F.when(month.between(1, 12), month).otherwise(F.lit(1)), F.lit(1))
    valid = month.between(1, 12) & (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
    return F.when(valid, F.date_add(first, (day - 1).cast("int")))


def normalize_id(value: Column, lenient: bool = False) -> Column:
    """An id as integer text without leading zeros. ``lenient`` accepts '12.0' and returns other text unchanged."""
    if not lenient:
        return value.cast("bigint").cast("string")
    text = value.cast("string")
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def padded_id(value: Column, width: int = 5) -> Column:
    """An id zero-padded to the width used in file names."""
    return F.lpad(value.cast("string"), width, "0")


def season_angle(position: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * position / F.lit(period)
    return F.sin(angle), F.cos(angle)


def seasonal_cyclical(date: Column) -> list[Column]:
    """Day of year and month as points on a circle."""
    day_sin, day_cos = season_angle(F.dayofyear(date), 365.25)
    month_sin, month_cos = season_angle(F.month(date), 12.0)
    return [
        day_sin.alias("day_sin"),
        day_cos.alias("day_cos"),
        month_sin.alias("month_sin"),
        month_cos.alias("month_cos"),
    ]


def seasonal_raw(date: Column) -> list[Column]:
    return [F.dayofyear(date).alias("day_of_year"), F.month(date).alias("month")]


# Calendar months of each season flag.
SEASON_MONTHS = {
    "is_monsoon": (6, 7, 8, 9),
    "is_pre_monsoon": (3, 4, 5),
    "is_post_monsoon": (10, 11),
    "is_winter": (12, 1, 2),
}


def season_flags(date: Column) -> list[Column]:
    return [F.month(date).isin(*months).cast("int").alias(name) for name, months in SEASON_MONTHS.items()]


def season_name(date: Column) -> Column:
    """The season of a date as one label (the flag name without its prefix)."""
    label = F.lit(None)
    for name, months in SEASON_MONTHS.items():
        label = F.when(F.month(date).isin(*months), F.lit(name.removeprefix("is_"))).otherwise(label)
    return label


def temp_features(tmax: Column, tmin: Column) -> list[Column]:
    return [
        (tmax - tmin).alias("temperature_range_c"),
        ((tmax + tmin) / F.lit(2.0)).alias("temperature_mean_c"),
    ]


def water_balance(precip: Column, pet: Column) -> list[Column]:
    return [
        ratio(precip, pet + F.lit(0.01)).alias("precip_pet_ratio"),
        (precip - pet).alias("water_balance_mm"),
    ]


def rain_features(precip: Column) -> list[Column]:
    """Rain amount and wet-day flag; a missing amount counts as no rain in both."""
    return [
        F.when(precip > 0, precip).otherwise(F.lit(0.0)).alias("precip_intensity"),
        F.when(precip > 1.0, F.lit(1)).otherwise(F.lit(0)).alias("is_rainy_day"),
    ]


def bounded_change(now: Column, before: Column, bound: float = 10.0) -> Column:
    """Relative change clipped to ``±bound``. From zero: ``+bound`` up, ``-bound`` down, undefined for 0 -> 0."""
    limit = F.lit(bound)
    return (
        F.when(now.isNull() | before.isNull(), F.lit(None))
        .when((before == 0) & (now > 0), limit)
        .when((before == 0) & (now < 0), -limit)
        .when(before == 0, F.lit(None))
        .otherwise(F.least(F.greatest(F.try_divide(now, before) - 1, -limit), limit))
    )


def linear_fill(value: Column, place: Column, left: Column, left_place: Column, right: Column, right_place: Column) -> Column:
    """A gap filled on the line between its two neighbours; with one neighbour only, that neighbour's value."""
    step = F.try_divide(right - left, (right_place - left_place).cast("double"))
    return F.coalesce(value, left + step * (place - left_place), left, right)
