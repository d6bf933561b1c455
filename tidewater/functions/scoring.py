"""Scalar features of impressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the position buckets, with their numbers (two bounds share a number).
POSITION_BUCKETS = ((4, 1), (8, 2), (12, 3), (20, 4), (50, 5), (100, 6), (200, 6), (300, 7), (400, 8), (500, 9))
# Weights of engagement.
WEIGHTS = {"click": 1.0, "like": 2.0, "collect": 3.0, "comment": 3.0, "share": 3.0}
# Numbers of the routes.
ROUTES = {"ann": 1, "swing": 2, "usercf": 3, "hot": 4}


def graded_label() -> Column:
    """0 without a click, else the weighted engagement plus 0.2 ln(1 + time on page)."""
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) + 0.2 * F.log1p(F.coalesce("page_time", F.lit(0.0)))
    return F.when(F.col("click") == 0, F.lit(0.0)).otherwise(total)


def interaction_score() -> Column:
    """The same weights without the gate of a click, each term and the sum at least 0. Null parts count 0."""
    return sum((F.greatest(F.col(k) * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0)) + 0.2 * F.log1p(F.greatest("page_time", F.lit(0.0)))


def position_bucket(position: str = "position") -> Column:
    out = F
    for most, number in POSITION_BUCKETS:
        out = out.when(F.col(position) <= most, number)
    return out.otherwise(10)


def safe_rate(part: Column | str, whole: Column | str) -> Column:
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.coalesce(part / F.when(whole != 0, whole), F.lit(0.0))


# Columns that hold the time of an event, by scene.
EVENT_TIME = {"search": ("search_timestamp", "timestamp"), "rec": ("request_timestamp", "timestamp")}


def optional(rows: DataFrame, name: str, fallback: str | float) -> Column:
    """The column name; where rows have none, the column fallback or that number."""
    if name in rows.columns:
        return F.col(name)
    return F.col(fallback) if isinstance(fallback, str) else F.lit(fallback)


def event_time(rows: DataFrame, scene: str) -> Column:
    """The time of an event by the first of the scene's columns; an error if there is none."""
    found = next((c for c in EVENT_TIME[scene] if c in rows.columns), None)
    if found is None:
        raise ValueError(f"no time of an event for {scene}: expected one of {EVENT_TIME[scene]}, found {sorted(rows.columns)}")
    return F.col(found).alias("event_timestamp")


def columns_like(rows: DataFrame, pattern: str) -> DataFrame:
    """The columns whose name matches."""
    return rows.select(rows.colRegex(f"`{pattern}`"))


def scene_rates(rows: DataFrame, scene: str) -> dict[str, Column]:
    """Rates of a scene's own counters, and of times viewed; counters that rows lack count as the general ones or 0."""
    clicks, shown = optional(rows, f"click_{scene}_num", "click_num"), optional(rows, f"imp_{scene}_num", "imp_num")
    out = {f"{scene}_ctr": safe_rate(clicks, shown)}
    for name in ("like", "collect", "share", "follow"):
        out[f"{scene}_{name}_rate"] = safe_rate(optional(rows, f"{scene}_{name}_num", 0.0), clicks)
    out[f"{scene}_view_time_rate"] = safe_rate(optional(rows, f"{scene}_view_time", "view_time"), "view_time")
    for name in ("valid", "full"):
        out[f"{name}_view_time_rate"] = safe_rate(optional(rows, f"{name}_view_times", 0.0), "view_time")
    return out


def route_number(route: Column) -> Column:
    out = F
    for name, number in ROUTES.items():
        out = out.when(F.lower(route) == name, number)
    return out.otherwise(0)


def number(value: Column) -> Column:
    """Any value as a finite number, or 0."""
    return finite(value.try_cast("double"))


def finite(value: Column) -> Column:
    """value, or 0 where it is null, NaN or infinite."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
