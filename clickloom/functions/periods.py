"""UTC days and sales periods."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each granularity truncates to, and which calendar parts may narrow it.
SCOPE_PARTS = {
    "hour": ("year", "month", "day"),
    "day": ("year", "month"),
    "month": ("year",),
    "year": (),
}
FALLBACK_UNIT = "month"


def utc_day(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def unit_of(granularity: str) -> str:
    return granularity if granularity in SCOPE_PARTS else FALLBACK_UNIT


def period_start(timestamp: Column, granularity: str) -> Column:
    return F.date_trunc(unit_of(granularity), timestamp)


def scope_filters(
    day: Column, granularity: str, year: int | None, month: int | None, day_of_month: int | None
) -> list[Column]:
    """Calendar filters on the day column; parts a granularity does not use are ignored.

    They stay on the day, not on the timestamp, so a log partitioned by day is pruned.
    Zero counts as absent.
    """
    parts = {
        "year": (F.year(day), year),
        "month": (F.month(day), month),
        "day": (F.dayofmonth(day), day_of_month),
    }
    used = (parts[name] for name in SCOPE_PARTS.get(granularity, ()))
    return [part == F.lit(wanted) for part, wanted in used if wanted]


def scope_range(
    timestamp: Column, granularity: str, year: int | None, month: int | None, day_of_month: int | None
) -> list[Column]:
    """The same scope as a range of time, as far as its leading parts reach: it is pushed to the
    scan, where a log that is not partitioned by day skips by its statistics."""
    wanted = {"year": year, "month": month, "day": day_of_month}
    used = []
    for name in SCOPE_PARTS.get(granularity, ()):
        if not wanted[name]:
            break
        used.append(wanted[name])
    if not used:
        return []
    unit = ("year", "month", "day")[len(used) - 1]
    year, month, day_of_month = (*used, 1, 1)[:3]
    try:
        start = date(year, month, day_of_month)
        following = {
            "year": lambda: date(year + 1, 1, 1),
            "month": lambda: date(year + month // 12, month % 12 + 1, 1),
            "day": lambda: start + timedelta(days=1),
        }[unit]()
    except (ValueError, OverflowError):
        return []  # no such day; the calendar filters find nothing
    low, high = (F.lit(f"{edge.isoformat()} 00:00:00").cast("timestamp") for edge in (start, following))
    return [timestamp >= low, timestamp < high]


def period_label(period: Column, granularity: str) -> Column:
    """`7:00`, `30 Jan`, `Jan 2024` or `2024`; ISO text for any other granularity."""
    formats = {"hour": "H:'00'", "day": "d MMM", "month": "MMM yyyy", "year": "yyyy"}
    return F.date_format(period, formats.get(granularity, "yyyy-MM-dd'T'HH:mm:ss"))
