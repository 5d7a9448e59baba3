"""Dates: business day, ISO and unix times, search scopes."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

DAY_START_HOUR = 8  # UTC


def at(when: datetime) -> Column:
    """Timestamp literal; a time without a zone is UTC, whatever the zone of the driver machine."""
    return F.lit(when if when.tzinfo else when.replace(tzinfo=timezone.utc))


def business_day(ts: Column) -> Column:
    """Day that starts at 08:00 UTC."""
    return F.to_date(ts - F.expr(f"INTERVAL {DAY_START_HOUR} HOURS"))


def unix_to_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def ts_to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_to_ts(text: Column) -> Column:
    """ISO text with `Z`, an offset or neither (then UTC); null when it cannot be read."""
    return text.try_cast("timestamp")


# days a named scope reaches back (fixed values)
SCOPE_DAYS = {"today": 0, "week": 7, "month": 30, "year": 365}


def resolve_scope(
    now: date, scope: str = "all", days: int | None = None, start: str | None = None, end: str | None = None
) -> tuple[str | None, str | None]:
    """Date range of a search: explicit dates, else days back, else the named scope."""
    if start or end:
        return start, end
    back = days if days is not None else SCOPE_DAYS.get(scope)
    if back is None:
        return None, None
    return (now - timedelta(days=back)).isoformat(), now.isoformat()
