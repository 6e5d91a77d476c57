"""Interval bounds, run keys and windows. All instants are UTC; intervals are half-open."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPACT = r"^\d{8}T\d{6}Z?$"
LEGACY = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d+$"


def instant(text: Column) -> Column:
    """Text (ISO with or without offset, a bare date, or a compact key) -> timestamp; null where it is none."""
    compact = F.try_to_timestamp(F.regexp_replace(text, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))
    return F.when(F.trim(text).rlike(COMPACT), compact).otherwise(F.trim(text).try_cast("timestamp"))


def iso(when: Column) -> Column:
    """Timestamp -> ISO 8601 text in UTC; the fraction only where there is one."""
    fraction = F.date_format(when, "SSSSSS")
    head = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(head, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def interval_end(start: Column, end: Column) -> Column:
    """The exclusive end: as given, else a day after the start."""
    return F.coalesce(end, start + F.expr("INTERVAL 1 DAY"))


def valid_interval(start: Column, end: Column) -> Column:
    return F.coalesce(interval_end(start, end) > start, F.lit(False))


def checked_end(start: Column, end: Column) -> Column:
    """interval_end() that raises where the end isn't after the start."""
    return F.when(valid_interval(start, end), interval_end(start, end)).otherwise(F.raise_error(F.lit("the end of an interval must be after its start")).cast("timestamp"))


def to_key(when: Column) -> Column:
    """Timestamp -> path-safe key of whole seconds."""
    return F.date_format(when, "yyyyMMdd'T'HHmmss'Z'")


def text_to_key(text: Column) -> Column:
    """Text of an instant -> key; the legacy slashed form is wall-clock and gets no Z."""
    legacy = F.date_format(F.try_to_timestamp(F.regexp_replace(text, r"\.\d+$", ""), F.lit("yyyy/MM/dd HH:mm:ss")), "yyyyMMdd'T'HHmmss")
    return F.when(text.rlike(LEGACY), legacy).otherwise(to_key(instant(text)))


def from_key(key: Column) -> Column:
    """Key, with or without Z -> timestamp."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(key), "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))


def in_window(when: Column, start: str | datetime | None, end: str | datetime | None) -> Column:
    """start <= when < end, either bound open if None; plain comparisons, which reach the scan."""
    out = F.lit(True)
    if start is not None:
        out = out & (when >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (when < F.lit(end).cast("timestamp"))
    return out


def attempt_window(since: str | date | None = None, until: str | date | None = None, now: datetime | None = None) -> tuple[date, date]:
    """Half-open window of UTC days; by default the last seven with today."""
    today = (now or datetime.now(UTC)).astimezone(UTC).date()

    def day(x: str | date | None) -> date | None:
        return date.fromisoformat(x[:10]) if isinstance(x, str) else x

    end = day(until) or today + timedelta(days=1)
    start = day(since) or end - timedelta(days=7)
    if end <= start:
        raise ValueError(f"window end {end} must be after start {start}")
    return start, end


def hours_before(as_of: Column, hours: Column) -> Column:
    return as_of - F.make_dt_interval(F.lit(0), hours)


def duration_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(end) - F.unix_millis(start))


def dataset_id(name: str, version: int = 1) -> str:
    """{name}_vN with a clean name."""
    return f"{slug(name)}_v{int(version)}"


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def bronze_schema(provider: str) -> str:
    return f"bronze_{slug(provider)}"


def source_slug(provider: str, source: str) -> str:
    return f"{slug(provider)}__{slug(source)}"
