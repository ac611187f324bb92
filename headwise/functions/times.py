"""Service-day arithmetic.

A service day starts at local noon minus twelve hours, so it is well defined on
the days the clocks change. All arithmetic is on epoch seconds: adding an
interval of a day or more to a timestamp would follow the calendar instead.
The session time zone is expected to be UTC (see :mod:`headwise.session`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as k


def as_instant(ts: Column) -> Column:
    """A zone-less timestamp column read as UTC."""
    return ts.cast("timestamp")


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts, tz))


def add_days(date: Column, days: int) -> Column:
    return F.date_add(date, days)


def service_day_start_s(date: Column, tz: str) -> Column:
    """Epoch second at which service day ``date`` starts."""
    noon = F.make_timestamp(
        F.year(date), F.month(date), F.dayofmonth(date), F.lit(12), F.lit(0), F.lit(0), F.lit(tz)
    )
    return F.unix_seconds(noon) - 12 * 3600


def scheduled_s(date: Column, seconds: Column, tz: str) -> Column:
    """Epoch second of a timetable time, which may exceed 24 hours."""
    return service_day_start_s(date, tz) + seconds


def scheduled_at(date: Column, seconds: Column, tz: str) -> Column:
    return F.timestamp_seconds(scheduled_s(date, seconds, tz))


def parse_gtfs_time(text: Column, strict: bool = False) -> Column:
    """``H:MM:SS`` to seconds. Malformed text gives null, or fails if ``strict``."""
    t = F.trim(text)
    part = [F.regexp_extract(t, k.GTFS_TIME, i).cast("int") for i in (1, 2, 3)]
    seconds = part[0] * 3600 + part[1] * 60 + part[2]
    parsed = F.when(t.rlike(k.GTFS_TIME), seconds)
    if not strict:
        return parsed
    message = F.concat(F.lit("invalid GTFS time: "), F.coalesce(text, F.lit("")))
    return parsed.otherwise(F.raise_error(message).cast("int"))


def day_type(date: Column) -> Column:
    dow = F.weekday(date)  # Monday = 0
    return (
        F.when(dow == 5, F.lit(k.SATURDAY)).when(dow == 6, F.lit(k.SUNDAY)).otherwise(F.lit(k.WEEKDAY))
    )


def week_start(date: Column) -> Column:
    return F.to_date(F.date_trunc("week", date))


def week_bucket(date: Column, prefix: str = "stop_time_observations_w") -> Column:
    return F.concat(F.lit(prefix), F.date_format(week_start(date), "yyyyMMdd"))


def utc_hour_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def runs_on_weekday(date: Column, flags: list[Column]) -> Column:
    """Pick the flag of ``date``'s weekday from seven flags, Monday first."""
    return F.element_at(F.array(*flags), F.weekday(date) + 1)


def feed_age_s(received: Column, header: Column) -> Column:
    """Whole seconds between a feed's own clock and its receipt."""
    millis = F.unix_millis(received) - F.unix_millis(header)
    return F.floor(millis / 1000 + 0.5).cast("int")


def snapshot_time(name: Column, prefix: str) -> Column:
    """Time in ``<prefix>-YYYY-MM-DDTHHMMZ.dump``; null for any other name."""
    pattern = "^" + _quote(prefix) + r"-(\d{4}-\d{2}-\d{2})T(\d{2})(\d{2})Z\.dump$"
    stamp = F.concat_ws(
        " ",
        F.regexp_extract(name, pattern, 1),
        F.concat_ws(":", F.regexp_extract(name, pattern, 2), F.regexp_extract(name, pattern, 3)),
    )
    return F.when(name.rlike(pattern), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm")))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_week_key(ts: Column) -> Column:
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.weekofyear(ts).cast("string")
    )


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)
