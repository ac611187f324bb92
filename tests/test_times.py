from __future__ import annotations

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from headwise.functions import times
from headwise.operators.match import resolve_service_date

TZ = "America/Chicago"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def day(text):
    return F.lit(text).cast("date")


def local_s(spark, text):
    """Epoch second of a wall-clock time in the zone."""
    return value(spark, F.unix_seconds(F.to_utc_timestamp(F.lit(text).cast("timestamp"), TZ)))


@pytest.mark.parametrize(
    ("text", "seconds"),
    [
        ("08:50:00", 31800), ("8:50:00", 31800), ("25:10:00", 90600), ("27:45:30", 99930), (" 00:00:01 ", 1),
        ("8:5:0", None), ("08:60:00", None), ("", None), ("nonsense", None), ("1234:00:00", None),
    ],
)
def test_parse_time(spark, text, seconds):
    assert value(spark, times.parse_gtfs_time(F.lit(text))) == seconds


def test_parse_time_strict(spark):
    assert value(spark, times.parse_gtfs_time(F.lit("25:10:00"), strict=True)) == 90600
    with pytest.raises(PySparkException, match="invalid GTFS time"):
        value(spark, times.parse_gtfs_time(F.lit("08:60:00"), strict=True))


def test_past_midnight_lands_on_next_day(spark):
    at = times.scheduled_at(day("2026-09-15"), F.lit(90600), TZ)
    assert value(spark, times.local_date(at, TZ)) == date(2026, 9, 16)
    assert value(spark, times.local_hour(at, TZ)) == 1


def test_service_days_of_a_year(spark):
    days = spark.sql("select explode(sequence(date'2026-01-01', date'2026-12-31')) as d")
    start = times.service_day_start_s
    rows = days.select(
        F.col("d").cast("string").alias("d"),
        (start(F.date_add("d", 1), TZ) - start(F.col("d"), TZ)).alias("length"),
        F.date_format(F.from_utc_timestamp(F.timestamp_seconds(start(F.col("d"), TZ) + 43200), TZ), "yyyy-MM-dd HH:mm").alias("noon"),
    ).collect()
    assert len(rows) == 365
    assert all(r.noon == f"{r.d} 12:00" for r in rows)
    odd = {r.d: r.length // 3600 for r in rows if r.length != 86400}
    assert odd == {"2026-03-07": 23, "2026-10-31": 25}


def test_late_trip_on_the_spring_day(spark):
    assert value(spark, times.scheduled_s(day("2026-03-08"), F.lit(90600), TZ)) == 1773036600


@pytest.mark.parametrize(("text", "kind"), [("2026-09-15", 0), ("2026-09-18", 0), ("2026-09-19", 1), ("2026-09-20", 2)])
def test_day_type(spark, text, kind):
    assert value(spark, times.day_type(day(text))) == kind


def test_week_start_and_bucket(spark):
    for text in ("2026-09-14", "2026-09-17", "2026-09-20"):
        assert value(spark, times.week_start(day(text))) == date(2026, 9, 14)
    assert value(spark, times.week_bucket(day("2026-09-20"))) == "stop_time_observations_w20260914"


ALWAYS = [f"2026-09-{d:02d}" for d in range(10, 21)]


@pytest.mark.parametrize(
    ("observed", "seconds", "runs", "expected"),
    [
        ("2026-09-16 01:10:00", 90600, ALWAYS, date(2026, 9, 15)),  # 25:10:00 on time
        ("2026-09-16 00:55:00", 87300, ALWAYS, date(2026, 9, 15)),  # 24:15:00, 40 minutes late
        ("2026-09-15 08:50:00", 31800, ALWAYS, date(2026, 9, 15)),
        ("2026-09-15 23:58:00", 300, ALWAYS, date(2026, 9, 16)),  # 00:05:00, early
        ("2026-09-15 08:50:00", 31800, [], None),
        ("2026-09-15 08:50:00", 31800, ["2026-09-14"], date(2026, 9, 14)),
        ("2026-09-15 08:50:00", 31800, ["2026-09-12"], None),
        ("2026-09-15 12:00:00", 0, ["2026-09-15", "2026-09-16"], date(2026, 9, 15)),  # a tie: the earlier
    ],
)
def test_resolve_service_date(spark, observed, seconds, runs, expected):
    words = {}
    for d in runs:
        n = (date.fromisoformat(d) - date(1970, 1, 1)).days
        words[n // 64] = words.get(n // 64, 0) | 1 << n % 64
    active = F.create_map(*[F.lit(x) for word in words.items() for x in word]).cast("map<int,bigint>")
    at = F.lit(local_s(spark, observed))
    assert value(spark, resolve_service_date(at, F.lit(seconds), active, TZ)) == expected


def test_snapshot_names(spark):
    def parse(name):
        return value(spark, F.date_format(times.snapshot_time(F.lit(name), "snap.x"), "yyyy-MM-dd HH:mm"))

    assert parse("snap.x-2026-09-15T0830Z.dump") == "2026-09-15 08:30"
    assert parse("snapax-2026-09-15T0830Z.dump") is None
    assert parse("snap.x-2026-13-15T0830Z.dump") is None
    assert parse("snap.x-2026-09-15T0830Z.dump.part") is None


def test_iso_week_at_year_boundary(spark):
    assert value(spark, times.iso_week_key(F.lit("2027-01-01").cast("timestamp"))) == "2026-W53"


def test_feed_age_rounds_to_seconds(spark):
    a, b = F.lit("2026-09-15 10:00:30.6").cast("timestamp"), F.lit("2026-09-15 10:00:00").cast("timestamp")
    assert value(spark, times.feed_age_s(a, b)) == 31
