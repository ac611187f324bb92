"""Running days as bits, and the coverage counted from them, against plain sets of days."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import functions as F

from headwise.operators import calendar, coverage

V = "feed_version_id"


def made(seed):
    rng = random.Random(seed)
    start = date(2026, 2, 20)
    days = [start + timedelta(days=i) for i in range(150)]  # three words and more
    services = [(v, s, d) for v in (1, 2) for s in "ABC" for d in days if rng.random() < 0.6]
    trips = [(v, f"T{i}", rng.choice("ABCD")) for v in (1, 2) for i in range(12) if (v, i) != (2, 11)]
    times = [(v, t, q) for v, t, _ in trips for q in range(1, rng.randint(2, 6))]
    seen = [(rng.choice(days), f"T{rng.randrange(14)}", rng.randint(1, 7)) for _ in range(3000)] + [(days[3], "T1", 1)] * 500
    return services, trips, times, seen


def frames(spark, services, trips, times, seen):
    return (
        spark.createDataFrame(services, f"{V} int, service_id string, date date"),
        spark.createDataFrame(trips, f"{V} int, trip_id string, service_id string"),
        spark.createDataFrame(times, f"{V} int, trip_id string, stop_sequence int"),
        spark.createDataFrame(seen, "service_date date, trip_id string, stop_sequence int"),
    )


def test_days_before_1970_and_words(spark):
    days = [date(1969, 12, 31), date(1970, 1, 1), date(1970, 3, 5), date(1970, 3, 6), date(2026, 9, 15)]
    words = calendar.day_words(spark.createDataFrame([(d,) for d in days * 2], "d date"), [], "d")
    assert {(r.word, r.bits) for r in words.collect()} == {(-1, -(1 << 63)), (0, 1 | -(1 << 63)), (1, 1), (323, 1 << (20711 - 323 * 64))}
    counts = calendar.counts_per_day(words, {"n": (F.col("bits"), F.lit(3))})
    assert {(r.service_date, r.n) for r in counts.collect()} == {(d, 3) for d in days}


def test_match_by_words_equals_match_by_days(spark):
    services, trips, times, seen = made(1)
    s, t, q, o = frames(spark, services, trips, times, seen)
    got = coverage.match_words(calendar.event_words(s, t, q).filter(f"{V} = 1"), coverage.observed_words(o))
    per_day = calendar.counts_per_day(got, {"scheduled": (F.col("bits"), F.lit(1)), "observed": (F.col("seen"), F.lit(1))})
    runs = {(x, d) for v, x, d in services if v == 1}
    of = {x: svc for v, x, svc in trips if v == 1}
    want = {(d, trip, n) for v, trip, n in times if v == 1 for svc, d in runs if svc == of[trip]}
    scheduled, observed = Counter(d for d, _, _ in want), Counter(d for d, _, _ in want & set(seen))
    assert {r.service_date: (r.scheduled, r.observed) for r in per_day.collect()} == {d: (n, observed[d]) for d, n in scheduled.items()}
    day = date(2026, 3, 1)
    events = calendar.scheduled_events(s, t, q, F.lit(day)).filter("true")
    assert Counter((r.service_date, r.trip_id, r.stop_sequence) for r in events.collect()) == Counter(
        (day, trip, n) for v, trip, n in times for v2, svc, d in services if v == v2 and d == day and dict(((a, b), c) for a, b, c in trips)[v, trip] == svc)


def test_coverage_of_versions_in_effect(spark):
    services, trips, times, seen = made(2)
    s, t, q, o = frames(spark, services, trips, times, seen)
    cut, end = date(2026, 5, 1), date(2026, 7, 1)
    versions = spark.createDataFrame(
        [(1, date(2026, 1, 1), date(2026, 12, 31), "2026-01-01"), (2, cut, date(2026, 12, 31), "2026-02-01"), (3, cut, end, "2026-03-01")],
        f"{V} int, feed_start_date date, feed_end_date date, l string",
    ).select("*", F.col("l").cast("timestamp").alias("loaded_at"), F.when(F.col(V) < 3, F.col("l").cast("timestamp")).alias("load_completed_at"))
    gaps = spark.createDataFrame([(date(2026, 3, 3), "storm"), (date(2020, 1, 1), "old")], "service_date date, known_gap_reason string")
    of = {(v, x): svc for v, x, svc in trips}
    for policy in ("in_effect", "latest"):
        bound = lambda d: 2 if policy == "latest" or d >= cut else 1  # noqa: E731, B023
        want = {}
        for day in {d for d, _, _ in seen if d < end}:
            v = bound(day)
            due = {(trip, n) for w, trip, n in times if w == v and (v, of[v, trip], day) in set(services)}
            want[day] = (len(due), len(due & {(x, n) for d, x, n in seen if d == day}))
        got = coverage.day_coverage(o, versions, t, q, s, gaps, F.lit(end), policy)
        assert {r.service_date: (r.scheduled_stop_events, r.observed_stop_events) for r in got.collect() if r.service_date.year > 2020} == want
        assert {r.service_date: r.known_gap_reason for r in got.collect() if r.known_gap_reason} == {date(2026, 3, 3): "storm", date(2020, 1, 1): "old"}


def test_observations_are_dealt_by_event_only(spark):
    services, trips, times, seen = made(3)
    s, t, q, o = frames(spark, services, trips, times, seen)
    plan = coverage.observed_words(o, F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "trip_id" in plan.split("hashpartitioning(")[1].split(")")[0] and "service_date" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_coverage_of_nothing(spark):
    s, t, q, o = frames(spark, *made(4))
    versions = spark.createDataFrame([], f"{V} int, feed_start_date date, feed_end_date date, loaded_at timestamp, load_completed_at timestamp")
    gaps = spark.createDataFrame([], "service_date date, known_gap_reason string")
    for policy in ("in_effect", "latest"):
        assert coverage.day_coverage(o, versions, t, q, s, gaps, F.lit(date(2027, 1, 1)), policy).collect() == []
        assert coverage.day_coverage(o.limit(0), versions, t, q, s, gaps, F.lit(date(2027, 1, 1)), policy).collect() == []
