"""Decoding, flattening, matching and collapsing on small hand-made feeds."""

from __future__ import annotations

from datetime import UTC, date, datetime

import pyarrow as pa
import pytest

from headwise import schemas
from headwise.operators import calendar, collapse, flatten, match
from headwise.plans import standins
from headwise.sources import decode

TZ = "America/Chicago"


def utc(seconds):
    return datetime.fromtimestamp(seconds, UTC).replace(tzinfo=None)


NOON = 1789491600  # 2026-09-15 12:00 local


def feed(*entities, poll="p1", at=NOON):
    stamp = utc(at)
    return {"poll_id": poll, "feed": "trips", "fetched_at": stamp, "header_ts": stamp, "version": "2.0", "incrementality": None,
            "entities": [entity | {"id": entity.get("id", str(i))} for i, entity in enumerate(entities)]}


def stop(seq, arrival=None, departure=None, rel=None, stop_id="S"):
    return {"stop_sequence": seq, "stop_id": stop_id and f"{stop_id}{seq}", "schedule_relationship": rel, "arrival_time": arrival, "departure_time": departure}


def trip(*stops, trip_id="T1", affected=None, vehicle=None, ts=None, route="80"):
    modified = None if affected is None else {"modifications_id": "m", "affected_trip_id": affected or None}
    return {"kinds": ["tripUpdate"], "trip_update": {
        "trip": {"trip_id": trip_id, "route_id": route, "modified_trip": modified}, "vehicle_id": vehicle, "ts": ts, "stop_time_update": list(stops)}}


def frame(spark, *feeds):
    ddl = f"poll_id string, feed string, fetched_at timestamp, {schemas.FEED}"
    return spark.createDataFrame(list(feeds), ddl)


def timetable(spark, stop_times=(("T1", 5, 31800),), dates=("2026-09-15",), trips=("T1",)):
    one = "1 as feed_version_id"
    versions = spark.sql(
        f"select {one}, 'v' as feed_version, date'2026-08-24' as feed_start_date, date'2026-12-05' as feed_end_date, "
        "timestamp'2026-08-01' as loaded_at, timestamp'2026-08-01' as load_completed_at")
    return match.Timetable(
        versions,
        spark.createDataFrame([(1, t, "WK") for t in trips], "feed_version_id int, trip_id string, service_id string"),
        spark.createDataFrame([(1, *s) for s in stop_times], "feed_version_id int, trip_id string, stop_sequence int, arrival_s int"),
        spark.createDataFrame([(1, "WK", d) for d in dates], "feed_version_id int, service_id string, d string").selectExpr(
            "feed_version_id", "service_id", "cast(d as date) as date"),
    )


MORNING = NOON - 12 * 3600 + 31800  # 08:50 local


def predict(spark, feeds, table):
    rows = match.predictions(flatten.trip_updates(feeds), table, TZ).collect()
    return {(r.trip_id, r.stop_sequence, r.is_modified): r for r in rows}


def stats(spark, feeds, table):
    return match.transform_stats(feeds, table, TZ).first().asDict()


def test_schedule_match(spark):
    r = predict(spark, frame(spark, feed(trip(stop(5, MORNING + 60)))), timetable(spark))["T1", 5, False]
    assert (r.scheduled_source, r.scheduled_hour_local, r.day_type, r.service_date) == (1, 8, 0, date(2026, 9, 15))
    assert (r.observed_arrival - r.scheduled_arrival).total_seconds() == 60
    assert r.feed_version_id == 1


def test_modified_trip_keeps_the_schedule(spark):
    f = frame(spark, feed(trip(stop(5, MORNING), trip_id=None, affected="T1")))
    r = predict(spark, f, timetable(spark))["T1", 5, True]
    assert r.scheduled_source == 2 and r.scheduled_arrival is not None
    assert stats(spark, f, timetable(spark))["modified_trips"] == 1


def test_orphan_stop(spark):
    f = frame(spark, feed(trip(stop(5, MORNING), stop(6, MORNING + 60))))
    rows = predict(spark, f, timetable(spark))
    assert [rows["T1", s, False].scheduled_source for s in (5, 6)] == [1, 0]
    assert rows["T1", 6, False].service_date == date(2026, 9, 15) and rows["T1", 6, False].day_type is None
    assert stats(spark, f, timetable(spark))["unmatched_stops"] == 1


def test_unresolvable_date(spark):
    f = frame(spark, feed(trip(stop(5, MORNING))))
    table = timetable(spark, dates=("2025-01-01",))
    r = predict(spark, f, table)["T1", 5, False]
    assert (r.scheduled_source, r.service_date, r.scheduled_arrival) == (0, date(2026, 9, 15), None)
    s = stats(spark, f, table)
    assert (s["unresolved_service_date"], s["unmatched_trips"], s["unmatched_stops"]) == (1, 0, 0)


def test_past_midnight(spark):
    # 25:10:00 of the 15th, seen at 01:10 on the 16th.
    f = frame(spark, feed(trip(stop(5, NOON + 13 * 3600 + 600)), at=NOON + 13 * 3600))
    r = predict(spark, f, timetable(spark, stop_times=(("T1", 5, 90600),)))["T1", 5, False]
    assert (r.service_date, r.scheduled_hour_local, r.observed_arrival) == (date(2026, 9, 15), 1, r.scheduled_arrival)


def test_unknown_trip(spark):
    f = frame(spark, feed(trip(stop(5, MORNING), trip_id="NOPE")))
    assert predict(spark, f, timetable(spark))["NOPE", 5, False].scheduled_source == 0
    assert stats(spark, f, timetable(spark))["unmatched_trips"] == 1


def test_trip_without_stop_times_is_unknown(spark):
    f = frame(spark, feed(trip(stop(5, MORNING), trip_id="T2")))
    assert stats(spark, f, timetable(spark, trips=("T1", "T2")))["unmatched_trips"] == 1


def test_first_resolvable_stop_anchors_all(spark):
    # The first stop has no timetable entry; the second, NO_DATA but with an arrival, decides.
    f = frame(spark, feed(trip(stop(1, MORNING), stop(5, MORNING, rel="NO_DATA"), stop(7, MORNING + 86400))))
    table = timetable(spark, stop_times=(("T1", 5, 31800), ("T1", 7, 31800)), dates=("2026-09-15", "2026-09-16"))
    rows = predict(spark, f, table)
    assert {r.service_date for r in rows.values()} == {date(2026, 9, 15)}
    assert set(rows) == {("T1", 1, False), ("T1", 7, False)}


def test_skips(spark):
    f = frame(spark, feed(trip(stop(1, MORNING, rel="NO_DATA"), stop(2, None, MORNING), stop(3), stop(5, MORNING))))
    assert set(predict(spark, f, timetable(spark))) == {("T1", 5, False)}
    s = stats(spark, f, timetable(spark))
    assert (s["skipped_no_data"], s["skipped_departure_only"], s["skipped_no_time"], s["rows_emitted"], s["stop_updates_total"]) == (1, 1, 1, 1, 4)


def test_vehicle_beats_plan_stop_by_stop(spark):
    planned = trip(*[stop(i, MORNING + i) for i in range(1, 60)], trip_id=None, affected="T1", ts=NOON)
    live = trip(*[stop(i, MORNING + 1000 + i) for i in range(30, 43)], trip_id="T1", affected="T1", vehicle="bus", ts=NOON - 500)
    f = frame(spark, feed(live, planned))
    rows = predict(spark, f, timetable(spark))
    assert len(rows) == 59
    assert {k[1] for k, r in rows.items() if r.vehicle_id == "bus"} == set(range(30, 43))
    s = stats(spark, f, timetable(spark))
    assert (s["duplicate_keys"], s["rows_emitted"]) == (13, 59)


def test_fresher_then_later_entity_wins(spark):
    old, new = trip(stop(5, MORNING), ts=10), trip(stop(5, MORNING + 1), ts=20)
    for order in ((old, new), (new, old)):
        r = predict(spark, frame(spark, feed(*order)), timetable(spark))["T1", 5, False]
        assert r.observed_arrival == utc(MORNING + 1)
    same = frame(spark, feed(trip(stop(5, MORNING)), trip(stop(5, MORNING + 7))))
    assert predict(spark, same, timetable(spark))["T1", 5, False].observed_arrival == utc(MORNING + 7)


def test_flatten_details(spark):
    f = frame(spark, feed(
        trip(stop(1, 1), trip_id=None, affected=""),  # names no trip
        trip(stop(1, 1), trip_id=""),
        {"kinds": ["alert"], "trip_update": None},
        trip(stop(None, 1), stop(2, 2, stop_id=None), stop(3, 3), route=None),
    ))
    assert flatten.unidentified_trips(f).first().unidentifiable_trips == 2
    census = flatten.entity_census(f).first()
    assert census.entity_counts == {"tripUpdate": 3, "alert": 1} and census.entity_total == 4
    rows = flatten.stop_updates(flatten.trip_updates(f)).collect()
    assert [(r.entity_pos, r.stop_pos, r.stop_sequence, r.route_id) for r in rows] == [(3, 2, 3, "")]
    header = flatten.with_header_defaults(f).first()
    assert (header.version, header.incrementality) == ("2.0", "FULL_DATASET")


def test_empty_poll_has_stats(spark):
    f = frame(spark, feed({"kinds": ["alert"], "trip_update": None}))
    s = stats(spark, f, timetable(spark))
    assert s.pop("poll_id") == "p1" and set(s.values()) == {0}


def test_decode_inverts_encode(spark):
    nested = frame(spark, feed(
        trip(stop(1, MORNING, MORNING + 5, rel="SKIPPED"), stop(2, None, None, rel="17"), trip_id=None, affected="T9", vehicle="v", ts=5),
        {"kinds": ["alert"], "trip_update": None},
        trip(stop(3, 0), route=None),
    ))
    decoded = decode.decode_polls(standins.encode_feeds(nested))
    got, want = decode.good_feeds(decoded).first(), nested.first()
    assert got.entities == want.entities and got.header_ts == want.header_ts and got.version == want.version
    assert decode.quarantine(decoded).count() == 0


def test_polls_are_encoded_a_few_at_a_time(spark):
    """F2-F4, F6, F7: a batch of 10,000 polls is never held as Python objects."""

    class Taken:
        def mapInArrow(self, run, schema):
            return run

    one = frame(spark, feed(trip(stop(1, MORNING, MORNING + 5)))).toArrow()
    (batch,) = pa.concat_tables([one] * 100).combine_chunks().to_batches()
    parts = list(standins.encode_feeds(Taken())(iter([batch])))
    assert max(p.num_rows for p in parts) <= standins.ENCODED_AT_ONCE and sum(p.num_rows for p in parts) == 100
    assert len({v for p in parts for v in p.column("payload").to_pylist()}) == 1


@pytest.mark.parametrize(("payload", "error"), [(b"\xff\xff\xff", "unreadable_payload"), (b"", "no_header_time"), (b"\x0a\x05\x0a\x032.0", "no_header_time")])
def test_bad_payloads_are_quarantined(spark, payload, error):
    polls = spark.createDataFrame([("t", datetime(2026, 1, 1), payload)], "feed string, fetched_at timestamp, payload binary")
    decoded = decode.decode_polls(polls)
    assert decode.quarantine(decoded).first().error == error
    assert decode.good_feeds(decoded).count() == 0


# -- collapse -----------------------------------------------------------------------


def prediction(at, arrival, vehicle=None, scheduled=None, source=0, rel=0, route="80"):
    t = utc
    return (f"p{at}", date(2026, 9, 15), "T1", 5, False, route, "S5", None if scheduled is None else 8, None if scheduled is None else 0,
            None if scheduled is None else t(NOON + scheduled), source, None if scheduled is None else 1, t(NOON + arrival), rel, vehicle, t(NOON + at), t(NOON + at))


def fold(spark, *rows, **kw):
    return collapse.collapse(collapse.once_per_poll(spark.createDataFrame(list(rows), schemas.PREDICTIONS)), **kw).collect()


CASE = (
    prediction(0, 100, vehicle="A", route="80"),
    prediction(30, 100, scheduled=40, source=1, route="81"),
    prediction(60, 160, rel=1),
    prediction(4000, 150),
    prediction(4030, 160),
)


@pytest.mark.parametrize("chunk_s", [1, 45, 3600, 10**6])
def test_fold_rules(spark, chunk_s):
    (r,) = fold(spark, *CASE, chunk_s=chunk_s)
    t = lambda s: utc(NOON + s)
    assert (r.change_count, r.poll_count) == (3, 5)
    assert (r.first_predicted_arrival, r.observed_arrival, r.min_predicted_arrival, r.max_predicted_arrival) == (t(100), t(160), t(100), t(160))
    assert (r.first_seen_at, r.last_seen_at) == (t(0), t(4030))
    assert (r.vehicle_id, r.route_id) == ("A", "80")
    assert (r.scheduled_source, r.scheduled_arrival, r.scheduled_hour_local, r.feed_version_id) == (1, t(40), 8, 1)
    assert (r.schedule_relationship, r.delay_seconds) == (0, 120)


def test_fold_ignores_order_and_replay(spark):
    assert fold(spark, *reversed(CASE), *CASE) == fold(spark, *CASE)


def test_unmatched_visit_has_no_delay(spark):
    (r,) = fold(spark, prediction(0, 100), prediction(30, 100))
    assert (r.scheduled_source, r.delay_seconds, r.change_count) == (0, None, 0)
    summary = collapse.write_summary(collapse.collapse(spark.createDataFrame([CASE[0]], schemas.PREDICTIONS))).first()
    assert (summary.rows_written, summary.rows_inserted, summary.rows_with_changes) == (1, 1, 0)


# -- calendar -----------------------------------------------------------------------


def test_bind_version(spark):
    rows = [(1, "2026-01-01", "2026-03-31", 1, 1), (2, "2026-03-01", "2026-06-30", 2, 1), (3, "2026-01-01", "2026-12-31", 3, None)]
    versions = spark.createDataFrame(rows, "feed_version_id int, s string, e string, l int, c int").selectExpr(
        "feed_version_id", "cast(s as date) as feed_start_date", "cast(e as date) as feed_end_date",
        "timestamp_seconds(l) as loaded_at", "timestamp_seconds(c) as load_completed_at")
    dates = spark.createDataFrame([(d,) for d in ("2026-02-01", "2026-03-15", "2026-09-01")], "d string").selectExpr("cast(d as date) as date")
    got = {str(r.date): r.feed_version_id for r in calendar.bind_version(dates, versions).collect()}
    assert got == {"2026-02-01": 1, "2026-03-15": 2, "2026-09-01": 2}
    none = calendar.bind_version(dates, versions.filter("feed_version_id = 3"))
    assert {r.feed_version_id for r in none.collect()} == {None}


def test_service_dates(spark):
    flags = dict.fromkeys(calendar.WEEKDAYS[:5], True) | dict.fromkeys(calendar.WEEKDAYS[5:], False)
    cal = spark.createDataFrame([{"feed_version_id": 1, "service_id": "WK", **flags}]).selectExpr("*", "date'2026-09-04' as start_date", "date'2026-09-09' as end_date")
    exc = spark.createDataFrame([(1, "WK", "2026-09-07", 2), (1, "WK", "2026-09-05", 1), (1, "SP", "2026-09-07", 1), (1, "WK", "2026-09-04", 1)],
                                "feed_version_id int, service_id string, d string, exception_type int").selectExpr("feed_version_id", "service_id", "cast(d as date) as date", "exception_type")
    got = sorted((r.service_id, r.date.day) for r in calendar.service_dates(cal, exc).collect())
    assert got == [("SP", 7), ("WK", 4), ("WK", 5), ("WK", 8), ("WK", 9)]
