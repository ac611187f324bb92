"""The jobs end to end on one small city."""

from __future__ import annotations

import json
import shutil
from datetime import UTC, date, datetime, timedelta

import pytest

from headwise import schemas
from headwise.operators import match
from headwise.plans import jobs, standins
from headwise.sources import archive, tables
from headwise.streaming import polls

TZ = "America/Chicago"
FEED = {
    "feed_info": "feed_version,feed_start_date,feed_end_date\nv1,20260824,20261205\n",
    "routes": "route_id,route_long_name\n80,Main\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"S{i},Stop {i},43.0{i},-89.4{i}\n" for i in range(1, 7)),
    "trips": "trip_id,route_id,service_id,trip_headsign,direction_id\n" + "".join(f"T{i},80,WK,North,{i % 2}\n" for i in range(8)),
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWK,1,1,1,1,1,0,0,20260824,20261205\n",
    "calendar_dates": "service_id,date,exception_type\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    + "".join(f"T{t},08:{5 * s + t % 4:02d}:00,08:{5 * s + t % 4:02d}:00,S{s},{s}\n" for t in range(8) for s in range(1, 7)),
}
MIDNIGHT = 1789448400  # 2026-09-15 00:00 local


def utc(seconds):
    return datetime.fromtimestamp(seconds, UTC).replace(tzinfo=None)


def poll(at, delay):
    entities = [
        {"id": str(t), "kinds": ["tripUpdate"], "trip_update": {
            "trip": {"trip_id": f"T{t}", "route_id": "80", "modified_trip": None}, "vehicle_id": f"V{t}", "ts": at,
            "stop_time_update": [
                {"stop_sequence": s, "stop_id": f"S{s}", "schedule_relationship": None, "departure_time": None,
                 "arrival_time": MIDNIGHT + 8 * 3600 + (5 * s + t % 4) * 60 + delay + 60 * s} for s in range(1, 7)]}}
        for t in range(8)
    ]
    return (f"p{at}", "trips", utc(at), utc(at), "2.0", None, entities)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("city")
    gtfs = base / "gtfs"
    gtfs.mkdir()
    for name, text in FEED.items():
        (gtfs / f"{name}.txt").write_text(text)
    root = str(base / "store")
    assert jobs.main(["load-static", "--store", root, "--gtfs", str(gtfs)]) == 0
    nested = spark.createDataFrame(
        [poll(MIDNIGHT + 8 * 3600 + 30 * i, d) for i, d in enumerate((0, 10, 10))],
        f"poll_id string, feed string, fetched_at timestamp, {schemas.FEED}",
    )
    archive.write_archive(standins.encode_feeds(nested), str(base / "archive"))
    live = jobs.Tables(spark, root)
    timetable = live.timetable()
    assert isinstance(timetable, match.Timetable)
    polls.ingest(spark, str(base / "archive"), polls.Store(root), timetable, TZ).awaitTermination()
    return root


def test_rollup_then_export(spark, store, tmp_path, capsys):
    assert jobs.main(["rollup", "--store", store, "--date", "2026-09-15", "--monthly", "2026-09", "--as-of", "2026-09-16T15:00:00"]) == 0
    daily = spark.read.parquet(f"{store}/rollup_daily")
    assert daily.agg({"n": "sum"}).first()[0] == 48
    assert spark.read.parquet(f"{store}/rollup_monthly").first().month == date(2026, 9, 1)
    cover = spark.read.parquet(f"{store}/day_coverage").first()
    assert (cover.scheduled_stop_events, cover.observed_stop_events, cover.coverage_pct) == (48, 48, 100.0)

    out = tmp_path / "site"
    assert jobs.main(["export", "--store", store, "--out", str(out), "--as-of", "2026-09-16T15:00:00"]) == 0
    def read(folder):
        files = [p for p in folder.glob("part-*")]
        return [json.loads(line) for p in files for line in p.read_text().splitlines()]

    (route,) = read(out / "routes" / "route_id=80")
    assert route["route"] == {"id": "80", "name": "Main"} and route["n"] == 48 and route["hasUsableData"]
    assert [d["direction"] for d in route["profile"]] == [0, 1]
    assert [s["seq"] for s in route["profile"][0]["stops"]] == [1, 2, 3, 4, 5, 6]
    assert route["profile"][0]["stops"][0]["mean"] == 70.0  # 10 s and one minute per stop
    (stop,) = read(out / "stops" / "stop_id=S4")
    assert stop["observations"] == 8 and stop["cells"][0]["pctLate"] == 100.0 and stop["stop"]["headsigns"] == ["North"]
    (facts,) = read(out / "index" / "section=dataset")
    assert facts["totalObservations"] == 48 and facts["dayTypesPresent"] == [0]
    (snap,) = read(out / "index" / "section=systemSnapshot")
    assert snap == {"date": "2026-09-15", "n": 48, "pctLate": 50.0}


def test_low_coverage_fails_the_rollup(spark, store, tmp_path, capsys):
    # Half of the observations only.
    root = str(tmp_path / "half")
    spark.read.parquet(f"{store}/observations").filter("stop_sequence <= 3").write.partitionBy("service_date").parquet(f"{root}/observations")
    shutil.copytree(f"{store}/static", f"{root}/static")
    args = ["rollup", "--store", root, "--date", "2026-09-15", "--as-of", "2026-09-16T15:00:00"]
    assert jobs.main(args) == 1
    assert "50.0% on 2026-09-15" in capsys.readouterr().err
    spark.createDataFrame([(date(2026, 9, 15), "known")], schemas.KNOWN_GAPS).write.parquet(f"{root}/known_gaps")
    assert jobs.main(args) == 0

    assert jobs.main(["diff", "--store", store, "--other", root, "--as-of", "2026-09-16T15:00:00"]) == 0
    assert "24" in capsys.readouterr().out


def test_summary_reports_problems(store, capsys):
    assert jobs.main(["summary", "--store", store, "--as-of", "2026-09-16T15:00:00"]) == 1
    assert "write_age" in capsys.readouterr().out


def test_evict_drops_only_weeks_that_are_rolled_up(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path / "s"))
    days = [date(2026, 1, 5) + timedelta(days=i) for i in range(21)]
    rows = spark.createDataFrame([(d, "80", "S") for d in days], "service_date date, route_id string, stop_id string")
    tables.write_observations(rows, store.path("observations"))
    daily = rows.filter("service_date <> date'2026-01-14'")
    daily.write.parquet(store.path("rollup_daily"))
    spark.createDataFrame([(date(2026, 1, 1),)], "month date").write.parquet(store.path("rollup_monthly"))
    assert jobs.evict_job(store, date(2026, 3, 1), 30) == ["2026-01-05", "2026-01-19"]
    assert sorted(r.service_date for r in store.read("observations").collect()) == days[7:14]
    assert jobs.evict_job(store, date(2026, 3, 1), 30) == []


def test_seeded_gaps_keep_what_is_set(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path / "s"))
    seed = tmp_path / "gaps.csv"
    seed.write_text("service_date,known_gap_reason\n2026-01-01,holiday\n2026-01-02,storm\n")
    jobs.seed_gaps_job(store, str(seed))
    seed.write_text("service_date,known_gap_reason\n2026-01-02,other\n2026-01-03,outage\n")
    jobs.seed_gaps_job(store, str(seed))
    assert sorted(tuple(r) for r in store.gaps().collect()) == [
        (date(2026, 1, 1), "holiday"), (date(2026, 1, 2), "storm"), (date(2026, 1, 3), "outage")]


def test_rollup_publishes_what_the_stream_has_folded(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path / "s"))
    days = [date(2026, 1, 5), date(2026, 1, 6)]
    old = spark.createDataFrame([(d, "80", "S") for d in days], "service_date date, route_id string, stop_id string")
    tables.write_observations(old, store.path("observations"))
    jobs.publish(store, days)  # no stream: nothing happens
    at = datetime(2026, 1, 6, 8)
    row = ("p", days[1], "T", 1, False, "81", "S", 8, 0, None, 0, 1, at, 0, None, at, at)
    polls.fold(spark.createDataFrame([row], schemas.PREDICTIONS), polls.Store(store.root), 0)
    jobs.publish(store, days)
    assert {(r.service_date, r.route_id) for r in store.read("observations").collect()} == {(days[0], "80"), (days[1], "81")}
