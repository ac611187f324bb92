from __future__ import annotations

import gzip
import json
import os
from datetime import date, datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from headwise.session import scratch_path, shared_dir
from headwise.sources import archive, gtfs, tables

FEED = {
    "feed_info": "feed_publisher_name,feed_version,feed_start_date,feed_end_date\nX,{version},20260824,20261205\n",
    "routes": "route_long_name,route_id,route_type\nMain Street,80,3\n,81,\nDuplicate,80,3\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon,zone\n1, Union South ,43.07,-89.40,z\n2,Park,,\n",
    "trips": "﻿route_id,trip_id,service_id,direction_id,trip_headsign\n80,T1,WK,0,North\n\n80,T2,WK,1,\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
    "WK,1,1,1,1,1,0,0,20260824,20261205\n",
    "calendar_dates": "service_id,date,exception_type\nWK,20260907,2\nSP,20260907,1\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,timepoint\n"
    "T1,8:50:00,08:51:00,1,1,1\nT1,25:10:00,25:10:00,2,2,0\nT1,09:00:00,09:00:00,2,2,1\nT2,,9:00:00,1,1,0\n",
}


def write_feed(folder, version="2026-08", **changes):
    folder.mkdir(exist_ok=True)
    for name, text in {**FEED, **changes}.items():
        (folder / f"{name}.txt").write_text(text.format(version=version), encoding="utf-8")
    return str(folder)


def test_columns_are_found_by_name(spark, tmp_path):
    rows = gtfs.read_csv(spark, write_feed(tmp_path / "g"), "trips").orderBy("trip_id").collect()
    assert [(r.route_id, r.trip_id, r.trip_headsign, r.block_id) for r in rows] == [
        ("80", "T1", "North", None), ("80", "T2", None, None)]


def test_typing(spark, tmp_path):
    feed = write_feed(tmp_path / "g")
    stops = {r.stop_id: r for r in gtfs.read_table(spark, feed, "stops").collect()}
    assert stops["1"].stop_name == "Union South" and stops["1"].stop_lat == 43.07
    assert stops["2"].stop_lat is None
    cal = gtfs.read_table(spark, feed, "calendar").first()
    assert cal.monday is True and cal.sunday is False and cal.end_date == date(2026, 12, 5)
    times = {(r.trip_id, r.stop_sequence): r for r in gtfs.read_table(spark, feed, "stop_times").collect()}
    assert times["T1", 1].arrival_s == 31800 and times["T1", 1].timepoint is True
    assert times["T2", 1].arrival_s is None  # blank, lenient
    with pytest.raises(PySparkException, match="invalid GTFS time"):
        gtfs.read_table(spark, feed, "stop_times", strict=True).collect()


def test_first_row_wins(spark, tmp_path):
    feed = write_feed(tmp_path / "g")
    assert {r.route_id: r.route_long_name for r in gtfs.read_table(spark, feed, "routes").collect()} == {
        "80": "Main Street", "81": None}
    second = gtfs.read_table(spark, feed, "stop_times").filter("trip_id = 'T1' and stop_sequence = 2").collect()
    assert [r.arrival_s for r in second] == [90600]


def test_first_row_wins_across_splits(spark, tmp_path):
    folder = tmp_path / "g"
    folder.mkdir()
    lines = "".join(f"K{i % 50},{i}\n" for i in range(20000))
    (folder / "routes.txt").write_text("route_id,route_long_name\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = gtfs.read_table(spark, str(folder), "routes").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.route_id: int(r.route_long_name) for r in rows} == {f"K{i}": i for i in range(50)}


def test_versioned_load(spark, tmp_path):
    store = str(tmp_path / "static")
    feed = write_feed(tmp_path / "g")
    first = gtfs.load_static(spark, feed, store)
    assert (first.feed_version_id, first.skipped) == (1, False)
    assert gtfs.load_static(spark, feed, store).skipped
    other = gtfs.load_static(spark, write_feed(tmp_path / "g2", version="2026-12"), store)
    assert other.feed_version_id == 2
    # Forcing reloads in place: the smaller timetable replaces the old one.
    slim = write_feed(tmp_path / "g", calendar_dates="service_id,date,exception_type\n")
    again = gtfs.load_static(spark, slim, store, force=True)
    assert (again.feed_version_id, again.skipped) == (1, False)
    counts = {r.feed_version_id: r["count"] for r in spark.read.parquet(f"{store}/calendar_dates").groupBy("feed_version_id").count().collect()}
    assert counts == {2: 2}
    assert gtfs.registry(spark, store).filter("load_completed_at is not null").count() == 2


def test_archive_round_trip_is_byte_exact(spark, tmp_path):
    payload = bytes.fromhex("001f8bff4100fe")
    rows = [
        ("trips", datetime(2026, 9, 15, 11, 59, 59, 123000), 200, None, 1, payload),
        ("trips", datetime(2026, 9, 15, 12, 0, 0), 200, None, 2, b""),
        ("alerts", datetime(2026, 9, 15, 11, 0, 0), 503, datetime(2026, 9, 15, 10, 0), 1, payload * 3),
    ]
    ddl = "feed string, fetched_at timestamp, http_status int, feed_timestamp timestamp, attempts int, payload binary"
    root = str(tmp_path / "a")
    archive.write_archive(spark.createDataFrame(rows, ddl), root)
    back = archive.read_archive(spark, root)
    got = sorted((r.feed, r.fetched_at, r.http_status, r.feed_timestamp, r.attempts, bytes(r.payload), r.payload_bytes) for r in back.collect())
    assert got == sorted((*r, len(r[5])) for r in rows)
    shards = {str(p.parent.relative_to(root)) for p in (tmp_path / "a").rglob("*.gz")}
    assert len(shards) == 3
    assert "shard_feed=trips/shard_date=2026-09-15/shard_hour=12" in shards


def test_foreign_shards_are_read(spark, tmp_path):
    folder = tmp_path / "trips" / "2026-09-15"
    folder.mkdir(parents=True)
    record = {
        "feed": "trips", "fetched_at": "2026-09-15T11:00:00.250Z", "http_status": 200, "feed_timestamp": None,
        "attempts": 1, "payload_bytes": 2, "payload_b64": "AP4=",
    }
    with gzip.open(folder / "2026-09-15T11.ndjson.gz", "wt") as f:
        f.write(json.dumps(record) + "\n")
    (folder / "2026-09-15T12.ndjson.gz.partial").write_bytes(b"\x1f\x8b broken")
    # A collector may have switched codec in the middle of the day.
    later = [record | {"fetched_at": f"2026-09-15T13:{m:02}:00Z"} for m in range(50)]
    with pa.CompressedOutputStream(str(folder / "2026-09-15T13.ndjson.br"), "brotli") as f:
        f.write("\n".join(map(json.dumps, later)).encode())
    want = [datetime(2026, 9, 15, 11, 0, 0, 250000), *(datetime(2026, 9, 15, 13, m) for m in range(50))]
    rows = archive.read_archive(spark, str(tmp_path)).collect()
    assert sorted((r.fetched_at, bytes(r.payload)) for r in rows) == [(t, b"\x00\xfe") for t in want]
    out = str(tmp_path / "out")
    stream = archive.stream_archive(spark, str(tmp_path / "trips")).writeStream.option("checkpointLocation", f"{out}/_c")
    stream.trigger(availableNow=True).format("parquet").start(f"{out}/polls").awaitTermination()
    assert sorted(r.fetched_at for r in spark.read.parquet(f"{out}/polls").collect()) == want
    whole = archive.read_archive(spark, str(tmp_path / "trips"))
    assert [tuple(r) for r in archive.verify_archive(whole, whole).collect()] == [("trips", 51, 51, 102, 0, True)]
    (r,) = archive.verify_archive(whole, whole.filter("minute(fetched_at) <> 49")).collect()
    assert (r.local_records, r.copy_records, r.verified) == (51, 50, False)


def test_manifest_of_files(spark, tmp_path):
    import hashlib

    day = tmp_path / "trips" / "2026-09-15"
    day.mkdir(parents=True)
    for name in ("2026-09-15T11.ndjson.gz", "2026-09-15T12.ndjson.br", "2026-09-15T13.ndjson.gz.partial", "odd.ndjson.gz", "notes.txt"):
        (day / name).write_bytes(name.encode())
    rows = {r.path: r for r in archive.shard_manifest(archive.shard_files(spark, str(tmp_path))).collect()}
    assert {p: (r.key, r.partial, r.recognised) for p, r in rows.items()} == {
        "trips/2026-09-15/2026-09-15T11.ndjson.gz": ("trips/2026/09/15/11.ndjson.gz", False, True),
        "trips/2026-09-15/2026-09-15T12.ndjson.br": ("trips/2026/09/15/12.ndjson.br", False, True),
        "trips/2026-09-15/2026-09-15T13.ndjson.gz.partial": ("trips/2026-09-15/2026-09-15T13.ndjson.gz.partial", True, True),
        "trips/2026-09-15/odd.ndjson.gz": (None, False, False),
    }
    one = rows["trips/2026-09-15/2026-09-15T11.ndjson.gz"]
    assert one.md5 == hashlib.md5(b"2026-09-15T11.ndjson.gz").hexdigest() and one.bytes == 23


def test_verify_archive(spark):
    def polls(rows):
        return spark.createDataFrame([("t", datetime(2026, 1, 1, 0, 0, s), p) for s, p in rows], "feed string, fetched_at timestamp, payload binary")

    same = archive.verify_archive(polls([(0, b"a"), (0, b"a"), (1, b"bc")]), polls([(1, b"bc"), (0, b"a"), (0, b"a")])).first()
    assert same.verified and same.payload_bytes_verified == 4 and same.local_records == 3
    lost = archive.verify_archive(polls([(0, b"a"), (0, b"a")]), polls([(0, b"a")])).first()
    assert not lost.verified


def test_one_partition_is_replaced_without_a_sort(spark, tmp_path):
    """a version known beforehand needs no sort by it, which held all rows of a task."""
    path = str(tmp_path / "t")
    for version, n in ((1, 5), (2, 3), (1, 4)):
        tables.replace_partition(spark.range(n), path, {"v": version})
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
        written = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and path in p]
        assert written and "Sort" not in written[-1]
    assert {(r.v, r["count"]) for r in spark.read.parquet(path).groupBy("v").count().collect()} == {(1, 4), (2, 3)}
    tables.replace_partition(spark.range(0), path, {"v": 1})
    assert {r.v for r in spark.read.parquet(path).collect()} == {2}


def test_replace_partitions_removes_emptied_periods(spark, tmp_path):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "d string, x int")
    tables.replace_partitions(both, path, ["d"])
    tables.replace_partitions(both.filter("d = '2026-01-02'").withColumn("x", F.lit(9)), path, ["d"], emptied=[{"d": "2026-01-01"}, {"d": "2026-01-02"}])
    assert [tuple(r) for r in spark.read.parquet(path).select("d", "x").collect()] == [(date(2026, 1, 2), 9)]
    tables.replace_partitions(both.filter("false"), path, ["d"], emptied=[{"d": "2026-01-02"}])
    assert not list((tmp_path / "t").glob("d=*"))


def test_swap_keeps_old_until_done(spark, tmp_path):
    path = str(tmp_path / "s")
    made = lambda n: spark.createDataFrame([("a", n)], "stop_id string, n int")
    for n in range(1, 5):  # all within a second or two: numbers decide, not the clock
        reader = tables.current(spark, path) if n > 1 else None
        tables.swap(made(n), path, "t")
        assert tables.current(spark, path).first().n == n and len(tables.names(spark, path)) == min(n, 2)
        assert reader is None or reader.first().n == n - 1  # one that began before goes on
    # A writer that died has a higher number and no mark: not current, and gone after the next swap but one.
    os.makedirs(f"{path}/00000009-t")
    assert tables.current(spark, path).first().n == 4
    tables.swap(made(5), path, "t")
    assert tables.current(spark, path).first().n == 5 and sorted(n[:8] for n in tables.names(spark, path)) == ["00000004", "00000010"]
    tables.swap(spark.createDataFrame([(1,)], "x int"), path, "t", sort=[], keep=1)
    assert tables.names(spark, path) == ["00000011-t"]


def test_shards_get_the_archive_names(spark, tmp_path):
    at = datetime(2026, 9, 15, 23, 30)
    polls = [("trips", at + timedelta(minutes=20 * i), 200, None, 1, bytearray([i, 255])) for i in range(5)] + [("alerts", at, 200, None, 1, None)]
    ddl = "feed string, fetched_at timestamp, http_status int, feed_timestamp timestamp, attempts int, payload binary"
    df = spark.createDataFrame(polls, ddl)
    for root in ("a", "b"):
        archive.write_shards(df.repartition(3), str(tmp_path / root))
    files = [archive.shard_manifest(archive.shard_files(spark, str(tmp_path / root))).drop("modified_at") for root in ("a", "b")]
    assert {(r.key, r.partial) for r in files[0].collect()} == {
        ("trips/2026/09/15/23.ndjson.gz", False), ("trips/2026/09/16/00.ndjson.gz", False),
        ("alerts/2026/09/15/23.ndjson.gz", False)}
    assert sorted(files[0].collect()) == sorted(files[1].collect())  # equal polls, equal bytes
    back = archive.read_archive(spark, str(tmp_path / "a")).select("feed", "fetched_at", "payload")
    assert sorted((r.feed, r.fetched_at, r.payload) for r in back.collect()) == sorted((f, t, p) for f, t, _, _, _, p in polls)


def test_prune_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [("t", datetime(2026, 1, d, h)) for d in range(1, 6) for h in (0, 18)]
    tables.append_runs(spark.createDataFrame(rows, "feed string, started_at timestamp"), path)
    tables.prune_runs(spark, path, F.lit("2026-01-06 12:00:00").cast("timestamp"), 3)
    kept = sorted(r.started_at for r in spark.read.parquet(path).collect())
    assert kept == [datetime(2026, 1, 3, 18), *[datetime(2026, 1, d, h) for d in (4, 5) for h in (0, 18)]]


class FakeSession:
    """Only what the folder lookup asks of a session."""

    def __init__(self, named=None, master="local[2]"):
        self.named, self.made = named, None
        self.conf = self.sparkContext = self
        self.master = master

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named or default

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path


def test_shared_dir_follows_the_session():
    named = FakeSession("/shared/work")
    assert shared_dir(named) == "/shared/work" and named.made is None
    assert scratch_path(named, "x").startswith("/shared/work/x-")
    unset = FakeSession()
    assert shared_dir(unset) == unset.made == shared_dir(unset)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(FakeSession(master="spark://host:7077"))
