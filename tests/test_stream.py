from __future__ import annotations

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headwise import schemas
from headwise.operators import collapse, flatten, match
from headwise.plans import standins
from headwise.sources import archive, tables
from headwise.streaming import polls
from headwise.streaming.runs import Run

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def nested(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feeds"))
    standins.feeds(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_stream_equals_batch_and_survives_replay(spark, nested, tmp_path):
    payloads = standins.encode_feeds(nested)
    middle = payloads.agg(F.percentile_approx("fetched_at", 0.5)).first()[0]
    root, store = str(tmp_path / "archive"), polls.Store(str(tmp_path / "store"))
    timetable = standins.probe_timetable(spark)

    def drain():
        polls.ingest(spark, root, store, timetable, standins.TZ, max_files=10).awaitTermination()

    # Late half first, then the early half with the late one replayed.
    archive.write_archive(payloads.filter(F.col("fetched_at") >= middle), root)
    drain()
    archive.write_archive(payloads, root)
    drain()

    expected = collapse.collapse(match.predictions(flatten.trip_updates(nested), timetable, standins.TZ))
    got = polls.observations(spark, store).select(*expected.columns)
    assert got.count() == expected.count() > 100
    assert got.exceptAll(expected).count() == 0
    assert spark.read.parquet(store.path("polls")).count() == nested.count()
    metrics = spark.read.parquet(store.path("metrics"))
    assert polls.live_status(metrics).first().total_rows == expected.count()
    runs = spark.read.parquet(store.path("ingest_runs")).agg(
        F.count_if("ok").alias("good"), F.sum("rows_written").alias("written"), F.sum("rows_changed").alias("changed"), F.max("feed_age_s").alias("age")
    ).first()
    assert (runs.good, runs.changed, runs.age) == (nested.count(), expected.count(), 0)
    assert runs.written == got.agg(F.sum("poll_count")).first()[0]


def test_batches_out_of_order_touch_no_earlier_batch(spark, nested, tmp_path):
    store = polls.Store(str(tmp_path / "store"))
    payloads = standins.encode_feeds(nested).withColumn("part", F.crc32(F.col("fetched_at").cast("string").cast("binary")) % 5)
    timetable = standins.probe_timetable(spark)
    for n, part in enumerate([4, 1, 3, 0, 2]):
        polls.ingest_batch(payloads.filter(F.col("part") == part).drop("part"), n, store, timetable, standins.TZ)
        assert not tables.exists(spark, store.path("predictions"))
    polls.ingest_batch(payloads.drop("part"), 5, store, timetable, standins.TZ)  # all of them again
    expected = collapse.collapse(match.predictions(flatten.trip_updates(nested), timetable, standins.TZ))
    got = polls.observations(spark, store).select(*expected.columns)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
    # What a batch plans to read of the states is the keys of its own days, and its own rows.
    plan = polls.new_visits(spark, store, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("ReadSchema: struct<trip_id:string,stop_sequence:int,is_modified:boolean>") == 1


def _states(spark, rows):
    ddl = schemas.PREDICTIONS
    return collapse.states(spark.createDataFrame(rows, ddl))


def _prediction(minute, arrival, poll="p", fetched=None, trip="T1"):
    at = datetime(2026, 9, 15, 12) + timedelta(minutes=minute)
    later = at if fetched is None else datetime(2026, 9, 15, 12) + timedelta(minutes=fetched)
    return (f"{poll}{minute}-{fetched}", date(2026, 9, 15), trip, 5, False, "80", "S", 12, 0, None, 0, 1, datetime(2026, 9, 15, 13) + timedelta(seconds=arrival), 0, None, at, later)


def test_states_merge_in_any_order_and_grouping(spark):
    rows = [_prediction(m, a, fetched=f) for m, a, f in [
        (0, 100, None), (1, 100, None), (2, 130, None), (2, 100, 3), (4, 130, None), (59, 130, None), (60, 140, None), (61, 140, None), (200, 100, None), (200, 100, 201)]]
    rows += [_prediction(m, m % 3, trip="T2") for m in range(0, 300, 7)]
    want = collapse.collapse(spark.createDataFrame(rows, schemas.PREDICTIONS))
    whole = collapse.visits(_states(spark, rows)).select(*want.columns)
    assert sorted(whole.collect()) == sorted(want.collect())
    for seed in range(3):
        rng = random.Random(seed)
        parts = [_states(spark, rng.sample(rows, 12)) for _ in range(3)] + [_states(spark, rows[i::2]) for i in (1, 0)]
        early = collapse.merged(parts[0].union(parts[3]))
        got = collapse.visits(early.union(parts[1]).union(parts[4]).union(parts[2])).select(*want.columns)
        assert sorted(got.collect()) == sorted(want.collect())


def test_compaction_bounds_the_runs_of_a_day(spark, tmp_path):
    store = polls.Store(str(tmp_path / "store"))
    rows = [_prediction(m, m % 4) for m in range(40)]
    schema = polls.state_schema(spark)
    for n in range(20):
        polls.fold(spark.createDataFrame(rows[2 * n : 2 * n + 2], schemas.PREDICTIONS), store, n)
        store.states.compact(spark, schema, n, fanout=3)
        # A repeated batch replaces its own run and no other.
        if n % 5 == 0:
            polls.fold(spark.createDataFrame(rows[2 * n : 2 * n + 2], schemas.PREDICTIONS), store, n)
    runs = store.states.runs(spark)
    assert max(r.tier for r in runs) == 2 and len(runs) <= 2 * 3 + 1 and sum(r.last - r.first + 1 for r in runs) == 20
    want = collapse.collapse(spark.createDataFrame(rows, schemas.PREDICTIONS))
    assert polls.observations(spark, store).select(*want.columns).collect() == want.collect()
    # A merge that has written its run and not yet removed the others, and one that never ended.
    store.states.put(store.states.read(spark, schema, runs), Run(5, 0, 19))
    os.makedirs(f"{store.states.path}/run=6-0-19/service_date=2026-09-15")
    assert store.states.runs(spark) == [Run(5, 0, 19)]
    assert polls.observations(spark, store).first().poll_count == 40
    store.states.forget(spark, [date(2026, 9, 15)])
    assert polls.observations(spark, store).isEmpty()


def test_published_days_follow_the_states(spark, tmp_path):
    store = polls.Store(str(tmp_path / "store"))
    polls.fold(spark.createDataFrame([_prediction(0, 1)], schemas.PREDICTIONS), store, 0)
    for n, minute in enumerate((5, 3), 1):
        polls.fold(spark.createDataFrame([_prediction(minute, n)], schemas.PREDICTIONS), store, n)
        polls.publish(spark, store, [date(2026, 9, 15), date(2026, 9, 16)])
        assert spark.read.parquet(store.path("observations")).first().poll_count == n + 1
    store.states.forget(spark, [date(2026, 9, 15)])
    polls.publish(spark, store, [date(2026, 9, 15)])
    assert spark.read.schema("n int").parquet(store.path("observations")).isEmpty()


def test_status_goes_on_after_a_restart(spark, nested, tmp_path):
    store = polls.Store(str(tmp_path / "store"))
    payloads, timetable = standins.encode_feeds(nested), standins.probe_timetable(spark)
    half = payloads.agg(F.percentile_approx("fetched_at", 0.5)).first()[0]
    polls.ingest_batch(payloads.filter(F.col("fetched_at") < half), 0, store, timetable, standins.TZ)
    assert polls.current_status(spark, store).isEmpty()
    polls.follow_status(spark, store, 50, interval=None).awaitTermination()
    first = polls.current_status(spark, store).first()
    polls.ingest_batch(payloads.filter(F.col("fetched_at") >= half), 1, store, timetable, standins.TZ)
    for _ in range(2):  # the second time the ingestion repeats its newest batch under new file names
        polls.follow_status(spark, store, 0, interval=None).awaitTermination()
        last = polls.current_status(spark, store).first()
        n = polls.observations(spark, store).count()
        assert last.total_rows == 50 + n > first.total_rows and last.last_poll_at > first.last_poll_at
        assert last == polls.live_status(spark.read.parquet(store.path("metrics")), seed_total=50).first()
        metrics = spark.read.parquet(store.path("metrics")).filter("batch = 1")
        tables.replace_partitions(spark.createDataFrame(metrics.collect(), metrics.schema), store.path("metrics"), ["batch"])
    # One row a trigger; the last two are kept.
    assert len([x for x in tables.names(spark, store.path("live_status")) if x.startswith("batch=")]) == 2


def test_repeating_a_batch_changes_nothing(spark, nested, tmp_path):
    store = polls.Store(str(tmp_path / "store"))
    batch = standins.encode_feeds(nested)
    timetable = standins.probe_timetable(spark)
    counts = []
    for _ in range(2):
        polls.ingest_batch(batch, 0, store, timetable, standins.TZ)
        counts.append(polls.observations(spark, store).agg(F.sum("poll_count"), F.count("*")).first())
    assert counts[0] == counts[1]
    # The same polls in a later batch are known already.
    polls.ingest_batch(batch, 1, store, timetable, standins.TZ)
    assert polls.observations(spark, store).agg(F.sum("poll_count"), F.count("*")).first() == counts[0]
    assert store.states.read(spark, polls.state_schema(spark), [Run(0, 1, 1)]).isEmpty()


def test_a_repeated_batch_under_another_timetable_leaves_nothing_behind(spark, nested, tmp_path):
    store = polls.Store(str(tmp_path / "store"))
    batch = standins.encode_feeds(nested)
    none = standins.probe_timetable(spark)
    none = match.Timetable(none.versions, none.trips.limit(0), none.stop_times.limit(0), none.services.limit(0))
    polls.ingest_batch(batch, 0, store, none, standins.TZ)
    polls.ingest_batch(batch, 0, store, standins.probe_timetable(spark), standins.TZ)
    want = collapse.collapse(match.predictions(flatten.trip_updates(nested), standins.probe_timetable(spark), standins.TZ))
    assert polls.observations(spark, store).select(*want.columns).exceptAll(want).isEmpty()


def test_bad_payloads_do_not_stop_the_stream(spark, nested, tmp_path):
    store = polls.Store(str(tmp_path / "store"))
    one = standins.encode_feeds(nested)
    broken = one.withColumn("payload", F.lit(b"\xff\xff")).withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 1 millisecond"))
    # Other feeds are recorded and left undecoded, whatever their payload and header time.
    alerts = one.withColumn("feed", F.lit("alerts"))
    polls.ingest_batch(one.unionAll(broken).unionAll(alerts), 0, store, lambda: standins.probe_timetable(spark), standins.TZ)
    assert spark.read.parquet(store.path("quarantine")).count() == nested.count()
    runs = spark.read.parquet(store.path("ingest_runs"))
    assert {(r.feed, r.ok): r["count"] for r in runs.groupBy("feed", "ok").count().collect()} == {
        ("trips", True): nested.count(), ("trips", False): nested.count(), ("alerts", True): nested.count()}
    changed = {r.feed: r.n for r in runs.groupBy("feed").agg(F.sum("rows_changed").alias("n")).collect()}
    assert changed == {"trips": polls.observations(spark, store).count(), "alerts": None}
    assert polls.observations(spark, store).count() > 100


def test_followed_visits_take_late_rows_and_ties(spark, tmp_path):
    rows = [_prediction(m, a, fetched=f) for m, a, f in [(0, 100, None), (10, 100, None), (20, 160, None), (20, 150, 21), (70, 160, None), (80, 150, None), (130, 150, None), (140, 200, None)]]
    source, store = str(tmp_path / "in"), polls.Store(str(tmp_path / "out"))
    late = [_prediction(-3 * 1440, 90), _prediction(15, 170)]  # days before the rest; between two of them
    for part in (rows[5:], rows[:2], rows[2:5], late):
        spark.createDataFrame(part, schemas.PREDICTIONS).coalesce(1).write.mode("append").parquet(source)
        polls.follow_visits(spark.readStream.schema(schemas.PREDICTIONS).parquet(source), store).awaitTermination()
    want = collapse.collapse(spark.createDataFrame(rows + late, schemas.PREDICTIONS))
    got = polls.observations(spark, store).select(*want.columns)
    assert got.collect() == want.collect() and (got.first().poll_count, got.first().change_count) == (10, 7)


def test_poll_health_on_a_table(spark):
    rows = [("t", datetime(2026, 1, 1, 5, m), m != 7, 10) for m in range(0, 60, 7)] + [("t", datetime(2026, 1, 1, 6, 0), True, 1)]
    got = polls.poll_health(spark.createDataFrame(rows, "feed string, started_at timestamp, ok boolean, payload_bytes int"))
    assert sorted((r.hour.hour, r.polls, r.fails, r.payload_bytes) for r in got.collect()) == [(5, 9, 1, 90), (6, 1, 0, 1)]
