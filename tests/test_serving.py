from __future__ import annotations

import json
import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headwise.operators import coverage, health, lifecycle, lookup, quality, rollup, serving
from headwise.plans import documents

OBS = (
    "service_date date, route_id string, stop_id string, scheduled_hour_local int, day_type int, "
    "scheduled_source int, schedule_relationship int, delay_seconds int"
)


def cells(spark, hours, stop="S", route="80", day=0):
    rows = [(stop, route, h, day, n, n * 60, n * 3600 + n, n // 2, 0, 0, -5, 200, 50, 90, 1, 60.0, 1.0, 50.0) for h, n in hours]
    return spark.createDataFrame(rows, (
        "stop_id string, route_id string, hour_of_day int, day_type int, n bigint, sum_delay bigint, sum_delay_sq bigint, n_late_240 bigint, "
        "n_late_300 bigint, n_early_60 bigint, min_delay int, max_delay int, p50_delay_approx int, p90_delay_approx int, service_days int, "
        "mean_delay double, stddev_delay double, pct_late_240 double"))


def widened(spark, hour, *groups):
    df = groups[0]
    for g in groups[1:]:
        df = df.unionAll(g)
    rows = serving.widened(df).filter((F.col("hour_of_day") == hour) & (F.col("stop_id") == "S") & (F.col("day_type") == 0) & (F.col("route_id") == "80"))
    return rows.first().fallback


def test_widening_scopes(spark):
    assert widened(spark, 8, cells(spark, [(7, 4), (8, 11), (9, 2)])).scope == "exact"
    band = widened(spark, 8, cells(spark, [(7, 8), (8, 4), (9, 2)]))
    assert (band.scope, band.n, list(band.hours)) == ("band", 14, [7, 8, 9])
    day = widened(spark, 8, cells(spark, [(8, 2), (12, 2), (20, 1)]))
    assert (day.scope, day.n, list(day.hours)) == ("allday", 5, [8, 12, 20])
    assert widened(spark, 8, cells(spark, [(8, 2), (12, 2)])) is None


def test_widening_stays_within_its_group(spark):
    lone = cells(spark, [(8, 4)])
    others = [cells(spark, [(8, 50)], route="81"), cells(spark, [(8, 50)], day=1), cells(spark, [(8, 50)], stop="T")]
    assert widened(spark, 8, lone, *others) is None


def test_widening_does_not_wrap_midnight(spark):
    late = widened(spark, 0, cells(spark, [(0, 4), (1, 5), (23, 70)]))
    assert (late.scope, late.n, list(late.hours)) == ("band", 9, [0, 1])


def observation(delay, day=1, hour=8, stop="S", source=1, rel=0, kind=0):
    return (date(2026, 9, day), "80", stop, hour, kind, source, rel, delay)


def test_rollup_measures(spark):
    delays = [-61, -60, -59, 0, 239, 240, 300, 301]
    noise = [observation(7200), observation(5, source=2), observation(5, rel=1), observation(None), observation(5, hour=None), observation(5, kind=None)]
    (r,) = rollup.rollup_daily(spark.createDataFrame([observation(d) for d in delays] + noise, OBS)).collect()
    assert (r.n, r.sum_delay, r.sum_delay_sq) == (8, sum(delays), sum(d * d for d in delays))
    assert (r.min_delay, r.max_delay, r.n_late_240, r.n_late_300, r.n_early_60) == (-61, 301, 3, 2, 2)
    assert (r.p50_delay, r.p90_delay) == (120, 300)  # 119.5 to even; 300.3


@pytest.mark.parametrize(("values", "p50"), [([0, 1], 0), ([1, 2], 2), ([-1, 0], 0), ([-3, -2], -2), ([5], 5)])
def test_median_rounds_half_to_even(spark, values, p50):
    assert rollup.rollup_daily(spark.createDataFrame([observation(d) for d in values], OBS)).first().p50_delay == p50


def test_monthly_equals_pooled_raw(spark):
    rows = [observation(d * 10, day=d) for d in range(1, 29)] + [(date(2026, 10, 1), "80", "S", 8, 0, 1, 0, 9)]
    obs = spark.createDataFrame(rows, OBS)
    months = {str(r.month): r for r in rollup.rollup_monthly(obs).collect()}
    assert months["2026-09-01"].n == 28 and months["2026-09-01"].p50_delay == 145 and months["2026-10-01"].n == 1
    assert [str(r.month) for r in rollup.rollup_monthly(obs, ["2026-10"]).collect()] == ["2026-10-01"]
    assert rollup.rollup_daily(obs, ["2026-09-03"]).first().sum_delay == 30


def test_combine_is_exact(spark):
    rng = random.Random(3)
    delays = [(rng.randrange(1, 29), rng.randrange(-900, 3000)) for _ in range(500)]
    daily = rollup.rollup_daily(spark.createDataFrame([observation(x, day=d) for d, x in delays], OBS))
    r = rollup.combine(daily, ["route_id"]).first()
    xs = [x for _, x in delays]
    mean = sum(xs) / len(xs)
    assert r.mean_delay == pytest.approx(mean)
    assert r.stddev_delay == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs)))


def no_gaps(spark, *rows):
    return spark.createDataFrame(list(rows), "service_date date, known_gap_reason string")


def test_serving_window_and_gaps(spark):
    obs = spark.createDataFrame([observation(60, day=d) for d in range(1, 11)], OBS)
    daily = rollup.rollup_daily(obs)
    assert rollup.serving_stats(daily, no_gaps(spark)).first().n == 10
    gap = no_gaps(spark, (date(2026, 9, 5), "storm"), (date(2026, 9, 6), None))
    assert rollup.serving_stats(daily, gap).first().service_days == 9
    # The cutoff day itself is inside.
    assert rollup.serving_stats(daily, no_gaps(spark), F.lit(date(2026, 9, 11)), 3).first().service_days == 3


def test_pooled_window_passes_single_hours_through(spark):
    one = serving.pooled_windows(cells(spark, [(8, 10)])).first()
    assert (one.window, one.n, one.stddev_delay, one.hours) == ("morning", 10, 1.0, 1)
    two = serving.pooled_windows(cells(spark, [(7, 10), (9, 4), (12, 99)])).first()
    assert (two.n, two.n_late_240, two.hours) == (14, 7, 2)
    assert two.stddev_delay == pytest.approx(math.sqrt((9 + 3) / 12))


def totals(spark, rows, route="R"):
    return spark.createDataFrame([(route, s, n, float(m), late, 100.0 * late / n) for s, n, m, late in rows],
                                 "route_id string, stop_id string, n bigint, mean_delay double, n_late_240 bigint, pct_late_240 double")


def positions(spark, rows, route="R"):
    top = max(p for _, p in rows)
    return spark.createDataFrame([(route, s, p, top) for s, p in rows], "route_id string, stop_id string, seq int, max_seq int")


def test_flags_compare_with_the_trend(spark):
    rows = [(f"s{i}", 30, 10 * i, i) for i in range(1, 10)] + [("odd", 30, 300, 9), ("thin", 19, 999, 19)]
    places = [(f"s{i}", i) for i in range(1, 10)] + [("odd", 5), ("thin", 6)]
    got = {r.stop_id: r for r in serving.flagged_stops(totals(spark, rows), positions(spark, places)).collect()}
    assert "thin" not in got
    assert {s for s, r in got.items() if r.flagged} == {"odd"}


def test_few_points_leave_a_zero_line(spark):
    # Three points: no fit, so residuals are the means themselves.
    rows = [("a", 30, 10, 1), ("b", 30, 10, 1), ("c", 30, 60, 1)]
    got = {r.stop_id: r for r in serving.flagged_stops(totals(spark, rows), positions(spark, [("a", 1), ("b", 2), ("c", 3)])).collect()}
    assert (got["c"].slope, got["c"].intercept, got["c"].residual) == (0.0, 0.0, 60.0)
    assert {s for s, r in got.items() if r.flagged} == {"c"}


def test_flat_positions_give_a_flat_line(spark):
    rows = [(s, 30, m, 1) for s, m in (("a", 10), ("b", 20), ("c", 30), ("d", 40))]
    r = serving.position_trend(serving.ranked_candidates(totals(spark, rows), positions(spark, [(s, 4) for s in "abcd"]))).first()
    assert (r.slope, r.intercept) == (0.0, 25.0)


def test_best_and_worst_share_one_order(spark):
    ranked = serving.best_and_worst(totals(spark, [(f"s{i}", 100, 1, i // 2) for i in range(8)]))
    lists = {}
    for r in sorted(ranked.collect(), key=lambda r: r.rank):
        lists.setdefault(r.list, []).append(r.stop_id)
    assert lists == {"best": ["s0", "s1", "s2", "s3", "s4"], "worst": ["s7", "s6", "s5", "s4", "s3"]}


# -- coverage -----------------------------------------------------------------------------


def covered(spark, rows):
    return spark.createDataFrame(rows, "service_date date, scheduled_stop_events bigint, observed_stop_events bigint, coverage_pct double, known_gap_reason string")


def test_coverage_counts(spark):
    static = dict(
        versions=spark.sql("select 1 as feed_version_id, date'2026-01-01' as feed_start_date, date'2026-12-31' as feed_end_date, timestamp'2026-01-01' as loaded_at, timestamp'2026-01-01' as load_completed_at"),
        trips=spark.createDataFrame([(1, "T1", "WK"), (1, "T2", "WK"), (1, "T3", "SP")], "feed_version_id int, trip_id string, service_id string"),
        stop_times=spark.createDataFrame([(1, t, s) for t in ("T1", "T2", "T3") for s in (1, 2)], "feed_version_id int, trip_id string, stop_sequence int"),
        services=spark.createDataFrame([(1, "WK", date(2026, 9, 1)), (1, "WK", date(2026, 9, 2))], "feed_version_id int, service_id string, date date"),
    )
    obs = [(date(2026, 9, 1), "T1", 1, m) for m in (True, False)] + [  # a modified twin counts once
        (date(2026, 9, 1), "T1", 9, False), (date(2026, 9, 1), "T3", 1, False),  # not scheduled that day
        (date(2026, 9, 2), "T1", 1, False), (date(2026, 9, 2), "T2", 2, False), (date(2026, 9, 2), "T1", 2, False),
        (date(2026, 9, 3), "T1", 1, False), (date(2026, 9, 9), "T1", 1, False)]
    observations = spark.createDataFrame(obs, "service_date date, trip_id string, stop_sequence int, is_modified boolean")
    gaps = no_gaps(spark, (date(2026, 9, 2), "storm"), (date(2026, 8, 1), "before"))
    for policy in ("latest", "in_effect"):
        got = coverage.day_coverage(observations, gaps=gaps, as_of=F.lit(date(2026, 9, 9)), policy=policy, **static)
        assert {str(r.service_date): (r.scheduled_stop_events, r.observed_stop_events, r.coverage_pct, r.known_gap_reason) for r in got.collect()} == {
            "2026-09-01": (4, 1, 25.0, None), "2026-09-02": (4, 3, 75.0, "storm"), "2026-09-03": (0, 0, 0.0, None), "2026-08-01": (0, 0, 0.0, "before")}


def test_alert_and_snapshot(spark):
    cov = covered(spark, [(date(2026, 9, 1), 100, 95, 95.0, None), (date(2026, 9, 2), 100, 50, 50.0, None), (date(2026, 9, 3), 100, 50, 50.0, "x"), (date(2026, 9, 4), 100, 99, 99.0, None)])
    assert coverage.coverage_alerts(cov, F.lit(date(2026, 9, 2))).count() == 1
    assert coverage.coverage_alerts(cov, F.lit(date(2026, 9, 3))).count() == 0
    daily = rollup.rollup_daily(spark.createDataFrame([observation(300 if d == 1 else 0, day=d) for d in (1, 2, 3)], OBS))
    day = serving.snapshot_day(daily, cov, F.lit(date(2026, 9, 9)))
    assert str(day.first().service_date) == "2026-09-01"  # the 4th has no data
    snap = serving.snapshot(daily, day).first()
    assert (snap.n, snap.pct_late, snap.on_time_pct) == (1, 100.0, 0.0)
    assert serving.snapshot_day(daily, cov, F.lit(date(2026, 9, 1))).count() == 0


def test_merge_gaps(spark):
    have = no_gaps(spark, (date(2026, 9, 1), "ours"), (date(2026, 9, 2), None))
    seed = no_gaps(spark, (date(2026, 9, 1), "seed"), (date(2026, 9, 2), "seed"), (date(2026, 9, 3), "seed"))
    assert sorted((r.service_date.day, r.known_gap_reason) for r in coverage.merge_gaps(have, seed).collect()) == [(1, "ours"), (2, "seed"), (3, "seed")]


# -- lookups --------------------------------------------------------------------------------


def brute_nearest(point, stops, k):
    _, la, lo = point
    def km(s):
        x = (s[2] - lo) * math.cos(math.radians((la + s[1]) / 2))
        return math.sqrt(x * x + (s[1] - la) ** 2) * 111.32
    return [s[0] for s in sorted(stops, key=lambda s: (round(km(s), 9), s[0]))[:k]]


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    stops = [(f"s{i:04d}", 43 + rng.gauss(0, 0.05), -89.4 + rng.gauss(0, 0.07)) for i in range(300)]
    stops += [(f"t{i:04d}", 43.01, -89.41) for i in range(40)]  # many at one place
    stops += [(f"u{i}", 70 + rng.random(), 25 + rng.random()) for i in range(15)]  # far north
    points = [(i, 43 + rng.gauss(0, 0.2), -89.4 + rng.gauss(0, 0.2)) for i in range(40)]
    points += [(100, 43.01, -89.41), (101, 70.4, 25.5), (102, -33.0, 151.0), (103, 89.99, 0.0), (104, 0.0, 179.9)]
    got = {}
    rows = lookup.nearest_stops(
        spark.createDataFrame(points, "point_id int, lat double, lon double"),
        spark.createDataFrame([*stops, ("none", None, None)], "stop_id string, stop_lat double, stop_lon double"))
    for r in sorted(rows.collect(), key=lambda r: r.rank):
        got.setdefault(r.point_id, []).append(r.stop_id)
    for p in points:
        assert got[p[0]] == brute_nearest(p, stops, 10), p


def test_far_riders_meet_few_stops(spark):
    rng = random.Random(9)
    stops = spark.createDataFrame([(f"s{i:04d}", 43 + rng.gauss(0, 0.05), -89.4 + rng.gauss(0, 0.07)) for i in range(500)], "stop_id string, stop_lat double, stop_lon double")
    far = spark.createDataFrame([(i, rng.uniform(-80, 80), rng.uniform(-179, 179)) for i in range(200)], "point_id int, lat double, lon double")
    met = lookup.candidate_stops(far, stops, 10).groupBy("point_id").count().agg(F.count("*").alias("riders"), F.avg("count").alias("mean"), F.max("count").alias("most")).first()
    assert met.riders == 200 and met.mean <= 100 and met.most <= 200


def test_points_at_one_place_share_a_search(spark, monkeypatch):
    """windows hold places, so they do not grow with the points that stand at one."""
    searched = []
    plain = lookup.candidate_stops
    monkeypatch.setattr(lookup, "candidate_stops", lambda points, *rest: plain(searched.append(points) or points, *rest))
    points = spark.range(300).selectExpr("id as point_id", "43.0 + id % 3 as lat", "double(-89) as lon")
    stops = spark.range(40).selectExpr("string(id) as stop_id", "43.0 + id / 10.0 as stop_lat", "double(-89) as stop_lon")
    rows = lookup.nearest_stops(points.selectExpr("point_id", "double(lat) lat", "lon"), stops.selectExpr("stop_id", "double(stop_lat) stop_lat", "stop_lon"), 4)
    assert rows.count() == 1200 and rows.columns == ["point_id", "stop_id", "km", "rank"]
    near = rows.filter("rank = 1").selectExpr("point_id % 3 as third", "int(stop_id) as stop").distinct().collect()
    assert {(r.third, r.stop) for r in near} == {(0, 0), (1, 10), (2, 20)}
    assert searched[0].count() == 3


def test_search_reads_one_index_for_all_batches(spark, tmp_path):
    rng = random.Random(4)
    syllables = ["uni", "ver", "bay", "st", "a", "mall", "o", "north", "é"]
    stops = [(f"{i}", " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(3)), [], [str(rng.randint(1, 99))], rng.randint(0, 50), rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(stops, "stop_id string, stop_name string, headsigns array<string>, routes array<string>, n int, usable boolean")
    index = lookup.write_index(lookup.stop_entries(df), str(tmp_path / "index"))
    asked = ["bay", "bay mall", "a", "o st", "1", "BAYST", "verver", "zzz", "é", "north 7", "uni uni", "universty"]
    for batch in (asked[:6], asked[6:]):
        queries = spark.createDataFrame(list(enumerate(batch)), "query_id int, query string")
        got = {}
        for r in sorted(lookup.search_stops(queries, df, 8, 1, index=lookup.read_index(spark, str(tmp_path / "index"))).collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append(r.id)
        for i, q in enumerate(batch):
            hits = [s for s in stops if all(t in f"{s[1]}  {s[3][0]}".lower() for t in q.lower().split())]
            assert got.get(i, []) == [s[0] for s in sorted(hits, key=lambda s: (not s[5], -s[4], s[0]))[:8]], q
    assert index.postings.filter(F.length("gram") < 3).isEmpty()


def test_nearest_with_few_stops(spark):
    rows = lookup.nearest_stops(spark.createDataFrame([(1, 0.0, 0.0)], "point_id int, lat double, lon double"),
                                spark.createDataFrame([("a", 50.0, 9.0), ("b", 1.0, 1.0)], "stop_id string, stop_lat double, stop_lon double"))
    assert [r.stop_id for r in sorted(rows.collect(), key=lambda r: r.rank)] == ["b", "a"]


def test_search(spark):
    stops = spark.createDataFrame(
        [("1", "University at University Bay", ["North"], ["80", "81"], 50, True), ("2", "Union South", ["Mall"], ["80"], 10, True),
         ("3", "Bay View", [], ["2"], 900, False), ("4", "Baymont", ["Union"], ["5"], 70, True)],
        "stop_id string, stop_name string, headsigns array<string>, routes array<string>, n int, usable boolean")
    asked = {0: "bay", 1: "UNION  south", 2: "x", 3: "80", 4: "zzzz", 5: " union ba ", 6: "so"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    got = {}
    for r in sorted(lookup.search_stops(queries, stops).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {0: ["4", "1", "3"], 1: ["2"], 3: ["1", "2"], 5: ["4"], 6: ["2"]}
    routes = spark.createDataFrame([("8", "Eighth", 5, True), ("80", None, 9, False), ("18", "Main 8", 2, True)], "route_id string, route_name string, n int, usable boolean")
    hits = sorted(lookup.search_routes(spark.createDataFrame([(0, "8")], "query_id int, query string"), routes, limit=2).collect(), key=lambda r: r.rank)
    assert [r.id for r in hits] == ["8", "18"]


# -- quality ----------------------------------------------------------------------------------


def side(spark, rows):
    key = (date(2026, 9, 15), "T")
    return spark.createDataFrame([(*key, s, False, at and datetime(2026, 9, 15, 12, 0, at % 60), d, 1, "80", stop) for s, at, d, stop in rows],
                                 "service_date date, trip_id string, stop_sequence int, is_modified boolean, observed_arrival timestamp, delay_seconds int, scheduled_source int, route_id string, stop_id string")


def test_diff_rules(spark):
    a = side(spark, [(1, 10, 10, "S"), (2, 10, 10, "S"), (3, 10, 10, "S"), (4, None, None, "S"), (5, None, 0, "S"), (6, 1, 1, "S"), (8, 5, None, "S")])
    b = side(spark, [(1, 10, 10, "S"), (2, 40, 40, "S"), (3, 10, 10, "X"), (4, 10, None, "S"), (5, None, None, "S"), (7, 1, 1, "S"), (8, 5, 61, "S")])
    got = {r.stop_sequence: (r.status, list(r.diffs)) for r in quality.table_diff(a, b).collect()}
    assert got == {1: ("match", []), 2: ("within_tolerance", []), 3: ("mismatch", ["stop_id"]), 4: ("mismatch", ["observed_arrival"]),
                   5: ("match", []), 6: ("only_a", []), 7: ("only_b", []), 8: ("mismatch", ["delay_seconds"])}
    exact = {r.stop_sequence: r.status for r in quality.table_diff(a, b, tolerance_s=0).collect()}
    assert exact[2] == "mismatch"
    s = quality.diff_summary(quality.table_diff(a, b)).first()
    assert (s.matching, s.within_tolerance, s.mismatched, s.only_a, s.only_b, s.agreement_pct) == (3, 1, 3, 1, 1, 37.5)
    none = quality.diff_summary(quality.table_diff(a.filter("false"), b.filter("false"))).first()
    assert (none.matching, none.agreement_pct) == (0, 0.0)


def test_checksum(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(100)], "k int, v int")
    one = quality.content_checksum(df, ["k", "v"]).first()
    assert one == quality.content_checksum(df.orderBy(F.desc("k")), ["k", "v"]).first() and one.rows_checked == 100
    last = df.withColumn("v", F.when(F.col("k") == 99, 0).otherwise(F.col("v")))
    assert one.checksum != quality.content_checksum(last, ["k", "v"]).first().checksum
    assert quality.content_checksum(df.filter("false"), ["k", "v"]).first().checksum == "empty"
    assert quality.table_fingerprint(df, ["k", "v"]).first() != quality.table_fingerprint(df.unionAll(df.limit(1)), ["k", "v"]).first()


# -- retention ----------------------------------------------------------------------------------


def dump_names(days, start=date(2026, 1, 1)):
    from datetime import timedelta

    return [f"snap-{start + timedelta(days=i):%Y-%m-%d}T0200Z.dump" for i in range(days)]


def retained(spark, names):
    rows = lifecycle.dump_retention(spark.createDataFrame([(n,) for n in names], "name string"), "snap").collect()
    return {r.name: r for r in rows}


def test_retention_thins_generations(spark):
    got = retained(spark, dump_names(60))
    kept = sorted(n for n, r in got.items() if r.retain)
    assert kept[-1] == "snap-2026-03-01T0200Z.dump" and set(got[kept[-1]].generations) == {"daily", "weekly", "monthly"}
    assert len(kept) < 20 and "snap-2026-01-31T0200Z.dump" in kept and "snap-2026-02-28T0200Z.dump" in kept
    two_years = retained(spark, dump_names(730))
    assert sum(r.retain for r in two_years.values()) <= 23


def test_retention_within_a_day_and_strangers(spark):
    got = retained(spark, ["snap-2026-01-01T0200Z.dump", "snap-2026-01-01T0900Z.dump", "other.txt", "snap-2026-01-01T0200Z.dump.part"])
    assert {n for n, r in got.items() if r.retain} == {"snap-2026-01-01T0900Z.dump", "other.txt", "snap-2026-01-01T0200Z.dump.part"}


def test_health_report(spark):
    as_of = F.lit("2026-09-16 12:00:00").cast("timestamp")
    t = datetime(2026, 9, 16, 11, 50)
    obs = spark.createDataFrame([(date(2026, 9, 16), t, t)], "service_date date, first_seen_at timestamp, last_seen_at timestamp")
    cov = covered(spark, [(date(2026, 9, 15), 100, 50, 50.0, None), (date(2026, 9, 14), 100, 99, 99.0, None)])
    runs = spark.createDataFrame([("trips", t, True)] * 99 + [("trips", t, False)], "feed string, started_at timestamp, ok boolean")
    dumps = spark.createDataFrame([("a.dump", datetime(2026, 9, 13, 12, 0))], "name string, modified_at timestamp")
    shards = spark.createDataFrame([("a", 5)], "key string, bytes bigint")
    report = health.health_report(obs, cov, runs, dumps, shards, as_of)
    got = {r.code: r for r in report.collect()}
    assert {code: (r.value, r.ok) for code, r in got.items()} == {
        "write_age": (10.0, True), "week_rows": (1.0, False), "total_rows": (1.0, True), "day_coverage": (50.0, False),
        "poll_failures": (1.0, True), "backup_age": (72.0, False), "archive_size": (5.0, True)}
    assert health.verdict(report).first().failing == 3
    empty = health.health_report(obs.filter("false"), cov.filter("false"), runs.filter("false"), dumps.filter("false"), shards.filter("false"), as_of)
    assert {r.code for r in empty.collect() if r.ok} == {"total_rows", "day_coverage"}
    beat = health.heartbeat(obs.filter("false"), as_of).first()
    assert (beat.recent_rows, beat.age_minutes, beat.ok) == (0, 999999, False)


# -- documents ----------------------------------------------------------------------------------------


def test_stop_document(spark):
    tier = cells(spark, [(7, 6), (8, 3), (9, 20)])
    meta = spark.sql("select 'S' as stop_id, 'Main' as stop_name, 43.0D as stop_lat, cast(null as double) as stop_lon, array('N') as headsigns, "
                     "array(0) as directions, array('80') as routes, 29L as n, true as usable")
    doc = json.loads(documents.stop_documents(tier, meta, F.lit("now")).first().json)
    assert doc["stop"] == {"id": "S", "name": "Main", "lat": 43.0, "lon": None, "headsigns": ["N"], "directions": [0]}
    assert [(c["h"], c["confidence"], c["fallback"] and c["fallback"]["scope"]) for c in doc["cells"]] == [
        (7, "provisional", None), (8, "sparse", "band"), (9, "confident", None)]
    assert doc["cells"][1]["fallback"]["hours"] == [7, 8, 9] and doc["hasUsableData"] is True and doc["generatedAt"] == "now"


# -- digests --------------------------------------------------------------------------------


def test_digests_tell_values_and_nulls_apart(spark):
    rows = [("1,2", "3"), ("1", "2,3"), ("1", None), ("1", ""), (None, "1"), ("", "1"), ("1:1", "-"), ("1", "1:-"), ("12", "3"), ("-", None)]
    sums = {quality.content_checksum(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first().checksum for r in rows}
    prints = {quality.table_fingerprint(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first() for r in rows}
    assert len(sums) == len(prints) == len(rows)
    twice = spark.createDataFrame([rows[0]] * 2, "a string, b string")
    assert quality.content_checksum(twice, ["a", "b"]).first().checksum not in sums


def _observed(spark, rows):
    return spark.createDataFrame(rows, "service_date date, trip_id string, stop_sequence int, is_modified boolean, observed_arrival timestamp, delay_seconds int, scheduled_source int, route_id string, stop_id string")


def test_digest_tree_finds_what_a_full_comparison_finds(spark, tmp_path):
    at = datetime(2026, 9, 15, 12)
    base = [(date(2026, 9, 15), f"T{i}", s, False, at + timedelta(seconds=i), i, 1, "80", None if i % 7 == 0 else "S") for i in range(300) for s in (1, 2)]
    other = [r for r in base if r[1] != "T5"] + [(date(2026, 9, 15), "T999", 1, False, at, None, 1, "80", "S")]
    other = [(*r[:4], r[4] + timedelta(seconds=30 if r[1] == "T8" else 90 if r[1] == "T9" else 0), *r[5:8], "" if r[1] == "T14" else r[8]) for r in other]
    columns = [*quality.VISIT_KEY, *quality.COMPARED]

    def leaves(df, name):
        quality.digest_leaves(df, quality.VISIT_KEY, columns).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    a, b = _observed(spark, base), _observed(spark, other)
    both = leaves(a, "a"), leaves(b, "b")
    full = quality.table_diff(a, b)
    tree = quality.tree_diff(a, b, both)
    off = lambda df: sorted((r.trip_id, r.stop_sequence, r.status, tuple(r.diffs)) for r in df.filter("status <> 'match'").collect())
    assert off(tree) == off(full) and {s for _, _, s, _ in off(full)} == {"only_a", "only_b", "mismatch", "within_tolerance"}
    assert tree.count() < 40 < full.count()
    assert quality.tree_summary(tree, both[0]).first() == quality.diff_summary(full).first()
    # Equal tables: no bucket differs, no row reaches the join.
    same = both[0], leaves(a.repartition(5), "c")
    assert quality.differing_buckets(*same).isEmpty()
    nothing = quality.tree_diff(a, a, same)
    assert nothing.isEmpty() and quality.tree_summary(nothing, both[0]).first() == quality.diff_summary(quality.table_diff(a, a)).first()
    none = leaves(a.limit(0), "d")
    assert quality.tree_summary(quality.tree_diff(a.limit(0), a.limit(0), (none, none)), none).first().agreement_pct == 0.0
    assert quality.tree_summary(quality.tree_diff(a.limit(0), a, (none, both[0])), none).first().only_b == 600


def test_leaves_hash_values_without_a_text_of_each_row(spark):
    """F8: the digests of a tree take no string of a row, and still tell null, empty and shifted values apart."""
    rows = [("k", None, "a"), ("k", "a", None), ("k", "", "a"), ("k", "a", ""), ("k", None, None), ("k", "", None), ("k", "ab", "c"), ("k", "a", "bc")]
    df = spark.createDataFrame(rows, "k string, x string, y string")
    digests = [quality.digest_leaves(df.filter(F.col("x").eqNullSafe(F.lit(x)) & F.col("y").eqNullSafe(F.lit(y))), ["k"], ["k", "x", "y"]).first() for _, x, y in rows]
    assert len({(d.high, d.low) for d in digests}) == len(rows) and all(d.n == 1 for d in digests)
    whole = quality.digest_leaves(df, ["k"], ["k", "x", "y"])
    assert (whole.first().high, whole.first().low) == (sum(d.high for d in digests), sum(d.low for d in digests))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "md5" not in plan and "conv(" not in plan
