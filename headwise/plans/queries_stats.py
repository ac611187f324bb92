"""Queries: scalar expressions, collapse, rollups and their sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates, stats, times
from ..operators import collapse, health, quality, rollup, serving
from . import standins as v
from .catalog import query
from .oracle import CONFIDENCE, DIMS, LATE, MEAN, SD, SUMS, day_type, wilson, with_

D = "strftime(service_date, '%Y-%m-%d') AS service_date"
ORDER = ("observed_at", "entity_pos")
LO, HI = wilson("n_late_240", "n")
R = "round({0}, 6) AS {0}".format
BUCKET = "n, sum_delay, sum_delay_sq, min_delay, max_delay, p50_delay, p90_delay, n_late_240, n_late_300, n_early_60"
CHICAGO = "timezone('America/Chicago', ts::TIMESTAMPTZ)"


# -- scalar expressions -----------------------------------------------------------


@query(
    "x1_x2_local_date_hour",
    f"""SELECT event_id, strftime({CHICAGO}, '%Y-%m-%d') AS local_date, CAST(hour({CHICAGO}) AS INT) AS local_hour
    FROM (SELECT event_id, timezone('UTC', ts) AS ts FROM events)""",
)
def _(spark, sf):
    ts = times.as_instant(F.col("ts"))
    return v.table(spark, sf, "events").select(
        "event_id", times.local_date(ts, v.TZ).alias("local_date"), times.local_hour(ts, v.TZ).alias("local_hour")
    )


@query(
    "x3_x7_x8_calendar_days",
    f"""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day,
           strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before, CAST({day_type('o_orderdate')} AS INT) AS day_type,
           strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start,
           'stop_time_observations_w' || strftime(date_trunc('week', o_orderdate), '%Y%m%d') AS bucket
    FROM orders""",
)
def _(spark, sf):
    d = F.to_date("o_orderdate")
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        times.add_days(d, 1).alias("next_day"),
        times.add_days(d, -1).alias("day_before"),
        times.day_type(d).alias("day_type"),
        times.week_start(d).alias("week_start"),
        times.week_bucket(d).alias("bucket"),
    )


@query(
    "x4_x5_service_day_instants",
    """SELECT o_orderkey, epoch_us(start) // 1000000 AS day_start_s,
           (epoch_us(start) // 1000000 + o_custkey % 100000) * 1000000 AS scheduled_at
    FROM (SELECT *, timezone('America/Chicago', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR)
                    - INTERVAL 12 HOUR AS start FROM orders)""",
)
def _(spark, sf):
    d = F.to_date("o_orderdate")
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        times.service_day_start_s(d, v.TZ).alias("day_start_s"),
        times.scheduled_at(d, F.col("o_custkey") % 100000, v.TZ).alias("scheduled_at"),
    )


@query(
    "x6_parse_time",
    """SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_suppkey % 60 < 10 AND l_suppkey % 7 = 0 THEN NULL
                ELSE CAST((l_partkey % 30) * 3600 + (l_suppkey % 60) * 60 + l_linenumber AS INT) END AS seconds
    FROM lineitem""",
)
def _(spark, sf):
    # One-digit minutes are malformed.
    minutes = F.when(F.col("l_suppkey") % 7 == 0, (F.col("l_suppkey") % 60).cast("string")).otherwise(
        F.format_string("%02d", F.col("l_suppkey") % 60)
    )
    text = F.concat_ws(":", (F.col("l_partkey") % 30).cast("string"), minutes, F.format_string("%02d", "l_linenumber"))
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", times.parse_gtfs_time(text).alias("seconds")
    )


@query(
    "x9_wilson",
    with_("cells") + f"SELECT stop_id, {DIMS.replace('stop_id, ', '')}, n, n_late_240, round({LO}, 6) AS pct_late_lo, round({HI}, 6) AS pct_late_hi FROM cells",
)
def _(spark, sf):
    return serving.with_interval(v.cells(spark, sf)).select(
        "stop_id", "route_id", "hour_of_day", "day_type", "n", "n_late_240", "pct_late_lo", "pct_late_hi"
    )


@query(
    "x10_round",
    "SELECT event_id, CAST(round(floor(value * 16) / 16, 1) AS DOUBLE) AS rounded FROM events",
)
def _(spark, sf):
    # Sixteenths are exact in binary, so both engines round the same value.
    return v.table(spark, sf, "events").select(
        "event_id", stats.rounded(F.floor(F.col("value") * 16).cast("double") / 16).alias("rounded")
    )


@query(
    "x13_x18_x19_hour_key_digest_age",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H') AS hour_key, base64(encode(props)) AS b64, md5(props) AS digest,
           CAST(floor((epoch_us(ts) // 1000 - (epoch_us(ts) // 60000000) * 60000) / 1000.0::DOUBLE + 0.5) AS INT) AS age_s
    FROM events""",
)
def _(spark, sf):
    ts = times.as_instant(F.col("ts"))
    return v.table(spark, sf, "events").select(
        "event_id",
        times.utc_hour_key(ts).alias("hour_key"),
        F.base64(F.col("props").cast("binary")).alias("b64"),
        F.md5(F.col("props").cast("binary")).alias("digest"),
        times.feed_age_s(ts, F.date_trunc("minute", ts)).alias("age_s"),
    )


@query(
    "x14_distance_km",
    """SELECT c_custkey, round(sqrt(x * x + y * y) * 111.32::DOUBLE, 6) AS km FROM (
      SELECT c_custkey, (-89.5::DOUBLE - (-89.5::DOUBLE + c_nationkey * 0.01::DOUBLE)) * cos(radians((43 + (c_custkey % 100) * 0.001::DOUBLE + 43.05::DOUBLE) / 2)) AS x,
             43.05::DOUBLE - (43 + (c_custkey % 100) * 0.001::DOUBLE) AS y FROM customer)""",
)
def _(spark, sf):
    from ..functions import keys

    return v.riders(spark, sf).select(
        F.col("point_id").alias("c_custkey"),
        keys.distance_km(F.col("lat"), F.col("lon"), F.lit(43.05), F.lit(-89.5)).alias("km"),
    )


@query(
    "x15_dump_periods",
    with_("dumps")
    + """SELECT name, epoch_us(dumped_at) AS dumped_at, strftime(dumped_at, '%Y-%m-%d') AS day,
           CAST(isoyear(dumped_at) AS VARCHAR) || '-W' || CAST(weekofyear(dumped_at) AS VARCHAR) AS week,
           strftime(dumped_at, '%Y-%m') AS month FROM dumps""",
)
def _(spark, sf):
    at = times.snapshot_time(F.col("name"), "snapshot")
    return v.dump_names(spark, sf).select(
        "name",
        at.alias("dumped_at"),
        times.day_key(at).alias("day"),
        times.iso_week_key(at).alias("week"),
        times.month_key(at).alias("month"),
    )


@query(
    "x16_weekday_flag",
    with_("calendar")
    + """SELECT o_orderkey, substr(flags, CAST(isodow(o_orderdate) AS INT), 1) = '1' AS runs
    FROM orders JOIN calendar ON service_id = o_orderpriority""",
)
def _(spark, sf):
    from ..sources.gtfs import WEEKDAYS

    calendar = v.calendar_table(spark)
    joined = v.table(spark, sf, "orders").join(calendar, F.col("o_orderpriority") == F.col("service_id"))
    runs = times.runs_on_weekday(F.to_date("o_orderdate"), [F.col(d) for d in WEEKDAYS])
    return joined.select("o_orderkey", runs.alias("runs"))


# -- predicates and labels ------------------------------------------------------------


@query("p3_delay_seconds", with_("visits") + "SELECT entity_pos AS event_id, delay AS delay_seconds FROM visits")
def _(spark, sf):
    return v.visits(spark, sf).select(F.col("entity_pos").alias("event_id"), "delay_seconds")


_P4 = (
    with_("visits")
    + """SELECT entity_pos AS event_id,
    coalesce(scheduled_source = 1 AND schedule_relationship = 0 AND delay IS NOT NULL AND abs(delay) < 7200, false) AS countable FROM visits"""
)


@query("p4_countable", _P4)
def _(spark, sf):
    flag = predicates.is_countable(F.col("scheduled_source"), F.col("schedule_relationship"), F.col("delay_seconds"))
    return v.visits(spark, sf).select(F.col("entity_pos").alias("event_id"), flag.alias("countable"))


@query("p4_countable_sql_function", _P4)
def _(spark, sf):
    predicates.register_sql(spark)
    return v.visits(spark, sf).selectExpr(
        "entity_pos AS event_id",
        "observation_is_countable(scheduled_source, schedule_relationship, delay_seconds) AS countable",
    )


@query("p5_bucketable_rows", with_("countable") + "SELECT route_id, stop_id, count(*) AS n FROM countable GROUP BY 1, 2")
def _(spark, sf):
    return rollup.countable(v.visits(spark, sf)).groupBy("route_id", "stop_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p6_settled",
    with_("collapsed")
    + f"""SELECT {D}, trip_id, stop_sequence, is_modified FROM collapsed
    WHERE last_seen_us < epoch_us(TIMESTAMP '2024-01-15 12:00:00') - 900000000""",
)
def _(spark, sf):
    obs = collapse.collapse(v.predictions(spark, sf), ORDER)
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return quality.settled(obs, as_of).select("service_date", "trip_id", "stop_sequence", "is_modified")


@query("p7_confidence", with_("cells") + f"SELECT stop_id, route_id, hour_of_day, day_type, {CONFIDENCE} AS confidence FROM cells")
def _(spark, sf):
    return serving.labelled_cells(v.cells(spark, sf)).select("stop_id", "route_id", "hour_of_day", "day_type", "confidence")


@query(
    "p8_usable",
    with_("cells")
    + """SELECT 'stop' AS kind, stop_id AS id, max(n >= 5) AS usable FROM cells GROUP BY stop_id
    UNION ALL SELECT 'route', route_id, sum(n) >= 5 FROM cells GROUP BY route_id""",
)
def _(spark, sf):
    cells = v.cells(spark, sf)
    stops = serving.stop_totals(cells).select(F.lit("stop").alias("kind"), F.col("stop_id").alias("id"), "usable")
    routes = serving.route_totals(cells).select(F.lit("route").alias("kind"), F.col("route_id").alias("id"), "usable")
    return stops.unionAll(routes)


@query(
    "p9_delay_phrase",
    with_("visits")
    + """SELECT entity_pos AS event_id, CASE WHEN abs(d / 60.0::DOUBLE) < 0.75 THEN 'about on time'
         ELSE printf('%.1f min ', abs(d / 60.0::DOUBLE)) || CASE WHEN d > 0 THEN 'late' ELSE 'early' END END AS phrase
    FROM (SELECT entity_pos, CAST(floor(delay / 30.0::DOUBLE) AS INT) * 30 + 1 AS d FROM visits WHERE delay IS NOT NULL)""",
)
def _(spark, sf):
    # Off the half-minute grid, so that no value lies on a rounding tie.
    d = F.floor(F.col("delay_seconds") / 30) * 30 + 1
    known = v.visits(spark, sf).filter("delay_seconds is not null")
    return known.select(F.col("entity_pos").alias("event_id"), stats.delay_phrase(d).alias("phrase"))


# -- collapse -------------------------------------------------------------------------


_COLLAPSED = f"""{D}, trip_id, stop_sequence, is_modified, route_id, stop_id, vehicle_id,
    scheduled_s * 1000000 AS scheduled_arrival, scheduled_hour_local, day_type, feed_version_id, scheduled_source,
    observed_s * 1000000 AS observed_arrival, first_s * 1000000 AS first_predicted_arrival,
    min_s * 1000000 AS min_predicted_arrival, max_s * 1000000 AS max_predicted_arrival, change_count, poll_count,
    first_seen_us AS first_seen_at, last_seen_us AS last_seen_at, schedule_relationship, delay AS delay_seconds"""


@query("a1_collapse", with_("collapsed") + f"SELECT {_COLLAPSED} FROM collapsed")
def _(spark, sf):
    return collapse.collapse(v.predictions(spark, sf), ORDER)


@query(
    "w3_change_count",
    with_("collapsed") + f"SELECT {D}, trip_id, stop_sequence, is_modified, change_count, poll_count FROM collapsed",
)
def _(spark, sf):
    return collapse.change_counts(v.predictions(spark, sf), ORDER)


@query(
    "a23_write_summary",
    with_("collapsed")
    + """SELECT count(*) AS rows_written, count(*) FILTER (WHERE poll_count = 1) AS rows_inserted,
    count(*) FILTER (WHERE change_count > 0) AS rows_with_changes FROM collapsed""",
)
def _(spark, sf):
    return collapse.write_summary(collapse.collapse(v.predictions(spark, sf), ORDER))


# -- rollups ----------------------------------------------------------------------------


@query("a2_rollup_daily", with_("daily") + f"SELECT {D}, {DIMS}, {BUCKET} FROM daily")
def _(spark, sf):
    return v.daily(spark, sf)


@query("a3_rollup_monthly", with_("monthly") + f"SELECT strftime(month, '%Y-%m-%d') AS month, {DIMS}, {BUCKET} FROM monthly")
def _(spark, sf):
    return v.monthly(spark, sf)


_SERVING = f"""SELECT stop_id, route_id, hour_of_day, day_type, n, sum_delay, sum_delay_sq, n_late_240, n_late_300, n_early_60,
    min_delay, max_delay, p50_delay_approx, p90_delay_approx,
    strftime(first_service_date, '%Y-%m-%d') AS first_service_date, strftime(last_service_date, '%Y-%m-%d') AS last_service_date,
    service_days, {R('mean_delay')}, {R('stddev_delay')}, {R('pct_late_240')} FROM cells"""


@query("a4_serving_stats", with_("cells") + _SERVING)
def _(spark, sf):
    return v.cells(spark, sf)


@query(
    "a4_serving_stats_window",
    with_("daily", "gaps")
    + f"""SELECT stop_id, route_id, hour_of_day, day_type, n, {R('mean_delay')} FROM (
      SELECT *, {MEAN} AS mean_delay FROM (
        SELECT stop_id, route_id, hour_of_day, day_type, {SUMS} FROM daily
        WHERE service_date >= DATE '2024-01-31' - 10 AND service_date NOT IN (SELECT service_date FROM gaps)
        GROUP BY ALL))""",
)
def _(spark, sf):
    cells = rollup.serving_stats(v.daily(spark, sf), v.gaps(spark), F.lit("2024-01-31").cast("date"), 10)
    return cells.select("stop_id", "route_id", "hour_of_day", "day_type", "n", "mean_delay")


@query(
    "a5_dataset_summary",
    with_("daily", "cells")
    + """SELECT strftime(min(service_date), '%Y-%m-%d') AS first_service_date, strftime(max(service_date), '%Y-%m-%d') AS last_service_date,
    count(DISTINCT service_date) AS service_days, CAST(sum(n) AS BIGINT) AS total_observations,
    count(DISTINCT stop_id) AS stops_with_data, count(DISTINCT route_id) AS routes_with_data,
    (SELECT count(*) FROM cells WHERE n >= 20) AS cells_confident, (SELECT count(*) FROM cells WHERE n >= 5 AND n < 20) AS cells_provisional,
    (SELECT count(*) FROM cells WHERE n < 5) AS cells_sparse, (SELECT count(*) FROM cells) AS cells_total FROM daily""",
)
def _(spark, sf):
    return rollup.dataset_summary(v.daily(spark, sf), v.cells(spark, sf))


@query("a6_growth", with_("daily") + f"SELECT {D}, CAST(sum(n) AS BIGINT) AS n FROM daily GROUP BY daily.service_date")
def _(spark, sf):
    return rollup.growth(v.daily(spark, sf))


_COMBINED = f"n, sum_delay, sum_delay_sq, n_late_240, n_late_300, n_early_60, {R('mean_delay')}, {R('stddev_delay')}, {R('pct_late_240')}"
_INTERVAL = f"round({LO}, 6) AS pct_late_lo, round({HI}, 6) AS pct_late_hi"


@query("a7_route_stop_totals", with_("rs") + f"SELECT route_id, stop_id, {_COMBINED} FROM rs")
def _(spark, sf):
    return serving.route_stop_totals(v.cells(spark, sf))


@query("a8_route_hour_totals", with_("rh") + f"SELECT route_id, hour_of_day, day_type, {_COMBINED}, {_INTERVAL} FROM rh")
def _(spark, sf):
    return serving.route_hour_totals(v.cells(spark, sf))


@query("a9_route_totals", with_("rt") + f"SELECT route_id, {_COMBINED}, {_INTERVAL}, n >= 5 AS usable FROM rt")
def _(spark, sf):
    return serving.route_totals(v.cells(spark, sf))


@query(
    "a10_stop_totals",
    with_("cells")
    + """SELECT stop_id, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS routes,
    max(n >= 5) AS usable FROM cells GROUP BY stop_id""",
)
def _(spark, sf):
    return serving.stop_totals(v.cells(spark, sf))


@query("a22_day_types", with_("cells") + "SELECT array_to_string(list_sort(list(DISTINCT day_type)), ',') AS day_types FROM cells")
def _(spark, sf):
    return serving.day_types_present(v.cells(spark, sf))


@query(
    "a24_combine_buckets",
    with_("daily")
    + f"""SELECT route_id, day_type, {_COMBINED} FROM (SELECT *, {MEAN} AS mean_delay, {SD} AS stddev_delay, {LATE} AS pct_late_240
    FROM (SELECT route_id, day_type, {SUMS} FROM daily WHERE service_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY 1, 2))""",
)
def _(spark, sf):
    span = v.daily(spark, sf).filter("service_date between date'2024-01-08' and date'2024-01-21'")
    return rollup.combine(span, ["route_id", "day_type"])


@query(
    "o3_history",
    with_("daily", "monthly")
    + f"""SELECT strftime(month, '%Y-%m-%d') AS period, {DIMS}, {BUCKET}, 'month' AS grain FROM monthly WHERE month < DATE '2024-01-15'
    UNION ALL SELECT strftime(service_date, '%Y-%m-%d'), {DIMS}, {BUCKET}, 'day' FROM daily WHERE service_date >= DATE '2024-01-15'""",
)
def _(spark, sf):
    return rollup.history(v.daily(spark, sf), v.monthly(spark, sf), F.lit("2024-01-15").cast("date"))


# -- totals for operations ------------------------------------------------------------------


@query(
    "a13_poll_failures",
    with_("runs")
    + """SELECT feed, count(*) AS polls, count(*) FILTER (WHERE NOT ok) AS fails,
    round(count(*) FILTER (WHERE NOT ok) / count(*)::DOUBLE, 6) AS fail_rate
    FROM runs WHERE started_at > TIMESTAMP '2024-01-24' GROUP BY feed""",
)
def _(spark, sf):
    return health.poll_failures(v.runs(spark, sf), v.as_of())


@query(
    "a13_failure_rate",
    with_("runs")
    + """SELECT count(*) AS polls, count(*) FILTER (WHERE NOT ok) AS fails,
    round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE NOT ok) / count(*)::DOUBLE END, 6) AS fail_rate
    FROM runs WHERE started_at > TIMESTAMP '2024-01-24'""",
)
def _(spark, sf):
    return health.failure_rate(health.poll_failures(v.runs(spark, sf), v.as_of()))


@query(
    "a14_collection_totals",
    with_("visits")
    + """SELECT count(*) AS rows_total, count(DISTINCT service_date) AS service_days, max(observed_us) AS last_seen_at,
    count(*) FILTER (WHERE observed_us > epoch_us(TIMESTAMP '2024-01-24')) AS rows_this_week FROM visits""",
)
def _(spark, sf):
    return health.collection_totals(v.visits(spark, sf), v.as_of())


@query(
    "a15_heartbeat",
    with_("visits")
    + """SELECT count(*) AS recent_rows,
    coalesce(CAST(round((epoch_us(TIMESTAMP '2024-01-31') - max(observed_us)) / 60000000.0::DOUBLE) AS INT), 999999) AS age_minutes,
    count(*) > 0 AS ok FROM visits WHERE observed_us > epoch_us(TIMESTAMP '2024-01-31') - 600000000""",
)
def _(spark, sf):
    return health.heartbeat(v.visits(spark, sf), v.as_of())


def late_share(spark, sf_dir: str):
    """Flagship: late share with its interval per (stop, route, hour, day type)."""
    return serving.labelled_cells(v.cells(spark, sf_dir)).select(
        "stop_id", "route_id", "hour_of_day", "day_type", "n", "n_late_240",
        "mean_delay", "pct_late_240", "pct_late_lo", "pct_late_hi", "confidence",
    )


@query(
    "late_share",
    with_("cells")
    + f"""SELECT stop_id, route_id, hour_of_day, day_type, n, n_late_240, {R('mean_delay')}, {R('pct_late_240')}, {_INTERVAL},
    {CONFIDENCE} AS confidence FROM cells""",
)
def _(spark, sf):
    return late_share(spark, sf)
