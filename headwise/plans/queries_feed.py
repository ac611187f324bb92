"""Queries: payload decoding, flattening, matching, service dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates
from ..operators import calendar, flatten, match
from ..sources import decode
from . import standins as v
from .catalog import query
from .oracle import with_

D = "strftime(service_date, '%Y-%m-%d') AS service_date"
VISIT = f"{D}, trip_id, stop_sequence, is_modified"
POLL_US = "header_s * 1000000 + poll_no % 1000000"


def _decoded(spark, sf):
    return decode.decode_polls(v.encode_feeds(v.feeds(spark, sf)))


_STOPS = (
    "SELECT poll_id, CAST(entity_pos AS INT) AS entity_pos, CAST(stop_pos AS INT) AS stop_pos, trip_id, is_modified, route_id, vehicle_id, "
    "stop_sequence, stop_id, rel AS schedule_relationship, arrival_s, departure_s FROM stop_rows"
)


@query("d1_decode_payloads", with_("stop_rows") + _STOPS)
def _(spark, sf):
    feeds = decode.good_feeds(_decoded(spark, sf))
    return flatten.stop_updates(flatten.trip_updates(feeds)).select(
        "poll_id", "entity_pos", "stop_pos", "trip_id", "is_modified", "route_id", "vehicle_id",
        "stop_sequence", "stop_id", "schedule_relationship", "arrival_s", "departure_s",
    )


@query(
    "d2_bad_payloads",
    with_("updates")
    + f"""SELECT DISTINCT poll_id, CASE WHEN ({POLL_US}) % 5 = 1 THEN 'no_header_time' ELSE 'unreadable_payload' END AS error
    FROM updates WHERE ({POLL_US}) % 5 < 2""",
)
def _(spark, sf):
    # Every fifth payload is garbage, every fifth an empty header.
    kind = F.unix_micros("fetched_at") % 5
    broken = v.encode_feeds(v.feeds(spark, sf)).withColumn(
        "payload",
        F.when(kind == 0, F.unhex(F.lit("FFFFFF")))
        .when(kind == 1, F.unhex(F.lit("0A050A03322E30")))
        .otherwise(F.col("payload")),
    )
    return decode.quarantine(decode.decode_polls(broken)).select("poll_id", "error")


@query(
    "d3_entity_census",
    with_("updates")
    + """SELECT poll_id, count(DISTINCT CASE WHEN has_update THEN n END) AS trip_updates,
    count(DISTINCT CASE WHEN NOT has_update THEN n END) AS alerts, CAST(count(DISTINCT n) AS INT) AS entity_total
    FROM updates GROUP BY poll_id""",
)
def _(spark, sf):
    counts = F.col("entity_counts")
    return flatten.entity_census(v.feeds(spark, sf)).select(
        "poll_id",
        F.coalesce(counts["tripUpdate"], F.lit(0)).alias("trip_updates"),
        F.coalesce(counts["alert"], F.lit(0)).alias("alerts"),
        "entity_total",
    )


@query(
    "d4_trip_updates",
    with_("trip_stops")
    + """SELECT DISTINCT poll_id, CAST(entity_pos AS INT) AS entity_pos, CAST(n AS VARCHAR) AS entity_id, trip_id, is_modified,
    CASE WHEN is_modified THEN 'M' || n END AS modifications_id, route_id, vehicle_id, trip_ts FROM trip_stops""",
)
def _(spark, sf):
    return flatten.trip_updates(v.feeds(spark, sf)).select(
        "poll_id", "entity_pos", "entity_id", "trip_id", "is_modified", "modifications_id", "route_id", "vehicle_id", "trip_ts"
    )


@query(
    "d4_header_defaults",
    with_("updates")
    + """SELECT DISTINCT poll_id, CASE WHEN poll_no % 2 = 0 THEN '2.0' ELSE 'unknown' END AS version,
    CASE WHEN poll_no % 3 = 0 THEN 'DIFFERENTIAL' ELSE 'FULL_DATASET' END AS incrementality FROM updates""",
)
def _(spark, sf):
    return flatten.with_header_defaults(v.feeds(spark, sf)).select("poll_id", "version", "incrementality")


@query(
    "d5_unidentified_trips",
    with_("updates")
    + """SELECT poll_id, CAST(count(DISTINCT CASE WHEN has_update AND own_trip IS NULL AND affected_trip IS NULL THEN n END) AS INT)
    AS unidentifiable_trips FROM updates GROUP BY poll_id""",
)
def _(spark, sf):
    return flatten.unidentified_trips(v.feeds(spark, sf))


@query("d6_stop_updates", with_("stop_rows") + _STOPS)
def _(spark, sf):
    return flatten.stop_updates(flatten.trip_updates(v.feeds(spark, sf))).select(
        "poll_id", "entity_pos", "stop_pos", "trip_id", "is_modified", "route_id", "vehicle_id",
        "stop_sequence", "stop_id", "schedule_relationship", "arrival_s", "departure_s",
    )


@query(
    "d7_relationship_codes",
    """SELECT event_id, CASE user_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 7 ELSE 0 END AS code FROM events""",
)
def _(spark, sf):
    given = F.element_at(
        F.array(*[F.lit(x) for x in ("SCHEDULED", "SKIPPED", "NO_DATA", "UNSCHEDULED", "7", "odd", None)]),
        (F.col("user_id") % 7 + 1).cast("int"),
    )
    return v.table(spark, sf, "events").select("event_id", predicates.relationship_code(given).alias("code"))


@query(
    "p1_without_no_data",
    with_("stop_rows") + "SELECT poll_id, count(*) AS stops FROM stop_rows WHERE rel <> 2 GROUP BY poll_id",
)
def _(spark, sf):
    stops = flatten.stop_updates(flatten.trip_updates(v.feeds(spark, sf)))
    return flatten.has_data(stops).groupBy("poll_id").agg(F.count(F.lit(1)).alias("stops"))


@query(
    "p2_skip_reasons",
    with_("stop_rows")
    + "SELECT poll_id, coalesce(skip_reason, 'kept') AS skip_reason, count(*) AS stops FROM stop_rows GROUP BY 1, 2",
)
def _(spark, sf):
    stops = flatten.with_skip_reason(flatten.stop_updates(flatten.trip_updates(v.feeds(spark, sf))))
    return stops.groupBy("poll_id", F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")).agg(
        F.count(F.lit(1)).alias("stops")
    )


# -- timetable in effect -------------------------------------------------------------


@query(
    "j1_bind_version",
    with_("versions")
    + """SELECT strftime(d, '%Y-%m-%d') AS date, coalesce(
      (SELECT arg_max(id, loaded) FROM versions WHERE done AND s <= d AND e >= d),
      (SELECT arg_max(id, loaded) FROM versions WHERE done)) AS feed_version_id
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)""",
)
def _(spark, sf):
    dates = v.table(spark, sf, "events").select(F.to_date("ts").alias("date"))
    return calendar.bind_version(dates, v.versions(spark))


@query(
    "w12_latest_version",
    """SELECT arg_max(id, loaded) AS feed_version_id FROM (
      SELECT CAST(epoch_us(date_trunc('month', o_orderdate)) // 2000000000000 AS INT) AS id, max(o_orderdate) AS loaded
      FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)""",
)
def _(spark, sf):
    at = F.col("o_orderdate").cast("timestamp")
    ident = F.floor(F.unix_seconds(F.date_trunc("month", at)) / 2000000).cast("int")
    loads = v.table(spark, sf, "orders").select(
        ident.alias("feed_version_id"),
        at.alias("loaded_at"),
        F.when(F.col("o_orderstatus") != "P", at).alias("load_completed_at"),
    )
    return calendar.latest_version(loads)


@query(
    "j2_trip_schedule",
    with_("trip_stops")
    + """SELECT poll_id, count(DISTINCT n) AS trips, count(DISTINCT CASE WHEN trip_no < 26 THEN n END) AS known
    FROM trip_stops GROUP BY poll_id""",
)
def _(spark, sf):
    timetable = v.probe_timetable(spark)
    trips = match.with_version(flatten.trip_updates(v.feeds(spark, sf)), timetable.versions, v.TZ)
    return match.with_schedule(trips, timetable).groupBy("poll_id").agg(
        F.count(F.lit(1)).alias("trips"), F.count_if(F.col("schedule").isNotNull()).alias("known")
    )


@query(
    "j3_stop_schedule",
    with_("timed")
    + """SELECT poll_id, CAST(entity_pos AS INT) AS entity_pos, CAST(stop_pos AS INT) AS stop_pos,
    feed_version_id, CAST(sched AS INT) AS scheduled_seconds FROM timed""",
)
def _(spark, sf):
    timetable = v.probe_timetable(spark)
    trips = match.with_version(flatten.trip_updates(v.feeds(spark, sf)), timetable.versions, v.TZ)
    stops = flatten.stop_updates(match.with_schedule(trips, timetable))
    return stops.select(
        "poll_id", "entity_pos", "stop_pos", "feed_version_id", F.col("schedule")[F.col("stop_sequence")].alias("scheduled_seconds")
    )


@query(
    "j4_service_date",
    with_("timed", "resolved")
    + """SELECT poll_id, CAST(entity_pos AS INT) AS entity_pos, CAST(stop_pos AS INT) AS stop_pos, strftime(date, '%Y-%m-%d') AS resolved
    FROM timed LEFT JOIN resolved USING (event_id) WHERE arrival_s IS NOT NULL AND sched IS NOT NULL""",
)
def _(spark, sf):
    timetable = v.probe_timetable(spark)
    trips = match.with_version(flatten.trip_updates(v.feeds(spark, sf)), timetable.versions, v.TZ)
    stops = flatten.stop_updates(match.with_schedule(trips, timetable))
    seconds = F.col("schedule")[F.col("stop_sequence")]
    return stops.filter(F.col("arrival_s").isNotNull() & seconds.isNotNull()).select(
        "poll_id",
        "entity_pos",
        "stop_pos",
        match.resolve_service_date(F.col("arrival_s"), seconds, F.col("days"), v.TZ).alias("resolved"),
    )


@query(
    "j5_anchored_trips",
    with_("eligible")
    + f"""SELECT DISTINCT poll_id, CAST(entity_pos AS INT) AS entity_pos, {D}, anchored FROM eligible""",
)
def _(spark, sf):
    matched = match.matched_trips(flatten.trip_updates(v.feeds(spark, sf)), v.probe_timetable(spark), v.TZ)
    return matched.filter(F.size("stops") > 0).select("poll_id", "entity_pos", "service_date", "anchored")


_PREDICTION = f"""poll_id, {VISIT}, route_id, stop_id,
    CASE WHEN hit THEN CAST(hour(to_timestamp(sched_s - 6 * 3600) AT TIME ZONE 'UTC') AS INT) END AS scheduled_hour_local,
    CASE WHEN hit THEN CASE isodow(service_date) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END END AS day_type,
    sched_s * 1000000 AS scheduled_arrival, CASE WHEN NOT hit THEN 0 WHEN is_modified THEN 2 ELSE 1 END AS scheduled_source,
    CASE WHEN hit THEN feed_version_id END AS feed_version_id, arrival_s * 1000000 AS observed_arrival,
    rel AS schedule_relationship, vehicle_id, header_s * 1000000 AS observed_at, {POLL_US} AS fetched_at"""


@query("w1_best_per_poll", with_("ranked") + f"SELECT {_PREDICTION} FROM ranked WHERE rn = 1")
def _(spark, sf):
    return match.predictions(flatten.trip_updates(v.feeds(spark, sf)), v.probe_timetable(spark), v.TZ)


@query(
    "a11_transform_stats",
    with_("updates", "trip_stops", "eligible", "ranked")
    + """SELECT poll_id, coalesce(trip_updates, 0) AS trip_updates, coalesce(modified_trips, 0) AS modified_trips,
      coalesce(stop_updates_total, 0) AS stop_updates_total, coalesce(skipped_departure_only, 0) AS skipped_departure_only,
      coalesce(skipped_no_data, 0) AS skipped_no_data, coalesce(skipped_no_time, 0) AS skipped_no_time,
      coalesce(unmatched_trips, 0) AS unmatched_trips, coalesce(unmatched_stops, 0) AS unmatched_stops,
      coalesce(unresolved, 0) AS unresolved_service_date, coalesce(rows_emitted, 0) AS rows_emitted,
      coalesce(rows_eligible, 0) - coalesce(rows_emitted, 0) AS duplicate_keys
    FROM (SELECT DISTINCT poll_id FROM updates)
    LEFT JOIN (SELECT poll_id, count(DISTINCT n) AS trip_updates, count(DISTINCT CASE WHEN is_modified THEN n END) AS modified_trips,
        count(DISTINCT CASE WHEN trip_no >= 26 THEN n END) AS unmatched_trips,
        count(DISTINCT CASE WHEN trip_no < 26 AND n NOT IN (SELECT n FROM anchors) THEN n END) AS unresolved
      FROM trip_stops GROUP BY poll_id) USING (poll_id)
    LEFT JOIN (SELECT poll_id, count(*) AS stop_updates_total,
        count(*) FILTER (WHERE skip_reason = 'departure_only') AS skipped_departure_only,
        count(*) FILTER (WHERE skip_reason = 'no_data') AS skipped_no_data,
        count(*) FILTER (WHERE skip_reason = 'no_time') AS skipped_no_time,
        count(*) FILTER (WHERE skip_reason IS NULL AND anchored AND sched IS NULL) AS unmatched_stops
      FROM eligible GROUP BY poll_id) USING (poll_id)
    LEFT JOIN (SELECT poll_id, count(*) AS rows_eligible, count(*) FILTER (WHERE rn = 1) AS rows_emitted
      FROM ranked GROUP BY poll_id) USING (poll_id)""",
)
def _(spark, sf):
    return match.transform_stats(v.feeds(spark, sf), v.probe_timetable(spark), v.TZ)


@query(
    "a12_vehicles_tracked",
    with_("trip_stops") + "SELECT poll_id, count(DISTINCT vehicle_id) AS vehicles_tracked FROM trip_stops GROUP BY poll_id",
)
def _(spark, sf):
    return match.vehicles_tracked(flatten.trip_updates(v.feeds(spark, sf)))
