"""Matching trip updates to the timetable, with service-date inference.

The timetable is joined once per trip update, not once per stop: a trip's
schedule travels as a small map (bounded by the stops of one trip), and its
service's days as bits (a word for each 64 days of one feed). Anchoring is then
row-local, so no stop-level join and no join-back are needed; stop rows are
exploded only at the end. Which stop decides is found by bits alone; the clock is
asked once for each trip update.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import predicates, times
from ..schemas import VISIT_KEY
from ..sources import tables
from . import calendar, flatten


@dataclass(frozen=True)
class Timetable:
    """Versioned timetable tables, all carrying ``feed_version_id``."""

    versions: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    services: DataFrame  # service_dates: feed_version_id, service_id, date
    schedules: DataFrame | None = None  # trip_schedules as stored when a version was loaded


def trip_schedules(timetable: Timetable) -> DataFrame:
    """Trips that have stop times: a map of sequence to seconds, and their running days.

    Days are attached here, on the timetable's side, so that trip updates are
    joined and shuffled once and never by service, of which a few carry most trips.
    Made once for each version where it is stored (:func:`store_schedules`).
    """
    if timetable.schedules is not None:
        return timetable.schedules
    per_trip = timetable.stop_times.groupBy("feed_version_id", "trip_id").agg(
        F.map_from_entries(F.collect_list(F.struct("stop_sequence", "arrival_s"))).alias("schedule")
    )
    never = F.create_map().cast("map<int,bigint>")
    return (
        timetable.trips.select("feed_version_id", "trip_id", "service_id")
        .join(calendar.service_days(timetable.services), ["feed_version_id", "service_id"], "left")
        .join(per_trip, ["feed_version_id", "trip_id"])
        .select("feed_version_id", "trip_id", "schedule", F.coalesce("days", never).alias("days"))
    )


def store_schedules(timetable: Timetable, version: int, path: str) -> None:
    """Write the schedules of one version, in place of what was stored for it."""
    one = Timetable(*[df.filter(F.col("feed_version_id") == version) for df in (timetable.versions, timetable.trips, timetable.stop_times, timetable.services)])
    tables.replace_partitions(trip_schedules(one), path, ["feed_version_id"], emptied=[{"feed_version_id": version}], sort=["trip_id"])


def with_version(trips: DataFrame, versions: DataFrame, tz: str) -> DataFrame:
    """Bind each trip update to the version in effect on its poll's local date."""
    dated = trips.withColumn("poll_date", times.local_date(F.col("header_ts"), tz))
    return calendar.with_version(dated, versions, "poll_date")


def with_schedule(trips: DataFrame, timetable: Timetable) -> DataFrame:
    """Attach ``schedule`` and ``days``; both null for an unknown trip."""
    return trips.join(trip_schedules(timetable), ["feed_version_id", "trip_id"], "left")


def _candidates(arrival_s: Column, tz: str) -> Column:
    centre = times.local_date(F.timestamp_seconds(arrival_s), tz)
    return F.array(*[times.add_days(centre, d) for d in (-1, 0, 1)])


def resolve_service_date(arrival_s: Column, seconds: Column, days: Column, tz: str) -> Column:
    """The running date whose scheduled instant is nearest the observed one.

    Candidates are the local date and its neighbours; the earliest wins a tie.
    Null when the trip runs on none of them.
    """
    running = F.filter(_candidates(arrival_s, tz), lambda d: calendar.runs_on(days, d))
    ranked = F.transform(
        running,
        lambda d: F.struct(F.abs(times.scheduled_s(d, seconds, tz) - arrival_s).alias("gap"), d.alias("date")),
    )
    return F.array_min(ranked)["date"]


def anchored(trips: DataFrame, tz: str) -> DataFrame:
    """Fix one service date for all stops of each trip update.

    The first stop, in feed order, with an arrival, a timetable entry and a
    date on which the trip runs decides. Without one the poll's local date is used and the
    timetable withheld. A stop flagged NO_DATA may decide if it has an arrival.
    """
    days = F.col("days")
    deciding = F.filter(
        "stops",
        lambda s: s["arrival_s"].isNotNull()
        & F.col("schedule")[s["stop_sequence"]].isNotNull()
        & F.exists(_candidates(s["arrival_s"], tz), lambda d: calendar.runs_on(days, d)),
    )
    arrival = F.col("_stop")["arrival_s"]
    seconds = F.col("schedule")[F.col("_stop")["stop_sequence"]]
    return (
        trips.withColumn("_stop", F.get(deciding, F.lit(0)))
        .withColumn("anchor_date", F.when(F.col("_stop").isNotNull(), resolve_service_date(arrival, seconds, days, tz)))
        .withColumn("anchored", F.col("anchor_date").isNotNull())
        .withColumn("service_date", F.coalesce("anchor_date", "poll_date"))
        .drop("anchor_date", "_stop")
    )


def matched_trips(trips: DataFrame, timetable: Timetable, tz: str) -> DataFrame:
    """:func:`headwise.operators.flatten.trip_updates` rows, bound, joined and anchored."""
    return anchored(with_schedule(with_version(trips, timetable.versions, tz), timetable), tz)


def candidate_rows(matched: DataFrame, tz: str) -> DataFrame:
    """Observation rows before duplicates within a poll are resolved."""
    exploded = flatten.with_arrival(flatten.stop_updates(matched))
    seconds = F.when(F.col("anchored"), F.col("schedule")[F.col("stop_sequence")])
    timed = exploded.withColumn("_day_start", times.service_day_start_s(F.col("service_date"), tz)).withColumn(
        "scheduled_arrival", F.timestamp_seconds(F.col("_day_start") + seconds)
    )
    hit = F.col("scheduled_arrival").isNotNull()
    return timed.select(
        "poll_id",
        "entity_pos",
        "stop_pos",
        "trip_ts",
        "service_date",
        "trip_id",
        "stop_sequence",
        "is_modified",
        "route_id",
        "stop_id",
        F.when(hit, times.local_hour(F.col("scheduled_arrival"), tz)).alias("scheduled_hour_local"),
        F.when(hit, times.day_type(F.col("service_date"))).alias("day_type"),
        "scheduled_arrival",
        F.when(~hit, F.lit(k.SOURCE_UNMATCHED))
        .when(F.col("is_modified"), F.lit(k.SOURCE_PRE_MODIFICATION))
        .otherwise(F.lit(k.SOURCE_STATIC))
        .alias("scheduled_source"),
        F.when(hit, F.col("feed_version_id")).alias("feed_version_id"),
        F.timestamp_seconds("arrival_s").alias("observed_arrival"),
        "schedule_relationship",
        "vehicle_id",
        F.col("header_ts").alias("observed_at"),
        "fetched_at",
    )


def best_per_poll(rows: DataFrame) -> DataFrame:
    """One row per poll and visit: a vehicle beats none, then the fresher trip
    timestamp, then the later entity and stop in feed order.

    Every map task first keeps only its best row per key.
    """
    w = Window.partitionBy("poll_id", *VISIT_KEY).orderBy(
        F.desc(F.col("vehicle_id").isNotNull()),
        F.desc(F.coalesce("trip_ts", F.lit(0))),
        F.desc("entity_pos"),
        F.desc("stop_pos"),
    )
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def predictions(trips: DataFrame, timetable: Timetable, tz: str) -> DataFrame:
    """Trip updates to one prediction per poll and stop visit."""
    rows = candidate_rows(matched_trips(trips, timetable, tz), tz)
    return best_per_poll(rows).drop("entity_pos", "stop_pos", "trip_ts")


def transform_stats(feeds: DataFrame, timetable: Timetable, tz: str) -> DataFrame:
    """Per-poll counters of the whole transformation; every poll has a row.

    Stop counters are taken inside each trip update's row. Duplicates are the
    eligible rows less the distinct visit keys.
    """
    matched = matched_trips(flatten.trip_updates(feeds), timetable, tz)
    reason = lambda s: predicates.skip_reason(s["schedule_relationship"], s["arrival_s"], s["departure_s"])

    def stops_where(test) -> Column:
        return F.size(F.filter("stops", test)).cast("long")

    def skipped(name: str) -> Column:
        return stops_where(lambda s: F.coalesce(reason(s) == name, F.lit(False)))

    known = F.col("schedule").isNotNull()
    orphans = stops_where(lambda s: reason(s).isNull() & F.col("schedule")[s["stop_sequence"]].isNull())
    eligible = F.filter("stops", lambda s: reason(s).isNull())
    per_trip = matched.select(
        "poll_id",
        "service_date",
        "trip_id",
        "is_modified",
        F.size("stops").cast("long").alias("stops_total"),
        skipped("departure_only").alias("departure_only"),
        skipped("no_data").alias("no_data"),
        skipped("no_time").alias("no_time"),
        (~known).alias("unmatched"),
        (known & ~F.col("anchored")).alias("unresolved"),
        F.when(F.col("anchored"), orphans).otherwise(F.lit(0)).alias("orphans"),
        F.transform(eligible, lambda s: s["stop_sequence"]).alias("eligible"),
    )
    # One pass: the counters of a trip update ride on its first eligible stop, so that
    # grouping by visit finds the distinct keys and carries the counters along.
    counters = {
        "trip_updates": F.lit(1),
        "modified_trips": F.col("is_modified").cast("int"),
        "stop_updates_total": F.col("stops_total"),
        "skipped_departure_only": F.col("departure_only"),
        "skipped_no_data": F.col("no_data"),
        "skipped_no_time": F.col("no_time"),
        "unmatched_trips": F.col("unmatched").cast("int"),
        "unmatched_stops": F.col("orphans"),
        "unresolved_service_date": F.col("unresolved").cast("int"),
    }
    carried = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    visit = ["poll_id", "service_date", "trip_id", "is_modified", "stop_sequence"]
    stops = per_trip.select("*", F.posexplode_outer("eligible").alias("_pos", "stop_sequence"))
    per_visit = stops.groupBy(*visit).agg(
        F.count("stop_sequence").alias("_rows"),
        *[F.sum(F.when(carried, c.cast("long")).otherwise(F.lit(0))).alias(name) for name, c in counters.items()],
    )
    # A poll without trip updates still has a row, of zeros.
    polls = feeds.select("poll_id", F.lit(0).alias("_rows"), *[F.lit(0).alias(name) for name in counters])
    every = per_visit.select("poll_id", "_rows", *counters).unionByName(polls)
    emitted = F.count_if(F.col("_rows") > 0)
    return every.groupBy("poll_id").agg(
        *[F.sum(name).alias(name) for name in counters],
        emitted.alias("rows_emitted"),
        (F.sum("_rows") - emitted).alias("duplicate_keys"),
    )


def vehicles_tracked(trips: DataFrame) -> DataFrame:
    return trips.groupBy("poll_id").agg(F.countDistinct("vehicle_id").alias("vehicles_tracked"))
