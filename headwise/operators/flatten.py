"""Nested feeds to flat trip and stop updates.

A poll is one row, so the census and the skip counts of a poll are computed
inside the row, without exploding or shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates


def with_header_defaults(feeds: DataFrame) -> DataFrame:
    return feeds.withColumn("version", F.coalesce("version", F.lit("unknown"))).withColumn(
        "incrementality", F.coalesce("incrementality", F.lit("FULL_DATASET"))
    )


def _census() -> list[Column]:
    kinds = F.flatten(F.transform("entities", lambda e: e["kinds"]))
    names = F.array_sort(F.array_distinct(kinds))
    counts = F.transform(names, lambda n: F.size(F.filter(kinds, lambda x: x == n)).cast("long"))
    return [F.map_from_arrays(names, counts).alias("entity_counts"), F.size("entities").alias("entity_total")]


def entity_census(feeds: DataFrame) -> DataFrame:
    """Per poll: how many entities carry each payload kind, and how many in all."""
    return feeds.select("poll_id", *_census())


def poll_counters(feeds: DataFrame) -> DataFrame:
    """Per poll, in one projection of its row: entities, trip updates without a trip, distinct vehicles."""
    named = F.filter("entities", lambda e: e["trip_update"].isNotNull() & _identified(e["trip_update"]))
    vehicles = F.filter(F.transform(named, lambda e: e["trip_update"]["vehicle_id"]), lambda v: v.isNotNull())
    return feeds.select(
        "poll_id", "feed", "fetched_at", "header_ts", *_census(), F.size(_nameless()).alias("unidentifiable_trips"),
        F.size(F.array_distinct(vehicles)).cast("long").alias("vehicles_tracked"),
    )


def _trip_id(update: Column) -> Column:
    return F.coalesce(update["trip"]["trip_id"], update["trip"]["modified_trip"]["affected_trip_id"])


def _identified(update: Column) -> Column:
    return F.coalesce(_trip_id(update) != "", F.lit(False))


def unidentified_trips(feeds: DataFrame) -> DataFrame:
    """Per poll: trip updates that name no trip at all."""
    return feeds.select("poll_id", F.size(_nameless()).alias("unidentifiable_trips"))


def _nameless() -> Column:
    return F.filter("entities", lambda e: e["trip_update"].isNotNull() & ~_identified(e["trip_update"]))


def _clean_stops(updates: Column) -> Column:
    """Number the stop updates, drop those without sequence or stop, code the rest."""
    numbered = F.transform(
        F.coalesce(updates, F.array()),
        lambda s, i: F.struct(
            i.alias("stop_pos"),
            s["stop_sequence"].alias("stop_sequence"),
            s["stop_id"].alias("stop_id"),
            predicates.relationship_code(s["schedule_relationship"]).alias("schedule_relationship"),
            s["arrival_time"].alias("arrival_s"),
            s["departure_time"].alias("departure_s"),
        ),
    )
    return F.filter(numbered, lambda s: s["stop_sequence"].isNotNull() & s["stop_id"].isNotNull())


def trip_updates(feeds: DataFrame) -> DataFrame:
    """One row per identified trip update, its stop updates still nested."""
    entities = feeds.select(
        "poll_id", "fetched_at", "header_ts", F.posexplode("entities").alias("entity_pos", "entity")
    )
    update = F.col("entity.trip_update")
    modified = update["trip"]["modified_trip"]
    return entities.filter(update.isNotNull() & _identified(update)).select(
        "poll_id",
        "fetched_at",
        "header_ts",
        "entity_pos",
        F.coalesce("entity.id", F.lit("")).alias("entity_id"),
        _trip_id(update).alias("trip_id"),
        modified.isNotNull().alias("is_modified"),
        modified["modifications_id"].alias("modifications_id"),
        F.coalesce(update["trip"]["route_id"], F.lit("")).alias("route_id"),
        update["vehicle_id"].alias("vehicle_id"),
        update["ts"].alias("trip_ts"),
        _clean_stops(update["stop_time_update"]).alias("stops"),
    )


def stop_updates(trips: DataFrame) -> DataFrame:
    """One row per stop update of :func:`trip_updates`."""
    kept = [c for c in trips.columns if c != "stops"]
    return trips.select(*kept, F.inline("stops"))


def with_skip_reason(stops: DataFrame) -> DataFrame:
    return stops.withColumn(
        "skip_reason",
        predicates.skip_reason(F.col("schedule_relationship"), F.col("arrival_s"), F.col("departure_s")),
    )


def has_data(stops: DataFrame) -> DataFrame:
    """Drop stop updates the feed marks as having no prediction."""
    return stops.filter(~(with_reason(stops, "no_data")))


def with_reason(stops: DataFrame, reason: str) -> Column:
    flag = predicates.skip_reason(F.col("schedule_relationship"), F.col("arrival_s"), F.col("departure_s"))
    return F.coalesce(flag == reason, F.lit(False))


def with_arrival(stops: DataFrame) -> DataFrame:
    """Keep the stop updates that yield an observation."""
    return with_skip_reason(stops).filter("skip_reason is null").drop("skip_reason")
