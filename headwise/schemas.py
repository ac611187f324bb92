"""Declared schemas of every table that is read or written."""

from __future__ import annotations

ARCHIVE = (
    "feed string, fetched_at timestamp, http_status int, feed_timestamp timestamp, "
    "attempts int, payload_bytes int, payload_b64 string"
)

STOP_TIME_UPDATE = (
    "struct<stop_sequence:int, stop_id:string, schedule_relationship:string, "
    "arrival_time:bigint, departure_time:bigint>"
)
TRIP_UPDATE = (
    "struct<trip:struct<trip_id:string, route_id:string, "
    "modified_trip:struct<modifications_id:string, affected_trip_id:string>>, "
    f"vehicle_id:string, ts:bigint, stop_time_update:array<{STOP_TIME_UPDATE}>>"
)
ENTITY = f"struct<id:string, kinds:array<string>, trip_update:{TRIP_UPDATE}>"
FEED = f"header_ts timestamp, version string, incrementality string, entities array<{ENTITY}>"
DECODED = f"poll_id string, feed string, fetched_at timestamp, {FEED}, error string"

FEED_VERSIONS = (
    "feed_version_id int, feed_version string, feed_start_date date, feed_end_date date, "
    "source_url string, sha256 string, loaded_at timestamp, load_completed_at timestamp"
)

#: The identity of a stop visit.
VISIT_KEY = ("service_date", "trip_id", "stop_sequence", "is_modified")

PREDICTIONS = (
    "poll_id string, service_date date, trip_id string, stop_sequence int, is_modified boolean, "
    "route_id string, stop_id string, scheduled_hour_local int, day_type int, "
    "scheduled_arrival timestamp, scheduled_source int, feed_version_id int, "
    "observed_arrival timestamp, schedule_relationship int, vehicle_id string, "
    "observed_at timestamp, fetched_at timestamp"
)

INGEST_RUNS = (
    "feed string, started_at timestamp, duration_ms int, ok boolean, http_status int, "
    "feed_age_s int, feed_timestamp timestamp, payload_bytes int, entities_total int, "
    "entities_decoded int, rows_written bigint, rows_changed bigint, rows_skipped bigint, "
    "attempts int, error string"
)

#: Visits -> buckets.
ROLLUP_DIMS = ("route_id", "stop_id", "hour_of_day", "day_type")
CELL_DIMS = ("stop_id", "route_id", "hour_of_day", "day_type")
KNOWN_GAPS = "service_date date, known_gap_reason string"

#: Timetable tables as stored, each partitioned by feed_version_id.
STATIC = {
    "routes": "route_id string, route_short_name string, route_long_name string, route_type int, route_color string",
    "stops": "stop_id string, stop_code string, stop_name string, stop_lat double, stop_lon double",
    "trips": (
        "trip_id string, route_id string, service_id string, trip_headsign string, direction_id int, "
        "block_id string, shape_id string"
    ),
    "calendar": (
        "service_id string, monday boolean, tuesday boolean, wednesday boolean, thursday boolean, friday boolean, "
        "saturday boolean, sunday boolean, start_date date, end_date date"
    ),
    "calendar_dates": "service_id string, date date, exception_type int",
    "stop_times": (
        "trip_id string, stop_sequence int, stop_id string, arrival_s int, departure_s int, timepoint boolean, "
        "pickup_type int, drop_off_type int"
    ),
}

#: Primary keys of the timetable tables, without the version.
STATIC_KEYS = {
    "routes": ("route_id",),
    "stops": ("stop_id",),
    "trips": ("trip_id",),
    "calendar": ("service_id",),
    "calendar_dates": ("service_id", "date"),
    "stop_times": ("trip_id", "stop_sequence"),
}
