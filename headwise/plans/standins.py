"""Transit-shaped views of general tables, so that every operator has whole-table input.

Each view has a DuckDB twin of the same name in :mod:`headwise.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, times
from ..operators import calendar, coverage, match, rollup
from ..session import prepare, scratch_path
from ..sources import decode

TZ = "America/Chicago"
AS_OF = "2024-01-31 00:00:00"
EVENT_ROUTES = ("click", "error", "purchase", "signup", "view")
PRIORITY_ROUTES = {
    "1-URGENT": "click",
    "2-HIGH": "error",
    "3-MEDIUM": "purchase",
    "4-NOT SPECIFIED": "signup",
    "5-LOW": "view",
}
CALENDAR = {  # service: weekdays, Monday first
    "1-URGENT": "1111100",
    "2-HIGH": "0000011",
    "3-MEDIUM": "1010100",
    "4-NOT SPECIFIED": "1111111",
    "5-LOW": "0000000",
}
EXCEPTIONS = (("1-URGENT", "2024-01-01", 2), ("5-LOW", "2024-01-01", 1), ("2-HIGH", "2024-01-03", 1))
GAPS = (("2024-01-05", "gap"),)
SEARCHES = ("red widget", "gear", "bolt blue", "zzz", "e", "BLUE", "s k")
PROBE_VERSIONS = (
    # id, label, first day, last day, loaded, complete
    (1, "winter", "2024-01-01", "2024-01-15", "2023-12-20 00:00:00", True),
    (2, "midwinter", "2024-01-10", "2024-01-25", "2024-01-05 00:00:00", True),
    (3, "broken", "2024-01-01", "2024-02-28", "2024-01-20 00:00:00", False),
)
POLL_EVENTS = 60  # events per poll of the nested feed
ENTITY_EVENTS = 6  # events per trip update
ENCODED_AT_ONCE = 32  # polls held as Python objects


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# -- predictions and visits -----------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per event; several events share a stop visit."""
    user = F.col("user_id")
    ts = times.as_instant(F.col("ts"))
    hour = F.date_trunc("hour", ts)
    delay = F.floor(F.col("value") * 16).cast("int") - 200
    matched = user % 11 != 0
    day = F.to_date(ts)
    sequence = F.array_position(F.array(*map(F.lit, EVENT_ROUTES)), F.col("event_type")).cast("int")
    return table(spark, sf_dir, "events").select(
        F.date_format(hour, "yyyy-MM-dd HH").alias("poll_id"),
        F.col("event_id").alias("entity_pos"),
        F.lit(0).alias("stop_pos"),
        F.col("event_id").alias("trip_ts"),
        day.alias("service_date"),
        (user % 30).cast("string").alias("trip_id"),
        sequence.alias("stop_sequence"),
        (user % 7 == 0).alias("is_modified"),
        F.col("event_type").alias("route_id"),
        (user % 10).cast("string").alias("stop_id"),
        F.when(matched, F.hour(ts)).alias("scheduled_hour_local"),
        F.when(matched, times.day_type(day)).alias("day_type"),
        F.when(matched, hour).alias("scheduled_arrival"),
        matched.cast("int").alias("scheduled_source"),
        F.when(matched, F.lit(1)).alias("feed_version_id"),
        F.timestamp_seconds(F.unix_seconds(hour) + delay).alias("observed_arrival"),
        F.when(user % 13 == 0, F.lit(1)).otherwise(F.lit(0)).alias("schedule_relationship"),
        F.when(user % 4 != 0, user.cast("string")).alias("vehicle_id"),
        ts.alias("observed_at"),
        ts.alias("fetched_at"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a visit of its own, for the statistics."""
    rows = predictions(spark, sf_dir)
    return rows.withColumn(
        "delay_seconds", predicates.delay_seconds(F.col("observed_arrival"), F.col("scheduled_arrival"))
    ).withColumns({"first_seen_at": F.col("observed_at"), "last_seen_at": F.col("observed_at")})


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, as jobs hand tables on."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gaps(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(GAPS), "d string, known_gap_reason string")
    return rows.select(F.col("d").cast("date").alias("service_date"), "known_gap_reason")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup_daily(visits(spark, sf_dir))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup_monthly(visits(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.serving_stats(daily(spark, sf_dir), gaps(spark))


# -- timetable ------------------------------------------------------------------


def versions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(
        list(PROBE_VERSIONS), "feed_version_id int, feed_version string, s string, e string, l string, done boolean"
    )
    return rows.select(
        "feed_version_id",
        "feed_version",
        F.col("s").cast("date").alias("feed_start_date"),
        F.col("e").cast("date").alias("feed_end_date"),
        F.col("l").cast("timestamp").alias("loaded_at"),
        F.when(F.col("done"), F.col("l").cast("timestamp")).alias("load_completed_at"),
    )


def one_version(spark: SparkSession) -> DataFrame:
    return versions(spark).filter("feed_version_id = 1")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.create_map(*[F.lit(x) for pair in PRIORITY_ROUTES.items() for x in pair])
    return table(spark, sf_dir, "orders").select(
        F.lit(1).alias("feed_version_id"),
        F.col("o_orderkey").cast("string").alias("trip_id"),
        route[F.col("o_orderpriority")].alias("route_id"),
        F.col("o_orderpriority").alias("service_id"),
        F.concat(F.lit("to "), F.col("o_orderstatus")).alias("trip_headsign"),
        (F.col("o_custkey") % 2).cast("int").alias("direction_id"),
    )


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_suppkey").alias("supplier"))
        .select(
            F.lit(1).alias("feed_version_id"),
            F.col("l_orderkey").cast("string").alias("trip_id"),
            F.col("l_linenumber").alias("stop_sequence"),
            (F.col("supplier") % 12).cast("string").alias("stop_id"),
            ((F.col("l_orderkey") % 24) * 3600 + F.col("l_linenumber") * 300).cast("int").alias("arrival_s"),
        )
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.lit(1).alias("feed_version_id"),
        key.cast("string").alias("stop_id"),
        F.col("s_name").alias("stop_name"),
        (F.lit(43) + key * F.lit(0.001)).alias("stop_lat"),
        (F.lit(-89.5) + F.col("s_nationkey") * F.lit(0.01)).alias("stop_lon"),
    )


def routes(spark: SparkSession) -> DataFrame:
    rows = [(r, f"{r} line") for r in EVENT_ROUTES if r != "view"]
    return spark.createDataFrame(rows, "route_id string, route_long_name string")


def calendar_table(spark: SparkSession) -> DataFrame:
    rows = [(s, *[c == "1" for c in days]) for s, days in CALENDAR.items()]
    ddl = "service_id string, " + ", ".join(f"{d} boolean" for d in calendar.WEEKDAYS)
    return spark.createDataFrame(rows, ddl).selectExpr(
        "1 as feed_version_id", "*", "date'2024-01-01' as start_date", "date'2024-01-31' as end_date"
    )


def calendar_dates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(EXCEPTIONS), "service_id string, d string, exception_type int")
    return rows.selectExpr("1 as feed_version_id", "service_id", "cast(d as date) as date", "exception_type")


def services(spark: SparkSession) -> DataFrame:
    return calendar.service_dates(calendar_table(spark), calendar_dates(spark))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed stop events of one week; returned items were never seen."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_returnflag <> 'A'")
        .select(
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_suppkey") % 7).cast("int")).alias("service_date"),
            F.col("l_orderkey").cast("string").alias("trip_id"),
            F.col("l_linenumber").alias("stop_sequence"),
        )
    )


def day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.day_coverage(
        observed(spark, sf_dir),
        one_version(spark),
        trips(spark, sf_dir),
        stop_times(spark, sf_dir),
        services(spark),
        gaps(spark),
        F.lit("2024-01-07").cast("date"),
    )


# -- nested feed ------------------------------------------------------------------


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested polls of consecutive events: a fixed number of entities and stops each.

    An entity is six events; some name no trip, some are modified, some carry no
    vehicle. Every seventh poll holds its first trips twice.
    """
    e = table(spark, sf_dir, "events").select("event_id", times.as_instant(F.col("ts")).alias("ts"), "user_id", "event_type")
    eid, user = F.col("event_id"), F.col("user_id")
    entity = F.floor(eid / ENTITY_EVENTS)
    arrival = F.unix_seconds("ts")
    stop = F.struct(
        F.when(eid % 50 != 49, (eid % ENTITY_EVENTS + 1).cast("int")).alias("stop_sequence"),
        F.when(user % 41 != 0, (user % 10).cast("string")).alias("stop_id"),
        F.when(user % 13 == 0, F.lit("NO_DATA"))
        .when(user % 13 == 1, F.lit("SKIPPED"))
        .when(user % 13 == 2, F.lit("3"))
        .when(user % 13 == 3, F.lit("odd"))
        .when(user % 13 == 4, F.lit("SCHEDULED"))
        .alias("schedule_relationship"),
        F.when(user % 9 != 0, arrival).alias("arrival_time"),
        F.when(user % 18 != 0, arrival + 20).alias("departure_time"),
    )
    staged = e.select(
        F.floor(eid / POLL_EVENTS).alias("poll_no"),
        entity.alias("entity_no"),
        F.struct(eid.alias("event_id"), stop.alias("stop")).alias("s"),
        F.col("ts"),
        F.col("event_type"),
    )
    # Six events at most per group, by construction.
    per_entity = staged.groupBy("poll_no", "entity_no").agg(
        F.transform(F.array_sort(F.collect_list("s")), lambda x: x["stop"]).alias("stops"),
        F.min("ts").alias("first_ts"),
        F.min("event_type").alias("route_id"),
    )
    n = F.col("entity_no")
    slot = n % (POLL_EVENTS // ENTITY_EVENTS)
    # Within a poll, odd sevenths reuse the trip of the entity before them.
    trip_no = F.when((F.col("poll_no") % 7 == 0) & (slot % 2 == 1), n - 1).otherwise(n) % 30
    modified = n % 7 == 0
    trip = F.struct(
        F.when(~modified & (n % 29 != 0) | (n % 77 == 0), F.concat(F.lit("T"), trip_no.cast("string"))).alias("trip_id"),
        F.when(n % 17 != 0, F.col("route_id")).alias("route_id"),
        F.when(
            modified,
            F.struct(
                F.concat(F.lit("M"), n.cast("string")).alias("modifications_id"),
                F.when(n % 29 != 0, F.concat(F.lit("T"), trip_no.cast("string"))).alias("affected_trip_id"),
            ),
        ).alias("modified_trip"),
    )
    update = F.struct(
        trip.alias("trip"),
        F.when(n % 4 != 0, F.concat(F.lit("V"), (n % 97).cast("string"))).alias("vehicle_id"),
        F.when(n % 5 != 0, F.unix_seconds("first_ts")).alias("ts"),
        F.col("stops").alias("stop_time_update"),
    )
    kinds = F.when(n % 31 == 30, F.array(F.lit("alert"))).otherwise(F.array(F.lit("tripUpdate")))
    body = F.struct(
        n.alias("entity_no"),
        F.struct(
            n.cast("string").alias("id"),
            kinds.alias("kinds"),
            F.when(n % 31 != 30, update).alias("trip_update"),
        ).alias("entity"),
        F.col("first_ts"),
    )
    # Ten entities at most per poll, by construction.
    polls = per_entity.select("poll_no", body.alias("b")).groupBy("poll_no").agg(
        F.array_sort(F.collect_list("b"), lambda a, b: (a["entity_no"] - b["entity_no"]).cast("int")).alias("bs")
    )
    first = F.unix_seconds(F.array_min(F.transform("bs", lambda b: b["first_ts"])))
    # The feed clock has whole seconds; the fetch time tells polls of one second apart.
    fetched_us = first * 1_000_000 + F.col("poll_no") % 1_000_000
    return polls.select(
        F.concat_ws("@", F.lit("trips"), fetched_us.cast("string")).alias("poll_id"),
        F.lit("trips").alias("feed"),
        F.timestamp_micros(fetched_us).alias("fetched_at"),
        F.timestamp_seconds(first).alias("header_ts"),
        F.when(F.col("poll_no") % 2 == 0, F.lit("2.0")).alias("version"),
        F.when(F.col("poll_no") % 3 == 0, F.lit("DIFFERENTIAL")).alias("incrementality"),
        F.transform("bs", lambda b: b["entity"]).alias("entities"),
    )


def probe_timetable(spark: SparkSession) -> match.Timetable:
    """Trips T0-T26 of the nested feed in two versions; T0-T2 run on no date.

    Trips of even number lack their fifth stop time, T26 lacks all of them.
    """
    numbers = spark.range(27).select(F.col("id").cast("int").alias("k"))
    both = numbers.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("feed_version_id"))
    trip_id = F.concat(F.lit("T"), F.col("k").cast("string")).alias("trip_id")
    probe_trips = both.select("feed_version_id", trip_id, F.col("k").cast("string").alias("service_id"))
    probe_times = (
        both.withColumn("stop_sequence", F.explode(F.sequence(F.lit(1), F.lit(6))))
        .filter("not (k % 2 = 0 and stop_sequence = 5) and k < 26")
        .select(
            "feed_version_id",
            trip_id,
            "stop_sequence",
            (F.col("k") * 3000 + 1800 + F.col("stop_sequence") * 120).alias("arrival_s"),
        )
    )
    first, last = F.lit("2023-12-30").cast("date"), F.lit("2024-02-02").cast("date")
    runs = (
        both.withColumn("date", F.explode(F.sequence(first, last)))
        .filter("k >= 3 and (datediff(date, date'2024-01-01') + k + 30) % 3 <> 0")
        .select("feed_version_id", F.col("k").cast("string").alias("service_id"), "date")
    )
    return match.Timetable(versions(spark), probe_trips, probe_times, runs)


# -- payloads -----------------------------------------------------------------------


def encode_feeds(nested: DataFrame) -> DataFrame:
    """Nested polls to archived polls with binary payloads (the inverse of decoding)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = "feed string, fetched_at timestamp, http_status int, feed_timestamp timestamp, attempts int, payload binary"
    arrow = to_arrow_schema(StructType.fromDDL(out))
    incrementality = {v: n for n, v in decode.INCREMENTALITY.items()}
    relationship = {v: n for n, v in decode.RELATIONSHIPS.items()}

    def put(message, **values):
        for name, value in values.items():
            if value is not None:
                setattr(message, name, value)

    def payload(row: dict) -> bytes:
        feed = decode.feed_message()()
        put(
            feed.header,
            gtfs_realtime_version=row["version"],
            incrementality=incrementality.get(row["incrementality"]),
            timestamp=int(row["header_ts"].timestamp()),
        )
        for e in row["entities"]:
            entity = feed.entity.add(id=e["id"])
            update = e["trip_update"]
            if update is None:
                entity.alert.SetInParent()
                continue
            target = entity.trip_update
            put(target.trip, trip_id=update["trip"]["trip_id"], route_id=update["trip"]["route_id"])
            target.SetInParent()
            target.trip.SetInParent()
            modified = update["trip"]["modified_trip"]
            if modified is not None:
                target.trip.modified_trip.SetInParent()
                put(target.trip.modified_trip, **modified)
            put(target, timestamp=update["ts"])
            if update["vehicle_id"] is not None:
                target.vehicle.id = update["vehicle_id"]
            for s in update["stop_time_update"]:
                stop = target.stop_time_update.add()
                code = s["schedule_relationship"]
                number = relationship.get(code, int(code) if code and code.isdigit() else None)
                put(stop, stop_sequence=s["stop_sequence"], stop_id=s["stop_id"], schedule_relationship=number)
                if s["arrival_time"] is not None:
                    stop.arrival.time = s["arrival_time"]
                if s["departure_time"] is not None:
                    stop.departure.time = s["departure_time"]
        return feed.SerializeToString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few polls at a time: as Python objects they take ten times and more of what they take in Arrow.
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED_AT_ONCE):
                rows = [
                    {
                        "feed": r["feed"],
                        "fetched_at": r["fetched_at"],
                        "http_status": 200,
                        "feed_timestamp": r["header_ts"],
                        "attempts": 1,
                        "payload": payload(r),
                    }
                    for r in batch.slice(at, ENCODED_AT_ONCE).to_pylist()
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return nested.mapInArrow(encode, out)


def raw_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archived record per event, its properties as the payload."""
    return table(spark, sf_dir, "events").select(
        F.lit("trips").alias("feed"),
        times.as_instant(F.col("ts")).alias("fetched_at"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("timestamp").alias("feed_timestamp"),
        F.lit(1).alias("attempts"),
        F.col("props").cast("binary").alias("payload"),
    )


# -- operations -----------------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed"),
        times.as_instant(F.col("ts")).alias("started_at"),
        (F.col("value") <= 100).alias("ok"),
        F.length("props").alias("payload_bytes"),
    )


def diff_sides(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two copies of the items that differ here and there; ``keep`` writes their base first, for those who read them often."""
    base = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min(F.unix_seconds(times.as_instant(F.col("l_shipdate")))).alias("t"), F.min("l_suppkey").alias("r"))
    )
    if keep:
        base = stored(base, "items")
    key = F.col("l_orderkey")

    def side(df: DataFrame, shift, route) -> DataFrame:
        return df.select(
            F.lit("2024-01-01").cast("date").alias("service_date"),
            key.cast("string").alias("trip_id"),
            F.col("l_linenumber").alias("stop_sequence"),
            F.lit(False).alias("is_modified"),
            F.timestamp_seconds(F.col("t") + shift).alias("observed_arrival"),
            shift.cast("int").alias("delay_seconds"),
            F.lit(1).alias("scheduled_source"),
            route.cast("string").alias("route_id"),
            F.col("l_linenumber").cast("string").alias("stop_id"),
        )

    shift = F.when(key % 10 == 0, F.lit(30)).when(key % 10 == 1, F.lit(90)).otherwise(F.lit(0))
    moved = F.when(key % 50 == 3, F.col("r") + 1).otherwise(F.col("r"))
    a = side(base.filter("l_linenumber <> 7"), F.lit(0), F.col("r"))
    b = side(base.filter("l_linenumber <> 1"), shift, moved)
    return a, b


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    local = docs.select(
        F.col("doc_id").cast("string").alias("key"),
        F.col("n_chars").alias("bytes"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        F.timestamp_seconds(F.lit(1704067200) - (F.col("doc_id") % 200) * 86400).alias("modified_at"),
    )
    i = F.col("key").cast("long")
    remote = local.select(
        F.when(i % 11 == 0, F.concat(F.lit("moved/"), "key")).otherwise(F.col("key")).alias("key"),
        F.when(i % 23 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when(i % 10 == 0, F.lit("0" * 32)).when(i % 17 == 0, F.lit(None)).otherwise(F.upper("md5")).alias("md5"),
    )
    return local, remote


def dump_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("snapshot-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T0830Z.dump")).alias("name")
    )
    strangers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return dated.union(strangers).distinct()


def riders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("point_id"),
        (F.lit(43) + (key % 100) * F.lit(0.001)).alias("lat"),
        (F.lit(-89.5) + F.col("c_nationkey") * F.lit(0.01)).alias("lon"),
    )


def searched_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("stop_id"),
        F.col("p_name").alias("stop_name"),
        F.array("p_brand").alias("headsigns"),
        F.array("p_type").alias("routes"),
        F.col("p_size").alias("n"),
        (F.col("p_size") >= 20).alias("usable"),
    )


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEARCHES)), "query_id int, query string")
