"""Queries: timetable files, archive shards and table sinks, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, collapse
from ..session import scratch_path
from ..sources import archive, gtfs, tables
from . import documents, queries_serving
from . import standins as v
from .catalog import query
from .oracle import DIMS, with_
from .queries_stats import _COLLAPSED, _SERVING, BUCKET, ORDER

D = "strftime(service_date, '%Y-%m-%d') AS service_date"


def _write_trips(spark, sf) -> str:
    """A trips.txt with padding, an extra column, and no block_id or shape_id."""
    root = scratch_path(spark, "gtfs")
    trips = v.trips(spark, sf).select(
        F.lit("x").alias("extra"),
        F.concat(F.lit(" "), "service_id", F.lit("  ")).alias("service_id"),
        "route_id",
        "trip_id",
        F.when(F.col("direction_id") == 0, "").otherwise(F.col("direction_id").cast("string")).alias("direction_id"),
        F.when(F.col("trip_headsign") != "to P", F.col("trip_headsign")).alias("trip_headsign"),
    )
    trips.write.csv(f"{root}/trips.txt", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return root


def _write_stop_times(spark, sf) -> str:
    root = scratch_path(spark, "gtfs")
    s = F.col("arrival_s")
    hms = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    rows = v.stop_times(spark, sf).select(
        "trip_id",
        "stop_sequence",
        "stop_id",
        F.when(F.col("stop_sequence") == 7, F.lit("7h")).otherwise(hms).alias("arrival_time"),
        hms.alias("departure_time"),
        F.when(F.col("stop_sequence") == 1, "1").otherwise("0").alias("timepoint"),
    )
    rows.write.csv(f"{root}/stop_times.txt", header=True)
    return root


@query(
    "s1_gtfs_csv",
    with_("trips")
    + """SELECT trip_id, route_id, service_id, CASE WHEN trip_headsign <> 'to P' THEN trip_headsign END AS trip_headsign,
      CASE WHEN direction_id <> 0 THEN CAST(direction_id AS VARCHAR) END AS direction_id, CAST(NULL AS VARCHAR) AS block_id, CAST(NULL AS VARCHAR) AS shape_id FROM trips""",
)
def _(spark, sf):
    return gtfs.read_csv(spark, _write_trips(spark, sf), "trips").drop(gtfs.FILE_ORDER)


@query(
    "s2_typed_stop_times",
    with_("stop_times")
    + """SELECT trip_id, stop_sequence, stop_id, CASE WHEN stop_sequence <> 7 THEN arrival_s END AS arrival_s, arrival_s AS departure_s,
      stop_sequence = 1 AS timepoint, CAST(NULL AS INT) AS pickup_type, CAST(NULL AS INT) AS drop_off_type FROM stop_times""",
)
def _(spark, sf):
    return gtfs.read_table(spark, _write_stop_times(spark, sf), "stop_times")


@query(
    "s3_first_row_wins",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct("l_partkey", "l_suppkey").alias("place")
    )
    return gtfs.first_by_key(rows, ["l_orderkey", "l_linenumber"], "place")


@query(
    "s4_pending_versions",
    """SELECT strftime(m, '%Y-%m') AS feed_version, strftime(min(d), '%Y-%m-%d') AS feed_start_date, strftime(max(d), '%Y-%m-%d') AS feed_end_date
    FROM (SELECT date_trunc('month', o_orderdate) AS m, o_orderdate AS d FROM orders) WHERE month(m) % 3 <> 0 GROUP BY m""",
)
def _(spark, sf):
    """Versions on offer that were never loaded, or whose load did not complete."""
    days = v.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    offered = days.groupBy(F.date_format("d", "yyyy-MM").alias("feed_version")).agg(
        F.min("d").alias("feed_start_date"), F.max("d").alias("feed_end_date")
    )
    loaded = days.filter(F.month("d") % 3 != 1).groupBy(F.date_format("d", "yyyy-MM").alias("feed_version")).agg(
        F.max(F.when(F.month("d") % 3 == 0, F.col("d"))).alias("load_completed_at")
    )
    return gtfs.pending_versions(offered, loaded)


_LOADS = """WITH t AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders)
    SELECT * FROM (SELECT 'first' AS load, 1 AS feed_version_id, false AS skipped, count(*) AS trips, 0 AS junk, 1 AS versions FROM t
    UNION ALL SELECT 'again', 1, true, count(*), 0, 1 FROM t
    UNION ALL SELECT 'forced', 1, false, count(*) FILTER (WHERE k % 2 = 0), 0, 1 FROM t
    UNION ALL SELECT 'second', 2, false, count(*) FILTER (WHERE k % 3 = 0), 0, 2 FROM t)"""


@query("s4_load_protocol", _LOADS)
def _(spark, sf):
    """A load over what a dead one left, one that is skipped, a forced one, and another version beside it."""
    store, junk = scratch_path(spark, "static"), "trip_id string, route_id string, service_id string, feed_version_id int"

    def directory(version, kept):
        at = scratch_path(spark, "gtfs")
        write = lambda df, name: df.write.option("header", "true").csv(f"{at}/{name}.txt")
        trips = v.trips(spark, sf).filter(kept)
        write(spark.createDataFrame([(version, "20240101", "20240131")], "feed_version string, feed_start_date string, feed_end_date string").coalesce(1), "feed_info")
        write(trips.selectExpr("trip_id", "route_id", "service_id", "trip_headsign", "direction_id"), "trips")
        write(trips.select("route_id").distinct(), "routes")
        write(v.stops(spark, sf).select("stop_id", "stop_name", "stop_lat", "stop_lon"), "stops")
        write(trips.selectExpr("trip_id", "1 as stop_sequence", "'0' as stop_id", "'08:00:00' as arrival_time", "'08:00:00' as departure_time"), "stop_times")
        write(trips.selectExpr("service_id", *[f"1 as {d}" for d in calendar.WEEKDAYS], "'20240101' as start_date", "'20240131' as end_date").distinct(), "calendar")
        write(trips.limit(0).selectExpr("service_id", "'20240101' as date", "1 as exception_type"), "calendar_dates")
        return at

    # A load that died: trips of the version to come, no word of it in the registry.
    dead = spark.createDataFrame([("junk", "r", "s", 1)] * 3, junk)
    tables.replace_partitions(dead, f"{store}/trips", ["feed_version_id"])
    out = None
    for name, version, kept, force in (("first", "A", "true", False), ("again", "A", "trip_id % 2 = 0", False), ("forced", "A", "trip_id % 2 = 0", True), ("second", "B", "trip_id % 3 = 0", False)):
        done = gtfs.load_static(spark, directory(version, kept), store, force=force)
        trips = gtfs.stored_table(spark, store, "trips").filter(F.col("feed_version_id") == done.feed_version_id)
        row = trips.agg(F.count("*").alias("trips"), F.count_if(F.col("trip_id") == "junk").cast("int").alias("junk"))
        versions = gtfs.registry(spark, store).filter("load_completed_at is not null").count()
        row = v.stored(row.select(F.lit(name).alias("load"), F.lit(done.feed_version_id).alias("feed_version_id"), F.lit(done.skipped).alias("skipped"), "trips", "junk", F.lit(versions).cast("int").alias("versions")), "load")
        out = row if out is None else out.union(row)
    return out


def _archived(spark, sf):
    root = scratch_path(spark, "archive")
    archive.write_archive(v.raw_polls(spark, sf), root)
    return archive.read_archive(spark, root)


@query(
    "s5_s6_archive_round_trip",
    """SELECT 'trips' AS feed, epoch_us(ts) AS fetched_at, 200 AS http_status, CAST(NULL AS BIGINT) AS feed_timestamp, 1 AS attempts,
      CAST(length(props) AS INT) AS payload_bytes, md5(props) AS digest FROM events""",
)
def _(spark, sf):
    return _archived(spark, sf).withColumn("digest", F.md5("payload")).drop("payload")


@query(
    "s6_archive_shards",
    """SELECT 'trips' AS shard_feed, strftime(ts, '%Y-%m-%d') AS shard_date, strftime(ts, '%H') AS shard_hour, count(*) AS records
    FROM events GROUP BY ALL""",
)
def _(spark, sf):
    lines = archive.archive_lines(v.raw_polls(spark, sf))
    return lines.groupBy(*archive.SHARD_COLUMNS).agg(F.count(F.lit(1)).alias("records"))


@query("s7_observation_sink", with_("collapsed") + f"SELECT {_COLLAPSED} FROM collapsed")
def _(spark, sf):
    path = scratch_path(spark, "observations")
    observations = collapse.collapse(v.predictions(spark, sf), ORDER)
    tables.write_observations(observations, path)
    return spark.read.parquet(path).select(*observations.columns)


@query(
    "s8_replace_period",
    with_("daily") + f"SELECT {D}, {DIMS}, {BUCKET} FROM daily WHERE service_date <> DATE '2024-01-09'",
)
def _(spark, sf):
    """Two days spoiled and one stale, then rebuilt: one of them to nothing."""
    path = scratch_path(spark, "rollup")
    daily = v.daily(spark, sf)
    spoiled = daily.filter("service_date in (date'2024-01-08', date'2024-01-09')").withColumn("n", F.lit(-1).cast("long"))
    tables.write_period(spoiled, path, "service_date")
    tables.write_period(
        daily.filter("service_date <> date'2024-01-09'"), path, "service_date", ["2024-01-08", "2024-01-09"]
    )
    return spark.read.parquet(path).select(*daily.columns)


@query("s9_serving_swap", with_("cells") + _SERVING)
def _(spark, sf):
    path = scratch_path(spark, "serving")
    cells = v.cells(spark, sf)
    for n in (-1, -2):
        tables.swap(cells.withColumn("n", F.lit(n).cast("long")), path, "cells")
    tables.swap(cells, path, "cells")
    return tables.current(spark, path)


@query(
    "s10_s11_s12_site_files",
    with_("cells")
    + "SELECT 'stops' AS kind, count(DISTINCT stop_id) AS files FROM cells UNION ALL SELECT 'routes', count(DISTINCT route_id) FROM cells",
)
def _(spark, sf):
    root = scratch_path(spark, "site")
    q = queries_serving
    daily, cells = q._tiers(spark, sf)
    stops = documents.stop_documents(cells, q._metadata(spark, sf, cells), q._stamp())
    documents.write_site(stops, q._route_documents(spark, sf, cells), q._index(spark, sf, daily, cells), root)
    parts = [
        spark.read.text(f"{root}/{kind}").select(F.lit(kind).alias("kind")) for kind in ("stops", "routes")
    ]
    return parts[0].unionAll(parts[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


@query(
    "s13_runs_appended",
    with_("runs")
    + """SELECT strftime(started_at, '%Y-%m-%d') AS run_date, feed, count(*) AS polls FROM runs
    WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY - INTERVAL 12 HOUR GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "runs")
    tables.append_runs(v.runs(spark, sf), path)
    tables.prune_runs(spark, path, F.lit("2024-01-30 12:00:00").cast("timestamp"), 20)
    return spark.read.parquet(path).groupBy("run_date", "feed").agg(F.count(F.lit(1)).alias("polls"))


