"""Static timetable: CSV reading, typing, key dedupe and versioned loading."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import constants as k
from ..functions import times
from . import tables

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

# Columns read from each CSV file, by header name.
CSV_COLUMNS = {
    "feed_info": ("feed_version", "feed_start_date", "feed_end_date"),
    "routes": ("route_id", "route_short_name", "route_long_name", "route_type", "route_color"),
    "stops": ("stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon"),
    "trips": (
        "trip_id", "route_id", "service_id", "trip_headsign", "direction_id", "block_id", "shape_id",
    ),
    "calendar": ("service_id", *WEEKDAYS, "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "stop_times": (
        "trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time", "timepoint",
        "pickup_type", "drop_off_type",
    ),
}

#: Position of a row in its file, for rules where the first row wins.
FILE_ORDER = "_file_order"


def read_csv(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """One timetable file as trimmed strings; absent columns are null.

    Columns are found by name, since feeds order and extend them freely.
    """
    raw = spark.read.csv(
        f"{directory.rstrip('/')}/{table}.txt",
        header=True,
        inferSchema=False,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    found = {name.strip().lstrip("﻿"): name for name in raw.columns}
    picked = [
        (F.col(f"`{found[c]}`") if c in found else F.lit(None).cast("string")).alias(c)
        for c in CSV_COLUMNS[table]
    ]
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias(FILE_ORDER)
    return raw.select(*picked, order)


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _int(name: str) -> Column:
    return _text(name).try_cast("int").alias(name)


def _float(name: str) -> Column:
    return _text(name).try_cast("double").alias(name)


def _flag(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)) == "1", F.lit(False)).alias(name)


def _day(name: str) -> Column:
    return F.to_date(F.try_to_timestamp(_text(name), F.lit("yyyyMMdd"))).alias(name)


def _key(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")).alias(name)


def typed(raw: DataFrame, table: str, strict: bool = False) -> DataFrame:
    """Cast one table's strings to the declared types.

    A missing time column counts as 00:00:00. A blank or malformed time is null,
    or an error if ``strict``.
    """

    def seconds(name: str, alias: str) -> Column:
        if name not in raw.columns:
            return F.lit(0).alias(alias)
        return times.parse_gtfs_time(F.col(name), strict).alias(alias)

    columns = {
        "feed_info": lambda: [
            _text("feed_version").alias("feed_version"), _day("feed_start_date"), _day("feed_end_date"),
        ],
        "routes": lambda: [
            _key("route_id"),
            _text("route_short_name").alias("route_short_name"),
            _text("route_long_name").alias("route_long_name"),
            _int("route_type"),
            _text("route_color").alias("route_color"),
        ],
        "stops": lambda: [
            _key("stop_id"),
            _text("stop_code").alias("stop_code"),
            _text("stop_name").alias("stop_name"),
            _float("stop_lat"),
            _float("stop_lon"),
        ],
        "trips": lambda: [
            _key("trip_id"), _key("route_id"), _key("service_id"),
            _text("trip_headsign").alias("trip_headsign"),
            _int("direction_id"),
            _text("block_id").alias("block_id"),
            _text("shape_id").alias("shape_id"),
        ],
        "calendar": lambda: [
            _key("service_id"), *[_flag(d) for d in WEEKDAYS], _day("start_date"), _day("end_date"),
        ],
        "calendar_dates": lambda: [
            _key("service_id"), _day("date"),
            F.coalesce(_int("exception_type"), F.lit(k.SERVICE_ADDED)).alias("exception_type"),
        ],
        "stop_times": lambda: [
            _key("trip_id"),
            F.coalesce(_int("stop_sequence"), F.lit(0)).alias("stop_sequence"),
            _key("stop_id"),
            seconds("arrival_time", "arrival_s"),
            seconds("departure_time", "departure_s"),
            _flag("timepoint"),
            _int("pickup_type"),
            _int("drop_off_type"),
        ],
    }[table]()
    kept = [FILE_ORDER] if FILE_ORDER in raw.columns else []
    return raw.select(*columns, *kept)


def first_by_key(df: DataFrame, keys: Sequence[str], order: str = FILE_ORDER) -> DataFrame:
    """The first row of each key, in file order.

    Spark limits each map partition to one row per key before the shuffle, so
    a key repeated very often stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", order)


def read_table(spark: SparkSession, directory: str, table: str, strict: bool = False) -> DataFrame:
    """Read, type and dedupe one timetable table."""
    df = typed(read_csv(spark, directory, table), table, strict)
    return first_by_key(df, schemas.STATIC_KEYS[table]) if table in schemas.STATIC_KEYS else df.drop(FILE_ORDER)


def stored_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    """One timetable table of the versioned store, all versions; it may be empty."""
    ddl = f"{schemas.STATIC[table]}, feed_version_id int"
    return spark.read.schema(ddl).parquet(f"{store.rstrip('/')}/{table}")


# -- versions -----------------------------------------------------------------


@dataclass(frozen=True)
class LoadResult:
    feed_version_id: int
    feed_version: str
    skipped: bool


def registry(spark: SparkSession, store: str) -> DataFrame:
    """Loaded versions, the newest load of each; empty before the first load."""
    path = f"{store.rstrip('/')}/feed_versions"
    if not tables.exists(spark, path):
        return spark.createDataFrame([], schemas.FEED_VERSIONS)
    rows = spark.read.schema(schemas.FEED_VERSIONS).parquet(path)
    w = Window.partitionBy("feed_version").orderBy(F.desc("loaded_at"), F.desc("feed_version_id"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pending_versions(feed_info: DataFrame, loaded: DataFrame) -> DataFrame:
    """Versions offered in ``feed_info`` that have no completed load."""
    done = loaded.filter("load_completed_at is not null").select("feed_version")
    return feed_info.join(done, "feed_version", "left_anti")


def load_static(
    spark: SparkSession,
    directory: str,
    store: str,
    *,
    source_url: str = "",
    sha256: str = "",
    force: bool = False,
    strict: bool = False,
) -> LoadResult:
    """Load one timetable directory into the versioned store.

    A version that is already complete is skipped unless ``force``. The registry
    row is appended last, so a load that dies half-way is never read, and its
    partitions are overwritten by the next attempt.
    """
    store = store.rstrip("/")
    info = typed(read_csv(spark, directory, "feed_info"), "feed_info").orderBy(FILE_ORDER).drop(FILE_ORDER).limit(1)
    head = info.first()
    if head is None:
        raise ValueError(f"feed_info.txt in {directory} is empty")
    known = registry(spark, store)
    same = known.filter(F.col("feed_version") == head.feed_version).first()
    if same is not None and same.load_completed_at is not None and not force:
        return LoadResult(same.feed_version_id, head.feed_version, True)
    if same is not None:
        version_id = same.feed_version_id
    else:
        version_id = (known.agg(F.max("feed_version_id")).first()[0] or 0) + 1

    started = F.current_timestamp()
    for table in schemas.STATIC_KEYS:
        tables.replace_partition(read_table(spark, directory, table, strict), f"{store}/{table}", {"feed_version_id": version_id})
    row = info.select(
        F.lit(version_id).alias("feed_version_id"),
        "feed_version", "feed_start_date", "feed_end_date",
        F.lit(source_url).alias("source_url"),
        F.lit(sha256).alias("sha256"),
        started.alias("loaded_at"),
        started.alias("load_completed_at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{store}/feed_versions")
    return LoadResult(version_id, head.feed_version, False)
