"""Which timetable applies, and which services run on which date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import times
from ..sources.gtfs import WEEKDAYS


def completed(versions: DataFrame) -> DataFrame:
    return versions.filter("load_completed_at is not null")


def latest_version(versions: DataFrame) -> DataFrame:
    """One row: the completed version loaded last (null if there is none)."""
    return completed(versions).agg(F.max_by("feed_version_id", "loaded_at").alias("feed_version_id"))


def with_version(rows: DataFrame, versions: DataFrame, date: str) -> DataFrame:
    """``rows`` with the feed_version_id to use on their ``date``; see :func:`bind_version`."""
    valid = completed(versions).select(
        F.explode(F.sequence("feed_start_date", "feed_end_date")).alias(date), "feed_version_id", "loaded_at"
    )
    per_day = valid.groupBy(date).agg(F.max_by("feed_version_id", "loaded_at").alias("_covering"))
    latest = latest_version(versions).scalar()
    return (
        rows.join(per_day, date, "left")
        .withColumn("feed_version_id", F.coalesce("_covering", latest))
        .drop("_covering")
    )


def bind_version(dates: DataFrame, versions: DataFrame, date: str = "date") -> DataFrame:
    """The version to use on each date.

    Of the completed versions valid on the date the one loaded last, else the one
    loaded last of all, else null. Validity windows are expanded to days, so the
    interval condition is an equi-join.
    """
    return with_version(dates.select(date).distinct(), versions, date)


def service_dates(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """(feed_version_id, service_id, date) on which each service runs.

    Weekday pattern within the validity window, minus removed dates, plus added
    ones.
    """
    key = ["feed_version_id", "service_id", "date"]
    pattern = (
        calendar.filter("start_date <= end_date")
        .withColumn("date", F.explode(F.sequence("start_date", "end_date")))
        .filter(times.runs_on_weekday(F.col("date"), [F.col(d) for d in WEEKDAYS]))
        .select(*key)
    )
    removed = calendar_dates.filter(F.col("exception_type") == k.SERVICE_REMOVED).select(*key)
    added = calendar_dates.filter(F.col("exception_type") == k.SERVICE_ADDED).select(*key)
    return pattern.join(removed, key, "left_anti").union(added).distinct()


def trip_lengths(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    sizes = stop_times.groupBy("feed_version_id", "trip_id").agg(F.count(F.lit(1)).alias("n_stops"))
    return trips.join(sizes, ["feed_version_id", "trip_id"])


def representative_trips(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The longest trip of each (route, direction); the lowest id on a tie."""
    w = Window.partitionBy("feed_version_id", "route_id", "direction_id").orderBy(F.desc("n_stops"), "trip_id")
    return (
        trip_lengths(trips.filter("direction_id is not null"), stop_times)
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn")
    )


def stop_order(representative: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops of the representative trips in travel order."""
    return (
        representative.select("feed_version_id", "trip_id", "route_id", "direction_id", "trip_headsign")
        .join(stop_times.select("feed_version_id", "trip_id", "stop_sequence", "stop_id"), ["feed_version_id", "trip_id"])
        .join(stops.select("feed_version_id", "stop_id", "stop_name"), ["feed_version_id", "stop_id"], "left")
        .select("route_id", "direction_id", "trip_headsign", "stop_sequence", "stop_id", "stop_name")
    )


def stop_positions(order: DataFrame) -> DataFrame:
    """Per (route, stop): last position over (direction, sequence), and the route's longest."""
    longest = order.groupBy("route_id").agg(F.max("stop_sequence").alias("max_seq"))
    return (
        order.groupBy("route_id", "stop_id")
        .agg(F.max(F.struct("direction_id", "stop_sequence"))["stop_sequence"].alias("seq"))
        .join(longest, "route_id")
    )


# -- running days as bits -----------------------------------------------------------
#
# A set of days is kept as 64-bit words: ``word`` numbers 64 days at a time, counted from 1970, and bit
# i of ``bits`` stands for the day ``64 * word + i``. A year takes six or seven words.


def day_word(day: Column) -> Column:
    return F.floor(F.unix_date(day) / 64).cast("int")


def day_bit(day: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.unix_date(day), F.lit(64)).cast("int"))


def day_words(rows: DataFrame, by: list[str], day: str) -> DataFrame:
    """(by, word, bits): the days of each group; a day counts once however often it stands."""
    return rows.groupBy(*by, day_word(F.col(day)).alias("word")).agg(F.bit_or(day_bit(F.col(day))).alias("bits"))


def service_days(services: DataFrame) -> DataFrame:
    """(feed_version_id, service_id, days): the running days of a service as a map of word to bits."""
    key = ["feed_version_id", "service_id"]
    words = day_words(services, key, "date")
    return words.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("days"))


def runs_on(days: Column, day: Column) -> Column:
    """Whether ``day`` is among ``days`` (:func:`service_days`); false for no days at all."""
    held = F.try_element_at(days, day_word(day)).bitwiseAND(day_bit(day))
    return F.coalesce(held != 0, F.lit(False))


def counts_per_day(words: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """(service_date, one sum for each name): weights of (bits, weight) summed by day, zero days left out.

    weights: name -> (column of bits, weight of a row). The sums are taken over the 64 bit columns of a
    word, so rows are never multiplied by days.
    """
    bit = lambda bits, i: F.shiftrightunsigned(bits, i).bitwiseAND(F.lit(1).cast("bigint"))
    sums = {name: F.array(*[F.sum(bit(bits, i) * weight) for i in range(64)]) for name, (bits, weight) in weights.items()}
    per_word = words.groupBy("word").agg(*[c.alias(name) for name, c in sums.items()])
    # One row for each word: 64 rows each from here on.
    per_day = per_word.select("word", F.posexplode(F.arrays_zip(*sums)).alias("i", "n"))
    day = F.date_from_unix_date((F.col("word") * 64 + F.col("i")).cast("int"))
    out = per_day.select(day.alias("service_date"), *[F.col(f"n.{name}").alias(name) for name in sums])
    return out.filter(" or ".join(f"{name} > 0" for name in sums))


def event_words(services: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Scheduled stop events, one row for each event and word of running days:
    (feed_version_id, trip_id, stop_sequence, word, bits)."""
    version = "feed_version_id"
    days = day_words(services, [version, "service_id"], "date")
    return (
        stop_times.select(version, "trip_id", "stop_sequence")
        .join(trips.select(version, "trip_id", "service_id").join(days, [version, "service_id"]), [version, "trip_id"])
        .select(version, "trip_id", "stop_sequence", "word", "bits")
    )


def scheduled_events(services: DataFrame, trips: DataFrame, stop_times: DataFrame, day: Column) -> DataFrame:
    """The scheduled stop events of one day: (service_date, trip_id, stop_sequence)."""
    on_day = services.filter(F.col("date") == day)
    version = "feed_version_id"
    return (
        on_day.join(trips.select(version, "trip_id", "service_id"), [version, "service_id"])
        .join(stop_times.select(version, "trip_id", "stop_sequence"), [version, "trip_id"])
        .select(F.col("date").alias("service_date"), "trip_id", "stop_sequence")
    )
