"""Collection coverage: scheduled against observed stop events per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as k
from . import calendar

VERSION = "feed_version_id"


def bind_days(days: DataFrame, versions: DataFrame, policy: str = "latest") -> DataFrame:
    """(service_date, feed_version_id): the newest version, or the one in effect."""
    if policy == "in_effect":
        return calendar.bind_version(days, versions, "service_date").filter(F.col(VERSION).isNotNull())
    if policy != "latest":
        raise ValueError(f"unknown feed policy: {policy}")
    latest = calendar.latest_version(versions).scalar()
    return days.select("service_date", latest.alias(VERSION)).filter(F.col(VERSION).isNotNull())


def match_words(scheduled: DataFrame, observed: DataFrame) -> DataFrame:
    """Every scheduled event and word with ``seen``, the days among ``bits`` on which it was observed.

    scheduled: :func:`headwise.operators.calendar.event_words`; observed: :func:`observed_words`. One row for an event and 64 days.
    """
    keys = [*([VERSION] if VERSION in observed.columns else []), "trip_id", "stop_sequence", "word"]
    joined = scheduled.join(observed.withColumnRenamed("bits", "_seen"), keys, "left")
    return joined.withColumn("seen", F.coalesce(F.col("bits").bitwiseAND(F.col("_seen")), F.lit(0))).drop("_seen")


def observed_words(observations: DataFrame, version: Column | None = None) -> DataFrame:
    """Days on which each stop event was observed; a trip and its modified twin count once.

    One exchange, on the event: neither the day nor the service deals the rows out.
    """
    keys = ["trip_id", "stop_sequence"]
    if version is not None:
        observations, keys = observations.withColumn(VERSION, version), [VERSION, *keys]
    return calendar.day_words(observations, keys, "service_date")


def _version_on(bound: DataFrame) -> Column:
    """The version of a row's ``service_date`` from (service_date, feed_version_id), a row for each day.

    The days go along as one array by number, so rows need no join to learn theirs.
    """
    by_day = F.map_from_entries(F.collect_list(F.struct("service_date", VERSION)))
    first, last = F.min("service_date"), F.max("service_date")
    one = bound.agg(first.alias("first"), F.transform(F.sequence(first, last), lambda d: F.try_element_at(by_day, d)).alias("versions")).select(
        F.struct("first", "versions").alias("days")
    ).scalar()
    return F.get(one["versions"], F.date_diff("service_date", one["first"]))


def day_coverage(
    observations: DataFrame,
    versions: DataFrame,
    trips: DataFrame,
    stop_times: DataFrame,
    services: DataFrame,
    gaps: DataFrame,
    as_of: Column,
    policy: str = "latest",
) -> DataFrame:
    """Coverage of every completed day that has observations.

    Days are bits. Observations are gathered to words of days by event, once, and keep the days on
    which their trip's service runs; scheduled events are counted per service. Both are summed over
    bit columns, so the timetable is never multiplied by days.
    """
    finished = observations.filter(F.col("service_date") < as_of)
    # One value a day, read once; everything below needs them.
    observed_days = [(r.service_date,) for r in finished.select("service_date").distinct().collect()]
    days = bind_days(observations.sparkSession.createDataFrame(observed_days, "service_date date"), versions, policy)
    # The observed days that each version applies to.
    applies = calendar.day_words(days, [VERSION], "service_date").withColumnRenamed("bits", "_applies")
    running = calendar.day_words(services, [VERSION, "service_id"], "date").join(applies, [VERSION, "word"])
    running = running.select(VERSION, "service_id", "word", F.col("bits").bitwiseAND(F.col("_applies")).alias("bits"))

    sized = calendar.trip_lengths(trips.select(VERSION, "trip_id", "service_id"), stop_times)
    per_service = sized.groupBy(VERSION, "service_id").agg(F.sum("n_stops").alias("events"))
    scheduled = calendar.counts_per_day(
        running.join(per_service, [VERSION, "service_id"]), {"scheduled_stop_events": (F.col("bits"), F.col("events"))}
    )

    of_trips = trips.select(VERSION, "trip_id", "service_id").join(running, [VERSION, "service_id"]).drop("service_id")
    hits = (
        observed_words(finished, _version_on(days))
        .join(stop_times.select(VERSION, "trip_id", "stop_sequence"), [VERSION, "trip_id", "stop_sequence"], "left_semi")
        .withColumnRenamed("bits", "_seen")
        .join(of_trips, [VERSION, "trip_id", "word"])
    )
    both = F.col("bits").bitwiseAND(F.col("_seen"))
    observed = calendar.counts_per_day(hits, {"observed_stop_events": (both, F.lit(1))})
    counted = (
        days.select("service_date")
        .join(scheduled, "service_date", "left")
        .join(observed, "service_date", "left")
        .fillna(0, ["scheduled_stop_events", "observed_stop_events"])
    )
    return annotate(counted.withColumn("coverage_pct", coverage_pct()), gaps)


def write_coverage(coverage: DataFrame, path: str) -> None:
    """The coverage table, a partition for each day; days that are no longer covered go."""
    coverage.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("service_date").parquet(path)


def coverage_pct() -> Column:
    """One decimal, half away from zero, by exact decimal arithmetic; 0 if nothing was scheduled."""
    s, o = F.col("scheduled_stop_events"), F.col("observed_stop_events")
    share = F.round(o.cast("decimal(18,0)") * 100 / F.nullif(s, F.lit(0)).cast("decimal(18,0)"), 1)
    return F.coalesce(share.cast("double"), F.lit(0.0))


def annotate(coverage: DataFrame, gaps: DataFrame) -> DataFrame:
    """Attach operator-supplied reasons; a day known only as a gap has zero counts."""
    joined = coverage.join(gaps.select("service_date", "known_gap_reason"), "service_date", "full_outer")
    return joined.fillna(0, ["scheduled_stop_events", "observed_stop_events"]).fillna(0.0, ["coverage_pct"])


def merge_gaps(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Known gaps after seeding: a reason an operator has set is never replaced."""
    ours = existing.select("service_date", F.col("known_gap_reason").alias("_ours"))
    theirs = seed.select("service_date", F.col("known_gap_reason").alias("_seed"))
    return ours.join(theirs, "service_date", "full_outer").select(
        "service_date", F.coalesce("_ours", "_seed").alias("known_gap_reason")
    )


def coverage_alerts(coverage: DataFrame, date: Column, ok_pct: float = k.COVERAGE_OK_PCT) -> DataFrame:
    """The given day, if it is low and nobody has explained it."""
    return coverage.filter(
        (F.col("service_date") == date) & F.col("known_gap_reason").isNull() & (F.col("coverage_pct") < ok_pct)
    )
