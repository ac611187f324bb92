"""Row predicates and classifications of stop updates and observations."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import constants as k


def delay_seconds(observed: Column, scheduled: Column) -> Column:
    """Observed minus scheduled, null while no schedule is matched."""
    return (F.unix_seconds(observed) - F.unix_seconds(scheduled)).cast("int")


def is_countable(source: Column, relationship: Column, delay: Column) -> Column:
    """Whether an observation enters the statistics. Never null."""
    return F.coalesce(
        (source == k.SOURCE_STATIC)
        & (relationship == k.REL_SCHEDULED)
        & delay.isNotNull()
        & (F.abs(delay) < k.MAX_PLAUSIBLE_DELAY_S),
        F.lit(False),
    )


def register_sql(spark: SparkSession) -> None:
    """Offer the countable rule to SQL users as a temporary function."""
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION observation_is_countable(src INT, rel INT, delay INT)
        RETURNS BOOLEAN
        RETURN coalesce(src = {k.SOURCE_STATIC} AND rel = {k.REL_SCHEDULED}
                        AND delay IS NOT NULL AND abs(delay) < {k.MAX_PLAUSIBLE_DELAY_S}, false)
        """
    )


def skip_reason(relationship: Column, arrival: Column, departure: Column) -> Column:
    """Why a stop update yields no row, or null if it does; NO_DATA comes first."""
    return (
        F.when(relationship == k.REL_NO_DATA, F.lit("no_data"))
        .when(arrival.isNotNull(), F.lit(None).cast("string"))
        .when(departure.isNotNull(), F.lit("departure_only"))
        .otherwise(F.lit("no_time"))
    )


def relationship_code(value: Column) -> Column:
    """Numbers pass, known names map to their code, all else is SCHEDULED."""
    named = (
        F.when(value == "SKIPPED", F.lit(k.REL_SKIPPED))
        .when(value == "NO_DATA", F.lit(k.REL_NO_DATA))
        .when(value == "UNSCHEDULED", F.lit(k.REL_UNSCHEDULED))
    )
    return F.coalesce(value.try_cast("int"), named, F.lit(k.REL_SCHEDULED))


def is_settled(last_seen: Column, as_of: Column, settled_s: int = k.SETTLED_S) -> Column:
    return F.unix_micros(last_seen) < F.unix_micros(as_of) - settled_s * 1_000_000
