"""Keeping and removing: upload plans, pruning, eviction, dump retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times

GENERATIONS = {"daily": 7, "weekly": 4, "monthly": 12}


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Compare local files with their remote copies by size and digest.

    ``status``: ok, missing, size, nohash (no remote digest) or md5. Anything but
    ok is to be uploaded; only ok is confirmed.
    """
    there = remote.select(
        "key", F.col("bytes").alias("_bytes"), F.lower("md5").alias("_md5"), F.lit(True).alias("_there")
    )
    status = (
        F.when(F.col("_there").isNull(), F.lit("missing"))
        .when(F.col("_bytes") != F.col("bytes"), F.lit("size"))
        .when(F.col("_md5").isNull(), F.lit("nohash"))
        .when(F.col("_md5") != F.col("md5"), F.lit("md5"))
        .otherwise(F.lit("ok"))
    )
    return (
        local.join(there, "key", "left")
        .withColumn("status", status)
        .withColumn("upload", F.col("status") != "ok")
        .withColumn("confirmed", F.col("status") == "ok")
        .drop("_bytes", "_md5", "_there")
    )


def prune_plan(files: DataFrame, confirmed: DataFrame, as_of: Column, keep_days: int) -> DataFrame:
    """Files past the age limit: prune if their copy is confirmed, else withhold."""
    old = files.filter(F.unix_micros("modified_at") < F.unix_micros(as_of) - keep_days * 86_400_000_000)
    known = confirmed.select("key").distinct()
    prune = old.join(known, "key", "left_semi").withColumn("action", F.lit("prune"))
    keep = old.join(known, "key", "left_anti").withColumn("action", F.lit("withhold"))
    return prune.unionByName(keep)


def eviction_plan(
    observations: DataFrame,
    daily: DataFrame,
    today: Column,
    keep_days: int,
    monthly: DataFrame | None = None,
) -> DataFrame:
    """Weeks wholly past retention, droppable once every observed day is rolled up.

    With ``monthly`` given, the months of those days must be rolled up as well.
    """
    days = observations.select("service_date").distinct()
    rolled = daily.select("service_date").distinct().withColumn("_daily", F.lit(True))
    checked = days.join(rolled, "service_date", "left")
    done = F.col("_daily").isNotNull()
    if monthly is not None:
        months = monthly.select(F.col("month").alias("_month")).distinct().withColumn("_monthly", F.lit(True))
        checked = checked.withColumn("_month", F.to_date(F.trunc("service_date", "MM"))).join(months, "_month", "left")
        done = done & F.col("_monthly").isNotNull()
    return (
        checked.groupBy(times.week_start(F.col("service_date")).alias("week_start"))
        .agg(F.count(F.lit(1)).alias("days"), F.count_if(~done).alias("missing_days"))
        .filter(F.date_add("week_start", 6) < F.date_sub(today, keep_days))
        .withColumn("bucket", times.week_bucket(F.col("week_start")))
        .withColumn("droppable", F.col("missing_days") == 0)
    )


def dump_retention(names: DataFrame, prefix: str, keep: dict[str, int] | None = None) -> DataFrame:
    """Generational retention of dumps by name.

    In each generation the newest dump of each of the newest K periods is kept.
    Names that do not parse are always kept.
    """
    keep = keep or GENERATIONS
    period = {"daily": times.day_key, "weekly": times.iso_week_key, "monthly": times.month_key}
    dated = names.select("name", times.snapshot_time(F.col("name"), prefix).alias("dumped_at"))
    parsed = dated.filter("dumped_at is not null")
    kept = None
    for generation, count in keep.items():
        newest = (
            parsed.groupBy(period[generation](F.col("dumped_at")).alias("_period"))
            .agg(F.max(F.struct("dumped_at", "name")).alias("_best"))
            .orderBy(F.desc("_best.dumped_at"))
            .limit(count)
            .select(F.col("_best.name").alias("name"), F.lit(generation).alias("generation"))
        )
        kept = newest if kept is None else kept.unionAll(newest)
    reasons = kept.groupBy("name").agg(F.array_sort(F.collect_set("generation")).alias("generations"))
    return dated.join(reasons, "name", "left").select(
        "name",
        "dumped_at",
        F.coalesce("generations", F.array().cast("array<string>")).alias("generations"),
        (F.col("dumped_at").isNull() | F.col("generations").isNotNull()).alias("retain"),
    )


