"""Daily and monthly buckets, the serving tier, and sums over them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import predicates, stats
from ..schemas import CELL_DIMS, ROLLUP_DIMS


def countable(observations: DataFrame) -> DataFrame:
    """Observations that enter the statistics, with both bucket keys known."""
    return observations.filter(
        predicates.is_countable(
            F.col("scheduled_source"), F.col("schedule_relationship"), F.col("delay_seconds")
        )
        & F.col("scheduled_hour_local").isNotNull()
        & F.col("day_type").isNotNull()
    )


def percentile_int(value: Column, p: float) -> Column:
    """Exact interpolated percentile, rounded half to even.

    Interpolation noise is rounded off first, so that halves stay halves. Spark counts distinct values per group and merges the counts; delays are
    whole seconds within two hours, so a group holds 14,399 counts at most.
    """
    return F.rint(F.round(F.percentile(value, p), 6)).cast("int")


def _measures() -> list[Column]:
    d = F.col("delay_seconds")
    wide = d.cast("long")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(wide).alias("sum_delay"),
        F.sum(wide * wide).alias("sum_delay_sq"),
        F.min(d).alias("min_delay"),
        F.max(d).alias("max_delay"),
        percentile_int(d, 0.5).alias("p50_delay"),
        percentile_int(d, 0.9).alias("p90_delay"),
        F.count_if(d >= k.LATE_S).alias("n_late_240"),
        F.count_if(d >= k.VERY_LATE_S).alias("n_late_300"),
        F.count_if(d <= k.EARLY_S).alias("n_early_60"),
    ]


def _rollup(observations: DataFrame, period: Column, name: str) -> DataFrame:
    return (
        countable(observations)
        .select(
            period.alias(name),
            "route_id",
            "stop_id",
            F.col("scheduled_hour_local").alias("hour_of_day"),
            "day_type",
            "delay_seconds",
        )
        .groupBy(name, *ROLLUP_DIMS)
        .agg(*_measures())
    )


def rollup_daily(observations: DataFrame, dates: Iterable[object] | None = None) -> DataFrame:
    """Buckets per service date; ``dates`` prunes the scan to those partitions."""
    if dates is not None:
        observations = observations.filter(F.col("service_date").isin([str(d) for d in dates]))
    return _rollup(observations, F.col("service_date"), "service_date")


def rollup_monthly(observations: DataFrame, months: Iterable[object] | None = None) -> DataFrame:
    """Buckets per month, from raw observations: percentiles do not compose."""
    if months is not None:
        firsts = [F.lit(str(m)[:7] + "-01").cast("date") for m in months]
        within = F.lit(False)
        for first in firsts:
            within = within | (
                (F.col("service_date") >= first) & (F.col("service_date") < F.add_months(first, 1))
            )
        observations = observations.filter(within)
    return _rollup(observations, F.to_date(F.trunc("service_date", "MM")), "month")


def combine(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact totals of any set of buckets: n, sums, counts, mean, sd, late share."""
    summed = buckets.groupBy(*keys).agg(*stats.bucket_sums())
    n, total, total_sq = (F.col(c) for c in ("n", "sum_delay", "sum_delay_sq"))
    return summed.withColumns(
        {
            "mean_delay": stats.mean_delay(n, total),
            "stddev_delay": stats.population_sd(n, total, total_sq),
            "pct_late_240": stats.percent(F.col("n_late_240"), n),
        }
    )


def without_gaps(daily: DataFrame, coverage: DataFrame) -> DataFrame:
    """Leave out days with a diagnosed collection gap."""
    gaps = coverage.filter("known_gap_reason is not null").select("service_date").distinct()
    return daily.join(gaps, "service_date", "left_anti")


def serving_stats(
    daily: DataFrame, coverage: DataFrame, as_of: Column | None = None, window_days: int | None = None
) -> DataFrame:
    """Serving tier per (stop, route, hour, day type) over a trailing window.

    Sums are exact; p50 and p90 are n-weighted means of the daily ones.
    """
    if window_days is not None:
        daily = daily.filter(F.col("service_date") >= F.date_sub(as_of, window_days))
    n = F.sum(F.col("n").cast("long"))

    def weighted(c: str) -> Column:
        return F.round(stats.ratio(F.sum(F.col(c).cast("long") * F.col("n")), n)).cast("int")

    cells = (
        without_gaps(daily, coverage)
        .groupBy(*CELL_DIMS)
        .agg(
            *stats.bucket_sums(),
            F.min("min_delay").alias("min_delay"),
            F.max("max_delay").alias("max_delay"),
            weighted("p50_delay").alias("p50_delay_approx"),
            weighted("p90_delay").alias("p90_delay_approx"),
            F.min("service_date").alias("first_service_date"),
            F.max("service_date").alias("last_service_date"),
            # The daily grain holds one row per date and cell, so rows are days.
            F.count(F.lit(1)).cast("int").alias("service_days"),
        )
    )
    return cells.withColumns(
        {
            "mean_delay": stats.mean_delay(F.col("n"), F.col("sum_delay")),
            "stddev_delay": stats.population_sd(F.col("n"), F.col("sum_delay"), F.col("sum_delay_sq")),
            "pct_late_240": stats.percent(F.col("n_late_240"), F.col("n")),
        }
    )


def dataset_summary(daily: DataFrame, cells: DataFrame) -> DataFrame:
    """One row of ten facts about the dataset."""
    # Distinct days, stops and routes come from a reduced set of their combinations.
    combos = daily.groupBy("service_date", "stop_id", "route_id").agg(F.sum(F.col("n").cast("long")).alias("n"))
    facts = combos.agg(
        F.min("service_date").alias("first_service_date"),
        F.max("service_date").alias("last_service_date"),
        F.countDistinct("service_date").alias("service_days"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_observations"),
        F.countDistinct("stop_id").alias("stops_with_data"),
        F.countDistinct("route_id").alias("routes_with_data"),
    )
    n = F.col("n")
    tiers = cells.agg(
        F.count_if(n >= k.N_CONFIDENT).alias("cells_confident"),
        F.count_if((n >= k.N_PROVISIONAL) & (n < k.N_CONFIDENT)).alias("cells_provisional"),
        F.count_if(n < k.N_PROVISIONAL).alias("cells_sparse"),
        F.count(F.lit(1)).alias("cells_total"),
    )
    # Two one-row tables side by side.
    both = facts.unionByName(tiers, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def growth(daily: DataFrame) -> DataFrame:
    return daily.groupBy("service_date").agg(F.sum(F.col("n").cast("long")).alias("n"))


def history(daily: DataFrame, monthly: DataFrame, cutover: Column) -> DataFrame:
    """Months before ``cutover`` and days from it on, in one column list."""
    columns = ["period", *ROLLUP_DIMS, "n", "sum_delay", "sum_delay_sq", "min_delay", "max_delay",
               "p50_delay", "p90_delay", "n_late_240", "n_late_300", "n_early_60"]
    old = monthly.filter(F.col("month") < cutover).withColumnRenamed("month", "period").select(*columns)
    new = daily.filter(F.col("service_date") >= cutover).withColumnRenamed("service_date", "period").select(*columns)
    return old.withColumn("grain", F.lit("month")).unionByName(new.withColumn("grain", F.lit("day")))
