"""Statistics over algebraic buckets (n, sum, sum of squares, counts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as k

#: Measures that add up across buckets, and those that take a minimum or maximum.
SUMS = ("n", "sum_delay", "sum_delay_sq", "n_late_240", "n_late_300", "n_early_60")


def bucket_sums(*names: str) -> list[Column]:
    """Exact re-aggregation of bucket measures, as long sums."""
    return [F.sum(F.col(c).cast("long")).alias(c) for c in (names or SUMS)]


def ratio(num: Column, den: Column) -> Column:
    """Null where the denominator is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def mean_delay(n: Column, total: Column) -> Column:
    return ratio(total, n)


def population_sd(n: Column, total: Column, total_sq: Column) -> Column:
    """sqrt(E[x^2] - E[x]^2) with the variance clamped at 0.

    The difference is taken as n*sum(x^2) - sum(x)^2 over exact decimals, so that
    no digits cancel.
    """
    exact = total.cast("decimal(18,0)")
    spread = n.cast("decimal(18,0)") * total_sq.cast("decimal(19,0)") - exact * exact
    return F.when(
        n > 0, F.sqrt(F.greatest(F.lit(0.0), spread.cast("double"))) / n.cast("double")
    )


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * F.lit(100), whole)


def wilson(successes: Column, total: Column, z: float = k.Z95) -> Column:
    """Wilson score interval in percent as struct(lo, hi); [0, 100] without data."""
    s, n, zz = successes.cast("double"), total.cast("double"), z * z
    centre = s + zz / 2
    half = z * F.sqrt(s * (n - s) / n + zz / 4)
    return F.when(
        total > 0,
        F.struct(
            F.greatest(F.lit(0.0), (centre - half) / (n + zz) * 100).alias("lo"),
            F.least(F.lit(100.0), (centre + half) / (n + zz) * 100).alias("hi"),
        ),
    ).otherwise(F.struct(F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi")))


def mean_band(n: Column, mean: Column, sd: Column, z: float = k.Z95) -> Column:
    """mean +/- z standard errors as struct(lo, hi); no width for one value."""
    se = F.when(n > 1, F.coalesce(sd, F.lit(0.0)) / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))
    return F.struct((mean - z * se).alias("lo"), (mean + z * se).alias("hi"))


def rounded(value: Column, dp: int = 1) -> Column:
    return F.round(value, dp)


def confidence(n: Column, confident: int = k.N_CONFIDENT, provisional: int = k.N_PROVISIONAL) -> Column:
    return (
        F.when(n >= confident, F.lit("confident"))
        .when(n >= provisional, F.lit("provisional"))
        .otherwise(F.lit("sparse"))
    )


def delay_phrase(seconds: Column) -> Column:
    minutes = seconds / F.lit(60.0)
    size = F.format_string("%.1f min ", F.abs(minutes))
    return (
        F.when(F.abs(minutes) < 0.75, F.lit("about on time"))
        .when(minutes > 0, F.concat(size, F.lit("late")))
        .when(minutes < 0, F.concat(size, F.lit("early")))
    )


def coverage_class(pct: Column, reason: Column, ok_pct: float = k.COVERAGE_OK_PCT) -> Column:
    return (
        F.when(reason.isNotNull(), F.lit("known_gap"))
        .when(pct < ok_pct, F.lit("unexplained"))
        .otherwise(F.lit("none"))
    )


def on_time_pct(pct_late: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - pct_late)
