"""Figures served to riders: totals, widening, day windows, rankings, snapshot."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import stats
from .rollup import combine


def with_interval(df: DataFrame, late: str = "n_late_240", n: str = "n") -> DataFrame:
    """Add the Wilson interval of the late share as pct_late_lo and pct_late_hi."""
    interval = stats.wilson(F.col(late), F.col(n))
    return df.withColumn("pct_late_lo", interval["lo"]).withColumn("pct_late_hi", interval["hi"])


def labelled_cells(cells: DataFrame, confident: int = k.N_CONFIDENT, provisional: int = k.N_PROVISIONAL) -> DataFrame:
    return with_interval(cells).withColumn("confidence", stats.confidence(F.col("n"), confident, provisional))


# -- totals -------------------------------------------------------------------


def route_stop_totals(cells: DataFrame) -> DataFrame:
    return combine(cells, ["route_id", "stop_id"])


def route_hour_totals(cells: DataFrame) -> DataFrame:
    return with_interval(combine(cells, ["route_id", "hour_of_day", "day_type"]))


def route_totals(cells: DataFrame) -> DataFrame:
    overall = with_interval(combine(cells, ["route_id"]))
    return overall.withColumn("usable", F.col("n") >= k.N_PROVISIONAL)


def stop_totals(cells: DataFrame) -> DataFrame:
    """Per stop: n, its routes, and whether any cell can show a figure."""
    return cells.groupBy("stop_id").agg(
        F.sum(F.col("n").cast("long")).alias("n"),
        F.array_sort(F.collect_set("route_id")).alias("routes"),
        F.max(F.col("n") >= k.N_PROVISIONAL).alias("usable"),
    )


def stop_labels(stop_ids: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Distinct headsigns and directions of the given stops, in one grouped pass.

    Stop times are first reduced to distinct (stop, trip label) pairs.
    """
    version = "feed_version_id"
    labelled = (
        stop_times.select(version, "trip_id", "stop_id")
        .join(stop_ids.select("stop_id").distinct(), "stop_id", "left_semi")
        .join(trips.select(version, "trip_id", "trip_headsign", "direction_id"), [version, "trip_id"])
        .select("stop_id", "trip_headsign", "direction_id")
        .distinct()
    )
    return labelled.groupBy("stop_id").agg(
        F.array_sort(F.collect_set("trip_headsign")).alias("headsigns"),
        F.array_sort(F.collect_set("direction_id")).alias("directions"),
    )


def stop_metadata(cells: DataFrame, stops: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Observed stops with name, place, headsigns, directions and routes."""
    observed = stop_totals(cells)
    labels = stop_labels(observed, trips, stop_times)
    return (
        observed.join(stops.select("stop_id", "stop_name", "stop_lat", "stop_lon"), "stop_id", "left")
        .join(labels, "stop_id", "left")
        .select(
            "stop_id",
            F.coalesce("stop_name", "stop_id").alias("stop_name"),
            "stop_lat",
            "stop_lon",
            F.coalesce("headsigns", F.array().cast("array<string>")).alias("headsigns"),
            F.coalesce("directions", F.array().cast("array<int>")).alias("directions"),
            "routes",
            "n",
            "usable",
        )
    )


def route_metadata(cells: DataFrame, routes: DataFrame) -> DataFrame:
    return route_totals(cells).select("route_id", "n", "usable").join(
        routes.select("route_id", F.col("route_long_name").alias("route_name")), "route_id", "left"
    )


def day_types_present(cells: DataFrame) -> DataFrame:
    return cells.agg(F.array_sort(F.collect_set("day_type")).alias("day_types"))


# -- widening -----------------------------------------------------------------


def widened(cells: DataFrame, min_n: int = k.N_PROVISIONAL) -> DataFrame:
    """For each cell, the narrowest scope with enough data as ``fallback``.

    This hour, else one hour either side (never across midnight), else the whole
    day; null if none suffices. A window group has 24 rows at most.
    """
    group = Window.partitionBy("stop_id", "route_id", "day_type")
    scopes = {
        "exact": group.orderBy("hour_of_day").rangeBetween(0, 0),
        "band": group.orderBy("hour_of_day").rangeBetween(-1, 1),
        "allday": group.orderBy("hour_of_day").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    }
    found = None
    for scope, frame in scopes.items():
        n = F.sum(F.col("n").cast("long")).over(frame)
        pooled = F.struct(
            F.lit(scope).alias("scope"),
            n.alias("n"),
            F.sum(F.col("n_late_240").cast("long")).over(frame).alias("n_late"),
            (F.sum(F.col("sum_delay").cast("long")).over(frame) / n).alias("mean"),
            F.array_sort(F.collect_list("hour_of_day").over(frame)).alias("hours"),
        )
        enough = n >= min_n
        found = F.when(enough, pooled) if found is None else found.when(enough, pooled)
    return cells.withColumn("fallback", found)


def pooled_windows(cells: DataFrame, windows: dict[str, Iterable[int]] | None = None) -> DataFrame:
    """One figure per (stop, route, day type) and named window of hours.

    Counts and sums add up; the sd is pooled over the hours' own sds. A single
    hour passes through unchanged.
    """
    windows = windows or k.DAY_WINDOWS
    names = F.create_map(*[x for name, hours in windows.items() for x in (F.lit(name), F.array(*map(F.lit, hours)))])
    hits = F.filter(F.map_keys(names), lambda name: F.array_contains(names[name], F.col("hour_of_day")))
    n, sd = F.col("n"), F.coalesce("stddev_delay", F.lit(0.0))
    pooled = (
        cells.withColumn("window", F.explode(hits))
        .groupBy("stop_id", "route_id", "day_type", "window")
        .agg(
            F.count(F.lit(1)).alias("hours"),
            F.sum(n.cast("long")).alias("n"),
            F.sum(F.col("n_late_240").cast("long")).alias("n_late_240"),
            F.sum(F.col("sum_delay").cast("long")).alias("sum_delay"),
            F.sum(sd * sd * F.greatest(n - 1, F.lit(0))).alias("_ss"),
            F.min_by(sd, "hour_of_day").alias("_first_sd"),
            F.max("service_days").alias("service_days"),
        )
    )
    spread = F.when(
        (F.col("hours") > 1) & (F.col("n") > F.col("hours")), F.sqrt(F.col("_ss") / (F.col("n") - F.col("hours")))
    ).otherwise(F.col("_first_sd"))
    return with_interval(
        pooled.withColumns(
            {
                "mean_delay": stats.mean_delay(F.col("n"), F.col("sum_delay")),
                "stddev_delay": spread,
                "pct_late_240": stats.percent(F.col("n_late_240"), F.col("n")),
                "confidence": stats.confidence(F.col("n")),
            }
        ).drop("_ss", "_first_sd")
    )


# -- routes -------------------------------------------------------------------


def delay_profile(totals: DataFrame, order: DataFrame) -> DataFrame:
    """Mean delay with its error band at each stop of the representative order.

    Stops without data stay in, with n = 0 and null means.
    """
    figures = totals.select("route_id", "stop_id", "n", "mean_delay", "stddev_delay")
    joined = order.join(figures, ["route_id", "stop_id"], "left").fillna(0, ["n"])
    band = stats.mean_band(F.col("n"), F.col("mean_delay"), F.col("stddev_delay"))
    return joined.withColumn("mean_lo", band["lo"]).withColumn("mean_hi", band["hi"])


def ranked_candidates(totals: DataFrame, positions: DataFrame, min_n: int = k.N_CONFIDENT) -> DataFrame:
    """Stops of a route with enough data, and where they lie along it."""
    return (
        totals.filter(F.col("n") >= min_n)
        .select("route_id", "stop_id", "n", "mean_delay", "n_late_240", "pct_late_240")
        .join(positions, ["route_id", "stop_id"], "left")
        .withColumn("x", F.col("seq") / F.col("max_seq"))
    )


def _fit(over, min_points: int) -> dict[str, Column]:
    """points, slope, intercept and residual_sd of the stops with a position; ``over`` closes each sum, by group or window.

    From six sums alone: the variance of what the line leaves is Syy - 2 b Sxy + b b Sxx, whatever its
    height, so no second pass over the residuals is needed. What rounding leaves of a perfect fit counts as none.
    """
    placed = F.col("seq").isNotNull()
    x, y = F.when(placed, F.col("x")), F.when(placed, F.col("mean_delay"))
    n, sxx, syy, sxy = over(F.count(x)), over(F.var_pop(x)), over(F.var_pop(y)), over(F.covar_pop(x, y))
    enough = n >= min_points
    slope = F.when(enough & (sxx > 0), sxy / sxx).otherwise(F.lit(0.0))
    intercept = F.when(enough, over(F.avg(y)) - slope * over(F.avg(x))).otherwise(F.lit(0.0))
    left = syy - 2 * slope * sxy + slope * slope * sxx
    sd = F.when((n > 1) & (left > 1e-12 * syy), F.sqrt(left * n / (n - 1))).otherwise(F.lit(0.0))
    return {"points": n, "slope": slope, "intercept": intercept, "residual_sd": sd}


def position_trend(candidates: DataFrame, min_points: int = k.MIN_FIT_POINTS) -> DataFrame:
    """Least-squares line of mean delay on position, per route, and the sample sd of what it leaves.

    Too few points give the zero line; no spread in position gives a flat one. The sd is 0 for fewer than two
    points. Routes without a placed stop are left out.
    """
    fit = candidates.groupBy("route_id").agg(*[c.alias(name) for name, c in _fit(lambda c: c, min_points).items()])
    return fit.filter("points > 0")


def residual_spread(candidates: DataFrame, min_points: int = k.MIN_FIT_POINTS) -> DataFrame:
    """Sample sd of the residuals per route, 0 for fewer than two."""
    return candidates.groupBy("route_id").agg(_fit(lambda c: c, min_points)["residual_sd"].alias("residual_sd"))


def flagged_stops(
    totals: DataFrame, positions: DataFrame, min_n: int = k.N_CONFIDENT, sds: float = k.OUTLIER_SDS, min_points: int = k.MIN_FIT_POINTS
) -> DataFrame:
    """Candidates with ``flagged``: worse by ``sds`` than their position on the route explains.

    One window over each route's stops, of which each is read once.
    """
    route = Window.partitionBy("route_id")
    fitted = ranked_candidates(totals, positions, min_n).withColumns(_fit(lambda c: c.over(route), min_points))
    fitted = fitted.withColumns({c: F.when(F.col("points") > 0, F.col(c)) for c in ("slope", "intercept")})
    predicted = F.col("intercept") + F.col("slope") * F.col("x")
    residual = F.when(F.col("seq").isNotNull(), F.col("mean_delay") - predicted)
    sd = F.col("residual_sd")
    flag = (sd > 0) & (F.col("residual") > sds * sd)
    return fitted.withColumn("residual", residual).withColumn("flagged", F.coalesce(flag, F.lit(False)))


def best_and_worst(ranked: DataFrame, each: int = k.RANKED_STOPS) -> DataFrame:
    """The ``each`` best and worst stops per route by rounded late share, in one pass over each route.

    Ties are broken by stop id, so that both lists are the two ends of one order.
    """
    share = F.round("pct_late_240", 1)
    up = Window.partitionBy("route_id").orderBy(share, "stop_id")
    down = Window.partitionBy("route_id").orderBy(F.desc(share), F.desc("stop_id"))
    placed = ranked.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    ends = F.array(*[F.struct(F.lit(name).alias("list"), F.col(c).alias("rank")) for name, c in (("best", "_up"), ("worst", "_down"))])
    lists = placed.filter((F.col("_up") <= each) | (F.col("_down") <= each)).select("*", F.inline(F.filter(ends, lambda e: e["rank"] <= each)))
    return lists.drop("_up", "_down")


# -- rankings over everything ---------------------------------------------------


def snapshot_day(daily: DataFrame, coverage: DataFrame, as_of: Column, ok_pct: float = k.COVERAGE_OK_PCT) -> DataFrame:
    """The latest finished day with data and good coverage (no row if none)."""
    good = coverage.filter((F.col("coverage_pct") >= ok_pct) & (F.col("service_date") < as_of))
    return (
        daily.join(good.select("service_date"), "service_date", "left_semi")
        .agg(F.max("service_date").alias("service_date"))
        .filter("service_date is not null")
    )


def snapshot(daily: DataFrame, day: DataFrame) -> DataFrame:
    """System-wide figures of the snapshot day."""
    total = (
        daily.join(day, "service_date", "left_semi")
        .groupBy("service_date")
        .agg(F.sum(F.col("n").cast("long")).alias("n"), F.sum(F.col("n_late_240").cast("long")).alias("n_late"))
    )
    late = F.coalesce(stats.percent(F.col("n_late"), F.col("n")), F.lit(0.0))
    return total.withColumn("pct_late", late).withColumn("on_time_pct", stats.on_time_pct(F.col("pct_late")))


def worst_routes(
    daily: DataFrame, day: DataFrame, routes: DataFrame, limit: int = 5, min_n: int = k.N_CONFIDENT
) -> DataFrame:
    """The latest-running routes of the snapshot day, by late share."""
    shares = (
        daily.join(day, "service_date", "left_semi")
        .groupBy("route_id")
        .agg(F.sum(F.col("n").cast("long")).alias("n"), F.sum(F.col("n_late_240").cast("long")).alias("n_late"))
        .filter(F.col("n") >= min_n)
        .withColumn("pct_late", stats.percent(F.col("n_late"), F.col("n")))
        .orderBy(F.desc("pct_late"), "route_id")
        .limit(limit)
    )
    names = routes.select("route_id", F.col("route_long_name").alias("route_name"))
    return shares.join(names, "route_id", "left")


def busiest(totals: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` usable routes or stops with most arrivals."""
    return totals.filter("usable").orderBy(F.desc("n"), key).limit(limit)
