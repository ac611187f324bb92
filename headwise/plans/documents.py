"""Published JSON documents: one per stop, one per route, and the index.

A stop document holds at most routes x 24 hours x 3 day types, a route document at
most its stops: both are bounded by the timetable, not by the observations. The
index is kept as lines, one per entry, so no task has to hold all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import stats
from ..operators import serving
from ..sources import tables

KEEP_NULLS = {"ignoreNullFields": "false"}


def _json(value: Column) -> Column:
    return F.to_json(value, KEEP_NULLS)


def _r1(c: str) -> Column:
    return F.round(c, 1)


def cell_entries(cells: DataFrame, min_n: int = k.N_PROVISIONAL) -> DataFrame:
    """Cells in published form; thin ones carry the widened figure as ``fallback``."""
    wide = serving.with_interval(serving.widened(cells, min_n))
    fb = F.col("fallback")
    interval = stats.wilson(fb["n_late"], fb["n"])
    fallback = F.when(
        (F.col("n") < min_n) & fb.isNotNull(),
        F.struct(
            fb["scope"].alias("scope"),
            fb["n"].alias("n"),
            fb["n_late"].alias("nLate"),
            F.round(stats.percent(fb["n_late"], fb["n"]), 1).alias("pctLate"),
            F.round(interval["lo"], 1).alias("pctLateLo"),
            F.round(interval["hi"], 1).alias("pctLateHi"),
            F.round(fb["mean"], 1).alias("mean"),
            fb["hours"].alias("hours"),
        ),
    )
    entry = F.struct(
        fallback.alias("fallback"),
        F.col("route_id").alias("r"),
        F.col("hour_of_day").alias("h"),
        F.col("day_type").alias("d"),
        F.col("n").alias("n"),
        stats.confidence(F.col("n")).alias("confidence"),
        _r1("mean_delay").alias("mean"),
        _r1("stddev_delay").alias("sd"),
        _r1("pct_late_240").alias("pctLate"),
        _r1("pct_late_lo").alias("pctLateLo"),
        _r1("pct_late_hi").alias("pctLateHi"),
        F.col("n_late_240").alias("nLate"),
        F.col("n_early_60").alias("nEarly"),
        F.col("min_delay").alias("min"),
        F.col("max_delay").alias("max"),
        F.col("p50_delay_approx").alias("p50"),
        F.col("p90_delay_approx").alias("p90"),
        F.col("service_days").alias("days"),
    )
    return wide.select("stop_id", "route_id", "day_type", "hour_of_day", entry.alias("entry"))


def _ordered(*keys: str, value: str) -> Column:
    """Collect ``value`` in the order of ``keys``."""
    rows = F.array_sort(
        F.collect_list(F.struct(*keys, F.col(value).alias("_v"))),
        lambda a, b: F.coalesce(
            *[F.when(a[c] < b[c], F.lit(-1)).when(a[c] > b[c], F.lit(1)) for c in keys], F.lit(0)
        ),
    )
    return F.transform(rows, lambda r: r["_v"])


def stop_documents(cells: DataFrame, metadata: DataFrame, generated_at: Column) -> DataFrame:
    """(stop_id, json) for every observed stop."""
    entries = cell_entries(cells).groupBy("stop_id").agg(
        _ordered("route_id", "day_type", "hour_of_day", value="entry").alias("cells")
    )
    head = F.struct(
        F.col("stop_id").alias("id"),
        F.col("stop_name").alias("name"),
        F.col("stop_lat").alias("lat"),
        F.col("stop_lon").alias("lon"),
        "headsigns",
        "directions",
    )
    document = F.struct(
        head.alias("stop"),
        "routes",
        F.col("usable").alias("hasUsableData"),
        F.col("n").alias("observations"),
        "cells",
        generated_at.alias("generatedAt"),
    )
    return metadata.join(entries, "stop_id").select("stop_id", _json(document).alias("json"))


def profile_entries(totals: DataFrame, order: DataFrame) -> DataFrame:
    """Delay profile per route: directions in order, each with its stops in order."""
    profile = serving.delay_profile(totals, order)
    point = F.struct(
        F.col("stop_sequence").alias("seq"),
        F.col("stop_id").alias("id"),
        F.col("stop_name").alias("name"),
        F.col("n").alias("n"),
        _r1("mean_delay").alias("mean"),
        _r1("mean_lo").alias("meanLo"),
        _r1("mean_hi").alias("meanHi"),
    )
    per_direction = (
        profile.withColumn("point", point)
        .groupBy("route_id", "direction_id")
        .agg(F.first("trip_headsign").alias("headsign"), _ordered("stop_sequence", value="point").alias("stops"))
        .withColumn("dir", F.struct(F.col("direction_id").alias("direction"), "headsign", "stops"))
    )
    return per_direction.groupBy("route_id").agg(_ordered("direction_id", value="dir").alias("profile"))


def ranking_entries(totals: DataFrame, positions: DataFrame, names: DataFrame) -> DataFrame:
    """Best and worst stops of each route, as two ordered lists."""
    flagged = serving.flagged_stops(totals, positions)
    ranked = serving.best_and_worst(flagged).join(names.select("stop_id", "stop_name"), "stop_id", "left")
    item = F.struct(
        F.col("stop_id").alias("id"),
        F.coalesce("stop_name", "stop_id").alias("name"),
        F.col("n").alias("n"),
        _r1("mean_delay").alias("mean"),
        _r1("pct_late_240").alias("pctLate"),
        F.col("seq").alias("seq"),
        F.when(F.col("seq").isNotNull(), F.col("max_seq")).alias("seqOf"),
        F.col("flagged").alias("flagged"),
    )
    rows = ranked.withColumn("item", item).groupBy("route_id", "list").agg(_ordered("rank", value="item").alias("items"))
    return rows.groupBy("route_id").agg(
        F.max(F.when(F.col("list") == "best", F.col("items"))).alias("best"),
        F.max(F.when(F.col("list") == "worst", F.col("items"))).alias("worst"),
    )


def hour_entries(cells: DataFrame) -> DataFrame:
    hours = serving.route_hour_totals(cells)
    entry = F.struct(
        F.col("hour_of_day").alias("h"),
        F.col("day_type").alias("d"),
        F.col("n").alias("n"),
        _r1("mean_delay").alias("mean"),
        _r1("pct_late_240").alias("pctLate"),
        _r1("pct_late_lo").alias("pctLateLo"),
        _r1("pct_late_hi").alias("pctLateHi"),
    )
    return hours.withColumn("entry", entry).groupBy("route_id").agg(
        _ordered("hour_of_day", "day_type", value="entry").alias("hours")
    )


def route_documents(
    cells: DataFrame,
    routes: DataFrame,
    order: DataFrame,
    positions: DataFrame,
    stop_names: DataFrame,
    generated_at: Column,
) -> DataFrame:
    """(route_id, json) for every observed route."""
    totals = serving.route_stop_totals(cells)
    overall = serving.route_totals(cells).join(
        routes.select("route_id", F.col("route_long_name").alias("route_name")), "route_id", "left"
    )
    parts = (
        overall.join(profile_entries(totals, order), "route_id", "left")
        .join(ranking_entries(totals, positions, stop_names), "route_id", "left")
        .join(hour_entries(cells), "route_id", "left")
    )
    def listed(c: str) -> Column:
        return F.coalesce(F.col(c), F.array().cast(parts.schema[c].dataType)).alias(c)

    document = F.struct(
        F.struct(F.col("route_id").alias("id"), F.col("route_name").alias("name")).alias("route"),
        F.col("n").alias("n"),
        F.col("usable").alias("hasUsableData"),
        _r1("mean_delay").alias("mean"),
        _r1("pct_late_240").alias("pctLate"),
        _r1("pct_late_lo").alias("pctLateLo"),
        _r1("pct_late_hi").alias("pctLateHi"),
        F.col("n_late_240").alias("nLate"),
        F.col("n_early_60").alias("nEarly"),
        listed("profile"),
        listed("best"),
        listed("worst"),
        listed("hours"),
        generated_at.alias("generatedAt"),
    )
    return parts.select("route_id", _json(document).alias("json"))


def index_entries(
    summary: DataFrame,
    day_types: DataFrame,
    growth: DataFrame,
    coverage: DataFrame,
    snapshot: DataFrame,
    worst: DataFrame,
    stops: DataFrame,
    routes: DataFrame,
) -> DataFrame:
    """The index as lines (section, position, json), one per entry."""

    def lines(section: str, df: DataFrame, position: Column, entry: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), position.cast("string").alias("position"), _json(entry).alias("json"))

    camel = {
        "firstServiceDate": "first_service_date",
        "lastServiceDate": "last_service_date",
        "serviceDays": "service_days",
        "totalObservations": "total_observations",
        "stopsWithData": "stops_with_data",
        "routesWithData": "routes_with_data",
        "cellsConfident": "cells_confident",
        "cellsProvisional": "cells_provisional",
        "cellsSparse": "cells_sparse",
        "cellsTotal": "cells_total",
    }
    facts = summary.withColumn("dayTypesPresent", day_types.scalar())
    thresholds = F.struct(F.lit(k.N_CONFIDENT).alias("confident"), F.lit(k.N_PROVISIONAL).alias("provisional"))
    none = F.lit("")
    sections = [
        lines("dataset", facts, none, F.struct(*[F.col(c).alias(a) for a, c in camel.items()], "dayTypesPresent")),
        lines("thresholds", summary, none, thresholds),
        lines("growth", growth, F.col("service_date"), F.struct(F.col("service_date").alias("date"), "n")),
        lines(
            "dayCoverage",
            coverage,
            F.col("service_date"),
            F.struct(
                F.col("service_date").alias("date"),
                F.col("coverage_pct").alias("coveragePct"),
                F.col("known_gap_reason").alias("knownGapReason"),
            ),
        ),
        lines(
            "systemSnapshot",
            snapshot,
            none,
            F.struct(F.col("service_date").alias("date"), "n", _r1("pct_late").alias("pctLate")),
        ),
        lines(
            "worstRoutes",
            worst,
            F.col("route_id"),
            F.struct(
                F.col("route_id").alias("id"), F.col("route_name").alias("name"), "n", _r1("pct_late").alias("pctLate")
            ),
        ),
        lines(
            "stops",
            stops,
            F.col("stop_id"),
            F.struct(
                F.col("stop_id").alias("id"),
                F.col("stop_name").alias("name"),
                F.col("stop_lat").alias("lat"),
                F.col("stop_lon").alias("lon"),
                F.slice("headsigns", 1, k.HEADSIGNS_SHOWN).alias("headsigns"),
                "routes",
                "n",
                "usable",
            ),
        ),
        lines(
            "routes",
            routes,
            F.col("route_id"),
            F.struct(F.col("route_id").alias("id"), F.col("route_name").alias("name"), "n", "usable"),
        ),
    ]
    out = sections[0]
    for section in sections[1:]:
        out = out.unionAll(section)
    return out


def write_site(stops: DataFrame, routes: DataFrame, index: DataFrame, path: str) -> None:
    """Write all documents below ``path``; stops and routes no longer served vanish."""
    root = path.rstrip("/")
    tables.write_documents(stops, f"{root}/stops", "stop_id")
    tables.write_documents(routes, f"{root}/routes", "route_id")
    tables.write_documents(index.select("section", "json"), f"{root}/index", "section")
