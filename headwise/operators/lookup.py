"""Batch lookups: nearest stops and text search, without cross joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import constants as k
from ..functions import keys
from ..session import scratch_path

#: Sides of the grid cells in degrees, from about 150 m up to an eighth of the globe; a cell holds 64 of the next finer.
FINEST_DEG = 360.0 / 8**6
LEVELS = 6


def nearest_stops(points: DataFrame, stops: DataFrame, limit: int = k.NEAREST_STOPS) -> DataFrame:
    """The ``limit`` stops nearest each point (point_id, lat, lon), exactly; of equally near ones the smaller ids.

    Points with one id are one point. Stops without a place are left out, as are points without one.
    Points at the very same place share one search, so its windows hold places, not points.
    """
    one = points.filter("lat is not null and lon is not null").groupBy("point_id").agg(F.min(F.struct("lat", "lon")).alias("at"))
    one = one.select("point_id", "at.lat", "at.lon")
    places = one.groupBy("lat", "lon").agg(F.min("point_id").alias("point_id"))
    pairs = candidate_stops(places, stops, limit)
    km = keys.distance_km(F.col("lat"), F.col("lon"), F.col("stop_lat"), F.col("stop_lon"))
    nearest = Window.partitionBy("point_id").orderBy("km", "stop_id")
    found = (
        pairs.select("point_id", "lat", "lon", "stop_id", km.alias("km"))
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= limit)
    )
    return one.join(found.drop("point_id"), ["lat", "lon"]).select("point_id", "stop_id", "km", "rank")


def candidate_stops(points: DataFrame, stops: DataFrame, limit: int) -> DataFrame:
    """Pairs of a point and the stops that may be among its ``limit`` nearest.

    Descends a pyramid of grid cells, all points at once. Each cell knows its number of stops and the
    box they lie in. At each level a point looks into the cells it has kept: the greatest distances to
    their boxes say within which distance ``limit`` stops lie for certain, and only cells with a smaller
    least distance are kept. A point in empty country keeps the few cells that face it.
    """
    placed = stops.filter("stop_lat is not null and stop_lon is not null").select("stop_id", "stop_lat", "stop_lon")
    # Of stops at the very same place only the first ``limit`` ids can be answers.
    same = Window.partitionBy("stop_lat", "stop_lon").orderBy("stop_id")
    placed = placed.withColumn("_rn", F.row_number().over(same)).filter(F.col("_rn") <= limit).drop("_rn")
    # Places beyond the globe stand in its outermost cells, so the topmost level has at most 64.
    number = lambda degrees: F.floor(F.least(F.greatest(degrees / FINEST_DEG, F.lit(0.0)), F.lit(8.0**6 - 1)))
    placed = placed.withColumns({"y": number(F.col("stop_lat") + 90), "x": number(F.col("stop_lon") + 180)})
    one = points.filter("lat is not null and lon is not null").groupBy("point_id").agg(F.min(F.struct("lat", "lon")).alias("at"))
    # The topmost cells, 64 at most, hang on one root, the cell that holds the globe; every point begins with it.
    root = [F.shiftright(number(F.col(c) + half), 3 * LEVELS).alias(p) for c, half, p in (("lat", 90, "py"), ("lon", 180, "px"))]
    kept = one.select("point_id", "at.lat", "at.lon").select("*", *root)
    for level in range(LEVELS - 1, -1, -1):
        cells = _cells(placed, level).withColumns({"py": F.shiftright("y", 3), "px": F.shiftright("x", 3)})
        found = kept.join(F.broadcast(cells) if level == LEVELS - 1 else cells, ["py", "px"])
        kept = _within_reach(found, limit).select("point_id", "lat", "lon", F.col("y").alias("py"), F.col("x").alias("px"))
    return kept.join(placed.withColumnsRenamed({"y": "py", "x": "px"}), ["py", "px"]).drop("py", "px")


def _cells(placed: DataFrame, level: int) -> DataFrame:
    """Cells of a level, 0 the finest: how many stops each has, and the box around them."""
    at = [F.shiftright(c, 3 * level).alias(c) for c in ("y", "x")]
    box = [f(c).alias(f"{name}_{c[5:]}") for name, f in (("low", F.min), ("high", F.max)) for c in ("stop_lat", "stop_lon")]
    return placed.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), *box)


def _within_reach(found: DataFrame, limit: int) -> DataFrame:
    """The cells of each point whose least distance is no more than that within which ``limit`` stops lie."""
    low, high, lat, lon = F.col("low_lat"), F.col("high_lat"), F.col("lat"), F.col("lon")
    # A degree of longitude counts by the cosine of the latitude between the two, which lies between these.
    ends = [F.cos(F.radians((lat + side) / 2)) for side in (low, high)]
    across = F.when((lat + low) * (lat + high) <= 0, F.lit(1.0)).otherwise(F.greatest(*ends))
    apart = lambda v, a, b: F.greatest(a - v, v - b, F.lit(0.0))
    reach = lambda v, a, b: F.greatest(F.abs(a - v), F.abs(b - v))
    size = lambda x, y: F.sqrt(x * x + y * y)
    least = size(apart(lon, F.col("low_lon"), F.col("high_lon")) * F.least(*ends), apart(lat, low, high))
    most = size(reach(lon, F.col("low_lon"), F.col("high_lon")) * across, reach(lat, low, high))
    measured = found.withColumns({"_least": least, "_most": most})
    nearer = Window.partitionBy("point_id").orderBy("_most").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.when(F.sum("n").over(nearer) >= limit, F.col("_most"))
    bound = F.min("_enough").over(Window.partitionBy("point_id"))
    # A hair's breadth for the rounding of square roots.
    return measured.withColumn("_enough", enough).withColumn("_bound", bound).filter(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound") * (1 + 1e-9) + 1e-12))


# -- text ---------------------------------------------------------------------

#: Letters of a gram, entries of a posting block, rare grams that a query probes with.
GRAM, BLOCK, PROBES = 3, 1 << 12, 3
#: Queries of short words that one scan answers.
SCANNED = 10_000


@dataclass(frozen=True)
class TextIndex:
    """Entries by number, and for each gram the numbers of those that hold it, cut into blocks.

    texts: number, id, text (lower case). postings: gram, block, numbers (ascending, of one block of ``BLOCK``
    entries), so a gram that nearly every text has is as many rows as there are blocks. frequency: gram, df.
    """

    texts: DataFrame
    postings: DataFrame
    frequency: DataFrame


def _grams(text: Column) -> Column:
    last = F.length(text) - GRAM + 1
    return F.when(
        last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(GRAM))))
    ).otherwise(F.array().cast("array<string>"))


def write_index(entries: DataFrame, path: str) -> TextIndex:
    """Build the index of entries (id, text) below ``path``, once for all batches of queries."""
    root = path.rstrip("/")
    numbered = entries.select(F.monotonically_increasing_id().alias("number"), "id", F.lower("text").alias("text"))
    numbered.write.mode("overwrite").parquet(f"{root}/texts")
    texts = entries.sparkSession.read.schema(numbered.schema).parquet(f"{root}/texts")
    held = texts.select("number", F.explode(_grams(F.col("text"))).alias("gram"))
    blocks = held.groupBy("gram", F.floor(F.col("number") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    blocks.write.mode("overwrite").parquet(f"{root}/postings")
    postings = entries.sparkSession.read.schema(blocks.schema).parquet(f"{root}/postings")
    df = postings.groupBy("gram").agg(F.sum(F.size("numbers")).alias("df"))
    df.write.mode("overwrite").parquet(f"{root}/frequency")
    return read_index(entries.sparkSession, root)


def read_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("texts", "postings", "frequency")])


def contains_all(queries: DataFrame, index: TextIndex) -> DataFrame:
    """Pairs (query_id, id) where the entry's text contains every token of the query (query_id, tokens).

    A query with a word of three letters or more probes with its rarest grams: their posting blocks are
    intersected, block by block, and what is left is checked in full. Queries of shorter words
    alone read the texts, all of them in one pass.
    """
    grams = F.array_distinct(F.flatten(F.transform("tokens", _grams)))
    asked = queries.select("query_id", "tokens", grams.alias("grams"))
    return _probed(asked.filter(F.size("grams") > 0), index).union(_scanned(asked.filter(F.size("grams") == 0), index))


def _probed(asked: DataFrame, index: TextIndex) -> DataFrame:
    wanted = asked.select("query_id", F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    rare = Window.partitionBy("query_id").orderBy("df", "gram")
    # A gram that no text has rules the query out.
    known = wanted.join(index.frequency, "gram").withColumns({"_rn": F.row_number().over(rare), "_known": F.count(F.lit(1)).over(Window.partitionBy("query_id"))})
    probes = known.filter((F.col("_known") == F.col("all")) & (F.col("_rn") <= PROBES)).select("query_id", "gram", F.least("all", F.lit(PROBES)).alias("probes"))
    # At most PROBES blocks of at most BLOCK numbers meet in a group.
    met = probes.join(index.postings, "gram").groupBy("query_id", "block").agg(F.max("probes").alias("probes"), F.collect_list("numbers").alias("lists"))
    met = met.filter(F.size("lists") == F.col("probes"))
    common = F.aggregate(F.slice("lists", 2, PROBES), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    found = met.select("query_id", F.explode(common).alias("number"))
    return _checked(found.join(asked.select("query_id", "tokens"), "query_id").join(index.texts, "number"))


def _checked(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.forall("tokens", lambda t: F.contains(F.col("text"), t))).select("query_id", "id")


def _scanned(asked: DataFrame, index: TextIndex) -> DataFrame:
    """Queries without a gram: each text is held against the distinct sets of short words, a batch at a time."""
    sets = asked.select("query_id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    distinct = sets.select("tokens").distinct()
    n = distinct.count()
    out = asked.sparkSession.createDataFrame([], StructType([asked.schema["query_id"], index.texts.schema["id"]]))
    parts = -(-n // SCANNED)
    for part in range(parts):
        some = distinct.filter(F.pmod(F.hash("tokens"), F.lit(parts)) == part)
        all_of = some.agg(F.collect_list("tokens").alias("sets")).scalar().alias("sets")
        hits = F.filter("sets", lambda ts: F.forall(ts, lambda t: F.contains(F.col("text"), t)))
        found = index.texts.select("id", "text", all_of).select("id", F.explode(hits).alias("tokens"))
        out = out.union(sets.join(found, "tokens").select("query_id", "id"))
    return out


def _ranked(hits: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("usable"), F.desc("n"), "id")
    return (
        hits.join(index.select("id", "usable", "n"), "id")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", "id", "usable", "n")
    )


def search_stops(
    queries: DataFrame, stops: DataFrame, limit: int = k.STOP_HITS, min_length: int = k.MIN_STOP_QUERY, index: TextIndex | None = None
) -> DataFrame:
    """Stops whose name, headsigns and routes contain every word of each query.

    Usable stops first, then those with most arrivals. ``index``: of :func:`stop_entries`, as written for an
    earlier batch; else one is written for this batch.
    """
    q = F.trim(F.lower("query"))
    asked = queries.select("query_id", F.split(q, r"\s+").alias("tokens"), F.length(q).alias("len"))
    index = index or write_index(stop_entries(stops), scratch_path(stops.sparkSession, "index"))
    return _ranked(contains_all(asked.filter(F.col("len") >= min_length), index), stops.withColumnRenamed("stop_id", "id"), limit)


def stop_entries(stops: DataFrame) -> DataFrame:
    """What a stop is found by: (id, text)."""
    text = F.concat_ws(" ", "stop_name", F.array_join("headsigns", " "), F.array_join("routes", " "))
    return stops.select(F.col("stop_id").alias("id"), text.alias("text"))


def route_entries(routes: DataFrame) -> DataFrame:
    """What a route is found by: (id, text)."""
    return routes.select(F.col("route_id").alias("id"), F.concat_ws(" ", "route_id", F.coalesce("route_name", F.lit(""))).alias("text"))


def search_routes(
    queries: DataFrame, routes: DataFrame, limit: int = k.ROUTE_HITS, min_length: int = k.MIN_ROUTE_QUERY, index: TextIndex | None = None
) -> DataFrame:
    """Routes whose id and name contain each whole query; ``index`` of :func:`route_entries`, as for stops."""
    q = F.trim(F.lower("query"))
    asked = queries.select("query_id", F.array(q).alias("tokens"), F.length(q).alias("len"))
    index = index or write_index(route_entries(routes), scratch_path(routes.sparkSession, "index"))
    return _ranked(contains_all(asked.filter(F.col("len") >= min_length), index), routes.withColumnRenamed("route_id", "id"), limit)
