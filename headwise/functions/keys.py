"""Archive keys, digests and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as k


def shard_key(path: Column) -> Column:
    """``feed/2026-09-16/2026-09-16T17.ndjson.gz`` -> ``feed/2026/09/16/17.ndjson.gz``.

    Null for anything else.
    """
    return F.when(path.rlike(k.SHARD_PATH), F.regexp_replace(path, k.SHARD_PATH, "$1/$2/$3/$4/$5.ndjson.$6"))


def is_shard(name: Column) -> Column:
    return name.rlike(k.SHARD_NAME)


def is_partial(name: Column) -> Column:
    return name.contains(".partial")


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance; accurate to metres at city scale."""
    return distance_deg(lat1, lon1, lat2, lon2) * k.KM_PER_DEGREE


def distance_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = lat2 - lat1
    return F.sqrt(dx * dx + dy * dy)

