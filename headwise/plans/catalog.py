"""Registry of runnable queries, one or more per operator, with SQL twins.

Results are flattened so that engines agree on them byte for byte: dates and
arrays become text, instants epoch microseconds, doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def flat(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(kind, T.DoubleType):
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, lambda spark, sf_dir: flat(run(spark, sf_dir)), sql)
        return run

    return register


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from . import queries_feed, queries_ops, queries_serving, queries_sources, queries_stats, queries_stream  # noqa: F401

    return CATALOG
