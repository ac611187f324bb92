"""Helpers shared by the operators: tables, written steps, running offsets, size-checked filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.session import scratch_path
from headwise.sources.tables import delete

#: Rows of one long column that may be sent to every executor (8 MB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting by which the shuffle files of a query go as it ends, not when the driver next collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.

    What was shuffled for it leaves the disk as soon as it is written."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing reads any more, what came of them being written itself."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def only_keys(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the stored one-column ``keys``; with "left_anti" the others.

    The keys are counted first: up to ``limit`` they go to every executor, so that ``df`` is
    filtered where it is read; more are joined by shuffle. The rows are the same either way.
    """
    small = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys, key, how)


def with_offsets(counts: DataFrame, by: list[str], order: list[str], coarse: Column) -> DataFrame:
    """Add ``offset``: the sum of ``n`` over earlier rows of the same ``by``, in two levels.

    ``coarse`` numbers runs of neighbours in that order; no task sums more than one run, or one row
    for each run.
    """
    from pyspark.sql import Window as W

    rows = counts.withColumn("_coarse", coarse)
    before = lambda keys, o: W.partitionBy(*keys).orderBy(*o).rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy(*by, "_coarse").agg(F.sum("n").alias("_n"))
    tops = tops.withColumn("_base", F.coalesce(F.sum("_n").over(before(by, ["_coarse"])), F.lit(0))).drop("_n")
    rows = rows.withColumn("_rest", F.coalesce(F.sum("n").over(before([*by, "_coarse"], order)), F.lit(0)))
    return rows.join(tops, [*by, "_coarse"]).withColumn("offset", F.col("_base") + F.col("_rest")).drop("_coarse", "_base", "_rest")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(column)
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
