"""Table sinks: period replacement, swaps, document files, pruning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _hadoop_path(spark, path)
    return fs.exists(jpath)


def delete(spark: SparkSession, path: str) -> bool:
    fs, jpath = _hadoop_path(spark, path)
    return fs.delete(jpath, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right below a folder; none if it is absent."""
    fs, jpath = _hadoop_path(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(jpath)] if fs.exists(jpath) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, the folders above its new name being made; never over another."""
    fs, old = _hadoop_path(spark, source)
    _, new = _hadoop_path(spark, target)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise FileExistsError(target)


def _partition_dir(path: str, values: Mapping[str, object]) -> str:
    return "/".join([path.rstrip("/"), *(f"{name}={value}" for name, value in values.items())])


def replace_partitions(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    *,
    emptied: Iterable[Mapping[str, object]] = (),
    sort: Sequence[str] = (),
) -> None:
    """Overwrite only the partitions present in ``df``.

    A period that has become empty leaves no rows to overwrite it with: name the
    periods being rebuilt in ``emptied`` and those without rows are removed. The
    rebalance hint gives few files per partition and still splits a large one.
    Which partitions were written is observed during the write itself.
    """
    spark = df.sparkSession
    periods = list(emptied)
    rows = df.hint("rebalance", *by)
    if sort:
        rows = rows.sortWithinPartitions(*by, *sort)
    if periods:
        seen = Observation()
        values = F.struct(*[F.col(c).cast("string") for c in by])
        rows = rows.observe(seen, F.collect_set(values).alias("present"))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )
    if periods:
        present = {tuple(row) for row in seen.get.get("present", [])}
        for period in periods:
            if tuple(str(period[c]) for c in by) not in present:
                delete(spark, _partition_dir(path, period))


def replace_partition(df: DataFrame, path: str, values: Mapping[str, object]) -> None:
    """Overwrite the one partition of these ``values``, which are no columns of ``df``; without rows it is removed.

    The values are put in as constants after the rebalancing, so Spark has no partitions to sort by: a task
    holds no more than the row it writes, however many rows a version has.
    """
    seen = Observation()
    rows = df.hint("rebalance").observe(seen, F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({c: F.lit(v) for c, v in values.items()})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*values).parquet(path)
    if not seen.get.get("n"):
        delete(df.sparkSession, _partition_dir(path, values))


def write_observations(df: DataFrame, path: str) -> None:
    """Observation table, one partition per service date touched."""
    replace_partitions(df, path, ["service_date"], sort=["route_id", "stop_id"])


def write_period(df: DataFrame, path: str, period: str, periods: Iterable[object] = ()) -> None:
    """Replace whole days or months of a rollup, including those now empty."""
    replace_partitions(df, path, [period], emptied=[{period: p} for p in periods], sort=["stop_id", "route_id"])


def _swaps(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(sequence, folder) of the complete versions of a swapped table, oldest first."""
    found = [n for n in names(spark, root) if n[:8].isdigit() and exists(spark, f"{root}/{n}/_SUCCESS")]
    return sorted((int(n[:8]), n) for n in found)


def swap(df: DataFrame, path: str, name: str, *, sort: Sequence[str] = ("stop_id",), keep: int = 2) -> str:
    """Write ``df`` as the next version of a table, which makes it the current one.

    Versions are numbered; the one with the highest number that Spark has marked complete is current,
    so readers see the old table until the new one is whole, and the clock decides nothing. All but the
    last ``keep`` versions are removed, so a reader of the version before may go on reading. One
    writer at a time.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    taken = [int(n[:8]) for n in names(spark, root) if n[:8].isdigit()]
    target = f"{root}/{max(taken, default=0) + 1:08d}-{name}"
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("error").parquet(target)
    done = _swaps(spark, root)
    for number, folder in done[: -max(1, keep)]:
        delete(spark, f"{root}/{folder}")
    # What a writer that died has left behind, too.
    for folder in names(spark, root):
        if folder[:8].isdigit() and int(folder[:8]) < done[-1][0] and int(folder[:8]) not in dict(done):
            delete(spark, f"{root}/{folder}")
    return target


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table last made current by :func:`swap`."""
    root = path.rstrip("/")
    return spark.read.parquet(f"{root}/{_swaps(spark, root)[-1][1]}")


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """One text partition per document; ``df`` has the key and ``json``."""
    df.select(key, "json").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(key).text(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Append poll telemetry, partitioned by the day the poll started."""
    df.withColumn("run_date", F.to_date("started_at")).write.mode("append").partitionBy("run_date").parquet(path)


def runs_to_keep(runs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Telemetry no older than ``days``."""
    return runs.filter(F.unix_micros("started_at") >= F.unix_micros(as_of) - days * 86_400_000_000)


def prune_runs(spark: SparkSession, path: str, as_of: Column, days: int) -> None:
    """Drop run days wholly past the limit and trim the one it falls in."""
    runs = spark.read.parquet(path)
    edge = F.to_date(F.timestamp_seconds(F.unix_seconds(as_of) - days * 86_400))
    old = runs.filter(F.col("run_date") <= edge).select(F.col("run_date").cast("string").alias("d"), edge.cast("string").alias("e"))
    for day, boundary in old.distinct().collect():  # one row per expired day
        where = f"{path.rstrip('/')}/run_date={day}"
        if day == boundary:
            kept = runs_to_keep(runs.filter(F.col("run_date") == F.lit(day).cast("date")), as_of, days)
            # The kept rows are put aside, then overwrite their partitions in one commit. A run that
            # ends in between leaves the day whole or trimmed, and the next one begins anew.
            spare = f"{path.rstrip('/')}/_trim"
            kept.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(spare)
            layout = [c for c in ("run_date", "batch") if c in runs.columns]
            aside = spark.read.schema(kept.schema).parquet(spare)
            gone = runs.filter(F.col("run_date") == F.lit(day).cast("date")).select(*layout).distinct()
            replace_partitions(aside, path, layout, emptied=[r.asDict() for r in gone.collect()])  # one for each batch of a day
            delete(spark, spare)
        else:
            delete(spark, where)
