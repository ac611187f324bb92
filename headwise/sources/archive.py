"""Raw poll archive: gzip or brotli NDJSON shards, one per feed and UTC hour."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import keys
from . import tables

SHARD_COLUMNS = ("shard_feed", "shard_date", "shard_hour")
#: What Spark gives of a file as a whole.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _records(raw: DataFrame) -> DataFrame:
    return raw.withColumn("payload", F.unbase64("payload_b64")).drop("payload_b64")


def _unpacked(files: DataFrame) -> DataFrame:
    """The records of brotli files, which Spark's readers have no codec for; files have a column content.

    Bytes that are no UTF-8 are replaced, as Spark's own reader does, so one bad line costs that line.
    """

    def lines(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                with pa.CompressedInputStream(pa.BufferReader(content.as_buffer()), "brotli") as stream:
                    rest = b""
                    # A part at a time: a shard is never held unpacked.
                    while part := stream.read(1 << 20):
                        *whole, rest = (rest + part).split(b"\n")
                        yield pa.RecordBatch.from_pydict({"line": pa.array([x.decode(errors="replace") for x in whole if x], pa.string())})
                    if rest:
                        yield pa.RecordBatch.from_pydict({"line": pa.array([rest.decode(errors="replace")], pa.string())})

    rows = files.select("content").mapInArrow(lines, "line string")
    return rows.select(F.from_json("line", schemas.ARCHIVE).alias("r")).select("r.*")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived polls with their payload bytes, whatever the folder layout and codec."""

    def found(glob: str):
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)

    packed = found("*.gz").schema(schemas.ARCHIVE).json(path)
    return _records(packed.unionByName(_unpacked(found("*.br").format("binaryFile").load(path))))


def stream_archive(spark: SparkSession, path: str, max_files: int = 200) -> DataFrame:
    """The same records as an unbounded stream of new shards."""

    def found(glob: str):
        return (
            spark.readStream.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files)
        )

    packed = found("*.gz").schema(schemas.ARCHIVE).json(path)
    files = found("*.br").format("binaryFile").schema(BINARY_FILE).load(path)
    return _records(packed.unionByName(_unpacked(files)))


def archive_lines(polls: DataFrame) -> DataFrame:
    """Archive records of polls (feed, fetched_at, ..., payload), with shard keys."""
    return polls.select(
        "feed",
        "fetched_at",
        "http_status",
        "feed_timestamp",
        "attempts",
        F.octet_length("payload").alias("payload_bytes"),
        F.base64("payload").alias("payload_b64"),
        F.col("feed").alias("shard_feed"),
        F.date_format("fetched_at", "yyyy-MM-dd").alias("shard_date"),
        F.date_format("fetched_at", "HH").alias("shard_hour"),
    )


def write_archive(polls: DataFrame, path: str, mode: str = "append") -> None:
    """Write polls as gzip shards.

    Rebalancing aims at one file per shard, and cuts a very large shard in several.
    """
    (
        archive_lines(polls)
        .hint("rebalance", *SHARD_COLUMNS)
        .write.mode(mode)
        .option("compression", "gzip")
        .option("ignoreNullFields", "false")
        .option("partitionOverwriteMode", "static")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .partitionBy(*SHARD_COLUMNS)
        .json(path)
    )


def write_shards(polls: DataFrame, root: str, ending: Callable[[str, str], str] = lambda feed, hour: ".ndjson.gz") -> None:
    """Write polls as one file for each shard, named as the archive names them: ``feed/day/dayThour`` and an ending.

    Spark chooses file names of its own, so shards are written aside and then renamed, one call for each.
    A shard's lines are in order, so equal polls make equal files. ``ending``: of (feed, dayThour).
    """
    spark, aside = polls.sparkSession, f"{root.rstrip('/')}/_aside"
    lines = archive_lines(polls).repartition(*SHARD_COLUMNS).sortWithinPartitions(*SHARD_COLUMNS, "fetched_at", "payload_b64")
    (
        lines.write.mode("overwrite")
        .option("compression", "gzip")
        .option("ignoreNullFields", "false")
        .option("partitionOverwriteMode", "static")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .partitionBy(*SHARD_COLUMNS)
        .json(aside)
    )
    inside = lambda at: [n for n in tables.names(spark, at) if "=" in n]
    for feed in inside(aside):
        for day in inside(f"{aside}/{feed}"):
            for hour in inside(f"{aside}/{feed}/{day}"):
                where = f"{aside}/{feed}/{day}/{hour}"
                own, date, stamp = feed.split("=")[1], day.split("=")[1], f"{day.split('=')[1]}T{hour.split('=')[1]}"
                for file in tables.names(spark, where):
                    if file.endswith(".json.gz"):
                        tables.move(spark, f"{where}/{file}", f"{root.rstrip('/')}/{own}/{date}/{stamp}{ending(own, stamp)}")
    tables.delete(spark, aside)


def shard_files(spark: SparkSession, root: str, glob: str = "*.ndjson.*") -> DataFrame:
    """Shard files below ``root``: relative path, size, time, digest."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    full = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    return files.select(
        F.substring(full, F.length(base) + 2, F.length(full)).alias("path"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.md5("content").alias("md5"),
    )


def shard_manifest(files: DataFrame) -> DataFrame:
    """Classify files as shards: archive key, partial, or unrecognised.

    An unfinished shard keeps its path as key. A name that fits no pattern has a
    null key and is reported, never guessed.
    """
    name = F.element_at(F.split("path", "/"), -1)
    partial = keys.is_partial(name)
    key = F.when(partial, F.col("path")).otherwise(keys.shard_key(F.col("path")))
    return (
        files.filter(keys.is_shard(name))
        .withColumn("partial", partial)
        .withColumn("key", key)
        .withColumn("recognised", F.col("key").isNotNull())
    )


def compare_archives(local: DataFrame, copy: DataFrame) -> DataFrame:
    """Record-by-record comparison of two archives, on feed and fetch time.

    Within a fetch time records are numbered, so that repeated ones pair up.
    Digests, not payloads, are shuffled.
    """
    def digested(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("feed", "fetched_at", F.md5("payload").alias("digest")).agg(
            F.count(F.lit(1)).alias(f"{side}_records"),
            F.sum(F.octet_length("payload")).alias(f"{side}_bytes"),
        )

    joined = digested(local, "local").join(digested(copy, "copy"), ["feed", "fetched_at", "digest"], "full_outer")
    filled = joined.fillna(0, ["local_records", "copy_records", "local_bytes", "copy_bytes"])
    return filled.withColumn("identical", F.col("local_records") == F.col("copy_records"))


def verify_archive(local: DataFrame, copy: DataFrame) -> DataFrame:
    """One row per feed: record counts, payload bytes, and whether all agree."""
    return (
        compare_archives(local, copy)
        .groupBy("feed")
        .agg(
            F.sum("local_records").alias("local_records"),
            F.sum("copy_records").alias("copy_records"),
            F.sum("local_bytes").alias("payload_bytes_verified"),
            F.count_if(~F.col("identical")).alias("differing"),
        )
        .withColumn("verified", F.col("differing") == 0)
    )
