"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a seeded random order, make blocks of ``block`` documents. In an ideal mix
all sources that still have blocks give them at once, at rates in proportion to their weights; there
block k of a source begins and ends at known times. It is released in the slot in which it begins
and due by the end of the slot in which it ends; in each slot the released block with the earliest
deadline runs. As the ideal mix fills each slot, all deadlines are met: after any number of slots
each source has had what the ideal mix gives it to within less than one block, also when sources
have ended and the others go on with their weights among themselves.

Times are exact: weights are taken as the fractions that their floats stand for, and all is reckoned
in whole numbers. One task lays out the slots from the sources' weights and numbers of blocks. It
holds a few numbers for each source and writes a row for each block as it goes, in time that grows
with the number of blocks; the documents themselves are never gathered.

Weights are given by source, or by default grow as the source's number of rows to the power
``ALPHA``; null counts as a source. Sources not named in given weights make up one group with the
smallest of them; those of weight 0 come after all others. Every row gets one place; none is dropped
or repeated. Rows that repeat an id and a source take neighbouring places in any order. An empty
table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, with_offsets

ALPHA = 0.7
BLOCK = 16
#: Rows of one source that are ranked together.
RUN = 256


def shares(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    whole = {k: Fraction(w) for k, w in weights.items()}
    if any(w < 0 for w in whole.values()):
        raise ValueError("a weight is negative")
    unit = math.lcm(*(w.denominator for w in whole.values()))
    return {k: w.numerator * (unit // w.denominator) for k, w in whole.items()}


def slots(share: Mapping[str, int], count: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block number) of each slot until all sources have given their ``count`` of blocks."""
    later = {k: 1 for k in share if not share[k] and count[k]}
    names = sorted(k for k in share if share[k] and count[k])
    # The order in which sources end in the ideal mix; after p of them have, ``gone[p]`` blocks are
    # theirs and ``rate[p]`` shares are left.
    ends = sorted(((count[k], share[k]) for k in names), key=lambda e: Fraction(*e))
    gone, rate = [0], [sum(share[k] for k in names)]
    for n, a in ends:
        gone.append(gone[-1] + n)
        rate.append(rate[-1] - a)
    at = dict.fromkeys(names, 0)

    def before(k: str, n: int) -> tuple[int, int]:
        """Slots of the ideal mix until source k has given n blocks, rounded down and up."""
        a, p = share[k], at[k]
        if p < len(ends) and ends[p][0] * a < n * ends[p][1]:
            low, high = p + 1, len(ends)
            while low < high:
                mid = (low + high) // 2
                if ends[mid][0] * a < n * ends[mid][1]:
                    low = mid + 1
                else:
                    high = mid
            p = at[k] = low
        whole, part = divmod(n * rate[p], a)
        return gone[p] + whole, gone[p] + whole + (part > 0)

    waiting = [(0, k, 0, before(k, 1)) for k in names]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(gone[-1]):
        while waiting and waiting[0][0] <= slot:
            _, k, n, (begin, due) = heapq.heappop(waiting)
            heapq.heappush(ready, (due, k, n, begin))
        _, k, n, begin = heapq.heappop(ready)
        yield k, n
        if n + 1 < count[k]:
            # A block begins where the one before it ends.
            heapq.heappush(waiting, (begin, k, n + 1, before(k, n + 2)))
    if later:
        yield from slots(later, count)


def period(share: Mapping[str, int]) -> list[tuple[str, int]]:
    """The slots after which each source has given as many blocks as it has shares."""
    return list(slots(share, share))


def layout(held: DataFrame, weights: Mapping[str, float] | None, block: int) -> DataFrame:
    """(mix_source, mix_block, slot) of each block of sources with ``n`` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {k: n for b in batches for k, n in zip(b.column("mix_source").to_pylist(), b.column("n").to_pylist())}
        wanted = {k: n**ALPHA if weights is None else weights.get(k, min(weights.values(), default=1)) for k, n in rows.items()}
        order = enumerate(slots(shares(wanted), {k: -(-n // block) for k, n in rows.items()}))
        while part := [(k, n, slot) for slot, (k, n) in itertools.islice(order, 1 << 16)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int64(), pa.int64()))], ["mix_source", "mix_block", "slot"])

    # A row for each source.
    return held.select("mix_source", "n").coalesce(1).mapInArrow(run, "mix_source string, mix_block long, slot long")


def interleaved(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float] | None = None, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """(row, mix_source, mix_block, mix_place): the rows of ``docs`` as structs, their source's group,
    its block number, and the place in the mix by which to sort."""
    # No name begins with a control character: null and the group of the rest can't clash with one.
    group = F.coalesce(docs[source_col].cast("string"), F.lit("\x01null"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), group.alias("_group"), docs[id_col].alias("_id"))
    total = docs.count()
    if weights is None:
        rows = rows.withColumn("mix_source", F.col("_group"))
    else:
        names = docs.sparkSession.createDataFrame([(k, k) for k in weights], "_g string, _name string")
        # As many rows as the weights name.
        rows = rows.join(F.broadcast(names), F.col("_group") == F.col("_g"), "left").withColumn("mix_source", F.coalesce("_name", F.lit("\x01rest"))).drop("_g", "_name")
    runs = max(1, -(-total // RUN))
    order = F.xxhash64(F.lit(seed), "_id", "_group")
    rows = rows.withColumn("_order", order).withColumn("_run", F.pmod("_order", F.lit(runs)))
    size = rows.groupBy("mix_source", "_run").agg(F.count("*").alias("n"))
    size = stored(with_offsets(size, ["mix_source"], ["_run"], F.floor(F.col("_run") / 1024)), "runs")
    plan = stored(layout(size.groupBy("mix_source").agg(F.sum("n").alias("n")), weights, block), "slots")
    within = F.row_number().over(W.partitionBy("mix_source", "_run").orderBy("_order", "_id")) - 1
    rows = rows.withColumn("_within", within).join(size.select("mix_source", "_run", "offset"), ["mix_source", "_run"])
    rows = rows.withColumn("_rank", F.col("offset") + F.col("_within")).withColumn("mix_block", F.floor(F.col("_rank") / block))
    # A slot for each ``block`` rows.
    rows = rows.join(plan, ["mix_source", "mix_block"]).withColumn("mix_place", F.col("slot") * block + F.col("_rank") % block)
    return rows.select("row", "mix_source", "mix_block", "mix_place")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` sorted into the mix: read in the order of its files, it keeps to the weights.

    Spark reads files in another order; :func:`placed` brings the rows back into that of the mix."""
    return interleaved(docs, **options).repartitionByRange("mix_place").sortWithinPartitions("mix_place").select("row.*")


def placed(mix: DataFrame) -> DataFrame:
    """The table that :func:`mixed` was written to, in the order of the mix, with ``mix_place``: how many rows come before.

    The numbers in the files' names and the rows within files follow the mix. ``mix`` is a table as read from its files."""
    rows = mix.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    files = rows.groupBy("_file").agg(F.count("*").alias("n")).withColumn("_part", part)
    files = with_offsets(files, [], ["_part", "_file"], F.floor(F.col("_part") / 1024)).select("_file", "offset")
    # A row for each file.
    rows = rows.join(F.broadcast(files), "_file").withColumn("mix_place", F.col("offset") + F.col("_row"))
    return rows.select(*mix.columns, "mix_place").repartitionByRange("mix_place").sortWithinPartitions("mix_place")
