"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

On unit vectors the largest cosine is the least Euclidean distance, so each of ``tables`` hash
tables projects them on ``hashes`` Gaussian directions and cuts each line into cells of ``width``;
a bucket is a cell of each. A query visits, in each table, its own bucket and those that differ by
one cell in some directions, in the order of estimated success: the least sum of squared distances to
the cell borders that must be crossed, ``probes`` buckets in all. What the tables return is merged
and ranked by the exact cosine of the original vectors in double precision.

Equal vectors are one class, represented by its smallest ids, so a vector that very many rows share
is compared once. Buckets are cut into blocks of about ``BLOCK`` classes, and their queries too; a
task compares one block with one block and passes on each query's best. Nothing is dropped.

Vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors
of equal length meet. A row without id takes no part. Rows that repeat an id are each compared, but
never with rows of their own id. Queries without a candidate give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .hashing import U, mix

TABLES, HASHES, WIDTH, PROBES = 8, 4, 1.5, 16
BLOCK = 2048


def directions(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Projections (dim, tables * hashes) and their offsets, the same on every worker."""
    rng = np.random.default_rng((4, dim))
    return rng.normal(size=(dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def _keys(cells: np.ndarray, dim: int) -> np.ndarray:
    """One key for each table's cells, (..., tables, hashes)."""
    key = np.arange(cells.shape[-2], dtype=U) + U(dim * 0x9E3779B97F4A7C15 % 2**64)
    key = np.broadcast_to(key, cells.shape[:-1])
    for k in range(cells.shape[-1]):
        key = mix(key * U(0xC2B2AE3D27D4EB4F) + cells[..., k].astype(np.int64).view(U))
    return key.view(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    flat, ends = np.asarray(column.flatten(), dtype=np.float64), np.asarray(column.offsets)
    size = np.diff(ends)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, flat[(ends[rows] - ends[0])[:, None] + np.arange(dim)]


def _hashed(probes: int, tables: int, hashes: int, width: float):
    """Adds to (node, vec) the keys of its buckets, ``probes`` in each table."""
    steps = np.array(list(product((0, -1, 1), repeat=hashes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty((batch.num_rows, tables * probes), dtype=np.int64)
            for rows, x in _by_length(batch.column("vec")):
                a, b = directions(x.shape[1], tables, hashes, width)
                place = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ a + b) / width
                place = place.reshape(len(x), tables, hashes)
                cell = np.floor(place)
                if probes == 1:
                    keys[rows] = _keys(cell, x.shape[1])
                    continue
                below = place - cell
                # Indexed by the step: none, one cell up, and (last) one cell down.
                cost = np.stack((np.zeros_like(below), (1 - below) ** 2, below**2), axis=-1)
                for t in range(tables):
                    total = sum(cost[:, t, k][:, steps[:, k]] for k in range(hashes))
                    best = np.argsort(total, axis=1, kind="stable")[:, :probes]
                    visited = (cell[:, t, None, :] + steps[best])[:, :, None, :]
                    shift = np.zeros((len(x), probes, tables, hashes))
                    shift[:, :, t : t + 1] = visited
                    keys[rows, t * probes : (t + 1) * probes] = _keys(shift, x.shape[1])[:, :, t]
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], [*batch.schema.names, "keys"])

    return run


def _best(width: int):
    """Compares a block of classes with a block of queries; each query's ``width`` best."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if own.num_rows and asked.num_rows:
            nodes, queries = own.column("node").to_numpy(), asked.column("node").to_numpy()
            order = np.argsort(nodes, kind="stable")
            nodes = nodes[order]
            x = _matrix(own)[order]
            y = _matrix(asked)
            nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            for at in range(0, len(y), 512):
                part = y[at : at + 512]
                score = part @ x.T / (ny[at : at + 512, None] * nx)
                # A little more than wanted: rounding may differ from the final measure.
                k = min(width, score.shape[1])
                low = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - 1e-12
                q, c = np.nonzero(score >= low[:, None])
                exact = np.einsum("ij,ij->i", part[q], x[c]) / (ny[at + q] * nx[c])
                rank = np.lexsort((nodes[c], -exact, q))
                q, c, exact = q[rank], c[rank], exact[rank]
                first = np.searchsorted(q, q)
                keep = np.arange(len(q)) - first < width
                out.append(np.rec.fromarrays([queries[at + q[keep]], nodes[c[keep]], exact[keep]]))
        query, node, score = (np.concatenate([o[f"f{k}"] for o in out]) if out else np.zeros(0) for k in range(3))
        return pa.table({"query": pa.array(query.astype(np.int64)), "node": pa.array(node.astype(np.int64)), "score": pa.array(score.astype(np.float64))})

    return run


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def usable(vec: Column) -> Column:
    """Whether a vector can be compared."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``is_query``.

    ``is_query`` is a condition on the id, under the name ``id``. Ranks count from 1, nearest first,
    ties to the smaller id.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = rows.select("id", "vec", F.xxhash64("vec").alias("hi"), F.xxhash64(F.lit(1), "vec").alias("lo"))
    same = W.partitionBy("hi", "lo")
    # The k + 1 smallest ids of a class are all that can be among the k nearest of another row.
    few = rows.dropDuplicates(["hi", "lo", "id"]).withColumn("at", F.row_number().over(same.orderBy("id"))).where(F.col("at") <= k + 1)
    classes = few.groupBy("hi", "lo").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))
    classes = stored(classes, "classes")
    asked = stored(rows.where(is_query).select("id", "hi", "lo").distinct().join(classes.select("hi", "lo", "node"), ["hi", "lo"]).select("id", "node"), "asked")
    kind = f"node long, vec {rows.schema['vec'].dataType.simpleString()}, keys array<long>"
    index = stored(classes.select("node", "vec").mapInArrow(_hashed(1, tables, hashes, width), kind), "index")
    visits = classes.select("node", "vec").join(asked.select("node").distinct(), "node", "left_semi")
    visits = stored(visits.mapInArrow(_hashed(probes, tables, hashes, width), kind), "visits")
    # Blocks of a bucket, and of its visitors.
    n = index.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    m = visits.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m"))
    parts = stored(n.join(m, "key").select("key", F.ceil(F.col("n") / block).cast("int").alias("n"), F.ceil(F.col("m") / block).cast("int").alias("m")), "parts")
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.select("node", "vec", F.explode("keys").alias("key")).join(parts, "key").select("key", mine("n").alias("i"), every("m").alias("j"), "node", "vec")
    right = visits.select("node", "vec", F.explode("keys").alias("key")).join(parts, "key").select("key", every("n").alias("i"), mine("m").alias("j"), "node", "vec")
    found = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(_best(k + 1), "query long, node long, score double")
    found = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    found = found.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("at") <= k + 1)
    found = found.join(classes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(found, "query").where("query_id <> vec_id")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
