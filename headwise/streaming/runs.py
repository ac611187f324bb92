"""A table kept as sorted-out runs: one for each batch, merged by size tiers, read as their union.

A batch writes one folder, ``run=<tier>-<first batch>-<last batch>``, and never touches another. When
``FANOUT`` runs of a tier lie before the newest batch, they are merged to one of the next tier, so
a day's rows lie in at most ``FANOUT - 1`` runs of each tier and are rewritten once a tier. A folder counts when
Spark has marked it complete; one whose batches all lie in a run of a higher tier is passed over, so a
merge that ends at any point changes nothing for readers. Folders passed over are removed by the
next merge only, when a reader that began before has had a batch's time to end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import tables

FANOUT = 8


@dataclass(frozen=True, order=True)
class Run:
    tier: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"run={self.tier}-{self.first}-{self.last}"

    def within(self, other: Run) -> bool:
        return self.tier < other.tier and other.first <= self.first and self.last <= other.last


@dataclass(frozen=True)
class RunTable:
    """The runs below ``path``, partitioned by ``day`` inside; ``merge`` folds rows of several runs."""

    path: str
    day: str
    merge: Callable[[DataFrame], DataFrame]

    def _all(self, spark: SparkSession) -> list[Run]:
        names = [n for n in tables.names(spark, self.path) if n.startswith("run=")]
        done = [n for n in names if tables.exists(spark, f"{self.path}/{n}/_SUCCESS")]
        return sorted(Run(*map(int, n[4:].split("-"))) for n in done)

    def runs(self, spark: SparkSession) -> list[Run]:
        """Those that count: complete, and in no run of a higher tier."""
        found = self._all(spark)
        return [r for r in found if not any(r.within(o) for o in found)]

    def put(self, rows: DataFrame, run: Run) -> None:
        """Write a run; one of the same name is replaced as a whole."""
        out = rows.hint("rebalance", self.day).sortWithinPartitions(self.day, *[c for c in rows.columns if c != self.day][:1])
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(self.day).parquet(f"{self.path}/{run.name}")

    def put_batch(self, rows: DataFrame, batch_id: int) -> None:
        self.put(rows, Run(0, batch_id, batch_id))

    def read(self, spark: SparkSession, schema: StructType, runs: Iterable[Run] | None = None) -> DataFrame:
        """Rows of the given runs, else of all that count, as they were written."""
        paths = [f"{self.path}/{r.name}" for r in (self.runs(spark) if runs is None else runs)]
        if not paths:
            return spark.createDataFrame([], schema)
        # The folder of a run is no partition value: its name is a matter of storage.
        reader = spark.read.schema(schema).option("basePath", self.path)
        return reader.parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names])

    def compact(self, spark: SparkSession, schema: StructType, before: int, fanout: int = FANOUT) -> list[Run]:
        """Merge full tiers of runs that end before batch ``before``; returns the runs made."""
        for old in set(self._all(spark)) - set(self.runs(spark)):
            tables.delete(spark, f"{self.path}/{old.name}")
        made: list[Run] = []
        tier = 0
        while True:
            ready = [r for r in self.runs(spark) if r.tier == tier and r.last < before]
            if not ready and not any(r.tier > tier for r in self.runs(spark)):
                return made
            while len(ready) >= fanout:
                group, ready = ready[:fanout], ready[fanout:]
                made.append(Run(tier + 1, group[0].first, group[-1].last))
                self.put(self.merge(self.read(spark, schema, group)), made[-1])
            tier += 1

    def forget(self, spark: SparkSession, days: Iterable[object]) -> None:
        """Remove whole days from every run."""
        for run in self._all(spark):
            for day in days:
                tables.delete(spark, f"{self.path}/{run.name}/{self.day}={day}")
