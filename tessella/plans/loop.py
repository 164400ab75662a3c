"""Fixpoint loops: each round's delta is a table in the shared folder, so lineage stays one round long."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.tables import drop_stored, scratch_path

BROADCAST_ROWS = 200_000  # a frontier of ids and values: a few MB
POINT_ROWS = 500
MERGE = 32


class Log:
    """Deltas written one after another and read together; every MERGE of them become one table.

    ``rounds`` has the rows and seconds of each delta.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths, self.schema = spark, label, [], None
        self.rounds: list[tuple[int, float]] = []
        self._began = time.perf_counter()

    def _write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The delta as a table, and its rows."""
        delta = self._write(df)
        if len(self.paths) > MERGE:  # of those before, which only ``all`` reads any more
            last = self.paths.pop()
            old, self.paths = self.all(), []
            self._write(old)
            drop_stored(self.spark, old)
            self.paths.append(last)
        rows, now = delta.count(), time.perf_counter()
        self.rounds.append((rows, now - self._began))
        self._began = now
        return delta, rows

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def frontier_join(edges: DataFrame, frontier: DataFrame, rows: int) -> DataFrame:
    """Edges out of the frontier (its columns beside theirs; key ``id`` = src).

    A frontier of a few rows becomes a filter on the scan: edges bucketed and sorted by source are then read by bucket
    and row group and not as a whole, which keeps rounds short where there are many.  A small one, its rows counted, is
    broadcast and pushes along the edges in place; a large one is joined by shuffle, which moves only the frontier where
    edges are bucketed by source.
    """
    if rows <= POINT_ROWS:
        edges = edges.where(F.col("src").isin([r["id"] for r in frontier.select("id").distinct().collect()]))
    frontier = F.broadcast(frontier) if rows <= BROADCAST_ROWS else frontier
    return edges.join(frontier, edges["src"] == frontier["id"])


def unseen(reached: DataFrame, log: Log, keys: list[str], most: int) -> DataFrame:
    """The reached rows whose keys are not in the log.  ``most`` bounds the rows of ``reached``: up to BROADCAST_ROWS
    they are broadcast to the log's scan, so that the log itself is not shuffled."""
    if most > BROADCAST_ROWS:
        return reached.join(log.all().select(*keys), keys, "left_anti")
    seen = log.all().select(*keys).join(F.broadcast(reached.select(*keys)), keys, "left_semi")
    return reached.join(seen, keys, "left_anti")
