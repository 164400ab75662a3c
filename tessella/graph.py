"""The graph model: vertices 0..n-1 and directed edges, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.tables import bucketed


class Graph:
    """``n`` vertices and ``edges`` (src, dst[, weight]); repeated edges and loops are kept, isolated vertices exist."""

    def __init__(self, edges: DataFrame, n: int):
        self.spark: SparkSession = edges.sparkSession
        self.n = int(n)
        self.weighted = "weight" in edges.columns
        self.edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *([F.col("weight").cast("long").alias("weight")] if self.weighted else []))

    @property
    def ids(self) -> DataFrame:
        return self.spark.range(self.n)

    def bucketed(self) -> Graph:
        """The same graph with its edges written once, bucketed by source: joins on src then move only the other side."""
        return Graph(bucketed(self.edges, "src", "edges"), self.n)

    def symmetrized(self) -> Graph:
        """Each edge and its reverse, weights copied, nothing dropped."""
        return Graph(self.edges.unionByName(self.reversed().edges), self.n)

    def reversed(self) -> Graph:
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if self.weighted else [])), self.n)

    def simple_undirected(self) -> DataFrame:
        """Distinct (u, v), u < v, without loops."""
        return self.inner.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every vertex, isolated ones included."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(self.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        found = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        return self.ids.join(found, "id", "left").select("id", F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"))

    @property
    def inner(self) -> DataFrame:
        """Edges with both ends in 0..n-1: traversals and rankings take no others (see ``invalid_edges``)."""
        return self.edges.where(F.col("src").between(0, self.n - 1) & F.col("dst").between(0, self.n - 1))

    def invalid_edges(self) -> DataFrame:
        """Edges with a missing end or one outside 0..n-1."""
        inside = F.col("src").between(0, self.n - 1) & F.col("dst").between(0, self.n - 1)
        return self.edges.where(~F.coalesce(inside, F.lit(False)))
