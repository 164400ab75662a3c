"""Breadth-first search, visit counts, shortest paths and label relaxation.

Edges with a missing end or one outside 0..n-1 are ignored; a source outside 0..n-1 reaches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.plans.loop import BROADCAST_ROWS, Log, frontier_join, unseen
from tessella.tables import drop_stored, stored


def bfs(graph: Graph, source: int = 0, max_hops: int | None = None) -> DataFrame:
    """(id, level, parent) of the reached vertices; the parent is the least possible, the source's is itself."""
    return _bfs(graph, source, max_hops).all()


def bfs_profile(graph: Graph, source: int = 0) -> DataFrame:
    """(level, vertices, seconds): the frontier and the time of each round."""
    rounds = [(k, n, s) for k, (n, s) in enumerate(_bfs(graph, source, None).rounds) if n]
    return graph.spark.createDataFrame(rounds, "level long, vertices long, seconds double")


def _bfs(graph: Graph, source: int, max_hops: int | None) -> Log:
    log, edges = Log(graph.spark, "bfs"), graph.inner
    start = [(source, 0, source)] if 0 <= source < graph.n else []
    (frontier, rows), level = log.append(graph.spark.createDataFrame(start, "id long, level long, parent long")), 0
    while rows and (max_hops is None or level < max_hops):
        level += 1
        reached = stored(frontier_join(edges, frontier.select("id"), rows).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")), "reached")
        fresh = unseen(reached, log, ["id"], reached.count())
        frontier, rows = log.append(fresh.select("id", F.lit(level).cast("long").alias("level"), "parent"))
        drop_stored(graph.spark, reached)
    return log


def visit_counts(graph: Graph, max_hops: int, max_sources: int) -> DataFrame:
    """(id, visits): by how many of the sources 0, s, 2s, ... (s = n div max_sources, 1 at least) a vertex is
    discovered within max_hops + 1 levels; a source does not discover itself."""
    step = max(1, graph.n // max_sources)
    log = Log(graph.spark, "visits")
    frontier, rows = log.append(graph.spark.range(0, graph.n, step).select(F.col("id").alias("source"), "id"))
    for _ in range(max_hops + 1):
        if not rows:
            break
        reached = frontier_join(graph.inner, frontier, rows).select("source", F.col("dst").alias("id")).distinct()
        frontier, rows = log.append(reached.join(log.all(), ["source", "id"], "left_anti"))
    return log.all().where("source <> id").groupBy("id").agg(F.count(F.lit(1)).alias("visits"))


def relaxed(graph: Graph, start: DataFrame, message: Column, max_rounds: int | None = None) -> DataFrame:
    """(id, value): the least value that reaches each vertex, from (id, value) along edges by ``message``, a column of
    value and weight.  Only vertices whose value fell send in the next round."""
    log = Log(graph.spark, "relax")
    active, rows = log.append(start.select("id", F.col("value").cast("long").alias("value")))
    k = 0
    while rows and (max_rounds is None or k < max_rounds):
        k += 1
        sent = stored(frontier_join(graph.inner, active, rows).select(F.col("dst").alias("id"), message.cast("long").alias("value")).groupBy("id").agg(F.min("value").alias("value")), "sent")
        many = sent.count()
        known = log.all()
        if many <= BROADCAST_ROWS:  # only what was sent to is looked up, and the log is not shuffled
            known = known.join(F.broadcast(sent.select("id")), "id", "left_semi")
        known = known.groupBy("id").agg(F.min("value").alias("known"))
        active, rows = log.append(sent.join(known, "id", "left").where("known is null or value < known").select("id", "value"))
        drop_stored(graph.spark, sent)
    return log.all().groupBy("id").agg(F.min("value").alias("value"))


def _source(graph: Graph, source: int) -> DataFrame:
    return graph.spark.createDataFrame([(source, 0)] if 0 <= source < graph.n else [], "id long, value long")


def sssp(graph: Graph, source: int = 0) -> DataFrame:
    """(id, dist): shortest weighted distance, hops without weights; unreached vertices have no row."""
    return relaxed(graph, _source(graph, source), F.col("value") + (F.col("weight") if graph.weighted else F.lit(1))).withColumnRenamed("value", "dist")


def bellman_ford(graph: Graph, source: int = 0, sweeps: int = 99, weight: str | None = None) -> DataFrame:
    """(id, dist) after at most ``sweeps`` sweeps of relaxation, by unit weights or those of the column ``weight``; it
    stops early at the fixed point."""
    return relaxed(graph, _source(graph, source), F.col("value") + (F.lit(1) if weight is None else F.col(weight)), sweeps).withColumnRenamed("value", "dist")


def min_label(graph: Graph) -> DataFrame:
    """(id, label): the least id from which each vertex can be reached along directed edges."""
    return relaxed(graph, graph.ids.select("id", F.col("id").alias("value")), F.col("value")).withColumnRenamed("value", "label")


def frontier_stats(graph: Graph, source: int = 0) -> DataFrame:
    """Per level: frontier size, its out-degrees, all edges, and their ratio in millionths (edges needed of scanned)."""
    levels = bfs(graph, source)
    degrees = graph.inner.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    edges = graph.edges.count()
    found = levels.join(degrees, "id", "left").groupBy("level").agg(F.count(F.lit(1)).alias("frontier"), F.coalesce(F.sum("d"), F.lit(0)).alias("out_edges"))
    return found.select("level", "frontier", "out_edges", F.lit(edges).cast("long").alias("edges"), F.expr(f"1000000 * out_edges div {max(edges, 1)}").alias("needed_ppm"))
