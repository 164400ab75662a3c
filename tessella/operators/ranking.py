"""PageRank, betweenness and independent sets; edges with an end outside 0..n-1 are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.plans.loop import Log, frontier_join, unseen
from tessella.tables import drop_stored, stored


def pagerank(graph: Graph, damping: float = 0.85, iterations: int = 1, initial: float = 1.0) -> DataFrame:
    """(id, rank): sums start afresh each round, ranks are not normalised and vertices without edges send nothing."""
    edges = graph.inner
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    senders = stored(degrees, "degrees") if iterations > 1 else degrees
    ranks = graph.ids.select("id", F.lit(initial).alias("rank"))
    last = None
    for k in range(iterations):
        share = senders.join(ranks, "id").select(F.col("id").alias("src"), (F.col("rank") / F.col("d")).alias("share")) if k else senders.select(F.col("id").alias("src"), (F.lit(initial) / F.col("d")).alias("share"))
        sums = edges.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("s"))
        ranks = graph.ids.join(sums, "id", "left").select("id", (F.lit((1 - damping) / max(graph.n, 1)) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if k + 1 < iterations:
            ranks = stored(ranks, "ranks")
            if last is not None:
                drop_stored(graph.spark, last)
            last = ranks
    return ranks


def betweenness(graph: Graph, source: int = 0) -> DataFrame:
    """(id, level, sigma, dependency) of the reached vertices: shortest paths from the source and its dependency on
    each vertex; the source's own dependency is kept (reached vertices less one)."""
    log = Log(graph.spark, "sigma")
    start = [(source, 0, 1.0)] if 0 <= source < graph.n else []
    (frontier, rows), level = log.append(graph.spark.createDataFrame(start, "id long, level long, sigma double")), 0
    while rows:
        level += 1
        reached = stored(frontier_join(graph.inner, frontier.select("id", "sigma"), rows).groupBy(F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma")), "reached")
        frontier, rows = log.append(unseen(reached, log, ["id"], reached.count()).select("id", F.lit(level).cast("long").alias("level"), "sigma"))
        drop_stored(graph.spark, reached)
    # Backwards over edges bucketed by target, once: x = 1 / sigma + the x of successors one level on.
    back, reverse = Log(graph.spark, "dependency"), None
    ahead, rows = None, 0
    for k in reversed(range(level + 1)):
        own = log.all().where(F.col("level") == k)
        x = own.withColumn("x", 1.0 / F.col("sigma"))
        if rows:
            reverse = reverse or Graph(graph.inner.select("src", "dst"), graph.n).reversed().bucketed()
            sums = frontier_join(reverse.edges, ahead.select("id", F.col("x").alias("ahead")), rows).select(F.col("dst").alias("to"), "ahead").groupBy(F.col("to").alias("id")).agg(F.sum("ahead").alias("sum"))
            x = x.join(sums, "id", "left").select("id", "level", "sigma", (F.col("x") + F.coalesce("sum", F.lit(0.0))).alias("x"))
        ahead, rows = back.append(x)
    return back.all().select("id", "level", "sigma", (F.col("sigma") * F.col("x") - 1.0).alias("dependency"))


def betweenness_sum(graph: Graph, sources: list[int]) -> DataFrame:
    """(id, dependency) summed over sources, each without its own; without sources no rows."""
    if not sources:
        return graph.spark.createDataFrame([], "id long, dependency double")
    parts = [betweenness(graph, s).where(F.col("id") != s).select("id", "dependency") for s in sources]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.sum("dependency").alias("dependency"))


def independent_set(graph: Graph) -> DataFrame:
    """(id, status) of every vertex, 3 in and 2 out: the set that is first in order of ids, on the undirected graph
    without loops.  A round takes every vertex without a smaller undecided neighbour and sets its neighbours out."""
    edges = stored(graph.simple_undirected(), "edges")
    log, found = Log(graph.spark, "mis"), False
    while edges.limit(1).count():
        # Undecided vertices that are the larger end of no edge go in.
        inside = edges.select(F.col("u").alias("id")).distinct().join(edges.select(F.col("v").alias("id")).distinct(), "id", "left_anti")
        inside = stored(inside, "in")
        out = edges.join(inside, edges["u"] == inside["id"], "left_semi").select(F.col("v").alias("id")).distinct()
        done, _ = log.append(inside.select("id", F.lit(3).alias("status")).unionByName(out.select("id", F.lit(2).alias("status"))))
        found = True
        u, v = (done.select(F.col("id").alias(c)) for c in "uv")
        # A vertex whose edges are all gone is undecided yet: it has no undecided neighbour left and goes in below.
        last, edges = edges, stored(edges.join(u, "u", "left_anti").join(v, "v", "left_anti"), "edges")
        drop_stored(graph.spark, last)
    decided = log.all() if found else graph.spark.createDataFrame([], "id long, status int")
    return graph.ids.join(decided, "id", "left").select("id", F.coalesce("status", F.lit(3)).alias("status"))


def independent_set_size(status: DataFrame) -> DataFrame:
    """One row: the number of vertices in the set."""
    return status.agg(F.count(F.when(F.col("status") == 3, 1)).alias("size"))


def independent_set_violations(graph: Graph, status: DataFrame) -> DataFrame:
    """One row a fault: 'edge' for two neighbours that are both in, 'gap' for one out without a neighbour in."""
    both = graph.inner.where("src <> dst").select("src", "dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    inside = status.where("status = 3").select("id")
    near = both.join(inside, both["dst"] == inside["id"], "left_semi")
    edge = near.join(inside, near["src"] == inside["id"], "left_semi").where("src < dst").select(F.lit("edge").alias("fault"), F.col("src").alias("id"))
    covered = near.select(F.col("src").alias("id")).distinct()
    gap = status.where("status <> 3").join(covered, "id", "left_anti").select(F.lit("gap").alias("fault"), "id")
    return edge.unionByName(gap)
