"""Histograms, bin averages, component summaries, access ranks, message aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.order import global_rank
from tessella.graph import Graph
from tessella.operators.components import star_components


def degree_histogram(graph: Graph, direction: str = "out") -> DataFrame:
    """(degree, vertices) for every degree from 0 to the largest, without gaps."""
    counts = graph.degrees().groupBy(F.col(f"{direction}_degree").alias("degree")).agg(F.count(F.lit(1)).alias("vertices"))
    most = counts.agg(F.coalesce(F.max("degree"), F.lit(-1))).first()[0]
    return graph.spark.range(most + 1).withColumnRenamed("id", "degree").join(counts, "degree", "left").select("degree", F.coalesce("vertices", F.lit(0)).cast("long").alias("vertices"))


def bin_average(counts: DataFrame, size: int) -> DataFrame:
    """(bin, average) of runs of ``size`` positions from 1; integer division; a last partial bin is dropped."""
    binned = counts.groupBy(F.expr(f"(pos - 1) div {size} + 1").alias("bin")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("k"))
    return binned.where(F.col("k") == size).select("bin", F.expr(f"s div {size}").alias("average"))


def connected_components(graph: Graph) -> DataFrame:
    """(id, component) of every vertex; component is the least id of its weakly connected component."""
    found = star_components(graph.simple_undirected())
    return graph.ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_summary(components: DataFrame) -> DataFrame:
    """One row: number of components, the largest one's label (ties: least) and size."""
    sizes = component_sizes(components)
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("size", (-F.col("component")).alias("m"))).alias("top")).select("components", (-F.col("top.m")).alias("largest"), F.col("top.size").alias("largest_size"))


def access_ranks(visits: DataFrame) -> DataFrame:
    """(rank, visits): counts in descending order, ids dropped; ties by id only decide places."""
    return global_rank(visits.select("id", "visits"), [F.desc("visits"), F.asc("id")]).select("rank", "visits")


def aggregate_messages(graph: Graph, state: DataFrame, message: Column, aggregate: Column, to: str = "dst") -> DataFrame:
    """(id, *aggregate*): a message along each edge, made of its source's state (its target's for ``to='src'``) and the
    edge's columns, aggregated by receiver.  ``aggregate`` is an aggregate Column over ``message``."""
    key = "src" if to == "dst" else "dst"
    rows = graph.edges.join(state.withColumnRenamed("id", key), key).select(F.col(to).alias("id"), message.alias("message"))
    return rows.groupBy("id").agg(aggregate)
