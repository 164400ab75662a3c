"""Edge-list layout: tiles, offsets, stripes, relabelling, adjacency, id shifts, source order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.order import global_rank, running_sum
from tessella.functions.tiles import side_of, stripe_order, tile_id, tile_row
from tessella.graph import Graph
from tessella.operators.traversal import bfs


def tiled(graph: Graph, width: int) -> DataFrame:
    """Edges with tile_row, tile_col and tile_id."""
    return graph.edges.withColumns({"tile_row": tile_row(width), "tile_col": tile_row(width, "dst"), "tile_id": tile_id(graph.n, width)})


def checked_tiles(graph: Graph, width: int) -> DataFrame:
    """``tiled``, refused where there are more tiles than edges."""
    if graph.edges.count() < side_of(graph.n, width) ** 2:
        raise ValueError("fewer edges than tiles: choose a larger width")
    return tiled(graph, width)


def tile_sizes(graph: Graph, width: int) -> DataFrame:
    """Edges of each tile that has any."""
    return tiled(graph, width).groupBy("tile_id").agg(F.count(F.lit(1)).alias("size"))


def tile_offsets(graph: Graph, width: int) -> DataFrame:
    """(tile_id, size, offset) of every tile, empty ones included."""
    every = graph.spark.range(side_of(graph.n, width) ** 2).withColumnRenamed("id", "tile_id")
    sizes = every.join(tile_sizes(graph, width), "tile_id", "left").select("tile_id", F.coalesce("size", F.lit(0)).alias("size"))
    return running_sum(sizes, [F.col("tile_id")], F.col("size"), "offset")


def striped(graph: Graph, width: int, rows: int) -> DataFrame:
    """Edges with tiles and the place of their tile in stripe order."""
    return tiled(graph, width).withColumn("stripe_order", stripe_order(graph.n, width, rows))


def relabelled(graph: Graph, labels: DataFrame) -> Graph:
    """Edges under new names; ``labels`` is (id, new_id)."""
    src = labels.select(F.col("id").alias("src"), F.col("new_id").alias("new_src"))
    dst = labels.select(F.col("id").alias("dst"), F.col("new_id").alias("new_dst"))
    more = ["weight"] if graph.weighted else []
    edges = graph.edges.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *more)
    return Graph(edges, graph.n)


def labels_by_degree(graph: Graph) -> DataFrame:
    """(id, new_id): highest out-degree first, ties by highest id."""
    return global_rank(graph.degrees().select("id", "out_degree"), [F.desc("out_degree"), F.desc("id")], "new_id").select("id", "new_id")


def labels_by_bfs(graph: Graph, source: int = 0) -> DataFrame:
    """(id, new_id): by level and id, unreached vertices last by id."""
    levels = graph.ids.join(bfs(graph, source).select("id", "level"), "id", "left")
    return global_rank(levels, [F.asc_nulls_last("level"), F.asc("id")], "new_id").select("id", "new_id")


def adjacency(graph: Graph) -> DataFrame:
    """(id, degree, neighbours ascending) of every vertex, and where its run begins in source order."""
    lists = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
    full = graph.ids.join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<long>"))).withColumn("degree", F.size("neighbours").cast("long"))
    return running_sum(full, [F.col("id")], F.col("degree"), "offset")


def adjacency_to_edges(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst"))


def shifted(edges: DataFrame, by: int) -> DataFrame:
    """Ids moved by ``by`` (1-based to 0-based: -1)."""
    return edges.withColumns({"src": F.col("src") + by, "dst": F.col("dst") + by})


def source_order(graph: Graph) -> DataFrame:
    """Edges with their place in source order (ties by target, then weight)."""
    return global_rank(graph.edges, [F.asc(c) for c in graph.edges.columns], "position")


def tile_width_range(n: int, m: int) -> tuple[int, int]:
    """Smallest and largest advisable tile width, by doubling from 64: the tile count must fit 32 bits and leave eight
    edges a tile; the largest keeps over 64 tiles a side.  Too few edges for any width give the first that fits."""
    width = 64
    while side_of(n, width) ** 2 > 4294967295:
        width *= 2
    while m // side_of(n, width) ** 2 < 8 and side_of(n, width) > 1:
        width *= 2
    least = width
    while side_of(n, width) > 64:
        width *= 2
    return least, width // 2 if side_of(n, width) <= 64 else width
