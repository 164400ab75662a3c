"""Text formats of edge lists: raw, weighted, sharded, header-less, converted and adjacency files.

Files hold 1-based ids unless said otherwise; graphs are 0-based.  Readers work on any file system Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.order import global_rank, running_sum
from tessella.graph import Graph
from tessella.tables import stored

NO_CHARACTER = "\x01"


def _lines(spark: SparkSession, path: str | list[str], skip_first: bool) -> DataFrame:
    """Non-empty lines as arrays of words, without each file's first line if so asked."""
    reader = spark.read.schema("line string").option("sep", NO_CHARACTER).option("quote", "").option("header", skip_first)
    return reader.csv(path).select(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("w")).where("w[0] <> ''")


def _header(spark: SparkSession, path: str) -> list[int]:
    return [int(x) for x in spark.read.text(path).limit(1).first()[0].split()]


def _edges(lines: DataFrame, weighted: bool, base: int) -> DataFrame:
    at = lambda k: F.element_at("w", k).cast("long")
    return lines.select((at(1) - base).alias("src"), (at(2) - base).alias("dst"), *([at(3).alias("weight")] if weighted else []))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(place, token) of a file's words in the file's order.  The file is read in splits: the order is that of a split's
    offset, then of its lines, then of the words of a line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))
    words = lines.select("block", "line", F.posexplode("w").alias("k", "token")).where("token <> ''")
    return global_rank(words, [F.asc("block"), F.asc("line"), F.asc("k")], "place").select("place", "token")


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> Graph:
    """One file: a header ``vertices edges``, then ``src dst[ weight]``, 1-based."""
    n = _header(spark, path)[0]
    return Graph(_edges(_lines(spark, path, True), weighted, 1), n)


def read_headless(spark: SparkSession, path: str, n: int, weighted: bool = False) -> Graph:
    """0-based rows without a header; ``n`` is given."""
    return Graph(_edges(_lines(spark, path, False), weighted, 0), n)


def read_converted(spark: SparkSession, path: str, n: int) -> Graph:
    """One leading word, then 0-based ``src dst weight``."""
    return Graph(_edges(_lines(spark, path, True), True, 0), n)


def read_shards(spark: SparkSession, prefix: str, shards: int = 64, weighted: bool = False) -> Graph:
    """Files ``prefix-0`` ... ``prefix-<shards - 1>``, 1-based, the header in the first alone."""
    n = _header(spark, f"{prefix}-0")[0]
    lines = _lines(spark, f"{prefix}-0", True)
    if shards > 1:
        lines = lines.unionByName(_lines(spark, [f"{prefix}-{k}" for k in range(1, shards)], False))
    return Graph(_edges(lines, weighted, 1), n)


def read_degrees(spark: SparkSession, prefix: str) -> DataFrame:
    """(id, out_degree) from ``prefix-nneibor``: one degree a line in vertex order."""
    return _tokens(spark, f"{prefix}-nneibor").select(F.col("place").alias("id"), F.col("token").cast("long").alias("out_degree"))


def read_offsets(spark: SparkSession, prefix: str) -> DataFrame:
    """(tile_id, offset) from ``prefix-offsets``: one offset a line in tile order."""
    return _tokens(spark, f"{prefix}-offsets").select(F.col("place").alias("tile_id"), F.col("token").cast("long").alias("offset"))


def read_adjacency(spark: SparkSession, path: str) -> Graph:
    """One word, n, m, n offsets, m 0-based targets, separated by white space."""
    tokens = stored(_tokens(spark, path), "tokens")
    head = dict(tokens.where("place in (1, 2)").select("place", F.col("token").cast("long")).collect())
    n, m = head[1], head[2]
    rows = tokens.where((F.col("place") >= 3) & (F.col("place") < 3 + n + m)).select((F.col("place") - 3).alias("k"), F.col("token").cast("long").alias("x"))
    # In order of place in the targets, offsets before targets, a target's source is the number of offsets so far less one.
    offsets = rows.where(F.col("k") < n).select(F.col("x").alias("at"), F.lit(1).cast("long").alias("starts"), F.lit(None).cast("long").alias("dst"))
    targets = rows.where(F.col("k") >= n).select((F.col("k") - n).alias("at"), F.lit(0).cast("long").alias("starts"), F.col("x").alias("dst"))
    ordered = running_sum(offsets.unionByName(targets), [F.asc("at"), F.desc("starts")], F.col("starts"), "before")
    return Graph(ordered.where("starts = 0").select((F.col("before") - 1).alias("src"), "dst"), n)


# ---------------------------------------------------------------- writers


def _rename(spark: SparkSession, folder: str, names: dict[int, str]) -> None:
    """The part file of each shard under its final name; the folder goes."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, name in names.items():
        target = jvm.org.apache.hadoop.fs.Path(name)
        fs.delete(target, False)
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={k}/part-*"))
        if len(found):
            fs.rename(found[0].getPath(), target)
        else:
            fs.create(target).close()
    fs.delete(root, True)


def _write_lines(lines: DataFrame, folder: str, names: dict[int, str]) -> None:
    """(shard, place, line) as one text file a shard, lines by place."""
    spark = lines.sparkSession
    lines.repartition(F.col("shard")).sortWithinPartitions("shard", "place").select("shard", "line").write.mode("overwrite").partitionBy("shard").text(folder)
    _rename(spark, folder, names)


def _line(graph: Graph, base: int, edges: DataFrame | None = None) -> DataFrame:
    edges = graph.edges if edges is None else edges
    return edges.withColumn("line", F.concat_ws(" ", F.col("src") + base, F.col("dst") + base, *([F.col("weight")] if graph.weighted else [])))


def write_edge_list(graph: Graph, path: str) -> None:
    """One file with a header, 1-based, in source order."""
    m = graph.edges.count()
    ordered = global_rank(_line(graph, 1), [F.asc(c) for c in graph.edges.columns], "place")
    header = graph.spark.createDataFrame([(0, -1, f"{graph.n} {m}")], "shard int, place long, line string")
    _write_lines(ordered.select(F.lit(0).alias("shard"), "place", "line").unionByName(header), f"{path}.parts", {0: path})


def write_converted(graph: Graph, path: str, word: str = "graph") -> None:
    """One file: a leading word, then 0-based ``src dst weight``, in source order."""
    ordered = global_rank(_line(graph, 0), [F.asc(c) for c in graph.edges.columns], "place")
    header = graph.spark.createDataFrame([(0, -1, word)], "shard int, place long, line string")
    _write_lines(ordered.select(F.lit(0).alias("shard"), "place", "line").unionByName(header), f"{path}.parts", {0: path})


def write_headless(graph: Graph, path: str) -> None:
    """A folder of text files, 0-based, without a header."""
    _line(graph, 0).select("line").write.mode("overwrite").text(path)


def write_shards(graph: Graph, prefix: str, shards: int = 64, order: list[str] | None = None, edges: DataFrame | None = None) -> None:
    """Files ``prefix-<k>`` of edges/shards rows each, the remainder in the last, and ``prefix-nneibor`` of degrees.

    ``edges`` may carry tile columns (``tiled``, ``striped``) and ``order`` then name them, for tiled and striped files.
    """
    rows = _line(graph, 1, edges)
    keys = [*(order or []), *graph.edges.columns]
    m = graph.edges.count()
    ranked = global_rank(rows, [F.asc(c) for c in keys], "place")
    each = max(1, m // shards)
    lines = ranked.select(F.least(F.expr(f"place div {each}"), F.lit(shards - 1)).cast("int").alias("shard"), "place", "line")
    header = graph.spark.createDataFrame([(0, -1, f"{graph.n} {m}")], "shard int, place long, line string")
    _write_lines(lines.unionByName(header), f"{prefix}.parts", {k: f"{prefix}-{k}" for k in range(shards)})
    degrees = graph.degrees().select(F.lit(0).alias("shard"), F.col("id").alias("place"), F.col("out_degree").cast("string").alias("line"))
    _write_lines(degrees, f"{prefix}.degrees", {0: f"{prefix}-nneibor"})


def write_offsets(offsets: DataFrame, prefix: str) -> None:
    """``prefix-offsets``: one tile offset a line in tile order."""
    lines = offsets.select(F.lit(0).alias("shard"), F.col("tile_id").alias("place"), F.col("offset").cast("string").alias("line"))
    _write_lines(lines, f"{prefix}.offset-parts", {0: f"{prefix}-offsets"})


def write_adjacency(graph: Graph, path: str, word: str = "AdjacencyGraph") -> None:
    """A word, n, m, offsets and 0-based targets, one token a line."""
    m = graph.edges.count()
    offsets = running_sum(graph.degrees().select("id", "out_degree"), [F.asc("id")], F.col("out_degree"), "offset")
    targets = global_rank(graph.edges.select("src", "dst"), [F.asc("src"), F.asc("dst")], "place")
    head = graph.spark.createDataFrame([(0, -3, word), (0, -2, str(graph.n)), (0, -1, str(m))], "shard int, place long, line string")
    body = offsets.select(F.lit(0).alias("shard"), F.col("id").alias("place"), F.col("offset").cast("string").alias("line"))
    tail = targets.select(F.lit(0).alias("shard"), (F.col("place") + graph.n).alias("place"), F.col("dst").cast("string").alias("line"))
    _write_lines(head.unionByName(body).unionByName(tail), f"{path}.parts", {0: path})
