"""Graphs derived from the input tables, with the same definition as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.tables import table

#: SQL of each graph: name -> (edges, number of vertices).
SQL = {
    "part_chain": (
        """SELECT src, dst, CAST(min(q) AS BIGINT) AS weight FROM (SELECT l_partkey AS src, l_quantity AS q,
        lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS dst FROM lineitem) t
        WHERE dst IS NOT NULL GROUP BY src, dst""",
        "(SELECT max(p_partkey) + 1 FROM part)",
    ),
    "cust_day": (
        """SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS dst
        FROM orders) t WHERE dst IS NOT NULL AND src <> dst""",
        "(SELECT max(c_custkey) + 1 FROM customer)",
    ),
    "part_supp": (
        "SELECT DISTINCT l_partkey AS src, (SELECT max(p_partkey) + 1 FROM part) + l_suppkey AS dst FROM lineitem",
        "((SELECT max(p_partkey) + 1 FROM part) + (SELECT max(s_suppkey) + 1 FROM supplier))",
    ),
}


def _top(df: DataFrame, key: str) -> int:
    most = df.agg(F.max(key)).first()[0]
    return 0 if most is None else most + 1


def part_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Consecutive parts of an order's lines, the least quantity as weight."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").alias("q")).where("dst is not null")
    return Graph(pairs.groupBy("src", "dst").agg(F.min("q").cast("long").alias("weight")), _top(table(spark, sf_dir, "part"), "p_partkey"))


def cust_day(spark: SparkSession, sf_dir: str) -> Graph:
    """Consecutive customers of a day's orders."""
    w = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(w).alias("dst")).where("dst is not null and src <> dst").distinct()
    return Graph(edges, _top(table(spark, sf_dir, "customer"), "c_custkey"))


def part_supp(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and their suppliers, numbered after the parts."""
    parts = _top(table(spark, sf_dir, "part"), "p_partkey")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + parts).alias("dst")).distinct()
    return Graph(edges, parts + _top(table(spark, sf_dir, "supplier"), "s_suppkey"))
