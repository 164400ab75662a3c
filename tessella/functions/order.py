"""Global order in two passes: ranges are sorted apart, and one total a range goes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.tables import stored


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the exclusive running sum of ``value`` in the total order ``order``."""
    spark = df.sparkSession
    rows = stored(df.repartitionByRange(*order).withColumns({"__range": F.spark_partition_id(), "__value": value}), "ordered")
    totals = sorted((r["__range"], r["t"]) for r in rows.groupBy("__range").agg(F.sum("__value").alias("t")).collect())
    before, offsets = 0, []
    for k, t in totals:
        offsets.append((k, before))
        before += t
    offsets = spark.createDataFrame(offsets, "__range int, __before long")  # as many rows as there are ranges
    inner = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__inner") + F.col("__before")).cast("long")).drop("__range", "__value", "__inner", "__before")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its place from 0 in the total order ``order``."""
    return running_sum(df, order, F.lit(1).cast("long"), name)
