"""Reading the input tables and keeping intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir`` (any URI that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset, a folder of our own (local runs)."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(given)
        given = sc.getCheckpointDir()
    return given.rstrip("/")


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessella-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    _written.append(path)
    return path


def mark() -> int:
    """A place in the list of intermediate tables, for ``drop_since``."""
    return len(_written)


def drop_since(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove the intermediate tables written after ``mark`` but those that ``keep`` reads, and let the driver notice
    that the shuffles behind them are done with: their files otherwise stay on the executors' disks."""
    kept = {f.rsplit("/", 2)[1] for df in keep for f in df.inputFiles()}  # a table's folder has a name of its own
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = []
    for path in _written[since:]:
        if path.rsplit("/", 1)[1] in kept:
            left.append(path)
        else:
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
    _written[since:] = left
    forget_shuffles(spark)


def forget_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that the shuffles of finished queries are removed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, label: str) -> DataFrame:
    """``df`` with a unique ``__row``, written so that the key is the same however often and wherever it is read."""
    return stored(df.withColumn("__row", F.monotonically_increasing_id()), label)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files behind a table of ``stored`` that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bucketed(df: DataFrame, key: str, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder, bucketed and sorted by ``key``: later joins and groups by it move only their
    other side.  The table's name is dropped when the program ends, its files with the JVM."""
    spark = df.sparkSession
    name = f"tessella_{label}_{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).bucketBy(partitions(spark), key).sortBy(key).option("path", scratch_path(spark, label)).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session is gone, and with it the name
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
