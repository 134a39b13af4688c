"""Tables that cut lineage, kept in the folder the cluster shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, for local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), "stemma-shared")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def home(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/stemma/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes all tables this application saved; results that still read them are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_left: set[str] = set()


def clear_at_end(spark: SparkSession) -> None:
    """Clears the application's tables when the driver's Python ends, if the session still runs then."""
    app = spark.sparkContext.applicationId
    if app not in _left:
        _left.add(app)
        atexit.register(lambda: clear(spark) if spark.sparkContext._jsc is not None else None)


class Workspace:
    """A folder of its own for each run of an operator.

    ``save`` writes a DataFrame as parquet and reads it back, so that later steps do not repeat it
    and a lost executor costs only the step at hand. ``drop`` removes a table no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        clear_at_end(spark)
        self.spark = spark
        self.root = f"{home(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name)) if not partition_by else self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def cores(spark: SparkSession) -> int:
    """Task slots of the cluster as far as Spark tells; never less than 2."""
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, least: int) -> DataFrame:
    """At least that many partitions for work that is heavy per row; a scan that has them already is left alone."""
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)
