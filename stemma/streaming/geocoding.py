"""Coordinates for places that arrive over time: each micro-batch resolves what is not yet stored and appends it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.spatial import geocode

SCHEMA = "id string, lat double, lon double, source string, confidence string"


def stored(spark: SparkSession, path: str) -> DataFrame:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(SCHEMA).parquet(path) if p.getFileSystem(conf).exists(p) else spark.createDataFrame([], SCHEMA)


def geocode_new(places: DataFrame, gazetteer: DataFrame, path: str) -> None:
    """One step: places(id, original, latitude, longitude) without a stored row are resolved and appended. Running it
    again, or over a repeated batch, adds nothing."""
    known = stored(places.sparkSession, path).select(F.col("id").alias("k"))
    new = places.dropDuplicates(["id"]).join(known, F.col("id") == F.col("k"), "left_anti")
    geocode(new, gazetteer).write.mode("append").parquet(path)


def start(places_stream: DataFrame, gazetteer: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """The streaming query: a failed batch is repeated, and the anti-join keeps it from being stored twice."""
    writer = places_stream.writeStream.foreachBatch(lambda batch, _: geocode_new(batch, gazetteer, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress(places: DataFrame, path: str) -> DataFrame:
    """(total, done, status): not_started, running or complete."""
    done = stored(places.sparkSession, path).select(F.col("id").alias("k")).distinct()
    j = places.select("id").distinct().join(done, F.col("id") == F.col("k"), "left").agg(F.count("*").alias("total"), F.count("k").alias("done"))
    return j.withColumn("status", F.when(F.col("done") == 0, "not_started").when(F.col("done") < F.col("total"), "running").otherwise("complete"))
