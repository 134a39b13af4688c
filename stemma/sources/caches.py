"""Stored coordinates and vectors that are valid only for the input they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_geocache(geocoded: DataFrame, input_hash: str, path: str) -> None:
    """geocoded(id, lat, lon, source, confidence) beside the hash of its input."""
    geocoded.select("id", "lat", "lon", "source", "confidence", F.lit(input_hash).alias("input_hash")).write.mode("overwrite").parquet(path)


def read_geocache(spark: SparkSession, input_hash: str, path: str) -> DataFrame:
    """The cached rows, none if they were made from another input."""
    return spark.read.schema("id string, lat double, lon double, source string, confidence string, input_hash string").parquet(path).where(F.col("input_hash") == input_hash).drop("input_hash")


def read_geocache_json(spark: SparkSession, input_hash: str, path: str) -> DataFrame:
    """From the exchange form {gedcom_hash, geocoded: {id: {lat, lon, source, confidence}}}."""
    kind = "gedcom_hash string, geocoded map<string, struct<lat: double, lon: double, source: string, confidence: string>>"
    df = spark.read.schema(kind).option("multiLine", True).json(path).where(F.col("gedcom_hash") == input_hash)
    return df.select(F.explode("geocoded").alias("id", "v")).select("id", "v.*")


def write_vectors(vectors: DataFrame, input_hash: str, model: str, path: str) -> None:
    vectors.withColumns({"input_hash": F.lit(input_hash), "model": F.lit(model)}).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, input_hash: str, model: str, path: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("input_hash") == input_hash) & (F.col("model") == model)).drop("input_hash", "model")
