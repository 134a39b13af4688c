"""The stored tables as typed DataFrames, reduced to their current rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "individuals families person_events citations places sources repositories person_vectors documents name_forms pack_limits"
).split()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def current(df: DataFrame, *keys: str) -> DataFrame:
    """The row of each key with the greatest (loaded_at, ord).

    One aggregation with map-side combine: repeats are dropped before the shuffle, and a key with any
    number of copies is never gathered in one task as a window would. Every column is an aggregate of its own, so
    that columns nobody asks for are pruned down to the scan. Rows with a null key form one group each like any
    other key. Extra columns are kept.
    """
    newest = F.struct("loaded_at", "ord")
    return df.groupBy(*keys).agg(*[F.max_by(c, newest).alias(c) for c in df.columns if c not in keys]).select(*df.columns)


def individuals(spark: SparkSession, folder: str) -> DataFrame:
    return current(read(spark, folder, "individuals"), "id")


def families(spark: SparkSession, folder: str) -> DataFrame:
    return current(read(spark, folder, "families"), "id")


def person_events(spark: SparkSession, folder: str) -> DataFrame:
    return current(read(spark, folder, "person_events"), "individual_id", "event_ord")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    return current(read(spark, folder, "citations"), "citation_id")


def lookup_id(column: Column) -> Column:
    """Pointer in the form @..@, whatever number of @ it had on either side; null stays null."""
    return F.concat(F.lit("@"), F.regexp_replace(column, r"^@+|@+$", ""), F.lit("@"))


def pointer(column: Column) -> Column:
    """As lookup_id, but null where nothing but @ is left."""
    bare = F.regexp_replace(column, r"^@+|@+$", "")
    return F.when(bare != "", F.concat(F.lit("@"), bare, F.lit("@")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
