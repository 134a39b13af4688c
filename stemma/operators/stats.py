"""Counts, groups and top lists. Ties are broken by first occurrence in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.operators import search
from stemma.plans.model import Tree


def overview(tree: Tree) -> DataFrame:
    p = tree.individuals
    one = p.agg(
        F.count("*").alias("individuals"), F.count_if(F.col("sex") == "M").alias("males"), F.count_if(F.col("sex") == "F").alias("females"),
        F.min("birth_year").alias("earliest_birth_year"), F.max("birth_year").alias("latest_birth_year"), F.count_distinct(F.nullif("surname_lc", F.lit(""))).alias("surnames"),
    )
    return one.withColumn("unknown", F.col("individuals") - F.col("males") - F.col("females")).crossJoin(tree.families.agg(F.count("*").alias("families")))


def surnames(tree: Tree) -> DataFrame:
    """(surname, n, first_ord) of surnames in lower case."""
    return tree.individuals.where("surname_lc <> ''").groupBy(F.col("surname_lc").alias("surname")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def top_surnames(tree: Tree, k: int = 20) -> DataFrame:
    return surnames(tree).orderBy(F.desc("n"), "first_ord").limit(k)


def surname_groups(tree: Tree) -> DataFrame:
    """Of each surname: members, earliest and latest birth year, number of generations of 25 years (0 without years)."""
    g = tree.individuals.where("surname_lc <> ''").groupBy(F.col("surname_lc").alias("surname")).agg(F.count("*").alias("members"), F.min("birth_year").alias("earliest"), F.max("birth_year").alias("latest"))
    return g.withColumn("generations", F.when(F.col("earliest").isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor((F.col("latest") - F.col("earliest")) / 25) + 1)).cast("bigint"))


def _top_in_group(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    counted = df.groupBy(group, item).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "first_ord", item)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first_ord")


def surname_places(tree: Tree, k: int = 5, dated_only: bool = False) -> DataFrame:
    """(surname, birth_place, n, rank): the k most frequent birth places of each surname."""
    p = tree.individuals.where("surname_lc <> '' and birth_place is not null and birth_place <> ''")
    return _top_in_group((p.where("birth_year is not null") if dated_only else p).withColumnRenamed("surname_lc", "group_surname"), "group_surname", "birth_place", k).withColumnRenamed("group_surname", "surname")


def surname_spouses(tree: Tree) -> DataFrame:
    """(surname, spouse_id): spouses of members who are not members themselves, each once."""
    f = tree.spouse_family.withColumn("spouse_id", F.when(F.col("husband_id") == F.col("person_id"), F.col("wife_id")).otherwise(F.col("husband_id")))
    mine = tree.individuals.select(F.col("id").alias("m_id"), F.col("surname_lc").alias("surname")).where("surname <> ''")
    theirs = tree.individuals.select(F.col("id").alias("t_id"), F.col("surname_lc").alias("other"))
    return f.join(mine, f.person_id == mine.m_id).join(theirs, F.col("spouse_id") == theirs.t_id).where("surname <> other").select("surname", "spouse_id").distinct()


def surname_origins(tree: Tree) -> DataFrame:
    """(surname, primary_origin, earliest, latest, span): the place of the earliest dated birth, first in file order on ties."""
    p = tree.individuals.where("surname_lc <> '' and birth_place is not null and birth_place <> '' and birth_year is not null")
    g = p.groupBy(F.col("surname_lc").alias("surname")).agg(F.min_by("birth_place", F.struct("birth_year", "ord")).alias("primary_origin"), F.min("birth_year").alias("earliest"), F.max("birth_year").alias("latest"))
    return g.withColumn("span", F.col("latest") - F.col("earliest"))


def surname_timeline(tree: Tree) -> DataFrame:
    """(surname, birth_place, birth_year), distinct: read per place for its years, by first year for the spread."""
    p = tree.individuals.where("surname_lc <> '' and birth_place is not null and birth_place <> '' and birth_year is not null")
    return p.select(F.col("surname_lc").alias("surname"), "birth_place", "birth_year").distinct()


def military_people(tree: Tree) -> DataFrame:
    m = search.military(tree).groupBy("individual_id").agg(F.count("*").alias("events"))
    return m.join(tree.names, m.individual_id == F.col("id")).select("individual_id", "name", "events")


def military_centuries(tree: Tree) -> DataFrame:
    return search.military(tree).where("year is not null").groupBy(X.century(F.col("year")).alias("century")).agg(F.count("*").alias("events"))


def military_places(tree: Tree, k: int = 10) -> DataFrame:
    """The k most frequent places, ties by name."""
    return search.military(tree).where("place is not null and place <> ''").groupBy("place").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "place").limit(k)


def geo_coverage(tree: Tree) -> DataFrame:
    """Places, those with coordinates, and the whole percentage."""
    g = tree.places.agg(F.count("*").alias("total"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("geocoded"))
    return g.withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("geocoded") * 100 / F.col("total"))).otherwise(F.lit(0)).cast("bigint"))
