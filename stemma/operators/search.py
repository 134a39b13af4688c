"""Predicates and text search. A limit keeps the first rows in file order; at least one row is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.plans.model import Tree
from stemma.plans.tables import union_all

SUMMARY = ["id", "name", "birth_date", "death_date", "ord"]


def has(column: Column, query: str) -> Column:
    """Whether the text occurs in any case; false for null."""
    return F.coalesce(F.lower(column).contains(query.lower()), F.lit(False))


def _first(df: DataFrame, order: list[str], most: int | None) -> DataFrame:
    return df if most is None else df.orderBy(*order).limit(max(1, most))


def by_name(tree: Tree, name: str, most: int | None = 50) -> DataFrame:
    hit = has(F.col("given_name"), name) | has(F.col("surname"), name) | has(F.col("name"), name)
    return _first(tree.individuals.where(hit).select(*SUMMARY), ["ord", "id"], most)


def by_birth(tree: Tree, year: int | None = None, place: str | None = None, year_range: int = 5, most: int | None = 50) -> DataFrame:
    df = tree.individuals
    if year:
        df = df.where(F.col("birth_year").between(year - year_range, year + year_range))
    if place:
        df = df.where(has(F.col("birth_place"), place))
    return _first(df.select(*SUMMARY, "birth_place"), ["ord", "id"], most)


def by_place(tree: Tree, place: str, most: int | None = 50) -> DataFrame:
    """People with any place that contains the text, each once."""
    hits = tree.individual_place.where(has(F.col("place"), place)).select("individual_id").distinct()
    return _first(tree.individuals.join(hits, F.col("id") == hits.individual_id, "left_semi").select(*SUMMARY, "birth_place", "death_place"), ["ord", "id"], most)


def events(tree: Tree, event_type: str | None = None, place: str | None = None, year: int | None = None, year_range: int = 5, most: int | None = 50) -> DataFrame:
    """Events by type, place and year; with a year, events without one do not count."""
    e = tree.events
    if event_type:
        e = e.where(F.col("type") == event_type.upper())
    if place:
        e = e.where(has(F.col("place"), place))
    if year:
        e = e.where(F.col("year").between(year - year_range, year + year_range))
    j = e.join(tree.names.select("id", "name", "ord"), e.individual_id == F.col("id"))
    return _first(j.select("individual_id", "name", "event_ord", "type", "date", "place", "ord"), ["ord", "event_ord"], most)


def sources(tree: Tree, query: str, most: int | None = 50) -> DataFrame:
    return _first(tree.sources.where(has(F.col("title"), query) | has(F.col("author"), query)).select("id", "title", "author", "ord"), ["ord"], most)


def narrative(tree: Tree, query: str, most: int | None = 50) -> DataFrame:
    """A row for each hit in people's notes, then their events' notes, then citations, person by person."""
    p = tree.individuals
    own = p.select(F.col("id").alias("individual_id"), F.lit("individual_note").alias("kind"), F.lit(-1).alias("event_ord"), F.posexplode("notes").alias("pos", "text"))
    notes = tree.events.select("individual_id", F.lit("event_note").alias("kind"), "event_ord", F.posexplode("notes").alias("pos", "text"))
    cites = tree.citations.select("individual_id", F.lit("citation").alias("kind"), "event_ord", F.col("cite_ord").alias("pos"), "text")
    hits = union_all([own, notes, cites]).where(has(F.col("text"), query))
    j = hits.join(tree.names.select("id", "name", "ord"), hits.individual_id == F.col("id"))
    out = j.select("individual_id", "name", "kind", "event_ord", "pos", X.snippet(F.col("text"), query).alias("snippet"), "ord")
    if most is not None:
        out = out.orderBy("ord", "event_ord", F.when(F.col("kind") == "individual_note", 0).when(F.col("kind") == "event_note", 1).otherwise(2), "pos").limit(max(0, most))
    return out


def military(tree: Tree) -> DataFrame:
    """(individual_id, event_ord, year, place) of military events."""
    return tree.events.where(X.is_military(F.col("type"), F.col("description"), F.col("notes"))).select("individual_id", "event_ord", "year", "place")
