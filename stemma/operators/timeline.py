"""Events in order of year (those without one last), then of the date's text, then of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators.lookup import ids_of
from stemma.plans.model import Tree



def sort_key() -> list[Column]:
    return [F.coalesce("year", F.lit(9999)).alias("sort_year"), F.coalesce("date", F.lit("")).alias("sort_date")]


def person(tree: Tree, id_: str) -> DataFrame:
    return merged(tree, [id_]).drop("n")


def everyone(tree: Tree) -> DataFrame:
    """The sort key beside each event, so that any person's timeline is a range of the table."""
    return tree.events.select("individual_id", "event_ord", "type", "date", "year", "place", *sort_key())


def families(tree: Tree) -> DataFrame:
    """(family_id, member_id, ...): the events of husband, wife and children of every family, each member once."""
    f = tree.families
    part = lambda c: f.select("family_id", F.col(c).alias("member_id"))
    members = part("husband_id").unionByName(part("wife_id")).unionByName(tree.family_children.select("family_id", F.col("child_id").alias("member_id"))).where("member_id is not null").distinct()
    e = everyone(tree)
    return members.join(e, members.member_id == e.individual_id).drop("individual_id")


def merged(tree: Tree, ids: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """Several people's events within years; events without a year are kept."""
    a = ids_of(tree, ids)
    e = everyone(tree)
    out = a.join(e, a.asked == e.individual_id).drop("asked")
    if start is not None:
        out = out.where((F.col("year") >= start) | F.col("year").isNull())
    if end is not None:
        out = out.where((F.col("year") <= end) | F.col("year").isNull())
    return out.orderBy("sort_year", "sort_date", "n", "event_ord")
