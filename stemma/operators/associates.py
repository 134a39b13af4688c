"""Friends, associates, neighbours: people who share places and years with a person without being kin.

Scores are sums of whole thousandths, so they do not depend on the order in which they are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.functions.similarity import ratio_at_least
from stemma.operators import graph, places
from stemma.operators.lookup import ids_of
from stemma.plans.model import Tree


def events_with_places(tree: Tree) -> DataFrame:
    """(individual_id, kind, year, place_norm): birth, death and events that have a place; repeats count."""
    return tree.individual_place.select("individual_id", "kind", "year", "place_norm")


def find(tree: Tree, id_: str, place: str | None = None, start: int | None = None, end: int | None = None, exclude_relatives: bool = True, most: int | None = 50, fuzzy: bool = False, like: float = 75) -> DataFrame:
    """(id, name, strength, overlaps, shared_places, overlap_years, is_relative), strongest first.

    Each pair of events at one place scores 150 in the same year, 80 within five, 20 beyond, 30 if a year is missing; 50 for
    each further shared place; 6 for each shared year of life up to 50; at most 1000. ``fuzzy`` matches places by ratio
    or if one contains the other; so does ``place``, at a ratio of 80, which chooses the person's events.
    """
    me = ids_of(tree, [id_]).select("asked")
    ev = events_with_places(tree)
    mine = ev.join(me, F.col("individual_id") == F.col("asked"), "left_semi")
    if start is not None:
        mine = mine.where((F.col("year") >= start) | F.col("year").isNull())
    if end is not None:
        mine = mine.where((F.col("year") <= end) | F.col("year").isNull())
    if place:
        mine = mine.where(places.match(F.col("place_norm"), X.normalize_place(F.lit(place))))
    t = mine.select(F.col("place_norm").alias("t_place"), F.col("year").alias("t_year"))
    others = ev.join(me, F.col("individual_id") == F.col("asked"), "left_anti")
    if fuzzy:
        # distinct places only: the person's few against all, thinned by edit distance in the JVM
        known = others.select(F.col("place_norm").alias("c_place")).distinct()
        wanted = t.select("t_place").distinct()
        hold = F.col("t_place").contains(F.col("c_place")) | F.col("c_place").contains(F.col("t_place"))
        # the bound on lengths is a necessary condition of the ratio alone
        both = F.length("t_place") + F.length("c_place")
        near = (F.abs(F.length("t_place") - F.length("c_place")) <= F.lit(1 - like / 100) * both + F.lit(1e-9)) & ratio_at_least(F.col("t_place"), F.col("c_place"), like)
        match = known.crossJoin(F.broadcast(wanted))
        match = match.where(hold).unionByName(match.where(~hold & near)).select("t_place", "c_place")
        pairs = others.join(match, others.place_norm == match.c_place).join(t, "t_place")
    else:
        pairs = others.join(t, others.place_norm == t.t_place)
    gap = F.abs(F.col("year") - F.col("t_year"))
    points = F.when(gap.isNull(), 30).when(gap == 0, 150).when(gap <= 5, 80).otherwise(20)
    g = pairs.groupBy(F.col("individual_id").alias("c_id")).agg(F.sum(points).alias("points"), F.count("*").alias("overlaps"), F.count_distinct("t_place").alias("shared_places"))
    people = tree.individuals.select("id", "name", "ord", "birth_year", "death_year")
    own = people.join(me, F.col("id") == F.col("asked"), "left_semi").select(F.col("birth_year").alias("b0"), F.col("death_year").alias("d0"))
    j = g.join(people, g.c_id == F.col("id")).crossJoin(F.broadcast(own)).withColumn("overlap_years", X.lifespan_overlap(F.col("b0"), F.col("d0"), F.col("birth_year"), F.col("death_year")))
    total = F.col("points") + 50 * (F.col("shared_places") - 1) + 6 * F.least(F.lit(50), F.coalesce("overlap_years", F.lit(0)))
    j = j.withColumn("strength", F.least(F.lit(1000), total) / 1000)
    kin = graph.relatives(tree, id_).select(F.col("id").alias("r_id"))
    if exclude_relatives:
        j = j.join(kin, F.col("id") == F.col("r_id"), "left_anti").withColumn("is_relative", F.lit(False))
    else:
        j = j.join(kin, F.col("id") == F.col("r_id"), "left").withColumn("is_relative", F.col("r_id").isNotNull())
    out = j.select("id", "name", "strength", "overlaps", "shared_places", "overlap_years", "is_relative", "ord")
    return out if most is None else out.orderBy(F.desc("strength"), "ord").limit(min(200, most))


def overlapping_events(tree: Tree, id_: str, other: str, like: float = 75) -> DataFrame:
    """(target_event, target_year, target_place, candidate_event, candidate_year, candidate_place, overlap_type): the pairs of
    events of two people whose places match, one row a pair."""
    ev = tree.individual_place.select("individual_id", "kind", "year", "place", "place_norm")
    of = lambda i, n: ev.join(ids_of(tree, [i]).select("asked"), F.col("individual_id") == F.col("asked"), "left_semi").select(*[F.col(c).alias(f"{n}_{c}") for c in ("kind", "year", "place", "place_norm")])
    # two people's own events: a handful on each side
    j = of(id_, "t").crossJoin(F.broadcast(of(other, "c"))).where(places.match(F.col("t_place_norm"), F.col("c_place_norm"), like))
    gap = F.abs(F.col("t_year") - F.col("c_year"))
    kind = F.when(gap.isNull(), "same_place_unknown_year").when(gap == 0, "same_year").when(gap <= 5, "within_5_years").otherwise("same_place")
    return j.select(F.col("t_kind").alias("target_event"), F.col("t_year").alias("target_year"), F.col("t_place").alias("target_place"), F.col("c_kind").alias("candidate_event"), F.col("c_year").alias("candidate_year"), F.col("c_place").alias("candidate_place"), kind.alias("overlap_type"))


def lifespan_pairs(tree: Tree) -> DataFrame:
    """(family_id, overlap): shared years of the spouses of each family."""
    p = tree.individuals.select("id", "birth_year", "death_year")
    side = lambda n: p.select(F.col("id").alias(f"i{n}"), F.col("birth_year").alias(f"b{n}"), F.col("death_year").alias(f"d{n}"))
    f = tree.families.select("family_id", "husband_id", "wife_id")
    j = f.join(side(1), F.col("husband_id") == F.col("i1")).join(side(2), F.col("wife_id") == F.col("i2"))
    return j.select("family_id", X.lifespan_overlap(F.col("b1"), F.col("d1"), F.col("b2"), F.col("d2")).alias("overlap"))
