"""The tree's questions as methods that answer with plain Python values: rows are collected only here, at the edge."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import associates, graph, kinship, lookup, places, search, spatial, stats, timeline, vector
from stemma.plans.model import Tree
from stemma.plans.tables import lookup_id


def canonical(id_: str) -> str:
    return "@" + id_.strip("@") + "@"


class Genealogy:
    """Questions over one folder of tables. Lists come in the operators' documented order."""

    def __init__(self, spark: SparkSession, folder: str, home: str | None = None):
        self.tree, self._home = Tree(spark, folder), home

    def _rows(self, df: DataFrame) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _one(self, df: DataFrame) -> dict[str, Any] | None:
        rows = self._rows(df.limit(1))
        return rows[0] if rows else None

    def _mine(self, df: DataFrame, column: str, id_: str) -> DataFrame:
        return df.where(F.col(column) == lookup_id(F.lit(id_)))

    def get_home_person(self) -> dict | None:
        home = self._home or graph.home_person(self.tree).first()["id"]
        return self.get_individual(home) if home else None

    def get_statistics(self) -> dict:
        return {**self._one(stats.overview(self.tree)), "top_surnames": [(r["surname"], r["n"]) for r in stats.top_surnames(self.tree).collect()]}

    def get_individual(self, id_: str) -> dict | None:
        return self._one(lookup.individual(self.tree, id_))

    def get_individuals_batch(self, ids: list[str]) -> dict[str, dict | None]:
        return {r["asked"]: (r if r["name"] is not None else None) for r in self._rows(lookup.individuals_batch(self.tree, ids))}

    def get_family(self, id_: str) -> dict | None:
        family = self._one(self._mine(lookup.families(self.tree), "family_id", id_))
        if family:
            family["children"] = self._rows(self._mine(lookup.family_members(self.tree), "family_id", id_).orderBy("child_ord"))
        return family

    def get_parents(self, id_: str) -> dict[str, dict]:
        return {r["role"]: r for r in self._rows(self._mine(lookup.parents(self.tree), "child_id", id_))}

    def get_children(self, id_: str) -> list[dict]:
        return self._rows(self._mine(lookup.children(self.tree), "parent_id", id_).orderBy("fam_ord", "child_ord"))

    def get_spouses(self, id_: str) -> list[dict]:
        return self._rows(self._mine(lookup.spouses(self.tree), "person_id", id_).orderBy("fam_ord"))

    def get_siblings(self, id_: str) -> list[dict]:
        return self._rows(self._mine(lookup.siblings(self.tree), "person_id", id_).orderBy("child_ord"))

    def get_ancestors(self, id_: str, generations: int = 4, filter: str | None = None) -> Any:
        """A tree of dicts with father and mother, or with filter 'terminal' the list of ancestors without known parents."""
        if filter == "terminal":
            return self._rows(graph.terminal(self.tree, id_, generations).orderBy("generation", "path"))
        root = self.get_individual(id_)
        if root is None or generations < 0:
            return {}
        ways = sorted(self._rows(graph.paths_up(self.tree, id_, generations)), key=lambda r: r["generation"])
        names = {r["id"]: r for r in self._rows(self.tree.people(sorted({r["ancestor_id"] for r in ways}) or [id_]).select("id", "name", "birth_date", "death_date", "ord"))}
        at = {"": dict(root)}
        for r in ways:
            up, _, role = r["path"].rpartition("/")
            at[r["path"]] = at[up][role] = dict(names[r["ancestor_id"]])
        return at[""]

    def get_descendants(self, id_: str, generations: int = 4) -> dict:
        """A tree of dicts with children; a child met twice stands under each parent."""
        root = self.get_individual(id_)
        if root is None:
            return {}
        edges = self._rows(graph.descendants(self.tree, id_, generations))
        names = {r["id"]: r for r in self._rows(lookup.individuals_batch(self.tree, sorted({e["child_id"] for e in edges}) or [id_]).withColumnRenamed("asked", "id"))}
        below: dict[tuple[str, int], list[str]] = {}
        for e in edges:
            below.setdefault((e["parent_id"], e["generation"]), []).append(e["child_id"])

        def node(i: str, level: int) -> dict:
            kids = [node(c, level + 1) for c in sorted(below.get((i, level + 1), []))]
            return {**(root if i == canonical(id_) else names[i]), **({"children": kids} if kids else {})}

        return node(canonical(id_), 0)

    def search_individuals(self, name: str, max_results: int = 50) -> list[dict]:
        return self._rows(search.by_name(self.tree, name, max_results))

    def get_surname_group(self, surname: str, include_spouses: bool = False) -> dict:
        s = surname.lower()
        group = self._one(stats.surname_groups(self.tree).where(F.col("surname") == s)) or {"surname": s, "members": 0}
        group["people"] = self._rows(self.tree.individuals.where(F.col("surname_lc") == s).select(*search.SUMMARY).orderBy("ord"))
        group["places"] = self._rows(stats.surname_places(self.tree).where(F.col("surname") == s).orderBy("rank"))
        if include_spouses:
            group["spouses"] = self._rows(stats.surname_spouses(self.tree).where(F.col("surname") == s).orderBy("spouse_id"))
        return group

    def get_surname_origins(self, surname: str) -> dict | None:
        s = surname.lower()
        origin = self._one(stats.surname_origins(self.tree).where(F.col("surname") == s))
        if origin:
            rows = stats.surname_timeline(self.tree).where(F.col("surname") == s).groupBy("birth_place").agg(F.sort_array(F.collect_set("birth_year")).alias("years")).orderBy(F.col("years")[0], "birth_place")
            origin["timeline"] = {r["birth_place"]: r["years"] for r in rows.collect()}
        return origin

    def get_relationship(self, id1: str, id2: str, max_generations: int | None = 10) -> str | None:
        pair = self.tree.spark.createDataFrame([(canonical(id1), canonical(id2))], "id1 string, id2 string")
        return kinship.relate(self.tree, pair, max_generations).first()["relationship"]

    def get_relationship_detail(self, id1: str, id2: str, max_generations: int | None = 10) -> dict:
        """The relationship, and for cousins the nearest common ancestor."""
        pair = self.tree.spark.createDataFrame([(canonical(id1), canonical(id2))], "id1 string, id2 string")
        found = self._one(kinship.relate(self.tree, pair, max_generations))
        of = found.pop("common_ancestor")
        return found | ({"common_ancestor": {"id": of, "name": (self.get_individual(of) or {}).get("name")}} if of else {})

    def get_relationship_matrix(self, ids: list[str]) -> list[dict]:
        return self._rows(kinship.matrix(self.tree, ids))

    def detect_pedigree_collapse(self, id_: str, max_generations: int = 10) -> list[dict]:
        return self._rows(graph.pedigree_collapse(self.tree, id_, max_generations).orderBy(F.desc("occurrences"), "ancestor_id"))

    def find_common_ancestors(self, id1: str, id2: str, max_generations: int = 10) -> list[dict]:
        return self._rows(graph.common_ancestors(self.tree, id1, id2, max_generations))

    def traverse(self, id_: str, direction: str, depth: int = 1) -> list[dict]:
        reached = graph.traverse(self.tree, id_, direction, depth)
        return self._rows(self.tree.names.join(reached, "id").orderBy("level", "ord"))

    def get_events(self, id_: str) -> list[dict]:
        return self._rows(self._mine(lookup.events_flat(self.tree), "individual_id", id_).orderBy("event_ord"))

    def get_citations(self, id_: str) -> list[dict]:
        return self._rows(self._mine(lookup.citations_flat(self.tree), "individual_id", id_).orderBy("event_ord", "cite_ord"))

    def get_notes(self, id_: str) -> list[dict]:
        return self._rows(self._mine(lookup.notes_flat(self.tree), "individual_id", id_).orderBy("event_ord", "pos"))

    def get_biography(self, id_: str) -> dict | None:
        bio = self._one(self._mine(lookup.biographies(self.tree), "id", id_))
        if bio:
            bio |= {"events": self.get_events(id_), "citations": self.get_citations(id_), "notes": self._one(self._mine(self.tree.individuals.select("id", "notes"), "id", id_))["notes"]}
        return bio

    def search_by_birth(self, year: int | None = None, place: str | None = None, year_range: int = 5, max_results: int = 50) -> list[dict]:
        return self._rows(search.by_birth(self.tree, year, place, year_range, max_results))

    def search_by_place(self, place: str, max_results: int = 50) -> list[dict]:
        return self._rows(search.by_place(self.tree, place, max_results))

    def search_events(self, event_type: str | None = None, place: str | None = None, year: int | None = None, year_range: int = 5, max_results: int = 50) -> list[dict]:
        return self._rows(search.events(self.tree, event_type, place, year, year_range, max_results))

    def search_sources(self, query: str, max_results: int = 50) -> list[dict]:
        return self._rows(search.sources(self.tree, query, max_results))

    def search_narrative(self, query: str, max_results: int = 50) -> list[dict]:
        return self._rows(search.narrative(self.tree, query, max_results))

    def get_timeline(self, id_: str) -> list[dict]:
        return self._rows(timeline.person(self.tree, id_))

    def get_family_events(self, family_id: str) -> list[dict]:
        return self._rows(self._mine(timeline.families(self.tree), "family_id", family_id).orderBy("sort_year", "sort_date", "member_id", "event_ord"))

    def get_military_service(self) -> dict:
        return {"people": self._rows(stats.military_people(self.tree)), "by_century": {r["century"]: r["events"] for r in stats.military_centuries(self.tree).collect()}, "places": self._rows(stats.military_places(self.tree))}

    def get_place_cluster(self, place: str, max_results: int = 100) -> dict:
        return {
            "people": self._rows(places.people_by_place(self.tree, place, 70, max_results)), "variants": self._rows(places.variants(self.tree, place)),
            "events": {r["type"]: r["events"] for r in places.cluster(self.tree, place, max_results).collect()},
        }

    def search_nearby(self, location: str, radius: float = 50, event_types: list[str] | None = None, unit: str = "miles", max_results: int = 100, gazetteer: DataFrame | None = None, mode: str = "proximity") -> dict:
        """People near a place named in words, or with mode 'within' inside the box that the gazetteer has for it."""
        at = self._one(spatial.resolve_location(self.tree, location, gazetteer, box=mode == "within"))
        if at is None:
            return {"error": f"no coordinates for {location}"}
        sides = [at[c] for c in ("south", "north", "west", "east")]
        if mode == "within":
            if None in sides:
                return {"error": f"no box for {location}", "location": at}
            return {"location": at, "people": self.search_within(*sides, event_types, max_results), "coverage": self._one(stats.geo_coverage(self.tree))}
        warning = {"warning": f"{location} is a region: mode 'within' finds what lies inside it"} if at["is_region"] else {}
        return {"location": at, **warning, "people": self._rows(spatial.people_near(self.tree, at["lat"], at["lon"], radius, unit, event_types, max_results)), "coverage": self._one(stats.geo_coverage(self.tree))}

    def search_within(self, south: float, north: float, west: float, east: float, event_types: list[str] | None = None, max_results: int = 100) -> list[dict]:
        return self._rows(spatial.people_within(self.tree, south, north, west, east, event_types, max_results))

    def get_place(self, place_id: str) -> dict | None:
        return self._one(lookup.place(self.tree, place_id))

    def get_overlapping_events(self, id_: str, other: str) -> list[dict]:
        return self._rows(associates.overlapping_events(self.tree, id_, other))

    def semantic_search(self, vectors: DataFrame, query: list[float], max_results: int = 20, key: str = "vec_id") -> list[dict]:
        """The query comes as a vector: encoding text is the caller's model's part."""
        return self._rows(vector.top_k(vectors, query, max_results, key))

    def find_associates(self, id_: str, place: str | None = None, start_year: int | None = None, end_year: int | None = None, exclude_relatives: bool = True, max_results: int = 50) -> list[dict]:
        return self._rows(associates.find(self.tree, id_, place, start_year, end_year, exclude_relatives, max_results, fuzzy=True))
