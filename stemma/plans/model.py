"""A family tree as a set of DataFrames, derived once from the stored tables and shared by the operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.plans import tables as T
from stemma.plans.workspace import Workspace


class Tree:
    """Lazy: a table is planned when an operator first asks for it. Pointers are in the form @..@ everywhere."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._edges: dict[str, DataFrame] = {}

    def edges(self, name: str, rows: DataFrame) -> DataFrame:
        """rows(a, b), distinct, as a table written once for this tree."""
        if name not in self._edges:
            self._edges[name] = Workspace(self.spark, "edges").save(rows.distinct(), name)
        return self._edges[name]

    def people(self, ids: list[str]) -> DataFrame:
        """The individuals of the asked ids: the stored ids in their usual forms are asked of the scan, before the current rows are made."""
        bare = [i.strip("@") for i in ids]
        forms = sorted({a + i + b for i in bare for a in ("", "@") for b in ("", "@")})
        stored = F.col("id")
        rows = T.read(self.spark, self.folder, "individuals").where(stored.isin(forms) | stored.startswith("@@") | stored.endswith("@@"))
        return self._typed(T.current(rows, "id")).where(F.col("id").isin([f"@{i}@" for i in bare]))

    @cached_property
    def individuals(self) -> DataFrame:
        return self._typed(T.individuals(self.spark, self.folder))

    @staticmethod
    def _typed(p: DataFrame) -> DataFrame:
        given, surname = F.coalesce("given_name", F.lit("")), F.coalesce("surname", F.lit(""))
        return p.select(
            T.pointer(F.col("id")).alias("id"), given.alias("given_name"), surname.alias("surname"), X.full_name(given, surname).alias("name"), F.lower(surname).alias("surname_lc"), "sex",
            "birth_date", "birth_place", "death_date", "death_place", X.year(F.col("birth_date")).alias("birth_year"), X.year(F.col("death_date")).alias("death_year"),
            T.pointer(F.col("family_as_child")).alias("famc"), F.filter(F.transform("families_as_spouse", T.pointer), lambda x: x.isNotNull()).alias("fams"), "notes", "ord",
        )

    @cached_property
    def names(self) -> DataFrame:
        return self.individuals.select("id", "name", "birth_date", "death_date", "ord")

    @cached_property
    def families(self) -> DataFrame:
        f = T.families(self.spark, self.folder)
        return f.select(T.pointer(F.col("id")).alias("family_id"), T.pointer(F.col("husband_id")).alias("husband_id"), T.pointer(F.col("wife_id")).alias("wife_id"), F.transform("children_ids", T.pointer).alias("children_ids"), "marriage_date", "marriage_place", F.col("ord").alias("family_ord"))

    @cached_property
    def family_children(self) -> DataFrame:
        return self.families.select("family_id", F.posexplode("children_ids").alias("child_ord", "child_id")).where("child_id is not null")

    @cached_property
    def famc_parents(self) -> DataFrame:
        """(child_id, parent_id, role, family_id): the parents' ids as the family of birth names them, known or not."""
        j = self.individuals.select(F.col("id").alias("child_id"), "famc").join(self.families.select("family_id", "husband_id", "wife_id"), F.col("famc") == F.col("family_id"))
        both = F.explode(F.array(F.struct(F.lit("father").alias("role"), F.col("husband_id").alias("parent_id")), F.struct(F.lit("mother").alias("role"), F.col("wife_id").alias("parent_id"))))
        return j.select("child_id", "family_id", both.alias("p")).select("child_id", F.col("p.parent_id").alias("parent_id"), F.col("p.role").alias("role"), "family_id").where("parent_id is not null")

    @cached_property
    def parent_edge(self) -> DataFrame:
        """famc_parents whose parent is in the tree."""
        known = self.individuals.select(F.col("id").alias("k"))
        return self.famc_parents.join(known, F.col("parent_id") == F.col("k"), "left_semi")

    @cached_property
    def spouse_family(self) -> DataFrame:
        """(person_id, family_id, fam_ord, husband_id, wife_id, ...): the families a person points to as spouse."""
        links = self.individuals.select(F.col("id").alias("person_id"), F.posexplode("fams").alias("fam_ord", "fam"))
        return links.join(self.families, F.col("fam") == F.col("family_id")).drop("fam")

    @cached_property
    def child_edge(self) -> DataFrame:
        """(parent_id, child_id): children of all families a person points to as spouse, known ones, each once, in order."""
        kids = self.spouse_family.select(F.col("person_id").alias("parent_id"), "family_id", "fam_ord").join(self.family_children, "family_id")
        known = self.individuals.select(F.col("id").alias("k"))
        first = kids.groupBy("parent_id", "child_id").agg(F.min(F.struct("fam_ord", "child_ord")).alias("at"))
        return first.join(known, F.col("child_id") == F.col("k"), "left_semi").select("parent_id", "child_id", F.col("at.fam_ord").alias("fam_ord"), F.col("at.child_ord").alias("child_ord"))

    @cached_property
    def events(self) -> DataFrame:
        e = T.person_events(self.spark, self.folder)
        return e.select(T.pointer(F.col("individual_id")).alias("individual_id"), "event_ord", "type", "date", X.year(F.col("date")).alias("year"), "place", X.normalize_place(F.col("place")).alias("place_norm"), X.place_id(F.col("place")).alias("place_id"), "description", "notes")

    @cached_property
    def citations(self) -> DataFrame:
        c = T.citations(self.spark, self.folder)
        return c.select("citation_id", T.pointer(F.col("individual_id")).alias("individual_id"), "event_ord", "cite_ord", T.pointer(F.col("source_id")).alias("source_id"), "page", "text", "url")

    @cached_property
    def places(self) -> DataFrame:
        return T.read(self.spark, self.folder, "places")

    @cached_property
    def sources(self) -> DataFrame:
        return T.read(self.spark, self.folder, "sources")

    @cached_property
    def repositories(self) -> DataFrame:
        return T.read(self.spark, self.folder, "repositories")

    @cached_property
    def individual_place(self) -> DataFrame:
        """(individual_id, place, place_id, kind, year): every place of a person, repeats kept: birth, death, events."""
        p = self.individuals
        vital = lambda kind, place, y: p.select(F.col("id").alias("individual_id"), F.col(place).alias("place"), F.lit(kind).alias("kind"), F.col(y).alias("year"))
        ev = self.events.select("individual_id", "place", F.col("type").alias("kind"), "year")
        rows = T.union_all([vital("BIRT", "birth_place", "birth_year"), vital("DEAT", "death_place", "death_year"), ev]).where("place is not null and place <> ''")
        return rows.select("individual_id", "place", X.place_id(F.col("place")).alias("place_id"), X.normalize_place(F.col("place")).alias("place_norm"), "kind", "year")
