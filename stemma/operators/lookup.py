"""Point lookups and navigation, set-based: what is asked for one person elsewhere is answered here for a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.plans.model import Tree
from stemma.plans.tables import lookup_id

FULL = ["id", "given_name", "surname", "name", "sex", "birth_date", "birth_place", "death_date", "death_place", "famc", "ord"]


def ids_of(tree: Tree, ids: list[str]) -> DataFrame:
    """Distinct canonical ids of a request, in its order."""
    rows = tree.spark.createDataFrame([(n, i) for n, i in enumerate(ids)], "n int, raw string")
    return rows.select(lookup_id(F.col("raw")).alias("asked"), "n").groupBy("asked").agg(F.min("n").alias("n"))


def individual(tree: Tree, id_: str) -> DataFrame:
    return tree.people([id_]).select(*FULL)


def individuals_batch(tree: Tree, ids: list[str]) -> DataFrame:
    """One row for each distinct asked id, null where there is no such person."""
    asked = ids_of(tree, ids)
    return asked.join(tree.people(ids), asked.asked == F.col("id"), "left").select("asked", "name", "birth_date", "death_date")


def families(tree: Tree) -> DataFrame:
    """(family_id, husband_name, wife_name, ...): names only of spouses who are in the tree."""
    n = tree.names
    h, w = n.select(F.col("id").alias("h_id"), F.col("name").alias("husband_name")), n.select(F.col("id").alias("w_id"), F.col("name").alias("wife_name"))
    f = tree.families
    return f.join(h, f.husband_id == h.h_id, "left").join(w, f.wife_id == w.w_id, "left").select("family_id", "husband_id", "husband_name", "wife_id", "wife_name", "marriage_date", "marriage_place")


def family_members(tree: Tree) -> DataFrame:
    """(family_id, child_ord, child_id, name): children in the family's order, unknown ones left out."""
    c = tree.family_children
    return c.join(tree.names, c.child_id == F.col("id")).select("family_id", "child_ord", "child_id", "name")


def parents(tree: Tree) -> DataFrame:
    """(child_id, role, parent_id, parent_name)."""
    e = tree.parent_edge
    return e.join(tree.names, e.parent_id == F.col("id")).select("child_id", "role", "parent_id", F.col("name").alias("parent_name"))


def children(tree: Tree) -> DataFrame:
    e = tree.child_edge
    return e.join(tree.names, e.child_id == F.col("id")).select("parent_id", "child_id", F.col("name").alias("child_name"), "fam_ord", "child_ord")


def spouses(tree: Tree) -> DataFrame:
    """(person_id, family_id, spouse_id, spouse_name, marriage_date, marriage_place): one row a family, not deduplicated."""
    f = tree.spouse_family.withColumn("spouse_id", F.when(F.col("husband_id") == F.col("person_id"), F.col("wife_id")).otherwise(F.col("husband_id")))
    return f.join(tree.names, f.spouse_id == F.col("id")).select("person_id", "family_id", "fam_ord", "spouse_id", F.col("name").alias("spouse_name"), "marriage_date", "marriage_place")


def siblings(tree: Tree) -> DataFrame:
    """(person_id, sibling_id, sibling_name): the other children the person's family of birth lists, full ones only."""
    p = tree.individuals.select(F.col("id").alias("person_id"), "famc")
    c = tree.family_children.groupBy("family_id", "child_id").agg(F.min("child_ord").alias("child_ord"))
    j = p.join(c, p.famc == c.family_id).where("child_id <> person_id")
    return j.join(tree.names, j.child_id == F.col("id")).select("person_id", F.col("child_id").alias("sibling_id"), F.col("name").alias("sibling_name"), "child_ord")


def sources(tree: Tree, most: int = 100) -> DataFrame:
    return tree.sources.orderBy("ord").limit(most).select("id", "title", "author", "ord")


def source_lines(tree: Tree, most: int = 1000) -> DataFrame:
    """The listing of sources as text."""
    title, author = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")), F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown author"))
    return tree.sources.orderBy("ord").limit(most).select("id", F.concat("id", F.lit(": "), title, F.lit(" by "), author).alias("line"))


def places(tree: Tree, most: int = 500) -> DataFrame:
    return tree.places.orderBy("ord").limit(most).select("id", "original", "latitude", "longitude", "ord")


def events_flat(tree: Tree, ids: list[str] | None = None) -> DataFrame:
    """Events in file order; with ids, one row with nulls for a person without events."""
    e = tree.events.select("individual_id", "event_ord", "type", "date", "place", "description")
    if ids is None:
        return e
    a = ids_of(tree, ids)
    return a.join(e, a.asked == e.individual_id, "left").select("asked", "event_ord", "type", "date", "place", "description")


def citations_flat(tree: Tree) -> DataFrame:
    """Citations with their event's type and date and their source's title (null if the source is unknown)."""
    c, e = tree.citations, tree.events.select("individual_id", "event_ord", F.col("type").alias("event_type"), F.col("date").alias("event_date"))
    s = tree.sources.select(F.col("id").alias("s_id"), F.col("title").alias("source_title"))
    return c.join(e, ["individual_id", "event_ord"]).join(s, c.source_id == s.s_id, "left").select("citation_id", "individual_id", "event_ord", "cite_ord", "event_type", "event_date", "source_id", "source_title", "page")


def notes_flat(tree: Tree) -> DataFrame:
    """(individual_id, event_ord, pos, event_type, note): the notes of events."""
    return tree.events.select("individual_id", "event_ord", F.col("type").alias("event_type"), F.posexplode("notes").alias("pos", "note"))


def _names_of(df: DataFrame, key: str, name: str, order: list[str], out: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(name).alias("_n"))))
    return df.groupBy(F.col(key).alias("b_id")).agg(F.array_join(F.transform(rows, lambda r: r["_n"]), "; ").alias(out))


def biographies(tree: Tree) -> DataFrame:
    """One row a person: vital summary and the names of parents, spouses and children, joined by '; '."""
    p = tree.individuals.select("id", "name", X.vital_summary(F.col("birth_date"), F.col("birth_place"), F.col("death_date"), F.col("death_place")).alias("vital_summary"))
    parts = [
        _names_of(parents(tree), "child_id", "parent_name", ["role", "parent_id"], "parents"),
        _names_of(spouses(tree), "person_id", "spouse_name", ["fam_ord", "family_id"], "spouses"),
        _names_of(children(tree), "parent_id", "child_name", ["fam_ord", "child_ord"], "children"),
    ]
    for part in parts:
        p = p.join(part, p.id == part.b_id, "left").drop("b_id")
    return p


def embedding_texts(tree: Tree) -> DataFrame:
    """(id, text): name, vitals, parents, marriages, events and notes in one line, as an encoder reads them."""
    b = biographies(tree)
    t = lambda words, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(words), c))
    ev = tree.events.select("individual_id", "event_ord", F.concat_ws(" ", "type", F.nullif("description", F.lit("")), F.nullif("date", F.lit("")), F.nullif("place", F.lit("")), F.nullif(F.array_join("notes", " "), F.lit(""))).alias("line"))
    lines = ev.groupBy(F.col("individual_id").alias("e_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_ord", "line"))), lambda r: r["line"]), " ").alias("events"))
    notes = tree.individuals.select(F.col("id").alias("n_id"), F.array_join("notes", " ").alias("person_notes"))
    j = b.join(lines, b.id == lines.e_id, "left").join(notes, b.id == notes.n_id, "left")
    text = F.concat_ws(" ", "name", F.nullif("vital_summary", F.lit("")), t("Parents: ", F.col("parents")), t("Spouses: ", F.col("spouses")), F.col("events"), F.nullif("person_notes", F.lit("")))
    return j.select("id", text.alias("text")).where(F.trim("text") != "")


def place(tree: Tree, place_id: str) -> DataFrame:
    """The place of that id, or no row."""
    return tree.places.where(F.col("id") == place_id).select("id", "original", "normalized", "components", "latitude", "longitude")
