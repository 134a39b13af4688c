import hashlib

import pytest
from pyspark.sql import functions as F

from stemma.operators import associates, graph, kinship, lookup, search, spatial, stats, timeline
from stemma.plans.model import Tree
from stemma.sources import caches
from stemma.sources.lineage_text import LineageText
from stemma.streaming import geocoding

TEXT = """0 HEAD
1 CHAR UTF-8
0 @S1@ SOUR
1 TITL Vital Records
1 AUTH Clerk
0 @R1@ REPO
1 NAME State Archive
0 @I1@ INDI
1 NAME Ada /PYE/
2 GIVN Adah
1 SEX F
1 BIRT
2 DATE 3 MAR 1900
2 PLAC Hill, Shire
2 SOUR @S1@
3 PAGE p. 9
3 DATA
4 TEXT first line
5 CONT second
5 CONC line
4 WWW http://x.example
1 BIRT
2 DATE 1901
1 EVEN
2 TYPE Fair
2 NOTE seen
1 FAMC @F9@
1 FAMC @F1@
1 FAMS @F2@
1 NOTE long
2 CONT text
0 @I2@ INDI
1 NAME Nobody
0 @F1@ FAM
1 HUSB @I2@
1 CHIL @I1@
1 CHIL @I7@
1 MARR
2 DATE 1899
0 TRLR
"""


@pytest.fixture(scope="module")
def text(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("text") / "a.txt"
    path.write_text(TEXT)
    return LineageText(spark, str(path))


def test_ingest(text):
    rows = {r.id: r for r in text.individuals().collect()}
    a, b = rows["@I1@"], rows["@I2@"]
    assert (a.given_name, a.surname, a.sex, a.birth_date, a.birth_place, a.family_as_child, a.families_as_spouse, a.notes) == ("Adah", "PYE", "F", "3 MAR 1900", "Hill, Shire", "@F1@", ["@F2@"], ["long\ntext"])
    assert (b.given_name, b.surname, b.birth_date) == ("Nobody", "", None)
    ev = text.events().orderBy("event_ord").collect()
    assert [(e.event_ord, e.type, e.date, e.description, e.notes) for e in ev] == [(0, "BIRT", "3 MAR 1900", None, []), (1, "BIRT", "1901", None, []), (2, "EVEN", None, "Fair", ["seen"])]
    c = text.citations().first()
    assert (c.event_ord, c.cite_ord, c.source_id, c.page, c.text, c.url) == (0, 0, "@S1@", "p. 9", "first line\nsecondline", "http://x.example")
    f = text.families().first()
    assert (f.husband_id, f.wife_id, f.children_ids, f.marriage_date) == ("@I2@", None, ["@I1@", "@I7@"], "1899")
    assert text.sources().first().title == "Vital Records" and text.repositories().first()["name"] == "State Archive"


# a family with an aunt, cousins, a half-sibling, a cycle and dangling pointers
PEOPLE = [
    ("g1", "Gus", "M", None, ["f0"]), ("g2", "Gwen", "F", None, ["f0"]), ("a", "Al", "M", "f0", ["f1", "f2"]), ("b", "Bea", "F", "f0", ["f3"]), ("w1", "Wyn", "F", None, ["f1"]), ("w2", "Wil", "F", None, ["f2"]),
    ("h", "Hal", "M", None, ["f3"]), ("c1", "Cy", "M", "f1", ["f4"]), ("c2", "Cat", "F", "f2", []), ("d", "Di", "F", "f3", []), ("e", "Ed", "M", "f4", []), ("x", "Xi", "M", "fx", ["fx"]), ("q", "Qi", "F", "gone", ["gone2"]),
]
FAMS = [("f0", "g1", "g2", ["a", "b"]), ("f1", "a", "w1", ["c1"]), ("f2", "a", "w2", ["c2", "nobody"]), ("f3", "h", "b", ["d"]), ("f4", "c1", None, ["e"]), ("fx", "x", None, ["x"])]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    p = [(i, n, "Lee", s, f"{1900 + k}", "Hill, Shire", None, None, f, fs, ["served in the army"] if i == "a" else [], k, k) for k, (i, n, s, f, fs) in enumerate(PEOPLE)]
    spark.createDataFrame(p, "id string, given_name string, surname string, sex string, birth_date string, birth_place string, death_date string, death_place string, family_as_child string, families_as_spouse array<string>, notes array<string>, loaded_at long, ord long").withColumn("loaded_at", F.timestamp_seconds("loaded_at")).write.parquet(f"{d}/individuals.parquet")
    f = [(i, h, w, c, "1920", "Hill, Shire", k, k) for k, (i, h, w, c) in enumerate(FAMS)]
    spark.createDataFrame(f, "id string, husband_id string, wife_id string, children_ids array<string>, marriage_date string, marriage_place string, loaded_at long, ord long").withColumn("loaded_at", F.timestamp_seconds("loaded_at")).write.parquet(f"{d}/families.parquet")
    e = [("a", 0, "OCCU", "1930", "Hill, Shire", None, ["Software Engineer"], 1, 1), ("a", 1, "RESI", None, "Dale", None, [], 1, 2), ("q", 0, "RESI", "1931", "Dale", None, [], 1, 3)]
    spark.createDataFrame(e, "individual_id string, event_ord int, type string, date string, place string, description string, notes array<string>, loaded_at long, ord long").withColumn("loaded_at", F.timestamp_seconds("loaded_at")).write.parquet(f"{d}/person_events.parquet")
    spark.createDataFrame([(1, "a", 0, 0, "s1", "p", "text", None, 1, 1)], "citation_id long, individual_id string, event_ord int, cite_ord int, source_id string, page string, text string, url string, loaded_at long, ord long").withColumn("loaded_at", F.timestamp_seconds("loaded_at")).write.parquet(f"{d}/citations.parquet")
    spark.createDataFrame([("@s1@", "Title", "Author", 0)], "id string, title string, author string, ord long").write.parquet(f"{d}/sources.parquet")
    spark.createDataFrame([(hashlib.md5(b"hill, shire").hexdigest()[:12], "Hill, Shire", "hill, shire", 10.0, 10.0, 0), (hashlib.md5(b"dale").hexdigest()[:12], "Dale", "dale", None, None, 1)], "id string, original string, normalized string, latitude double, longitude double, ord long").write.parquet(f"{d}/places.parquet")
    return Tree(spark, str(d))


def test_relationships(spark, tree):
    want = {
        ("a", "a"): "same person", ("c1", "a"): "child", ("a", "c1"): "parent", ("a", "w2"): "spouse", ("a", "b"): "sibling", ("c1", "c2"): "half-sibling", ("c1", "g1"): "grandchild", ("g1", "c1"): "grandparent",
        ("c1", "b"): "niece/nephew", ("b", "c1"): "aunt/uncle", ("c1", "d"): "first cousin", ("e", "d"): "first cousin once removed", ("e", "g1"): "great-grandparent", ("g1", "e"): "great-grandchild", ("w1", "h"): "not related (within 10 generations)", ("a", "nobody"): None,
    }
    asked = spark.createDataFrame([(f"@{a}@", f"@{b}@") for a, b in want], "id1 string, id2 string")
    got = {(r.id1.strip("@"), r.id2.strip("@")): r.relationship for r in kinship.relate(tree, asked).collect()}
    assert got == want
    assert kinship.matrix(tree, ["a", "b", "c1", "@a@"]).count() == 3


def test_graph_with_cycle_and_dangling_pointers(tree):
    up = {(r.relative_id, r.generation) for r in graph.closure(tree, 10, ["x"]).collect()}
    assert up == {("@x@", g) for g in range(1, 11)}
    assert graph.closure(tree, 3, ["q"]).count() == 0
    assert {(r.ancestor_id, r.path) for r in graph.terminal(tree, "c1").collect()} == {("@w1@", "mother"), ("@g1@", "father/father"), ("@g2@", "father/mother")}
    assert {(r.child_id, r.generation) for r in graph.descendants(tree, "g1", 3).collect()} == {("@a@", 1), ("@b@", 1), ("@c1@", 2), ("@c2@", 2), ("@d@", 2), ("@e@", 3)}
    assert {r.id for r in graph.traverse(tree, "a", "spouses").collect()} == {"@w1@", "@w2@"}
    assert graph.traverse(tree, "a", "sideways").count() == 0
    assert {r.id for r in graph.relatives(tree, "c1").collect()} >= {"@a@", "@w1@", "@g1@", "@e@", "@w2@"}
    assert graph.home_person(tree).first().id == "@a@"


def test_invariants(tree):
    s = {(r.person_id, r.sibling_id) for r in lookup.siblings(tree).collect()}
    assert all((b, a) in s and a != b for a, b in s if b != "@nobody@")
    o = stats.overview(tree).first()
    assert o.males + o.females + o.unknown == o.individuals == len(PEOPLE)
    assert lookup.individuals_batch(tree, ["a", "@a@", "zz"]).count() == 2
    assert search.by_name(tree, "a", 0).count() == 1
    assert timeline.merged(tree, ["a"], 1950, 1960).count() == 1
    assert [r.individual_id for r in search.military(tree).collect()] == ["@a@"]


def test_associates(tree):
    rows = {r.id: r for r in associates.find(tree, "a", most=None).collect()}
    assert set(rows) == {"@d@", "@h@", "@q@", "@x@", "@w1@", "@w2@"} - {r.id for r in graph.relatives(tree, "a").collect()}
    alike = associates.find(tree, "a", most=None, fuzzy=True, exclude_relatives=False).collect()
    assert {r.id for r in alike} >= set(rows) and any(r.is_relative for r in alike)


def test_associates_by_containment(spark, tmp_path):
    d, address = str(tmp_path), "71 Oxbow Street, Ingibridge, Bramanshire County, Kingdom of Ruland"
    at = [("a", "Ingibridge"), ("b", address), ("c", "Ingibrigde"), ("d", "Oxbow"), ("e", None)]
    p = [(i, i, "Lee", "F", "1900", place, None, None, None, [], [], k, k) for k, (i, place) in enumerate(at)]
    spark.createDataFrame(p, "id string, given_name string, surname string, sex string, birth_date string, birth_place string, death_date string, death_place string, family_as_child string, families_as_spouse array<string>, notes array<string>, loaded_at long, ord long").withColumn("loaded_at", F.timestamp_seconds("loaded_at")).write.parquet(f"{d}/individuals.parquet")
    spark.createDataFrame([], "id string, husband_id string, wife_id string, children_ids array<string>, marriage_date string, marriage_place string, loaded_at timestamp, ord long").write.parquet(f"{d}/families.parquet")
    spark.createDataFrame([], "individual_id string, event_ord int, type string, date string, place string, description string, notes array<string>, loaded_at timestamp, ord long").write.parquet(f"{d}/person_events.parquet")
    people = Tree(spark, d)
    found = lambda id_, place=None: {r.id for r in associates.find(people, id_, place, most=None, fuzzy=True, exclude_relatives=False).collect()}
    assert found("a") == {"@b@", "@c@"} and found("d") == {"@b@"} and found("b") == {"@a@", "@d@"}
    # the filter holds by ratio and by containment either way
    assert found("a", "Ingibridges") == found("a", "Ingibridge, Bramanshire") == {"@b@", "@c@"} and found("a", "Dale") == set()


def test_spatial_and_geocoding(spark, tree, tmp_path):
    gaz = spark.createDataFrame([("Dale", "Shire", 1.0, 2.0), ("Hilltown", "Shire", 3.0, 4.0)], "name string, country string, lat double, lon double")
    asked = spark.createDataFrame([("1", "Dale", None, None), ("2", "Hiltown, Shire", None, None), ("3", "at sea", 5.0, 6.0), ("4", "Own", 7.0, 8.0), ("5", "Zzz", None, None), ("6", None, None, None)], "id string, original string, latitude double, longitude double")
    got = {r.id: (r.lat, r.source, r.confidence) for r in spatial.geocode(asked, gaz).collect()}
    assert got == {"1": (1.0, "gazetteer", "high"), "2": (3.0, "gazetteer", "medium"), "3": (None, "ungeocodable", "low"), "4": (7.0, "own", "high"), "5": (None, "not_found", "low"), "6": (None, "ungeocodable", "low")}
    path = f"file://{tmp_path}/store"
    assert geocoding.progress(asked, path).first().status == "not_started"
    src = f"{tmp_path}/in"
    asked.write.parquet(src)
    for _ in range(2):
        geocoding.start(spark.readStream.schema(asked.schema).parquet(src), gaz, path, f"{tmp_path}/cp", available_now=True).awaitTermination()
    geocoding.geocode_new(asked, gaz, path)
    p = geocoding.progress(asked, path).first()
    assert (p.total, p.done, p.status) == (6, 6, "complete") and geocoding.stored(spark, path).count() == 6
    caches.write_geocache(spatial.geocode(asked, gaz), "h1", f"{tmp_path}/cache")
    assert caches.read_geocache(spark, "h1", f"{tmp_path}/cache").count() == 6 and caches.read_geocache(spark, "h2", f"{tmp_path}/cache").count() == 0
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert caches.file_hash(spark, str(tmp_path / "f.bin")).first().sha256.startswith("ba7816bf")


def test_geocode_first_letter_and_long_names(spark):
    long = "north " * 8 + "dale"
    gaz = spark.createDataFrame([("Pelbeby", "Shire", 1.0, 2.0), ("Bardaham", "", 3.0, 4.0), (long, "", 5.0, 6.0), ("Pelbeby", "Other", 7.0, 8.0)], "name string, country string, lat double, lon double")
    asked = spark.createDataFrame([("1", "(pelbeby, Shire", None, None), ("2", "ardaham", None, None), ("3", long + " by sea", None, None), ("4", "Peb", None, None)], "id string, original string, latitude double, longitude double")
    got = {r.id: (r.lat, r.source, r.confidence) for r in spatial.geocode(asked, gaz).collect()}
    assert got == {"1": (7.0, "gazetteer", "medium"), "2": (3.0, "gazetteer", "medium"), "3": (5.0, "gazetteer", "medium"), "4": (None, "not_found", "low")}
    checked = {r.id: (r.lat, r.source) for r in spatial.geocode(asked, gaz, check_country=True).collect()}
    assert checked["1"] == (1.0, "gazetteer") and checked["2"] == (None, "not_found")


def test_dangling_family_makes_no_siblings(spark, tmp_path):
    from datetime import datetime

    at = datetime(2020, 1, 1)
    people = [(i, "A", "Lee", None, None, "Saint Louis, Missouri" if i == "@x@" else None, None, None, f, [], [], at, n) for n, (i, f) in enumerate([("@x@", "@none@"), ("@y@", "@none@"), ("z", "@F1@"), ("@@w@@", "F1")])]
    spark.createDataFrame(people, "id string, given_name string, surname string, sex string, birth_date string, birth_place string, death_date string, death_place string, family_as_child string, families_as_spouse array<string>, notes array<string>, loaded_at timestamp, ord long").write.parquet(f"{tmp_path}/individuals.parquet")
    spark.createDataFrame([("@F1@", None, None, ["z", "w"], None, None, at, 1)], "id string, husband_id string, wife_id string, children_ids array<string>, marriage_date string, marriage_place string, loaded_at timestamp, ord long").write.parquet(f"{tmp_path}/families.parquet")
    spark.createDataFrame([], "individual_id string, event_ord int, type string, date string, place string, description string, notes array<string>, loaded_at timestamp, ord long").write.parquet(f"{tmp_path}/person_events.parquet")
    spark.createDataFrame([("p", "Saint Louis, Missouri", "saint louis, missouri", ["Saint Louis", "Missouri"], 1.0, 2.0, 1)], "id string, original string, normalized string, components array<string>, latitude double, longitude double, ord long").write.parquet(f"{tmp_path}/places.parquet")
    t = Tree(spark, str(tmp_path))
    pairs = spark.createDataFrame([("@x@", "@y@"), ("@z@", "@w@")], "id1 string, id2 string")
    assert {r.id1: r.relationship for r in kinship.relate(t, pairs).collect()} == {"@x@": "not related (within 10 generations)", "@z@": "sibling"}
    assert {r.id for r in t.people(["w", "@z", "nobody"]).collect()} == {"@w@", "@z@"}
    # a short form of a name is found in the normalised places that contain it
    from stemma.operators import places

    assert [(r.id, r.score) for r in places.people_by_place(t, "St. Louis", exact_only=True).collect()] == [("@x@", 95.0)]


def test_levels_as_lists_and_as_tables(tree, monkeypatch):
    def all_of():
        frames = graph.closure(tree, 5, ["c1", "d"]), graph.paths_up(tree, "c1", 6), *(graph.traverse(tree, "c1", d, 4) for d in ("parents", "spouses", "siblings", "children")), graph.traverse(tree, "g1", "children", 3)
        return [{tuple(str(v) for v in r) for r in f.select(*sorted(f.columns)).collect()} for f in frames]

    as_list = all_of()
    monkeypatch.setattr(graph, "FRONTIER", 0)
    assert as_list[0] and as_list[1] and as_list == all_of()


def test_location_by_likeness_and_box(spark, tree):
    from stemma.api import Genealogy

    g = Genealogy(spark, tree.folder)
    gaz = spark.createDataFrame([("Shire", 10.0, 10.0, -60.0, 80.0, -170.0, 170.0), ("Spot", 1.0, 1.0, 0.9, 1.1, 0.9, 1.1)], "name string, lat double, lon double, south double, north double, west double, east double")
    at = spatial.resolve_location(tree, "Hil, Shire").first()
    assert at.tier == 2 and at.confidence == "high" and at.is_region is False
    assert "warning" in g.search_nearby("Shire", gazetteer=gaz, mode="proximity") or g.search_nearby("Shire", gazetteer=gaz)["location"]["tier"] == 2
    inside = g.search_nearby("Shire", gazetteer=gaz, mode="within")
    assert inside["location"]["is_region"] and inside["people"] and "error" in g.search_nearby("Hill", mode="within")
    assert g.search_nearby("Spot", gazetteer=gaz, mode="within")["people"] == []
    assert g.get_relationship_detail("c1", "d")["common_ancestor"]["id"]


def test_api(spark, tree):
    from stemma.api import Genealogy
    from stemma.operators import places, vector

    g = Genealogy(spark, tree.folder)
    assert g.get_individual("a")["name"] == "Al Lee" and g.get_individual("zz") is None
    assert [c["child_id"] for c in g.get_family("f0")["children"]] == ["@a@", "@b@"]
    up = g.get_ancestors("c1", 3)
    assert up["father"]["mother"]["name"] == "Gwen Lee" and up["mother"]["name"] == "Wyn Lee" and "father" not in up["mother"]
    down = g.get_descendants("g1", 3)
    assert [c["name"] for c in down["children"]] == ["Al Lee", "Bea Lee"] and down["children"][0]["children"][0]["children"][0]["name"] == "Ed Lee"
    assert g.get_relationship("c1", "d") == "first cousin" and g.get_biography("a")["events"][0]["type"] == "OCCU"
    assert {k for k in g.get_parents("c1")} == {"father", "mother"} and g.get_surname_origins("LEE")["primary_origin"] == "Hill, Shire"
    assert g.search_nearby("Hill", 10)["people"][0]["distance"] == 0.0 and "error" in g.search_nearby("Nowhere")
    texts = spark.createDataFrame([("1", "abc"), ("2", " "), ("3", None)], "id string, text string")
    assert [r.embedding for r in vector.build(texts, lambda ts: [[3.0, 4.0] for _ in ts]).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)]]
    pair = spark.createDataFrame([("new york", "new yrok", True), ("york", "new york", True), ("paris", "new york", False)], "a string, b string, e boolean")
    assert pair.where(places.match(F.col("a"), F.col("b")) != F.col("e")).count() == 0
