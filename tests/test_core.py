import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.functions import similarity as S
from stemma.operators import hierarchy, nearby
from stemma.plans import tables as T


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_year(spark):
    cases = {"1 JAN 1900": 1900, "BET 1900 AND 1910": 1900, "(29 Nov. 1886)": 1886, "June": None, "12345": None, "": None, None: None, "ABT 0999": 999}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, y int")
    assert rows.where(~X.year(F.col("s")).eqNullSafe(F.col("y"))).count() == 0


def test_ids(spark):
    df = spark.createDataFrame([("@I1@", "@I1@"), ("I1", "@I1@"), ("@@I1", "@I1@"), ("@@", None), ("", None), (None, None)], "s string, e string")
    assert df.where(~T.pointer(F.col("s")).eqNullSafe(F.col("e"))).count() == 0
    assert one(spark, T.lookup_id(F.lit("@@"))) == "@@"


def test_places(spark):
    assert one(spark, X.normalize_place(F.lit("  St. Paul,  Ramsey Co., U.S.A. "))) == "saint paul, ramsey county, united states"
    assert one(spark, X.place_id(F.lit("Boston, Suffolk, Massachusetts, USA"))) == "6dcc8fb72477"
    assert one(spark, X.place_components(F.lit(" a ,, b,"))) == ["a", "b"]
    assert one(spark, X.ungeocodable(F.lit(" At Sea "))) is True


def test_names_of_lines(spark):
    assert [one(spark, X.ancestor_name(F.lit(g))) for g in (1, 2, 3, 4, 21)] == ["parent", "grandparent", "great-grandparent", "second great-grandparent", "19th great-grandparent"]
    assert one(spark, X.descendant_name(F.lit(2))) == "grandchild"


def test_overlap(spark):
    n = F.lit(None).cast("int")
    f = lambda *a: one(spark, X.lifespan_overlap(*[n if v is None else F.lit(v) for v in a]))
    assert f(1900, 1980, 1950, 2000) == 30 and f(1900, None, 1950, None) == 30 and f(None, None, 1900, 1950) is None and f(1800, 1850, 1900, 1950) == 0


def test_snippet(spark):
    text = "a" * 60 + "Needle" + "b" * 60
    assert one(spark, X.snippet(F.lit(text), "needle")) == "..." + "a" * 50 + "**Needle**" + "b" * 50 + "..."
    assert one(spark, X.snippet(F.lit("x" * 120), "needle")) == "x" * 100 + "..."


def test_similarity():
    assert S.lcs_ratio("abc", "abc") == 100 and S.lcs_ratio("", "") == 100 and S.lcs_ratio("abcd", "bcde") == 75
    assert S.metaphone("Thompson") == S.metaphone("Tomson") or S.metaphone("Knight") == S.metaphone("Night")
    assert S.weighted_ratio("new york city", "city new york") == 95


def test_weighted_ratio_by_published_examples():
    assert S.partial("this is a test", "this is a test!") == 100 and round(S.lcs_ratio("this is a test", "this is a test!")) == 97
    assert S.token_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100 and S.token_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    # by sets of words: the two that both have, against these with the shorter rest
    assert S.token_ratio("mariners vs angels", "angels mariners at home") == pytest.approx(max(S.lcs_ratio("angels mariners vs", "angels at home mariners"), 200 * 15 / (15 + 18)))
    assert S.partial_token_ratio("yankees", "new york yankees") == 100 and S.partial_token_ratio("abc", "xabcx") == 100
    assert S.weighted_ratio("boston massachusetts", "boston suffolk massachusetts usa") == pytest.approx(85.5)
    assert S.weighted_ratio("ab", "ab" + "x" * 20) == pytest.approx(60) and S.weighted_ratio("", "a") == 0
    assert S.partial("cde", "abc") == pytest.approx(50) == S.partial("abc", "cde")


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.choice((3, 4, 5, 7, 8, 10, 13, 20, 24, 26, 40, 60)))) for _ in range(120)]

    def changed(s, edits):
        for _ in range(edits):
            k = rng.randrange(len(s) + 1)
            s = s[:k] + s[k + 1 :] if rng.random() < 0.5 and len(s) > 2 else s[:k] + rng.choice("abcde ") + s[k:]
        return s

    others = [changed(s, rng.randint(0, 1 + len(s) // 3)) for s in names for _ in range(6)]
    others += ["(" * 7 + names[-1], names[0]]
    want = {(a, b) for a in set(names) for b in set(others) if a != b and S.lcs_ratio(a, b) >= 85}
    frames = [spark.createDataFrame([(v,) for v in sorted(set(x))], f"{c} string") for x, c in ((names, "a"), (others, "b"))]
    got = [(r.a, r.b) for r in S.near_pairs(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150
    assert any(a[0] != b[0] for a, b in want) and any(abs(len(a) - len(b)) > 6 for a, b in want)


def test_current_keeps_latest_with_extra_columns(spark):
    df = spark.sql("select * from values ('a', 1, 5, 'x'), ('a', 1, 6, 'y'), ('b', 2, 1, null), (null, 3, 2, 'z') as t(id, loaded_at, ord, _row)")
    got = {r.id: r["_row"] for r in T.current(df, "id").collect()}
    assert got == {"a": "y", "b": None, None: "z"}
    assert T.current(df.limit(0), "id").count() == 0


def brute(links):
    out = {}
    for i in links:
        seen, x = [], i
        while True:
            seen.append(x)
            p = links.get(x)
            p = p if p in links else None
            if p is None:
                out[i] = (x, len(seen) - 1)
                break
            if p in seen:
                out[i] = ("cycle", -1)
                break
            x = p
    return out


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    links = {f"n{k}": (f"n{rng.randrange(k)}" if k and rng.random() < 0.9 else None) for k in range(60)}
    links |= {f"c{k}": f"c{k + 1}" for k in range(50)} | {"c50": None}
    links |= {"x1": "x2", "x2": "x3", "x3": "x1", "y": "x1", "s": "s", "t": "gone"}
    df = spark.createDataFrame([*links.items(), (None, "n1"), ("n5", links["n5"])], "id string, parent string")
    assert {r.id: (r.root_id, r.depth) for r in hierarchy.resolve(df).collect()} == brute(links)
    assert hierarchy.resolve(df.limit(0)).count() == 0


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")], "id string, parent string")
    assert {r.id: r.path for r in hierarchy.paths(df).collect()} == {"a": "a", "b": "a > b", "c": "a > b > c", "d": "a > b > d", "x": "x", "y": "y"}
    assert {(r.ancestor_id, r.id, r.distance) for r in hierarchy.ancestry(df).where("distance > 0").collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_pairs_within(spark):
    rng = random.Random(1)
    rows = [(f"p{k:03}", 10 + rng.gauss(0, 0.03), 179.99 + rng.gauss(0, 0.03)) for k in range(120)]
    rows = [(i, a, o - 360 if o > 180 else o) for i, a, o in rows] + [(f"q{k}", 50.0, 5.0) for k in range(9)] + [("pole1", 89.999, 10.0), ("pole2", 89.999, -170.0)]
    bad = [("n", None, 1.0), ("z", 0.0, 0.0), ("o", 91.0, 5.0), ("v", 50.0, 181.0), (None, 50.0, 5.0)]
    df = spark.createDataFrame(rows + bad + rows[:3], "id string, latitude double, longitude double").withColumn("cell", F.lit(1))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and km(a[1:], b[1:]) <= 5}
    got = [(r.id_a, r.id_b) for r in nearby.pairs_within(df, 5.0, cell_points=20).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert nearby.pairs_within(df.limit(0), 5.0).count() == 0


def test_regions(spark):
    pt = lambda *p: [Row(lat=float(a), lon=float(b)) for a, b in p]
    regions = spark.createDataFrame([("box", pt((0, 0), (0, 10), (10, 10), (10, 0))), ("tri", pt((5, 5), (5, 15), (15, 5))), ("line", pt((0, 0), (1, 1))), (None, pt((0, 0), (0, 1), (1, 1)))], "region_id string, ring array<struct<lat: double, lon: double>>")
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 6.0, 6.0), ("c", 14.0, 5.5), ("d", 14.0, 14.0), ("e", 10.0, 3.0), ("f", None, 3.0)], "id string, latitude double, longitude double")
    assert {(r.id, r.region_id) for r in nearby.regions_of(points, regions).collect()} == {("a", "box"), ("b", "box"), ("b", "tri"), ("c", "tri")}
