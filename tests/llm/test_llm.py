import base64
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemma.llm import addresses, names, overlap, packing, personal, tokens, vectors

# --- vectors ---------------------------------------------------------------------------------------------------------


def expected_pairs(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for n in range(len(ids)):
        c = np.round(x @ x[n], 9)
        c[n] = -9
        for m in np.lexsort((ids, -c))[: min(k, len(ids) - 1)]:
            out.add((min(ids[n], ids[m]), max(ids[n], ids[m])))
    return out


def test_similar_with_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(150)]
    rows += [(500 + k, [2.0 * v for v in rows[0][1]]) for k in range(25)] + [(700, rows[1][1]), (701, rows[1][1])]
    bad = [(900, None), (901, [0.0] * 16), (902, [1.0] * 15), (903, [1.0] * 15 + [None]), (904, [float("nan")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x"))
    got = {(r.vec_a, r.vec_b) for r in vectors.similar_pairs(df, k=10, dim=16, margin=9.0, probes=99).collect()}
    want = expected_pairs([(i, np.float32(v)) for i, v in rows], 10)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    copies = [500 + k for k in range(25)]
    assert {(a, b) for a, b in got if a in copies and b in copies} == {(a, b) for a, b in want if a in copies and b in copies}
    assert vectors.similar_pairs(df.limit(0), dim=16).count() == 0
    assert vectors.similar_pairs(df.where("vec_id = 1"), dim=16).count() == 0


def test_vectors_alone_in_their_list_find_k_others(spark):
    rng = np.random.default_rng(9)
    crowd = np.eye(32)[0] + 0.02 * rng.standard_normal((150, 32))
    alone = rng.standard_normal((50, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([crowd, alone]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.similar(df, k=10, dim=32, list_rows=4, cell_rows=40, probes=2).groupBy("id").count().collect()
    assert len(got) == 200 and {r["count"] for r in got} == {10}
    few = vectors.similar(df.where("vec_id >= 193"), k=10, dim=32, list_rows=1, cell_rows=2, probes=2).groupBy("id").count().collect()
    assert len(few) == 7 and {r["count"] for r in few} == {6}


def test_scan_abandons_without_losing_neighbours():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 64))
    x = np.repeat(centres, 30, 0) + 0.35 * rng.standard_normal((1800, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) @ vectors.rotation(64)
    lists = vectors.kmeans(x, 12)
    probes = vectors.nearest(x, lists, 4)
    best = vectors.scan(x, probes[:, 0], x, probes, 10, np.arange(len(x)), blocks=(16, 32))
    s = x @ x.T
    np.fill_diagonal(s, -9)
    top = np.argpartition(-s, 10, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(top, best.i)]) >= 0.95


def test_lists_of_two_levels(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16))
    rows = [(k, (centres[k % 12] + 0.3 * rng.standard_normal(16)).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_a, r.vec_b) for r in vectors.similar_pairs(df, k=5, dim=16, list_rows=6, sample_rows=200, cell_rows=100, probes=30).collect()}
    want = expected_pairs([(i, np.float32(v)) for i, v in rows], 5)
    assert len(got & want) >= 0.95 * len(want)
    # a nearest list of one level is found in two where its coarse list is looked into
    c = vectors.Lists(rng.standard_normal((40, 16)).astype(np.float32), rng.standard_normal((3, 16)).astype(np.float32), [np.arange(0, 20), np.arange(20, 40), np.arange(0)])
    x = rng.standard_normal((50, 16)).astype(np.float32)
    assert (c.nearest(x, 4) == vectors.nearest(x, c.centres, 4)).all()


# --- overlap ---------------------------------------------------------------------------------------------------------


def test_overlap_of_common_words_alone(spark):
    # a and b share sixteen words; the four others of each are more frequent, so they stand last in the order
    shared, own = [f"s{k}" for k in range(16)], {"a": [f"x{k}" for k in range(4)], "b": [f"y{k}" for k in range(4)]}
    rows = [(r, " ".join(shared + own[r])) for r in "ab"]
    rows += [(f"{r}{n}", " ".join([f"u{r}{n}{k}" for k in range(16)] + own[r])) for r in "ab" for n in range(4)]
    df = spark.createDataFrame(rows, "record string, text string")
    assert [tuple(r) for r in overlap.overlapping(df, block_texts=1e-30).collect()] == [("a", "b")]


def brute_overlap(rows):
    w = {r: Counter(x.lower() for x in re.findall("[A-Za-z0-9]+", t)) for r, t in rows if t is not None}
    w = {r: c for r, c in w.items() if sum(c.values()) >= 20}
    out = set()
    for a in w:
        for b in w:
            if a < b and sum((w[a] & w[b]).values()) >= 0.8 * max(sum(w[a].values()), sum(w[b].values())) - 1e-9:
                out.add((a, b))
    return out


@pytest.mark.parametrize("block,hot", [(2.0, 60_000), (2000.0, 60_000), (2000.0, 7)])
def test_overlap_against_brute_force(spark, block, hot):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        base = [rng.choice(vocabulary[: 40 if k % 2 else 300]) for _ in range(rng.randint(18, 60))]
        rows.append((f"r{k}", " ".join(base)))
        for j in range(3):
            edited = list(base)
            for _ in range(rng.randint(0, len(base) // 4)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rng.shuffle(edited)
            rows.append((f"r{k}e{j}", ("; " if j else " ").join(edited).upper()))
    rows += [("n", None), ("e", ""), ("s", "short text"), ("long", "the " * 6000), ("long2", "the " * 5000), ("twin", rows[0][1]), ("k", "K " + rows[0][1])]
    df = spark.createDataFrame(rows + rows[:2], "record string, text string").withColumn("no", F.lit(1))
    got = [(r.record_a, r.record_b) for r in overlap.overlapping(df, block_texts=block, hot=hot, chunk=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_overlap(rows)
    assert overlap.overlapping(df.limit(0)).count() == 0


def test_whole_runs():
    rng = np.random.default_rng(1)
    key = np.sort(np.concatenate([rng.integers(0, 60, 300), np.full(90, 17), np.full(50, 60)]))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 23]), pa.array(np.arange(a, min(len(key), a + 23)))], names=["k", "n"]) for a in range(0, len(key), 23)]
    for hot, rows in ((20, 40), (20, 1000), (5, 30), (1000, 50)):
        seen, sets = [], []
        for alone, (k, n) in overlap.whole_runs(iter(batches), ("k", "n"), hot, rows):
            seen += n.tolist()
            if not alone:
                sets += [set(k.tolist())]
                assert np.unique(k, return_counts=True)[1].max() <= hot
            else:
                assert all((key == x).sum() > hot for x in set(k.tolist()))
        assert sorted(seen) == list(range(len(key)))
        assert sum(map(len, sets)) == len(set().union(*sets)) if sets else True


# --- addresses -------------------------------------------------------------------------------------------------------

PLACES = [
    ("a1", "12 Mill Street, Oldham, Kent County, Westria, Kingdom of Sarn", 10.001, 20.001), ("a2", "12 Mill St., Oldham, Co. Kent, Sarn", None, None), ("a3", "Sarn; Westria; Kent County; Oldham; Mill Street No. 12", 10.002, 20.0),
    ("a4", "12 MLIL STREET, OLDHAM, KENT COUNTY", None, None), ("b1", "14 Mill Street, Oldham, Kent County, Westria, Kingdom of Sarn", 10.001, 20.002), ("c1", "12 Mill Lane, Oldham, Kent County, Westria, Kingdom of Sarn", 10.0, 20.0),
    ("t1", "Oldham, Kent County, Westria, Kingdom of Sarn", 10.0, 20.0), ("t2", "(oldham, kent cnty, westria)", None, None), ("u1", "Oldham, Dorset County, Westria, Kingdom of Sarn", 30.0, 40.0),
    ("s1", "Saint Alban's Chapel, Oldham, Kent County, Westria, Kingdom of Sarn", 10.0, 20.0), ("s2", "Chapel of St. Alban, Oldham, Kent County", None, None), ("s3", "Saint Alban's Farm, Oldham, Kent County, Westria, Kingdom of Sarn", 10.0, 20.0), ("n", None, None, None), ("e", "", 0.0, 0.0),
]


def test_addresses(spark):
    df = spark.createDataFrame(PLACES, "id string, original string, latitude double, longitude double").withColumn("form", F.lit(0))
    filler = [(f"f{k}", f"{k} Elm Road, Town{chr(97 + k % 26)}ville, {c} County, Westria, Kingdom of Sarn", None, None) for k in range(60) for c in ("Kent", "Dorset", "Surrey", "Essex", "Devon", "Norfolk")[k % 6 : k % 6 + 1]]
    df = df.unionByName(spark.createDataFrame(filler, "id string, original string, latitude double, longitude double").withColumn("form", F.lit(0)))
    got = {(r.id_a, r.id_b) for r in addresses.same_location_pairs(df).where("id_a not like 'f%'").collect()}
    groups = [["a1", "a2", "a3", "a4"], ["t1", "t2"], ["s1", "s2"]]
    assert got == {(x, y) for g in groups for x in g for y in g if x < y}
    assert addresses.same_location_pairs(df.limit(0)).count() == 0


def test_a_window_goes_on_where_matches_do(spark):
    # forty spellings of one house stand side by side in every pass; a window of four alone would part the first from the last
    rows = [(f"x{k:02}", f"12 Mill Street, Oldham, Kent{chr(97 + k % 26)}{chr(97 + k // 26)} County, Westria, Kingdom of Sarn", None, None) for k in range(40)]
    table = pa.table({"form": [str(k) for k in range(60)], "key": ["0|a"] * 60, "kind": ["house"] * 60, "number": ["12"] * 50 + ["13"] * 10, "type": ["street", ""] * 30, "lat": [10.0] * 30 + [None] * 30, "lon": [10.0] * 10 + [20.0] * 20 + [None] * 30})
    near = addresses.possible(table, 5)
    for n in (0, 9, 12, 48):
        want = [m for m in range(n + 1, 60) if table["number"][m] == table["number"][n] and not (n < 10 and 10 <= m < 30)]
        assert list(near(n, n + 1, n + 6)) == [m for m in want if m < n + 6]
        assert near(n, n + 6, 60) == [m for m in want if m >= n + 6]
    filler = [(f"f{k}", f"{k} Elm Road, Town{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}ville, {c} County, Westria, Kingdom of Sarn", None, None) for k in range(4000) for c in ("Surrey", "Dorset", "Sussex", "Norfolk", "Devonish", "Cornwall")[k % 6 : k % 6 + 1]]
    df = spark.createDataFrame(rows + filler, "id string, original string, latitude double, longitude double")
    assert addresses.same_location_pairs(df, window=4).where("id_a like 'x%'").count() == 40 * 39 // 2


def test_repeated_rows_part_no_location(spark):
    # a misspelt town and street of one row each are as rare beside the right ones however often all rows are repeated
    rows = [(f"x{k}", f"{k} Mill Street, Wendlebrook, Kent County, Westria, Kingdom of Sarn", None, None) for k in range(12)]
    rows += [("y1", "1 Mill Street, Wendlebrok, Kent County, Westria", None, None), ("y2", "2 Miill Street, Wendlebrook, Kent County, Westria", None, None)]
    rows += [(f"f{k}", f"{k} Elm Road, Town{chr(97 + k % 26)}ville, {c} County, Westria, Kingdom of Sarn", None, None) for k in range(60) for c in ("Surrey", "Dorset", "Sussex", "Norfolk", "Devonish", "Cornwall")[k % 6 : k % 6 + 1]]
    df = spark.createDataFrame(rows, "id string, original string, latitude double, longitude double")
    for copies in (1, 40):
        many = df.crossJoin(spark.range(copies).select(F.col("id").alias("copy"))).withColumn("id", F.concat_ws("-", "id", "copy"))
        found = addresses.locations(many).where("id like 'x%' or id like 'y%'").withColumn("base", F.substring_index("id", "-", 1)).groupBy("location").agg(F.collect_set("base").alias("ids"), F.count("*").alias("n")).collect()
        groups = {tuple(sorted(r["ids"])): r["n"] for r in found}
        assert groups == {("x1", "y1"): 2 * copies, ("x2", "y2"): 2 * copies, **{(f"x{k}",): copies for k in range(12) if k not in (1, 2)}}


def test_windows_reach_over_short_runs():
    assert addresses.seen_before({0: 9000, 1: 9000}, 240) == [(1, 0, 240)]
    assert addresses.seen_before({0: 5, 2: 100, 3: 200, 5: 9}, 240) == [(2, 0, 240), (3, 2, 240), (3, 0, 140), (5, 3, 240), (5, 2, 40)]


def test_a_typo_stays_within_a_window_however_many_towns():
    rng = random.Random(7)
    heads, tails = [a + b + c for a in "bdfghklmnprstw" for b in "aeiou" for c in "lnrst"], ["combe", "minster", "thorpe", "stead", "hurst", "bridge", "worth", "field"]
    towns = sorted({rng.choice(heads) + rng.choice(heads) + rng.choice(tails) for _ in range(20_000)})
    reading = lambda town, kind, name, type: {"kind": kind, "number": "", "name": name, "type": type, "town": town, "county": "kent", "regions": ""}
    for kind, name, type in (("town", "", ""), ("site", "saint alban", "chapel")):
        typos = [(t, t[:k] + rng.choice("bcdfgjkmpqvwxz") + t[k + 1 :]) for t in rng.sample(towns, 300) for k in [rng.randrange(1, len(t) - 1)]]
        near = set()
        for of_pass in zip(*(addresses.keys(reading(t, kind, name, type)) for t in towns + [w for _, w in typos])):
            order = sorted((k, n) for n, k in enumerate(of_pass))
            at = {n: place for place, (_, n) in enumerate(order)}
            where = {t: at[n] for n, t in enumerate(towns)}
            near |= {n for n, (t, _) in enumerate(typos) if abs(where[t] - at[len(towns) + n]) <= addresses.WINDOW}
        assert len(near) >= 0.99 * len(typos)


def test_a_misspelt_county_before_its_town():
    reader = addresses.Reader(["quenlenmark", "kent"], ["westria"])
    for text in ("Westria, Quenlenmaek, Bramibridge, 18 Larch Avenue", "18 Larch Avenue, Bramibridge, Quenlenmaek, Westria", "Westria, Quenlenmark, Bramibridge, 18 Larch Avenue"):
        assert reader.read(text)[4:6] == ("bramibridge", "quenlenmark")


def test_edits():
    assert addresses.edits("street", "stereet", 2) == 1 and addresses.edits("ab", "ba", 2) == 1 and addresses.edits("kitten", "sitting", 2) == 3


# --- names -----------------------------------------------------------------------------------------------------------


def test_names(spark):
    p = [
        ("1", "William James", "Ockfield", 1850, "L1", "M", None), ("2", "Wm. J.", "Ockfeild", 1850, "L1", "M", None), ("3", "OCKFIELD", "Bill", 1850, "L1", None, None), ("4", "Ockfield, William", "", 1850, "L1", "M", None),
        ("5", "Walter", "Ockfield", 1850, "L1", "M", None), ("6", "William", "Ockfield", 1851, "L1", "M", None), ("7", "William", "Ockfield", 1850, "L2", "M", None), ("8", "William", "Ockfield", 1850, "L1", "F", None),
        ("9", "Mary Ann", "Pell", 1870, "L3", "F", ["Dorling"]), ("10", "Mary", "Dorling née Pell", 1870, "L3", "F", None), ("11", "Mary", "Dorling", 1870, "L3", "F", None), ("12", "", "", 1870, "L3", "F", None), ("13", None, None, 1870, "L3", None, None),
    ]
    df = spark.createDataFrame(p + p[:1] + [(None, "William", "Ockfield", 1850, "L1", "M", None), ("14", "Mary", "Pell", None, "L3", "F", None)], "id string, given string, surname string, year int, location string, sex string, others array<string>").withColumn("key", F.lit(1))
    forms = spark.createDataFrame([("William", "Bill"), (None, "X")], "formal string, short_form string")
    for crowd in (2000, 2):
        got = [(r.id_a, r.id_b) for r in names.same_person_pairs(df, forms, crowd=crowd, cell=2).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {("1", "2"), ("1", "3"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4"), ("3", "8"), ("10", "9"), ("10", "11"), ("11", "9")}
    assert names.same_person_pairs(df.limit(0), forms).count() == 0


def test_names_of_a_crowd_as_of_small_groups(spark):
    rng = random.Random(4)
    given, family = ["William James", "Wm. J.", "Bill", "Mary", "Polly", "Walter", "M.", "James", "Jas. William"], ["Ockfield", "Ockfeild", "Ockfields", "Pell", "Pelle", "Oakfield"]
    rows = [(str(k), rng.choice(given), rng.choice(family), 1850, "L1", rng.choice(["M", "F", None]), None) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, given string, surname string, year int, location string, sex string, others array<string>")
    forms = spark.createDataFrame([("William", "Bill")], "formal string, short_form string")
    together, apart = ({(r.id_a, r.id_b) for r in names.same_person_pairs(df, forms, crowd=c, cell=7).collect()} for c in (2000, 5))
    assert together == apart and len(together) > 100


def test_score_is_symmetric():
    forms = names.Forms([])
    a, b = names.readings("P Caroline", "Wynttabeck"), names.readings("Phoebe Caroline", "Wyntabeck")
    assert names.score(a, b, forms) == names.score(b, a, forms) > 0.73


def test_stars_of_a_chain():
    # the links of b and c are most; d is in no star until it makes its own
    chain = {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0, (3, 4): 1.0, (1, 5): 1.0}
    assert names.star_cover(chain, lambda n: n) == {(0, 1), (0, 2), (0, 5), (1, 2), (1, 5), (2, 5), (2, 3), (2, 4), (3, 4)}


def test_curve():
    rows, bands = names.tuned(0.34, 0.995)
    assert 1 - (1 - 0.34**rows) ** bands >= 0.995 > 1 - (1 - 0.34**rows) ** (bands - 1)


# --- tokens and packing ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    if not os.path.exists(tokens.BYTE_BPE_50K):
        pytest.skip("no vocabulary here")
    with open(tokens.BYTE_BPE_50K, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens(spark, reference):
    rng = random.Random(9)
    texts = [None, "", " ", " ​", "Hello  world's\n\n end", "漢字 🌳 naïve " * 30, "a" * 30_000, "<|endoftext|>"] + ["".join(rng.choice("abcdefgh tuioesr  \n'.,0123é漢🌳") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    assert got == {k: reference.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    items = [(k, rng.choice([1, 3, 40, 90, 130, 600, 1100, 2600]), rng.choice(["a", "b", None])) for k in range(3000)] + [(9001, 0, "a"), (9002, None, "a"), (7, 40, "a")]
    df = spark.createDataFrame(items, "item long, size int, group string").withColumn("k", F.lit(0))
    limits = spark.createDataFrame([(1, 512), (2, 2048), (3, 0), (4, None)], "limit_id long, capacity int")
    rows = packing.pack(df, limits, block_items=500).collect()
    used, parts = Counter(), Counter()
    for r in rows:
        used[r.limit_id, r.group, r.container, r.capacity] += r.size
        parts[r.limit_id, r.item] += r.size
        assert r.size == r.capacity or r.part == 0 or r.size <= r.capacity
    assert all(u <= key[3] for key, u in used.items())
    total = Counter()
    for i, s, _ in items:
        if s:
            total[i] += s
    assert all(parts[lim, i] == s for lim in (1, 2) for i, s in total.items()) and set(i for _, i in parts) == set(total)
    assert all(r.part == 0 for r in rows if total[r.item] <= r.capacity)
    assert packing.pack(df.limit(0), limits).count() == 0
    told = packing.pack(df, limits, told=True)
    assert told.where("by_class").count() > 0.9 * told.count()


def test_containers_are_full_whatever_the_sizes():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 512, 8192):
        size = np.minimum(capacity, rng.lognormal(5, 1.2, 20_000).astype(np.int64) + 1)
        nth, _ = packing.containers(size, capacity)
        used = np.bincount(nth, size)
        assert used.max() <= capacity and used.min() > 0 and used.sum() >= 0.97 * min(len(used) * capacity, used.sum() + capacity)
    assert len(np.unique(packing.containers(np.array([5]), 5)[0])) == 1


# --- personal information --------------------------------------------------------------------------------------------


def test_personal(spark):
    given, sur = ["Mary", "John", "Ada", "Silas", "Ruth", "Hugo"], ["Ockfell", "Pellow", "Wyngard", "Zelmott", "Kelcroft"]
    people = spark.createDataFrame([(g, s) for g in given for s in sur], "given_name string, surname string")
    places = spark.createDataFrame([("Oldham, Kent County",)] * 5, "original string")
    forms = spark.createDataFrame([("Margaret", "Maggie")], "formal string, short_form string")
    train = [(k, f"Dear {rng.choice(given)} {rng.choice(sur)}, the firm of {rng.choice(sur)} & Sons moved. {rng.choice(sur)} Hall was sold. The brig {rng.choice(given)} of Oldham sailed. We think {rng.choice(sur)}, {rng.choice(given)} kept it; tel (311) 555-01{k % 90 + 10}. Film 1 938 {k % 900 + 100}. Passport 666-27-{2000 + k} was issued to Mrs. {rng.choice(sur)}. She lives at {k % 90 + 1} Mill Road, Oldham.") for rng in [random.Random(1)] for k in range(150)]
    text = "Dear Ruth A. Pellow, write to ada.pellow [at] mail [dot] example or +44 7700 900 123. ID QZ 75 07 46 A; film 1 938 362. Kelcroft Hall and the firm of Wyngard & Sons; the brig Hugo of Oldham. ZELMOTT Silas, Flat 3, 12 Bridge La., Oldham. John's map; see https://x.example/a@b. I live at P.O. Box 9."
    df = spark.createDataFrame([*train, (1000, text), (1001, None), (1002, ""), (1003, text)], "doc_id long, text string").withColumn("kind", F.lit(1))
    found_by = personal.finder(df, people, forms, places)
    got = {(r.kind, r.surface) for r in personal.find_items(df, found_by).where("doc_id = 1000").collect()}
    assert got == {
        ("name", "Ruth A. Pellow"), ("email", "ada.pellow [at] mail [dot] example"), ("phone", "+44 7700 900 123"), ("id_number", "QZ 75 07 46 A"), ("name", "ZELMOTT Silas"), ("street_address", "Flat 3, 12 Bridge La."), ("name", "John"), ("street_address", "P.O. Box 9"),
    }
    out = {r.doc_id: r.text for r in personal.redact(df, found_by).collect()}
    assert out[1001] is None and out[1002] == "" and out[1000].startswith("Dear [NAME], write to [EMAIL] or [PHONE]. ID [ID_NUMBER]; film 1 938 362. Kelcroft Hall")
    assert personal.find_items(df.limit(0), found_by).count() == 0


def test_planted_labels_are_known_by_construction():
    lists = personal.Lists(np.zeros((4, personal.BUCKETS), np.uint8))
    for w, kind in (("john", 0), ("mary", 0), ("tomkin", 1), ("barlow", 1), ("west", 1)):
        lists.tables[kind, personal.bucket(w)] = 9
    text = "Dear Mr. Tomkin, John Barlow came. Ring tel. (555) 555-1234. The card number is 123-45-6789. Then Mary Barlow left. "
    rows = [r for n in range(60) for r in personal.planted(text, personal.propose(text, lists), lists, [("John", "West"), ("Mary", "Tomkin")], ["Oldham"], np.random.default_rng(n))]
    assert {(y, k) for _, y, k in rows} >= {(1, 1), (1, 2), (1, 4), (0, 4)}
    found_by = personal.train([text] * 60, lists, [("John", "West"), ("Mary", "Tomkin")], ["Oldham"], report=(report := {}))
    assert set(report) >= {"name", "phone"} and all(0.1 <= v[3] < 1 for v in report.values()) and found_by.least[4] == report["name"][3]


def test_every_form_of_a_street_is_proposed():
    french = [f"{n}{w} de la Paix" for w in ("rue", "avenue", "quai", "cours") for n in ("12 ", "12b ", "12bis ", "12ter ", "14 b ", "12 bis, ", "12 ter ", "3bis,  ", "7, ")]
    german = ["Hauptstraße 5", "Lindenstrasse 7b", "Bahnhofstr. 9", "Rosengasse 1", "Marktplatz 3", "Am Hang 4", "In der Aue 12", "Zum Löwen 8a"]
    english = [f"12 Mill {t}" for t in personal.TYPES.split("|")] + [f"Mill {t} No. 4" for t in personal.TYPES.split("|")] + ["Flat 3, 12a Old Mill Road"]
    boxes = ["P.O. Box 9", "PO Box 9", "P. O.Box 12", "Postfach 33", "B.P. 40", "BP 40"]
    lists = personal.Lists(np.zeros((4, personal.BUCKETS), np.uint8))
    for text in french + german + english + boxes:
        assert personal.STREET.search(text), text
        assert any(s.kind == 3 for s in personal.propose(text, lists)), text
