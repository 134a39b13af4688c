"""Postal addresses of one location written in different ways.

Every spelling is read into components: number, street or site and its type, town, county, regions. Equal
readings are one form. Forms are then sorted by several keys made of the components in differing orders, and
each form is compared with the forms in a window after it, in every pass. The comparison is strict on
numbers, units and the types of streets and sites, and tolerates a few edits and transpositions in names;
a missing component is no objection, a different one is. Each form points to its best match among the fuller
or more frequent forms, and what is reached from form to form is the location.

Names of counties and regions are learned from the data: components that carry a county's mark, and
components far more frequent than any place; both lists are bounded by shares of the texts and only help the reading.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.workspace import Workspace, cores

#: Types of streets and sites and their usual abbreviations.
STREETS = {
    "street": "st str", "road": "rd", "lane": "la ln", "court": "ct crt", "place": "pl plc", "avenue": "av ave", "square": "sq", "terrace": "tce terr ter",
    "drive": "dr", "close": "cl", "row": "", "way": "", "hill": "", "alley": "al", "crescent": "cres", "boulevard": "blvd", "gardens": "gdns", "walk": "", "yard": "",
}
SITES = {
    "church": "ch", "chapel": "chap", "farm": "fm", "infirmary": "infirm inf", "workhouse": "workh wkhs", "rectory": "rect", "parish": "par", "cemetery": "cem cemet",
    "abbey": "", "priory": "", "hospital": "hosp", "school": "sch", "mill": "", "manor": "", "castle": "", "vicarage": "vic", "asylum": "", "barracks": "",
}
PREFIXES = {"saint": "st ste snt", "mount": "mt", "fort": "ft", "north": "n nth", "south": "s sth", "east": "e", "west": "w", "upper": "up upr", "lower": "lwr low", "great": "gt grt", "little": "lt ltl", "new": "", "old": ""}
COUNTY = {"county", "co", "cnty", "cty"}
#: A county's name stands in at least COUNTY_ROWS differing texts and this share of all: no more than 1 / COUNTY_SHARE names have
#: it for each component of an address, whatever the size of the table.
COUNTY_ROWS, COUNTY_SHARE = 2, 1e-5
#: A region is a component in at least this share of the differing texts.
REGION_SHARE = 0.012
#: Forms after a form that it is compared with in a pass. A window whose last quarter holds a match goes on by another
#: window, up to HALO forms into the next run.
WINDOW, HALO = 24, 240
#: A spelling is established if it has at least ESTABLISHED_ROWS differing texts and ESTABLISHED_SHARE of all.
ESTABLISHED_ROWS, ESTABLISHED_SHARE = 4, 1e-4
#: Forms of a run, about, each with all its keys.
RUN_ROWS = 1500


def _flip(table: dict[str, str]) -> dict[str, str]:
    return {s: full for full, short in table.items() for s in (full, *short.split())}


STREET_OF, SITE_OF, PREFIX_OF = _flip(STREETS), _flip(SITES), _flip(PREFIXES)


def plain(text: str) -> str:
    """Lower case without accents, brackets, invisible characters and odd white space."""
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"[()\[\]{}\"]", " ", t.replace("’", "'").casefold()).replace("\t", "  ").replace("\n", ", ").strip(" ,.;/-")


def components(text: str) -> list[str]:
    t = plain(text)
    for mark in (r"[,;|]", r"\s*/\s*", r"\s+[-–—]\s+"):
        if re.search(mark, t):
            parts = re.split(mark, t)
            break
    else:
        parts = re.split(r"\s{2,}", t)
    return [p for p in (" ".join(re.sub(r"[^\w' .\-]", " ", x).split()).strip(" .-'") for x in parts) if p]


def edits(a: str, b: str, most: int) -> int:
    """Edits with transpositions of neighbours (optimal alignment), or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    two, one, row = None, list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return row[-1]


def allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 6 else 2


class Reader:
    """Reads spellings, given the learned names of counties and regions."""

    def __init__(self, counties: list[str], regions: list[str]):
        self.counties, self.regions = set(counties), {}
        for r in regions:
            self.regions[r] = self.core(r)
        cores_ = set(self.regions.values())
        initials = {"".join(w[0] for w in r.split()): c for r, c in self.regions.items() if len(r.split()) > 2}
        self.initials = initials
        # an adjective of a known region with a noun of state is that region
        self.cores = cores_
        self._near: dict[tuple[str, bool], str | None] = {}

    @staticmethod
    def core(name: str) -> str:
        """The proper name in the long form of a country: what follows 'of', else the only long word."""
        words = name.split()
        if "of" in words[:-1]:
            return " ".join(words[words.index("of") + 1 :])
        return name

    def near(self, name: str, county: bool) -> str | None:
        key = (name, county)
        if key not in self._near:
            pool = self.counties if county else self.cores
            got = name if name in pool else None
            if got is None and len(name) >= 6:
                best = sorted((edits(name, p, 2), p) for p in pool if abs(len(p) - len(name)) <= 2)
                if best and best[0][0] <= 2 and (len(best) == 1 or best[1][0] > best[0][0]):
                    got = best[0][1]
            if len(self._near) > 200_000:
                self._near.clear()
            self._near[key] = got
        return self._near[key]

    def region(self, comp: str) -> str | None:
        bare = comp.replace(".", "").replace(" ", "")
        if bare in self.initials:
            return self.initials[bare]
        name = self.core(comp)
        if name in self.cores:
            return self._country(name)
        first = name.split()[0]
        if len(name.split()) == 2 and name.split()[1] in ("commonwealth", "republic", "kingdom", "empire", "union", "state"):
            for c in self.cores:
                if first.startswith(c[: max(5, len(c) - 1)]):
                    return self._country(c)
        got = self.near(name, False)
        return self._country(got) if got else None

    def _country(self, core: str) -> str:
        words = core.split()
        if len(words) == 2 and words[1] in ("commonwealth", "republic", "kingdom", "empire", "union", "state"):
            for c in sorted(self.cores, key=len):
                if c != core and words[0].startswith(c[: max(5, len(c) - 1)]):
                    return c
        return core

    def read(self, text: str) -> tuple[str, str, str, str, str, str, str]:
        """(kind, number, name, type, town, county, regions); kind is house, site or town."""
        number = name = kind_of = town = county = ""
        kind, regions, free = "town", [], []
        for comp in components(text):
            words = [w.strip(".") for w in comp.split()]
            words = [w for w in words if w]
            if not words:
                continue
            if len(words) > 1 and (words[-1] in COUNTY or words[0] in COUNTY):
                c = " ".join(words[:-1] if words[-1] in COUNTY else words[1:])
                county = county or self.near(c, True) or c
                continue
            digits = [w for w in words if re.fullmatch(r"\d+[a-z]?(?:[-/]\d+[a-z]?)?", w)]
            if digits:
                number = number or digits[0]
                kind = "house"
                words = [w for w in words if w not in digits and w not in ("no", "nr", "number")]
                if not words:
                    continue
                if len(words) > 1 and words[-1] in STREET_OF:
                    name, kind_of = " ".join(words[:-1]), STREET_OF[words[-1]]
                elif len(words) > 1:
                    name, kind_of = " ".join(words[:-1]), self._typo(words[-1], STREET_OF)
                else:
                    name = words[0]
                continue
            region = self.region(comp)
            if region:
                regions.append(region)
                continue
            if len(words) > 1 and words[-1] in STREET_OF and words[-1] not in ("hill", "way", "row") and words[0] not in PREFIX_OF or (len(words) > 2 and words[-1] in STREET_OF):
                name, kind_of, kind = " ".join(words[:-1]), STREET_OF[words[-1]], "house"
                continue
            if len(words) > 2 and words[1] == "of" and self._typo(words[0], SITE_OF, True):
                kind, kind_of, name = "site", self._typo(words[0], SITE_OF, True), self._saint(words[2:])
                continue
            if len(words) > 1 and self._typo(words[-1], SITE_OF, True):
                kind, kind_of, name = "site", self._typo(words[-1], SITE_OF, True), self._saint(words[:-1])
                continue
            free.append(words)
        rest = []
        for words in free:
            c = " ".join(words)
            if not county and len(free) > 1 and c in self.counties:
                county = c
            else:
                rest.append(words)
        if rest:
            if len(rest) > 1 and not county:
                county = self.near(" ".join(rest[1]), True) or ""
                # written from the far end, the county stands before the town
                if not county and (got := self.near(" ".join(rest[0]), True)):
                    county, rest = got, rest[1:]
            town = self._town(rest[0])
        return kind, number, name, kind_of, town, county, " ".join(sorted(set(regions)))

    @staticmethod
    @lru_cache(maxsize=50_000)
    def _typo_cached(word: str, sites: bool) -> str:
        table = SITE_OF if sites else STREET_OF
        if word in table:
            return table[word]
        if len(word) < 4:
            return ""
        best = sorted((edits(word, t, 2 if len(t) > 6 else 1), t) for t in set(table.values()) if len(t) > 3)
        return best[0][1] if best and best[0][0] <= (2 if len(best[0][1]) > 6 else 1) else ""

    def _typo(self, word: str, table: dict, sites: bool = False) -> str:
        return self._typo_cached(word, sites)

    @staticmethod
    def _saint(words: list[str]) -> str:
        words = [w[:-2] if w.endswith("'s") else w.rstrip("'") for w in words]
        words = [SITE_OF.get(w, w) for w in words]
        if len(words) > 1 and words[0] in ("st", "ste", "s", "snt", "saint"):
            words = ["saint", *words[1:]]
        return " ".join(words)

    @staticmethod
    def _town(words: list[str]) -> str:
        if len(words) > 1 and words[0] in PREFIX_OF and words[0] != "s":
            words = [PREFIX_OF[words[0]], *words[1:]]
        return " ".join(words)


def _first(town: str) -> tuple[str, str]:
    head, _, tail = town.partition(" ")
    return (head, tail) if tail and (head in PREFIX_OF or head == "s") else ("", town)


def same_town(a: str, b: str, extra: int = 0) -> int | None:
    """Edits between two towns' names, or None if they are not one name. A bare s stands for Saint and South."""
    pa_, ta = _first(a)
    pb, tb = _first(b)
    if pa_ != pb and not ("s" in (pa_, pb) and {pa_, pb} & {"saint", "south"}):
        most = allowed(len(a)) + extra
        n = edits(a, b, most)
        return n if n <= most and (not pa_ or not pb) and len(a) > 6 else (n if n <= 1 and len(a) > 8 and bool(pa_) and bool(pb) and pa_ not in PREFIXES and pb not in PREFIXES else None)
    n = edits(ta, tb, min(allowed(len(ta)), allowed(len(tb))) + extra)
    return n if n <= min(allowed(len(ta)), allowed(len(tb))) + extra else None


def agree(a: dict, b: dict, least: float = ESTABLISHED_ROWS) -> float | None:
    """A score for two readings of one location (higher is better), or None if they denote different ones; of two
    spellings that both have ``least`` texts neither is a typo of the other unless it is far rarer."""
    if a["kind"] != b["kind"] or a["number"] != b["number"]:
        return None
    if a["kind"] != "town" and a["type"] and b["type"] and a["type"] != b["type"]:
        return None
    far = _km(a, b)
    if far is not None and far > 4.0:
        return None
    close = far is not None and far < 1.0
    extra = 1 if close else 0
    cost = 0.0
    if a["name"] != b["name"]:
        if established(a["name_rows"], b["name_rows"], 10, least):
            return None
        short = min(len(a["name"]), len(b["name"]))
        most = (0 if short < 3 else 1 if short < 6 else 2) + (extra if short > 4 else 0)
        n = edits(a["name"], b["name"], most)
        if n > most:
            return None
        cost += n
    if a["county"] and b["county"] and a["county"] != b["county"]:
        if edits(a["county"], b["county"], 2) > 2:
            return None
        cost += 1.5
    if a["regions"] and b["regions"]:
        ra, rb = set(a["regions"].split()), set(b["regions"].split())
        if not ra & rb and not a["county"] == b["county"] != "":
            return None
    if not a["town"] or not b["town"]:
        if a["town"] == b["town"] and a["county"] == b["county"]:
            n = 0
        elif close and a["kind"] != "town":
            n = 1
        else:
            return None
    else:
        n = same_town(a["town"], b["town"], extra)
        if n is None:
            return None
        if n and not close and established(a["town_rows"], b["town_rows"], 20, least):
            return None
        # two edits need the county to agree, or the coordinates
        if n >= 2 and not close and not (a["county"] and a["county"] == b["county"]):
            return None
    cost += n
    known = sum(bool(a[k] and a[k] == b[k]) for k in ("county", "regions"))
    return 10.0 - cost + 0.5 * known + (1.0 if close else 0.0)


def established(m: int, n: int, times: int, least: float) -> bool:
    """Whether two spellings are both too frequent for one to be a typo of the other."""
    return min(m, n) >= least and min(m, n) * times >= max(m, n)


def _km(a: dict, b: dict) -> float | None:
    if a["lat"] is None or b["lat"] is None or a["lat"] != a["lat"] or b["lat"] != b["lat"]:
        return None
    p, q = np.radians(a["lat"]), np.radians(b["lat"])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b["lon"] - a["lon"]) / 2) ** 2
    return float(12742.0176 * np.arcsin(min(1.0, np.sqrt(h))))


def _skeleton(name: str) -> str:
    """First letter and consonants, doubles once: what survives a typo in a vowel or a doubled letter."""
    bare = re.sub(r"[^a-z]", "", name)
    return re.sub(r"(.)\1+", r"\1", bare[:1] + re.sub(r"[aeiouyh]", "", bare[1:]))


def keys(r: dict) -> list[str]:
    """The sort key of each pass: the components in differing orders. In the last one a town stands by its two ends after
    all else, since a typo amid its name leaves ever more towns in between where only one end leads the order."""
    town = _first(r["town"])[1]
    number = r["number"].zfill(6) if r["number"] else ""
    return [
        "0|" + "|".join((r["kind"], r["county"], town, r["name"], number, r["type"])),
        "1|" + "|".join((r["kind"], number, r["name"], r["type"], town)),
        "2|" + "|".join((r["kind"], number, _skeleton(town), r["name"], r["county"])),
        "3|" + "|".join((r["kind"], number, r["type"], town[::-1], r["name"][::-1])),
        "4|" + "|".join((r["kind"], r["county"], number, "".join(sorted(town)), r["type"])),
        "5|" + "|".join((r["kind"], _skeleton(r["name"]), r["type"], number, _skeleton(town))),
        "6|" + "|".join((r["kind"], number, r["name"], r["type"], r["county"], town[:3] + town[-4:], town)),
    ]


FORM = "form string, kind string, number string, name string, type string, town string, county string, regions string, lat double, lon double, rows bigint, name_rows bigint, town_rows bigint"


def locations(places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, location) of places(id, original, latitude, longitude): location is the same for all rows of one location.

    Rows with a null id are left out; a null or empty original is a location of its own. Repeated rows count
    once. Coordinates only speak against a match when they lie apart, and for it when they meet; null, (0, 0)
    and impossible ones say nothing. Other columns are ignored.
    """
    spark = places.sparkSession
    ws = Workspace(spark, "addresses")
    ok = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    rows = places.where("id is not null").select("id", "original", F.when(ok, F.col("latitude")).alias("lat"), F.when(ok, F.col("longitude")).alias("lon")).dropDuplicates(["id"])

    def tally(batches):
        for batch in batches:
            names, kinds = [], []
            for text in batch.column(0).to_pylist():
                for comp in components(text) if text else ():
                    words = [w.strip(".") for w in comp.split() if w.strip(".")]
                    if len(words) > 1 and (words[-1] in COUNTY or words[0] in COUNTY):
                        names.append(" ".join(words[:-1] if words[-1] in COUNTY else words[1:]))
                        kinds.append("county")
                    elif words and not any(c.isdigit() for c in comp):
                        names.append(comp)
                        kinds.append("other")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string())], names=["name", "kind"])

    # what is learned is learned from differing texts: repeated ones make no spelling more usual against another
    texts = ws.save(rows.select("original").distinct(), "texts")
    counted = texts.mapInArrow(tally, "name string, kind string").groupBy("kind", "name").agg(F.count("*").alias("n"))
    total = max(1, texts.count())
    least_established = max(ESTABLISHED_ROWS, ESTABLISHED_SHARE * total)
    # both thresholds are shares of the texts, which bounds how many names can reach them
    learned = counted.where(((F.col("kind") == "county") & (F.col("n") >= max(COUNTY_ROWS, COUNTY_SHARE * total))) | ((F.col("kind") == "other") & (F.col("n") >= max(3, REGION_SHARE * total)))).collect()
    county_rows = {r["name"]: r["n"] for r in learned if r["kind"] == "county"}
    # a spelling close to a far more frequent one is a typo of it
    counties: list[str] = []
    for c in sorted(county_rows, key=lambda c: (-county_rows[c], c)):
        if not any(county_rows[k] > 5 * county_rows[c] and edits(c, k, 2) <= 2 for k in counties):
            counties.append(c)
    # the regions' names end most addresses, a town's never do: what stands beside a county mark is none
    regions = [r["name"] for r in learned if r["kind"] == "other" and not re.search(r"\d", r["name"])]
    regions = _regions(texts, regions)

    def parse(batches):
        reader = Reader(counties, regions)
        for batch in batches:
            out = [reader.read(t) if t else ("none", "", i, "", "", "", "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            cols = [pa.array([r[k] for r in out], pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), *cols], names=["id", "lat", "lon", "text", "kind", "number", "name", "type", "town", "county", "regions"])

    count = rows.count()
    told = rows.withColumn("text", F.xxhash64("original")).repartition(max(1, min(cores(spark), count // 2000), count // 50_000))
    read = told.mapInArrow(parse, "id string, lat double, lon double, text bigint, kind string, number string, name string, type string, town string, county string, regions string")
    named = ("kind", "number", "name", "type", "town", "county", "regions")
    read = ws.save(read.withColumn("form", F.md5(F.concat_ws("|", *named, F.when((F.col("town") == "") | (F.col("county") == ""), F.concat(F.round("lat", 0), F.lit("/"), F.round("lon", 0)))))), "read")
    forms = read.groupBy("form", *named).agg(F.expr("percentile_approx(lat, 0.5)").alias("lat"), F.expr("percentile_approx(lon, 0.5)").alias("lon"), F.count_distinct("text").alias("rows"))
    forms = ws.save(forms, "counted")
    by_name = forms.groupBy("name").agg(F.sum("rows").alias("name_rows"))
    by_town = forms.groupBy("town").agg(F.sum("rows").alias("town_rows"))
    forms = forms.join(by_name, "name").join(by_town, "town")
    forms = ws.save(forms.select(*[c.split()[0] for c in FORM.split(", ")]), "forms")

    def passes(batches):
        for batch in batches:
            table = batch.to_pylist()
            ks = [keys(r) for r in table]
            at = [n for n, k in enumerate(ks) for _ in k]
            yield pa.RecordBatch.from_arrays([pa.array([x for k in ks for x in k], pa.string()), *batch.take(pa.array(at, pa.int64())).columns], names=["key", *batch.schema.names])

    keyed = forms.where("kind <> 'none'").mapInArrow(passes, f"key string, {FORM}")
    parts = max(1, forms.count() // RUN_ROWS)
    runs = keyed.repartitionByRange(parts, "key", "form").sortWithinPartitions("key", "form").withColumn("part", F.spark_partition_id())

    def number(batches):
        n = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + batch.num_rows), pa.int64())], names=[*batch.schema.names, "nth"])
            n += batch.num_rows

    runs = ws.save(runs.mapInArrow(number, f"key string, {FORM}, part int, nth bigint"), "runs")
    # a run also sees the rows after it, in however many runs these are, so that no window ends at a border
    sizes = {r["part"]: r["count"] for r in runs.groupBy("part").count().collect()}
    before = seen_before(sizes, max(window, HALO))
    runs = runs.withColumn("of", F.col("part")).unionByName(runs.join(F.broadcast(spark.createDataFrame(before, "part int, of int, first bigint")), "part").where("nth < first").select(*runs.columns, "of"))

    def compare(table):
        table = table.take(pa.array(np.lexsort((_codes(table, "form"), _codes(table, "key")))))
        near = possible(table, window)
        rows_ = table.select([c for c in table.column_names if c not in ("key", "nth", "of")]).to_pylist()
        own = [r["part"] for r in rows_]
        of = table.column("of")[0].as_py()
        a_, b_, s_ = [], [], []
        for n, a in enumerate(rows_):
            if own[n] != of:
                continue
            at, end = n + 1, n + 1 + window
            while at < min(end, len(rows_)):
                last = -1
                for m in near(n, at, min(end, len(rows_))):
                    b = rows_[m]
                    score = agree(a, b, least_established)
                    if score is not None:
                        last = m
                        x, y = (a, b) if rank(a) < rank(b) else (b, a)
                        a_.append(x["form"])
                        b_.append(y["form"])
                        s_.append(score + 0.01 * min(y["rows"], 50))
                at, end = end, end + window if last >= end - window // 4 else end
        return pa.table({"form": pa.array(a_, pa.string()), "up": pa.array(b_, pa.string()), "score": pa.array(s_, pa.float64())})

    links = runs.groupBy("of").applyInArrow(compare, "form string, up string, score double")
    best = links.groupBy("form").agg(F.max_by("up", F.struct("score", "up")).alias("up"))
    tree = ws.save(forms.select("form").join(best, "form", "left").select("form", F.coalesce("up", "form").alias("up")), "tree0")
    for k in range(1, 40):
        # every form's target is taken from its target, which halves what is left of the way
        over = tree.select(F.col("form").alias("f"), F.col("up").alias("upper"))
        nxt = tree.join(over, tree.up == over.f).select("form", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved"))
        nxt = ws.save(nxt, f"tree{k}")
        tree = nxt.select("form", "up")
        if nxt.where("moved").isEmpty():
            break
    return read.select("id", "form").join(tree, "form").select("id", F.col("up").alias("location"))


def seen_before(sizes: dict[int, int], reach: int) -> list[tuple[int, int, int]]:
    """(part, of, first): run ``of`` stands before run ``part`` and its windows reach that run's first ``first`` rows."""
    out, parts = [], sorted(sizes)
    for n, part in enumerate(parts):
        left = reach
        for of in reversed(parts[:n]):
            if left <= 0:
                break
            out.append((part, of, left))
            left -= sizes[of]
    return out


def _codes(table: pa.Table, column: str) -> np.ndarray:
    """Ranks of a text column's values."""
    names, codes = np.unique(table.column(column).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    return codes


def possible(table: pa.Table, window: int):
    """near(n, start, end): the rows from start to end that could agree with row n: equal in pass, kind and number, not of
    different types, not apart in place. The first window of every row is worked out for all rows at once."""
    first = pa.table({"p": pa.compute.utf8_slice_codeunits(table.column("key"), 0, 1)})
    same = (_codes(first, "p") * (1 << 40)) + _codes(table, "kind") * (1 << 36) + _codes(table, "number")
    kind = table.column("type").to_numpy(zero_copy_only=False).astype(str)
    blank, kind = kind == "", _codes(table, "type")
    lat, lon = (np.radians(table.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("lat", "lon"))

    def ok(i, j):
        good = (same[i] == same[j]) & ((kind[i] == kind[j]) | blank[i] | blank[j])
        far = np.sin((lat[j] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lon[j] - lon[i]) / 2) ** 2
        # somewhat beyond the bound that decides; not a number where a coordinate is missing
        return good & ~(far > np.sin(4.01 / 12742.0176) ** 2)

    size = len(same)
    steps = np.zeros((size, window), bool)
    for d in range(1, window + 1):
        n = np.arange(max(0, size - d))
        steps[n, d - 1] = ok(n, n + d)
    ahead = {}
    for n, d in zip(*(x.tolist() for x in np.nonzero(steps))):
        ahead.setdefault(n, []).append(n + 1 + d)

    def near(n: int, start: int, end: int):
        if start == n + 1:
            return ahead.get(n, ())
        m = np.arange(start, end)
        return m[ok(np.full(len(m), n), m)].tolist()

    return near


def rank(r: dict) -> tuple:
    """Fuller forms stand above lesser ones, then the more frequent."""
    return (bool(r["town"]) + bool(r["county"]), r["rows"], bool(r["regions"]), bool(r["type"]), r["form"])


def _regions(texts: DataFrame, names: list[str]) -> list[str]:
    """Of the frequent components, those that also occur in the addresses of many different towns: regions, not towns."""
    if not names:
        return []

    def beside(batches):
        pool = set(names)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                c = components(text) if text else []
                if len(c) < 3:
                    continue
                # at the far end of the order in which the number or the county mark shows the near end
                county = [n for n, x in enumerate(c) if {w.strip(".") for w in x.split()} & COUNTY]
                if not county:
                    continue
                for n, x in enumerate(c):
                    if x in pool:
                        out.append((x, c[county[0]]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["name", "county"])

    seen = texts.mapInArrow(beside, "name string, county string").groupBy("name").agg(F.approx_count_distinct("county").alias("n")).collect()
    return [r["name"] for r in seen if r["n"] >= 5]


def same_location_pairs(places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of places rows whose originals denote one location; see ``locations``."""
    loc = locations(places, window)
    a = loc.select(F.col("location"), F.col("id").alias("id_a"))
    b = loc.select(F.col("location"), F.col("id").alias("id_b"))
    return a.join(b, "location").where("id_a < id_b").select("id_a", "id_b")
