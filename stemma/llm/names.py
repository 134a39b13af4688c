"""Variant spellings of one person's name, entered under several ids.

Candidates come from MinHash banding over padded q-grams of the surname, within one year and location of birth
(both must be equal anyway). Rows and bands are taken from the collision curve 1 - (1 - s^r)^b so that pairs of the
least accepted similarity are found with the wanted recall. Every reading of a name (parts swapped, a married woman's
maiden name) is banded. Candidates are verified token by token with a Monge-Elkan similarity that knows initials and
short forms; star clustering decides which of the verified links stand.

Ids with equal entries are one entry until the end. The entries of one year and location, if there are at most
CROWD of them, travel together once and are banded, verified and clustered where they meet. A larger crowd is sent
band by band, so that only entries that share a band meet, and what shares a band is cut into cells of CELL entries.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.addresses import edits
from stemma.plans.workspace import Workspace, cores

Q = 2
#: Least Jaccard similarity of the q-grams of two spellings of one name, and the recall wanted there.
LEAST_SIMILAR, RECALL = 0.34, 0.995
TITLES = {"mr", "mrs", "miss", "ms", "dr", "rev", "capt", "sir", "lady", "widow", "master", "col", "maj", "hon", "lt", "sgt", "prof", "esq", "jr", "sr", "senior", "junior"}
BORN = {"nee", "geb", "born", "formerly"}
#: Short forms in common use besides those of the table that comes with the data.
COMMON_SHORT = {
    "margaret": "maggie meg peg peggy madge daisy greta", "mehitabel": "hitty hetty", "piers": "pyrs pierce", "henrietta": "etta hattie hetty", "elizabeth": "eliza lizzie bess bessie betsy betty beth libby",
    "mary": "polly molly mamie may minnie", "sarah": "sally sadie", "martha": "patty mattie", "catherine": "kate kitty cathy katie", "dorothy": "dolly dot", "frances": "fanny frankie", "harriet": "hattie",
    "charlotte": "lottie", "caroline": "carrie lina", "wilhelmina": "minnie mina billie", "william": "wm bill will willie", "john": "jack jno johnny", "james": "jas jim jem", "robert": "rob bob bert",
    "richard": "dick rick", "edward": "ned ted", "henry": "harry hal", "charles": "chas charlie", "thomas": "thos tom", "george": "geo", "joseph": "jos joe", "samuel": "sam saml", "alexander": "alex sandy",
    "theodore": "theo ted", "bartholomew": "bart bat", "nathaniel": "nat nate", "christopher": "kit chris", "walter": "wat walt", "lawrence": "larry laurie", "leopold": "leo", "gertrude": "trudy gertie",
    "isabella": "bella ibby", "susannah": "sukey susan sue", "rebecca": "becky", "deborah": "debby", "philippa": "pippa", "josephine": "josie jo", "anthony": "tony antony", "matthew": "matt", "michael": "mike mick",
}
MARRIED = {"m", "married", "verh", "ep"}
PARTICLES = {"van", "von", "de", "der", "den", "du", "la", "le"}
#: Entries of one year and location that are compared in one place, and entries of a chunk of what shares a band.
CROWD, CELL = 2_000, 500


def tuned(similarity: float, recall: float, rows: int = 2) -> tuple[int, int]:
    """Rows and bands: the fewest bands of that many rows with which the collision curve reaches the recall."""
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
    return rows, bands


def plain(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.replace("’", "'"))
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()
    # a name in brackets is a maiden name
    t = re.sub(r"[(\[]", " nee ", t)
    return re.sub(r"\s+", " ", re.sub(r"[^\w'., \-]", " ", t)).strip()


def stem(surname: str) -> str:
    """A surname without the endings that scribes add or drop."""
    s = re.sub(r"[^a-z]", "", surname)
    for end in ("sen", "son", "s", "e"):
        if s.endswith(end) and len(s) - len(end) >= 5:
            return s[: -len(end)]
    return s


class Forms:
    """Short forms of given names. What the table lacks is met by the likeness of beginnings."""

    def __init__(self, pairs: list[tuple[str, str]] = ()):
        self.formal: dict[str, set[str]] = {}
        self.given: set[str] = set()
        for formal, short in [*pairs, *((f, s) for f, many in COMMON_SHORT.items() for s in many.split())]:
            f, s = plain(formal).strip(".").replace("ph", "f"), plain(short).strip(".").replace("ph", "f")
            self.formal.setdefault(s, set()).add(f)
            self.given |= {f, s}

    def all(self, token: str) -> set[str]:
        return {token} | self.formal.get(token, set())


class Name:
    """A reading: given tokens, surname, and the maiden or married surname beside it."""

    __slots__ = ("given", "surnames")

    def __init__(self, given: list[str], surnames: list[str]):
        self.given, self.surnames = given, surnames


def readings(given: str | None, surname: str | None, others: list[str] = ()) -> list[Name]:
    """The ways in which the two fields can be read, with a husband's surname beside the own; none for a name without a letter."""
    extra = [plain(o) for o in others or () if o]
    g, s = plain(given or ""), plain(surname or "")
    out: list[Name] = []

    def tokens(text: str) -> list[str]:
        words = [w.strip(".'-").replace("ph", "f") for w in re.split(r"[ .]+", text)]
        return [w for w in words if w and w not in TITLES]

    def surname_parts(text: str) -> list[str]:
        words, parts, part = tokens(text), [], []
        for w in words:
            if w in BORN or (w in MARRIED and part and w != words[-1]):
                parts.append(part)
                part = []
            else:
                part.append(w)
        whole = [" ".join(p) for p in [*parts, part] if p]
        return whole + [h for w in whole if "-" in w for h in w.split("-") if len(h) > 2]

    def add(gv: list[str], sn: list[str]) -> None:
        if gv or sn:
            out.append(Name(gv, [*sn, *extra] if sn else sn))

    joined = f"{g} {s}".strip() if not (g and s) else ""
    if joined:
        if "," in joined:
            a, _, b = joined.partition(",")
            add(tokens(b), surname_parts(a))
            add(tokens(a), surname_parts(b))
        else:
            words = tokens(joined)
            cut = next((n for n, w in enumerate(words) if w in BORN), None)
            if cut is not None and cut > 0:
                at = cut - 1
                while at > 1 and words[at - 1] in PARTICLES:
                    at -= 1
                add(words[:at], [" ".join(words[at:cut]), " ".join(words[cut + 1 :])])
            elif len(words) > 1:
                at = len(words) - 1
                while at > 1 and words[at - 1] in PARTICLES:
                    at -= 1
                add(words[:at], [" ".join(words[at:])])
                n = 1
                while n < len(words) - 1 and words[n - 1] in PARTICLES:
                    n += 1
                add(words[n:], [" ".join(words[:n])])
            elif words:
                add([], words)
                add(words, [])
    else:
        add(tokens(g.replace(",", " ")), surname_parts(s.replace(",", " ")))
        add(tokens(s.replace(",", " ")), surname_parts(g.replace(",", " ")))
    return out


def qgrams(text: str, q: int = Q) -> set[str]:
    padded = "#" * (q - 1) + text + "#" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def like(a: str, b: str) -> float:
    """1 less the share of edits (transpositions count once) in the longer of two words."""
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    most = max(1, longest // 3)
    n = edits(a, b, most)
    return 0.0 if n > most else 1 - n / longest


def given_like(a: str, b: str, forms: Forms) -> float:
    """Of two given names; initials and short forms count as the name."""
    if not a or not b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] or any(f[0] == b[0] for f in forms.all(a)) or any(f[0] == a[0] for f in forms.all(b)) else 0.0
    best = max(like(x, y) for x in forms.all(a) for y in forms.all(b))
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and len(long) > len(short) and (long.startswith(short) or long.endswith(short)):
        best = max(best, 0.85)
    if 2 <= len(short) <= 5 and len(long) > len(short) and short[0] == long[0] and contained(short, long):
        best = max(best, 0.8)
    if best < 0.75 and len(short) >= 3:
        # a short form the table lacks, made from a known one by its ending
        root = re.sub(r"(ie|ey|y)$", "", short)
        if len(root) >= 3 and root != short and long.startswith(root):
            best = max(best, 0.8)
    return best


def contained(short: str, long: str) -> bool:
    """Whether the letters of short come in long in that order, as in written contractions."""
    at = iter(long)
    return all(c in at for c in short)


def surname_like(a: str, b: str) -> float:
    x, y = a.replace(" ", "").replace("'", "").replace("-", ""), b.replace(" ", "").replace("'", "").replace("-", "")
    short, long = sorted((x, y), key=len)
    cut = 0.8 if len(short) >= 4 and len(long) >= len(short) + 3 and long.startswith(short) else 0.0
    return max(like(x, y), like(stem(x), stem(y)) if min(len(x), len(y)) > 5 else 0.0, cut)


def same_name(a: Name, b: Name, forms: Forms) -> float:
    """Monge-Elkan over the parts: 0 when a part contradicts, else the mean of the best matches."""
    if not a.surnames or not b.surnames or not a.given or not b.given:
        return 0.0
    sur = max(surname_like(x, y) for x in a.surnames for y in b.surnames)
    if sur < 0.74:
        return 0.0
    first = given_like(a.given[0], b.given[0], forms)
    mine, yours = a.given[1:], b.given[1:]
    if first < 0.66:
        # the name in use may be the second one, or stand after an initial: all of the shorter must be in the longer
        few, many = sorted((a.given, b.given), key=len)
        if len(many) < 2 or min(max(given_like(x, y, forms) for y in many) for x in few) < 0.66:
            if not (len(few) == 2 and len(few[0]) == 1 and max(given_like(few[1], y, forms) for y in many) >= 0.75):
                return 0.0
        mine, yours, first = [], [], 0.75
    total, n = first * 2 + sur * 3, 5.0
    few, many = sorted((mine, yours), key=len)
    for x in few:
        best = max((given_like(x, y, forms) for y in many), default=0.0)
        if best < 0.6:
            # a lone initial is often a slip; two full names that differ are not
            if len(x) > 1 and all(len(y) > 1 for y in many):
                return 0.0
            best = 0.5
        total, n = total + best, n + 1
    return total / n


def score(a: list[Name], b: list[Name], forms: Forms) -> float:
    """The best of any two readings, whichever is held against the other."""
    return max((max(s, same_name(y, x, forms)) if (s := same_name(x, y, forms)) < 1 and len(x.given) == len(y.given) else s for x in a for y in b), default=0.0)


def persons(people: DataFrame, families: DataFrame) -> DataFrame:
    """(id, given, surname, year, place, sex, others): others are surnames of husbands, from the families that
    name the person as wife. Only people with a year and a place of birth; current rows expected."""
    year = F.regexp_extract("birth_date", r"\b(\d{4})\b", 1)
    p = people.where("id is not null").select("id", F.col("given_name").alias("given"), "surname", F.when(year != "", year.cast("int")).alias("year"), F.col("birth_place").alias("place"), "sex")
    wives = families.where("wife_id is not null and husband_id is not null").select("wife_id", "husband_id")
    husbands = people.select(F.col("id").alias("husband_id"), F.col("surname").alias("other"))
    others = wives.join(husbands.hint("merge"), "husband_id").groupBy("wife_id").agg(F.sort_array(F.collect_set("other")).alias("others")).withColumnRenamed("wife_id", "id")
    return p.where("year is not null and place is not null").join(others.hint("merge"), "id", "left")


class Bands:
    """Band keys of surnames, remembered: a surname's bands are the same wherever it stands."""

    def __init__(self, rows: int, bands: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.shape = bands, rows
        self.a = rng.integers(1, (1 << 61) - 1, rows * bands, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, (1 << 61) - 1, rows * bands, dtype=np.uint64)
        self.known: dict[str, np.ndarray] = {}

    def of(self, text: str) -> np.ndarray:
        """One number a band."""
        import xxhash

        got = self.known.get(text)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            h = np.array([xxhash.xxh3_64_intdigest(g) for g in sorted(qgrams(text))], np.uint64)
            least = (h[:, None] * self.a + self.b).min(0).reshape(self.shape)
            mix = np.uint64(0x9E3779B97F4A7C15)
            key = np.arange(self.shape[0], dtype=np.uint64)
            for r in range(self.shape[1]):
                key = (key ^ least[:, r]) * mix
                key ^= key >> np.uint64(29)
            got = self.known[text] = key.view(np.int64)
        return got


ENTRY = "unit bigint, given string, surname string, others array<string>, sex string, ids bigint"


class Entry:
    __slots__ = ("unit", "sex", "ids", "readings", "stems")

    def __init__(self, unit: int, given, surname, others, sex, ids):
        self.unit, self.sex, self.ids = unit, sex, ids
        self.readings = readings(given, surname, others)
        # every surname of every reading; first names come as initials and short forms, too little to be banded
        self.stems = {t for r in self.readings for sn in r.surnames if (t := stem(sn))}

    def apart(self, other: "Entry") -> bool:
        return self.sex in ("M", "F") and other.sex in ("M", "F") and self.sex != other.sex


def met_in_bands(entries: list[Entry], bands: Bands) -> list[tuple[int, int]]:
    """(i, j), i < j, of entries that share a band."""
    owner = np.array([n for n, e in enumerate(entries) for _ in e.stems], np.int64)
    if len(owner) < 2:
        return []
    keys = np.stack([bands.of(t) for e in entries for t in sorted(e.stems)])
    if len(owner) <= 64:
        i, j = np.nonzero((keys[:, None, :] == keys[None, :, :]).any(2))
        i, j = owner[i], owner[j]
    else:
        flat, who = keys.ravel(), np.repeat(owner, keys.shape[1])
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        many = np.diff(np.append(first, len(flat)))
        left, right = [], []
        for s, m in zip(first[many > 1].tolist(), many[many > 1].tolist()):
            u = np.unique(who[s : s + m])
            a, b = np.triu_indices(len(u), 1)
            left.append(u[a])
            right.append(u[b])
        if not left:
            return []
        i, j = np.concatenate(left), np.concatenate(right)
    pair = np.unique(i[i < j] * len(entries) + j[i < j])
    return list(zip((pair // len(entries)).tolist(), (pair % len(entries)).tolist()))


def star_cover(links: dict[tuple[int, int], float], spread_of) -> set[tuple[int, int]]:
    """Pairs that lie in one star: by falling number of links (ties by spread_of), whoever is in no star yet becomes the
    centre of one that holds all its neighbours."""
    near: dict[int, set[int]] = {}
    for i, j in links:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    marked: set[int] = set()
    out: set[tuple[int, int]] = set()
    for n in sorted(near, key=lambda n: (-len(near[n]), -spread_of(n))):
        if n not in marked:
            star = sorted({n} | near[n])
            marked |= near[n] | {n}
            out |= {(a, b) for k, a in enumerate(star) for b in star[k + 1 :]}
    return out


def _spread(unit: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(int(unit).to_bytes(8, "little", signed=True), seed=42) >> 1


def same_person_pairs(persons_: DataFrame, name_forms: DataFrame, accept: float = 0.73, least_similar: float = LEAST_SIMILAR, recall: float = RECALL, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of persons(id, given, surname, year, location, sex, others).

    Two people are one if some reading of their names is a spelling of one name (score at least ``accept``) or both are
    spellings of a third one's in a star, the year and the location of birth are equal and the sexes, where both are
    M or F, do not differ. Rows without year, location or any letter in the name have no partner; a repeated id counts
    once; an empty table gives no rows. name_forms is a table of settings: short forms in common use.
    """
    spark = persons_.sparkSession
    ws = Workspace(spark, "names")
    pairs = [(r[0], r[1]) for r in name_forms.where("formal is not null and short_form is not null").select("formal", "short_form").distinct().collect()]
    n_rows, n_bands = tuned(least_similar, recall)
    people = persons_.where("id is not null and year is not null and location is not null").dropDuplicates(["id"])
    fields = ("given", "surname", "others", "year", "location", "sex")
    whole = people.select("id", "given", "surname", "year", "location", "sex", F.coalesce("others", F.array().cast("array<string>")).alias("others"))
    # two entries are one if all their fields are equal, null apart from empty
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string") if c != "others" else F.array_join(c, "|")), F.lit("-")) for c in fields]
    whole = ws.save(whole.withColumn("unit", F.xxhash64(*marked)), "people")
    entries = whole.groupBy("unit").agg(*[F.first(c).alias(c) for c in fields], F.count("*").alias("ids"))
    entries = ws.save(entries.withColumn("place", F.xxhash64("location", "year")).drop("location", "year"), "entries")
    sizes = entries.groupBy("place").agg(F.count("*").alias("n"), F.sum("ids").alias("all")).where("all > 1").select("place", "n")
    met = entries.join(sizes.hint("merge"), "place")
    parts = max(cores(spark), whole.count() // 20_000)
    form = "link boolean, unit_a bigint, unit_b bigint, score double"

    def links_of(group: list[Entry], met: list[tuple[int, int]], forms: Forms) -> dict[tuple[int, int], float]:
        scored = ((i, j, score(group[i].readings, group[j].readings, forms)) for i, j in met if not group[i].apart(group[j]))
        return {(i, j): s for i, j, s in scored if s >= accept}

    def rows(found: list[tuple[bool, int, int, float]]):
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in range(4)], names=["link", "unit_a", "unit_b", "score"])

    def together(batches):
        """Whole groups of one year and location: pairs of stars, and entries of several ids with themselves."""
        forms, bands = Forms(pairs), Bands(n_rows, n_bands)
        for group in _groups(batches, "place"):
            group = [Entry(*r[1:]) for r in group]
            found = [(False, e.unit, e.unit, 1.0) for e in group if e.ids > 1 and score(e.readings, e.readings, forms) >= accept]
            links = links_of(group, met_in_bands(group, bands), forms)
            found += [(False, group[i].unit, group[j].unit, 1.0) for i, j in star_cover(links, lambda n: _spread(group[n].unit)) if not group[i].apart(group[j])]
            if found:
                yield found

    def batched(of):
        def run(batches):
            held = []
            for found in of(batches):
                held += found
                if len(held) > 20_000:
                    yield rows(held)
                    held = []
            if held:
                yield rows(held)

        return run

    columns = ["place", "unit", "given", "surname", "others", "sex", "ids"]
    small = met.where(F.col("n") <= crowd).select(*columns).repartition(parts, "place").sortWithinPartitions("place")
    found = ws.save(small.mapInArrow(batched(together), form), "found")
    large = met.where(F.col("n") > crowd).select(*columns)
    if not large.isEmpty():
        found = found.unionByName(_crowded(ws, large, parts, n_rows, n_bands, cell, links_of, pairs, accept, batched, form))
    same = found.select("unit_a", "unit_b").distinct()
    one = whole.select(F.col("unit").alias("unit_a"), F.col("id").alias("x"))
    two = whole.select(F.col("unit").alias("unit_b"), F.col("id").alias("y"))
    across = same.join(one.hint("merge"), "unit_a").join(two.hint("merge"), "unit_b").where((F.col("x") < F.col("y")) | ((F.col("unit_a") != F.col("unit_b")) & (F.col("x") != F.col("y"))))
    return across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _groups(batches, key: str):
    """Rows (as tuples) of sorted batches, key by key."""
    held, last = [], None
    for batch in batches:
        keys = batch.column(key).to_pylist() if isinstance(key, str) else None
        for k, row in zip(keys, zip(*[c.to_pylist() for c in batch.columns])):
            if k != last and held:
                yield held
                held = []
            last = k
            held.append(row)
    if held:
        yield held


def _crowded(ws: Workspace, large: DataFrame, parts: int, n_rows: int, n_bands: int, cell: int, links_of, pairs, accept: float, batched, form: str) -> DataFrame:
    """As the small groups, for groups too large for one place: sent by bands, cells of what shares a band compared apart,
    and stars found in rounds over all links."""

    def band(batches):
        forms, bands = Forms(pairs), Bands(n_rows, n_bands)
        for batch in batches:
            who, keys = [], []
            for n, (place, *r) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                e = Entry(*r)
                if e.ids > 1 and score(e.readings, e.readings, forms) >= accept:
                    who.append(n)
                    keys.append(e.unit)
                mine = {hash((place, k)) for t in e.stems for k in bands.of(t).tolist()}
                who += [n] * len(mine)
                keys += list(mine)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *batch.select(batch.schema.names[1:]).take(pa.array(who, pa.int64())).columns], names=["key", *batch.schema.names[1:]])

    banded = ws.save(large.repartition(parts).mapInArrow(band, f"key bigint, {ENTRY}"), "banded")
    alone = banded.where("key = unit").select(F.lit(False).alias("link"), F.col("unit").alias("unit_a"), F.col("unit").alias("unit_b"), F.lit(1.0).alias("score"))
    many = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("chunks"))
    cells = banded.join(many.hint("merge"), "key").withColumn("mine", F.pmod(F.xxhash64("unit"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    cells = cells.withColumn("cell", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("across", F.col("chunks") > 1)
    cells = cells.select("cell", "unit", "given", "surname", "others", "sex", "ids", "mine")

    def compare(batches):
        forms = Forms(pairs)
        for rows in _groups(batches, "cell"):
            group, chunk = [Entry(*r[1:7]) for r in rows], [r[7] for r in rows]
            one = len(set(chunk)) == 1
            # two chunks are compared across, each with itself in a cell of its own
            met = [(i, j) for i in range(len(group)) for j in range(i + 1, len(group)) if one or chunk[i] != chunk[j]]
            yield [(True, *sorted((group[i].unit, group[j].unit)), s) for (i, j), s in links_of(group, met, forms).items() if group[i].unit != group[j].unit]

    linked = cells.repartition(parts * 4, "cell").sortWithinPartitions("cell").mapInArrow(batched(compare), form)
    links = ws.save(linked.select("unit_a", "unit_b").distinct(), "links")
    covered = stars(ws, links)
    sex = lambda n: large.select(F.col("unit").alias(f"unit_{n}"), F.col("sex").alias(f"x{n}"))
    apart = F.col("xa").isin("M", "F") & F.col("xb").isin("M", "F") & (F.col("xa") != F.col("xb"))
    kept = covered.join(sex("a").hint("merge"), "unit_a").join(sex("b").hint("merge"), "unit_b").where(~F.coalesce(apart, F.lit(False)))
    return alone.unionByName(kept.select(F.lit(False).alias("link"), "unit_a", "unit_b", F.lit(1.0).alias("score")))


def stars(ws: Workspace, links: DataFrame, most: int = 200) -> DataFrame:
    """(unit_a, unit_b) that lie in one star, as star_cover, in rounds: whoever is in no star yet and has more links than
    all such neighbours (ties by hash) becomes a centre; its star holds all its neighbours."""
    ends = ws.save(links.select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b")).unionByName(links.select(F.col("unit_b").alias("a"), F.col("unit_a").alias("b"))), "ends")
    weight = F.struct(F.count("*").alias("n"), F.expr("shiftrightunsigned(xxhash64(a), 1)").alias("t"))
    free = ws.save(ends.groupBy("a").agg(weight.alias("w")), "free0")
    centres = []
    for k in range(most):
        if free.isEmpty():
            break
        near = free.select(F.col("a").alias("b"), F.col("w").alias("v"))
        best = ends.join(free, "a").join(near, "b").groupBy("a").agg(F.max("v").alias("v"))
        centre = ws.save(free.join(best, "a", "left").where("v is null or w > v").select("a"), f"centre{k}")
        centres.append(centre)
        taken = centre.unionByName(ends.join(centre, "a", "left_semi").select(F.col("b").alias("a"))).distinct()
        free = ws.save(free.join(taken, "a", "left_anti"), f"free{k + 1}")
    if not centres:
        return links.select("unit_a", "unit_b")
    every = centres[0]
    for c in centres[1:]:
        every = every.unionByName(c)
    star = ws.save(ends.join(every, "a", "left_semi").select(F.col("a").alias("centre"), F.col("b").alias("u")).unionByName(every.select(F.col("a").alias("centre"), F.col("a").alias("u"))), "star")
    x, y = star.select("centre", F.col("u").alias("unit_a")), star.select("centre", F.col("u").alias("unit_b"))
    return x.join(y, "centre").where("unit_a < unit_b").select("unit_a", "unit_b").distinct()
