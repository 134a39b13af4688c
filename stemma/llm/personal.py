"""Personal information inside free text: found, named by kind, and replaced by typed placeholders.

Generators propose spans generously: addresses of mail, numbers that look like telephones or identity numbers,
streets with a number or a box, and sequences of words that could be a name. Boosted trees score each proposal
from its format, from word lists and from the words beside it; of overlapping proposals the best one above
its kind's threshold stays. The trees are fitted on proposals from a bounded sample (SEED_DOCUMENTS texts of at most
SEED_CHARS characters) that are labelled by seed rules sure enough either way, and on copies of these texts with
known items planted in them; thresholds are set on held-out plants. Word lists are counted over all rows of the given tables into hashed tables of fixed size.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.names import COMMON_SHORT, contained
from stemma.plans.workspace import cores, spread

KINDS = ("email", "phone", "id_number", "street_address", "name")
SEED_DOCUMENTS, SEED_CHARS, BUCKETS = 3000, 20_000, 1 << 20
#: Rows of the tables of people (given names, surnames), places and documents up to which words are counted as they
#: are; the counts of larger tables are brought to these sizes, so that what is compared with a count is a share.
COUNTED_ROWS = (1_000_000, 1_000_000, 3_000, 10_000)
TREES, DEPTH, RATE = 40, 3, 0.3

S = r"[^\S\r\n]"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+\-]*{S}?(?:@|\(at\)|\[at\]|\{{at\}}){S}?[A-Za-z0-9][\w\-]*(?:(?:\.|{S}?(?:\[dot\]|\(dot\)|\{{dot\}}){S}?)[A-Za-z][\w\-]*)+", re.I)
AT = re.compile(r"[(\[{]at[)\]}]", re.I)
#: What every alternative begins with is asked first, which spares most places of a text the rest.
PHONE = re.compile(rf"(?=[+(\d])(?<![\w.+/\-])(?:\+\d{{1,3}}[\s.\-]?(?:\(0\){S}?)?(?:\(?\d{{2,5}}\)?[  .\-]?)(?:\d{{2,5}}[  .\-]?){{0,3}}\d{{2,4}}|\(?\d{{3}}\)?[  .\-]\d{{3}}[  .\-]\d{{4}}|0\d{{2,5}}[  ./\-]?\d{{3}}[  .\-]?\d{{3,4}}|\d{{3}}[\-.]\d{{4}})(?:,?{S}?(?:ext\.?|x){S}?\d{{1,5}})?(?![\w\-]|[./]\d)")
NUMBER = re.compile(rf"(?=[A-Z\d])(?<![\w@/.\-])(?:[A-Z]{{1,3}}(?:[  \-]?\d{{1,6}}){{1,4}}(?:[  \-]?[A-Z])?|\d{{3}}[  \-]\d{{2}}[  \-]\d{{4}}|\d{{6}}-\d{{4,5}}|\d(?:[  ]\d{{3}}){{2,}}|\d{{4}}-\d{{2}}(?:-\d{{2}})?)(?![\w\-/]|\.\d)")
#: The ways in which identity numbers are written: groups of letters and digits.
ID_SHAPES = [r"[A-Z]{2}(?: ?\d\d){3} ?[A-D]", r"[A-Z]-\d{4}-\d{2}-[A-Z]", r"\d{3}[- ]\d{2}[- ]\d{4}", r"[A-Z]{3} ?\d{3} ?\d{3} ?\d{3}", r"\d{6}-\d{5}", r"[A-Z]{2}\d{7}"]
ID_SHAPE = re.compile("|".join(f"(?:{s})" for s in ID_SHAPES))
ID_NUMBER = re.compile(rf"(?=[A-Z\d])(?<![\w@/.\-])(?:{ID_SHAPE.pattern.replace(' ?', '[  ]?').replace('[- ]', '[-  ]')})(?![\w\-/]|\.\d)")
#: Street types in three languages and their abbreviations.
TYPES = "Street|St|Str|Road|Rd|Lane|La|Ln|Court|Ct|Crt|Place|Pl|Avenue|Ave|Av|Square|Sq|Terrace|Terr|Ter|Tce|Drive|Dr|Close|Row|Way|Crescent|Cres|Boulevard|Blvd"
UNIT = rf"(?:Flat|Apt|Unit|Apartment|Suite|Room|No){S}?\.?{S}?\d+[a-z]?,?{S}+"
WORD = r"[A-ZÀ-Þ][\w'’]+"
STREET = re.compile(
    rf"(?=[\dA-ZÀ-Þ])(?:(?:{UNIT})?(?<![\w.,/\-])(?<!\d )\d{{1,4}}[a-z]?,?{S}+(?:{WORD}{S}+){{1,3}}?(?:{TYPES})\b(?:\.(?!\w))?"
    rf"|(?:{UNIT})?{WORD}(?:{S}+{WORD})?{S}+(?:{TYPES})\b\.?{S}+(?:No\.{S}?)?\d{{1,4}}[a-z]?(?![\w/\-])"
    rf"|P\.?{S}?O\.?{S}?Box{S}+\d+|(?:Postfach|B\.?P\.?){S}+\d+"
    rf"|\b[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm|graben|markt){S}+\d{{1,4}}{S}?[a-z]?\b"
    rf"|\b(?:Am|An der|Im|In der|Zum|Zur){S}+[A-ZÄÖÜ][\wäöüß]+{S}+\d{{1,4}}[a-z]?\b"
    rf"|\b\d{{1,4}}(?:{S}?(?:bis|ter|[a-z]))?,?{S}+(?:rue|avenue|chemin|place|boulevard|impasse|quai|allée|route|passage|cours){S}+(?:(?:de la|du|des|de|de l['’]|d['’]|l['’]){S}*)?[\w'’\-]+(?:{S}+[A-ZÀ-Þ][\w'’\-]+)?)"
)
#: White space that may stand inside a name: without and with the narrow kinds.
WHITE, WHITE_LINE = " \u00a0\u200b\t", " \u00a0\u200b\t\u2009\u202f\ufeff"
WEB = re.compile(r"(?:https?://|www\.)\S+")
DIGIT = re.compile(r"\d")
TOKEN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĀ-ž]+(?:['’\-][A-Za-zÀ-ÖØ-öø-ÿĀ-ž]+)*")
TITLES = {"mr", "mrs", "miss", "ms", "dr", "rev", "capt", "sir", "mme", "mlle", "m", "herr", "frau", "abbé", "l'abbé", "l’abbé", "widow", "frl", "lady", "prof", "sgt", "lt", "col", "maj", "pfarrer", "fräulein", "dame"}
SHIPS = {"brig", "ship", "schooner", "barque", "bark", "steamer", "sloop", "vessel", "boat", "hms", "ss"}
HOUSES = {"hall", "house", "lodge", "manor", "farm", "mill", "cottage", "inn", "grange", "abbey", "castle", "parish", "chapel", "church", "street", "lane", "road", "court", "place", "square", "terrace", "avenue", "county"}
MONTHS = {"may", "april", "june", "august", "march", "mai", "juni", "jan", "avril", "juin"}
GREETINGS = {"dear", "cher", "chère", "liebe", "lieber", "looking", "signed", "witnesses", "passport", "yours", "the", "and", "from", "child", "bapt", "ever"}
TAGS = {"name", "indi", "birt", "deat", "plac", "date", "sour", "note", "resi", "famc", "fams", "husb", "wife", "chil", "page"}
PARTICLES = {"van", "von", "de", "der", "den", "du", "la", "le"}
PLACE_CUES = {"at", "in", "near", "from", "of", "behind", "beyond", "inside", "under", "above", "along", "bei", "aus", "nach", "in", "à"}


def bucket(word: str) -> int:
    import xxhash

    # as Spark's xxhash64 of the same string
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), seed=42) & (BUCKETS - 1)


@lru_cache(maxsize=20_000)
def contraction(word: str) -> bool:
    """Whether a word can be a written contraction of a common given name."""
    return len(word) >= 2 and any(f[0] == word[0] and len(word) < len(f) and contained(word, f) for f in COMMON_SHORT)


class Memo(dict):
    """A function of one string, remembered; emptied at a bound, since a worker may see any number of words."""

    def __init__(self, of, most: int = 300_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str):
        if len(self) > self.most:
            self.clear()
        got = self[word] = self.of(word)
        return got


class Lists:
    """How many rows hold a word as a given name, a surname, a place, or in lower case in a text: one byte a bucket, up to 255."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables
        self.known = Memo(lambda word: tuple(map(int, self.tables[:, bucket(word)])))
        self.of = self.known.__getitem__
        self.low = Memo(lowered)
        #: whether a name can begin with a token; most tokens of a text are a few common words
        self.start = Memo(self._start)
        self.given = Memo(self._given)

    def _start(self, token: str) -> bool:
        w = lowered(token)
        g, f, p, c = self.of(w)
        if len(w) == 1:
            return token.isupper()
        if w in PARTICLES or (g >= 3 and g > f):
            return True
        if len(w) == 2:
            # no list has it: at most a contraction with a full stop
            return token[0].isupper() and contraction(w)
        return token[0].isupper() and w not in TITLES and (f >= 2 or (c < 8 and p < 3))

    def _given(self, word: str) -> bool:
        g, f, *_ = self.of(word)
        return g >= 3 and g > f and word not in TITLES


def word_lists(documents: DataFrame, individuals: DataFrame, name_forms: DataFrame, places: DataFrame, text: str = "text") -> Lists:
    """Counted over all rows, by kind and bucket, and brought to COUNTED_ROWS: at most 4 * BUCKETS small rows come to the driver."""

    part = lambda df, c, kind: df.where(F.col(c).isNotNull()).select(F.lit(kind).cast("int").alias("kind"), F.lower(c).alias("w"))
    cut = lambda df: df.withColumn("w", F.explode(F.regexp_extract_all("w", F.lit(r"(?U)([^\s,()./;]+)"), 1)))
    rows = cut(part(individuals, "given_name", 0)).unionByName(part(individuals, "surname", 1)).unionByName(cut(part(places, "original", 2)))
    forms = part(name_forms, "formal", 0).unionByName(part(name_forms, "short_form", 0))
    more = [(w,) for formal, short in COMMON_SHORT.items() for w in (formal, *short.split())]
    forms = cut(forms.unionByName(part(documents.sparkSession.createDataFrame(more, "more string"), "more", 0)))
    rows = rows.unionByName(forms.withColumn("w", F.explode(F.array_repeat("w", 6)))).withColumn("w", F.btrim("w", F.lit(".'’ "))).where(F.length("w") > 1)
    in_bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    counted = rows.groupBy("kind", in_bucket).agg(F.count("*").alias("n"))
    plain = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}'])(\p{Ll}{3,})"), 1))).alias("w"))
    plain = plain.groupBy(F.lit(3).alias("kind"), in_bucket).agg(F.count("*").alias("n"))
    people = individuals.count()
    scale = [max(1.0, n / most) for n, most in zip((people, people, places.count(), documents.count()), COUNTED_ROWS)]
    share = F.floor(F.col("n") / F.element_at(F.array(*map(F.lit, scale)), F.col("kind") + 1))
    counted = counted.unionByName(plain).select("kind", "bucket", F.least(share, F.lit(255)).cast("int").alias("n")).where("n > 1").toPandas()
    tables = np.zeros((4, BUCKETS), np.uint8)
    tables[counted.kind.to_numpy(), counted.bucket.to_numpy()] = counted.n.to_numpy()
    return Lists(tables)


def lowered(token: str) -> str:
    w = token.lower().replace("’", "'")
    return w[:-2] if w.endswith("'s") else w


class Span:
    __slots__ = ("start", "end", "kind", "form", "words")

    def __init__(self, start, end, kind, form, words=()):
        self.start, self.end, self.kind, self.form, self.words = start, end, kind, form, words


def propose(text: str, lists: Lists) -> list[Span]:
    out = [Span(m.start(), m.end(), 0, 0) for m in EMAIL.finditer(text)] if "@" in text or AT.search(text) else []
    shut = [(s.start, s.end) for s in out] + [(m.start(), m.end()) for m in WEB.finditer(text)]
    free = lambda a, b: all(b <= x or a >= y for x, y in shut)
    if DIGIT.search(text):
        out += [Span(m.start(), m.end(), 1, 1) for m in PHONE.finditer(text) if free(m.start(), m.end())]
        out += [Span(m.start(), m.end(), 2, 2) for m in ID_NUMBER.finditer(text) if free(m.start(), m.end())]
        sure = [(s.start, s.end) for s in out if s.kind == 2]
        out += [Span(m.start(), m.end(), 2, 20) for m in NUMBER.finditer(text) if free(m.start(), m.end()) and all(m.end() <= x or m.start() >= y for x, y in sure)]
        out += [Span(m.start(), m.end(), 3, 3) for m in STREET.finditer(text) if free(m.start(), m.end())]
    streets = [(s.start, s.end) for s in out if s.kind == 3]
    tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
    n = len(tokens)
    known = lists.low
    low = [known[t] for t, _, _ in tokens]

    def tight(k: int) -> bool:
        """Whether nothing but white space stands between the tokens k and k + 1."""
        if k + 1 >= n:
            return False
        gap = text[tokens[k][2] : tokens[k + 1][1]]
        return gap == " " or (gap != "" and not gap.strip(WHITE_LINE))

    def after_mark(k: int, mark: str) -> str | None:
        """What follows the mark right after the token k up to the next one, if only that stands between them."""
        if k + 1 >= n or text[tokens[k][2]] != mark:
            return None
        gap = text[tokens[k][2] + 1 : tokens[k + 1][1]]
        return None if gap.strip(WHITE) else gap

    dotted = lambda k: after_mark(k, ".") is not None
    comma = lambda k: bool(after_mark(k, ","))
    dated = lambda k: bool(re.search(r"\d\W*$", text[max(0, tokens[k][1] - 4) : tokens[k][1]]) or re.match(r"\W{0,2}\d", text[tokens[k][2] : tokens[k][2] + 3]))

    givens = lists.given
    given = lambda k: givens[low[k]] and not (low[k] in MONTHS and dated(k))

    upper = lambda k: tokens[k][0][0].isupper()
    initial = lambda k: len(low[k]) == 1 and tokens[k][0].isupper()
    owned = lambda k: tokens[k][0].replace("’", "'").lower().endswith("'s")

    def end_of(k: int) -> int:
        return tokens[k][2] - 2 if owned(k) else tokens[k][2]

    def family(k: int) -> int:
        """Number of tokens of a surname at k, 0 if there is none."""
        j = k
        while j < n and low[j] in PARTICLES and tight(j) and j < k + 3:
            j += 1
        if j >= n or len(low[j]) < 3 or low[j] in TITLES:
            return 0
        g, f, p, _ = lists.of(low[j])
        known = f if f >= g else 0
        if j > k:
            whole = lists.of(" ".join(low[k : j + 1]))
            known = max(known, whole[1] if whole[1] >= whole[0] else 0)
        if known >= 2 or (k and not upper(j) and given(k - 1) and not upper(k - 1) and len(low[j]) >= 5 and lists.of(low[j])[3] < 8 and not p >= 3) or (upper(j) and low[j] not in TAGS and not p >= 3 and len(low[j]) >= 4):
            return j - k + 1
        return 0

    def given_run(k: int) -> int:
        """Number of tokens of given names and initials at k."""
        j = k
        while j < n and j < k + 5:
            if given(j) and (upper(j) or tokens[j][0].islower()):
                if owned(j):
                    return j - k + 1
                j += 1
                if not (tight(j - 1) or dotted(j - 1)):
                    break
            elif initial(j) and (dotted(j) or (tight(j) and j > k)):
                j += 1
            else:
                break
        return j - k

    i = 0
    start = lists.start
    for k in [k for k, t in enumerate(tokens) if start[t[0]]]:
        if k < i:
            continue
        i, (_, a, b) = k, tokens[k]
        titled = i > 0 and low[i - 1] in TITLES
        if not (upper(i) or given(i) or (titled and low[i] in PARTICLES)) or (shut and not free(a, b)) or (streets and any(x <= a < y for x, y in streets)):
            i += 1
            continue
        g = given_run(i) if given(i) or initial(i) else 0
        if g and (tight(i + g - 1) or dotted(i + g - 1)) and not owned(i + g - 1):
            f = family(i + g)
            if f and (upper(i) or upper(i + g + f - 1) or lists.of(low[i])[0] >= 3):
                last = i + g + f - 1
                out.append(Span(a, end_of(last), 4, 10, (i, last)))
                i = last + 1
                continue
        if g and i + g < n and text[tokens[i + g - 1][2] : tokens[i + g][1]] in (" /", "/") and (m := re.compile(r"/(\w[^/\n]{0,38}\w)/").match(text, tokens[i + g - 1][2] + text[tokens[i + g - 1][2] :].find("/"))):
            out.append(Span(a, m.end(), 4, 15, (i, i + g)))
            while i < n and tokens[i][1] < m.end():
                i += 1
            continue
        if not g and upper(i) and (tight(i) or (dotted(i) and contraction(low[i]))) and not owned(i) and (3 if tight(i) else 2) <= len(low[i]) <= 10 and low[i] not in GREETINGS and not tokens[i][0].isupper() and low[i] not in TITLES and low[i] not in TAGS and lists.of(low[i])[3] < 8 and lists.of(low[i])[2] < 3 and lists.of(low[i])[1] < 2:
            # a given name no list has, before a known surname
            f = family(i + 1)
            if f and max(lists.of(" ".join(low[i + 1 : i + 1 + f]))[1], lists.of(low[i + f])[1]) >= 2:
                out.append(Span(a, end_of(i + f), 4, 16, (i, i + f)))
                i += f + 1
                continue
        f = family(i) if not g or lists.of(low[i])[1] > lists.of(low[i])[0] else 0
        if f:
            last = i + f - 1
            if (comma(last) or tight(last)) and not owned(last):
                h = given_run(last + 1)
                shout = tokens[last][0].isupper() or tokens[last][0][:2] in ("O'", "Ma", "Mc")
                if h and (comma(last) or shout or lists.of(low[last])[1] >= 3) and any(given(k) for k in range(last + 1, last + 1 + h)):
                    end = last + h
                    stop = end_of(end)
                    if initial(end) and dotted(end) or (initial(end) and text[stop : stop + 1] == "."):
                        stop += 1
                    out.append(Span(a, stop, 4, 11 if comma(last) else 12, (i, end)))
                    i = end + 1
                    continue
            out.append(Span(a, end_of(last), 4, 13, (i, last)))
            i = last + 1
            continue
        if g and any(given(k) for k in range(i, i + g)):
            last = i + g - 1
            stop = end_of(last)
            if initial(last) and text[stop : stop + 1] == ".":
                stop += 1
            if upper(i):
                out.append(Span(a, stop, 4, 14, (i, last)))
            i += g
            continue
        i += 1
    for s in out:
        if s.kind == 4:
            k, e = s.words
            before = low[k - 1] if k and "\n" not in text[tokens[k - 1][2] : tokens[k][1]] else ""
            after = low[e + 1] if tight(e) else ""
            if k == e:
                s.words = (before, after, *lists.of(low[k])[:3], 1)
                continue
            best = [lists.of(v) for v in low[k : e + 1]]
            whole = lists.of(" ".join(low[k : e + 1]))
            s.words = (before, after, max(x[0] for x in best), max(max(x[1] for x in best), whole[1]), max(x[2] for x in best), e - k + 1)
        else:
            left = TOKEN.findall(text[max(0, s.start - 40) : s.start])
            right = TOKEN.findall(text[s.end : s.end + 20])
            s.words = (left[-1].lower() if left else "", right[0].lower() if right else "", 0, 0, 0, 1)
    return out


def _cue(word: str) -> int:
    return bucket(word) & 255 if word else 256


CUES = {
    1: {"tel", "ring", "is", "telefon", "tél", "phone", "call", "to", "or"}, 2: {"passport", "id", "number", "nr", "identité", "no", "ausweis", "card"},
    3: {"at", "to", "wohne", "habite", "lives", "went", "contact"},
}
NOT_PERSONAL = re.compile(r"(?:film|ms|lot|dated|price|lies at)\W*$")
FIRM = re.compile(r"\s*(?:&|and|und|et)\s*(?:Sons|Co|Bros|Söhne|Fils)\b")
AGAINST = {"film", "ms", "lot", "price", "dated", "number", "call", "entry", "fol", "record", "vol", "page", "p"}


def features(text: str, s: Span) -> list[float]:
    before, after, g, f, p, count = s.words
    surface = text[s.start : s.end]
    name = s.kind == 4
    near = text[max(0, s.start - 24) : s.start].lower() if not name or before == "of" else ""
    follow = text[s.end : s.end + 8]
    # a name's tokens are letters; only one between strokes may hold other signs
    digits = sum(map(str.isdigit, surface)) if not name or s.form == 15 else 0
    shape = not name and ID_SHAPE.fullmatch(surface.replace("\u00a0", " ")) is not None
    title = before.strip(".") in TITLES
    return [
        s.kind, s.form, len(surface), digits, float(shape), float(surface[:1] in "+0("), float(before in CUES.get(s.kind, ())), float(before in AGAINST or (s.kind != 4 and bool(NOT_PERSONAL.search(near)))),
        float(title), float(before in SHIPS), float(after in HOUSES), float(s.kind == 4 and bool(FIRM.match(text, s.end))), min(g, 20), min(f, 20), min(p, 20), count,
        float(surface[:1].isupper()), float(surface.isupper()), float(before in PLACE_CUES), float(follow[:2] in ("'s", "’s")), float(before == "of" and "firm" in near), float(bool(after) and after in ("who", "was", "sailed", "lost")), float(before in ("saint", "mount", "fort", "north", "south", "east", "west", "great", "little", "upper")),
    ]


def seed(text: str, s: Span, x: list[float]) -> int | None:
    """1 or 0 where the rules are sure, else None."""
    before, after, g, f, p, count = s.words
    if s.kind == 0:
        return 1
    if x[7]:
        return 0
    if s.kind == 1:
        return 1 if x[6] or x[5] else None if x[3] >= 10 else 1 if re.search(r"(tel|number is|ring)\W*$", text[max(0, s.start - 14) : s.start].lower()) else None
    if s.kind == 2:
        return 1 if x[4] else 0
    if s.kind == 3:
        return 1
    if x[9] or x[10] or x[11] or x[20] or x[22]:
        return 0
    if s.form == 10:
        return 1 if (g >= 5 and f >= 2) or (f >= 3 and p < 3) else None
    if s.form in (11, 12):
        return 1 if g >= 5 and f >= 2 else None
    if s.form == 15:
        return 1
    if s.form == 16:
        return 1 if f >= 4 else None
    if s.form == 13:
        return (1 if f >= 2 else None) if x[8] else 0
    return 1 if g >= 5 and x[16] and count == 1 and (x[19] or before in ("dear", "for", "of", "was", "were", "think", "regret", "registre", "to", "before", "signed")) else None


class Trees:
    """Boosted trees of small depth on binned features, logistic loss."""

    def __init__(self):
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.edges: list[np.ndarray] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:])) if len(np.unique(c)) > 16 else np.unique(c)[1:] for c in x.T]
        b, width = self._bin(x), 20
        rate = y.mean() if 0 < y.mean() < 1 else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        at = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-at))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feat, cut = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1, np.int64)
            for d in range(DEPTH):
                first, many = 2**d - 1, 2**d
                best = np.full(many, 1e-6)
                for j in range(x.shape[1]):
                    key = (node - first) * width + b[:, j]
                    gs = np.bincount(key, g, many * width).reshape(many, width).cumsum(1)
                    hs = np.bincount(key, h, many * width).reshape(many, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    k = gain.argmax(1)
                    v = gain[np.arange(many), k]
                    better = v > best
                    best[better] = v[better]
                    feat[first : first + many][better], cut[first : first + many][better] = j, k[better]
                f = feat[node]
                right = (f >= 0) & (b[np.arange(len(y)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.trees.append((feat, cut, value))
            at += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._bin(x)
        at = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feat[node]
                node = 2 * node + 1 + ((f >= 0) & (b[rows, np.maximum(f, 0)] > cut[node]))
            at += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-at))


class Finder:
    def __init__(self, lists: Lists, trees: Trees | None, least: dict[int, float]):
        self.lists, self.trees, self.least = lists, trees, least

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the items, in order, not overlapping."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """As find, for many texts, whose proposals are scored together."""
        spans = [propose(t, self.lists) if t else [] for t in texts]
        x = [features(t, s) for t, many in zip(texts, spans) for s in many]
        score = self.trees.predict(np.array(x, float)) if self.trees and x else np.ones(len(x))
        out, at = [], 0
        for many in spans:
            good = sorted((s.kind == 4, s.start - s.end, -p, s.start, s.end, s.kind) for s, p in zip(many, score[at : at + len(many)].tolist()) if p >= self.least.get(s.kind, 0.5))
            at += len(many)
            taken: list[tuple[int, int, int]] = []
            for _, _, _, a, b, kind in good:
                if all(b <= x or a >= y for x, y, _ in taken):
                    taken.append((a, b, kind))
            out.append([(a, b, KINDS[k]) for a, b, k in sorted(taken)])
        return out


def planted(text: str, spans: list[Span], lists: Lists, people: list[tuple[str, str]], towns: list[str], rng: np.random.Generator) -> list[tuple[list[float], int, int]]:
    """(features, label, kind) of proposals in a copy of the text in which some items were exchanged: names that the seed
    rules are sure of by a person's name in another order or style, or by a town, a house, a firm or a ship named like a
    person; numbers by an invented telephone or identity number, or by a lot, film or page. What was planted is known,
    so these labels do not come from the features: of the proposals that touch a plant, 1 is the plant of its kind
    from end to end, 0 is any other."""
    chosen, last = [], -1
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        if s.start > last and rng.random() < 0.5 and s.kind in (1, 2, 4) and seed(text, s, features(text, s)) == 1:
            chosen.append(s)
            last = s.end + 1
    if not chosen:
        return []
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    parts, plants, at, size = [], [], 0, 0
    for s in chosen:
        given, family = people[rng.integers(len(people))]
        one, real = given.split()[0], rng.random() < 0.7
        if s.kind == 4 and real:
            put = [f"{given} {family}", f"{family}, {given}", f"{family.upper()} {given}", f"{one[0]}. {family}", f"{one} {family[0].upper()}. {family}"][rng.integers(5)]
        elif s.kind == 4:
            town = towns[rng.integers(len(towns))]
            put = [town, f"{family} Hall", f"{family} & Sons", f"{given} {family} Lane", f"{town} House", f"{family} County"][rng.integers(6)]
        elif s.kind == 1:
            put = f"({digits(3)}) 555-{digits(4)}" if real else [f"lot {digits(3)}-{digits(4)}", f"film {digits(1)} {digits(3)} {digits(3)}", f"MS {digits(2)}/{digits(4)}"][rng.integers(3)]
        else:
            put = f"{digits(3)}-{digits(2)}-{digits(4)}" if real else [f"film {digits(7)}", f"fol. {digits(3)}", f"MS {digits(4)}-{digits(2)}"][rng.integers(3)]
        before = text[at : s.start]
        parts += [before, put]
        size += len(before)
        plants.append((size, size + len(put), s.kind if real else -1))
        size, at = size + len(put), s.end
    copy = "".join(parts) + text[at:]
    out = []
    for s in propose(copy, lists):
        met = [p for p in plants if s.start < p[1] and s.end > p[0]]
        if met:
            # a name's plant may lack the full stop of an initial, as any item
            out.append((features(copy, s), int(len(met) == 1 and met[0] == (s.start, s.end, s.kind)), s.kind))
    return out


def train(texts: list[str], lists: Lists, people: list[tuple[str, str]] = (), towns: list[str] = (), precise: float = 0.98, report: dict | None = None) -> Finder:
    """Trees on seed-labelled proposals and on planted ones; of each kind the least threshold that keeps the precision
    on held-out plants (seeds, where none of a kind was planted), and if none does the one of the highest precision.

    report: gets (plants, precision, recall, threshold) of the held-out plants of each kind.
    """
    rng = np.random.default_rng(13)
    xs, ys, kinds, source = [], [], [], []
    for t in texts:
        spans = propose(t, lists)
        rows = [(x, y, s.kind, 0) for s in spans if (y := seed(t, s, x := features(t, s))) is not None]
        if people and towns:
            rows += [(*r, 1) for r in planted(t, spans, lists, people, towns, rng)]
        for x, y, k, by in rows:
            xs.append(x)
            ys.append(y)
            kinds.append(k)
            source.append(by)
    if len(set(ys)) < 2:
        return Finder(lists, None, {})
    x, y, kinds_, by = np.array(xs, float), np.array(ys, float), np.array(kinds), np.array(source)
    held = np.arange(len(y)) % 5 == 0
    trees = Trees().fit(x[~held], y[~held])
    p = trees.predict(x[held])
    least = {}
    for k in range(len(KINDS)):
        mine = (kinds_[held] == k) & (by[held] == 1)
        if not mine.any():
            mine = kinds_[held] == k
        q, truth = p[mine], y[held][mine]
        precision = {float(c): truth[q >= c].mean() for c in np.arange(0.1, 0.96, 0.05) if (q >= c).any()}
        good = [c for c, v in precision.items() if v >= precise]
        least[k] = min(good) if good else max(precision, key=precision.get) if precision else 0.5
        if report is not None and mine.any() and truth.any():
            report[KINDS[k]] = (int(mine.sum()), float(precision.get(least[k], 0.0)), float((q[truth == 1] >= least[k]).mean()), least[k])
    return Finder(lists, trees, least)


def finder(documents: DataFrame, individuals: DataFrame, name_forms: DataFrame, places: DataFrame, key: str = "doc_id", text: str = "text", report: dict | None = None) -> Finder:
    """Lists counted over all rows, trees and thresholds fitted on a sample: SEED_DOCUMENTS texts, and as many people and
    places for the plants, taken by hash."""
    lists = word_lists(documents, individuals, name_forms, places, text)
    sample = lambda df, *by: df.withColumn("_h", F.xxhash64(*by, F.lit(3))).orderBy("_h").limit(SEED_DOCUMENTS).collect()
    rows = sample(documents.where(F.col(text).isNotNull() & (F.length(text) <= SEED_CHARS)).select(F.col(text).alias("t"), F.col(key).alias("k")), "k")
    simple = F.col("given_name").rlike(r"^[A-Z][a-z]+( [A-Z][a-z]+)?$") & F.col("surname").rlike(r"^(van |de |von )?[A-Z][a-z]{3,}$")
    people = sample(individuals.where(simple).select("given_name", "surname"), "given_name", "surname")
    towns = [t for r in sample(places.where("original is not null").select("original"), "original") if re.fullmatch(r"[A-Z][a-z]{3,}( [A-Z][a-z]+)?", t := r["original"].split(",")[0].strip())]
    return train([r["t"] for r in rows], lists, [(r["given_name"], r["surname"]) for r in people], towns, report=report)


def _in_parts(use: Finder, texts: list[str | None], chars: int = 2_000_000):
    """Items of each text, some texts at a time, so that proposals of very long texts do not pile up."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > chars:
            yield from use.find_all(part)
            part, size = [], 0
    yield from use.find_all(part)


def find_items(documents: DataFrame, found_by: Finder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, surface): each distinct item of each document, exactly as in its text. Null and empty texts have none."""
    df = spread(documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t")), cores(documents.sparkSession))
    model = df.sparkSession.sparkContext.broadcast((found_by.lists.tables, found_by.trees, found_by.least))

    def run(batches):
        tables, trees, least = model.value
        use = Finder(Lists(tables), trees, least)
        for batch in batches:
            rows, kinds, surfaces = [], [], []
            texts = batch.column(1).to_pylist()
            for n, (t, items) in enumerate(zip(texts, _in_parts(use, texts))):
                for kind, surface in dict.fromkeys((k, t[a:b]) for a, b, k in items):
                    rows.append(n)
                    kinds.append(kind)
                    surfaces.append(surface)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(surfaces, pa.string())], names=[key, "kind", "surface"])

    return df.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, surface string")


def redact(documents: DataFrame, found_by: Finder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the text with [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS] and [NAME] in the items' stead.
    Null stays null, empty stays empty; every row gives one row."""
    df = spread(documents.select(F.col(key), F.col(text).alias("_t")), cores(documents.sparkSession))
    model = df.sparkSession.sparkContext.broadcast((found_by.lists.tables, found_by.trees, found_by.least))

    def run(batches):
        tables, trees, least = model.value
        use = Finder(Lists(tables), trees, least)
        for batch in batches:
            out = []
            texts = batch.column(1).to_pylist()
            for t, items in zip(texts, _in_parts(use, texts)):
                parts, at = [], 0
                for a, b, kind in items:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                out.append(None if t is None else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return df.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
