"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of the place rules: all Unicode spaces, not only ASCII ones.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

#: Replacements of the place rules, as substrings and in this order; place ids depend on them.
PLACE_REPLACEMENTS = [
    ("st.", "saint"), ("st ", "saint "), ("co.", "county"), ("co ", "county "), ("mt.", "mount"), ("mt ", "mount "),
    ("ft.", "fort"), ("ft ", "fort "), ("n.y.", "new york"), ("n.y", "new york"), ("nyc", "new york city"), ("l.a.", "los angeles"),
    ("d.c.", "district of columbia"), ("u.s.a.", "united states"), ("usa", "united states"), ("u.s.", "united states"),
    ("u.k.", "united kingdom"), ("uk", "united kingdom"),
]


def strip(s: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(s, "^" + SPACE, ""), SPACE + "$", "")


def normalize_place(s: Column) -> Column:
    """Lower case, replacements in order, single spaces. Null stays null."""
    replaced = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), PLACE_REPLACEMENTS, strip(F.lower(s)))
    return strip(F.regexp_replace(replaced, SPACE, " "))


def place_id(s: Column) -> Column:
    """First 12 hex digits of the MD5 of the normalised place."""
    return F.left(F.md5(normalize_place(s)), F.lit(12))


def year(s: Column) -> Column:
    """The first run of exactly four digits as a number; null if there is none."""
    return F.regexp_extract(s, r"\b(\d{4})\b", 1).try_cast("int")


def full_name(given: Column, surname: Column) -> Column:
    """The parts that are not empty, joined by one space."""
    return F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(surname, F.lit("")))


def place_components(s: Column) -> Column:
    """Parts between commas, stripped, the empty ones left out."""
    return F.filter(F.transform(F.split(s, ","), strip), lambda x: x != "")


def snippet(text: Column, query: str, context: int = 50) -> Column:
    """The text around the first match (any case) with the match in **, ellipses where it is cut; without a match
    the first hundred characters and an ellipsis."""
    at = F.instr(F.lower(text), F.lit(query.lower()))
    n = len(query)
    first = F.greatest(F.lit(1), at - context)
    head = F.substring(text, first, at - first)
    tail = F.substring(text, at + n, F.lit(context))
    cut = F.concat(
        F.when(first > 1, F.lit("...")).otherwise(F.lit("")), head, F.lit("**"), F.substring(text, at, F.lit(n)), F.lit("**"), tail,
        F.when(at + n - 1 + context < F.length(text), F.lit("...")).otherwise(F.lit("")),
    )
    return F.when(at > 0, cut).otherwise(F.concat(F.substring(text, 1, 100), F.lit("...")))


def vital_summary(birth_date: Column, birth_place: Column, death_date: Column, death_place: Column) -> Column:
    """'Born D in P. Died D in P.', the missing parts left out."""

    def part(verb: str, date: Column, place: Column) -> Column:
        d, p = F.nullif(date, F.lit("")), F.nullif(place, F.lit(""))
        words = F.concat_ws(" ", F.lit(verb), d, F.when(p.isNotNull(), F.concat(F.lit("in "), p)))
        return F.when(d.isNotNull() | p.isNotNull(), F.concat(words, F.lit(".")))

    return F.concat_ws(" ", part("Born", birth_date, birth_place), part("Died", death_date, death_place))


def century(y: Column) -> Column:
    return F.concat((F.floor(y / 100) * 100).cast("string"), F.lit("s"))


def lifespan_overlap(birth1: Column, death1: Column, birth2: Column, death2: Column, span: int = 80) -> Column:
    """Years both lived; a missing end is put 80 years from the other, null if both ends of one are missing."""
    b1, d1 = F.coalesce(birth1, death1 - span), F.coalesce(death1, birth1 + span)
    b2, d2 = F.coalesce(birth2, death2 - span), F.coalesce(death2, birth2 + span)
    # greatest and least skip nulls, so the nulls are kept by hand
    return F.when(b1.isNotNull() & b2.isNotNull(), F.greatest(F.lit(0), F.least(d1, d2) - F.greatest(b1, b2)))


#: Words for the first ordinals.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]


def ordinal(n: Column) -> Column:
    words = F.array(*[F.lit(w) for w in ORDINALS])
    return F.when(n.between(1, len(ORDINALS)), F.try_element_at(words, n.cast("int"))).otherwise(F.concat(n.cast("string"), F.lit("th")))


def _line_name(n: Column, near: str, far: str) -> Column:
    return F.when(n == 1, F.lit(near)).when(n == 2, F.lit(far)).when(n == 3, F.lit("great-" + far)).otherwise(F.concat(ordinal(n - 2), F.lit(" great-" + far)))


def ancestor_name(generation: Column) -> Column:
    return _line_name(generation, "parent", "grandparent")


def descendant_name(generation: Column) -> Column:
    return _line_name(generation, "child", "grandchild")


#: Words that mark an event as military wherever they occur inside its description or notes.
MILITARY = [
    "war", "military", "army", "navy", "marine", "marines", "soldier", "regiment", "corps", "veteran", "enlisted", "drafted", "served", "service", "wwi", "wwii", "ww1", "ww2", "civil war", "revolutionary",
    "infantry", "cavalry", "artillery", "battalion", "company", "brigade", "division", "air force", "airforce", "usaf", "usmc", "usn", "coast guard", "national guard", "pvt", "private", "corporal", "sergeant",
    "lieutenant", "captain", "major", "colonel", "general", "admiral", "seaman", "petty officer", "combat", "battle", "campaign", "deployment", "discharge", "honorable", "medal", "purple heart", "bronze star", "silver star",
]


def is_military(type_: Column, description: Column, notes: Column) -> Column:
    words = "|".join(MILITARY)
    hit = lambda c: F.lower(c).rlike(words)
    return type_.isin("MILT", "SERV", "_MILT", "_SERV") | F.coalesce(hit(description), F.lit(False)) | F.coalesce(F.exists(notes, lambda n: F.coalesce(hit(n), F.lit(False))), F.lit(False))


#: Places that have no coordinates.
NOWHERE = ["at sea", "on ship", "in transit", "unknown", "?", "", "n/a", "na", "none"]


def ungeocodable(place: Column) -> Column:
    return strip(F.lower(place)).isin(NOWHERE)


#: Former names and what they are called now.
HISTORICAL = [
    ("constantinople", "istanbul"), ("kristiania", "oslo"), ("petrograd", "saint petersburg"), ("leningrad", "saint petersburg"), ("saigon", "ho chi minh city"), ("bombay", "mumbai"), ("madras", "chennai"),
    ("calcutta", "kolkata"), ("peking", "beijing"), ("canton", "guangzhou"), ("rangoon", "yangon"), ("batavia", "jakarta"), ("danzig", "gdansk"), ("breslau", "wroclaw"), ("konigsberg", "kaliningrad"), ("lemberg", "lviv"),
    ("prussia", "germany"), ("bohemia", "czech republic"), ("moravia", "czech republic"), ("austro-hungary", "austria"), ("yugoslavia", "serbia"), ("czechoslovakia", "czech republic"), ("ussr", "russia"),
    ("soviet union", "russia"), ("rhodesia", "zimbabwe"), ("burma", "myanmar"), ("ceylon", "sri lanka"), ("persia", "iran"), ("siam", "thailand"), ("formosa", "taiwan"), ("east germany", "germany"), ("west germany", "germany"),
]
