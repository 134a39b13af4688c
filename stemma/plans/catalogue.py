"""The tree operators as named queries over the stored tables, and the SQL that states each independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.operators import associates, graph, kinship, lookup, places, search, spatial, stats, timeline, vector
from stemma.operators.nearby import great_circle_km
from stemma.plans.model import Tree

SEED, ELDER, OTHER, ASKED = "@I118@", "@I22@", "@I82@", ["I7", "@I12", "@I99@", "@I7@", "nobody"]
POINT = (-20.44, -22.65)
VECTOR = [((i * 37) % 11 - 5) / 10 for i in range(128)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tree], DataFrame]) -> Callable[[Tree], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Tree(spark, folder))
    return f


# --- SQL building blocks -------------------------------------------------------------------------------------------

WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def ptr(x: str) -> str:
    return f"CASE WHEN trim({x}, '@') <> '' THEN '@' || trim({x}, '@') || '@' END"


def yr(x: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({x}, '\b(\d{{4}})\b', 1), '') AS INTEGER)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}', ''), '{WS}$', '')"


def norm(x: str) -> str:
    out = strip(f"lower({x})")
    for a, b in X.PLACE_REPLACEMENTS:
        out = f"replace({out}, '{a}', '{b}')"
    return strip(f"regexp_replace({out}, '{WS}', ' ', 'g')")


def pid(x: str) -> str:
    return f"substr(md5({norm(x)}), 1, 12)"


def cent(y: str) -> str:
    return f"CAST(CAST(floor({y} / 100) * 100 AS BIGINT) AS VARCHAR) || 's'"


def km(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def now(table: str, key: str) -> str:
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC, ord DESC) = 1"


USABLE = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)"

BASE = f"""WITH RECURSIVE ind AS ({now('individuals', 'id')}),
p AS (SELECT {ptr('id')} AS id, coalesce(given_name, '') AS given_name, coalesce(surname, '') AS surname, concat_ws(' ', nullif(given_name, ''), nullif(surname, '')) AS name, lower(coalesce(surname, '')) AS surname_lc, sex,
  birth_date, birth_place, death_date, death_place, {yr('birth_date')} AS birth_year, {yr('death_date')} AS death_year, {ptr('family_as_child')} AS famc,
  list_filter(list_transform(families_as_spouse, lambda x: {ptr('x')}), lambda x: x IS NOT NULL) AS fams, notes, ord FROM ind),
f AS (SELECT {ptr('id')} AS family_id, {ptr('husband_id')} AS husband_id, {ptr('wife_id')} AS wife_id, list_transform(children_ids, lambda x: {ptr('x')}) AS children_ids, marriage_date, marriage_place FROM ({now('families', 'id')})),
fc AS (SELECT family_id, child_id, child_ord FROM (SELECT family_id, unnest(children_ids) AS child_id, CAST(generate_subscripts(children_ids, 1) - 1 AS INTEGER) AS child_ord FROM f) WHERE child_id IS NOT NULL),
fp AS (SELECT p.id AS child_id, f.husband_id AS parent_id, 'father' AS role, family_id FROM p JOIN f ON p.famc = f.family_id WHERE husband_id IS NOT NULL
  UNION ALL SELECT p.id, f.wife_id, 'mother', family_id FROM p JOIN f ON p.famc = f.family_id WHERE wife_id IS NOT NULL),
pe AS (SELECT * FROM fp WHERE parent_id IN (SELECT id FROM p)),
sf AS (SELECT l.person_id, l.fam_ord, f.*, CASE WHEN f.husband_id = l.person_id THEN f.wife_id ELSE f.husband_id END AS spouse_id FROM
  (SELECT id AS person_id, unnest(fams) AS fam, CAST(generate_subscripts(fams, 1) - 1 AS INTEGER) AS fam_ord FROM p) l JOIN f ON l.fam = f.family_id),
ce AS (SELECT person_id AS parent_id, child_id, fam_ord, child_ord FROM sf JOIN fc USING (family_id) WHERE child_id IN (SELECT id FROM p)
  QUALIFY row_number() OVER (PARTITION BY person_id, child_id ORDER BY fam_ord, child_ord) = 1),
ev AS (SELECT {ptr('individual_id')} AS individual_id, event_ord, type, date, {yr('date')} AS year, place, {norm('place')} AS place_norm, {pid('place')} AS place_id, description, notes FROM ({now('person_events', 'individual_id, event_ord')})),
ci AS (SELECT citation_id, {ptr('individual_id')} AS individual_id, event_ord, cite_ord, {ptr('source_id')} AS source_id, page, text, url FROM ({now('citations', 'citation_id')})),
ip AS (SELECT individual_id, place, {pid('place')} AS place_id, {norm('place')} AS place_norm, kind, year FROM (
  SELECT id AS individual_id, birth_place AS place, 'BIRT' AS kind, birth_year AS year FROM p UNION ALL SELECT id, death_place, 'DEAT', death_year FROM p
  UNION ALL SELECT individual_id, place, type, year FROM ev) WHERE place IS NOT NULL AND place <> ''),
pl AS (SELECT id AS place_id, original, normalized, latitude AS lat, longitude AS lon FROM places WHERE {USABLE})
"""


def up_to(generations: int, where: str, edges: str = "SELECT child_id AS a, parent_id AS b FROM pe", name: str = "up") -> str:
    return f""", {name}_e AS (SELECT DISTINCT a, b FROM ({edges})),
{name} AS (SELECT id AS root_id, id AS relative_id, 0 AS generation FROM p {where} UNION SELECT u.root_id, e.b, u.generation + 1 FROM {name} u JOIN {name}_e e ON e.a = u.relative_id WHERE u.generation < {generations})
"""


ORACLE: dict[str, str] = {}


def oracle(name: str, select: str, ctes: str = "") -> None:
    ORACLE[name] = BASE + ctes + select


# --- counts --------------------------------------------------------------------------------------------------------


@query
def stats_overview(t: Tree) -> DataFrame:
    return stats.overview(t)


oracle("stats_overview", """SELECT count(*) AS individuals, count_if(sex = 'M')::BIGINT AS males, count_if(sex = 'F')::BIGINT AS females, (count(*) - coalesce(count_if(sex = 'M'), 0) - coalesce(count_if(sex = 'F'), 0))::BIGINT AS unknown,
min(birth_year) AS earliest_birth_year, max(birth_year) AS latest_birth_year, count(DISTINCT nullif(surname_lc, '')) AS surnames, (SELECT count(*) FROM f) AS families FROM p""")


@query
def top_surnames(t: Tree) -> DataFrame:
    return stats.top_surnames(t)


oracle("top_surnames", "SELECT surname_lc AS surname, count(*) AS n, min(ord) AS first_ord FROM p WHERE surname_lc <> '' GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 20")


@query
def surnames_all(t: Tree) -> DataFrame:
    return stats.surnames(t).select("surname", "n")


oracle("surnames_all", "SELECT surname_lc AS surname, count(*) AS n FROM p WHERE surname_lc <> '' GROUP BY 1")


@query
def surname_group_stats(t: Tree) -> DataFrame:
    return stats.surname_groups(t)


oracle("surname_group_stats", """SELECT surname_lc AS surname, count(*) AS members, min(birth_year) AS earliest, max(birth_year) AS latest,
coalesce(greatest(1, CAST(floor((max(birth_year) - min(birth_year)) / 25.0) AS BIGINT) + 1), 0)::BIGINT * (CASE WHEN min(birth_year) IS NULL THEN 0 ELSE 1 END)::BIGINT AS generations FROM p WHERE surname_lc <> '' GROUP BY 1""")


@query
def surname_top_places(t: Tree) -> DataFrame:
    return stats.surname_places(t)


oracle("surname_top_places", """SELECT surname, birth_place, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY surname ORDER BY n DESC, o, birth_place) AS rank FROM
(SELECT surname_lc AS surname, birth_place, count(*) AS n, min(ord) AS o FROM p WHERE surname_lc <> '' AND birth_place <> '' GROUP BY 1, 2)) WHERE rank <= 5""")


@query
def surname_group_spouses(t: Tree) -> DataFrame:
    return stats.surname_spouses(t)


oracle("surname_group_spouses", "SELECT DISTINCT m.surname_lc AS surname, spouse_id FROM sf JOIN p m ON m.id = sf.person_id JOIN p o ON o.id = sf.spouse_id WHERE m.surname_lc <> '' AND m.surname_lc <> o.surname_lc")


@query
def surname_origin(t: Tree) -> DataFrame:
    return stats.surname_origins(t)


DATED = "FROM p WHERE surname_lc <> '' AND birth_place <> '' AND birth_year IS NOT NULL"
oracle("surname_origin", f"""SELECT surname_lc AS surname, first(birth_place ORDER BY birth_year, ord) AS primary_origin, min(birth_year) AS earliest, max(birth_year) AS latest, max(birth_year) - min(birth_year) AS span {DATED} GROUP BY 1""")


@query
def surname_place_timeline(t: Tree) -> DataFrame:
    return stats.surname_timeline(t)


oracle("surname_place_timeline", f"SELECT DISTINCT surname_lc AS surname, birth_place, birth_year {DATED}")

MILITARY = "(regexp_matches(lower(coalesce(ev.description, '')), '{0}') OR list_bool_or(list_transform(ev.notes, lambda n: regexp_matches(lower(coalesce(n, '')), '{0}'))))".format("|".join(X.MILITARY))


@query
def military_people(t: Tree) -> DataFrame:
    return stats.military_people(t)


oracle("military_people", f"SELECT individual_id, name, count(*) AS events FROM ev JOIN p ON p.id = individual_id WHERE {MILITARY} GROUP BY 1, 2")


@query
def military_periods(t: Tree) -> DataFrame:
    return stats.military_centuries(t)


oracle("military_periods", f"SELECT {cent('year')} AS century, count(*) AS events FROM ev WHERE year IS NOT NULL AND {MILITARY} GROUP BY 1")


@query
def military_places(t: Tree) -> DataFrame:
    return stats.military_places(t)


oracle("military_places", f"SELECT place, count(*) AS events FROM ev WHERE place <> '' AND {MILITARY} GROUP BY 1 ORDER BY events DESC, place LIMIT 10")


@query
def geo_coverage(t: Tree) -> DataFrame:
    return stats.geo_coverage(t)


oracle("geo_coverage", "SELECT count(*) AS total, count_if(latitude IS NOT NULL AND longitude IS NOT NULL)::BIGINT AS geocoded, CAST(floor(count_if(latitude IS NOT NULL AND longitude IS NOT NULL) * 100 / count(*)) AS BIGINT) AS percent FROM places")

# --- lookups -------------------------------------------------------------------------------------------------------


@query
def lookup_individual(t: Tree) -> DataFrame:
    return lookup.individual(t, "I7")


oracle("lookup_individual", "SELECT id, given_name, surname, name, sex, birth_date, birth_place, death_date, death_place, famc, ord FROM p WHERE id = '@I7@'")


@query
def individuals_batch(t: Tree) -> DataFrame:
    return lookup.individuals_batch(t, ASKED)


ASK = "(VALUES ('@I7@', 0), ('@I12@', 1), ('@I99@', 2), ('@nobody@', 4)) AS a(asked, n)"
oracle("individuals_batch", f"SELECT asked, name, birth_date, death_date FROM {ASK} LEFT JOIN p ON p.id = asked")


@query
def lookup_family(t: Tree) -> DataFrame:
    return lookup.families(t)


oracle("lookup_family", "SELECT family_id, husband_id, h.name AS husband_name, wife_id, w.name AS wife_name, marriage_date, marriage_place FROM f LEFT JOIN p h ON h.id = husband_id LEFT JOIN p w ON w.id = wife_id")


@query
def family_members(t: Tree) -> DataFrame:
    return lookup.family_members(t)


oracle("family_members", "SELECT family_id, child_ord, child_id, name FROM fc JOIN p ON p.id = child_id")


@query
def parents(t: Tree) -> DataFrame:
    return lookup.parents(t)


oracle("parents", "SELECT child_id, role, parent_id, name AS parent_name FROM pe JOIN p ON p.id = parent_id")


@query
def children(t: Tree) -> DataFrame:
    return lookup.children(t)


oracle("children", "SELECT parent_id, child_id, name AS child_name, fam_ord, child_ord FROM ce JOIN p ON p.id = child_id")


@query
def spouses(t: Tree) -> DataFrame:
    return lookup.spouses(t)


oracle("spouses", "SELECT person_id, family_id, fam_ord, spouse_id, name AS spouse_name, marriage_date, marriage_place FROM sf JOIN p ON p.id = spouse_id")


@query
def siblings(t: Tree) -> DataFrame:
    return lookup.siblings(t)


SIB = "SELECT a.id AS person_id, c.child_id AS sibling_id, min(child_ord) AS child_ord FROM p a JOIN fc c ON a.famc = c.family_id WHERE c.child_id <> a.id GROUP BY 1, 2"
oracle("siblings", f"SELECT person_id, sibling_id, name AS sibling_name, child_ord FROM ({SIB}) JOIN p ON p.id = sibling_id")


@query
def sources_list(t: Tree) -> DataFrame:
    return lookup.source_lines(t)


oracle("sources_list", "SELECT id, id || ': ' || coalesce(nullif(title, ''), 'Untitled') || ' by ' || coalesce(nullif(author, ''), 'Unknown author') AS line FROM sources ORDER BY ord LIMIT 1000")


@query
def repositories_all(t: Tree) -> DataFrame:
    return t.repositories


oracle("repositories_all", "SELECT * FROM repositories")


@query
def places_list(t: Tree) -> DataFrame:
    return lookup.places(t)


oracle("places_list", "SELECT id, original, latitude, longitude, ord FROM places ORDER BY ord LIMIT 500")


@query
def events_batch(t: Tree) -> DataFrame:
    return lookup.events_flat(t, ASKED)


oracle("events_batch", f"SELECT asked, event_ord, type, date, place, description FROM {ASK} LEFT JOIN ev ON individual_id = asked")


@query
def citations_flat(t: Tree) -> DataFrame:
    return lookup.citations_flat(t)


oracle("citations_flat", """SELECT citation_id, individual_id, event_ord, cite_ord, type AS event_type, date AS event_date, source_id, s.title AS source_title, page
FROM ci JOIN ev USING (individual_id, event_ord) LEFT JOIN sources s ON s.id = source_id""")


@query
def notes_flat(t: Tree) -> DataFrame:
    return lookup.notes_flat(t)


oracle("notes_flat", "SELECT individual_id, event_ord, type AS event_type, CAST(generate_subscripts(notes, 1) - 1 AS INTEGER) AS pos, unnest(notes) AS note FROM ev")


def vital(verb: str, d: str, q: str) -> str:
    return f"CASE WHEN nullif({d}, '') IS NOT NULL OR nullif({q}, '') IS NOT NULL THEN concat_ws(' ', '{verb}', nullif({d}, ''), CASE WHEN nullif({q}, '') IS NOT NULL THEN 'in ' || {q} END) || '.' END"


BIO = f""", bio AS (SELECT id, name, concat_ws(' ', {vital('Born', 'birth_date', 'birth_place')}, {vital('Died', 'death_date', 'death_place')}) AS vital_summary,
(SELECT string_agg(q.name, '; ' ORDER BY role, parent_id) FROM pe JOIN p q ON q.id = parent_id WHERE child_id = p.id) AS parents,
(SELECT string_agg(q.name, '; ' ORDER BY fam_ord, family_id) FROM sf JOIN p q ON q.id = spouse_id WHERE person_id = p.id) AS spouses,
(SELECT string_agg(q.name, '; ' ORDER BY fam_ord, child_ord) FROM ce JOIN p q ON q.id = child_id WHERE parent_id = p.id) AS children FROM p)
"""


@query
def biography_flat(t: Tree) -> DataFrame:
    return lookup.biographies(t)


oracle("biography_flat", "SELECT * FROM bio", BIO)


@query
def embedding_text(t: Tree) -> DataFrame:
    return lookup.embedding_texts(t)


oracle("embedding_text", """SELECT id, text FROM (SELECT bio.id, concat_ws(' ', bio.name, nullif(vital_summary, ''), CASE WHEN parents <> '' THEN 'Parents: ' || parents END, CASE WHEN spouses <> '' THEN 'Spouses: ' || spouses END, e.events, nullif(array_to_string(p.notes, ' '), '')) AS text
FROM bio JOIN p ON p.id = bio.id LEFT JOIN (SELECT individual_id, string_agg(concat_ws(' ', type, nullif(description, ''), nullif(date, ''), nullif(place, ''), nullif(array_to_string(notes, ' '), '')), ' ' ORDER BY event_ord) AS events FROM ev GROUP BY 1) e ON e.individual_id = bio.id) WHERE trim(text) <> ''""", BIO)

# --- search --------------------------------------------------------------------------------------------------------


@query
def search_name(t: Tree) -> DataFrame:
    return search.by_name(t, "mar", None)


oracle("search_name", "SELECT id, name, birth_date, death_date, ord FROM p WHERE contains(lower(given_name), 'mar') OR contains(lower(surname), 'mar') OR contains(lower(name), 'mar')")


@query
def search_birth(t: Tree) -> DataFrame:
    return search.by_birth(t, 1850, "county", 5, None)


oracle("search_birth", "SELECT id, name, birth_date, death_date, ord, birth_place FROM p WHERE birth_year BETWEEN 1845 AND 1855 AND contains(lower(birth_place), 'county')")


@query
def search_place(t: Tree) -> DataFrame:
    return search.by_place(t, "Mount", None)


oracle("search_place", "SELECT id, name, birth_date, death_date, ord, birth_place, death_place FROM p WHERE id IN (SELECT individual_id FROM ip WHERE contains(lower(place), 'mount'))")


@query
def search_events(t: Tree) -> DataFrame:
    return search.events(t, "cens", "county", 1850, 50, None)


oracle("search_events", "SELECT individual_id, name, event_ord, type, date, place, ord FROM ev JOIN p ON p.id = individual_id WHERE type = 'CENS' AND contains(lower(place), 'county') AND year BETWEEN 1800 AND 1900")


@query
def search_sources(t: Tree) -> DataFrame:
    return search.sources(t, "Probate", None)


oracle("search_sources", "SELECT id, title, author, ord FROM sources WHERE contains(lower(coalesce(title, '')), 'probate') OR contains(lower(coalesce(author, '')), 'probate')")

SNIP = """CASE WHEN hit > 0 THEN (CASE WHEN hit > 51 THEN '...' ELSE '' END) || substring(text, greatest(1, hit - 50), hit - greatest(1, hit - 50)) || '**' || substring(text, hit, 5) || '**' || substring(text, hit + 5, 50)
|| (CASE WHEN hit + 54 < length(text) THEN '...' ELSE '' END) ELSE substring(text, 1, 100) || '...' END"""


@query
def search_narrative_snippets(t: Tree) -> DataFrame:
    return search.narrative(t, "Chest", None)


oracle("search_narrative_snippets", f"""SELECT individual_id, name, kind, event_ord, pos, {SNIP} AS snippet, ord FROM (SELECT *, instr(lower(text), 'chest')::BIGINT AS hit FROM (
SELECT id AS individual_id, 'individual_note' AS kind, -1 AS event_ord, CAST(generate_subscripts(notes, 1) - 1 AS INTEGER) AS pos, unnest(notes) AS text FROM p
UNION ALL SELECT individual_id, 'event_note', event_ord, CAST(generate_subscripts(notes, 1) - 1 AS INTEGER), unnest(notes) FROM ev
UNION ALL SELECT individual_id, 'citation', event_ord, cite_ord, text FROM ci)) h JOIN p ON p.id = h.individual_id WHERE contains(lower(text), 'chest')""")

# --- timelines -----------------------------------------------------------------------------------------------------

TIME = "coalesce(year, 9999) AS sort_year, coalesce(date, '') AS sort_date"


@query
def timeline_person(t: Tree) -> DataFrame:
    return timeline.person(t, OTHER)


oracle("timeline_person", f"SELECT individual_id, event_ord, type, date, year, place, {TIME} FROM ev WHERE individual_id = '{OTHER}'")


@query
def timeline_all(t: Tree) -> DataFrame:
    return timeline.everyone(t)


oracle("timeline_all", f"SELECT individual_id, event_ord, type, date, year, place, {TIME} FROM ev")


@query
def timeline_family(t: Tree) -> DataFrame:
    return timeline.families(t)


oracle("timeline_family", f"""SELECT family_id, member_id, event_ord, type, date, year, place, {TIME} FROM (SELECT family_id, husband_id AS member_id FROM f WHERE husband_id IS NOT NULL UNION SELECT family_id, wife_id FROM f WHERE wife_id IS NOT NULL UNION SELECT family_id, child_id FROM fc) m
JOIN ev ON individual_id = member_id""")


@query
def timeline_merged(t: Tree) -> DataFrame:
    return timeline.merged(t, ASKED, 1700, 1900)


oracle("timeline_merged", f"SELECT individual_id, event_ord, type, date, year, place, {TIME}, n FROM {ASK} JOIN ev ON individual_id = asked WHERE year IS NULL OR year BETWEEN 1700 AND 1900")

# --- graph ---------------------------------------------------------------------------------------------------------

PATHS = """, walk AS (SELECT id AS ancestor_id, '' AS path, 0 AS generation FROM p WHERE id = '{seed}' UNION ALL
SELECT pe.parent_id, w.path || CASE WHEN w.path <> '' THEN '/' ELSE '' END || role, w.generation + 1 FROM walk w JOIN pe ON pe.child_id = w.ancestor_id WHERE w.generation < {g})
"""
DOWN = "SELECT parent_id AS a, child_id AS b FROM ce"


@query
def ancestors_long(t: Tree) -> DataFrame:
    return graph.paths_up(t, SEED, 6)


oracle("ancestors_long", "SELECT generation, path, ancestor_id FROM walk WHERE generation > 0", PATHS.format(seed=SEED, g=6))


@query
def ancestors_terminal(t: Tree) -> DataFrame:
    return graph.terminal(t, SEED, 8)


oracle("ancestors_terminal", "SELECT ancestor_id, min(path) AS path, min_by(generation, path) AS generation FROM walk WHERE generation > 0 AND ancestor_id NOT IN (SELECT child_id FROM fp) GROUP BY 1", PATHS.format(seed=SEED, g=8))


@query
def descendants_long(t: Tree) -> DataFrame:
    return graph.descendants(t, ELDER, 6)


oracle("descendants_long", "SELECT DISTINCT generation + 1 AS generation, parent_id, child_id FROM up JOIN ce ON ce.parent_id = up.relative_id", up_to(5, f"WHERE id = '{ELDER}'", DOWN))


@query
def ancestor_min_gen(t: Tree) -> DataFrame:
    return graph.nearest(graph.closure(t, 10))


oracle("ancestor_min_gen", "SELECT root_id, relative_id, min(generation) AS generation FROM up WHERE generation > 0 GROUP BY 1, 2", up_to(10, ""))


@query
def common_ancestors(t: Tree) -> DataFrame:
    return graph.common_ancestors(t, SEED, OTHER)


oracle("common_ancestors", f"""SELECT a.relative_id AS ancestor_id, min(a.generation) AS generation1, min(b.generation) AS generation2 FROM up a JOIN up b ON a.relative_id = b.relative_id AND a.root_id = '{SEED}' AND b.root_id = '{OTHER}'
WHERE a.generation > 0 AND b.generation > 0 GROUP BY 1""", up_to(10, f"WHERE id IN ('{SEED}', '{OTHER}')"))


@query
def traverse_children(t: Tree) -> DataFrame:
    return graph.traverse(t, ELDER, "children", 4)


oracle("traverse_children", f"SELECT relative_id AS id, min(generation) AS level FROM up WHERE relative_id <> '{ELDER}' GROUP BY 1", up_to(4, f"WHERE id = '{ELDER}'", DOWN))


@query
def traverse_siblings(t: Tree) -> DataFrame:
    return graph.traverse(t, SEED, "siblings", 2)


oracle("traverse_siblings", f"SELECT relative_id AS id, min(generation) AS level FROM up WHERE relative_id <> '{SEED}' GROUP BY 1", up_to(2, f"WHERE id = '{SEED}'", f"SELECT person_id AS a, sibling_id AS b FROM ({SIB}) WHERE sibling_id IN (SELECT id FROM p)"))


@query
def pedigree_collapse(t: Tree) -> DataFrame:
    return graph.pedigree_collapse(t, SEED, 8)


oracle("pedigree_collapse", "SELECT ancestor_id, count(*) AS occurrences, string_agg(path, '; ' ORDER BY path) AS paths FROM walk WHERE generation > 0 GROUP BY 1 HAVING count(*) > 1", PATHS.format(seed=SEED, g=8))

RELATIVES = up_to(5, f"WHERE id = '{SEED}'") + up_to(5, f"WHERE id = '{SEED}'", DOWN, "dn") + f""", base AS (SELECT '{SEED}' AS id UNION SELECT relative_id FROM up UNION SELECT relative_id FROM dn UNION SELECT unnest([husband_id, wife_id]) FROM sf WHERE person_id = '{SEED}'
UNION SELECT unnest(children_ids) FROM sf WHERE person_id = '{SEED}' UNION SELECT child_id FROM fc WHERE family_id = (SELECT famc FROM p WHERE id = '{SEED}')),
rel AS (SELECT id FROM (SELECT id FROM base UNION SELECT spouse_id FROM sf WHERE person_id IN (SELECT id FROM base)) WHERE id IN (SELECT id FROM p))
"""


@query
def relative_set(t: Tree) -> DataFrame:
    return graph.relatives(t, SEED)


oracle("relative_set", "SELECT id FROM rel", RELATIVES)


@query
def home_person(t: Tree) -> DataFrame:
    return graph.home_person(t)


oracle("home_person", """SELECT arg_max(id, (score, -ord)) AS id, max(score) AS score FROM (SELECT id, ord, CAST((CASE WHEN famc IN (SELECT family_id FROM f) THEN 2 ELSE 0 END)
+ (SELECT count(*) FROM fp WHERE child_id = p.id AND parent_id IN (SELECT id FROM p WHERE famc IS NOT NULL)) + (SELECT count(*) FROM sf WHERE person_id = p.id AND spouse_id IN (SELECT id FROM p))
+ coalesce((SELECT sum(len(children_ids)) FROM sf WHERE person_id = p.id), 0) AS BIGINT) AS score FROM p)""")

# --- kinship -------------------------------------------------------------------------------------------------------


def _pairs(t: Tree) -> DataFrame:
    """All pairs that share a parent or grandparent, spouses, and everyone with the parents and grandparents."""
    up = graph.closure(t, 2).select("root_id", "relative_id")
    a, b = up.select(F.col("root_id").alias("id1"), "relative_id"), up.select(F.col("root_id").alias("id2"), "relative_id")
    wed = t.spouse_family.where("husband_id is not null and wife_id is not null").select(F.col("husband_id").alias("id1"), F.col("wife_id").alias("id2"))
    return a.join(b, "relative_id").select("id1", "id2").unionByName(up.select(F.col("root_id").alias("id1"), F.col("relative_id").alias("id2"))).unionByName(wed).distinct()


def say(n: str, near: str, far: str) -> str:
    words = " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(X.ORDINALS, 1))
    return f"CASE {n} WHEN 1 THEN '{near}' WHEN 2 THEN '{far}' WHEN 3 THEN 'great-{far}' ELSE (CASE {n} - 2 {words} ELSE ({n} - 2) || 'th' END) || ' great-{far}' END"


CLOSE = """near AS (SELECT DISTINCT root_id, relative_id FROM mg WHERE g <= 2),
pairs AS (SELECT a.root_id AS id1, b.root_id AS id2 FROM near a JOIN near b USING (relative_id) UNION SELECT root_id, relative_id FROM near UNION SELECT husband_id, wife_id FROM sf WHERE husband_id IS NOT NULL AND wife_id IS NOT NULL),"""
KIN = up_to(10, "") + """, mg AS (SELECT root_id, relative_id, min(generation) AS g FROM up WHERE generation > 0 GROUP BY 1, 2),
fam AS (SELECT p.id, p.famc, f.family_id AS fam, f.husband_id AS dad, f.wife_id AS mum FROM p LEFT JOIN f ON f.family_id = p.famc),
gp AS (SELECT a.id, g.family_id, g.husband_id, g.wife_id FROM fam a JOIN fam b ON b.id = a.dad OR b.id = a.mum JOIN f g ON g.family_id = b.famc),
gps AS (SELECT DISTINCT id, unnest([husband_id, wife_id]) AS b FROM gp), aunts AS (SELECT DISTINCT id, child_id AS b FROM gp JOIN fc USING (family_id)),
wed AS (SELECT DISTINCT person_id, unnest([husband_id, wife_id]) AS b FROM sf),
near AS (SELECT DISTINCT root_id, relative_id FROM mg WHERE g <= 2),
pairs AS (SELECT a.root_id AS id1, b.root_id AS id2 FROM near a JOIN near b USING (relative_id) UNION SELECT root_id, relative_id FROM near UNION SELECT husband_id, wife_id FROM sf WHERE husband_id IS NOT NULL AND wife_id IS NOT NULL),
ca AS (SELECT id1, id2, min((x.g + y.g, x.g, x.relative_id, y.g)) AS m FROM pairs JOIN mg x ON x.root_id = id1 JOIN mg y ON y.root_id = id2 AND y.relative_id = x.relative_id GROUP BY 1, 2),
flat AS (SELECT q.*, a.id AS k1, b.id AS k2, a.fam AS fam1, b.fam AS fam2, a.dad AS dad1, b.dad AS dad2, a.mum AS mum1, b.mum AS mum2, u.g AS g12, v.g AS g21, struct_extract(m, 2) AS n1, struct_extract(m, 3) AS nearest, struct_extract(m, 4) AS n2
FROM pairs q LEFT JOIN fam a ON a.id = id1 LEFT JOIN fam b ON b.id = id2 LEFT JOIN mg u ON u.root_id = id1 AND u.relative_id = id2 LEFT JOIN mg v ON v.root_id = id2 AND v.relative_id = id1 LEFT JOIN ca ON ca.id1 = q.id1 AND ca.id2 = q.id2)
"""
COUSIN = "(CASE least(n1, n2) - 1 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(X.ORDINALS, 1)) + " ELSE (least(n1, n2) - 1) || 'th' END) || ' cousin' || CASE abs(n1 - n2) WHEN 0 THEN '' WHEN 1 THEN ' once removed' WHEN 2 THEN ' twice removed' ELSE ' ' || abs(n1 - n2) || 'x removed' END"


@query
def relationship_pairs(t: Tree) -> DataFrame:
    return kinship.relate(t, _pairs(t))


RELATED = f"""SELECT id1, id2, relationship, CASE WHEN contains(relationship, ' cousin') THEN nearest END AS common_ancestor FROM (SELECT id1, id2, nearest, CASE WHEN k1 IS NULL OR k2 IS NULL THEN NULL WHEN id1 = id2 THEN 'same person' WHEN id2 IN (dad1, mum1) THEN 'child' WHEN id1 IN (dad2, mum2) THEN 'parent'
WHEN EXISTS (SELECT 1 FROM wed w WHERE w.person_id = flat.id1 AND w.b = flat.id2) THEN 'spouse' WHEN fam1 = fam2 THEN 'sibling' WHEN dad1 = dad2 OR mum1 = mum2 OR dad1 = mum2 OR mum1 = dad2 THEN 'half-sibling'
WHEN EXISTS (SELECT 1 FROM gps w WHERE w.id = flat.id1 AND w.b = flat.id2) THEN 'grandchild' WHEN EXISTS (SELECT 1 FROM gps w WHERE w.id = flat.id2 AND w.b = flat.id1) THEN 'grandparent'
WHEN g12 IS NOT NULL THEN {say('g12', 'parent', 'grandparent')} WHEN g21 IS NOT NULL THEN {say('g21', 'child', 'grandchild')}
WHEN EXISTS (SELECT 1 FROM aunts w WHERE w.id = flat.id1 AND w.b = flat.id2) THEN 'niece/nephew' WHEN EXISTS (SELECT 1 FROM aunts w WHERE w.id = flat.id2 AND w.b = flat.id1) THEN 'aunt/uncle'
WHEN least(n1, n2) - 1 >= 1 THEN {COUSIN} ELSE 'not related (within 10 generations)' END AS relationship FROM flat)"""
oracle("relationship_pairs", RELATED, KIN)


@query
def relationship_matrix(t: Tree) -> DataFrame:
    return kinship.matrix(t, [f"@I{k}@" for k in range(1, 41)])


oracle("relationship_matrix", RELATED, KIN.replace(CLOSE, "pairs AS (SELECT '@I' || a.k || '@' AS id1, '@I' || b.k || '@' AS id2 FROM range(1, 41) a(k) JOIN range(1, 41) b(k) ON a.k < b.k),"))


# --- places --------------------------------------------------------------------------------------------------------

COMPS = f"list_filter(list_transform(string_split(original, ','), lambda x: {strip('x')}), lambda x: x <> '')"


@query
def place_normalise(t: Tree) -> DataFrame:
    return places.distinct_places(t)


oracle("place_normalise", f"SELECT id, {pid('original')} AS computed_id, {norm('original')} AS normalized, CAST(len({COMPS}) AS INTEGER) AS n_components, array_to_string({COMPS}, ' | ') AS components FROM places")


@query
def place_ungeocodable(t: Tree) -> DataFrame:
    return t.individual_place.select("place").distinct().select("place", X.ungeocodable(F.col("place")).alias("ungeocodable"))


oracle("place_ungeocodable", "SELECT DISTINCT place, {} IN ({}) AS ungeocodable FROM ip".format(strip("lower(place)"), ", ".join(f"'{w}'" for w in X.NOWHERE)))


@query
def historical_variants(t: Tree) -> DataFrame:
    asked = t.spark.createDataFrame([("Leningrad, Ussr",), ("Danzig, West Prussia, Germany",), ("Serbia",), ("Ho Chi Minh City, Vietnam",), ("Nowhere",)], "place string")
    return places.historical_variants(t, asked)


HIST = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in X.HISTORICAL)
oracle("historical_variants", f"""SELECT DISTINCT place, variant FROM (SELECT place, unnest(list_concat(regexp_split_to_array(lower(place), '[\\s,]+'), list_transform(string_split(lower(place), ','), lambda x: trim(x)))) AS w
FROM (VALUES ('Leningrad, Ussr'), ('Danzig, West Prussia, Germany'), ('Serbia'), ('Ho Chi Minh City, Vietnam'), ('Nowhere')) AS a(place)) JOIN (VALUES {HIST}) AS h(name, variant) ON w = name""")


@query
def place_by_id(t: Tree) -> DataFrame:
    return lookup.place(t, "0" * 12).unionByName(t.places.orderBy("id").limit(3).select("id", "original", "normalized", "components", "latitude", "longitude")).select("id", "original", "normalized", F.size("components").alias("n_components"))


oracle("place_by_id", "SELECT id, original, normalized, CAST(len(components) AS INTEGER) AS n_components FROM places ORDER BY id LIMIT 3")


@query
def place_search_exact_layers(t: Tree) -> DataFrame:
    return places.people_by_place(t, "Barivale County", most=None, exact_only=True)


oracle("place_search_exact_layers", f"""SELECT id, name, max(score) AS score, ord FROM (SELECT individual_id, CASE WHEN bool_or(contains(lower(place), 'barivale county')) OVER (PARTITION BY place_id) THEN 100.0::DOUBLE WHEN contains(place_norm, {norm("'Barivale County'")}) THEN 95.0::DOUBLE END AS score FROM ip) s
JOIN p ON p.id = individual_id WHERE score IS NOT NULL GROUP BY id, name, ord""")


@query
def fuzzy_places(t: Tree) -> DataFrame:
    return places.fuzzy(t, "Barivale County, Dalackvia", 60)


@query
def similar_places(t: Tree) -> DataFrame:
    return places.similar(t, "Ulvgaholm, Barivale County")


@query
def place_variants(t: Tree) -> DataFrame:
    return places.variants(t, "Ulvgaholm, Barivale County, Dalackvia")


@query
def phonetic_places(t: Tree) -> DataFrame:
    return places.phonetic(t, "Ulvgahulm")


@query
def place_cluster(t: Tree) -> DataFrame:
    return places.cluster(t, "Barivale County")


# --- space, vectors, associates ------------------------------------------------------------------------------------


@query
def geo_distance(t: Tree) -> DataFrame:
    return spatial.distances(t, *POINT).select("place_id", F.round("distance", 6).alias("distance"))


FROM_POINT = km(str(POINT[0]), f"({POINT[1]})", "lat", "lon")
oracle("geo_distance", f"SELECT place_id, round({FROM_POINT} / 1.609344, 6) AS distance FROM pl")


@query
def nearby_people(t: Tree) -> DataFrame:
    return spatial.people_near(t, *POINT, radius=400, most=None)


oracle("nearby_people", f"SELECT id, name, round(min(d), 1) AS distance, count(*) AS matches, ord FROM (SELECT place_id, {FROM_POINT} / 1.609344 AS d FROM pl) JOIN ip USING (place_id) JOIN p ON p.id = individual_id WHERE d <= 400 GROUP BY id, name, ord")


@query
def nearby_km(t: Tree) -> DataFrame:
    return spatial.people_near(t, *POINT, radius=500, unit="km", event_types=["birt", "DEAT"], most=None)


oracle("nearby_km", f"SELECT id, name, round(min(d), 1) AS distance, count(*) AS matches, ord FROM (SELECT place_id, {FROM_POINT} AS d FROM pl) JOIN ip USING (place_id) JOIN p ON p.id = individual_id WHERE d <= 500 AND kind IN ('BIRT', 'DEAT') GROUP BY id, name, ord")


@query
def nearby_first(t: Tree) -> DataFrame:
    return spatial.people_near(t, *POINT, radius=400, most=30)


oracle("nearby_first", ORACLE["nearby_people"].removeprefix(BASE) + " ORDER BY distance, ord LIMIT 30")


@query
def within_bbox(t: Tree) -> DataFrame:
    return spatial.people_within(t, -40, 10, -60, 60, most=None)


oracle("within_bbox", "SELECT id, name, count(*) AS matches, ord FROM pl JOIN ip USING (place_id) JOIN p ON p.id = individual_id WHERE lat BETWEEN -40 AND 10 AND lon BETWEEN -60 AND 60 GROUP BY id, name, ord")


@query
def geocode_gazetteer(t: Tree) -> DataFrame:
    """Places resolved against a gazetteer made of the tree's own towns: each name's first coordinate."""
    town = F.lower(F.element_at(X.place_components(F.col("original")), 1))
    gaz = spatial.located(t).where(F.size(X.place_components(F.col("original"))) >= 2).groupBy(town.alias("name")).agg(F.min(F.struct("lat", "lon")).alias("c")).select("name", F.lit("").alias("country"), "c.lat", "c.lon")
    out = spatial.geocode(t.places, gaz)
    return out.groupBy("source", "confidence").agg(F.count("*").alias("n"))


@query
def vector_topk(t: Tree) -> DataFrame:
    from stemma.plans.tables import read

    return vector.top_k(read(t.spark, t.folder, "person_vectors"), VECTOR, 20)


VEC = "[" + ", ".join(f"{v}::DOUBLE" for v in VECTOR) + "]"
oracle("vector_topk", f"""SELECT vec_id, round(s, 3) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {VEC}) AS s FROM person_vectors WHERE len(embedding) = 128 AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))
ORDER BY s DESC, vec_id LIMIT 20""")


@query
def associates_exact_place(t: Tree) -> DataFrame:
    return associates.find(t, SEED, most=None)


oracle("associates_exact_place", f"""SELECT id, name, least(1000, points + 50 * (shared_places - 1) + 6 * least(50, coalesce(overlap_years, 0))) / 1000.0::DOUBLE AS strength, "overlaps", shared_places, overlap_years, false AS is_relative, ord FROM (
SELECT p.id, p.name, p.ord, g.points, g."overlaps", g.shared_places, CASE WHEN coalesce(o.birth_year, o.death_year) IS NOT NULL AND coalesce(p.birth_year, p.death_year) IS NOT NULL THEN
greatest(0, least(coalesce(o.death_year, o.birth_year + 80), coalesce(p.death_year, p.birth_year + 80)) - greatest(coalesce(o.birth_year, o.death_year - 80), coalesce(p.birth_year, p.death_year - 80))) END AS overlap_years
FROM (SELECT c.individual_id, sum(CASE WHEN c.year IS NULL OR m.year IS NULL THEN 30 WHEN c.year = m.year THEN 150 WHEN abs(c.year - m.year) <= 5 THEN 80 ELSE 20 END)::BIGINT AS points, count(*) AS "overlaps", count(DISTINCT m.place_norm) AS shared_places
FROM ip c JOIN ip m ON m.place_norm = c.place_norm AND m.individual_id = '{SEED}' WHERE c.individual_id <> '{SEED}' GROUP BY 1) g JOIN p ON p.id = g.individual_id, (SELECT birth_year, death_year FROM p WHERE id = '{SEED}') o WHERE p.id NOT IN (SELECT id FROM rel))""", RELATIVES)


@query
def associates_first(t: Tree) -> DataFrame:
    return associates.find(t, SEED, most=25)


oracle("associates_first", ORACLE["associates_exact_place"].removeprefix(BASE + RELATIVES) + " ORDER BY strength DESC, ord LIMIT 25", RELATIVES)


@query
def associates_fuzzy(t: Tree) -> DataFrame:
    return associates.find(t, SEED, most=50, fuzzy=True, exclude_relatives=False)


@query
def lifespan_overlap(t: Tree) -> DataFrame:
    return associates.lifespan_pairs(t)


oracle("lifespan_overlap", """SELECT family_id, CASE WHEN coalesce(a.birth_year, a.death_year) IS NOT NULL AND coalesce(b.birth_year, b.death_year) IS NOT NULL THEN
greatest(0, least(coalesce(a.death_year, a.birth_year + 80), coalesce(b.death_year, b.birth_year + 80)) - greatest(coalesce(a.birth_year, a.death_year - 80), coalesce(b.birth_year, b.death_year - 80))) END AS overlap
FROM f JOIN p a ON a.id = husband_id JOIN p b ON b.id = wife_id""")

# --- reading lineage text ------------------------------------------------------------------------------------------


def _text(t: Tree):
    """The tree's people and families written as lineage text and read again."""
    from stemma.plans.workspace import Workspace
    from stemma.sources.lineage_text import LineageText, render

    path = Workspace(t.spark, "lineage").path("text")
    render(t.individuals, t.families).write.text(path)
    return LineageText(t.spark, path)


@query
def ingest_individuals(t: Tree) -> DataFrame:
    i = _text(t).individuals()
    return i.select("id", "given_name", "surname", "sex", "birth_date", "birth_place", "death_date", "death_place", "family_as_child", F.array_join("families_as_spouse", " ").alias("fams"), F.size("notes").alias("n_notes"), F.md5(F.array_join("notes", "|")).alias("notes_md5"))


oracle("ingest_individuals", """SELECT id, trim(given_name) AS given_name, trim(surname) AS surname, sex, birth_date, birth_place, death_date, death_place, famc AS family_as_child, array_to_string(fams, ' ') AS fams,
CAST(coalesce(len(list_filter(notes, lambda x: x <> '')), 0) AS INTEGER) AS n_notes, md5(coalesce(array_to_string(list_transform(list_filter(notes, lambda x: x <> ''), lambda x: replace(x, chr(13) || chr(10), chr(10))), '|'), '')) AS notes_md5 FROM p""")


@query
def ingest_families(t: Tree) -> DataFrame:
    return _text(t).families().select("id", "husband_id", "wife_id", F.array_join("children_ids", " ").alias("children"), "marriage_date", "marriage_place")


oracle("ingest_families", "SELECT family_id AS id, husband_id, wife_id, array_to_string(list_filter(children_ids, lambda x: x IS NOT NULL), ' ') AS children, marriage_date, marriage_place FROM f")


def _written(t: Tree, rows: DataFrame):
    from stemma.plans.workspace import Workspace
    from stemma.sources.lineage_text import LineageText

    path = Workspace(t.spark, "lineage").path("text")
    rows.write.text(path)
    return LineageText(t.spark, path)


def _event_text(t: Tree):
    from stemma.sources.lineage_text import render_events

    return _written(t, render_events(t.events.where("individual_id is not null"), t.citations))


@query
def ingest_events(t: Tree) -> DataFrame:
    """All events written as lineage text and read again; they are numbered anew."""
    e = _event_text(t).events()
    return e.select("individual_id", "event_ord", "type", "date", "place", "description", F.size("notes").alias("n_notes"))


PLAIN = lambda x: f"nullif({x}, '')"
NUMBERED = "SELECT *, CAST(row_number() OVER (PARTITION BY individual_id ORDER BY event_ord) - 1 AS INTEGER) AS nth FROM ev WHERE individual_id IS NOT NULL"
oracle("ingest_events", f"""SELECT individual_id, nth AS event_ord, type, {PLAIN('date')} AS date, {PLAIN('place')} AS place, CASE WHEN type = 'EVEN' THEN {PLAIN('description')} END AS description,
CAST(coalesce(len(list_filter(notes, lambda x: x IS NOT NULL)), 0) AS INTEGER) AS n_notes FROM ({NUMBERED})""")


@query
def ingest_citations(t: Tree) -> DataFrame:
    c = _event_text(t).citations()
    return c.select("individual_id", "event_ord", "cite_ord", "source_id", "page", "url", F.length(F.regexp_replace("text", r"[\r\n]", "")).alias("text_length"))


oracle("ingest_citations", f"""SELECT c.individual_id, nth AS event_ord, CAST(row_number() OVER (PARTITION BY c.individual_id, nth ORDER BY cite_ord) - 1 AS INTEGER) AS cite_ord, source_id, {PLAIN('page')} AS page, {PLAIN('url')} AS url,
CAST(length(regexp_replace({PLAIN('text')}, '[\r\n]', '', 'g')) AS INTEGER) AS text_length FROM ci c JOIN ({NUMBERED}) e ON e.individual_id = c.individual_id AND e.event_ord = c.event_ord WHERE source_id IS NOT NULL""")


@query
def ingest_sources(t: Tree) -> DataFrame:
    from stemma.sources.lineage_text import render_sources

    return _written(t, render_sources(t.sources, t.repositories)).sources().drop("rec")


oracle("ingest_sources", f"SELECT id, {', '.join(f'{PLAIN(c)} AS {c}' for c in ('title', 'author', 'publication'))}, {ptr('repository_id')} AS repository_id, {PLAIN('note')} AS note FROM sources")


@query
def ingest_repositories(t: Tree) -> DataFrame:
    from stemma.sources.lineage_text import render_sources

    return _written(t, render_sources(t.sources, t.repositories)).repositories()


oracle("ingest_repositories", f"SELECT id, {', '.join(f'{PLAIN(c)} AS {c}' for c in ('name', 'address', 'url'))} FROM repositories")
