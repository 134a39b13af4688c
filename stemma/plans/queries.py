"""Queries of the core by name, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.operators import hierarchy, nearby
from stemma.plans import catalogue, tables

Query = Callable[[SparkSession, str], DataFrame]


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.parent_links(tables.individuals(spark, folder), tables.families(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, folder)).withColumnRenamed("id", "individual_id")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.paths(_links(spark, folder)).withColumnRenamed("id", "individual_id")


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.ancestry(_links(spark, folder)).where("distance > 0").selectExpr("ancestor_id", "id as descendant_id", "distance")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearby.pairs_within(tables.read(spark, folder, "places"), 5.0)


def p6_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The cell of a ten-degree graticule, drawn as polygons, in which each place lies."""
    cells = spark.range(18 * 36).selectExpr(
        "concat(cast(id div 36 as string), '/', cast(id % 36 as string)) as region_id", "cast(id div 36 as double) * 10 - 90 as y", "cast(id % 36 as double) * 10 - 180 as x"
    ).selectExpr("region_id", "array(named_struct('lat', y, 'lon', x), named_struct('lat', y, 'lon', x + 10), named_struct('lat', y + 10, 'lon', x + 10), named_struct('lat', y + 10, 'lon', x)) as ring")
    return nearby.regions_of(tables.read(spark, folder, "places"), cells)


QUERIES: dict[str, Query] = {**catalogue.QUERIES, **{f.__name__: f for f in (p5_found, p5_paths, p5_descendants, p6_found, p6_regions)}}

CURRENT = """
ind AS (SELECT * FROM individuals QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, ord DESC) = 1),
fam AS (SELECT * FROM families QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, ord DESC) = 1)
"""

LINKS = f"""{CURRENT},
n_ind AS (SELECT '@' || trim(id, '@') || '@' AS id, CASE WHEN trim(family_as_child, '@') <> '' THEN '@' || trim(family_as_child, '@') || '@' END AS famc FROM ind),
n_fam AS (SELECT '@' || trim(id, '@') || '@' AS id, '@' || trim(husband_id, '@') || '@' AS husband, '@' || trim(wife_id, '@') || '@' AS wife, children_ids FROM fam),
listed AS (SELECT child, min(id) AS fam_id FROM (SELECT id, '@' || trim(unnest(children_ids), '@') || '@' AS child FROM n_fam) GROUP BY child),
links AS (
  SELECT p.id, coalesce(h.id, w.id) AS parent FROM n_ind p LEFT JOIN listed l ON l.child = p.id
  LEFT JOIN n_fam f ON f.id = coalesce(p.famc, l.fam_id) LEFT JOIN n_ind h ON h.id = f.husband LEFT JOIN n_ind w ON w.id = f.wife)
"""

ORACLE: dict[str, str] = {
    "p5_found": f"""WITH RECURSIVE {LINKS},
up AS (SELECT id AS individual_id, id AS node, 0 AS depth FROM links
  UNION ALL SELECT u.individual_id, l.parent, u.depth + 1 FROM up u JOIN links l ON l.id = u.node WHERE l.parent IS NOT NULL AND u.depth < 400)
SELECT individual_id, CASE WHEN max(depth) >= 400 THEN 'cycle' ELSE max_by(node, depth) END AS root_id,
  CAST(CASE WHEN max(depth) >= 400 THEN -1 ELSE max(depth) END AS INTEGER) AS depth FROM up GROUP BY individual_id""",
    "p5_descendants": f"""WITH RECURSIVE {LINKS},
up AS (SELECT id AS descendant_id, id AS ancestor_id, 0 AS distance FROM links
  UNION ALL SELECT u.descendant_id, l.parent, u.distance + 1 FROM up u JOIN links l ON l.id = u.ancestor_id WHERE l.parent IS NOT NULL AND u.distance < 400)
SELECT ancestor_id, descendant_id, CAST(distance AS INTEGER) AS distance FROM up
WHERE distance > 0 AND descendant_id NOT IN (SELECT descendant_id FROM up WHERE distance = 400)""",
    "p5_paths": f"""WITH RECURSIVE {LINKS},
up AS (SELECT id AS individual_id, id AS node, id AS path, 0 AS depth FROM links
  UNION ALL SELECT u.individual_id, l.parent, l.parent || ' > ' || u.path, u.depth + 1 FROM up u JOIN links l ON l.id = u.node WHERE l.parent IS NOT NULL AND u.depth < 400)
SELECT individual_id, CASE WHEN max(depth) >= 400 THEN individual_id ELSE max_by(path, depth) END AS path FROM up GROUP BY individual_id""",
    "p6_found": """WITH p AS (SELECT * FROM places WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0))
SELECT a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.id < b.id AND abs(a.latitude - b.latitude) < 0.1
WHERE 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) <= 5.0""",
    "p6_regions": """SELECT id, CAST(CAST(floor(latitude / 10) + 9 AS INTEGER) AS VARCHAR) || '/' || CAST(CAST(floor(longitude / 10) + 18 AS INTEGER) AS VARCHAR) AS region_id FROM places
WHERE latitude >= -90 AND latitude < 90 AND longitude >= -180 AND longitude < 180 AND NOT (latitude = 0 AND longitude = 0)""",
}

ORACLE |= catalogue.ORACLE
