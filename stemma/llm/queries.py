"""Queries of the operators for training data. SQL stands where SQL can say the same on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import addresses, names, overlap, packing, personal, tokens, vectors
from stemma.functions import exprs
from stemma.plans import tables
from stemma.plans.workspace import Workspace


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.similar_pairs(tables.read(spark, folder, "person_vectors"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    people = tables.current(tables.read(spark, folder, "individuals").select("id", "notes", "loaded_at", "ord"), "id")
    cites = tables.current(tables.read(spark, folder, "citations").select("citation_id", "text", "loaded_at", "ord"), "citation_id")
    return overlap.overlapping(overlap.family_records(people, cites))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.same_location_pairs(tables.read(spark, folder, "places"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    people = names.persons(tables.individuals(spark, folder), tables.families(spark, folder))
    where = addresses.locations(tables.read(spark, folder, "places")).withColumnRenamed("id", "place_id")
    located = people.withColumn("place_id", exprs.place_id(F.col("place"))).join(where.hint("merge"), "place_id")
    return names.same_person_pairs(located, tables.read(spark, folder, "name_forms"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(tables.read(spark, folder, "documents"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = tokens.token_counts(tables.read(spark, folder, "documents").select("doc_id", "lang", "text"))
    # counted once, however often the numbers are read
    docs = Workspace(spark, "packing").save(docs, "counts")
    groups = F.explode(F.array(F.struct(F.lit("lang").alias("scope"), F.col("lang").alias("lang")), F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("lang"))))
    items = docs.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"), groups.alias("group"))
    limits = tables.read(spark, folder, "pack_limits").select("limit_id", F.col("capacity_tokens").alias("capacity"))
    return packing.pack(items, limits)


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each document, or part of one longer than the container, with its container, within its lang and over all."""
    p = _packed(spark, folder)
    return p.select(F.col("group.scope").alias("scope"), F.col("group.lang").alias("lang"), "limit_id", "capacity", "container", F.col("item").alias("doc_id"), "part", "size")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of room used, for each lang, over all, and each capacity."""
    p = p8_containers(spark, folder)
    one = p.groupBy("scope", "lang", "limit_id", "capacity", "container").agg(F.sum("size").alias("used"))
    return one.groupBy("scope", "lang", "limit_id", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / F.sum("capacity"), 4).alias("fill"))


def _finder(spark: SparkSession, folder: str) -> personal.Finder:
    t = lambda name: tables.read(spark, folder, name)
    return personal.finder(t("documents"), t("individuals"), t("name_forms"), t("places"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_items(tables.read(spark, folder, "documents"), _finder(spark, folder))


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redact(tables.read(spark, folder, "documents"), _finder(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p7_ids, p8_containers, p8_fill, p9_found, p9_redacted)}
ORACLE: dict[str, str] = {
    # the words two texts must share include one of the rarest of each; what meets by these is counted in full
    "p2_found": """WITH texts AS (
  SELECT id || '#' || CAST(generate_subscripts(notes, 1) - 1 AS VARCHAR) AS record, unnest(notes) AS text FROM (SELECT * FROM individuals QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, ord DESC) = 1) WHERE id IS NOT NULL
  UNION ALL SELECT 'C' || CAST(citation_id AS VARCHAR), text FROM (SELECT * FROM citations QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY loaded_at DESC, ord DESC) = 1)),
bags AS (SELECT record, list_sort(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS w FROM texts WHERE text IS NOT NULL),
long AS (SELECT record, w, len(w) AS n, dense_rank() OVER (ORDER BY w) AS no FROM bags WHERE len(w) >= 20),
one AS (SELECT DISTINCT no, w, n FROM long),
words AS (SELECT no, n, word, row_number() OVER (PARTITION BY no, word) AS nth FROM (SELECT no, n, unnest(w) AS word FROM one)),
df AS (SELECT word, nth, count(*) AS f FROM words GROUP BY ALL),
ranked AS (SELECT no, n, word, nth, f, row_number() OVER (PARTITION BY no ORDER BY f, word, nth) AS k FROM words JOIN df USING (word, nth)),
prefix AS (SELECT * FROM ranked WHERE k <= n - CAST(ceil(0.8 * n - 1e-9) AS INTEGER) + 1),
met AS (SELECT DISTINCT a.no AS x, b.no AS y FROM prefix a JOIN prefix b ON a.word = b.word AND a.nth = b.nth AND a.no < b.no AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
shared AS (SELECT x, y FROM met JOIN words a ON a.no = x JOIN words b ON b.no = y AND b.word = a.word AND b.nth = a.nth GROUP BY x, y HAVING count(*) >= 0.8 * greatest(any_value(a.n), any_value(b.n)) - 1e-9),
pairs AS (SELECT p.record AS r, q.record AS s FROM shared JOIN long p ON p.no = x JOIN long q ON q.no = y UNION ALL SELECT p.record, q.record FROM long p JOIN long q ON p.no = q.no AND p.record < q.record)
SELECT DISTINCT least(r, s) AS record_a, greatest(r, s) AS record_b FROM pairs WHERE r <> s""",
}
