"""Places: spellings, likeness, sound, former names, and the people and events found by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.functions.similarity import metaphone, metaphone_udf, weighted_udf
from stemma.plans.model import Tree
from stemma.plans.tables import union_all


def historical_table(tree: Tree) -> DataFrame:
    """(name, variant), both ways; a few dozen rows."""
    both = sorted({*X.HISTORICAL, *((b, a) for a, b in X.HISTORICAL)})
    return tree.spark.createDataFrame(both, "name string, variant string")


def historical_variants(tree: Tree, places: DataFrame) -> DataFrame:
    """(place, variant), distinct, of places(place): other names of its components and of its words."""
    words = F.array_union(F.split(F.lower("place"), r"[\s,]+"), F.transform(X.place_components(F.lower("place")), lambda c: c))
    named = places.select("place", F.explode(words).alias("w")).distinct()
    return named.join(F.broadcast(historical_table(tree)), F.col("w") == F.col("name")).select("place", "variant").distinct()


def fuzzy(tree: Tree, query: str, threshold: float = 70, most: int = 100) -> DataFrame:
    """(id, normalized, score): places by weighted ratio with the normalised query, best first."""
    q = F.lit(query)
    scored = tree.places.select("id", "normalized", weighted_udf(F.col("normalized"), X.normalize_place(q)).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(most)


def phonetic(tree: Tree, query: str) -> DataFrame:
    """(id, normalized): places whose first word sounds like the query's."""
    first = lambda c: F.element_at(F.split(F.element_at(X.place_components(c), 1), " "), 1)
    word = (query.split(",")[0].split() or [""])[0]
    return tree.places.where((metaphone_udf(first(F.col("original"))) == metaphone(word)) & F.lit(metaphone(word) != "")).select("id", "normalized")


def similar(tree: Tree, query: str, most: int = 20) -> DataFrame:
    """(id, normalized, score, phonetic): likeness from 50 up, then places that only sound alike at 60."""
    near, sound = fuzzy(tree, query, 50, 100), phonetic(tree, query)
    flagged = near.join(sound.select(F.col("id").alias("s")), F.col("id") == F.col("s"), "left").select("id", "normalized", "score", F.col("s").isNotNull().alias("phonetic"))
    only = sound.join(near.select(F.col("id").alias("f")), F.col("id") == F.col("f"), "left_anti").select("id", "normalized", F.lit(60.0).alias("score"), F.lit(True).alias("phonetic"))
    # likeness fills the limit first
    kept = flagged.withColumn("turn", F.lit(0)).unionByName(only.withColumn("turn", F.lit(1))).orderBy("turn", F.desc("score"), "id").limit(most)
    return kept.drop("turn").orderBy(F.desc("score"), "id")


def variants(tree: Tree, query: str) -> DataFrame:
    """(id, match_type, score): the same normalised form, else the same sound, else likeness from 85 up."""
    same = tree.places.where(F.col("normalized") == X.normalize_place(F.lit(query))).select("id", F.lit("normalized").alias("match_type"), F.lit(100.0).alias("score"), F.lit(1).alias("turn"))
    sound = phonetic(tree, query).select("id", F.lit("phonetic").alias("match_type"), F.lit(60.0).alias("score"), F.lit(2).alias("turn"))
    near = fuzzy(tree, query, 85).select("id", F.lit("fuzzy").alias("match_type"), "score", F.lit(3).alias("turn"))
    rows = union_all([same, sound, near])
    return rows.groupBy("id").agg(F.min_by(F.struct("match_type", "score"), "turn").alias("m")).select("id", "m.*")


def place_scores(tree: Tree, query: str, threshold: float = 70, exact_only: bool = False) -> DataFrame:
    """(place_id, score) by strategy in order: text contained 100, normalised form contained 95, likeness (if higher),
    sound 60, former name 80; the last two only where nothing scored before, sound first."""
    b = tree.individual_place.select("place_id", "place", "place_norm").distinct()
    sub = b.where(F.lower("place").contains(query.lower())).select("place_id", F.lit(100.0).alias("score"), F.lit(1).alias("turn"))
    norm = b.where(F.col("place_norm").contains(X.normalize_place(F.lit(query)))).select("place_id", F.lit(95.0).alias("score"), F.lit(2).alias("turn"))
    hist = historical_variants(tree, tree.spark.createDataFrame([(query,)], "place string")).select("variant")
    old = b.join(F.broadcast(hist), F.lower("place").contains(F.col("variant"))).select("place_id", F.lit(80.0).alias("score"), F.lit(5).alias("turn"))
    parts = [sub, norm, old]
    if not exact_only:
        parts += [fuzzy(tree, query, threshold).select(F.col("id").alias("place_id"), "score", F.lit(3).alias("turn")), phonetic(tree, query).select(F.col("id").alias("place_id"), F.lit(60.0).alias("score"), F.lit(4).alias("turn"))]
    rows = union_all(parts).groupBy("place_id").agg(
        F.max(F.when(F.col("turn") <= 3, F.col("score"))).alias("strong"), F.max(F.when(F.col("turn") == 4, F.col("score"))).alias("sound"), F.max(F.when(F.col("turn") == 5, F.col("score"))).alias("old"))
    return rows.select("place_id", F.coalesce("strong", "sound", "old").alias("score"))


def people_by_place(tree: Tree, query: str, threshold: float = 70, most: int | None = 50, exact_only: bool = False) -> DataFrame:
    """(id, name, place_id, score): people by their best-scoring place, best first."""
    s = place_scores(tree, query, threshold, exact_only)
    j = tree.individual_place.select("individual_id", "place_id").distinct().join(s, "place_id")
    best = j.groupBy("individual_id").agg(F.max_by(F.struct("place_id", "score"), F.struct("score", F.expr("-xxhash64(place_id)"))).alias("b"))
    out = best.join(tree.names, F.col("individual_id") == F.col("id")).select("id", "name", F.col("b.score").alias("score"), "ord")
    return out if most is None else out.orderBy(F.desc("score"), "ord").limit(most)


def cluster(tree: Tree, query: str, most: int = 100) -> DataFrame:
    """(type, events): event counts, over people found by the place, of events whose place holds the query or a variant."""
    people = people_by_place(tree, query, 70, most).select("id")
    names = variants(tree, query).join(tree.places.select(F.col("id").alias("p"), "normalized"), F.col("id") == F.col("p")).select("normalized")
    e = tree.events.join(people, F.col("individual_id") == F.col("id"), "left_semi").select("individual_id", "event_ord", "type", "place", "place_norm")
    direct = e.where(F.lower("place").contains(query.lower()))
    by_variant = e.join(names, e.place_norm == names.normalized, "left_semi")
    return direct.unionByName(by_variant).select("individual_id", "event_ord", "type").distinct().groupBy("type").agg(F.count("*").alias("events"))


def distinct_places(tree: Tree) -> DataFrame:
    """(id, original, normalized, n_components): the reading of each stored spelling, from its text alone."""
    o = F.col("original")
    return tree.places.select("id", X.place_id(o).alias("computed_id"), X.normalize_place(o).alias("normalized"), F.size(X.place_components(o)).alias("n_components"), F.array_join(X.place_components(o), " | ").alias("components"))


def match(a, b, threshold: float = 80):
    """Whether two places are equal, alike by ratio, or one contains the other; null if either is null."""
    from stemma.functions.similarity import ratio_at_least

    return (a == b) | a.contains(b) | b.contains(a) | ratio_at_least(a, b, threshold)
