"""People and places by distance from a point or inside a box, and the resolution of places to coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.functions.similarity import near_pairs, weighted_udf
from stemma.operators.nearby import great_circle_km, usable
from stemma.plans.model import Tree

KM_PER_MILE = 1.609344


def located(tree: Tree) -> DataFrame:
    return tree.places.select(F.col("id").alias("place_id"), "original", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).where(usable(F.col("latitude"), F.col("longitude")))


def distances(tree: Tree, lat: float, lon: float, unit: str = "miles") -> DataFrame:
    """(place_id, distance) of every place with a usable coordinate."""
    km = great_circle_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return located(tree).select("place_id", "lat", "lon", (km if unit == "km" else km / KM_PER_MILE).alias("distance"))


def _box(df: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """A bounding box ahead of the exact distance, so that a scan can skip by latitude."""
    d = km / 110.0
    return df.where(F.col("lat").between(lat - d, lat + d))


def people_near(tree: Tree, lat: float, lon: float, radius: float = 50, unit: str = "miles", event_types: list[str] | None = None, most: int | None = 100) -> DataFrame:
    """(id, name, distance, matches): people with a place within the radius (1..500), nearest first. The unit is that of
    radius and result alike. matches counts their places in reach, of the given types if any are given."""
    radius = min(500, max(1, radius))
    near = _box(distances(tree, lat, lon, unit), lat, lon, radius * (1 if unit == "km" else KM_PER_MILE)).where(F.col("distance") <= radius)
    b = tree.individual_place.select("individual_id", "place_id", "kind")
    if event_types:
        b = b.where(F.col("kind").isin([t.upper() for t in event_types]))
    hits = b.join(near, "place_id").groupBy("individual_id").agg(F.round(F.min("distance"), 1).alias("distance"), F.count("*").alias("matches"))
    out = hits.join(tree.names, hits.individual_id == F.col("id")).select("id", "name", "distance", "matches", "ord")
    return out if most is None else out.orderBy("distance", "ord").limit(most)


def people_within(tree: Tree, south: float, north: float, west: float, east: float, event_types: list[str] | None = None, most: int | None = 100) -> DataFrame:
    """(id, name, matches): people with a place inside the closed box, in file order."""
    inside = located(tree).where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("place_id")
    b = tree.individual_place.select("individual_id", "place_id", "kind")
    if event_types:
        b = b.where(F.col("kind").isin([t.upper() for t in event_types]))
    hits = b.join(inside, "place_id", "left_semi").groupBy("individual_id").agg(F.count("*").alias("matches"))
    out = hits.join(tree.names, hits.individual_id == F.col("id")).select("id", "name", "matches", "ord")
    return out if most is None else out.orderBy("ord").limit(max(1, most))


def geocode(places: DataFrame, gazetteer: DataFrame, cache: DataFrame | None = None, check_country: bool = False) -> DataFrame:
    """(id, lat, lon, source, confidence) of places(id, original, latitude, longitude): the cache, then nothing for places
    that have no coordinates, then the place's own, then the gazetteer(name, country, lat, lon), else not_found.

    The gazetteer is asked by the first component: an equal name is of high confidence, a ratio of 85 or more of medium.
    """
    first = F.lower(F.element_at(F.concat(X.place_components(F.col("original")), F.array(F.lit(""))), 1))
    last = F.lower(F.element_at(F.concat(F.array(F.lit("")), X.place_components(F.col("original"))), -1))
    p = places.select("id", "original", F.col("latitude").alias("own_lat"), F.col("longitude").alias("own_lon"), first.alias("first"), last.alias("country_name"))
    g = gazetteer.select(F.lower("name").alias("g_name"), F.lower("country").alias("g_country"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    fits = (F.col("country_name") == F.col("g_country")) if check_country else F.lit(True)
    exact = p.join(g, (F.col("first") == F.col("g_name")) & fits).groupBy("id").agg(F.min(F.struct("g_lat", "g_lon")).alias("e"))
    rest = p.where("first <> ''").join(exact, "id", "left_anti").select("first", "country_name").distinct()
    alike = near_pairs(rest.select(F.col("first").alias("a")).distinct(), g.select(F.col("g_name").alias("b")).distinct())
    near = rest.join(alike, F.col("first") == F.col("a")).join(g, (F.col("b") == F.col("g_name")) & fits)
    near = near.groupBy("first", "country_name").agg(F.max_by(F.struct("g_lat", "g_lon"), F.struct("r", "g_lat", "g_lon")).alias("m"))
    out = p.join(exact, "id", "left").join(near, ["first", "country_name"], "left")
    if cache is not None:
        out = out.join(cache.select("id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.lit(True).alias("c")), "id", "left")
    else:
        out = out.withColumn("c", F.lit(False)).withColumn("c_lat", F.lit(None).cast("double")).withColumn("c_lon", F.lit(None).cast("double"))
    source = F.when(F.col("c"), "cache").when(X.ungeocodable(F.coalesce("original", F.lit(""))), "ungeocodable").when(F.col("own_lat").isNotNull() & F.col("own_lon").isNotNull(), "own").when(F.col("e").isNotNull(), "gazetteer").when(F.col("m").isNotNull(), "gazetteer").otherwise("not_found")
    out = out.withColumn("source", source)
    level = F.when(F.col("source").isin("cache", "own"), "high").when((F.col("source") == "gazetteer") & F.col("e").isNotNull(), "high").when(F.col("source") == "gazetteer", "medium").otherwise("low")
    pick = lambda c: F.when(F.col("source") == "cache", F.col(f"c_{c}")).when(F.col("source") == "own", F.col(f"own_{c}")).when(F.col("source") == "gazetteer", F.coalesce(F.col("e")[f"g_{c}"], F.col("m")[f"g_{c}"]))
    return out.select("id", pick("lat").alias("lat"), pick("lon").alias("lon"), "source", level.alias("confidence"))


def confidence_of(importance):
    """Confidence by a geocoder's importance."""
    return F.when(importance > 0.6, "high").when(importance > 0.3, "medium").otherwise("low")


#: Degrees of latitude or longitude from which on a box is a region rather than a point.
REGION_DEGREES = 0.5


def is_region(south, north, west, east):
    """Whether a box spans a region: null where a side is missing."""
    return ((north - south) > REGION_DEGREES) | (F.abs(east - west) > REGION_DEGREES)


def resolve_location(tree: Tree, query: str, gazetteer: DataFrame | None = None, like: float = 80, box: bool = False) -> DataFrame:
    """(lat, lon, matched, tier, confidence, south, north, west, east, is_region) of a place named in words.

    Tier 1 is the place of that normalised form, 2 one like it by weighted ratio (high from 95 up, else medium), 3 the
    gazetteer(name, lat, lon[, south, north, west, east]) by the first component. With ``box`` the gazetteer comes
    first, since it alone knows boxes. No row if there is none.
    """
    q = X.normalize_place(F.lit(query))
    p = tree.places.where(usable(F.col("latitude"), F.col("longitude"))).select("normalized", "original", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "ord")
    score = F.when(F.col("normalized") == q, 100.0).otherwise(weighted_udf(F.col("normalized"), q))
    found = p.withColumn("score", score).where(F.col("score") >= like)
    tier = F.when(F.col("normalized") == q, 1).otherwise(2)
    none = F.lit(None).cast("double")
    rows = found.select("lat", "lon", F.col("original").alias("matched"), tier.alias("tier"), F.when(F.col("score") >= 95, "high").otherwise("medium").alias("confidence"), "score", "ord", *[none.alias(c) for c in ("south", "north", "west", "east")])
    if gazetteer is not None:
        side = lambda c: F.col(c).cast("double") if c in gazetteer.columns else none
        g = gazetteer.where(F.lower("name") == query.split(",")[0].strip().lower())
        g = g.select("lat", "lon", F.col("name").alias("matched"), F.lit(0 if box else 3).alias("tier"), F.lit("high").alias("confidence"), F.lit(100.0).alias("score"), F.lit(0).cast("bigint").alias("ord"), *[side(c).alias(c) for c in ("south", "north", "west", "east")])
        rows = rows.unionByName(g)
    best = rows.orderBy("tier", F.desc("score"), "ord", "lat", "lon").limit(1).drop("score", "ord")
    return best.withColumn("is_region", F.coalesce(is_region(F.col("south"), F.col("north"), F.col("west"), F.col("east")), F.lit(False)))
