"""Points near other points, and points in regions.

Distance join: coordinates become three-dimensional unit vectors, so that a radius on the sphere is a chord.
Planes of a k-d tree, fitted on a bounded sample, cut space into cells; each point is sent to its own cell and,
as a halo copy, to every cell within the chord. In each cell blocks of a local k-d tree are compared by their
bounding boxes first. Points at exactly the same coordinate travel once and are expanded at the end, and a cell
that the planes cannot thin out is split over several tasks by its own points.

Regions: polygon edges are swept over the points of their tile in order of latitude.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.plans.workspace import Workspace

EARTH_KM = 6371.0088
#: Points a cell should hold, and rows of the sample the planes are fitted on: bounds for the driver, not for the data.
CELL_POINTS = 4000
SAMPLE_POINTS = 40000
LEAF = 64


def usable(latitude: Column, longitude: Column) -> Column:
    """True for a pair that is on the globe and not the placeholder (0, 0); never null."""
    ok = latitude.between(-90, 90) & longitude.between(-180, 180) & ~F.isnan(latitude) & ~F.isnan(longitude) & ~((latitude == 0) & (longitude == 0))
    return F.coalesce(ok, F.lit(False))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in km on a sphere of the mean earth radius."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


class Planes:
    """Median splits along the widest axis of a sample, down to cells of about ``per_cell`` points of the whole."""

    def __init__(self, sample: np.ndarray, total: int, per_cell: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, low, high; axis -1: a cell, its number in low
        self.weight: list[float] = []
        scale = total / max(1, len(sample))

        def build(points: np.ndarray) -> int:
            here = len(self.nodes)
            self.nodes.append((-1, 0.0, 0, 0))
            if len(points) * scale > per_cell and len(points) > 1:
                axis = int(np.argmax(points.max(0) - points.min(0)))
                cut = float(np.median(points[:, axis]))
                low = points[:, axis] < cut
                if low.any() and not low.all():
                    a = build(points[low])
                    b = build(points[~low])
                    self.nodes[here] = (axis, cut, a, b)
                    return here
            self.nodes[here] = (-1, 0.0, len(self.weight), 0)
            self.weight.append(len(points) * scale)
            return here

        build(sample if len(sample) else np.zeros((1, 3)))

    def assign(self, xyz: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, rows whose ball of radius reach meets it, which of them lie in it)."""
        stack = [(0, np.arange(len(xyz)), np.ones(len(xyz), bool))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            axis, cut, a, b = self.nodes[node]
            if axis < 0:
                yield a, rows, home
                continue
            v = xyz[rows, axis]
            low = v < cut
            to_low, to_high = low | (v - reach < cut), ~low | (v + reach >= cut)
            stack.append((a, rows[to_low], (home & low)[to_low]))
            stack.append((b, rows[to_high], (home & ~low)[to_high]))


def local_blocks(xyz: np.ndarray) -> list[np.ndarray]:
    """Leaves of a k-d tree: arrays of row numbers."""
    out, stack = [], [np.arange(len(xyz))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        p = xyz[rows]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argsort(p[:, axis], kind="stable")
        half = len(rows) // 2
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


def within(home: np.ndarray, every: np.ndarray, chord: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (of home, of every) whose chord is at most that long, block by block."""
    if not len(home) or not len(every):
        return
    blocks = local_blocks(every)
    low = np.array([every[b].min(0) for b in blocks])
    high = np.array([every[b].max(0) for b in blocks])
    for q in local_blocks(home):
        p = home[q]
        gap = np.maximum(0, np.maximum(low - p.max(0), p.min(0) - high))
        near = np.flatnonzero((gap * gap).sum(1) <= chord * chord)
        if not len(near):
            continue
        rows = np.concatenate([blocks[i] for i in near])
        d = ((p[:, None, :] - every[rows][None, :, :]) ** 2).sum(2)
        i, j = np.nonzero(d <= chord * chord)
        yield q[i], rows[j]


def pairs_within(points: DataFrame, km: float, id_col: str = "id", lat: str = "latitude", lon: str = "longitude", cell_points: int = CELL_POINTS) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of points at most ``km`` apart on the great circle.

    Rows with a null id, a null or impossible coordinate or (0, 0) take no part. Rows repeated under one id
    count once; different ids at one coordinate are pairs. An empty table gives no rows. Other columns are ignored.
    """
    spark = points.sparkSession
    ws = Workspace(spark, "nearby")
    p = points.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon")))
    # one row a coordinate; its least id stands for it
    spots = ws.save(p.groupBy("lat", "lon").agg(F.min("id").alias("spot"), F.count_distinct("id").alias("n")), "spots")
    total = spots.count()
    if not total:
        return p.select(F.col("id").alias("id_a"), F.col("id").alias("id_b")).limit(0)
    part = min(1.0, 1.2 * SAMPLE_POINTS / total)
    # a bounded sample for the planes, the same on every run: rows in the lowest part of a hash
    picked = spots.where(F.pmod(F.xxhash64("lat", "lon"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("lat", "lon").limit(2 * SAMPLE_POINTS).toPandas()
    planes = Planes(_unit(picked.lat.to_numpy(), picked.lon.to_numpy()), total, cell_points)
    pieces = np.maximum(1, np.ceil(np.array(planes.weight) / (2 * cell_points))).astype(int)
    # a little wide: the exact great-circle test follows
    chord = 2 * np.sin(min(km / EARTH_KM, np.pi) / 2) * (1 + 1e-9) + 1e-12
    id_type = p.schema["id"].dataType
    packed = f"lat double, lon double, spot {id_type.simpleString()}, n bigint, cell int, piece int, home boolean"

    def place(batches):
        for batch in batches:
            xyz = _unit(batch.column("lat").to_numpy(zero_copy_only=False), batch.column("lon").to_numpy(zero_copy_only=False))
            for cell, rows, home in planes.assign(xyz, chord):
                taken = batch.take(pa.array(rows))
                k = int(pieces[cell])
                own = (rows % k).astype(np.int32)
                for piece in range(k):
                    # every piece gets all points of the cell, and a share of them as its own
                    mine = home & (own == piece)
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(rows), cell, np.int32)), pa.array(np.full(len(rows), piece, np.int32)), pa.array(mine)], names=[*batch.schema.names, "cell", "piece", "home"])

    placed = spots.select("lat", "lon", "spot", "n").mapInArrow(place, packed)

    def join(table):
        lat_, lon_ = table.column("lat").to_numpy(), table.column("lon").to_numpy()
        xyz, home = _unit(lat_, lon_), np.flatnonzero(table.column("home").to_numpy())
        left, right = [], []
        ids = table.column("spot").to_pandas().to_numpy()
        for i, j in within(xyz[home], xyz, chord):
            a = home[i]
            keep = ids[a] < ids[j]
            a, j = a[keep], j[keep]
            ok = _km(lat_[a], lon_[a], lat_[j], lon_[j]) <= km
            left.append(a[ok])
            right.append(j[ok])
        a = np.concatenate(left) if left else np.zeros(0, int)
        b = np.concatenate(right) if right else np.zeros(0, int)
        spot, n = table.column("spot"), table.column("n")
        return pa.table({"spot_a": spot.take(pa.array(a)), "spot_b": spot.take(pa.array(b)), "one": pa.array((n.to_numpy()[a] == 1) & (n.to_numpy()[b] == 1))})

    found = placed.groupBy("cell", "piece").applyInArrow(join, f"spot_a {id_type.simpleString()}, spot_b {id_type.simpleString()}, one boolean")
    found = ws.save(found, "found")
    single = found.where("one").select(F.col("spot_a").alias("id_a"), F.col("spot_b").alias("id_b"))
    crowded = spots.where("n > 1").select("lat", "lon", "spot")
    members = p.join(crowded, ["lat", "lon"]).select("spot", "id").distinct()
    spot_only = spots.where("n = 1").select("spot", F.col("spot").alias("id"))
    members = ws.save(members.unionByName(spot_only), "members")
    ma = members.select(F.col("spot").alias("sa"), F.col("id").alias("x"))
    mb = members.select(F.col("spot").alias("sb"), F.col("id").alias("y"))
    many = found.where("not one")
    across = many.join(ma, many.spot_a == ma.sa).join(mb, F.col("spot_b") == mb.sb).where("x != y")
    inside = crowded.select("spot").join(ma, F.col("spot") == F.col("sa")).join(mb, F.col("spot") == F.col("sb")).where("x < y")
    extra = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(inside.select(F.col("x").alias("id_a"), F.col("y").alias("id_b")))
    return single.unionByName(extra) if _ids_unique(p) else single.unionByName(extra).distinct()


def _ids_unique(p: DataFrame) -> bool:
    """Whether no id has two coordinates, so that no pair can come twice."""
    return p.groupBy("id").agg(F.count_distinct("lat", "lon").alias("k")).where("k > 1").isEmpty()


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], 1)


def _km(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def regions_of(points: DataFrame, regions: DataFrame, tile_degrees: float = 5.0, task_points: int = 100_000) -> DataFrame:
    """(id, region_id) of points(id, latitude, longitude) inside regions(region_id, ring: array<struct<lat, lon>>).

    A ring is closed by itself and must not cross the antimeridian; its lower and left edges belong to it, its
    upper and right ones do not. Points without a usable coordinate (see ``usable``) and rings that are null,
    hold nulls or have fewer than three corners take no part; a point in several regions gives several rows.
    Points and the edges near them meet by tile; a tile of more than ``task_points`` points is several groups.
    """
    t = tile_degrees
    pts = points.select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).where(F.col("id").isNotNull() & usable(F.col("latitude"), F.col("longitude")))
    pts = pts.select("id", "lat", "lon", F.floor(F.col("lat") / t).cast("int").alias("ty"), F.floor(F.col("lon") / t).cast("int").alias("tx"))
    # tiles are at most the globe's, so their counts are a small table
    counts = pts.groupBy("ty", "tx").agg(F.ceil(F.count("*") / F.lit(task_points)).cast("int").alias("pieces"))
    pts = pts.join(F.broadcast(counts), ["ty", "tx"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    good = regions.where(F.col("region_id").isNotNull() & (F.size("ring") >= 3) & ~F.exists("ring", lambda c: c["lat"].isNull() | c["lon"].isNull()))
    box = lambda f, k: f(F.transform("ring", lambda c: c[k]))
    tiles = good.withColumn("ty", F.explode(F.sequence(F.floor(box(F.array_min, "lat") / t), F.floor(box(F.array_max, "lat") / t)))).withColumn("tx", F.explode(F.sequence(F.floor(box(F.array_min, "lon") / t), F.floor(box(F.array_max, "lon") / t))))
    tiles = tiles.join(F.broadcast(counts), ["ty", "tx"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("region_id", F.transform("ring", lambda c: c["lat"]).alias("ys"), F.transform("ring", lambda c: c["lon"]).alias("xs"), F.col("ty").cast("int").alias("ty"), F.col("tx").cast("int").alias("tx"), "piece")
    schema = f"id {pts.schema['id'].dataType.simpleString()}, region_id {good.schema['region_id'].dataType.simpleString()}"

    def sweep(_key, p, r):
        if not len(p) or not len(r):
            return pd.DataFrame({"id": p["id"].iloc[:0], "region_id": r["region_id"].iloc[:0]})
        p = p.sort_values("lat", kind="stable")
        lat, lon, ids = p["lat"].to_numpy(), p["lon"].to_numpy(), p["id"].to_numpy()
        out = []
        for region, ys, xs in zip(r["region_id"], r["ys"], r["xs"]):
            y0, x0 = np.asarray(ys, float), np.asarray(xs, float)
            y1, x1 = np.roll(y0, -1), np.roll(x0, -1)
            inside = np.zeros(len(lat), bool)
            # an edge is met by the points from its lower end, taken in, to its upper end, left out
            first = np.searchsorted(lat, np.minimum(y0, y1), "left")
            last = np.searchsorted(lat, np.maximum(y0, y1), "left")
            for k in np.flatnonzero(last > first):
                s = slice(first[k], last[k])
                cross = x0[k] + (lat[s] - y0[k]) * (x1[k] - x0[k]) / (y1[k] - y0[k])
                inside[s] ^= lon[s] < cross
            out.append(pd.DataFrame({"id": ids[inside], "region_id": region}))
        return pd.concat(out, ignore_index=True)

    keys = ["ty", "tx", "piece"]
    return pts.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInPandas(sweep, schema)
