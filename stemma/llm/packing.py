"""Items of varying length into containers of fixed capacity, by harmonic classes.

An item of size s belongs to class k = floor(capacity / s): k items of the class fit one container whatever they are.
Filled by its own items alone a class leaves up to 1 / (k + 1) of the room empty, so each class is cut into narrower ones
and a container takes a fixed number of items of each of a few classes, complementary in size: a pattern. The patterns of
a block follow from the numbers of its classes alone: the largest class still filled opens one with as many items as
fit, and each next class that fits adds as many as fit; then the pattern is repeated for as long as its classes last.
Every block of items is packed on its own, so that nothing is compared across workers, and no item is looked at singly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Items a block should hold; in each block a few containers stay short, so fewer blocks waste less.
BLOCK_ITEMS = 50_000
#: Classes have at most this share of the capacity as width, and at least LEAST_PARTS parts each.
WIDTH, LEAST_PARTS = 1 / 256, 4


def pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, capacity, group, item, part, size): items longer than the capacity cut into full parts and a rest.

    Items without size (null, 0 or less) are left out: they need no room. A limit that is null or not positive packs nothing.
    """
    lim = limits.where("capacity > 0 and limit_id is not null").select("limit_id", "capacity")
    sized = items.where("size > 0 and item is not null").select("group", "item", F.col("size").cast("long").alias("size"))
    return (
        sized.crossJoin(F.broadcast(lim))
        .withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / F.col("capacity")) - 1).cast("int"))))
        .withColumn("size", F.least(F.col("capacity").cast("long"), F.col("size") - F.col("part").cast("long") * F.col("capacity")).cast("int"))
        .select("limit_id", "capacity", "group", "item", "part", "size")
    )


def classes(size: np.ndarray, capacity: int) -> np.ndarray:
    """A number for the class of each size: larger sizes have smaller or equal numbers."""
    k = capacity // size
    parts = np.maximum(LEAST_PARTS, np.ceil(1 / (WIDTH * k * (k + 1)))).astype(np.int64)
    # the part of (capacity / (k + 1), capacity / k], counted from the top
    part = np.minimum(parts - 1, ((capacity / k - size) / (capacity / (k * (k + 1))) * parts).astype(np.int64))
    return np.unique(k * (1 << 20) + part, return_inverse=True)[1]


def patterns(bound: np.ndarray, count: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(class, items)]): containers that take every item, given the largest size and the number of items of each
    class, largest first."""
    left = count.tolist()
    size = bound.tolist()
    falling = -bound
    out = []
    start = 0
    while start < len(size):
        if not left[start]:
            start += 1
            continue
        room, taken, at = capacity, [], start
        while at < len(size):
            if left[at]:
                n = min(left[at], room // size[at])
                if n:
                    taken.append((at, n))
                    room -= n * size[at]
            # the next class that fits
            at = max(at + 1, int(np.searchsorted(falling, -room)))
        times = min(left[c] // n for c, n in taken)
        for c, n in taken:
            left[c] -= n * times
        out.append((times, taken))
    return out


def containers(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each item its container's number, and whether its pattern is repeated."""
    of = classes(size, capacity)
    order = np.lexsort((-size, of))
    count = np.bincount(of)
    first = np.cumsum(count) - count
    bound = size[order][first]
    # within a class the items stand in order of size, so that containers of one pattern hold like items
    used = first.copy()
    nth, many = np.empty(len(size), np.int64), np.empty(len(size), bool)
    made = 0
    for times, taken in patterns(bound, count, capacity):
        for c, n in taken:
            rows = order[used[c] : used[c] + n * times]
            nth[rows] = made + np.arange(n * times) // n
            many[rows] = times > 1
            used[c] += n * times
        made += times
    return nth, many


def pack(items: DataFrame, limits: DataFrame, block_items: int = BLOCK_ITEMS, told: bool = False) -> DataFrame:
    """(limit_id, capacity, group, container, item, part, size) of items(group, item, size), limits(limit_id, capacity).

    limits is a table of settings, one row a container size. Items of one group share containers. Ties and
    repeated rows are items of their own; null groups are one group. Every part appears exactly once. ``told`` adds
    by_class: whether the item's pattern of fixed numbers fills more than one container of its block. ``items`` is read
    twice: to count and to pack.
    """
    parts = pieces(items, limits)
    # pre-aggregated numbers of items give the number of blocks
    sizes = parts.groupBy("limit_id", "group").agg(F.ceil(F.count("*") / F.lit(block_items)).cast("int").alias("blocks")).select(F.col("limit_id").alias("l_"), F.col("group").alias("g_"), "blocks")
    blocked = parts.join(sizes, (F.col("limit_id") == F.col("l_")) & F.col("group").eqNullSafe(F.col("g_"))).withColumn("block", F.pmod(F.xxhash64("item", "part"), F.col("blocks")).cast("int"))
    prefix = F.concat_ws("/", F.col("limit_id").cast("string"), F.xxhash64("group").cast("string"), F.col("block").cast("string"))
    blocked = blocked.withColumn("prefix", prefix).select("limit_id", "capacity", "group", "item", "part", "size", "prefix")
    out = ["limit_id", "capacity", "group", "container", "item", "part", "size", *(["by_class"] if told else [])]

    def fill(table):
        size = table.column("size").to_numpy().astype(np.int64)
        # equal sizes go in the order of their items, so that a block is packed alike however its rows arrive
        order = np.lexsort((table.column("part").to_numpy(), table.column("item").to_pandas().to_numpy()))
        nth, many = np.empty(len(size), np.int64), np.empty(len(size), bool)
        nth[order], many[order] = containers(size[order], int(table.column("capacity")[0].as_py()))
        start = table.column("prefix")[0].as_py()
        cols = {c: table.column(c) for c in ("limit_id", "capacity", "group", "item", "part", "size")}
        cols |= {"container": pa.array([f"{start}/{k}" for k in nth.tolist()], pa.string()), "by_class": pa.array(many)}
        return pa.table({c: cols[c] for c in out})

    kinds = {"container": StructField("container", StringType()), "by_class": StructField("by_class", BooleanType())}
    return blocked.groupBy("prefix").applyInArrow(fill, StructType([kinds.get(c) or blocked.schema[c] for c in out]))
