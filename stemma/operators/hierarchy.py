"""Parent-child links of unknown depth to roots, depths, paths and descendants, by tree contraction.

Each round rakes the leaves (nodes that are nobody's parent any more) and then compresses unary chains: an
independent set of nodes with one child is spliced out, the child taking over the parent and the added
length. Every removal is recorded with its parent and distance at that time. When only roots are left the
recorded removals are undone last to first, each round one equi-join against the nodes already known. A
cycle cannot be raked; compression shrinks it to a node that is its own parent, which marks it and all that
hangs on it. Rounds grow with the logarithm of the number of nodes, not with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stemma.plans.workspace import Workspace

CYCLE = "cycle"


def contract(links: DataFrame, ws: Workspace, trail: bool = False, max_rounds: int = 200) -> int:
    """links(id, parent): one row an id, parent null at roots and never dangling.

    Writes a table round0, round1, ... for each round, of (id, parent, w, via, gone): what the round removed and
    what it left, parents being nodes that are left after it. With ``trail`` via lists the nodes spliced out between
    parent and id, from the parent on; else it is null. Returns the number of rounds; the last one leaves only roots
    and nodes that are their own parent.
    """
    kind = links.schema["id"].dataType.simpleString()
    none = F.lit(None).cast(f"array<{kind}>")
    state = after = links.select("id", "parent", F.lit(1).alias("w"), (F.array().cast(f"array<{kind}>") if trail else none).alias("via"))
    for turn in range(max_rounds):
        if turn:
            state = after.where("not gone").drop("gone")
        kids = state.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"), F.min("id").alias("only")).withColumnRenamed("parent", "k_id")
        marked = state.join(kids, state.id == kids.k_id, "left").drop("k_id")
        heads = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0
        inner = F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))
        # heads with one child that is tails: no two neighbours go at once, so the parent found here stays
        spliced = F.coalesce(inner & (F.col("n") == 1) & (F.col("only") != F.col("id")) & heads(F.col("id")) & ~heads(F.col("only")), F.lit(False))
        leaf = F.col("parent").isNotNull() & F.col("n").isNull()
        marked = marked.withColumn("gone", leaf | spliced)
        by_child = marked.where(spliced).select(F.col("only").alias("c_id"), F.col("parent").alias("c_parent"), F.col("w").alias("c_w"), (F.concat("via", F.array("id")) if trail else none).alias("c_via"))
        way = F.when(F.col("c_id").isNull(), F.col("via")).otherwise(F.concat("c_via", "via")) if trail else F.col("via")
        after = marked.join(by_child, marked.id == by_child.c_id, "left")
        after = after.select("id", F.coalesce("c_parent", "parent").alias("parent"), (F.col("w") + F.coalesce("c_w", F.lit(0))).cast("int").alias("w"), way.alias("via"), "gone")
        seen = Observation()
        after = ws.save(after.observe(seen, F.count_if(~F.col("gone") & inner).alias("open")), f"round{turn}")
        if not seen.get["open"]:
            return turn + 1
    raise RuntimeError(f"not contracted after {max_rounds} rounds")


def resolve(links: DataFrame, trail: bool = False) -> DataFrame:
    """(id, root_id, depth) of links(id, parent), with ``trail`` also way: the ids from the root down to the node.

    Rows with a null id are left out, repeated ids count once (the least parent), a parent that is no id
    counts as none. On or leading into a cycle: root_id 'cycle', depth -1, the way only the node. An empty table gives
    no rows. The contractions recorded are undone last to first; tables no longer needed are removed.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "hierarchy")
    nodes = links.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    known = nodes.select(F.col("id").alias("k"))
    rounds = contract(nodes.join(known, nodes.parent == known.k, "left").select("id", F.col("k").alias("parent")), ws, trail)
    form = nodes.schema["id"].dataType.simpleString()
    kind = f"id {form}, parent {form}, w int, via array<{form}>, gone boolean"
    of = lambda k: spark.read.schema(kind).parquet(ws.path(f"round{k}"))
    cyclic = F.col("parent").isNotNull()
    out = ["id", "root_id", "depth", *(["way"] if trail else [])]
    core = of(rounds - 1).where("not gone").select("id", F.when(cyclic, F.lit(CYCLE)).otherwise(F.col("id")).alias("root_id"), F.when(cyclic, F.lit(-1)).otherwise(F.lit(0)).alias("depth"), F.array("id").alias("way")).select(*out)
    ws.save(core, "done0")
    every = lambda k: spark.read.schema(core.schema).parquet(*[ws.path(f"done{i}") for i in range(k)])
    for k in range(1, rounds + 1):
        gone = of(rounds - k).where("gone")
        up = every(k).select(F.col("id").alias("u_id"), "root_id", F.col("depth").alias("u_depth"), *([F.col("way").alias("u_way")] if trail else []))
        astray = F.col("u_depth") < 0
        more = gone.join(up, gone.parent == up.u_id).withColumn("depth", F.when(astray, F.lit(-1)).otherwise(F.col("u_depth") + F.col("w")).cast("int"))
        if trail:
            more = more.withColumn("way", F.when(astray, F.array("id")).otherwise(F.concat("u_way", "via", F.array("id"))))
        more = more.select(*out)
        if k == rounds:
            return every(k).unionByName(more)
        ws.save(more, f"done{k}")
        ws.drop(f"round{rounds - k}")


def ancestry(links: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance) for every node and each node above it, itself at 0: read upwards the
    path, read downwards all descendants. The rows are the answer's own size. Whoever ends in a cycle has
    only the row of itself."""
    return resolve(links, trail=True).select("id", F.posexplode(F.reverse("way")).alias("distance", "ancestor_id")).select("id", "ancestor_id", "distance")


def paths(links: DataFrame, separator: str = " > ") -> DataFrame:
    """(id, path): ids from the root down to the node; of a node on or above a cycle only the node."""
    return resolve(links, trail=True).select("id", F.array_join("way", separator).alias("path"))


def parent_links(individuals: DataFrame, families: DataFrame) -> DataFrame:
    """(id, parent) of people: the husband of the family the person belongs to if he exists, else the wife if
    she exists. The family is family_as_child or, if null, the one whose children_ids list the person (the
    least id of several). All ids are compared in the form @..@.
    """
    from stemma.plans.tables import pointer

    people = individuals.select(pointer(F.col("id")).alias("id"), pointer(F.col("family_as_child")).alias("famc")).where("id is not null").groupBy("id").agg(F.min("famc").alias("famc"))
    fam = families.select(pointer(F.col("id")).alias("fam_id"), pointer(F.col("husband_id")).alias("husband"), pointer(F.col("wife_id")).alias("wife"), "children_ids").where("fam_id is not null")
    listed = fam.select("fam_id", F.explode("children_ids").alias("child")).select("fam_id", pointer(F.col("child")).alias("child")).where("child is not null").groupBy("child").agg(F.min("fam_id").alias("by_list"))
    person = people.join(listed, people.id == listed.child, "left").select("id", F.coalesce("famc", "by_list").alias("fam"))
    exists = people.select(F.col("id").alias("e"))
    heads = fam.select("fam_id", "husband", "wife")
    husbands = heads.join(exists, heads.husband == exists.e, "left").select("fam_id", F.col("e").alias("husband"), "wife")
    couples = husbands.join(exists, husbands.wife == exists.e, "left").select("fam_id", F.coalesce("husband", "e").alias("head")).where("head is not null").groupBy("fam_id").agg(F.min("head").alias("head"))
    return person.join(couples, person.fam == couples.fam_id, "left").select("id", F.col("head").alias("parent"))
