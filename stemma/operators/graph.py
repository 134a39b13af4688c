"""Recursion over parents and children by level, each level an equi-join; levels are distinct, so that cycles and
many paths to one ancestor cost no more than the pairs themselves. Only where paths are the answer (``paths_up``)
does a level keep one row a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stemma.operators.lookup import ids_of
from stemma.plans.model import Tree
from stemma.plans.workspace import Workspace
from stemma.plans.tables import union_all

MAX_ANCESTORS, MAX_DESCENDANTS, MAX_TRAVERSE = 20, 10, 10
#: Pairs of a level up to which it is kept as a list of the plan; a larger one becomes a table.
FRONTIER = 5_000


def _everyone(tree: Tree) -> DataFrame:
    return tree.individuals.select("id").where("id is not null")


def closure(tree: Tree, generations: int = 10, seeds: list[str] | None = None, down: bool = False) -> DataFrame:
    """(root_id, relative_id, generation), distinct: ancestors (descendants with ``down``) of everyone or of the seeds."""
    ws = Workspace(tree.spark, "closure")
    edges = tree.child_edge.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")) if down else tree.parent_edge.select(F.col("child_id").alias("a"), F.col("parent_id").alias("b"))
    if seeds is not None:
        edges = tree.edges("down" if down else "up", edges)
        few = _few_levels(tree, edges, seeds, generations)
        if few is not None:
            return few
    else:
        edges = ws.save(edges.distinct(), "edges")
    start = _everyone(tree) if seeds is None else ids_of(tree, seeds).join(_everyone(tree), F.col("asked") == F.col("id")).select("id")
    return levels_of(ws, start.select(F.col("id").alias("root_id"), F.col("id").alias("relative_id")), edges, generations)


def levels_of(ws: Workspace, level: DataFrame, edges: DataFrame, generations: int) -> DataFrame:
    """(root_id, relative_id, generation), distinct, from level(root_id, relative_id) along edges(a, b); each level is a
    table, counted as it is written."""
    levels = []
    for g in range(1, generations + 1):
        seen = Observation()
        step = level.join(edges, level.relative_id == edges.a).select("root_id", F.col("b").alias("relative_id")).distinct()
        level = ws.save(step.observe(seen, F.count(F.lit(1)).alias("n")), f"level{g}")
        if not seen.get["n"]:
            break
        levels.append(level.withColumn("generation", F.lit(g)))
    return union_all(levels) if levels else level.withColumn("generation", F.lit(0)).limit(0)


def _few_levels(tree: Tree, edges: DataFrame, seeds: list[str], generations: int) -> DataFrame | None:
    """The closure of a few seeds, each level's pairs looked up as a list; None as soon as a level has more than FRONTIER."""
    asked = [r["id"] for r in ids_of(tree, seeds).select(F.col("asked").alias("id")).join(_everyone(tree), "id", "left_semi").collect()]
    level, out = {(i, i) for i in asked}, []
    for g in range(1, generations + 1):
        ends = sorted({b for _, b in level})
        if not ends:
            break
        met = edges.where(F.col("a").isin(ends)).limit(FRONTIER + 1).collect()
        if len(met) > FRONTIER:
            return None
        of: dict[str, list[str]] = {}
        for r in met:
            of.setdefault(r["a"], []).append(r["b"])
        level = {(root, b) for root, a in level for b in of.get(a, ())}
        if len(level) > FRONTIER:
            return None
        out += [(root, b, g) for root, b in sorted(level)]
    return tree.spark.createDataFrame(out, "root_id string, relative_id string, generation int")


def nearest(pairs: DataFrame) -> DataFrame:
    """The least generation of each pair."""
    return pairs.groupBy("root_id", "relative_id").agg(F.min("generation").alias("generation"))


def paths_up(tree: Tree, seed: str, generations: int = 4) -> DataFrame:
    """(generation, path, ancestor_id): one row for each way to an ancestor, the path in roles, as a tree is drawn."""
    ws = Workspace(tree.spark, "paths")
    edges = tree.edges("roles", tree.parent_edge.select("child_id", "parent_id", "role"))
    few = _few_paths(tree, edges, seed, min(generations, MAX_ANCESTORS))
    if few is not None:
        return few
    level = ids_of(tree, [seed]).join(_everyone(tree), F.col("asked") == F.col("id")).select(F.col("id").alias("ancestor_id"), F.lit("").alias("path"))
    level, out = ws.save(level, "level0"), []
    for g in range(1, min(generations, MAX_ANCESTORS) + 1):
        nxt = level.join(edges, level.ancestor_id == edges.child_id)
        level = ws.save(nxt.select(F.col("parent_id").alias("ancestor_id"), F.concat("path", F.when(F.col("path") != "", F.lit("/")).otherwise(F.lit("")), "role").alias("path")), f"level{g}")
        out.append(level.withColumn("generation", F.lit(g)))
        if level.isEmpty():
            break
    return union_all(out).select("generation", "path", "ancestor_id") if out else level.withColumn("generation", F.lit(0)).limit(0)


def _few_paths(tree: Tree, edges: DataFrame, seed: str, generations: int) -> DataFrame | None:
    """As paths_up, each level looked up as a list; None as soon as a level has more than FRONTIER paths."""
    asked = ids_of(tree, [seed]).select(F.col("asked").alias("id")).join(_everyone(tree), "id", "left_semi").collect()
    level, out = [(r["id"], "") for r in asked], []
    for g in range(1, generations + 1):
        met: dict[str, list[tuple[str, str]]] = {}
        ends = sorted({i for i, _ in level})
        if not ends:
            break
        # at most two parents a person, so no more rows than twice the level
        for r in edges.where(F.col("child_id").isin(ends)).collect():
            met.setdefault(r["child_id"], []).append((r["parent_id"], r["role"]))
        level = [(p, f"{path}/{role}" if path else role) for i, path in level for p, role in met.get(i, ())]
        if len(level) > FRONTIER:
            return None
        out += [(g, path, p) for p, path in level]
    return tree.spark.createDataFrame(out, "generation int, path string, ancestor_id string")


def terminal(tree: Tree, seed: str, generations: int = 20) -> DataFrame:
    """Ancestors whose family of birth names no parent, with the first path (father before mother) that reaches them."""
    ends = tree.famc_parents.select(F.col("child_id").alias("c")).distinct()
    up = paths_up(tree, seed, generations).join(ends, F.col("ancestor_id") == F.col("c"), "left_anti")
    return up.groupBy("ancestor_id").agg(F.min("path").alias("path"), F.min_by("generation", "path").alias("generation"))


def descendants(tree: Tree, seed: str, generations: int = 4) -> DataFrame:
    """(generation, parent_id, child_id): a descendant reached twice appears under each parent."""
    up = closure(tree, min(generations, MAX_DESCENDANTS) - 1, [seed], down=True) if generations > 1 else None
    me = ids_of(tree, [seed]).select(F.col("asked").alias("parent_id"), F.lit(0).alias("g"))
    if up is not None:
        me = me.unionByName(up.select(F.col("relative_id").alias("parent_id"), F.col("generation").alias("g")))
    return me.join(tree.child_edge, "parent_id").select((F.col("g") + 1).alias("generation"), "parent_id", "child_id").distinct() if generations > 0 else me.select(F.col("g").alias("generation"), "parent_id", F.col("parent_id").alias("child_id")).limit(0)


def common_ancestors(tree: Tree, id1: str, id2: str, generations: int = 10) -> DataFrame:
    """(ancestor_id, generation1, generation2), nearest first by their sum."""
    c = nearest(closure(tree, generations, [id1, id2]))
    one = c.where(F.col("root_id") == F.concat(F.lit("@"), F.lit(id1.strip("@")), F.lit("@"))).select("relative_id", F.col("generation").alias("generation1"))
    two = c.where(F.col("root_id") == F.concat(F.lit("@"), F.lit(id2.strip("@")), F.lit("@"))).select("relative_id", F.col("generation").alias("generation2"))
    return one.join(two, "relative_id").withColumnRenamed("relative_id", "ancestor_id").orderBy(F.col("generation1") + F.col("generation2"), "generation1", "ancestor_id")


def neighbours(tree: Tree, direction: str) -> DataFrame:
    """(a, b) edges of a direction: parents, children, spouses or siblings; any other has none."""
    if direction == "parents":
        return tree.parent_edge.select(F.col("child_id").alias("a"), F.col("parent_id").alias("b"))
    if direction == "children":
        return tree.child_edge.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b"))
    known = tree.individuals.select(F.col("id").alias("k"))
    if direction == "spouses":
        f = tree.spouse_family.select(F.col("person_id").alias("a"), F.when(F.col("husband_id") == F.col("person_id"), F.col("wife_id")).otherwise(F.col("husband_id")).alias("b"))
    elif direction == "siblings":
        f = tree.individuals.select(F.col("id").alias("a"), "famc").join(tree.family_children, F.col("famc") == F.col("family_id")).select("a", F.col("child_id").alias("b")).where("a <> b")
    else:
        return tree.parent_edge.select(F.col("child_id").alias("a"), F.col("parent_id").alias("b")).limit(0)
    return f.join(known, f.b == known.k, "left_semi")


def traverse(tree: Tree, seed: str, direction: str, depth: int = 1) -> DataFrame:
    """(id, level): breadth first, each person at the level first reached, the start left out."""
    ws = Workspace(tree.spark, "traverse")
    edges = tree.edges(direction, neighbours(tree, direction))
    few = _few_steps(tree, edges, seed, max(1, min(depth, MAX_TRAVERSE)))
    if few is not None:
        return few
    seen = ids_of(tree, [seed]).join(_everyone(tree), F.col("asked") == F.col("id")).select("id", F.lit(0).alias("level"))
    seen = ws.save(seen, "seen0")
    for k in range(1, max(1, min(depth, MAX_TRAVERSE)) + 1):
        edge = seen.where(F.col("level") == k - 1)
        new = edge.join(edges, edge.id == edges.a).select(F.col("b").alias("id")).distinct()
        new = ws.save(new.join(seen.select(F.col("id").alias("s")), new.id == F.col("s"), "left_anti").withColumn("level", F.lit(k)), f"new{k}")
        if new.isEmpty():
            break
        seen = ws.save(seen.unionByName(new), f"seen{k}")
    return seen.where("level > 0")


def _few_steps(tree: Tree, edges: DataFrame, seed: str, depth: int) -> DataFrame | None:
    """As traverse, each level looked up as a list; None as soon as a level has more than FRONTIER edges."""
    new = [r["id"] for r in ids_of(tree, [seed]).select(F.col("asked").alias("id")).join(_everyone(tree), "id", "left_semi").collect()]
    seen = {i: 0 for i in new}
    for k in range(1, depth + 1):
        if not new:
            break
        met = edges.where(F.col("a").isin(new)).limit(FRONTIER + 1).collect()
        if len(met) > FRONTIER:
            return None
        new = sorted({r["b"] for r in met} - seen.keys())
        seen |= {i: k for i in new}
    return tree.spark.createDataFrame([(i, k) for i, k in seen.items() if k], "id string, level int")


def pedigree_collapse(tree: Tree, seed: str, generations: int = 10) -> DataFrame:
    """(ancestor_id, occurrences, paths): ancestors reached by more than one path."""
    up = paths_up(tree, seed, generations)
    return up.groupBy("ancestor_id").agg(F.count("*").alias("occurrences"), F.array_join(F.sort_array(F.collect_list("path")), "; ").alias("paths")).where("occurrences > 1")


def relatives(tree: Tree, seed: str, generations: int = 5) -> DataFrame:
    """(id): the person, ancestors, the members of the own families and of the family of birth, spouses of all of these,
    descendants and their spouses; known people only."""
    ws = Workspace(tree.spark, "relatives")
    me = ids_of(tree, [seed]).select(F.col("asked").alias("id"))
    up = closure(tree, generations, [seed]).select(F.col("relative_id").alias("id"))
    down = closure(tree, generations, [seed], down=True).select(F.col("relative_id").alias("id"))
    own = tree.spouse_family.join(me, F.col("person_id") == me.id, "left_semi")
    members = union_all([own.select(F.col("husband_id").alias("id")), own.select(F.col("wife_id").alias("id")), own.select(F.explode("children_ids").alias("id"))])
    born = tree.individuals.join(me.withColumnRenamed("id", "m"), F.col("id") == F.col("m"), "left_semi").select("famc")
    siblings = tree.family_children.join(born, F.col("family_id") == F.col("famc"), "left_semi").select(F.col("child_id").alias("id"))
    base = ws.save(union_all([me, up, down, members, siblings]).where("id is not null").distinct(), "base")
    s = neighbours(tree, "spouses")
    wed = s.join(base, s.a == base.id, "left_semi").select(F.col("b").alias("id"))
    return base.unionByName(wed).distinct().join(_everyone(tree).withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left_semi")


def home_scores(tree: Tree) -> DataFrame:
    """(id, score, ord): 2 for a known family of birth, 1 for each of its parents with one named, 1 for each own family
    whose spouse is known, 1 for each child listed in the own families."""
    p = tree.individuals.select("id", "famc", "ord")
    fam = tree.families.select("family_id")
    born = p.join(fam, p.famc == fam.family_id, "left_semi").select("id", F.lit(2).alias("s"))
    named = tree.individuals.where("famc is not null").select(F.col("id").alias("n"))
    grand = tree.famc_parents.join(named, F.col("parent_id") == F.col("n"), "left_semi").select(F.col("child_id").alias("id"), F.lit(1).alias("s"))
    f = tree.spouse_family
    spouse = f.select(F.col("person_id").alias("id"), F.when(F.col("husband_id") == F.col("person_id"), F.col("wife_id")).otherwise(F.col("husband_id")).alias("b"))
    wed = spouse.join(_everyone(tree).withColumnRenamed("id", "k"), F.col("b") == F.col("k"), "left_semi").select("id", F.lit(1).alias("s"))
    kids = f.select(F.col("person_id").alias("id"), F.size(F.coalesce("children_ids", F.array().cast("array<string>"))).alias("s"))
    points = union_all([born, grand, wed, kids]).groupBy("id").agg(F.sum("s").alias("score"))
    return p.select("id", "ord").join(points, "id", "left").select("id", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"), "ord")


def home_person(tree: Tree) -> DataFrame:
    """The first person with the greatest score."""
    return home_scores(tree).agg(F.max_by("id", F.struct("score", -F.col("ord"))).alias("id"), F.max("score").alias("score"))
