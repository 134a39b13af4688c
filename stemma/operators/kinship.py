"""How two people are related, for many pairs at once: each rule is a column of the pair, and one ordered CASE decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import exprs as X
from stemma.operators import graph
from stemma.operators.lookup import ids_of
from stemma.plans.model import Tree
from stemma.plans.tables import union_all
from stemma.plans.workspace import Workspace


def relate(tree: Tree, pairs: DataFrame, generations: int | None = 10) -> DataFrame:
    """(id1, id2, relationship, common_ancestor) of pairs(id1, id2). Null where one is unknown. Pairs are answered once each.

    The wording names id1's role for near relations and id2's for more distant lines, as callers know it; ties of
    common ancestors are decided by (sum of generations, generations of id1, ancestor id).
    """
    ws = Workspace(tree.spark, "kinship")
    depth = generations or 100
    pairs = ws.save(pairs.select("id1", "id2").distinct(), "pairs")
    who = pairs.select(F.col("id1").alias("id")).unionByName(pairs.select(F.col("id2").alias("id"))).distinct()
    p = tree.individuals.select("id", "famc")
    f = tree.families.select("family_id", "husband_id", "wife_id")
    # of each asked person: the family of birth, its parents and theirs
    born = ws.save(who.join(p, "id", "left_semi").join(p, "id").join(f, F.col("famc") == F.col("family_id"), "left").select("id", "famc", F.col("family_id").alias("fam"), F.col("husband_id").alias("dad"), F.col("wife_id").alias("mum")), "born")
    side = lambda n: born.select(*[F.col(c).alias(f"{c}{n}") for c in born.columns])
    base = pairs.join(side(1).withColumnRenamed("id1", "k1"), F.col("id1") == F.col("k1"), "left").join(side(2).withColumnRenamed("id2", "k2"), F.col("id2") == F.col("k2"), "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))

    wed = tree.spouse_family.select(F.col("person_id").alias("a"), F.explode(F.array("husband_id", "wife_id")).alias("b")).where("b is not null")
    # grandparents, and the families that are a parent's family of birth
    parents = born.select("id", F.explode(F.array("dad", "mum")).alias("par")).where("par is not null")
    up2 = parents.join(p.select(F.col("id").alias("pid"), F.col("famc").alias("pf")), F.col("par") == F.col("pid")).join(f, F.col("pf") == F.col("family_id"))
    up2 = ws.save(up2.select("id", "family_id", "husband_id", "wife_id"), "up2")
    grand = up2.select(F.col("id").alias("a"), F.explode(F.array("husband_id", "wife_id")).alias("b")).where("b is not null")
    aunts = up2.join(tree.family_children, "family_id").select(F.col("id").alias("a"), F.col("child_id").alias("b"))
    edges = tree.edges("up", tree.parent_edge.select(F.col("child_id").alias("a"), F.col("parent_id").alias("b")))
    start = who.select(F.col("id").alias("root_id"), F.col("id").alias("relative_id"))
    up = ws.save(graph.nearest(graph.levels_of(ws, start, edges, depth)), "up")
    # all that is known of an ordered pair in one row: married, grandparent, child of a grandparent's family, ancestor
    kind = lambda rows, name: rows.select("a", "b", F.lit(name).alias("kind"), F.lit(None).cast("int").alias("g"))
    known = union_all([kind(wed, "wed"), kind(grand, "grand"), kind(aunts, "aunt"), up.select(F.col("root_id").alias("a"), F.col("relative_id").alias("b"), F.lit("up").alias("kind"), F.col("generation").alias("g"))])
    has = lambda name: F.max(F.col("kind") == name).alias(name)
    known = ws.save(known.groupBy("a", "b").agg(has("wed"), has("grand"), has("aunt"), F.min("g").alias("g")), "known")
    out = base
    for n, (a, b) in ((1, ("id1", "id2")), (2, ("id2", "id1"))):
        k = known.select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("wed").alias(f"wed{n}"), F.col("grand").alias(f"grand{n}"), F.col("aunt").alias(f"aunt{n}"), F.col("g").alias(f"up{n}"))
        out = out.join(k, (F.col(a) == F.col("ka")) & (F.col(b) == F.col("kb")), "left").drop("ka", "kb")
    one = up.select(F.col("root_id").alias("r1"), F.col("relative_id").alias("c1"), F.col("generation").alias("n1"))
    two = up.select(F.col("root_id").alias("r2"), F.col("relative_id").alias("c2"), F.col("generation").alias("n2"))
    common = pairs.join(one, pairs.id1 == one.r1).join(two, (F.col("id2") == F.col("r2")) & (F.col("c1") == F.col("c2")))
    common = common.groupBy("id1", "id2").agg(F.min(F.struct((F.col("n1") + F.col("n2")).alias("s"), "n1", "c1", "n2")).alias("best")).select(F.col("id1").alias("q1"), F.col("id2").alias("q2"), F.col("best.n1").alias("n1"), F.col("best.n2").alias("n2"), F.col("best.c1").alias("nearest"))
    out = out.join(common, (F.col("id1") == F.col("q1")) & (F.col("id2") == F.col("q2")), "left")
    degree, removal = F.least("n1", "n2") - 1, F.abs(F.col("n1") - F.col("n2"))
    cousin = F.concat(X.ordinal(degree), F.lit(" cousin"), F.when(removal == 0, "").when(removal == 1, " once removed").when(removal == 2, " twice removed").otherwise(F.concat(F.lit(" "), removal.cast("string"), F.lit("x removed"))))
    none = f"not related (within {generations} generations)" if generations else "not related (in tree)"
    shared = F.coalesce((F.col("dad1") == F.col("dad2")), F.lit(False)) | F.coalesce((F.col("mum1") == F.col("mum2")), F.lit(False)) | same("dad1", "mum2") | same("mum1", "dad2")
    answer = (
        F.when(F.col("k1").isNull() | F.col("k2").isNull(), F.lit(None).cast("string"))
        .when(F.col("id1") == F.col("id2"), "same person")
        .when(same("dad1", "id2") | same("mum1", "id2"), "child")
        .when(same("dad2", "id1") | same("mum2", "id1"), "parent")
        .when(F.col("wed1"), "spouse")
        .when(same("fam1", "fam2"), "sibling")
        .when(shared, "half-sibling")
        .when(F.col("grand1"), "grandchild")
        .when(F.col("grand2"), "grandparent")
        .when(F.col("up1").isNotNull(), X.ancestor_name(F.col("up1")))
        .when(F.col("up2").isNotNull(), X.descendant_name(F.col("up2")))
        .when(F.col("aunt1"), "niece/nephew")
        .when(F.col("aunt2"), "aunt/uncle")
        .when(F.col("n1").isNotNull() & (degree >= 1), cousin)
        .otherwise(none)
    )
    out = out.select("id1", "id2", answer.alias("relationship"), "nearest")
    # only cousins are told by an ancestor
    return out.select("id1", "id2", "relationship", F.when(F.col("relationship").contains(" cousin"), F.col("nearest")).alias("common_ancestor"))


def matrix(tree: Tree, ids: list[str], generations: int = 10) -> DataFrame:
    """All unordered pairs of a request's distinct ids, in its order: n * (n - 1) / 2 rows."""
    a = ids_of(tree, ids)
    one, two = a.select(F.col("asked").alias("id1"), F.col("n").alias("n1")), a.select(F.col("asked").alias("id2"), F.col("n").alias("n2"))
    return relate(tree, one.join(two, F.col("n1") < F.col("n2")).select("id1", "id2"), generations)
