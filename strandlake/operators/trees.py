"""Phylogeny and ancestor operators over node(node, parent, name, branch_length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closure(tree: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, ancestor, distance, steps), each node its own ancestor; path doubling, so rounds grow with the logarithm of the depth."""
    paths = tree.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.col("branch_length").alias("distance"), F.lit(1).alias("steps"))
    reach = 1
    for _ in range(rounds):
        up = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("distance").alias("d2"), F.col("steps").alias("s2"))
        longer = paths.where(F.col("steps") == reach).join(up, "ancestor").select("node", F.col("a2").alias("ancestor"), (F.col("distance") + F.col("d2")).alias("distance"), (F.col("steps") + F.col("s2")).alias("steps"))
        if longer.isEmpty():
            break
        paths = paths.unionByName(longer)
        reach *= 2
    return paths.unionByName(tree.select("node", F.col("node").alias("ancestor"), F.lit(0.0).alias("distance"), F.lit(0).alias("steps")))


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def leaf_distances(tree: DataFrame) -> DataFrame:
    """(a, b, distance, ancestor) of leaf pairs through their lowest common ancestor."""
    up = closure(tree).join(leaves(tree).select("node"), "node", "left_semi")
    a = up.select("ancestor", F.col("node").alias("a"), F.col("distance").alias("da"))
    b = up.select("ancestor", F.col("node").alias("b"), F.col("distance").alias("db"))
    both = a.join(b, "ancestor").where("a < b")
    return both.groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("d"), "ancestor")).alias("m")).select("a", "b", F.col("m.d").alias("distance"), F.col("m.ancestor").alias("ancestor"))


def subtree(tree: DataFrame, root: int) -> DataFrame:
    below = closure(tree).where(F.col("ancestor") == root).select("node")
    kept = tree.join(below, "node", "left_semi")
    return kept.withColumn("parent", F.when(F.col("node") != root, F.col("parent")))


def present_at(tree: DataFrame, at_leaves: DataFrame) -> DataFrame:
    """at_leaves(node, run) to (node, run) at every node some of whose leaves holds the run."""
    return at_leaves.join(closure(tree).select("node", "ancestor"), "node").select(F.col("ancestor").alias("node"), "run").distinct()


def postorder(tree: DataFrame) -> DataFrame:
    """Nodes by falling depth, then name: children before parents. One row a node of a phylogeny."""
    depth = closure(tree).groupBy("node").agg(F.max("steps").alias("depth"))
    return tree.join(depth, "node").withColumn("place", F.row_number().over(Window.orderBy(F.desc("depth"), "name")))


def adjacency(paths: DataFrame) -> DataFrame:
    """paths(leaf, chr, pos, run, forward, weight) to votes of neighbouring run ends.

    An end is run * 2, plus 1 for its right side; a vote names the smaller end first, and a run next
    to itself on one end has no vote.
    """
    by = Window.partitionBy("leaf", "chr").orderBy("pos", "run")
    out = F.col("run") * 2 + F.when(F.col("forward"), 1).otherwise(0)
    into = F.lead(F.col("run") * 2 + F.when(F.col("forward"), 0).otherwise(1)).over(by)
    step = paths.select("leaf", "weight", out.alias("x"), into.alias("y")).where(F.col("y").isNotNull() & (F.col("x") != F.col("y")))
    votes = step.select("leaf", "weight", F.least("x", "y").alias("end1"), F.greatest("x", "y").alias("end2"))
    return votes.groupBy("end1", "end2").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("weight").alias("support"), F.count_distinct("leaf").alias("leaves"))


def z_score(left: Column, right: Column, gap: Column, theta: float = 1e-6) -> Column:
    """((1 - b^l) / t) b^gap ((1 - b^r) / t) with b = 1 - t."""
    beta = F.lit(1.0 - theta)
    return (1 - F.pow(beta, left)) / theta * F.pow(beta, gap) * ((1 - F.pow(beta, right)) / theta)


def terminal_ends(paths: DataFrame, lineages: int = 2, lineage: Column | None = None) -> DataFrame:
    """(end, lineages) of run ends that are the first or last of a contig in enough lineages; each leaf is one unless `lineage` says otherwise."""
    paths = paths if lineage is None else paths.withColumn("_lineage", lineage)
    by = Window.partitionBy("leaf", "chr").orderBy("pos", "run")
    side = lambda right: F.col("run") * 2 + F.when(F.col("forward") == F.lit(right), 1).otherwise(0)
    at = paths.withColumn("first", F.row_number().over(by) == 1).withColumn("last", F.lead("run").over(by).isNull())
    name = F.col("leaf" if lineage is None else "_lineage").alias("_of")
    ends = at.where("first").select(name, side(False).alias("end")).unionByName(at.where("last").select(name, side(True).alias("end")))
    return ends.groupBy("end").agg(F.count_distinct("_of").alias("lineages")).where(F.col("lineages") >= lineages)


def weighted_adjacency(paths: DataFrame, branches: DataFrame, phi: float) -> DataFrame:
    """(end1, end2, weight): every child that has the adjacency votes exp(-phi b), b its branch length in branches(leaf, branch_length)."""
    by = Window.partitionBy("leaf", "chr").orderBy("pos", "run")
    out = F.col("run") * 2 + F.when(F.col("forward"), 1).otherwise(0)
    into = F.lead(F.col("run") * 2 + F.when(F.col("forward"), 0).otherwise(1)).over(by)
    step = paths.select("leaf", out.alias("x"), into.alias("y")).where(F.col("y").isNotNull() & (F.col("x") != F.col("y")))
    votes = step.select("leaf", F.least("x", "y").alias("end1"), F.greatest("x", "y").alias("end2")).distinct()
    weight = F.exp(-phi * F.col("branch_length"))
    return votes.join(F.broadcast(branches), "leaf").groupBy("end1", "end2").agg(F.sum(weight).alias("weight"))  # one row a leaf of the tree


def named_root(tree: DataFrame, name: str, artificial: tuple[str, ...] = ()) -> DataFrame:
    """The tree with the root called `name` where it has no name, an artificial one, or that of another node."""
    others = tree.where("parent is not null").select(F.col("name").alias("_o")).distinct()
    taken = tree.where("parent is null").join(others, F.col("name") == F.col("_o"), "left_semi").limit(1).count() > 0
    bad = F.col("name").isNull() | F.col("name").isin(*artificial) | F.lit(taken)
    return tree.withColumn("name", F.when(F.col("parent").isNull() & bad, F.lit(name)).otherwise(F.col("name")))
