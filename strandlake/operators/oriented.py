"""Graphs whose nodes have two orientations: union with parity, unitigs, common refinement of column runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components

#: Bases of a bin in which points meet windows.
BIN = 1024


def oriented_components(links: DataFrame) -> DataFrame:
    """links(src, dst, reverse) over non-negative long nodes to (node, component, reverse, contradictory).

    Every node is doubled into its two orientations, 2n and 2n + 1; a link that reverses crosses over.
    component is the smallest node that can be reached, reverse the orientation towards it. A component
    that holds both orientations of a node contradicts itself; its nodes' reverse is null.
    """
    flip = F.col("reverse").cast("long")
    double = lambda a, b, at: F.struct((F.col(a) * 2 + at).alias("src"), (F.col(b) * 2 + F.abs(flip - at)).alias("dst"))
    both = links.select(F.explode(F.array(double("src", "dst", 0), double("src", "dst", 1))).alias("l")).select("l.*")
    found = components(both)
    # a link of a node to itself that doesn't reverse leaves it alone in both orientations
    alone = links.select(F.explode(F.array("src", "dst")).alias("n")).distinct().select(F.explode(F.array(F.col("n") * 2, F.col("n") * 2 + 1)).alias("node"))
    every = alone.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("label"))
    node = F.shiftright("node", 1)
    each = every.groupBy(node.alias("node")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "node").alias("own"))
    torn = F.col("low") == F.col("high")
    return each.select("node", F.shiftright("low", 1).alias("component"), F.when(~torn, F.col("own") % 2 == 1).alias("reverse"), torn.alias("contradictory"))


def unitigs(walks: DataFrame) -> DataFrame:
    """walks(walk, pos, node, reverse) with each step's unitig: (walk, pos, node, reverse, place, unitig, flipped).

    Two neighbours belong together if every occurrence of either has the other on that side. Such a
    chain stands whole wherever one of its nodes does, so it is a run of steps, found without
    iteration: count the pairs, count the nodes, compare. A unitig is named by its smallest node and
    flipped where that one is reversed; place numbers a walk's unitigs from 0.
    """
    path = Window.partitionBy("walk").orderBy("pos")
    here, there = F.struct("node", "reverse"), F.struct(F.lag("node").over(path).alias("node"), F.lag("reverse").over(path).alias("reverse"))
    steps = walks.select("walk", "pos", "node", "reverse", here.alias("b"), there.alias("a"))
    turned = lambda h: F.struct(h["node"].alias("node"), (~h["reverse"]).alias("reverse"))
    ahead, back = F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(turned(F.col("b")).alias("x"), turned(F.col("a")).alias("y"))
    paired = steps.withColumn("pair", F.when(F.col("a.node").isNotNull() & (F.col("a.node") != F.col("node")), F.least(ahead, back)))
    uses = walks.groupBy("node").agg(F.count(F.lit(1)).alias("uses"))
    pairs = paired.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.count(F.lit(1)).alias("together"))
    of = lambda side: uses.select(F.col("node").alias(f"n{side}"), F.col("uses").alias(f"u{side}"))
    fixed = pairs.withColumn("nx", F.col("pair.x.node")).withColumn("ny", F.col("pair.y.node")).join(of("x"), "nx").join(of("y"), "ny").where((F.col("together") == F.col("ux")) & (F.col("ux") == F.col("uy"))).select("pair", F.lit(1).alias("fixed"))
    marked = paired.join(fixed, "pair", "left")
    place = F.sum(F.when(F.col("fixed").isNull(), 1).otherwise(0)).over(path.rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = marked.select("walk", "pos", "node", "reverse", place.cast("long").alias("place"))
    least = F.min(F.struct("node", "reverse")).over(Window.partitionBy("walk", "place"))
    return placed.withColumn("_l", least).select("walk", "pos", "node", "reverse", "place", F.col("_l.node").alias("unitig"), F.col("_l.reverse").alias("flipped"))


def compacted_walks(steps: DataFrame) -> DataFrame:
    """unitigs() to walks over unitigs: (walk, pos, node, reverse)."""
    return steps.select("walk", F.col("place").alias("pos"), F.col("unitig").alias("node"), F.col("flipped").alias("reverse")).distinct()


def unitig_nodes(steps: DataFrame) -> DataFrame:
    """(unitig, step, node, reverse) in the unflipped order, from each unitig's first occurrence."""
    first = steps.groupBy("unitig").agg(F.min(F.struct("walk", "place")).alias("f")).select("unitig", "f.walk", "f.place")
    one = steps.join(first, ["unitig", "walk", "place"])
    order = F.when(F.col("flipped"), -F.col("pos")).otherwise(F.col("pos"))
    step = F.row_number().over(Window.partitionBy("unitig").orderBy(order)).cast("long") - 1
    return one.select("unitig", step.alias("step"), "node", (F.col("reverse") != F.col("flipped")).alias("reverse"))


def _leaf_at(off: Column) -> Column:
    """The leaf coordinate of a run's offset in one of its windows."""
    return F.when(F.col("reverse"), F.col("start") + F.col("len") - off).otherwise(F.col("start") + off)


def run_cuts(windows: DataFrame, rounds: int = 60, keep=lambda df: df) -> DataFrame:
    """windows(run, leaf, start, len, reverse) to cuts (run, off): the ends of all runs, carried through shared leaf bases.

    All windows of a run have its length. A cut moves from its run to the leaves and from there into
    every other window that holds the point strictly inside; points and windows meet in bins. `keep`
    ends a round's lineage (a checkpoint).
    """
    windows = windows.where(F.col("len") > 0)
    held = keep(windows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("start") + F.col("len")) / BIN)))))
    known = keep(windows.select("run", "len").distinct().select("run", F.explode(F.array(F.lit(0).cast("long"), F.col("len"))).alias("off")))
    fresh = known
    for _ in range(rounds):
        at = fresh.join(windows, "run").select("leaf", _leaf_at(F.col("off")).alias("x")).distinct().withColumn("bin", F.floor(F.col("x") / BIN))
        inside = at.join(held, ["leaf", "bin"]).where((F.col("x") > F.col("start")) & (F.col("x") < F.col("start") + F.col("len")))
        off = F.when(F.col("reverse"), F.col("start") + F.col("len") - F.col("x")).otherwise(F.col("x") - F.col("start"))
        fresh = keep(inside.select("run", off.alias("off")).distinct().join(known, ["run", "off"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = keep(known.unionByName(fresh))
    raise RuntimeError("cuts did not settle")


def refined_runs(windows: DataFrame, cuts: DataFrame, keep=lambda df: df) -> DataFrame:
    """(run, off, len, piece, component, reverse, contradictory): the pieces between cuts, those over the same leaf bases together.

    piece numbers the pieces by (run, off), from prefix sums in two levels, so no task holds them all.
    """
    from ..functions.sequence import prefix_sums

    by = Window.partitionBy("run").orderBy("off")
    cut_up = cuts.withColumn("to", F.lead("off").over(by)).where(F.col("to") > F.col("off"))
    n = cut_up.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    numbered = cut_up.join(prefix_sums(n, [], "run", "n", "_before").select("run", "_before"), "run")
    pieces = keep(numbered.select("run", "off", (F.col("to") - F.col("off")).alias("size"), (F.col("_before") + F.row_number().over(by) - 1).cast("long").alias("piece")))
    low = F.when(F.col("reverse"), F.col("start") + F.col("len") - F.col("off") - F.col("size")).otherwise(F.col("start") + F.col("off"))
    on_leaf = pieces.join(windows.where(F.col("len") > 0), "run").select("piece", "leaf", low.alias("low"), "reverse")
    hub = Window.partitionBy("leaf", "low")
    star = on_leaf.withColumn("h", F.min(F.struct("piece", "reverse")).over(hub))
    links = star.select(F.col("h.piece").alias("src"), F.col("piece").alias("dst"), (F.col("h.reverse") != F.col("reverse")).alias("reverse"))
    named = oriented_components(keep(links.distinct())).withColumnRenamed("node", "piece")
    return pieces.join(named, "piece").select("run", "off", F.col("size").alias("len"), "piece", "component", "reverse", "contradictory")
