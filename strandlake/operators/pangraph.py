"""Sequence graph from pairwise rows: exact relations, breakpoints, atoms, nodes, walks, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import sorted_join
from . import columns as co


def exact_relations(rows: DataFrame, least: int = 1) -> DataFrame:
    """(block, left, right, lpos, rpos, len): runs of columns where a row holds the base of its group's first row.

    A column's group is a star around its first member; positions count bases within the row.
    """
    by = Window.partitionBy("block", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.sum(F.when(F.col("base") == "-", 0).otherwise(1)).over(by) - 1
    some = co.cells(rows).withColumn("pos", pos).where(~F.upper("base").isin("-", "N", "X"))
    star = Window.partitionBy("block", "col", "base")
    hub = some.withColumn("hub", F.min(F.struct("row", "pos")).over(star)).where(F.col("hub.row") != F.col("row"))
    pairs = hub.select("block", F.col("hub.row").alias("left"), F.col("row").alias("right"), "col", F.col("hub.pos").alias("l"), F.col("pos").alias("r"))
    # a run goes on while both positions and nothing else advance together
    key = ["block", "left", "right"]
    rank = F.row_number().over(Window.partitionBy(*key, F.col("l") - F.col("r")).orderBy("l"))
    runs = pairs.withColumn("diag", F.col("l") - F.col("r")).withColumn("g", F.col("l") - rank).groupBy(*key, "diag", "g").agg(F.min("l").cast("long").alias("lpos"), F.min("r").cast("long").alias("rpos"), F.count(F.lit(1)).alias("len"))
    return runs.where(F.col("len") >= least).select(*key, "lpos", "rpos", "len")


def breakpoints(relations: DataFrame, lengths: DataFrame, rounds: int = 30, keep=lambda df: df) -> DataFrame:
    """(block, row, at): cut positions closed under projection through the relations.

    lengths(block, row, length). Ends of rows and of relations are projected until nothing is new;
    `keep` ends each round's lineage (a checkpoint).
    """
    sides = relations.select("block", F.col("left").alias("row"), F.col("lpos").alias("p"), F.col("right").alias("row2"), F.col("rpos").alias("p2"), "len")
    both = keep(sides.unionByName(relations.select("block", F.col("right").alias("row"), F.col("rpos").alias("p"), F.col("left").alias("row2"), F.col("lpos").alias("p2"), "len")))
    ends = lengths.select("block", "row", F.explode(F.array(F.lit(0).cast("long"), F.col("length"))).alias("at"))
    cuts = both.select("block", "row", F.explode(F.array("p", F.col("p") + F.col("len"))).alias("at"))
    known = keep(ends.unionByName(cuts).distinct())
    fresh = known
    for _ in range(rounds):
        moved = sorted_join(fresh, both, ["block", "row"]).where((F.col("at") > F.col("p")) & (F.col("at") < F.col("p") + F.col("len")))
        fresh = keep(sorted_join(moved.select("block", F.col("row2").alias("row"), (F.col("p2") + F.col("at") - F.col("p")).alias("at")).distinct(), known, ["block", "row", "at"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = keep(known.unionByName(fresh))
    raise RuntimeError("breakpoints did not settle")


def atoms(cuts: DataFrame) -> DataFrame:
    """(block, row, start, end) between neighbouring cuts."""
    by = Window.partitionBy("block", "row").orderBy("at")
    return cuts.withColumn("end", F.lead("at").over(by)).where(F.col("end") > F.col("at")).select("block", "row", F.col("at").alias("start"), "end")


def nodes(pieces: DataFrame, relations: DataFrame, label) -> DataFrame:
    """Atoms with their node: atoms that a relation equates share one. `label` finds components of (src, dst)."""
    named = pieces.withColumn("atom", F.concat_ws("|", "block", "row", "start"))
    left = named.select("block", F.col("row").alias("left"), F.col("start").alias("ls"), F.col("end").alias("le"), F.col("atom").alias("src"))
    inside = sorted_join(relations, left, ["block", "left"]).where((F.col("ls") >= F.col("lpos")) & (F.col("le") <= F.col("lpos") + F.col("len")))
    at = inside.select("block", F.col("right").alias("row"), (F.col("rpos") + F.col("ls") - F.col("lpos")).alias("start"), "src")
    links = sorted_join(at, named.select("block", "row", "start", F.col("atom").alias("dst")), ["block", "row", "start"]).select("src", "dst")
    comp = label(links)
    return sorted_join(named, comp.withColumnRenamed("node", "atom"), ["atom"], "left").withColumn("node", F.coalesce("component", "atom")).select("block", "row", "start", "end", "node")


def edges(placed: DataFrame) -> DataFrame:
    """(src, dst, walks) of neighbouring nodes on any walk."""
    by = Window.partitionBy("block", "row").orderBy("start")
    step = placed.withColumn("dst", F.lead("node").over(by)).where(F.col("dst").isNotNull())
    return step.groupBy(F.col("node").alias("src"), "dst").agg(F.count(F.lit(1)).alias("walks"))


def metrics(placed: DataFrame, links: DataFrame) -> DataFrame:
    """nodes, edges, shared and private bases."""
    each = placed.groupBy("node").agg(F.count(F.lit(1)).alias("uses"), F.first(F.col("end") - F.col("start")).alias("size"))
    n = each.agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.when(F.col("uses") > 1, F.col("size")).otherwise(0)).cast("long").alias("shared"), F.sum(F.when(F.col("uses") == 1, F.col("size")).otherwise(0)).cast("long").alias("private"))
    return n.crossJoin(links.agg(F.count(F.lit(1)).alias("edges")))


def spelled(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """(block, row, ok): whether the first occurrence of each node spells every walk."""
    bare = rows.select("block", "row", F.replace(F.col("aligned"), F.lit("-"), F.lit("")).alias("seq"))
    cut = sorted_join(placed, bare, ["block", "row"]).withColumn("bases", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    said = cut.groupBy("node").agg(F.min_by("bases", F.struct("block", "row", "start")).alias("said"))
    walk = sorted_join(cut, said, ["node"]).groupBy("block", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "said"))), lambda s: s["said"]), "").alias("walk"))
    return sorted_join(bare, walk, ["block", "row"], "left").select("block", "row", (F.coalesce("walk", F.lit("")) == F.col("seq")).alias("ok"))


def gfa_lines(placed: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, line): header, segments, links and paths of GFA 1.0."""
    bare = rows.select("block", "row", F.replace(F.col("aligned"), F.lit("-"), F.lit("")).alias("seq"))
    cut = sorted_join(placed, bare, ["block", "row"]).withColumn("bases", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    s = cut.groupBy("node").agg(F.first("bases").alias("b")).select(F.lit(1).alias("kind"), F.concat_ws("\t", F.lit("S"), "node", "b").alias("line"))
    li = links.select(F.lit(2).alias("kind"), F.concat_ws("\t", F.lit("L"), "src", F.lit("+"), "dst", F.lit("+"), F.lit("0M")).alias("line"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "node"))), lambda x: F.concat(x["node"], F.lit("+"))), ",")
    p = placed.groupBy("block", "row").agg(path.alias("p")).select(F.lit(3).alias("kind"), F.concat_ws("\t", F.lit("P"), F.concat_ws("#", "block", "row"), "p", F.lit("*")).alias("line"))
    head = placed.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit("H\tVN:Z:1.0").alias("line"))
    return head.unionByName(s).unionByName(li).unionByName(p)
