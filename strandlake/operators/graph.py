"""Block graph operators: segments, neighbours, overlaps, merging of adjacent blocks, checks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv


def segments(blocks: DataFrame) -> DataFrame:
    """blocks(block, rchr, start, end, species, qchr, qstart, qend, strand) to one row a side."""
    ref = F.struct(F.lit(-1).cast("long").alias("species"), F.col("rchr").alias("chr"), F.col("start").alias("start"), F.col("end").alias("end"), F.lit("+").alias("strand"))
    qry = F.struct(F.col("species").alias("species"), F.col("qchr").alias("chr"), F.col("qstart").alias("start"), F.col("qend").alias("end"), F.col("strand").alias("strand"))
    return blocks.select("block", F.explode(F.array(ref, qry)).alias("s")).select("block", "s.*")


def with_neighbours(segs: DataFrame) -> DataFrame:
    """Each segment with the blocks before and after it on its path."""
    by = Window.partitionBy("species", "chr").orderBy("start", "end", "block")
    return segs.withColumn("previous", F.lag("block").over(by)).withColumn("next", F.lead("block").over(by))


def overlapping_blocks(blocks: DataFrame, width: int = 64) -> DataFrame:
    """(rchr, left, right, shared) block pairs that overlap on the reference and may merge: their queries are of different species."""
    a = blocks.select("rchr", "start", "end", F.col("block").alias("left"), F.col("species").alias("ls"))
    b = blocks.select("rchr", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("block").alias("right"), F.col("species").alias("rs"))
    pairs = iv.overlap_join(a, b, ["rchr"], width).where((F.col("left") < F.col("right")) & (F.col("ls") != F.col("rs")))
    return pairs.select("rchr", "left", "right", (F.least("end", "end2") - F.greatest("start", "start2")).alias("shared"))


def elementary_split(blocks: DataFrame, width: int = 64) -> DataFrame:
    """(rchr, start, end, members): the reference cut at all block ends, with how many blocks cover each piece."""
    cuts = blocks.select("rchr", F.explode(F.array("start", "end")).alias("at")).distinct()
    by = Window.partitionBy("rchr").orderBy("at")
    cells = cuts.withColumn("to", F.lead("at").over(by)).where(F.col("to").isNotNull()).select("rchr", F.col("at").alias("start"), F.col("to").alias("end"))
    # coverage as a running sum of openings and closings: no range join
    steps = blocks.select("rchr", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("s")).select("rchr", "s.at", "s.d").groupBy("rchr", "at").agg(F.sum("d").alias("d"))
    cover = steps.withColumn("members", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return cells.join(cover.select("rchr", F.col("at").alias("start"), "members"), ["rchr", "start"]).where("members > 0")


def boundary_reasons(blocks: DataFrame, most_gap: int = 100, most_span: int = 1_000_000) -> DataFrame:
    """Why each block can't be joined with the one before it on its reference path, or 'mergeable'."""
    by = Window.partitionBy("rchr").orderBy("start", "end", "block")
    prev = lambda c: F.lag(c).over(by)
    gap = F.when(F.col("strand") == "+", F.col("qstart") - F.col("p_qend")).otherwise(F.col("p_qstart") - F.col("qend"))
    named = blocks.select("*", *[prev(c).alias(f"p_{c}") for c in ("block", "start", "end", "species", "qchr", "strand", "qstart", "qend")])
    reason = (
        F.when(F.col("p_block").isNull(), "first")
        .when(F.col("start") < F.col("p_end"), "reference overlap")
        .when(F.col("start") > F.col("p_end"), "reference gap")
        .when(F.col("species") != F.col("p_species"), "species differ")
        .when(F.col("qchr") != F.col("p_qchr"), "contigs differ")
        .when(F.col("strand") != F.col("p_strand"), "strands differ")
        .when(gap < 0, "query order")
        .when(gap > most_gap, "query gap")
        .when(F.col("end") - F.col("p_start") > most_span, "span")
        .otherwise("mergeable")
    )
    return named.withColumn("reason", reason)


def merge_contiguous(blocks: DataFrame, most_gap: int = 100) -> DataFrame:
    """Runs of mergeable neighbours become one block (named by its first)."""
    marked = boundary_reasons(blocks, most_gap)
    by = Window.partitionBy("rchr").orderBy("start", "end", "block").rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.withColumn("run", F.sum(F.when(F.col("reason") == "mergeable", 0).otherwise(1)).over(by))
    return runs.groupBy("rchr", "run").agg(
        F.min_by("block", F.struct("start", "end", "block")).alias("block"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("qstart").alias("qstart"), F.max("qend").alias("qend"), F.count(F.lit(1)).alias("parts")
    ).drop("run")


def extension_candidates(segs: DataFrame) -> DataFrame:
    """For every segment the nearest earlier block on its path whose own species differs from the segment's; a fully extended segment (barrier) hides what is behind it.

    segs: block, chr, start, end, species (of the query), barrier.
    """
    by = Window.partitionBy("chr").orderBy("start", "end", "block")
    walls = F.sum(F.when(F.col("barrier"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    zone = segs.withColumn("zone", F.coalesce(walls, F.lit(0)))
    inside = Window.partitionBy("chr", "zone", "species").orderBy("start", "end", "block")
    return zone.withColumn("left", F.lag("block").over(inside)).withColumn("right", F.lead("block").over(inside))


def graph_checks(segs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(check, failures) over ordering, overlap, strand, length and participants."""
    by = Window.partitionBy("species", "chr").orderBy("start", "end", "block")
    s = segs.withColumn("before", F.lag("end").over(by))
    per_segment = {"overlap": F.col("before") > F.col("start"), "empty": F.col("end") <= F.col("start"), "negative": F.col("start") < 0, "strand": ~F.col("strand").isin("+", "-")}
    counts = s.agg(*[F.count_if(c).alias(n) for n, c in per_segment.items()])
    sides = segs.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("species") == -1).alias("r"))
    shape = sides.agg(F.count_if(F.col("n") < 2).alias("single"), F.count_if(F.col("r") != 1).alias("reference"))
    lost = blocks.select("block").distinct().join(segs.select("block").distinct(), "block", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    stacked = [df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in df.columns])).alias("x")).select("x.*") for df in (counts, shape, lost)]
    return reduce(DataFrame.unionByName, stacked)


def reference_offset(start: Column, length: Column, position: Column, reverse: Column) -> Column:
    """Offset of a segment coordinate along the reference direction; null outside."""
    inside = (position >= start) & (position < start + length)
    return F.when(inside, F.when(reverse, start + length - 1 - position).otherwise(position - start))


def without_empty(segs: DataFrame, least_sides: int = 1) -> DataFrame:
    """Segments of positive length, of blocks that keep at least `least_sides` of them."""
    full = segs.where(F.col("end") > F.col("start"))
    keep = full.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_sides).select("block")
    return full.join(keep, "block", "left_semi")


def conflict_free(candidates: pd.DataFrame) -> list[int]:
    """Greedy batch over candidates(rank, reads, writes): none may write what an accepted one reads, or read what it writes."""
    reads: set = set()
    writes: set = set()
    taken = []
    for row in candidates.sort_values("rank", kind="stable").itertuples():
        own_reads, own_writes = set(row.reads), set(row.writes)
        if own_writes & reads or own_reads & writes:
            continue
        reads |= own_reads
        writes |= own_writes
        taken.append(row.Index)
    return taken


def participants(segs: DataFrame) -> DataFrame:
    """(block, keys): the sorted distinct species.chr names of each block."""
    return segs.groupBy("block").agg(F.array_sort(F.collect_set(F.concat_ws(".", "species", "chr"))).alias("keys"))
