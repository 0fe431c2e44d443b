"""Operators on alignment rows: pairs, projections, runs, votes, profiles."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cigar as cg
from ..functions.joins import sorted_join


def cells(rows: DataFrame) -> DataFrame:
    """rows(block, row, aligned) to (block, row, col, base)."""
    return rows.select("block", "row", F.posexplode(F.split("aligned", "")).alias("col", "base")).where(F.col("base") != "")


def row_pairs(rows: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """(block, left's name and text, right's name and text) of every two rows of a block, the smaller row on the left."""
    a = rows.select("block", F.col("row").alias(left[0]), F.col("aligned").alias(left[1]))
    b = rows.select("block", F.col("row").alias(right[0]), F.col("aligned").alias(right[1]))
    return sorted_join(a, b, ["block"]).where(F.col(left[0]) < F.col(right[0]))


def shared_pairs(rows: DataFrame) -> DataFrame:
    """(block, left, right, columns) of row pairs that share columns without gaps.

    A block's rows are joined, not its cells: bases of both rows are compared in place.
    """
    both = row_pairs(rows, ("left", "a"), ("right", "b"))
    return both.withColumn("columns", cg.shared_columns(F.col("a"), F.col("b"))).where("columns > 0").select("block", "left", "right", "columns")


def base_groups(rows: DataFrame) -> DataFrame:
    """(block, col, base, members): rows that hold the same base in a column, two at least; X never agrees."""
    base = F.upper("base")
    some = cells(rows).where((F.col("base") != "-") & (base != "X")).withColumn("base", base)
    return some.groupBy("block", "col", "base").agg(F.array_sort(F.collect_list("row")).alias("members")).where(F.size("members") > 1)


def project(target: Column, query: Column) -> dict[str, Column]:
    """PAF fields of an aligned pair: cigar, matches, nm, block_length."""
    units = cg.from_rows(target, query)
    matches = cg.total(units, ("=",))
    length = cg.total(units)
    return {"cigar": cg.render_text(units), "matches": matches, "nm": length - matches, "block_length": length}


def elementary_runs(rows: DataFrame) -> DataFrame:
    """(block, run, col_beg, col_end, mask): longest stretches of columns with one set of present rows."""
    present = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.when(F.col("base") == "-", "0").otherwise("1").alias("p")))), lambda s: s["p"]), "")
    masks = cells(rows).groupBy("block", "col").agg(present.alias("mask"))
    by = Window.partitionBy("block").orderBy("col")
    fresh = masks.withColumn("_new", F.when(F.lag("mask").over(by) == F.col("mask"), 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("block", "run").agg(F.min("col").cast("long").alias("col_beg"), (F.max("col") + 1).cast("long").alias("col_end"), F.first("mask").alias("mask"))


def run_spans(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(block, run, row, before, length): where each present row's bases of a run stand in the row."""
    placed = sorted_join(rows, runs.where(F.instr("mask", "1") > 0), ["block"])
    before = F.length(F.replace(F.substring(F.col("aligned"), F.lit(1), F.col("col_beg").cast("int")), F.lit("-"), F.lit("")))
    part = F.replace(F.substring(F.col("aligned"), (F.col("col_beg") + 1).cast("int"), (F.col("col_end") - F.col("col_beg")).cast("int")), F.lit("-"), F.lit(""))
    return placed.select("block", "run", "row", before.cast("long").alias("before"), F.length(part).cast("long").alias("length")).where("length > 0")


def leaf_interval(start: Column, length: Column, before: Column, run: Column, reverse: Column) -> Column:
    """Forward start of a run in its segment."""
    return F.when(reverse, start + length - before - run).otherwise(start + before)


@F.arrow_udf(T.ArrayType(T.StructType().add("col", "long").add("base", "string")))
def _votes(texts: pa.Array) -> pa.Array:
    out = []
    for own in texts.to_pylist():
        some = ("".join(c).upper() for c in itertools.zip_longest(*own, fillvalue=""))
        tops = ((c, max("ACGT", key=c.count)) for c in some)
        out.append([{"col": i, "base": b if b in c else "N"} for i, (c, b) in enumerate(tops)])
    return pa.array(out, pa.list_(pa.struct([("col", pa.int64()), ("base", pa.string())])))


@F.arrow_udf(T.BooleanType())
def _meet(texts: pa.Array) -> pa.Array:
    return pa.array([any(sum(x != "-" for x in c) > 1 for c in itertools.zip_longest(*(t or [""] for t in own), fillvalue="-")) for own in texts.to_pylist()], pa.bool_())


def _by_block(rows: DataFrame) -> DataFrame:
    """(block, texts): a block's rows travel, not its cells."""
    return rows.groupBy("block").agg(F.collect_list("aligned").alias("texts"))


def base_vote(rows: DataFrame) -> DataFrame:
    """(block, col, base): the commonest of A, C, G, T in each column, the first of them on ties; N if none."""
    return _by_block(rows).select("block", F.explode(_votes("texts")).alias("v")).select("block", "v.col", "v.base")


def meeting_blocks(rows: DataFrame) -> DataFrame:
    """Blocks(block) in which two rows have a base in one column."""
    return _by_block(rows).where(_meet("texts")).select("block")


def weighted_consensus(donors: DataFrame, least: float = 0.6) -> DataFrame:
    """donors(bucket, weight, dna) to (bucket, consensus): the base with the share `least` of the weight, else N; lower case where half the weight is."""
    at = donors.select("bucket", "weight", F.posexplode(F.split("dna", "")).alias("pos", "ch")).where(F.col("ch") != "")
    base = F.upper("ch")
    votes = at.groupBy("bucket", "pos", base.alias("base")).agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("ch") != base, F.col("weight")).otherwise(0)).alias("soft"))
    total = votes.groupBy("bucket", "pos").agg(F.sum("w").alias("total"), F.sum("soft").alias("soft"), F.max(F.struct("w", F.when(F.col("base").isin("A", "C", "G", "T"), 1).otherwise(0).alias("real"), F.expr("-ascii(base)").alias("order"), "base")).alias("top"))
    sure = (F.col("top.w") >= least * F.col("total")) & (F.col("top.real") == 1)
    called = F.when(sure, F.col("top.base")).otherwise("N")
    shown = F.when(F.col("soft") * 2 >= F.col("total"), F.lower(called)).otherwise(called)
    return total.select("bucket", F.struct("pos", shown.alias("c")).alias("s")).groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]), "").alias("consensus"))


def best_donors(donors: DataFrame) -> DataFrame:
    """The donor of each bucket: internal first, then weight, then name."""
    by = Window.partitionBy("bucket").orderBy(F.desc("internal"), F.desc("weight"), "name")
    return donors.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def preferred_to_unaligned(ref: Column, qry: Column, open_: int = 400, extend: int = 30, match: int = 91, mismatch: int = -114) -> Column:
    """Whether aligned rows score above leaving both sides as two gaps under affine costs."""
    pairs = F.arrays_zip(F.split(ref, "").alias("r"), F.split(qry, "").alias("q"))
    state = lambda p: F.when(p["r"] == "-", "I").when(p["q"] == "-", "D").otherwise("M")

    def walk(acc: Column, p: Column) -> Column:
        s = state(p)
        gap = F.when(acc["s"] == s, -extend).otherwise(-(open_ + extend))
        gain = F.when((p["r"] == "-") & (p["q"] == "-") | (p["r"] == "") | (p["q"] == ""), 0).when(s == "M", F.when(F.upper(p["r"]) == F.upper(p["q"]), match).otherwise(mismatch)).otherwise(gap)
        return F.struct((acc["v"] + gain).cast("long").alias("v"), s.alias("s"))

    aligned = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("v"), F.lit("").alias("s")), walk)["v"]
    bases = lambda c: F.length(F.replace(c, F.lit("-"), F.lit("")))
    alone = lambda n: F.when(n > 0, -(open_ + extend * n)).otherwise(0)
    return aligned > alone(bases(ref)) + alone(bases(qry))


def insertion_events(alignments: DataFrame, least: int) -> DataFrame:
    """alignments(id, units) to (id, ref_pos, qry_pos, len) of insertions of at least `least` bases."""
    at = alignments.select("id", "units", F.posexplode("units").alias("i", "u"))
    earlier = F.slice("units", F.lit(1), F.col("i"))
    return at.where((F.col("u.op") == "I") & (F.col("u.len") >= least)).select("id", cg.reference_length(earlier).alias("ref_pos"), cg.query_length(earlier).alias("qry_pos"), F.col("u.len").alias("len"))


def star_profile(rows: DataFrame) -> DataFrame:
    """Pairwise alignments to one reference, rows(block, row, ref, qry), as one profile (block, row, aligned).

    Insertions before a reference position are left-justified in as many columns as the longest needs.
    Row -1 is the reference.
    """
    pairs = rows.select("block", "row", F.posexplode(F.arrays_zip(F.split("ref", "").alias("r"), F.split("qry", "").alias("q"))).alias("i", "p")).where(F.col("p.r") != "")
    by = Window.partitionBy("block", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ref_pos = F.sum(F.when(F.col("p.r") == "-", 0).otherwise(1)).over(by)
    at = pairs.withColumn("k", ref_pos).withColumn("ins", F.col("p.r") == "-")
    nth = F.sum(F.when(F.col("ins"), 1).otherwise(0)).over(Window.partitionBy("block", "row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    # (k, 0) is the base after k - 1 others; (k, n) the n-th base inserted after it
    placed = at.withColumn("n", F.when(F.col("ins"), nth).otherwise(0)).select("block", "row", "k", "n", F.col("p.q").alias("base"), F.when(~F.col("ins"), F.col("p.r")).alias("r"))
    grid = placed.groupBy("block", "k", "n").agg(F.max("r").alias("r"))
    names = rows.select("block", "row").distinct()
    full = names.join(grid, "block").join(placed.drop("r"), ["block", "row", "k", "n"], "left").select("block", "row", "k", "n", F.coalesce("base", F.lit("-")).alias("base"))
    ref = grid.select("block", F.lit(-1).cast("long").alias("row"), "k", "n", F.coalesce("r", F.lit("-")).alias("base"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n", "base"))), lambda s: s["base"]), "")
    return full.unionByName(ref).groupBy("block", "row").agg(text.alias("aligned"))
