"""Column expressions over DNA text: cleaning, complement, names, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Complements; any other letter becomes N in unknown_to_n().
BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"


def clean_dna(seq: Column) -> Column:
    """Upper case, and N for whatever isn't A, C, G or T."""
    return F.regexp_replace(F.upper(F.regexp_replace(seq, "[^A-Za-z]", "N")), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    """Base by base, case kept; other characters become N."""
    return F.regexp_replace(F.translate(seq, BASES, COMPLEMENTS), "[^ACGTacgt]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_dna(seq: Column) -> Column:
    return seq.rlike("^[ACGTNacgtn]*$")


def first_token(header: Column) -> Column:
    """A header's name: the first white-space separated token, without a leading '>'."""
    return F.regexp_extract(F.trim(F.regexp_replace(header, "^>", "")), r"^\S+", 0)


def qualified(species: Column, contig: Column) -> Column:
    return F.concat_ws(".", species, contig)


def is_plain_name(name: Column) -> Column:
    """Usable in PAF and GFA: not empty, no white space."""
    return name.isNotNull() & name.rlike(r"^\S+$")


def readable_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """Bytes with a binary unit, the last one at most, and two decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / float(1024**power))).otherwise(out)
    return out


def subsequence(seq: Column, start: Column, length: Column) -> Column:
    """0-based start."""
    return F.substring(seq, start + 1, length)


def prefix_sums(df: DataFrame, key: list[str], order: str, value: str, out: str, run: int = 65_536) -> DataFrame:
    """Sum of value over earlier rows of the key, by an integer order column unique in the key.

    Two levels, so that no window holds a whole key: totals of runs of `run` orders, then rows
    inside a run.
    """
    at = df.withColumn("_run", F.floor(F.col(order) / run))
    totals = at.groupBy(*key, "_run").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select(*key, "_run", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return at.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(first, [*key, "_run"]).withColumn(out, F.col("_first") + F.col("_in")).drop("_run", "_in", "_first")


def locate(points: DataFrame, contigs: DataFrame, key: str, point: str, width: int = 4096) -> DataFrame:
    """Global positions to (contig, local): contigs(key, contig, offset, length), by binned equi-join."""
    first, last = F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.greatest("length", F.lit(1)) - 1) / width)
    spread = contigs.where("length > 0").withColumn("_bin", F.explode(F.sequence(first, last)))
    asked = points.withColumn("_bin", F.floor(F.col(point) / width))
    return asked.join(spread, [key, "_bin"]).where((F.col(point) >= F.col("offset")) & (F.col(point) < F.col("offset") + F.col("length"))).withColumn("local", F.col(point) - F.col("offset")).drop("_bin")


def valid_position(start: Column, length: Column, contig_length: Column) -> Column:
    """Whether a stretch lies inside its contig."""
    return (start >= 0) & (length >= 0) & (start + length <= contig_length)


def joined_parts(contigs: DataFrame, parts: DataFrame, key: str, separator: str) -> DataFrame:
    """contigs(key, seq) to (key, text): parts(key, start, end) of seq in order, a separator between two."""
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_p"))
    cut = F.transform("_p", lambda p: F.substring(F.col("seq"), (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))
    return contigs.join(listed, key).select(key, F.array_join(cut, separator).alias("text"))
