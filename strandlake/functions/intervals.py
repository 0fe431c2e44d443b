"""Interval algebra on half-open, 0-based intervals: islands, complements, range and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(ivls: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of touching or overlapping intervals of each key."""
    by = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ivls.where(F.col(start) < F.col(end)).withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return fresh.withColumn("_i", island).groupBy(*key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def add(known: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """A merged set with a delta merged into it."""
    cols = [*key, "start", "end"]
    return merge(known.select(*cols).unionByName(delta.select(*cols)), key)


def complement(merged: DataFrame, bounds: DataFrame, key: list[str], length: str = "length") -> DataFrame:
    """Parts of [0, length) outside merged intervals; keys without intervals give all of it."""
    clipped = merged.join(bounds, key).select(*key, F.least("start", length).alias("start"), F.least("end", length).alias("end"))
    fence = bounds.select(*key, F.col(length).alias("start"), F.col(length).alias("end"))
    by = Window.partitionBy(*key).orderBy("start", "end")
    gaps = clipped.unionByName(fence).withColumn("_from", F.coalesce(F.lag("end").over(by), F.lit(0).cast("long")))
    return gaps.select(*key, F.col("_from").alias("start"), F.col("start").alias("end")).where("start < end")


def overlap_join(a: DataFrame, b: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of a(key, start, end, ...) and b(key, start2, end2, ...) that share a position.

    Both sides are dealt to bins of the given width; a pair is kept in its first common bin only.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    left = a.where("start < end").withColumn("_bin", bins("start", "end"))
    right = b.where("start2 < end2").withColumn("_bin", bins("start2", "end2"))
    joined = left.join(right, [*key, "_bin"]).where((F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")))
    return joined.where(F.col("_bin") == F.floor(F.greatest("start", "start2") / width)).drop("_bin")


def as_of(points: DataFrame, rows: DataFrame, key: list[str], at: str, start: str, carry: list[str]) -> DataFrame:
    """Each point with `carry` of the last row whose start is at most the point: union and one window."""
    packed = F.struct(F.col(start), *[F.col(c) for c in carry])
    both = rows.select(*key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), packed.alias("_row"), *[F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c not in key]).unionByName(
        points.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), *[c for c in points.columns if c not in key]), allowMissingColumns=True
    )
    by = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_row", ignorenulls=True).over(by)).where("_kind = 1")
    return seen.select(*points.columns, F.col(f"_last.{start}").alias(start), *[F.col(f"_last.{c}").alias(c) for c in carry])


def with_running(merged: DataFrame, key: list[str]) -> DataFrame:
    """Merged intervals with the masked bases before each (`before`) and their rank (`nth`)."""
    by = Window.partitionBy(*key).orderBy("start")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("start")).over(earlier), F.lit(0)).cast("long")).withColumn("nth", F.row_number().over(by).cast("long"))


def to_masked(points: DataFrame, merged: DataFrame, key: list[str], at: str) -> DataFrame:
    """Original to masked coordinate; null inside a mask."""
    found = as_of(points, with_running(merged, key), key, at, "start", ["end", "before"])
    inside = F.col("end").isNotNull() & (F.col(at) < F.col("end"))
    masked = F.when(~inside, F.col(at) - F.coalesce(F.col("before") + F.col("end") - F.col("start"), F.lit(0)))
    return found.withColumn("masked", masked).drop("start", "end", "before")


def to_original(points: DataFrame, merged: DataFrame, key: list[str], at: str, separated: bool = False) -> DataFrame:
    """Masked to original coordinate; separated: the masked text has one separator for each mask."""
    step = F.when(F.col("start") > 0, 1).otherwise(0) if separated else F.lit(0)
    running = with_running(merged, key)
    # the coordinate at which a mask's following base stands in the masked text
    shift = F.sum(step).over(Window.partitionBy(*key).orderBy("start")) if separated else F.lit(0)
    placed = running.withColumn("_s", shift.cast("long")).withColumn("from", F.col("start") - F.col("before") + F.col("_s"))
    found = as_of(points, placed, key, at, "from", ["end"])
    return found.withColumn("original", F.when(F.col("from").isNull(), F.col(at)).otherwise(F.col("end") + F.col(at) - F.col("from"))).drop("from", "end")


def summary(merged: DataFrame, bounds: DataFrame, key: list[str]) -> DataFrame:
    """Masked bases, length left, and the separators between unmasked parts."""
    inside = merged.join(bounds, key).where(F.col("start") < F.col("length")).groupBy(*key).agg(F.sum(F.least("end", "length") - F.col("start")).cast("long").alias("masked_bases"))
    parts = complement(merged, bounds, key).groupBy(*key).agg(F.count(F.lit(1)).alias("parts"))
    out = bounds.join(inside, key, "left").join(parts, key, "left")
    bases, n = F.coalesce("masked_bases", F.lit(0).cast("long")), F.coalesce("parts", F.lit(0).cast("long"))
    return out.select(*key, "length", bases.alias("masked_bases"), (F.col("length") - bases).alias("masked_length"), F.greatest(n - 1, F.lit(0).cast("long")).alias("separators"))


def islands(df: DataFrame, key: list[str], order: str, joins: Column) -> DataFrame:
    """Number the runs of rows in each key: a run goes on where `joins` is true."""
    by = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chunks(spans: DataFrame, size: int, overlap: int = 0, least: int = 1) -> DataFrame:
    """spans(..., start, end) cut into pieces of `size`, each `overlap` into the next; a last piece under `least` joins its neighbour."""
    step = size - overlap
    length = F.col("end") - F.col("start")
    count = F.when(length <= size, 1).otherwise(F.ceil((length - overlap) / step)).cast("long")
    tail = length - (count - 1) * step
    count = F.when((count > 1) & (tail < least), count - 1).otherwise(count)
    rest = [c for c in spans.columns if c not in ("start", "end")]
    cut = spans.withColumn("_n", count).select(*rest, "start", "end", "_n", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk", "_k"))
    begin = F.col("start") + F.col("_k") * step
    return cut.select(*rest, F.col("chunk").cast("long").alias("chunk"), begin.alias("chunk_start"), F.when(F.col("_k") == F.col("_n") - 1, F.col("end")).otherwise(F.least(begin + size, F.col("end"))).alias("chunk_end"))


def _separators(merged: DataFrame, key: list[str], separated: bool) -> DataFrame:
    """Where each mask stands in the masked view, or in the one with separators."""
    run = with_running(merged, key)
    at = F.col("start") - F.col("before")
    return run.select(*key, (at + F.col("nth") - 1 if separated else at).cast("long").alias("_x"))


def _counted_before(points: DataFrame, marks: DataFrame, key: list[str], at: str) -> DataFrame:
    """points with `_n`, the marks at or before, and `_last`, the last of them: union and one window."""
    p = points.withColumn("_x", F.col(at).cast("long")).withColumn("_m", F.lit(0))
    m = marks.withColumn("_m", F.lit(1))
    both = p.unionByName(m, allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("_x", F.desc("_m")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_n", F.sum("_m").over(order)).withColumn("_last", F.max(F.when(F.col("_m") == 1, F.col("_x"))).over(order)).where("_m = 0")


def to_separated(points: DataFrame, merged: DataFrame, key: list[str], at: str) -> DataFrame:
    """Masked coordinates to those of the view with one separator for each mask."""
    return _counted_before(points, _separators(merged, key, False), key, at).withColumn("separated", F.col(at) + F.col("_n")).drop("_x", "_m", "_n", "_last")


def from_separated(points: DataFrame, merged: DataFrame, key: list[str], at: str) -> DataFrame:
    """And back; null on a separator."""
    found = _counted_before(points, _separators(merged, key, True), key, at)
    on = F.coalesce(F.col("_last") == F.col(at), F.lit(False))
    return found.withColumn("masked", F.when(~on, F.col(at) - F.col("_n"))).drop("_x", "_m", "_n", "_last")
