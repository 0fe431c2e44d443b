"""Operators over segment paths and blocks: deletes, lookups, participant tests, windows, reblocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import meeting_blocks


def sentinels(contigs: DataFrame) -> DataFrame:
    """An empty path: a head before position 0 and a tail behind the end of each contig (genome, contig, kind, at)."""
    ends = F.array(F.struct(F.lit("head").alias("kind"), F.lit(-1).cast("long").alias("at")), F.struct(F.lit("tail").alias("kind"), F.col("length").cast("long").alias("at")))
    return contigs.select("genome", "contig", F.explode(ends).alias("e")).select("genome", "contig", "e.kind", "e.at")


def delete_range(segs: DataFrame, chromosome: Column, start: int, end: int) -> DataFrame:
    """Segments but those of the chromosome that lie wholly inside [start, end)."""
    return segs.where(~(chromosome & (F.col("start") >= start) & (F.col("end") <= end)))


def delete_species(segs: DataFrame, names: list[str]) -> DataFrame:
    """Segments without those of the species, and without blocks that keep fewer than two sides."""
    left = segs.where(~F.col("species").isin(*names))
    return left.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("block"))).where("_n >= 2").drop("_n")


def surrounding(points: DataFrame, segs: DataFrame, key: list[str], at: str) -> DataFrame:
    """Each point(id, key, at) with the last segment that starts at or before it and the first that starts behind.

    Both are found by frames that only grow, forwards and backwards: one that shrinks is read anew for every row.
    """
    p = points.select(*key, F.col(at).alias("_x"), F.lit(1).alias("_p"), F.col("id"), F.lit(None).cast("long").alias("_s"))
    s = segs.select(*key, "start").distinct().select(*key, F.col("start").alias("_x"), F.lit(0).alias("_p"), F.lit(None).cast("long").alias("id"), F.col("start").cast("long").alias("_s"))
    both = p.unionByName(s)
    order = Window.partitionBy(*key).orderBy("_x", "_p")
    before = F.last("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*key).orderBy(F.desc("_x"), F.desc("_p"))
    after = F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("before", before).withColumn("after", after).where("_p = 1").select("id", *key, F.col("_x").alias(at), "before", "after")


def block_views(segs: DataFrame) -> DataFrame:
    """One row a block: its sides, sorted by species, and its length."""
    side = F.struct("species", "chr", "start", "end", "strand")
    return segs.groupBy("block").agg(F.array_sort(F.collect_list(side)).alias("sides"), F.max(F.col("end") - F.col("start")).alias("length"))


def participant_relations(pairs: DataFrame, keys: DataFrame, reference: str) -> DataFrame:
    """pairs(left, right) with tests on the blocks' participant keys (block, keys): same, subset, and a shared species that isn't the reference."""
    a = keys.select(F.col("block").alias("left"), F.col("keys").alias("_a"))
    b = keys.select(F.col("block").alias("right"), F.col("keys").alias("_b"))
    species = lambda c: F.filter(F.transform(c, lambda k: F.substring_index(k, ".", 1)), lambda s: s != reference)
    joined = pairs.join(a, "left").join(b, "right")
    return joined.select("left", "right", (F.col("_a") == F.col("_b")).alias("same"), (F.size(F.array_except("_a", "_b")) == 0).alias("subset"), F.arrays_overlap(species("_a"), species("_b")).alias("share"))


def missing_windows(blocks: DataFrame, most_span: int = 3000, most_gap: int = 200) -> DataFrame:
    """Candidate windows (rchr, first, pattern, start, end) of neighbouring blocks(rchr, block, start, end, species).

    K-x-K: the middle block lacks the species that both neighbours have; K-0-K: a gap of at most
    most_gap between two blocks of one species; K-K-K: three blocks of one species. No window spans
    more than most_span.
    """
    path = Window.partitionBy("rchr").orderBy("start", "end", "block")
    ahead = {f"{c}{i}": F.lead(c, i).over(path) for i in (1, 2) for c in ("start", "end", "species")}
    wide = blocks.select("rchr", "block", "start", "end", "species", *[v.alias(k) for k, v in ahead.items()])
    three = F.col("end2").isNotNull() & (F.col("end2") - F.col("start") <= most_span) & (F.col("start1") >= F.col("end")) & (F.col("start2") >= F.col("end1"))
    two = F.col("end1").isNotNull() & (F.col("end1") - F.col("start") <= most_span) & (F.col("start1") - F.col("end")).between(1, most_gap)
    same1, same2 = F.col("species1") == F.col("species"), F.col("species2") == F.col("species")
    pattern = F.when(three & same2 & ~same1, "K-x-K").when(three & same2 & same1, "K-K-K").when(two & same1, "K-0-K")
    found = wide.withColumn("pattern", pattern).where("pattern is not null")
    return found.select("rchr", F.col("block").alias("first"), "pattern", "start", F.when(F.col("pattern") == "K-0-K", F.col("end1")).otherwise(F.col("end2")).alias("end"))


def break_candidates(blocks: DataFrame, anchor: int = 30, most_span: int = 1000, most_inner: int = 5) -> DataFrame:
    """Stretches (rchr, left, right, inner, strands) between neighbouring long blocks of one path that hold short ones only.

    Anchors are blocks of at least `anchor`; between two of them stand 1 to most_inner shorter blocks
    within most_span; strands says whether any of these turns against the left anchor.
    """
    path = Window.partitionBy("rchr").orderBy("start", "end", "block")
    long_ = (F.col("end") - F.col("start")) >= anchor
    numbered = blocks.withColumn("_a", F.sum(long_.cast("int")).over(path.rowsBetween(Window.unboundedPreceding, 0)))
    own = numbered.where("_a > 0").groupBy("rchr", "_a").agg(
        F.min_by("block", F.when(long_, 0).otherwise(1)).alias("left"), F.max(F.when(long_, F.col("end"))).alias("lend"), F.max(F.when(long_, F.col("strand"))).alias("lstrand"),
        F.count(F.when(~long_, 1)).alias("inner"), F.collect_set(F.when(~long_, F.col("strand"))).alias("_s"),
    )
    turn = Window.partitionBy("rchr").orderBy("_a")
    starts = numbered.where(long_).select("rchr", "_a", F.col("start").alias("rstart"))
    wide = own.join(starts, ["rchr", "_a"]).withColumn("right", F.lead("left").over(turn)).withColumn("rstart", F.lead("rstart").over(turn))
    kept = wide.where(F.col("right").isNotNull() & F.col("inner").between(1, most_inner) & (F.col("rstart") - F.col("lend")).between(0, most_span))
    return kept.select("rchr", "left", "right", "inner", F.exists("_s", lambda s: s != F.col("lstrand")).alias("turned"))


def best_candidate(candidates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each key in the order."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def without_overlap(segs: DataFrame, key: list[str]) -> DataFrame:
    """Segments of each path in order, without those that start before the end of the last one kept."""

    def scan(pdf):
        pdf = pdf.sort_values(["start", "end", "block"], ignore_index=True)
        kept, end = [], None
        for i, (a, b) in enumerate(zip(pdf["start"], pdf["end"])):
            if end is None or a >= end:
                kept.append(i)
                end = b
        return pdf.iloc[kept]

    # what can't touch an overlap needs no scan: paths are cut where a start lies at or behind all ends before
    path = Window.partitionBy(*key).orderBy("start", "end", "block")
    far = F.max("end").over(path.rowsBetween(Window.unboundedPreceding, -1))
    parts = segs.withColumn("_new", F.coalesce((F.col("start") >= far).cast("int"), F.lit(1))).withColumn("_part", F.sum("_new").over(path.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    sized = parts.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key, "_part")))
    alone = sized.where("_n = 1").select(*segs.columns)
    return alone.unionByName(sized.where("_n > 1").groupBy(*key, "_part").applyInPandas(scan, sized.schema).select(*segs.columns))


def leaf_paths(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each leaf's runs in order of their start, with their number on the path."""
    return rows.withColumn("nth", (F.row_number().over(Window.partitionBy(*key).orderBy("start", "run")) - 1).cast("long"))


def reblocked(runs: DataFrame, key: list[str]) -> DataFrame:
    """runs(key, run, chr, strand, start, end, dna) joined to rows where a run goes on from the last: same chromosome and strand, touching."""
    path = Window.partitionBy(*key).orderBy("run")
    before = {c: F.lag(c).over(path) for c in ("chr", "strand", "start", "end")}
    touches = F.when(F.col("strand") == "+", F.col("start") == before["end"]).otherwise(F.col("end") == before["start"])
    goes_on = (F.col("chr") == before["chr"]) & (F.col("strand") == before["strand"]) & touches
    numbered = runs.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("row", F.sum("_new").over(path.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "dna"))), lambda x: x["dna"]), "")
    return numbered.groupBy(*key, "row").agg(F.first("chr").alias("chr"), F.first("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"), text.alias("dna"))


def multi_occurrence(rows: DataFrame) -> DataFrame:
    """Blocks(block) of rows(block, row, aligned) with at least two rows and a column in which two rows have a base."""
    return meeting_blocks(rows)


def renumbered(walks: DataFrame, key: list[str], node: str) -> DataFrame:
    """(node, id): used nodes numbered from 1 by their first occurrence on walks(key, pos, node)."""
    seen = walks.groupBy(node).agg(F.min(F.struct(*key, "pos")).alias("_at"))
    # rank in two levels would be needed for very many nodes; a walk's own first occurrences come first
    firsts = seen.select(node, *[F.col(f"_at.{k}").alias(k) for k in key], F.col("_at.pos").alias("pos"))
    own = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    sizes = own.groupBy(*key).agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a walk
    return own.join(before.drop("_k"), key).select(node, (F.col("_before") + F.col("_n")).cast("long").alias("id"))


def emission_stats(children: DataFrame) -> DataFrame:
    """(parent, segments, bases, paralogs) of children(parent, child, start, end): paralogs are children beyond the first of one genome."""
    per = children.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))
    return per.groupBy("parent").agg(F.sum("n").alias("segments"), F.sum("bases").alias("bases"), F.sum(F.col("n") - 1).alias("paralogs"))


def length_histogram(blocks: DataFrame, bounds: tuple[int, ...] = (10, 50, 100, 500)) -> DataFrame:
    """One row: how many blocks are at most as long as each bound, and how many longer than all."""
    n = F.col("end") - F.col("start")
    return blocks.agg(*[F.count(F.when(n <= b, 1)).alias(f"le_{b}") for b in bounds], F.count(F.when(n > bounds[-1], 1)).alias(f"gt_{bounds[-1]}"))


def exact_names(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, problem) of names on one side only; none if given(name) and wanted(name) are the same."""
    both = given.select("name", F.lit(1).alias("_g")).distinct().join(wanted.select("name", F.lit(1).alias("_w")).distinct(), "name", "full")
    return both.where("_g is null or _w is null").select("name", F.when(F.col("_g").isNull(), "missing").otherwise("unexpected").alias("problem"))
