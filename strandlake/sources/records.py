"""PAF records beyond parsing: orientation, canonical order and duplicates, free fragments, anchors; mask and chunk plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv

#: The columns that make two PAF records the same.
SAME_RECORD = ("query_name", "query_start", "query_end", "strand", "target_name", "target_start", "target_end", "cigar")


def oriented(pairs: DataFrame, reference: str) -> DataFrame:
    """pairs(block, name1, reverse1, name2, reverse2) to (block, target, query, strand): the reference's row is the target, else the smaller name; strands differ: -."""
    first = F.when(F.col("name1") == reference, True).when(F.col("name2") == reference, False).otherwise(F.col("name1") <= F.col("name2"))
    strand = F.when(F.col("reverse1") == F.col("reverse2"), "+").otherwise("-")
    return pairs.select("block", F.when(first, F.col("name1")).otherwise(F.col("name2")).alias("target"), F.when(first, F.col("name2")).otherwise(F.col("name1")).alias("query"), strand.alias("strand"))


def canonical(records: DataFrame, key: tuple[str, ...] = SAME_RECORD) -> DataFrame:
    """Records without duplicates of the key, with their place (nth) in target order: target, start, end, then the rest of the key.

    Places are counted inside each target, so no task holds all records.
    """
    order = [c for c in ("target_start", "target_end", *key) if c in records.columns]
    return records.dropDuplicates(list(key)).withColumn("nth", F.row_number().over(Window.partitionBy("target_name").orderBy(*dict.fromkeys(order))).cast("long"))


def prefix_overlap(records: DataFrame, taken: DataFrame, key: list[str], reverse: bool = False) -> DataFrame:
    """records(key, start, end) with `overlap`: how much of their first bases (reverse: their last) lies in the taken interval over their border.

    taken(key, start, end) doesn't overlap itself: the last interval that starts at or before the border
    is the only one that can hold it.
    """
    if reverse:  # the mirrored axis
        flip = lambda df, *more: df.select(*key, *more, (-F.col("end")).alias("start"), (-F.col("start")).alias("end"))
        rest = [c for c in records.columns if c not in (*key, "start", "end")]
        found = prefix_overlap(flip(records, *rest), flip(taken), key)
        return found.select(*key, *rest, (-F.col("end")).alias("start"), (-F.col("start")).alias("end"), "overlap")
    held = taken.select(*key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    found = iv.as_of(records, held, key, "start", "_s", ["_e"])
    shared = F.when(F.col("_e").isNotNull(), F.greatest(F.lit(0), F.least("_e", "end") - F.col("start"))).otherwise(0)
    return found.withColumn("overlap", shared.cast("long")).drop("_e")


def free_fragments(records: DataFrame, blocked: DataFrame, least: int = 1) -> DataFrame:
    """records(id, start, end) to (id, start, end): the parts outside blocked(id, start, end), of at least `least`."""
    clipped = records.select("id", F.col("start").alias("_s"), F.col("end").alias("_e")).join(blocked, "id")
    inside = clipped.select("id", (F.greatest("start", "_s") - F.col("_s")).alias("start"), (F.least("end", "_e") - F.col("_s")).alias("end")).where("start < end")
    lengths = records.select("id", (F.col("end") - F.col("start")).alias("length"))
    gaps = iv.complement(iv.merge(inside, ["id"]), lengths, ["id"]).where(F.col("end") - F.col("start") >= least)
    return gaps.join(records.select("id", F.col("start").alias("_s")), "id").select("id", (F.col("_s") + F.col("start")).alias("start"), (F.col("_s") + F.col("end")).alias("end"))


def to_anchors(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """PAF records as anchors under the queries' own names: aliases(alias, name) are translated back."""
    named = records.join(aliases.withColumnRenamed("alias", "query_name"), "query_name", "left")
    return named.select(
        F.coalesce("name", "query_name").alias("qry_chr"), F.col("target_name").alias("ref_chr"), F.col("query_start").alias("qry_start"), (F.col("query_end") - F.col("query_start")).alias("qry_len"),
        F.col("target_start").alias("ref_start"), (F.col("target_end") - F.col("target_start")).alias("ref_len"), "strand", F.col("matches").alias("aligned_base"),
    )


def mask_lines(masks: DataFrame, key: str) -> DataFrame:
    """(key, value): a header and a 'start - end' line for each interval, one text a sequence."""
    line = F.concat_ws(" - ", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line")))), lambda x: x["line"]), "\n")
    return masks.groupBy(key).agg(listed.alias("body")).select(key, F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), "body").alias("value"))


def chunk_plan(contigs: DataFrame, size: int, overlap: int, least: int, most_contigs: int) -> DataFrame:
    """Chunks (genome, id, chunk, chunk_start, chunk_end): one for each contig of a genome with more than most_contigs, else pieces by size."""
    n = contigs.groupBy("genome").agg(F.count(F.lit(1)).alias("_n"))
    known = contigs.join(F.broadcast(n), "genome")  # one row a genome
    whole = known.where(F.col("_n") > most_contigs).select("genome", F.col("contig").alias("id"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("chunk_start"), F.col("length").alias("chunk_end"))
    spans = known.where(F.col("_n") <= most_contigs).select(F.col("contig").alias("id"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    cut = iv.chunks(spans, size, overlap, least).join(contigs.select(F.col("contig").alias("id"), "genome"), "id")
    return whole.unionByName(cut.select("genome", "id", F.col("chunk").cast("long").alias("chunk"), "chunk_start", "chunk_end"))


def balanced_chunks(costs: list[tuple[int, int]], k: int) -> dict[int, int]:
    """Chunk of each (id, cost): largest first, each to the lightest chunk so far. A plan over a bounded list of work items."""
    import heapq

    heap = [(0, i) for i in range(k)]
    out = {}
    for ident, cost in sorted(costs, key=lambda c: (-c[1], c[0])):
        weight, i = heapq.heappop(heap)
        out[ident] = i
        heapq.heappush(heap, (weight + cost, i))
    return out


def reference_choice(stats: DataFrame, named: str | None) -> DataFrame:
    """genome order: the named one first, else the one of fewest contigs; then by contigs and name."""
    first = F.when(F.col("genome").cast("string") == F.lit(named), 0).otherwise(1) if named is not None else F.lit(1)
    order = Window.orderBy(first, "contigs", "genome")  # one row a genome
    return stats.withColumn("place", F.row_number().over(order).cast("long"))


def forward_to_parent(child_forward: Column, parent_forward: Column) -> Column:
    """A child's segment runs along its parent's if both run the same way on their sequences."""
    return child_forward == parent_forward


def oriented_dna(dna: Column, forward: Column) -> Column:
    from ..functions.sequence import reverse_complement

    return F.when(forward, dna).otherwise(reverse_complement(dna))
