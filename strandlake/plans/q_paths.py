"""Queries over segment paths, participants, reblocking and coordinate views, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import intervals as iv
from ..functions import sequence as sq
from ..operators import columns, graph, paths
from . import adapters as ad
from . import q_align as qa
from . import q_intervals as qi

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _segs(spark: SparkSession, d: str) -> DataFrame:
    """One row a side; the reference's species is named ref."""
    side = F.when(F.col("species") == -1, "ref").otherwise(F.col("species").cast("string"))
    return graph.segments(ad.blocks(spark, d)).withColumn("species", side)


_SEGS = f"""{ad.SQL_BLOCKS}, segs AS (SELECT block, 'ref' AS species, rchr AS chr, "start", "end", '+' AS strand FROM blocks UNION ALL SELECT block, CAST(species AS VARCHAR), qchr, qstart, qend, strand FROM blocks)"""


def _apart(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that don't overlap: rchr, block, start, end, species, strand."""
    start = F.col("o_orderkey") * 20
    return ad.read(spark, d, "orders").select(
        (F.col("o_orderkey") % 8).alias("rchr"), F.col("o_orderkey").alias("block"), start.alias("start"), (start + 5 + F.col("o_custkey") % 60).alias("end"), (F.col("o_custkey") % 2).alias("species"), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise("+").alias("strand")
    )


_APART = "apart AS (SELECT o_orderkey % 8 AS rchr, o_orderkey AS block, o_orderkey * 20 AS \"start\", o_orderkey * 20 + 5 + o_custkey % 60 AS \"end\", o_custkey % 2 AS species, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand FROM orders)"


# ------------------------------------------------------------------ coordinates


@query(f"WITH {ad.SQL_MASKS}, {ad.SQL_BOUNDS} SELECT seq_id, \"start\", \"end\", \"start\" >= 0 AND \"end\" <= length AS valid FROM masks JOIN bounds USING (seq_id)")
def position_validity(spark: SparkSession, d: str) -> DataFrame:
    j = ad.masks(spark, d).join(ad.bounds(spark, d), "seq_id")
    return j.select("seq_id", "start", "end", sq.valid_position(F.col("start"), F.col("end") - F.col("start"), F.col("length")).alias("valid"))


@query(f"WITH {ad.SQL_CONTIGS} SELECT genome, min(length) AS least, CAST(count(*) AS BIGINT) AS contigs FROM contigs WHERE length IS NOT NULL GROUP BY genome")
def least_contig_length(spark: SparkSession, d: str) -> DataFrame:
    return ad.contigs(spark, d).where("length is not null").groupBy("genome").agg(F.min("length").alias("least"), F.count(F.lit(1)).alias("contigs"))


@query(f"WITH {ad.SQL_CONTIGS}, {qi._OFFSETS}, pts AS (SELECT o_orderkey AS id, o_orderkey % 4 AS genome, o_orderkey * 37 AS pos FROM orders) SELECT id, substr(seq, CAST(pos - off + 1 AS INTEGER), 40) AS bases FROM pts JOIN offs USING (genome) JOIN contigs USING (genome, contig) WHERE pos >= off AND pos < off + offs.length")
def global_subsequence(spark: SparkSession, d: str) -> DataFrame:
    """Forty bases from global positions, to the contig's end at most."""
    at = qi.global_to_local(spark, d)
    return at.join(ad.contigs(spark, d).select("contig", "seq"), "contig").select("id", sq.subsequence(F.col("seq"), F.col("local"), F.lit(40)).alias("bases"))


_GAPS = f"""{ad.SQL_CONTIGS}, cm AS (SELECT contig, least(greatest(s, 0), length) AS s, least(e, length) AS e FROM (SELECT doc_id AS contig, (doc_id * 13) % 97 AS s, (doc_id * 13) % 97 + 20 AS e FROM documents UNION ALL SELECT doc_id, 150, 170 FROM documents) JOIN contigs USING (contig)),
ck AS (SELECT contig, s, e FROM cm WHERE s < e)"""


def _contig_masks(spark: SparkSession, d: str) -> DataFrame:
    c = ad.contigs(spark, d).where("length is not null").select("contig", "length")
    a = c.select("contig", "length", ((F.col("contig") * 13) % 97).alias("start")).withColumn("end", F.col("start") + 20)
    b = c.select("contig", "length", F.lit(150).cast("long").alias("start"), F.lit(170).cast("long").alias("end"))
    both = a.unionByName(b).withColumn("start", F.least(F.greatest("start", F.lit(0)), "length")).withColumn("end", F.least("end", "length"))
    return both.where("start < end").select("contig", "start", "end")


@query(f"""WITH {_GAPS}, o AS (SELECT contig, s, e, lag(e, 1, 0) OVER (PARTITION BY contig ORDER BY s) AS b, row_number() OVER (PARTITION BY contig ORDER BY s DESC) AS r FROM ck),
p AS (SELECT contig, b AS s, s AS e FROM o UNION ALL SELECT contig, e, length FROM o JOIN contigs USING (contig) WHERE r = 1 UNION ALL SELECT contig, 0, length FROM contigs WHERE contig NOT IN (SELECT contig FROM ck) AND length IS NOT NULL)
SELECT contig, md5(coalesce(string_agg(substr(seq, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)), '|' ORDER BY s), '')) AS text_md5 FROM p JOIN contigs USING (contig) WHERE s < e GROUP BY contig""")
def separated_concatenation(spark: SparkSession, d: str) -> DataFrame:
    """The unmasked parts of each contig, a separator between two parts."""
    c = ad.contigs(spark, d).where("length is not null")
    gaps = iv.complement(iv.merge(_contig_masks(spark, d), ["contig"]), c.select("contig", "length"), ["contig"])
    return sq.joined_parts(c.select("contig", "seq"), gaps.where("start < end"), "contig", "|").select("contig", F.md5("text").alias("text_md5"))


@query(f"""WITH {ad.SQL_MERGED}, mm AS (SELECT seq_id, "start", "end", coalesce(sum("end" - "start") OVER w, 0) AS before, row_number() OVER (PARTITION BY seq_id ORDER BY "start") - 1 AS nth FROM merged WINDOW w AS (PARTITION BY seq_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT seq_id, "start" - before AS masked_at, "start" - before + nth AS separated_at FROM mm),
pts AS (SELECT o_orderkey AS id, o_orderkey % 100 + 1 AS seq_id, o_custkey * 40 AS "at" FROM orders)
SELECT id, pts.seq_id, "at", CAST("at" + count(b.masked_at) AS BIGINT) AS separated FROM pts LEFT JOIN b ON b.seq_id = pts.seq_id AND b.masked_at <= pts."at" GROUP BY id, pts.seq_id, "at" """)
def masked_to_separated(spark: SparkSession, d: str) -> DataFrame:
    """Masked coordinates to those of the view with one separator a mask: one more for every mask at or before."""
    merged = iv.merge(ad.masks(spark, d), ["seq_id"])
    pts = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100 + 1).alias("seq_id"), (F.col("o_custkey") * 40).alias("at"))
    return iv.to_separated(pts, merged, ["seq_id"], "at").select("id", "seq_id", "at", F.col("separated").cast("long").alias("separated"))


@query(f"""WITH {ad.SQL_MERGED}, mm AS (SELECT seq_id, "start", "end", coalesce(sum("end" - "start") OVER w, 0) AS before, row_number() OVER (PARTITION BY seq_id ORDER BY "start") - 1 AS nth FROM merged WINDOW w AS (PARTITION BY seq_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT seq_id, "start" - before + nth AS sep FROM mm), pts AS (SELECT o_orderkey AS id, o_orderkey % 100 + 1 AS seq_id, o_custkey * 40 AS "at" FROM orders),
c AS (SELECT id, pts.seq_id, "at", count(b.sep) AS n, bool_or(coalesce(b.sep = "at", false)) AS hit FROM pts LEFT JOIN b ON b.seq_id = pts.seq_id AND b.sep <= pts."at" GROUP BY id, pts.seq_id, "at")
SELECT id, seq_id, "at", CASE WHEN NOT hit THEN CAST("at" - n AS BIGINT) END AS masked FROM c""")
def separated_to_masked(spark: SparkSession, d: str) -> DataFrame:
    """And back; a separator itself has no masked coordinate."""
    merged = iv.merge(ad.masks(spark, d), ["seq_id"])
    pts = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100 + 1).alias("seq_id"), (F.col("o_custkey") * 40).alias("at"))
    return iv.from_separated(pts, merged, ["seq_id"], "at").select("id", "seq_id", "at", F.col("masked").cast("long").alias("masked"))


@query(f"""WITH {ad.SQL_CONTIGS}, {_GAPS.partition(', cm AS')[2] and 'cm AS' + _GAPS.partition(', cm AS')[2]}, ln AS (SELECT genome, contig, length - coalesce((SELECT sum(e - s) FROM ck WHERE ck.contig = contigs.contig), 0) AS length FROM contigs WHERE length IS NOT NULL),
lo AS (SELECT genome, contig, length, coalesce(sum(length) OVER (PARTITION BY genome ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ln),
pts AS (SELECT o_orderkey AS id, o_orderkey % 4 AS genome, o_orderkey * 31 AS pos FROM orders) SELECT id, contig, CAST(pos - off AS BIGINT) AS local FROM pts JOIN lo USING (genome) WHERE pos >= off AND pos < off + length""")
def masked_global_to_local(spark: SparkSession, d: str) -> DataFrame:
    """Global positions of the concatenated masked contigs to positions in their masked contig."""
    gone = iv.merge(_contig_masks(spark, d), ["contig"]).groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("gone"))
    c = ad.contigs(spark, d).where("length is not null").select("genome", "contig", "length").join(gone, "contig", "left").select("genome", "contig", (F.col("length") - F.coalesce("gone", F.lit(0))).alias("length"))
    offsets = sq.prefix_sums(c, ["genome"], "contig", "length", "offset")
    pts = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("genome"), (F.col("o_orderkey") * 31).alias("pos"))
    return sq.locate(pts, offsets, "genome", "pos").select("id", "contig", F.col("local").cast("long").alias("local"))


# ------------------------------------------------------------------ paths


@query(f"WITH {ad.SQL_CONTIGS} SELECT genome, contig, 'head' AS kind, CAST(-1 AS BIGINT) AS at FROM contigs UNION ALL SELECT genome, contig, 'tail', length FROM contigs")
def path_sentinels(spark: SparkSession, d: str) -> DataFrame:
    return paths.sentinels(ad.contigs(spark, d))


@query(f"""WITH {_SEGS} SELECT species, chr, CAST(count(*) AS BIGINT) AS n FROM segs WHERE NOT (chr = 3 AND species = 'ref' AND "start" >= 100 AND "end" <= 900) GROUP BY species, chr""")
def range_delete(spark: SparkSession, d: str) -> DataFrame:
    left = paths.delete_range(_segs(spark, d), (F.col("chr") == 3) & (F.col("species") == "ref"), 100, 900)
    return left.groupBy("species", "chr").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SEGS}, l AS (SELECT * FROM segs WHERE species <> '1'), k AS (SELECT *, count(*) OVER (PARTITION BY block) AS n FROM l) SELECT block, species, chr, "start", "end" FROM k WHERE n >= 2""")
def species_delete(spark: SparkSession, d: str) -> DataFrame:
    return paths.delete_species(_segs(spark, d), ["1"]).select("block", "species", "chr", "start", "end")


@query(f"""WITH {_SEGS} SELECT block, species, chr, "start", "end" FROM segs WHERE NOT (species = 'ref' AND chr = 2)""")
def chromosome_delete(spark: SparkSession, d: str) -> DataFrame:
    return _segs(spark, d).where(~((F.col("species") == "ref") & (F.col("chr") == 2))).select("block", "species", "chr", "start", "end")


@query(f"""WITH {_SEGS}, p AS (SELECT o_orderkey AS id, o_custkey % 8 AS chr, o_orderkey % 2000 AS "at" FROM orders), s AS (SELECT DISTINCT chr, "start" FROM segs WHERE species = 'ref')
SELECT id, p.chr, "at", (SELECT max("start") FROM s WHERE s.chr = p.chr AND s."start" <= p."at") AS "before", (SELECT min("start") FROM s WHERE s.chr = p.chr AND s."start" > p."at") AS "after" FROM p""")
def surrounding_segments(spark: SparkSession, d: str) -> DataFrame:
    p = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 8).alias("chr"), (F.col("o_orderkey") % 2000).alias("at"))
    return paths.surrounding(p, _segs(spark, d).where("species = 'ref'"), ["chr"], "at")


@query(f"""WITH {_SEGS} SELECT block, CAST(count(*) AS BIGINT) AS sides, string_agg(species || ':' || chr || ':' || "start", ',' ORDER BY species, chr, "start") AS names, max("end" - "start") AS length FROM segs GROUP BY block""")
def block_view(spark: SparkSession, d: str) -> DataFrame:
    name = lambda s: F.concat_ws(":", s["species"], s["chr"].cast("string"), s["start"].cast("string"))
    return paths.block_views(_segs(spark, d)).select("block", F.size("sides").cast("long").alias("sides"), F.array_join(F.transform("sides", name), ",").alias("names"), "length")


@query(f"""WITH {_SEGS}, k AS (SELECT block, list_sort(list_distinct(list(species || '.' || chr))) AS keys FROM segs GROUP BY block), p AS (SELECT block AS l, block + 1 AS r FROM blocks)
SELECT l AS "left", r AS "right", a.keys = b.keys AS same, len(list_filter(a.keys, lambda x: NOT list_contains(b.keys, x))) = 0 AS subset,
len(list_intersect(list_filter(list_transform(a.keys, lambda x: split_part(x, '.', 1)), lambda x: x <> 'ref'), list_filter(list_transform(b.keys, lambda x: split_part(x, '.', 1)), lambda x: x <> 'ref'))) > 0 AS share
FROM p JOIN k a ON a.block = l JOIN k b ON b.block = r""")
def participant_tests(spark: SparkSession, d: str) -> DataFrame:
    pairs = ad.blocks(spark, d).select(F.col("block").alias("left"), (F.col("block") + 1).alias("right"))
    return paths.participant_relations(pairs, graph.participants(_segs(spark, d)), "ref")


@query(f"""WITH {_APART}, w AS (SELECT rchr, block, "start", "end", species, lead("start", 1) OVER p AS s1, lead("end", 1) OVER p AS e1, lead(species, 1) OVER p AS k1, lead("start", 2) OVER p AS s2, lead("end", 2) OVER p AS e2, lead(species, 2) OVER p AS k2 FROM apart WINDOW p AS (PARTITION BY rchr ORDER BY "start", "end", block)),
c AS (SELECT *, e2 IS NOT NULL AND e2 - "start" <= 3000 AND s1 >= "end" AND s2 >= e1 AS three, e1 IS NOT NULL AND e1 - "start" <= 3000 AND s1 - "end" BETWEEN 1 AND 200 AS two FROM w),
f AS (SELECT *, CASE WHEN three AND k2 = species AND k1 <> species THEN 'K-x-K' WHEN three AND k2 = species AND k1 = species THEN 'K-K-K' WHEN two AND k1 = species THEN 'K-0-K' END AS pattern FROM c)
SELECT rchr, block AS first, pattern, "start", CASE WHEN pattern = 'K-0-K' THEN e1 ELSE e2 END AS "end" FROM f WHERE pattern IS NOT NULL""")
def missing_species_windows(spark: SparkSession, d: str) -> DataFrame:
    return paths.missing_windows(_apart(spark, d))


@query(f"""WITH {_APART}, a AS (SELECT *, "end" - "start" >= 30 AS big, sum(CASE WHEN "end" - "start" >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY rchr ORDER BY "start", "end", block ROWS UNBOUNDED PRECEDING) AS a FROM apart),
g AS (SELECT rchr, a, max(CASE WHEN big THEN block END) AS l, max(CASE WHEN big THEN "end" END) AS le, max(CASE WHEN big THEN "start" END) AS ls, max(CASE WHEN big THEN strand END) AS st, count(*) FILTER (NOT big) AS inner_, list(strand) FILTER (NOT big) AS ss FROM a WHERE a > 0 GROUP BY rchr, a),
n AS (SELECT *, lead(l) OVER (PARTITION BY rchr ORDER BY a) AS r, lead(ls) OVER (PARTITION BY rchr ORDER BY a) AS rs FROM g)
SELECT rchr, l AS "left", r AS "right", CAST(inner_ AS BIGINT) AS "inner", len(list_filter(ss, lambda x: x <> st)) > 0 AS turned FROM n WHERE r IS NOT NULL AND inner_ BETWEEN 1 AND 5 AND rs - le BETWEEN 0 AND 1000""")
def structural_break_candidates(spark: SparkSession, d: str) -> DataFrame:
    return paths.break_candidates(_apart(spark, d))


@query(f"""WITH {ad.SQL_BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY rchr, "start" ORDER BY "end" - "start" DESC, species, block) AS n FROM blocks) SELECT rchr, "start", block FROM n WHERE n = 1""")
def best_repair_candidate(spark: SparkSession, d: str) -> DataFrame:
    b = ad.blocks(spark, d)
    return paths.best_candidate(b, ["rchr", "start"], [F.desc(F.col("end") - F.col("start")), F.col("species"), F.col("block")]).select("rchr", "start", "block")


@query(f"""WITH RECURSIVE {ad.SQL_BLOCKS}, o AS (SELECT rchr, block, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY rchr ORDER BY "start", "end", block) AS i FROM blocks WHERE rchr < 8 AND "start" < 300),
k AS (SELECT rchr, block, s, e, i, e AS far, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.rchr, o.block, o.s, o.e, o.i, CASE WHEN o.s >= k.far THEN o.e ELSE k.far END, o.s >= k.far FROM k JOIN o ON o.rchr = k.rchr AND o.i = k.i + 1)
SELECT rchr, block, s AS "start", e AS "end" FROM k WHERE kept""")
def overlap_removal(spark: SparkSession, d: str) -> DataFrame:
    b = ad.blocks(spark, d).where("start < 300").select("rchr", "block", "start", "end")
    return paths.without_overlap(b, ["rchr"])


@query(f"""WITH {ad.SQL_BLOCKS} SELECT species, qchr, block AS run, qstart AS "start", CAST(row_number() OVER (PARTITION BY species, qchr ORDER BY qstart, block) - 1 AS BIGINT) AS nth FROM blocks""")
def leaf_run_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.blocks(spark, d).select("species", "qchr", F.col("block").alias("run"), F.col("qstart").alias("start"))
    return paths.leaf_paths(rows, ["species", "qchr"])


_RUNS = "rr AS (SELECT l_orderkey AS block, l_linenumber AS run, l_partkey % 2 AS chr, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber * 10 ELSE 200 - l_linenumber * 10 END AS s, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber * 10 + 10 - l_suppkey % 2 ELSE 210 - l_linenumber * 10 - l_suppkey % 2 END AS e, substr(md5(l_orderkey || '/' || l_linenumber), 1, 5) AS dna FROM lineitem)"


@query(f"""WITH {_RUNS}, d AS (SELECT DISTINCT ON (block, run) * FROM rr ORDER BY block, run), b AS (SELECT *, lag(chr) OVER w AS c0, lag(s) OVER w AS s0, lag(e) OVER w AS e0 FROM d WINDOW w AS (PARTITION BY block ORDER BY run)),
g AS (SELECT *, sum(CASE WHEN chr = c0 AND (CASE WHEN strand = '+' THEN s = e0 ELSE e = s0 END) THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY run) AS row FROM b)
SELECT block, CAST(row AS BIGINT) AS row, min(s) AS "start", max(e) AS "end", string_agg(dna, '' ORDER BY run) AS dna FROM g GROUP BY block, row""")
def maf_reblocking(spark: SparkSession, d: str) -> DataFrame:
    """Runs that continue one another on a leaf become one row."""
    at = F.struct("_metadata.file_path", "_metadata.row_index")  # of equal runs the first in the table is kept
    line = ad.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_partkey", "l_suppkey"), at).alias("k")).select("l_orderkey", "l_linenumber", "k.*")
    even = F.col("l_orderkey") % 2 == 0
    n, cut = F.col("l_linenumber").cast("long") * 10, F.col("l_suppkey") % 2
    runs = line.select(
        F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("run"), (F.col("l_partkey") % 2).alias("chr"), F.when(even, "+").otherwise("-").alias("strand"),
        F.when(even, n).otherwise(200 - n).alias("start"), F.when(even, n + 10 - cut).otherwise(210 - n - cut).alias("end"), F.substring(F.md5(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))), 1, 5).alias("dna"),
    )
    return paths.reblocked(runs, ["block"]).select("block", F.col("row").cast("long").alias("row"), "start", "end", "dna")


@query(f"""WITH {ad.SQL_ROWS}, c AS (SELECT block, i, count(*) AS n FROM arows, range(1, 25) t(i) WHERE substr(aligned, i, 1) <> '-' GROUP BY block, i) SELECT block FROM c GROUP BY block HAVING max(n) >= 2""")
def maf_emitted_blocks(spark: SparkSession, d: str) -> DataFrame:
    return paths.multi_occurrence(ad.alignment_rows(spark, d))


@query("""WITH w AS (SELECT o_custkey AS walk, o_orderkey AS pos, o_orderkey % 700 AS node FROM orders), f AS (SELECT node, min((walk, pos)) AS first_at FROM w GROUP BY node) SELECT node, CAST(row_number() OVER (ORDER BY first_at) AS BIGINT) AS id FROM f""")
def node_renumbering(spark: SparkSession, d: str) -> DataFrame:
    """Used nodes in the order of their first occurrence on a walk."""
    w = ad.read(spark, d, "orders").select(F.col("o_custkey").alias("walk"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 700).alias("node"))
    return paths.renumbered(w, ["walk"], "node")


@query(f"""WITH {ad.SQL_BLOCKS}, p AS (SELECT rchr AS parent, species AS child, count(*) AS n, sum(qend - qstart) AS b FROM blocks GROUP BY rchr, species) SELECT parent, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(b) AS BIGINT) AS bases, CAST(sum(n - 1) AS BIGINT) AS paralogs FROM p GROUP BY parent""")
def emission_statistics(spark: SparkSession, d: str) -> DataFrame:
    return paths.emission_stats(ad.blocks(spark, d).select(F.col("rchr").alias("parent"), F.col("species").alias("child"), F.col("qstart").alias("start"), F.col("qend").alias("end")))


@query(f"""WITH {ad.SQL_BLOCKS}, n AS (SELECT ("end" - "start") * 11 AS n FROM blocks) SELECT CAST(count(*) FILTER (n <= 10) AS BIGINT) AS le_10, CAST(count(*) FILTER (n <= 50) AS BIGINT) AS le_50, CAST(count(*) FILTER (n <= 100) AS BIGINT) AS le_100, CAST(count(*) FILTER (n <= 500) AS BIGINT) AS le_500, CAST(count(*) FILTER (n > 500) AS BIGINT) AS gt_500 FROM n""")
def block_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return paths.length_histogram(ad.blocks(spark, d).select((F.col("start") * 11).alias("start"), (F.col("end") * 11).alias("end")))


@query("SELECT name, problem FROM (SELECT coalesce(n.n_name, s.x) AS name, CASE WHEN n.n_name IS NULL THEN 'unexpected' ELSE 'missing' END AS problem, n.n_name AS a, s.x AS b FROM nation n FULL JOIN (SELECT DISTINCT CASE WHEN s_nationkey % 5 = 0 THEN 'ghost' || s_nationkey ELSE (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) END AS x FROM supplier) s ON n.n_name = s.x) WHERE a IS NULL OR b IS NULL")
def leaf_name_match(spark: SparkSession, d: str) -> DataFrame:
    """Names of a tree's leaves against those of the genomes at hand."""
    n = ad.read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    s = ad.read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct().join(F.broadcast(n), "k")
    return paths.exact_names(s.select(F.when(F.col("k") % 5 == 0, F.concat(F.lit("ghost"), F.col("k").cast("string"))).otherwise(F.col("name")).alias("name")), n.select("name"))


# ------------------------------------------------------------------ CIGARs and alignment


@query(f"""WITH {qa._UNITS}, r AS (SELECT id, i, op, n, sum(n) OVER (PARTITION BY id ORDER BY i) AS z, coalesce(sum(CASE WHEN op IN ('M','D','=','X') THEN n ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM u WHERE n > 0),
x AS (SELECT id, i, op, n, CASE WHEN op IN ('M','D','=','X') THEN greatest(0, least(n, 10 - u)) WHEN u < 10 THEN n ELSE 0 END AS a, CASE WHEN op IN ('M','D','=','X') THEN greatest(0, least(n, 30 - u)) WHEN u < 30 THEN n ELSE 0 END AS ab FROM r)
SELECT id, coalesce(string_agg(CASE WHEN a > 0 THEN CAST(a AS BIGINT) || op ELSE '' END, '' ORDER BY i), '') AS prefix, coalesce(string_agg(CASE WHEN ab - a > 0 THEN CAST(ab - a AS BIGINT) || op ELSE '' END, '' ORDER BY i), '') AS middle, coalesce(string_agg(CASE WHEN n - ab > 0 THEN CAST(n - ab AS BIGINT) || op ELSE '' END, '' ORDER BY i), '') AS suffix FROM x GROUP BY id""")
def cigar_overlap_split(spark: SparkSession, d: str) -> DataFrame:
    """Prefix, overlap and suffix between 10 and 30 reference bases; insertions stay with the part that they follow."""
    a, b, c = cg.split_three(F.col("units"), F.lit(10).cast("long"), F.lit(30).cast("long"))
    return qa._cigars(spark, d).select("id", cg.render_text(a).alias("prefix"), cg.render_text(b).alias("middle"), cg.render_text(c).alias("suffix"))


@query(f"""WITH {qa._UNITS}, s AS (SELECT id, sum(n) FILTER (op IN ('M','D','=','X')) AS r, sum(n) FILTER (op IN ('M','I','=','X')) AS q FROM u GROUP BY id), k AS (SELECT *, sum(CASE WHEN op = p THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS g FROM (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY i) AS p FROM u WHERE n > 0)),
j AS (SELECT id, g, any_value(op) AS op, sum(n) AS n FROM k GROUP BY id, g), t AS (SELECT id, string_agg(CAST(n AS BIGINT) || op, '' ORDER BY g) AS cigar FROM j GROUP BY id)
SELECT id, CASE WHEN r % 2 = 0 THEN cigar END AS cigar, CASE WHEN r % 2 <> 0 THEN 'reference length' END AS error FROM s JOIN t USING (id)""")
def cigar_validation(spark: SparkSession, d: str) -> DataFrame:
    """Normalised CIGARs against the lengths of their segments; one length is wrong where the reference length is odd."""
    c = qa._cigars(spark, d)
    r, q = cg.reference_length(F.col("units")), cg.query_length(F.col("units"))
    units, error = cg.validated(F.col("units"), r - r % 2, q)
    return c.select("id", F.when(error.isNull(), cg.render_text(units)).alias("cigar"), error.alias("error"))


@query(f"""WITH {qa._UNITS}, s AS (SELECT id, 91 * sum(CASE WHEN op = '=' THEN n ELSE 0 END) - 114 * sum(CASE WHEN op IN ('M','X') THEN n ELSE 0 END) - coalesce(sum(CASE WHEN op IN ('I','D') AND n > 0 THEN 400 + 30 * n ELSE 0 END), 0) AS score, sum(n) FILTER (op IN ('M','D','=','X')) AS r, sum(n) FILTER (op IN ('M','I','=','X')) AS q FROM u GROUP BY id)
SELECT id, CAST(score AS BIGINT) AS score, score > -(CASE WHEN r > 0 THEN 400 + 30 * r ELSE 0 END) - (CASE WHEN q > 0 THEN 400 + 30 * q ELSE 0 END) AS preferred FROM s""")
def cigar_preferred(spark: SparkSession, d: str) -> DataFrame:
    """Whether an alignment scores above leaving both sides as gaps, by its CIGAR alone."""
    score, better = cg.preferred(F.col("units"))
    return qa._cigars(spark, d).select("id", score.alias("score"), better.alias("preferred"))


@query(f"WITH {ad.SQL_MATCHES} SELECT match_id, CAST(floor(200 + 0.1 * (len + rstart / 2.0)) AS BIGINT) AS band FROM matches")
def automatic_band(spark: SparkSession, d: str) -> DataFrame:
    return ad.matches(spark, d).select("match_id", cg.band_width(F.col("len"), F.col("rstart")).alias("band"))


@query(f"""WITH {qa._PAIRCOLS}, n AS (SELECT block, l, r, count(*) FILTER (x <> '-' AND y <> '-') AS both_, count(*) FILTER (x <> '-' AND x = y) AS same, count(*) FILTER (x <> '-') AS a, count(*) FILTER (y <> '-') AS b FROM p GROUP BY block, l, r)
SELECT block, l, r, round(CASE WHEN both_ > 0 THEN same / CAST(both_ AS DOUBLE) ELSE 0 END, 9) AS identity, round(CASE WHEN least(a, b) > 0 THEN both_ / CAST(least(a, b) AS DOUBLE) ELSE 0 END, 9) AS coverage FROM n""")
def aligned_row_quality(spark: SparkSession, d: str) -> DataFrame:
    """Identity and coverage of every pair of aligned rows."""
    rows = ad.alignment_rows(spark, d)
    identity, coverage = cg.row_quality(F.col("x"), F.col("y"))
    return columns.row_pairs(rows, ("l", "x"), ("r", "y")).select("block", "l", "r", F.round(identity, 9).alias("identity"), F.round(coverage, 9).alias("coverage"))
