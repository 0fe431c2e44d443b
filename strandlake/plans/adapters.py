"""The driver tables seen as genomes, intervals, matches, trees and alignment rows.

Every adapter comes with the same definition as a DuckDB common table expression for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TWO_BIT = ("ACGT" * 7)[:26]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """genome, contig, seq over ACGT, length."""
    ascii_ = F.upper(F.regexp_replace("text", "[^A-Za-z]", "N"))
    return read(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 4).alias("genome"), F.col("doc_id").alias("contig"), F.translate(ascii_, LETTERS, TWO_BIT).alias("seq"), F.length("text").cast("long").alias("length")
    )


SQL_CONTIGS = f"contigs AS (SELECT doc_id % 4 AS genome, doc_id AS contig, translate(upper(regexp_replace(text, '[^A-Za-z]', 'N', 'g')), '{LETTERS}', '{TWO_BIT}') AS seq, CAST(length(text) AS BIGINT) AS length FROM documents)"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, start, end."""
    start = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seq_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


SQL_MASKS = 'masks AS (SELECT l_suppkey AS seq_id, l_orderkey * 16 + l_linenumber AS "start", l_orderkey * 16 + l_linenumber + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem)'
SQL_MERGED = f'''{SQL_MASKS}, m1 AS (SELECT *, max("end") OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM masks WHERE "start" < "end"),
m2 AS (SELECT *, sum(CASE WHEN b IS NULL OR "start" > b THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS i FROM m1),
merged AS (SELECT seq_id, min("start") AS "start", max("end") AS "end" FROM m2 GROUP BY seq_id, i)'''


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, length: a contig a little shorter than its furthest mask, so that masks are clipped."""
    return masks(spark, sf_dir).groupBy("seq_id").agg((F.max("end") - 7).alias("length"))


SQL_BOUNDS = 'bounds AS (SELECT seq_id, max("end") - 7 AS length FROM masks GROUP BY seq_id)'


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, species, strand, qchr, rchr, qstart, rstart, len."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("match_id"),
        (F.col("l_partkey") % 3).alias("species"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        F.col("l_linenumber").cast("long").alias("qchr"),
        (F.col("l_suppkey") % 8).alias("rchr"),
        F.col("l_orderkey").alias("qstart"),
        F.col("l_partkey").alias("rstart"),
        F.col("l_quantity").cast("long").alias("len"),
    )


SQL_MATCHES = "matches AS (SELECT l_orderkey * 8 + l_linenumber AS match_id, l_partkey % 3 AS species, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CAST(l_linenumber AS BIGINT) AS qchr, l_suppkey % 8 AS rchr, l_orderkey AS qstart, l_partkey AS rstart, CAST(l_quantity AS BIGINT) AS len FROM lineitem)"


def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, row, aligned: four DNA rows of 24 columns for each part, with gaps, from its keys' digest."""
    part = read(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"))
    base = F.md5(F.concat_ws(":", F.col("block").cast("string"), (F.col("row").cast("int") / 2).cast("int").cast("string")))
    own = F.md5(F.concat_ws("/", F.col("block").cast("string"), F.col("row").cast("string")))
    mixed = F.concat(F.substring(base, 1, 14), F.substring(own, 1, 4), F.substring(base, 19, 6))
    return rows.select("block", F.col("row").cast("long").alias("row"), F.translate(mixed, "0123456789abcdef", "ACGTACGTACGTAC--").alias("aligned"))


SQL_ROWS = "arows AS (SELECT block, CAST(r AS BIGINT) AS row, translate(substr(md5(block || ':' || (r // 2)), 1, 14) || substr(md5(block || '/' || r), 1, 4) || substr(md5(block || ':' || (r // 2)), 19, 6), '0123456789abcdef', 'ACGTACGTACGTAC--') AS aligned FROM (SELECT p_partkey AS block, unnest(range(4)) AS r FROM part))"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, rchr, start, end (reference interval), species, qchr, qstart, qend, strand."""
    m = matches(spark, sf_dir)
    return m.select(F.col("match_id").alias("block"), "rchr", F.col("rstart").alias("start"), (F.col("rstart") + F.col("len")).alias("end"), "species", "qchr", "qstart", (F.col("qstart") + F.col("len")).alias("qend"), "strand")


SQL_BLOCKS = f'{SQL_MATCHES}, blocks AS (SELECT match_id AS block, rchr, rstart AS "start", rstart + len AS "end", species, qchr, qstart, qstart + len AS qend, strand FROM matches)'


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, name, branch_length: a root, regions below it, nations as leaves."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    root = region.select(F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("root").alias("name"), F.lit(0.0).alias("branch_length")).distinct()
    inner = region.select((F.col("r_regionkey") + 1).cast("long").alias("node"), F.lit(0).cast("long").alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") * 0.5 + 1.0).cast("double").alias("branch_length"))
    leaf = nation.select((F.col("n_nationkey") + 1000).cast("long").alias("node"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 0.25 + 0.5).cast("double").alias("branch_length"))
    return root.unionByName(inner).unionByName(leaf)


SQL_TREE = "tree AS (SELECT CAST(0 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 'root' AS name, CAST(0 AS DOUBLE) AS branch_length UNION ALL SELECT CAST(r_regionkey + 1 AS BIGINT), 0, r_name, CAST(r_regionkey * 0.5 + 1 AS DOUBLE) FROM region UNION ALL SELECT CAST(n_nationkey + 1000 AS BIGINT), CAST(n_regionkey + 1 AS BIGINT), n_name, CAST(n_nationkey * 0.25 + 0.5 AS DOUBLE) FROM nation)"
