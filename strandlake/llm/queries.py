"""The registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, separator=0)


def op2_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score

    return score(table(spark, sf_dir, "documents"))


def op3_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicate

    out = deduplicate(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_pages

    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, radius=2)


def op6_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle_words=5, threshold=0.8)


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import document_secrets

    return document_secrets(table(spark, sf_dir, "documents"))


def op9_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: f
        for name, f in globals().items()
        if name.startswith("op") and name[2].isdigit()
    }


#: The plain definition: every pair of a document and a test item by whole shingles.
_OP6 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS shingles FROM bs GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, CAST(shingles AS BIGINT) AS shingles, CAST(shared AS DOUBLE) / shingles AS containment
FROM h JOIN n USING (item_id) WHERE shared >= ceil(shingles * 0.8)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_containment": _OP6}
