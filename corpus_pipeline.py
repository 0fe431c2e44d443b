"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read back
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, packing, quality, secrets, simhash
from strandlake.llm.common import cut, shared_dir
from strandlake.llm.queries import table, tokenizer_path

#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents above their language's perplexity quantile go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group the document with the smallest id stays; rows of one id stand or fall together, rows without an id stay."""
    found = simhash.similar_documents(docs, shingle_words=5)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), shingle_words=5, threshold=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: found secrets are masked in the text; every document stays."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, separator=0)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The first stage's model can't be put in SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back; a stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
            if k:
                old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{k - 1}-{STAGES[k - 1][0]}")
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
