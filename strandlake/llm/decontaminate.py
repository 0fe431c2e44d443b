"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Built-in functions only. Test items and documents are sets of word shingles, hashed to 64 bits. Items
are partitioned by the number of their shingles; in the partition of size s an item of q <= s
shingles is sketched by its k smallest hashes (bottom-k MinHash), k = s - ceil(t s) + 1 for the
containment threshold t. A document that holds at least a share t of the item's shingles misses at
most q - ceil(t q) <= k - 1 of them, so it holds one of the k: probing documents with the sketches
loses no pair, whatever the lengths, and only a short item against a long document needs few probes.
Candidates are then verified on the shingles themselves.

Documents are taken by distinct content, so copies are searched once. The sketch table is broadcast
while its counted rows stay under `broadcast_rows`; beyond, the same join is shuffled on the hash,
and a frequent shingle's partition is left to the skew splitting of adaptive execution.

Edge cases: null or empty texts have no shingles and contain nothing; texts of fewer words than a
shingle are one shingle; repeated items or documents give repeated rows; empty tables give no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, staged


def words(text: Column) -> Column:
    """Lower-cased words, without the empty ends of the split."""
    return F.filter(F.split(F.lower(text.cast("string")), WORD_BREAK), lambda w: w != "")


def starts(w: Column, k: int) -> Column:
    """0-based starts of a word array's shingles; one if it is shorter than a shingle, none if empty."""
    return F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))))


def at(w: Column, i: Column, k: int) -> list[Column]:
    """The words of the shingle at i, null beyond the end. Element by element: slice() inside a lambda copies the whole array each time."""
    return [F.get(w, i + j) for j in range(k)]


def all_hashes(w: Column, k: int) -> Column:
    """64-bit hashes of the shingles of a word array, repeats included."""
    return F.transform(starts(w, k), lambda i: F.xxhash64(*at(w, i, k)))


def shingle_hashes(w: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the shingles of a word array."""
    return F.array_distinct(all_hashes(w, k))


def shingle_texts(w: Column, k: int) -> Column:
    """Distinct shingles of a word array, words joined by one space."""
    return F.array_distinct(F.transform(starts(w, k), lambda i: F.concat_ws(" ", *at(w, i, k))))


def content_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def sketches(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(hash, item): of each distinct item text the hashes that a containing document can't all miss."""
    sized = items.select("item", F.array_sort(shingle_hashes(F.col("w"), k)).alias("h")).where(F.size("h") > 0)
    # partitions by size: upper bounds 4, 8, 16, ...; all items of one share the bound's sketch size
    bound = F.greatest(F.lit(4.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.size("h").cast("double")))))
    width = bound - F.ceil(bound * threshold) + 1
    return sized.select("item", F.explode(F.slice("h", 1, width.cast("int"))).alias("hash"))


def contained(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, threshold: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """(content, item, shared, shingles): document contents that hold an item's shingles to the threshold.

    content is content_key(text) of the document, item that of the test item.
    """
    own = benchmark.select(content_key(F.col("text")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = staged(own.dropDuplicates(["item"]))
    probes = staged(sketches(items, shingle_words, threshold))
    n_probes = probes.count()
    small = n_probes <= broadcast_rows
    hashed = docs.where("text is not null").select(content_key(F.col("text")).alias("content"), words(F.col("text")).alias("w"))
    found = hashed.select("content", F.explode(all_hashes(F.col("w"), shingle_words)).alias("hash"))
    pairs = staged(found.join(F.broadcast(probes) if small else probes, "hash").select("content", "item").distinct())
    # verification on whole shingles, only of contents that are candidates
    contents = pairs.select("content").distinct()
    few = pairs.count() <= broadcast_rows
    kept = docs.where("text is not null").withColumn("content", content_key(F.col("text"))).join(F.broadcast(contents) if few else contents, "content", "left_semi")
    one = kept.select("content", "text").dropDuplicates(["content"]).select("content", words(F.col("text")).alias("w"))
    # w is a column by now: an expression in its place would be evaluated again for every shingle
    doc_shingles = one.select("content", F.explode(shingle_texts(F.col("w"), shingle_words)).alias("shingle"))
    item_shingles = items.select("item", shingle_texts(F.col("w"), shingle_words).alias("s")).select("item", F.size("s").alias("shingles"), F.explode("s").alias("shingle"))
    item_shingles = staged(item_shingles)
    hits = doc_shingles.join(F.broadcast(item_shingles) if item_shingles.count() <= broadcast_rows else item_shingles, "shingle").groupBy("content", "item").agg(F.count(F.lit(1)).alias("shared"), F.first("shingles").cast("long").alias("shingles"))
    return staged(pairs.join(hits, ["content", "item"]).where(F.col("shared") >= F.ceil(F.col("shingles") * threshold)))


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, shared, shingles and containment of every contaminated pair."""
    hits = contained(docs, benchmark, shingle_words, threshold)
    named = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("content"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), content_key(F.col("text")).alias("item"))
    return named.join(hits, "content").join(items, "item").select("doc_id", "item_id", "shared", "shingles", (F.col("shared") / F.col("shingles")).alias("containment"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, threshold: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of docs that hold no test item, all columns."""
    bad = contained(docs, benchmark, shingle_words, threshold, broadcast_rows).select("content").distinct()
    few = bad.count() <= broadcast_rows
    keyed = docs.select(F.struct(*docs.columns).alias("row"), content_key(F.col("text")).alias("content"))  # no column of docs can clash
    return keyed.join(F.broadcast(bad) if few else bad, "content", "left_anti").select("row.*")
