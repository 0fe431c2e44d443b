"""Operator 10: a quality classifier from an interpolated modified Kneser-Ney trigram model.

The model is trained on trusted text: documents labelled good and not toxic, all of the half that a
hash of doc_id picks for training. Counts are sharded by the trigram's middle word (see ngrams):
trigram counts give the continuation counts of bigrams, those the counts of words; each order has
three discounts from its counts of counts, and every n-gram meets its context's total and the
probability of its suffix, which gives the interpolated probability. Unknown words share the uniform
base. A trusted text of more than `word_bound` words is counted and scored by joins of whole n-grams.

Documents are scored where they are read, against a hash table of the model; a model of more than
`table_bound` entries isn't shipped, and the documents' n-grams travel to its shards instead. The
score is the mean negative log-probability of a word, drawn towards the trusted mean by `prior`
words, because a short text says little. A document goes if its score is above its language's
quantile among trusted documents that the model hasn't seen (the other half, all of them); languages
with fewer than `least` such documents take the quantile of all.

Words are separated by white space, A-Z in lower case. The labels may come with any column `quality`
of 0 and 1. Edge cases: null and empty texts have no words, score the trusted mean and stay; null
languages take the common threshold; documents without an id are scored too; repeated rows are
scored alike, and a loss equal to the threshold stays; very long texts are scored whole; no trusted
documents: everything stays; further columns, whatever their names, are kept by keep_good() and
ignored otherwise.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams
from .common import cut, kept, pieces, scratch, staged
from .words import Words

#: What stands before a document's first word.
START = np.int64(1)
LEAST_DISCOUNT = 0.1


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    return Words([text], lower=True).hashes().view("int64")


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words in each text, and each word with the two before it) of a list of texts."""
    words = Words(texts, lower=True)
    sizes = words.sizes
    flat = np.full(len(words.starts) + 2 * len(sizes), START)
    last = np.arange(len(words.starts)) + 2 * (1 + np.repeat(np.arange(len(sizes)), sizes))
    flat[last] = words.hashes().view("int64")
    return sizes, flat[last - 2], flat[last - 1], flat[last]


@dataclass
class Model:
    """Tables (key, p) and (context, weight) of each order, as DataFrames, and the base."""

    p3: DataFrame
    w3: DataFrame
    p2: DataFrame
    w2: DataFrame
    p1: DataFrame
    unknown: float


@dataclass
class Packed:
    """Shards of counts (shard, blob), the words by code, the numbers that all shards need, entries and each shard's share of the tokens."""

    counts: DataFrame
    hashes: Broadcast
    numbers: ngrams.Numbers
    entries: int
    shares: np.ndarray


#: Words of a lexicon that is shipped at most; characters of a part of the word counts; trained tokens of a shard; characters of documents that meet a shard, and whose sums meet, in one task; bits of the largest filter, as a power of two.
WORD_BOUND, WORDS_CHARS, SHARD_TOKENS, SPLIT_CHARS, BUCKET_CHARS, MOST_BITS = 6_000_000, 10_000_000, 1_250_000, 50_000_000, 50_000_000, 28


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more; n counts of 1, 2, 3 and 4.

    Copies in the trusted text can make the estimate zero or negative, and a zero discount would give
    unseen words no probability at all; so discounts are at least LEAST_DISCOUNT.
    """
    n = [0, *map(int, n)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], LEAST_DISCOUNT), float(i)) if n[i] else LEAST_DISCOUNT for i in (1, 2, 3)]


def _tally(counts: DataFrame) -> list[int]:
    n = {r["k"]: r["count"] for r in counts.groupBy(F.least("n", F.lit(5)).alias("k")).count().collect()}
    return [n.get(i, 0) for i in (1, 2, 3, 4)]


def _take(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _train_by_joins(trusted: DataFrame) -> Model:
    """The model of trusted(text) as whole n-grams' counts, for more words than a lexicon should hold."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, a, b, c = trigrams(batch["text"].tolist())
            yield pd.DataFrame({"a": a, "b": b, "c": c})

    c3 = staged(trusted.select("text").mapInPandas(emit, "a long, b long, c long").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")))
    c2 = cut(c3.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")))
    c1 = cut(c2.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    types, total = c1.agg(F.count(F.lit(1)), F.sum("n")).first()
    d3, d2, d1 = (_discounts(_tally(c)) for c in (c3, c2, c1))
    spare = c1.agg(F.sum(_take(d1))).first()[0]
    unknown = spare / total / (2 * types)
    p1 = c1.select("c", ((F.col("n") - _take(d1)) / total + unknown).alias("p"))

    def order(counts: DataFrame, context: list[str], d: list[float], lower: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
        of = counts.groupBy(*context).agg(F.sum("n").alias("t"), F.sum(_take(d)).alias("s"))
        weight = of.select(*context, "t", (F.col("s") / F.col("t")).alias("w"))
        joined = counts.join(weight, context).join(lower.withColumnRenamed("p", "q"), on)
        return joined.withColumn("p", (F.col("n") - _take(d)) / F.col("t") + F.col("w") * F.col("q")), weight

    p2, w2 = order(c2, ["b"], d2, p1, ["c"])
    p2 = staged(p2.select("b", "c", "p"))
    p3, w3 = order(c3, ["a", "b"], d3, p2, ["b", "c"])
    # in single precision wherever documents are scored, so that both ways of scoring give the same
    single = lambda t: staged(t.withColumn(t.columns[-1], F.col(t.columns[-1]).cast("float")))
    return Model(single(p3.select("a", "b", "c", "p")), single(w3.select("a", "b", "w")), single(p2), single(w2.select("b", "w")), single(p1), unknown)


def train(trusted: DataFrame, word_bound: int = WORD_BOUND) -> Packed | Model | None:
    """The model of trusted(text); None if that holds no word. More than word_bound words are counted by joins."""
    sc = trusted.sparkSession.sparkContext
    chars = trusted.agg(F.sum(F.length("text"))).first()[0] or 0
    heard = trusted.select("text").mapInPandas(lambda batches: ngrams.word_counts(batches, pieces(chars, WORDS_CHARS)), "part int, blob binary, n long")
    words = staged(heard.groupBy("part").applyInPandas(ngrams.summed_words, "c long, n long"))
    types, tokens = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not types:
        return None
    if types > word_bound:
        return _train_by_joins(trusted)
    found = words.toArrow()
    c, n = found["c"].to_numpy(), found["n"].to_numpy()
    hashes = c[np.lexsort((c, -n))]
    shards, bits = pieces(tokens, SHARD_TOKENS), min(max(int(8 * tokens).bit_length(), 12), MOST_BITS)
    bits = bits if tokens < 1 << (bits - 1) else 0  # a filter of more would rule out little
    shipped, name = sc.broadcast(hashes), uuid.uuid4().hex  # at most word_bound words

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return ngrams.packed_counts(batches, ngrams.resident(name, lambda: ngrams.Lexicon(shipped.value)), shards)

    packed = trusted.select("text").mapInPandas(count, "shard int, blob binary").groupBy("shard")
    parts = staged(packed.applyInPandas(lambda g: ngrams.merged(g, bits), "kind int, shard int, blob binary, s array<long>"))
    stats = parts.where("kind = 0").select("shard", "s").collect()
    tallies = np.sum([r["s"] for r in stats], 0)
    n1, middle = np.zeros(types + 2, "uint32"), np.zeros((4, types + 2), "uint32")
    for r in parts.where("kind = 1").groupBy("shard").applyInPandas(ngrams.summed, "shard int, blob binary").collect():
        at, n = ngrams.unpack(r["blob"], 2)
        n1[at] = n
    for r in parts.where("kind = 3").select("blob").collect():
        at, *n = ngrams.unpack(r["blob"], 5)
        middle[:, at] = n
    bloom = np.zeros(1 << (bits - 3) if bits else 0, "uint8")
    for r in parts.where("kind = 2").select("blob").toLocalIterator():
        at = np.cumsum(ngrams.unpack(r["blob"], 1)[0])
        np.bitwise_or.at(bloom, at >> 3, (1 << (at & 7)).astype("uint8"))
    d = [_discounts(x) for x in (np.bincount(np.minimum(n1, 5), minlength=6)[1:5], tallies[4:8], tallies[:4])]
    seen = n1[n1 > 0]
    unknown = float(ngrams._take(seen, d[0]).sum()) / int(seen.sum()) / (2 * len(seen))
    w2 = np.divide(middle[1:].T @ np.array(d[1]), middle[0], out=np.zeros(types + 2), where=middle[0] > 0).astype("float32")
    numbers = ngrams.Numbers(n1, w2, d, int(seen.sum()), unknown, shards, bits, ngrams.pa.compress(bloom, codec="zstd", asbytes=True))
    shares = np.zeros(shards)
    for r in stats:
        shares[r["shard"]] = r["s"][9] / tokens
    return Packed(parts.where("kind = 0").select("shard", "blob"), shipped, numbers, int(tallies[8]) + len(seen), shares)


def _joined_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _n and _log by joins with the sharded tables; docs must be staged."""
    at = docs.withColumn("_at", F.monotonically_increasing_id())

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, a, b, c = trigrams(batch["text"].tolist())
            yield pd.DataFrame({"_at": np.repeat(batch["_at"].to_numpy(), sizes), "a": a, "b": b, "c": c})

    rows = at.select("_at", "text").mapInPandas(emit, "_at long, a long, b long, c long")
    # equal trigrams of a document are one row; a hot word's rows are split by the tables' joins on whole n-grams
    rows = rows.groupBy("_at", "a", "b", "c").agg(F.count(F.lit(1)).alias("k"))
    rows = rows.join(model.p3.withColumnRenamed("p", "t3"), ["a", "b", "c"], "left").join(model.w3.withColumnRenamed("w", "u3"), ["a", "b"], "left")
    rows = rows.join(model.p2.withColumnRenamed("p", "t2"), ["b", "c"], "left").join(model.w2.withColumnRenamed("w", "u2"), ["b"], "left").join(model.p1.withColumnRenamed("p", "t1"), ["c"], "left")
    wide = lambda c: F.col(c).cast("double")
    one = lambda c: F.coalesce(wide(c), F.lit(1.0))
    p2 = F.coalesce(wide("t2"), one("u2") * F.coalesce(wide("t1"), F.lit(model.unknown)))
    summed = rows.withColumn("p", F.coalesce(wide("t3"), one("u3") * p2)).groupBy("_at").agg(F.sum("k").alias("_n"), F.sum(F.col("k") * F.log("p")).alias("_log"))
    return at.join(summed, "_at", "left").fillna({"_n": 0, "_log": 0.0}).drop("_at")


def _shard_scores(docs: DataFrame, model: Packed) -> DataFrame:
    """docs with _n and _log: their trigrams travel to the model's shards, sums by text come back."""
    sc, name = docs.sparkSession.sparkContext, uuid.uuid4().hex
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    splits = np.maximum(np.ceil(model.shares * chars / SPLIT_CHARS), 1).astype("int64")
    buckets = pieces(chars, BUCKET_CHARS)
    shipped, numbers = model.hashes, sc.broadcast(model.numbers)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return ngrams.packed_texts(batches, ngrams.resident(name, lambda: ngrams.Sieve(shipped.value, numbers.value)), splits)

    def score(group: pd.DataFrame) -> pd.DataFrame:
        return ngrams.shard_scores(group, numbers.value)

    rows = keyed.select(F.col("_key").alias("key"), "text").mapInPandas(emit, "shard int, split int, kind int, chunk long, blob binary")
    copies = F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(int(x) - 1) for x in splits]), F.col("shard") + 1)))
    counts = model.counts.select("shard", copies.alias("split"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "blob")
    found = counts.unionByName(rows).groupBy("shard", "split").applyInPandas(score, "chunk long, kind int, blob binary")
    sums = found.groupBy(F.pmod("chunk", F.lit(buckets))).applyInPandas(ngrams.document_scores, "_key long, _n long, _log double")
    sums = staged(sums.groupBy("_key").agg(F.max("_n").alias("_n"), F.min("_log").alias("_log")))
    return keyed.join(F.broadcast(sums) if sums.count() <= BROADCAST_SUMS else sums, "_key", "left").drop("_key").fillna({"_n": 0, "_log": 0.0})


def scored(docs: DataFrame, model: Packed | Model, table_bound: int = 4_000_000) -> DataFrame:
    """docs with _n (words) and _log (their summed log-probability)."""
    if isinstance(model, Model):
        return _joined_scores(staged(docs), model)
    if model.entries > table_bound:
        return _shard_scores(docs, model)
    name = uuid.uuid4().hex
    shipped = docs.sparkSession.sparkContext.broadcast(([r["blob"] for r in model.counts.collect()], dataclasses.replace(model.numbers, filter=b"")))  # at most table_bound entries
    words = model.hashes

    @F.pandas_udf("_n long, _log double")
    def score(texts: pd.Series) -> pd.DataFrame:
        n_all, log_all = [], []

        def make() -> tuple[ngrams.Lexicon, ngrams.Table]:
            return ngrams.Lexicon(words.value), ngrams.Table(*shipped.value)

        lexicon, table = ngrams.resident(name, make)
        for lo in range(0, len(texts), 512):
            sizes, a, b, c = lexicon.trigrams(texts.iloc[lo : lo + 512].tolist())
            n_all.append(sizes)
            log_all.append(np.bincount(np.repeat(np.arange(len(sizes)), sizes), table.logs(a, b, c), len(sizes)))
        return pd.DataFrame({"_n": np.concatenate(n_all or [np.zeros(0, "int64")]), "_log": np.concatenate(log_all or [np.zeros(0)])})

    scored_ = docs.withColumn("_s", score("text"))
    return scored_.select(*docs.columns, F.col("_s._n").alias("_n"), F.col("_s._log").alias("_log"))


#: Thresholds that are broadcast at most; a longer list of languages is joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: Ids of training documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Texts whose sums are broadcast at most.
BROADCAST_SUMS = 1_000_000


def _limits(losses: DataFrame, quantile: float) -> DataFrame:
    """group, k (rows) and limit of losses(group, loss): the smallest loss that at least the given part of a group's rows don't exceed.

    The limit is exact. A sketch brackets it, ten times wider than the sketch can err; only what lies in the bracket is sorted.
    """
    ends = F.percentile_approx("loss", F.array(F.lit(max(quantile - 1e-3, 0.0)), F.lit(min(quantile + 1e-3, 1.0))), 10_000)
    near = losses.groupBy("group").agg(ends.alias("e"), F.count(F.lit(1)).alias("k"))
    near = cut(near.select("group", "k", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi")))
    rows = losses.join(F.broadcast(near) if near.count() <= BROADCAST_LANGUAGES else near, "group")
    below = rows.groupBy("group").agg(F.count(F.when(F.col("loss") < F.col("lo"), 1)).alias("below"))
    inside = rows.where("loss >= lo and loss <= hi").groupBy("group", "k", "loss").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("group").orderBy("loss"))
    ranked = inside.withColumn("upto", upto).join(below, "group").where(F.col("below") + F.col("upto") >= F.ceil(F.lit(quantile) * F.col("k")))
    return ranked.groupBy("group", "k").agg(F.min("loss").alias("limit"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, prior: float = 20.0, least: int = 50, table_bound: int = 4_000_000, word_bound: int = WORD_BOUND, columns: list[str] | None = None) -> DataFrame:
    """row (all columns of docs, or the given ones, as a struct), n, perplexity, threshold and keep for every row of docs."""
    with scratch():  # of the model's tables
        return _judged(docs, labels, quantile, prior, least, table_bound, word_bound, columns or docs.columns)


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, prior: float, least: int, table_bound: int, word_bound: int, columns: list[str]) -> DataFrame:
    # inside a struct the columns of docs can't clash with any of ours
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    good = F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")
    toxic = F.max("toxic") if "toxic" in labels.columns else F.lit(0)
    labelled = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good, F.coalesce(toxic, F.lit(0)).alias("toxic")).where("good = 1 and toxic = 0").select("doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2))
    taught = cut(labelled.where(half == 0))
    model = train(own.join(F.broadcast(taught) if taught.count() <= BROADCAST_IDS else taught, "doc_id", "left_semi"), word_bound)
    if model is None:
        none = F.lit(None).cast("double")
        return own.select("row", F.lit(0).cast("long").alias("n"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("keep"))
    table = kept(scored(own, model, table_bound).drop("text"))
    unseen = labelled.where(half == 1)
    held = cut(table.select("doc_id", "lang", "_n", "_log").join(unseen, "doc_id", "left_semi").select("lang", "_n", "_log"))
    sums = held.agg(F.sum("_log"), F.sum("_n")).first()
    mean = -(sums[0] / sums[1]) if sums[1] else -float(np.log(model.unknown if isinstance(model, Model) else model.numbers.unknown))
    loss = F.round((prior * mean - F.col("_log")) / (F.col("_n") + prior), 9)  # either way of scoring gives the same digits
    losses = held.select("lang", loss.alias("loss"))
    common = _limits(losses.select(F.lit(0).alias("group"), "loss"), quantile).agg(F.max("limit")).first()[0]
    own_limits = _limits(losses.where("lang is not null").select(F.col("lang").alias("group"), "loss"), quantile)
    limits = cut(own_limits.where(F.col("k") >= least).select(F.col("group").alias("lang"), "limit"))
    limited = table.join(F.broadcast(limits) if limits.count() <= BROADCAST_LANGUAGES else limits, "lang", "left")
    limit = F.coalesce("limit", F.lit(float("inf") if common is None else common))
    return limited.select("row", F.col("_n").alias("n"), F.exp(loss).alias("perplexity"), F.exp(limit).alias("threshold"), (loss <= limit).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold and keep for every row of docs; see judged() for the options."""
    lang = F.col("row.lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return judged(docs, labels, columns=[c for c in ("doc_id", "lang") if c in docs.columns], **options).select("row.doc_id", lang.alias("lang"), F.col("n").alias("n_words"), "perplexity", "threshold", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns."""
    return judged(docs, labels, **options).where("keep").select("row.*")
