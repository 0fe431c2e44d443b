"""The pipeline's stages on the smallest tables."""

import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_corpus import brute_secrets, brute_similar

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        if name in ("quality", "near_duplicates"):
            assert left < ids
        if name == "near_duplicates":
            assert docs.groupBy("text").count().where(F.col("count") > 1).count() == 0
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_stages_survive_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_registered():
    entry = pytest.importorskip("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def plain_losses(trusted, asked):
    """(summed log-probability, words) of each asked text under the interpolated Kneser-Ney model of the trusted ones, by dictionaries."""
    words = lambda t: ["<", "<", *(t or "").encode().lower().split()]
    c3 = Counter(g for w in map(words, trusted) for g in zip(w, w[1:], w[2:]))
    c2 = Counter(g[1:] for g in c3)
    c1 = Counter(g[1:] for g in c2)

    def discounts(c):
        n = Counter(min(v, 5) for v in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i) if n[i] else 0.1 for i in (1, 2, 3)]

    total = sum(c1.values())
    d = {len(next(iter(c))): discounts(c) for c in (c1, c2, c3)}
    unknown = sum(d[1][min(v, 3)] for v in c1.values()) / total / (2 * len(c1))
    sums, spare = Counter(), Counter()
    for c in (c2, c3):
        for g, v in c.items():
            sums[g[:-1], len(g)] += v
            spare[g[:-1], len(g)] += d[len(g)][min(v, 3)]

    def p(g):
        n = len(g)
        if n == 1:
            return (c1[g] - d[1][min(c1[g], 3)]) / total + unknown if g in c1 else unknown
        at = (g[:-1], n)
        if at not in sums:
            return p(g[1:])
        v = (c2 if n == 2 else c3).get(g, 0)
        return (v - d[n][min(v, 3)] if v else 0) / sums[at] + spare[at] / sums[at] * p(g[1:])

    out = []
    for t in asked:
        w = words(t)
        out.append((sum(math.log(p(g)) for g in zip(w, w[1:], w[2:])), len(w) - 2))
    return out, -math.log(unknown)


def test_stages_against_a_plain_version(spark):
    from tokenizers import Tokenizer

    from strandlake.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    # quality
    good = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").collect()}
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)).alias("h")).collect()}
    logs, _ = plain_losses([t for i, t, _ in rows if i in good and half[i] == 0], [t for _, t, _ in rows])
    held = [k for k, r in enumerate(rows) if r[0] in good and half[r[0]] == 1]
    mean = -sum(logs[k][0] for k in held) / sum(logs[k][1] for k in held)
    loss = [(20 * mean - a) / (n + 20) for a, n in logs]
    at = lambda own: sorted(own)[math.ceil(0.99 * len(own)) - 1]
    by = defaultdict(list)
    for k in held:
        by[rows[k][2]].append(loss[k])
    limit = {lang: at(own) for lang, own in by.items() if lang is not None and len(own) >= 50}
    common = at([loss[k] for k in held])
    close = lambda k: abs(loss[k] - limit.get(rows[k][2], common)) < 1e-5  # noqa: E731  single precision decides
    kept = {rows[k][0] for k in range(len(rows)) if loss[k] <= limit.get(rows[k][2], common) or close(k)}
    found = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    got = {r.doc_id for r in found.select("doc_id").collect()}
    assert got <= kept and {rows[k][0] for k in range(len(rows)) if rows[k][0] in kept and not close(k)} <= got
    # near-duplicates
    rows = [r for r in rows if r[0] in got]
    kept = {d for d, c in brute_similar(rows) if d == c}
    found = corpus_pipeline.STAGES[1][1](spark, found, SF)
    assert {r.doc_id for r in found.select("doc_id").collect()} == kept
    # decontamination
    rows = [r for r in rows if r[0] in kept]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    items = [x for x in (shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if x]
    rows = [r for r in rows if not any(len(x & s) >= math.ceil(len(x) * 0.8) for s in [shingles(r[1])] for x in items)]
    found = corpus_pipeline.STAGES[2][1](spark, found, SF)
    assert {r.doc_id for r in found.select("doc_id").collect()} == {r[0] for r in rows}
    # secrets
    want = {}
    for i, t, _ in rows:
        out, end = "", 0
        for _, a, b in brute_secrets(t):
            out += t[end:a] + "[secret]" if a >= end else ""
            end = max(end, b)
        want[i] = None if t is None else out + t[end:]
    found = corpus_pipeline.STAGES[3][1](spark, found, SF)
    assert {r.doc_id: r.text for r in found.collect()} == want
    # packing
    tok = Tokenizer.from_file(tokenizer_path())
    parts = Counter()
    for i, t in want.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            parts[i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    packed = corpus_pipeline.STAGES[4][1](spark, found, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == parts
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
