"""Operator 3: substring deduplication with a compressed FM-index in every shard.

A window of `window` consecutive words is redundant in a document if its words also start somewhere
in a document with a smaller id; every word that a redundant window covers goes. Windows are judged
on the input.

The texts are dealt once into a bucketed table of groups of about `group_bytes`; all later passes
read it in place, and only small packed arrays move. Equal windows must meet in one shard: each
window is routed by its minimizer, the smallest hash among its `seed`-word shingles, and
neighbouring windows with one minimizer travel together as a segment (of `most_windows` windows at
most). Groups first send their minimizers alone; those of a single document can't take part, so the
text of only the shared ones moves, each different segment of a group once. A shard concatenates
its segments, builds a suffix order to the depth of a window, the Burrows-Wheeler transform in a
bit-packed wavelet matrix, and streams all windows of its segments backwards through it; the
matching statistics tell how far each matches elsewhere, and the intervals at full length, with the
smallest document of each, give the word ranges that every document loses.

A minimizer of more than `segment_bound` documents (a passage that very many embed differently) is
taken apart: its windows travel one by one, routed by their own hash, to the same index. A window
costs its shard one short row for each group that holds it.

Documents whose whole text equals that of a smaller id lose all windows; while the counted list of
such texts is under `broadcast_rows`, they are known beforehand and send nothing.

Edge cases: null texts have no words; documents without an id come after all others, so they lose
words to them but take none; rows with one id, or repeated rows, don't take from each other; texts
shorter than a window keep all words; very long texts are one group of their own size, cut into
segments like any other; empty tables give no rows; further columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, pieces, staged, tidy
from .fmindex import FMIndex
from .words import Words, grams, mix, span_hashes

LAST = (1 << 63) - 1
SPANS = np.dtype([("doc", "<i4"), ("first", "<i4"), ("last", "<i4")])
PLACES = np.dtype([("segment", "<i4"), ("doc", "<i4"), ("first", "<i4"), ("d", "<i8")])


def segments(sizes: np.ndarray, hashes: np.ndarray, window: int, seed: int, most: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window, minimizer) of every segment; windows are numbered in the joined words."""
    empty = np.zeros(0, "int64")
    n = len(hashes) - window + 1
    if n <= 0:
        return empty, empty, empty, empty.astype("uint64")
    low, width = grams(hashes, seed), 1
    span = window - seed + 1
    while width < span:  # sliding minimum by doubling
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    low = low[:n]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[:n] == doc[window - 1 :]
    edge = np.ones(n, bool)
    edge[1:] = (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1])
    begun = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    edge |= (np.arange(n) - begun) % most == 0
    first = np.flatnonzero(inside & edge)
    last = np.flatnonzero(inside & np.append(edge[1:] | ~inside[1:], True))
    return doc[first], first, last, low[first]


def judge(contents: list[bytes], lows: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment the smallest low of any segment that holds each of its windows."""
    if not contents:
        return []
    split = [c.split(b" ") for c in contents]
    flat = [w for ws in split for w in ws]
    ids = {w: i for i, w in enumerate(dict.fromkeys(flat), 1)}
    sizes = np.array([len(ws) for ws in split], "int64")
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), "int64")  # 0 ends every segment
    mask = np.ones(len(text), bool)
    mask[starts + sizes] = False
    text[mask] = np.fromiter(map(ids.__getitem__, flat), "int64", len(flat))
    owner = np.repeat(np.arange(len(split)), sizes + 1)
    counts = sizes - window + 1
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    best = lows[owner[at]].copy()
    index = FMIndex(text, len(ids) + 1, window, lows[owner])
    length, lo, hi = index.statistics(text, at, window)
    full = np.flatnonzero(length == window)
    if len(full):
        left, back = np.unique(lo[full], return_inverse=True)
        right = np.zeros(len(left), "int64")
        right[back] = hi[full]
        best[full] = index.least(left, right)[back]
    return np.split(best, np.cumsum(counts)[:-1])


def deduplicate(docs: DataFrame, window: int = 13, seed: int = 4, shard_words: int = 250_000, segment_bound: int = 20_000, group_bytes: int = 1 << 20, bucket_bytes: int = 32 << 20, part_rows: int = 500_000, most_windows: int = 256, broadcast_rows: int = 300_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the removed word spans of every document."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = pieces(total, group_bytes)
    buckets = min(groups, pieces(total, bucket_bytes))
    parts = pieces(total // 30, part_rows)  # about a minimizer for so many bytes

    # texts that occur again under another id, with the smallest id; only a shortcut, so it is left out beyond the bound
    whole = [F.xxhash64("text").alias("_h1"), F.hash("text").alias("_h2"), F.octet_length("text").alias("_h3")]
    d = F.coalesce("doc_id", F.lit(LAST))
    again = keyed.where("text is not null").select(*whole, d.alias("d")).groupBy("_h1", "_h2", "_h3").agg(F.min("d").alias("least"), F.max("d").alias("_most")).where("least < _most").drop("_most")
    again = staged(again)
    placed = keyed.select("doc_id", "text", *whole, F.monotonically_increasing_id().alias("at"))
    if again.count() <= broadcast_rows:
        placed = placed.join(F.broadcast(again), ["_h1", "_h2", "_h3"], "left")
    else:
        placed = placed.withColumn("least", F.lit(None).cast("long"))
    table = bucketed(placed.select("doc_id", d.alias("d"), "text", "at", (F.coalesce("least", F.lit(LAST)) < d).alias("copy"), F.pmod(F.xxhash64("at"), F.lit(groups)).alias("g")), "g", buckets)

    def cut_up(own: pd.DataFrame) -> tuple[Words, np.ndarray, tuple]:
        """Words, their hashes and the segments of a group's documents, in the order of `at`."""
        words = Words(t if not copy else None for t, copy in zip(own["text"], own["copy"]))
        hashes = words.hashes()
        return words, hashes, segments(words.sizes, hashes, window, seed, most_windows)

    def minimizers(own: pd.DataFrame) -> pd.DataFrame:
        _, _, (doc, _, _, m) = cut_up(own.sort_values("at"))
        order = np.lexsort((doc, m))
        m, doc = m[order], doc[order]
        new = np.append(True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])) if len(m) else np.zeros(0, bool)
        m, n = np.unique(m[new], return_counts=True)
        part = (m % np.uint64(parts)).astype("int64")
        order = np.argsort(part, kind="stable")
        m, n, part = m[order], n[order].astype("<u4"), part[order]
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        return pd.DataFrame({"part": part[edges[:-1]], "g": own["g"].iloc[0], "m": [m[a:b].tobytes() for a, b in zip(edges, edges[1:])], "n": [n[a:b].tobytes() for a, b in zip(edges, edges[1:])]})

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["m"].str.len().to_numpy("int64") // 8
        m, n = np.frombuffer(b"".join(pdf["m"]), "<u8"), np.frombuffer(b"".join(pdf["n"]), "<u4").astype("int64")
        group = np.repeat(np.arange(len(pdf)), own)
        _, back = np.unique(m, return_inverse=True)
        held = np.bincount(back, n)[back]
        keep = held > 1
        ends = np.cumsum(np.bincount(group[keep], minlength=len(pdf)))
        m, crowded = m[keep], held[keep] > segment_bound
        cuts = list(zip(np.append(0, ends[:-1]), ends))
        out = pd.DataFrame({"g": pdf["g"], "m": [m[a:b].tobytes() for a, b in cuts], "crowded": [crowded[a:b].tobytes() for a, b in cuts]})
        tidy()
        return out[out["m"].str.len() > 0]

    rows = table.groupBy("g").applyInPandas(minimizers, "part long, g long, m binary, n binary")
    marks = staged(rows.groupBy("part").applyInPandas(shared, "g long, m binary, crowded binary"))
    moved = marks.agg(F.sum(F.octet_length("m"))).first()[0] or 0
    shards = pieces(moved // 8 * 16, shard_words)  # about 16 words a segment

    def contents(own: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"shard": [], "g": [], "lows": [], "content": [], "places": []})
        if not len(own) or not len(marks):
            return empty
        own = own.sort_values("at")
        words, hashes, (doc, first, last, m) = cut_up(own)
        wanted, crowded = np.frombuffer(b"".join(marks["m"]), "<u8"), np.frombuffer(b"".join(marks["crowded"]), bool)
        order = np.argsort(wanted)
        wanted, crowded = wanted[order], crowded[order]
        at = np.minimum(np.searchsorted(wanted, m), len(wanted) - 1)
        keep = wanted[at] == m
        doc, first, last, m, apart = doc[keep], first[keep], last[keep], m[keep], crowded[at[keep]]
        if apart.any():  # one segment a window
            n = np.where(apart, last - first + 1, 1)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            doc, m, single = np.repeat(doc, n), np.repeat(m, n), np.repeat(apart, n)
            first, last = np.repeat(first, n) + step, np.where(single, np.repeat(first, n) + step, np.repeat(last, n))
            m = np.where(single, span_hashes(hashes, first, first + window)[0], m)
        if not len(m):
            return empty
        h1, h2 = span_hashes(hashes, first, last + window)
        shard = (mix(m) % np.uint64(shards)).astype("int64")
        lows = own["d"].to_numpy("int64")[doc]
        order = np.lexsort((lows, h2, h1, shard))
        doc, first, last, shard, lows, h1, h2 = (x[order] for x in (doc, first, last, shard, lows, h1, h2))
        new = np.append(True, (shard[1:] != shard[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        ids = np.cumsum(new) - 1
        edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        where = np.zeros(len(doc), PLACES)
        where["doc"], where["first"], where["d"] = doc, first - words.first[doc], lows
        out = []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            where["segment"][a:b] = ids[a:b] - ids[a]
            heads = np.flatnonzero(new[a:b]) + a
            out.append((int(shard[a]), lows[heads].tobytes(), b"\n".join([words.slice(i, j) for i, j in zip(first[heads].tolist(), (last[heads] + window).tolist())]), where[a:b].tobytes()))
        return pd.DataFrame(out, columns=["shard", "lows", "content", "places"]).assign(g=own["g"].iloc[0])[["shard", "g", "lows", "content", "places"]]

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        """The word spans that documents lose, by group."""
        texts = [c.split(b"\n") for c in pdf["content"]]
        flat = [t for own in texts for t in own]
        ids = {t: i for i, t in enumerate(dict.fromkeys(flat))}
        of = np.fromiter(map(ids.__getitem__, flat), "int64", len(flat))
        lows = np.full(len(ids), LAST)
        np.minimum.at(lows, of, np.frombuffer(b"".join(pdf["lows"]), "int64"))
        best = judge(list(ids), lows, window)
        sizes = np.array([len(b) for b in best])
        starts, best = np.cumsum(sizes) - sizes, np.concatenate(best)
        where = np.frombuffer(b"".join(pdf["places"]), PLACES)
        per = pdf["places"].str.len().to_numpy("int64") // PLACES.itemsize
        row = np.repeat(np.arange(len(pdf)), per)
        begins = np.cumsum([0] + [len(t) for t in texts])[:-1]
        segment = of[begins[row] + where["segment"]]
        # every window of every place
        n = sizes[segment]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        lost = best[np.repeat(starts[segment], n) + step] < np.repeat(where["d"], n)
        place, step = np.repeat(np.arange(len(where)), n)[lost], step[lost]
        head = np.append(True, (place[1:] != place[:-1]) | (step[1:] != step[:-1] + 1)) if len(place) else np.zeros(0, bool)
        tail = np.append(head[1:], True) if len(place) else head
        out = np.zeros(int(head.sum()), SPANS)
        out["doc"], out["first"] = where["doc"][place[head]], where["first"][place[head]] + step[head]
        out["last"] = where["first"][place[tail]] + step[tail] + window
        ends = np.cumsum(np.bincount(row[place[head]], minlength=len(pdf)))
        spans = [out[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)]
        tidy()
        found = pd.DataFrame({"g": pdf["g"], "spans": spans})
        return found[found["spans"].str.len() > 0]

    moved = table.groupBy("g").cogroup(marks.repartition(buckets, "g").groupBy("g")).applyInPandas(contents, "shard long, g long, lows binary, content binary, places binary")
    lost = staged(moved.groupBy("shard").applyInPandas(index, "g long, spans binary"))

    def finish(own: pd.DataFrame, lost: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": [], "spans": []}
        if len(own):
            own = own.sort_values("at")
            found = np.frombuffer(b"".join(lost["spans"]), SPANS)
            found = found[np.argsort(found["doc"], kind="stable")]
            edges = np.searchsorted(found["doc"], np.arange(len(own) + 1))
            for i, (ident, text, copy) in enumerate(zip(own["doc_id"], own["text"], own["copy"])):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                mine = found[edges[i] : edges[i + 1]]
                gone = np.zeros(len(words) + 1, "int64")
                if copy and len(words) >= window:
                    gone[0] = 1
                np.add.at(gone, mine["first"], 1)
                np.add.at(gone, mine["last"], -1)
                gone = np.cumsum(gone[:-1]) > 0
                flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype("int8"), [0]]))).reshape(-1, 2)
                out["doc_id"].append(None if pd.isna(ident) else int(ident))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_text"].append((b" ".join([words[k] for k in np.flatnonzero(~gone)]) if len(mine) or copy else b" ".join(words)).decode("utf-8", "replace"))
                out["spans"].append([{"start": a, "end": b} for a, b in flips.tolist()])
        return pd.DataFrame(out).astype({"doc_id": "Int64"})

    shape = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"
    return table.select("g", "doc_id", "text", "at", "copy").groupBy("g").cogroup(lost.repartition(buckets, "g").groupBy("g")).applyInPandas(finish, shape)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
