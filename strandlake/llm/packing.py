"""Operator 1: vector best-fit packing of tokenised documents.

Documents become token pieces, cut only where one is longer than a sequence. Every open sequence
has a vector of residual capacities: tokens, documents, and attention cost (the sum of squared
lengths). A piece goes to the feasible sequence with the smallest weighted norm of what would be
left (`score="norm"`), or with the largest weighted dot product of demand and residual
(`score="dot"`); every capacity binds.

Full pieces fill a sequence alone and need no search. The others are dealt into groups of bounded
size by their place in the staged piece table, packed longest first in one task each; a group
wastes at most its last, part-filled sequences, so the loss does not grow with the input.

Edge cases: null text is empty and makes one piece of the separator alone; documents without an id,
and repeated rows, are packed like any other row; an empty table gives no rows; very long texts are
encoded whole and cut into full pieces; of bins of one worth the oldest wins; further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, pieces, staged, tidy

#: Words that the tokenizer treats run by run: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]{1,60}\Z")
#: The tokenizer's own split pattern, narrowed to those characters; words end in a line break.
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries that a worker remembers, of words and of runs.
REMEMBERED = 600_000
#: Texts encoded together; their words are in memory at once.
AT_ONCE = 2_000
_NONE = np.int64(1 << 40)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairMerger:
    """Byte-pair merging of many runs at once, over a hash table of the vocabulary's merges."""

    BITS = 19
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: dict):
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], "int64")
        self.last = np.array([vocab[c + suffix] for c in letters], "int64")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], "uint64")
        made = np.array([vocab[a + b] for a, b in pairs], "int64")
        self.keys = np.full(1 << self.BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank = np.full(1 << self.BITS, _NONE)
        self.made = np.zeros(1 << self.BITS, "int64")
        for rank, (at, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist())):
            while self.keys[at] != 0xFFFFFFFFFFFFFFFF and self.keys[at] != key:
                at = (at + 1) % (1 << self.BITS)
            if self.keys[at] != key:
                self.keys[at], self.rank[at], self.made[at] = key, rank, made[rank]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.MIX) >> np.uint64(64 - self.BITS)).astype("int64")

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = a.astype("uint64") << np.uint64(20) | b.astype("uint64")
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, at, -1)
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            at[open_] = (at[open_] + 1) % (1 << self.BITS)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out

    def __call__(self, runs: list[bytes]) -> list[bytes]:
        """Ids of every run, as bytes; runs of one length go together."""
        sizes = np.fromiter(map(len, runs), "int64", len(runs))
        out: list[bytes] = [b""] * len(runs)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            raw = np.frombuffer(b"".join([runs[i] for i in rows]), np.uint8).reshape(len(rows), size)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            for i, made in zip(rows, self._merge(ids)):
                out[i] = made
        return out

    def _merge(self, ids: np.ndarray) -> list[bytes]:
        n, width = ids.shape
        count = np.full(n, width)
        if width > 1:
            slots = self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
            ranks = np.where(slots >= 0, self.rank[slots], _NONE)
            live = np.arange(n)
            while len(live):
                at = ranks[live].argmin(1)  # the leftmost of the lowest rank
                low = ranks[live, at]
                keep = low < _NONE
                live, at = live[keep], at[keep]
                if not len(live):
                    break
                rows = ids[live]
                cols = np.arange(width)
                merged = self.made[self._find(rows[np.arange(len(live)), at], rows[np.arange(len(live)), at + 1])]
                shift = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
                rows = np.take_along_axis(rows, shift, 1)
                rows[np.arange(len(live)), at] = merged
                ids[live] = rows
                count[live] -= 1
                own = ranks[live]
                own = np.take_along_axis(own, np.minimum(cols[None, :-1] + (cols[None, :-1] > at[:, None]), width - 2), 1)
                ends = count[live] - 1  # pairs left in each row
                for k in (at - 1, at):
                    ok = np.flatnonzero((k >= 0) & (k < ends))
                    found = self._find(rows[ok, k[ok]], rows[ok, k[ok] + 1])
                    own[ok, k[ok]] = np.where(found >= 0, self.rank[found], _NONE)
                own[cols[None, :-1] >= ends[:, None]] = _NONE
                ranks[live] = own
        return [row[:c].tobytes() for row, c in zip(ids.astype("<u4"), count.tolist())]


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, remembered word by word.

    No token of this tokenizer spans white space, so a text's ids are the ids of its words. The
    ids of an unseen word come from the tokenizer's merges run by run for plain words, and from
    the tokenizer itself for any other.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merger = PairMerger(json.load(f)["model"])
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _learn(self, unseen: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't remembered."""
        plain, made = [], {}
        for word in unseen:
            text = word.decode("utf-8", "replace")
            if _PLAIN.match(text) and "<|" not in text:
                plain.append(text)
            else:
                made[word] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not plain:
            return made
        runs = _RUNS.findall("\n".join(plain).lower() + "\n")
        known = self.runs
        new = [r for r in dict.fromkeys(runs) if r not in known and r != "\n"]
        fresh = dict(zip(new, self.merger([r.encode() for r in new])))
        own = fresh if not known else {**fresh, **{r: known[r] for r in set(runs) if r in known}}
        parts: list[bytes] = []
        words = iter(plain)
        for run in runs:
            if run == "\n":
                made[next(words).encode()] = b"".join(parts)
                parts = []
            else:
                parts.append(own[run])
        if len(known) < self.remembered:
            known.update(fresh)
        return made

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        known = self.words
        unseen = [w for w in set().union(*split) if w not in known]
        made = self._learn(unseen) if unseen else {}
        if len(known) + len(made) <= self.remembered:
            known.update(made)
            look = known.__getitem__
            return [b"".join(map(look, words)) for words in split]
        get, rest = known.get, made.__getitem__  # a word's ids may be none at all, so b"" isn't a miss
        return [b"".join([rest(w) if (ids := get(w)) is None else ids for w in words]) for words in split]


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and worker."""
    held = CACHES.setdefault("tokenizer", {})
    if path not in held:
        tidy("tokenizer")
        held[path] = WordEncoder(path)
    return held[path]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Pieces of at most capacity ids of every document: doc_id, piece, start, length, ids_crc32."""
    end = int(separator).to_bytes(4, "little")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for lo in range(0, len(batch), AT_ONCE):
                part_of = batch.iloc[lo : lo + AT_ONCE]
                for doc, ids in zip(part_of["doc_id"].astype("Int64").tolist(), encode(part_of["text"].tolist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (None if doc is pd.NA else doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
            yield pd.DataFrame({"doc_id": pd.array(out[0], "Int64"), "piece": np.array(out[1], "int32"), "start": np.array(out[2], "int64"), "length": np.array(out[3], "int64"), "ids_crc32": np.array(out[4], "int64")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut_up, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, longest first; bins are numbered from 0.

    Residuals are fractions of each capacity. Bins that can take not even the shortest length are
    put away now and then, so that a step looks at open bins only.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    bins, offsets = np.zeros(n, "int64"), np.zeros(n, "int64")
    tokens, slots, heat = (np.zeros(n + 1) for _ in range(3))
    name = np.zeros(n + 1, "int64")
    opened = live = 0
    wt, wd, wa = weights
    for step, i in enumerate(order):
        size = int(lengths[i])
        heat_of = float(size) * size
        place = -1
        if live:
            t, d, a = tokens[:live], slots[:live], heat[:live]
            fits = np.flatnonzero((t >= size) & (d >= 1) & (a >= heat_of))
            if len(fits):
                rt, rd, ra = t[fits], d[fits], a[fits]
                if score == "norm":
                    worth = -(wt * ((rt - size) / capacity) ** 2 + wd * ((rd - 1) / max_docs) ** 2 + wa * ((ra - heat_of) / max_cost) ** 2)
                else:
                    worth = wt * rt * size / capacity**2 + wd * rd / max_docs**2 + wa * ra * heat_of / max_cost**2
                place = int(fits[np.argmax(worth)])
        if place < 0:
            place = live
            tokens[live], slots[live], heat[live], name[live] = capacity, max_docs, max_cost, opened
            live += 1
            opened += 1
        bins[i], offsets[i] = name[place], int(capacity - tokens[place])
        tokens[place] -= size
        slots[place] -= 1
        heat[place] -= heat_of
        if step % 256 == 255:
            stay = (tokens[:live] >= least) & (slots[:live] >= 1) & (heat[:live] >= least * least)
            kept = int(stay.sum())
            if kept < live:
                for held in (tokens, slots, heat, name):
                    held[:kept] = held[:live][stay]
                live = kept
    return bins, offsets


def pack(cut_pieces: DataFrame, capacity: int = 2048, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm", group_rows: int = 8_192) -> DataFrame:
    """Assign every piece a sequence and an offset in it.

    max_docs and max_cost default to what capacity tokens can reach at most, so that they bind only
    where given. A piece that breaks a capacity alone is an error.
    """
    max_docs = max_docs or capacity
    max_cost = float(max_cost or capacity * capacity)
    table = staged(cut_pieces, AT_ONCE)
    # the place in the staged table decides the group: stable under retries, and equal rows spread
    placed = table.withColumn("_at", F.monotonically_increasing_id())
    alone = placed.where(F.col("length") >= capacity)
    rest = placed.where(F.col("length") < capacity)
    groups = pieces(rest.count(), group_rows)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy("int64")
        if len(sizes) and (float(sizes.max()) ** 2 > max_cost):
            raise ValueError("a piece exceeds the attention-cost capacity")
        bins, offsets = best_fit(sizes, capacity, max_docs, max_cost, weights, score)
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["sequence_id"] = pdf["_group"].to_numpy("int64") * (1 << 32) + bins
        out["offset"] = offsets
        return out

    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("_group").applyInPandas(fill, PIECE_SCHEMA + ", sequence_id long, offset long")
    full = alone.select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("_at") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, **options) -> DataFrame:
    """Tokenise and pack whole documents; see pack() for the options."""
    return pack(tokenize(docs, tokenizer, capacity, separator), capacity, **options)
