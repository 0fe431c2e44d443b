"""Modified Kneser-Ney trigram counts as packed columns, dealt out by the middle word of each trigram.

A shard holds all trigrams around its middle words, so it has all that their probabilities need but
the words' own: how often a trigram and its context occur, how many words stand before a bigram, and
what the middle word gives away. Words travel as codes of a lexicon (frequent words have small codes),
bytes of equal weight side by side and compressed, so a trigram takes a few bytes. A model that is
small enough is rebuilt in every worker; otherwise the documents' trigrams travel to the shards, save
those that a Bloom filter or an unseen middle word rules out: their probability follows from words
alone. Words at either end that the filter rules out stay behind too. A fuller filter rules out less,
and without one all travel; no result changes. Documents go by a 64-bit hash of their text; sums come back packed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import CACHES, tidy
from .hashing import HashIndex, combine
from .words import Words

#: Codes of words that the trusted text doesn't have, and of what stands before a document's first word.
UNSEEN, START = 0, 1
#: Trigrams that a task packs at once.
CHUNK = 500_000
#: Words of a part of the word counts.
SPAN = 1 << 20
_ZSTD = pa.Codec("zstd", compression_level=9)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, of numbers below 2^32: a byte for numbers below 255, four planes of bytes for the rest."""
    out = []
    for c in columns:
        rest = (c[c >= 255] - 255).astype("<u4")
        out += [np.minimum(c, 255).astype("uint8").tobytes(), np.ascontiguousarray(rest.view("uint8").reshape(-1, 4).T).tobytes()]
    whole = b"".join(out)
    return len(columns[0]).to_bytes(8, "little") + len(whole).to_bytes(8, "little") + _ZSTD.compress(whole, asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    whole = np.frombuffer(pa.decompress(blob[16:], size, codec="zstd", asbytes=True), "uint8")
    out, at = [], 0
    for _ in range(columns):
        c = whole[at : at + n].astype("int64")
        large = np.flatnonzero(c == 255)
        at += n
        c[large] += np.ascontiguousarray(whole[at : at + 4 * len(large)].reshape(4, -1).T).view("<u4").ravel()
        at += 4 * len(large)
        out.append(c)
    return out


def _joined(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [unpack(b, columns) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, "int64") for k in range(columns)]


def resident(name: str, make: Callable):
    """What make() gives, kept in this worker under a name; only the last one stays."""
    held = CACHES.setdefault("kneser-ney", {})
    if name not in held:
        tidy()
        held[name] = make()
        tidy("kneser-ney")
    return held[name]


def place(b: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each middle word."""
    return (((b * 0x9E3779B1) & 0xFFFFFFFF) * shards) >> 32


class Lexicon:
    """Codes of word hashes; hashes[i] has code i + 2."""

    def __init__(self, hashes: np.ndarray):
        self.index = HashIndex(hashes, np.arange(2, len(hashes) + 2, dtype="uint32"))

    def trigrams(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words in each text, and the codes of each word with the two before it) of a list of texts."""
        words = Words(texts, lower=True)
        sizes = words.sizes
        at = self.index.find(words.hashes().view("int64"))
        flat = np.full(len(at) + 2 * len(sizes), START, "int64")
        last = np.arange(len(at)) + 2 * (1 + np.repeat(np.arange(len(sizes)), sizes))
        flat[last] = np.where(at >= 0, self.index.values[0][at], UNSEEN)
        return sizes, flat[last - 2], flat[last - 1], flat[last]


def word_counts(batches: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """(part, blob) of batches of text: words' hashes and how often they occur, summed up now and then."""
    held, n = [], 0

    def flush() -> pd.DataFrame:
        words, k = np.unique(np.concatenate(held), return_counts=True)
        part = ((words & 0xFFFFFFFF) * parts) >> 32
        own = [part == x for x in range(parts)]
        return pd.DataFrame({"part": np.arange(parts), "blob": [words[x].tobytes() + pack(k[x]) for x in own], "n": [int(x.sum()) for x in own]})

    for batch in batches:
        held.append(Words(batch["text"].tolist(), lower=True).hashes().view("int64"))
        n += len(held[-1])
        if n > 6 * CHUNK:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def summed_words(group: pd.DataFrame) -> pd.DataFrame:
    """(c, n) of one part's blobs."""
    words = np.concatenate([np.frombuffer(x[: 8 * n], "int64") for x, n in zip(group["blob"], group["n"], strict=True)])
    k = np.concatenate([unpack(x[8 * n :], 1)[0] for x, n in zip(group["blob"], group["n"], strict=True)])
    words, of = np.unique(words, return_inverse=True)
    return pd.DataFrame({"c": words, "n": np.bincount(of.ravel(), k, len(words)).astype("int64")})


def packed_counts(batches: Iterator[pd.DataFrame], lexicon: Lexicon, shards: int) -> Iterator[pd.DataFrame]:
    """(shard, blob) of batches of text: trigrams and how often they occur."""
    held, n = [], 0

    def flush() -> pd.DataFrame:
        a, b, c = (np.concatenate([h[k] for h in held]) for k in range(3))
        _, at, k = np.unique(combine(a, b, c), return_index=True, return_counts=True)
        return _sorted_blobs(a[at], b[at], c[at], k, place(b[at], shards))

    for batch in batches:
        texts = batch["text"].tolist()
        for lo in range(0, len(texts), 512):
            held.append(lexicon.trigrams(texts[lo : lo + 512])[1:])
            n += len(held[-1][0])
            if n > 2 * CHUNK:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _sorted_blobs(a, b, c, k, shard) -> pd.DataFrame:
    order = np.lexsort((a, b, shard))
    a, b, c, k, shard = a[order], b[order], c[order], k[order], shard[order]
    ids, starts = np.unique(shard, return_index=True)
    ends = np.append(starts[1:], len(shard))
    blobs = []
    for x, y in zip(starts, ends, strict=True):
        step = np.diff(b[x:y], prepend=0)
        blobs.append(pack(np.where(step == 0, np.diff(a[x:y], prepend=0), a[x:y]), step, c[x:y], k[x:y]))
    return pd.DataFrame({"shard": ids, "blob": blobs})


def _sorted_columns(blob: bytes) -> list[np.ndarray]:
    a, step, c, k = unpack(blob, 4)
    first = np.flatnonzero(step)  # of each middle word; no code in a model is 0
    sums = np.cumsum(a)
    return [sums - np.repeat(sums[first] - a[first], np.diff(np.append(first, len(a)))), np.cumsum(step), c, k]


def _trigram_counts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, c, n) of blobs of counts, each trigram once."""
    parts = [_sorted_columns(x) for x in blobs]
    a, b, c, k = (np.concatenate([p[j] for p in parts]) for j in range(4))
    del parts
    _, at, of = np.unique(combine(a, b, c), return_index=True, return_inverse=True)
    return a[at], b[at], c[at], np.bincount(of.ravel(), k, len(at)).astype("int64")


def merged(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    """(kind, shard, blob, s) of one shard's blobs.

    Kind 0 holds the shard's counts, s its counts of counts, entries and tokens; kind 1 the words by the number of
    words before them, in parts of SPAN codes; kind 2 the places in a filter of 2^bits (0: no filter) of its contexts and bigrams;
    kind 3 its middle words with the sum of their bigrams' counts and how many of these are 1, 2, and more.
    """
    shard = int(group["shard"].iloc[0])
    a, b, c, n = _trigram_counts(group["blob"].tolist())
    _, at, n2 = np.unique(combine(b, c), return_index=True, return_counts=True)
    contexts = np.unique(combine(a, b))
    s = [*np.bincount(np.minimum(n, 5), minlength=6)[1:5], *np.bincount(np.minimum(n2, 5), minlength=6)[1:5], len(n) + len(n2) + len(contexts) + len(np.unique(b)), int(n.sum())]
    rows = [(0, shard, _sorted_blobs(a, b, c, n, np.zeros_like(b))["blob"].iloc[0], s)]
    words, k = np.unique(c[at], return_counts=True)
    for part in np.unique(words // SPAN):
        own = words // SPAN == part
        rows.append((1, int(part), pack(words[own], k[own]), None))
    middle, of = np.unique(b[at], return_inverse=True)
    of = of.ravel()
    rows.append((3, shard, pack(middle, *(np.bincount(of, x, len(middle)) for x in (n2, n2 == 1, n2 == 2, n2 > 2))), None))
    if bits:
        marks = np.unique(np.concatenate([probes(a, b, bits, 0), probes(b[at], c[at], bits, 1)]))
        rows.append((2, shard, pack(np.diff(marks, prepend=0)), None))
    return pd.DataFrame(rows, columns=["kind", "shard", "blob", "s"])


def ranks(words: int, shards: int) -> np.ndarray:
    """The place of each code among those of its shard."""
    shard = place(np.arange(words), shards)
    order = np.argsort(shard, kind="stable")
    out = np.zeros(words, "uint32")
    out[order] = np.arange(words) - np.searchsorted(shard[order], shard[order])
    return out


def probes(x: np.ndarray, y: np.ndarray, bits: int, kind: int) -> np.ndarray:
    """Two places of each pair (x, y) in a filter of 2^bits, one row after the other."""
    h = combine(np.full(len(x), kind, "int64"), x, y).view("uint64")
    return np.concatenate([(h >> np.uint64(64 - bits)), (h & np.uint64((1 << bits) - 1))]).astype("int64")


def summed(group: pd.DataFrame) -> pd.DataFrame:
    """One blob of a part of the word counts."""
    c, n = _joined(group["blob"].tolist(), 2)
    words, of = np.unique(c, return_inverse=True)
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "blob": [pack(words, np.bincount(of.ravel(), n))]})


@dataclass
class Numbers:
    """What shards need beside their counts: n1[code] words stand before a word, a bigram backs off from it with w2[code] (0: no context)."""

    n1: np.ndarray
    w2: np.ndarray
    d: list[list[float]]
    total: int
    unknown: float
    shards: int
    bits: int = 0
    filter: bytes = b""  # compressed

    def words(self) -> np.ndarray:
        return np.where(self.n1 > 0, (self.n1 - _take(self.n1, self.d[0])) / self.total + self.unknown, self.unknown)

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        """Words' probabilities and weights in single precision, and what stands for those that have none."""
        single = lambda v, seen, other: np.where(seen, v.astype("float32").astype("float64"), other)
        return single(self.words(), self.n1 > 0, self.unknown), single(self.w2, self.w2 > 0, 1.0)


class Sieve:
    """What a worker that packs documents holds: the lexicon, words' numbers and the filter."""

    def __init__(self, hashes: np.ndarray, numbers: Numbers):
        self.lexicon, self.bits, self.shards, self.unknown = Lexicon(hashes), numbers.bits, numbers.shards, numbers.unknown
        self.p1, self.w2 = numbers.single()
        self.ranks = ranks(len(numbers.n1), numbers.shards)
        self.filter = np.frombuffer(pa.decompress(numbers.filter, 1 << (numbers.bits - 3), codec="zstd"), "uint8") if numbers.bits else None

    def may_have(self, x: np.ndarray, y: np.ndarray, kind: int) -> np.ndarray:
        """False only where the model doesn't have the context (kind 0) or bigram (kind 1) of x and y."""
        if self.filter is None:
            return np.ones(len(x), bool)
        at = probes(x, y, self.bits, kind)
        on = (self.filter[at >> 3] >> (at & 7).astype("uint8")) & 1
        return (on[: len(x)] & on[len(x) :]).astype(bool)


def _take(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


class _Dense:
    """Words' values by code, looked up as in a HashIndex."""

    def __init__(self, seen: np.ndarray, values: np.ndarray):
        self.seen, self.values = seen, [values]

    def find(self, codes: np.ndarray) -> np.ndarray:
        return np.where(self.seen[codes], codes, -1)


def tables(blobs: list[bytes], numbers: Numbers) -> dict[str, HashIndex | _Dense]:
    """The probabilities and weights of the shards in blobs, in single precision."""
    a, b, c, n = _trigram_counts(blobs)
    p1 = numbers.words()
    d2, d3 = numbers.d[1:]
    k2, at, of2, n2 = np.unique(combine(b, c), return_index=True, return_inverse=True, return_counts=True)

    def weights(keys: np.ndarray, n: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ks, of = np.unique(keys, return_inverse=True)
        of = of.ravel()
        t = np.bincount(of, n)
        return ks, of, t, np.bincount(of, _take(n, d)) / t

    of, t = weights(b[at], n2, d2)[1:3]
    p2 = (n2 - _take(n2, d2)) / t[of] + numbers.w2[b[at]] * p1[c[at]]
    kw3, of, t, w3 = weights(combine(a, b), n, d3)
    p3 = (n - _take(n, d3)) / t[of] + w3[of] * p2[of2.ravel()]
    f = lambda v: v.astype("float32")
    return {"p3": HashIndex(combine(a, b, c), f(p3)), "w3": HashIndex(kw3, f(w3)), "p2": HashIndex(k2, f(p2)), "w2": _Dense(numbers.w2 > 0, f(numbers.w2)), "p1": _Dense(numbers.n1 > 0, f(p1))}


class Table:
    """Probabilities and weights in memory."""

    def __init__(self, blobs: list[bytes], numbers: Numbers):
        self.__dict__ |= tables(blobs, numbers)
        self.unknown = numbers.unknown

    def logs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural log-probability of each c after (a, b)."""

        def look(t: HashIndex | _Dense, keys: np.ndarray, missing: float) -> np.ndarray:
            at = t.find(keys)
            return np.where(at >= 0, t.values[0][at].astype("float64"), missing)

        p = look(self.p3, combine(a, b, c), -1.0)
        rest = np.flatnonzero(p < 0)
        a, b, c = a[rest], b[rest], c[rest]
        q = look(self.p2, combine(b, c), -1.0)
        low = np.flatnonzero(q < 0)
        q[low] = look(self.w2, b[low], 1.0) * look(self.p1, c[low], self.unknown)
        p[rest] = look(self.w3, combine(a, b), 1.0) * q
        return np.log(p)


def packed_texts(batches: Iterator[pd.DataFrame], sieve: Sieve, splits: np.ndarray) -> Iterator[pd.DataFrame]:
    """(shard, split, kind, chunk, blob) of batches of (key, text).

    Kind 1 holds trigrams that must see their shard, each with its document's place in the chunk; kind 2 holds how many
    rows of kind 1 the chunk has, and for each document its key, its words and the summed logarithms of what follows
    from words alone. A chunk is named by its keys.
    """
    keys, held, n = [], [], 0

    def flush() -> pd.DataFrame:
        own = np.concatenate(keys)
        sizes, a, b, c = (np.concatenate([h[k] for h in held]) for k in range(4))
        doc = np.repeat(np.arange(len(own)), sizes)
        context, bigram = sieve.may_have(a, b, 0), sieve.may_have(b, c, 1)
        away = (b != UNSEEN) & (context | bigram)
        # alone: the weight of b and the probability of c; away without the bigram: what c differs from an unseen word
        alone = np.where(away, np.where(bigram, 1.0, sieve.p1[c] / sieve.unknown), sieve.w2[b] * sieve.p1[c])
        logs = np.bincount(doc, np.log(alone), len(own))
        a, b, c, doc = np.where(context, a, UNSEEN)[away], b[away], np.where(bigram, c, UNSEEN)[away], doc[away]
        shard = place(b, sieve.shards)
        order = np.argsort(shard.astype("uint16") if sieve.shards < 1 << 16 else shard, kind="stable")
        a, b, c, doc, shard = a[order], b[order], c[order], doc[order], shard[order]
        ids, starts = np.unique(shard, return_index=True)
        chunk = int(np.bitwise_xor.reduce(combine(own, np.arange(len(own)))))
        mix = chunk & 0xFFFFFFFF
        rows = [(mix % sieve.shards, 0, 2, chunk, len(ids).to_bytes(8, "little") + own.tobytes() + sizes.astype("int64").tobytes() + logs.tobytes())]
        for shard_, x, y in zip(ids, starts, [*starts, len(shard)][1:], strict=True):
            rows.append((int(shard_), mix % int(splits[shard_]), 1, chunk, pack(a[x:y], sieve.ranks[b[x:y]], c[x:y], np.diff(doc[x:y], prepend=0))))
        return pd.DataFrame(rows, columns=["shard", "split", "kind", "chunk", "blob"])

    for batch in batches:
        texts, ids = batch["text"].tolist(), batch["key"].to_numpy("int64")
        for lo in range(0, len(texts), 512):
            keys.append(ids[lo : lo + 512])
            held.append(sieve.lexicon.trigrams(texts[lo : lo + 512]))
            n += len(held[-1][1])
            if n > CHUNK:
                yield flush()
                keys, held, n = [], [], 0
    if keys:
        yield flush()


def shard_scores(group: pd.DataFrame, numbers: Numbers) -> pd.DataFrame:
    """(chunk, kind, blob) of one shard's rows: in kind 1 documents' places and summed logarithms, kind 2 as it came."""
    blobs = group["blob"][group["kind"] == 0].tolist()
    table = Table(blobs, numbers) if blobs else None
    words, rows = np.flatnonzero(place(np.arange(len(numbers.n1)), numbers.shards) == int(group["shard"].iloc[0])), []
    for kind, chunk, blob in zip(group["kind"], group["chunk"], group["blob"], strict=True):
        if kind == 1:
            a, b, c, at = unpack(blob, 4)
            docs, of = np.unique(np.cumsum(at), return_inverse=True)
            logs = np.bincount(of.ravel(), table.logs(a, words[b], c), len(docs))
            blob = len(docs).to_bytes(8, "little") + logs.tobytes() + pack(np.diff(docs, prepend=0))
        if kind:
            rows.append((chunk, kind, blob))
    return pd.DataFrame(rows, columns=["chunk", "kind", "blob"])


def document_scores(group: pd.DataFrame) -> pd.DataFrame:
    """(_key, _n, _log) of some chunks' rows, each key once: documents of one key have equal words and sums."""
    found = []
    for _, rows in group.groupby("chunk"):
        own, parts = rows["blob"][rows["kind"] == 2].tolist(), rows["blob"][rows["kind"] == 1].tolist()
        sent = [int.from_bytes(x[:8], "little") for x in own]
        if not own or sum(sent) != len(parts):
            raise RuntimeError("parts of a chunk are missing: its documents were read in another order when a task ran again")
        keys, sizes, logs = np.frombuffer(own[0][8:], "int64").reshape(3, -1)
        logs = logs.view("float64") * len(own)  # equal chunks come together
        for x in parts:
            end = 8 + 8 * int.from_bytes(x[:8], "little")
            logs[np.cumsum(unpack(x[end:], 1)[0])] += np.frombuffer(x[8:end], "float64")
        found.append((keys, sizes, logs / len(own)))
    keys, sizes, logs = (np.concatenate([f[k] for f in found]) for k in range(3))
    keys, at = np.unique(keys, return_index=True)
    return pd.DataFrame({"_key": keys, "_n": sizes[at], "_log": logs[at]})
