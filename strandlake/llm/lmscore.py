"""Operator 2: masked pseudo-likelihood from a bidirectional window network.

The network predicts every token, which it doesn't see, from the `reach` tokens on both sides: the
embeddings of the context, each position with a matrix row of its own, are summed into a hidden
layer, and a two-level softmax (a class, then a token of the class) gives the conditional
log-probability. A document's score is the sum over its tokens.

Every word of the corpus is counted, in a sharded aggregation of packed arrays. The vocabulary is the
most frequent words; its size grows with the cube root of the number of distinct words, and with it
the network. All other words share hashed buckets: such a word has its bucket's probability times its
share of the bucket by the corpus counts, so the probabilities of all words of the corpus sum to one.

Texts are dealt once into a bucketed table of lanes of about `lane_bytes`, from which the counts are
made and, with the totals that come back to each lane, the encoded table. Training predicts every
position of every document once: in each of `rounds` rounds every lane makes steps of AdaGrad over its
share of the documents from the common start, and the lanes' parameters are averaged, weighted by
their positions, in a two-level sum; only the averages, whose size is that of the network, reach the
driver. Numpy does all of it.

Edge cases: null and empty texts have no tokens and score 0; documents without an id are scored;
repeated rows are scored alike; words of one count are ordered by hash; an empty table gives no rows;
very long texts are encoded whole, one to a lane at worst; further columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, kept, pieces, scratch, staged, tidy
from .hashing import HashIndex
from .words import Words

#: Positions handled at once, and documents in a row of the encoded table.
CHUNK, DOCS = 8_192, 256
#: Words rarer than this stay out of the vocabulary.
LEAST_COUNT = 4


class WindowNetwork:
    """Parameters, loss and gradients."""

    NAMES = ("embed", "mix", "bias", "heads", "head_bias", "tails", "tail_bias")

    def __init__(self, size: int, width: int = 16, reach: int = 2, seed: int = 5):
        self.size, self.width, self.reach = size, width, reach
        self.classes = int(np.ceil(np.sqrt(size)))
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype("float32")
        self.p = {
            "embed": normal(size, width),
            "mix": normal(2 * reach, width) + 1,
            "bias": np.zeros(width, "float32"),
            "heads": normal(width, self.classes),
            "head_bias": np.zeros(self.classes, "float32"),
            "tails": normal(self.classes, width, self.classes),
            "tail_bias": np.zeros((self.classes, self.classes), "float32"),
        }
        self.energy = {n: np.full(v.shape, 1e-6, "float32") for n, v in self.p.items()}

    def start_from(self, counts: np.ndarray) -> None:
        """Biases of the corpus's own frequencies."""
        padded = np.zeros(self.classes**2)
        padded[: self.size] = counts + 0.5
        grid = padded.reshape(self.classes, self.classes)
        self.p["head_bias"] = np.log(grid.sum(1) / grid.sum() + 1e-12).astype("float32")
        self.p["tail_bias"] = np.where(grid > 0, np.log(np.maximum(grid, 1e-12) / np.maximum(grid.sum(1, keepdims=True), 1e-12)), -30.0).astype("float32")

    @property
    def offsets(self) -> list[int]:
        return [o for o in range(-self.reach, self.reach + 1) if o]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """context: (n, 2 reach) token ids."""
        h = np.take(self.p["embed"], context[:, 0], axis=0) * self.p["mix"][0] + self.p["bias"]
        for j in range(1, context.shape[1]):
            h += np.take(self.p["embed"], context[:, j], axis=0) * self.p["mix"][j]
        return np.tanh(h, out=h)

    @staticmethod
    def _softmax(x: np.ndarray, pick: np.ndarray, wanted: bool) -> np.ndarray:
        """log softmax(x)[pick]; x becomes softmax(x) less one at pick where wanted."""
        rows = np.arange(len(x))
        np.minimum(x, 60, out=x)
        out = x[rows, pick]
        np.exp(x, out=x)
        total = x.sum(1)
        if wanted:
            x /= total[:, None]
            x[rows, pick] -= 1
        return out - np.log(total)

    def logs(self, context: np.ndarray, target: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Log-probability of each target; puts the loss's gradients into grads where given.

        grads gets whole arrays, but for `embed` a pair of token ids and their rows, and for `tails`
        and `tail_bias` only the classes that occur.
        """
        p, k = self.p, self.classes
        top, low = np.divmod(np.asarray(target, "int64"), k)
        order = np.argsort(top.astype("uint16"), kind="stable")
        context, top, low = context[order], top[order], low[order]
        h = self.hidden(context)
        x = h @ p["heads"]
        x += p["head_bias"]
        found = self._softmax(x, top, grads is not None)
        dh = None
        if grads is not None:
            grads["heads"], grads["head_bias"] = h.T @ x, x.sum(0)
            dh = x @ p["heads"].T
            grads["tails"], grads["tail_bias"] = {}, {}
        edges = np.searchsorted(top, np.arange(k + 1))
        for c in np.flatnonzero(np.diff(edges)):
            at = slice(edges[c], edges[c + 1])
            x = h[at] @ p["tails"][c]
            x += p["tail_bias"][c]
            found[at] += self._softmax(x, low[at], grads is not None)
            if grads is not None:
                grads["tails"][c], grads["tail_bias"][c] = h[at].T @ x, x.sum(0)
                dh[at] += x @ p["tails"][c].T
        if grads is not None:
            dh *= 1 - h * h
            grads["bias"] = dh.sum(0)
            grads["mix"] = np.stack([np.einsum("ij,ij->j", dh, np.take(p["embed"], context[:, j], axis=0)) for j in range(context.shape[1])])
            flat = context.T.ravel()
            by = np.argsort(flat.astype("uint16") if self.size <= 1 << 16 else flat, kind="stable")
            heads = np.flatnonzero(np.diff(flat[by], prepend=-1))
            rows = np.concatenate([dh * p["mix"][j] for j in range(context.shape[1])])
            grads["embed"] = flat[by][heads], np.add.reduceat(rows[by], heads, axis=0)
        out = np.empty(len(found), "float64")
        out[order] = found
        return out

    def step(self, grads: dict, n: int, rate: float) -> None:
        """One step of AdaGrad with gradients summed over n positions."""
        for name, g in grads.items():
            parts = [(g[0], g[1])] if isinstance(g, tuple) else g.items() if isinstance(g, dict) else [(..., g)]
            for at, own in parts:
                own = own / n
                self.energy[name][at] += own * own
                self.p[name][at] -= rate * own / np.sqrt(self.energy[name][at])

    def flat(self) -> np.ndarray:
        """Parameters and the energies of their steps."""
        return np.concatenate([held[n].ravel() for held in (self.p, self.energy) for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for held in (self.p, self.energy):
            for n in self.NAMES:
                size = held[n].size
                held[n] = flat[at : at + size].reshape(held[n].shape).astype("float32")
                at += size


def windows(docs: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(padded stream, places of all tokens in it); documents are parted by `reach` edge tokens."""
    sizes = np.array([len(d) for d in docs], "int64")
    total = int(sizes.sum()) + reach * (len(docs) + 1)
    stream = np.zeros(total, "int64")
    starts = reach + np.cumsum(sizes + reach) - (sizes + reach)
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    stream[places] = np.concatenate(docs) if docs else []
    return stream, places


def document_logs(net: WindowNetwork, docs: list[np.ndarray]) -> np.ndarray:
    """Summed conditional log-probabilities of each document."""
    stream, places = windows(docs, net.reach)
    logs = np.zeros(len(places))
    for lo in range(0, len(places), CHUNK):
        at = places[lo : lo + CHUNK]
        logs[lo : lo + CHUNK] = net.logs(np.stack([stream[at + o] for o in net.offsets], 1), stream[at])
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return np.bincount(owner, logs, len(docs)) if docs else np.zeros(0)


def train_on(net: WindowNetwork, batches: Iterator[list[np.ndarray]], rate: float = 0.1, least: int = 256) -> int:
    """AdaGrad over every position of the documents, of least to CHUNK positions a step; returns how many there were."""
    seen = 0
    for docs in batches:
        stream, places = windows(docs, net.reach)
        step = max(least, min(CHUNK, len(places) // 8))
        for lo in range(0, len(places), step):
            at = places[lo : lo + step]
            grads: dict = {}
            net.logs(np.stack([stream[at + o] for o in net.offsets], 1), stream[at], grads)
            net.step(grads, len(at), rate)
        seen += len(places)
    return seen


def vocabulary_size(distinct: int) -> int:
    """Words that get an id of their own, by the number of distinct words of the corpus."""
    return max(64, 16 * round(distinct ** (1 / 3)))


def score(docs: DataFrame, size: int | None = None, width: int = 16, reach: int = 2, rounds: int = 2, passes: int = 1, lane_bytes: int = 8 << 20, bucket_bytes: int = 32 << 20, part_rows: int = 500_000, parts_sum: int = 64) -> DataFrame:
    """doc_id, n_tokens, log_prob (their summed conditional log-probability) and mean_log_prob; size: words of the vocabulary, by default vocabulary_size(); passes: how often every position is trained."""
    with scratch():
        out = _score(docs, size, width, reach, rounds, passes, lane_bytes, bucket_bytes, part_rows, parts_sum)
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def _score(docs: DataFrame, size: int | None, width: int, reach: int, rounds: int, passes: int, lane_bytes: int, bucket_bytes: int, part_rows: int, parts_sum: int) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lanes = pieces(total, lane_bytes)
    buckets = min(lanes, pieces(total, bucket_bytes))
    parts = pieces(total // 40, part_rows)  # a distinct word of a lane for so many bytes, about
    table = bucketed(own.withColumn("lane", F.pmod(F.xxhash64("at"), F.lit(lanes))), "lane", buckets)

    def distinct(pdf: pd.DataFrame) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A lane's words; its distinct hashes by part and value, their counts, the place of each word's among them, and the parts' edges."""
        words = Words(pdf["text"], lower=True)
        names, at, n = np.unique(words.hashes(), return_inverse=True, return_counts=True)
        part = (names % np.uint64(parts)).astype("int64")
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), "int64")
        place[order] = np.arange(len(order))
        return words, names[order], n[order], place[at.ravel()], np.searchsorted(part[order], np.arange(parts + 1))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        _, names, n, _, edges = distinct(pdf.sort_values("at"))
        held = np.flatnonzero(np.diff(edges))
        return pd.DataFrame({"part": held, "lane": pdf["lane"].iloc[0], "words": [names[edges[i] : edges[i + 1]].tobytes() for i in held], "n": [n[edges[i] : edges[i + 1]].astype("<i8").tobytes() for i in held]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """The corpus counts of the words that each lane sent, in its order; and, for the vocabulary, the frequent words."""
        words, n = np.frombuffer(b"".join(pdf["words"]), "<u8"), np.frombuffer(b"".join(pdf["n"]), "<i8")
        names, at = np.unique(words, return_inverse=True)
        sums = np.bincount(at.ravel(), n).astype("int64")
        ends = np.cumsum(pdf["words"].str.len().to_numpy("int64") // 8)
        back = sums[at.ravel()]
        often = np.flatnonzero(sums >= LEAST_COUNT)
        out = pd.DataFrame({"part": pdf["part"], "lane": pdf["lane"], "words": None, "n": [back[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)], "distinct": 0})
        top = pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "lane": [-1], "words": [names[often].tobytes()], "n": [sums[often].tobytes()], "distinct": [len(names)]})
        tidy()
        return pd.concat([out, top])

    shape = "part long, lane long, words binary, n binary"
    counted = staged(table.groupBy("lane").applyInPandas(count, shape).groupBy("part").applyInPandas(add, shape + ", distinct long"))
    frequent = counted.where("lane = -1")
    n_words = frequent.agg(F.sum("distinct")).first()[0] or 0
    size = size or vocabulary_size(n_words)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words, n in zip(batch["words"], batch["n"]):
                yield pd.DataFrame({"word": np.frombuffer(words, "<i8"), "n": np.frombuffer(n, "<i8")})

    words = staged(frequent.select("words", "n").mapInPandas(listed, "word long, n long"))
    # the least count is found from how many words have each count (in three digits), so that no more than the vocabulary is collected
    rough = F.floor(F.col("n") / F.pow(F.lit(10.0), F.greatest(F.floor(F.log10("n")) - 2, F.lit(0)))) * F.pow(F.lit(10.0), F.greatest(F.floor(F.log10("n")) - 2, F.lit(0)))
    steps = words.groupBy(rough.cast("long").alias("least")).count().orderBy(F.desc("least")).collect()  # at most 900 for each power of ten
    least, held = 1 << 62, 0
    for r in steps:
        if held and held + r["count"] > size:
            break
        least, held = r["least"], held + r["count"]
    top = words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    vocabulary = np.array([r["word"] for r in top], "int64")
    first_bucket = len(vocabulary) + 1
    n_buckets = max(16, size // 4)
    size = first_bucket + n_buckets
    shipped = spark.sparkContext.broadcast(vocabulary)  # of the vocabulary's size
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def encode(pdf: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"lane": [], "turn": [], "doc_ids": [], "none": [], "sizes": [], "ids": [], "rare": []})
        if not len(pdf):
            return empty
        pdf = pdf.sort_values("at")
        words, names, _, at, _ = distinct(pdf)
        n = np.frombuffer(b"".join(totals.sort_values("part")["n"]), "<i8")
        known = HashIndex(shipped.value, np.arange(1, len(shipped.value) + 1))
        slot = known.find(names.view("<i8"))
        mine = np.where(slot >= 0, known.values[0][slot], first_bucket + (names >> np.uint64(20)).astype("int64") % n_buckets)
        logs = np.where(slot >= 0, 0.0, np.log(n)) if len(n) else np.zeros(0)
        ids, rare = mine[at].astype(kind), logs[at]
        owner = np.repeat(np.arange(len(pdf)), words.sizes)
        shares = np.bincount(owner, rare, len(pdf))
        none = pdf["doc_id"].isna().to_numpy()
        doc_ids = pdf["doc_id"].astype("Int64").fillna(0).to_numpy("int64")
        out = []
        for k, lo in enumerate(range(0, len(pdf), DOCS)):
            hi = min(lo + DOCS, len(pdf))
            a, b = words.first[lo], words.first[hi - 1] + words.sizes[hi - 1]
            out.append((int(pdf["lane"].iloc[0]), k % rounds, doc_ids[lo:hi].tobytes(), none[lo:hi].tobytes(), words.sizes[lo:hi].astype("<i8").tobytes(), ids[a:b].tobytes(), shares[lo:hi].tobytes()))
        return pd.DataFrame(out, columns=empty.columns)

    back = counted.where("lane >= 0").select("part", "lane", "n").repartition(buckets, "lane")
    encoded = staged(table.groupBy("lane").cogroup(back.groupBy("lane")).applyInPandas(encode, "lane long, turn int, doc_ids binary, none binary, sizes binary, ids binary, rare binary"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(size, "int64")
        for batch in batches:
            for ids in batch["ids"]:
                held += np.bincount(np.frombuffer(ids, kind), minlength=size)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"id": at, "n": held[at]})

    seen = encoded.select("ids").mapInPandas(tally, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most `size` rows
    unigram = np.zeros(size)
    for r in seen:
        unigram[r["id"]] = r["n"]
    net = WindowNetwork(size, width, reach)
    net.start_from(unigram)

    def arrays(ids: bytes, sizes: bytes) -> list[np.ndarray]:
        ends = np.cumsum(np.frombuffer(sizes, "<i8"))
        return np.split(np.frombuffer(ids, kind).astype("int64"), ends[:-1])

    for turn in range(passes * rounds if unigram.sum() else 0):
        common = spark.sparkContext.broadcast(net.flat())

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            mine = WindowNetwork(size, width, reach)
            mine.load(common.value)
            n = train_on(mine, (arrays(i, s) for i, s in zip(pdf["ids"], pdf["sizes"])))
            moved = (mine.flat() - common.value) * n
            lane = int(pdf["lane"].iloc[0])
            return pd.DataFrame([(k, lane % 32, n, part.astype("float32").tobytes()) for k, part in enumerate(np.array_split(moved, parts_sum)) if n], columns=["part", "lane", "n", "moved"])

        def plus(pdf: pd.DataFrame) -> pd.DataFrame:
            sums = np.zeros(len(pdf["moved"].iloc[0]) // 4)
            for raw in pdf["moved"]:
                sums += np.frombuffer(raw, "float32")
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "lane": [0], "n": [int(pdf["n"].sum())], "moved": [sums.astype("float32").tobytes()]})

        shape = "part int, lane int, n long, moved binary"
        own_turn = encoded.where(F.col("turn") == turn % rounds).select("lane", "ids", "sizes")
        sums = own_turn.groupBy("lane").applyInPandas(fit, shape).groupBy("part", "lane").applyInPandas(plus, shape).groupBy("part").applyInPandas(plus, shape).collect()  # the network's size
        moves = {r["part"]: np.frombuffer(bytes(r["moved"]), "float32") / r["n"] for r in sums}
        if moves:
            net.load(common.value + np.concatenate([moves[k] for k in range(parts_sum)]))
        common.unpersist()
    final = spark.sparkContext.broadcast((net.flat(), np.log(np.maximum(unigram, 1))))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = WindowNetwork(size, width, reach)
        mine.load(final.value[0])
        base = np.where(np.arange(size) >= first_bucket, final.value[1], 0.0)  # of the buckets
        for batch in batches:
            for names, none, sizes, ids, rare in zip(batch["doc_ids"], batch["none"], batch["sizes"], batch["ids"], batch["rare"]):
                docs_ = arrays(ids, sizes)
                shares = np.frombuffer(rare, "<f8") - np.array([base[d].sum() for d in docs_])
                yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(np.frombuffer(names, "<i8").copy(), np.frombuffer(none, bool).copy()), "n_tokens": np.frombuffer(sizes, "<i8"), "log_prob": document_logs(mine, docs_) + shares})
        tidy()

    return kept(encoded.select("doc_ids", "none", "sizes", "ids", "rare").mapInPandas(judge, "doc_id long, n_tokens long, log_prob double"))
