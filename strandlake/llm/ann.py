"""Operator 9: approximate nearest neighbours by multiprobe p-stable hashing.

Each of `tables` hash tables concatenates m projections floor((a.u + b) / width) of the unit vector
u, a Gaussian. A query visits its own bucket and the perturbed ones in order of estimated success:
the distances of its projections to their slot borders are sorted, and the sets of perturbations
are taken in the order of their expected score for such sorted distances. Candidates of all tables
are merged and reranked by their exact cosine.

Equal vectors are one entry that carries its k + 1 smallest ids, more than which no result can need.
Buckets are joined in cells: a bucket with more rows than `cell_rows` on either side is split on
both sides by salts from counts of every bucket, so that each (query, entry) pair of the bucket
meets in exactly one cell and no task holds a hot bucket. No candidate is dropped.

m grows with the logarithm of the number of distinct vectors as far as the recall allows: the exact
neighbours of `SAMPLE` queries among all vectors are found outright, and the largest m, with the
fewest probes, whose buckets hold at least `TARGET` of them is taken. Every row is indexed.

Edge cases: vectors that are null, zero, or hold null or non-finite components, vectors of another
length than the commonest (of two, the shorter), and rows without an id take no part; a row repeated
with its id and vector counts once, and a query id with several vectors is a query for each; equal
scores go by vec_id; fewer candidates give fewer rows; empty tables give none; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, staged


#: Queries whose exact neighbours set m and the probes, and the share of these that must be found.
SAMPLE, TARGET = 128, 0.95


def probe_sets(m: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of positions among 2m sorted border distances, by expected score, the empty one first."""
    score = []
    for j in range(1, 2 * m + 1):
        if j <= m:
            score.append(j * (j + 1) / (4 * (m + 1) * (m + 2)))
        else:
            k = 2 * m + 1 - j
            score.append(1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(score[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - j not in chosen for j in chosen):  # not both borders of one slot
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*chosen, last + 1)))
    return out


class StableHash:
    """The projections of all tables for vectors of one dimension."""

    def __init__(self, dim: int, tables: int, m: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim, m))
        self.b = rng.uniform(0, width, (tables, m))
        self.mix = rng.integers(1 << 20, 1 << 62, (tables, m)) | 1
        self.tables, self.m, self.width = tables, m, width

    def _slots(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = (unit @ self.a[t] + self.b[t]) / self.width
        low = np.floor(at)
        return low.astype("int64"), at - low

    def buckets(self, unit: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._slots(unit, t)[0] * self.mix[t]).sum(1)

    def probes(self, unit: np.ndarray, t: int, sets: list[tuple[int, ...]]) -> np.ndarray:
        """(vectors, len(sets)) buckets in the order of their estimated success."""
        low, within = self._slots(unit, t)
        order = np.argsort(np.concatenate([within, 1 - within], 1), 1)
        with np.errstate(over="ignore"):
            own = (low * self.mix[t]).sum(1)
            step = np.where(order < self.m, -1, 1) * self.mix[t][order % self.m]
            return np.stack([own + step[:, list(s)].sum(1) for s in sets], 1)


def _arrays(values: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that hold a usable vector, their vectors in double precision); very large and very small ones are scaled."""
    rows, vectors = [], []
    for i, v in enumerate(values):
        if v is None:
            continue
        x = np.array([np.nan if c is None else c for c in v], "float64") if getattr(v, "dtype", None) == object or not isinstance(v, np.ndarray) else v.astype("float64")
        if len(x) and np.isfinite(x).all() and (most := float(np.abs(x).max())) > 0:
            power = math.frexp(most)[1]
            rows.append(i)
            vectors.append(x if abs(power) < 200 else np.ldexp(x, -power))  # a power of two leaves the cosine as it is
    return np.array(rows, "int64"), vectors


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vec): vec the doubles as bytes, key their 128-bit digest; unusable rows go."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows, x = _arrays(batch["embedding"])
            raw = [(v + 0.0).tobytes() for v in x]
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy()[rows].astype("int64"), "key": [xxh3_128_digest(r) for r in raw], "vec": raw})

    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(read, "vec_id long, key binary, vec binary")


def success(hasher: StableHash, asked: np.ndarray, near: np.ndarray, sets: list[tuple[int, ...]]) -> float:
    """Share of the pairs (asked[i], near[i]) of unit vectors that meet in some table."""
    hit = np.zeros(len(asked), bool)
    for t in range(hasher.tables):
        hit |= (hasher.probes(asked, t, sets) == hasher.buckets(near, t)[:, None]).any(1)
    return float(hit.mean())


def tuned(asked: np.ndarray, near: np.ndarray, dim: int, tables: int, width: float, most: int, probes: int | None) -> tuple[int, int]:
    """(m, probes) of the finest buckets in which TARGET of the neighbours are found."""
    for m in range(most, 1, -1):
        base = probes or 4 * max(m - 1, 4)
        for n in [base] if probes else [base, 2 * base, 4 * base]:
            if not len(asked) or success(StableHash(dim, tables, m, width), asked, near, probe_sets(m, n)) >= TARGET:
                return m, n
    return 2, probes or 64  # more than there are sets for m = 2


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, tables: int = 4, width: float = 3.0, probes: int | None = None, m: int | None = None, cell_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query (ids divisible by every)."""
    rows = usable(vectors).dropDuplicates(["key", "vec_id"])
    rows = staged(rows)
    first = rows.select(F.octet_length("vec").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = first["n"] // 8 if first else 1
    rows = rows.where(F.octet_length("vec") == 8 * dim)
    of_key = Window.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(of_key)).where(F.col("_n") <= k + 1)
    entries = staged(few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec").alias("vec")))
    asked = rows.where(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("query_id"))
    count = entries.count()

    def unit(batch: pd.DataFrame) -> np.ndarray:
        x = np.frombuffer(b"".join(batch["vec"]), "float64").reshape(-1, dim)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    wanted = entries.join(asked.select("key").distinct(), "key", "left_semi")
    if m is None:
        some = wanted.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()  # bounded
        mine = unit(some) if len(some) else np.zeros((0, dim))
        names = some["key"].tolist()

        def outright(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(mine):
                    near = mine @ unit(batch).T
                    near[batch["key"].to_numpy()[None, :] == np.array(names, object)[:, None]] = -2
                    keep = min(k, near.shape[1])
                    at = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                    q = np.repeat(np.arange(len(mine)), keep)
                    yield pd.DataFrame({"q": q, "score": near[q, at.ravel()], "key": batch["key"].to_numpy()[at.ravel()], "vec": batch["vec"].to_numpy()[at.ravel()]})

        first_k = Window.partitionBy("q").orderBy(F.desc("score"), "key")
        pairs = entries.select("key", "vec").mapInPandas(outright, "q int, score double, key binary, vec binary").where("score > -2")
        pairs = pairs.withColumn("_n", F.row_number().over(first_k)).where(F.col("_n") <= k).select("q", "vec").toPandas()  # at most k for each query
        m, probes = tuned(mine[pairs["q"].to_numpy("int64")], unit(pairs) if len(pairs) else mine[:0], dim, tables, width, min(24, max(2, round(math.log2(max(count, 2))) - 7)), probes)
    sets = probe_sets(m, probes or 4 * max(m - 1, 4))
    hasher = StableHash(dim, tables, m, width)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                u = unit(batch)
                for t in range(tables):
                    yield pd.DataFrame({"tab": t, "bucket": hasher.buckets(u, t), "ask": False, "key": batch["key"], "ids": batch["ids"], "vec": batch["vec"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                u = unit(batch)
                for t in range(tables):
                    for column in hasher.probes(u, t, sets).T:
                        yield pd.DataFrame({"tab": t, "bucket": column, "ask": True, "key": batch["key"], "ids": None, "vec": batch["vec"]})

    shape = "tab int, bucket long, ask boolean, key binary, ids array<long>, vec binary"
    items = entries.mapInPandas(index, shape)
    questions = wanted.mapInPandas(ask, shape)
    both = items.unionByName(questions)
    sizes = cut(
        both.groupBy("tab", "bucket").agg(F.count_if(~F.col("ask")).alias("n"), F.count_if(F.col("ask")).alias("q")).where("n > 0 and q > 0")
    )
    split = lambda c: F.ceil(F.col(c) / cell_rows).cast("int")
    placed = both.join(sizes.select("tab", "bucket", split("n").alias("ns"), split("q").alias("qs")), ["tab", "bucket"])
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = placed.withColumn("ci", F.explode(F.when(F.col("ask"), all_("ns")).otherwise(F.array(own("ns")))))
    placed = placed.withColumn("cq", F.explode(F.when(F.col("ask"), F.array(own("qs"))).otherwise(all_("qs"))))
    parts = pieces(count * tables, cell_rows) * 4
    placed = placed.select(F.pmod(F.xxhash64("tab", "bucket", "ci", "cq"), F.lit(parts)).alias("part"), "tab", "bucket", "ci", "cq", "ask", "key", "ids", "vec")

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"key": [], "vec_id": [], "score": []}
        for _, cell in pdf.groupby(["tab", "bucket", "ci", "cq"], sort=False):
            q, x = cell[cell["ask"]], cell[~cell["ask"]]
            if not len(q) or not len(x):
                continue
            raw = lambda c: np.frombuffer(b"".join(c["vec"]), "float64").reshape(-1, dim)
            xs, ids, keys = raw(x), x["ids"].to_numpy(), q["key"].to_numpy()
            lowest = np.array([i[0] for i in ids])
            xn = np.sqrt((xs * xs).sum(1))
            for lo in range(0, len(q), 512):
                qs = raw(q.iloc[lo : lo + 512])
                near = (qs @ xs.T) / xn[None, :]
                keep = min(k + 1, near.shape[1])
                edge = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
                for i in range(len(qs)):
                    qn = math.sqrt(float((qs[i] * qs[i]).sum()))
                    some = np.flatnonzero(near[i] >= edge[i] - 1e-9 * max(1.0, qn))
                    exact = (xs[some] * qs[i]).sum(1) / (xn[some] * qn)  # one order of summation everywhere
                    for j in np.lexsort((lowest[some], -exact))[: k + 1]:
                        for ident in ids[some[j]]:
                            out["key"].append(keys[lo + i])
                            out["vec_id"].append(ident)
                            out["score"].append(exact[j])
        found = pd.DataFrame(out).astype({"vec_id": "int64", "score": "float64"})
        # a query's best of all cells here; no others can be among its best of all
        found["q"] = pd.factorize(found["key"])[0]
        found = found.drop_duplicates(["q", "vec_id"]).sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
        return found[found.groupby("q").cumcount() <= k][["key", "vec_id", "score"]]

    found = placed.groupBy("part").applyInPandas(rank, "key binary, vec_id long, score double").groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    mine = asked.join(cut(best), "key").where("query_id <> vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
