"""Operator 5: SimHash near-duplicates through vantage-point trees.

A fingerprint is the bitwise majority of a document's shingle hashes. Equal fingerprints collapse
first, so a group of exact copies is one node. A top tree of vantage points, built from a bounded
sample, cuts the Hamming space into shards: inside (distance to the vantage point at most mu) or
outside. Every fingerprint lives in one shard and also visits each later shard whose region its ball
of the given radius touches; the triangle inequality proves that no other shard can hold a
neighbour, so the links found are exact. Within a shard the same recursion goes on in memory, down
to blocks that are compared outright. A shard reports a spanning forest of its links, not all
pairs, which keeps groups of thousands of near copies linear; components are then found by a
distributed min-label iteration.

Cost: at radius r a random 64-bit fingerprint crosses a median boundary with probability about
0.35 (r = 2), so visits grow roughly as N^1.5 with a small constant: that is the price of exact
search with this structure, and the README gives figures.

Edge cases: null text has no words (fingerprint zero); documents with no id keep a null id and get
the smallest id of their component, null if nobody has one; repeated rows stay repeated; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kept, pieces, roots_of, scratch, small_batches, staged, tidy
from .words import Words, bit_majority, grams, mix

SEED = 42
#: Rows compared outright at the end of a branch, and queries compared at once.
BLOCK, AT_ONCE = 256, 4096


def words_of(text: str | None) -> list[bytes]:
    """A text's words, A-Z in lower case; bytes.lower() touches ASCII letters only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """k-word shingles, repeats included; the whole sequence if shorter."""
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k))))) if k > 1 else words


def majority(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64-bit hashes (n, lanes) to one fingerprint of lanes * 64 bits."""
    return np.concatenate([bit_majority(np.ascontiguousarray(lane), np.array([len(lane)])) for lane in hashes.astype("<u8").T])


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 hash bits from a hash; lane 0 is the hash itself."""
    return mix(h + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))) if lane else h


def fingerprint(text: str | None, k: int = 3, lanes: int = 1) -> np.ndarray:
    """Fingerprint of 64 bits a lane; no words: zero."""
    from xxhash import xxh64_intdigest

    parts = shingles(words_of(text), k)
    if not parts:
        return np.zeros(lanes, "<u8")
    h = np.array([xxh64_intdigest(p, SEED) for p in parts], "<u8")
    return majority(np.stack([mixed(h, i) for i in range(lanes)], 1))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


# ---------------------------------------------------------------- vantage points


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point, of a few tried, that spreads the points best, with its median distance."""
    some = points if len(points) <= 512 else points[rng.integers(0, len(points), 512)]
    best, spread = None, 0.0
    for vp in points[rng.integers(0, len(points), 5)]:
        d = hamming(some, vp)
        if (s := float(d.std())) > spread and int(np.median(d)) < int(d.max()):
            best, spread = (vp, int(np.median(d))), s
    return best


def top_tree(sample: np.ndarray, shards: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, mu, inside, outside); a child below zero is the leaf -child - 1.

    Leaves are numbered from the inside out, in the order of a depth-first walk.
    """
    rng = np.random.default_rng(seed)
    nodes: list = []
    leaves = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        cut_at = _vantage(points, rng) if want > 1 and len(points) > 8 else None
        if cut_at is None:
            leaves += 1
            return -leaves
        vp, mu = cut_at
        d = hamming(points, vp)
        inside = points[d <= mu]
        mine = len(nodes)
        nodes.append(None)
        share = min(want - 1, max(1, round(want * len(inside) / len(points))))
        left = grow(inside, share)
        right = grow(points[d > mu], want - share)
        nodes[mine] = (int(vp), mu, left, right)
        return mine

    grow(np.unique(sample), shards)
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, is home) of each point's own leaf and of every later leaf its ball touches."""
    rows, leaves, homes = [], [], []
    own = np.zeros(len(points), "int64")

    def walk(node: int, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node < 0:
            own[at[home]] = -node - 1
            rows.append(at)
            leaves.append(np.full(len(at), -node - 1))
            homes.append(home)
            return
        vp, mu, inside, outside = nodes[node]
        d = hamming(points[at], np.uint64(vp)).astype("int64")
        into, out = d - radius <= mu, d + radius > mu
        walk(inside, at[into], home[into] & (d[into] <= mu))
        walk(outside, at[out], home[out] & (d[out] > mu))

    walk(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool))
    if not rows:
        return own[:0], own[:0], np.zeros(0, bool)
    r, leaf, home = np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)
    stay = home | (leaf > own[r])
    return r[stay], leaf[stay], home[stay]


def near_pairs(items: np.ndarray, queries: np.ndarray, radius: int, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (item, query) index pairs within the radius, each pair once."""
    rng = np.random.default_rng(seed)

    def search(at: np.ndarray, ask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(at) or not len(ask):
            return
        cut_at = _vantage(items[at], rng) if len(at) > BLOCK else None
        if cut_at is None:
            for lo in range(0, len(at), BLOCK):
                block = items[at[lo : lo + BLOCK]]
                for k in range(0, len(ask), AT_ONCE):
                    i, q = np.nonzero(hamming(block[:, None], queries[ask[k : k + AT_ONCE]][None, :]) <= radius)
                    if len(i):
                        yield at[lo + i], ask[k + q]
            return
        vp, mu = cut_at
        d, dq = hamming(items[at], vp), hamming(queries[ask], vp).astype("int64")
        yield from search(at[d <= mu], ask[dq - radius <= mu])
        yield from search(at[d > mu], ask[dq + radius > mu])

    yield from search(np.arange(len(items)), np.arange(len(queries)))


def forest(n: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member of every element's component under the given links."""
    root = np.arange(n)
    for a, b in blocks:
        root = roots_of(n, root[a], root[b])[root]
    return root


def links(nodes: DataFrame, radius: int, shard_rows: int = 20_000, sample_rows: int = 65_536, views: tuple[str, ...] = ("fp",), check: str | None = None, within: int = 0) -> DataFrame:
    """Spanning links (src, dst) among nodes(node, views..., check) within the radius in any view.

    check, where given, is a wide fingerprint (binary) in which linked nodes must differ in at most
    `within` bits. The tree's sample is bounded by sample_rows; it only balances the shards.
    """
    spark = nodes.sparkSession
    shards = pieces(nodes.count(), shard_rows)
    carried = [check] if check else []
    kind = nodes.schema["node"].dataType.simpleString()
    shape = f"view int, shard long, home boolean, fp long, node {kind}" + "".join(f", {c} binary" for c in carried)
    trees = []
    for view in views:
        sample = [r[0] for r in nodes.select(view).orderBy(F.xxhash64(view)).limit(min(sample_rows, 64 * shards)).collect()]
        trees.append(top_tree(np.array(sample, "int64").view("uint64"), shards))
    known = spark.sparkContext.broadcast(trees)  # at most one entry for each shard

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for v, view in enumerate(views):
                row, leaf, home = route(batch[view].to_numpy("int64").view("uint64"), known.value[v], radius)
                out = {"view": np.full(len(row), v, "int32"), "shard": leaf, "home": home, "fp": batch[view].to_numpy("int64")[row], "node": batch["node"].to_numpy()[row]}
                yield pd.DataFrame(out | {c: batch[c].to_numpy()[row] for c in carried})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False, kind="stable", ignore_index=True)
        points = pdf["fp"].to_numpy("int64").view("uint64")
        items = points[: int(pdf["home"].sum())]

        def proven() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            wide = np.frombuffer(b"".join(pdf[check]), "<u8").reshape(len(pdf), -1) if check else None
            for a, b in near_pairs(items, points, radius):
                a, b = a[a != b], b[a != b]
                if wide is not None and len(a):
                    ok = np.concatenate([hamming(wide[a[k : k + 65_536]], wide[b[k : k + 65_536]]).sum(1, dtype="int64") <= within for k in range(0, len(a), 65_536)])
                    a, b = a[ok], b[ok]
                yield a, b

        root = forest(len(points), proven())
        tied = np.flatnonzero(root != np.arange(len(root)))
        names = pdf["node"].to_numpy()
        return pd.DataFrame({"src": names[root[tied]], "dst": names[tied]})

    dealt = nodes.select("node", *views, *carried).mapInPandas(deal, shape)
    return dealt.groupBy("view", "shard").applyInPandas(join, f"src {kind}, dst {kind}")


def named_groups(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) of the nodes(node, low, copies) that have copies or a component in roots: the smallest low there."""
    if roots.count() <= BROADCAST_NODES:
        roots = F.broadcast(roots)
    rooted = staged(nodes.select("node", "low", "copies").join(roots, "node", "left").where("component is not null or copies > 1").withColumn("root", F.coalesce("component", "node")))
    lows = rooted.where("component is not null").groupBy("root").agg(F.min("low").alias("least"))
    lows = staged(lows)
    if lows.count() <= BROADCAST_NODES:
        lows = F.broadcast(lows)
    return staged(rooted.join(lows, "root", "left").select("node", F.coalesce("least", "low").alias("component_id")))


def with_groups(prints: DataFrame, named: DataFrame) -> DataFrame:
    """prints(doc_id, node, ...) with component_id; a document alone in its node and component is its own."""
    if named.count() <= BROADCAST_NODES:
        named = F.broadcast(named)
    return prints.join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _printed(docs: DataFrame, shape: str, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = list(zip(*(make(t) for t in batch["text"]))) or None
            names = [p.split()[0] for p in shape.split(", ")][1:]
            out = {"doc_id": batch["doc_id"].astype("Int64")}
            yield pd.DataFrame(out | {n: list(c) for n, c in zip(names, columns or [[]] * len(names))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, shape)


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2, shard_rows: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id under links of at most radius differing bits."""
    prints = staged(_printed(docs, "doc_id long, node long", lambda t: (int(fingerprint(t, shingle_words).view("int64")[0]),)))
    nodes = staged(prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")))
    named = named_groups(nodes, components(links(nodes.withColumn("fp", F.col("node")), radius, shard_rows)))
    return with_groups(prints, named).select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


#: 64-bit lanes of the wide check fingerprint, and of the search views.
WIDE_LANES, VIEW_LANES = 4, 2
#: Shingles that sort last in prefixes: at most so many, of those found this often in one text of HOT_SHARE.
HOT_SHINGLES, HOT_LEAST, HOT_SHARE = 500_000, 3, 16
#: Texts handled at once, prefix shingles in a task, and pairs verified in one.
SLICE, PART_SHINGLES, PART_PAIRS = 256, 400_000, 2_000
#: Nodes that are broadcast at most; more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: A node in a run: its place in the node's prefix is p.
MEMBERS = np.dtype([("n", "<i4"), ("p", "<i4"), ("node", "<i8"), ("group", "<i8")])
#: Buckets of a set's parity sketch.
SKETCH_BITS = 1024
#: Partners of one node that are verified together.
CELL_PAIRS = 64


def shingle_sets(texts, k: int) -> tuple[list[np.ndarray], Words, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (of the whole text if shorter), its words and their hashes."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    whole = grams(hashes, k)
    sets = []
    for a, n in zip(words.first.tolist(), words.sizes.tolist()):
        own = whole[a : a + n - k + 1] if n >= k else grams(hashes[a : a + n], n) if n else hashes[:0]
        sets.append(np.unique(own.view("<i8")))
    return sets, words, hashes


def similar_sets(a: int, b: int, both: int, tenths: int = 8) -> bool:
    """Whether sets of a and b members that share `both` have a Jaccard similarity of tenths / 10 or more."""
    return (10 + tenths) * both >= tenths * (a + b)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 64-bit key of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle_words: int, tenths: int) -> DataFrame:
    """The rows of pairs(src, dst) whose whole shingle sets are similar; pairs must be stored.

    A pair is judged in a cell of its src, which holds the text of src and those of CELL_PAIRS partners
    or so; only the text of nodes(node, key, low) that are named in a pair moves.
    """
    parts = pieces(pairs.count(), PART_PAIRS)
    cells = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / CELL_PAIRS).cast("int").alias("cells"))
    placed = pairs.join(cells, "src").withColumn("cell", F.pmod(F.xxhash64("dst", F.lit("cell")), F.col("cells")))
    placed = staged(placed.withColumn("part", F.pmod(F.xxhash64("src", "cell"), F.lit(parts))).select("src", "dst", "part"))
    where = placed.select(F.col("src").alias("node"), "part").unionByName(placed.select(F.col("dst").alias("node"), "part")).distinct()
    where = staged(where.join(nodes.select("node", "key", "low"), "node"))
    once = F.broadcast(where) if where.count() <= BROADCAST_NODES else where
    named = keyed_texts(docs).alias("t").join(once.alias("w"), (F.col("t.key") == F.col("w.key")) & F.col("t.doc_id").eqNullSafe(F.col("w.low"))).select("part", "node", "text")

    def first_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set = set()  # rows that repeat an id and text
        for batch in batches:
            fresh = [k not in done and not done.add(k) for k in zip(batch["part"].tolist(), batch["node"].tolist())]
            yield batch[fresh]

    texts = named.mapInPandas(first_in_task, "part long, node long, text string").select("*", F.lit(0).cast("long").alias("other"), F.lit(False).alias("ask"))
    rows = texts.unionByName(placed.select("part", F.col("src").alias("node"), F.lit(None).cast("string").alias("text"), F.col("dst").alias("other"), F.lit(True).alias("ask")))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[~pdf["ask"]].drop_duplicates("node")
        sets: dict[int, np.ndarray] = {}
        for lo in range(0, len(own), SLICE):
            some = own.iloc[lo : lo + SLICE]
            sets.update(zip(some["node"].tolist(), shingle_sets(some["text"], shingle_words)[0]))
        asked = pdf[pdf["ask"]]
        out = [(a, b) for a, b in zip(asked["node"].tolist(), asked["other"].tolist()) if similar_sets(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b], assume_unique=True)), tenths)]
        tidy()
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return staged(rows.groupBy("part").applyInPandas(judge, "src long, dst long"))


def met(n):
    """Members that the prefixes of similar sets share, the smaller of which has n."""
    return 1 + n // 20


def prefix(members: np.ndarray, hot: np.ndarray, rank: np.ndarray, tenths: int) -> np.ndarray:
    """The first members of a set in the common order: rare ones by hash, then hot ones by rank.

    The k-th common member of two sets that share `both` is at most at place n - both + k of a set of
    n, and similar ones share both >= ceil(n tenths / 10); so their prefixes share met(n) members, n the
    smaller size.
    """
    keep = len(members) - -(-tenths * len(members) // 10) + met(len(members))
    if not len(hot) or not len(members):
        return members[:keep]
    at = np.minimum(np.searchsorted(hot, members), len(hot) - 1)
    order = np.where(hot[at] == members, rank[at] + 1, 0)
    return members[np.argsort(order, kind="stable")[:keep]]


def prefix_runs(docs: DataFrame, groups: DataFrame, total: int, shingle_words: int, tenths: int) -> DataFrame:
    """Runs (least, members, times): nodes whose prefixes share a shingle, the smallest node, and for how many shingles.

    Runs inside one group of groups(node, component) are left out. total is the number of shingles,
    about.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs).select("text", "key")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                yield pd.DataFrame({"s": np.concatenate(shingle_sets(batch["text"].iloc[lo : lo + SLICE], shingle_words)[0])})

    some = texts.where(F.pmod("key", F.lit(HOT_SHARE)) == 0).dropDuplicates(["key"]).select("text")
    counted = some.mapInPandas(spread, "s long").groupBy("s").count().where(F.col("count") >= HOT_LEAST)
    with small_batches(spark):
        top = counted.orderBy(F.desc("count"), "s").limit(HOT_SHINGLES).toPandas()  # bounded; it only orders the prefixes
    top = top.sort_values("s", ignore_index=True)
    rank = np.empty(len(top), "int64")
    rank[np.lexsort((top["s"], top["count"]))] = np.arange(len(top))
    shipped = spark.sparkContext.broadcast((top["s"].to_numpy("int64"), rank))
    parts = pieces(total * (10 - tenths) // 10, PART_SHINGLES)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, ranks = shipped.value
        done: set = set()  # a task's texts
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                own = batch.iloc[lo : lo + SLICE]
                own = own[[k not in done and not done.add(k) for k in own["key"].tolist()]]
                sets = [s for s in shingle_sets(own["text"], shingle_words)[0] if len(s)]
                if sets:
                    first = [prefix(s, hot, ranks, tenths) for s in sets]
                    sizes = [len(f) for f in first]
                    yield pd.DataFrame({"s": np.concatenate(first), "node": np.repeat(node_names(sets), sizes), "n": np.repeat([len(s) for s in sets], sizes).astype("int32"), "p": np.concatenate([np.arange(k) for k in sizes]).astype("int32")})
        tidy()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """The nodes of each shingle that more than one group has, under the smallest node; how often the same nodes meet."""
        pdf = pdf.drop_duplicates(["s", "node"]).sort_values(["s", "n", "node"], ignore_index=True)
        s, group = pdf["s"].to_numpy("int64"), pdf["group"].to_numpy("int64")
        held = np.zeros(len(pdf), MEMBERS)
        for name in MEMBERS.names:
            held[name] = pdf[name].to_numpy("int64")
        ends = np.append(np.flatnonzero(np.diff(s)) + 1, len(s))
        starts = np.append(0, ends[:-1])
        runs: dict[bytes, int] = {}
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            if hi - lo > 1 and not (group[lo:hi] == group[lo]).all():
                runs[raw] = runs.get(raw := held[lo:hi].tobytes(), 0) + 1
        out = pd.DataFrame({"least": [int(np.frombuffer(r, MEMBERS)["node"].min()) for r in runs], "members": list(runs), "times": list(runs.values())})
        tidy()
        return out.astype({"least": "int64", "times": "int64"})

    dealt = texts.mapInPandas(emit, "s long, node long, n int, p int")
    if groups.count() <= BROADCAST_NODES:
        groups = F.broadcast(groups)
    dealt = dealt.join(groups, "node", "left").select("s", "node", "n", "p", F.coalesce("component", "node").alias("group"))
    return staged(dealt.groupBy(F.pmod(F.xxhash64("s"), F.lit(parts)).alias("part")).applyInPandas(meet, "least long, members binary, times long"))


#: Nodes that are tried first as partners of all others they meet, and how often with new groups.
PIVOTS, STAR_ROUNDS = 4, 1
_COUNTED = "src long, dst long, need long, k long"


def _relabelled(groups: DataFrame):
    """A function that sets the group of runs' members from groups(node, component), while that is small enough to be broadcast."""
    if groups.count() > BROADCAST_NODES:
        return lambda members: members  # with older labels more pairs are looked at, no fewer
    found = groups.orderBy("node").toPandas()  # at most BROADCAST_NODES rows
    shipped = groups.sparkSession.sparkContext.broadcast((found["node"].to_numpy("int64"), found["component"].to_numpy("int64")))

    def label(members: np.ndarray) -> np.ndarray:
        names, roots = shipped.value
        if not len(names):
            return members
        members = members.copy()
        at = np.minimum(np.searchsorted(names, members["node"]), len(names) - 1)
        members["group"] = np.where(names[at] == members["node"], roots[at], members["group"])
        return members

    return label


def _counted(rows: list[np.ndarray]) -> pd.DataFrame:
    """Sums of k by pair of rows (src, dst, need, k)."""
    whole = np.concatenate([np.zeros((0, 4), "int64"), *rows])
    names, back = np.unique(whole[:, :3], axis=0, return_inverse=True)
    return pd.DataFrame({"src": names[:, 0], "dst": names[:, 1], "need": names[:, 2], "k": np.bincount(back.ravel(), whole[:, 3], len(names)).astype("int64")})


def _ordered(a: np.ndarray, b: np.ndarray, need: np.ndarray, k: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(a, b), np.maximum(a, b), need, k], 1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the parities of its members in SKETCH_BITS buckets, as (len(sets), SKETCH_BITS / 64) words.

    Two sets differ in at least as many members as their sketches in bits, whatever the sets.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = np.concatenate(sets).view("<u8") % np.uint64(SKETCH_BITS) if sets else np.zeros(0, "uint64")
    odd = np.bincount(owner * SKETCH_BITS + bucket.astype("int64"), minlength=len(sets) * SKETCH_BITS) & 1
    return np.packbits(odd.astype("uint8"), bitorder="little").view("<u8").reshape(len(sets), -1)


def candidates(runs: DataFrame, nodes: DataFrame, groups: DataFrame, tenths: int, stars: bool) -> DataFrame:
    """Distinct pairs (src, dst) of nodes(node, sketch) of different groups that meet in runs often enough and whose sizes and sketches allow the similarity.

    With stars only pairs of a run's most frequent nodes with its others, so at most PIVOTS for each
    member; without, all of them. Most of a pair's runs have one least node, so they are summed where
    they meet.
    """
    label = _relabelled(groups)
    held = runs.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    parts = pieces(held // MEMBERS.itemsize, PART_SHINGLES // 4)
    placed = runs.withColumn("part", F.pmod(F.xxhash64("least"), F.lit(parts)))

    def members_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            per = batch["members"].str.len().to_numpy("int64") // MEMBERS.itemsize
            yield pd.DataFrame({"part": np.repeat(batch["part"].to_numpy(), per), "node": np.frombuffer(b"".join(batch["members"]), MEMBERS)["node"]}).drop_duplicates()

    who = placed.select("part", "members").mapInPandas(members_of, "part long, node long").distinct().join(nodes.select("node", "sketch"), "node")
    zero = F.lit(0).cast("long")
    rows = placed.select("part", "least", "members", "times", zero.alias("node"), F.lit(None).cast("binary").alias("sketch")).unionByName(
        who.select("part", zero.alias("least"), F.lit(None).cast("binary").alias("members"), zero.alias("times"), "node", "sketch")
    )

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["sketch"].notna()].sort_values("node")
        names_of, bits = known["node"].to_numpy("int64"), np.frombuffer(b"".join(known["sketch"]), "<u8").reshape(len(known), -1)

        def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
            """Whether the sketches of nodes a and b of na and nb members allow the similarity."""
            apart = np.bitwise_count(bits[np.searchsorted(names_of, a)] ^ bits[np.searchsorted(names_of, b)]).sum(1, dtype="int64")
            return (10 + tenths) * ((na + nb - apart) // 2) >= tenths * (na + nb)

        def star(own: pd.DataFrame) -> list[np.ndarray]:
            per = own["members"].str.len().to_numpy("int64") // MEMBERS.itemsize
            m = label(np.frombuffer(b"".join(own["members"]), MEMBERS))
            run, times = np.repeat(np.arange(len(own)), per), np.repeat(own["times"].to_numpy("int64"), per)
            names, first, at = np.unique(m["node"], return_index=True, return_inverse=True)
            n, group = m["n"][first].astype("int64"), m["group"][first]
            found, order = [], np.argsort(-np.bincount(at, times), kind="stable")
            chosen = order[np.sort(np.unique(group[order], return_index=True)[1])[:PIVOTS]]  # of different groups
            for pivot in chosen:
                k = np.bincount(at, times * np.isin(run, run[at == pivot])).astype("int64")
                low, high = np.minimum(n, n[pivot]), np.maximum(n, n[pivot])
                far = np.flatnonzero((group != group[pivot]) & (k > 0) & (high * tenths <= low * 10))
                far = far[possible(np.full(len(far), names[pivot]), names[far], n[pivot], n[far])]
                found.append(_ordered(np.full(len(far), names[pivot]), names[far], met(low[far]), k[far]))
            whole = np.concatenate(found)
            return [whole[np.unique(whole[:, :2], axis=0, return_index=True)[1]]]  # two pivots are one pair

        def every(own: pd.DataFrame) -> list[np.ndarray]:
            found = []
            for raw, times in zip(own["members"], own["times"]):
                m = label(np.frombuffer(raw, MEMBERS))
                n, node, group, p = (m[c].astype("int64") for c in ("n", "node", "group", "p"))
                if (group == group[0]).all():
                    continue
                for i in range(len(m) - 1):
                    to = i + 1 + int(np.searchsorted(n[i + 1 :], n[i] * 10 // tenths, "right"))
                    far = np.arange(i + 1, to)
                    both = -(-tenths * (n[i] + n[far]) // (10 + tenths))  # members that similar sets share
                    far = far[(group[far] != group[i]) & (p[i] < n[i] - both + met(n[i])) & (p[far] < n[far] - both + met(n[i]))]
                    if len(far):
                        far = far[possible(np.full(len(far), node[i]), node[far], n[i], n[far])]
                        found.append(_ordered(np.full(len(far), node[i]), node[far], np.full(len(far), met(n[i])), np.full(len(far), times)))
            return found

        out = [_counted((star if stars else every)(own)) for _, own in pdf[pdf["members"].notna()].groupby("least", sort=False)]
        tidy()
        return pd.concat(out) if out else _counted([])

    pairs = rows.groupBy("part").applyInPandas(pair, _COUNTED)
    return pairs.groupBy("src", "dst", "need").agg(F.sum("k").alias("k")).where("k >= need").select("src", "dst")


def node_names(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set."""
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], "uint64").view("int64")


def similar_documents(docs: DataFrame, shingle_words: int = 5, tenths: int = 8, differing: int = 42, radius: int = 3, shard_rows: int = 20_000) -> DataFrame:
    """doc_id and component_id under links of documents whose shingle sets have a similarity of tenths / 10 or more.

    Every link is proven on whole shingle sets (of 64-bit hashes), and no similar pair is lost. Two
    exact vantage-point searches of small radius over fingerprints of single words, which a few
    edits hardly move, give the first links: a spanning forest of what also agrees in a 256-bit
    fingerprint of shingles, each link then verified. That joins most of every large group; the
    pairs of different groups that are left come from a prefix-filter join, which is lossless, and
    are verified as well, first those with the members that meet most others. Equal sets are one node; texts without words are one node too. Sets are
    made anew from the texts wherever they are needed, which costs less than keeping them.
    """
    with scratch():
        return _similar(docs, shingle_words, tenths, differing, radius, shard_rows)


def _similar(docs: DataFrame, shingle_words: int, tenths: int, differing: int, radius: int, shard_rows: int) -> DataFrame:
    shape = "doc_id long, key long, node long, n long, v0 long, v1 long, wide binary, sketch binary"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                own = batch.iloc[lo : lo + SLICE]
                sets, words, hashes = shingle_sets(own["text"], shingle_words)
                sizes = np.array([len(s) for s in sets], "int64")
                views = [bit_majority(mixed(hashes, i), words.sizes).view("<i8") for i in range(VIEW_LANES)]
                members = np.concatenate(sets).view("<u8") if sets else hashes
                wide = np.stack([bit_majority(mixed(members, i), sizes) for i in range(WIDE_LANES)], 1)
                yield pd.DataFrame({"doc_id": own["doc_id"].astype("Int64").to_numpy(), "key": own["key"].to_numpy(), "node": node_names(sets), "n": sizes, "v0": views[0], "v1": views[1], "wide": [w.tobytes() for w in wide], "sketch": [k.tobytes() for k in sketches(sets)]})
        tidy()

    prints = staged(keyed_texts(docs).mapInPandas(make, shape))
    # the text that stands for a node is that of the smallest (doc_id, key) with it
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("_least")
    nodes = prints.groupBy("node").agg(least, F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("v0").alias("v0"), F.min("v1").alias("v1"), F.min("wide").alias("wide"), F.min("sketch").alias("sketch"))
    nodes = staged(nodes.select("node", F.col("_least.doc_id").alias("low"), F.col("_least.key").alias("key"), "copies", "n", "v0", "v1", "wide", "sketch"))
    forest_links = staged(links(nodes, radius, shard_rows, views=("v0", "v1"), check="wide", within=differing).where("src <> dst").distinct())
    first = verified(forest_links, nodes, docs, shingle_words, tenths)
    groups = components(first)
    total = prints.agg(F.sum("n")).first()[0] or 0
    runs = prefix_runs(docs, groups, total, shingle_words, tenths)
    # the middle of a group first: what that joins needs no looking at pair by pair
    found, judged = first, forest_links
    for stars in [True] * STAR_ROUNDS + [False]:
        asked = candidates(runs, nodes, groups, tenths, stars)
        asked = staged(asked.join(F.broadcast(judged) if judged.count() <= BROADCAST_NODES else judged, ["src", "dst"], "left_anti"))
        fresh = verified(asked, nodes, docs, shingle_words, tenths)
        if stars and not fresh.take(1):
            continue
        found, judged = found.unionByName(fresh), judged.unionByName(asked)
        groups = components(found)
    named = named_groups(nodes, groups)
    return kept(with_groups(prints.select("doc_id", "node"), named).select("doc_id", "component_id"))
