"""Helpers shared by the corpus operators: staging, word views and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these bytes only; bytes.split() without arguments uses exactly this set.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a single machine where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            named = tempfile.mkdtemp(prefix="strandlake-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


#: Records of an Arrow batch sent to Python: texts of some KB each make a few MB.
BATCH = 1_000


@contextmanager
def small_batches(spark: SparkSession, records: int = BATCH) -> Iterator[None]:
    """Python workers get at most so many records at once in what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, records)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def staged(df: DataFrame, records: int = BATCH) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there; Python gets at most `records` rows at once.

    Lost executors cost a reread, not a recomputation, and row numbering over the table is stable.
    scratch() deletes the tables that are staged inside it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    with small_batches(spark, records):
        df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append((spark, path, None))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like staged(), dealt into buckets by key: groupings and joins on key don't shuffle the table again."""
    spark = df.sparkSession
    name = f"strandlake_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    if _open:
        _open[-1].append((spark, path, name))
    return spark.table(name)


#: Tables staged by each scratch() that is open.
_open: list[list[tuple[SparkSession, str, str | None]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes on leaving all tables staged inside; nothing read from them may be used afterwards."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path, name in _open.pop():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """staged(), but not deleted by the scratch() around it: the result that a scratch leaves behind."""
    held, _open[:] = _open[:], []
    try:
        return staged(df)
    finally:
        _open[:] = held


#: What operators keep in a Python worker from task to task, by operator.
CACHES: dict[str, dict] = {}


def tidy(keep: str = "") -> None:
    """Drop what other operators keep in this Python worker, and give free memory back to the system; the worker lives on for other stages."""
    import ctypes
    import gc

    for name, held in CACHES.items():
        if name != keep:
            held.clear()
    gc.collect()
    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc or allocator: nothing to do
        pass


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small intermediate relations of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def pieces(n: int, size: int) -> int:
    """How many parts of about size rows n rows make; one at least."""
    return max(1, -(-int(n) // int(size)))


#: Links of components that one task settles; more take distributed rounds.
LOCAL_LINKS = 1_000_000


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n elements' components under links a, b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def components(edges: DataFrame, rounds: int = 40, local_links: int = LOCAL_LINKS) -> DataFrame:
    """Connected components of edges(src, dst): rows (node, component), component the smallest node.

    A counted list of at most local_links is settled in one task. Beyond, alternating hooking and
    pointer jumping: every round is joins and min-aggregations (partial sums before the shuffle, so a
    node with very many links costs no task more), and ends in a checkpoint. Rounds grow with the
    logarithm of the longest chain.
    """
    edges = staged(edges.select("src", "dst").where("src <> dst"))
    if edges.count() <= local_links:

        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [b for b in batches]
            if held:
                whole = pd.concat(held)
                names, at = np.unique(whole[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
                root = roots_of(len(names), at.ravel()[0::2], at.ravel()[1::2])
                yield pd.DataFrame({"node": names, "component": names[root]})

        kind = edges.schema["src"].dataType.simpleString()
        return staged(edges.coalesce(1).mapInPandas(settle, f"node {kind}, component {kind}"))
    both = cut(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))
    labels = cut(labels)
    for _ in range(rounds):
        # the smallest label among a node's neighbours, offered to the node and to its present root
        seen = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("seen"))
        near = labels.join(seen, "node", "left").select(
            "node", F.col("component").alias("root"), F.least("component", F.coalesce("seen", "component")).alias("component")
        )
        offers = near.groupBy(F.col("root").alias("node")).agg(F.min("component").alias("offer"))
        hooked = near.join(offers, "node", "left").select("node", F.least("component", F.coalesce("offer", "component")).alias("component"))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = hooked.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
        before, labels = labels, cut(jumped)
        moved = labels.join(before.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


__all__ = ["CACHES", "WORD_BREAK", "bucketed", "components", "cut", "kept", "pieces", "roots_of", "scratch", "shared_dir", "small_batches", "staged", "tidy"]
