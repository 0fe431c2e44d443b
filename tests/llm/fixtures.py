"""Small documents tables with every awkward case."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("d", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("shard", T.StringType()),
])


def prose(rng, n):
    vocabulary = ["the", "of", "and", "river", "stone", "walks", "under", "bright", "cloud", "seven", "horses", "quietly", "over", "grass", "mill", "turns", "again", "night", "paper", "candle"]
    return " ".join(rng.choice(vocabulary) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


def rows(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (5, 12, 13, 14, 40, 80, 120, 200, 400, 3000)]
    near = base[8].split()
    near[50] = "changed"
    far = base[8].split()
    for i in range(0, 400, 9):
        far[i] = f"other{i}"
    passage = " ".join(base[7].split()[20:90])
    texts = base + [base[4], base[4], base[6], " ".join(near), " ".join(far), passage, prose(rng, 30) + " " + passage + "\n" + prose(rng, 20), None, None, "", " \t\n ", "one", "Two\x0bWords", "ß É 日本 " * 20]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 2}", None if t is None else len(t), i, "x", None) for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, base[5], None, None, None, None, None, None), (None, base[9], "fr", None, None, None, None, None)]
    rng.shuffle(out)
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
