"""Soft masks: runs of lower-case letters inside a text column."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_LOWER = re.compile("[a-z]+")


@F.arrow_udf(RUNS)
def _runs(texts: pa.Array) -> pa.Array:
    # flat numbers: a batch of texts has millions of runs, too many for objects
    start, end, offsets = array("q"), array("q"), array("i", [0])
    for t in texts:
        for m in _LOWER.finditer(t.as_py() or ""):
            start.append(m.start())
            end.append(m.end())
        offsets.append(len(start))
    spans = pa.StructArray.from_arrays([pa.array(np.frombuffer(x, "int64")) for x in (start, end)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, "int32")), spans, mask=pa.array(texts.is_null().to_numpy(zero_copy_only=False)))


def lower_runs(text: Column) -> Column:
    """Half-open runs of a-z, one array a text; in Arrow batches, because an array that grows in a fold is copied at every step."""
    return _runs(text.cast("string"))


@F.pandas_udf(T.StringType())
def _lowered(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, begin, end in zip(texts, starts, ends):
        if text is None or begin is None:
            out.append(text)
            continue
        parts, at = [], 0
        for a, b in zip(begin.tolist(), end.tolist()):
            parts += [text[at:a], text[a:b].lower()]
            at = b
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def restore(text: Column, runs: Column) -> Column:
    """text with its runs in lower case; in Arrow batches, because substring() walks its text from the start for every run."""
    return _lowered(text, F.transform(runs, lambda r: r["start"]), F.transform(runs, lambda r: r["end"]))


def mirrored(runs: Column, length: Column) -> Column:
    """Runs of the reverse strand of a text of that length."""
    turned = F.transform(runs, lambda r: F.struct((length - r["end"]).cast("long").alias("start"), (length - r["start"]).cast("long").alias("end")))
    return F.reverse(turned)


def _like(texts: pa.Array, masked: pa.Array, turned: bool) -> pa.Array:
    out = []
    for t, m in zip(texts, masked):
        text, like = t.as_py(), m.as_py()
        if text is None or like is None:
            out.append(None)
            continue
        spans = (x.span() for x in _LOWER.finditer(like))
        if turned:
            spans = [(len(like) - b, len(like) - a) for a, b in spans][::-1]
        parts, at = [], 0
        for a, b in spans:
            parts += [text[at:a], text[a:b].lower()]
            at = b
        out.append("".join([*parts, text[at:]]))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _lowered_like(texts: pa.Array, masked: pa.Array) -> pa.Array:
    return _like(texts, masked, False)


@F.arrow_udf(T.StringType())
def _lowered_back(texts: pa.Array, masked: pa.Array) -> pa.Array:
    return _like(texts, masked, True)


def lowered_like(text: Column, masked: Column, turned: bool = False) -> Column:
    """text in lower case where masked is, or where masked read from its end is: runs are found and used text by text, none travels."""
    return (_lowered_back if turned else _lowered_like)(text, masked)


@F.arrow_udf(T.StructType().add("runs", "long").add("bases", "long").add("longest", "long").add("first", "long"))
def _summary(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        spans = [m.span() for m in _LOWER.finditer(t.as_py() or "")]
        sizes = [b - a for a, b in spans]
        out.append((len(spans), sum(sizes), max(sizes), spans[0][0]) if spans else (0, None, None, None))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["runs", "bases", "longest", "first"])


def run_summary(text: Column) -> Column:
    """How many lower-case runs a text has, their bases, the longest and where the first starts."""
    return _summary(text.cast("string"))
