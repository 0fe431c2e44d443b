"""CIGAR algebra on array columns of struct<op:string,len:bigint>."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = "array<struct<op:string,len:bigint>>"
_UNITS = T.ArrayType(T.StructType().add("op", "string").add("len", "long"))
#: Op codes of the packed form, and the ops that consume each axis.
CODES = "MIDNSHP=X"
ON_REFERENCE, ON_QUERY, ALIGNED = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X"), ("M", "=", "X")


def parse(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(pieces, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, r"\d+", 0).cast("long").alias("len")))


def render_text(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: F.concat(u["len"].cast("string"), u["op"])), "")


def coalesce_units(units: Column) -> Column:
    """Neighbouring equal ops become one; empty ones go."""
    def step(acc: Column, u: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(u["op"].alias("op"), (last["len"] + u["len"]).alias("len"))))
        return F.when(u["len"] == 0, acc).when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == u["op"]), grown).otherwise(F.concat(acc, F.array(F.struct(u["op"].alias("op"), u["len"].alias("len")))))

    return F.aggregate(units, F.array().cast(UNITS), step)


def total(units: Column, ops: tuple[str, ...] | None = None) -> Column:
    kept = units if ops is None else F.filter(units, lambda u: u["op"].isin(*ops))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, u: acc + u["len"])


def reference_length(units: Column) -> Column:
    return total(units, ON_REFERENCE)


def query_length(units: Column) -> Column:
    return total(units, ON_QUERY)


def packed(units: Column) -> Column:
    """len << 4 | op code."""
    return F.transform(units, lambda u: u["len"] * 16 + _code(u["op"]))


def _code(op: Column) -> Column:
    out = F.lit(None).cast("long")
    for i, c in enumerate(CODES):
        out = F.when(op == c, F.lit(i).cast("long")).otherwise(out)
    return out


def unpacked(codes: Column) -> Column:
    return F.transform(codes, lambda c: F.struct(F.substring(F.lit(CODES), (c % 16 + 1).cast("int"), F.lit(1)).alias("op"), F.floor(c / 16).alias("len")))


def split_at(units: Column, at: Column, ops: tuple[str, ...] = ON_REFERENCE) -> tuple[Column, Column]:
    """(before, after) a length on the axis of ops; an op across the cut is divided.

    Ops that don't consume the axis go before the cut while that side is unfinished.
    """
    def walk(acc: Column, u: Column) -> Column:
        room = at - acc["used"]
        on_axis = u["op"].isin(*ops)
        first = F.when(room <= 0, F.lit(0).cast("long")).when(on_axis, F.least(room, u["len"])).otherwise(u["len"])
        rest = u["len"] - first
        piece = lambda n: F.when(n > 0, F.array(F.struct(u["op"].alias("op"), n.alias("len")))).otherwise(F.array().cast(UNITS))
        return F.struct((acc["used"] + F.when(on_axis, first).otherwise(F.lit(0).cast("long"))).alias("used"), F.concat(acc["a"], piece(first)).alias("a"), F.concat(acc["b"], piece(rest)).alias("b"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(UNITS).alias("a"), F.array().cast(UNITS).alias("b"))
    done = F.aggregate(units, start, walk)
    return done["a"], done["b"]


@F.arrow_udf(T.StructType().add("r", "string").add("q", "string"))
def _rendered(ref: pa.Array, qry: pa.Array, ops: pa.Array, sizes: pa.Array) -> pa.Array:
    out = []
    for a, b, own, n in zip(ref.to_pylist(), qry.to_pylist(), ops.to_pylist(), sizes.to_pylist()):
        if a is None or b is None or own is None:
            out.append({"r": None, "q": None})
            continue
        r, q, i, j = [], [], 0, 0
        for op, k in zip(own, n):
            on_r, on_q = op in ON_REFERENCE, op in ON_QUERY
            r.append(a[i : i + k] if on_r else "-" * k)
            q.append(b[j : j + k] if on_q else "-" * k)
            i, j = i + k * on_r, j + k * on_q
        out.append({"r": "".join(r), "q": "".join(q)})
    return pa.array(out, pa.struct([("r", pa.string()), ("q", pa.string())]))


def render_rows(ref: Column, qry: Column, units: Column) -> tuple[Column, Column]:
    """Both aligned rows of an alignment; in Arrow batches, as a text that grows in a fold is copied at every step."""
    done = _rendered(ref, qry, F.transform(units, lambda u: u["op"]), F.transform(units, lambda u: u["len"]))
    return done["r"], done["q"]


def _columns(ref: pa.Array, qry: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, reference letter, query letter) of every column that both rows of a pair have, and the pairs without a row."""
    rows = list(zip(ref.to_pylist(), qry.to_pylist()))
    sizes = [0 if a is None or b is None else min(len(a), len(b)) for a, b in rows]
    letters = lambda k: np.frombuffer("".join(x[k][:n] for x, n in zip(rows, sizes) if n).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.repeat(np.arange(len(rows)), sizes), letters(0), letters(1), np.array([a is None or b is None for a, b in rows], bool)


_GAP, _NONE = ord("-"), ord("X")


def _units(ref: pa.Array, qry: pa.Array, extended: bool) -> pa.Array:
    pair, a, b, missing = _columns(ref, qry)
    some = (a != _GAP) | (b != _GAP)
    pair, a, b = pair[some], a[some], b[some]
    upper = lambda x: np.where((x >= 97) & (x <= 122), x - 32, x)
    same = (upper(a) == upper(b)) & (upper(a) != _NONE)
    code = np.where(a == _GAP, 1, np.where(b == _GAP, 2, np.where(same, 7, 8) if extended else 0))
    at = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (code[1:] != code[:-1]))) if len(pair) else np.zeros(0, "int64")
    ops = pa.array(list(CODES)).take(pa.array(code[at]))
    offsets = np.append(0, np.cumsum(np.bincount(pair[at], minlength=len(missing)))).astype("int32")
    units = pa.StructArray.from_arrays([ops, pa.array(np.diff(np.append(at, len(pair))))], ["op", "len"])
    return pa.ListArray.from_arrays(pa.array(offsets), units, mask=pa.array(missing))


@F.arrow_udf(_UNITS)
def _extended(ref: pa.Array, qry: pa.Array) -> pa.Array:
    return _units(ref, qry, True)


@F.arrow_udf(_UNITS)
def _aligned(ref: pa.Array, qry: pa.Array) -> pa.Array:
    return _units(ref, qry, False)


def from_rows(ref: Column, qry: Column, extended: bool = True) -> Column:
    """CIGAR of two aligned rows: = and X (or M), I where the reference has the gap, D where the query has; columns of two gaps vanish."""
    return (_extended if extended else _aligned)(ref, qry)


@F.arrow_udf(T.StructType().add("both", "long").add("same", "long"))
def _agreement(ref: pa.Array, qry: pa.Array) -> pa.Array:
    pair, a, b, missing = _columns(ref, qry)
    count = lambda of: pa.array(np.bincount(pair[of], minlength=len(missing)), mask=missing)
    return pa.StructArray.from_arrays([count((a != _GAP) & (b != _GAP)), count((a != _GAP) & (a == b))], ["both", "same"])


def shared_columns(ref: Column, qry: Column) -> Column:
    """How many columns hold a base of both aligned rows."""
    return _agreement(ref, qry)["both"]


def gap_quality(units: Column, matches: Column, least: float) -> Column:
    """True up to ten columns; beyond, matches over the shorter side must reach `least`."""
    shorter = F.least(reference_length(units), query_length(units))
    return (total(units) <= 10) | ((shorter > 0) & (matches / shorter >= least))


def match_score(text: Column) -> Column:
    """Score of an exact match: 91 for A and T, 100 for C and G."""
    count = lambda c: F.length(text) - F.length(F.replace(F.upper(text), F.lit(c), F.lit("")))
    return 91 * (count("A") + count("T")) + 100 * (count("C") + count("G"))


def band_width(qry: Column, ref: Column, rate: float = 0.1) -> Column:
    return (F.lit(200) + F.lit(rate) * (qry + ref / 2)).cast("long")


def split_three(units: Column, first: Column, second: Column) -> tuple[Column, Column, Column]:
    """(prefix, overlap, suffix) at two reference lengths; ops off the reference axis stay with the part they follow."""
    a, rest = split_at(units, first)
    b, c = split_at(rest, second - first)
    return a, b, c


def validated(units: Column, ref: Column, qry: Column) -> tuple[Column, Column]:
    """(normalised units, error or null) of a segment's CIGAR against its lengths on both axes."""
    tidy = coalesce_units(units)
    error = F.when(reference_length(units) != ref, "reference length").when(query_length(units) != qry, "query length")
    return tidy, error


def preferred(units: Column, open_: int = 400, extend: int = 30, match: int = 91, mismatch: int = -114) -> tuple[Column, Column]:
    """(score, whether it beats leaving both sides as two gaps) under affine costs; M counts as a mismatch."""
    gaps = F.aggregate(units, F.lit(0).cast("long"), lambda acc, u: acc + F.when(u["op"].isin("I", "D") & (u["len"] > 0), open_ + extend * u["len"]).otherwise(0))
    score = (match * total(units, ("=",)) + mismatch * total(units, ("M", "X")) - gaps).cast("long")
    alone = lambda n: F.when(n > 0, open_ + extend * n).otherwise(0)
    return score, score > -(alone(reference_length(units)) + alone(query_length(units)))


def row_quality(ref: Column, qry: Column) -> tuple[Column, Column]:
    """(identity over columns of two bases, share of the shorter side in such columns) of two aligned rows."""
    both, same = _agreement(ref, qry)["both"], _agreement(ref, qry)["same"]
    bases = lambda c: F.length(F.replace(c, F.lit("-"), F.lit("")))
    shorter = F.least(bases(ref), bases(qry))
    return F.when(both > 0, same / both).otherwise(F.lit(0.0)), F.when(shorter > 0, both / shorter).otherwise(F.lit(0.0))
