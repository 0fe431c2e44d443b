"""Readers and writers of the text formats: seqfile, FASTA, mask intervals, PAF, FAI, distances, Newick, MAF, GFA."""

from __future__ import annotations

import re


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.sequence import clean_dna, first_token, is_plain_name

PAF_FIELDS = ("query_name", "query_length", "query_start", "query_end", "strand", "target_name", "target_length", "target_start", "target_end", "matches", "block_length", "mapq")
_PAF_TEXT = ("query_name", "strand", "target_name")


# ------------------------------------------------------------------ seqfile and trees


def parse_newick(text: str) -> list[tuple[int, int | None, str, float]]:
    """(id, parent, name, branch length) of a Newick tree, parents first."""
    tokens = re.findall(r"\(|\)|,|;|:[^,();]*|'(?:[^']|'')*'|[^,():;]+", re.sub(r"\[[^\]]*\]", "", text.strip()))
    nodes: list[list] = [[0, None, "", 0.0]]
    stack, at, closed = [], 0, False
    for token in tokens:
        if token == "(":
            nodes.append([len(nodes), at, "", 0.0])
            stack.append(at)
            at = len(nodes) - 1
        elif token == ",":
            if not stack:
                raise ValueError("a comma outside parentheses")
            nodes.append([len(nodes), stack[-1], "", 0.0])
            at = len(nodes) - 1
        elif token == ")":
            if not stack:
                raise ValueError("unbalanced parentheses")
            at = stack.pop()
        elif token == ";":
            closed = True
            break
        elif token[0] == ":":
            nodes[at][3] = float(token[1:])
        elif token.strip():
            nodes[at][2] = token.strip().strip("'").replace("''", "'")
    if stack or not closed:
        raise ValueError("the tree doesn't end")
    return [tuple(n) for n in nodes]


def newick_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_newick(text), "node long, parent long, name string, branch_length double")


def to_newick(nodes: list[tuple[int, int | None, str, float]]) -> str:
    """The tree as text again; node ids decide the order of children."""
    below: dict = {}
    for n in nodes:
        below.setdefault(n[1], []).append(n)
    done: dict[int, str] = {}
    for n in sorted(nodes, key=lambda n: -n[0]):
        kids = [done[k[0]] for k in below.get(n[0], [])]
        done[n[0]] = (f"({','.join(kids)})" if kids else "") + n[2] + (f":{n[3]:g}" if n[1] is not None else "")
    return done[below[None][0][0]] + ";"


def read_seqfile(spark: SparkSession, path: str, root: str | None = None) -> tuple[str | None, DataFrame]:
    """(the tree's text or None, species and path); with root only that subtree's leaves."""
    lines = [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip() and not r[0].startswith("#")]  # one line a genome
    tree = lines.pop(0) if lines and (lines[0].startswith("(") or len(lines[0].split()) == 1) else None
    pairs = [line.split(None, 1) for line in lines]
    if not pairs or any(len(p) < 2 for p in pairs):
        raise ValueError("a seqfile needs a name and a path on every line")
    if len({p[0] for p in pairs}) < len(pairs):
        raise ValueError("a species is named twice")
    if root is not None:
        nodes = parse_newick(tree or "")
        kept = {next(n[0] for n in nodes if n[2] == root)}
        for n in nodes:
            if n[1] in kept:
                kept.add(n[0])
        names = {n[2] for n in nodes if n[0] in kept}
        pairs = [p for p in pairs if p[0] in names]
    return tree, spark.createDataFrame([(p[0].lstrip("*"), p[1]) for p in pairs], "species string, path string")


# ------------------------------------------------------------------ FASTA and masks


def read_fasta(spark: SparkSession, path: str, species: str) -> DataFrame:
    """genome, contig, contig_index, seq, length; gzip by its suffix.

    Records are split by Spark's own reader on '\\n>', so a file's records spread over tasks.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("_at", F.monotonically_increasing_id()).where(F.length(F.trim("value")) > 0)
    head = first_token(F.split("value", "\n", 2).getItem(0))
    body = F.regexp_replace(F.coalesce(F.get(F.split("value", "\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    rows = raw.select(F.lit(species).alias("genome"), head.alias("contig"), body.alias("seq"), "_at")
    index = F.row_number().over(Window.partitionBy("genome").orderBy("_at")) - 1
    return rows.withColumn("contig_index", index).withColumn("length", F.length("seq").cast("long")).select("genome", "contig", "contig_index", "seq", "length")


def cleaned(fasta: DataFrame) -> DataFrame:
    return fasta.withColumn("seq", clean_dna(F.col("seq")))


def fasta_lines(contigs: DataFrame) -> DataFrame:
    """One text value a record, `species.contig` headers, unknown letters N."""
    return contigs.select(F.concat(F.lit(">"), F.concat_ws(".", "genome", "contig"), F.lit("\n"), clean_dna(F.col("seq"))).alias("value"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end from '>name' headers and 'start - end' lines."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "(?m)^>"), lambda s: F.trim(s) != "")).alias("i", "part"))
    lines = raw.select(first_token(F.col("part")).alias("contig"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^\s*(\d+\s*-\s*\d+)\s*$"), F.lit(1))).alias("span"))
    number = lambda i: F.trim(F.split("span", "-").getItem(i)).cast("long")
    return lines.select("contig", number(0).alias("start"), number(1).alias("end")).where("start < end")


# ------------------------------------------------------------------ PAF, FAI, distances


def paf_error(row: dict[str, Column], cigar: Column, need_cigar: bool, target_lengths: bool = True) -> Column:
    """Why a record is invalid, or null; without target_lengths a target may end beyond its stated length."""
    units = cg.parse(cigar)
    out = F.lit(None).cast("string")
    checks = [
        ("fields", F.col("_n") < 12),
        ("name", ~is_plain_name(row["query_name"]) | ~is_plain_name(row["target_name"])),
        ("number", F.greatest(*[c.isNull().cast("int") for k, c in row.items() if k not in _PAF_TEXT]) == 1),
        ("strand", ~row["strand"].isin("+", "-")),
        ("query bounds", (row["query_start"] < 0) | (row["query_start"] >= row["query_end"]) | (row["query_end"] > row["query_length"])),
        ("target bounds", (row["target_start"] < 0) | (row["target_start"] >= row["target_end"]) | (F.lit(target_lengths) & (row["target_end"] > row["target_length"]))),
        ("matches", row["matches"] > row["block_length"]),
        ("mapq", row["mapq"] > 255),
        ("no cigar", F.lit(need_cigar) & cigar.isNull()),
        ("cigar text", cigar.isNotNull() & ~cigar.rlike(r"^(\d+[MIDNSHP=X])+$")),
        ("cigar consumption", cigar.isNotNull() & ((cg.query_length(units) != row["query_end"] - row["query_start"]) | (cg.reference_length(units) != row["target_end"] - row["target_start"]))),
    ]
    for name, bad in reversed(checks):
        out = F.when(bad, name).otherwise(out)
    return out


def parse_paf(lines: DataFrame, need_cigar: bool = False, target_lengths: bool = True) -> DataFrame:
    """lines(value) to the twelve fields, cigar, and error."""
    parts = lines.where(F.trim("value") != "").select(F.split("value", "\t").alias("f")).withColumn("_n", F.size("f"))
    row = {k: F.get("f", F.lit(i)) if k in _PAF_TEXT else F.expr(f"try_cast(get(f, {i}) as bigint)") for i, k in enumerate(PAF_FIELDS)}
    tag = F.get(F.filter("f", lambda x: x.startswith("cg:Z:")), F.lit(0))
    named = parts.select("_n", *[c.alias(k) for k, c in row.items()], F.substring(tag, F.lit(6), F.length(tag)).alias("cigar"))
    return named.withColumn("error", paf_error({k: F.col(k) for k in PAF_FIELDS}, F.col("cigar"), need_cigar, target_lengths)).drop("_n")


def unknown_contigs(paf: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records whose query or target isn't in catalog(name, length), or has another length."""
    c = catalog.select(F.col("name"), F.col("length"))
    q = paf.join(c.select(F.col("name").alias("query_name"), F.col("length").alias("query_length")), ["query_name", "query_length"], "left_anti")
    t = paf.join(c.select(F.col("name").alias("target_name"), F.col("length").alias("target_length")), ["target_name", "target_length"], "left_anti")
    return q.unionByName(t.select(q.columns)).distinct()


def paf_lines(rows: DataFrame) -> DataFrame:
    """value: twelve fields, cg:Z, tp:A:P and NM:i."""
    tags = [F.concat(F.lit("cg:Z:"), "cigar"), F.lit("tp:A:P"), F.concat(F.lit("NM:i:"), (F.col("block_length") - F.col("matches")).cast("string"))]
    return rows.select(F.concat_ws("\t", *[F.col(k).cast("string") for k in PAF_FIELDS], *tags).alias("value"))


def parse_fai(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    names = ("length", "offset", "line_bases", "line_width")
    return lines.where(F.trim("value") != "").select(f.getItem(0).alias("name"), *[F.expr(f"try_cast(get(split(value, '\\t'), {i}) as bigint)").alias(n) for i, n in enumerate(names, 1)])


def parse_distances(lines: DataFrame) -> DataFrame:
    """reference, query, distance, p_value, shared_hashes, total_hashes from five tab-separated fields."""
    f = F.split("value", "\t")
    share = F.split(f.getItem(4), "/")
    return lines.where(F.trim("value") != "").select(f.getItem(0).alias("reference"), f.getItem(1).alias("query"), f.getItem(2).cast("double").alias("distance"), f.getItem(3).cast("double").alias("p_value"), share.getItem(0).cast("long").alias("shared_hashes"), share.getItem(1).cast("long").alias("total_hashes"))


# ------------------------------------------------------------------ PAF normalisation


def _trim(row: dict, target: int, query: int) -> dict | None:
    """row without its first columns, until `target` and `query` bases are gone on both axes; starts on an aligned column."""
    units = [(op, n) for op, n in ((u[-1], int(u[:-1])) for u in re.findall(r"\d+[MIDNSHP=X]", row["cigar"]))]
    gone_t = gone_q = 0
    rest = []
    for k, (op, n) in enumerate(units):
        on_t, on_q = op in cg.ON_REFERENCE, op in cg.ON_QUERY
        if on_t and on_q:
            skip = min(n, max(0, target - gone_t, query - gone_q))
            gone_t, gone_q = gone_t + skip, gone_q + skip
            if skip < n:
                rest = [(op, n - skip), *units[k + 1 :]]
                break
        else:
            gone_t, gone_q = gone_t + n * on_t, gone_q + n * on_q
    if not rest:
        return None
    out = dict(row)
    out["target_start"] += gone_t
    if row["strand"] == "+":
        out["query_start"] += gone_q
    else:
        out["query_end"] -= gone_q
    out["cigar"] = "".join(f"{n}{op}" for op, n in rest)
    out["block_length"] = sum(n for _, n in rest)
    if not any(op in cg.ALIGNED for op, _ in rest):
        return None
    # = columns count as they are; what the record says beyond them is spread evenly over its M columns
    count = lambda own, kind: sum(n for op, n in own if op == kind)
    whole, kept = count(units, "M"), count(rest, "M")
    spread = min(whole, max(0, row["matches"] - count(units, "=")))
    out["matches"] = count(rest, "=") + (kept * spread // whole if whole else 0)
    return out


def normalise_paf(records: pd.DataFrame) -> pd.DataFrame:
    """Input-order greedy choice of records that don't overlap on either axis; overlapping prefixes are trimmed.

    For one target: an ordered scan, so it runs in applyInPandas for each connected set of contigs.
    """
    from bisect import bisect_left, insort

    taken: dict[tuple[str, str], list[tuple[int, int]]] = {}

    def overlap(axis: str, name: str, start: int, end: int) -> tuple[int, bool]:
        """(how much of the start is taken, whether anything beyond is)."""
        held = taken.get((axis, name), [])
        at = max(0, bisect_left(held, (start, start)) - 1)
        cut = 0
        for s, e in held[at:]:
            if s >= end:
                break
            if e > start + cut:
                if s <= start + cut:
                    cut = e - start
                else:
                    return cut, True
        return min(cut, end - start), False

    out = []
    for row in records.to_dict("records"):
        current: dict | None = row
        for _ in range(3):
            if current is None:
                break
            t, t_more = overlap("t", current["target_name"], current["target_start"], current["target_end"])
            if current["strand"] == "+":
                q, q_more = overlap("q", current["query_name"], current["query_start"], current["query_end"])
            else:
                span = [(-e, -s) for s, e in taken.get(("q", current["query_name"]), [])]
                taken[("r", "")] = sorted(span)
                q, q_more = overlap("r", "", -current["query_end"], -current["query_start"])
            if t_more or q_more:
                current = None
            elif t or q:
                current = _trim(current, t, q)
            else:
                break
        if current is not None:
            insort(taken.setdefault(("t", current["target_name"]), []), (current["target_start"], current["target_end"]))
            insort(taken.setdefault(("q", current["query_name"]), []), (current["query_start"], current["query_end"]))
            out.append(current)
    return pd.DataFrame(out, columns=records.columns)


# ------------------------------------------------------------------ MAF and GFA


def maf_block(rows: DataFrame, least: int = 2) -> DataFrame:
    """rows(block, row, source, start, size, strand, source_size, aligned) to (block, body) of blocks with enough rows."""
    line = F.concat_ws(" ", F.lit("s"), "source", F.col("start").cast("string"), F.col("size").cast("string"), "strand", F.col("source_size").cast("string"), "aligned")
    made = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("a"))
    return made.where(F.size("a") >= least).select("block", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("body"))


def maf_lines(blocks: DataFrame) -> DataFrame:
    """value: one block of text each, with its 'a' line; the header goes into the file separately."""
    return blocks.select(F.concat(F.lit("a score=0\n"), "body", F.lit("\n")).alias("value"))


def maf_start(start: Column, end: Column, source_size: Column, reverse: Column) -> Column:
    """MAF counts reverse rows from the end of the source."""
    return F.when(reverse, source_size - end).otherwise(start)


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """block, row, source, start, size, strand, source_size, aligned."""
    raw = spark.read.option("lineSep", "\na ").text(path).withColumn("block", F.monotonically_increasing_id())
    lines = raw.select("block", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?m)^(s\s.*)$"), F.lit(1))).alias("row", "line"))
    f = F.split(F.trim("line"), r"\s+")
    return lines.select("block", "row", f.getItem(1).alias("source"), f.getItem(2).cast("long").alias("start"), f.getItem(3).cast("long").alias("size"), f.getItem(4).alias("strand"), f.getItem(5).cast("long").alias("source_size"), f.getItem(6).alias("aligned"))


def read_gfa(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """segments(id, sequence), links(src, src_orient, dst, dst_orient, overlap), paths(name, steps)."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    item = lambda i: F.get("f", F.lit(i))
    of = lambda kind: rows.where(item(0) == kind)
    walk = F.regexp_extract_all(item(6), F.lit(r"([<>][^<>]+)"), F.lit(1))
    w = of("W").select(F.concat_ws("#", item(1), item(2), item(3)).alias("name"), F.transform(walk, lambda s: F.concat(F.substring(s, F.lit(2), F.length(s)), F.when(s.startswith(">"), "+").otherwise("-"))).alias("steps"))
    return {
        "segments": of("S").select(item(1).alias("id"), item(2).alias("sequence")),
        "links": of("L").select(item(1).alias("src"), item(2).alias("src_orient"), item(3).alias("dst"), item(4).alias("dst_orient"), item(5).alias("overlap")),
        "paths": of("P").select(item(1).alias("name"), F.split(item(2), ",").alias("steps")).unionByName(w),
    }


OUTPUT_ORDER = ("maf", "paf", "gfa", "hal")


def output_plan(paths: list[str]) -> list[tuple[str, str]]:
    """(format, path) in canonical order; one path a format, no path twice."""
    kinds: dict[str, str] = {}
    for p in paths:
        kind = p.rsplit(".", 1)[-1].lower()
        if kind not in OUTPUT_ORDER:
            raise ValueError(f"{p}: not one of {', '.join(OUTPUT_ORDER)}")
        if kind in kinds or p in kinds.values():
            raise ValueError(f"{p}: a second output of its kind")
        kinds[kind] = p
    return [(k, kinds[k]) for k in OUTPUT_ORDER if k in kinds]


def write_text(lines: DataFrame, path: str, compression: str = "none") -> None:
    """lines(value) through Spark's commit protocol: nothing shows before the job ends."""
    lines.write.mode("error").option("compression", compression).text(path)


