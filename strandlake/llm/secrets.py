"""Operator 8: secret scanning through an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one row
for each blob and rule version that has been scanned, with its findings. A scan looks only at pairs
that the ledger lacks, each blob once however many paths share it, and joins the findings back to
all paths.

Copies collapse before the shuffle (a task keeps the digests it has sent), and the scan streams the
texts, so a blob that a third of all paths share costs at most one text a task. Rules keep the
leftmost, non-overlapping matches of each kind; a match that is too short is dropped after it has
consumed its text.

Edge cases: null content is the empty blob; paths without an id and repeated rows are joined like
any other; an empty table gives no rows; very long texts are scanned whole; kinds that start at one
place are listed in the order of the rules; further columns, whatever their names, are kept by
redact() and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group that is measured (0: the match), its least length."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    fold: bool = False
    #: Text that every match holds (in lower case where fold is set); empty: unknown.
    needles: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    """Rules in the order in which ties at one start are listed, and the version they stand for."""

    version: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


#: The three base kinds.
BASE_RULES = RuleSet(
    "base-1",
    (
        Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
        Rule("access", r"AKIA[A-Z0-9]+", 20, 0, False, ("AKIA",)),
        Rule("hex", r"[0-9a-f]+", 24),
    ),
)
#: The base kinds and two that the method adds, as a rule version of its own.
WIDER_RULES = RuleSet(
    "wider-1",
    (
        *BASE_RULES.rules,
        Rule("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 1, 0, False, ("PRIVATE KEY",)),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, 0, False, ("eyJ",)),
    ),
)
#: Findings that are broadcast at most; more are joined by a shuffle.
SPANS_BROADCAST = 200_000
LEDGER = "blob string, rule_version string, findings array<struct<kind:string,start:long,end:long>>"


class Scanner:
    """Compiled rules."""

    def __init__(self, rules: RuleSet):
        self.rules = [(r, re.compile(r.pattern if r.pattern != r"[0-9a-f]+" else rf"[0-9a-f]{{{r.least},}}", re.A | (re.I if r.fold else 0))) for r in rules.rules]

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
        found, low = [], None
        for order, (rule, pattern) in enumerate(self.rules):
            if rule.needles:
                if rule.fold and low is None:
                    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                if not any(n in (low if rule.fold else text) for n in rule.needles):
                    continue
            for m in pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append((m.start(), order, rule.kind, m.end()))
        return [(kind, start, end) for start, _, kind, end in sorted(found)]


def content_address(content: Column) -> Column:
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")).cast("binary"), 256)


#: Digests that a task remembers to leave out copies; beyond, copies may travel, and are dropped after the shuffle.
REMEMBERED = 1_000_000


def _first_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()
    for batch in batches:
        keys = [bytes.fromhex(b) for b in batch["blob"]]
        keep = []
        for k in keys:
            keep.append(k not in seen)
            if len(seen) < REMEMBERED:
                seen.add(k)
        yield batch[keep]


def scan_blobs(versions: DataFrame, rules: RuleSet | tuple[RuleSet, ...] = BASE_RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the pairs of a blob of versions(content) and a rule version that the ledger lacks.

    A blob is read once for all the rule versions that it lacks. A blob without findings gets a row
    too: that is what makes the next scan skip it.
    """
    sets = (rules,) if isinstance(rules, RuleSet) else tuple(rules)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanners = [(r.version, Scanner(r)) for r in sets]
        for batch in batches:
            out = []
            for blob, text, done in zip(batch["blob"], batch["content"], batch["done"]):
                for version, scanner in scanners:
                    if done is None or version not in done:
                        out.append((blob, version, [{"kind": k, "start": s, "end": e} for k, s, e in scanner(text)]))
            yield pd.DataFrame(out, columns=["blob", "rule_version", "findings"])

    blobs = versions.select(content_address(F.col("content")).alias("blob"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    once = blobs.mapInPandas(_first_in_task, "blob string, content string")
    if ledger is None:
        # copies from several tasks meet in one, one text from each
        once = once.withColumn("done", F.lit(None).cast("array<string>"))
    else:
        named = ledger.where(F.col("rule_version").isin(*[r.version for r in sets])).groupBy("blob").agg(F.collect_set("rule_version").alias("done"))
        once = once.join(named, "blob", "left").where(F.col("done").isNull() | (F.size("done") < len(sets)))
    return once.repartition("blob").mapInPandas(scan, LEDGER).dropDuplicates(["blob", "rule_version"]) if ledger is not None else once.repartition("blob").mapInPandas(_once(scan), LEDGER)


def _once(scan):
    """scan over the first row of each blob of a task; equal blobs are in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()

        def first() -> Iterator[pd.DataFrame]:
            for batch in batches:
                fresh = [b not in seen and not seen.add(b) for b in batch["blob"]]
                yield batch[fresh]

        yield from scan(first())

    return run


def scan_versions(versions: DataFrame, rules: RuleSet | tuple[RuleSet, ...] = BASE_RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the ledger with the new rows, versions with their blob and the findings of the last of the rules).

    versions has `content` and any columns that name path and version; they are kept. The new rows are
    a stored table; to keep the ledger, write it where the next scan finds it.
    """
    from .common import staged

    last = rules.version if isinstance(rules, RuleSet) else rules[-1].version
    fresh = staged(scan_blobs(versions, rules, ledger))
    full = fresh if ledger is None else ledger.select("blob", "rule_version", "findings").unionByName(fresh)
    known = full.where((F.col("rule_version") == last) & (F.size("findings") > 0)).select("blob", "findings")
    named = versions.withColumn("blob", content_address(F.col("content"))).drop("content", "findings")
    empty = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    # all rows of one blob would meet in a task, so the findings go to them wherever their count allows
    few = (known.agg(F.sum(F.size("findings"))).first()[0] or 0) <= SPANS_BROADCAST
    return full, named.join(F.broadcast(known) if few else known, "blob", "left").withColumn("findings", F.coalesce("findings", empty))


def document_secrets(docs: DataFrame, rules: RuleSet = WIDER_RULES) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, and all spans."""
    versions = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("content"))
    _, found = scan_versions(versions, (BASE_RULES, rules) if rules.version != BASE_RULES.version else rules)
    base = F.filter("findings", lambda f: f["kind"].isin("assign", "access", "hex"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, rules: RuleSet = BASE_RULES, mask: str = "[secret]") -> DataFrame:
    """docs with every found span replaced; other columns and rows stay as they are."""
    spare = staged_ledger(docs, rules)
    spans = spare.agg(F.sum(F.size("_findings"))).first()[0] or 0
    # the columns of docs are in a struct, so that none can clash with ours
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), content_address(F.col("text")).alias("blob"))
    blobs = own.join(F.broadcast(spare) if spans <= SPANS_BROADCAST else spare, "blob", "left")
    # spans of different kinds may overlap: the text between the furthest end so far and the next start stays
    step = lambda acc, f: F.struct(
        F.concat(acc["out"], F.when(f["start"] >= acc["at"], F.concat(F.col("text").substr(acc["at"].cast("int") + 1, (f["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))).alias("out"),
        F.greatest(acc["at"], f["end"]).alias("at"),
    )
    whole = F.aggregate("_findings", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"].cast("int") + 1, F.length("text"))))
    masked = F.when(F.col("_findings").isNull(), F.col("text")).otherwise(whole)
    return blobs.select(*[masked.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def staged_ledger(docs: DataFrame, rules: RuleSet = BASE_RULES) -> DataFrame:
    """blob and _findings of the blobs with findings."""
    from .common import staged

    fresh = staged(scan_blobs(docs.select(F.col("text").alias("content")), rules))
    return fresh.where(F.size("findings") > 0).select("blob", F.col("findings").alias("_findings"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of a list of spans, as document_secrets() gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
