"""Oriented graphs, unitigs, column runs, scans and bridged anchors against plain versions."""

import random

import pytest


def test_parity_against_a_walk(spark):
    from strandlake.operators.oriented import oriented_components

    rng = random.Random(2)
    links = [(g * 20 + a, g * 20 + b, rng.random() < 0.4) for g in range(25) for a, b in [(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(1, 9))]]
    near = {}
    for a, b, r in links:
        near.setdefault(a, []).append((b, r))
        near.setdefault(b, []).append((a, r))
    seen = {}
    for root in sorted(near):
        if root in seen:
            continue
        side, todo, torn = {root: False}, [root], False
        while todo:
            x = todo.pop()
            for y, r in near[x]:
                if y in side:
                    torn |= side[y] != side[x] ^ r
                else:
                    side[y] = side[x] ^ r
                    todo.append(y)
        for x, s in side.items():
            seen[x] = (root, None if torn else s, torn)
    got = oriented_components(spark.createDataFrame(links, "src long, dst long, reverse boolean")).collect()
    assert {r.node: (r.component, r.reverse, r.contradictory) for r in got} == seen


def _pairwise(walks):
    """Unitigs by merging one deterministic pair after another; every step keeps its nodes."""
    walks = [[((n, r),) for n, r in w] for w in walks]
    flip = lambda u: tuple((n, not r) for n, r in reversed(u))
    name = lambda u: min(u, flip(u))
    while True:
        uses = {}
        for w in walks:
            for u in w:
                uses[name(u)] = uses.get(name(u), 0) + 1
        together = {}
        for w in walks:
            for a, b in zip(w, w[1:]):
                if name(a) != name(b):
                    pair = min((a, b), (flip(b), flip(a)))
                    together[pair] = together.get(pair, 0) + 1
        good = sorted(p for p, n in together.items() if n == uses[name(p[0])] == uses[name(p[1])])
        if not good:
            return walks
        a, b = good[0]
        for w in walks:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) in ((a, b), (flip(b), flip(a))):
                    w[i : i + 2] = [w[i] + w[i + 1]]
                i += 1


def test_unitigs_against_merging_pairs(spark):
    from strandlake.operators.oriented import compacted_walks, unitig_nodes, unitigs

    rng = random.Random(5)
    chains = [[(g * 10 + i, rng.random() < 0.5) for i in range(rng.randrange(1, 5))] for g in range(9)]
    walks = []
    for _ in range(14):
        w = []
        for _ in range(rng.randrange(1, 6)):
            c = rng.choice(chains)
            w += c if rng.random() < 0.5 else [(n, not r) for n, r in reversed(c)]
        walks.append(w[rng.randrange(2) : len(w) - rng.randrange(2)])
    walks.append([(77, False), (77, True), (78, False)])
    rows = [(k, i, n, r) for k, w in enumerate(walks) for i, (n, r) in enumerate(w)]
    steps = unitigs(spark.createDataFrame(rows, "walk long, pos long, node long, reverse boolean")).cache()
    nodes = {}
    for r in unitig_nodes(steps).orderBy("unitig", "step").collect():
        nodes.setdefault(r.unitig, []).append((r.node, r.reverse))
    got = {}
    for r in compacted_walks(steps).orderBy("walk", "pos").collect():
        unit = nodes[r.node]
        got.setdefault(r.walk, []).append(tuple((n, not f) for n, f in reversed(unit)) if r.reverse else tuple(unit))
    assert got == {k: w for k, w in enumerate(_pairwise(walks)) if w}


def test_runs_that_contradict_themselves(spark):
    from strandlake.operators.oriented import refined_runs, run_cuts

    rows = [(1, 0, 0, 10, False), (2, 0, 4, 10, True), (3, 0, 100, 6, False), (3, 1, 0, 6, False), (4, 0, 100, 6, True), (4, 1, 0, 6, False), (5, 0, 50, 0, False)]
    w = spark.createDataFrame(rows, "run long, leaf long, start long, len long, reverse boolean")
    cuts = run_cuts(w)
    assert {(r.run, r.off) for r in cuts.collect()} == {(1, 0), (1, 4), (1, 10), (2, 0), (2, 4), (2, 10), (3, 0), (3, 6), (4, 0), (4, 6)}
    got = {(r.run, r.off): r for r in refined_runs(w, cuts).collect()}
    assert got[2, 4].component == got[1, 4].component and got[2, 4].reverse is True and not got[2, 4].contradictory
    assert got[1, 0].component != got[1, 4].component
    assert got[3, 0].contradictory and got[4, 0].contradictory and got[4, 0].reverse is None


def _scan(ref, query, strand, mode, least, most, skip):
    """One scan by text search; the forward strand runs from the query's end."""
    other = str.maketrans("ACGT", "TGCA")
    n, p, out, old = len(query), 0, [], None
    text = query if strand == "+" else query.translate(other)
    where = lambda s: [i for i in range(len(ref) - len(s) + 1) if ref.startswith(s, i)]
    while p < n:
        part = (lambda m: text[n - p - m : n - p]) if strand == "+" else (lambda m: text[p : p + m][::-1])
        best = 0
        while p + best < n and part(best + 1) in ref:
            best += 1
        at = where(part(best)) if best >= least else []
        taken = 0 < len(at) <= most
        if taken:
            mark = at[0] + (best if mode == "fast" else 0)
            if mode == "middle" or mark != old:
                out += [(strand, n - p - best if strand == "+" else p, i, best) for i in at]
            old = mark
        if mode == "fast":
            p += least
        elif mode == "middle":
            p += best if taken else 1
        else:
            p += best if taken and len(at) == 1 and 0 < skip < best else 1
    return out


@pytest.mark.parametrize("mode,most,skip", [("fast", 3, 0), ("middle", 3, 0), ("accurate", 1, 0), ("accurate", 3, 25)])
def test_scans_against_text_search(spark, mode, most, skip):
    from strandlake.operators.bridging import scan_matches

    rng = random.Random(9)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    repeat = dna(17)
    ref = dna(90) + repeat + dna(60) + repeat + dna(80) + repeat + dna(50)
    query = dna(13) + ref[60:150] + "A" + ref[160:230] + dna(20) + ref[20:75] + repeat + dna(9)
    back = query[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contigs = spark.createDataFrame([(0, 0, ref, len(ref)), (1, 1, query, len(query)), (1, 2, back, len(back)), (1, 3, "", 0)], "genome long, contig long, seq string, length long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # stretches go on over batches
    try:
        got = sorted((r.qchr, r.strand, r.qstart, r.rstart, r.len) for r in scan_matches(contigs, 0, 12, mode, most, skip).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted((c, *m) for c, q in ((1, query), (2, back)) for s in "+-" for m in _scan(ref, q, s, mode, 12, most, skip))
    assert got == want and len(got) > 3


def test_bridged_anchors_spell_their_texts(spark):
    import re

    from strandlake.operators.bridging import bridged_anchors

    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    other = str.maketrans("ACGT", "TGCA")
    a, b, c = dna(40), dna(30), dna(50)
    ref = dna(16380) + a + dna(11) + b + dna(5) + c + dna(30)
    qry = dna(20) + a + dna(14) + b + c + dna(9)
    back = qry[::-1].translate(other)
    rows = []
    for name, strand in ((2, "+"), (3, "-")):
        for m in (a, b, c):
            q = qry.index(m) if strand == "+" else len(qry) - qry.index(m) - len(m)
            rows.append((name, strand, name, 1, q, ref.index(m), len(m)))
    rows += [(4, "+", 2, 1, 0, 0, 10), (4, "+", 2, 1, 5, 20, 10), (4, "+", 2, 1, 40, 10300, 10)]
    contigs = spark.createDataFrame([(1, ref), (2, qry), (3, back)], "contig long, seq string")
    got = {(r.cluster, r.anchor): r for r in bridged_anchors(spark.createDataFrame(rows, "cluster long, strand string, qchr long, rchr long, qstart long, rstart long, len long"), contigs).collect()}
    assert set(got) == {(2, 0), (3, 0), (4, 0), (4, 1), (4, 2)}
    assert got[4, 0].cigar == "10M"
    for k, text in ((2, qry), (3, back)):
        r = got[k, 0]
        q = text[r.qstart : r.qend]
        q = q if k == 2 else q[::-1].translate(other)
        t, i, j = ref[r.rstart : r.rend], 0, 0
        assert r.cigar == got[2, 0].cigar and r.cigar.endswith("5D50M") and r.matched + 0 >= 120
        for n, op in re.findall(r"(\d+)([MID])", r.cigar):
            i, j = i + int(n) * (op != "I"), j + int(n) * (op != "D")
        assert (i, j) == (len(t), len(q)) and q.startswith(a) and t.startswith(a)


def test_banded_alignment_is_the_whole_one():
    from strandlake.functions.align import global_align

    rng = random.Random(6)
    a = "".join(rng.choice("ACGT") for _ in range(2500))
    b = a[:700] + a[760:1500] + "ACGGT" * 6 + a[1500:]
    assert global_align(a, b) == global_align(a, b, band=100)
    assert global_align(a, b, band=100)[1].count("D") == 1
