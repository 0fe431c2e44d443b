"""Findings of round 3: queries against their SQL on tables unlike the driver's, and plans that hold no table in the driver."""

import pandas as pd
import pytest

from .test_operators import SF, table


def both(spark, tmp_path, name, **tables):
    """Rows of the query and of its SQL where the named tables are replaced by the given frames; a list makes one file each."""
    import duckdb

    from strandlake.plans.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "documents", "supplier", "customer"):
        path = f"{SF}/{t}.parquet"
        if t in tables:
            path = str(tmp_path / f"{t}.parquet")
            if isinstance(tables[t], list):
                (tmp_path / f"{t}.parquet").mkdir()
                for i, part in enumerate(tables[t]):
                    part.to_parquet(f"{path}/{i}.parquet", index=False)
                path += "/*.parquet"
            else:
                tables[t].to_parquet(path, index=False)
        else:
            (tmp_path / f"{t}.parquet").symlink_to(path)
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return table(QUERIES[name](spark, str(tmp_path)).toPandas()), table(con.execute(ORACLES[name]).df())


def lines(**columns):
    """sf0.001's lineitem, its first rows with the given columns."""
    n = len(next(iter(columns.values())))
    return pd.read_parquet(f"{SF}/lineitem.parquet").head(n).assign(**columns)


def test_f24_starts_one_beyond_the_gap_are_apart(spark):
    from strandlake.streaming.sessions import coordinate_sessions

    rows = spark.createDataFrame([("a", 1), ("a", 12), ("a", 22)], "chr string, start long")
    assert sorted(map(tuple, coordinate_sessions(rows, "start", ["chr"], 10).collect())) == [("a", 1, 2, 1), ("a", 12, 23, 2)]


def test_f25_targets_longer_than_the_sql_says(spark, tmp_path):
    ours, theirs = both(spark, tmp_path, "paf_records", lineitem=lines(l_orderkey=[5, 6, 7], l_linenumber=[1, 1, 1], l_partkey=[95_000, 89_999, 7], l_quantity=[9.0, 9.0, 9.0]).astype({"l_linenumber": "int32"}))
    assert ours == theirs


def test_f26_sizes_beyond_gigabytes(spark, tmp_path):
    orders = pd.read_parquet(f"{SF}/orders.parquet").head(4).assign(o_orderkey=[3, 2**15, 2**20, 9_000_000])
    ours, theirs = both(spark, tmp_path, "readable_sizes", orders=orders)
    assert ours == theirs and any("1024.00 GB" in r for r in theirs)


def test_f27_the_first_of_equal_runs_is_kept(spark, tmp_path):
    # Spark reads the larger file first; the first file's rows win all the same
    first = pd.read_parquet(f"{SF}/lineitem.parquet").head(1000)
    more = pd.concat([first.assign(l_partkey=first["l_partkey"] + 1, l_suppkey=first["l_suppkey"] + k) for k in (1, 2, 3)], ignore_index=True)
    ours, theirs = both(spark, tmp_path, "maf_reblocking", lineitem=[first, more])
    assert ours == theirs


def plan_of(spark, name):
    from strandlake.plans.catalogue import QUERIES

    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["aligned_row_quality", "pairs_all", "pair_projection", "run_leaf_intervals", "cigar_round_trip", "cigar_rendered_rows", "alignment_preferred", "gap_alignment"])
def test_f1_f2_f12_f23_rows_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan_of(spark, name)


def test_f32_rows_to_cigars_against_a_plain_version(spark):
    import itertools

    from strandlake.functions import cigar as cg

    rows = [("AC-GT", "A--GX"), ("", ""), ("a-XC", "A-XC"), (None, "A"), ("ACGT", "AC"), ("--", "--"), ("AÉC", "AÉ-")]

    def plain(a, b):
        if a is None:
            return None
        ops = ["I" if x == "-" else "D" if y == "-" else "=" if x.upper() == y.upper() != "X" else "X" for x, y in zip(a, b) if (x, y) != ("-", "-")]
        return [(k, len(list(g))) for k, g in itertools.groupby(ops)]

    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select(cg.from_rows(df.a, df.b).alias("u"), cg.from_rows(df.a, df.b, extended=False).alias("m"), cg.shared_columns(df.a, df.b).alias("n")).collect()
    assert [None if r.u is None else [tuple(x) for x in r.u] for r in got] == [plain(a, b) for a, b in rows]
    assert [r.n for r in got] == [3, 0, 3, None, 2, 0, 2]
    assert [tuple(x) for x in got[0].m] == [("M", 1), ("D", 1), ("M", 2)]


@pytest.mark.parametrize("name", ["breakpoint_closure", "walk_validation", "gfa_export", "gfa_graph_metrics"])
def test_f6_f8_f9_f10_f17_atoms_are_not_broadcast(spark, name):
    # what the graph's pieces meet in is sorted; one row of totals may be sent
    plan = plan_of(spark, name)
    assert "BroadcastHashJoin" not in plan


def test_f4_f5_f7_runs_stay_inside_their_text(spark):
    from strandlake.functions import softmask as sm

    rows = [("abCDe",), ("",), (None,), ("XYZ",), ("éaB",)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    got = df.select(sm.lower_runs(df.t).alias("r"), sm.run_summary(df.t).alias("s"), sm.lowered_like(sm.F.upper("t"), df.t).alias("f"), sm.lowered_like(sm.F.reverse(sm.F.upper("t")), df.t, turned=True).alias("b"), sm.mirrored(sm.lower_runs(df.t), sm.F.length("t")).alias("m")).collect()
    assert [None if g.r is None else [tuple(x) for x in g.r] for g in got] == [[(0, 2), (4, 5)], [], None, [], [(1, 2)]]
    assert [tuple(g.s) for g in got] == [(2, 3, 2, 0), (0, None, None, None), (0, None, None, None), (0, None, None, None), (1, 1, 1, 1)]
    assert [g.f for g in got] == ["abCDe", "", None, "XYZ", "ÉaB"] and [g.b for g in got] == ["eDCba", "", None, "ZYX", "BaÉ"]
    assert [None if g.m is None else [tuple(x) for x in g.m] for g in got] == [[(0, 1), (3, 5)], [], None, [], [(1, 2)]]


@pytest.mark.parametrize("name", ["softmask_intervals", "softmask_restore", "softmask_texts"])
def test_f4_f5_f7_no_run_travels(spark, name):
    from strandlake.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "_runs(" not in plan


def test_f16_short_pairs_together_as_alone():
    import random

    from strandlake.functions.align import align_all, global_align

    rng = random.Random(3)
    dna = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    pairs = [(dna(rng.randrange(0, 9)), dna(rng.randrange(0, 9))) for _ in range(1500)]
    for _ in range(300):  # near copies, with gaps
        x = dna(rng.randrange(20, 26))
        at, n = rng.randrange(15), rng.randrange(6)
        pairs.append((x, x[:at] + x[at + n :] + dna(rng.randrange(3))))
    pairs.append((dna(200), dna(150)))
    for band in (None, 3):
        assert align_all(pairs, band) == [global_align(r, q, band=band) for r, q in pairs]


def test_f22_no_frame_shrinks(spark, tmp_path):
    assert "unboundedfollowing" not in plan_of(spark, "surrounding_segments").lower().replace("$", "")
    ours, theirs = both(spark, tmp_path, "surrounding_segments", lineitem=lines(l_partkey=[10, 10, 11, 700, 1999], l_suppkey=[0, 1, 1, 1, 9]))
    assert ours == theirs


def test_f13_hits_are_counted_not_listed(spark, tmp_path):
    assert "collect_list" not in plan_of(spark, "anchor_validation")
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(60)
    texts = ["ACGTACGTTGCAACGTACGTGGGGGTTTTTACCA", "TGGTAAAAACCCCCACGTACGTTGCAACGTACGT", "AATTAATTAATTAATTAATTAATT", "AAAAAAAAAACCCCCCCCCC", None, ""] * 10
    ours, theirs = both(spark, tmp_path, "anchor_validation", documents=docs.assign(doc_id=range(60), text=texts))
    assert ours == theirs and len(ours) > 3


@pytest.mark.parametrize("name", ["base_vote", "maf_emitted_blocks"])
def test_f30_f43_cells_do_not_travel(spark, name):
    plan = plan_of(spark, name)
    assert "posexplode" not in plan and "hashpartitioning(block" in plan


def test_f30_f43_ragged_rows(spark):
    from strandlake.operators import columns, paths

    rows = spark.createDataFrame([(1, 0, "aC-G"), (1, 1, "CC"), (2, 0, "A-"), (2, 1, "-A"), (3, 0, "--"), (4, 0, None)], "block long, row long, aligned string")
    assert sorted(map(tuple, columns.base_vote(rows).collect())) == [(1, 0, "A"), (1, 1, "C"), (1, 2, "N"), (1, 3, "G"), (2, 0, "A"), (2, 1, "A"), (3, 0, "N"), (3, 1, "N")]
    assert [r.block for r in paths.multi_occurrence(rows).collect()] == [1]
