"""Registered queries against their SQL twins on the small tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from dataclasses import replace  # noqa: E402

from vecmosaic.operators import match as M  # noqa: E402
from vecmosaic.operators.knn import KnnOptions, knn_join  # noqa: E402
from vecmosaic.plans import catalog, clusters, matching  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
SAMPLE = ["JN1_knn_exact_all", "JN3_knn_grid", "JN5_ratio_target_against_query", "JN7_mirror_match", "JN10_mutual_nearest", "JN17_band_join", "JN18_two_hop_verification", "AG29_precision_recall", "GM5_prune_threshold", "GM13_community_matches", "AG9_norm_scores", "FX6_lbp_original", "CL6_leave_one_out", "components"]


#: Queries on the neighbour join that are run as for targets which no worker holds.
LARGE = ["AG9_norm_scores", "JN5_ratio_target_against_query", "WN1_rank_within_query", "GM22_iso_match", "JN6_symmetric_dedupe", "AG31_false_positives_removed", "PF3_threshold_filter", "BD6_standard_match", "AG8_normalize_matches", "GM37_homography_errors", "AG11_normalize_scores"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_twin(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sql.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def dealt(spark):
    """Rows that the stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("name", LARGE)
def test_large_query_copies_no_rows(spark, sql, name, monkeypatch):
    """Where no worker holds the targets the rows are the twin's, or those of the other path, and shuffles grow with the table, not with its blocks."""
    run = catalog.queries()[name]
    twin = sql.sql(catalog.oracle_sql()[name]) if name in catalog.oracle_sql() else None
    cols = sorted(run(spark, SF).columns)
    rows = lambda df: sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = rows(run(spark, SF)) if twin is None else sorted(tuple(plain(r[twin.columns.index(c)]) for c in cols) for r in twin.fetchall())
    for module in (M, clusters, matching):
        monkeypatch.setattr(module, "knn_join", lambda f, targets=None, options=KnnOptions(): knn_join(f, targets, replace(options, strategy="grid", block=8)))
    n, before = spark.read.parquet(f"{SF}/embeddings.parquet").count(), dealt(spark)
    assert rows(run(spark, SF)) == want
    assert sum(v for k, v in dealt(spark).items() if k not in before) <= 32 * n


def plans(spark):
    """The plans run so far by the numbers of their executions."""
    all_ = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {e.executionId(): e.physicalPlanDescription() for e in (all_.apply(i) for i in range(all_.size()))}


def test_sql_neighbours_join_no_pairs_row_by_row(spark, sql):
    """The rows are the twin's, and no plan compares every row with every other one by one."""
    before = plans(spark)
    got = sorted(tuple(plain(v) for v in r) for r in catalog.queries()["JN3_knn_sql"](spark, SF).select("q", "qi", "r", "t", "ti", "d").collect())
    new = [v for k, v in plans(spark).items() if k not in before]
    assert new and not any("CartesianProduct" in v or "NestedLoopJoin" in v for v in new)
    assert got == sorted(tuple(plain(v) for v in r) for r in sql.sql(catalog.oracle_sql()["JN3_knn_sql"]).fetchall())


def test_every_twin_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and catalog.FLAGSHIP in catalog.queries()
