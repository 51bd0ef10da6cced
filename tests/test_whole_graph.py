"""Graph queries read every feature of every image set: against brute force on a table of two sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmosaic.operators import cluster as K
from vecmosaic.operators import faces as X
from vecmosaic.operators import graph as G
from vecmosaic.plans import catalog
from vecmosaic.plans.graphs import SET, pruned

N = 260


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(13, 64))
    vec = centre[np.arange(N) % 13] + 0.3 * rng.normal(size=(N, 64))
    rows = [(i, i % 4, v.tolist()) for i, v in enumerate(vec)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return str(at), vec


def pruned_by_hand(vec):
    """Each set's edges by its own largest cosine and its own threshold."""
    out = {}
    for first in range(0, len(vec), SET):
        unit = vec[first : first + SET] / np.linalg.norm(vec[first : first + SET], axis=1, keepdims=True)
        dots = unit @ unit.T
        w = 1 - np.arccos(np.clip(dots / dots.max(), -1, 1)) / np.pi
        np.fill_diagonal(w, 0)
        t = next(t for t in (1 + k * -1.0 / 599 for k in range(600)) if (w > t).sum() >= 2.5 * 2 * len(w))
        out |= {(i + first, j + first): w[i, j] for i, j in zip(*np.nonzero((w > t) & (w != 1)), strict=True)}
    return out


def test_a_second_set_leaves_the_first_alone(spark):
    """Edges, thresholds and modularity of a set don't change with the sets beside it."""
    rng = np.random.default_rng(12)
    one, other = rng.normal(size=(60, 8)), rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(90, 8))  # near copies
    rows = [(i, 0, v.tolist()) for i, v in enumerate(one)] + [(1000 + i, 1, v.tolist()) for i, v in enumerate(other)]
    both = spark.createDataFrame(rows, "feature_id long, set_id long, descriptor array<double>")
    part = both.select(F.col("feature_id").alias("vertex"), (F.col("set_id") * 10 + F.col("feature_id") % 3).alias("cluster"))

    def results(f):
        e = G.weights(G.angle_distances(f, "set_id"))
        n = G.vertex_counts(f, "set_id")
        kept = G.prune_threshold(e, n, 2.5, by="set_id")
        alike = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.where("set_id = 0").collect()}
        return [alike(x) for x in (e, G.edge_threshold(e, n, 2.5, by="set_id"), kept, G.prune_fraction(e, n, 0.05, by="set_id"), G.prune_rows(e, 0.3, by="set_id"), G.modularity(kept, part, "set_id"))]

    alone = results(both.where("set_id = 0"))
    assert results(both) == alone and all(len(x) for x in alone)
    e = G.weights(G.angle_distances(both.where("set_id = 0").drop("set_id")))
    assert {(r.src, r.dst) for r in G.prune_threshold(e, G.vertex_counts(both.where("set_id = 0")), 2.5).collect()} == {(x[0], x[1]) if isinstance(x[2], float) else (x[1], x[2]) for x in alone[2]}


def test_pruned_graph_of_all_features(spark, small):
    at, vec = small
    want = pruned_by_hand(vec)
    got = {(r.src, r.dst): r.w for r in pruned(spark, at).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_queries_reach_features_beyond_the_twins_group(spark, small):
    at, vec = small
    near = pruned_by_hand(vec)
    src, dst = np.array(sorted(near)).T
    w = np.array([near[k] for k in sorted(near)])
    component = {v: v for v in np.unique(src).tolist()}
    while any(component[a] != component[b] for a, b in near):
        for a, b in near:
            component[a] = min(component[a], component[b])
    want = {}
    for c in set(component.values()):
        own = np.array([component[v] == c for v in src.tolist()])
        ids = np.unique(src[own])
        total = w[src // SET == ids[0] // SET].sum()
        want |= dict(zip(ids.tolist(), K.louvain_kernel(ids, src[own], dst[own], w[own], total).tolist(), strict=True))
    assert max(want) >= SET
    q = catalog.queries()
    assert {r.vertex: r.cluster for r in q["GM9_louvain"](spark, at).collect()} == want
    for name in ("GM12_split_large_clusters", "GM29_spin_glass"):
        assert {r.vertex for r in q[name](spark, at).collect()} == set(want), name
    assert all(r.modularity > 0.5 for r in q["GM9_louvain_modularity"](spark, at).collect())
    for name in ("GM16_cluster_match", "BD4_spectral_over_clusters"):
        assert max(max(r.i, r.j) for r in q[name](spark, at).collect()) >= 200, name
    for name in ("BD2_cluster_benchmark", "AG33_mutual_information"):
        assert q[name](spark, at).count() > 0, name


def test_svm_counts_every_row_of_every_label(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, 0, (rng.normal(size=6) + 5 * np.eye(6)[i % 4]).tolist()) for i in range(130)]
    df = spark.createDataFrame(rows, "id long, label int, grp int, vec array<double>")
    got = X.svm_grid(df, [1.0], [None, 0.5], 3, max_rows=40).collect()
    assert len(got) == 2 and all(r.tp + r.fp == 130 and r.tp > 100 for r in got)


def test_svm_queries_count_the_whole_table(spark, small):
    r = catalog.queries()["CL2_svm_linear"](spark, small[0]).first()
    assert r.tp + r.fp == N


def test_spin_glass_anneals_large_components(spark):
    n = 4200
    edges = spark.createDataFrame([(i, (i + s) % n, 1.0) for i in range(n) for s in (1, n - 1)], "src long, dst long, w double")
    got = K.spin_glass(edges, k=6, sweeps=2).collect()
    assert len(got) == n and len({r.cluster for r in got}) <= 6
