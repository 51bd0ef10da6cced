import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmosaic.operators import match as M
from vecmosaic.operators.balltree import BallOptions, ball_tree, neighbours_inside
from vecmosaic.operators.forest import ForestOptions, build_forest, forest_knn, visits
from vecmosaic.operators.knn import KnnOptions, _narrow, knn_join


def table(spark, x, images=3):
    return spark.createDataFrame([(i, i % images, v) for i, v in enumerate(x.tolist())], "feature_id long, image_id int, descriptor array<double>")


def clustered(n, dim=8, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 4, (centres, dim))[rng.integers(0, centres, n)] + rng.normal(0, 0.5, (n, dim))


def brute_tree(x, leaf):
    """(rows, radius, leaf) of every node by recursion over all rows."""
    out = {}

    def grow(node, rows):
        radius = np.sqrt(((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1)).max()
        out[node] = (sorted(rows), float(radius), len(rows) <= 2 * leaf)
        if len(rows) > 2 * leaf:
            dim = (x[rows].max(axis=0) - x[rows].min(axis=0)).argmax()
            order = sorted(rows, key=lambda i: (x[i, dim], i))
            grow(2 * node, order[: len(order) // 2])
            grow(2 * node + 1, order[len(order) // 2 :])

    grow(1, list(range(len(x))))
    return out


def top_most(nodes, radius):
    return {n for n, (_, r, last) in nodes.items() if (r < radius or last) and not any((nodes[n >> k][1] < radius) for k in range(1, n.bit_length()))}


@pytest.mark.parametrize("block", [10_000, 40])
def test_ball_tree_against_recursion(spark, block):
    x = clustered(400)
    x[50:90] = x[7]  # many equal rows
    want = brute_tree(x, 4)
    tree = ball_tree(table(spark, x), BallOptions(leaf=4, block=block))
    got = {r.node: r for r in tree.nodes.collect()}
    assert set(got) == set(want)
    assert all(got[n].n == len(rows) and abs(got[n].radius - r) < 1e-9 and got[n].is_leaf == last for n, (rows, r, last) in want.items())
    for radius in (0.0, 1.0, 1.7, 6.0, 100.0):
        want_nodes = top_most(want, radius)
        assert {r.node for r in tree.selected(radius).collect()} == want_nodes
        inside = {}
        for r in tree.members(radius).select("node", "feature_id").collect():
            inside.setdefault(r.node, []).append(r.feature_id)
        assert {n: sorted(v) for n, v in inside.items()} == {n: want[n][0] for n in want_nodes}


def test_ball_tree_from_a_sample_holds_every_row(spark):
    x = clustered(3000, seed=2)
    tree = ball_tree(table(spark, x), BallOptions(leaf=5, block=100, sample_rows=500))
    rows = tree.rows.select("leaf", "feature_id").collect()
    assert sorted(r.feature_id for r in rows) == list(range(3000))
    nodes = {r.node: r for r in tree.nodes.collect()}
    members = {}
    for r in rows:
        for k in range(r.leaf.bit_length()):
            members.setdefault(r.leaf >> k, []).append(r.feature_id)
    assert set(members) == set(nodes) and len(nodes) > 300
    for n, ids in members.items():
        p = x[ids]
        assert nodes[n].n == len(ids) and abs(nodes[n].radius - np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)).max()) < 1e-9
        assert nodes[n].is_leaf == (2 * n not in nodes) and (not nodes[n].is_leaf or len(ids) <= 10)
    assert ball_tree(table(spark, x).limit(0)).nodes.count() == 0


def test_large_ball_tree_has_the_halves_of_all_rows(spark):
    """Beyond the sample, too, a node's halves are those of all of its rows."""
    x = clustered(1500, seed=8)
    x[300:900] = x[7]  # far more equal rows than a bracket around the half has
    x[:, 2] = np.round(x[:, 2])
    want = brute_tree(x, 6)
    got = {r.node: r for r in ball_tree(table(spark, x), BallOptions(leaf=6, block=40, sample_rows=200)).nodes.collect()}
    assert set(got) == set(want)
    assert all(got[n].n == len(rows) and abs(got[n].radius - r) < 1e-9 and got[n].is_leaf == last for n, (rows, r, last) in want.items())


def test_matches_inside_nodes(spark):
    x = clustered(240, seed=3)
    f = table(spark, x)
    want = brute_tree(x, 4)
    out = set()
    for n in top_most(want, 1.6):
        ids = want[n][0]
        d = np.sqrt(((x[ids][:, None] - x[ids][None]) ** 2).sum(axis=2))
        near = {i: sorted((d[a, b], ids[b]) for b in range(len(ids)) if b != a) for a, i in enumerate(ids)}
        for i, found in near.items():
            if found and near[found[0][1]][0][1] == i and i % 3 < found[0][1] % 3:
                out.add((i, found[0][1], round(found[0][0], 9), round(found[0][0] / found[1][0], 9) if len(found) > 1 else None))
    assert len(out) > 20
    for block in (2048, 7):
        got = M.speed_match(f, M.SpeedOptions(leaf=4, radius=1.6, block=block))
        assert {(r.i, r.j, round(r.score, 9), None if r.ratio is None else round(r.ratio, 9)) for r in got.collect()} == out
    one = f.select(F.lit(1).cast("long").alias("node"), "feature_id", "image_id", "descriptor")
    exact = {(r.q, r.r, r.t) for r in knn_join(f, options=KnnOptions(k=2)).collect()}
    assert {(r.q, r.r, r.t) for r in neighbours_inside(one, 2, 50).collect()} == exact


def recall(got, exact):
    exact = {(r.q, r.t) for r in exact.collect()}
    return len(exact & {(r.q, r.t) for r in got.collect()}) / len(exact)


def test_forest_reaches_its_precision(spark):
    f = table(spark, clustered(4000, dim=16, centres=60, seed=4), images=5)
    for scope in ("all", "other"):
        o = KnnOptions(k=3, scope=scope)
        exact = knn_join(f, options=o)
        forest = build_forest(_narrow(f), _narrow(f), o, ForestOptions(sample_rows=1500, leaf=20))
        got = forest.search(_narrow(f), o)
        assert recall(got, exact) >= 0.9
        assert forest.checks < 0.5 * 4000
        assert sum(int(c.sum()) for c in forest.counts) == 4 * 4000
        truth = {(r.q, r.t): r.d for r in exact.collect()}
        assert all(abs(truth[r.q, r.t] - r.d) < 1e-9 for r in got.collect() if (r.q, r.t) in truth)


def test_forest_without_structure(spark):
    """Random directions: nearly every leaf has to be visited, and the precision still holds."""
    x = np.random.default_rng(5).normal(size=(1200, 32))
    f = table(spark, x)
    o = KnnOptions(k=3)
    assert recall(forest_knn(f, f, o, ForestOptions(block=300)), knn_join(f, options=o)) >= 0.9


def test_all_leaves_meet_every_query_once(spark):
    """A search of all leaves is the exact one, without a copy of a query for each leaf."""
    f = table(spark, clustered(500, seed=7), images=5)
    o = KnnOptions(k=3, scope="other")
    got = forest_knn(f, f, o, ForestOptions(leaf=20, precision=1.0))
    plan = got._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and "explode" not in plan.lower() and "Window" not in plan
    assert {(r.q, r.r, r.t) for r in got.collect()} == {(r.q, r.r, r.t) for r in knn_join(f, options=o).collect()}


def test_forest_of_few_or_equal_rows(spark):
    f = table(spark, np.zeros((300, 4)))
    got = forest_knn(f, f, KnnOptions(k=2), ForestOptions(leaf=8))
    assert {(r.q, r.r, r.t) for r in got.collect()} == {(i, r, t) for i in range(300) for r, t in enumerate([t for t in (0, 1, 2) if t != i][:2], 1)}
    assert forest_knn(f, f.limit(0), KnnOptions(k=2)).count() == 0
    assert forest_knn(f.limit(0), f, KnnOptions(k=2)).count() == 0
    odd = f.limit(3).unionByName(f.limit(1).withColumn("descriptor", F.lit(None).cast("array<double>")))
    assert forest_knn(odd, odd, KnnOptions(k=5)).count() == 6


def test_one_queue_over_all_trees(spark):
    """Leaves are visited by the distance of their cells, so no later leaf has a nearer branch in any tree."""
    x = clustered(600, seed=6)
    forest = build_forest(_narrow(table(spark, x)), _narrow(table(spark, x)), KnnOptions(k=1), ForestOptions(leaf=30, trees=3))
    for v in x[:20]:
        order = [(t, leaf) for t, leaf, _ in visits(forest.trees, forest.counts, v, float("inf"))]
        assert len(order) == len(set(order)) == sum(int((c > 0).sum()) for c in forest.counts)
        assert len({t for t, _ in order[:6]}) == 3
