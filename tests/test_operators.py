"""Fixtures with values worked out by hand, and properties."""

import glob
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecmosaic.functions import vectors as V
from vecmosaic.operators import cluster as K
from vecmosaic.operators import faces as X
from vecmosaic.operators import geometry as G
from vecmosaic.operators import graph as Gr
from vecmosaic.operators import images as I
from vecmosaic.operators import match as M
from vecmosaic.operators import scores as S
from vecmosaic.operators.components import connected_components
from vecmosaic.operators.knn import KnnOptions, _Nearest, knn_join, radius_counts, stream_knn
from vecmosaic.operators import spectral as Sp
from vecmosaic.operators.passes import stored
from vecmosaic.operators.spectral import affinity_simple, spectral_match
from vecmosaic.session import shared_dir
from vecmosaic.sources import files


@pytest.fixture
def five(spark):
    rows = [(0, 0, [0.0, 0.0]), (1, 0, [10.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [10.0, 2.0]), (4, 1, [4.0, 0.0])]
    return spark.createDataFrame([(i, im, *v, v) for i, im, v in rows], "feature_id long, image_id int, x double, y double, descriptor array<double>")


def test_mirror_matches(five):
    got = {(r.i, r.j): (r.score, round(r.ratio, 6)) for r in M.mirror_match(five).collect()}
    assert got == {(0, 2): (1.0, 0.25), (1, 3): (2.0, 0.333333)}
    assert M.mirror_match(five, 0.3).count() == 1


def test_ratio_scopes(five):
    rows = {r.q: (r.t, round(r.ratio, 6)) for r in M.ratio_rows(five, M.RatioOptions("target", "target")).where("r = 1").collect()}
    assert rows == {0: (2, 0.25), 1: (3, 0.333333), 2: (0, 0.111111), 3: (1, 0.196116), 4: (0, 0.666667)}
    with pytest.raises(ValueError):
        M.ratio_rows(five, M.RatioOptions("query", "all"))


@pytest.mark.parametrize("rule", [r for r in M.RULES if M.RULES[r][0] != M.RULES[r][2]])
def test_ratio_rules_compare_each_pair_once(spark, rule, monkeypatch):
    """Two scopes are searched that share no pair, and the rows are those of two whole searches."""
    x = np.round(np.random.default_rng(10).normal(size=(90, 3)), 0)
    df = spark.createDataFrame([(i, 0 if i < 1 else 1 + i % 3, v.tolist()) for i, v in enumerate(x)], "feature_id long, image_id int, descriptor array<double>")
    asked = []
    monkeypatch.setattr(M, "knn_join", lambda f, targets=None, options=None: asked.append(options.scope) or knn_join(f, targets, options))
    rows = lambda s: {tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in M.ratio_rows(df, M.RatioOptions(*rule, KnnOptions(strategy=s))).collect()}
    got = rows("auto")
    assert sorted(asked) == ["other", "same"]
    assert got == rows("sql")


@pytest.mark.parametrize("strategy", ["block", "grid", "sql"])
def test_strategies_agree(spark, strategy):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, i % 3, rng.normal(size=8).tolist()) for i in range(120)], "feature_id long, image_id int, descriptor array<double>")
    rows = lambda s: [(r.q, r.r, r.t) for r in knn_join(df, options=KnnOptions(k=4, scope="other", strategy=s, block=50)).orderBy("q", "r").collect()]
    assert rows(strategy) == rows("auto")
    assert knn_join(df.limit(0), options=KnnOptions(strategy=strategy)).count() == 0


@pytest.mark.parametrize("scope,metric", [("all", "l2"), ("same", "l2"), ("other", "angle")])
def test_grid_copies_no_rows(spark, scope, metric):
    """Disk in proportion to the tables: every row is dealt out once, and the nearest are those of a full search."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "feature_id long, image_id int, descriptor array<double>")
    near = knn_join(df, options=KnnOptions(k=3, scope=scope, metric=metric, strategy="grid", block=16))
    assert "explode" not in near._jdf.queryExecution().toString().lower()
    d = np.arccos(np.clip(0.9999 * (x[:, None] * x[None]).sum(axis=2), -1, 1)) if metric == "angle" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    ok = {"all": lambda i, j: i != j, "same": lambda i, j: i != j and i % 4 == j % 4, "other": lambda i, j: i % 4 != j % 4}[scope]
    want = {(i, r, j) for i in range(300) for r, (_, j) in enumerate(sorted((d[i, j], j) for j in range(300) if ok(i, j))[:3], 1)}
    assert {(r.q, r.r, r.t) for r in near.collect()} == want


def test_grid_searches_once(spark):
    """However often a plan uses the neighbours, their search isn't part of it; no copy of the targets stays."""
    x = np.random.default_rng(5).normal(size=(200, 4))
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "feature_id long, image_id int, descriptor array<double>")
    before = set(glob.glob(f"{shared_dir(spark)}/vecmosaic/targets-*"))
    o = KnnOptions(k=2, strategy="grid", block=16)
    m = S.dense(S.pair_scores(M.mirror_match(df, 9.0, M.RatioOptions("all", "all", o))), df.select("image_id").distinct(), "score")
    assert "MapInArrow" not in S.norm_scores(m)._jdf.queryExecution().toString()
    assert set(glob.glob(f"{shared_dir(spark)}/vecmosaic/targets-*")) <= before
    search = stream_knn(df, 200, stored(df, "targets"), o)
    assert "explode" not in search._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("scope", ["same", "other"])
def test_images_are_rectangles_of_the_product(scope, monkeypatch):
    """No mask of single pairs: targets of the query's image are not multiplied or are left out by ranges, and queries in any order keep it."""
    x = np.round(np.random.default_rng(7).normal(size=(400, 3)), 1)
    ids, image = np.random.default_rng(8).permutation(400), np.arange(400) % 5
    sizes = []
    found = _Nearest._candidates
    monkeypatch.setattr(_Nearest, "_candidates", lambda self, left, right, *rest: sizes.append(len(left) * right.shape[1]) or found(self, left, right, *rest))
    near = _Nearest(ids, image, x, KnnOptions(k=3, scope=scope), 64)
    near.add(ids, image, x)
    assert sum(sizes) <= (400 * 80 if scope == "same" else 400 * 400) * 2
    q, qi, r, t, ti, _ = near.columns()
    assert q.tolist() == np.repeat(ids, 3).tolist() and r.tolist() == [1, 2, 3] * 400
    assert ((qi == ti) == (scope == "same")).all()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(400):
        ok = [j for j in range(400) if i != j and (image[i] == image[j]) == (scope == "same")]
        assert t[3 * i : 3 * i + 3].tolist() == [ids[j] for j in sorted(ok, key=lambda j: (d[i, j], ids[j]))[:3]]


@pytest.mark.parametrize("metric", ["l2", "angle"])
def test_sql_ranks_pairs_within_a_bound_only(spark, metric):
    """Few pairs are ranked, and ties, small images and vectors of other lengths keep their neighbours."""
    x = np.round(np.random.default_rng(6).normal(size=(150, 5)), 0)
    df = spark.createDataFrame([(i, 0 if i < 2 else 1 + i % 3, v.tolist()) for i, v in enumerate(x)], "feature_id long, image_id int, descriptor array<double>")
    rows = lambda f, s, scope: [(r.q, r.r, r.t, round(r.d, 9)) for r in knn_join(f, options=KnnOptions(k=3, scope=scope, strategy=s, metric=metric)).orderBy("q", "r").collect()]
    assert rows(df, "sql", "all") == rows(df, "block", "all") and rows(df, "sql", "same") == rows(df, "block", "same")
    near = knn_join(df, options=KnnOptions(k=3, strategy="sql", metric=metric))
    assert "explode" not in near._jdf.queryExecution().toString().lower()
    uneven = df.limit(4).withColumn("descriptor", F.when(F.col("feature_id") < 2, F.slice("descriptor", 1, 3)).otherwise(F.col("descriptor")))
    assert {(r.q, r.t) for r in knn_join(uneven, options=KnnOptions(k=1, scope="same", strategy="sql", metric=metric)).where("q < 2").collect()} == {(0, 1), (1, 0)}


@pytest.mark.parametrize("scope", ["all", "same", "other"])
def test_sql_keeps_rows_that_no_product_takes(spark, scope):
    """Nulls, infinite and very long vectors, ties, repeated ids and empty sides: the rows of all pairs ranked."""
    x = np.round(np.random.default_rng(11).normal(size=(120, 4)), 1).tolist()
    x[5][1], x[6][0], x[7][2], x[8] = None, float("nan"), float("inf"), [1e200, 0.0, -1e200, 3.0]
    df = spark.createDataFrame([(None if i == 10 else min(i, 117), None if i == 9 else i % 7, v) for i, v in enumerate(x)], "feature_id long, image_id int, descriptor array<double>")
    q, t = (df.select(F.col("feature_id").alias(k), F.col("image_id").alias(f"{k}i"), F.transform("descriptor", lambda c: F.coalesce(c, F.lit(float("nan")))).alias(f"{k}v")) for k in "qt")
    on = {"all": F.lit(True), "same": F.col("qi") == F.col("ti"), "other": F.col("qi") != F.col("ti")}[scope]
    want = q.crossJoin(t).where((F.col("q") != F.col("t")) & on).withColumn("d", V.euclidean(F.col("qv"), F.col("tv"))).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))).where("r <= 3")
    o = KnnOptions(k=3, scope=scope, strategy="sql")
    rows = lambda f: sorted((r.q, r.r, r.t, repr(r.d)) for r in f.collect())
    assert rows(knn_join(df, options=o)) == rows(want)
    assert knn_join(df, df.limit(0), o).count() == knn_join(df.limit(0), df, o).count() == 0


def test_radius_counts_by_the_shared_folder(spark):
    x = np.random.default_rng(4).normal(size=(200, 3))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "feature_id long, image_id int, descriptor array<double>")
    got = radius_counts(df, 1.0, KnnOptions(broadcast_bytes=1, block=32))
    assert "explode" not in got._jdf.queryExecution().toString().lower()
    want = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 1.0).sum(axis=1)
    assert {r.feature_id: r.group_size for r in got.collect()} == dict(enumerate(want.tolist()))


def test_transfer_error(spark):
    h = [1.0, 0, 5, 0, 1, -3, 0, 0, 1]
    df = spark.createDataFrame([(1.0, 1.0, 6.0, -2.0), (1.0, 1.0, 9.0, 2.0)], "x1 double, y1 double, x2 double, y2 double")
    assert [r.error for r in G.with_errors(df, h).collect()] == [0.0, 10.0]
    assert G.crop_homography([1, 0, 0, 0, 1, 0, 0, 0, 1], 10, 20, 4, 5, 1.0) == [1, 0, 6, 0, 1, 15, 0, 0, 1]


def test_views_against_brute_force(spark):
    """Two-hop and three-view verification make no row for a pair of a line and a point."""
    fs = [[0.0, -0.001, 0.3, 0.0012, 0.0, -0.5, -0.28, 0.45, 1.0], [0.0, -0.0008, 0.2, 0.001, 0.0, -0.4, -0.25, 0.35, 2.0], [0.0, -0.0011, 0.25, 0.0009, 0.0, -0.35, -0.2, 0.4, 1.5]]
    p = np.random.default_rng(8).uniform(0, 1000, (240, 2))

    def far(f, i, j):
        a, b, c = (f[3 * k] * p[i, 0] + f[3 * k + 1] * p[i, 1] + f[3 * k + 2] for k in range(3))
        return abs(a * p[j, 0] + b * p[j, 1] + c) / math.hypot(a, b)

    views = [spark.createDataFrame([(i, *p[i].tolist()) for i in range(s, s + 80)], "id long, x double, y double") for s in (0, 80, 160)]
    want = {(a, c) for a in range(80) for c in range(160, 240) if far(fs[0], a, c) < 40 and any(far(fs[1], a, b) < 40 and far(fs[2], b, c) < 40 for b in range(80, 160))}
    got = G.three_view(*views, *fs, 40.0)
    assert "join" not in got._jdf.queryExecution().toString().lower()
    assert 0 < len(want) == got.count() and {(r.a, r.c) for r in got.collect()} == want
    one = G.three_view(*views, *fs, 40.0, once=True).collect()
    assert sorted(r.a for r in one) == sorted({a for a, _ in want}) and {(r.a, r.c) for r in one} <= want

    rows = [(a, *p[a].tolist(), c, *p[c].tolist(), a % 2) for a in range(80) for c in range(160, 240, 7)]
    matches = spark.createDataFrame(rows, "a long, ax double, ay double, c long, cx double, cy double, view int")
    seen = views[1].withColumn("view", (F.col("id") % 2).cast("int"))
    got = G.two_hop(matches, seen, *fs, 40.0, "view")
    assert "join" not in got._jdf.queryExecution().toString().lower()
    errors = {(r.a, r.c): r.error for r in got.collect()}
    assert len(errors) == len(rows)
    for a, *_, c, _, _, view in rows:
        d = far(fs[0], a, c)
        hop = [far(fs[2], b, c) for b in range(80, 160) if b % 2 == view and far(fs[1], a, b) < 40]
        assert abs(errors[a, c] - (max(d, min(hop)) if d < 40 and hop else d)) < 1e-9


def test_homography_and_fundamental_fits():
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 500, (60, 2))
    h = np.array([[1.1, 0.1, 4], [-0.05, 0.95, 7], [1e-4, 2e-4, 1]])
    w = np.c_[p, np.ones(60)] @ h.T
    q = w[:, :2] / w[:, 2:]
    q[:15] += 100
    got, inside = G.fit_homography(p, q)
    assert inside.sum() == 45 and np.allclose(got, h, atol=1e-6)
    z = rng.uniform(2, 6, 60)
    a, b = p / 500, None
    point = np.c_[(a - 0.5) * z[:, None], z]
    turn = np.array([[math.cos(0.1), 0, math.sin(0.1)], [0, 1, 0], [-math.sin(0.1), 0, math.cos(0.1)]])
    second = point @ turn.T + [0.5, 0.1, 0]
    x, u = point[:, :2] / point[:, 2:] * 500, second[:, :2] / second[:, 2:] * 500
    f = G.fit_fundamental(x, u)
    assert f is not None and np.abs((np.c_[u, np.ones(60)] @ f * np.c_[x, np.ones(60)]).sum(axis=1)).max() < 1e-6
    del b


def test_modularity_of_two_triangles(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    edges = spark.createDataFrame([(a, b, 1.0) for x in pairs for a, b in (x, x[::-1])], "src long, dst long, w double")
    part = spark.createDataFrame([(v, v // 3) for v in range(6)], "vertex long, cluster long")
    assert round(Gr.modularity(edges, part).first()[0], 10) == 0.3571428571
    got = {}
    for r in K.louvain(edges).collect():
        got.setdefault(r.cluster, set()).add(r.vertex)
    assert sorted(map(sorted, got.values())) == [[0, 1, 2], [3, 4, 5]]
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + k) for k in range(50)] + [(200, 200), (None, 5)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + k: 100 for k in range(51)}}


def test_distances(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 2.0, 1.0])], "p array<double>, q array<double>")
    want = {"euclidean": 2.236068, "cosine": -0.8017837, "correlation": 1.8660254, "chi_square": 1.3333333, "intersection": 4, "bin_ratio": 10.9166667, "l1_bin_ratio": 10.1666667, "chi_square_bin_ratio": 4.4722222}
    got = row.select(*[f(F.col("p"), F.col("q")).alias(n) for n, f in V.DISTANCES.items()]).first().asDict()
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_lbp_code():
    assert I.lbp_original(np.array([[5, 9, 1], [4, 4, 6], [7, 2, 3]], dtype=float)).tolist() == [[211.0]]


def test_soft_f1_and_pair_scores(spark):
    m = lambda v: spark.createDataFrame([(i, j, v[i][j]) for i in range(2) for j in range(2)], "i int, j int, v double")
    r = S.soft_f1(m([[1.0, 0.5], [0.5, 1.0]]), m([[1.0, 1.0], [1.0, 1.0]])).first()
    assert (r.precision, r.recall, round(r.f1, 6)) == (1.0, 0.75, 0.857143)
    matches = spark.createDataFrame([(0, 1, 0.25), (0, 1, 0.5), (0, 1, 1.5)], "im_i int, im_j int, ratio double")
    assert sorted(map(tuple, S.pair_scores(matches).collect())) == [(0, 1, 4.0, 2), (1, 0, 4.0, 2)]


def test_affinity_certainty_and_geometry(spark):
    r = spark.range(1).select(affinity_simple(F.lit(5.0), F.lit(10.0)).alias("a"), Gr.certainty(F.lit(10.0)).alias("c"), Gr.certainty(F.lit(20.0)).alias("d"), Gr.geometry_multiplier(F.lit(6.0)).alias("g")).first()
    assert (round(r.a, 3), r.c, r.d, r.g) == (4.495, 0.75, 1.0, 0.5)


def test_spectral_selection_without_the_matrix(spark, monkeypatch):
    p = np.random.default_rng(11).uniform(0, 400, (90, 4))
    rows = [(k % 2, 1000 + k, *v.tolist(), 0.1 + k / 100) for k, v in enumerate(p)]
    m = spark.createDataFrame(rows, "pair long, id long, x1 double, y1 double, x2 double, y2 double, score double")
    pick = lambda n: {(r.id, round(r.x, 9)) for r in spectral_match(m, rounds=5, dense_entries=n).collect()}
    want = pick(10**6)
    made = []
    monkeypatch.setattr(Sp, "affinities", lambda matches, *a, whole=Sp.affinities: made.append(matches.count()) or whole(matches, *a))
    assert len(want) == 44 and pick(100) == want
    assert made == [0]  # no entry of the matrix is made


def test_greedy_distinct_matches(spark):
    rows = [(1, 1, 0, 1, 0.0, 0.0, 0.0, 0.0), (2, 2, 0, 1, 3.0, 0.0, 3.0, 0.0), (3, 3, 0, 1, 3.0, 0.0, 30.0, 0.0)]
    df = spark.createDataFrame(rows, "i long, j long, im_i int, im_j int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.i for r in M.distinct_matches(df, 5.0).collect()) == [1, 3]


def test_isodata_finds_groups(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal((20 * k, 30 * (k % 2)), 1.0, (80, 2)) for k in range(3)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    out = K.isodata(df, K.IsodataOptions(k_init=6, max_iterations=6, min_size=5, max_sd=5.0, min_distance=8.0)).collect()
    label = {r.id: r.cluster for r in out}
    assert len({(label[i], i // 80) for i in range(240)}) == 3


def test_faces(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, i % 4, (rng.normal(size=6) + 4 * np.eye(6)[i % 3]).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label int, grp int, vec array<double>")
    assert X.accuracy(X.k_fold(df, 5, 3)).first().accuracy > 0.9
    assert len(X.lda(df).basis) == 2 and len(X.fisherfaces(df).basis) == 2
    model = X.pca(df, 6)
    x = np.stack([r[3] for r in rows])
    assert np.allclose(sorted(model.values), sorted(np.linalg.eigvalsh(np.cov(x.T, bias=True))))
    best = X.best_setting(X.svm_grid(df, [1.0, 4.0], [None, 0.5], 3)).first()
    assert best.tp > 80


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[r].astype(np.uint8).tobytes() for r in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder_and_face_labels(spark, tmp_path):
    rng = np.random.default_rng(1)
    for k, name in enumerate(["ann", "bob"]):
        png(tmp_path / "faces" / name / "1.png", rng.integers(0, 256, (12, 10, 3)) * (k + 1) // 2)
    (tmp_path / "faces" / "bob" / "broken.png").write_bytes(b"no image")
    got = files.face_folder(files.read_images(spark, str(tmp_path / "faces"))).orderBy("label").collect()
    assert [(r.name, r.label, r.height, r.width) for r in got] == [("ann", 0, 12, 10), ("bob", 1, 12, 10)]
    assert min(got[0].pixels) == 0 and max(got[0].pixels) == 255


def test_keypoint_and_homography_files(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.key").write_text("2 4\n1 2 3 0.5\n3 4 0 0\n5 6 7 0.1\n0 0 0 2\n")
    got = files.read_keypoints(spark, str(tmp_path / "k"), 4).orderBy("feature_id").collect()
    assert [(r.row, r.col, r.scale, r.descriptor) for r in got] == [(1, 2, 3, [0.6, 0.8, 0, 0]), (5, 6, 7, [0, 0, 0, 1])]
    with pytest.raises(Exception, match="descriptor width"):
        files.read_keypoints(spark, str(tmp_path / "k"), 128).collect()
    h = [1.0, 0.5, 3.0, 0.0, 1.0, -2.0, 0.0, 1e-4, 1.0]
    files.write_homographies(spark.createDataFrame([("p", h)], "name string, h array<double>"), str(tmp_path / "h"))
    assert files.read_homographies(spark, str(tmp_path / "h") + "/*").first().h == h
    (tmp_path / "f.csv").write_text("a/1.png;3;1\n")
    assert tuple(files.read_face_csv(spark, str(tmp_path / "f.csv")).first()) == ("a/1.png", 3, 1)


def test_model_round_trip(spark, tmp_path):
    model = X.Subspace((1.0, 2.0), ((0.6, 0.8), (0.8, -0.6)), (3.0, 1.0))
    files.write_model(model, spark, str(tmp_path / "m"))
    assert files.read_model(spark, str(tmp_path / "m")) == model


def test_unknown_features_are_refused(spark):
    df = spark.createDataFrame([], I.IMAGE)
    for kind in I.DETECTORS:
        assert I.features_of(df, kind).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        I.features_of(df, "HARRIS", "SURF")
    with pytest.raises(ValueError, match="unknown"):
        I.features_of(df, "nothing")


def test_contracted_images_meet_at_one_root(spark):
    from vecmosaic.operators.stitch import contract

    shift = lambda d: [1.0, 0.0, float(d), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    at = [0.0, 10.0, 25.0, 27.0]
    edges = [(a, b, n, shift(at[b] - at[a])) for a, b, n in ((0, 1, 9), (1, 2, 20), (2, 3, 5), (0, 3, 4))]
    got = contract(spark.createDataFrame(edges, "src long, dst long, n long, h array<double>")).collect()
    assert {r.root for r in got} == {0}
    assert {r.image: round(r.h[2], 6) for r in got} == {i: -x + 0.0 for i, x in enumerate(at)}


def test_stream_of_new_features(spark, five, tmp_path):
    from vecmosaic.streaming import match_stream

    five.where("feature_id < 2").write.parquet(str(tmp_path / "in"))
    seen = []
    q = match_stream(spark.readStream.schema(five.schema).parquet(str(tmp_path / "in")), five, lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"), KnnOptions(k=1))
    q.processAllAvailable()
    q.stop()
    assert {(r.q, r.t) for r in seen} == {(0, 2), (1, 3)}


def test_components_in_small_chunks(spark):
    """Hubs, chains and random pairs, with so few pairs in a chunk that everything takes several rounds."""
    rng = np.random.default_rng(8)
    edges = [(500, int(v)) for v in range(1, 400)] + [(int(a), int(b)) for a, b in rng.integers(600, 900, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    order = (2000 + rng.permutation(300)).tolist()
    edges += list(zip(order, order[1:], strict=False)) + [(3999, v) for v in range(3500, 3999)] + [(600, 601)] * 50
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows, chunk in ((16, 8), (16, 40), (10_000, 1 << 19)):
            spark.conf.set(size, rows)
            got = connected_components(df, chunk=chunk).collect()
            assert len(got) == len(want) and {r.vertex: r.component for r in got} == want
    finally:
        spark.conf.set(size, before)
    assert connected_components(df.limit(0)).count() == 0


def test_clusters_of_each_image_pair_alone(spark):
    """Every pair's clusters are those of its own points, and its links those by their own counts."""
    rng = np.random.default_rng(21)
    rows = []
    for a, b in ((0, 1), (0, 2), (1, 2)):
        for k in range(60):
            spot = rng.integers(0, 3)
            rows.append((a, b, 1000 * a + k, 1000 * b + k, *(200.0 * spot + rng.normal(0, 9, 2)), *(300.0 * (spot if k % 7 else rng.integers(0, 3)) + rng.normal(0, 9, 2))))
    m = spark.createDataFrame([tuple(float(x) if i > 3 else int(x) for i, x in enumerate(r)) for r in rows], "im_i int, im_j int, i long, j long, x1 double, y1 double, x2 double, y2 double")
    o = K.IsodataOptions(k_init=5, max_iterations=5, min_size=4)
    points = m.select("im_i", "im_j", F.col("i").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    got = {(r.im_i, r.im_j, r.id): (r.cluster, round(r.dist, 6)) for r in K.isodata_groups(points, o, "im_i", "im_j").collect()}
    want = {}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        own = K.isodata(points.where(f"im_i = {a} and im_j = {b}"), o).collect()
        want |= {(a, b, r.id): (r.cluster, round(r.dist, 6)) for r in own}
    assert got == want
    linked = K.linked_clusters(m, o).collect()
    by = {}
    side2 = {(r.im_i, r.im_j, r.id): r.cluster for r in K.isodata_groups(m.select("im_i", "im_j", F.col("j").alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y")), o, "im_i", "im_j").collect()}
    for a, b, i, j, *_ in rows:
        by.setdefault((a, b, want[a, b, i][0], side2[a, b, j]), []).append((i, j))
    good = {k for k, v in by.items() if len(v) > 5 and len(v) > 0.5 * max(len(w) for q, w in by.items() if q[:3] == k[:3])}
    assert {(r.im_i, r.im_j, r.i, r.j) for r in linked} == {(*k[:2], *p) for k in good for p in by[k]} and len(linked) > 100

def test_fits_make_no_square_matrix_of_the_matches(monkeypatch):
    """Many inliers: the decomposition has nine columns, and the fit is the one that made the points."""
    svd, wide = np.linalg.svd, []
    monkeypatch.setattr(np.linalg, "svd", lambda a, *rest, **named: wide.append((u := svd(a, *rest, **named))[0].shape[1]) or u)
    p = np.random.default_rng(9).uniform(0, 1000, (500, 2))
    h = np.array([[1.01, 0.02, 5.0], [-0.01, 0.99, -3.0], [1e-5, -2e-5, 1.0]])
    q = np.c_[p, np.ones(500)] @ h.T
    q = q[:, :2] / q[:, 2:]
    got, inside = G.fit_homography(p, q, rounds=5)
    assert inside.all() and np.allclose(got, h, rtol=1e-5)
    assert G.fit_fundamental(p, q, rounds=5, limit=50.0) is not None
    assert max(wide) <= 9


def test_image_pairs_of_affinities_are_dealt_over_tasks(spark):
    """Matches are few bytes, but image pairs aren't put together in one task; the rows are the same."""
    x = np.random.default_rng(11).uniform(0, 300, (60, 5))
    df = spark.createDataFrame([(i % 6, i, *v) for i, v in enumerate(x.tolist())], "pair long, id long, x1 double, y1 double, x2 double, y2 double, score double")
    rows = lambda w: {(r.pair, r.a, r.b, round(r.w, 9)) for r in w.collect()}
    dealt = Sp.affinities(df, parts=16)
    assert rows(dealt) == rows(Sp.affinities(df))
    assert dealt.where("a <> b").select(F.spark_partition_id().alias("p")).distinct().count() > 1
