"""Scale-space and binary features find the same places again after turning and scaling an image."""

import numpy as np
import pytest

from vecmosaic.operators import boxes as B
from vecmosaic.operators import images as I
from vecmosaic.operators import keypoints as K
from vecmosaic.operators import rings as R
from vecmosaic.operators import stars as St


@pytest.fixture(scope="module")
def scene():
    """Blots and rectangles of several sizes on a soft ground."""
    rng = np.random.default_rng(3)
    ys, xs = np.mgrid[0:128, 0:128]
    x = 20 * np.sin(ys / 23.0) + 20 * np.cos(xs / 31.0)
    for _ in range(30):
        y, z, r = rng.uniform(15, 113), rng.uniform(15, 113), rng.uniform(2, 7)
        x += rng.choice([-90, 90]) * np.exp(-(((ys - y) / r) ** 2 + ((xs - z) / (r * rng.uniform(0.6, 1.6))) ** 2))
    for _ in range(12):
        y, z = rng.integers(10, 105, 2)
        x[y : y + rng.integers(5, 14), z : z + rng.integers(5, 14)] += rng.choice([-70, 70])
    return np.floor(255 * I.stretched(x))


def matched(a, b):
    """Pairs (i, j) of nearest descriptors clearly nearer than the second."""
    p, q = np.array([d for _, d in a]), np.array([d for _, d in b])
    d = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T, 0))
    order = np.sort(d, axis=1)
    return [(i, int(d[i].argmin())) for i in range(len(p)) if order[i, 0] < 0.8 * order[i, 1]]


def retinal(x):
    """Arcs with retinal bits."""
    found = I.peaks(I.fast_score(x), 0.0)
    return [(K.Keypoint(float(a), float(b), 1.0, 0.0, r), d) for (a, b, r), d in zip(found, R.retinal_bits(x, [(a, b) for a, b, _ in found]), strict=True)]


@pytest.mark.parametrize("find", [K.scale_space_features, K.binary_features, B.box_features, R.ring_features, retinal], ids=["scale-space", "binary", "boxes", "rings", "retina"])
def test_turned_image_has_the_same_features(scene, find):
    a, b = find(scene), find(np.rot90(scene).copy())
    pairs = matched(a, b)
    right = 0
    for i, j in pairs:
        y, x = 127 - a[i][0].x, a[i][0].y  # where the turn takes the point
        right += np.hypot(b[j][0].y - y, b[j][0].x - x) < 3
    assert len(a) >= 20 and len(pairs) >= 10 and right >= 0.8 * len(pairs)


@pytest.mark.parametrize("find", [K.scale_space_features, B.box_features], ids=["scale-space", "boxes"])
def test_shrunk_image_has_the_same_scale_space_features(scene, find):
    a, b = find(scene), find(K._shrunk(scene, 1.5))
    pairs = matched(a, b)
    good = [np.hypot(b[j][0].y * 1.5 - a[i][0].y, b[j][0].x * 1.5 - a[i][0].x) < 4 for i, j in pairs]
    assert len(pairs) >= 8 and np.mean(good) >= 0.7


def test_descriptors_are_normal_and_bits(scene):
    assert all(abs(np.linalg.norm(d) - 1) < 1e-9 and len(d) == 128 for _, d in K.scale_space_features(scene))
    assert all(set(np.unique(d)) <= {1.0, -1.0} and len(d) == 256 for _, d in K.binary_features(scene, oriented=False))
    assert K.scale_space_features(np.zeros((40, 40))) == K.binary_features(np.zeros((5, 5))) == []


def test_features_of_a_table(spark, scene):
    df = spark.createDataFrame([(3, 128, 128, scene.ravel().tolist())], I.IMAGE)
    for kind, size in (("SIFT", 128), ("SURF", 64), ("BRISK", 512), ("ORB", 256), ("BRIEF", 256)):
        rows = I.features_of(df, kind, max_kp=15).collect()
        assert len(rows) == 15 and all(r.image_id == 3 and len(r.descriptor) == size for r in rows)


def test_boxes_against_plain_sums():
    rng = np.random.default_rng(4)
    x = rng.random((40, 33))
    sums = B.integral(x)
    for y, z, h, w in ((0, 0, 5, 5), (10, 7, 3, 20), (-4, 30, 9, 9), (38, -3, 6, 5), (50, 2, 3, 3)):
        want = x[max(y, 0) : max(y + h, 0), max(z, 0) : max(z + w, 0)].sum()
        assert abs(B.box(sums, np.array(y), np.array(z), h, w) - want) < 1e-9
    got = B.determinant(sums, 9)
    y, z = 17, 14
    across = x[y - 2 : y + 3, z - 4 : z + 5].sum() - 3 * x[y - 2 : y + 3, z - 1 : z + 2].sum()
    down = x[y - 4 : y + 5, z - 2 : z + 3].sum() - 3 * x[y - 1 : y + 2, z - 2 : z + 3].sum()
    mixed = x[y - 3 : y, z + 1 : z + 4].sum() + x[y + 1 : y + 4, z - 3 : z].sum() - x[y - 3 : y, z - 3 : z].sum() - x[y + 1 : y + 4, z + 1 : z + 4].sum()
    assert abs(got[y, z] - (across * down - 0.81 * mixed**2) / 9**4) < 1e-12
    assert np.isinf(got[3]).all() and np.isfinite(got[4:36, 4:29]).all()
    assert B.box_features(np.zeros((60, 60))) == B.box_features(np.zeros((4, 4))) == []


def test_a_box_feature_lies_on_its_disc():
    ys, xs = np.mgrid[0:80, 0:80]
    x = np.where((ys - 41.0) ** 2 + (xs - 33.0) ** 2 <= 36, 200.0, 10.0)
    best = B.box_features(x)[0][0]
    assert np.hypot(best.y - 41, best.x - 33) < 1.5


def test_cascade_gives_the_neighbours_of_all_bits(scene):
    a, b = (np.array([d for _, d in retinal(x)]) for x in (scene, np.rot90(scene).copy()))
    assert a.shape[1] == len(R.retina_pattern().bits) >= 500 and len(a) > 60
    want = ((a.shape[1] - a @ b.T) / 2).argmin(axis=1)
    assert (R.cascade_nearest(a, b) == want).all()
    rng = np.random.default_rng(6)
    p, q = (np.where(rng.random((n, 512)) < 0.5, 1.0, -1.0) for n in (40, 300))
    q[100:200] = q[0]  # ties
    assert (R.cascade_nearest(p, q) == ((512 - p @ q.T) / 2).argmin(axis=1)).all()
    assert (R.cascade_nearest(p, q[:0]) == -1).all()


def test_ring_pairs_and_widths():
    p = R.ring_pattern()
    away = lambda pairs: np.sqrt(((p.places[pairs[:, 0]] - p.places[pairs[:, 1]]) ** 2).sum(axis=1))
    assert len(p.places) == 60 and len(p.bits) == 512 and away(p.bits).max() < 9.75 and away(p.directing).min() > 13.67
    r = R.retina_pattern()
    widths = r.widths[r.bits].sum(axis=1)
    assert (np.diff(widths) <= 1e-9).all() and len(r.places) == 43  # coarse to fine


def test_ring_features_at_another_scale(scene):
    a, b = R.ring_features(scene), R.ring_features(K._shrunk(scene, 1.5))
    pairs = matched(a, b)
    good = [np.hypot(b[j][0].y * 1.5 - a[i][0].y, b[j][0].x * 1.5 - a[i][0].x) < 5 for i, j in pairs]
    assert len(pairs) >= 4 and np.mean(good) >= 0.6


def test_diamonds_against_plain_sums():
    rng = np.random.default_rng(7)
    x = rng.random((17, 23))
    sums = St.slanted(x, 16)
    for radius in (0, 1, 4, 7):
        got = St.diamonds(sums, x.shape, 16, radius)
        for y, z in ((0, 0), (16, 22), (8, 11), (3, 20)):
            want = sum(x[b, d] for b in range(17) for d in range(23) if abs(b - y) + abs(d - z) <= radius)
            assert abs(got[y, z] - want) < 1e-9


def test_stars_lie_on_spots_and_not_on_lines():
    ys, xs = np.mgrid[0:90, 0:90]
    x = np.full((90, 90), 100.0)
    x[(ys - 30) ** 2 + (xs - 40) ** 2 <= 25] = 200
    x[(ys - 60) ** 2 + (xs - 30) ** 2 <= 49] = 10
    x[:, 70:73] = 220  # a line
    found = St.star_keypoints(x)
    assert {(round(p.y), round(p.x)) for p in found[:2]} == {(30, 40), (60, 30)}
    assert not any(67 <= p.x <= 75 and 20 <= p.y <= 70 for p in found)
    turned = St.star_keypoints(np.rot90(x).copy())
    assert sorted((89 - p.x, p.y, p.size) for p in found) == sorted((p.y, p.x, p.size) for p in turned)
    assert St.star_keypoints(np.zeros((40, 40))) == St.star_keypoints(np.zeros((3, 3))) == []
