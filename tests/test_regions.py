"""Component trees, stable regions and blobs against flood fills."""

import numpy as np

from vecmosaic.operators import images as I
from vecmosaic.operators import regions as R


def flood(mask):
    """Connected regions of a mask as sets of pixels."""
    left, out = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    while left:
        todo, region = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            region.add((y, x))
            for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(frozenset(region))
    return out


def pictures():
    rng = np.random.default_rng(1)
    out = [rng.integers(0, k, (h, w)) for k, h, w in ((2, 9, 9), (4, 12, 7), (9, 15, 15), (200, 10, 14), (1, 5, 5), (3, 1, 8), (5, 1, 1))]
    smooth = I.gaussian(rng.random((24, 24)), 2.0)
    return [*out, np.floor(255 * I.stretched(smooth)).astype(int)]


def test_tree_against_flood_fill_at_every_level():
    for x in pictures():
        tree = R.ComponentTree.of(x)
        want = {}
        for t in np.unique(x).tolist():
            for region in flood(x <= t):
                want.setdefault(region, t)
        got = sorted((int(t), int(a), *p.tolist()) for t, a, p in zip(tree.level, tree.area, tree.place, strict=True))
        assert got == sorted((t, len(r), sum(y for y, _ in r), sum(z for _, z in r)) for r, t in want.items())
        assert (tree.parent == -1).sum() == 1 and tree.area[tree.parent == -1][0] == x.size
        # the region next larger than each, by inclusion
        keys = {(t, len(r), sum(y for y, _ in r), sum(z for _, z in r)): r for r, t in want.items()}
        sets = [keys[int(t), int(a), *p.tolist()] for t, a, p in zip(tree.level, tree.area, tree.place, strict=True)]
        for k, r in enumerate(sets):
            above = [(len(s), s) for s in want if r < s]
            assert not above if tree.parent[k] < 0 else sets[tree.parent[k]] == min(above)[1]


def test_growth_against_flood_fill():
    for x in pictures():
        tree, delta = R.ComponentTree.of(x), 3
        for k, g in enumerate(tree.growth(delta)):
            region = next(r for r in flood(x <= tree.level[k]) if len(r) == tree.area[k] and sum(y for y, _ in r) == tree.place[k][0] and sum(z for _, z in r) == tree.place[k][1])
            around = next(r for r in flood(x <= tree.level[k] + delta) if region <= r)
            assert abs(g - (len(around) - len(region)) / len(region)) < 1e-12


def discs():
    ys, xs = np.mgrid[0:90, 0:110]
    x = np.full((90, 110), 140.0)
    for y, z, r, v in ((20, 20, 6, 30), (60, 30, 9, 60), (40, 80, 12, 230), (75, 90, 7, 20)):
        x[(ys - y) ** 2 + (xs - z) ** 2 <= r * r] = v
    return np.floor(I.gaussian(x, 1.0))


def test_stable_regions_and_blobs_are_the_discs():
    x = discs()
    found = R.stable_regions(x)
    for y, z, r in ((20, 20, 6), (60, 30, 9), (40, 80, 12), (75, 90, 7)):
        assert any(np.hypot(q.y - y, q.x - z) < 1 and abs(q.size - 2 * r) < 4 for q in found)
    dark = R.blobs(x)
    assert sorted((round(q.y), round(q.x)) for q in dark) == [(20, 20), (60, 30), (75, 90)]
    assert [q.response for q in dark] == sorted((q.response for q in dark), reverse=True)
    bright = R.blobs(255 - x)
    assert [(round(q.y), round(q.x)) for q in bright if q.size < 40] == [(40, 80)]


def test_stable_regions_turn_with_the_image():
    x = np.floor(255 * I.stretched(I.gaussian(np.random.default_rng(5).random((48, 48)), 2.5)))
    a, b = R.stable_regions(x), R.stable_regions(np.rot90(x).copy())
    assert len(a) > 5 and sorted((round(47 - q.x, 6), round(q.y, 6), round(q.size, 6)) for q in a) == sorted((round(q.y, 6), round(q.x, 6), round(q.size, 6)) for q in b)


def test_labels_against_flood_fill():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.6, 1.0):
        mask = rng.random((20, 17)) < share
        label = R.labelled(mask)
        assert {frozenset(map(tuple, np.argwhere(label == k).tolist())) for k in np.unique(label[mask]).tolist()} == set(flood(mask)) and (label[~mask] == -1).all()


def test_even_and_empty_images(spark):
    assert R.blobs(np.full((9, 9), 255.0)) == [] and R.stable_regions(np.zeros((30, 30))) == []
    assert [q.size for q in R.blobs(np.zeros((9, 9)))] == [2 * np.sqrt(81 / np.pi)]  # dark at every threshold
    df = spark.createDataFrame([(1, 90, 110, discs().ravel().tolist()), (2, 8, 8, [250.0] * 64)], I.IMAGE)
    for kind in ("MSER", "SIMPLEBLOB"):
        rows = I.features_of(df, kind).collect()
        assert {r.image_id for r in rows} == {1} and len(rows) >= 3 and all(len(r.descriptor) == 128 for r in rows)
