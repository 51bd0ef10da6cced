import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmosaic.operators import images as I
from vecmosaic.operators import tiles as T


@pytest.fixture(scope="module")
def pictures():
    """Images of different sizes, one with an even area, one of a single line."""
    rng = np.random.default_rng(1)
    out = [rng.integers(0, 256, (37, 53)).astype(float), rng.integers(0, 256, (20, 20)).astype(float), rng.integers(0, 256, (64, 31)).astype(float), np.full((26, 41), 9.0), rng.integers(0, 256, (1, 30)).astype(float)]
    out[0][10:30, 5:40] = 40
    return dict(enumerate(out, 1))


@pytest.fixture(scope="module")
def table(spark, pictures):
    return spark.createDataFrame([(i, *x.shape, x.ravel().tolist()) for i, x in pictures.items()], "image_id long, height int, width int, pixels array<double>")


def pixels(df, digits=6):
    out = {}
    for r in T.long(df, digits).collect():
        assert (r.image_id, r.r, r.c) not in out
        out[r.image_id, r.r, r.c] = r.v
    return out


def expected(pictures, kernel, digits=6):
    return {(i, r, c): round(float(v), digits) + 0.0 for i, x in pictures.items() for (r, c), v in np.ndenumerate(kernel(x))}


def close(a, b, off=2e-6):
    assert a.keys() == b.keys() and all(abs(v - b[k]) <= off for k, v in a.items())


@pytest.mark.parametrize("tile", [7, 16, 200])
def test_results_agree_at_the_seams(table, pictures, tile):
    """For every size of tile each operator gives what its kernel gives for whole images."""
    some = {i: x for i, x in pictures.items() if min(x.shape) > 4}
    close(pixels(T.per_tile(T.tiles_of(table, tile, 1), I.lbp_original, (1,) * 4)), expected(some, I.lbp_original))
    close(pixels(T.per_tile(T.tiles_of(table, tile, 2), I.lbp_circular(2, 8), (2,) * 4)), expected(some, I.lbp_circular(2, 8)))
    wide = T.tiles_of(table, tile, 9)
    close(pixels(T.per_tile(wide, lambda x: I.gaussian(x, 2.0))), expected(pictures, lambda x: I.gaussian(x, 2.0)))
    close(pixels(T.illumination_normalized(wide)), expected(pictures, I.illumination_normalized()))
    close(pixels(T.face_normalized(wide.where("image_id <> 4"))), expected({i: x for i, x in pictures.items() if i != 4}, I.face_normalized()))
    plain = T.cores(T.tiles_of(table, tile, 0))
    close(pixels(plain), expected(pictures, lambda x: x))
    close(pixels(T.stretched(plain, plain)), expected(pictures, I.stretched))
    close(pixels(T.inverted(plain, plain)), expected(pictures, I.inverted))
    close(pixels(T.equalized(wide)), expected(pictures, I.equalized()))
    assert {r.image_id: (r.height, r.width, r.pixels) for r in T.assembled(plain).collect()} == {i: (*x.shape, x.ravel().tolist()) for i, x in pictures.items()}


@pytest.mark.parametrize("tile", [11, 200])
def test_table_wide_statistics_and_histograms(table, pictures, tile):
    plain = T.cores(T.tiles_of(table, tile, 0))
    every = np.concatenate([x.ravel() for x in pictures.values()])
    close(pixels(T.minmax(plain, -1.0, 1.0)), expected(pictures, lambda x: -1 + 2 * (x - every.min()) / (every.max() - every.min())))
    close(pixels(T.zscore(plain)), expected(pictures, lambda x: (x - every.mean()) / every.std()))
    codes = T.per_tile(T.tiles_of(table, tile, 1), I.lbp_original, (1,) * 4)
    got = {(r.image_id, r.cell * 256 + r.code): r.v for r in T.histograms(codes, 2, 3).collect()}
    want = {}
    for i, x in pictures.items():
        if min(x.shape) > 4:
            want |= {(i, k): v for k, v in enumerate(I.grid_histogram(I.lbp_original(x), 2, 3)[0]) if v}
    assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-12 for k, v in got.items())


def test_features_do_not_depend_on_the_tiles(table, pictures):
    for kind in ("HARRIS", "GFTT", "FAST", "DENSE"):
        got = [{r.feature_id: (r.image_id, r.x, r.y, round(r.response, 6), tuple(np.round(r.descriptor, 6))) for r in T.features(T.tiles_of(table, tile, 20), kind).collect()} for tile in (13, 200)]
        assert got[0] == got[1]
        whole = {(r.image_id, r.x, r.y, round(r.response, 6)) for r in I.features_of(table, kind).collect()}
        assert {x[:4] for x in got[0].values()} == whole and len(whole) > 20
    with pytest.raises(ValueError):
        T.features(T.tiles_of(table, 9, 9), "SIFT")


def test_tiles_from_patches(spark):
    """Patches in any order, with gaps, nulls and places outside, are the image they make."""
    rng = np.random.default_rng(2)
    x = {i: np.zeros((40, 28)) for i in (5, 9)}
    rows = []
    for i in x:
        for r in range(12):
            for c in range(8):
                if rng.random() < 0.8:
                    p = rng.integers(0, 9, (4, 4)).astype(float)
                    rows.append((i, r, c, p.ravel().tolist()))
                    if r < 10 and c < 7:
                        x[i][4 * r : 4 * r + 4, 4 * c : 4 * c + 4] = p
    x[7] = np.zeros((40, 28))
    rows += [(7, 0, 0, None), (7, -1, 0, [1.0] * 16), (7, 0, 1, [None] * 16)]
    patches = spark.createDataFrame(rows, "image_id long, row int, col int, pixels array<double>").repartition(5)
    for tile, halo in ((9, 0), (9, 5), (100, 3), (4, 20)):
        tiles = T.tiles_from_patches(patches, 4, 40, 28, tile, halo)
        assert tiles.count() == 3 * -(-40 // tile) * -(-28 // tile)
        assert pixels(T.cores(tiles)) == expected(x, lambda v: v)
        for r in tiles.collect():
            assert np.array_equal(np.reshape(r.pixels, (r.rows, r.cols)), x[r.image_id][r.top : r.top + r.rows, r.left : r.left + r.cols])
            assert r.top == max(0, r.core_top - halo) and r.left == max(0, r.core_left - halo)
    assert T.tiles_from_patches(patches.limit(0), 4, 40, 28, 9, 2).count() == 0


def test_crops_across_tiles(table, pictures):
    got = [{(r.image_id, r.crop): (r.left, r.top, round(r.total, 6)) for r in T.crops(T.cores(T.tiles_of(table, tile, 0)), 12, 4).collect()} for tile in (5, 100)]
    assert got[0] == got[1] and len(got[0]) == 16
    for (i, _), (left, top, total) in got[0].items():
        assert total == pictures[i][top : top + 12, left : left + 12].sum()


def test_no_images(table):
    none = T.tiles_of(table.limit(0), 9, 2)
    assert none.count() == 0 and T.minmax(T.cores(none), 0.0, 1.0).count() == 0 and T.zscore(T.cores(none)).count() == 0 and T.equalized(none).count() == 0
    null = T.cores(T.tiles_of(table.limit(1).withColumn("pixels", F.transform("pixels", lambda p: F.when(p > 100, p))), 9, 0))
    assert min(v for v in pixels(null).values()) == 0
