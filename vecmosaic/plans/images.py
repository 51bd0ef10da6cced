"""Queries over images put together from the feature table, and over file-layout expressions.

A feature's components are a patch of 8 x 8 pixels; the patches of 64 consecutive ids are an image.  So the images
grow in number with the table, and each is cut into tiles with halos that no query puts together but
those whose operator takes whole images.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vecmosaic.operators import images as I
from vecmosaic.operators import tiles as T
from vecmosaic.operators.tiles import long
from vecmosaic.plans.catalog import query
from vecmosaic.plans.geometry import H
from vecmosaic.sources import files as S
from vecmosaic.sources.tables import table

PATCH, GRID, TILE = 8, 8, 24
SIDE = PATCH * GRID
PIX = f"""px AS MATERIALIZED (SELECT i.image_id, r.range AS r, c.range AS c, coalesce(least(255, greatest(0, floor(128 + 400 * v[(r.range % {PATCH}) * {PATCH} + c.range % {PATCH} + 1]))), 0)::DOUBLE AS p
  FROM (SELECT DISTINCT vec_id // {GRID * GRID} AS image_id FROM embeddings) i CROSS JOIN range({SIDE}) r CROSS JOIN range({SIDE}) c
  LEFT JOIN (SELECT vec_id // {GRID * GRID} AS image_id, vec_id % {GRID * GRID} AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e ON e.image_id = i.image_id AND e.k = (r.range // {PATCH}) * {GRID} + c.range // {PATCH})"""


def patches(spark, sf):
    """(image_id, row, col, pixels): the features as patches of grey values from 0 to 255."""
    grey = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 400 * e).cast("double"))))
    at = F.col("vec_id") % (GRID * GRID)
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / (GRID * GRID)).alias("image_id"), F.floor(at / GRID).alias("row"), (at % GRID).alias("col"), grey.alias("pixels"))


def tiles(spark, sf, halo=0, tile=TILE):
    return T.tiles_from_patches(patches(spark, sf), PATCH, SIDE, SIDE, tile, halo)


def images(spark, sf):
    """Whole images, for operators that take them; they all have the same size."""
    return T.assembled(T.cores(tiles(spark, sf, 0, SIDE)))


def tiled(spark, sf, kernel, margin):
    return T.per_tile(tiles(spark, sf, margin), kernel, (margin,) * 4)


NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
LBP = f"""{PIX}, im AS (SELECT image_id, list(p ORDER BY r, c) AS a FROM px GROUP BY image_id),
lb AS (SELECT image_id, r, c, {' + '.join(f'{1 << (7 - k)} * (a[(r + {1 + dy}) * {SIDE} + c + {1 + dx} + 1] >= a[(r + 1) * {SIDE} + c + 2])::INTEGER' for k, (dy, dx) in enumerate(NEIGHBOURS))} AS code
  FROM im, (SELECT unnest(range({SIDE - 2})) AS r), (SELECT unnest(range({SIDE - 2})) AS c))"""


@query("FX6_lbp_original", f"WITH {LBP} SELECT image_id, r, c, code::DOUBLE AS v FROM lb")
def lbp(spark, sf):
    return long(tiled(spark, sf, I.lbp_original, 1))


def circle_sql(radius, neighbors=8):
    """``s`` has the bilinear samples on a circle around each inner pixel, ``p`` the pixel."""
    theta = 2 * np.pi * np.arange(neighbors) / neighbors
    dy, dx = -radius * np.sin(theta), radius * np.cos(theta)
    top, left = int(-np.floor(dy.min())), int(-np.floor(dx.min()))
    h, w = SIDE - top - int(np.ceil(dy.max())), SIDE - left - int(np.ceil(dx.max()))
    at = lambda y, x: f"a[(r + {y}) * {SIDE} + c + {x} + 1]"
    sample = []
    for y, x in zip((dy + top).tolist(), (dx + left).tolist(), strict=True):
        (ya, yb), (xa, xb) = ((int(np.floor(v)), int(np.ceil(v))) for v in (y, x))
        ty, tx = f"{y - ya!r}::DOUBLE", f"{x - xa!r}::DOUBLE"
        sample.append(f"(1 - {ty}) * ((1 - {tx}) * {at(ya, xa)} + {tx} * {at(ya, xb)}) + {ty} * ((1 - {tx}) * {at(yb, xa)} + {tx} * {at(yb, xb)})")
    return f"""{PIX}, im AS (SELECT image_id, list(p ORDER BY r, c) AS a FROM px GROUP BY image_id),
cs AS (SELECT image_id, r, c, {at(top, left)} AS p, [{', '.join(sample)}] AS s FROM im, (SELECT unnest(range({h})) AS r), (SELECT unnest(range({w})) AS c))"""


def code_sql(radius):
    return f"WITH {circle_sql(radius)} SELECT image_id, r, c, {' + '.join(f'{1 << i} * (s[{i + 1}] >= p)::INTEGER' for i in range(8))} + 0.0 AS v FROM cs"


query("FX7_lbp_circular", code_sql(1))(lambda spark, sf: long(tiled(spark, sf, I.lbp_circular(1, 8), 1)))
query("FX8_lbp_variance", f"WITH {circle_sql(1)} SELECT image_id, r, c, round(list_aggregate(s, 'var_samp'), 6) + 0.0 AS v FROM cs")(lambda spark, sf: long(tiled(spark, sf, I.lbp_variance(1, 8), 1)))
query("FX12_lbp_preprocessing", code_sql(2))(lambda spark, sf: long(tiled(spark, sf, I.lbp_circular(2, 8), 2)))

CELL = (SIDE - 2) // 2


@query("FX9_spatial_histogram", f"""WITH {LBP} SELECT image_id, ((r // {CELL}) * 2 + c // {CELL}) * 256 + code AS c, round(count(*) / {CELL * CELL}.0, 6)::DOUBLE AS v FROM lb WHERE r < {2 * CELL} AND c < {2 * CELL} GROUP BY ALL""")
def spatial(spark, sf):
    h = T.histograms(tiled(spark, sf, I.lbp_original, 1), 2, 2)
    return h.select("image_id", (F.col("cell") * 256 + F.col("code")).alias("c"), F.round("v", 6).alias("v"))


@query("FX10_equalized", f"""WITH {PIX}, st AS (SELECT image_id, min(p) AS lo, max(p) AS hi FROM px GROUP BY image_id), b AS (SELECT px.*, lo, hi, least(255, floor((p - lo) / (hi - lo) * 256)) AS bin FROM px JOIN st USING (image_id)),
n AS (SELECT image_id, bin, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT st.image_id, k.range AS bin, lo + k.range * (hi - lo) / 256 AS edge, sum(coalesce(n, 0)) OVER (PARTITION BY st.image_id ORDER BY k.range) * 255.0::DOUBLE / {SIDE * SIDE} AS cdf FROM st CROSS JOIN range(256) k LEFT JOIN n ON n.image_id = st.image_id AND n.bin = k.range)
SELECT b.image_id, b.r, b.c, round((CASE WHEN b.p >= z.edge THEN z.cdf ELSE x.cdf + (y.cdf - x.cdf) * (b.p - x.edge) / (y.edge - x.edge) END) * {SIDE * SIDE} / 255, 3) + 0.0 AS v
FROM b JOIN g x ON x.image_id = b.image_id AND x.bin = least(254, floor((b.p - lo) / ((hi - lo) / 256))) JOIN g y ON y.image_id = b.image_id AND y.bin = x.bin + 1 JOIN g z ON z.image_id = b.image_id AND z.bin = 255""")
def equalize(spark, sf):
    """In counts of pixels, which are whole numbers at the bins' edges."""
    out = T.equalized(tiles(spark, sf))
    return long(out.withColumn("pixels", F.transform("pixels", lambda p: p * SIDE * SIDE / 255)), 3)


def gauss_sql(name, of, sigma):
    """``name`` has the column v of ``of`` (image_id, r, c, v) after a separable Gaussian with mirrored borders."""
    n = int(4.0 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    weights = ", ".join(f"({j}, {w!r}::DOUBLE)" for j, w in zip(range(-n, n + 1), (k / k.sum()).tolist(), strict=True))
    mirror = lambda x: f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {SIDE} THEN {2 * SIDE - 1} - ({x}) ELSE {x} END"
    one = lambda out, src, a, b: f"{out} AS MATERIALIZED (SELECT t.image_id, t.{a}, t.{b}, sum(w * s.v) AS v FROM {src} t CROSS JOIN {name}w JOIN {src} s ON s.image_id = t.image_id AND s.{b} = t.{b} AND s.{a} = {mirror(f't.{a} + j')} GROUP BY ALL)"
    return f"{name}w AS (SELECT * FROM (VALUES {weights}) t(j, w)), {one(name + 'r', of, 'r', 'c')}, {one(name, name + 'r', 'c', 'r')}"


ALPHA, TAU = 0.1, 10.0


def illumination_sql(of):
    """``tt`` from ``of`` (image_id, r, c, v): gamma, difference of Gaussians, two-stage contrast, soft limit."""
    return f"""ga AS MATERIALIZED (SELECT image_id, r, c, pow(v, 0.2) AS v FROM {of}), {gauss_sql('gi', 'ga', 1.0)}, {gauss_sql('go', 'ga', 2.0)},
dg AS (SELECT go.image_id, go.r, go.c, CASE WHEN abs(go.v - gi.v) < 1e-9 THEN 0 ELSE go.v - gi.v END AS v FROM go JOIN gi ON go.image_id = gi.image_id AND go.r = gi.r AND go.c = gi.c),
l1 AS (SELECT *, v / greatest(pow(avg(pow(abs(v), {ALPHA})) OVER (PARTITION BY image_id), {1 / ALPHA}), 1e-12) AS x FROM dg),
l2 AS (SELECT *, x / greatest(pow(avg(pow(least(abs(x), {TAU}), {ALPHA})) OVER (PARTITION BY image_id), {1 / ALPHA}), 1e-12) AS y FROM l1),
tt AS (SELECT image_id, r, c, round({TAU} * tanh(y / {TAU}), 6) + 0.0 AS v FROM l2)"""


VALUES = f"{PIX}, va AS (SELECT image_id, r, c, p AS v FROM px)"


@query("FX11_illumination_normalized", f"WITH {VALUES}, {illumination_sql('va')} SELECT * FROM tt")
def illumination(spark, sf):
    return long(T.illumination_normalized(tiles(spark, sf, 8)))


@query("FX16_face_normalized", f"""WITH {VALUES}, {gauss_sql('gi', 'va', 1.0)}, {gauss_sql('go', 'va', 2.0)},
ra AS (SELECT gi.image_id, gi.r, gi.c, (gi.v - go.v) / (gi.v + go.v + 1e-6) AS x FROM go JOIN gi ON go.image_id = gi.image_id AND go.r = gi.r AND go.c = gi.c), co AS (SELECT *, x * 1.5 / (abs(x) + 0.5) AS y FROM ra),
rg AS (SELECT image_id, min(y) AS lo, max(y) AS hi FROM co GROUP BY image_id) SELECT image_id, r, c, round(CASE WHEN hi > lo THEN (y - lo) / (hi - lo) ELSE 0 END, 6) + 0.0 AS v FROM co JOIN rg USING (image_id)""")
def face(spark, sf):
    return long(T.face_normalized(tiles(spark, sf, 8)))


@query("FX17_illumination_inverted", f"""WITH {VALUES}, sr AS (SELECT *, (v - min(v) OVER (PARTITION BY image_id)) / (max(v) OVER (PARTITION BY image_id) - min(v) OVER (PARTITION BY image_id)) AS s FROM va),
iv AS (SELECT image_id, r, c, max(s) OVER (PARTITION BY image_id) - s AS v FROM sr), {illumination_sql('iv')} SELECT * FROM tt""")
def illumination_inverted(spark, sf):
    t = tiles(spark, sf, 8)
    own = T.cores(t)
    s = T.stretched(t, own)
    return long(T.illumination_normalized(T.inverted(s, T.cores(s))))


@query("FX13_minmax", f"WITH {PIX} SELECT image_id, r, c, round(-1 + (p - (SELECT min(p) FROM px)) * 2 / (SELECT max(p) - min(p) FROM px), 6) + 0.0 AS v FROM px")
def minmax(spark, sf):
    return long(T.minmax(T.cores(tiles(spark, sf)), -1.0, 1.0))


@query("FX14_zscore", f"WITH {PIX} SELECT image_id, r, c, round((p - (SELECT avg(p) FROM px)) / (SELECT stddev_pop(p) FROM px), 6) + 0.0 AS v FROM px")
def zscore(spark, sf):
    return long(T.zscore(T.cores(tiles(spark, sf))))


@query("FX15_stretch_to_bytes", f"WITH {PIX} SELECT image_id, r, c, floor(255 * ((p - min(p) OVER (PARTITION BY image_id)) / (max(p) OVER (PARTITION BY image_id) - min(p) OVER (PARTITION BY image_id)))) + 0.0 AS v FROM px")
def stretch(spark, sf):
    own = T.cores(tiles(spark, sf))
    return long(T.stretched(own, own).withColumn("pixels", F.transform("pixels", lambda p: F.floor(255 * p).cast("double"))))


@query("FX15_invert", f"WITH {PIX} SELECT image_id, r, c, max(p) OVER (PARTITION BY image_id) - p + 0.0 AS v FROM px")
def invert(spark, sf):
    own = T.cores(tiles(spark, sf))
    return long(T.inverted(own, own))


@query("FX1_features_harris")
def harris(spark, sf):
    return T.features(tiles(spark, sf, 20), "HARRIS").drop("descriptor")


@query("FX2_keypoints_eigenvalue")
def eigenvalue(spark, sf):
    return T.features(tiles(spark, sf, 20), "GFTT").drop("descriptor")


RING = ((0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1), (-3, 0), (-3, 1), (-2, 2), (-1, 3))


def ring_sql():
    """``sc`` has the score of the strongest arc of nine around each pixel, ``kp`` the places where it is above all neighbours."""
    arc = "list_max(list_transform(range(1, 17), lambda i: list_min(list_slice({0}, i, i + 8))))"
    return f"""{PIX}, im AS (SELECT image_id, list(p ORDER BY r, c) AS a FROM px GROUP BY image_id),
d AS (SELECT image_id, r, c, [{', '.join(f'a[(r + ({dy})) * {SIDE} + c + ({dx}) + 1] - a[r * {SIDE} + c + 1]' for dy, dx in RING)}] AS s FROM im, (SELECT unnest(range(3, {SIDE - 3})) AS r), (SELECT unnest(range(3, {SIDE - 3})) AS c)),
e AS (SELECT image_id, r, c, list_concat(s, s[1:8]) AS s, list_transform(list_concat(s, s[1:8]), lambda x: -x) AS t FROM d),
a AS (SELECT image_id, r, c, {arc.format('s')} AS up, {arc.format('t')} AS down FROM e),
sc AS (SELECT px.image_id, px.r, px.c, greatest(CASE WHEN up > 20 THEN up ELSE 0 END, CASE WHEN down > 20 THEN down ELSE 0 END, 0) AS v FROM px LEFT JOIN a ON px.image_id = a.image_id AND px.r = a.r AND px.c = a.c),
kp AS (SELECT k.image_id, k.r, k.c, k.v FROM sc k JOIN sc n ON k.v > 0 AND n.image_id = k.image_id AND n.r BETWEEN k.r - 1 AND k.r + 1 AND n.c BETWEEN k.c - 1 AND k.c + 1 AND (n.r <> k.r OR n.c <> k.c) GROUP BY ALL HAVING k.v > max(n.v))"""


@query("FX2_keypoints_fast", f"WITH {ring_sql()} SELECT (image_id << 32) | (r << 16) | c AS feature_id, image_id, c::DOUBLE AS x, r::DOUBLE AS y, v AS response FROM kp")
def fast(spark, sf):
    return T.features(tiles(spark, sf, 20), "FAST").drop("descriptor")


STEPS = f"(SELECT unnest(range({PATCH // 2}, {SIDE}, {PATCH})) AS {{0}})"
PLACES = f"(SELECT DISTINCT vec_id // {GRID * GRID} AS i FROM embeddings), {STEPS.format('r')}, {STEPS.format('c')}"


def dense(spark, sf, step=PATCH):
    return T.features(tiles(spark, sf, 20), "DENSE", step)


@query("FX2_keypoints_dense", f"SELECT (i << 32) | (r << 16) | c AS feature_id, c::DOUBLE AS x, r::DOUBLE AS y FROM {PLACES}")
def dense_keypoints(spark, sf):
    return dense(spark, sf).select("feature_id", "x", "y")


query("FX4_dense_descriptors")(lambda spark, sf: dense(spark, sf).select("feature_id", "image_id", F.round(F.array_max("descriptor"), 6).alias("largest")))
query("FX5_shuffled_keypoints", f"SELECT (i << 32) | (r << 16) | c AS feature_id FROM {PLACES}")(lambda spark, sf: dense(spark, sf).orderBy(F.xxhash64("feature_id", F.lit(7))).select("feature_id"))


@query("FX3_multi_size_keypoints", f"SELECT DISTINCT i AS image_id, c::DOUBLE AS x, r::DOUBLE AS y FROM (SELECT * FROM {PLACES} UNION ALL SELECT * FROM {PLACES.replace(f'range(4, {SIDE}, 8)', f'range(6, {SIDE}, 12)')})")
def multi_size(spark, sf):
    return dense(spark, sf, 8).unionByName(dense(spark, sf, 12)).select("image_id", "x", "y").distinct()


def found(spark, sf, keypoint):
    """The keypoints of whole images, with the length of their descriptors."""
    rows = I.features_of(images(spark, sf), keypoint)
    return rows.select("feature_id", "image_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.size("descriptor").alias("n"))


query("FX1_features_scale_space")(lambda spark, sf: found(spark, sf, "SIFT"))
query("FX1_features_box_filters")(lambda spark, sf: found(spark, sf, "SURF"))
query("FX2_keypoints_stable_regions")(lambda spark, sf: found(spark, sf, "MSER"))
query("FX2_keypoints_blobs")(lambda spark, sf: found(spark, sf, "SIMPLEBLOB"))
query("FX1_features_rings")(lambda spark, sf: found(spark, sf, "BRISK"))
query("FX2_keypoints_stars")(lambda spark, sf: found(spark, sf, "STAR"))
query("FX4_retinal_bits")(lambda spark, sf: I.features_of(images(spark, sf), "FAST", "FREAK").select("feature_id", "image_id", F.size(F.filter("descriptor", lambda b: b > 0)).alias("n_set")))
query("FX3_oriented_binary")(lambda spark, sf: found(spark, sf, "ORB"))
query("FX4_binary_tests")(lambda spark, sf: I.features_of(images(spark, sf), "BRIEF").select("feature_id", "image_id", F.size(F.filter("descriptor", lambda b: b > 0)).alias("n_set")))


@query("PF19_test_set_crops")
def test_set(spark, sf):
    return T.crops(T.cores(tiles(spark, sf)), 20, 5).withColumn("total", F.round("total", 3))


@query("PF18_make_test_pair")
def test_pair(spark, sf):
    """Two crops of an image with the homography between them."""
    c = T.crops(T.cores(tiles(spark, sf)), 20, 2).select("image_id", "crop", "left", "top")
    a, b = c.where("crop = 0").alias("a"), c.where("crop = 1").alias("b")
    shift = F.array(*[F.lit(v) for v in (1.0, 0.0)], (F.col("a.left") - F.col("b.left")).cast("double"), F.lit(0.0), F.lit(1.0), (F.col("a.top") - F.col("b.top")).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return a.join(b, F.col("a.image_id") == F.col("b.image_id")).select(F.col("a.image_id").alias("image_id"), shift.alias("h"))


@query("GM40_warp", f"""WITH {PIX}, cv AS (SELECT image_id, y, x, x - 6.5 AS u, y - 3 AS v FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range({SIDE + 3})) AS y), (SELECT unnest(range({SIDE + 7})) AS x)),
ot AS (SELECT cv.image_id, y, x, (a.p + b.p) / 2 AS p FROM cv JOIN px a ON a.image_id = cv.image_id AND a.r = v AND a.c = floor(u) JOIN px b ON b.image_id = cv.image_id AND b.r = v AND b.c = floor(u) + 1 WHERE u >= 0 AND u <= {SIDE - 1})
SELECT cv.image_id, {SIDE + 3}::INTEGER AS height, {SIDE + 7}::INTEGER AS width, round(sum(coalesce(px.p, ot.p, 0)), 3) AS total FROM cv LEFT JOIN px ON px.image_id = cv.image_id AND px.r = y AND px.c = x LEFT JOIN ot ON ot.image_id = cv.image_id AND ot.y = cv.y AND ot.x = cv.x GROUP BY cv.image_id""")
def warp(spark, sf):
    out = I.per_image(images(spark, sf), lambda x: I.warp(x, x, np.array([[1, 0, 6.5], [0, 1, 3.0], [0, 0, 1]])))
    return out.select("image_id", "height", "width", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


NAMES = "nm AS (SELECT p_partkey, lower(replace(p_brand, '#', '')) AS brand, p_size FROM part)"


def names(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("brand"), "p_size")


@query("SRC9_saved_homography", f"WITH {NAMES} SELECT p_partkey, '/d/' || brand || '_1_' || brand || '_2_hom.npy' AS path FROM nm")
def saved(spark, sf):
    at = lambda n: F.concat(F.lit("/d/"), "brand", F.lit(f"_{n}.jpg"))
    return names(spark, sf).select("p_partkey", S.saved_homography(at(1), at(2)).alias("path"))


@query("SRC10_image_pairs", f"WITH {NAMES} SELECT DISTINCT left(brand, 6) AS pair, '/x/' || left(brand, 6) || '_1.jpg' AS path1, '/x/' || left(brand, 6) || '_2.jpg' AS path2 FROM nm")
def image_pairs(spark, sf):
    return S.image_pairs(names(spark, sf).select(F.substring("brand", 1, 6).alias("name")).distinct(), "/x")


@query("SRC15_turntable_path", f"WITH {NAMES} SELECT p_partkey, 'imageset_' || (p_size % 15 + 1) || '/' || brand || '/Top/img_1-' || lpad((p_size * 5 + 360)::VARCHAR, 3, '0') || '_*_0.JPG' AS path FROM nm")
def turntable_path(spark, sf):
    return names(spark, sf).select("p_partkey", S.turntable_path(F.col("brand"), F.col("p_size") % 15 + 1, F.col("p_size") * 5, F.lit("Top"), 1).alias("path"))


@query("SRC16_calibration_index", f"WITH {NAMES} SELECT p_partkey, (p_size * 7 // 5 * 3 + 1 + 2)::INTEGER AS k FROM nm")
def calibration(spark, sf):
    return names(spark, sf).select("p_partkey", S.calibration_index(F.col("p_size") * 7, 2).alias("k"))


@query("SRC17_image_set", f"WITH {NAMES} SELECT p_partkey, s.set AS image_set FROM nm JOIN (SELECT brand, row_number() OVER (ORDER BY brand)::INTEGER AS set FROM (SELECT DISTINCT brand FROM nm)) s USING (brand)")
def image_set(spark, sf):
    from pyspark.sql import Window

    n = names(spark, sf)
    sets = n.select("brand").distinct().withColumn("image_set", F.row_number().over(Window.orderBy("brand")))  # a row per object
    return n.join(sets, "brand").select("p_partkey", "image_set")


@query("SRC13_nth_pair", f"WITH {NAMES} SELECT brand FROM (SELECT DISTINCT brand FROM nm) ORDER BY brand LIMIT 1 OFFSET 4")
def nth_pair(spark, sf):
    from pyspark.sql import Window

    return names(spark, sf).select("brand").distinct().withColumn("k", F.row_number().over(Window.orderBy("brand"))).where("k = 5").select("brand")


@query("SRC4_face_labels", "SELECT 'file:/s/' || c_mktsegment || '/' || c_custkey || '.png' AS path, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS label FROM customer")
def face_labels(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("file:/s/"), "c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("path"))
    return S.face_folder(c).select("path", "label")


def relative_sql():
    """A homography times the inverse of a shift by (tx, ty), as nine rows a part."""
    n = f"({H[8]!r} - {H[6]!r} * tx - {H[7]!r} * ty)"
    cells = [f"({H[3 * r + c]!r} / {n})" if c < 2 else f"(({H[3 * r + 2]!r} - {H[3 * r]!r} * tx - {H[3 * r + 1]!r} * ty) / {n})" for r in range(3) for c in range(3)]
    return f"SELECT p_partkey, k - 1 AS k, round(m[k]::DOUBLE, 6) AS v FROM (SELECT p_partkey, [{', '.join(cells)}] AS m, unnest(range(1, 10)) AS k FROM (SELECT p_partkey, p_size::DOUBLE AS tx, p_retailprice / 100 AS ty FROM part))"


@query("SRC11_relative_homography", relative_sql())
def relative(spark, sf):
    """From an image that is shifted against the first one of its series to another one; the shift is a matrix as text."""
    cells = [F.lit("1.0"), F.lit("0.0"), F.col("p_size").cast("double").cast("string"), F.lit("0.0"), F.lit("1.0"), (F.col("p_retailprice") / 100).cast("string"), F.lit("0.0"), F.lit("0.0"), F.lit("1.0")]
    rows = table(spark, sf, "part").select("p_partkey", F.split(F.concat_ws(" ", *cells), " ").cast("array<double>").alias("first"))
    rows = rows.select("p_partkey", S.relative_homography(F.col("first"), F.array(*map(F.lit, H))).alias("m"))
    return rows.select("p_partkey", F.posexplode("m").alias("k", "v")).select("p_partkey", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))
