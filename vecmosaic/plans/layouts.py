"""Queries that write a file layout to the shared folder with Spark and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vecmosaic.operators import faces as X
from vecmosaic.operators import geometry as Geo
from vecmosaic.operators import graph as G
from vecmosaic.operators import images as I
from vecmosaic.plans.catalog import query
from vecmosaic.plans.faces import people
from vecmosaic.plans.geometry import ERRORS, H, matches
from vecmosaic.plans.graphs import BY, MOD, TOP, communities, edges, pruned
from vecmosaic.plans.images import GRID, PIX, SIDE, images
from vecmosaic.operators.tiles import long
from vecmosaic.plans.matching import FEATURES, rounded
from vecmosaic.session import shared_dir
from vecmosaic.sources import files as S
from vecmosaic.sources.tables import features


def place(spark, tag):
    return f"{shared_dir(spark)}/vecmosaic/{tag}-{uuid.uuid4().hex}"


def images_back(spark, sf, channel, stretch):
    """The images written as files and read again."""
    at = place(spark, "images")
    S.write_images(images(spark, sf), at)
    back = S.read_images(spark, at, channel, stretch)
    return back.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image_id"), "height", "width", "pixels")


def pixels(df):
    """(image_id, r, c, v) of whole images."""
    return long(df.select("image_id", F.lit(0).alias("top"), F.lit(0).alias("left"), F.col("width").alias("cols"), "pixels"))


@query("SRC3_read_grey_images", f"WITH {PIX} SELECT image_id, r, c, p + 0.0 AS v FROM px")
def grey(spark, sf):
    return pixels(images_back(spark, sf, "grey", False))


@query("SRC2_read_images_unstretched", f"WITH {PIX} SELECT image_id, round(sum(p), 3) AS total FROM px GROUP BY image_id")
def unstretched(spark, sf):
    return images_back(spark, sf, "L", False).select("image_id", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("SRC1_read_luminance", f"""WITH {PIX}, li AS (SELECT *, p / 255.0::DOUBLE AS q FROM px), ln AS (SELECT *, CASE WHEN q > 0.04045 THEN pow((q + 0.055) / 1.055, 2.4) ELSE q / 12.92 END AS y FROM li),
lu AS (SELECT *, CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END AS l FROM ln), mm AS (SELECT image_id, min(l) AS lo, max(l) AS hi FROM lu GROUP BY image_id)
SELECT image_id, r, c, floor(255 * (l - lo) / (hi - lo) + 0.5) + 0.0 AS v FROM lu JOIN mm USING (image_id)""")
def luminance(spark, sf):
    return pixels(images_back(spark, sf, "L", True))


IDS = f"SELECT DISTINCT vec_id // {GRID * GRID} AS image_id FROM embeddings"
query("SRC18_recursive_walk", IDS)(lambda spark, sf: images_back(spark, sf, "grey", False).select("image_id"))


@query("SNK2_write_images", f"SELECT image_id, image_id || '.png' AS name FROM ({IDS})")
def write_images(spark, sf):
    return S.write_images(images(spark, sf), place(spark, "images")).select("image_id", F.element_at(F.split("path", "/"), -1).alias("name"))


@query("SRC5_face_csv", "SELECT vec_id || '.png' AS path, CAST(label AS INTEGER) AS label, CAST(vec_id % 5 AS INTEGER) AS grp FROM embeddings")
def face_csv(spark, sf):
    at = place(spark, "faces")
    people(spark, sf).select(F.concat(F.col("id").cast("string"), F.lit(".png")), "label", "grp").write.option("sep", ";").csv(at)
    return S.read_face_csv(spark, at)


@query("SRC6_keypoint_files", f"""WITH {FEATURES}, q AS (SELECT img, id - min(id) OVER (PARTITION BY img) AS o, id, v[1:8] AS v FROM f), d AS (SELECT img, row_number() OVER (PARTITION BY img ORDER BY id) - 1 AS k, list_transform(v, lambda e: floor(abs(e) * 512)) AS w FROM q)
SELECT 'im' || img AS name, k::INTEGER AS feature_id, round(list_sum(list_transform(w, lambda e: e / sqrt(list_sum(list_transform(w, lambda z: z * z))))), 6) AS total FROM d""")
def keypoint_files(spark, sf):
    at = place(spark, "keypoints")
    f = features(spark, sf)
    d = F.transform(F.slice("descriptor", 1, 8), lambda e: F.floor(F.abs(e) * 512).cast("int"))
    S.write_keypoints(f.select(F.concat(F.lit("im"), F.col("image_id").cast("string")).alias("name"), "feature_id", F.col("y").alias("row"), F.col("x").alias("col"), F.lit(1).alias("scale"), F.lit(0).alias("orientation"), d.alias("descriptor")), at)
    back = S.read_keypoints(spark, f"{at}/*", 8)
    return back.select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("name"), "feature_id", F.round(F.aggregate("descriptor", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


HOMS = "SELECT img::INTEGER AS image, k::INTEGER AS k, CASE WHEN k IN (0, 4, 8) THEN 1.0 WHEN k = 2 THEN img * 1.5 ELSE 0.0 END::DOUBLE AS v FROM (SELECT DISTINCT label AS img FROM embeddings), (SELECT unnest(range(9)) AS k)"


def homography_files(spark, sf):
    at = place(spark, "homographies")
    im = features(spark, sf).select("image_id").distinct()
    h = F.array(F.lit(1.0), F.lit(0.0), F.col("image_id") * F.lit(1.5), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    S.write_homographies(im.select(F.concat(F.lit("h"), F.col("image_id").cast("string")).alias("name"), h.alias("h")), at)
    back = S.read_homographies(spark, f"{at}/*")
    return back.select(F.regexp_extract("path", r"name=h(\d+)/", 1).cast("int").alias("image"), F.posexplode("h").alias("k", "v"))


query("SRC8_homography_files", HOMS)(homography_files)
query("SNK1_write_homographies", f"SELECT count(*) AS n, round(sum(v), 6) AS total FROM ({HOMS})")(lambda spark, sf: homography_files(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total")))


@query("SRC12_series_homographies", f"SELECT image, round(v * 2, 6) AS shift FROM ({HOMS}) WHERE k = 2")
def series(spark, sf):
    """Two steps of a series: the second matrix against the inverse of the first."""
    h = homography_files(spark, sf).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s")).select("image", F.transform("s", lambda x: x["v"]).alias("h"))
    back = F.transform("h", lambda x, i: F.when(i == 2, -x).otherwise(x))
    return h.select("image", F.round(F.element_at(S.relative_homography(back, F.col("h")), 3), 6).alias("shift"))


@query("SNK3_model_table")
def model_table(spark, sf):
    at = place(spark, "model")
    S.write_model(X.pca(people(spark, sf), 3), spark, at)
    model = S.read_model(spark, at)
    return spark.createDataFrame([(k, round(v, 9)) for k, v in enumerate(model.values)], "k int, value double")


SMALL = round(SIDE * 0.4)  # pixels of a side after resizing
EDGES = f"round(({{0}}) * {SIDE}.0 / {SMALL})"


@query("PF21_crop_and_resize", f"""WITH {PIX}, k AS (SELECT y, x, {EDGES.format(f'y + {(SMALL - 8) // 2}')} AS r0, {EDGES.format(f'y + {(SMALL - 8) // 2 + 1}')} AS r1, {EDGES.format(f'x + {(SMALL - 6) // 2}')} AS c0, {EDGES.format(f'x + {(SMALL - 6) // 2 + 1}')} AS c1 FROM (SELECT unnest(range(8)) AS y), (SELECT unnest(range(6)) AS x))
SELECT image_id, y AS r, x AS c, round(avg(p), 6) + 0.0 AS v FROM k JOIN px ON r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY ALL""")
def crop_and_resize(spark, sf):
    return pixels(I.per_image(images(spark, sf), I.resized_centre(0.4, 8, 6)))


GAINS = f"""{MOD}, dg AS (SELECT src AS vertex, sum(w) AS degree FROM pr GROUP BY src), lk AS (SELECT src AS vertex, c2 AS cluster, sum(w) AS links FROM ce GROUP BY ALL),
gn AS (SELECT lk.vertex, lk.cluster, (2 * links - (dg.degree * (2 * mp.degree - inside) + dg.degree * dg.degree) / k) / k AS gain FROM lk JOIN dg ON lk.vertex = dg.vertex JOIN mp ON lk.cluster = mp.cluster JOIN ks ON ks.sid = mp.sid)"""


@query("GM10_best_moves", f"WITH {GAINS} SELECT vertex, cluster::BIGINT AS cluster, round(gain, 6) AS gain FROM gn QUALIFY row_number() OVER (PARTITION BY vertex ORDER BY gain DESC, cluster DESC) = 1")
def best_moves(spark, sf):
    g = G.move_gains(pruned(spark, sf), communities(spark, sf), BY)
    top = g.groupBy("vertex").agg(F.max(F.struct("gain", "cluster")).alias("t"))
    return rounded(top.select("vertex", "t.cluster", "t.gain"), "gain")


@query("GM8_prune_highest_one", f"WITH {MOD}, {TOP} SELECT src, dst, round(max(w), 6) AS w FROM (SELECT vertex AS src, best AS dst, w1 AS w FROM tp UNION ALL SELECT best, vertex, w1 FROM tp) GROUP BY src, dst")
def prune_highest_one(spark, sf):
    return rounded(G.prune_highest(edges(spark, sf), 1), "w")


query("GM38_fundamental_matrices")(lambda spark, sf: Geo.fundamentals(matches(spark, sf), ("im_i", "im_j"), 2.0, 50, 20.0).select("im_i", "im_j", F.size("f").alias("n")))
query("GM37_homography_errors", f"WITH {ERRORS} SELECT im_i, round(min(error), 6) AS least FROM e GROUP BY im_i")(lambda spark, sf: Geo.with_errors(matches(spark, sf), H).groupBy("im_i").agg(F.round(F.min("error"), 6).alias("least")))
