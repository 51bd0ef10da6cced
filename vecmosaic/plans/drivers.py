"""Composite benchmark queries and the remaining graph properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmosaic.operators import cluster as K
from vecmosaic.operators import geometry as Geo
from vecmosaic.operators import graph as G
from vecmosaic.operators import match as M
from vecmosaic.operators import spectral as S
from vecmosaic.operators import stitch as T
from vecmosaic.plans.catalog import query
from vecmosaic.plans.clusters import iso_match, whole_graph
from vecmosaic.plans.geometry import ERRORS, H, T_SQL, THRESHOLDS, VIEWS, error_sql, matches, points, verified
from vecmosaic.plans.graphs import ANGLE, BY, IMAGES, PART, PRUNED, SCORED, communities, edges, group, images, pruned, sizes, threshold_sql
from vecmosaic.plans.matching import FEATURES, PAIRS, ranked_sql, rounded
from vecmosaic.sources.tables import features

SUMMARY = "count(*) AS n, round(avg(error), 6) AS mean_error"


def summary(rows):
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("error"), 6).alias("mean_error"))


@query("BD6_standard_match", f"WITH {ERRORS} SELECT threshold, {SUMMARY} FROM e, {T_SQL} t WHERE ratio < threshold GROUP BY threshold")
def standard_match(spark, sf):
    return summary(Geo.evaluate(matches(spark, sf), H, THRESHOLDS))


@query("BD7_ball_match", f"""WITH {PAIRS}, {ranked_sql('k', 'all')}, g AS (SELECT a.id, count(*) AS n FROM f a JOIN f b ON list_distance(a.v, b.v) <= 1.2 GROUP BY a.id),
m AS (SELECT a.q AS i, a.t AS j, a.d / b.d * CASE WHEN g.n >= 4 THEN 1.2 ELSE 1.0 END AS ratio FROM k a JOIN k b ON a.q = b.q AND a.r = 1 AND b.r = 2 JOIN g ON g.id = a.q WHERE a.qi < a.ti),
w AS (SELECT m.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM m JOIN f a ON m.i = a.id JOIN f b ON m.j = b.id), e AS (SELECT *, {error_sql()} AS error FROM w)
SELECT threshold, {SUMMARY} FROM e, (SELECT unnest([1.1, 1.2])::DOUBLE AS threshold) t WHERE ratio < threshold GROUP BY threshold""")
def ball_match(spark, sf):
    f = features(spark, sf)
    m = M.radius_match(f, 9.0, M.RadiusOptions(radius=1.2, ratio_boost=1.2, group_limit=4))
    return summary(Geo.evaluate(M.with_positions(m, f), H, [1.1, 1.2]))


@query("BD4_spectral_over_clusters")
def spectral_over_clusters(spark, sf):
    """Spectral selection over community matches."""
    f = features(spark, sf)
    e, near = whole_graph(spark, sf)
    m = G.community_matches(near, e, K.louvain(near, BY), images(spark, sf), 0.999)
    ends = images(spark, sf)
    of = lambda k: ends.select(F.col("vertex").alias(k), F.col("image").alias(f"im_{k}"))
    rows = M.with_positions(m, f).join(of("i"), "i").join(of("j"), "j").select((F.col("im_i") * 1000 + F.col("im_j")).cast("long").alias("pair"), (F.col("i") * 1000000 + F.col("j")).alias("id"), "i", "j", "x1", "y1", "x2", "y2", F.col("ratio").alias("score"), "ratio")
    return S.spectral_match(rows, keep=0.5).select("i", "j", F.round("ratio", 6).alias("ratio"))


@query("BD8_iso_match")
def iso_benchmark(spark, sf):
    f = features(spark, sf)
    rows = M.with_positions(iso_match(spark, sf).select("i", "j"), f)
    return Geo.with_errors(rows, H).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("error"), 6).alias("mean_error"))


@query("BD10_match_distances", f"WITH {VIEWS} SELECT d.view, count(*) AS n, count(*) FILTER (CASE WHEN d_bc IS NOT NULL THEN greatest(d_ac, d_bc) ELSE d_ac END < 30) AS n_near FROM d LEFT JOIN h ON d.a = h.a AND d.c = h.c AND d.view = h.view GROUP BY d.view")
def match_distances(spark, sf):
    return verified(spark, sf).groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") < 30).alias("n_near"))


@query("GM26_weighted_graph", f"WITH {PRUNED} SELECT src, dst, round(w, 6) AS w FROM pr WHERE src < dst AND w > 0")
def weighted_graph(spark, sf):
    return rounded(pruned(spark, sf).where("src < dst and w > 0").drop(BY), "w")


@query("GM27_vertex_properties", f"WITH {FEATURES}, {PART}, {IMAGES} SELECT pt.vertex, cluster::BIGINT AS cluster, image, round(x, 6) AS x, round(y, 6) AS y FROM pt JOIN im ON pt.vertex = im.vertex JOIN f ON f.id = pt.vertex")
def vertex_properties(spark, sf):
    f = group(spark, sf).select(F.col("feature_id").alias("vertex"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return communities(spark, sf).join(images(spark, sf), "vertex").join(f, "vertex")


@query("GM31_trait_graph", f"""WITH {SCORED}, vt AS (SELECT DISTINCT pt.cluster, img AS image_id FROM pt JOIN f ON pt.vertex = f.id)
SELECT a.cluster::BIGINT AS cluster, a.image_id AS im_i, b.image_id AS im_j, round(200 * score, 5) + 0.0 AS w FROM vt a JOIN vt b ON a.cluster = b.cluster AND a.image_id < b.image_id JOIN sr ON sr.cluster = a.cluster""")
def trait_graph(spark, sf):
    s = G.match_scores(pruned(spark, sf), communities(spark, sf), images(spark, sf), BY).select("cluster", "score")
    return T.trait_graph(communities(spark, sf), group(spark, sf), s)[1].select("cluster", "im_i", "im_j", (F.round("w", 5) + 0.0).alias("w"))


@query("GM39_contract_images")
def contract_images(spark, sf):
    """The image graph of near matches, contracted to roots; every edge has a fixed shift."""
    e = M.mirror_match(features(spark, sf), 9.0).groupBy("im_i", "im_j").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    h = F.array(F.lit(1.0), F.lit(0.0), (F.col("im_j") - F.col("im_i")).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return T.contract(e.select(F.col("im_i").cast("long").alias("src"), F.col("im_j").cast("long").alias("dst"), "n", h.alias("h")))


@query("WN5_first_threshold", f"WITH {ANGLE}, {threshold_sql('0.1 * zs.n * zs.n', 600)} SELECT sid AS set_id, round(t, 6) AS t FROM th")
def first_threshold(spark, sf):
    return rounded(G.fraction_threshold(edges(spark, sf), sizes(spark, sf), 0.1, by=BY), "t")


@query("PF13_mask", "SELECT vec_id::BIGINT AS id, (label IN (1, 3)) AS inside FROM embeddings")
def mask(spark, sf):
    return features(spark, sf).select(F.col("feature_id").alias("id"), F.col("image_id").isin(1, 3).alias("inside"))


@query("PF14_masked_matches", f"WITH {ERRORS} SELECT i, j, CASE WHEN error <= 150 THEN 'inlier' ELSE 'outlier' END AS kind FROM e")
def masked_matches(spark, sf):
    return Geo.with_errors(matches(spark, sf), H).select("i", "j", F.when(F.col("error") <= 150, "inlier").otherwise("outlier").alias("kind"))


@query("PF20_short_keys", "SELECT vec_id::BIGINT AS id, left(sha256(vec_id::VARCHAR || '-7'), 6) AS key FROM embeddings")
def short_keys(spark, sf):
    return features(spark, sf).select(F.col("feature_id").alias("id"), F.substring(F.sha2(F.concat(F.col("feature_id").cast("string"), F.lit("-7")), 256), 1, 6).alias("key"))
