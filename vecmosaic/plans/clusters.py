"""Queries over clusterings and spectral selection; single steps have SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmosaic.functions import vectors as V
from vecmosaic.operators import cluster as K
from vecmosaic.operators import geometry as Geo
from vecmosaic.operators import graph as G
from vecmosaic.operators import match as M
from vecmosaic.operators import spectral as S
from vecmosaic.operators.components import connected_components
from vecmosaic.operators.knn import KnnOptions, knn_join
from vecmosaic.plans.catalog import query
from vecmosaic.plans.geometry import H, matches
from vecmosaic.plans.graphs import BY, communities, edges, images, next_ones, pruned
from vecmosaic.plans.matching import ORIENTED_SQL, rounded
from vecmosaic.session import checkpointed, written
from vecmosaic.sources.tables import features


def points(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 40).alias("y"))


def whole_graph(spark, sf):
    """The edges inside the sets of all features and those left by pruning, written once as they are read many times."""
    e = edges(spark, sf)
    return e, written(pruned(spark, sf, e), "pruned")


@query("GM9_louvain")
def louvain(spark, sf):
    return K.louvain(pruned(spark, sf), BY)


@query("GM9_louvain_modularity")
def louvain_modularity(spark, sf):
    near = written(pruned(spark, sf), "pruned")
    return G.modularity(near, K.louvain(near, BY), BY)


@query("GM12_split_large_clusters")
def split_large_clusters(spark, sf):
    e, near = whole_graph(spark, sf)
    return K.split_large(e, K.louvain(near, BY), 40, 1.5)


@query("GM16_cluster_match")
def cluster_match(spark, sf):
    e, near = whole_graph(spark, sf)
    return G.community_matches(near, e, K.split_large(e, K.louvain(near, BY), 50, 1.5), images(spark, sf), 0.99)


@query("BD2_cluster_benchmark")
def cluster_benchmark(spark, sf):
    f = features(spark, sf)
    e, near = whole_graph(spark, sf)
    found = G.community_matches(near, e, K.louvain(near, BY), images(spark, sf), 0.999)
    return Geo.evaluate(M.with_positions(found, f), H, [0.95, 0.99, 0.999]).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("error"), 6).alias("mean_error"))


CC = "e AS (SELECT l_suppkey AS a, l_partkey + 100000 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


@query("components", f"""WITH RECURSIVE {CC}, r(v, root) USING KEY (v) AS (SELECT a, min(a) FROM s GROUP BY a UNION
  SELECT s.b, min(r.root) FROM r JOIN s ON s.a = r.v JOIN recurring.r AS old ON old.v = s.b WHERE r.root < old.root GROUP BY s.b)
SELECT v::BIGINT AS vertex, root::BIGINT AS component FROM r""")
def components(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return connected_components(li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst")))


query("GM20_isodata")(lambda spark, sf: K.isodata(points(spark, sf), K.IsodataOptions(k_init=12, max_iterations=8, min_size=20, max_sd=9.0, min_distance=6.0)))

CENTRES = [(10.0, 24.0), (25.0, 36.0), (40.0, 48.0), (30.0, 27.0)]
NEAR = f"""p AS (SELECT p_partkey::BIGINT AS id, p_size::DOUBLE AS x, p_retailprice / 40 AS y FROM part), c AS (SELECT * FROM (VALUES {', '.join(f'({k}, {x}::DOUBLE, {y}::DOUBLE)' for k, (x, y) in enumerate(CENTRES))}) t(k, cx, cy)),
n AS (SELECT id, x, y, k AS cluster, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist FROM p, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), k) = 1)"""


@query("GM21_assign_centres", f"WITH {NEAR} SELECT id, cluster, round(dist, 6) AS dist FROM n")
def assign(spark, sf):
    return rounded(K.assign(points(spark, sf), CENTRES).select("id", "cluster", "dist"), "dist")


@query("GM21_cluster_statistics", f"WITH {NEAR} SELECT cluster, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(dist), 6) AS spread, round(stddev_pop(x), 6) AS sx, round(stddev_pop(y), 6) AS sy FROM n GROUP BY cluster HAVING count(*) >= 5")
def statistics(spark, sf):
    a = K.assign(points(spark, sf), CENTRES)
    s = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("dist").alias("spread"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return rounded(s.where("n >= 5"), "cx", "cy", "spread", "sx", "sy")


@query("SO2_centre_distances", f"WITH {NEAR}, m AS (SELECT cluster, id % 20 AS part, avg(x) AS cx, avg(y) AS cy FROM n GROUP BY ALL) SELECT a.part, a.cluster AS a, b.cluster AS b, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 6) AS dist FROM m a JOIN m b ON a.part = b.part AND a.cluster < b.cluster")
def centre_distances(spark, sf):
    """The distances between the cluster centres of each twentieth of the points, the nearest first."""
    c = K.assign(points(spark, sf), CENTRES).groupBy((F.col("id") % 20).alias("part"), "cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    a, b = c.alias("a"), c.alias("b")
    d = F.hypot(F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy"))
    pairs = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.cluster") < F.col("b.cluster")))
    return pairs.select("a.part", F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b"), F.round(d, 6).alias("dist")).orderBy("dist")


@query("GM22_iso_match")
def iso_match(spark, sf):
    """Matches of every image pair in geometric clusters that are linked by most matches of their row."""
    f = features(spark, sf)
    near = knn_join(f, options=KnnOptions(k=3, scope="other")).withColumn("ratio", F.lit(1.0))
    m = M.with_positions(M.first_of_pairs(M.oriented(near)), f)
    return K.linked_clusters(m, K.IsodataOptions(k_init=4, max_iterations=4, min_size=4, max_sd=60.0), least=2).select("im_i", "im_j", "i", "j", "p1", "p2")


query("GM29_spin_glass")(lambda spark, sf: K.spin_glass(G.prune_highest(checkpointed(pruned(spark, sf)), 2), k=6, sweeps=30))
query("AG33_mutual_information")(lambda spark, sf: K.adjusted_mutual_information(K.louvain(pruned(spark, sf), BY), images(spark, sf).withColumnRenamed("image", "cluster")))
query("AG33_self_information", "SELECT 1.0::DOUBLE AS ami")(lambda spark, sf: K.adjusted_mutual_information(communities(spark, sf), communities(spark, sf)).select(F.round("ami", 6).alias("ami")))

MATCHES = f"""{ORIENTED_SQL}, mm AS (SELECT im_i * 1000 + im_j AS pair, m.i * 1000000 + m.j AS id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, m.score FROM m JOIN f a ON m.i = a.id JOIN f b ON m.j = b.id),
af AS (SELECT q.pair, a.id AS a, b.id AS b, CASE WHEN abs(d0 - d1) < 150 THEN 4.5 - (d0 - d1) ** 2 / 5000 ELSE 0 END AS w FROM (SELECT a.pair, a.id AS ai, b.id AS bi, sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) AS d0, sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) AS d1 FROM mm a JOIN mm b ON a.pair = b.pair AND a.id <> b.id) q JOIN mm a ON a.id = q.ai JOIN mm b ON b.id = q.bi),
aw AS (SELECT * FROM af WHERE w <> 0 UNION ALL SELECT pair, id, id, 4.5 * (1 - score / max(score) OVER (PARTITION BY pair)) FROM mm)"""


def some_matches(spark, sf):
    """The matches of every image pair; ids and pairs are numbers made of both ends."""
    m = matches(spark, sf)
    return m.select((F.col("im_i") * 1000 + F.col("im_j")).cast("long").alias("pair"), (F.col("i") * 1000000 + F.col("j")).alias("id"), "i", "j", "x1", "y1", "x2", "y2", "score", "ratio")


@query("GM24_affinity_matrix", f"WITH {MATCHES} SELECT pair::BIGINT AS pair, a, b, round(w, 5) + 0.0 AS w FROM aw")
def affinity_matrix(spark, sf):
    return S.affinities(some_matches(spark, sf), parts=int(spark.conf.get("spark.sql.shuffle.partitions"))).select("pair", "a", "b", (F.round("w", 5) + 0.0).alias("w"))


@query("GM23_affinity", "SELECT o_orderkey, round(CASE WHEN abs(d) < 150 THEN 4.5 - d * d / 5000 ELSE 0 END, 6)::DOUBLE AS affinity FROM (SELECT o_orderkey, o_totalprice / 1000 - 100 AS d FROM orders)")
def affinity(spark, sf):
    d = F.col("o_totalprice") / 1000
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.round(S.affinity_simple(d, F.lit(100.0)), 6).alias("affinity"))


query("GM25_spectral_match")(lambda spark, sf: rounded(S.spectral_match(some_matches(spark, sf)).select("i", "j", "x"), "x"))
query("TK2_top_half")(lambda spark, sf: S.top_share(S.principal_vector(S.affinities(some_matches(spark, sf)), 8), 0.5).select("pair", "id"))


@query("BD3_spectral_benchmark")
def spectral_benchmark(spark, sf):
    return Geo.evaluate(S.spectral_match(some_matches(spark, sf)), H, [0.95, 1.0]).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("error"), 6).alias("mean_error"))


@query("GM36_image_graph", f"""WITH {ORIENTED_SQL}, e AS (SELECT im_i, im_j, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 4) SELECT im_i AS src, im_j AS dst, n FROM e UNION ALL SELECT im_j, im_i, n FROM e""")
def image_graph(spark, sf):
    e = M.mirror_match(features(spark, sf), 9.0).groupBy("im_i", "im_j").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    return e.select(F.col("im_i").alias("src"), F.col("im_j").alias("dst"), "n").union(e.select("im_j", "im_i", "n"))


@query("JN21_edges_of_matched_images", f"WITH {ORIENTED_SQL} SELECT p1, p2 FROM (SELECT a.label AS p1, b.label AS p2 FROM (SELECT DISTINCT label FROM embeddings) a JOIN (SELECT DISTINCT label FROM embeddings) b ON a.label < b.label) WHERE (p1, p2) IN (SELECT (im_i, im_j) FROM m WHERE ratio < 0.95)")
def matched_images(spark, sf):
    im = features(spark, sf).select("image_id").distinct()
    pairs = im.select(F.col("image_id").alias("p1")).join(im.select(F.col("image_id").alias("p2")), F.col("p1") < F.col("p2"))
    m = M.mirror_match(features(spark, sf), 0.95).select(F.col("im_i").alias("p1"), F.col("im_j").alias("p2"))
    return pairs.join(m, ["p1", "p2"], "left_semi")


@query("BD9_near_duplicate_matches", f"WITH {ORIENTED_SQL} SELECT im_i, im_j, count(*) AS n, round(min(ratio), 6) AS best FROM m WHERE ratio < 1 GROUP BY ALL")
def near_duplicates(spark, sf):
    return rounded(M.mirror_match(features(spark, sf)).groupBy("im_i", "im_j").agg(F.count(F.lit(1)).alias("n"), F.min("ratio").alias("best")), "best")


@query("SF2_euclidean_table", "SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 8")
def euclidean_table(spark, sf):
    a, b = next_ones(features(spark, sf), 8).alias("a"), features(spark, sf).alias("b")
    return a.join(b, F.col("a.next_id") == F.col("b.feature_id")).select(F.col("a.feature_id").alias("i"), F.col("b.feature_id").alias("j"), F.round(V.euclidean(F.col("a.descriptor"), F.col("b.descriptor")), 6).alias("d"))
