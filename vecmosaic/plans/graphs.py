"""Queries over similarity graphs and communities, with their SQL twins.

The labels stand in for a partition, so that every single step can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmosaic.functions import vectors as V
from vecmosaic.operators import graph as G
from vecmosaic.plans.catalog import query
from vecmosaic.plans.matching import FEATURES, rounded
from vecmosaic.session import written
from vecmosaic.sources.tables import features

#: Features of an image set: those of several images, which are matched with each other.  Every query
#: runs over all sets of the table.
SET = 200
GROUP = f"g AS (SELECT *, id // {SET} AS sid FROM f), zs AS (SELECT sid, count(*) AS n FROM g GROUP BY sid)"
ANGLE = f"""{FEATURES}, {GROUP}, dt AS (SELECT a.sid, a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS c FROM g a JOIN g b ON a.sid = b.sid), mc AS (SELECT sid, max(c) AS most FROM dt GROUP BY sid),
ad AS (SELECT sid, src, dst, acos(least(1.0, greatest(-1.0, c / most))) AS value FROM dt JOIN mc USING (sid) WHERE src <> dst),
ew AS (SELECT sid, src, dst, 1 - value / pi() AS w FROM ad)"""
IMAGES = "im AS (SELECT id AS vertex, img AS image FROM f)"
BY = "set_id"


def group(spark, sf):
    """All features with their image set."""
    return features(spark, sf).withColumn(BY, F.floor(F.col("feature_id") / SET).cast("long"))


def sizes(spark, sf):
    """The number of features of each set."""
    return G.vertex_counts(group(spark, sf), BY)


def edges(spark, sf):
    """The edges inside image sets, written once as most queries read them many times."""
    return written(G.weights(G.angle_distances(group(spark, sf), BY)), "edges")


def images(spark, sf):
    return group(spark, sf).select(F.col("feature_id").alias("vertex"), F.col("image_id").alias("image"))


def communities(spark, sf):
    """A fixed partition of each set that mixes images: the signs of four components."""
    d = lambda k: (F.element_at("descriptor", k) > 0).cast("long")
    return group(spark, sf).select(F.col("feature_id").alias("vertex"), (16 * F.col("set_id") + d(1) + 2 * d(2) + 4 * d(3) + 8 * d(4)).alias("cluster"))


PART = f"pt AS (SELECT id AS vertex, 16 * (id // {SET}) + {' + '.join(f'{1 << k} * (CASE WHEN v[{k + 1}] > 0 THEN 1 ELSE 0 END)' for k in range(4))} AS cluster FROM f)"


def threshold_sql(need: str, n: int, name: str = "th", start: float = 0.0) -> str:
    """``th`` has each set's threshold; ``need`` is an expression of the set's size n.  Weights are counted at the first step below them."""
    at = f"1 + {{0}} * ({start} - 1.0)::DOUBLE / {n - 1}"
    return f"""{name}k AS (SELECT sid, list_filter([greatest(k0 - 1, 0), k0, k0 + 1, k0 + 2], lambda k: w > {at.format('k')})[1] AS k FROM (SELECT sid, w, greatest(0, floor((1 - w) * {n - 1} / (1 - {start}))::BIGINT) AS k0 FROM ew)),
{name}c AS (SELECT sid, k, sum(count(*)) OVER (PARTITION BY sid ORDER BY k) AS c FROM {name}k WHERE k < {n} GROUP BY sid, k),
{name}m AS (SELECT zs.sid, min(k) AS k FROM zs LEFT JOIN {name}c c ON c.sid = zs.sid AND c.c >= {need} GROUP BY zs.sid),
{name} AS (SELECT sid, CASE WHEN k IS NULL THEN {start} WHEN k = 0 THEN 1.0 ELSE {at.format('k')} END::DOUBLE AS t FROM {name}m)"""


@query("GM1_hamming_distances", f"""WITH {FEATURES}, {GROUP}, h AS (SELECT a.id AS src, b.id AS dst, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a.v[i] > 0) <> (b.v[i] > 0) THEN 1 ELSE 0 END))::BIGINT AS value FROM g a JOIN g b ON a.sid = b.sid AND a.id <> b.id)
SELECT * FROM h""")
def hamming(spark, sf):
    w = group(spark, sf).select("feature_id", "set_id", V.sign_words(F.col("descriptor")).alias("words"))
    return G.hamming_distances(w, by=BY)


@query("GM2_angle_distances", f"WITH {ANGLE} SELECT src, dst, round(value, 6) AS value FROM ad")
def angle(spark, sf):
    return rounded(G.angle_distances(group(spark, sf), BY).drop(BY), "value")


@query("GM3_weights", f"WITH {ANGLE} SELECT src, dst, round(w, 6) AS w FROM ew")
def weights(spark, sf):
    return rounded(edges(spark, sf).drop(BY), "w")


@query("GM4_edge_threshold", f"WITH {ANGLE}, {threshold_sql('2.5 * 2 * zs.n', 600)} SELECT sid AS set_id, round(t, 6) AS t FROM th")
def edge_threshold(spark, sf):
    return rounded(G.edge_threshold(edges(spark, sf), sizes(spark, sf), 2.5, by=BY), "t")


PRUNED = f"{ANGLE}, {threshold_sql('2.5 * 2 * zs.n', 600)}, pr AS (SELECT sid, src, dst, w FROM ew JOIN th USING (sid) WHERE w > t AND w <> 1)"


def pruned(spark, sf, full=None):
    return G.prune_threshold(edges(spark, sf) if full is None else full, sizes(spark, sf), 2.5, by=BY)


@query("GM5_prune_threshold", f"WITH {PRUNED} SELECT src, dst, round(w, 6) AS w FROM pr")
def prune_threshold(spark, sf):
    return rounded(pruned(spark, sf).drop(BY), "w")


@query("GM6_prune_fraction", f"WITH {ANGLE}, {threshold_sql('0.05 * zs.n * zs.n', 500)} SELECT src, dst, round(w, 6) AS w FROM ew JOIN th USING (sid) WHERE w > t AND w <> 1")
def prune_fraction(spark, sf):
    return rounded(G.prune_fraction(edges(spark, sf), sizes(spark, sf), 0.05, by=BY).drop(BY), "w")


@query("GM7_prune_rows", f"""WITH {ANGLE}, mx AS (SELECT sid, dst, max(w) AS m FROM ew GROUP BY sid, dst), st AS (SELECT sid, max(m) AS hi, min(m) AS lo, count(*) AS n FROM mx GROUP BY sid),
ks AS (SELECT sid, range AS k, hi + range * (lo - hi) / 999.0 AS t FROM range(1000), st), sh AS (SELECT ks.sid, k, t, count(m) AS c FROM ks JOIN mx ON ks.sid = mx.sid AND m > t GROUP BY ALL),
th AS (SELECT sh.sid, max(t) AS t FROM sh JOIN st USING (sid) WHERE c >= 0.3 * n GROUP BY sh.sid) SELECT src, dst, round(w, 6) AS w FROM ew JOIN th USING (sid) WHERE w > t AND w <> 1""")
def prune_rows(spark, sf):
    return rounded(G.prune_rows(edges(spark, sf), 0.3, by=BY).drop(BY), "w")


@query("TK1_prune_highest", f"""WITH {ANGLE}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM ew)
SELECT src, dst, round(max(w), 6) AS w FROM (SELECT src, dst, w FROM k WHERE r <= 3 UNION ALL SELECT dst, src, w FROM k WHERE r <= 3) GROUP BY src, dst""")
def prune_highest(spark, sf):
    return rounded(G.prune_highest(edges(spark, sf), 3), "w")


@query("AG20_degrees", f"WITH {PRUNED} SELECT src AS vertex, round(sum(w), 6) AS degree FROM pr GROUP BY src")
def degrees(spark, sf):
    return rounded(G.degrees(pruned(spark, sf)), "degree")


MOD = f"""{PRUNED}, {PART}, {IMAGES}, ce AS (SELECT e.*, a.cluster AS c1, b.cluster AS c2 FROM pr e JOIN pt a ON e.src = a.vertex JOIN pt b ON e.dst = b.vertex),
ks AS (SELECT sid, sum(w) AS k FROM pr GROUP BY sid), mp AS (SELECT sid, c1 AS cluster, sum(CASE WHEN c1 = c2 THEN w ELSE 0 END) AS inside, sum(w) AS degree FROM ce GROUP BY sid, c1),
mq AS (SELECT sid, cluster, inside, degree, inside / k - (degree / k) * (degree / k) AS q FROM mp JOIN ks USING (sid))"""


@query("AG21_modularity", f"WITH {MOD} SELECT sid AS set_id, round(sum(q), 6) AS modularity FROM mq GROUP BY sid")
def modularity(spark, sf):
    return rounded(G.modularity(pruned(spark, sf), communities(spark, sf), BY), "modularity")


@query("AG21_modularity_parts", f"WITH {MOD} SELECT cluster::BIGINT AS cluster, round(inside, 6) AS inside, round(degree, 6) AS degree, round(q, 6) AS q FROM mq")
def modularity_parts(spark, sf):
    return rounded(G.modularity_parts(pruned(spark, sf), communities(spark, sf), BY).drop(BY), "inside", "degree", "q")


@query("GM11_move_gains", f"""WITH {MOD}, dg AS (SELECT src AS vertex, sum(w) AS degree FROM pr GROUP BY src), lk AS (SELECT src AS vertex, c2 AS cluster, sum(w) AS links FROM ce GROUP BY ALL)
SELECT lk.vertex, lk.cluster::BIGINT AS cluster, round((2 * links - (dg.degree * (2 * mp.degree - inside) + dg.degree * dg.degree) / k) / k, 6) AS gain FROM lk JOIN dg ON lk.vertex = dg.vertex JOIN mp ON lk.cluster = mp.cluster JOIN ks ON ks.sid = mp.sid""")
def move_gains(spark, sf):
    return rounded(G.move_gains(pruned(spark, sf), communities(spark, sf), BY), "gain")


COH = f"""{MOD}, ci AS (SELECT c.*, a.image AS i1, b.image AS i2 FROM ce c JOIN im a ON c.src = a.vertex JOIN im b ON c.dst = b.vertex WHERE c1 = c2),
co AS (SELECT c1 AS cluster, -(sum(CASE WHEN i1 = 0 AND i2 = 0 THEN w ELSE 0 END) / sum(w) - (sum(CASE WHEN i1 = 0 THEN w ELSE 0 END) / sum(w)) ** 2
 + sum(CASE WHEN i1 = 1 AND i2 = 1 THEN w ELSE 0 END) / sum(w) - (sum(CASE WHEN i1 = 1 THEN w ELSE 0 END) / sum(w)) ** 2) AS coherence FROM ci GROUP BY c1)"""


@query("AG22_coherence", f"WITH {COH} SELECT cluster::BIGINT AS cluster, round(coherence, 6) + 0.0 AS coherence FROM co")
def coherence(spark, sf):
    return G.coherence(pruned(spark, sf), communities(spark, sf), images(spark, sf), 0, 1).select("cluster", (F.round("coherence", 6) + 0.0).alias("coherence"))


TOP = "tp AS (SELECT src AS vertex, max(CASE WHEN r = 1 THEN dst END) AS best, max(CASE WHEN r = 1 THEN w END) AS w1, coalesce(max(CASE WHEN r = 2 THEN w END), 0) AS w2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM ew) WHERE r <= 2 GROUP BY src)"


@query("WN2_uniqueness", f"WITH {ANGLE}, {TOP} SELECT vertex, round(w2 / w1, 6) AS uniqueness FROM tp")
def uniqueness(spark, sf):
    return rounded(G.uniqueness(edges(spark, sf)), "uniqueness")


@query("GM14_mutual_best", f"WITH {ANGLE}, {IMAGES}, {TOP} SELECT a.vertex AS i, a.best AS j, round(a.w2 / a.w1, 6) AS ratio, round(a.w1, 6) AS w FROM tp a JOIN tp b ON a.best = b.vertex AND b.best = a.vertex JOIN im x ON x.vertex = a.vertex JOIN im y ON y.vertex = a.best WHERE a.w2 / a.w1 < 0.99 AND b.w2 / b.w1 < 0.99 AND x.image = 0 AND y.image <> 0")
def mutual_best(spark, sf):
    return rounded(G.mutual_best(edges(spark, sf), images(spark, sf), 0.99), "ratio", "w")


COMM = f"""{MOD}, {TOP}, inn AS (SELECT c.*, a.image AS s, b.image AS d FROM ce c JOIN im a ON c.src = a.vertex JOIN im b ON c.dst = b.vertex WHERE c1 = c2),
cr AS (SELECT *, count(*) OVER (PARTITION BY c1, s, d) AS n FROM inn WHERE s < d),
sg AS (SELECT cr.src AS i, cr.dst AS j, x.w2 / w AS ratio, w FROM cr JOIN tp x ON cr.src = x.vertex JOIN tp y ON cr.dst = y.vertex WHERE n = 1 AND x.w1 = y.w1 AND x.w2 / w < 0.999 AND y.w2 / w < 0.999),
sv AS (SELECT DISTINCT c1, s AS i1, d AS i2 FROM cr WHERE n > 1), lo AS (SELECT sv.*, inn.src, inn.dst, inn.w, inn.s, inn.d FROM inn JOIN sv ON inn.c1 = sv.c1 AND inn.s IN (i1, i2) AND inn.d IN (i1, i2)),
lr AS (SELECT *, row_number() OVER (PARTITION BY c1, i1, i2, src ORDER BY w DESC, dst) AS r FROM lo),
lb AS (SELECT c1, i1, i2, src, s, max(CASE WHEN r = 1 THEN dst END) AS dst, max(CASE WHEN r = 1 THEN d END) AS d, max(CASE WHEN r = 1 THEN w END) AS w, coalesce(max(CASE WHEN r = 2 THEN w END), 0) AS w2 FROM lr WHERE r <= 2 GROUP BY ALL),
lm AS (SELECT a.src AS i, a.dst AS j, a.w2 / a.w AS ratio, a.w FROM lb a JOIN lb b ON a.c1 = b.c1 AND a.i1 = b.i1 AND a.i2 = b.i2 AND a.src = b.dst AND a.dst = b.src WHERE a.w2 / a.w < 0.999 AND b.w2 / b.w < 0.999 AND a.s = a.i1 AND a.d = a.i2)"""


def community_matches(spark, sf):
    full = edges(spark, sf)
    return G.community_matches(written(pruned(spark, sf, full), "pruned"), full, communities(spark, sf), images(spark, sf), 0.999)


@query("GM13_community_matches", f"WITH {COMM} SELECT i, j, round(ratio, 6) AS ratio, round(w, 6) AS w FROM (SELECT * FROM sg UNION ALL SELECT * FROM lm)")
def community(spark, sf):
    return rounded(community_matches(spark, sf), "ratio", "w")


@query("GM17_community_similarity", f"WITH {COMM}, ms AS (SELECT i // {SET} AS sid, count(*) AS c FROM (SELECT * FROM sg UNION ALL SELECT * FROM lm) GROUP BY ALL) SELECT zs.sid AS set_id, coalesce(c, 0) AS n_matches, round(coalesce(c, 0)::DOUBLE / n, 6) AS similarity FROM zs LEFT JOIN ms USING (sid)")
def community_similarity(spark, sf):
    found = community_matches(spark, sf).groupBy(F.floor(F.col("i") / SET).alias(BY)).agg(F.count(F.lit(1)).alias("c"))
    n = F.coalesce("c", F.lit(0))
    return rounded(sizes(spark, sf).join(found, BY, "left").select(BY, n.alias("n_matches"), (n / F.col("vertices")).alias("similarity")), "similarity")


@query("GM15_heaviest_cross_edges", f"""WITH {COH}, x AS (SELECT c1 AS cluster, src, dst, w, row_number() OVER (PARTITION BY c1 ORDER BY w DESC, src, dst) AS r, count(*) OVER (PARTITION BY c1) AS n FROM ci WHERE i1 = 0 AND i2 = 1)
SELECT x.cluster::BIGINT AS cluster, src AS i, dst AS j, round(w, 6) AS w, n FROM x JOIN co ON x.cluster = co.cluster WHERE r = 1 AND n >= 1 AND coherence >= -1""")
def heaviest(spark, sf):
    return rounded(G.heaviest_cross_edges(pruned(spark, sf), communities(spark, sf), images(spark, sf), 0, 1), "w")


POS = f"{FEATURES}, {GROUP}, pd AS (SELECT a.id AS src, b.id AS dst, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS value FROM g a JOIN g b ON a.sid = b.sid AND a.id <> b.id)"


@query("GM18_position_distances", f"WITH {POS} SELECT src, dst, round(value, 4) AS value FROM pd")
def position_distances(spark, sf):
    return G.position_distances(group(spark, sf), BY).select("src", "dst", F.round("value", 4).alias("value"))


@query("GM19_geometric_weights", f"""WITH {ANGLE}, {IMAGES}, pd AS (SELECT a.sid, a.id AS src, b.id AS dst, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS value FROM g a JOIN g b ON a.sid = b.sid AND a.id <> b.id)
SELECT pd.src, pd.dst, round(CASE WHEN a.image = b.image THEN value / max(value) OVER (PARTITION BY pd.sid) ELSE coalesce(w, 0) END, 6) AS w FROM pd LEFT JOIN ew ON pd.src = ew.src AND pd.dst = ew.dst JOIN im a ON pd.src = a.vertex JOIN im b ON pd.dst = b.vertex""")
def geometric_weights(spark, sf):
    return rounded(G.geometric_weights(edges(spark, sf), G.position_distances(group(spark, sf), BY), images(spark, sf), BY), "w")


@query("PF10_vertex_filter", f"WITH {FEATURES}, {PART} SELECT vertex FROM pt WHERE cluster % 16 IN (1, 3, 5)")
def vertex_filter(spark, sf):
    return communities(spark, sf).where((F.col("cluster") % 16).isin(1, 3, 5)).select("vertex")


@query("PF11_positive_edges", f"WITH {PRUNED} SELECT count(*) AS n FROM pr WHERE w > 0")
def positive_edges(spark, sf):
    return pruned(spark, sf).where("w > 0").agg(F.count(F.lit(1)).alias("n"))


@query("ST4_mask_union", f"WITH {FEATURES}, {PART} SELECT vertex, (cluster % 16 IN (1, 3) OR vertex % 3 = 0) AS either, (cluster % 16 IN (1, 3) AND vertex % 3 = 0) AS together FROM pt")
def mask_union(spark, sf):
    a, b = (F.col("cluster") % 16).isin(1, 3), F.col("vertex") % 3 == 0
    return communities(spark, sf).select("vertex", (a | b).alias("either"), (a & b).alias("together"))


@query("AG19_partition_links", f"WITH {MOD} SELECT c1::BIGINT AS p1, c2::BIGINT AS p2, count(*) AS n FROM ce GROUP BY ALL")
def partition_links(spark, sf):
    e = G._clustered(pruned(spark, sf).drop(BY), communities(spark, sf))
    return e.groupBy(F.col("c1").alias("p1"), F.col("c2").alias("p2")).agg(F.count(F.lit(1)).alias("n"))


@query("GM28_image_indices", "SELECT label::INTEGER AS image_id, (dense_rank() OVER (ORDER BY m) - 1)::INTEGER AS place FROM (SELECT label, min(vec_id) AS m FROM embeddings GROUP BY label)")
def image_indices(spark, sf):
    from pyspark.sql import Window

    first = features(spark, sf).groupBy("image_id").agg(F.min("feature_id").alias("m"))
    return first.select("image_id", (F.dense_rank().over(Window.orderBy("m")) - 1).alias("place"))


@query("TK4_heaviest_edge", f"WITH {PRUNED} SELECT src, dst, round(w, 6) AS w FROM pr WHERE src < dst ORDER BY w DESC, src, dst LIMIT 1")
def heaviest_edge(spark, sf):
    return rounded(pruned(spark, sf).where("src < dst").orderBy(F.desc("w"), "src", "dst").limit(1).drop(BY), "w")


RES = f"""{FEATURES}, sc AS (SELECT a.id AS p1, b.id AS p2, CASE WHEN (a.id + b.id) % 7 = 0 THEN 'NaN'::DOUBLE ELSE list_distance(a.v, b.v) END AS score FROM f a JOIN f b ON b.id BETWEEN a.id + 1 AND a.id + 8),
bo AS (SELECT p1, p2, CASE WHEN isnan(score) THEN 0 ELSE score END AS v FROM sc UNION ALL SELECT p2, p1, CASE WHEN isnan(score) THEN 0 ELSE score END FROM sc)"""


def next_ones(f, n, key="feature_id"):
    """Rows with the ids of the ``n`` that follow theirs in ``next_id``."""
    return f.withColumn("next_id", F.explode(F.sequence(F.col(key) + 1, F.col(key) + n)))


def named_scores(spark, sf):
    a, b = next_ones(features(spark, sf), 8).alias("a"), features(spark, sf).alias("b")
    d = F.when((F.col("a.feature_id") + F.col("b.feature_id")) % 7 == 0, F.lit(float("nan"))).otherwise(V.euclidean(F.col("a.descriptor"), F.col("b.descriptor")))
    return a.join(b, F.col("a.next_id") == F.col("b.feature_id")).select(F.col("a.feature_id").alias("p1"), F.col("b.feature_id").alias("p2"), d.alias("score"))


@query("JN22_result_matrix", f"WITH {RES} SELECT p1, p2, round((v - (SELECT least(min(v), 0) FROM bo)) / (SELECT greatest(max(v), 0) - least(min(v), 0) FROM bo), 6) AS value FROM bo")
def result_matrix(spark, sf):
    return rounded(G.result_matrix(named_scores(spark, sf)), "value")


@query("GM30_face_graph", f"WITH {RES}, m AS (SELECT p1 AS src, p2 AS dst, 1 - (v - (SELECT least(min(v), 0) FROM bo)) / (SELECT greatest(max(v), 0) - least(min(v), 0) FROM bo) AS w FROM bo) SELECT src, dst, round(w, 6) AS w FROM m WHERE w > 0.3 AND w <> 1")
def face_graph(spark, sf):
    m = G.result_matrix(named_scores(spark, sf)).select(F.col("p1").alias("src"), F.col("p2").alias("dst"), (1 - F.col("value")).alias("w"))
    return rounded(G.above(m, 0.3), "w")


SCORED = f"""{COH}, bt AS (SELECT cluster FROM pt JOIN im ON pt.vertex = im.vertex GROUP BY cluster HAVING count(*) FILTER (image = 0) > 0 AND count(*) FILTER (image = 1) > 0),
ms AS (SELECT mq.sid, mq.cluster, q AS m, coherence AS c, q / tq.total AS share FROM mq JOIN bt USING (cluster) JOIN co USING (cluster) JOIN (SELECT sid, sum(q) AS total FROM mq JOIN bt USING (cluster) GROUP BY sid) tq ON tq.sid = mq.sid),
sr AS (SELECT sid, cluster, share, m, c, CASE WHEN c > 0 THEN m + c ELSE 0 END * share AS score FROM ms)"""


@query("GM32_cluster_scores", f"WITH {SCORED} SELECT cluster::BIGINT AS cluster, round(share, 6) AS share, round(m, 6) AS m, round(c, 6) + 0.0 AS c, round(score, 6) + 0.0 AS score FROM sr")
def cluster_scores(spark, sf):
    out = rounded(G.match_scores(pruned(spark, sf), communities(spark, sf), images(spark, sf), BY).drop(BY), "share", "m", "c", "score")
    return out.withColumn("c", F.col("c") + 0.0).withColumn("score", F.col("score") + 0.0)


@query("GM32_scoring_hook", f"WITH {SCORED} SELECT cluster::BIGINT AS cluster, round(greatest(m, c) * share, 6) + 0.0 AS score FROM ms")
def scoring_hook(spark, sf):
    """The same with a scoring function handed in."""
    s = G.match_scores(pruned(spark, sf), communities(spark, sf), images(spark, sf), BY, scoring=F.greatest)
    return s.select("cluster", (F.round("score", 6) + 0.0).alias("score"))


@query("GM33_bipartite_scores", f"""WITH {COH}, bt AS (SELECT cluster, cluster // 16 AS sid FROM pt JOIN im ON pt.vertex = im.vertex GROUP BY cluster HAVING count(*) FILTER (image = 0) > 1 AND count(*) FILTER (image = 1) > 1),
mn AS (SELECT c1 AS cluster, avg(w) AS mean FROM ci WHERE i1 = 0 AND i2 = 1 GROUP BY c1) SELECT bt.cluster::BIGINT AS cluster, round(mean / count(*) OVER (PARTITION BY sid) / 10, 6) AS score FROM bt LEFT JOIN mn USING (cluster)""")
def bipartite(spark, sf):
    part = communities(spark, sf).withColumn(BY, F.floor(F.col("cluster") / 16))
    return rounded(G.bipartite_scores(pruned(spark, sf).drop(BY), part, images(spark, sf), BY), "score")


DEV = "dv AS (SELECT pt.cluster, img AS image_id, sqrt((var_pop(x) + var_pop(y)) / 2) AS sd FROM pt JOIN f ON pt.vertex = f.id GROUP BY ALL)"


@query("AG18_partition_deviation", f"WITH {FEATURES}, {PART}, {DEV} SELECT cluster::BIGINT AS cluster, image_id, round(sd, 6) AS sd FROM dv")
def deviation(spark, sf):
    return rounded(G.partition_deviation(communities(spark, sf), group(spark, sf)), "sd")


@query("AG17_mean_position", f"WITH {FEATURES}, {PART} SELECT cluster::BIGINT AS cluster, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(0.1 * sqrt((var_pop(x) + var_pop(y)) / 2), 6) AS spread FROM pt JOIN f ON pt.vertex = f.id GROUP BY cluster")
def mean_position(spark, sf):
    rows = communities(spark, sf).join(group(spark, sf).withColumnRenamed("feature_id", "vertex"), "vertex")
    return rounded(rows.groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (0.1 * F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2)).alias("spread")), "mx", "my", "spread")


@query("GM34_geometry_multiplier", f"WITH {FEATURES}, {PART}, {DEV} SELECT cluster::BIGINT AS cluster, round(CASE WHEN max(sd) < 3 THEN 1.0 ELSE 3.0 / max(sd) END, 6)::DOUBLE AS multiplier, round(CASE WHEN count(*) < 20 THEN count(*) * (40.0 - count(*)) / 400.0 ELSE 1.0 END, 6)::DOUBLE AS certainty FROM dv GROUP BY cluster")
def multiplier(spark, sf):
    d = G.partition_deviation(communities(spark, sf), group(spark, sf))
    return rounded(d.groupBy("cluster").agg(G.geometry_multiplier(F.max("sd")).alias("multiplier"), G.certainty(F.count(F.lit(1)).cast("double")).alias("certainty")), "multiplier", "certainty")


@query("GM35_image_score", f"""WITH {SCORED}, {DEV}, mu AS (SELECT cluster, CASE WHEN max(sd) < 3 THEN 1.0 ELSE 3.0 / max(sd) END AS k FROM dv WHERE image_id IN (0, 1) GROUP BY cluster)
SELECT sid AS set_id, round(sum(score * k) * CASE WHEN count(*) < 20 THEN count(*) * (40.0 - count(*)) / 400.0 ELSE 1.0 END, 6) + 0.0 AS score, count(*) AS n_clusters FROM sr JOIN mu USING (cluster) GROUP BY sid""")
def image_score(spark, sf):
    d = G.partition_deviation(communities(spark, sf), group(spark, sf)).where("image_id in (0, 1)").groupBy("cluster").agg(G.geometry_multiplier(F.max("sd")).alias("k"))
    s = G.match_scores(pruned(spark, sf), communities(spark, sf), images(spark, sf), BY).join(d, "cluster")
    n = F.count(F.lit(1)).cast("double")
    return s.groupBy(BY).agg((F.round(F.sum(F.col("score") * F.col("k")) * G.certainty(n), 6) + 0.0).alias("score"), F.count(F.lit(1)).alias("n_clusters"))
