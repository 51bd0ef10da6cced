"""Queries over neighbour joins and matchers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.functions import vectors as V
from vecmosaic.operators import match as M
from vecmosaic.operators.balltree import BallOptions, ball_tree
from vecmosaic.operators.knn import KnnOptions, knn_join, radius_counts
from vecmosaic.plans.catalog import query
from vecmosaic.sources.tables import features

FEATURES = """f AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS INTEGER) AS img, CAST(embedding AS DOUBLE[]) AS v,
  500 + 500 * CAST(embedding[1] AS DOUBLE) AS x, 500 + 500 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""
PAIRS = f"""{FEATURES},
p AS (SELECT a.id AS q, a.img AS qi, b.id AS t, b.img AS ti, list_distance(a.v, b.v) AS d FROM f a JOIN f b ON a.id <> b.id)"""
SCOPE_SQL = {"all": "TRUE", "same": "qi = ti", "other": "qi <> ti"}


def ranked_sql(name: str, scope: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS r FROM p WHERE {SCOPE_SQL[scope]})"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def side(df: DataFrame, image: int) -> DataFrame:
    return df.where(F.col("image_id") == image)


KNN_SQL = "SELECT q, qi, CAST(r AS INTEGER) AS r, t, ti, round(d, 6) AS d FROM {0} WHERE r <= {1}"

for _scope in ("all", "same", "other"):
    query(f"JN1_knn_exact_{_scope}", f"WITH {PAIRS}, {ranked_sql('k', _scope)} {KNN_SQL.format('k', 3)}")(
        lambda spark, sf, s=_scope: rounded(knn_join(features(spark, sf), options=KnnOptions(k=3, scope=s)), "d")
    )
for _strategy in ("grid", "sql"):
    query(f"JN3_knn_{_strategy}", f"WITH {PAIRS}, {ranked_sql('k', 'all')} {KNN_SQL.format('k', 2)}")(
        lambda spark, sf, s=_strategy: rounded(knn_join(features(spark, sf), options=KnnOptions(k=2, strategy=s, block=200)), "d")
    )
query("JN2_knn_forest_all_leaves", f"WITH {PAIRS}, {ranked_sql('k', 'other')} {KNN_SQL.format('k', 3)}")(
    lambda spark, sf: rounded(knn_join(features(spark, sf), options=KnnOptions(k=3, scope="other", strategy="forest", precision=1.0)), "d")
)
query("JN2_knn_approximate")(lambda spark, sf: knn_join(features(spark, sf), options=KnnOptions(k=3, strategy="forest")))

CROSS = f"""{FEATURES}, p AS (SELECT a.id AS q, a.img AS qi, b.id AS t, b.img AS ti, list_distance(a.v, b.v) AS d FROM f a JOIN f b ON a.img = 0 AND b.img = 1)"""
BRUTE_SQL = f"""WITH {CROSS}, {ranked_sql('k', 'all')},
m AS (SELECT q AS i, max(CASE WHEN r = 1 THEN t END) AS j, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM k WHERE r <= 3 GROUP BY q HAVING count(*) = 3)
SELECT i, j, round(d1, 6) AS score, round(d1 / (d2 + 0.00001), 6) AS ratio FROM m"""


@query("JN4_brute_force", BRUTE_SQL)
def brute_force(spark, sf):
    f = features(spark, sf)
    return rounded(M.brute_match(side(f, 0), side(f, 1)), "score", "ratio")


@query("JN8_ratio_match", BRUTE_SQL + " WHERE d1 / (d2 + 0.00001) < 0.95")
def ratio_match(spark, sf):
    f = features(spark, sf)
    return rounded(M.below(M.brute_match(side(f, 0), side(f, 1)), 0.95), "score", "ratio")


@query(
    "JN9_naive_match",
    f"""WITH {FEATURES}, p AS (SELECT a.id AS q, a.img AS qi, b.id AS t, b.img AS ti, list_distance(a.v, b.v) AS d FROM f a JOIN f b ON a.id <> b.id AND a.img = 2 AND b.img = 2), {ranked_sql('k', 'all')},
m AS (SELECT q AS i, max(CASE WHEN r = 1 THEN t END) AS j, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM k WHERE r <= 2 GROUP BY q HAVING count(*) = 2)
SELECT i, j, round(d1, 6) AS score, round(d1 / (d2 + 0.00001), 6) AS ratio FROM m""",
)
def naive_match(spark, sf):
    f = side(features(spark, sf), 2)
    return rounded(M.brute_match(f, f, match_same=True), "score", "ratio")


_JOIN = {"all": "ka", "same": "ks", "other": "ko"}
for (_p, _b), (_scope, _ranks, _bscope, _brank) in M.RULES.items():
    _sql = f"""WITH {PAIRS}, {ranked_sql('ka', 'all')}, {ranked_sql('ks', 'same')}, {ranked_sql('ko', 'other')}
SELECT n.q, n.qi, CAST(n.r AS INTEGER) AS r, n.t, n.ti, round(n.d, 6) AS d, round(n.d / b.d, 6) AS ratio
FROM {_JOIN[_scope]} n LEFT JOIN {_JOIN[_bscope]} b ON n.q = b.q AND b.r = {_brank} WHERE n.r IN ({', '.join(map(str, _ranks))})"""
    query(f"JN5_ratio_{_p}_against_{_b}", _sql)(lambda spark, sf, p=_p, b=_b: rounded(M.ratio_rows(features(spark, sf), M.RatioOptions(p, b)), "d", "ratio"))

ORIENTED_SQL = f"""{PAIRS}, {ranked_sql('k', 'all')},
n AS (SELECT a.q, a.qi, a.t, a.ti, a.d AS score, a.d / b.d AS ratio FROM k a JOIN k b ON a.q = b.q AND a.r = 1 AND b.r = 2 WHERE a.qi <> a.ti),
o AS (SELECT CASE WHEN qi < ti THEN q ELSE t END AS i, CASE WHEN qi < ti THEN t ELSE q END AS j, least(qi, ti) AS im_i, greatest(qi, ti) AS im_j, score, ratio, qi, q FROM n),
m AS (SELECT i, j, im_i, im_j, score, ratio FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY qi, q) AS rn FROM o) WHERE rn = 1)"""
MATCH_SQL = "SELECT i, j, im_i, im_j, round(score, 6) AS score, round(ratio, 6) AS ratio FROM m"


@query("JN6_symmetric_dedupe", f"WITH {ORIENTED_SQL} {MATCH_SQL}")
def symmetric_dedupe(spark, sf):
    return rounded(M.first_of_pairs(M.oriented(M.ratio_rows(features(spark, sf), M.RatioOptions("all", "all")))), "score", "ratio")


@query("JN7_mirror_match", f"WITH {ORIENTED_SQL} {MATCH_SQL} WHERE ratio < 1.0")
def mirror(spark, sf):
    return rounded(M.mirror_match(features(spark, sf)), "score", "ratio")


@query("PF3_threshold_filter", f"WITH {ORIENTED_SQL} {MATCH_SQL} WHERE ratio < 0.97")
def threshold(spark, sf):
    return rounded(M.mirror_match(features(spark, sf), 0.97), "score", "ratio")


@query("PF2_match_positions", f"""WITH {ORIENTED_SQL} SELECT m.i, m.j, round(a.x, 6) AS x1, round(a.y, 6) AS y1, round(b.x, 6) AS x2, round(b.y, 6) AS y2 FROM m JOIN f a ON m.i = a.id JOIN f b ON m.j = b.id""")
def positions(spark, sf):
    f = features(spark, sf)
    return rounded(M.with_positions(M.mirror_match(f, 9.0), f).select("i", "j", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")


@query("PF1_positions", f"WITH {FEATURES} SELECT id AS feature_id, round(x, 6) AS x, round(y, 6) AS y FROM f")
def keypoints(spark, sf):
    return rounded(features(spark, sf).select("feature_id", "x", "y"), "x", "y")


@query("PF4_cross_image_orientation", f"""WITH {PAIRS}, {ranked_sql('k', 'all')}
SELECT CASE WHEN qi < ti THEN q ELSE t END AS i, CASE WHEN qi < ti THEN t ELSE q END AS j, least(qi, ti) AS im_i, greatest(qi, ti) AS im_j FROM k WHERE r = 1 AND qi <> ti""")
def orientation(spark, sf):
    near = knn_join(features(spark, sf), options=KnnOptions(k=1)).withColumn("ratio", F.lit(1.0))
    return M.oriented(near).select("i", "j", "im_i", "im_j")


@query("PF5_filter_features", f"WITH {FEATURES} SELECT id AS feature_id, img AS image_id FROM f WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_features(spark, sf):
    drop = spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("long").alias("feature_id"))
    return features(spark, sf).select("feature_id", "image_id").join(drop, "feature_id", "left_anti")


MUTUAL_SQL = f"""{FEATURES}, p AS (SELECT a.id AS q, b.id AS t, list_distance(a.v, b.v) AS d FROM f a JOIN f b ON a.img = 0 AND b.img = 1),
ab AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS r FROM p), ba AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, q) AS r FROM p),
m AS (SELECT x.q AS i, x.t AS j, x.d AS score, x.d / s.d AS ratio FROM ab x JOIN ba y ON x.q = y.q AND x.t = y.t AND x.r = 1 AND y.r = 1 JOIN ab s ON s.q = x.q AND s.r = 2)"""


@query("JN10_mutual_nearest", f"WITH {MUTUAL_SQL} SELECT i, j, round(score, 6) AS score, round(ratio, 6) AS ratio FROM m")
def mutual(spark, sf):
    f = features(spark, sf)
    return rounded(M.mutual_nearest(side(f, 0), side(f, 1)), "score", "ratio")


@query("JN10_set_similarity", f"""WITH {MUTUAL_SQL} SELECT count(*) AS n_matches, (SELECT count(*) FROM f WHERE img IN (0, 1)) AS n_features,
round(count(*) * 1.0 / (SELECT count(*) FROM f WHERE img IN (0, 1)), 6)::DOUBLE AS similarity FROM m WHERE ratio < 0.96""")
def similarity(spark, sf):
    f = features(spark, sf)
    return rounded(M.set_similarity(side(f, 0), side(f, 1), 0.96), "similarity")


@query("JN11_radius_groups", f"WITH {FEATURES} SELECT a.id AS feature_id, count(*) AS group_size FROM f a JOIN f b ON list_distance(a.v, b.v) <= 1.2 GROUP BY a.id")
def radius_groups(spark, sf):
    return radius_counts(features(spark, sf), 1.2)


@query("JN12_radius_match", f"""WITH {PAIRS}, {ranked_sql('k', 'all')}, g AS (SELECT a.id, count(*) AS n FROM f a JOIN f b ON list_distance(a.v, b.v) <= 1.2 GROUP BY a.id)
SELECT a.q AS i, a.t AS j, round(a.d, 6) AS score, round(a.d / b.d * CASE WHEN g.n >= 4 THEN 1.2 ELSE 1.0 END, 6) AS ratio
FROM k a JOIN k b ON a.q = b.q AND a.r = 1 AND b.r = 2 JOIN g ON g.id = a.q WHERE a.qi < a.ti AND a.d / b.d * CASE WHEN g.n >= 4 THEN 1.2 ELSE 1.0 END < 1.15""")
def radius_match(spark, sf):
    return rounded(M.ball_match(features(spark, sf), "radius", 1.15, radius=1.2, ratio_boost=1.2, group_limit=4), "score", "ratio")


def tree_sql(leaf: int, radius: float, levels: int = 14) -> str:
    """The ball tree by its levels: ``lv`` has each row's node level by level, ``nd`` the nodes, ``sn`` the selected ones, ``mb`` their rows."""
    steps = [f"{FEATURES}, lv0 AS MATERIALIZED (SELECT id, img, v, 1::BIGINT AS node FROM f)"]
    for k in range(levels):
        steps.append(f"""sp{k} AS (SELECT node, d, max(e) - min(e) AS spread FROM (SELECT node, unnest(v) AS e, generate_subscripts(v, 1) AS d FROM lv{k}) GROUP BY node, d),
dm{k} AS (SELECT node, d FROM sp{k} QUALIFY row_number() OVER (PARTITION BY node ORDER BY spread DESC, d) = 1),
lv{k + 1} AS MATERIALIZED (SELECT id, img, v, CASE WHEN n <= {2 * leaf} THEN node ELSE 2 * node + (rn > n // 2)::INTEGER END AS node
  FROM (SELECT l.*, count(*) OVER (PARTITION BY l.node) AS n, row_number() OVER (PARTITION BY l.node ORDER BY v[d], id) AS rn FROM lv{k} l JOIN dm{k} ON l.node = dm{k}.node))""")
    steps.append(f"""al AS (SELECT DISTINCT node, id FROM ({' UNION ALL '.join(f'SELECT node, id FROM lv{k}' for k in range(levels + 1))})),
ce AS (SELECT node, list(m ORDER BY d) AS c FROM (SELECT node, d, avg(e) AS m FROM (SELECT al.node, unnest(v) AS e, generate_subscripts(v, 1) AS d FROM al JOIN f ON al.id = f.id) GROUP BY node, d) GROUP BY node),
nd AS (SELECT al.node, count(*) AS n, max(list_distance(v, c)) AS radius, count(*) <= {2 * leaf} AS is_leaf FROM al JOIN f ON al.id = f.id JOIN ce ON al.node = ce.node GROUP BY al.node),
ft AS (SELECT * FROM nd WHERE radius < {radius} OR is_leaf),
up AS (SELECT node, node >> k AS above FROM ft, (SELECT unnest(range(1, {levels + 1})) AS k) WHERE node >> k > 0),
sn AS (SELECT * FROM ft WHERE node NOT IN (SELECT up.node FROM up JOIN ft ON up.above = ft.node)),
mb AS (SELECT sn.node, f.* FROM sn JOIN al ON sn.node = al.node JOIN f ON al.id = f.id),
p AS (SELECT a.id AS q, a.img AS qi, b.id AS t, b.img AS ti, list_distance(a.v, b.v) AS d FROM mb a JOIN mb b ON a.node = b.node AND a.id <> b.id)""")
    return ", ".join(steps)


LEAF, SMALL = 5, 0.93
SPEED_SQL = f"""WITH {tree_sql(LEAF, SMALL)}, {ranked_sql('k', 'all')},
m AS (SELECT a.q AS i, a.t AS j, a.d AS score, a.d / s.d AS ratio FROM k a JOIN k b ON a.t = b.q AND b.t = a.q AND a.r = 1 AND b.r = 1 LEFT JOIN k s ON s.q = a.q AND s.r = 2 WHERE a.qi < a.ti AND a.d < 100)"""


@query("JN13_speed_match", f"{SPEED_SQL} SELECT i, j, round(score, 6) AS score, round(ratio, 6) AS ratio FROM m")
def speed_match(spark, sf):
    return rounded(M.speed_match(features(spark, sf), M.SpeedOptions(leaf=LEAF, radius=SMALL)), "score", "ratio")


@query("JN14_nodes", f"WITH {tree_sql(LEAF, SMALL)} SELECT node, n, round(radius, 6) AS radius, is_leaf FROM sn")
def nodes(spark, sf):
    return rounded(ball_tree(features(spark, sf), BallOptions(leaf=LEAF)).selected(SMALL).select("node", "n", "radius", "is_leaf"), "radius")


@query("JN14_tree", f"WITH {tree_sql(LEAF, SMALL)} SELECT node, n, round(radius, 6) AS radius, is_leaf FROM nd")
def whole_tree(spark, sf):
    """Every node, with the parts split further in small blocks."""
    return rounded(ball_tree(features(spark, sf), BallOptions(leaf=LEAF, block=64)).nodes.select("node", "n", "radius", "is_leaf"), "radius")


@query("JN15_match_type_speed", f"{SPEED_SQL} SELECT i, j FROM m WHERE score < 1.3 AND ratio < 0.97")
def match_type(spark, sf):
    return M.ball_match(features(spark, sf), "speed", 0.97, leaf=LEAF, radius=SMALL, dist_threshold=1.3).select("i", "j")


@query("JN24_angle_match", f"""WITH {FEATURES}, p AS (SELECT a.id AS q, a.img AS qi, b.id AS t, b.img AS ti, acos(greatest(-1.0, least(1.0, 0.9999 * list_dot_product(a.v, b.v)))) AS d FROM f a JOIN f b ON a.img = 0 AND b.img = 1), {ranked_sql('k', 'all')}
SELECT a.q AS i, a.t AS j, round(a.d, 6) AS score FROM k a JOIN k b ON a.q = b.q AND a.r = 1 AND b.r = 2 WHERE a.d < 0.97 * b.d""")
def angle_match(spark, sf):
    f = features(spark, sf)
    return rounded(M.angle_match(side(f, 0), side(f, 1), 0.97), "score")


@query("JN20_all_pairs", "SELECT a.label AS p1, b.label AS p2 FROM (SELECT DISTINCT label FROM embeddings) a JOIN (SELECT DISTINCT label FROM embeddings) b ON a.label < b.label")
def all_pairs(spark, sf):
    images = features(spark, sf).select("image_id").distinct()
    return images.select(F.col("image_id").alias("p1")).join(images.select(F.col("image_id").alias("p2")), F.col("p1") < F.col("p2"))


@query("JN23_same_label", "SELECT count(*) FILTER (a.label = b.label) AS n_same, count(*) FILTER (a.label <> b.label) AS n_diff FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def same_label(spark, sf):
    """Pairs are counted from the sizes of the labels, without making them."""
    n = features(spark, sf).where("image_id is not null").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    both = n.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n_same"), F.sum("n").alias("all"))
    return both.select(F.coalesce("n_same", F.lit(0)).alias("n_same"), F.coalesce(F.expr("`all` * (`all` - 1) div 2 - n_same"), F.lit(0)).alias("n_diff"))


@query("PF6_keep_match", f"""WITH {PAIRS}, {ranked_sql('k', 'all')} SELECT a.q AS i, a.t AS j, round(a.d, 6) AS score FROM k a JOIN k b ON a.t = b.q AND b.t = a.q AND a.r = 1 AND b.r = 1 WHERE a.qi < a.ti AND a.d < 1.25""")
def keep_match(spark, sf):
    near = knn_join(features(spark, sf), options=KnnOptions(k=1))
    back = near.select(F.col("q").alias("t"), F.col("t").alias("back"))
    return rounded(near.join(back, "t").where("back = q and qi < ti and d < 1.25").select(F.col("q").alias("i"), F.col("t").alias("j"), F.col("d").alias("score")), "score")


@query("PF7_pair_orientation", f"WITH {PAIRS} SELECT CASE WHEN qi <= ti THEN q ELSE t END AS first_id, CASE WHEN qi <= ti THEN t ELSE q END AS second_id FROM p WHERE t BETWEEN q + 1 AND q + 8")
def pair_orientation(spark, sf):
    f = features(spark, sf).select("feature_id", "image_id")
    near = f.withColumn("next_id", F.explode(F.sequence(F.col("feature_id") + 1, F.col("feature_id") + 8)))
    p = near.alias("a").join(f.alias("b"), F.col("a.next_id") == F.col("b.feature_id"))
    low = F.col("a.image_id") <= F.col("b.image_id")
    return p.select(F.when(low, F.col("a.feature_id")).otherwise(F.col("b.feature_id")).alias("first_id"), F.when(low, F.col("b.feature_id")).otherwise(F.col("a.feature_id")).alias("second_id"))


GREEDY_SQL = f"""WITH RECURSIVE {ORIENTED_SQL}, g AS (SELECT im_i, im_j, m.i, m.j, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, row_number() OVER (PARTITION BY im_i, im_j ORDER BY m.i, m.j) AS k FROM m JOIN f a ON m.i = a.id JOIN f b ON m.j = b.id),
w(im_i, im_j, k, kept) AS (SELECT im_i, im_j, 1::BIGINT, [{{'i': i, 'j': j, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] FROM g WHERE k = 1 UNION ALL
  SELECT g.im_i, g.im_j, g.k, CASE WHEN len(list_filter(kept, lambda z: sqrt((z.x1 - g.x1) ** 2 + (z.y1 - g.y1) ** 2) < 20 AND sqrt((z.x2 - g.x2) ** 2 + (z.y2 - g.y2) ** 2) < 20)) > 0 THEN kept
  ELSE list_append(kept, {{'i': g.i, 'j': g.j, 'x1': g.x1, 'y1': g.y1, 'x2': g.x2, 'y2': g.y2}}) END FROM w JOIN g ON g.im_i = w.im_i AND g.im_j = w.im_j AND g.k = w.k + 1),
z AS (SELECT im_i, im_j, unnest(kept) AS q FROM w QUALIFY row_number() OVER (PARTITION BY im_i, im_j ORDER BY k DESC) = 1)"""
query("PF8_distinct_matches", f"{GREEDY_SQL} SELECT q.i AS i, q.j AS j, im_i, im_j FROM z")(lambda spark, sf: M.distinct_matches(M.with_positions(M.mirror_match(features(spark, sf), 9.0), features(spark, sf)), 20.0).select("i", "j", "im_i", "im_j"))

PRUNE_SQL = f"""{ORIENTED_SQL}, z AS (SELECT m.i, m.j, b.x + 500 - a.x AS dx, b.y - a.y AS dy FROM m JOIN f a ON m.i = a.id JOIN f b ON m.j = b.id),
l AS (SELECT i, j, sqrt(dx * dx + dy * dy) AS length, acos(greatest(-1.0, least(1.0, dx / (sqrt(dx * dx + dy * dy) + 0.001)))) AS angle FROM z),
s AS (SELECT median(length) AS ml, stddev_pop(length) AS sl, median(angle) AS ma, stddev_pop(angle) AS sa FROM l)"""


@query("PF9_pruned_matches", f"WITH {PRUNE_SQL} SELECT i, j, round(length, 6) AS length, round(angle, 6) AS angle FROM l, s WHERE abs(length - ml) <= sl AND abs(angle - ma) <= sa")
def prune(spark, sf):
    f = features(spark, sf)
    return rounded(M.pruned_matches(M.with_positions(M.mirror_match(f, 9.0), f)).select("i", "j", "length", "angle"), "length", "angle")


@query("SF13_match_angle_length", f"WITH {PRUNE_SQL} SELECT i, j, round(length, 6) AS length, round(angle, 6) AS angle FROM l")
def angle_length(spark, sf):
    f = features(spark, sf)
    rows = M.with_positions(M.mirror_match(f, 9.0), f)
    dx, dy = F.col("x2") + 500 - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    return rounded(rows.select("i", "j", length.alias("length"), F.acos(dx / (length + 0.001)).alias("angle")), "length", "angle")


@query("PF15_descriptor_slice", f"WITH {FEATURES} SELECT id AS feature_id, CAST(len(v[1:16]) AS INTEGER) AS n, round(list_sum(v[1:16]), 6) AS total FROM f")
def descriptor_slice(spark, sf):
    part = F.slice("descriptor", 1, 16)
    return rounded(features(spark, sf).select("feature_id", F.size(part).alias("n"), V.total(part).alias("total")), "total")


@query("WN1_rank_within_query", f"WITH {PAIRS}, {ranked_sql('k', 'other')} SELECT q, max(CASE WHEN r = 1 THEN t END) AS t1, max(CASE WHEN r = 2 THEN t END) AS t2, max(CASE WHEN r = 3 THEN t END) AS t3 FROM k WHERE r <= 3 GROUP BY q")
def ranks(spark, sf):
    near = knn_join(features(spark, sf), options=KnnOptions(k=3, scope="other"))
    return near.groupBy("q").agg(*[F.max(F.when(F.col("r") == n, F.col("t"))).alias(f"t{n}") for n in (1, 2, 3)])


@query("ST1_concatenate", "SELECT CAST(vec_id AS BIGINT) AS feature_id, CAST(label AS INTEGER) AS image_id FROM embeddings WHERE label IN (0, 1) UNION ALL SELECT vec_id, label FROM embeddings WHERE label = 1")
def concatenate(spark, sf):
    f = features(spark, sf).select("feature_id", "image_id")
    return f.where("image_id in (0, 1)").unionByName(f.where("image_id = 1"))


@query("ST2_distinct", "SELECT DISTINCT CAST(label AS INTEGER) AS image_id FROM embeddings")
def distinct(spark, sf):
    return features(spark, sf).select("image_id").distinct()


@query("ST3_seen_set", f"WITH {PAIRS}, {ranked_sql('k', 'all')} SELECT least(q, t) AS i, greatest(q, t) AS j FROM k WHERE r <= 2 GROUP BY ALL")
def seen_set(spark, sf):
    return knn_join(features(spark, sf), options=KnnOptions(k=2)).select(F.least("q", "t").alias("i"), F.greatest("q", "t").alias("j")).dropDuplicates()


@query("ST5_anti_set", "SELECT CAST(vec_id AS BIGINT) AS feature_id FROM embeddings EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0")
def anti_set(spark, sf):
    seen = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 7 = 0").select(F.col("o_custkey").cast("long").alias("feature_id"))
    return features(spark, sf).select("feature_id").join(seen, "feature_id", "left_anti")


@query("ST6_flatten", f"WITH {FEATURES} SELECT img AS image_id, round(sum(e), 6) AS total, count(*) AS n FROM (SELECT img, unnest(v) AS e FROM f) GROUP BY img")
def flatten(spark, sf):
    flat = features(spark, sf).select("image_id", F.explode("descriptor").alias("e"))
    return rounded(flat.groupBy("image_id").agg(F.sum("e").alias("total"), F.count(F.lit(1)).alias("n")), "total")
