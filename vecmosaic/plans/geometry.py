"""Queries over homographies, epipolar lines and precision curves, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmosaic.operators import curves as C
from vecmosaic.operators import geometry as G
from vecmosaic.operators import match as M
from vecmosaic.plans.catalog import query
from vecmosaic.plans.matching import FEATURES, ORIENTED_SQL, rounded, side
from vecmosaic.sources.tables import features

H = [1.01, 0.02, 5.0, -0.01, 0.99, -3.0, 1e-5, -2e-5, 1.0]
HI = G.inverse(H)
F_AC = [0.0, -0.001, 0.3, 0.0012, 0.0, -0.5, -0.28, 0.45, 1.0]
F_AB = [0.0, -0.0008, 0.2, 0.001, 0.0, -0.4, -0.25, 0.35, 2.0]
F_BC = [0.0, -0.0011, 0.25, 0.0009, 0.0, -0.35, -0.2, 0.4, 1.5]
THRESHOLDS = [0.9, 0.94, 0.97, 1.0]
T_SQL = "(SELECT unnest([0.9, 0.94, 0.97, 1.0])::DOUBLE AS threshold)"


def apply_sql(h, x, y):
    h = [repr(float(v)) + "::DOUBLE" for v in h]
    w = f"({h[6]} * {x} + {h[7]} * {y} + {h[8]})"
    return f"(({h[0]} * {x} + {h[1]} * {y} + {h[2]}) / {w})", f"(({h[3]} * {x} + {h[4]} * {y} + {h[5]}) / {w})"


def error_sql(x1="x1", y1="y1", x2="x2", y2="y2"):
    (hx, hy), (bx, by) = apply_sql(H, x1, y1), apply_sql(HI, x2, y2)
    return f"(sqrt(({hx} - {x2}) * ({hx} - {x2}) + ({hy} - {y2}) * ({hy} - {y2})) + sqrt(({bx} - {x1}) * ({bx} - {x1}) + ({by} - {y1}) * ({by} - {y1})))"


ERRORS = f"""{ORIENTED_SQL}, w AS (SELECT m.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM m JOIN f a ON m.i = a.id JOIN f b ON m.j = b.id),
e AS (SELECT *, {error_sql()} AS error FROM w)"""


def matches(spark, sf):
    f = features(spark, sf)
    return M.with_positions(M.mirror_match(f, 9.0), f)


def points(spark, sf, image):
    return side(features(spark, sf), image).select(F.col("feature_id").alias("id"), "x", "y")


@query("SF1_transfer_error", f"WITH {ERRORS} SELECT i, j, round(error, 6) AS error FROM e")
def transfer(spark, sf):
    return rounded(G.with_errors(matches(spark, sf), H).select("i", "j", "error"), "error")


_hx, _hy = apply_sql(H, "x", "y")
_bx, _by = apply_sql(HI, _hx, _hy)


@query("SF14_homography_round_trip", f"WITH {FEATURES} SELECT id, round({_hx}, 6) AS hx, round({_hy}, 6) AS hy, round({_bx} - x, 3) + 0.0 AS back_x, round({_by} - y, 3) + 0.0 AS back_y FROM f")
def homography(spark, sf):
    p = features(spark, sf).select(F.col("feature_id").alias("id"), "x", "y")
    hx, hy = G.apply(H, F.col("x"), F.col("y"))
    bx, by = G.apply(HI, hx, hy)
    return p.select("id", F.round(hx, 6).alias("hx"), F.round(hy, 6).alias("hy"), (F.round(bx - F.col("x"), 3) + 0.0).alias("back_x"), (F.round(by - F.col("y"), 3) + 0.0).alias("back_y"))


@query("BD1_evaluate", f"WITH {ERRORS} SELECT threshold, i, j, round(error, 6) AS error FROM e, {T_SQL} t WHERE ratio < threshold")
def evaluate(spark, sf):
    return rounded(G.evaluate(matches(spark, sf), H, THRESHOLDS).select("threshold", "i", "j", "error"), "error")


COUNTS = f"{ERRORS}, c AS (SELECT im_i, im_j, threshold, count(*) FILTER (error <= 150) AS n_correct, count(*) AS n_total FROM e, {T_SQL} t WHERE ratio < threshold GROUP BY ALL)"


def counted(spark, sf):
    return G.counts_by_threshold(G.with_errors(matches(spark, sf), H), THRESHOLDS, 150.0, ("im_i", "im_j"))


query("AG1_folder_match", f"WITH {COUNTS} SELECT * FROM c")(counted)

CORR = f"""{FEATURES}, c AS (SELECT a.id AS a, b.id AS b, {error_sql("a.x", "a.y", "b.x", "b.y")} AS error FROM f a JOIN f b ON a.img = 0 AND b.img = 1)"""


@query("JN16_correspondences", f"WITH {CORR} SELECT a, b, round(error, 6) AS error FROM c WHERE error <= 60")
def correspondences(spark, sf):
    return rounded(G.correspondences(points(spark, sf, 0), points(spark, sf, 1), H, 60.0), "error")


@query("AG2_folder_correspondences", f"WITH {CORR} SELECT count(*) AS n FROM c WHERE error <= 60")
def correspondence_count(spark, sf):
    return G.correspondences(points(spark, sf, 0), points(spark, sf, 1), H, 60.0).agg(F.count(F.lit(1)).alias("n"))


@query("AG3_turntable_counts", f"WITH {ERRORS} SELECT threshold, count(*) FILTER (error < 150) AS n_correct, count(*) AS n_total FROM e, {T_SQL} t WHERE ratio <= threshold GROUP BY threshold")
def turntable(spark, sf):
    return G.counts_by_threshold(G.with_errors(matches(spark, sf), H), THRESHOLDS, 150.0, (), strict=True, inclusive_ratio=True)


@query("AG4_evaluate_objects", f"WITH {ERRORS} SELECT im_i AS object, count(*) FILTER (error < 150 AND ratio <= 0.97) AS n_correct, count(*) FILTER (ratio <= 0.97) AS n_total FROM e GROUP BY im_i")
def objects(spark, sf):
    e = G.with_errors(matches(spark, sf), H)
    ok = F.col("ratio") <= 0.97
    return e.groupBy(F.col("im_i").alias("object")).agg(F.count_if(ok & (F.col("error") < 150)).alias("n_correct"), F.count_if(ok).alias("n_total"))


def line_sql(f, alias, x="x", y="y"):
    a, b, c = (f"({f[3 * k]!r}::DOUBLE * {x} + {f[3 * k + 1]!r}::DOUBLE * {y} + {f[3 * k + 2]!r}::DOUBLE)" for k in range(3))
    n = f"sqrt({a} * {a} + {b} * {b})"
    return f"{a} / {n} AS la, {b} / {n} AS lb, {c} / {n} AS lc"


LINES = f"""{FEATURES}, ac AS (SELECT id, {line_sql(F_AC, 'f')} FROM f WHERE img = 0), ab AS (SELECT id, {line_sql(F_AB, 'f')} FROM f WHERE img = 0), bc AS (SELECT id, {line_sql(F_BC, 'f')} FROM f WHERE img = 1)"""


@query("SF11_epipolar_lines", f"WITH {LINES} SELECT id, round(la, 6) AS la, round(lb, 6) AS lb, round(lc, 6) AS lc FROM ac")
def epilines(spark, sf):
    return rounded(G.lines(points(spark, sf, 0), F_AC), "la", "lb", "lc")


@query("JN17_band_join", f"WITH {LINES} SELECT l.id AS line, p.id AS point, round(abs(la * x + lb * y + lc), 6) AS dist FROM ac l JOIN f p ON p.img = 2 AND abs(la * x + lb * y + lc) < 8")
def band(spark, sf):
    return rounded(G.band_join(G.lines(points(spark, sf, 0), F_AC), points(spark, sf, 2), 8.0), "dist")


VIEWS = f"""{ORIENTED_SQL}, {LINES.replace(FEATURES + ', ', '').replace(' WHERE img = 0', '').replace(' WHERE img = 1', '')}, im AS (SELECT DISTINCT img AS view FROM f),
mt AS (SELECT m.i AS a, m.j AS c, view, q.x AS cx, q.y AS cy FROM m JOIN f q ON m.j = q.id JOIN im ON view <> im_i AND view <> im_j WHERE ratio < 9.0),
d AS (SELECT mt.*, abs(la * cx + lb * cy + lc) AS d_ac FROM mt JOIN ac ON mt.a = ac.id),
nb AS (SELECT DISTINCT d.a, d.view, p.id AS b FROM d JOIN ab l ON l.id = d.a JOIN f p ON p.img = d.view AND abs(l.la * x + l.lb * y + l.lc) < 30),
h AS (SELECT d.a, d.c, d.view, min(abs(la * cx + lb * cy + lc)) AS d_bc FROM d JOIN nb ON d.a = nb.a AND d.view = nb.view JOIN bc ON bc.id = nb.b WHERE d.d_ac < 30 GROUP BY ALL)"""


def seen_by(spark, sf):
    """Every match between two images with each third image as the view that verifies it."""
    views = features(spark, sf).select(F.col("image_id").alias("view")).distinct()
    m = matches(spark, sf).select(F.col("i").alias("a"), F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("j").alias("c"), F.col("x2").alias("cx"), F.col("y2").alias("cy"), "im_i", "im_j")
    return m.join(views, (F.col("view") != F.col("im_i")) & (F.col("view") != F.col("im_j"))).drop("im_i", "im_j")


def verified(spark, sf):
    everyone = features(spark, sf).select(F.col("feature_id").alias("id"), F.col("image_id").alias("view"), "x", "y")
    return G.two_hop(seen_by(spark, sf), everyone, F_AC, F_AB, F_BC, 30.0, "view")


@query("JN18_two_hop_verification", f"WITH {VIEWS} SELECT d.a, d.c, d.view, round(CASE WHEN d_bc IS NOT NULL THEN greatest(d_ac, d_bc) ELSE d_ac END, 6) AS error FROM d LEFT JOIN h ON d.a = h.a AND d.c = h.c AND d.view = h.view")
def two_hop(spark, sf):
    return rounded(verified(spark, sf), "error")


VIEW3 = f"""{LINES}, g AS (SELECT DISTINCT l.id AS a, p.id AS c FROM ac l JOIN f p ON p.img = 2 AND abs(l.la * p.x + l.lb * p.y + l.lc) < 30
JOIN ab k ON k.id = l.id JOIN f b ON b.img = 1 AND abs(k.la * b.x + k.lb * b.y + k.lc) < 30 JOIN bc j ON j.id = b.id AND abs(j.la * p.x + j.lb * p.y + j.lc) < 30)"""


def three(spark, sf, once=False):
    return G.three_view(*(points(spark, sf, k) for k in range(3)), F_AC, F_AB, F_BC, 30.0, once)


query("JN19_three_view_truth", f"WITH {VIEW3} SELECT a, c FROM g")(three)


@query("AG5_ground_truth", f"WITH {VIEW3} SELECT count(DISTINCT a) AS n_with, (SELECT count(*) FROM f WHERE img = 0) - count(DISTINCT a) AS n_without FROM g")
def truth(spark, sf):
    n = points(spark, sf, 0).agg(F.count(F.lit(1))).scalar()
    return three(spark, sf, once=True).agg(F.count_distinct("a").alias("n_with")).select("n_with", (n - F.col("n_with")).alias("n_without"))


CURVE = f"""{COUNTS}, s AS (SELECT threshold, sum(n_correct)::BIGINT AS n_correct, sum(n_total)::BIGINT AS n_total FROM c GROUP BY threshold),
pr AS (SELECT threshold, n_correct, n_total, CASE WHEN n_total = 0 THEN 1.0 ELSE n_correct::DOUBLE / n_total END AS "precision", n_correct::DOUBLE / (SELECT max(n_correct) FROM s) AS recall FROM s)"""


@query("AG29_precision_recall", f'WITH {CURVE} SELECT threshold, n_correct, n_total, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM pr')
def curve(spark, sf):
    return rounded(C.precision_recall(counted(spark, sf)), "precision", "recall")


@query("AG30_accuracy_detail", f"WITH {CURVE} SELECT im_i, im_j, threshold, n_correct, n_total, round(n_correct::DOUBLE / n_total, 6) AS accuracy FROM c WHERE threshold = (SELECT min(threshold) FROM s WHERE n_correct >= 20)")
def detail(spark, sf):
    return rounded(C.accuracy_at_count(counted(spark, sf), 20), "accuracy")


LEGS = """legs AS (SELECT recall, "precision" AS p, lead(recall) OVER (ORDER BY recall) AS r2, lead("precision") OVER (ORDER BY recall) AS p2 FROM (SELECT recall, max("precision") AS "precision" FROM pr GROUP BY recall)),
ip AS (SELECT x AS recall, p + (p2 - p) * (x - recall) / (r2 - recall) AS "precision" FROM legs JOIN (SELECT range / 99.0::DOUBLE AS x FROM range(100)) ON x >= recall AND x < r2)"""


@query("AG31_interpolated_precision", f'WITH {CURVE}, {LEGS} SELECT round(recall, 6) AS recall, round("precision", 6) AS "precision" FROM ip')
def interpolation(spark, sf):
    return rounded(C.interpolated(C.precision_recall(counted(spark, sf)), 100), "recall", "precision")


@query("AG31_false_positives_removed", f'WITH {CURVE}, {LEGS} SELECT round(recall, 6) AS recall, round(("precision" - (0.5 * "precision")) / (1 - 0.5 * "precision"), 6) AS improvement FROM ip')
def improvement(spark, sf):
    pr = C.precision_recall(counted(spark, sf))
    return rounded(C.false_positives_removed(pr, pr.withColumn("precision", F.col("precision") * 0.5), 100).select("recall", "improvement"), "recall", "improvement")


SAME = f"""{FEATURES}, sc AS (SELECT a.img = b.img AS same, list_distance(a.v, b.v) AS score, a.id AS i, b.id AS j FROM f a JOIN f b ON b.id BETWEEN a.id + 1 AND a.id + 20)"""


def pair_scores(spark, sf):
    from vecmosaic.functions.vectors import euclidean

    f = features(spark, sf)
    a, b = f.withColumn("next_id", F.explode(F.sequence(F.col("feature_id") + 1, F.col("feature_id") + 20))).alias("a"), f.alias("b")
    return a.join(b, F.col("a.next_id") == F.col("b.feature_id")).select(
        F.col("a.feature_id").alias("i"), F.col("b.feature_id").alias("j"), (F.col("a.image_id") == F.col("b.image_id")).alias("same"), euclidean(F.col("a.descriptor"), F.col("b.descriptor")).alias("score")
    )


@query("AG32_roc_rates", f"""WITH {SAME}, t AS (SELECT range AS k, (SELECT min(score) FROM sc) + range * ((SELECT max(score) FROM sc) - (SELECT min(score) FROM sc)) / 49 AS threshold FROM range(50))
SELECT round(threshold, 6) AS threshold, round(count(*) FILTER (same AND score <= threshold)::DOUBLE / (SELECT count(*) FROM sc WHERE same), 6) AS tpr, round(count(*) FILTER (NOT same AND score <= threshold)::DOUBLE / (SELECT count(*) FROM sc WHERE NOT same), 6) AS fpr FROM t, sc GROUP BY k, threshold""")
def roc(spark, sf):
    return rounded(C.rates(pair_scores(spark, sf), 50), "threshold", "tpr", "fpr")


@query("AG25_score_separation", f"""WITH {SAME}, s AS (SELECT avg(score) FILTER (same) AS ms, avg(score) FILTER (NOT same) AS md, var_pop(score) FILTER (same) AS vs, var_pop(score) FILTER (NOT same) AS vd, count(*) FILTER (same) AS ns, count(*) FILTER (NOT same) AS nd FROM sc)
SELECT round(ms, 6) AS mean_same, round(md, 6) AS mean_diff, round((ns * vs + nd * vd) / (ns + nd), 6) AS pooled_var, round((ms - md) / sqrt((ns * vs + nd * vd) / (ns + nd)), 6) AS separation FROM s""")
def separation(spark, sf):
    return rounded(C.separation(pair_scores(spark, sf)), "mean_same", "mean_diff", "pooled_var", "separation")


RATIO_SQL = f"""WITH {SAME}, b AS (SELECT i, same, score FROM sc UNION ALL SELECT j, same, score FROM sc), r AS (SELECT i, least(3.0, avg(score) FILTER (same) / avg(score) FILTER (NOT same)) AS ratio FROM b GROUP BY i)"""


@query("AG26_score_ratio", f"{RATIO_SQL} SELECT count(*) FILTER (ratio < 1) AS below, count(*) FILTER (ratio = 1) AS equal, count(*) FILTER (ratio > 1) AS above, count(*) FILTER (ratio >= 3) AS clipped FROM r")
def score_ratio(spark, sf):
    s = pair_scores(spark, sf)
    both = s.select("i", "same", "score").union(s.select(F.col("j"), "same", "score"))
    of = lambda k: F.avg(F.when(F.col("same") == k, F.col("score")))
    r = both.groupBy("i").agg(F.least(F.lit(3.0), F.try_divide(of(True), of(False))).alias("ratio"))
    return r.agg(
        F.count_if(F.col("ratio") < 1).alias("below"), F.count_if(F.col("ratio") == 1).alias("equal"), F.count_if(F.col("ratio") > 1).alias("above"), F.count_if(F.col("ratio") >= 3).alias("clipped")
    )


@query("AG28_distance_shares", f"WITH {ERRORS} SELECT round(count(*) FILTER (error <= 150)::DOUBLE / count(*), 6) AS share, count(*) FILTER (error <= 2 * (SELECT median(error) FROM e)) AS n_typical, round(median(error), 6) AS median_error FROM e")
def distance_shares(spark, sf):
    e = G.with_errors(matches(spark, sf), H)
    mid = e.agg(F.median("error")).scalar()
    return rounded(e.agg((F.count_if(F.col("error") <= 150) / F.count(F.lit(1))).alias("share"), F.count_if(F.col("error") <= 2 * mid).alias("n_typical"), F.median("error").alias("median_error")), "share", "median_error")


@query("AG34_histogram", "WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT least(19, floor((o_totalprice - a) / (b - a) * 20))::INTEGER AS bin, count(*) AS n FROM orders, s GROUP BY 1")
def histogram(spark, sf):
    return C.histogram(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", 20)


@query("AG23_label_counts", "SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_crop = G.crop_homography(H, 10, 20, 4, 5, 0.5)
_cx, _cy = apply_sql(_crop, "x", "y")


@query("PF18_crop_homography", f"WITH {FEATURES} SELECT id, round({_cx}, 6) AS cx, round({_cy}, 6) AS cy FROM f")
def crop(spark, sf):
    p = features(spark, sf).select(F.col("feature_id").alias("id"), "x", "y")
    cx, cy = G.apply(_crop, F.col("x"), F.col("y"))
    return p.select("id", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query("PF12_filter_pair", f"WITH {ORIENTED_SQL} SELECT i, j FROM m WHERE im_i = 0 AND im_j = 1")
def pair_filter(spark, sf):
    return M.mirror_match(features(spark, sf), 9.0).where("im_i = 0 and im_j = 1").select("i", "j")


@query("AG16_occurrences", f"WITH {ORIENTED_SQL} SELECT im_i, im_j, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 4")
def occurrences(spark, sf):
    return M.mirror_match(features(spark, sf), 9.0).groupBy("im_i", "im_j").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").orderBy(F.desc("n"), F.desc("im_i"), F.desc("im_j"))


@query("BD5_ratio_benchmark", f"""WITH {ERRORS} SELECT threshold, count(*) FILTER (error <= 150) AS n_correct, count(*) AS n_total FROM e, {T_SQL} t WHERE ratio < threshold AND im_i = 0 GROUP BY threshold""")
def ratio_benchmark(spark, sf):
    return G.counts_by_threshold(G.with_errors(matches(spark, sf).where("im_i = 0"), H), THRESHOLDS, 150.0)


query("GM37_pair_homographies")(lambda spark, sf: G.homographies(matches(spark, sf), rounds=100, limit=40.0))
