"""Queries over pair scores and their normalisations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmosaic.operators import match as M
from vecmosaic.operators import scores as S
from vecmosaic.plans.catalog import query
from vecmosaic.plans.matching import ORIENTED_SQL, rounded
from vecmosaic.sources.tables import features

PS = f"""{ORIENTED_SQL}, s1 AS (SELECT im_i, im_j, sum(1.0 / ratio - 1) AS score, count(*) AS n FROM m WHERE ratio < 1.0 GROUP BY ALL),
ps AS (SELECT im_i AS i, im_j AS j, score, n FROM s1 UNION ALL SELECT im_j, im_i, score, n FROM s1)"""
DN = f"""{PS}, ii AS (SELECT DISTINCT img FROM f), d AS (SELECT a.img AS i, b.img AS j, coalesce(score, 0)::DOUBLE AS v FROM ii a JOIN ii b ON TRUE LEFT JOIN ps ON ps.i = a.img AND ps.j = b.img)"""


def scores(spark, sf):
    return S.pair_scores(M.mirror_match(features(spark, sf), 9.0))


def matrix(spark, sf):
    return S.dense(scores(spark, sf), features(spark, sf).select("image_id").distinct(), "score")


def mat(name, sql, f):
    query(name, f"WITH {DN} {sql}")(lambda spark, sf: f(matrix(spark, sf)).select("i", "j", (F.round("v", 6) + 0.0).alias("v")))


@query("AG6_pair_scores", f"WITH {PS} SELECT i, j, round(score, 6) AS score, n FROM ps")
def pair_scores(spark, sf):
    return rounded(scores(spark, sf), "score")


mat("AG7_norm_counts", "SELECT i, j, round(v / (least(a.r, b.r) / 1000), 6) + 0.0 AS v FROM d JOIN (SELECT i AS k, sum(v) AS r FROM d GROUP BY i) a ON d.i = a.k JOIN (SELECT i AS k, sum(v) AS r FROM d GROUP BY i) b ON d.j = b.k", S.norm_counts)
mat("AG8_normalize_matches", "SELECT i, j, round(1000 * v / (sum(v) OVER (PARTITION BY i) + sum(v) OVER (PARTITION BY j)), 6) + 0.0 AS v FROM d", S.normalize_matches)
mat(
    "AG9_norm_scores",
    """, t AS (SELECT i AS k, avg(v) AS t FROM (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM d) WHERE r <= 5 GROUP BY i), mm AS (SELECT avg(v) AS m FROM d WHERE v > 0)
SELECT i, j, round(least(1.0, greatest(0.0, v / greatest(least(a.t, b.t), m))), 6) + 0.0 AS v FROM d JOIN t a ON d.i = a.k JOIN t b ON d.j = b.k, mm""",
    S.norm_scores,
)
mat(
    "AG12_cap",
    """, q AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM d), z AS (SELECT m, s, 1 / (1 + exp(-(0 - m) / (0.5 * s))) AS z FROM q) SELECT i, j, round((1 / (1 + exp(-(v - m) / (0.5 * s))) - z) / (1 - z), 6) + 0.0 AS v FROM d, z""",
    S.cap,
)
mat("AG10_trim", ", t AS (SELECT avg(x) AS t FROM (SELECT max(v) AS x FROM d GROUP BY j)) SELECT i, j, round(least(1.0, greatest(0.0, (v - 0.1 * t) / (0.8 * t))), 6) + 0.0 AS v FROM d, t", lambda m: S.trim(m, (0.1, 0.9)))
mat("PF16_set_diagonal", "SELECT i, j, round(CASE WHEN i = j THEN 7.0 ELSE v END, 6) + 0.0 AS v FROM d", lambda m: S.set_diag(m, 7))
mat(
    "AG11_normalize_scores",
    """, c AS (SELECT 0.5 * avg(v) / max(v) AS lo, 2.0 * (avg(v) + stddev_pop(v)) / max(v) AS hi FROM d), nb AS (SELECT j AS k, avg(v) AS near FROM (SELECT j, v, row_number() OVER (PARTITION BY j ORDER BY i DESC) AS r FROM d) WHERE r <= 5 GROUP BY j)
SELECT i, j, round(CASE WHEN abs(i - j) > 7 THEN 0 WHEN i = j THEN 1 WHEN v < 0.2 THEN 0 ELSE least(1.0, greatest(0.0, (v / near - lo) / (hi - lo))) END, 6) + 0.0 AS v FROM d JOIN nb ON d.j = nb.k, c""",
    lambda m: S.normalize_scores(m, 0.2, 7),
)


@query("WN3_gradients", f"""WITH {DN} SELECT i, row_number() OVER (PARTITION BY i ORDER BY v DESC, j DESC)::INTEGER AS k, round(v, 6) AS v, round(CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END, 6) + 0.0 AS gradient
FROM (SELECT *, lag(v) OVER (PARTITION BY i ORDER BY v, j) AS b, lead(v) OVER (PARTITION BY i ORDER BY v, j) AS a FROM d)""")
def gradients(spark, sf):
    return S.gradients(matrix(spark, sf)).select("i", "k", F.round("v", 6).alias("v"), (F.round("gradient", 6) + 0.0).alias("gradient"))


@query("AG13_soft_f1", f"""WITH {DN}, t AS (SELECT avg(x) AS t FROM (SELECT max(v) AS x FROM d GROUP BY j)), rt AS (SELECT least(1.0, greatest(0.0, v / t)) AS r, CASE WHEN (i - j) % 3 = 0 THEN 1.0 ELSE 0.0 END AS g FROM d, t),
q AS (SELECT sum(least(r, g)) AS tp, sum(greatest(r - g, 0)) AS fp, sum(greatest(g - r, 0)) AS fn FROM rt)
SELECT round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM q""")
def soft_f1(spark, sf):
    r = S.trim(matrix(spark, sf))
    truth = r.select("i", "j", F.when((F.col("i") - F.col("j")) % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("v"))
    return rounded(S.soft_f1(r, truth), "precision", "recall", "f1")


@query("AG14_match_descriptors", f"""WITH {PS}, pr AS (SELECT a.img AS p1, b.img AS p2 FROM (SELECT DISTINCT img FROM f) a JOIN (SELECT DISTINCT img FROM f) b ON a.img < b.img), g AS (SELECT im_i, im_j, avg(score) AS s FROM m WHERE ratio < 0.97 GROUP BY ALL)
SELECT p1, p2, round(coalesce(s, 1.0), 6) AS score FROM pr LEFT JOIN g ON p1 = im_i AND p2 = im_j""")
def match_descriptors(spark, sf):
    im = features(spark, sf).select("image_id").distinct()
    pairs = im.select(F.col("image_id").alias("p1")).join(im.select(F.col("image_id").alias("p2")), F.col("p1") < F.col("p2"))
    return rounded(S.pair_aggregate(M.mirror_match(features(spark, sf), 0.97), pairs, F.avg("score"), 1.0), "score")


@query("AG15_image_to_image", f"WITH {PS} SELECT round(avg(score), 6) AS score FROM m WHERE im_i = 0 AND im_j = 1")
def image_to_image(spark, sf):
    return rounded(M.mirror_match(features(spark, sf), 9.0).where("im_i = 0 and im_j = 1").agg(F.avg("score").alias("score")), "score")


@query("AG27_row_scores", f"""WITH {DN}, r AS (SELECT i, j, v, (i % 3) = (j % 3) AS same FROM d WHERE i <> j),
w AS (SELECT *, avg(CASE WHEN same THEN v END) OVER (PARTITION BY i) AS a, avg(CASE WHEN NOT same THEN v END) OVER (PARTITION BY i) AS b, stddev_pop(v) OVER (PARTITION BY i) AS s FROM r)
SELECT i, j, same, round((v - (coalesce(a, b) + coalesce(b, a)) / 2) / (s + 0.1), 6) + 0.0 AS v FROM w""")
def row_scores(spark, sf):
    labels = features(spark, sf).select("image_id").distinct().select("image_id", (F.col("image_id") % 3).alias("label"))
    out = S.score_separation_by_row(matrix(spark, sf), labels)
    return out.select("i", "j", "same", (F.round("v", 6) + 0.0).alias("v"))


NAMES = "SELECT CAST(c_custkey AS INTEGER) AS image_id, c_mktsegment || '_' || c_name || '.jpg' AS name FROM customer"


def names(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("int").alias("image_id"), F.concat("c_mktsegment", F.lit("_"), "c_name", F.lit(".jpg")).alias("name"))


@query("SO1_sorted_labels", f"SELECT image_id, name, row_number() OVER (ORDER BY left(name, 3), image_id)::INTEGER AS place FROM ({NAMES})")
def sorted_labels(spark, sf):
    return S.sorted_labels(names(spark, sf))


@query("SO3_sorted_occurrences", "SELECT c_mktsegment AS tag, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 4")
def sorted_occurrences(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.groupBy(F.col("c_mktsegment").alias("tag")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4").orderBy(F.desc("n"), F.desc("tag"))


@query("SF10_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 5000)), 6) AS s FROM customer")
def sigmoid(spark, sf):
    from vecmosaic.functions.vectors import sigmoid as f

    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.round(f(F.col("c_acctbal") / 5000), 6).alias("s"))


@query("SF12_image_label", f"SELECT image_id, array_to_string(list_slice(string_split(string_split('/a/b/' || name, '/')[-1], '_'), 1, greatest(len(string_split(string_split('/a/b/' || name, '/')[-1], '_')) - 1, 0)), ' ') AS label FROM ({NAMES})")
def label(spark, sf):
    from vecmosaic.functions.vectors import image_label

    return names(spark, sf).select("image_id", image_label(F.concat(F.lit("/a/b/"), "name")).alias("label"))


@query("SF15_red_green", "SELECT c_custkey, printf('#%02x%02x11', trunc(255 * (1 - s))::INTEGER, trunc(255 * s)::INTEGER) AS colour FROM (SELECT c_custkey, (c_custkey % 11) / 10.0::DOUBLE AS s FROM customer)")
def red_green(spark, sf):
    from vecmosaic.functions.vectors import red_green as f

    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", f((F.col("c_custkey") % 11) / F.lit(10.0)).alias("colour"))


query("SNK4_score_table")(lambda spark, sf: S.score_table(matrix(spark, sf)))


@query("SRC14_image_files", f"SELECT name FROM ({NAMES}) WHERE regexp_matches(name, '\\.(jpg|png)$')")
def image_files(spark, sf):
    return names(spark, sf).where(F.col("name").rlike(r"\.(jpg|png)$")).select("name")


@query("SRC10_pair_keys", "SELECT DISTINCT p_brand AS pair FROM part WHERE length(p_brand) <= 8 AND p_brand <> ''")
def pair_keys(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").where("length(p_brand) <= 8 and p_brand <> ''").select(F.col("p_brand").alias("pair")).distinct()
