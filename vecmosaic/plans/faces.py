"""Queries over vector distances, subspaces, classifiers and cross-validation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmosaic.functions import vectors as V
from vecmosaic.operators import faces as X
from vecmosaic.plans.catalog import query
from vecmosaic.plans.matching import rounded
from vecmosaic.sources.tables import faces, table

FACES = f"""fa AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS INTEGER) AS label, CAST(vec_id % 5 AS INTEGER) AS grp, CAST(embedding AS DOUBLE[]) AS vec, list_transform(CAST(embedding AS DOUBLE[]), lambda e: abs(e)) AS h FROM embeddings)"""
DIM = "range(1, len(a.h) + 1)"


def people(spark, sf):
    return faces(spark, sf)


def histograms(spark, sf):
    return people(spark, sf).withColumn("vec", F.transform("vec", lambda x: F.abs(x)))


def _sum(term: str) -> str:
    return f"list_sum(list_transform({DIM}, lambda k: {term}))"


_P, _Q = "a.h[k]", "b.h[k]"
_A = "abs(1 - list_dot_product(a.h, b.h))"
_EPS = "2.220446049250313e-16::DOUBLE"
DIST_SQL = {
    "euclidean": "list_distance(a.h, b.h)",
    "cosine": "-list_cosine_similarity(a.h, b.h)",
    "correlation": f"1 - {_sum(f'({_P} - list_avg(a.h)) * ({_Q} - list_avg(b.h))')} / sqrt({_sum(f'({_P} - list_avg(a.h)) ** 2')} * {_sum(f'({_Q} - list_avg(b.h)) ** 2')})",
    "chi_square": _sum(f"({_P} - {_Q}) ** 2 / ({_P} + {_Q} + {_EPS})"),
    "intersection": _sum(f"least({_P}, {_Q})"),
    "bin_ratio": f"abs({_sum(f'(({_P} - {_Q}) ** 2 + 2 * {_A} * {_P} * {_Q}) / (({_P} + {_Q}) ** 2 + {_EPS})')})",
    "l1_bin_ratio": f"abs({_sum(f'abs({_P} - {_Q}) * (({_P} - {_Q}) ** 2 + 2 * {_A} * {_P} * {_Q}) / (({_P} + {_Q}) ** 2 + {_EPS})')})",
    "chi_square_bin_ratio": f"abs({_sum(f'({_P} - {_Q}) ** 2 * (({_P} - {_Q}) ** 2 + 2 * {_A} * {_P} * {_Q}) / (({_P} + {_Q}) ** 3 + {_EPS})')})",
}
_IDS = {"euclidean": "SF2", "cosine": "SF3", "correlation": "SF4", "chi_square": "SF5", "intersection": "SF6", "bin_ratio": "SF7", "l1_bin_ratio": "SF8", "chi_square_bin_ratio": "SF9"}


def distance_table(spark, sf, name):
    """Each row against the four that follow it."""
    h = histograms(spark, sf)
    a, b = h.withColumn("next_id", F.explode(F.sequence(F.col("id") + 1, F.col("id") + 4))).alias("a"), h.alias("b")
    return a.join(b, F.col("a.next_id") == F.col("b.id")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.round(V.DISTANCES[name](F.col("a.vec"), F.col("b.vec")), 5).alias("d"))


for _name, _sql in DIST_SQL.items():
    query(f"{_IDS[_name]}_{_name}", f"WITH {FACES} SELECT a.id AS i, b.id AS j, round({_sql}, 5) AS d FROM fa a JOIN fa b ON b.id BETWEEN a.id + 1 AND a.id + 4")(lambda spark, sf, n=_name: distance_table(spark, sf, n))


def near_sql(dist="list_distance(a.vec, b.vec)", cond="a.id <> b.id", k=3, label="label"):
    return f"""nn AS (SELECT a.id, a.label AS actual, a.grp AS agrp, b.{label} AS label, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS r FROM fa a JOIN fa b ON {cond}),
vt AS (SELECT id, actual, agrp, label AS predicted FROM (SELECT id, actual, agrp, label, count(*) AS n FROM nn WHERE r <= {k} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"""


@query("CL1_nearest_neighbour", f"WITH {FACES}, {near_sql(cond='a.id <> b.id AND a.grp = 0 AND b.grp <> 0')} SELECT id, actual, predicted FROM vt")
def nearest(spark, sf):
    f = people(spark, sf)
    return X.classify(f.where("grp = 0"), f.where("grp <> 0"), 3)


@query("CL1_nearest_neighbour_chi_square", f"WITH {FACES}, {near_sql(dist=DIST_SQL['chi_square'], cond='a.id <> b.id AND a.grp = 0 AND b.grp <> 0', k=1)} SELECT id, actual, predicted FROM vt")
def nearest_chi(spark, sf):
    f = histograms(spark, sf)
    return X.classify(f.where("grp = 0"), f.where("grp <> 0"), 1, "chi_square")


@query("TK3_nearest_labels", f"WITH {FACES}, {near_sql()} SELECT id, r::INTEGER AS r, label FROM nn WHERE r <= 3")
def nearest_labels(spark, sf):
    f = people(spark, sf)
    return X.neighbours(f, f, 3).select("id", "r", "label")


@query("CL6_leave_one_out", f"WITH {FACES}, {near_sql()} SELECT count(*) FILTER (actual = predicted) AS tp, count(*) FILTER (actual <> predicted) AS fp FROM vt")
def leave_one_out(spark, sf):
    return X.leave_one_out(people(spark, sf), 3)


@query("CL7_leave_one_class_out", f"WITH {FACES}, {near_sql(cond='a.label <> b.label', label='grp')} SELECT count(*) FILTER (agrp = predicted) AS tp, count(*) FILTER (agrp <> predicted) AS fp FROM vt")
def leave_one_class_out(spark, sf):
    return X.leave_one_class_out(people(spark, sf), 3)


@query("CL8_simple_validation", f"WITH {FACES}, {near_sql(cond='a.id <> b.id AND a.grp = 1 AND b.grp IN (2, 3)', k=1)} SELECT count(*) FILTER (actual = predicted) AS tp, count(*) FILTER (actual <> predicted) AS fp FROM vt")
def simple_validation(spark, sf):
    f = people(spark, sf)
    return X.counts(X.classify(f.where("grp = 1"), f.where("grp in (2, 3)"), 1))


FOLDS = f"""{FACES}, fp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR || '-7'), id) - 1 AS place, (SELECT min(n) FROM (SELECT count(*) AS n FROM fa GROUP BY label)) AS size FROM fa),
fo AS (SELECT id, label, vec, CASE WHEN place // (size // least(4, size)) < least(4, size) THEN place // (size // least(4, size)) ELSE -1 END AS fold FROM fp WHERE place < size),
fn AS (SELECT a.fold, a.label AS actual, b.label AS predicted, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS r FROM fo a JOIN fo b ON a.fold <> b.fold AND a.fold >= 0),
fc AS (SELECT fold::INTEGER AS fold, count(*) FILTER (actual = predicted) AS tp, count(*) FILTER (actual <> predicted) AS fp FROM fn WHERE r = 1 GROUP BY fold)"""
query("CL5_k_fold", f"WITH {FOLDS} SELECT * FROM fc")(lambda spark, sf: X.k_fold(people(spark, sf), 4))
query("CL5_folds", f"WITH {FACES}, m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM fa GROUP BY label)) SELECT fold::INTEGER AS fold, (SELECT n // least(4, n) FROM m) * 10 AS n FROM (SELECT unnest(range(4)) AS fold) WHERE fold < (SELECT least(4, n) FROM m)")(
    lambda spark, sf: X.folds(people(spark, sf), 4).where("fold >= 0").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
)
query("CL9_validation_accuracy", f"WITH {FOLDS} SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, round(sum(tp)::DOUBLE / (sum(tp) + sum(fp)), 6) AS accuracy, round(stddev_pop(tp::DOUBLE / (tp + fp)), 6) AS sd FROM fc")(
    lambda spark, sf: rounded(X.accuracy(X.k_fold(people(spark, sf), 4)), "accuracy", "sd")
)


@query("AG24_validation_counts", f"WITH {FACES}, {near_sql()}, c AS (SELECT id % 4 AS run, count(*) FILTER (actual = predicted) AS tp, count(*) FILTER (actual <> predicted) AS fp FROM vt GROUP BY 1) SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, round(sum(tp)::DOUBLE / (sum(tp) + sum(fp)), 6) AS accuracy, round(stddev_pop(tp::DOUBLE / (tp + fp)), 6) AS sd FROM c")
def validation_counts(spark, sf):
    f = people(spark, sf)
    runs = X.counts(X.classify(f, f, 3).withColumn("run", F.col("id") % 4), ["run"])
    return rounded(X.accuracy(runs), "accuracy", "sd")


query("CL2_svm_linear")(lambda spark, sf: X.svm_grid(faces(spark, sf), [1.0], [None], 3))
query("CL3_svm_grid")(lambda spark, sf: X.best_setting(X.svm_grid(faces(spark, sf), V.powers_of_two(-1, 3, 2), V.powers_of_two(-3, 1, 2), 3)))


@query("SF17_parameter_grid", """SELECT s_suppkey, pow(2.0, c)::DOUBLE AS c, pow(2.0, g)::DOUBLE AS gamma FROM (SELECT s_suppkey, unnest(range(-(s_nationkey % 4) - 1, s_nationkey % 5 + 3, 2)) AS c, s_nationkey FROM supplier) t,
(SELECT unnest(range(-15, 4, 2)) AS g) WHERE g >= -(s_nationkey % 7) - 9""")
def parameter_grid(spark, sf):
    """A grid of powers of two for every supplier, with bounds of its own."""
    n = F.col("s_nationkey")
    power = lambda k: F.pow(F.lit(2.0), k.cast("double"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", V.steps(-(n % 4) - 1, n % 5 + 2, 2).alias("cs"), V.steps(F.lit(-15), F.lit(3), 2).alias("gs"))
    grid = s.select("s_suppkey", "s_nationkey", F.explode("cs").alias("c"), "gs").select("s_suppkey", "s_nationkey", "c", F.explode("gs").alias("g"))
    return grid.where(F.col("g") >= -(n % 7) - 9).select("s_suppkey", power(F.col("c")).alias("c"), power(F.col("g")).alias("gamma"))


COV = f"""{FACES}, mu AS (SELECT k, avg(vec[k]) AS m FROM fa, (SELECT unnest(range(1, 65)) AS k) GROUP BY k)"""


@query("FX19_pca_total_variance", f"WITH {COV} SELECT round(sum(s), 6) AS total FROM (SELECT var_pop(vec[k]) AS s FROM fa, (SELECT unnest(range(1, 65)) AS k) GROUP BY k)")
def pca_variance(spark, sf):
    m = X.pca(people(spark, sf))
    return spark.createDataFrame([(float(sum(m.values)),)], "total double").select(F.round("total", 6).alias("total"))


@query("FX19_pca_project")
def pca_project(spark, sf):
    f = people(spark, sf)
    return f.select("id", F.transform(X.pca(f, 4).project(F.col("vec")), lambda x: F.round(x, 6)).alias("coords"))


@query("FX19_pca_reconstruct", f"WITH {FACES} SELECT id, 0.0::DOUBLE AS error FROM fa")
def pca_reconstruct(spark, sf):
    f = people(spark, sf)
    m = X.pca(f, 64)
    out = f.select("id", "vec", m.project(F.col("vec")).alias("coords")).select("id", "vec", m.reconstruct(F.col("coords")).alias("back"))
    return out.select("id", (F.round(V.euclidean(F.col("vec"), F.col("back")), 5) + 0.0).alias("error"))


query("FX20_lda_project")(lambda spark, sf: people(spark, sf).select("id", F.transform(X.lda(people(spark, sf), 3).project(F.col("vec")), lambda x: F.round(x, 5)).alias("coords")))
query("FX21_fisherfaces_project")(lambda spark, sf: people(spark, sf).select("id", F.transform(X.fisherfaces(people(spark, sf), 3).project(F.col("vec")), lambda x: F.round(x, 5)).alias("coords")))


@query("CL4_model_fisherfaces_nearest")
def predictable_model(spark, sf):
    """Feature and classifier together: project, then the nearest training row."""
    f = people(spark, sf)
    m = X.fisherfaces(f.where("grp <> 0"), 5)
    p = f.withColumn("vec", m.project(F.col("vec")))
    return X.classify(p.where("grp = 0"), p.where("grp <> 0"), 1)


@query("FX18_identity", f"WITH {FACES} SELECT id, round(list_sum(vec), 6) AS total FROM fa")
def identity(spark, sf):
    return people(spark, sf).select("id", F.round(V.total(F.col("vec")), 6).alias("total"))


@query("FX22_chain", f"WITH {FACES} SELECT id, round(list_sum(list_transform(h, lambda e: e * 2)), 6) AS total FROM fa")
def chain(spark, sf):
    return histograms(spark, sf).select("id", F.round(V.total(F.transform("vec", lambda e: e * 2)), 6).alias("total"))


@query("FX23_combine", f"WITH {FACES} SELECT id, len(list_concat(vec, h))::INTEGER AS n, round(list_sum(list_concat(vec, h)), 6) AS total FROM fa")
def combine(spark, sf):
    both = F.concat("vec", F.transform("vec", lambda x: F.abs(x)))
    return people(spark, sf).select("id", F.size(both).alias("n"), F.round(V.total(both), 6).alias("total"))


@query("FX24_combine_nd", f"WITH {FACES} SELECT id, 8 AS n_rows, 16 AS n_cols, round(list_sum(vec) + list_sum(h), 6) AS total FROM fa")
def combine_nd(spark, sf):
    rows = lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(v, r * 8 + 1, 8))
    m = F.zip_with(rows(F.col("vec")), rows(F.transform("vec", lambda x: F.abs(x))), lambda a, b: F.concat(a, b))
    return people(spark, sf).select("id", F.size(m).alias("n_rows"), F.size(F.element_at(m, 1)).alias("n_cols"), F.round(V.total(F.flatten(m)), 6).alias("total"))


@query("FX25_row_matrix", f"WITH {FACES} SELECT id, k::INTEGER AS k, round(vec[k + 1], 6) AS v FROM fa, (SELECT unnest(range(64)) AS k)")
def row_matrix(spark, sf):
    return people(spark, sf).select("id", F.posexplode("vec").alias("k", "v")).select("id", "k", F.round("v", 6).alias("v"))


ACC = "SELECT c_custkey, c_acctbal FROM customer"


@query("FX26_minmax_normalized", "SELECT c_custkey, round(-1 + 2 * (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS v FROM customer")
def minmax_normalized(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    lo, hi = c.agg(F.min("c_acctbal")).scalar(), c.agg(F.max("c_acctbal")).scalar()
    return c.select("c_custkey", F.round(-1 + 2 * (F.col("c_acctbal") - lo) / (hi - lo), 6).alias("v"))


@query("FX27_zscore_normalized", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS v FROM customer")
def zscore_normalized(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    m, s = c.agg(F.avg("c_acctbal")).scalar(), c.agg(F.stddev_pop("c_acctbal")).scalar()
    return c.select("c_custkey", F.round((F.col("c_acctbal") - m) / s, 6).alias("v"))


@query("WN4_cumulative_sum", "SELECT p_size, sum(count(*)) OVER (ORDER BY p_size)::BIGINT AS n FROM part GROUP BY p_size")
def cumulative(spark, sf):
    from pyspark.sql import Window

    n = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return n.select("p_size", F.sum("n").over(Window.orderBy("p_size").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))  # a row per size


@query("WN6_online_variance", f"WITH {FACES} SELECT id, round(var_pop(e), 8) AS v FROM (SELECT id, unnest(vec) AS e FROM fa) GROUP BY id")
def online_variance(spark, sf):
    step = lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["m"] + (x - s["m"]) / (s["n"] + 1)).alias("m"), (s["q"] + (x - s["m"]) * (x - (s["m"] + (x - s["m"]) / (s["n"] + 1)))).alias("q"))
    fold = F.aggregate("vec", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q")), step, lambda s: s["q"] / s["n"])
    return people(spark, sf).select("id", F.round(fold, 8).alias("v"))


@query("PF17_gather", f"WITH {FACES} SELECT id, k::INTEGER AS k, round(vec[k], 6) AS v FROM fa, (SELECT unnest([3, 5, 9]) AS k) WHERE id % 4 IN (0, 2)")
def gather(spark, sf):
    k = F.explode(F.array(F.lit(3), F.lit(5), F.lit(9))).alias("k")
    return people(spark, sf).where("id % 4 in (0, 2)").select("id", "vec", k).select("id", "k", F.round(F.element_at("vec", F.col("k")), 6).alias("v"))


KINDS = ("SIFT", "surf", "ORB", "Brisk", "BRIEF", "FREAK", "none")


@query("SF16_metric_names", f"""SELECT p_partkey, kind, CASE WHEN upper(kind) IN ('SIFT', 'SURF') THEN 'minkowski' WHEN upper(kind) IN ('ORB', 'BRISK', 'BRIEF', 'FREAK') THEN 'hamming' END AS metric
FROM (SELECT p_partkey, [{', '.join(f"'{k}'" for k in KINDS)}][p_size % {len(KINDS)} + 1] AS kind FROM part)""")
def metric_names(spark, sf):
    """The metric of the kind of descriptor that each row names; none of an unknown one."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("p_size") % len(KINDS) + 1)
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind")).withColumn("metric", V.metric_column(F.col("kind")))


@query("SO4_shuffled", f"WITH {FACES} SELECT id, label FROM fa")
def shuffled(spark, sf):
    return people(spark, sf).orderBy(F.xxhash64("id", F.lit(42)), "id").select("id", "label")
