"""Pair scores of images and their normalisations, on the long matrix (i, j, v) with all cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_scores(matches: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(i, j, score, n), both orientations: the sum of threshold / ratio - 1 and the matches under it."""
    sums = matches.where(F.col("ratio") < threshold).groupBy("im_i", "im_j").agg(F.sum(threshold / F.col("ratio") - 1).alias("score"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.col("im_i").alias("i"), F.col("im_j").alias("j"), "score", "n").union(sums.select("im_j", "im_i", "score", "n"))


def dense(pairs: DataFrame, images: DataFrame, value: str) -> DataFrame:
    """All cells of the image matrix; a missing pair is zero.  The result is quadratic in the images."""
    cells = images.select(F.col("image_id").alias("i")).join(images.select(F.col("image_id").alias("j")), F.lit(True))
    return cells.join(pairs.select("i", "j", F.col(value).cast("double").alias("v")), ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def _per(m: DataFrame, key: str, f: Column, name: str) -> DataFrame:
    return m.groupBy(F.col(key)).agg(f.alias(name))


def norm_counts(m: DataFrame, modifier: float = 1000.0) -> DataFrame:
    rows = _per(m, "i", F.sum("v") / modifier, "c")
    both = m.join(rows.withColumnRenamed("c", "ci"), "i").join(rows.select(F.col("i").alias("j"), F.col("c").alias("cj")), "j")
    return both.select("i", "j", F.try_divide("v", F.least("ci", "cj")).alias("v"))


def normalize_matches(m: DataFrame, modifier: float = 1000.0) -> DataFrame:
    total = F.sum("v").over(Window.partitionBy("i")) + F.sum("v").over(Window.partitionBy("j"))
    return m.select("i", "j", F.try_divide(modifier * F.col("v"), total).alias("v"))


def norm_scores(m: DataFrame, amount: int = 5) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("v"), "j"))
    top = m.withColumn("r", r).where(F.col("r") <= amount).groupBy("i").agg(F.avg("v").alias("t"))
    mean = m.where("v > 0").agg(F.avg("v")).scalar()
    both = m.join(top.withColumnRenamed("t", "ti"), "i").join(top.select(F.col("i").alias("j"), F.col("t").alias("tj")), "j")
    s = F.try_divide("v", F.greatest(F.least("ti", "tj"), mean))
    return both.select("i", "j", F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)).alias("v"))


def cap(m: DataFrame, nb_sd: float = 0.5) -> DataFrame:
    """A logistic squash around the mean, moved so that zero stays zero."""
    mean, sd = m.agg(F.avg("v")).scalar(), m.agg(F.stddev_pop("v")).scalar()
    squash = lambda x: 1 / (1 + F.exp(-(x - mean) / (nb_sd * sd)))
    zero = squash(F.lit(0.0))
    return m.select("i", "j", ((squash(F.col("v")) - zero) / (1 - zero)).alias("v"))


def trim(m: DataFrame, margins: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    mean = _per(m, "j", F.max("v"), "t").agg(F.avg("t")).scalar()
    s = F.try_divide(F.col("v") - margins[0] * mean, (margins[1] - margins[0]) * mean)
    return m.select("i", "j", F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)).alias("v"))


def set_diag(m: DataFrame, k: float) -> DataFrame:
    return m.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(float(k))).otherwise(F.col("v")).alias("v"))


def normalize_scores(m: DataFrame, score_bar: float = 1.0, max_dist: int = 999, diagonal: float = 1.0, caps: tuple[float, float] = (0.5, 2.0), amount: int = 5, compat: bool = True) -> DataFrame:
    """Scores over their neighbours' mean, placed in a cap window.

    The neighbours are the last five of the column (``compat``) or the five largest of row and column.
    """
    mean, most, sd = (m.agg(f("v")).scalar() for f in (F.avg, F.max, F.stddev_pop))
    lo, hi = caps[0] * mean / most, caps[1] * (mean + sd) / most
    if compat:
        r = F.row_number().over(Window.partitionBy("j").orderBy(F.desc("i")))
        near = m.withColumn("r", r).where(F.col("r") <= amount).groupBy("j").agg(F.avg("v").alias("near"))
        both = m.join(near, "j")
    else:
        cells = m.select(F.col("i").alias("k"), F.col("v").alias("x")).union(m.select("j", "v"))
        r = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("x")))
        top = cells.withColumn("r", r).where(F.col("r") <= amount).groupBy("k").agg(F.avg("x").alias("t"))
        both = m.join(top.select(F.col("k").alias("i"), F.col("t").alias("ti")), "i").join(top.select(F.col("k").alias("j"), F.col("t").alias("tj")), "j").withColumn("near", F.greatest("ti", "tj"))
    s = (F.try_divide("v", "near") - lo) / (hi - lo)
    v = F.when(F.abs(F.col("i") - F.col("j")) > max_dist, 0.0).when(F.col("i") == F.col("j"), F.lit(float(diagonal))).when(F.col("v") < score_bar, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))
    return both.select("i", "j", v.alias("v"))


def gradients(m: DataFrame) -> DataFrame:
    """(i, k, v, gradient): each row in falling order with the central difference of its rising order."""
    up = Window.partitionBy("i").orderBy("v", "j")
    before, after = F.lag("v").over(up), F.lead("v").over(up)
    g = F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2)
    k = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("v"), F.desc("j")))
    return m.select("i", k.alias("k"), "v", g.alias("gradient"))


def soft_f1(result: DataFrame, truth: DataFrame) -> DataFrame:
    both = result.select("i", "j", F.col("v").alias("r")).join(truth.select("i", "j", F.col("v").alias("t")), ["i", "j"])
    s = both.agg(
        F.sum(F.least("r", "t")).alias("tp"), F.sum(F.greatest(F.col("r") - F.col("t"), F.lit(0.0))).alias("fp"), F.sum(F.greatest(F.col("t") - F.col("r"), F.lit(0.0))).alias("fn")
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return s.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def score_separation_by_row(m: DataFrame, labels: DataFrame, eps: float = 0.1) -> DataFrame:
    """(i, j, same, v): each row centred on the mean of its class means and scaled by its deviation."""
    lab = lambda k, n: labels.select(F.col("image_id").alias(k), F.col("label").alias(n))
    rows = m.join(lab("i", "a"), "i").join(lab("j", "b"), "j").where("i <> j").withColumn("same", F.col("a") == F.col("b"))
    w = Window.partitionBy("i")
    of = lambda k: F.avg(F.when(F.col("same") == k, F.col("v"))).over(w)
    centre = (F.coalesce(of(True), of(False)) + F.coalesce(of(False), of(True))) / 2
    return rows.select("i", "j", "same", ((F.col("v") - centre) / (F.stddev_pop("v").over(w) + eps)).alias("v"))


def sorted_labels(names: DataFrame) -> DataFrame:
    """(image_id, name, place): files in order of their first three characters, then by id."""
    place = F.row_number().over(Window.orderBy(F.substring("name", 1, 3), "image_id"))  # one row per image
    return names.select("image_id", "name", place.alias("place"))


def score_table(m: DataFrame, bar: float = 0.01) -> DataFrame:
    """The matrix as text: a row per image, values at or under the bar blank."""
    text = F.when(F.col("v") > bar, F.format_string("%.2f", "v")).otherwise("")
    return m.withColumn("t", text).groupBy("i").pivot("j").agg(F.first("t")).orderBy("i")


def pair_aggregate(matches: DataFrame, pairs: DataFrame, score: Column, default: float = 1.0) -> DataFrame:
    """(p1, p2, score): an aggregate of each image pair's matches, or a default where there is none."""
    got = matches.groupBy(F.col("im_i").alias("p1"), F.col("im_j").alias("p2")).agg(score.alias("s"))
    return pairs.join(got, ["p1", "p2"], "left").select("p1", "p2", F.coalesce("s", F.lit(float(default))).alias("score"))
