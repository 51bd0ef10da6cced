"""Precision, recall and distribution figures behind the usual plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(curve: DataFrame, possible: Column | None = None) -> DataFrame:
    """(threshold, n_correct, n_total, precision, recall) from counts by pair and threshold.

    Precision is one where nothing is proposed; recall is against ``possible``, or the largest count.
    """
    sums = curve.groupBy("threshold").agg(F.sum("n_correct").alias("n_correct"), F.sum("n_total").alias("n_total"))
    most = possible if possible is not None else sums.agg(F.max("n_correct")).scalar()
    return sums.select(
        "threshold", "n_correct", "n_total",
        F.when(F.col("n_total") == 0, F.lit(1.0)).otherwise(F.col("n_correct") / F.col("n_total")).alias("precision"),
        F.coalesce(F.try_divide(F.col("n_correct").cast("double"), most), F.lit(0.0)).alias("recall"),
    )


def accuracy_at_count(curve: DataFrame, least: int = 1000) -> DataFrame:
    """Each pair's accuracy at the first threshold with at least ``least`` correct over all pairs."""
    at = curve.groupBy("threshold").agg(F.sum("n_correct").alias("n")).where(F.col("n") >= least).agg(F.min("threshold")).scalar()
    return curve.where(F.col("threshold") == at).withColumn("accuracy", F.try_divide(F.col("n_correct"), F.col("n_total")))


def interpolated(curve: DataFrame, samples: int = 1000) -> DataFrame:
    """(recall, precision) at evenly spaced recalls, linear between the curve's points."""
    points = curve.groupBy("recall").agg(F.max("precision").alias("precision"))
    w = Window.orderBy("recall")  # the curve has a row per threshold
    legs = points.withColumn("r2", F.lead("recall").over(w)).withColumn("p2", F.lead("precision").over(w)).where("r2 is not null")
    at = legs.sparkSession.range(samples).select((F.col("id") / F.lit(float(samples - 1))).alias("x"))
    hit = legs.join(F.broadcast(at), (F.col("x") >= F.col("recall")) & (F.col("x") < F.col("r2")))
    return hit.select(F.col("x").alias("recall"), (F.col("precision") + (F.col("p2") - F.col("precision")) * (F.col("x") - F.col("recall")) / (F.col("r2") - F.col("recall"))).alias("precision"))


def false_positives_removed(curve: DataFrame, reference: DataFrame, samples: int = 1000) -> DataFrame:
    """The share of the reference curve's false positives that the curve avoids, by recall."""
    a, b = interpolated(curve, samples), interpolated(reference, samples).withColumnRenamed("precision", "base")
    return a.join(b, "recall").select("recall", "precision", "base", F.try_divide(F.col("precision") - F.col("base"), 1 - F.col("base")).alias("improvement"))


def rates(scores: DataFrame, n: int = 500, higher_is_same: bool = False) -> DataFrame:
    """(threshold, tpr, fpr) at n evenly spaced thresholds from scores (same, score)."""
    s = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    ends = s.agg(F.min("score").alias("a"), F.max("score").alias("b"))
    t = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("k", (F.col("a") + F.col("k") * (F.col("b") - F.col("a")) / (n - 1)).alias("threshold"))
    passes = F.col("score") >= F.col("threshold") if higher_is_same else F.col("score") <= F.col("threshold")
    hit = s.join(F.broadcast(t), passes)  # n thresholds, counted before any shuffle
    counts = hit.groupBy("k").agg(F.count_if("same").alias("tp"), F.count_if(~F.col("same")).alias("fp"))
    total = s.agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("q"))
    return t.join(counts, "k", "left").select(
        "threshold", F.try_divide(F.coalesce("tp", F.lit(0)), total.select("p").scalar()).alias("tpr"), F.try_divide(F.coalesce("fp", F.lit(0)), total.select("q").scalar()).alias("fpr")
    )


def separation(scores: DataFrame) -> DataFrame:
    """Means of same and different pairs, their pooled variance, and the distance in deviations."""
    of = lambda f, same: f(F.when(F.col("same") == same, F.col("score")))
    s = scores.agg(*[of(f, k).alias(f"{n}_{m}") for n, f in (("mean", F.avg), ("var", F.var_pop), ("n", F.count)) for k, m in ((True, "same"), (False, "diff"))])
    pooled = (F.col("n_same") * F.col("var_same") + F.col("n_diff") * F.col("var_diff")) / (F.col("n_same") + F.col("n_diff"))
    return s.select("mean_same", "mean_diff", pooled.alias("pooled_var"), F.try_divide(F.col("mean_same") - F.col("mean_diff"), F.sqrt(pooled)).alias("separation"))


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n): counts in equal bins between the least and the largest value."""
    v = values.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    lo, hi = v.agg(F.min("v")).scalar(), v.agg(F.max("v")).scalar()
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / (hi - lo) * bins)).cast("int")
    return v.groupBy(F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
