"""Matchers: ratio tests over neighbour joins, symmetric and mutual selection, thresholds.

A match is a row (i, j, im_i, im_j, score, ratio): two features, their images, the distance and
its ratio to a baseline distance.  A ratio without a denominator is null and passes no threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.operators.balltree import BallOptions, ball_tree, neighbours_inside
from vecmosaic.operators.knn import KnnOptions, knn_join, radius_counts, ranked

SCOPES = ("query", "target", "all")
#: proposed and baseline scope -> (neighbour join, ranks proposed, baseline join, its rank)
RULES = {
    ("all", "all"): ("all", (1,), "all", 2),
    ("target", "target"): ("other", (1,), "other", 2),
    ("target", "query"): ("other", (1, 2), "same", 1),
    ("all", "query"): ("all", (1, 2), "same", 1),
    ("all", "target"): ("all", (1, 2), "other", 2),
    ("target", "all"): ("other", (1, 2), "all", 2),
}


@dataclass(frozen=True)
class RatioOptions:
    proposed: str = "target"
    baseline: str = "all"
    knn: KnnOptions = KnnOptions()


def ratio_rows(features: DataFrame, options: RatioOptions = RatioOptions()) -> DataFrame:
    """(q, qi, r, t, ti, d, ratio): each feature's proposed neighbours with the distance ratio."""
    named = lambda s: "all" if s == "both" else s
    rule = RULES.get((named(options.proposed), named(options.baseline)))
    if rule is None:
        raise ValueError(f"no ratio test proposes {options.proposed} against {options.baseline}")
    scope, ranks, base_scope, base_rank = rule
    k = max(max(ranks), base_rank if base_scope == scope else 0)
    if "all" in (scope, base_scope) and scope != base_scope and options.knn.strategy in ("auto", "block", "grid"):
        near, other = _both_scopes(features, options.knn, {scope: k, base_scope: base_rank}, scope, base_scope)
    else:
        near = knn_join(features, options=replace(options.knn, k=k, scope=scope))
        other = knn_join(features, options=replace(options.knn, k=base_rank, scope=base_scope)) if base_scope != scope else None
    if base_scope == scope:
        base = F.max(F.when(F.col("r") == base_rank, F.col("d"))).over(Window.partitionBy("q"))
        near = near.withColumn("base", base)
    else:
        near = near.join(other.where(F.col("r") == base_rank).select("q", F.col("d").alias("base")), "q", "left")
    return near.where(F.col("r").isin(*ranks)).select("q", "qi", "r", "t", "ti", "d", F.try_divide("d", "base").alias("ratio"))


def _both_scopes(features: DataFrame, knn: KnnOptions, k: dict[str, int], *scopes: str) -> list[DataFrame]:
    """Neighbours of ``all`` and of a narrower scope; each pair is compared once, as the nearest of all are among those of both parts."""
    part = next(s for s in scopes if s != "all")
    rest = "same" if part == "other" else "other"
    near = {part: knn_join(features, options=replace(knn, k=max(k.values()), scope=part))}
    near["all"] = ranked(near[part].union(knn_join(features, options=replace(knn, k=k["all"], scope=rest))), k["all"])
    near[part] = near[part].where(F.col("r") <= k[part])
    return [near[s] for s in scopes]


def oriented(rows: DataFrame) -> DataFrame:
    """Matches between images with the lower image first; ``scan`` keeps the order of the search."""
    low = F.col("qi") < F.col("ti")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    return rows.where("qi <> ti").select(
        pick("q", "t").alias("i"), pick("t", "q").alias("j"), pick("qi", "ti").alias("im_i"), pick("ti", "qi").alias("im_j"),
        F.col("d").alias("score"), "ratio", F.struct("qi", "q", "r").alias("scan"),
    )


def first_of_pairs(matches: DataFrame) -> DataFrame:
    """One row per feature pair: the one the search meets first."""
    rank = F.row_number().over(Window.partitionBy("i", "j").orderBy("scan"))
    return matches.withColumn("n", rank).where("n = 1").drop("n", "scan")


def below(matches: DataFrame, threshold: float | Column) -> DataFrame:
    return matches.where(F.col("ratio") < threshold)


def mirror_match(features: DataFrame, threshold: float = 1.0, options: RatioOptions = RatioOptions("all", "all")) -> DataFrame:
    """Matches over all images at once: ratio rows, oriented, each pair once, under the threshold."""
    return below(first_of_pairs(oriented(ratio_rows(features, options))), threshold)


def brute_match(queries: DataFrame, targets: DataFrame, match_same: bool = False, eps: float = 1e-5, knn: KnnOptions = KnnOptions()) -> DataFrame:
    """(i, j, score, ratio): nearest target and its ratio, for queries with three neighbours.

    With ``match_same`` the two sides are one set and the nearest other feature is proposed.
    """
    near = knn_join(queries, None if match_same else targets, replace(knn, k=2 if match_same else 3))
    per = near.groupBy("q").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("t", "r").alias("j"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2")
    )
    return per.where(F.col("n") == (2 if match_same else 3)).select(F.col("q").alias("i"), "j", F.col("d1").alias("score"), (F.col("d1") / (F.col("d2") + eps)).alias("ratio"))


def mutual_nearest(queries: DataFrame, targets: DataFrame, ratio: float | None = None, knn: KnnOptions = KnnOptions()) -> DataFrame:
    """(i, j, score, ratio): pairs that are each other's nearest across two sets."""
    there = knn_join(queries, targets, replace(knn, k=2))
    back = knn_join(targets, queries, replace(knn, k=1)).select(F.col("q").alias("j"), F.col("t").alias("back"))
    per = there.groupBy("q").agg(F.min_by("t", "r").alias("j"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2"))
    out = per.join(back, "j").where("q = back").select(F.col("q").alias("i"), "j", F.col("d1").alias("score"), F.try_divide("d1", "d2").alias("ratio"))
    return out if ratio is None else below(out, ratio)


def set_similarity(queries: DataFrame, targets: DataFrame, ratio: float = 0.64) -> DataFrame:
    """(n_matches, n_features, similarity): mutual matches against the features of both sets."""
    n = queries.unionByName(targets).agg(F.count(F.lit(1)).alias("n_features")).select("n_features").scalar()
    got = mutual_nearest(queries, targets, ratio).agg(F.count(F.lit(1)).alias("n_matches"))
    return got.select("n_matches", n.alias("n_features"), F.try_divide(F.col("n_matches"), n).alias("similarity"))


def angle_match(queries: DataFrame, targets: DataFrame, ratio: float = 0.6, knn: KnnOptions = KnnOptions()) -> DataFrame:
    """(i, j, score): nearest by angle where the angle is below ``ratio`` times the second's."""
    near = knn_join(queries, targets, replace(knn, k=2, metric="angle"))
    per = near.groupBy("q").agg(F.min_by("t", "r").alias("j"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("a1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("a2"))
    return per.where(F.col("a1") < ratio * F.col("a2")).select(F.col("q").alias("i"), "j", F.col("a1").alias("score"))


@dataclass(frozen=True)
class RadiusOptions:
    radius: float = 300.0
    ratio_boost: float = 1.0
    group_limit: int = 5


def radius_match(features: DataFrame, threshold: float, options: RadiusOptions = RadiusOptions(), knn: KnnOptions = KnnOptions()) -> DataFrame:
    """(i, j, score, ratio): nearest neighbours in a later image; crowded features get a boosted ratio."""
    near = knn_join(features, options=replace(knn, k=2))
    per = near.groupBy("q", "qi").agg(
        F.min_by("t", "r").alias("j"), F.min_by("ti", "r").alias("tj"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2")
    )
    crowd = radius_counts(features, options.radius, knn).withColumnRenamed("feature_id", "q")
    ratio = F.try_divide("d1", "d2") * F.when(F.col("group_size") >= options.group_limit, F.lit(options.ratio_boost)).otherwise(F.lit(1.0))
    return below(per.where("qi < tj").join(crowd, "q").select(F.col("q").alias("i"), "j", F.col("d1").alias("score"), ratio.alias("ratio")), threshold)


@dataclass(frozen=True)
class SpeedOptions:
    leaf: int = 2
    radius: float = 300.0
    dist_threshold: float = 100.0
    block: int = 2048
    tree: BallOptions = BallOptions()


def speed_match(features: DataFrame, options: SpeedOptions = SpeedOptions()) -> DataFrame:
    """(i, j, score, ratio): mutual nearest neighbours inside the top-most small nodes of a ball tree.

    Both are from different images, closer than ``dist_threshold`` and the lower image is first; the
    ratio is to the second neighbour in the node, null without one.
    """
    tree = ball_tree(features, replace(options.tree, leaf=options.leaf))
    near = neighbours_inside(tree.members(options.radius), 2, options.block)
    per = near.groupBy("q", "qi").agg(
        F.min_by("t", "r").alias("j"), F.min_by("ti", "r").alias("tj"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2")
    )
    back = per.select(F.col("q").alias("j"), F.col("j").alias("back"))
    both = per.join(back, "j").where((F.col("back") == F.col("q")) & (F.col("qi") < F.col("tj")) & (F.col("d1") < options.dist_threshold))
    return both.select(F.col("q").alias("i"), "j", F.col("d1").alias("score"), F.try_divide("d1", "d2").alias("ratio"))


def ball_match(features: DataFrame, match_type: str, threshold: float, **options) -> DataFrame:
    if match_type == "radius":
        return radius_match(features, threshold, RadiusOptions(**options))
    if match_type == "speed":
        return below(speed_match(features, SpeedOptions(**options)), threshold)
    raise ValueError(f"unknown match type {match_type}")


def with_positions(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Matches with the keypoints (x1, y1) and (x2, y2) of both features."""
    side = lambda k, n: features.select(F.col("feature_id").alias(k), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return matches.join(side("i", 1), "i").join(side("j", 2), "j")


def distinct_matches(matches: DataFrame, threshold: float = 5.0, pair: tuple[str, ...] = ("im_i", "im_j")) -> DataFrame:
    """Greedy selection in (i, j) order: a later match within the threshold of a kept one at both ends goes.

    The order matters, so each image pair is one group; its matches are bounded by the features of
    two images.
    """
    import numpy as np
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["i", "j"], kind="stable")
        p = rows[["x1", "y1", "x2", "y2"]].to_numpy()
        kept: list[int] = []
        for k in range(len(p)):
            if kept:
                d = p[kept] - p[k]
                if ((np.hypot(d[:, 0], d[:, 1]) < threshold) & (np.hypot(d[:, 2], d[:, 3]) < threshold)).any():
                    continue
            kept.append(k)
        return rows.iloc[kept]

    return matches.groupBy(*pair).applyInPandas(pick, matches.schema)


def pruned_matches(matches: DataFrame, offset: float = 500.0, guard: float = 0.001) -> DataFrame:
    """Matches within one standard deviation of the median length and of the median angle."""
    dx, dy = F.col("x2") + offset - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    rows = matches.withColumn("length", length).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dx / (length + guard)))))
    s = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("length", "angle") for n, f in (("m", F.median), ("s", F.stddev_pop))])
    near = lambda c: F.abs(F.col(c) - s.select(f"m_{c}").scalar()) <= s.select(f"s_{c}").scalar()
    return rows.where(near("length") & near("angle"))
