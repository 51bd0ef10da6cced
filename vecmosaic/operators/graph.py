"""Similarity graphs: weighted edges, pruning, degrees, modularity and matches inside communities.

An edge table (src, dst, w) holds every edge in both directions; absent pairs weigh zero.  A
partition is (vertex, cluster).

Several graphs, one for each set of images, may lie in one table.  ``by`` then names the column that tells them apart:
largest values, thresholds, totals and shares are those of each set alone, so a set's result doesn't depend on the
others.  Without it the whole table is one graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.functions import vectors as V

PAIR = "src long, dst long, value double"


def _keys(by: str | None) -> list[str]:
    return [by] if by else []


def _with(df: DataFrame, each: DataFrame, by: str | None) -> DataFrame:
    """The rows with the columns that ``each`` has for their set; without sets it is one row."""
    if by:
        return df.join(each, by)
    one = each.first()  # one row
    return df.withColumns({c: F.lit(one[c] if one else None) for c in each.columns})


def all_pairs(features: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 1024, by: str | None = None) -> DataFrame:
    """(src, dst, value) of every ordered pair of different features of one set, in blocks that meet pairwise.

    With ``by`` the set is a column, too.  The result is quadratic in the features of a set, as the operator asks, and
    linear in the sets.
    """
    f = features.select(F.col("feature_id").cast("long").alias("id"), F.col("descriptor").alias("v"), (F.col(by) if by else F.lit(0)).cast("long").alias("g"))
    sizes = f.groupBy(F.col("g").alias("of")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    mine, other = F.pmod(F.xxhash64("id"), F.col("n")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    f = f.join(sizes, F.col("g").eqNullSafe(F.col("of"))).drop("of")
    left = f.select("id", "v", "g", mine.alias("a"), other.alias("b"), F.lit(0).alias("side"))
    right = f.select("id", "v", "g", mine.alias("b"), other.alias("a"), F.lit(1).alias("side"))

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        parts = [group.filter(pa.array(side == k)) for k in (0, 1)]
        if not all(p.num_rows for p in parts):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "value": pa.array([], pa.float64())} | ({by: pa.array([], pa.int64())} if by else {}))
        (i, x), (j, y) = ((p.column("id").to_numpy(), np.array(p.column("v").to_pylist(), dtype=np.float64)) for p in parts)
        value = kernel(x, y)
        keep = i[:, None] != j[None, :]
        src, dst = np.broadcast_to(i[:, None], keep.shape)[keep], np.broadcast_to(j[None, :], keep.shape)[keep]
        of = {by: pa.array([group.column("g")[0].as_py()] * len(src), pa.int64())} if by else {}
        return pa.table({"src": src, "dst": dst, "value": value[keep].astype(np.float64)} | of)

    return left.unionByName(right).groupBy("g", "a", "b").applyInArrow(run, PAIR + (f", `{by}` long" if by else ""))


def angle_distances(features: DataFrame, by: str | None = None) -> DataFrame:
    """(src, dst, value): arc cosine of the cosines over their largest, the features' own included."""
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    dots = all_pairs(features, lambda x, y: unit(x) @ unit(y).T, by=by)
    own = features.select(F.try_divide(V.dot(F.col("descriptor"), F.col("descriptor")), V.norm(F.col("descriptor")) * V.norm(F.col("descriptor"))).alias("value"), *_keys(by))
    most = dots.select("value", *_keys(by)).unionByName(own).groupBy(*_keys(by)).agg(F.max("value").alias("most"))
    scaled = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("value") / F.col("most"))))
    return _with(dots, most, by).select("src", "dst", scaled.alias("value"), *_keys(by))


def hamming_distances(words: DataFrame, compat: bool = False, by: str | None = None) -> DataFrame:
    """(src, dst, value): unequal bits of binary descriptors; ``compat`` wraps at 256 like unsigned bytes."""

    def bits(x: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(x.astype(np.int64)).view(np.uint8), axis=1).astype(np.float32)

    def unequal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, q = bits(x), bits(y)
        return p.sum(axis=1)[:, None] + q.sum(axis=1)[None, :] - 2 * p @ q.T

    # words go as 32 bits each, which doubles hold exactly
    halves = F.flatten(F.transform("words", lambda w: F.array(F.shiftrightunsigned(w, 32).cast("double"), w.bitwiseAND(F.lit((1 << 32) - 1)).cast("double"))))
    d = F.col("value").cast("long")
    return all_pairs(words.withColumn("descriptor", halves), unequal, by=by).select("src", "dst", (d % 256 if compat else d).alias("value"))


def weights(distances: DataFrame, kind: str = "angle") -> DataFrame:
    """Edges with one minus the scaled distance; other kinds than angle are bit distances."""
    scale = math.pi if kind == "angle" else 255.0
    return distances.select("src", "dst", (1 - F.col("value") / scale).alias("w"), *[c for c in distances.columns if c not in ("src", "dst", "value")])


def _grid_threshold(values: DataFrame, column: str, needs: DataFrame, n: int, by: str | None) -> DataFrame:
    """(set, k): the first of n even thresholds from ``top`` to ``start`` that ``need`` values of the set exceed.

    ``needs`` has need, top and start of each set.  Each value is put at the first threshold below it, so one count per
    threshold is enough; the running sum is over at most n rows of a set.  k is null where no threshold is exceeded so often.
    """
    top, start = F.col("top"), F.col("start")
    at = lambda k: top + k * (start - top) / F.lit(float(n - 1))
    guess = F.floor(F.try_divide(top - F.col(column), top - start) * F.lit(float(n - 1))).cast("int")
    first = F.coalesce(*[F.when((guess + d >= 0) & (F.col(column) > at(guess + d)), guess + d) for d in (-1, 0, 1, 2)], F.when(F.col(column) > at(F.lit(0)), F.lit(0)))
    placed = _with(values.select(column, *_keys(by)), needs, by).select(first.alias("k"), *_keys(by))
    counts = placed.where(F.col("k").isNotNull() & (F.col("k") < n)).groupBy("k", *_keys(by)).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*_keys(by)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = _with(counts.withColumn("sum", F.sum("n").over(order)), needs, by)
    reached = run.where(F.col("sum") >= F.col("need")).groupBy(*_keys(by)).agg(F.min("k").alias("k"))
    return needs.join(reached, by, "left") if by else reached


def thresholds(edges: DataFrame, needs: DataFrame, n: int = 600, start: float = 0.0, by: str | None = None) -> DataFrame:
    """(set, t): of n even thresholds from 1 to ``start`` the first that ``need`` weights of the set exceed."""
    needs = needs.select(*_keys(by), "need", F.lit(1.0).alias("top"), F.lit(float(start)).alias("start"))
    k = F.col("k")
    t = F.when(k.isNull(), F.lit(float(start))).when(k == 0, F.lit(1.0)).otherwise(1.0 + k * F.lit(float(start - 1.0)) / F.lit(float(n - 1)))
    return _grid_threshold(edges, "w", needs, n, by).select(*_keys(by), t.alias("t"))


def vertex_counts(features: DataFrame, by: str | None = None) -> DataFrame:
    """(set, vertices)."""
    return features.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("vertices"))


def edge_threshold(edges: DataFrame, vertices: DataFrame, per_vertex: float, n: int = 600, start: float = 0.0, by: str | None = None) -> DataFrame:
    """(set, t): the threshold above which there are about ``per_vertex`` edges a vertex."""
    return thresholds(edges, vertices.select(*_keys(by), (per_vertex * 2.0 * F.col("vertices")).alias("need")), n, start, by)


def fraction_threshold(edges: DataFrame, vertices: DataFrame, fraction: float, n: int = 600, start: float = 0.0, by: str | None = None) -> DataFrame:
    """(set, t): the threshold that about ``fraction`` of all cells of the weight matrix exceed."""
    return thresholds(edges, vertices.select(*_keys(by), (fraction * F.col("vertices").cast("double") * F.col("vertices")).alias("need")), n, start, by)


def above(edges: DataFrame, threshold: DataFrame | float, by: str | None = None) -> DataFrame:
    """The edges over their set's threshold, but those of weight one."""
    kept = (F.col("w") > F.col("t")) & (F.col("w") != 1)
    each = edges.withColumn("t", F.lit(threshold)) if isinstance(threshold, float) else _with(edges, threshold, by)
    return each.where(kept).drop("t")


def prune_threshold(edges: DataFrame, vertices: DataFrame, per_vertex: float, n: int = 600, start: float = 0.0, by: str | None = None) -> DataFrame:
    return above(edges, edge_threshold(edges, vertices, per_vertex, n, start, by), by)


def prune_fraction(edges: DataFrame, vertices: DataFrame, fraction: float, n: int = 500, start: float = 0.0, by: str | None = None) -> DataFrame:
    return above(edges, fraction_threshold(edges, vertices, fraction, n, start, by), by)


def prune_rows(edges: DataFrame, fraction: float, n: int = 1000, by: str | None = None) -> DataFrame:
    """Edges above the threshold that the largest weight of about ``fraction`` of the set's vertices exceeds."""
    most = edges.groupBy("dst", *_keys(by)).agg(F.max("w").alias("m"))
    needs = most.groupBy(*_keys(by)).agg(F.max("m").alias("top"), F.min("m").alias("start"), (fraction * F.count(F.lit(1))).alias("need"))
    k = _grid_threshold(most, "m", needs, n, by)
    k = k if by else _with(k, needs, by)
    t = F.col("top") + F.col("k") * (F.col("start") - F.col("top")) / F.lit(float(n - 1))
    return above(edges, k.select(*_keys(by), t.alias("t")), by)


def prune_highest(edges: DataFrame, keep: int) -> DataFrame:
    """Each vertex's ``keep`` heaviest edges, in both directions."""
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    kept = edges.withColumn("r", r).where(F.col("r") <= keep).select("src", "dst", "w")
    return kept.union(kept.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.sum("w").alias("degree"))


def _clustered(edges: DataFrame, partition: DataFrame) -> DataFrame:
    side = lambda k, n: partition.select(F.col("vertex").alias(k), F.col("cluster").alias(n))
    return edges.join(side("src", "c1"), "src").join(side("dst", "c2"), "dst")


def modularity_parts(edges: DataFrame, partition: DataFrame, by: str | None = None) -> DataFrame:
    """(cluster, inside, degree, q): each cluster's part of its set's modularity; zero without any weight."""
    total = edges.groupBy(*_keys(by)).agg(F.sum("w").alias("k"))
    sums = _clustered(edges, partition).groupBy(F.col("c1").alias("cluster"), *_keys(by)).agg(
        F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree")
    )
    share = F.try_divide("degree", "k")
    return _with(sums, total, by).withColumn("q", F.coalesce(F.try_divide("inside", "k") - share * share, F.lit(0.0))).drop("k")


def modularity(edges: DataFrame, partition: DataFrame, by: str | None = None) -> DataFrame:
    """(set, modularity)."""
    return modularity_parts(edges, partition, by).groupBy(*_keys(by)).agg(F.sum("q").alias("modularity"))


def move_gains(edges: DataFrame, partition: DataFrame, by: str | None = None) -> DataFrame:
    """(vertex, cluster, gain) of moving each vertex to a neighbouring cluster, itself not taken out first."""
    total = edges.groupBy(*_keys(by)).agg(F.sum("w").alias("k"))
    own = degrees(edges)
    parts = modularity_parts(edges, partition, by).select("cluster", "inside", F.col("degree").alias("total"))
    links = _clustered(edges, partition).groupBy(F.col("src").alias("vertex"), F.col("c2").alias("cluster"), *_keys(by)).agg(F.sum("w").alias("links"))
    k = F.col("k")
    gain = (2 * F.col("links") - (F.col("degree") * (2 * F.col("total") - F.col("inside")) + F.col("degree") * F.col("degree")) / k) / k
    return _with(links, total, by).join(own, "vertex").join(parts, "cluster").select("vertex", "cluster", gain.alias("gain"))


def coherence(edges: DataFrame, partition: DataFrame, images: DataFrame, first: int, second: int) -> DataFrame:
    """(cluster, coherence): minus the modularity, inside the cluster, of its parts in two images."""
    where = lambda k, n: images.select(F.col("vertex").alias(k), F.col("image").alias(n))
    inside = _clustered(edges, partition).where("c1 = c2").join(where("src", "i1"), "src").join(where("dst", "i2"), "dst")
    of = lambda cond: F.sum(F.when(cond, F.col("w")).otherwise(0.0))
    s = inside.groupBy(F.col("c1").alias("cluster")).agg(
        F.sum("w").alias("k"), *[of((F.col("i1") == i) & (F.col("i2") == i)).alias(f"in{i}") for i in (first, second)], *[of(F.col("i1") == i).alias(f"deg{i}") for i in (first, second)]
    )
    q = lambda i: F.try_divide(f"in{i}", "k") - F.try_divide(f"deg{i}", "k") * F.try_divide(f"deg{i}", "k")
    return s.select("cluster", F.coalesce(-(q(first) + q(second)), F.lit(0.0)).alias("coherence"))


def two_heaviest(edges: DataFrame) -> DataFrame:
    """(vertex, best, w1, w2): each vertex's heaviest edge and the weight of its second one."""
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    top = edges.withColumn("r", r).where("r <= 2")
    return top.groupBy(F.col("src").alias("vertex")).agg(
        F.max(F.when(F.col("r") == 1, F.col("dst"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("w"))).alias("w1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("w"))), F.lit(0.0)).alias("w2")
    )


def uniqueness(edges: DataFrame) -> DataFrame:
    return two_heaviest(edges).select("vertex", F.try_divide("w2", "w1").alias("uniqueness"))


def mutual_best(edges: DataFrame, images: DataFrame, threshold: float, first: int = 0) -> DataFrame:
    """(i, j, ratio, w): pairs that are each other's heaviest edge, both clear of their second, from
    image ``first`` to another."""
    top = two_heaviest(edges).where(F.try_divide("w2", "w1") < threshold)
    back = top.select(F.col("vertex").alias("best"), F.col("best").alias("vertex"))
    of = lambda k, n: images.select(F.col("vertex").alias(k), F.col("image").alias(n))
    both = top.join(back, ["vertex", "best"]).join(of("vertex", "a"), "vertex").join(of("best", "b"), "best")
    return both.where((F.col("a") == first) & (F.col("b") != first)).select(F.col("vertex").alias("i"), F.col("best").alias("j"), F.try_divide("w2", "w1").alias("ratio"), F.col("w1").alias("w"))


def _cross_edges(edges: DataFrame, partition: DataFrame, images: DataFrame) -> DataFrame:
    of = lambda k, n: images.select(F.col("vertex").alias(k), F.col("image").alias(n))
    inside = _clustered(edges, partition).where("c1 = c2")
    return inside.join(of("src", "i1"), "src").join(of("dst", "i2"), "dst").where("i1 < i2").withColumnRenamed("c1", "cluster")


def community_matches(edges: DataFrame, full: DataFrame, partition: DataFrame, images: DataFrame, threshold: float, min_coherence: float | None = None) -> DataFrame:
    """(i, j, ratio, w) inside clusters, by image pair.

    A single edge between the two images counts when it is the heaviest of both its ends over the
    full weights and both second weights stay under ``threshold`` of it; of several edges, mutual
    best ones count within the cluster's part in the two images.
    """
    cross = _cross_edges(edges, partition, images)
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster", "i1", "i2"))
    cross = cross.withColumn("n", n)
    top = two_heaviest(full)
    end = lambda k: top.select(F.col("vertex").alias(k), F.col("w1").alias(f"{k}1"), F.col("w2").alias(f"{k}2"))
    single = cross.where("n = 1").join(end("src"), "src").join(end("dst"), "dst")
    single = single.where((F.col("src1") == F.col("dst1")) & (F.try_divide("src2", "w") < threshold) & (F.try_divide("dst2", "w") < threshold))
    single = single.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.try_divide("src2", "w").alias("ratio"), "w")
    several = cross.where("n > 1").select("cluster", "i1", "i2").distinct()
    of = lambda k, m: images.select(F.col("vertex").alias(k), F.col("image").alias(m))
    inside = _clustered(edges, partition).where("c1 = c2").withColumnRenamed("c1", "cluster").join(of("src", "s"), "src").join(of("dst", "d"), "dst")
    local = inside.join(several, "cluster").where("s in (i1, i2) and d in (i1, i2)")
    r = F.row_number().over(Window.partitionBy("cluster", "i1", "i2", "src").orderBy(F.desc("w"), "dst"))
    best = local.withColumn("r", r).where("r <= 2").groupBy("cluster", "i1", "i2", "src", "s").agg(
        F.max(F.when(F.col("r") == 1, F.col("dst"))).alias("dst"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d"),
        F.max(F.when(F.col("r") == 1, F.col("w"))).alias("w"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("w"))), F.lit(0.0)).alias("w2"),
    ).where(F.try_divide("w2", "w") < threshold)
    back = best.select("cluster", "i1", "i2", F.col("src").alias("dst"), F.col("dst").alias("src"))
    pairs = best.join(back, ["cluster", "i1", "i2", "src", "dst"]).where("s = i1 and d = i2").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.try_divide("w2", "w").alias("ratio"), "w")
    return single.union(pairs)


def heaviest_cross_edges(edges: DataFrame, partition: DataFrame, images: DataFrame, first: int, second: int, min_edges: int = 1, min_coherence: float = -1.0) -> DataFrame:
    """(cluster, i, j, w, n): the heaviest edge between two images in each coherent cluster."""
    cross = _cross_edges(edges, partition, images).where((F.col("i1") == first) & (F.col("i2") == second))
    best = cross.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("w", (-F.col("src")).alias("a"), (-F.col("dst")).alias("b"))).alias("top"))
    ok = coherence(edges, partition, images, first, second).where(F.col("coherence") >= min_coherence)
    return best.where(F.col("n") >= min_edges).join(ok, "cluster").select("cluster", (-F.col("top.a")).alias("i"), (-F.col("top.b")).alias("j"), F.col("top.w").alias("w"), "n")


def position_distances(features: DataFrame, by: str | None = None) -> DataFrame:
    """(src, dst, value): squared distances between the keypoints of one set."""
    at = features.withColumn("descriptor", F.array("x", "y"))
    return all_pairs(at, lambda p, q: ((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2), by=by)


def geometric_weights(edges: DataFrame, positions: DataFrame, images: DataFrame, by: str | None = None) -> DataFrame:
    """Within an image the position distance over the largest one of the set, between images the edge weight."""
    most = positions.groupBy(*_keys(by)).agg(F.max("value").alias("most"))
    of = lambda k, n: images.select(F.col("vertex").alias(k), F.col("image").alias(n))
    both = _with(positions, most, by).join(edges.select("src", "dst", "w"), ["src", "dst"], "left").join(of("src", "a"), "src").join(of("dst", "b"), "dst")
    return both.select("src", "dst", F.when(F.col("a") == F.col("b"), F.try_divide("value", "most")).otherwise(F.coalesce("w", F.lit(0.0))).alias("w"))


def result_matrix(scores: DataFrame) -> DataFrame:
    """(p1, p2, value): both orientations of pair scores, not-a-number as zero, scaled to 0..1."""
    both = scores.select("p1", "p2", F.nanvl("score", F.lit(0.0)).alias("v")).union(scores.select("p2", "p1", F.nanvl("score", F.lit(0.0))))
    hi = both.agg(F.greatest(F.max("v"), F.lit(0.0))).scalar()  # the diagonal counts as zero
    lo = both.agg(F.least(F.min("v"), F.lit(0.0))).scalar()
    return both.select("p1", "p2", F.try_divide(F.col("v") - lo, hi - lo).alias("value"))


def match_scores(edges: DataFrame, partition: DataFrame, images: DataFrame, by: str | None = None, scoring: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(set, cluster, share, m, c, score): modularity and coherence of clusters in both images 0 and 1.

    The score is ``scoring`` of the two times the cluster's share of its set's modularity; by default their sum where
    the coherence is positive, else zero.
    """
    rate = scoring or (lambda m, c: F.when(c > 0, m + c).otherwise(0.0))
    both = partition.join(images, "vertex").groupBy("cluster").agg(F.count_if(F.col("image") == 0).alias("n0"), F.count_if(F.col("image") == 1).alias("n1")).where("n0 > 0 and n1 > 0")
    parts = modularity_parts(edges, partition, by).select(*_keys(by), "cluster", F.col("q").alias("m")).join(both, "cluster")
    total = parts.groupBy(*_keys(by)).agg(F.sum("m").alias("total"))
    c = coherence(edges, partition, images, 0, 1).withColumnRenamed("coherence", "c")
    rows = _with(parts, total, by).join(c, "cluster").withColumn("share", F.try_divide("m", "total"))
    return rows.select(*_keys(by), "cluster", "share", "m", "c", (rate(F.col("m"), F.col("c")) * F.col("share")).alias("score"))


def bipartite_scores(edges: DataFrame, partition: DataFrame, images: DataFrame, by: str | None = None) -> DataFrame:
    """(cluster, score): mean weight between the two images by an equal share of the set's clusters, over ten."""
    both = partition.join(images, "vertex").groupBy("cluster", *_keys(by)).agg(F.count_if(F.col("image") == 0).alias("n0"), F.count_if(F.col("image") == 1).alias("n1")).where("n0 > 1 and n1 > 1")
    mean = _cross_edges(edges, partition, images).where("i1 = 0 and i2 = 1").groupBy("cluster").agg(F.avg("w").alias("mean"))
    n = both.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("n"))
    return _with(both.select("cluster", *_keys(by)), n, by).join(mean, "cluster", "left").select("cluster", (F.col("mean") / F.col("n") / 10).alias("score"))


def partition_deviation(partition: DataFrame, features: DataFrame) -> DataFrame:
    """(cluster, image_id, sd): spread of a cluster's keypoints in each image."""
    rows = partition.join(features.select(F.col("feature_id").alias("vertex"), "image_id", "x", "y"), "vertex")
    return rows.groupBy("cluster", "image_id").agg(F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2).alias("sd"))


def geometry_multiplier(max_sd: Column) -> Column:
    return F.when(max_sd < 3, F.lit(1.0)).otherwise(3.0 / max_sd)


def certainty(n: Column) -> Column:
    return F.when(n < 20, n * (40.0 - n) / 400.0).otherwise(F.lit(1.0))
