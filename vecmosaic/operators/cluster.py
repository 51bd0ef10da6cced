"""Communities and geometric clusters.

Louvain moves depend on vertex order, so each connected component is one group of a kernel; the
components themselves are found with distributed joins.  Geometric clustering iterates on small
tables of centres: points are assigned in the JVM with the centres as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.operators.communities import annealed, local_moving
from vecmosaic.operators.components import connected_components
from vecmosaic.session import checkpointed


def louvain_kernel(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, total: float, gain: float = 1e-6, max_sweeps: int = 100) -> np.ndarray:
    """Communities by one level of local moving over a component, vertices in rising id order.

    ``total`` is the weight of the whole graph.  Ties go to the larger community id; the sweeps
    stop when nothing moves or the modularity no longer rises.
    """
    place = {v: k for k, v in enumerate(ids.tolist())}
    near: list[dict[int, float]] = [{} for _ in ids]
    for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
        near[place[a]][place[b]] = x
    degree = np.array([sum(n.values()) for n in near])
    label, inside, deg = np.arange(len(ids)), np.zeros(len(ids)), degree.copy()

    def delta(v: int, part: int, links: float) -> float:
        return (2 * links - (degree[v] * (2 * deg[part] - inside[part]) + degree[v] ** 2) / total) / total

    def quality() -> float:
        return float((inside / total - (deg / total) ** 2).sum())

    before = 0.0
    for _ in range(max_sweeps):
        moved = 0
        for v in range(len(ids)):
            links: dict[int, float] = {}
            for u, x in near[v].items():
                links[label[u]] = links.get(label[u], 0.0) + x
            old = label[v]
            if not links:
                continue
            best, part = max((delta(v, p, x), p) for p, x in links.items())
            if best - delta(v, old, links.get(old, 0.0)) > gain and part != old:
                inside[old] -= 2 * links.get(old, 0.0)
                inside[part] += 2 * links[part]
                deg[old] -= degree[v]
                deg[part] += degree[v]
                label[v] = part
                moved += 1
        now = quality()
        if not moved or now - before <= 0:
            break
        before = now
    return ids[label]


def _by_size(edges: DataFrame, task_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges with their component: of components that one task holds, and of larger ones if there are any."""
    named = checkpointed(edges.join(connected_components(edges).withColumnRenamed("vertex", "src"), "src"))
    large = checkpointed(named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_edges).select("component"))
    if not large.limit(1).count():
        return named, None
    return named.join(large, "component", "left_anti"), named.join(large, "component")


def louvain(edges: DataFrame, by: str | None = None, task_edges: int = 2_000_000) -> DataFrame:
    """(vertex, cluster) for every vertex with an edge.

    Gains use the weight of the whole graph, or with ``by`` of the vertex's set.  A component of at most ``task_edges``
    edges is one task, where vertices move one by one in order of their ids until a sweep gains nothing; in
    larger ones they move a class at a time over tables (``communities``), which is another order of the same moves.
    """
    of = [by] if by else []
    edges = checkpointed(edges.select("src", "dst", "w", *of))
    totals = edges.groupBy(*of).agg(F.sum("w").alias("total")).where("total <> 0")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _moved(rows, float(rows["total"].iloc[0]))

    small, large = _by_size(edges, task_edges)
    named = small.join(totals, by) if by else small.join(F.broadcast(totals))  # one row
    found = named.select("component", "src", "dst", "w", "total").groupBy("component").applyInPandas(run, "vertex long, cluster long")
    if large is None:
        return found
    return found.unionByName(local_moving(large.select("src", "dst", "w", *of), by, totals=totals))


def _moved(rows: pd.DataFrame, total: float) -> pd.DataFrame:
    rows = rows.sort_values(["src", "dst"], kind="stable")
    ids = np.unique(rows["src"].to_numpy())
    return pd.DataFrame({"vertex": ids, "cluster": louvain_kernel(ids, rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["w"].to_numpy(), total)})


def _grid_threshold(w: np.ndarray, need: float, n: int = 600) -> float:
    """The first of n even thresholds from 1 to 0 that ``need`` weights exceed."""
    for k in range(n):
        t = 1.0 - k / (n - 1)
        if (w > t).sum() >= need:
            return t
    return 0.0


def split_large(edges: DataFrame, partition: DataFrame, split_limit: int, per_vertex: float, depth: int = 11, prune_fun: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """(vertex, cluster): clusters over the limit are pruned, rescaled and clustered again, to a depth.

    All clusters over the limit are split in one job per depth.  ``prune_fun`` says which of a
    cluster's rescaled weights stay, given its number of vertices; by default those above the
    threshold of ``per_vertex`` edges a vertex.
    """
    keep = prune_fun or (lambda w, n: (w > _grid_threshold(w, per_vertex * 2.0 * n)) & (w != 1))
    edges, part = checkpointed(edges.select("src", "dst", "w")), checkpointed(partition.select("vertex", "cluster"))

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        own, n, w = int(rows["cluster"].iloc[0]), int(rows["n"].iloc[0]), rows["w"].to_numpy()
        none = pd.DataFrame({"vertex": np.array([], dtype=np.int64), "new": np.array([], dtype=np.int64)})
        if w.min() == w.max():
            return none
        scaled = rows.assign(w=(w - w.min()) / (w.max() - w.min()))
        scaled = scaled[keep(scaled["w"].to_numpy(), n)]
        total = scaled["w"].sum()
        return _moved(scaled, total).rename(columns={"cluster": "new"}) if len(scaled) and total else none

    for _ in range(depth):
        large = part.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_limit)
        todo = part.join(large, "cluster")
        ends = lambda k, c: todo.select(F.col("vertex").alias(k), F.col("cluster").alias(c), "n")
        inside = edges.join(ends("src", "cluster"), "src").join(ends("dst", "other").drop("n"), "dst").where("cluster = other")
        split = inside.select("cluster", "n", "src", "dst", "w").groupBy("cluster").applyInPandas(again, "vertex long, new long")
        after = checkpointed(part.join(split, "vertex", "left").select("vertex", F.coalesce("new", "cluster").alias("cluster"), (F.coalesce("new", "cluster") != F.col("cluster")).alias("moved")))
        part = after.select("vertex", "cluster")
        if not after.where("moved").limit(1).count():
            break
    return part


@dataclass(frozen=True)
class IsodataOptions:
    k_init: int = 50
    max_iterations: int = 20
    min_size: int = 10
    max_sd: float = 40.0
    min_distance: float = 25.0
    max_mergers: int = 10
    merge: bool = True
    seed: int = 1864


def assign(points: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """Points (id, x, y) with the nearest centre; ties go to the first."""
    d = [((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)) for cx, cy in centres]
    near = F.array_min(F.array(*[F.struct(x.alias("d"), F.lit(k).alias("k")) for k, x in enumerate(d)]))
    return points.withColumn("__n", near).select("id", "x", "y", F.col("__n.k").alias("cluster"), F.sqrt("__n.d").alias("dist"))


def centres_of(assigned: DataFrame) -> list[dict]:
    """Size, centre, spread and deviations of each cluster; a row per cluster reaches the driver."""
    s = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("dist").alias("spread"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")
    )
    return [r.asDict() for r in s.orderBy("cluster").collect()]


def isodata(points: DataFrame, options: IsodataOptions = IsodataOptions()) -> DataFrame:
    """(id, x, y, cluster, dist): iterative self-organising clusters of points (id, x, y).

    Start centres are the points of least hash.  Clusters under the least size are dissolved;
    wide ones are split along their wider axis; close centres are merged in pairs.
    """
    first = points.orderBy(F.xxhash64("id", F.lit(options.seed)), "id").limit(options.k_init).select("x", "y").collect()
    centres = [(float(r["x"]), float(r["y"])) for r in first]
    if not centres:
        return points.select("id", "x", "y", F.lit(0).alias("cluster"), F.lit(0.0).alias("dist"))
    return assign(points, settled(centres, lambda c: centres_of(assign(points, c)), options))


def isodata_groups(points: DataFrame, options: IsodataOptions, *by: str) -> DataFrame:
    """(by, id, x, y, cluster, dist): the same for each group of points alone, a group in one task.

    A group is the points of one image in the matches of a pair, say, so it is bounded by an image's features.
    """
    keyed = points.select(*by, F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.xxhash64("id", F.lit(options.seed)).alias("h"))

    def nearest(xy: np.ndarray, centres: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
        d = ((xy[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        return at, np.sqrt(d[np.arange(len(xy)), at])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "id"], kind="stable")
        xy = rows[["x", "y"]].to_numpy()

        def stats(centres: list[tuple[float, float]]) -> list[dict]:
            at, dist = nearest(xy, centres)
            out = []
            for k in np.unique(at).tolist():
                p = xy[at == k]
                (cx, cy), (sx, sy) = p.mean(axis=0).tolist(), p.std(axis=0).tolist()
                out.append({"cluster": k, "n": len(p), "cx": cx, "cy": cy, "spread": float(dist[at == k].mean()), "sx": sx, "sy": sy})
            return out

        at, dist = nearest(xy, settled([tuple(p) for p in xy[: options.k_init].tolist()], stats, options))
        return rows.assign(cluster=at.astype(np.int32), dist=dist)[[*by, "id", "x", "y", "cluster", "dist"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name in by)
    return keyed.groupBy(*by).applyInPandas(run, f"{kinds}, id long, x double, y double, cluster int, dist double")


def settled(centres: list[tuple[float, float]], stats_of: Callable[[list[tuple[float, float]]], list[dict]], options: IsodataOptions) -> list[tuple[float, float]]:
    """The centres after all iterations; ``stats_of`` measures the clusters around given centres."""
    o = options
    for it in range(o.max_iterations):
        while True:
            stats = stats_of(centres)
            kept = [s for s in stats if s["n"] >= o.min_size] or [max(stats, key=lambda s: s["n"])]
            centres = [(s["cx"], s["cy"]) for s in kept]
            if len(kept) == len(stats):
                break
        stats = stats_of(centres)
        k, last = len(centres), it == o.max_iterations - 1
        mean = sum(s["spread"] * s["n"] for s in stats) / sum(s["n"] for s in stats)
        if not (last or (2 * k > o.k_init and it % 2 == 0) or k >= 2 * o.k_init):
            wide = [s for s in stats if max(s["sx"], s["sy"]) > o.max_sd and ((s["spread"] > mean and s["n"] > 2 * (o.min_size + 1)) or 2 * k <= o.k_init)]
            if wide:
                ids = {s["cluster"] for s in wide}
                centres = [(s["cx"], s["cy"]) for s in stats if s["cluster"] not in ids]
                for s in wide:
                    dx, dy = (s["sx"], 0.0) if s["sx"] >= s["sy"] else (0.0, s["sy"])
                    centres += [(s["cx"] + dx, s["cy"] + dy), (s["cx"] - dx, s["cy"] - dy)]
                continue
        if o.merge and not last:
            pairs = sorted((np.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]), i, j) for i, a in enumerate(stats) for j, b in enumerate(stats) if i < j)
            gone: set[int] = set()
            joined = []
            for d, i, j in pairs:
                if d >= o.min_distance or len(joined) >= o.max_mergers:
                    break
                if i not in gone and j not in gone:
                    a, b = stats[i], stats[j]
                    n = a["n"] + b["n"]
                    joined.append(((a["cx"] * a["n"] + b["cx"] * b["n"]) / n, (a["cy"] * a["n"] + b["cy"] * b["n"]) / n))
                    gone |= {i, j}
            if joined:
                centres = [(s["cx"], s["cy"]) for i, s in enumerate(stats) if i not in gone] + joined
    return centres


def linked_clusters(matches: DataFrame, options: IsodataOptions, share: float = 0.5, least: int = 5) -> DataFrame:
    """Matches (im_i, im_j, i, j, x1, y1, x2, y2) of every image pair in linked clusters, with these: p1, p2.

    The points of both images of a pair are clustered apart.  A cluster of the first image is linked with those of the
    second that more than ``share`` of its most frequent one's matches lead to, and more than ``least``.
    """
    pair = ["im_i", "im_j"]
    sides = []
    for n, key in ((1, "i"), (2, "j")):
        points = matches.select(*pair, F.col(key).alias("id"), F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y")).distinct()
        sides.append(isodata_groups(points, options, *pair).select(*pair, F.col("id").alias(key), F.col("cluster").alias(f"p{n}")))
    linked = matches.join(sides[0], [*pair, "i"]).join(sides[1], [*pair, "j"])
    counts = linked.groupBy(*pair, "p1", "p2").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(*pair, "p1").agg(F.max("n").alias("most"))
    good = counts.join(most, [*pair, "p1"]).where((F.col("n") > share * F.col("most")) & (F.col("n") > least)).select(*pair, "p1", "p2")
    return linked.join(good, [*pair, "p1", "p2"], "left_semi")


def spin_glass(edges: DataFrame, k: int = 8, sweeps: int = 200, gamma: float = 1.0, seed: int = 7, task_edges: int = 2_000_000) -> DataFrame:
    """(vertex, cluster): communities of least Potts energy by simulated annealing, by component.

    A component of at most ``task_edges`` edges is one task, where a step looks at the edges of one vertex only; larger
    ones are annealed a class of vertices at a time over tables (``communities``).
    """
    total = edges.agg(F.sum("w")).first()[0] or 1.0
    temperatures = np.geomspace(1.0, 0.01, sweeps)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "dst"], kind="stable")
        ids, s = np.unique(rows["src"].to_numpy(), return_inverse=True)
        d = np.searchsorted(ids, rows["dst"].to_numpy())
        w = rows["w"].to_numpy()
        rng = np.random.default_rng(seed)
        first = np.searchsorted(s, np.arange(len(ids) + 1))
        degree = np.bincount(s, weights=w, minlength=len(ids))
        label = rng.integers(0, k, len(ids))
        mass = np.bincount(label, weights=degree, minlength=k)
        for t in temperatures:
            for v in range(len(ids)):
                a, b = first[v], first[v + 1]
                mass[label[v]] -= degree[v]
                field = np.bincount(label[d[a:b]], weights=w[a:b], minlength=k) - gamma * degree[v] * mass / total
                p = np.exp((field - field.max()) / (t * max(degree[v], 1e-12)))
                label[v] = rng.choice(k, p=p / p.sum())
                mass[label[v]] += degree[v]
        return pd.DataFrame({"vertex": ids, "cluster": (ids[0] * k + label).astype(np.int64)})

    small, large = _by_size(edges, task_edges)
    found = small.select("component", "src", "dst", "w").groupBy("component").applyInPandas(run, "vertex long, cluster long")
    if large is None:
        return found
    where = large.select(F.col("src").alias("vertex"), "component").distinct()
    return found.unionByName(annealed(large.select("src", "dst", "w"), where, k, temperatures.tolist(), gamma, seed=seed, total=total))


def _expected_information(i: int, j: int, n: int, part: int = 1 << 20) -> float:
    """The expected contribution to the mutual information of two clusters of i and j of n rows, over their chance overlaps."""
    from math import lgamma

    first, last = max(1, i + j - n), min(i, j)
    log_p = lgamma(i + 1) + lgamma(j + 1) + lgamma(n - i + 1) + lgamma(n - j + 1) - lgamma(n + 1) - lgamma(first + 1) - lgamma(i - first + 1) - lgamma(j - first + 1) - lgamma(n - i - j + first + 1)
    out = 0.0
    for a in range(first, last + 1, part):
        k = np.arange(a, min(a + part, last + 1), dtype=float)
        # the chance of one overlap more, from that before
        up = np.log((i - k) * (j - k), where=k < last, out=np.zeros(len(k))) - np.log((k + 1) * (n - i - j + k + 1))
        logs = log_p + np.concatenate([[0.0], np.cumsum(up[:-1])])
        out += float((k / n * np.log(n * k / (float(i) * j)) * np.exp(logs)).sum())
        log_p = logs[-1] + up[-1]
    return out


def adjusted_mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (mi, ami) of two partitions (vertex, cluster), from the cells of their contingency table that aren't zero.

    The expected information depends on the sizes of clusters alone, so it is taken once for each two sizes that occur; of
    n rows these are at most 2 n pairs.
    """
    both = a.select("vertex", F.col("cluster").alias("x")).join(b.select("vertex", F.col("cluster").alias("y")), "vertex")
    cells = checkpointed(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    total = cells.agg(F.sum("n")).first()[0]
    sizes = {k: cells.groupBy(k).agg(F.sum("n").alias(f"n{k}")) for k in ("x", "y")}
    n = F.lit(float(total or 0))
    share = lambda c: F.col(c) / n
    mi = cells.join(sizes["x"], "x").join(sizes["y"], "y").agg(F.sum(share("n") * (F.log(n * F.col("n")) - F.log("nx") - F.log("ny"))).alias("mi"))
    entropy = {k: s.agg(F.sum(-share(f"n{k}") * F.log(share(f"n{k}"))).alias(f"h{k}")) for k, s in sizes.items()}
    often = {k: s.groupBy(f"n{k}").agg(F.count(F.lit(1)).alias(f"m{k}")) for k, s in sizes.items()}

    def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            each = [x * y * _expected_information(int(i), int(j), int(total)) for i, x, j, y in zip(f["nx"], f["mx"], f["ny"], f["my"], strict=True)]
            yield pd.DataFrame({"e": [float(sum(each))]})

    parallel = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = often["x"].crossJoin(often["y"]).repartition(parallel, "nx", "ny")
    expected = pairs.mapInPandas(expect, "e double").agg(F.sum("e").alias("e"))
    one = mi.crossJoin(entropy["x"]).crossJoin(entropy["y"]).crossJoin(expected).where("mi is not null")
    top = (F.col("hx") + F.col("hy")) / 2 - F.col("e")
    return one.select("mi", F.when(F.abs(top) > 1e-15, (F.col("mi") - F.col("e")) / top).otherwise(F.lit(1.0)).alias("ami"))
