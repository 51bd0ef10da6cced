"""Stitching: image graphs contracted along their heaviest edges, with homographies to a root."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.operators.components import connected_components


def contract(edges: DataFrame) -> DataFrame:
    """(image, root, h, step) from edges (src, dst, n, h array<double>), one direction each.

    In every connected component of images the heaviest edge is contracted: its second image joins
    the first, and the second's other edges are based on the first; of edges that become parallel
    the heavier stays.  A component's images are one group.
    """
    where = connected_components(edges).select(F.col("vertex").alias("src"), "component")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "dst"], kind="stable")
        to = {i: (i, np.eye(3), 0) for i in sorted(set(rows["src"]) | set(rows["dst"]))}
        live: dict[tuple[int, int], tuple[float, np.ndarray]] = {}

        def put(a: int, b: int, n: float, h: np.ndarray) -> None:
            if a > b:
                a, b, h = b, a, np.linalg.inv(h)
            if a != b and ((a, b) not in live or live[a, b][0] < n):
                live[a, b] = n, h / h[2, 2]

        for a, b, n, h in zip(rows["src"], rows["dst"], rows["n"], rows["h"], strict=True):
            put(int(a), int(b), float(n), np.asarray(h, dtype=float).reshape(3, 3))
        step = 0
        while live:
            step += 1
            (a, b), (_, h) = max(live.items(), key=lambda x: (x[1][0], -x[0][0], -x[0][1]))
            back = np.linalg.inv(h)
            for i, (root, own, s) in list(to.items()):
                if root == b:
                    moved = back @ own
                    to[i] = a, moved / moved[2, 2], s or step
            old, live = live, {}
            for (u, v), (n, g) in sorted(old.items()):
                if (u, v) == (a, b):
                    continue
                # an edge's matrix maps points of its first image to its second
                if u == b:
                    put(a, v, n, g @ h)
                elif v == b:
                    put(u, a, n, back @ g)
                else:
                    put(u, v, n, g)
        return pd.DataFrame([(i, r, m.ravel().tolist(), s) for i, (r, m, s) in to.items()], columns=["image", "root", "h", "step"])

    kind = "image long, root long, h array<double>, step int"
    return edges.join(where, "src").groupBy("component").applyInPandas(run, kind)


def trait_graph(partition: DataFrame, features: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of matching traits: two vertices per cluster, one in each image, and a
    scored edge between them."""
    rows = partition.join(features.select(F.col("feature_id").alias("vertex"), "image_id", "x", "y"), "vertex")
    vertices = rows.groupBy("cluster", "image_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (0.1 * F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2)).alias("spread"))
    a, b = vertices.alias("a"), vertices.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.image_id") < F.col("b.image_id"))).select(F.col("a.cluster").alias("cluster"), F.col("a.image_id").alias("im_i"), F.col("b.image_id").alias("im_j"))
    return vertices, pairs.join(scores, "cluster").select("cluster", "im_i", "im_j", (200 * F.col("score")).alias("w"))
