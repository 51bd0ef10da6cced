"""Connected components of an edge table by large-star steps and contraction of what lies together.

Every pair is held as (u, v) with u > v.  In a large-star step u moves from v to the least vertex among v and v's
neighbours.  Then all pairs of one u come together in a task, which replaces the pairs it holds, a bounded number at
a time, by stars around the least vertex of each part.  This joins the different v of one u, as a
small-star step does, and whatever else meets there.  A vertex so has at most a pair in each chunk of
pairs, however many it began with, and a part is finished when all its pairs lead to one vertex.

The steps are the same at every size.  Each round writes two tables and reads them back as plain scans; those before are
deleted.  Many pairs may lead to one v; the join that looks up its least neighbour is between two
exchanged scans, so adaptive execution splits such a v over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.session import discard, new_path, written_at

_PAIR = "u long, v long"


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its part) for the vertices of some pairs but the least ones."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    up = np.arange(len(ids))
    while True:
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            low = np.flatnonzero(up != np.arange(len(ids)))
            return ids[low], ids[up[low]]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, jump := up[up]):
            up = jump


def _stars(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Pairs contracted in chunks, which end between different u where the pairs are sorted by it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in contracted(u, v)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        rows += batch.num_rows
        if rows >= chunk:
            u, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            cut = int(np.flatnonzero(u != u[-1])[-1]) + 1 if (u != u[-1]).any() else 0
            if cut:
                yield out(u[:cut], v[:cut])
            held, rows = [(u[cut:], v[cut:])], len(u) - cut
    if rows:
        yield out(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50, chunk: int = 1 << 19) -> DataFrame:
    """(vertex, component): the least vertex id reachable from each vertex that has an edge to another.

    ``chunk`` pairs are contracted together.  Null ends and loops are dropped; repeated edges count once; no edges give no rows.  Only whether a vertex is left
    with several pairs reaches the driver.
    """
    spark = edges.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stars(batches, chunk)

    def together(pairs: DataFrame) -> tuple[DataFrame, str]:
        met = pairs.repartition(parallel, "u").sortWithinPartitions("u").mapInArrow(stars, _PAIR)
        return written_at(met, new_path(spark, "component-pairs"))

    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    e, at = together(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInArrow(stars, _PAIR))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a vertex that isn't less than its neighbours is done when it has one neighbour
        seen = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        least, where = written_at(seen.select(F.col("u").alias("v"), F.least("u", "m").alias("m"), ((F.col("m") < F.col("u")) & (F.col("m") < F.col("most"))).alias("open")), new_path(spark, "component-least"))
        if not least.where("open").limit(1).count():
            discard(spark, at)
            return least.select(F.col("v").alias("vertex"), F.col("m").alias("component"))
        before = at
        e, at = together(e.join(least.select("v", "m"), "v").select("u", F.col("m").alias("v")))
        discard(spark, where)
        discard(spark, before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
