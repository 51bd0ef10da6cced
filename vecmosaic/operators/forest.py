"""Approximate nearest neighbours by a forest of randomised kd-trees.

Each tree splits a node at the median of a component drawn from those of largest variance.  A query goes down all
trees and keeps one priority queue of the branches it didn't take, by the squared distance to their cells; leaves are
visited from the nearest branch on, whichever tree it is of, until they hold as many rows as the index allows (its
checks).  That number is tuned: a set of calibration queries is searched exactly, and the least number with which the
asked share of their true neighbours was met is taken.

The trees come from a bounded sample drawn by hash; every row is put into its leaf of each tree, so the index holds a row
once per tree.  Queries and rows meet by leaf, in blocks where a leaf or its queries are many; a query that
visits a leaf is compared with its rows alone.  The distances are exact.  A search of all leaves takes one tree, whose
leaves are read past each task's queries.

Rows without an id or a vector take no part; with fewer targets than asked all may be returned; equal distances go to
the smaller id; a feature is never its own neighbour; no targets give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.operators.balltree import _matrix
from vecmosaic.operators.grouped import runs
from vecmosaic.operators.knn import KNN, KnnOptions, _narrow, _record, _topk, ranked, stream_knn
from vecmosaic.operators.passes import stored
from vecmosaic.session import written


@dataclass(frozen=True)
class ForestOptions:
    trees: int = 4
    leaf: int = 64  # rows of the sample in a leaf, at most
    candidates: int = 5  # components of largest variance that a split is drawn from
    sample_rows: int = 20_000
    calibration_queries: int = 128
    precision: float = 0.9  # share of true neighbours that calibration queries must meet; from 1 on every leaf is visited
    block: int = 4096  # rows, and queries, of a leaf handled together
    seed: int = 5


@dataclass
class KdTree:
    """Inner nodes hold (component, cut, left, right); a leaf is the number -1 - leaf."""

    splits: list[tuple[int, float, int, int]] = field(default_factory=list)
    root: int = 0
    leaves: int = 0

    @staticmethod
    def fit(x: np.ndarray, options: ForestOptions, rng: np.random.Generator) -> KdTree:
        out = KdTree()

        def grow(rows: np.ndarray) -> int:
            part = x[rows]
            spread = part.var(axis=0)
            if len(rows) > options.leaf and spread.max() > 0:
                some = np.argsort(-spread, kind="stable")[: options.candidates]
                dim = int(rng.choice(some[spread[some] > 0]))
                cut = float(np.median(part[:, dim]))
                left = part[:, dim] < cut
                if not left.any():  # the median is the least value
                    cut = float(part[part[:, dim] > cut, dim].min())
                    left = part[:, dim] < cut
                at = len(out.splits)
                out.splits.append((dim, cut, 0, 0))
                out.splits[at] = dim, cut, grow(rows[left]), grow(rows[~left])
                return at
            out.leaves += 1
            return -out.leaves

        out.root = grow(np.arange(len(x)))
        return out

    def place(self, x: np.ndarray) -> np.ndarray:
        out, work = np.zeros(len(x), dtype=np.int32), [(self.root, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            dim, cut, left, right = self.splits[node]
            low = x[rows, dim] < cut
            work += [(left, rows[low]), (right, rows[~low])]
        return out


def visits(trees: list[KdTree], counts: list[np.ndarray], q: np.ndarray, checks: float) -> Iterator[tuple[int, int, int]]:
    """(tree, leaf, rows held before it) in the order one query visits leaves, until these hold ``checks`` rows."""
    queue = [(0.0, t, tree.root) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    held = 0
    while queue and held < checks:
        away, t, node = heapq.heappop(queue)
        while node >= 0:
            dim, cut, left, right = trees[t].splits[node]
            side = float(q[dim]) - cut
            near, far = (left, right) if side < 0 else (right, left)
            heapq.heappush(queue, (away + side * side, t, far))
            node = near
        n = int(counts[t][-1 - node])
        if n:
            yield t, -1 - node, held
        held += n


PLACED = "tree int, leaf int, feature_id long, image_id int, descriptor array<double>"


@dataclass
class KdForest:
    """The fitted trees, the rows by leaf, and the tuned number of checks."""

    rows: DataFrame
    trees: list[KdTree]
    counts: list[np.ndarray]
    checks: int
    reached: float
    options: ForestOptions

    def search(self, queries: DataFrame, knn: KnnOptions) -> DataFrame:
        """KNN rows of queries (feature_id, image_id, descriptor).

        Where every leaf is to be visited, the leaves of one tree hold every row; its rows are read past the queries.
        """
        if self.checks > sum(int(c.sum()) for c in self.counts):
            every = self.rows.where("tree = 0").select("feature_id", "image_id", "descriptor")
            return stream_knn(queries, queries.count(), stored(every, "leaves"), knn)
        spark, trees, counts, checks, block = queries.sparkSession, self.trees, self.counts, self.checks, self.options.block
        parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    x = _matrix(part.column("descriptor"))
                    found = [(k, t, leaf) for k in range(len(x)) for t, leaf, _ in visits(trees, counts, x[k], checks)]
                    if found:
                        row, t, leaf = np.array(found).T
                        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(leaf, pa.int32()), *part.take(pa.array(row)).columns], names=["tree", "leaf", *part.schema.names])

        asked = queries.mapInArrow(visit, PLACED)
        # a row per leaf of each tree, of which there are as many as the sample allows
        sizes = spark.createDataFrame([(t, leaf, max(1, -(-int(n) // block))) for t, c in enumerate(counts) for leaf, n in enumerate(c)], "tree int, leaf int, blocks int")
        own = F.pmod(F.xxhash64("feature_id"), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cols = ["tree", "leaf", "feature_id", "image_id", "descriptor"]
        have = self.rows.join(F.broadcast(sizes), ["tree", "leaf"]).select(*cols, own.alias("part"), F.lit(False).alias("asks"))
        ask = asked.join(F.broadcast(sizes), ["tree", "leaf"]).select(*cols, every.alias("part"), F.lit(True).alias("asks"))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, "gid"):
                ids, image, x = table.column("feature_id").to_numpy(), table.column("image_id").to_numpy(), _matrix(table.column("descriptor"))
                key = np.stack([table.column(c).to_numpy() for c in ("tree", "leaf", "part")])
                asks = table.column("asks").to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), len(ids)]
                found = []
                for i, j in zip(cuts, cuts[1:], strict=False):
                    q, t = np.flatnonzero(asks[i:j]) + i, np.flatnonzero(~asks[i:j]) + i
                    for a in range(0, len(q) if len(t) else 0, block):
                        at = q[a : a + block]
                        found += _topk(ids[at], image[at], x[at], ids[t], image[t], x[t], knn)
                yield _record(found)

        met = have.unionByName(ask).withColumn("gid", F.xxhash64("tree", "leaf", "part"))
        near = met.repartition(parallel, "gid").sortWithinPartitions("gid", "tree", "leaf", "part").mapInArrow(search, KNN)
        return ranked(near.dropDuplicates(["q", "t"]), knn.k)


def build_forest(targets: DataFrame, queries: DataFrame, knn: KnnOptions, options: ForestOptions = ForestOptions()) -> KdForest:
    """Fit the trees to a bounded sample, place every row in each, and tune the checks on some of the queries."""
    n = targets.count()
    share = min(1.0, 0.95 * options.sample_rows / n) if n > options.sample_rows else 1.0
    part = F.pmod(F.xxhash64("feature_id", F.lit(options.seed)), F.lit(1 << 30))
    x = _matrix(targets.where(part < int(share * (1 << 30)) + 1).select("descriptor").limit(options.sample_rows).toArrow().column("descriptor"))
    rng = np.random.default_rng(options.seed)
    # the leaves of any one tree hold all rows, so no more are of use where all are visited
    trees = [KdTree.fit(x, options, rng) for _ in range(options.trees if options.precision < 1 else 1)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("descriptor"))
                for t, tree in enumerate(trees):
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(m), pa.int32()), pa.array(tree.place(m)), *batch.columns], names=["tree", "leaf", *batch.schema.names])

    rows = written(targets.mapInArrow(place, PLACED), "forest")
    counts = [np.zeros(tree.leaves, dtype=np.int64) for tree in trees]
    for r in rows.groupBy("tree", "leaf").count().collect():  # a row per leaf
        counts[r["tree"]][r["leaf"]] = r["count"]

    if options.precision >= 1:
        return KdForest(rows, trees, counts, 1 + sum(int(c.sum()) for c in counts), 1.0, options)
    few = queries.orderBy(F.xxhash64("feature_id", F.lit(options.seed)), "feature_id").limit(options.calibration_queries).toArrow()
    q_ids, q_im, q = few.column("feature_id").to_numpy(), few.column("image_id").to_numpy(), _matrix(few.column("descriptor"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's nearest to the calibration queries, with their leaves instead of images."""
        for batch in batches:
            if batch.num_rows:
                m, ids, image = _matrix(batch.column("descriptor")), batch.column("feature_id").to_numpy(), batch.column("image_id").to_numpy()
                yield _record(_topk(q_ids, q_im, q, ids, image, m, knn))

    near = ranked(targets.mapInArrow(scan, KNN), knn.k).select("q", "t")
    true = near.join(rows.select(F.col("feature_id").alias("t"), "tree", "leaf"), "t").collect()  # k rows per calibration query and tree
    best: dict[tuple[int, int], float] = {}
    orders = {int(i): {(t, leaf): held for t, leaf, held in visits(trees, counts, v, float("inf"))} for i, v in zip(q_ids, q, strict=True)}
    for r in true:
        held = orders[r["q"]][r["tree"], r["leaf"]]
        best[r["q"], r["t"]] = min(best.get((r["q"], r["t"]), float("inf")), held)
    needed = np.sort(np.array(list(best.values())))
    # a little more than asked, as other queries deviate from these
    want = min(len(needed), int(np.ceil((options.precision + (1 - options.precision) / 4) * len(needed))))
    checks = int(needed[want - 1]) + 1 if want else 1
    return KdForest(rows, trees, counts, checks, want / len(needed) if len(needed) else 1.0, options)


def forest_knn(queries: DataFrame, targets: DataFrame, knn: KnnOptions, options: ForestOptions = ForestOptions()) -> DataFrame:
    """KNN rows by a forest fitted to the targets."""
    usable = lambda df: _narrow(df).where("feature_id is not null and descriptor is not null")
    queries, targets = usable(queries), usable(targets)
    if not targets.limit(1).count():
        return queries.sparkSession.createDataFrame([], KNN)
    return build_forest(targets, queries, knn, options).search(queries, knn)
