"""A ball tree over a feature table, its nodes under a radius, and neighbours inside nodes.

A node is split in half along the component of largest spread (the first of equal ones), its rows in order of that
component and then of their ids; a node of at most twice ``leaf`` rows is a leaf.  Nodes are numbered as in a heap:
the root is 1, the children of n are 2 n and 2 n + 1, so a node's ancestors are its halves.

The splits at the top are those of all rows: found at once until a node stands for ``block`` rows where there are no
more than ``sample_rows``, else by passes over the table, a level at a time, until a node stands for ``sample_rows``; a
sample only tells where to look for the halves.  Every row is placed by these splits, and each
part is split further in one task by all of its rows.  Centres and radii are those of all rows: a part's task knows the
nodes inside it; for the nodes above, centres follow from the parts' and radii are the largest distances in one more
pass.  The driver holds at most ``max_parts`` splits and centres; beyond that many parts, these grow.

Rows without an id or a vector take no part; vectors have one length; repeated rows are rows of their own; an empty
table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.operators.grouped import groups, runs
from vecmosaic.operators.knn import KNN, KnnOptions, _record, _topk, ranked
from vecmosaic.session import written


@dataclass(frozen=True)
class BallOptions:
    leaf: int = 10
    block: int = 4096
    sample_rows: int = 20_000
    max_parts: int = 16_384
    seed: int = 11


def halves(x: np.ndarray, ids: np.ndarray) -> tuple[int, np.ndarray]:
    """The component of largest spread and the rows in order of it, then of their ids; the first half goes left."""
    dim = int((x.max(axis=0) - x.min(axis=0)).argmax())
    return dim, np.lexsort((ids, x[:, dim]))


@dataclass
class Splits:
    """Splits at the top: a row goes left where its (component, id) is less than the cut."""

    cuts: dict[int, tuple[int, float, int]] = field(default_factory=dict)

    @staticmethod
    def fit(x: np.ndarray, ids: np.ndarray, options: BallOptions) -> Splits:
        out, open_ = Splits(), [(1, np.arange(len(x)))]
        while open_ and len(out.cuts) < options.max_parts:
            node, rows = open_.pop(0)
            if len(rows) <= max(options.block, 2 * options.leaf) or len(rows) < 2:
                continue
            dim, order = halves(x[rows], ids[rows])
            rows = rows[order]
            half = len(rows) // 2
            out.cuts[node] = dim, float(x[rows[half], dim]), int(ids[rows[half]])
            open_ += [(2 * node, rows[:half]), (2 * node + 1, rows[half:])]
        return out

    @staticmethod
    def exact(rows: DataFrame, n: int, x: np.ndarray, ids: np.ndarray, options: BallOptions) -> Splits:
        """Halves of all ``n`` rows (feature_id, descriptor), level by level, while a node has more than ``sample_rows``.

        A pass over the rows finds the spreads of a level's nodes.  The sample (x, ids) gives a bracket around each half;
        a second pass counts the rows below it, and only those inside are ordered.  A half outside its bracket is
        looked for among all rows of the node.
        """
        out, open_ = Splits(), {1: n}
        while open_:
            level = {k: m for k, m in open_.items() if m > max(options.sample_rows, options.block, 2 * options.leaf)}
            level = dict(list(level.items())[: options.max_parts - len(out.cuts)])
            open_, at = {}, out.place(x, ids)
            brackets = {}
            for node, dim in _widest(rows, out, set(level)).items():
                v = np.sort(x[at == node, dim])
                half, slack = len(v) // 2, int(3 * np.sqrt(len(v))) + 1
                low, high = half - slack, half + slack
                brackets[node] = dim, float(v[low]) if low >= 0 else -np.inf, float(v[high]) if high < len(v) else np.inf, level[node] // 2
            cuts = _cuts(rows, out, brackets)
            missed = {k: (dim, -np.inf, np.inf, half) for k, (dim, _, _, half) in brackets.items() if k not in cuts}
            if missed:
                cuts |= _cuts(rows, out, missed)
            for node, (value, first) in cuts.items():
                out.cuts[node] = brackets[node][0], value, first
                open_ |= {2 * node: level[node] // 2, 2 * node + 1: level[node] - level[node] // 2}
        return out

    def place(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out, work = np.ones(len(x), dtype=np.int64), [(1, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if node not in self.cuts or not len(rows):
                out[rows] = node
                continue
            dim, value, cut = self.cuts[node]
            left = (x[rows, dim] < value) | ((x[rows, dim] == value) & (ids[rows] < cut))
            work += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
        return out


def _widest(rows: DataFrame, splits: Splits, level: set[int]) -> dict[int, int]:
    """The component of largest spread of each node, the first of equal ones."""
    if not level:
        return {}

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column("descriptor"))
            at = splits.place(x, batch.column("feature_id").to_numpy())
            for k in level.intersection(np.unique(at).tolist()):
                part = x[at == k]
                low[k] = np.minimum(low.get(k, np.inf), part.min(axis=0))
                high[k] = np.maximum(high.get(k, -np.inf), part.max(axis=0))
        many = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array([v.tolist() for v in low.values()], many), pa.array([v.tolist() for v in high.values()], many)], names=["node", "low", "high"])

    each = rows.mapInArrow(ends, "node long, low array<double>, high array<double>").select("node", F.posexplode(F.arrays_zip("low", "high")).alias("dim", "e"))
    spread = each.groupBy("node", "dim").agg((F.max("e.high") - F.min("e.low")).alias("spread"))
    return {r["node"]: r["dim"] for r in spread.groupBy("node").agg(F.max_by("dim", F.struct("spread", -F.col("dim"))).alias("dim")).collect()}  # a row per node


def _cuts(rows: DataFrame, splits: Splits, brackets: dict[int, tuple[int, float, float, int]]) -> dict[int, tuple[float, int]]:
    """The (component, id) of the first row of each node's second half, for nodes (dim, low, high, half) where it lies in the bracket."""
    if not brackets:
        return {}

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = dict.fromkeys(brackets, 0)
        kinds, names = (pa.int64(), pa.int64(), pa.float64(), pa.int64()), ["node", "below", "v", "id"]
        for batch in batches:
            x, ids = _matrix(batch.column("descriptor")), batch.column("feature_id").to_numpy()
            at = splits.place(x, ids)
            for k in brackets.keys() & set(np.unique(at).tolist()):
                dim, low, high, _ = brackets[k]
                v, i = x[at == k, dim], ids[at == k]
                below[k] += int((v < low).sum())
                some = (v >= low) & (v <= high)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((np.full(some.sum(), k), np.zeros(some.sum()), v[some], i[some]), kinds, strict=True)], names=names)
        none = [None] * len(below)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((list(below), list(below.values()), none, none), kinds, strict=True)], names=names)

    found = written(rows.mapInArrow(inside, "node long, below long, v double, id long"), "ball-cuts")
    half = rows.sparkSession.createDataFrame([(k, b[3]) for k, b in brackets.items()], "node long, half long")
    start = found.groupBy("node").agg(F.sum("below").alias("below")).join(F.broadcast(half), "node")
    place = F.row_number().over(Window.partitionBy("node").orderBy("v", "id"))
    first = found.where("v is not null").drop("below").withColumn("place", place).join(F.broadcast(start), "node").where("below + place = half + 1")
    return {r["node"]: (r["v"], r["id"]) for r in first.select("node", "v", "id").collect()}  # a row per node


def subtree(x: np.ndarray, ids: np.ndarray, root: int, leaf: int) -> tuple[np.ndarray, list[tuple[int, int, float, bool, np.ndarray]]]:
    """The leaf of each row, and (node, rows, radius, is a leaf, centre) of every node from ``root`` down."""
    at, nodes, work = np.zeros(len(x), dtype=np.int64), [], [(root, np.arange(len(x)))]
    while work:
        node, rows = work.pop()
        centre = x[rows].mean(axis=0)
        last = len(rows) <= 2 * leaf
        nodes.append((node, len(rows), float(np.sqrt(((x[rows] - centre) ** 2).sum(axis=1).max())), last, centre))
        if last:
            at[rows] = node
            continue
        rows = rows[halves(x[rows], ids[rows])[1]]
        work += [(2 * node, rows[: len(rows) // 2]), (2 * node + 1, rows[len(rows) // 2 :])]
    return at, nodes


@dataclass
class BallTree:
    """rows (leaf, feature_id, image_id, descriptor) and nodes (node, n, radius, is_leaf)."""

    rows: DataFrame
    nodes: DataFrame

    def selected(self, radius: float) -> DataFrame:
        """The top-most nodes whose radius is below the given one, or which are leaves; nodes below them are skipped."""
        fits = self.nodes.where((F.col("radius") < radius) | F.col("is_leaf"))
        above = fits.select("node", F.explode(_ancestors(F.col("node"))).alias("above"))
        covered = above.join(fits.select(F.col("node").alias("above")), "above").select("node").distinct()
        return fits.join(covered, "node", "left_anti")

    def members(self, radius: float) -> DataFrame:
        """(node, feature_id, image_id, descriptor): the rows by selected node."""
        leaves = self.nodes.where("is_leaf").select(F.col("node").alias("leaf"))
        up = leaves.select("leaf", F.explode(F.concat(F.array("leaf"), _ancestors(F.col("leaf")))).alias("node"))
        of = up.join(self.selected(radius).select("node"), "node")
        return self.rows.join(of, "leaf").select("node", "feature_id", "image_id", "descriptor")


def _ancestors(node: Column) -> Column:
    """Every node above, from the parent to the root."""
    depth = F.length(F.bin(node)) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.call_function("shiftright", node, k))).otherwise(F.array().cast("array<bigint>"))


PLACED = "part long, feature_id long, image_id int, descriptor array<double>"
BUILT = "part long, node long, is_row boolean, feature_id long, image_id int, descriptor array<double>, n long, radius double, is_leaf boolean"


def ball_tree(features: DataFrame, options: BallOptions = BallOptions()) -> BallTree:
    spark = features.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    f = features.select(F.col("feature_id").cast("long"), F.col("image_id").cast("int"), F.col("descriptor").cast("array<double>"))
    f = f.where("feature_id is not null and descriptor is not null")
    n = f.count()
    share = min(1.0, 0.95 * options.sample_rows / n) if n > options.sample_rows else 1.0
    some = f.where(F.pmod(F.xxhash64("feature_id", F.lit(options.seed)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else f
    sample = some.select("feature_id", "descriptor").limit(options.sample_rows).toArrow()
    x, ids = _matrix(sample.column("descriptor")), sample.column("feature_id").to_numpy()
    if share < 1:
        f = written(f, "ball-rows")
        splits = Splits.exact(f.select("feature_id", "descriptor"), n, x, ids, options)
    else:
        splits = Splits.fit(x, ids, options) if sample.num_rows else Splits()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = splits.place(_matrix(batch.column("descriptor")), batch.column("feature_id").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], names=["part", *batch.schema.names])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            part, ids, x = table.column("part").to_numpy(), table.column("feature_id").to_numpy(), _matrix(table.column("descriptor"))
            image = table.column("image_id").combine_chunks()
            for a, b in groups(table, "part"):
                leaf, nodes = subtree(x[a:b], ids[a:b], int(part[a]), options.leaf)
                node, size, radius, last, centre = zip(*nodes, strict=True)
                both = lambda x, y, t: pa.concat_arrays([pa.array(x, t), pa.array(y, t)])
                rows, some = b - a, len(nodes)
                none = [None] * rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(part[a])] * (rows + some), pa.int64()), both(leaf, node, pa.int64()), both([True] * rows, [False] * some, pa.bool_()), both(ids[a:b], [None] * some, pa.int64()),
                        pa.concat_arrays([_whole(image).slice(a, rows), pa.nulls(some, pa.int32())]), both(list(x[a:b]), list(centre), pa.list_(pa.float64())),
                        both(none, size, pa.int64()), both(none, radius, pa.float64()), both(none, last, pa.bool_()),
                    ],
                    names=[c.split()[0] for c in BUILT.split(", ")],
                )

    placed = written(f.mapInArrow(place, PLACED), "ball-parts")
    built = written(placed.repartition(parallel, "part").sortWithinPartitions("part", "feature_id").mapInArrow(build, BUILT), "ball-tree")
    rows = built.where("is_row").select(F.col("node").alias("leaf"), "feature_id", "image_id", "descriptor")
    nodes = built.where("not is_row").select("node", "n", "radius", "is_leaf")
    if splits.cuts:
        nodes = nodes.unionByName(_above(placed, built.where("not is_row and node = part").select("node", "n", "descriptor")))
    return BallTree(rows, nodes)


def _above(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """The nodes above the parts, of which there are at most ``max_parts``: (node, n, radius, is_leaf)."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for r in parts.collect():
        node, total = r["node"] >> 1, r["n"] * np.asarray(r["descriptor"])
        while node:
            n, s = sums.get(node, (0, 0.0))
            sums[node] = n + r["n"], s + total
            node >>= 1
    centres = {k: s / n for k, (n, s) in sums.items()}

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, float] = {}
        for batch in batches:
            x, at = _matrix(batch.column("descriptor")), batch.column("part").to_numpy() >> 1
            while at.any():
                for k in np.unique(at[at > 0]).tolist():
                    best[k] = max(best.get(k, 0.0), float(np.sqrt(((x[at == k] - centres[k]) ** 2).sum(axis=1).max())))
                at = at >> 1
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.float64())], names=["node", "radius"])

    radii = placed.mapInArrow(far, "node long, radius double").groupBy("node").agg(F.max("radius").alias("radius"))
    counts = placed.sparkSession.createDataFrame([(k, int(n)) for k, (n, _) in sums.items()], "node long, n long")
    return radii.join(counts, "node").select("node", "n", "radius", F.lit(False).alias("is_leaf"))


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    v = _whole(column)
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def neighbours_inside(members: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """KNN rows: each row's k nearest others of the same node, from (node, feature_id, image_id, descriptor).

    A node of more than ``block`` rows is dealt into blocks that meet pairwise.
    """
    parallel = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = members.join(sizes, "node").withColumn("mine", F.pmod(F.xxhash64("feature_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cols = ["node", "feature_id", "image_id", "descriptor"]
    alone = rows.where("blocks = 1").select(*cols, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(2).alias("side"))
    large = rows.where("blocks > 1").select(*cols, "mine", other)
    left = large.select(*cols, F.col("mine").alias("a"), F.col("other").alias("b"), F.lit(0).alias("side"))
    right = large.select(*cols, F.col("other").alias("a"), F.col("mine").alias("b"), F.lit(1).alias("side"))
    o = replace(KnnOptions(), k=k)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "gid"):
            ids, x, side = table.column("feature_id").to_numpy(), _matrix(table.column("descriptor")), table.column("side").to_numpy()
            image = table.column("image_id").to_numpy()
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("node", "a", "b")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), len(ids)]
            found = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                q, t = np.flatnonzero(side[i:j] != 1) + i, np.flatnonzero(side[i:j] != 0) + i
                if len(q) and len(t):
                    found += _topk(ids[q], image[q], x[q], ids[t], image[t], x[t], o)
            yield _record(found)

    met = alone.unionByName(left).unionByName(right).withColumn("gid", F.xxhash64("node", "a", "b"))
    return ranked(met.repartition(parallel, "gid").sortWithinPartitions("gid", "node", "a", "b").mapInArrow(near, KNN), k)
