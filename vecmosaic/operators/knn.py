"""k-nearest-neighbour joins of feature tables.

Strategies: ``block`` keeps the targets in every worker and is used only while their measured
size is below ``broadcast_bytes``; ``grid`` writes the targets to the shared folder once, where every
task reads them past its queries, and holds at any size; ``sql`` takes candidates in the same way and leaves distances and
ranks to expressions; ``forest`` is approximate, by randomised kd-trees tuned to ``precision``.
The first three agree: distances are computed from the component differences, ties go to the
smaller id, and a feature is never its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.functions import vectors as V
from vecmosaic.operators.passes import Stored, pass_over, stored
from vecmosaic.session import discard, written

KNN = "q long, qi int, r int, t long, ti int, d double"


@dataclass(frozen=True)
class KnnOptions:
    k: int = 3
    scope: str = "all"  # all, same: the query's image only, other: all images but the query's
    metric: str = "l2"  # l2, angle: arc cosine of the scaled dot product
    strategy: str = "auto"  # auto, block, grid, sql, forest
    broadcast_bytes: int = 64 << 20
    block: int = 2048
    dot_scale: float = 0.9999
    precision: float = 0.9  # of ``forest``

    def __post_init__(self) -> None:
        if self.scope not in ("all", "same", "other") or self.metric not in ("l2", "angle"):
            raise ValueError(f"unknown scope {self.scope} or metric {self.metric}")


def _distances(q: np.ndarray, t: np.ndarray, o: KnnOptions) -> np.ndarray:
    if o.metric == "angle":
        return np.arccos(np.clip(o.dot_scale * (q * t).sum(axis=-1), -1, 1))
    if o.strategy == "sql":  # added in the order of the components like the expressions, to the last bit
        return np.sqrt(np.add.accumulate((q - t) ** 2, axis=-1)[..., -1])
    return np.sqrt(((q - t) ** 2).sum(axis=-1))


class _Nearest:
    """The k nearest of some queries over blocks of targets, one block at a time.

    A product of single precision, with a bound on its rounding, only picks the candidates: those not surely beyond a
    query's k-th nearest so far.  Their distances are exact; ties go to the smaller id.  Where images matter, queries and
    targets are in order of them, so that those of one image are a rectangle of the product.
    """

    def __init__(self, qid: np.ndarray, qi: np.ndarray, q: np.ndarray, o: KnnOptions, tile: int = 256) -> None:
        self.order = np.arange(len(q)) if o.scope == "all" else np.argsort(qi, kind="stable")
        self.qid, self.qi, self.q, self.o, self.tile = qid[self.order], qi[self.order], q[self.order], o, tile
        self.q2 = (self.q * self.q).sum(axis=1)
        self.left = np.concatenate([-self.q, np.ones((len(q), 1))], axis=1).astype(np.float32)
        self.n = np.zeros(len(q), dtype=np.int64)  # found so far
        self.d = np.full((len(q), o.k), np.inf)
        self.t = np.zeros((len(q), o.k), dtype=np.int64)
        self.ti = np.zeros((len(q), o.k), dtype=np.int64)
        self.bound = np.full(len(q), np.inf)  # of the product, for the k-th distance

    def add(self, tid: np.ndarray, ti: np.ndarray, t: np.ndarray) -> None:
        for b in range(0, len(tid), 4096):
            self._block(tid[b : b + 4096], ti[b : b + 4096], t[b : b + 4096])

    def _block(self, tid: np.ndarray, ti: np.ndarray, t: np.ndarray) -> None:
        o, same = self.o, []
        if o.scope != "all":
            order = np.argsort(ti, kind="stable")
            tid, ti, t = tid[order], ti[order], t[order]
            images, first = np.unique(ti, return_index=True)
            rows = np.searchsorted(self.qi, images), np.searchsorted(self.qi, images, side="right")
            same = [r for r in zip(*(x.tolist() for x in rows), first.tolist(), [*first[1:].tolist(), len(ti)], strict=True) if r[0] < r[1]]
        t2 = (t * t).sum(axis=1)
        right = np.concatenate([t, np.zeros((len(t), 1)) if o.metric == "angle" else t2[:, None] / 2], axis=1)
        right32 = np.ascontiguousarray(right.astype(np.float32).T)
        # of the rounding of a product of so many single-precision terms
        loose = 1.2e-7 * (t.shape[1] + 8) * (np.sqrt(self.q2 * t2.max(initial=0)) + t2.max(initial=0) / 2)
        tight = 1e-9 * (1 + self.q2 + t2.max(initial=0))
        for top, end, first, last in same if o.scope == "same" else [(0, len(self.q), 0, len(t))]:
            for a in range(top, end, self.tile):
                at = slice(a, min(end, a + self.tile))
                bad = [(max(x, at.start) - a, min(y, at.stop) - a, c, d) for x, y, c, d in same if x < at.stop and y > at.start] if o.scope == "other" else []
                i, j = self._candidates(self.left[at], right32[:, first:last], loose[at], bad, at, tid[first:last])
                if len(i) > 16 * (last - first) + (at.stop - a) * (last - first) // 16:  # the rounding lets too much through
                    wide = np.concatenate([-self.q[at], np.ones((at.stop - a, 1))], axis=1)
                    i, j = self._candidates(wide, right[first:last].T, tight[at], bad, at, tid[first:last])
                for c in range(0, len(i), 65_536):
                    row, col = i[c : c + 65_536] + a, j[c : c + 65_536] + first
                    self._merge(row, _distances(self.q[row], t[col], o), tid[col], ti[col])

    def _candidates(self, left: np.ndarray, right: np.ndarray, slack: np.ndarray, bad: list[tuple[int, int, int, int]], at: slice, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            rough = left @ right
        for top, end, first, last in bad:
            rough[top:end, first:last] = np.inf
        most = self.bound[at] + slack
        open_ = np.flatnonzero(np.isinf(self.bound[at]))
        if len(open_):
            k = min(self.o.k, rough.shape[1])
            some = rough[open_]
            some[self.qid[at][open_, None] == tid[None, :]] = np.inf
            most[open_] = np.partition(some, k - 1, axis=1)[:, k - 1] + 2 * slack[open_]
        if self.o.metric == "angle":
            # cosines beyond 1 or -1 share an angle, and the smaller id decides
            end = 1 / self.o.dot_scale
            most = np.where(most >= end - slack, np.inf, np.maximum(most, slack - end))
        # over the largest number only where nothing bounds a query yet
        with np.errstate(over="ignore"):
            most = np.nextafter(np.minimum(most, np.finfo(np.float32).max).astype(rough.dtype), rough.dtype.type(np.inf))
        # few queries have a candidate in a block once many rows are read; a least product that isn't a number tells nothing
        some = np.flatnonzero(~(rough.min(axis=1) >= most))
        i, j = np.nonzero(rough[some] < most[some, None])
        i = some[i]
        other = self.qid[at][i] != tid[j]
        return i[other], j[other]

    def _merge(self, row: np.ndarray, d: np.ndarray, t: np.ndarray, ti: np.ndarray) -> None:
        k = self.o.k
        some = np.unique(row)
        r, c = np.nonzero(np.arange(k)[None, :] < self.n[some, None])
        old = some[r]
        row, d, t, ti = (np.concatenate(p) for p in ((row, old), (d, self.d[old, c]), (t, self.t[old, c]), (ti, self.ti[old, c])))
        order = np.lexsort((t, d, row))
        row, d, t, ti = row[order], d[order], t[order], ti[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
        keep = place < k
        at = row[keep], place[keep]
        self.d[at], self.t[at], self.ti[at] = d[keep], t[keep], ti[keep]
        self.n[some] = np.minimum(np.diff(first, append=len(row)), k)
        full = some[self.n[some] == k]
        last = self.d[full, k - 1]
        if self.o.metric == "angle":
            self.bound[full] = -np.cos(last) / self.o.dot_scale + 1e-9 * (1 + self.q2[full])
        else:
            self.bound[full] = (last * last - self.q2[full]) / 2 + 1e-9 * (1 + self.q2[full] + last * last)

    def columns(self) -> tuple[np.ndarray, ...]:
        """The arrays of KNN rows, by query and rank."""
        back = np.argsort(self.order)
        i, r = np.nonzero(np.arange(self.o.k)[None, :] < self.n[back, None])
        i = back[i]
        return self.qid[i], self.qi[i], r + 1, self.t[i, r], self.ti[i, r], self.d[i, r]


def _topk(qid: np.ndarray, qi: np.ndarray, q: np.ndarray, tid: np.ndarray, ti: np.ndarray, t: np.ndarray, o: KnnOptions) -> list[tuple]:
    """KNN rows of one block against one block."""
    near = _Nearest(qid, qi, q, o)
    near.add(tid, ti, t)
    return list(zip(*(c.tolist() for c in near.columns()), strict=True))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
    cols = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["q", "qi", "r", "t", "ti", "d"])


def _arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    v = batch.column("descriptor")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column("feature_id").to_numpy(), batch.column("image_id").to_numpy(), flat.reshape(n, -1) if n else flat.reshape(0, 1)


def _narrow(df: DataFrame) -> DataFrame:
    return df.select(F.col("feature_id").cast("long"), F.col("image_id").cast("int"), F.col("descriptor").cast("array<double>"))


def _block(queries: DataFrame, targets: DataFrame, o: KnnOptions) -> DataFrame:
    held = queries.sparkSession.sparkContext.broadcast(_arrays(targets.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for batch in batches:
            if batch.num_rows and len(t[0]):
                near = _Nearest(*_arrays(batch), o)
                near.add(*t)
                yield _columns(near)

    return queries.mapInArrow(run, KNN)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))
    return rows.withColumn("r", r).where(F.col("r") <= k).select("q", "qi", "r", "t", "ti", "d")


def _columns(near: _Nearest) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(near.columns(), kinds, strict=True)], names=["q", "qi", "r", "t", "ti", "d"])


def stream_knn(queries: DataFrame, n: int, targets: Stored, o: KnnOptions) -> DataFrame:
    """KNN rows of about ``n`` queries, each task's against the targets in the shared folder, ``block`` of them at a time."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        near = _Nearest(*_arrays(table), o)
        for batch in targets.batches(o.block):
            near.add(*_arrays(batch))
        yield _columns(near)

    return pass_over(queries, n, "feature_id", run, KNN, 8 * o.block)


def _grid(queries: DataFrame, targets: DataFrame, nq: int, o: KnnOptions) -> DataFrame:
    """The neighbours are written, so that a plan that uses them more than once doesn't search again."""
    spark, at = queries.sparkSession, stored(targets, "targets")
    near = written(stream_knn(queries, nq, at, o), "neighbours")
    discard(spark, at.uri)
    return near


def _pairs(queries: DataFrame, targets: DataFrame, o: KnnOptions) -> DataFrame:
    """All pairs, for what no product takes: distances as expressions, in two passes over the pairs, of which none is shuffled.

    The targets are dealt into segments.  The k-th least of a query's least distances to the segments bounds its k-th
    distance; the second pass ranks the pairs within that bound only.
    """
    about = queries.select(F.size("descriptor").alias("n")).union(targets.select(F.size("descriptor"))).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    dims = range(about["most"] or 0) if about["most"] == about["least"] else ()
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # vectors of one length as columns, as sums of these are compiled and folds over arrays aren't
    wide = lambda k: [F.coalesce(F.get("descriptor", F.lit(i)), F.lit(float("nan"))).alias(f"{k}{i}") for i in dims] or [F.col("descriptor").alias(f"{k}v")]
    q = queries.repartition(parts, "feature_id").select(F.col("feature_id").alias("q"), F.col("image_id").alias("qi"), *wide("q"))
    t = targets.repartition(max(1, parts // 8), "feature_id").select(F.col("feature_id").alias("t"), F.col("image_id").alias("ti"), F.pmod(F.xxhash64("feature_id"), F.lit(8 * o.k)).alias("segment"), *wide("t"))
    on = _scoped(o.scope)
    if o.metric == "l2":
        d = F.expr(f"sqrt({' + '.join(['0.0D', *(f'(q{i} - t{i}) * (q{i} - t{i})' for i in dims)])})") if dims else V.euclidean(F.col("qv"), F.col("tv"))
    else:
        dot = F.expr(" + ".join(["0.0D", *(f"q{i} * t{i}" for i in dims)])) if dims else V.dot(F.col("qv"), F.col("tv"))
        d = F.acos(F.greatest(F.least(o.dot_scale * dot, F.lit(1.0)), F.lit(-1.0)))
    least = q.join(t, on).select("q", "segment", d.alias("d")).groupBy("q", "segment").agg(F.min("d").alias("d"))
    bound = least.groupBy("q").agg(F.get(F.sort_array(F.collect_list("d")), F.lit(o.k - 1)).alias("bound"))
    near = q.join(bound, "q", "left").join(t, on & (F.col("bound").isNull() | (d <= F.col("bound"))))
    return ranked(near.select("q", "qi", "t", "ti", d.alias("d")), o.k)


def _scoped(scope: str) -> Column:
    on = F.col("q") != F.col("t")
    return on if scope == "all" else on & ((F.col("qi") == F.col("ti")) if scope == "same" else (F.col("qi") != F.col("ti")))


def _candidates(queries: DataFrame, n: int, targets: Stored, o: KnnOptions, block: int = 2048) -> DataFrame:
    """(q, qi, qv, t, ti, tv): the pairs of about ``n`` queries that hold each one's k nearest, with their vectors."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        near = _Nearest(*_arrays(table), o)
        for batch in targets.batches(block):
            near.add(*_arrays(batch))
        i, r = np.nonzero(np.arange(o.k)[None, :] < near.n[:, None])
        t, i = np.unique(np.stack([near.t[i, r], i]), axis=1)  # each once, as an id may have several rows
        for batch in targets.batches(block):
            tid, ti, tv = _arrays(batch)
            first, last = np.searchsorted(t, tid), np.searchsorted(t, tid, side="right")
            j = np.repeat(np.arange(len(tid)), last - first)
            row = i[np.arange(len(j)) + np.repeat(last - np.cumsum(last - first), last - first)]
            for a in range(0, len(j), 8192):
                x, y = row[a : a + 8192], j[a : a + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.qid[x], pa.int64()), pa.array(near.qi[x], pa.int32()), _lists(near.q[x]), pa.array(tid[y], pa.int64()), pa.array(ti[y], pa.int32()), _lists(tv[y])],
                    names=["q", "qi", "qv", "t", "ti", "tv"],
                )

    return pass_over(queries, n, "feature_id", run, "q long, qi int, qv array<double>, t long, ti int, tv array<double>", 8 * block)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def _sql(queries: DataFrame, targets: DataFrame, o: KnnOptions) -> DataFrame:
    """Distances and ranks as expressions, over the candidates of a search that compares every pair.

    The search adds in the same order, so its nearest are those of the expressions.  Rows with a null, with a component that
    isn't finite, or too long for single precision are compared as expressions with every row.
    """
    spark = queries.sparkSession
    square = F.coalesce(F.aggregate("descriptor", F.lit(0.0), lambda a, x: a + x * x), F.lit(float("nan")))
    fits = (square < 1e30) & F.col("feature_id").isNotNull() & F.col("image_id").isNotNull()
    about = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~fits).alias("odd"), F.min(F.size("descriptor")).alias("least"), F.max(F.size("descriptor")).alias("most")).first()
    a = about(queries)
    b = a if targets is queries else about(targets)
    if o.metric != "l2" or len({x[k] for x in (a, b) for k in ("least", "most") if x["n"]}) > 1 or (a["least"] or 0) < 1:
        return _pairs(queries, targets, o)
    at = stored(targets.where(fits), "targets")
    near = _candidates(queries.where(fits), a["n"], at, o).where(_scoped(o.scope))
    near = near.select("q", "qi", "t", "ti", V.euclidean(F.col("qv"), F.col("tv")).alias("d"))
    for q, t, some in ((queries.where(~fits), targets, a["odd"]), (queries.where(fits), targets.where(~fits), b["odd"])):
        if some:
            near = near.union(_pairs(q, t, o).select(near.columns))
    out = written(ranked(near, o.k), "neighbours")
    discard(spark, at.uri)
    return out


def knn_join(queries: DataFrame, targets: DataFrame | None = None, options: KnnOptions = KnnOptions()) -> DataFrame:
    """KNN rows: each query's k nearest targets within the scope, nearest first."""
    o, own = options, targets is None
    queries = _narrow(queries)
    targets = queries if own else _narrow(targets)
    if o.strategy == "sql":
        return _sql(queries, targets, o)
    if o.strategy == "forest":
        from vecmosaic.operators.forest import ForestOptions, forest_knn

        return forest_knn(queries, targets, o, ForestOptions(precision=o.precision))
    size = targets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("descriptor")).alias("cells")).first()
    small = 8 * (size["cells"] or 0) <= o.broadcast_bytes
    if o.strategy == "block" and not small:
        raise ValueError("the targets are over broadcast_bytes; use grid")
    if o.strategy == "block" or (o.strategy == "auto" and small):
        n = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        near = _block(queries.repartition(n, "feature_id") if size["n"] > 512 else queries, targets, o)
        return written(near, "neighbours") if size["n"] > 10_000 else near  # many, so that no plan searches them twice
    return _grid(queries, targets, size["n"] if own else queries.count(), o)


def _within(q: np.ndarray, t: np.ndarray, radius: float) -> np.ndarray:
    """How many rows of t lie within the radius of each row of q; rounding is settled exactly."""
    out, t2 = np.zeros(len(q), dtype=np.int64), (t * t).sum(axis=1)
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        q2 = (part * part).sum(axis=1)
        d2 = q2[:, None] + t2[None, :] - 2 * part @ t.T
        slack = 1e-9 * (1 + q2[:, None] + t2.max(initial=0))
        sure, border = d2 <= radius * radius - slack, np.abs(d2 - radius * radius) < slack
        n = sure.sum(axis=1)
        for i, j in zip(*np.nonzero(border), strict=True):
            n[i] += np.sqrt(((part[i] - t[j]) ** 2).sum()) <= radius
        out[a : a + 256] = n
    return out


def radius_counts(features: DataFrame, radius: float, options: KnnOptions = KnnOptions()) -> DataFrame:
    """(feature_id, group_size): features within the radius of each, itself included.

    The same two strategies as the neighbour join: targets in every worker while their measured
    size allows it, else read from the shared folder past each task's features.
    """
    f = _narrow(features)
    size = f.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("descriptor")).alias("cells")).first()
    counted = lambda i, n: pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int64())], names=["feature_id", "n"])
    if 8 * (size["cells"] or 0) <= options.broadcast_bytes:
        held = f.sparkSession.sparkContext.broadcast(_arrays(f.toArrow()))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    i, _, q = _arrays(batch)
                    yield counted(i, _within(q, held.value[2], radius))

        n = max(1, int(f.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return f.repartition(n, "feature_id").mapInArrow(near, "feature_id long, n long").withColumnRenamed("n", "group_size")
    targets = stored(f, "targets")

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        i, _, q = _arrays(table)
        yield counted(i, sum((_within(q, _arrays(batch)[2], radius) for batch in targets.batches(options.block)), np.zeros(len(q), dtype=np.int64)))

    return pass_over(f, size["n"], "feature_id", run, "feature_id long, n long", 8 * options.block).withColumnRenamed("n", "group_size")
