"""Nearest neighbours by largest inner product with a hierarchical k-means tree.

The tree is fitted on the driver to a bounded sample; every row is then put into its leaf.  A
query visits leaves best bin first: a priority queue holds the nodes by the inner product with
their centroids, and a node's children are scored when it is taken from the queue.  The number of leaves to visit is
widened until a calibration set of queries, searched exactly against all rows, reaches the asked recall.  Each query also
stops on its own: no row of a leaf has a larger product than its centroid's plus the leaf's radius times the query's
length, so a leaf where this is below the query's k-th product in the sample is left out.

Leaves next to each other in the tree share a shelf; a query goes to a shelf once, with the list of its leaves there, and
is multiplied with the rows of those leaves alone.  Shelves and their queries meet in blocks of bounded size, so a leaf or
a vector with very many rows is spread over tasks.  Each result row says with which share of all rows its
query was multiplied; vectors without structure leave little to prune.

Scores are inner products of the original vectors in double precision, summed in one fixed order,
so equal vectors have equal scores; ties go to the smaller id.

Defined results: a vector that is null, all zero, or has a null or non-finite component takes no
part, nor does one whose dimension isn't the most common one, nor a row without an id; rows that
repeat an id are that id once; with fewer candidates than asked all are returned; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.operators.grouped import groups, runs
from vecmosaic.session import written

RESULT = "query_id long, rank int, vec_id long, score double, scored_share double"


@dataclass(frozen=True)
class AnnOptions:
    k: int = 20
    branching: int = 16
    sample_rows: int = 20_000  # bound on the rows the tree is fitted to
    max_leaves: int = 16_384
    rounds: int = 12
    calibration_queries: int = 128
    recall: float = 0.97  # asked of the calibration queries
    block: int = 4096  # rows, and queries, of a leaf handled together
    seed: int = 7


@dataclass
class KMeansTree:
    """Nodes in order of creation: centroid, children (none for a leaf) and leaf number."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf_of: list[int]
    leaves: int = field(init=False)

    def __post_init__(self) -> None:
        self.leaves = max(self.leaf_of) + 1

    @staticmethod
    def fit(x: np.ndarray, leaves: int, options: AnnOptions) -> KMeansTree:
        rng = np.random.default_rng(options.seed)
        x = np.unique(x, axis=0)
        centroids, children, leaf_of = [x.mean(axis=0)], [[]], [-1]
        open_ = [(-len(x), 0, np.arange(len(x)))]  # the largest node is split next
        n_leaves = 1
        while open_ and n_leaves < leaves:
            size, node, rows = heapq.heappop(open_)
            b = min(options.branching, -size, leaves - n_leaves + 1)
            if b < 2:
                continue
            label, means = _kmeans(x[rows], b, options.rounds, rng)
            if len(means) < 2:
                continue
            for j, mean in enumerate(means):
                child = len(centroids)
                centroids.append(mean)
                children.append([])
                leaf_of.append(-1)
                children[node].append(child)
                part = rows[label == j]
                heapq.heappush(open_, (-len(part), child, part))
            n_leaves += len(means) - 1
        stack, number = [0], 0
        while stack:  # leaves are numbered down the tree, so that near ones have near numbers
            node = stack.pop()
            stack += children[node][::-1]
            if not children[node]:
                leaf_of[node], number = number, number + 1
        return KMeansTree(np.array(centroids), children, leaf_of)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree to the nearest centroid."""
        out, work = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centroids[kids]
            near = ((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            work += [(kid, rows[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray, n: int, counts: np.ndarray | None = None, rows: int = 0, radius: np.ndarray | None = None, least: np.ndarray | None = None) -> Iterator[list[int]]:
        """The first ``n`` leaves of each query row, best bin first; more while they hold fewer than ``rows``.

        With ``radius`` of the leaves and the ``least`` product that matters to each query, leaves that can't reach it are left out.
        """
        for i, row in enumerate(q):
            length = float(np.sqrt(row @ row))
            queue, order, seen, held = [(-float(row @ self.centroids[0]), 0)], [], 0, 0
            while queue and (seen < n or held < rows):
                near, node = heapq.heappop(queue)
                if kids := self.children[node]:
                    for kid, product in zip(kids, (self.centroids[kids] @ row).tolist(), strict=True):
                        heapq.heappush(queue, (-product, kid))
                    continue
                leaf = self.leaf_of[node]
                seen += 1
                if counts is not None:
                    held += int(counts[leaf])
                if least is None or -near + radius[leaf] * length >= least[i]:
                    order.append(leaf)
            yield order


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    means = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        label = ((means * means).sum(axis=1) - 2 * x @ means.T).argmin(axis=1)
        used, label = np.unique(label, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, label, x)
        means = sums / np.bincount(label)[:, None]
    return ((means * means).sum(axis=1) - 2 * x @ means.T).argmin(axis=1), means


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _raw(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """(vec_id, v array<double>) of the rows that take part, their dimension and number."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~odd & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows, 0, 0
    return rows.where(F.size("v") == common["dim"]), common["dim"], common["count"]


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, leaf: np.ndarray | None = None, visited: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k nearest rows but itself, exact within the rows or within its visited leaves.

    A query is multiplied with the rows of its leaves only.  Equal vectors, which are in one leaf, are scored once;
    of their rows only the k + 1 smallest ids can be among the nearest.  The matrix product only picks
    candidates, with a slack beyond its rounding.
    """
    leaf = np.zeros(len(ids), dtype=np.int32) if leaf is None else leaf
    order = np.lexsort((ids, leaf))
    ids, leaf, x = ids[order], leaf[order], np.ascontiguousarray(x[order])
    cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(ids)]
    if visited is None:
        asks = {int(leaf[0]): np.arange(len(q))} if len(ids) else {}
    else:
        place = np.repeat(np.arange(len(q)), [len(v) for v in visited])
        names = np.concatenate(visited) if visited else np.zeros(0, dtype=np.int32)
        by = np.argsort(names, kind="stable")
        ends = np.flatnonzero(np.diff(names[by], append=-1)) + 1
        asks = {int(names[by[a]]): place[by[a:b]] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)} if len(by) else {}
    length, found = np.sqrt((q * q).sum(axis=1)), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        who = asks.get(int(leaf[a])) if a < b else None
        if who is not None:
            found += _leaf_best(who, q, length, ids[a:b], x[a:b], k)
    row, got, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, dtype=kind) for c, kind in enumerate((np.int64, np.int64, np.float64)))
    other = got != q_ids[row]
    row, got, score = row[other], got[other], score[other]
    order = np.lexsort((got, -score, row))
    row, got, score = row[order], got[order], score[order]
    starts = np.searchsorted(row, np.arange(len(q) + 1))
    for i, j in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        j = min(j, i + k)
        yield got[i:j], score[i:j]


def _leaf_best(who: np.ndarray, q: np.ndarray, length: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) of the candidates of one leaf for the queries that visit it; ids are ascending."""
    _, group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group))
    starts = np.concatenate([[0], ends[:-1]])
    rows = x[by[starts]]
    slack = 1e-12 * x.shape[1] * np.sqrt((rows * rows).sum(axis=1)).max()
    top, out = min(k + 1, len(rows)), []
    for a in range(0, len(who), 256):
        ask = who[a : a + 256]
        s = q[ask] @ rows.T
        least = np.partition(s, len(rows) - top, axis=1)[:, len(rows) - top]
        i, c = np.nonzero(s >= (least - slack * length[ask])[:, None])
        score = (rows[c] * q[ask[i]]).sum(axis=1)
        take = np.minimum(ends[c] - starts[c], k + 1)
        at = np.repeat(starts[c] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())
        out.append((np.repeat(ask[i], take), ids[by[at]], np.repeat(score, take)))
    return out


def _nearest(placed: DataFrame, dim: int, k: int, parallel: int) -> DataFrame:
    """The k nearest of each query from rows (gid, is_query, id, v, leaf, leaves, share) whose groups hold both."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "gid"):
            is_query, ids, leaf, share = (table.column(c).to_numpy() for c in ("is_query", "id", "leaf", "share"))
            x, leaves = _raw(table.column("v"), dim), table.column("leaves")
            out: tuple[list, list, list, list] = ([], [], [], [])
            for a, b in groups(table, "gid"):
                ask = np.flatnonzero(is_query[a:b]) + a
                have = np.flatnonzero(~is_query[a:b]) + a
                if not len(ask) or not len(have):
                    continue
                visited = [np.frombuffer(leaves[i].as_py(), "<i4") for i in ask.tolist()]
                for qid, part, (got, score) in zip(ids[ask].tolist(), share[ask].tolist(), best(ids[ask], x[ask], ids[have], x[have], k, leaf[have], visited), strict=True):
                    out[0].append(qid)
                    out[1].append(got.astype("<i8").tobytes())
                    out[2].append(score.astype("<f8").tobytes())
                    out[3].append(part)
            if out[0]:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "ids", "scores", "share"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "query_id"):
            qid, ids, scores, share = table.column("query_id").to_numpy(), table.column("ids").to_pylist(), table.column("scores").to_pylist(), table.column("share").to_numpy()
            rows: list[tuple] = []
            for a, b in groups(table, "query_id"):
                got, sc = np.frombuffer(b"".join(ids[a:b]), "<i8"), np.frombuffer(b"".join(scores[a:b]), "<f8")
                order = np.lexsort((got, -sc))
                got, sc = got[order], sc[order]
                first = np.sort(np.unique(got, return_index=True)[1])[:k]
                rows += [(int(qid[a]), r + 1, int(got[i]), float(sc[i]), float(share[a])) for r, i in enumerate(first)]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query_id", "rank", "vec_id", "score", "scored_share"])

    found = placed.repartition(parallel, "gid").sortWithinPartitions("gid").mapInArrow(search, "query_id long, ids binary, scores binary, share double")
    return found.repartition(parallel, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, RESULT)


@dataclass
class AnnIndex:
    """The fitted tree, the rows by leaf, and the visits that reach the asked recall."""

    rows: DataFrame  # leaf, id, v binary
    tree: KMeansTree
    dim: int
    counts: np.ndarray  # rows of each leaf
    radius: np.ndarray  # largest distance of a leaf's rows from its centroid
    sample: np.ndarray
    visits: int
    calibrated: float
    options: AnnOptions

    def shelves(self) -> np.ndarray:
        """The shelf of each leaf: leaves in order, as many as hold ``block`` rows together."""
        out, held, shelf = np.zeros(self.tree.leaves, dtype=np.int32), 0, 0
        for leaf in range(self.tree.leaves):
            c = int(self.counts[leaf])
            if held and held + c > self.options.block:
                shelf, held = shelf + 1, 0
            out[leaf], held = shelf, held + c
        return out

    def search(self, queries: DataFrame) -> DataFrame:
        """RESULT rows for queries (vec_id, v array<double>)."""
        spark, o, tree, n, dim, counts, radius = queries.sparkSession, self.options, self.tree, self.visits, self.dim, self.counts, self.radius
        sample = spark.sparkContext.broadcast(self.sample)  # at most sample_rows rows
        parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shelf_of, rows_of = self.shelves(), int(counts.sum())

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    q, ids = _matrix(part.column("v"), dim), part.column("vec_id").to_pylist()
                    out: list[tuple] = []
                    least = kth_product(q, sample.value, o.k + 1)
                    for qid, row, order in zip(ids, q, tree.visits(q, n, counts, o.k + 1, radius, least), strict=True):
                        if not order:
                            continue
                        raw, leaves = row.astype("<f8").tobytes(), np.sort(np.array(order, dtype="<i4"))
                        share = float(counts[leaves].sum()) / rows_of
                        shelf = shelf_of[leaves]
                        cuts = np.flatnonzero(np.diff(shelf)) + 1
                        out += [(int(s[0]), qid, raw, x.tobytes(), share) for s, x in zip(np.split(shelf, cuts), np.split(leaves, cuts), strict=True)]
                    if out:
                        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shelf", "id", "v", "leaves", "share"])

        asked = written(queries.select("vec_id", "v").mapInArrow(visit, "shelf int, id long, v binary, leaves binary, share double"), "visits")
        per_shelf = {r["shelf"]: r["count"] for r in asked.groupBy("shelf").count().collect()}  # a row per shelf, of which there are at most max_leaves
        held = np.bincount(shelf_of, weights=counts).astype(int).tolist()
        sizes = spark.createDataFrame(
            [(shelf, max(1, -(-c // o.block)), -(-per_shelf.get(shelf, 1) // o.block)) for shelf, c in enumerate(held)], "shelf int, row_blocks int, query_blocks int"
        )
        shelf_table = spark.createDataFrame([(leaf, int(x)) for leaf, x in enumerate(shelf_of.tolist())], "leaf int, shelf int")

        def dealt(df: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
            mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
            theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs")
            one = df.join(F.broadcast(sizes), "shelf").select("shelf", "id", "v", "leaf", "leaves", "share", mine.alias("mine"), theirs)
            pair = ("theirs", "mine") if is_query else ("mine", "theirs")
            return one.select(F.xxhash64("shelf", *pair).alias("gid"), F.lit(is_query).alias("is_query"), "id", "v", "leaf", "leaves", "share")

        rows = self.rows.join(F.broadcast(shelf_table), "leaf").withColumn("leaves", F.lit(None).cast("binary")).withColumn("share", F.lit(0.0))
        placed = dealt(rows, "row_blocks", "query_blocks", False).unionByName(dealt(asked.withColumn("leaf", F.lit(-1)), "query_blocks", "row_blocks", True))
        return _nearest(placed, dim, o.k, parallel)


def kth_product(q: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th largest product with some of the rows, less the rounding: no larger than that with all rows."""
    if len(rows) < k:
        return np.full(len(q), -np.inf)
    least = np.partition(q @ rows.T, len(rows) - k, axis=1)[:, len(rows) - k]
    return least - 1e-9 * (1 + np.abs(least))


def build_index(vectors: DataFrame, dim: int, count: int, queries: DataFrame, options: AnnOptions = AnnOptions()) -> AnnIndex:
    """Fit the tree to a bounded sample, place every row, and calibrate on some of the queries."""
    spark = vectors.sparkSession
    part = F.pmod(F.xxhash64("vec_id", F.lit(options.seed)), F.lit(1 << 30))
    share = min(1.0, 0.95 * options.sample_rows / count)
    sample = vectors.where(part < int(share * (1 << 30)) + 1).limit(options.sample_rows).toPandas()
    if not len(sample):
        sample = vectors.limit(1).toPandas()
    x = np.array([np.asarray(v, dtype=np.float64) for v in sample["v"]])
    once = x[np.unique(sample["vec_id"].to_numpy(), return_index=True)[1]]  # an id counts once
    tree = KMeansTree.fit(x, max(1, min(options.max_leaves, len(x) // 4, round(count**0.5))), options)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                piece = batch.slice(a, 4096)
                m = _matrix(piece.column("v"), dim)
                leaf = tree.assign(m)
                away = np.sqrt(((m - centres[leaf]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), piece.column("vec_id"), pa.array([r.astype("<f8").tobytes() for r in m], pa.binary()), pa.array(away)], names=["leaf", "id", "v", "away"])

    centres = np.zeros((tree.leaves, dim))
    for centroid, leaf in zip(tree.centroids, tree.leaf_of, strict=True):
        if leaf >= 0:
            centres[leaf] = centroid
    rows = written(vectors.mapInArrow(place, "leaf int, id long, v binary, away double"), "leaves")
    counts, radius = np.zeros(tree.leaves, dtype=np.int64), np.zeros(tree.leaves)
    for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():  # a row per leaf
        counts[r["leaf"]], radius[r["leaf"]] = r["n"], r["r"] * (1 + 1e-9)
    rows = rows.drop("away")

    few = queries.orderBy(F.xxhash64("vec_id", F.lit(options.seed)), "vec_id").limit(options.calibration_queries).toPandas()
    q_ids = few["vec_id"].to_numpy()
    q = np.array([np.asarray(v, dtype=np.float64) for v in few["v"]]).reshape(-1, dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, leaf = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
                at = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
                for qid, (got, score) in zip(q_ids.tolist(), best(q_ids, q, ids, _raw(batch.column("v"), dim), options.k), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([qid] * len(got), pa.int64()), pa.array(got), pa.array(score), pa.array([at[i] for i in got.tolist()], pa.int32())], names=["query_id", "id", "score", "leaf"])

    true = rows.mapInArrow(scan, "query_id long, id long, score double, leaf int")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    true = true.withColumn("r", ranked).where(F.col("r") <= options.k).select("query_id", "leaf").toPandas()
    # the place of each true neighbour's leaf in its query's order of visits
    place_of = {i: {leaf: p for p, leaf in enumerate(order)} for i, order in zip(q_ids.tolist(), tree.visits(q, tree.leaves), strict=True)}
    places = np.array([place_of[i][leaf] for i, leaf in zip(true["query_id"], true["leaf"], strict=True)])
    visits, reached = 1, 1.0
    while len(places) and (reached := float((places < visits).mean())) < options.recall and visits < tree.leaves:
        visits += 1 + visits // 8
    return AnnIndex(rows, tree, dim, counts, radius, once, min(visits, tree.leaves), reached, options)


def nearest_neighbours(df: DataFrame, query: Column | None = None, options: AnnOptions = AnnOptions(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """RESULT rows: each query's nearest rows but itself.  ``query`` is a condition on vec_id; none takes every row."""
    vectors, dim, count = usable(df, vec_id, vector)
    if not count:
        return df.sparkSession.createDataFrame([], RESULT)
    queries = vectors if query is None else vectors.where(query)
    return build_index(vectors, dim, count, queries, options).search(queries)
