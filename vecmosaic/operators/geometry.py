"""Plane geometry of matches: homographies, epipolar lines, verification and precision curves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmosaic.operators.passes import pass_over, stored

Matrix = Sequence[float]  # nine numbers, row by row


def inverse(h: Matrix) -> list[float]:
    """The inverse, scaled so that its last entry is one."""
    m = np.linalg.inv(np.array(h, dtype=float).reshape(3, 3))
    return (m / m[2, 2]).ravel().tolist()


def apply(h: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def transfer_error(h: Matrix, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The distances of both points to the other's image, added; the inverse is taken once, on the driver."""
    hx, hy = apply(h, x1, y1)
    bx, by = apply(inverse(h), x2, y2)
    return F.sqrt((hx - x2) * (hx - x2) + (hy - y2) * (hy - y2)) + F.sqrt((bx - x1) * (bx - x1) + (by - y1) * (by - y1))


def with_errors(matches: DataFrame, h: Matrix) -> DataFrame:
    return matches.withColumn("error", transfer_error(h, *map(F.col, ("x1", "y1", "x2", "y2"))))


def evaluate(matches: DataFrame, h: Matrix, thresholds: Sequence[float]) -> DataFrame:
    """Each match's transfer error under every ratio threshold it passes."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return with_errors(matches, h).select("*", t).where(F.col("ratio") < F.col("threshold"))


def counts_by_threshold(errors: DataFrame, thresholds: Sequence[float], limit: float, by: Sequence[str] = (), strict: bool = False, inclusive_ratio: bool = False) -> DataFrame:
    """(by, threshold, n_correct, n_total) from rows with ``error`` and ``ratio``: one pass for all thresholds."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = errors.select("*", t)
    rows = rows.where(F.col("ratio") <= F.col("threshold")) if inclusive_ratio else rows.where(F.col("ratio") < F.col("threshold"))
    right = F.col("error") < limit if strict else F.col("error") <= limit
    return rows.groupBy(*by, "threshold").agg(F.count_if(right).alias("n_correct"), F.count(F.lit(1)).alias("n_total"))


def correspondences(first: DataFrame, second: DataFrame, h: Matrix, limit: float) -> DataFrame:
    """(a, b, error): all pairs of points (id, x, y) with a transfer error within the limit.

    The first point's image lies within the limit of the second, so they meet in neighbouring cells
    of a grid of that size; no pair farther apart is formed.
    """
    hx, hy = apply(h, F.col("x"), F.col("y"))
    a = first.select(F.col("id").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.floor(hx / limit).alias("cx"), F.floor(hy / limit).alias("cy"))
    around = lambda c: F.explode(F.array(*[F.floor(F.col(c) / limit) + k for k in (-1, 0, 1)]))
    b = second.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), around("x").alias("cx")).withColumn("cy", around("y2"))
    return with_errors(a.join(b, ["cx", "cy"]), h).where(F.col("error") <= limit).select("a", "b", "error")


def lines(points: DataFrame, f: Matrix, *keep: str) -> DataFrame:
    """(id, la, lb, lc): the normalised epipolar line of each point (id, x, y), with the columns to keep."""
    a, b, c = (f[3 * k] * F.col("x") + f[3 * k + 1] * F.col("y") + f[3 * k + 2] for k in range(3))
    n = F.sqrt(a * a + b * b)
    return points.select("id", *keep, F.try_divide(a, n).alias("la"), F.try_divide(b, n).alias("lb"), F.try_divide(c, n).alias("lc"))


def line_distance(x: Column, y: Column, la: Column | str = "la", lb: Column | str = "lb", lc: Column | str = "lc") -> Column:
    la, lb, lc = (F.col(c) if isinstance(c, str) else c for c in (la, lb, lc))
    return F.abs(la * x + lb * y + lc)


def band_join(lines_: DataFrame, points: DataFrame, limit: float, size: float = 1000.0, cell: float = 50.0, by: str | None = None) -> DataFrame:
    """(line, point, dist): points (id, x, y) nearer than ``limit`` to lines (id, la, lb, lc).

    With ``by`` both sides have that column, a line meets the points of its own value only, and the result has it, too.  A line is laid out as the cells that its band crosses, column by column where it is flat and
    row by row where it is steep, and meets points by cell.  Points outside the ``size`` frame are
    brought to its border cells.
    """
    n, of = int(size // cell), [by] if by else []
    flat = F.abs("lb") >= F.abs("la")
    across = lambda s: F.when(flat, -(F.col("la") * s + F.col("lc")) / F.col("lb")).otherwise(-(F.col("lb") * s + F.col("lc")) / F.col("la"))
    slack = limit * 1.5 + 1e-6
    at = lines_.select(F.col("id").alias("line"), *of, "la", "lb", "lc", flat.alias("flat"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    lo, hi = F.least(across(F.col("k") * cell), across((F.col("k") + 1) * cell)) - slack, F.greatest(across(F.col("k") * cell), across((F.col("k") + 1) * cell)) + slack
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")
    first = clip(F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), lo)) / cell))
    last = clip(F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), hi)) / cell))
    at = at.withColumn("m", F.explode(F.sequence(first, last)))
    at = at.select("line", *of, "la", "lb", "lc", F.when(F.col("flat"), F.col("k")).otherwise(F.col("m")).alias("cx"), F.when(F.col("flat"), F.col("m")).otherwise(F.col("k")).alias("cy"))
    inside = points.select(F.col("id").alias("point"), *of, "x", "y", clip(F.floor(F.col("x") / cell)).alias("cx"), clip(F.floor(F.col("y") / cell)).alias("cy"))
    return at.join(inside, ["cx", "cy", *of]).withColumn("dist", line_distance(F.col("x"), F.col("y"))).where(F.col("dist") < limit).select("line", *of, "point", "dist")


def _numbers(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in names]


def _distances(line: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of each line (a row) to each point (a column)."""
    la, lb, lc = (c[:, None] for c in line)
    out = la * x
    out += lb * y
    out += lc
    return np.abs(out, out=out)


def two_hop(matches: DataFrame, b_points: DataFrame, f_ac: Matrix, f_ab: Matrix, f_bc: Matrix, limit: float, by: str | None = None) -> DataFrame:
    """(a, c, error) for matches (a, ax, ay, c, cx, cy): the AC line distance, and where that is below
    the limit and view B has candidates, the larger of it and the least BC line distance.

    With ``by``, a column of both tables, each match is verified by the points of its own view B.  The points are read
    past the matches of a task, whose least distances are kept: no pair of a line and a point becomes a row.
    """
    of = [by] if by else []
    own = matches.select(F.col("a").alias("id"), "c", *of, F.col("ax").alias("x"), F.col("ay").alias("y"), "cx", "cy")
    direct = lines(own, f_ac, "c", *of, "x", "y", "cx", "cy").withColumn("d_ac", line_distance(F.col("cx"), F.col("cy"))).drop("la", "lb", "lc")
    asked = lines(direct, f_ab, "c", *of, "cx", "cy", "d_ac").withColumnRenamed("id", "a")
    points = stored(lines(b_points, f_bc, *of, "x", "y").select(*of, "x", "y", "la", "lb", "lc"), "view-points")

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ab, (cx, cy, d_ac) = _numbers(table, "la", "lb", "lc"), _numbers(table, "cx", "cy", "d_ac")
        view = table.column(by).to_numpy() if by else np.zeros(len(d_ac), dtype=np.int8)
        least, close = np.full(len(d_ac), np.inf), d_ac < limit
        mine = {v: np.flatnonzero(close & (view == v)) for v in np.unique(view[close]).tolist()}
        for batch in points.batches(8192) if mine else ():
            x, y, *bc = _numbers(batch, "x", "y", "la", "lb", "lc")
            none = np.isnan(bc[2])  # a point without a line reaches nothing
            bc = [np.where(none, far, c) for c, far in zip(bc, (0.0, 0.0, np.inf), strict=True)]
            where = batch.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(len(x), dtype=np.int8)
            for v in np.unique(where).tolist():
                at = np.flatnonzero(where == v)
                for i in range(0, len(mine.get(v, ())), 1024):
                    rows = mine[v][i : i + 1024]
                    near = _distances([c[rows] for c in ab], x[at], y[at]) < limit
                    d = _distances([c[at] for c in bc], cx[rows], cy[rows]).T
                    least[rows] = np.minimum(least[rows], np.where(near, d, np.inf).min(axis=1))
        error = pa.array(np.where(np.isfinite(least), np.maximum(d_ac, least), d_ac), from_pandas=True)
        yield from pa.table([*(table.column(c) for c in ("a", "c", *of)), error], names=["a", "c", *of, "error"]).to_batches()

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in ("a", "c", *of))
    return pass_over(asked, None, "a", run, f"{kinds}, error double")


def three_view(a_points: DataFrame, b_points: DataFrame, c_points: DataFrame, f_ac: Matrix, f_ab: Matrix, f_bc: Matrix, limit: float, once: bool = False) -> DataFrame:
    """(a, c): points of view C compatible with a point of A through some point of B; with ``once`` one of them for each a.

    Both other views are read past the points of A, and whether some point of B leads from one to the other is a product
    of zeros and ones; only the pairs of the result become rows.
    """
    asked = lines(lines(a_points, f_ac, "x", "y").select("id", "x", "y", *(F.col(c).alias(f"c_{c}") for c in ("la", "lb", "lc"))), f_ab, "c_la", "c_lb", "c_lc")
    b = stored(lines(b_points, f_bc, "x", "y").select("x", "y", "la", "lb", "lc"), "view-b")
    c = stored(c_points.select("id", "x", "y"), "view-c")

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("id").combine_chunks()
        ac, ab = _numbers(table, "c_la", "c_lb", "c_lc"), _numbers(table, "la", "lb", "lc")
        found = np.zeros(len(ids), dtype=bool)
        for points in c.batches(4096):
            cx, cy = _numbers(points, "x", "y")
            todo = _distances(ac, cx, cy) < limit
            todo[found & once] = False
            yes = np.zeros_like(todo)
            for via in b.batches(1024):
                i, j = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
                if not len(i):
                    break
                x, y, *bc = _numbers(via, "x", "y", "la", "lb", "lc")
                there = (_distances([k[i] for k in ab], x, y) < limit).astype(np.float32)
                met = there @ (_distances(bc, cx[j], cy[j]) < limit).astype(np.float32) > 0.5
                met &= todo[np.ix_(i, j)]
                yes[np.ix_(i, j)] |= met
                todo[np.ix_(i, j)] &= ~met
                if once:
                    todo[i[met.any(axis=1)]] = False
            a, k = np.nonzero(yes)
            if once:
                a, first = np.unique(a, return_index=True)
                k, found[a] = k[first], True
            for n in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[n : n + 100_000])), points.column("id").take(pa.array(k[n : n + 100_000]))], names=["a", "c"])
            if found.all():
                return

    kinds = f"a {asked.schema['id'].dataType.simpleString()}, c {c_points.schema['id'].dataType.simpleString()}"
    return pass_over(asked, None, "id", run, kinds, 1024)


def crop_homography(h: Matrix, left1: float, top1: float, left2: float, top2: float, scale: float) -> list[float]:
    """The homography between two crops, scaled, of images related by ``h``."""
    shift = lambda x, y: np.array([[1, 0, x], [0, 1, y], [0, 0, 1]], dtype=float)
    s = np.diag([scale, scale, 1.0])
    m = s @ shift(-left2, -top2) @ np.array(h, dtype=float).reshape(3, 3) @ shift(left1, top1) @ np.linalg.inv(s)
    return (m / m[2, 2]).ravel().tolist()


def _null(rows: np.ndarray) -> np.ndarray:
    """The vector that the rows come nearest to mapping to zero; no matrix is square in the rows."""
    return np.linalg.svd(rows, full_matrices=len(rows) < rows.shape[1])[2][-1]


def fit_homography(p: np.ndarray, q: np.ndarray, rounds: int = 500, limit: float = 3.0, seed: int = 7) -> tuple[np.ndarray | None, np.ndarray]:
    """A homography from p to q by sample consensus, refitted to its inliers, and the inlier mask."""
    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        z, o = np.zeros(len(a)), np.ones(len(a))
        x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
        rows = np.concatenate([np.stack([x, y, o, z, z, z, -u * x, -u * y, -u], 1), np.stack([z, z, z, x, y, o, -v * x, -v * y, -v], 1)])
        h = _null(rows).reshape(3, 3)
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None

    def errors(h: np.ndarray) -> np.ndarray:
        w = np.c_[p, np.ones(len(p))] @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.hypot(*(w[:, :2] / w[:, 2:] - q).T), nan=np.inf)

    if len(p) < 4:
        return None, np.zeros(len(p), dtype=bool)
    rng, best = np.random.default_rng(seed), np.zeros(len(p), dtype=bool)
    for _ in range(rounds):
        pick = rng.choice(len(p), 4, replace=False)
        h = solve(p[pick], q[pick])
        if h is not None and (inside := errors(h) < limit).sum() > best.sum():
            best = inside
    return (solve(p[best], q[best]), best) if best.sum() >= 4 else (None, best)


def fit_fundamental(p: np.ndarray, q: np.ndarray, rounds: int = 500, limit: float = 1.0, seed: int = 7) -> np.ndarray | None:
    """A fundamental matrix with q' F p = 0 by normalised eight-point samples and consensus."""
    def normal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = a.mean(axis=0)
        s = np.sqrt(2) / max(np.hypot(*(a - c).T).mean(), 1e-12)
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return np.c_[a, np.ones(len(a))] @ t.T, t

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (x, ta), (u, tb) = normal(a), normal(b)
        f = _null(np.einsum("ni,nj->nij", u, x).reshape(len(a), 9)).reshape(3, 3)
        w, s, v = np.linalg.svd(f)
        return tb.T @ (w @ np.diag([s[0], s[1], 0]) @ v) @ ta

    if len(p) < 8:
        return None
    x, u = np.c_[p, np.ones(len(p))], np.c_[q, np.ones(len(q))]
    rng, best = np.random.default_rng(seed), np.zeros(len(p), dtype=bool)
    for _ in range(rounds):
        f = solve(*(z[pick] for pick in [rng.choice(len(p), 8, replace=False)] for z in (p, q)))
        l = x @ f.T
        d = np.abs((l * u).sum(axis=1)) / np.maximum(np.hypot(l[:, 0], l[:, 1]), 1e-12)
        if (d < limit).sum() > best.sum():
            best = d < limit
    if best.sum() < 8:
        return None
    f = solve(p[best], q[best])
    return f / np.abs(f).max()


def homographies(matches: DataFrame, by: Sequence[str] = ("im_i", "im_j"), least: int = 4, rounds: int = 500, limit: float = 3.0) -> DataFrame:
    """One homography per image pair from matches with x1, y1, x2, y2."""
    import pandas as pd

    kinds = ", ".join(f"{c} {matches.schema[c].dataType.simpleString()}" for c in by)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x1", "y1", "x2", "y2"], kind="stable")
        h, inside = fit_homography(rows[["x1", "y1"]].to_numpy(), rows[["x2", "y2"]].to_numpy(), rounds, limit)
        return pd.DataFrame([[*key, None if h is None else h.ravel().tolist(), int(inside.sum())]], columns=[*by, "h", "n_inliers"])

    some = matches.select(*by, "x1", "y1", "x2", "y2")
    return some.groupBy(*by).applyInPandas(fit, f"{kinds}, h array<double>, n_inliers long").where(F.col("h").isNotNull() & (F.col("n_inliers") >= least))


def fundamentals(points: DataFrame, by: Sequence[str], scale: float = 1.0, rounds: int = 300, limit: float = 1.0) -> DataFrame:
    """One fundamental matrix per group from pooled corners (x1, y1, x2, y2), coordinates over the scale."""
    import pandas as pd

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x1", "y1", "x2", "y2"], kind="stable")
        f = fit_fundamental(rows[["x1", "y1"]].to_numpy() / scale, rows[["x2", "y2"]].to_numpy() / scale, rounds, limit)
        return pd.DataFrame([[*key, None if f is None else f.ravel().tolist()]], columns=[*by, "f"])

    return points.select(*by, "x1", "y1", "x2", "y2").groupBy(*by).applyInPandas(fit, f"{kinds}, f array<double>").where(F.col("f").isNotNull())
