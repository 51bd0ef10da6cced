"""Subspace features, classifiers and cross-validation over vectors (id, label, grp, vec)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.functions import vectors as V
from vecmosaic.session import written


@dataclass(frozen=True)
class Subspace:
    """A linear projection: rows of ``basis`` after taking off ``mean``."""

    mean: tuple[float, ...]
    basis: tuple[tuple[float, ...], ...]
    values: tuple[float, ...]

    def project(self, vec: Column) -> Column:
        m = F.array(*map(F.lit, self.mean))
        centred = F.zip_with(vec, m, lambda a, b: a - b)
        return F.array(*[V.dot(centred, F.array(*map(F.lit, b))) for b in self.basis])

    def reconstruct(self, coords: Column) -> Column:
        cols = np.array(self.basis).T
        out = [V.dot(coords, F.array(*map(F.lit, row.tolist()))) for row in cols]
        return F.zip_with(F.array(*out), F.array(*map(F.lit, self.mean)), lambda a, b: a + b)


def _moments(df: DataFrame, by: list[str] | None = None) -> pd.DataFrame:
    """Counts, sums and products of components: one row per class, whatever the number of vectors."""
    by = by or []
    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)

    def part(frames):
        acc: dict[tuple, list] = {}
        for frame in frames:
            for key, rows in frame.groupby(by) if by else [((), frame)]:
                x = np.stack(rows["vec"].to_numpy()) if len(rows) else np.zeros((0, 1))
                if len(x):
                    a = acc.setdefault(key if isinstance(key, tuple) else (key,), [0, 0.0, 0.0])
                    a[0], a[1], a[2] = a[0] + len(x), a[1] + x.sum(axis=0), a[2] + x.T @ x
        yield pd.DataFrame([(*k, n, s.tolist(), p.ravel().tolist()) for k, (n, s, p) in acc.items()], columns=[*by, "n", "s", "p"])

    shape = f"{kinds}n long, s array<double>, p array<double>"
    parts = df.select(*by, "vec").mapInPandas(part, shape)

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        total = [(*rows.iloc[0][by], int(rows["n"].sum()), np.sum(np.stack(rows["s"]), axis=0).tolist(), np.sum(np.stack(rows["p"]), axis=0).tolist())]
        return pd.DataFrame(total, columns=[*by, "n", "s", "p"])

    # a task's sums are dealt over a few groups before those of a class meet, so no task gets all of them
    dealt = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    met = dealt.groupBy(*by, "part").applyInPandas(lambda rows: together(rows), shape).groupBy(*(by or [F.lit(0).alias("all")])).applyInPandas(together, shape).toPandas()
    return met.assign(s=met["s"].map(np.asarray), p=met["p"].map(np.asarray)).sort_values(by or "n", ignore_index=True)


def _basis(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and vectors, each turned so that its largest entry is positive."""
    w, v = np.linalg.eig(matrix)
    w, v = w.real, v.real
    order = np.argsort(-w, kind="stable")[:k]
    v = v[:, order] / np.linalg.norm(v[:, order], axis=0)
    return w[order], v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def pca(df: DataFrame, components: int | None = None) -> Subspace:
    """Eigenvectors of the covariance (over n); at most one less than the vectors."""
    m = _moments(df).iloc[0]
    d = len(m["s"])
    k = min(d, m["n"] - 1, components or m["n"] - 1)
    mean = m["s"] / m["n"]
    w, v = _basis(m["p"].reshape(d, d) / m["n"] - np.outer(mean, mean), max(k, 1))
    return Subspace(tuple(mean.tolist()), tuple(map(tuple, v.T.tolist())), tuple(w.tolist()))


def _scatter(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    m = _moments(df, ["label"])
    n, d = int(m["n"].sum()), len(m["s"].iloc[0])
    mean = np.sum(np.stack(m["s"]), axis=0) / n
    within, between = np.zeros((d, d)), np.zeros((d, d))
    for c, s, p in zip(m["n"], m["s"], m["p"], strict=True):
        own = s / c
        within += p.reshape(d, d) - c * np.outer(own, own)
        between += c * np.outer(own - mean, own - mean)
    return mean, within, between, n, len(m)


def lda(df: DataFrame, components: int | None = None) -> Subspace:
    """Directions that separate the classes; at most one less than the classes."""
    mean, within, between, _, c = _scatter(df)
    k = min(c - 1, components or c - 1)
    w, v = _basis(np.linalg.pinv(within) @ between, k)
    return Subspace(tuple(mean.tolist()), tuple(map(tuple, v.T.tolist())), tuple(w.tolist()))


def fisherfaces(df: DataFrame, components: int | None = None) -> Subspace:
    """Separation inside the leading principal components; projects without taking off the mean."""
    mean, within, between, n, c = _scatter(df)
    first = pca(df, max(1, n - c))
    p = np.array(first.basis).T
    w, v = _basis(np.linalg.pinv(p.T @ within @ p) @ (p.T @ between @ p), min(c - 1, components or c - 1))
    return Subspace((0.0,) * len(mean), tuple(map(tuple, (p @ v).T.tolist())), tuple(w.tolist()))


_EPS = np.finfo(float).eps


def _ratio_terms(p: np.ndarray, q: np.ndarray, power: int) -> np.ndarray:
    a = np.abs(1 - (p * q).sum(axis=-1, keepdims=True))
    return ((p - q) ** 2 + 2 * a * p * q) / ((p + q) ** power + _EPS)


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=-1, keepdims=True)


def _cosine(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p * q).sum(axis=-1) / (np.sqrt((p * p).sum(axis=-1)) * np.sqrt((q * q).sum(axis=-1)))


#: The distances of ``vectors.DISTANCES`` over the last axis of arrays.
KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda p, q: np.sqrt(((p - q) ** 2).sum(axis=-1)),
    "cosine": lambda p, q: -_cosine(p, q),
    "correlation": lambda p, q: 1 - _cosine(_centred(p), _centred(q)),
    "chi_square": lambda p, q: ((p - q) ** 2 / (p + q + _EPS)).sum(axis=-1),
    "intersection": lambda p, q: np.minimum(p, q).sum(axis=-1),
    "bin_ratio": lambda p, q: np.abs(_ratio_terms(p, q, 2).sum(axis=-1)),
    "l1_bin_ratio": lambda p, q: np.abs((np.abs(p - q) * _ratio_terms(p, q, 2)).sum(axis=-1)),
    "chi_square_bin_ratio": lambda p, q: np.abs(((p - q) ** 2 * _ratio_terms(p, q, 3)).sum(axis=-1)),
}


def nearest_in_blocks(test: DataFrame, train: DataFrame, k: int, metric: str = "euclidean", block: int = 2048) -> DataFrame:
    """(id, tid, d): candidates that hold the k nearest rows of another mark for each test row.

    Both sides have (id, mark, vec).  They are dealt into blocks that meet pairwise; a pair of
    blocks hands on at most k rows for each of its test rows.
    """
    kernel = KERNELS[metric]

    def dealt(df: DataFrame, own: str, other: str, mine: int, theirs: int, side: int) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int").alias(own)
        return df.select("id", F.col("mark").cast("long").alias("mark"), "vec", at, F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))).alias(other), F.lit(side).alias("side"))

    na, nb = (max(1, -(-df.count() // block)) for df in (test, train))
    both = dealt(test, "a", "b", na, nb, 0).unionByName(dealt(train, "b", "a", nb, na, 1))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked, known = (group[group["side"] == s].sort_values("id", kind="stable") for s in (0, 1))
        out: tuple[list, list, list] = ([], [], [])
        if len(asked) and len(known):
            q, x, ids, marks = np.stack(asked["vec"]), np.stack(known["vec"]), known["id"].to_numpy(), known["mark"].to_numpy()
            for i, mark, one in zip(asked["id"].tolist(), asked["mark"].tolist(), q, strict=True):
                other = np.flatnonzero(marks != mark)
                d = kernel(one[None, :], x[other])
                first = np.lexsort((ids[other], d))[:k] if len(d) <= 4 * k else _least(d, ids[other], k)
                out[0].extend([i] * len(first))
                out[1].extend(ids[other][first].tolist())
                out[2].extend(d[first].tolist())
        return pd.DataFrame({"id": np.array(out[0], dtype=np.int64), "tid": np.array(out[1], dtype=np.int64), "d": np.array(out[2], dtype=float)})

    return both.groupBy("a", "b").applyInPandas(run, "id long, tid long, d double")


def _least(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest, ties to the smaller id."""
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    return near[np.lexsort((ids[near], d[near]))[:k]]


def neighbours(test: DataFrame, train: DataFrame, k: int, metric: str = "euclidean", mark: str = "id") -> DataFrame:
    """(id, actual, agrp, tid, label, grp, d, r): the k nearest training rows of each test row; ties to the smaller id.

    A test row never meets training rows whose ``mark`` column equals its own.
    """
    a, b = (df.select("id", F.col(mark).alias("mark"), "vec") for df in (test, train))
    r = F.row_number().over(Window.partitionBy("id").orderBy("d", "tid"))
    near = nearest_in_blocks(a, b, k, metric).withColumn("r", r).where(F.col("r") <= k)
    own = test.select("id", F.col("label").alias("actual"), F.col("grp").alias("agrp"))
    return near.join(own, "id").join(train.select(F.col("id").alias("tid"), "label", "grp"), "tid").select("id", "actual", "agrp", "tid", "label", "grp", "d", "r")


def vote(near: DataFrame, label: str = "label") -> DataFrame:
    """(id, actual, predicted): the majority label, of equal ones the smallest."""
    n = near.groupBy("id", "actual", F.col(label).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "predicted"))
    return n.withColumn("r", r).where("r = 1").select("id", "actual", "predicted")


def classify(test: DataFrame, train: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    return vote(neighbours(test, train, k, metric))


def folds(df: DataFrame, k: int = 10, seed: int = 7) -> DataFrame:
    """Rows with a fold by class: hashed order, equal folds of the smallest class's size over k.

    Rows past the last full fold always train (fold -1); rows beyond the smallest class's size are out.
    """
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}"))), "id")) - 1
    kk = F.least(F.lit(k).cast("long"), n)
    rows = df.select("*", place.alias("place"), n.alias("least"), kk.alias("kk")).where("place < least")
    size = F.floor(F.col("least") / F.col("kk"))
    f = F.floor(F.col("place") / size)
    return rows.select(*df.columns, F.when(f < F.col("kk"), f).otherwise(F.lit(-1)).cast("int").alias("fold"))


def counts(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(by or [])).agg(F.count_if(F.col("actual") == F.col("predicted")).alias("tp"), F.count_if(F.col("actual") != F.col("predicted")).alias("fp"))


def k_fold(df: DataFrame, k: int = 10, neighbours_: int = 1, metric: str = "euclidean", seed: int = 7) -> DataFrame:
    """(fold, tp, fp): all folds in one plan, a row trains for every fold but its own."""
    f = written(folds(df, k, seed), "folds")
    held = f.where("fold >= 0")
    best = vote(neighbours(held, f, neighbours_, metric, "fold"))
    return counts(best.join(held.select("id", "fold"), "id"), ["fold"])


def leave_one_out(df: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    return counts(classify(df, df, k, metric))


def leave_one_class_out(df: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    """Group predictions with the row's own class left out of training."""
    near = neighbours(df, df, k, metric, "label")
    best = vote(near.withColumn("actual", F.col("agrp")), "grp")
    return counts(best)


def accuracy(validation: DataFrame) -> DataFrame:
    """Accuracy over all runs and the deviation of its value between them."""
    a = F.try_divide("tp", F.col("tp") + F.col("fp"))
    return validation.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.try_divide(F.sum("tp"), F.sum("tp") + F.sum("fp")).alias("accuracy"), F.stddev_pop(a).alias("sd"))


def _svm(x: np.ndarray, y: np.ndarray, c: float, gamma: float | None, rounds: int = 60, seed: int = 7) -> Callable[[np.ndarray], np.ndarray]:
    """A two-class margin classifier by sequential minimal optimisation; no gamma means linear."""
    kernel = (lambda a, b: a @ b.T) if gamma is None else (lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)))
    k, n = kernel(x, x), len(x)
    a, b, rng, still = np.zeros(n), 0.0, np.random.default_rng(seed), 0
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            e = (a * y) @ k[i] + b - y[i]
            if not ((y[i] * e < -1e-3 and a[i] < c) or (y[i] * e > 1e-3 and a[i] > 0)):
                continue
            j = int(rng.integers(0, n - 1))
            j += j >= i
            ej = (a * y) @ k[j] + b - y[j]
            oi, oj = a[i], a[j]
            lo, hi = (max(0.0, oj - oi), min(c, c + oj - oi)) if y[i] != y[j] else (max(0.0, oi + oj - c), min(c, oi + oj))
            eta = 2 * k[i, j] - k[i, i] - k[j, j]
            if lo >= hi or eta >= 0:
                continue
            a[j] = min(hi, max(lo, oj - y[j] * (e - ej) / eta))
            if abs(a[j] - oj) < 1e-6:
                continue
            a[i] = oi + y[i] * y[j] * (oj - a[j])
            bi = b - e - y[i] * (a[i] - oi) * k[i, i] - y[j] * (a[j] - oj) * k[i, j]
            bj = b - ej - y[i] * (a[i] - oi) * k[i, j] - y[j] * (a[j] - oj) * k[j, j]
            b = bi if 0 < a[i] < c else bj if 0 < a[j] < c else (bi + bj) / 2
            moved += 1
        still = 0 if moved else still + 1
        if still >= 3:
            break
    return lambda z: (a * y) @ kernel(x, z) + b


def _one_against_rest(x: np.ndarray, y: np.ndarray, c: float, gamma: float | None) -> Callable[[np.ndarray], np.ndarray]:
    labels = np.unique(y)
    if len(labels) == 1:
        return lambda z: np.full(len(z), labels[0])
    each = [_svm(x, np.where(y == k, 1.0, -1.0), c, gamma) for k in labels]
    return lambda z: labels[np.stack([f(z) for f in each]).argmax(axis=0)]


def svm_grid(df: DataFrame, cs: list[float], gammas: list[float | None], k: int = 5, max_rows: int = 2_000) -> DataFrame:
    """(c, gamma, tp, fp) for each setting: settings and folds are tasks of their own.

    Every task fits to at most ``max_rows`` (by hash) of the rows outside its fold and predicts all
    rows of the fold, a batch at a time.  Every row is in a fold.
    """
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(7)), "id")) - 1
    f = written(df.select("id", "label", "vec", F.pmod(place, F.lit(k)).cast("int").alias("fold")), "folds")
    settings = [(float(c), None if g is None else float(g)) for c in cs for g in gammas]
    train: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for held in range(k):
        rows = f.where(F.col("fold") != held).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(max_rows).toPandas()
        if len(rows):
            rows = rows.sort_values("id")
            train[held] = np.stack(rows["vec"]), rows["label"].to_numpy()
    samples = df.sparkSession.sparkContext.broadcast(train)  # k bounded samples
    grid = df.sparkSession.createDataFrame([(c, g, r) for c, g in settings for r in range(k)], "c double, gamma double, run int")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        c, gamma, held = rows.iloc[0][["c", "gamma", "run"]]
        if int(held) not in samples.value:
            return pd.DataFrame({"c": [], "gamma": [], "run": [], "model": []})
        x, y = samples.value[int(held)]
        model = _one_against_rest(x, y, float(c), None if pd.isna(gamma) else float(gamma))
        return pd.DataFrame({"c": [c], "gamma": [gamma], "run": [int(held)], "model": [cloudpickle.dumps(model)]})

    fitted = grid.groupBy("c", "gamma", "run").applyInPandas(fit, "c double, gamma double, run int, model binary")
    models = written(fitted, "models")

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [(c, gamma, held, cloudpickle.loads(raw)) for c, gamma, held, raw in known.value]
        for batch in batches:
            y, fold = batch["label"].to_numpy(), batch["fold"].to_numpy()
            for c, gamma, held, model in ready:
                at = fold == held
                if at.any():
                    x = np.stack(batch["vec"][at])
                    tp = int((model(x) == y[at]).sum())
                    yield pd.DataFrame({"c": [c], "gamma": [gamma], "tp": [tp], "fp": [int(at.sum()) - tp]})

    known = df.sparkSession.sparkContext.broadcast([tuple(r) for r in models.collect()])  # bounded by the samples
    out = f.select("label", "vec", "fold").mapInPandas(predict, "c double, gamma double, tp long, fp long")
    return out.groupBy("c", "gamma").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


def best_setting(grid: DataFrame) -> DataFrame:
    """The first best setting: most right, then least c and gamma."""
    return grid.orderBy(F.desc("tp"), "c", "gamma").limit(1)
