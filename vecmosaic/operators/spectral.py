"""Spectral selection of matches: pairwise affinities and the principal eigenvector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.operators.passes import Stored, pass_over
from vecmosaic.session import checkpointed, discard, new_path, written, written_at


def affinity_simple(d0: Column, d1: Column, sigma: float = 50.0) -> Column:
    """How well two matches agree: 4.5 less the squared difference of their lengths, zero beyond 3 sigma."""
    diff = d0 - d1
    return F.when(F.abs(diff) < 3 * sigma, 4.5 - diff * diff / (2 * sigma * sigma)).otherwise(F.lit(0.0))


def affinities(matches: DataFrame, sigma: float = 50.0, affinity_fun: Callable[[Column, Column, float], Column] = affinity_simple, parts: int | None = None) -> DataFrame:
    """(pair, a, b, w) of matches (pair, id, x1, y1, x2, y2, score): all pairs of matches of one image pair, and
    the scores on the diagonal; quadratic in the matches of an image pair, as the operator asks.

    With ``parts`` the image pairs are dealt into as many tasks: the matches are few bytes, so adaptive execution would
    put many image pairs into one task, whose result is large."""
    matches = matches if parts is None else matches.repartition(parts, "pair")
    a, b = matches.alias("a"), matches.alias("b")
    dist = lambda n: F.hypot(F.col(f"a.x{n}") - F.col(f"b.x{n}"), F.col(f"a.y{n}") - F.col(f"b.y{n}"))
    pairs = a.join(b, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.id") != F.col("b.id")))
    pairs = pairs.select("a.pair", F.col("a.id").alias("a"), F.col("b.id").alias("b"), affinity_fun(dist(1), dist(2), sigma).alias("w"))
    most = matches.groupBy("pair").agg(F.max("score").alias("most"))
    own = matches.join(most, "pair").select("pair", F.col("id").alias("a"), F.col("id").alias("b"), (4.5 * (1 - F.try_divide("score", "most"))).alias("w"))
    return pairs.where("w <> 0").union(own)


def principal_vector(w: DataFrame, rounds: int = 20, dense_entries: int = 4_000_000) -> DataFrame:
    """(pair, id, x): a fixed number of power iterations from the all-ones vector, scaled to length one.

    The matrix of an image pair is one kernel up to ``dense_entries`` entries; larger ones iterate
    over tables, all together.
    """
    w = checkpointed(w)
    sizes = w.groupBy("pair").agg(F.count(F.lit(1)).alias("entries"))
    large = checkpointed(sizes.where(F.col("entries") > dense_entries).select("pair"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"], kind="stable")
        ids, a = np.unique(rows["a"].to_numpy(), return_inverse=True)
        b = np.searchsorted(ids, rows["b"].to_numpy())
        x = np.ones(len(ids))
        for _ in range(rounds):
            x = np.bincount(a, weights=rows["w"].to_numpy() * x[b], minlength=len(ids))
            x = x / (np.sqrt((x * x).sum()) or 1.0)
        return pd.DataFrame({"pair": rows["pair"].iloc[0], "id": ids, "x": x})

    if not large.limit(1).count():
        return w.groupBy("pair").applyInPandas(run, "pair long, id long, x double")
    small = w.join(large, "pair", "left_anti").groupBy("pair").applyInPandas(run, "pair long, id long, x double")
    w = checkpointed(w.join(large, "pair"))
    x = checkpointed(w.select("pair", F.col("a").alias("id")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        y = w.join(x.withColumnRenamed("id", "b"), ["pair", "b"]).groupBy("pair", F.col("a").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        y = checkpointed(y)
        norm = y.groupBy("pair").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        x = y.join(norm, "pair").select("pair", "id", F.when(F.col("norm") > 0, F.col("y") / F.col("norm")).otherwise(F.col("y")).alias("x"))
    return small.union(x)


ROWS = "pair long, id long, x1 double, y1 double, x2 double, y2 double, own double, x double"


def streamed_vector(matches: DataFrame, sigma: float = 50.0, rounds: int = 20) -> DataFrame:
    """(pair, id, x) as of ``principal_vector`` over ``affinity_simple``, without the matrix.

    Each round reads the matches past those of a task and makes the affinities anew, so disk grows with the matches only.
    """
    spark = matches.sparkSession

    def times(table: Stored) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
        names = ["x1", "y1", "x2", "y2", "x"]

        def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            pair, ids, own, mine = (rows.column(c).to_numpy() for c in ("pair", "id", "own", "x"))
            p = np.stack([rows.column(c).to_numpy() for c in names[:4]])
            out, at = own * mine, {k: np.flatnonzero(pair == k) for k in np.unique(pair).tolist()}
            for batch in table.batches(4096):
                of, other = batch.column("pair").to_numpy(), batch.column("id").to_numpy()
                q = np.stack([batch.column(c).to_numpy() for c in names])
                for k in np.unique(of).tolist():
                    b = np.flatnonzero(of == k)
                    for i in range(0, len(at.get(k, ())), 512):
                        a = at[k][i : i + 512]
                        d0, d1 = (np.hypot(p[c, a][:, None] - q[c, b], p[c + 1, a][:, None] - q[c + 1, b]) for c in (0, 2))
                        diff = np.abs(d0 - d1)
                        w = np.where((diff < 3 * sigma) & (ids[a][:, None] != other[b]), 4.5 - diff * diff / (2 * sigma * sigma), 0.0)
                        out[a] += w @ q[4, b]
            done = rows.set_column(rows.schema.get_field_index("x"), "x", pa.array(out))
            yield from done.to_batches()

        return run

    most = matches.groupBy("pair").agg(F.max("score").alias("most"))
    own = F.coalesce(4.5 * (1 - F.try_divide("score", "most")), F.lit(0.0)).alias("own")
    start = matches.join(most, "pair").select("pair", F.col("id").cast("long"), "x1", "y1", "x2", "y2", own, F.lit(1.0).alias("x"))
    x, at = written_at(start.repartitionByRange("pair"), new_path(spark, "spectral"))
    for _ in range(rounds):
        y, after = written_at(pass_over(x, None, "id", times(Stored.at(at)), ROWS), new_path(spark, "spectral"))
        discard(spark, at)
        norm = y.groupBy("pair").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        scaled = F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")).alias("x")
        x, at = written_at(y.join(norm, "pair").select(*x.columns[:-1], scaled).repartitionByRange("pair"), new_path(spark, "spectral"))
        discard(spark, after)
    return x.select("pair", "id", "x")


def top_share(x: DataFrame, keep: float) -> DataFrame:
    """Each pair's share of entries of largest magnitude; a share under one entry keeps all."""
    w = Window.partitionBy("pair")
    ranked = x.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.abs("x")), "id")))
    k = F.floor(F.col("n") * keep)
    return ranked.where((k < 1) | (F.col("r") <= k)).select("pair", "id", "x")


def spectral_match(matches: DataFrame, sigma: float = 50.0, keep: float = 0.5, rounds: int = 20, affinity_fun: Callable[[Column, Column, float], Column] = affinity_simple, dense_entries: int = 250_000) -> DataFrame:
    """The matches of each image pair that agree best with each other.

    With the plain affinities the matrix of a pair of more than ``dense_entries`` entries isn't written.
    """
    matches = written(matches, "spectral-matches")
    some, large = matches, None
    if affinity_fun is affinity_simple:
        sizes = checkpointed(matches.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * F.col("n") > dense_entries).select("pair"))
        if sizes.limit(1).count():
            some, large = matches.join(sizes, "pair", "left_anti"), matches.join(sizes, "pair", "left_semi")
    x = principal_vector(affinities(some, sigma, affinity_fun), rounds, dense_entries)
    if large is not None:
        x = x.union(streamed_vector(large, sigma, rounds))
    return matches.join(top_share(x, keep), ["pair", "id"])
