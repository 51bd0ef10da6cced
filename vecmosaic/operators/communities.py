"""Communities of graphs of any size: local moving and annealing over tables, a class of vertices at a time.

Vertices are dealt into classes by hash.  The vertices of one class look at the labels of all others as they
are, choose their own, and all change at once; then comes the next class.  A step is joins and aggregations over the
edges of one class, so no task holds a component.  Weights are whole numbers of a 2**30th of the largest one, sums of
them are exact in any order, and random numbers are hashes of the vertex and the step: the result is the same for any
number of partitions, and again after a task is lost.

Edges (src, dst, w) are in both directions; no edges give no rows.  Each step's labels are written, those before deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmosaic.session import discard, new_path, written_at

_UNIT = 1 << 30


def _whole(edges: DataFrame, by: str | None) -> tuple[DataFrame, str, float]:
    """Edges with weights as whole numbers, by the largest of all; their path; how many go into a weight of one."""
    unit = _UNIT / (edges.agg(F.max("w")).first()[0] or 1.0)
    w = F.round(F.col("w") * F.lit(unit)).cast("long")
    return *written_at(edges.select("src", "dst", w.alias("w"), *([by] if by else [])), new_path(edges.sparkSession, "whole-edges")), unit


def _vertices(e: DataFrame, by: str | None, totals: DataFrame | float | None, unit: float) -> DataFrame:
    """(vertex, degree, total): with the weight of the vertex's set, of these edges where it isn't given."""
    own = e.groupBy(F.col("src").alias("vertex"), *([by] if by else [])).agg(F.sum("w").alias("degree"))
    if by:
        of = e.groupBy(by).agg(F.sum("w").alias("total")) if totals is None else totals.select(by, F.round(F.col("total") * F.lit(unit)).cast("long").alias("total"))
        return own.join(of, by).drop(by)
    if isinstance(totals, DataFrame):
        totals = totals.first()["total"]
    all_ = e.agg(F.sum("w")).first()[0] if totals is None else round(totals * unit)
    return own.withColumn("total", F.lit(int(all_)).cast("long"))


def _class(vertex: str, classes: int) -> Column:
    return F.pmod(F.xxhash64(F.col(vertex), F.lit(23)), F.lit(classes))


def local_moving(edges: DataFrame, by: str | None = None, classes: int = 4, gain: float = 1e-5, max_sweeps: int = 20, totals: DataFrame | None = None) -> DataFrame:
    """(vertex, cluster): each vertex moves to the neighbouring cluster of largest gain in modularity, until none moves or ``max_sweeps`` times.

    A cluster is named by the vertex that began it.  Equal gains go to the smaller cluster; a vertex alone joins
    another one alone only if that one's id is smaller, as both may move at once.  With ``by`` the gain is in the
    modularity of the vertex's set; ``totals`` (set, total) are the weights of whole sets, where these aren't all their edges.
    """
    spark = edges.sparkSession
    e, e_at, unit = _whole(edges, by)
    if not e.limit(1).count():
        return spark.createDataFrame([], "vertex long, cluster long")
    parts, at = written_at(_vertices(e, by, totals, unit).withColumn("cluster", F.col("vertex")), new_path(spark, "labels"))
    for _ in range(max_sweeps):
        moved = 0
        for c in range(classes):
            new, new_at = written_at(_moved(e.where(_class("src", classes) == c), parts, _class("vertex", classes) == c, gain), new_path(spark, "labels"))
            moved += new.where("moved").count()
            discard(spark, at)
            parts, at = new.drop("moved"), new_at
        if not moved:
            break
    discard(spark, e_at)
    return parts.select("vertex", "cluster")


def _moved(e: DataFrame, parts: DataFrame, own: Column, gain: float) -> DataFrame:
    """All vertices with their clusters after the vertices of one class have moved, and whether they did."""
    mine = parts.where(own)
    links = e.join(parts.select(F.col("vertex").alias("dst"), "cluster"), "dst").where("src <> dst").select(F.col("src").alias("vertex"), "cluster", "w")
    links = links.unionByName(mine.select("vertex", "cluster", F.lit(0).cast("long").alias("w"))).groupBy("vertex", "cluster").agg(F.sum("w").alias("links"))
    held = parts.groupBy("cluster").agg(F.sum("degree").alias("held"), F.count(F.lit(1)).alias("n"))
    rows = links.join(held, "cluster").join(mine.select("vertex", "degree", "total", F.col("cluster").alias("own")), "vertex")
    here = F.col("cluster") == F.col("own")
    others = F.col("held") - F.when(here, F.col("degree")).otherwise(F.lit(0))
    # twice the links less the expected ones, as a share of the total
    score = 2 * (F.col("links") - F.col("degree").cast("double") * others / F.col("total")) / F.col("total")
    best = rows.select("vertex", "own", "cluster", "n", here.alias("here"), score.alias("score")).groupBy("vertex").agg(
        F.max(F.struct("score", (-F.col("cluster")).alias("c"), "n")).alias("b"), F.max(F.when(F.col("here"), F.struct("score", "n"))).alias("s"), F.first("own").alias("own")
    )
    alone = (F.col("b.n") == 1) & (F.col("s.n") == 1) & (-F.col("b.c") > F.col("own"))
    go = (-F.col("b.c") != F.col("own")) & (F.col("b.score") - F.col("s.score") > gain) & ~alone
    moves = best.where(go).select("vertex", (-F.col("b.c")).alias("to"))
    return parts.join(moves, "vertex", "left").select("vertex", "degree", "total", F.coalesce("to", "cluster").alias("cluster"), F.col("to").isNotNull().alias("moved"))


def annealed(edges: DataFrame, components: DataFrame, k: int, temperatures: list[float], gamma: float = 1.0, classes: int = 4, seed: int = 7, total: float | None = None) -> DataFrame:
    """(vertex, cluster): labels of low Potts energy in each component (vertex, component) by annealing.

    At each temperature every vertex draws one of k labels, with weights by the exponent of its links to the label less
    the expected ones.  A cluster is numbered by its component's least vertex times k plus the label.  ``total`` is the
    weight of the whole graph, where these aren't all its edges.
    """
    spark = edges.sparkSession
    e, e_at, unit = _whole(edges, None)
    if not e.limit(1).count():
        return spark.createDataFrame([], "vertex long, cluster long")
    drawn = F.pmod(F.xxhash64("vertex", F.lit(seed), F.lit(-1)), F.lit(k)).cast("int")
    first = _vertices(e, None, total, unit).join(components, "vertex").withColumn("label", drawn)
    parts, at = written_at(first, new_path(spark, "labels"))
    every = F.sequence(F.lit(0), F.lit(k - 1))
    for step, t in enumerate(temperatures):
        for c in range(classes):
            mass = parts.groupBy("component").agg(F.array(*[F.sum(F.when(F.col("label") == q, F.col("degree")).otherwise(F.lit(0))) for q in range(k)]).alias("mass"))
            near = e.where(_class("src", classes) == c).join(parts.select(F.col("vertex").alias("dst"), "label"), "dst").where("src <> dst")
            links = near.groupBy(F.col("src").alias("vertex")).agg(F.array(*[F.sum(F.when(F.col("label") == q, F.col("w")).otherwise(F.lit(0))) for q in range(k)]).alias("links"))
            mine = parts.where(_class("vertex", classes) == c).join(mass, "component").join(links, "vertex", "left")
            degree = F.col("degree").cast("double")
            held = lambda q: F.get("mass", q) - F.when(q == F.col("label"), F.col("degree")).otherwise(F.lit(0))
            field = F.transform(every, lambda q: (F.coalesce(F.get("links", q), F.lit(0)) - gamma * degree * held(q) / F.col("total")) / F.greatest(t * degree, F.lit(1e-12)))
            mine = mine.select("vertex", field.alias("field")).withColumn("top", F.array_max("field"))
            weight = F.transform("field", lambda f: F.exp(f - F.col("top")))
            mine = mine.select("vertex", weight.alias("p")).withColumn("sum", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
            place = F.pmod(F.xxhash64("vertex", F.lit(seed), F.lit(step)), F.lit(1 << 52)) / F.lit(float(1 << 52)) * F.col("sum")
            # the first label at which the running sum passes the drawn place
            state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("label"))
            label = F.aggregate("p", state, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["label"] + (a["sum"] + x <= F.col("place")).cast("int")).alias("label")), lambda a: F.least(a["label"], F.lit(k - 1)))
            new = mine.withColumn("place", place).select("vertex", label.alias("new"))
            after = parts.join(new, "vertex", "left").select("vertex", "degree", "total", "component", F.coalesce("new", "label").alias("label"))
            old = at
            parts, at = written_at(after, new_path(spark, "labels"))
            discard(spark, old)
    discard(spark, e_at)
    return parts.select("vertex", (F.col("component") * k + F.col("label")).alias("cluster"))
