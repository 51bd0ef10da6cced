"""Local moving and annealing over tables: planted groups, the gain rule, and the same result at any parallelism."""

import numpy as np
import pytest

from vecmosaic.operators import cluster as K
from vecmosaic.operators import graph as G
from vecmosaic.operators.communities import annealed, local_moving
from vecmosaic.operators.components import connected_components


@pytest.fixture(scope="module")
def planted(spark):
    """Six groups of 25 with many edges inside and few between, one component, and a hub with an edge to all."""
    rng = np.random.default_rng(4)
    group = np.repeat(np.arange(6), 25)
    pairs = {}
    for a in range(150):
        for b in range(a + 1, 150):
            if rng.random() < (0.5 if group[a] == group[b] else 0.01):
                pairs[a, b] = float(rng.uniform(0.5, 1.0))
        pairs[a, 150] = 0.02
    rows = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]
    return spark.createDataFrame(rows, "src long, dst long, w double").repartition(5).cache(), group


def partition(df):
    return {r.vertex: r.cluster for r in df.collect()}


def agree(found, group):
    """The share of vertices in the most frequent cluster of their group, if these clusters are different."""
    most = [max(set(own := [found[v] for v in np.flatnonzero(group == g).tolist()]), key=own.count) for g in range(6)]
    return np.mean([found[v] == most[group[v]] for v in range(150)]) if len(set(most)) == 6 else 0.0


@pytest.fixture(scope="module")
def found(planted):
    return partition(local_moving(planted[0], classes=2))


def test_groups_are_found_at_any_parallelism(spark, planted, found):
    edges, group = planted
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 3)
        assert partition(local_moving(edges.repartition(11), classes=2)) == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 151 and agree(found, group) > 0.95
    kernel = partition(K.louvain(edges))
    quality = [G.modularity(edges, spark.createDataFrame(list(p.items()), "vertex long, cluster long")).first()[0] for p in (found, kernel)]
    assert quality[0] > 0.95 * quality[1]


def test_no_vertex_gains_by_a_further_move(planted, found):
    rows = [(r.src, r.dst, r.w) for r in planted[0].collect()]
    total = sum(w for *_, w in rows)
    degree, held, links = {}, {}, {}
    for a, b, w in rows:
        degree[a] = degree.get(a, 0) + w
        links[a, found[b]] = links.get((a, found[b]), 0) + w
    for v, c in found.items():
        held[c] = held.get(c, 0) + degree[v]
    score = lambda v, c: 2 * (links.get((v, c), 0) - degree[v] * (held[c] - (degree[v] if found[v] == c else 0)) / total) / total
    better = [v for v in found if max(score(v, c) for u, c in links if u == v) - score(v, found[v]) > 1e-5 + 1e-7]
    assert len(better) <= 3  # those alone that wait for a smaller one


def test_sets_have_their_own_weight(spark, planted, found):
    """A second set beside the first, with ``by``, doesn't change the first one's clusters."""
    edges, _ = planted
    from pyspark.sql import functions as F

    one = edges.withColumn("set_id", F.lit(0).cast("long"))
    two = edges.limit(400).select((F.col("src") + 1000).alias("src"), (F.col("dst") + 1000).alias("dst"), "w")
    two = two.unionByName(two.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).distinct().withColumn("set_id", F.lit(1).cast("long"))
    both = partition(local_moving(one.unionByName(two), "set_id", classes=2))
    assert {v: c for v, c in both.items() if v < 1000} == found


def test_large_components_go_over_tables(spark, planted):
    edges, group = planted
    from pyspark.sql import functions as F

    small = spark.createDataFrame([(500, 501, 1.0), (501, 500, 1.0)], "src long, dst long, w double")
    both = edges.unionByName(small)
    found = partition(K.louvain(both, task_edges=100))
    assert len(found) == 153 and found[500] == found[501] and agree(found, group) > 0.95
    glass = partition(K.spin_glass(both, k=8, sweeps=3, task_edges=100))
    assert set(glass) == set(found) and len({c for v, c in glass.items() if v < 500}) <= 8
    assert local_moving(edges.where(F.lit(False))).count() == 0 and K.louvain(edges.where(F.lit(False))).count() == 0


def test_annealing_is_the_same_at_any_parallelism(spark, planted):
    edges, _ = planted
    where = connected_components(edges).cache()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n, parts in ((2, 2), (6, 9)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(partition(annealed(edges.repartition(parts), where, 5, [1.0, 0.05], classes=2)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == 151 and len(set(results[0].values())) <= 5


def test_adjusted_mutual_information(spark):
    """Against the definition, and with more clusters than a dense table of them could hold."""
    from math import comb, log

    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 4, 60)
    b[:40] = a[:40] % 4
    frame = lambda x: spark.createDataFrame(list(enumerate(x.tolist())), "vertex long, cluster long")
    got = K.adjusted_mutual_information(frame(a), frame(b)).first()
    n, r, c = 60, np.bincount(a).tolist(), np.bincount(b).tolist()
    mi = sum(k / n * log(n * k / (r[x] * c[y])) for x in range(5) for y in range(4) if (k := int(((a == x) & (b == y)).sum())))
    h = [-sum(k / n * log(k / n) for k in m if k) for m in (r, c)]
    e = sum(k / n * log(n * k / (i * j)) * comb(i, k) * comb(n - i, j - k) / comb(n, j) for i in r for j in c for k in range(max(1, i + j - n), min(i, j) + 1))
    assert abs(got.mi - mi) < 1e-9 and abs(got.ami - (mi - e) / (sum(h) / 2 - e)) < 1e-9
    many = spark.range(60_000).select(F.col("id").alias("vertex"), F.floor(F.col("id") / 3).alias("cluster"))
    assert abs(K.adjusted_mutual_information(many, many).first().ami - 1) < 1e-9
    assert K.adjusted_mutual_information(many.limit(0), many).count() == 0
    one = many.select("vertex", F.lit(1).cast("long").alias("cluster"))
    assert K.adjusted_mutual_information(one, one).first().ami == 1
