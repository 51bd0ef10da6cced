"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

A bin takes at most ``per_source`` pieces of one source and one document of a duplicate cluster.
Open bins are ordered by residual; each carries bitmaps of the sources and clusters that are full
in it.  The search starts at the least residual that holds the piece and goes on to the next until
the tightest compatible bin is found.  A tree over the residuals keeps the bits that all bins
below a node share, so stretches in which every bin conflicts are passed over at once.

Documents come in order of falling length.  One longer than a bin is cut; its full pieces are bins
of their own and its last piece is packed like a document.  A document costs its words and one end
token.  Packing runs in shards dealt by hash, each of about ``shard_rows`` documents, so no source
or cluster gathers in one task.

Defined results: a null or empty text costs its end token alone; null sources are one source; rows
that repeat are packed one by one and, being one cluster, into different bins; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.operators.grouped import groups, runs
from vecmosaic.llm.quality_rules import words_of
from vecmosaic.session import written

RESULT = "bin_id long, slot int, doc_id long, piece int, doc_start long, n_tokens int, bin_start int"


@dataclass(frozen=True)
class PackingOptions:
    capacity: int = 2048
    per_source: int = 2
    shard_rows: int = 50_000
    bits: int = 1024  # sources, and clusters, that have a bit of their own; rarer ones are looked up


class _Bin:
    __slots__ = ("number", "left", "mask", "sources", "clusters", "pieces")

    def __init__(self, number: int, capacity: int):
        self.number, self.left, self.mask = number, capacity, 0
        self.sources: Counter = Counter()
        self.clusters: set = set()
        self.pieces: list = []


class Packer:
    """Best fit in one shard."""

    def __init__(self, options: PackingOptions, sources: list, clusters: list):
        self.o, self.bins = options, []
        often = lambda keys: [k for k, n in Counter(keys).most_common(options.bits) if n > 1]
        self.source_bit = {k: 1 << i for i, k in enumerate(often(sources))}
        self.cluster_bit = {k: 1 << (options.bits + i) for i, k in enumerate(often(clusters))}
        self.size = 1 << options.capacity.bit_length()
        self.levels: list[list[_Bin]] = [[] for _ in range(self.size)]
        self.shared = [-1] * (2 * self.size)  # bits that all bins below have; all of them where there is no bin

    def _refresh(self, level: int) -> None:
        bits = -1
        for b in self.levels[level]:
            bits &= b.mask
        node = level + self.size
        self.shared[node] = bits
        while node > 1:
            node >>= 1
            both = self.shared[2 * node] & self.shared[2 * node + 1]
            if both == self.shared[node]:
                break
            self.shared[node] = both

    def _fits(self, b: _Bin, source, cluster) -> bool:
        return b.sources[source] < self.o.per_source and cluster not in b.clusters

    def _tightest(self, length: int, source, cluster) -> _Bin | None:
        bits = self.source_bit.get(source, 0), self.cluster_bit.get(cluster, 0)
        stack = [(1, 0, self.size)]
        while stack:
            node, a, b = stack.pop()
            shared = self.shared[node]
            if b <= length or shared == -1 or shared & bits[0] or shared & bits[1]:
                continue
            if b - a == 1:
                found = next((x for x in self.levels[a] if not x.mask & (bits[0] | bits[1]) and self._fits(x, source, cluster)), None)
                if found:
                    return found
                continue
            mid = (a + b) // 2
            stack.append((2 * node + 1, mid, b))
            stack.append((2 * node, a, mid))
        return None

    def place(self, length: int, source, cluster, piece: tuple) -> None:
        b = self._tightest(length, source, cluster) if length < self.o.capacity else None
        if b is None:
            b = _Bin(len(self.bins), self.o.capacity)
            self.bins.append(b)
        elif b.left:
            self.levels[b.left].remove(b)
            self._refresh(b.left)
        b.pieces.append((*piece, length, self.o.capacity - b.left))
        b.left -= length
        b.sources[source] += 1
        b.clusters.add(cluster)
        if b.sources[source] >= self.o.per_source:
            b.mask |= self.source_bit.get(source, 0)
        b.mask |= self.cluster_bit.get(cluster, 0)
        if b.left:
            self.levels[b.left].append(b)
            self._refresh(b.left)


def pack_shard(ids: list, lengths: list[int], sources: list, clusters: list, options: PackingOptions) -> list[tuple]:
    """(bin, slot, doc_id, piece, doc_start, n_tokens, bin_start) of a shard's documents."""
    packer, c = Packer(options, sources, clusters), options.capacity
    pieces = []
    for doc_id, n, source, cluster in zip(ids, lengths, sources, clusters, strict=True):
        for k in range(-(-n // c)):
            pieces.append((min(c, n - k * c), doc_id, source, cluster, k))
    pieces.sort(key=lambda p: (-p[0], p[1] is not None, p[1] or 0, p[4], p[3]))
    for length, doc_id, source, cluster, k in pieces:
        packer.place(length, source, cluster, (doc_id, k, k * c))
    return [(b.number, slot, *p) for b in packer.bins for slot, p in enumerate(b.pieces)]


def pack(docs: DataFrame, options: PackingOptions = PackingOptions(), doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """RESULT rows: every piece of every document with its bin, slot and place in it.

    ``cluster`` names a column of duplicate clusters, such as the component_id of ``near_duplicates``;
    without it a cluster is exact copies up to case and spacing.
    """
    spark = docs.sparkSession
    words = words_of(F.lower(F.col(text)))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.size(words) + 1).cast("long").alias("n"),
        F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))).alias("src"),
        (F.xxhash64(F.col(cluster).cast("string")) if cluster else F.xxhash64(words)).alias("cluster"),
    )
    # an id that more rows have than a shard should hold is dealt over several
    often = written(docs.groupBy(F.col(doc_id).cast("long").alias("often")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > options.shard_rows), "frequent-ids")
    salt = F.lit(0).cast("long")
    if often.limit(1).count():
        # numbered before the join, so a row keeps its number when a task after a shuffle is run again
        rows = rows.withColumn("number", F.monotonically_increasing_id()).join(often, F.col("doc_id").eqNullSafe(F.col("often")), "left")
        salt = F.when(F.col("c").isNotNull(), F.col("number")).otherwise(salt)
    shards = max(1, -(-docs.count() // options.shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "src", salt), F.lit(shards))).select("doc_id", "n", "src", "cluster", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        names = ["bin_id", "slot", "doc_id", "piece", "doc_start", "n_tokens", "bin_start"]
        for table in runs(batches, "shard"):
            shard = table.column("shard").to_numpy()
            for a, b in groups(table, "shard"):
                part = table.slice(a, b - a)
                got = pack_shard(*(part.column(c).to_pylist() for c in ("doc_id", "n", "src", "cluster")), options)
                for i in range(0, len(got), 100_000):
                    cols = list(zip(*got[i : i + 100_000], strict=True))
                    cols[0] = (np.array(cols[0], dtype=np.int64) + (int(shard[a]) << 40)).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    parallel = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(parallel, "shard").sortWithinPartitions("shard").mapInArrow(run, RESULT)
