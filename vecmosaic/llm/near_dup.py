"""Near-duplicate classes by HyperMinHash.

A document's shingle hashes fall into buckets by their leading bits; a bucket's least hash is kept
as the number of its leading zeros and a few bits after them.  Registers are compared in bands.
Within a band's bucket, pairs are judged by the share of equal registers, corrected for chance
collisions and with a margin of six standard errors, and only a spanning forest of the passing
pairs is written.  The components of these forests are coarse classes; in each, the full shingle
sets are brought together once and every link that could join two parts is confirmed exactly.

Copies with equal sets are one entry up to the last join.  Very large bands are split by set size
and at random; members outside a band's main class then meet every block of a size near theirs, so
each similar pair of a band is compared or already in one class.  Coarse classes with very many
members or shingles are verified in blocks that share a few pivots, so that most members of a block
are linked at once; members outside the class's main part then meet every block, a piece of them
and a block at a time, so no group outgrows two blocks.

Defined results: a text without words (null, empty, blank) has no shingles and is its own
component; a null doc_id takes no part and has no component; rows that repeat a doc_id belong to
that id, each by its own text; an empty table gives an empty result; very long texts are used whole;
other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.operators.grouped import groups, runs
from vecmosaic.llm.names import unused
from vecmosaic.llm.shingles import U, mix, shingle_sets
from vecmosaic.operators.components import connected_components
from vecmosaic.session import written


@dataclass(frozen=True)
class NearDupOptions:
    width: int = 5
    percent: int = 85  # link when 100 * intersection >= percent * union
    bucket_bits: int = 7
    mantissa_bits: int = 10
    bands: int = 25
    rows: int = 5
    margin: float = 6.0  # standard errors below the threshold that still get verified
    block: int = 4096  # members of a band or a coarse class handled together
    group_shingles: int = 2_000_000  # shingles of a coarse class handled together, beyond one text
    pivots: int = 16  # members of a very large class that every block of it holds


def registers(sets: list[np.ndarray], options: NearDupOptions) -> np.ndarray:
    """One row of registers per sorted set; 0 is an empty bucket."""
    m, bits = 1 << options.bucket_bits, options.bucket_bits
    out = np.zeros((len(sets), m), dtype=np.uint16)
    for row, s in zip(out, sets, strict=True):
        if not len(s):
            continue
        bucket = (s >> U(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = s[first] << U(bits)
        zeros = 53 - np.frexp((rest >> U(11)).astype(np.float64))[1]
        zeros = np.minimum(zeros, 53).astype(U)
        tail = (rest << zeros << U(1)) >> U(64 - options.mantissa_bits)
        row[bucket[first]] = (zeros * U(1 << options.mantissa_bits) + tail + U(1)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray, options: NearDupOptions) -> tuple[np.ndarray, np.ndarray]:
    """(keys, used) by document and band; a band of empty registers is not used."""
    cut = regs[:, : options.bands * options.rows].reshape(len(regs), options.bands, options.rows).astype(U)
    key = np.broadcast_to(np.arange(1, options.bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), cut.shape[:2]).copy()
    for j in range(options.rows):
        key = mix(key ^ (cut[:, :, j] + U((j + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))))
    return key.view(np.int64), cut.any(axis=2)


def similar(one: np.ndarray, n_one: int, regs: np.ndarray, n: np.ndarray, options: NearDupOptions) -> np.ndarray:
    """Which rows may reach the threshold with ``one``, by corrected register agreement and set sizes."""
    used = (regs != 0) | (one != 0)
    same = ((regs == one) & used).sum(axis=1)
    union = np.maximum(used.sum(axis=1), 1)
    chance = 2.0**-options.mantissa_bits / 3  # equal zeros and equal bits of unequal minima
    t = options.percent / 100
    estimate = (same / union - chance) / (1 - chance)
    close = 100 * np.minimum(n, n_one) >= options.percent * np.maximum(n, n_one)
    return close & (estimate >= t - options.margin * np.sqrt(t * (1 - t) / union))


def parts(size: int, weight: np.ndarray, scan: Callable[[int], np.ndarray]) -> np.ndarray:
    """Components of the graph whose neighbours ``scan`` gives, with as few scans as suffice.

    Links inside one part needn't be known, so a vertex is scanned only while it lies outside the
    largest part; at the end all links between parts have been looked for.
    """
    label, scanned = np.arange(size), np.zeros(size, dtype=bool)
    counts = np.ones(size, dtype=np.int64)
    while True:
        open_ = ~scanned & (label != counts.argmax()) if scanned.any() else ~scanned
        if not open_.any():
            return label
        u = int(np.where(open_, weight, -1.0).argmax())
        scanned[u] = True
        near = scan(u)
        near[u] = True
        joined = np.unique(label[near])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
            counts = np.bincount(label, minlength=size)


def forest(regs: np.ndarray, n: np.ndarray, options: NearDupOptions) -> list[tuple[int, int]]:
    """Edges that connect what similar pairs connect, at most one fewer than the members."""
    edges: list[tuple[int, int]] = []
    tree = list(range(len(n)))

    def root(x: int) -> int:
        while tree[x] != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    def scan(u: int) -> np.ndarray:
        near = similar(regs[u], n[u], regs, n, options)
        for v in np.flatnonzero(near).tolist():
            a, b = root(u), root(v)
            if a != b:
                tree[max(a, b)] = min(a, b)
                edges.append((u, v))
        return near

    parts(len(n), np.ones(len(n)), scan)
    return edges


def cross_links(component: np.ndarray, guest: np.ndarray, regs: np.ndarray, n: np.ndarray, options: NearDupOptions) -> list[tuple[int, int]]:
    """Edges between the classes of guests and of the members they are similar to, as far as these aren't linked yet."""
    _, label = np.unique(component, return_inverse=True)
    edges: list[tuple[int, int]] = []
    host = np.flatnonzero(~guest)
    for u in np.flatnonzero(guest).tolist():
        other = host[label[host] != label[u]]
        if not len(other):
            continue
        near = other[similar(regs[u], n[u], regs[other], n[other], options)]
        for c in np.unique(component[near]).tolist():
            edges.append((int(component[u]), c))
        joined = np.unique(np.append(label[near], label[u]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return edges


class SetGroup:
    """Shingle sets brought together: exact links of one member to all others at once."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent = np.array([len(s) for s in sets]), percent
        self.ends = np.cumsum(self.sizes)
        _, self.token = np.unique(np.concatenate(sets), return_inverse=True)
        self.df = np.bincount(self.token)
        order = np.argsort(self.token, kind="stable")
        self.holder = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        #: Members whose shingles many share come first: an original is likely linked with most of its copies.
        self.weight = np.add.reduceat(self.df[self.token].astype(float), self.ends - self.sizes) / self.sizes

    def linked(self, u: int) -> np.ndarray:
        counts = np.zeros(len(self.sizes), dtype=np.int64)
        tokens = self.token[self.ends[u] - self.sizes[u] : self.ends[u]]
        for t in np.array_split(tokens, 1 + int(self.df[tokens].sum()) // 4_000_000):
            df = self.df[t]
            at = np.repeat(self.first[t] - np.concatenate([[0], np.cumsum(df)[:-1]]), df) + np.arange(df.sum())
            counts += np.bincount(self.holder[at], minlength=len(counts))
        return 100 * counts >= self.percent * (self.sizes + self.sizes[u] - counts)

    def components(self) -> np.ndarray:
        if len(self.sizes) == 1:
            return np.zeros(1, dtype=np.int64)
        if len(self.sizes) == 2:
            return np.array([0, 0 if self.linked(0)[1] else 1])
        return parts(len(self.sizes), self.weight, self.linked)


def _fixed(column: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def signatures(docs: DataFrame, options: NearDupOptions = NearDupOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version, n, set_key, regs) for every row; set_key is null where there are no shingles."""
    narrow = _narrow(docs, doc_id, text).select("doc_id", "version", F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("body"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sets = list(shingle_sets(part.column("body").to_pylist(), options.width))
                regs = registers(sets, options)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "version", "n", "set_key", "regs"],
                )

    return narrow.mapInArrow(sign, "doc_id long, version long, n long, set_key binary, regs binary")


def _coarse(reps: DataFrame, options: NearDupOptions) -> DataFrame:
    """(vertex, component): coarse classes of the representatives that have a candidate."""
    m = 1 << options.bucket_bits

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = _fixed(batch.column("regs"), np.uint16, m)
            keys, used = band_keys(regs, options)
            rep = np.repeat(batch.column("rep").to_numpy(), options.bands)[used.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[used.ravel()]), pa.array(rep)], names=["key", "rep"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "gid"):
            regs, n, rep = _fixed(table.column("regs"), np.uint16, m), table.column("n").to_numpy(), table.column("rep").to_numpy()
            edges = [(a + u, a + v) for a, b in groups(table, "gid") if b - a > 1 for u, v in forest(regs[a:b], n[a:b], options)]
            if edges:
                u, v = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[u]), pa.array(rep[v])], names=["src", "dst"])

    parallel = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = reps.select("rep", "regs").mapInArrow(band, "key long, rep long")
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-bands")
    large = shared.where(F.col("size") > options.block).select("key")
    some = large.limit(1).count() > 0
    members = bands.join(shared.where(F.col("size") <= options.block), "key").select(F.col("key").alias("gid"), "rep")
    if some:
        # sizes of a similar pair are in one cell or in two that touch
        cell = F.floor(F.log(F.col("n").cast("double")) / (1.000001 * math.log(100 / options.percent))).cast("int")
        inside = written(bands.join(large, "key").join(reps.select("rep", "n"), "rep").select("key", cell.alias("cell"), "rep"), "large-bands")
        cells = inside.groupBy("key", "cell").agg(F.ceil(F.count(F.lit(1)) / options.block).cast("int").alias("blocks"))
        placed = inside.join(cells, ["key", "cell"]).select("key", "cell", "rep", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int").alias("block"))
        members = members.union(placed.select(F.xxhash64("key", "cell", "block").alias("gid"), "rep"))
    full = members.join(reps.select("rep", "n", "regs"), "rep").select("gid", "rep", "n", "regs")
    edges = full.repartition(parallel, "gid").sortWithinPartitions("gid").mapInArrow(join, "src long, dst long").distinct()
    if not some:
        return connected_components(edges)
    edges = written(edges, "band-edges")
    found = connected_components(edges)
    return connected_components(edges.union(_across_blocks(placed, cells, found, reps, options, parallel)))


def _across_blocks(placed: DataFrame, cells: DataFrame, found: DataFrame, reps: DataFrame, options: NearDupOptions, parallel: int) -> DataFrame:
    """(src, dst): links between classes that the blocks of very large bands left apart.

    Of two members in different classes, one at least is outside the band's main class.  It is sent
    to every block of its own and the neighbouring cells; such guests come in groups of about a
    block, each of which meets the hosts anew.
    """
    m = 1 << options.bucket_bits
    own = placed.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    own = written(own.select("key", "cell", "block", "rep", "component"), "large-members")
    often = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = often.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m")).select("key", F.col("m.component").alias("main"))
    stray = own.join(main, "key").where("component <> main")
    pieces = stray.groupBy("key", F.col("cell").alias("from")).agg(F.ceil(F.count(F.lit(1)) / options.block).cast("int").alias("pieces"))
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    at = F.xxhash64("key", "cell", "block", "from", "piece").alias("gid")
    guests = stray.withColumnRenamed("cell", "from").join(pieces, ["key", "from"])
    guests = guests.select("key", "from", "rep", "component", F.pmod(F.xxhash64("rep", "key", F.lit(1)), F.col("pieces")).cast("int").alias("piece"), near("from").alias("cell"))
    guests = guests.join(cells, ["key", "cell"]).withColumn("block", upto("blocks")).select(at, "rep", "component", F.lit(True).alias("guest"))
    hosts = own.withColumn("from", near("cell")).join(pieces, ["key", "from"]).withColumn("piece", upto("pieces")).select(at, "rep", "component", F.lit(False).alias("guest"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "gid"):
            regs, n = _fixed(table.column("regs"), np.uint16, m), table.column("n").to_numpy()
            component, guest = table.column("component").to_numpy(), table.column("guest").to_numpy()
            links = [x for a, b in groups(table, "gid") for x in cross_links(component[a:b], guest[a:b], regs[a:b], n[a:b], options)]
            if links:
                s, d = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], names=["src", "dst"])

    full = guests.union(hosts).join(reps.select("rep", "n", "regs"), "rep").select("gid", "component", "guest", "n", "regs")
    return full.repartition(parallel, "gid").sortWithinPartitions("gid").mapInArrow(across, "src long, dst long").distinct()


def _verified(texts: DataFrame, coarse: DataFrame, options: NearDupOptions) -> DataFrame:
    """(rep, component): exact components of the coarse classes (rep, component, n) from their texts (rep, component, body)."""
    spark = texts.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sets = list(shingle_sets([x or b"" for x in part.column("body").to_pylist()], options.width))
                keep = [i for i, s in enumerate(sets) if len(s)]
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("component"), part.column("rep"), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["coarse", "rep", "set"])

    sizes = coarse.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    large = written(sizes.select(F.col("component").alias("coarse"), _blocks("size", "shingles", options).alias("blocks")).where("blocks > 1"), "large-classes")
    sets = texts.mapInArrow(build, "coarse long, rep long, set binary")
    some = large.limit(1).count() > 0
    if some:
        sets = written(sets, "sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "gid"):
            rep, raw = table.column("rep").to_numpy(), table.column("set")
            out = rep.copy()
            for a, b in groups(table, "gid"):
                label = SetGroup([np.frombuffer(raw[i].as_py(), dtype=U) for i in range(a, b)], options.percent).components()
                least = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(least, label, rep[a:b])
                out[a:b] = least[label]
            yield pa.RecordBatch.from_arrays([table.column("gid").combine_chunks(), pa.array(rep), pa.array(out)], names=["gid", "rep", "component"])

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(parallel, "gid").sortWithinPartitions("gid").mapInArrow(exact, "gid long, rep long, component long")

    if not some:
        return grouped(sets.select(F.col("coarse").alias("gid"), "rep", "set")).select("rep", "component")
    small = sets.join(large, "coarse", "left_anti")
    done = grouped(small.select(F.col("coarse").alias("gid"), "rep", "set")).select("rep", "component")
    return done.union(_in_blocks(sets.join(large, "coarse"), grouped, options, parallel))


def _blocks(size: str, shingles: str, options: NearDupOptions) -> Column:
    return F.ceil(F.greatest(F.col(size) / options.block, F.col(shingles) / options.group_shingles)).cast("int")


def meetings(own: DataFrame, options: NearDupOptions) -> DataFrame:
    """(gid, rep, part, guest): where the members of very large classes meet that don't belong to the main part.

    ``own`` holds (coarse, blocks, block, rep, n, part) of every member.  Guests are dealt into
    pieces; each pair of a piece and a block is one group.
    """
    often = own.groupBy("coarse", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("coarse").agg(F.max(F.struct("c", "part")).alias("m"))
    stray = own.join(often.select("coarse", F.col("m.part").alias("main")), "coarse").where("part <> main")
    pieces = stray.groupBy("coarse").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select("coarse", _blocks("c", "s", options).alias("pieces"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    gid = F.xxhash64("coarse", "block", "piece").alias("gid")
    guests = stray.drop("block").join(pieces, "coarse").withColumn("piece", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("pieces")).cast("int")).withColumn("block", upto("blocks"))
    hosts = own.join(pieces, "coarse").withColumn("piece", upto("pieces"))
    return hosts.select(gid, "rep", "part", F.lit(False).alias("guest")).union(guests.select(gid, "rep", "part", F.lit(True).alias("guest")))


def _in_blocks(big: DataFrame, grouped: Callable[[DataFrame], DataFrame], options: NearDupOptions, parallel: int) -> DataFrame:
    """Components of very large classes (coarse, rep, set, blocks), a block at a time.

    Every block holds the class's pivots, so its parts hang together with those of other blocks.
    What is left beside the largest part is sent to all blocks of its class; the links found there
    are between whole parts.
    """
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    order = Window.partitionBy("coarse").orderBy(F.xxhash64("rep", F.lit(5)), "rep")
    pivots = written(big.select("coarse", "rep", F.row_number().over(order).alias("r")).where(F.col("r") <= options.pivots).select("rep"), "pivots")
    everywhere = big.join(pivots, "rep", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = big.join(pivots, "rep", "left_anti").withColumn("block", block).unionByName(everywhere)
    found = written(grouped(placed.select(F.xxhash64("coarse", "block").alias("gid"), "rep", "set")).select("rep", "component"), "blocks")
    parts = connected_components(found.select(F.col("rep").alias("src"), F.col("component").alias("dst")))
    members = big.select("coarse", "blocks", block.alias("block"), "rep", (F.length("set") / 8).cast("long").alias("n"))
    own = members.join(parts.select(F.col("vertex").alias("rep"), F.col("component").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    own = written(own, "parts")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "gid"):
            raw, part, guest = table.column("set"), table.column("part").to_numpy(), table.column("guest").to_numpy()
            links = set()
            for a, b in groups(table, "gid"):
                if not guest[a:b].any() or guest[a:b].all():
                    continue
                group = SetGroup([np.frombuffer(raw[i].as_py(), dtype=U) for i in range(a, b)], options.percent)
                for u in np.flatnonzero(guest[a:b]).tolist():
                    links |= {(int(part[a + u]), int(x)) for x in np.unique(part[a:b][group.linked(u)])}
            links = [x for x in links if x[0] != x[1]]
            if links:
                s, d = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], names=["src", "dst"])

    met = meetings(own, options).join(big.select("rep", "set"), "rep")
    links = met.repartition(parallel, "gid").sortWithinPartitions("gid").mapInArrow(across, "src long, dst long")
    whole = connected_components(links.distinct())
    return own.join(whole, F.col("part") == F.col("vertex"), "left").select("rep", F.coalesce("component", "part").alias("component"))


def _classes(docs: DataFrame, options: NearDupOptions) -> DataFrame:
    """(doc_id, version, vertex, n_shingles, component_id, kept), one row per row of (doc_id, text).

    A version stands for a text and a vertex for a group of texts.  Ids are vertices; where texts
    of one id differ, those after the first are vertices of their own.
    """
    signed = written(signatures(docs, options), "signatures")
    sized = signed.where("set_key is not null and doc_id is not null")
    named = sized.groupBy("set_key").agg(F.min(F.struct("doc_id", "version")).alias("at"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    named = named.select("set_key", "at.doc_id", "at.version", "n", "regs")
    # below this size a set of another content is never within the threshold
    least = next(n for n in range(1, 1000) if 100 * n >= options.percent * (n + 1))
    several = sized.groupBy("doc_id").agg(F.min("version").alias("first"), F.max("version").alias("last"))
    several = written(several.where("first <> last").select("doc_id", "first"), "ids-of-several-texts")
    some = several.limit(1).count() > 0

    def with_vertex(df: DataFrame) -> DataFrame:
        if not some:
            return df.withColumn("rep", F.col("doc_id"))
        own = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "version"), 1)
        return df.join(several, "doc_id", "left").withColumn("rep", F.when(F.col("version") != F.col("first"), own).otherwise(F.col("doc_id"))).drop("first")

    reps = written(with_vertex(named.where(F.col("n") >= least)).select("rep", "doc_id", "version", "n", "regs"), "representatives")
    coarse = written(_coarse(reps.select("rep", "n", "regs"), options).select(F.col("vertex").alias("rep"), "component"), "coarse")
    # only what is needed to find the texts goes into the join with them
    wanted = coarse.join(reps.select("rep", "doc_id", "version"), "rep") if some else coarse.withColumn("doc_id", F.col("rep"))
    near = _marked(docs.where("doc_id is not null"), wanted.select("doc_id"))
    texts = near.join(wanted.hint("shuffle_merge"), ["doc_id", "version"] if some else ["doc_id"]).select("rep", "component", F.encode("text", "UTF-8").alias("body"))
    exact = written(_verified(texts, coarse.join(reps.select("rep", "n"), "rep"), options), "classes").groupBy("rep").agg(F.min("component").alias("component"))
    classes = with_vertex(named.select("set_key", "doc_id", "version")).join(exact, "rep", "left")
    classes = classes.select("set_key", F.col("doc_id").alias("least"), F.coalesce("component", "rep").alias("vertex"))
    if some:
        roots = classes.groupBy("vertex").agg(F.min("least").alias("root"))
        classes = classes.join(roots, "vertex")
    else:
        classes = classes.withColumn("root", F.col("vertex"))
    # both sides are plain scans, so adaptive execution can split a set that very many rows have
    classes = written(classes.select("set_key", "vertex", "root"), "vertices")
    out = signed.select("doc_id", "version", "n", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(
        "doc_id", "version", "vertex", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


_MARKS = (1 << 24, 1 << 26)


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among ``ids``, so that few texts go into the shuffle of a join with those.

    Ids are marked in a bitmap of 16 bits for each, 2 MB at least and 8 MB at most (``_MARKS``).  An id outside passes
    by chance, one in 16 or fewer up to 4 million ids; with very many more all rows pass
    and the join shuffles every text once.
    """
    bits = min(_MARKS[1], max(_MARKS[0], 1 << (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(bits)) + 1
    marks = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    marks = marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return docs.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "bucket").where(hit).drop("bucket", "bits")


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))


def near_duplicates(docs: DataFrame, options: NearDupOptions = NearDupOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    return _classes(_narrow(docs, doc_id, text), options).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, options: NearDupOptions = NearDupOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows without all but one of each near-duplicate class.

    Of a class one text of the smallest id stays; a row that repeats both id and text stays once;
    rows without an id all stay, and so does each text without words.
    """
    named, version, key = unused(docs, "id", "version", "key")
    classes = _classes(_narrow(docs, doc_id, text), options).where("kept and doc_id is not null")
    one = classes.groupBy("doc_id", "vertex", F.when(F.col("vertex").isNull(), F.col("version")).alias("blank")).agg(F.min("version").alias("version"))
    kept = one.select(F.col("doc_id").alias(key), F.col("version").alias(version))
    cols = docs.columns
    rows = docs.withColumn(named, F.col(doc_id).cast("long"))
    here = rows.where(F.col(named).isNotNull()).withColumn(version + "_", F.xxhash64(text))
    here = here.join(kept, (F.col(named) == F.col(key)) & (F.col(version + "_") == F.col(version)), "left_semi")
    return here.dropDuplicates([named, version + "_"]).select(*cols).unionByName(docs.where(F.col(doc_id).isNull()))
