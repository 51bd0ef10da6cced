"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph is hashed to a wide vector and a text's fingerprint is the sum of its paragraphs'
vectors, so it doesn't depend on their order, and a paragraph is inserted or deleted by adding or
subtracting its vector.  The vector has two parts:

* eight numbers of 64 bits from a cryptographic digest of the paragraph, summed modulo 2**64: equal
  sums mean equal multisets of paragraphs, but for chance;
* 128 lanes of 32 bits, summed modulo 2**32, in which each five-word shingle of the paragraph counts
  +1 or -1 by one bit of its hash.  The squared length of the difference of two fingerprints tells how many
  shingles the texts don't share, and from this comes their likeness.

A paragraph is a line with a word in it, without white space at its ends; words are runs of other
characters than blank, tab, line feed, vertical tab, form feed and carriage return.  A paragraph of
fewer than five words is one shingle.  ``likeness`` is 1 for equal fingerprints, else
1 - |a - b|**2 / (|a|**2 + |b|**2) over the lanes, at least 0: the shared part of both texts'
shingles, with a standard error of about 0.09 for unlike texts.

Defined results: a null or empty text, or one of white space, has the fingerprint of nothing, which is
like itself only; repeated rows have a row each; rows are in order of doc_id, then of a hash of the
text, rows without an id first; the last one's next is the first, a single row's next is itself; an
empty table gives an empty result; a very long text is read in segments; other columns may have any names.
Rows that repeat both id and text are one task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmosaic.llm.pieces import chunks
from vecmosaic.llm.shingles import U, mix, pieces, word_hashes

NAMES, LANES = 8, 128
WIDTH = 5
_BLOCK = 1 << 15  # shingles whose bits are unpacked together
_K = U(0xA24BAED4963EE407)
_SHORT = U(0xD1B54A32D192ED03)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@dataclass(frozen=True)
class Fingerprints:
    """The sums of some texts, a row each: names modulo 2**64, lanes modulo 2**32."""

    names: np.ndarray
    lanes: np.ndarray

    def __add__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.names + other.names, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.names - other.names, self.lanes - other.lanes)

    def __getitem__(self, rows: slice | np.ndarray) -> Fingerprints:
        return Fingerprints(self.names[rows], self.lanes[rows])

    def __len__(self) -> int:
        return len(self.names)

    def raw(self) -> list[bytes]:
        return [a.astype("<u8").tobytes() + b.astype("<u4").tobytes() for a, b in zip(self.names, self.lanes, strict=True)]

    def strings(self) -> list[str]:
        return [base64.b64encode(x).decode("ascii") for x in self.raw()]

    @staticmethod
    def of_raw(values: list[bytes]) -> Fingerprints:
        rows = np.frombuffer(b"".join(values), dtype="u1").reshape(-1, 8 * NAMES + 4 * LANES)
        return Fingerprints(np.ascontiguousarray(rows[:, : 8 * NAMES]).view("<u8").astype(U), np.ascontiguousarray(rows[:, 8 * NAMES :]).view("<u4").astype(np.uint32))

    @staticmethod
    def of_strings(values: list[str]) -> Fingerprints:
        return Fingerprints.of_raw([base64.b64decode(x) for x in values])

    @staticmethod
    def of(texts: list[bytes]) -> Fingerprints:
        """The fingerprints of texts in UTF-8."""
        names, lanes = np.zeros((len(texts), NAMES), dtype=U), np.zeros((len(texts), LANES), dtype=np.uint32)
        for row, text in zip(names, texts, strict=True):
            found = [hashlib.blake2b(p, digest_size=8 * NAMES).digest() for x in text.split(b"\n") if (p := x.strip(b" \t\n\v\f\r"))]
            if found:
                row[:] = np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, NAMES).sum(axis=0, dtype=U)
        for a, b in chunks([len(x) for x in texts], 1 << 20):
            # a line feed between two texts parts their paragraphs
            words, paragraph, firsts = _words(texts[a:b])
            shingle, at = _shingles(words, paragraph)
            cuts = np.searchsorted(at, [*firsts, len(words)])
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                lanes[a + k] = _signs(shingle[i:j])
        return Fingerprints(names, lanes)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hash and paragraph of each word, and the first word of each text."""
    hashes, paragraphs, firsts, lines, n = [], [], [], 0, 0
    begins = np.cumsum([0, *[len(x) + 1 for x in texts[:-1]]])
    data, begun = b"\n".join(texts), 0
    for part in pieces(data):
        h, starts = word_hashes(part)
        feeds = np.flatnonzero(np.frombuffer(part, dtype=np.uint8) == 10)
        hashes.append(h)
        paragraphs.append(np.searchsorted(feeds, starts) + lines)
        here = begins[(begins >= begun) & (begins < begun + len(part))]
        firsts += (np.searchsorted(starts, here - begun) + n).tolist()
        lines, n, begun = lines + len(feeds), n + len(h), begun + len(part)
    return np.concatenate(hashes), np.concatenate(paragraphs), firsts + [n] * (len(texts) - len(firsts))


def _shingles(words: np.ndarray, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles within paragraphs, and the word each begins with."""
    n = len(words)
    if not n:
        return words, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.diff(paragraph, prepend=-1))
    size = np.diff(first, append=n)
    out, use = np.zeros(n, dtype=U), np.zeros(n, dtype=bool)
    if n >= WIDTH:
        h = words[: n - WIDTH + 1].copy()
        for j in range(1, WIDTH):
            h = h * _K + words[j : n - WIDTH + 1 + j]
        out[: len(h)] = h
        use[: len(h)] = paragraph[: len(h)] == paragraph[WIDTH - 1 :]
    few = size < WIDTH
    first, size = first[few], size[few]
    h = size.astype(U) * _SHORT
    for j in range(WIDTH - 1):
        h = np.where(j < size, h * _K + words[np.minimum(first + j, n - 1)], h)
    out[first], use[first] = h, True
    at = np.flatnonzero(use)
    return mix(out[at]), at


def _signs(shingle: np.ndarray) -> np.ndarray:
    """The sum over shingles of +1 or -1 in each lane."""
    total = np.zeros(LANES, dtype=np.int64)
    for a in range(0, len(shingle), _BLOCK):
        part = shingle[a : a + _BLOCK]
        wide = np.stack([part, *(mix(part ^ U(0x9E3779B97F4A7C15 * k % (1 << 64))) for k in range(1, LANES // 64))], axis=1).astype("<u8")
        total += 2 * np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32) - len(part)
    return total.astype(np.uint32)


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """How much of their shingles the texts of two rows share, from 0 to 1."""
    x, y = a.lanes.view(np.int32).astype(np.float64), b.lanes.view(np.int32).astype(np.float64)
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.clip(1 - ((x - y) ** 2).sum(axis=1) / np.where(both > 0, both, 1), 0, 1)
    same = (a.names == b.names).all(axis=1) & (a.lanes == b.lanes).all(axis=1)
    return np.where(same, 1.0, np.where(both > 0, near, 0.0))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row per row."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column("body")).to_pylist()):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(Fingerprints.of(part.column("body").to_pylist()).strings(), pa.string())], names=["doc_id", "fingerprint"])

    return narrow.mapInArrow(digest, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def updated(known: DataFrame, changes: DataFrame) -> DataFrame:
    """``known`` (doc_id long, fingerprint) after ``changes`` (doc_id long, paragraph, n): n times inserted, deleted where negative.

    The texts aren't needed.  Vectors are summed in each batch before their shuffle and then a row at a
    time, so a document may have any number of changes.  A document that has only changes begins
    with nothing; null ids, null paragraphs and null numbers are left out; an id that repeats in
    ``known`` has its fingerprints added up.
    """
    state = "doc_id long, sums binary"

    def known_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([base64.b64decode(x) for x in batch.column("fingerprint").to_pylist()], pa.binary())], names=["doc_id", "sums"])

    def change_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column("paragraph")).to_pylist()):
                part = batch.slice(a, b - a)
                one, times = Fingerprints.of(part.column("paragraph").to_pylist()), part.column("n").to_numpy()
                ids, at = np.unique(part.column("doc_id").to_numpy(), return_inverse=True)
                names, lanes = np.zeros((len(ids), NAMES), dtype=U), np.zeros((len(ids), LANES), dtype=np.uint32)
                np.add.at(names, at, one.names * times.astype(U)[:, None])
                np.add.at(lanes, at, one.lanes * times.astype(np.uint32)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(Fingerprints(names, lanes).raw(), pa.binary())], names=["doc_id", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            ids, sums = batch.column("doc_id").to_numpy(), Fingerprints.of_raw(batch.column("sums").to_pylist())
            done: list[tuple[int, str]] = []
            for i, k in enumerate(ids.tolist()):
                if total is not None and k != now:
                    done.append((now, total.strings()[0]))
                    total = None
                now, total = k, sums[i : i + 1] if total is None else total + sums[i : i + 1]
            if done:
                yield pa.RecordBatch.from_pylist([{"doc_id": i, "fingerprint": f} for i, f in done], schema=pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())]))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(total.strings())], names=["doc_id", "fingerprint"])

    before = known.where("doc_id is not null and fingerprint is not null").select(F.col("doc_id").cast("long"), "fingerprint").mapInArrow(known_sums, state)
    what = changes.where("doc_id is not null and paragraph is not null and n is not null")
    after = what.select(F.col("doc_id").cast("long"), F.encode("paragraph", "UTF-8").alias("paragraph"), F.col("n").cast("long")).mapInArrow(change_sums, state)
    parallel = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return before.unionByName(after).repartition(parallel, "doc_id").sortWithinPartitions("doc_id").mapInArrow(added, "doc_id long, fingerprint string")


def _buckets(keyed: DataFrame, rows: int, parallel: int, per_bucket: int) -> tuple[Column, Column, int]:
    """The bucket of a row (doc_id, tie) in ascending ranges, whether it is the first row of a bucket, and the last bucket.

    Cuts are keys of rows, drawn by hash; about ``per_bucket`` of them for each range reach the driver.
    """
    every = max(1, rows // (parallel * per_bucket))
    drawn = keyed.where(F.pmod(F.xxhash64("doc_id", "tie", F.lit(41)), F.lit(every)) == 0).select("doc_id", "tie").distinct()
    keys = sorted(((r.doc_id is not None, r.doc_id or 0, r.tie) for r in drawn.collect()))
    nulls, low = keyed.agg(F.count(F.when(F.col("doc_id").isNull(), 1)), F.min("doc_id")).first()
    low = None if nulls else low
    least = (low is not None, low or 0, keyed.where(F.col("doc_id").eqNullSafe(F.lit(low))).agg(F.min("tie")).first()[0])
    cuts = sorted({keys[i * len(keys) // parallel] for i in range(1, parallel)} - {least}) if keys else []
    kind = "array<struct<named:boolean,doc_id:bigint,tie:bigint>>"
    literal = F.array(*[F.struct(F.lit(a), F.lit(b).cast("long"), F.lit(c).cast("long")) for a, b, c in cuts]).cast(kind) if cuts else F.array().cast(kind)
    key = F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("tie"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(cuts).bit_length())))])
    # the number of cuts up to the key, by halving
    bucket = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(literal, n + s - 1) <= key, n + s).otherwise(n))
    first = F.struct(F.lit(least[0]).alias("named"), F.lit(least[1]).cast("long").alias("doc_id"), F.lit(least[2]).cast("long").alias("tie"))
    opening = F.coalesce(F.get(literal, F.col("bucket") - 1) == key, F.lit(False)) | (key == first)
    return bucket, opening, len(cuts)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_bucket: int = 40) -> DataFrame:
    """RESULT rows: each text's fingerprint, that of its edited form, and its likeness to this and to the next text.

    The edited form has the second half of a text's code points (rounded down) replaced by as many from the
    beginning of the next text.  Its fingerprint comes from the text's by taking away the
    paragraphs from the cut on and adding those that stand there instead.

    Texts are shuffled once into ascending ranges.  The first row of each range also goes to the
    end of the range before it, the very first one to the end of the last.
    """
    spark = docs.sparkSession
    parallel = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    count = keyed.count()
    if not count:
        return spark.createDataFrame([], RESULT)
    bucket, opening, last = _buckets(keyed, count, parallel, per_bucket)
    placed = keyed.withColumn("bucket", bucket)
    openers = placed.where(opening).groupBy("bucket", "doc_id", "tie").agg(F.min("text").alias("text"))
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    guests = openers.select("doc_id", "text", "tie", before.alias("bucket"), F.lit(True).alias("guest"))
    rows = placed.select("doc_id", "text", "tie", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    ranges = rows.repartitionById(parallel, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), "tie", "text")
    return ranges.select("doc_id", "text", "guest").mapInArrow(_edited, RESULT)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each range with the row after it as a guest at its end."""
    ids: list[int | None] = []
    texts: list[str] = []
    guest: list[bool] = []
    for batch in batches:
        for a, b in chunks(pc.binary_length(batch.column("text")).to_pylist(), 4 << 20):
            part = batch.slice(a, b - a)
            ids += part.column("doc_id").to_pylist()
            texts += part.column("text").to_pylist()
            guest += part.column("guest").to_pylist()
            own = [k for k in range(len(ids) - 1) if not guest[k]]
            if own:
                yield _compared(ids, texts, own)
            ids, texts, guest = ids[-1:], texts[-1:], guest[-1:]


def _compared(ids: list[int | None], texts: list[str], own: list[int]) -> pa.RecordBatch:
    kept, gone, come, digests, sizes = [], [], [], [], []
    for k in own:
        text, size = texts[k], len(texts[k])
        cut = size - size // 2
        line = text.rfind("\n", 0, cut) + 1
        new = texts[k + 1][: size // 2]
        kept.append(text[:line].encode())
        gone.append(text[line:].encode())
        come.append((text[line:cut] + new).encode())
        digests.append(hashlib.sha256((text[:cut] + new).encode()).hexdigest())
        sizes.append(size)
    alone = sorted({k + 1 for k in own} - set(own))
    n = len(own)
    parts = Fingerprints.of([*kept, *gone, *come, *[texts[k].encode() for k in alone]])
    whole = parts[:n] + parts[n : 2 * n]
    edited = whole - parts[n : 2 * n] + parts[2 * n : 3 * n]
    place = {k: i for i, k in enumerate([*own, *alone])}
    everyone = Fingerprints(np.concatenate([whole.names, parts.names[3 * n :]]), np.concatenate([whole.lanes, parts.lanes[3 * n :]]))
    following = everyone[np.array([place[k + 1] for k in own])]
    cols = [ids[k] for k in own], sizes, digests, whole.strings(), edited.strings(), likeness(whole, edited), likeness(whole, following)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
