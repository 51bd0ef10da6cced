"""Alignment of two tokenizers over a corpus, with counts of linked id pairs.

A is a byte-level BPE of the tokenizers library applied to a blank and the text, B a SentencePiece model, which
adds the blank itself.  Both sequences of tokens spell the same bytes; places where a token of each
ends cut them into groups, and tokens of one group are linked.  An id pair's count is the number
of documents that hold it linked.

1. Each text is encoded once.  Its distinct linked pairs, an id of A and one of B packed in an int64, are kept
   with their numbers of links.
2. np.unique counts the pairs of each partition; these partial counts are sorted globally by ranges of the
   packed key, and equal neighbours are summed while a range is written as one shard: a file of
   sorted keys and a file of their counts.
3. Each document's pairs are looked up by searchsorted in the shards, which are mapped into memory
   where the shared folder is a mounted one; from another store one shard at a time is read.

An id pair has at most one row from each batch of partial counts, so no key is hot.  The driver holds a row for each
shard and the highest count of each id of A, whose number is the size of the vocabulary.  A group of very many
tokens is reduced to its distinct ids, and pairs are made some at a time.

Defined results: a null or empty text, and one whose tokens don't spell a blank and the text, has no tokens and counts
nowhere; repeated rows are documents of their own; strings of special tokens are plain text; a null doc_id stays
null; an empty table gives an empty result; a very long text is encoded whole; other columns may have any names.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.llm.files import new_folder, reader, writer
from vecmosaic.operators.grouped import runs
from vecmosaic.llm.piece_fst import PieceModel, _fields
from vecmosaic.llm.pieces import PieceCoder, chunks
from vecmosaic.llm.token_store import PieceEncoder
from vecmosaic.session import written

_SHIFT = 32


@dataclass(frozen=True)
class AlignmentOptions:
    bytes_model: str  # a byte-level BPE file of the tokenizers library
    piece_model: str  # a SentencePiece model
    cached_pieces: int = 300_000
    batch_links: int = 4_000_000  # links of a group, and pairs of documents, handled together


class SpacedEncoder(PieceEncoder):
    """Ids of a blank and the text; strings of special tokens are plain text."""

    def __init__(self, path: str, cached: int):
        super().__init__(path, cached)
        self.tok.encode_special_tokens = True
        self.head, self.skip = "", 0  # a text's first piece follows the blank

    def whole(self, texts: list[str]) -> list[bytes]:
        return self._plain([" " + t for t in texts])


class LibraryPieces(PieceCoder):
    """Ids by the SentencePiece library, kept for pieces between single blanks and line feeds.

    Such pieces are independent of each other in a merge-based model that leaves texts as they are, whose pieces have
    the blank's sign at their head only and no line feed; with any other model every text goes to the library whole.
    """

    def __init__(self, path: str, cached: int):
        import sentencepiece

        super().__init__(cached)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.width, self.code = (2, "H") if self.model.get_piece_size() <= 1 << 16 else (4, "I")
        self.apart_unless = "\\A[ \n]| \\z|  | \n|\n |▁|\0" if self._free(path) else r"(?s)."
        self.blank = self.model.piece_to_id("▁")

    def _free(self, path: str) -> bool:
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        trainer, normaliser = ({k: v for field, value in fields if field == n for k, v in _fields(value)} for n in (2, 3))
        user = any(dict(_fields(value)).get(3) == PieceModel.USER for field, value in fields if field == 1)
        plain = not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1) and not trainer.get(24, 0)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        return bool(trainer.get(3) == PieceModel.MERGES and plain and not user and "▁" in pieces and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces))

    def learn(self, names: list[str]) -> None:
        for name, ids in zip(names, self.model.encode(names, num_threads=1), strict=True):
            if name[0] == "\n":  # no blank stands before a line feed
                if ids[0] != self.blank:
                    raise ValueError("the model joins a blank with a line feed")
                ids = ids[1:]
            self.cache[name] = array(self.code, ids).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, ids).tobytes() for ids in self.model.encode(texts, num_threads=1)]


def byte_table(tok) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, whose letters stand for one byte each."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    table = [b""] * tok.get_vocab_size()
    for token, i in tok.get_vocab().items():
        table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return table


def piece_table(model) -> list[bytes]:
    """The bytes of each id of a SentencePiece vocabulary: byte pieces are a byte, U+2581 is a blank."""
    pieces = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]


class Aligner:
    """Both tokenizers and what is known of their ids; built once in each worker process."""

    def __init__(self, options: AlignmentOptions):
        self.options = options
        self.a, self.b = SpacedEncoder(options.bytes_model, options.cached_pieces), LibraryPieces(options.piece_model, options.cached_pieces // 2)
        tables = byte_table(self.a.tok), piece_table(self.b.model)
        self.bytes_a, self.bytes_b = (pa.array(t, pa.large_binary()) for t in tables)
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in tables)
        self.kinds = ["<u2" if x.width == 2 else "<u4" for x in (self.a, self.b)]
        # what an id is written as, when its group goes on and when it ends there
        names = [f"{i}{end}" for t, ends in zip(tables, (",|", ",;"), strict=True) for i in range(len(t)) for end in ends]
        self.written = pa.array(names, pa.large_string())

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text by both; none where they don't spell a blank and the text."""
        none = np.zeros(0, dtype=np.int64)
        for text, *raw in zip(texts.cast(pa.binary()), self.a(texts), self.b(texts), strict=True):
            body = b" " + (text.as_py() or b"")
            one, two = (np.frombuffer(x, dtype=kind).astype(np.int64) for x, kind in zip(raw, self.kinds, strict=True))
            good = len(body) > 1 and joined(self.bytes_a, one) == body and joined(self.bytes_b, two) == body
            yield (one, two) if good else (none, none)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of both."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.zeros(end_a[-1] + 1, dtype=bool)
        at[end_a] = True
        shared = at[end_b]  # tokens of B that end a group
        cut = end_b[shared]
        return np.searchsorted(cut, end_a), np.cumsum(shared) - shared

    def text_of(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> memoryview:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        n = np.bincount(in_a), np.bincount(in_b)
        before_a, before_b = np.cumsum(n[0]), np.cumsum(n[1]) - n[1]
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + before_b[in_a]] = 2 * a + (np.diff(in_a, append=-1) != 0)
        codes[np.arange(len(b)) + before_a[in_b]] = 2 * (len(self.bytes_a) + b) + (np.diff(in_b, append=-1) != 0)
        return joined(self.written, codes)[:-1]

    def pairs(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct packed id pairs, ascending, and the number of links of each."""
        n_a, n_b = np.bincount(in_a), np.bincount(in_b)
        times_a, times_b = np.ones(len(a), dtype=np.int64), np.ones(len(b), dtype=np.int64)
        if int((n_a * n_b).max()) > 64:  # then the group's distinct ids are far fewer, or may be
            (in_a, a, times_a), (in_b, b, times_b) = _counted(in_a, a), _counted(in_b, b)
            n_b = np.bincount(in_b)
        first_b, links = np.cumsum(n_b) - n_b, n_b[in_a]
        if len(times_a) == len(times_b) == len(links) == len(n_b) and (n_b == 1).all():  # one of each in every group
            return summed(a << _SHIFT | b, times_a * times_b)
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for i, j in chunks(links.tolist(), self.options.batch_links):
            left = np.repeat(np.arange(i, j), links[i:j])
            right = np.arange(len(left)) - np.repeat(np.cumsum(links[i:j]) - links[i:j], links[i:j]) + first_b[in_a[left]]
            keys, counts = summed(np.concatenate([keys, a[left] << _SHIFT | b[right]]), np.concatenate([counts, times_a[left] * times_b[right]]))
        return keys, counts


def joined(table: pa.Array, at: np.ndarray) -> memoryview:
    """The bytes of the table's values at these places, one after the other."""
    if not len(at):
        return memoryview(b"")
    taken = table.take(pa.array(at))
    _, ends, data = taken.buffers()
    return memoryview(data).cast("B")[: int(np.frombuffer(ends, dtype="<i8")[len(at)])]


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = np.unique(group << _SHIFT | ids, return_counts=True)
    return keys >> _SHIFT, keys & ((1 << _SHIFT) - 1), counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if len(counts) and counts.min() == counts.max():  # then their order doesn't matter
        keys, one = np.sort(keys), counts[0]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.diff(first, append=len(keys)) * one
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


@functools.lru_cache(maxsize=1)
def shared_aligner(options: AlignmentOptions) -> Aligner:
    """One for all tasks of a worker process."""
    return Aligner(options)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, links binary"


def aligned(docs: DataFrame, options: AlignmentOptions, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """ALIGNED, one row per row: sizes, a digest of the groups, and the distinct pairs with their numbers of links.

    ``keys`` holds ascending int64, ``links`` uint32, little-endian and compressed.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        one, pack = shared_aligner(options), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column("text")
            for i, j in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 4 << 20):
                rows = []
                for a, b in one.encoded(texts.slice(i, j - i)):
                    if not len(a):
                        rows.append((0, 0, 0, 0, "", b"", b""))
                        continue
                    in_a, in_b = one.groups(a, b)
                    keys, links = one.pairs(a, b, in_a, in_b)
                    digest = hashlib.sha256(one.text_of(a, b, in_a, in_b)).hexdigest()
                    rows.append((len(a), len(b), int(in_b[-1]) + 1, int(links.sum()), digest, pack.compress(_columns(keys)), pack.compress(links.astype("<u4").tobytes())))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *cols], names=[x.split()[0] for x in ALIGNED.split(", ")])

    return narrow.mapInArrow(align, ALIGNED)


def _columns(keys: np.ndarray) -> bytes:
    """Steps between sorted keys, byte by byte: first bytes of all, second bytes of all, and so on."""
    return np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _pairs_of(batch: pa.RecordBatch, links: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    none = np.zeros(0, dtype=np.int64)
    for i, raw in enumerate(batch.column("keys")):
        if not (x := raw.as_py()):
            yield none, none
        else:
            yield _keys(unpack.decompress(x)), np.frombuffer(unpack.decompress(batch.column("links")[i].as_py()), dtype="<u4").astype(np.int64) if links else None


def pair_counts(rows: DataFrame, options: AlignmentOptions) -> DataFrame:
    """(key, n): partial counts of the pairs of ALIGNED rows, one for each key and batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

        keys, counts, wait, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate(wait), return_counts=True)
            return summed(np.concatenate([keys, new]), np.concatenate([counts, times]))

        for batch in batches:
            for k, _ in _pairs_of(batch, False):
                wait.append(k)
                held += len(k)
                if held >= options.batch_links:
                    keys, counts = merged()
                    wait, held = [], 0
                    if len(keys) >= options.batch_links:
                        yield out(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        if wait:
            keys, counts = merged()
        if len(keys):
            yield out(keys, counts)

    return rows.select("keys").mapInArrow(count, "key long, n long")


SHARDS = "path string, pairs long, first long, last long, best binary"


def write_shards(counts: DataFrame, folder: str | None = None) -> DataFrame:
    """Partial counts (key, n) as sorted shards; SHARDS rows, whose ``best`` holds the highest count of each id of A.

    Key ranges don't overlap.  A task that is run again writes under another name; only files in the
    returned table count.
    """
    spark = counts.sparkSession
    folder = folder or new_folder(spark, "pair-counts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}"
        files = first = last = None
        pairs, best = 0, {}
        for table in runs(batches, "key"):  # whole runs of equal keys
            keys, n = summed(table.column("key").to_numpy(), table.column("n").to_numpy())
            if files is None:
                files, first = (writer(path + ".keys"), writer(path + ".counts")), int(keys[0])
            files[0].write(keys.astype("<i8").tobytes())
            files[1].write(n.astype("<i8").tobytes())
            pairs, last = pairs + len(keys), int(keys[-1])
            a = keys >> _SHIFT
            at = np.flatnonzero(np.diff(a, prepend=-1))
            for i, m in zip(a[at].tolist(), np.maximum.reduceat(n, at).tolist(), strict=True):
                best[i] = max(best.get(i, 0), m)
        if files:
            for f in files:
                f.close()
            top = np.array(sorted(best.items()), dtype="<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([pairs], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([top], pa.binary())], names=["path", "pairs", "first", "last", "best"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return written(counts.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(write, SHARDS), "count-shards")


class CountShards:
    """Lookup of counts in sorted shards (path, pairs, last)."""

    def __init__(self, shards: list[tuple[str, int, int]]):
        self.shards = sorted(shards, key=lambda x: x[2])
        self.lasts = np.array([x[2] for x in self.shards], dtype=np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _arrays(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k in self.open:
            return self.open[k]
        path, pairs, _ = self.shards[k]
        if path.startswith("file:"):
            found = tuple(np.memmap("/" + path.removeprefix("file:").lstrip("/") + end, dtype="<i8", mode="r", shape=(pairs,)) for end in (".keys", ".counts"))
            self.open[k] = found
            return found
        read = []
        for end in (".keys", ".counts"):
            with reader(path + end) as f:
                read.append(np.frombuffer(f.read(), dtype="<i8"))
        return read[0], read[1]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ascending keys that are all in the shards."""
        out, cuts = np.zeros(len(keys), dtype=np.int64), np.searchsorted(keys, self.lasts, side="right").tolist()
        for k, (i, j) in enumerate(zip([0, *cuts], cuts, strict=False)):
            if i < j:
                have, n = self._arrays(k)
                at = np.minimum(np.searchsorted(have, keys[i:j]), len(have) - 1)
                if (have[at] != keys[i:j]).any():
                    raise ValueError(f"a pair isn't in {self.shards[k][0]}")
                out[i:j] = n[at]
        return out


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_counts(docs: DataFrame, options: AlignmentOptions, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT, one row per row: sizes, links whose pair is the most frequent of its id of A, and the sum of counts over links."""
    rows = written(aligned(docs, options, doc_id, text), "alignments")
    shards = write_shards(written(pair_counts(rows, options), "partial-counts")).collect()  # a row per shard
    known = [(r["path"], r["pairs"], r["last"]) for r in shards]
    each = [np.frombuffer(r["best"], dtype="<i8").reshape(-1, 2) for r in shards]
    size = max((int(x[-1, 0]) + 1 for x in each), default=0)
    best = np.zeros(size, dtype=np.int64)  # an entry per id of A
    for x in each:
        best[x[:, 0]] = np.maximum(best[x[:, 0]], x[:, 1])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = CountShards(known)
        for batch in batches:
            for i, j in chunks(batch.column("n_links").to_pylist(), options.batch_links):
                part = batch.slice(i, j - i)
                pairs = list(_pairs_of(part, True))
                keys, links = (np.concatenate([x[c] for x in pairs]) for c in (0, 1))
                distinct, at = np.unique(keys, return_inverse=True)
                n = counts(distinct)
                top = n == best[distinct >> _SHIFT]
                row = np.repeat(np.arange(len(pairs)), [len(k) for k, _ in pairs])
                n_best, total = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
                np.add.at(n_best, row, np.where(top[at], links, 0))
                np.add.at(total, row, links * n[at])
                own = [part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_best), pa.array(total), part.column("groups_sha256")], names=[x.split()[0] for x in RESULT.split(", ")])

    return rows.mapInArrow(look, RESULT)
