"""Token ids as binary files with a shared zstandard dictionary.

Texts are encoded by the tokenizers library, an end id is appended, and each document's id array
is compressed on its own with one dictionary trained on serialized id arrays.  A file holds the
documents of one range of ids in ascending order and ends in an offset index, so one short
document is read with two small reads; the header names the dictionary by hash.

File layout, all little-endian: magic (8 bytes), SHA-256 of the dictionary (32), bytes per id
(8); the frames; the index as arrays doc_id int64, null flag uint8, offset uint64, size uint32,
ids uint32; index offset uint64, documents uint64, magic.

Encoding goes piece by piece: byte-level BPE with the usual split pattern never joins characters
across a single blank that has non-blank characters on both sides, so the ids of such a piece
don't depend on its neighbours and the library's answer is kept in a bounded cache.  Texts with
other white space or special tokens go to the library whole, and so do all texts where the
tokenizer's file names another normaliser or split.

Defined results: a null or empty text is the end id alone; rows of one doc_id stay together in
the order of their frames; a null doc_id comes first; an empty table gives no file and an empty
result; very long texts are encoded whole; other columns may have any names.  The dictionary is trained on at most ``sample_docs`` rows, at most ``sample_chars``
characters of each; where that is too little for training there is no dictionary.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecmosaic.llm.files import new_folder, reader, writer
from vecmosaic.llm.pieces import OTHER_SPACE, PieceCoder, chunks
from vecmosaic.session import written

MAGIC = b"VMTOKS01"


@dataclass(frozen=True)
class TokenStoreOptions:
    tokenizer: str
    end_id: int = 2
    level: int = 3
    dictionary_bytes: int = 65_536
    sample_docs: int = 1000
    sample_chars: int = 20_000
    cached_pieces: int = 600_000
    read_bytes: int = 8 << 20


#: Marks a piece of signs that follow a letter.
_MARK = "\x01"
#: A letter and the signs after it up to a blank, a line feed or the end: no split pattern joins the two.
_SIGNS = r"(\pL)([!-/:-@\[-`{-~]+)([ \n]|\z)"


def _splits_as_usual(path: str) -> bool:
    """Whether the file's normaliser and split are those for which pieces between single blanks are independent.

    With any other file every text goes to the library whole.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return bool(usual and spec.get("normalizer") is None and spec.get("model", {}).get("type") == "BPE" and not spec["model"].get("continuing_subword_prefix") and not spec["model"].get("end_of_word_suffix"))


class PieceEncoder(PieceCoder):
    """Texts to id bytes; ids of pieces between single blanks or line feeds are kept.

    New pieces go to the library many at a time, joined by line feeds: a line feed between
    non-blank characters is one token of its own, so it also separates the ids.
    """

    def __init__(self, path: str, cached: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(cached)
        self.tok = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.apart_unless = "|".join([r"\A[ \n]| \z|  | \n|\n |\n\n", _MARK, OTHER_SPACE, *special]) if _splits_as_usual(path) else r"(?s)."
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.feed = self._plain(["\n"])[0]
        self.head, self.skip = "\n", len(self.feed)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, bare: list[str]) -> list[bytes]:
        """Ids of pieces without blanks at their ends or line feeds, many in one text."""
        out: list[bytes] = []
        width, kind = self.width, "<u2" if self.width == 2 else "<u4"
        for a in range(0, len(bare), 4096):
            part = bare[a : a + 4096]
            ids = self._plain(["\n".join(part)])[0]
            cuts = (np.flatnonzero(np.frombuffer(ids, dtype=kind) == int.from_bytes(self.feed, "little")) * width).tolist() if len(self.feed) == width else []
            if len(cuts) == len(part) - 1:
                out += [ids[i:j] for i, j in zip([0, *[c + width for c in cuts]], [*cuts, len(ids)], strict=True)]
            else:  # a vocabulary in which the line feed isn't one token
                out += self._plain(part)
        return out

    def prepared(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, _SIGNS, rf"\1 {_MARK}\2\3")

    def learn(self, names: list[str]) -> None:
        cache, feed = self.cache, self.feed
        cache["\n"] = feed
        spaced = [p for p in names if p[0] not in "\n\x01"]
        cache.update(zip(spaced, self._ids([" " + p for p in spaced]), strict=True))
        if len(spaced) < len(names):
            heads = [p for p in names if p[0] == "\n" and p != "\n"]
            cache.update(zip(heads, [feed + v for v in self._ids([p[1:] for p in heads])], strict=True))
            signs = [p for p in names if p[0] == _MARK]
            cache.update(zip(signs, self._plain([p[1:] for p in signs]), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        return self._plain(texts)


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str, cached: int) -> PieceEncoder:
    """One encoder for all tasks of a worker process."""
    return PieceEncoder(path, cached)


def _dictionary(docs: DataFrame, one: PieceEncoder, options: TokenStoreOptions) -> bytes:
    """Trained on a bounded number of rows of bounded length, drawn by hash from all; empty where these are too few."""
    import zstandard

    order = docs.select(F.xxhash64("doc_id", F.lit(29)).alias("order")).orderBy("order").limit(options.sample_docs)
    last = order.agg(F.max("order")).first()[0]  # the ids alone are read for it
    if last is None:
        return b""
    near = docs.where(F.xxhash64("doc_id", F.lit(29)) <= last)
    rows = near.select(F.substring(F.coalesce("text", F.lit("")), 1, options.sample_chars).alias("t")).limit(options.sample_docs).collect()
    samples = [x for x in one(pa.array([r.t for r in rows], pa.string())) if x]
    try:
        return zstandard.train_dictionary(options.dictionary_bytes, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Cuts between ranges of about as many documents; reads the id column alone."""
    at = [i / buckets for i in range(1, buckets)]
    cuts = docs.select(F.percentile_approx("doc_id", at, 10_000)).first()[0] if at else []
    return sorted(set(cuts or []))


def _compressor(dictionary: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class _File:
    """One open token file while it is written."""

    def __init__(self, folder: str, bucket: int, dictionary: bytes, width: int):
        self.path, self.bucket = f"{folder}/{bucket:06d}-{uuid.uuid4().hex}.tok", bucket
        self.out, self.at = writer(self.path), 48
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest() + width.to_bytes(8, "little"))
        self.ids, self.nulls, self.offsets, self.sizes, self.counts = [], [], [], [], []

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.offsets.append(self.at)
        self.sizes.append(len(frame))
        self.counts.append(n)
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> tuple[int, str, int, int]:
        for values, kind in ((self.ids, "<i8"), (self.nulls, "u1"), (self.offsets, "<u8"), (self.sizes, "<u4"), (self.counts, "<u4")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(self.at.to_bytes(8, "little") + len(self.ids).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.bucket, self.path, len(self.ids), sum(self.counts)


@dataclass
class TokenFile:
    """The index of a token file and random access to its documents."""

    path: str
    dictionary: bytes

    def __post_init__(self) -> None:
        self.file = reader(self.path)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        head = self.file.read_at(48, 0)
        if tail[16:] != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{self.path} is not a token file")
        if head[8:40] != hashlib.sha256(self.dictionary).digest():
            raise ValueError(f"{self.path} was written with another dictionary")
        self.width = int.from_bytes(head[40:48], "little")
        index = self.file.read_at(size - 24 - at, at)
        self.arrays, a = [], 0
        for kind in ("<i8", "u1", "<u8", "<u4", "<u4"):
            b = a + n * np.dtype(kind).itemsize
            self.arrays.append(np.frombuffer(index[a:b], dtype=kind))
            a = b
        self.doc_id, self.null, self.offset, self.size, self.count = self.arrays
        self.unpack = _decompressor(self.dictionary)

    def _decoded(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame), dtype="<u2" if self.width == 2 else "<u4").astype("<u4")

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by one read."""
        return self._decoded(self.file.read_at(int(self.size[k]), int(self.offset[k])))

    def documents(self, read_bytes: int) -> Iterator[np.ndarray]:
        """All documents in order, by reads of about ``read_bytes``."""
        a, n = 0, len(self.size)
        while a < n:
            b, first = a, int(self.offset[a])
            while b < n and (b == a or int(self.offset[b]) + int(self.size[b]) - first <= read_bytes):
                b += 1
            block = self.file.read_at(int(self.offset[b - 1]) + int(self.size[b - 1]) - first, first)
            for k in range(a, b):
                s = int(self.offset[k]) - first
                yield self._decoded(block[s : s + int(self.size[k])])
            a = b


def write_tokens(docs: DataFrame, options: TokenStoreOptions, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, bytes]:
    """Write the token files; returns the files in order (bucket, path, n_docs, n_tokens, start) and the dictionary.

    A task that is run again writes under another name; only files in the returned table count.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    folder = folder or new_folder(spark, "tokens")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    here = PieceEncoder(options.tokenizer)
    width, bounds, dictionary = here.width, np.array(_bounds(docs, buckets), dtype="i8"), _dictionary(docs, here, options)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, pack = shared_encoder(options.tokenizer, options.cached_pieces), _compressor(dictionary, options.level)
        end = array(one.code, [options.end_id]).tobytes()
        for batch in batches:
            for a, b in chunks(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                ids = one(batch.column("text").slice(a, b - a), end)
                key = batch.column("doc_id").slice(a, b - a)
                at = np.searchsorted(bounds, key.fill_null(-(1 << 63)).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), key, pa.array([len(x) // one.width for x in ids], pa.int64()), pa.array([pack.compress(x) for x in ids], pa.binary())],
                    names=["bucket", "doc_id", "n_tokens", "frame"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for bucket, key, n, frame in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or now.bucket != bucket:
                    if now:
                        done.append(now.close())
                    now = _File(folder, bucket, dictionary, width)
                now.add(key, n, frame)
        if now:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["bucket", "path", "n_docs", "n_tokens"])

    frames = docs.mapInArrow(encode, "bucket int, doc_id long, n_tokens long, frame binary")
    # ranges are whole in one task each, and sorted there, so a file is written as a stream
    ranges = frames.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id", "frame")
    files = written(ranges.mapInArrow(write, "bucket int, path string, n_docs long, n_tokens long"), "token-files")
    before = F.sum("n_tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")), dictionary


def read_tokens(files: DataFrame, dictionary: bytes, options: TokenStoreOptions) -> DataFrame:
    """A digest row per stored document: doc_id, start, n_tokens and ids_crc32, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                one = TokenFile(path, dictionary)
                sums = np.concatenate([[0], np.cumsum(one.count.astype("i8"))]) + start
                crc = [zlib.crc32(x.tobytes()) for x in one.documents(options.read_bytes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.doc_id, pa.int64(), mask=one.null.astype(bool)), pa.array(sums[:-1], pa.int64()), pa.array(one.count.astype("i8"), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
