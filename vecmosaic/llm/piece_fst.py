"""Subword pieces by weighted finite-state transducers.

Four machines are compiled from the model file.  The *normaliser* maps the longest entry of the
character map at each place and writes blanks as the piece alphabet's blank.  The *piece machine*
is a trie whose states read a character each; from a state that ends a piece an arc without input
goes back to the start, puts out the piece and costs its negated score.  The *fallback* puts out
the bytes of a character without a piece, or the unknown piece.  The *neighbour acceptor* reads
pieces: its state is the last one, and it has an arc for each piece that may follow.  A model that
is no more than its scores has one state there; for a merge-based model the arcs are the pairs
that the merges alone would leave standing, each at no cost.

Encoding composes these machines with the input and takes the path of least cost.  Composed states
are (place, acceptor state); since all arcs lead to later places, they are relaxed in that order
with (min, +).  The acceptor of a merge-based model lets exactly one path reach each place, so
there the search is linear.  Decoding reads the piece machine backwards.

No merge crosses a blank that follows another character, nor a character without a piece, so for
merge-based models the composition runs segment by segment and the paths of segments are kept in a
bounded cache.  Costs of the other models are added in single precision in the order of the path,
as the format defines them, over the whole text.

Defined results: a null or empty text has no pieces; repeated rows are encoded one by one; an
empty table gives an empty result; very long texts and segments are encoded whole; other columns
are left alone, whatever their names.  The blank of the piece alphabet decodes to a blank even
where the text had it.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.llm.pieces import PieceCoder, chunks

BLANK = "▁"
_SIGNS = ".,;:!?#$%&*|<>()[]'\"-"


@dataclass(frozen=True)
class PieceOptions:
    model: str
    cached_segments: int = 600_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Normaliser:
    """The longest entry of a character map at each place, as a trie over bytes with an output at each entry's end."""

    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool, escape: bool):
        self.arcs: list[dict[int, int]] = [{}]
        self.out: dict[int, str] = {}
        self.prefix, self.squeeze, self.escape = prefix, squeeze, escape
        if charsmap:
            self._compile(charsmap)
        self.identity = not self.out

    def _compile(self, charsmap: bytes) -> None:
        """Entries of a double-array trie: units of 32 bits, then outputs that end in a zero byte."""
        size = int.from_bytes(charsmap[:4], "little")
        units, outputs = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist(), charsmap[4 + size :]
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        todo = [(offset(units[0]), 0)]
        while todo:
            at, state = todo.pop()
            for c in range(1, 256):
                if at ^ c >= len(units):
                    continue
                u = units[at ^ c]
                if u & 0x800000FF != c:
                    continue
                self.arcs[state][c] = new = len(self.arcs)
                self.arcs.append({})
                below = (at ^ c) ^ offset(u)
                if u >> 8 & 1:
                    first = units[below] & 0x7FFFFFFF
                    self.out[new] = outputs[first : outputs.index(b"\0", first)].decode()
                todo.append((below, new))

    def _parts(self, text: str) -> Iterator[str]:
        if self.identity:
            yield from text
            return
        data, at = text.encode("utf-8", "surrogatepass"), 0
        while at < len(data):
            state, end, out, k = 0, 0, "", at
            while k < len(data) and (state := self.arcs[state].get(data[k], -1)) >= 0:
                k += 1
                if state in self.out:
                    end, out = k, self.out[state]
            if not end:
                lead = data[at]
                end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
                out = data[at:end].decode("utf-8", "surrogatepass")
            yield out
            at = end

    def __call__(self, text: str) -> str:
        if self.squeeze:
            out: list[str] = []
            after_blank = True
            for part in self._parts(text):
                if after_blank:
                    part = part.lstrip(" ")
                if part:
                    out.append(part)
                    after_blank = part.endswith(" ")
            text = "".join(out).rstrip(" ")
        elif not self.identity:
            text = "".join(self._parts(text))
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        return text.replace(" ", BLANK) if self.escape else text


class PieceMachine:
    """A trie over characters: a state maps a character to (state, piece, cost), where the piece that ends
    there goes out on the arc back to the start; -1 for none."""

    def __init__(self) -> None:
        self.start: dict[str, tuple[dict, int, float]] = {}

    def add(self, text: str, piece: int, cost: float) -> None:
        state = self.start
        for c in text[:-1]:
            if c not in state:
                state[c] = {}, -1, 0.0
            state = state[c][0]
        state[text[-1]] = state.get(text[-1], ({},))[0], piece, cost


_SHIFT = 24  # of the state in an acceptor's key


class Acceptor(dict):
    """Arcs by ``(state + 1) << _SHIFT | piece``, found when first asked for: the state after, or -2 for none.

    The first state is -1, which ``follows`` is never asked about: any piece may come first.
    """

    def __init__(self, follows: Callable[[int, int], bool], limit: int = 1_000_000):
        super().__init__()
        self.follows, self.limit = follows, limit

    def __missing__(self, key: int) -> int:
        last, piece = (key >> _SHIFT) - 1, key & ((1 << _SHIFT) - 1)
        if len(self) >= self.limit:
            self.clear()
        self[key] = after = piece if last < 0 or self.follows(last, piece) else -2
        return after


class OneState(dict):
    """The acceptor of all sequences."""

    def __missing__(self, key: int) -> int:
        return -1


def shortest_path(text: str, machine: PieceMachine, acceptor: Acceptor | OneState, unknown: float) -> list[int]:
    """The pieces on the path of least cost through input, piece machine and acceptor composed.

    A character without a piece of its own costs ``unknown`` and puts out -1, after which the
    acceptor begins anew.  Of paths that cost the same the one that was reached first stays.
    """
    n, start = len(text), machine.start
    reached: list[dict[int, tuple[float, int, int, int]] | None] = [None] * (n + 1)  # cost, place and state before, piece
    reached[0] = {-1: (unknown - unknown, 0, -1, -1)}
    for i in range(n):
        here = reached[i]
        if here is None:
            continue
        state, j, alone = start, i, False
        for c in text[i:] if n - i < 64 else (text[k] for k in range(i, n)):
            arc = state.get(c)
            if arc is None:
                break
            state, piece, cost = arc
            j += 1
            if piece < 0:
                continue
            if j == i + 1:
                alone = True
            for last, before in here.items():
                after = acceptor[last + 1 << _SHIFT | piece]
                if after == -2:
                    continue
                there = reached[j]
                if there is None:
                    reached[j] = {after: (before[0] + cost, i, last, piece)}
                else:
                    total, old = before[0] + cost, there.get(after)
                    if old is None or total < old[0]:
                        there[after] = total, i, last, piece
        if not alone:
            there = reached[i + 1]
            if there is None:
                there = reached[i + 1] = {}
            for last, before in here.items():
                total, old = before[0] + unknown, there.get(-1)
                if old is None or total < old[0]:
                    there[-1] = total, i, last, -1
    if not reached[n]:
        raise ValueError("no path: the acceptor lets no sequence of pieces through")
    path, place, state = [], n, min(reached[n], key=lambda q: reached[n][q][0])
    while place:
        _, before, last, piece = reached[place][state]
        path.append(piece)
        place, state = before, last
    return path[::-1]


class PieceModel:
    """The machines compiled from a model file."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the file format
    UNIGRAM, MERGES = 1, 2  # kinds of models
    PENALTY = 10.0  # of an unknown character, below the least score

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        settings: dict[int, int] = {}
        spec: dict[int, int | bytes] = {}
        for field, value in _fields(data):
            if field == 1:
                one = dict(_fields(value))
                self.pieces.append(one[1].decode())
                self.scores.append(float(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(one.get(3, self.NORMAL))
            elif field == 2:
                settings = {k: v for k, v in _fields(value) if isinstance(v, int)}
            elif field == 3:
                spec = dict(_fields(value))
        self.type = settings.get(3, self.UNIGRAM)
        self.normaliser = Normaliser(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        self.prefix = self.normaliser.prefix
        if self.type not in (self.UNIGRAM, self.MERGES) or self.USER in self.kinds or settings.get(24, 0):
            raise ValueError("only unigram and merge-based models without user-defined pieces or blanks as suffixes are compiled")
        self.merges = self.type == self.MERGES
        self.unknown = self.kinds.index(self.UNKNOWN) if self.UNKNOWN in self.kinds else 0
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.BYTE} if settings.get(35, 0) else {}
        if self.merges and not self.bytes:
            raise ValueError("a merge-based model needs byte fallback here")
        #: What each piece gives when decoded; control pieces give nothing.
        self.output = [
            bytes([int(p[1:-1], 16)]) if k == self.BYTE else p.replace(BLANK, " ").encode() if k == self.NORMAL else " ⁇ ".encode() if k == self.UNKNOWN else b""
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        order = sorted((i for i, k in enumerate(self.kinds) if k == self.NORMAL), key=lambda i: (-self.scores[i], i))
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.inside = "".join(sorted({c for p in self.rank for c in p}))
        self.known = frozenset(self.inside)
        self.split = {p: self._last_merge(p) for p in self.rank if len(p) > 1} if self.merges else {}
        self.machine = PieceMachine()
        kind = float if self.merges else np.float32
        for i in order:
            if not self.merges or len(self.pieces[i]) == 1 or self.split[self.pieces[i]]:
                self.machine.add(self.pieces[i], i, -kind(self.scores[i]))
        self.unknown_cost = -(kind(min((self.scores[i] for i in order), default=0.0)) - kind(self.PENALTY))
        self._left: dict[str, list[tuple[str, float]]] = {}
        self._right: dict[str, list[tuple[str, float]]] = {}
        self.acceptor = Acceptor(lambda last, piece: self.neighbours(self.pieces[last], self.pieces[piece])) if self.merges else OneState()
        self.free = self.merges and self.normaliser.identity and not self.normaliser.squeeze and self.normaliser.escape and BLANK in self.rank and not any(BLANK in p.lstrip(BLANK) for p in self.rank) and "\n" not in self.known

    def path(self, text: str) -> list[int]:
        """The pieces of normalised text, with -1 for an unknown character."""
        return shortest_path(text, self.machine, self.acceptor, self.unknown_cost)

    def encode(self, text: str) -> list[int]:
        """The ids of normalised text: unknown characters as their bytes, or a run of them as one unknown piece."""
        path = self.path(text)
        if -1 not in path:
            return path
        out: list[int] = []
        at, before = 0, 0
        for piece in path:
            if piece >= 0:
                out.append(piece)
                at += len(self.pieces[piece])
            else:
                if self.bytes:
                    out += [self.bytes[b] for b in text[at].encode("utf-8", "surrogatepass")]
                elif before >= 0:
                    out.append(self.unknown)
                at += 1
            before = piece if self.bytes or piece < 0 else 0
        return out

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The pair whose merge makes the piece from its characters; none if the merges don't make it."""
        parts, rank, last = list(piece), self.rank, None
        while len(parts) > 1:
            ranks = [rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 60:
                return None
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [last[0] + last[1]]
        return last

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at one end of a piece over the course of its merges, with the rank that ends each."""
        memo = self._left if side == 0 else self._right
        if (got := memo.get(piece)) is None:
            got, until, p = [], float("inf"), piece
            while True:
                got.append((p, until))
                if len(p) == 1:
                    break
                until = self.rank[p]
                p = self.split[p][side]
            memo[piece] = got
        return got

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the merges of a + b alone end in a and b.

        From the finished pieces back to single characters: the two parts that meet at the
        boundary would merge there if that came before either of their own next merges; of equal
        ranks the left one comes first.
        """
        left, right, rank = self._edge(a, 1), self._edge(b, 0), self.rank
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            cross = rank.get(x + y)
            if cross is not None and cross < x_until and cross <= y_until:
                return False
            x_made = rank[x] if len(x) > 1 else -1
            y_made = rank[y] if len(y) > 1 else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made >= y_made:
                i += 1
            else:
                j += 1


class PieceEncoder(PieceCoder):
    """Encodes segments by the shortest path and keeps their ids."""

    def __init__(self, model: PieceModel, cached: int = 600_000):
        super().__init__(cached)
        self.model = model
        self.width, self.code = (2, "H") if len(model.pieces) <= 1 << 16 else (4, "I")
        self.paths: dict[str, list[int]] = {}
        #: Single blanks between other characters; a line feed has no piece, so it always separates.
        self.apart_unless = rf"\A | \z|  | \n|\n |{BLANK}" if model.free and model.prefix else r"(?s)."
        self.segment = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", re.S)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _path(self, text: str) -> list[int]:
        if (path := self.paths.get(text)) is None:
            self.paths[text] = path = self.model.path(text)
        return path

    def learn(self, names: list[str]) -> None:
        """Where the last piece of a segment's letters and the first of the signs after them may be
        neighbours, their two paths together are the path of both."""
        if len(self.paths) > 200_000:
            self.paths.clear()
        cache, model, known = self.cache, self.model, self.model.known
        for name in names:
            text = name if name[:1] == "\n" else BLANK + name
            letters = name.rstrip(_SIGNS)
            if not letters or len(letters) == len(name) or not known.issuperset(text):
                cache[name] = self._packed(model.encode(text))
                continue
            path, after = self._path(BLANK + letters), self._path(name[len(letters) :])
            if model.acceptor[path[-1] + 1 << _SHIFT | after[0]] == -2:
                path, after = model.path(text), []
            cache[name] = self._packed(path + after)

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that don't fall into plain segments."""
        out = []
        for text in map(self.model.normaliser, texts):
            parts = self.segment.findall(text) if self.model.free else [text]
            out.append(b"".join(self._packed(self.model.encode(part)) for part in parts))
        return out


def decode(model: PieceModel, ids: np.ndarray) -> str:
    """The text of ids: the inverse transducer."""
    text = b"".join(map(model.output.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str, cached: int) -> PieceEncoder:
    """One encoder for all tasks of a worker process."""
    with open(path, "rb") as f:
        return PieceEncoder(PieceModel(f.read()), cached)


def encode_pieces(docs: DataFrame, options: PieceOptions, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) with ids as an array, one row per input row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared_encoder(options.model, options.cached_segments)
        for batch in batches:
            for a, b in chunks([len(t) for t in batch.column("text").to_pylist()]):
                ids = one(batch.column("text").slice(a, b - a))
                ends = np.concatenate([[0], np.cumsum([len(x) // one.width for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), one.code).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, options: PieceOptions) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_encoder(options.model, options.cached_segments).model
        for batch in batches:
            texts = [decode(model, np.asarray(x.values)) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(docs: DataFrame, options: PieceOptions, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_bytes, ids_crc32, round_trip): a digest of every document's ids.

    ``n_bytes`` counts pieces of the byte fallback; ``ids_crc32`` is over unsigned 32-bit
    little-endian ids; ``round_trip`` says that decoding gives the text back.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared_encoder(options.model, options.cached_segments)
        model = one.model
        is_byte = np.array([k == PieceModel.BYTE for k in model.kinds])
        for batch in batches:
            column = batch.column("text")
            for a, b in chunks([len(t) for t in column.to_pylist()]):
                texts, ids = column.slice(a, b - a).to_pylist(), [np.frombuffer(x, one.code) for x in one(column.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([decode(model, x) == model.normaliser(t).replace(BLANK, " ")[model.prefix and bool(t) :] for x, t in zip(ids, texts, strict=True)]),
                    ],
                    names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")
