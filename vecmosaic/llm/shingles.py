"""Distinct five-word shingles of texts as sorted 64-bit hashes, computed on Arrow batches.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return, after lower-casing A-Z.  A text with fewer words than a shingle is one shingle; a text
without words has none.  A shingle is known by its 64-bit hash, in which each word's bytes are mixed
in turn; no structure of the words makes two of them alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
_LEN = 0xD1B54A32D192ED03
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U)
_LONG = 256  # bytes from which a word is hashed by itself


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its start) of lower-cased bytes, mixed eight bytes at a time."""
    arr = np.frombuffer(data, dtype=np.uint8)
    word = ~_SPACE[arr]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=U), starts
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=data + bytes(8), strides=(1,))
    size = ends - starts
    h = mix(mix(size.astype(U) * U(_LEN)) ^ (eights[starts] & _MASK[np.minimum(size, 8)]))
    live, k = np.flatnonzero((size > 8) & (size < _LONG)), 8
    while len(live):
        left = size[live] - k
        h[live] = mix(h[live] ^ (eights[starts[live] + k] & _MASK[np.minimum(left, 8)]))
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(size >= _LONG).tolist():
        h[i] = U(int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little"))
    return h, starts


def pieces(data: bytes) -> Iterator[bytes]:
    """Long data in segments that end at white space."""
    a = 0
    while len(data) - a > 2 * SEGMENT:
        b = max((data.rfind(c, a, a + SEGMENT) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")), default=-1)
        b = b + 1 if b >= a else len(data)
        yield data[a:b]
        a = b
    yield data[a:]


def _sets_of(words: np.ndarray, firsts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles for documents whose words begin at ``firsts``."""
    bounds = [*firsts.tolist(), len(words)]
    k = U(0xA24BAED4963EE407)
    h = None
    if len(words) >= width:
        h = words[: len(words) - width + 1].copy()
        for j in range(1, width):
            h = h * k + words[j : len(words) - width + 1 + j]
        h = mix(h)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= width:
            yield np.unique(h[a : b - width + 1])
        elif b > a:
            one = U(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    one = one * k + w
                one = one + U(b - a) * U(_LEN)
            yield mix(np.array([one], dtype=U))
        else:
            yield np.zeros(0, dtype=U)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """One sorted array of distinct shingle hashes per text, about a megabyte of text at a time."""
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b]) <= SEGMENT):
            n += len(texts[b]) + 1
            b += 1
        if b == a + 1:
            words = np.concatenate([word_hashes(x)[0] for x in pieces(texts[a].lower())])
            yield from _sets_of(words, np.zeros(1, dtype=np.int64), width)
        else:
            words, starts = word_hashes(b" ".join(texts[a:b]).lower())
            begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts[a : b - 1]])])
            yield from _sets_of(words, np.searchsorted(starts, begins), width)
        a = b
