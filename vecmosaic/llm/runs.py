"""Periodic runs of words, found by bit-parallel comparison of a text with itself at a lag.

The ids of a text's words are laid out as bit planes, each one big integer.  At a lag q every
plane is combined with itself shifted by q (XOR) and the results with each other (OR): a zero stands where
words q apart are identical.  Of stretches of such places those of the length needed survive AND
with copies of themselves, shifted by doubling distances; a place left over is the start of one.  A stretch
and the q words after it are a run.

Only lags that some run may have are tried: in a run of smallest period q that is three periods long,
the window of k words at its start, q <= k <= 2 q, stands again q words on and nowhere between, as
its first period isn't a power of a shorter one.  So for k = 16, 32, 64 ... the distances from windows to
their next occurrence (by hashes of doubling width) hold every period from k / 2 to k, as often in a row as
the run is longer than the window.  A hash that meets another only adds a lag to be tried.

Runs of one text may overlap; a period's multiples are the same stretch and aren't runs of their own.
Words are runs of other characters than blank, tab, line feed, vertical tab, form feed and carriage return.

Defined results: a null, empty or blank text has no words and no runs; repeated rows have a row each; a null
doc_id is taken as it is and its text isn't made periodic; ties of the greatest exponent go to the smaller
start, then period; an empty table gives an empty result; a very long text is read whole, in time and memory
about proportional to its words and the number of its different periods; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.llm.shingles import U, mix

LEAST = 24  # words of a run at least
PERIODS = 3  # periods of a run at least
_WINDOW = 16
_K = U(0xA24BAED4963EE407)


def needed(lag: int) -> int:
    """Words in a row that equal the word a lag later, in the shortest run of this period."""
    return max(LEAST - lag, (PERIODS - 1) * lag)


def bit_planes(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the ids; its i-th bit is that of the i-th word."""
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def stretches(planes: list[int], n: int, lag: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of places, ``length`` at least, whose words equal those a lag later."""
    differ = 0
    for p in planes:
        differ |= p ^ (p >> lag)
    same = ~differ & ((1 << (n - lag)) - 1)
    have = 1
    while same and have < length:
        step = min(have, length - have)
        same &= same >> step
        have += step
    if not same:
        return []
    bits = np.unpackbits(np.frombuffer(same.to_bytes((n - lag + 7) // 8, "little"), dtype=np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(bits, prepend=0, append=0))
    return [(a, b + length - 1) for a, b in edge.reshape(-1, 2).tolist()]


def lags(ids: np.ndarray) -> list[int]:
    """Every period that a run may have, ascending."""
    n, k, found = len(ids), _WINDOW, set()
    if n < LEAST:
        return []
    h = mix(ids.astype(U) + U(1))
    width = 1
    while width < k:
        h, width = mix(h[:-width] * _K + h[width:]), 2 * width
    while 3 * (k // 2 + 1) <= n or k == _WINDOW:
        order = np.argsort(h, kind="stable")
        again = h[order[1:]] == h[order[:-1]]
        if not again.any():
            break  # nor does any wider window stand twice
        gap = np.zeros(len(h), dtype=np.int64)
        gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
        cut = np.flatnonzero(np.diff(gap, prepend=-1))
        size, gap = np.diff(cut, append=len(gap)), gap[cut]
        least = np.maximum(np.maximum(LEAST - gap, (PERIODS - 1) * gap) - k + 1, 1)
        fits = (gap > (k // 2 if k > _WINDOW else 0)) & (gap <= k) & (size >= least)
        found |= set(np.unique(gap[fits]).tolist())
        if len(h) <= k:
            break
        h, k = mix(h[:-k] * _K + h[k:]), 2 * k
    return sorted(found)


def word_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    tried = lags(ids)
    if not tried:
        return []
    planes, found = bit_planes(ids), {}
    for q in tried:
        for a, b in stretches(planes, len(ids), q, needed(q)):
            found.setdefault((a, b + q), q)  # at a multiple of its period a run is the same stretch
    return sorted((a, e - a, q) for (a, e), q in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """An id for each word; equal words have equal ids."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    drop = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop[:n]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; the first of equal ones."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in a tenth of the documents periodic from some word on, as their doc_id says."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


RUNS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(words: list[bytes]) -> tuple:
    found = word_runs(numbered(words))
    best = strongest(found)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    left = words if not found else [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
    exact = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(words), len(found), *exact, listed, hashlib.sha256(b" ".join(left)).hexdigest()


def periodic_runs(docs: DataFrame, planted: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: the number of runs, the strongest one, and digests of all runs and of the text cut to first periods.

    ``planted`` makes a tenth of the documents periodic before the search, as their doc_id says.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for i, body in zip(ids, batch.column("body"), strict=True):
                words = body.as_py().split()  # at just these six characters
                rows.append(_digest(made_periodic(words, i) if planted else words))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *(x.split()[0] for x in RUNS.split(", "))])

    return narrow.mapInArrow(search, f"doc_id long, {RUNS}")


def without_repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with each periodic run of their texts cut to its first period.

    A text without runs stays as it is, spacing included; in others words are joined by one blank.
    """
    cols = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            out = []
            for value in batch.column(at).to_pylist():
                words = (value or "").encode().split()
                found = word_runs(numbered(words)) if words else []
                out.append(b" ".join(words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()).decode() if found else value)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.types[at]) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(cut, docs.schema).select(*cols)
