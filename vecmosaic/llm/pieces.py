"""Ids of texts from the ids of their pieces between single blanks and line feeds.

A coder says which texts fall into independent pieces and codes new pieces; here the pieces of
many texts are counted once with Arrow's dictionaries and their ids are put in place by index.
Known pieces are kept in two halves: when the newer one is full it becomes the older one, and
what is asked for again comes back from there.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the blank and the line feed, as a pattern.
OTHER_SPACE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def chunks(sizes: list[int], total: int = 12 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``total`` together."""
    a = n = 0
    for i, size in enumerate(sizes):
        n += size
        if n >= total:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


class PieceCoder:
    """Base of the coders.

    ``apart_unless`` is a pattern that texts have whose pieces aren't independent; ``head`` marks a
    text's first piece and ``skip`` is the bytes it adds.
    """

    width, head, skip, apart_unless = 2, "", 0, ""

    def __init__(self, cached: int):
        self.cached = cached
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def prepared(self, texts: pa.Array) -> pa.Array:
        """Texts with further blanks where pieces can be cut."""
        return texts

    def learn(self, names: list[str]) -> None:
        """Put new pieces into the cache; one that doesn't begin with a line feed follows a blank."""
        raise NotImplementedError

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that don't fall into pieces."""
        raise NotImplementedError

    def _values(self, names: list[str]) -> list[bytes]:
        if len(self.cache) > self.cached:
            self.cache, self.old = {}, self.cache
        values = list(map(self.cache.get, names))
        gaps = [i for i, v in enumerate(values) if v is None]
        if gaps:
            asked = [names[i] for i in gaps]
            before = list(map(self.old.get, asked))
            self.cache.update([(p, v) for p, v in zip(asked, before, strict=True) if v is not None])
            self.learn([p for p, v in zip(asked, before, strict=True) if v is None])
            for i, v in zip(gaps, map(self.cache.__getitem__, asked), strict=True):
                values[i] = v
        return values

    def __call__(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """The id bytes of each text, each followed by ``end``.

        Nothing here makes reference cycles, and many small objects would only set the collector off.
        """
        on = gc.isenabled()
        gc.disable()
        try:
            return self._coded(texts, end)
        finally:
            if on:
                gc.enable()

    def _coded(self, texts: pa.Array, end: bytes) -> list[bytes]:
        texts = texts.fill_null("")
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        apart = full & ~pc.match_substring_regex(texts, self.apart_unless).to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        rest = np.flatnonzero(full & ~apart).tolist()
        if rest:
            for k, ids in zip(rest, self.whole(texts.take(pa.array(rest)).to_pylist()), strict=True):
                out[k] = ids
        some = np.flatnonzero(apart).tolist()
        if some:
            split = self.prepared(texts if len(some) == len(texts) else texts.take(pa.array(some)))
            split = pc.split_pattern(pc.binary_join_element_wise(self.head, pc.replace_substring(split, "\n", " \n"), ""), " ")
            coded = split.flatten().dictionary_encode()
            values = self._values(coded.dictionary.to_pylist())
            sizes = (np.fromiter(map(len, values), np.int32, len(values)) // self.width).astype(np.int32)
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
            ids = np.frombuffer(b"".join(values), dtype="<u2" if self.width == 2 else "<u4")
            index = coded.indices.to_numpy()
            n = sizes[index]
            # an Arrow array of strings holds less than 2**31 bytes, and so fewer ids
            to = np.zeros(len(n) + 1, dtype=np.int32)
            np.cumsum(n, out=to[1:])
            spots = np.repeat(firsts[index] - to[:-1], n)
            spots += np.arange(to[-1], dtype=np.int32)
            flat = ids[spots].tobytes()
            at = (to[split.offsets.to_numpy() - split.offsets[0].as_py()].astype(np.int64) * self.width).tolist()
            for k, i, j in zip(some, at, at[1:], strict=False):
                out[k] = flat[i + self.skip : j]
        return [x + end for x in out] if end else out
