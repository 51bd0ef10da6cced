"""Fuzzy search for short licence notices.

A notice's distinguishing words must stand exactly, as one edit there makes another licence; the rest
may carry ``k`` edits.  Cut into at least ``k + 1`` pieces, all but ``k`` of the rest's pieces are intact in any such match
(pigeonhole).  One automaton pass finds the exact words; a place is a candidate where enough pieces lie
intact at their distances from these, give or take ``k``, and enough letter pairs are shared.  The regex library's
bounded-error matching then verifies the text before and after the exact words and gives the span.  Each
candidate is verified by itself, in a window as long as the notice, and equal windows once.  Where spans
overlap, the one with most of its wording intact is reported.  Beside this, exact phrases of whole words are reported
at every place.

Texts are lower-cased in A-Z only and taken as words of ASCII letters, digits and all characters
beyond ASCII; between words any run of other characters counts as one blank.  Edits are counted in
UTF-8 bytes of that form.

Defined results: a null or empty text has no words and no labels; repeated rows are scanned one by
one; an empty table gives an empty result; a very long text is scanned whole, in time proportional to its
length and its candidates; other columns may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases with labels of the exact scan.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices of the fuzzy scan: label, wording with the words that must stand exactly in brackets, edits allowed in the rest.
NOTICES = (
    ("mit", "released under the [mit] license", 3),
    ("mit", "licensed under the [mit] license", 3),
    ("mit", "permission is [hereby] granted free of charge to any person obtaining a copy", 7),
    ("mit", "spdx license identifier [mit]", 2),
    ("apache-2.0", "licensed under the [apache] license version 2 0", 4),
    ("apache-2.0", "spdx license identifier [apache 2 0]", 2),
    ("bsd", "[redistribution] and use in source and binary forms", 5),
    ("bsd", "spdx license identifier [bsd]", 2),
    ("isc", "permission to use copy modify and or [distribute] this software", 6),
    ("isc", "spdx license identifier [isc]", 2),
    ("mpl-2.0", "[mozilla] public license version 2 0", 3),
    ("mpl-2.0", "spdx license identifier [mpl 2 0]", 2),
    ("epl-2.0", "[eclipse] public license", 2),
    ("lgpl", "gnu [lesser] general public license", 3),
    ("lgpl", "spdx license identifier [lgpl]", 2),
    ("agpl", "gnu [affero] general public license", 3),
    ("agpl", "spdx license identifier [agpl]", 2),
    ("gpl", "[gnu general] public license", 3),
    ("gpl", "spdx license identifier [gpl]", 2),
    ("unlicense", "this is free and [unencumbered] software released into the public domain", 7),
    ("unlicense", "spdx license identifier [unlicense]", 2),
    ("cc0-1.0", "[cc0 1 0] universal", 2),
    ("cc0-1.0", "spdx license identifier [cc0]", 2),
    ("cc-by", "creative commons [attribution]", 3),
    ("cc-by-sa", "creative commons attribution [sharealike]", 4),
    ("cc-by-sa", "licensed under [cc by sa]", 2),
    ("cc-by-nc", "creative commons attribution [noncommercial]", 4),
    ("cc-by-nc", "licensed under [cc by nc]", 2),
    ("reserved", "all rights [reserved]", 2),
)


_KNOWN = 100_000  # windows whose answer a worker keeps


@dataclass(frozen=True)
class LicenseOptions:
    phrases: tuple[tuple[str, str], ...] = PHRASES
    notices: tuple[tuple[str, str, int], ...] = NOTICES


def pieces(wording: str, edits: int) -> list[tuple[int, str]]:
    """The wording cut into edits + 1 parts of about one length, with their offsets."""
    cuts = [round(i * len(wording) / (edits + 1)) for i in range(edits + 2)]
    return [(a, wording[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Notice:
    """A notice cut at its exact words: the wording before and after them, and the pieces that edits leave intact.

    ``pieces`` are (distance from the exact words' first blank, piece).
    """

    label: str
    edits: int
    left: str
    exact: str  # with the blanks around it
    right: str
    pieces: tuple[tuple[int, str], ...]

    @property
    def wording(self) -> str:
        return (self.left + self.exact + self.right).strip()

    @staticmethod
    def of(label: str, wording: str, edits: int) -> Notice:
        found = re.fullmatch(r"(?:([^][]+) )?\[([^][]+)\](?: ([^][]+))?", wording)
        if not found:
            raise ValueError(f"a notice has exact words in brackets, and blanks around them: {wording}")
        left, exact, right = found[1] or "", f" {found[2]} ", found[3] or ""
        before = round((edits + 1) * len(left) / max(1, len(left) + len(right)))
        cut = [(at - len(left), p) for at, p in pieces(left, max(before, 1) - 1) if p]
        cut += [(at + len(exact), p) for at, p in pieces(right, max(edits + 1 - before, 1) - 1) if p]
        if len(cut) <= edits:
            raise ValueError(f"too many edits for its length: {wording}")
        return Notice(label, edits, left, exact, right, tuple(cut))


def distance(a: str, b: str) -> int:
    """Fewest edits from one string to the other."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
    return row[-1]


def _letter_pairs(x: str) -> Counter:
    return Counter(zip(x, x[1:], strict=False))


class Scanner:
    """One text at a time; built once in each worker.  Notices of two labels that edits could turn into each other are refused."""

    def __init__(self, options: LicenseOptions):
        import ahocorasick
        import regex

        table = np.zeros(256, dtype=bool)
        for a, b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
            table[a:b] = True
        self.table = table
        self.phrases = [(f" {p} ".encode("latin-1"), p.count(" ") + 1, label) for p, label in options.phrases]
        self.notices = [Notice.of(*n) for n in options.notices]
        for i, a in enumerate(self.notices):
            for b in self.notices[:i]:
                both = a.exact in f" {b.wording} " and b.exact in f" {a.wording} "
                if a.label != b.label and both and distance(a.wording, b.wording) <= a.edits + b.edits:
                    raise ValueError(f"notices of {a.label} and {b.label} are within their edits of each other")
        fuzzy = lambda x, k, at_end: regex.compile(f"(?b)(?:{regex.escape(x)}){{e<={k}}}" + (r"\Z" if at_end else "")) if x else None
        self.sides = [(fuzzy(n.left, n.edits, True), fuzzy(n.right, n.edits, False)) for n in self.notices]
        self.pairs = [(_letter_pairs(n.left), _letter_pairs(n.right)) for n in self.notices]
        uses: dict[str, list[int]] = {}
        for i, n in enumerate(self.notices):
            uses.setdefault(n.exact, []).append(i)
        self.seeds = ahocorasick.Automaton()
        for exact, which in uses.items():
            self.seeds.add_word(exact, (len(exact), which))
        self.seeds.make_automaton()
        self.known: dict[tuple[int, int, str], tuple[int, int] | None] = {}

    def _side(self, i: int, side: int, window: str) -> tuple[int, int] | None:
        """(edits, length) of the notice's text on one side of its exact words, at that end of the window next to them."""
        key = (i, side, window)
        if key in self.known:
            return self.known[key]
        n = self.notices[i]
        size, found = len(n.right if side else n.left), None
        # edits each change two letter pairs at most
        if (self.pairs[i][side] & _letter_pairs(window)).total() >= size - 1 - 2 * n.edits:
            m = self.sides[i][side].match(window) if side else self.sides[i][side].search(window)
            found = (sum(m.fuzzy_counts), m.end() - m.start()) if m else None
        if len(self.known) >= _KNOWN:
            self.known.clear()
        self.known[key] = found
        return found

    def _place(self, i: int, norm: str, at: int) -> tuple[int, int, int, int] | None:
        """(notice, start, end, edits) around the exact words at ``at``."""
        n = self.notices[i]
        k, end, gone = n.edits, at + len(n.exact), 0
        for off, piece in n.pieces:
            if norm.find(piece, max(0, at + off - k), at + off + len(piece) + k) < 0:
                gone += 1
                if gone > k:
                    return None
        left = self._side(i, 0, norm[max(0, at - len(n.left) - k) : at]) if n.left else (0, -1)
        if left is None or left[0] > k:
            return None
        right = self._side(i, 1, norm[end : end + len(n.right) + k]) if n.right else (0, -1)
        if right is None or left[0] + right[0] > k:
            return None
        return i, at - left[1], end + right[1], left[0] + right[0]

    def places(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of every verified place, overlapping ones too."""
        found = []
        for end, (size, which) in self.seeds.iter(norm):
            found += [x for i in which if (x := self._place(i, norm, end + 1 - size))]
        return found

    def normal(self, text: bytes) -> bytes:
        """The words with one blank between, before and after them."""
        arr = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8)
        word = self.table[arr]
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[0] = True
        return np.where(word, arr, 32)[keep].astype(np.uint8).tobytes()

    def fuzzy(self, norm: str) -> list[tuple[int, int, int, int]]:
        """The places from left to right; of those that overlap the one with most of its wording intact, then the first."""
        ranked = sorted(self.places(norm), key=lambda x: (x[3] - len(self.notices[x[0]].wording), x[3], x[1], x[2], x[0]))
        starts: list[int] = []
        ends: list[int] = []
        found = []
        for x in ranked:
            at = bisect_left(starts, x[2])  # those before it begin before its end
            if not at or ends[at - 1] <= x[1]:
                at = bisect_left(starts, x[1])
                starts.insert(at, x[1])
                ends.insert(at, x[2])
                found.append(x)
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def __call__(self, text: bytes) -> dict:
        norm = self.normal(text)
        blanks = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
        places, base = [], set()
        for phrase, _, label in self.phrases:
            at = norm.find(phrase)
            if at >= 0:
                base.add(label)
            while at >= 0:
                places.append(at)
                at = norm.find(phrase, at + 1)
        starts = np.searchsorted(blanks, places)
        labels, score, spans = set(base), 1.0 if base else 0.0, []
        hits = self.fuzzy(norm.decode("latin-1"))
        if hits:
            arr = np.frombuffer(text.lower(), dtype=np.uint8)
            edge = np.flatnonzero(np.diff(self.table[arr], prepend=False, append=False))
            # code points before each byte
            points = np.concatenate([[0], np.cumsum((arr & 0xC0) != 0x80)])
            n, a, b, _ = np.array(hits).T
            first = np.clip(np.searchsorted(blanks, np.maximum(a, 1)) - 1, 0, len(edge) // 2 - 1)
            last = np.clip(np.searchsorted(blanks, np.maximum(b - 1, 1)) - 1, 0, len(edge) // 2 - 1)
            for (k, _, _, edits), i, j in zip(hits, points[edge[2 * first]].tolist(), points[edge[2 * last + 1]].tolist(), strict=True):
                label = self.notices[k].label
                labels.add(label)
                score = max(score, 1 - edits / len(self.notices[k].wording))
                spans.append(f"{label}:{i}:{j}:{edits}")
        return {
            "n_words": max(len(blanks) - 1, 0), "n_base": len(places), "first_word": int(starts.min()) if places else None, "last_word": int(starts.max()) if places else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "spans": ",".join(spans),
        }


def license_scan(docs: DataFrame, options: LicenseOptions = LicenseOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the exact places, the labels of both scans, a score, and fuzzy spans.

    ``spans`` lists label:start:end:edits in code points of the text, ends exclusive.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Scanner(options)
        types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.string()}
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column("body")]
            cols = [batch.column("doc_id")] + [pa.array([r[c] for r in rows], type=t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *types])

    return narrow.mapInArrow(scan, out)
