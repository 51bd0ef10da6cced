"""Binary features sampled on rings: a corner score over scales with short and long pairs, and retinal fields.

A pattern is a set of places around a keypoint, each with the width of the Gaussian its value is read through, wider
farther out.  Pairs of places give the direction, by the sum of their differences along the lines between them, and,
turned by it, the bits: one for each pair, whether the first value is greater.  Descriptors are vectors of 1 and -1.

``ring_features`` finds keypoints where the corner score is largest over place and scale, between layers of a pyramid
that halves and their intermediate ones; far pairs give the direction and near ones the bits.  ``retinal_bits`` describes
given keypoints by fields that overlap and grow outwards, the pairs of the widest fields first, so that
``cascade_nearest`` can tell most descriptors apart by their first bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

from vecmosaic.operators.images import fast_score, gaussian
from vecmosaic.operators.keypoints import Keypoint, _local_peaks, _shrunk


@dataclass(frozen=True)
class Pattern:
    """Places (y, x), the widths they are read with, the pairs for the direction and those for the bits."""

    places: np.ndarray
    widths: np.ndarray
    directing: np.ndarray
    bits: np.ndarray


def _circles(radii: list[float], counts: list[int], turned: bool) -> np.ndarray:
    out = []
    for ring, (r, n) in enumerate(zip(radii, counts, strict=True)):
        angle = 2 * np.pi * np.arange(n) / n + (np.pi / n if turned and ring % 2 else 0)
        out.append(np.stack([r * np.sin(angle), r * np.cos(angle)], axis=1))
    return np.concatenate(out)


def _pairs(n: int) -> np.ndarray:
    return np.stack(np.triu_indices(n, 1), axis=1)


@cache
def ring_pattern() -> Pattern:
    """Five rings; pairs nearer than 9.75 give bits, those farther than 13.67 the direction."""
    # Radii and numbers of places of the rings, and the two distances.
    radii, counts, near, far = [0.0, 2.9, 4.9, 7.4, 10.8], [1, 10, 14, 15, 20], 9.75, 13.67
    places = _circles(radii, counts, False)
    widths = np.repeat([0.5 * 1.3 if r == 0 else 1.3 * r * np.sin(np.pi / n) for r, n in zip(radii, counts, strict=True)], counts)
    pairs = _pairs(len(places))
    away = np.sqrt(((places[pairs[:, 0]] - places[pairs[:, 1]]) ** 2).sum(axis=1))
    return Pattern(places, widths, pairs[away > far], pairs[away < near][:512])


@cache
def retina_pattern(bits: int = 512) -> Pattern:
    """Seven rings of six fields and a middle one; bits from the widest fields to the narrowest."""
    radii = [22.0 * 0.72**k for k in range(7)] + [0.0]
    places = _circles(radii, [6] * 7 + [1], True)
    widths = np.repeat([0.45 * r for r in radii[:7]] + [0.45 * radii[6]], [6] * 7 + [1])
    pairs = _pairs(len(places))
    order = np.lexsort((pairs[:, 1], pairs[:, 0], -(widths[pairs[:, 0]] + widths[pairs[:, 1]])))
    opposite = pairs[(pairs[:, 0] // 6 == pairs[:, 1] // 6) & (pairs[:, 1] - pairs[:, 0] == 3) & (pairs[:, 1] < 42)]
    # of all pairs every third beside the coarsest ones, so that fine fields take part, too
    chosen = np.unique(np.concatenate([np.arange(bits // 2), np.linspace(bits // 2, len(pairs) - 1, bits - bits // 2).round().astype(int)]))
    return Pattern(places, widths, opposite, pairs[order[chosen]])


class Reader:
    """The values of an image at a pattern's places around points, through Gaussians of some widths."""

    def __init__(self, x: np.ndarray, pattern: Pattern):
        self.pattern = pattern
        self.names, self.of = np.unique(np.round(pattern.widths, 2), return_inverse=True)
        self.blurred = [gaussian(x, w) if w >= 0.3 else x for w in self.names.tolist()]

    def __call__(self, y: float, x: float, angle: float = 0.0) -> np.ndarray:
        c, s = np.cos(angle), np.sin(angle)
        p = self.pattern.places
        ys, xs = y + c * p[:, 0] + s * p[:, 1], x - s * p[:, 0] + c * p[:, 1]
        h, w = self.blurred[0].shape
        ys, xs = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
        y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
        y1, x1, ty, tx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), ys - y0, xs - x0
        stack = np.stack(self.blurred)
        at = lambda a, b: stack[self.of, a, b]
        return (1 - ty) * ((1 - tx) * at(y0, x0) + tx * at(y0, x1)) + ty * ((1 - tx) * at(y1, x0) + tx * at(y1, x1))

    def direction(self, y: float, x: float) -> float:
        """Where the values grow: the sum over the directing pairs of their difference by their distance, along the line between them."""
        v, (a, b) = self(y, x), self.pattern.directing.T
        line = self.pattern.places[b] - self.pattern.places[a]
        g = ((v[b] - v[a]) / (line * line).sum(axis=1))[:, None] * line
        gy, gx = g.sum(axis=0)
        return float(np.arctan2(gy, gx) % (2 * np.pi))

    def bits(self, y: float, x: float, angle: float) -> np.ndarray:
        v, (a, b) = self(y, x, angle), self.pattern.bits.T
        return np.where(v[a] > v[b], 1.0, -1.0)


def _score_at(score: np.ndarray, y: float, x: float) -> float:
    """The largest score within a pixel of a place in another layer."""
    a, b = round(y), round(x)
    part = score[max(0, a - 1) : a + 2, max(0, b - 1) : b + 2]
    return float(part.max()) if part.size else 0.0


def ring_features(x: np.ndarray, threshold: float = 20.0, octaves: int = 4) -> list[tuple[Keypoint, np.ndarray]]:
    """Corners that are the strongest over place and scale, with their bits, the strongest first."""
    x = np.asarray(x, dtype=float)
    layers = []
    for k in range(octaves):
        for unit in (2.0**k, 1.5 * 2**k):
            small = _shrunk(x, unit)
            if min(small.shape) >= 7:
                layers.append((unit, small, fast_score(small, threshold)))
    out = []
    for k, (unit, small, score) in enumerate(layers):
        places = _local_peaks(score).tolist()
        reader = Reader(small, ring_pattern()) if places else None
        for y, z in places:
            here = float(score[y, z])
            below, above = (_score_at(layers[j][2], y * unit / layers[j][0], z * unit / layers[j][0]) if 0 <= j < len(layers) else 0.0 for j in (k - 1, k + 1))
            if here < below or here <= above:
                continue
            # the top of a parabola through the scores of the three layers, over the logarithm of the scale
            bend = below - 2 * here + above
            step = 0.5 * (below - above) / bend if bend < 0 else 0.0
            scale = unit * 2.0 ** (0.5 * float(np.clip(step, -1, 1)))
            angle = reader.direction(y, z)
            out.append((Keypoint(y * unit, z * unit, 12 * scale, angle, here), reader.bits(y, z, angle)))
    return sorted(out, key=lambda f: (-f[0].response, f[0].y, f[0].x, f[0].size))


def retinal_bits(x: np.ndarray, places: list[tuple[float, float]]) -> list[np.ndarray]:
    """The bits of each place (y, x), turned by its own direction."""
    if not places:
        return []
    reader = Reader(np.asarray(x, dtype=float), retina_pattern())
    return [reader.bits(y, z, reader.direction(y, z)) for y, z in places]


def cascade_nearest(queries: np.ndarray, targets: np.ndarray, first: int = 128) -> np.ndarray:
    """The nearest target of each query by unequal bits, the first of equal ones: the same as by comparing all bits.

    The first bits are compared with all targets; the rest only with those whose first bits alone don't differ more
    than all bits of the best one so far.
    """
    if not len(targets):
        return np.full(len(queries), -1)
    out = np.zeros(len(queries), dtype=np.int64)
    coarse = (first - queries[:, :first] @ targets[:, :first].T) / 2
    for k, c in enumerate(coarse):
        best, at = np.inf, -1
        order = np.argsort(c, kind="stable")
        for a in range(0, len(order), 64):
            part = order[a : a + 64]
            part = part[c[part] <= best]
            if not len(part):
                break
            rest = queries.shape[1] - first
            d = c[part] + (rest - targets[part, first:] @ queries[k, first:]) / 2
            j = int(np.lexsort((part, d))[0])
            if (d[j], part[j]) < (best, at if at >= 0 else np.inf):
                best, at = float(d[j]), int(part[j])
        out[k] = at
    return out
