"""Keypoints of single images from connected regions of grey values: maximally stable regions and blobs.

A region at a level is a connected set of pixels (four neighbours) no brighter than the level.  As the level rises regions
grow and merge into a tree.  A region is maximally stable where its area grows less over the next
``delta`` levels, in proportion, than that of the region around it and of the largest one inside it.  Bright
regions are dark ones of the inverted image.

Blobs are regions of about one place at several thresholds: the regions darker than each threshold are labelled, those of a
fitting area and roundness have a centre, and centres near each other at different thresholds are one blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

from vecmosaic.operators.components import contracted


class Region(NamedTuple):
    """A keypoint: centre, diameter of a disc of its area, and how stable or how often found it is."""

    y: float
    x: float
    size: float
    response: float


@dataclass
class ComponentTree:
    """Regions in order of their levels: level, area, sums of the pixels' places, and the next larger region (-1 at the top)."""

    level: np.ndarray
    area: np.ndarray
    place: np.ndarray
    parent: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> ComponentTree:
        """The tree of an image of whole numbers, by union-find over its pixels from dark to bright."""
        h, w = x.shape
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        values = flat.tolist()
        up = [-1] * len(values)  # not yet met
        node_of: dict[int, int] = {}  # the newest region of each root
        area, ys, xs = [0] * len(values), [0] * len(values), [0] * len(values)
        nodes: list[tuple[int, int, int, int]] = []
        parent: list[int] = []

        def root(p: int) -> int:
            while up[p] != p:
                up[p] = up[up[p]]
                p = up[p]
            return p

        at, pixels = 0, order.tolist()
        while at < len(pixels):
            level, begun, inside = values[pixels[at]], at, {}
            while at < len(pixels) and values[pixels[at]] == level:
                p = pixels[at]
                y, z = divmod(p, w)
                up[p], area[p], ys[p], xs[p] = p, 1, y, z
                r = p
                for q in ((p - w) if y else -1, (p + w) if y + 1 < h else -1, (p - 1) if z else -1, (p + 1) if z + 1 < w else -1):
                    if q < 0 or up[q] < 0:
                        continue
                    s = root(q)
                    if s == r:
                        continue
                    if area[s] > area[r]:
                        r, s = s, r
                    up[s] = r
                    area[r], ys[r], xs[r] = area[r] + area[s], ys[r] + ys[s], xs[r] + xs[s]
                    # regions of lower levels that are now inside this one
                    inside.setdefault(r, set()).update(inside.pop(s, set()), *([{node_of.pop(s)}] if s in node_of else []))
                at += 1
            for r in {root(p) for p in pixels[begun:at]}:
                new = len(nodes)
                nodes.append((level, area[r], ys[r], xs[r]))
                parent.append(-1)
                for old in inside.pop(r, set()) | ({node_of[r]} if r in node_of else set()):
                    parent[old] = new
                node_of[r] = new
        level, size, sy, sx = (np.array(c, dtype=np.int64) for c in zip(*nodes, strict=True)) if nodes else (np.zeros(0, dtype=np.int64),) * 4
        return ComponentTree(level, size, np.stack([sy, sx], axis=1), np.array(parent, dtype=np.int64))

    def growth(self, delta: int) -> np.ndarray:
        """How much each region's area grows over the next ``delta`` levels, in proportion."""
        top = np.arange(len(self.level))
        while True:
            above = np.where(self.parent[top] >= 0, self.parent[top], top)
            step = (above != top) & (self.level[above] <= self.level + delta)
            if not step.any():
                return (self.area[top] - self.area) / self.area
            top = np.where(step, above, top)

    def stable(self, delta: int, least: int, most: int, variation: float, diversity: float) -> np.ndarray:
        """The maximally stable regions of an area from ``least`` to ``most``; of nested ones that differ little the larger."""
        n, grown = len(self.level), self.growth(delta)
        main = np.full(n, -1)  # the largest region inside
        for k in np.lexsort((np.arange(n), self.area)).tolist():
            if self.parent[k] >= 0:
                main[self.parent[k]] = k
        inner = np.where(main >= 0, grown[main], np.inf)
        outer = np.where(self.parent >= 0, grown[self.parent], -np.inf)  # the whole image isn't one
        good = (grown <= inner) & (grown < outer) & (grown <= variation) & (self.area >= least) & (self.area <= most)
        kept = np.zeros(n, dtype=bool)
        for k in np.flatnonzero(good)[::-1].tolist():  # larger regions have higher levels
            p = self.parent[k]
            while p >= 0 and not kept[p]:
                p = self.parent[p]
            kept[k] = p < 0 or (self.area[p] - self.area[k]) / self.area[p] >= diversity
        return np.flatnonzero(kept)


def stable_regions(x: np.ndarray, delta: int = 5, least: int = 30, most: int = 14_400, variation: float = 0.25, diversity: float = 0.2) -> list[Region]:
    """The maximally stable regions, dark and bright, the most stable first."""
    whole = np.clip(np.floor(x), 0, 255).astype(np.int64)
    out = []
    for image in (whole, 255 - whole):
        tree = ComponentTree.of(image)
        grown = tree.growth(delta) if len(tree.level) else np.zeros(0)
        for k in tree.stable(delta, least, most, variation, diversity).tolist():
            y, z = tree.place[k] / tree.area[k]
            out.append(Region(float(y), float(z), float(2 * np.sqrt(tree.area[k] / np.pi)), float(1 - grown[k])))
    return sorted(out, key=lambda r: (-r.response, r.y, r.x, r.size))


def labelled(mask: np.ndarray) -> np.ndarray:
    """The connected regions (four neighbours) of a mask: the least pixel number of its region at each pixel, -1 outside."""
    number = np.arange(mask.size).reshape(mask.shape)
    down, right = mask[1:] & mask[:-1], mask[:, 1:] & mask[:, :-1]
    u = np.concatenate([number[1:][down], number[:, 1:][right]])
    v = np.concatenate([number[:-1][down], number[:, :-1][right]])
    out = np.where(mask, number, -1).ravel()
    if len(u):
        vertex, least = contracted(u, v)
        out[vertex] = least
    return out.reshape(mask.shape)


def blobs(x: np.ndarray, step: float = 10.0, first: float = 50.0, last: float = 220.0, distance: float = 10.0, repeats: int = 2, least: int = 25, most: int = 5000, roundness: float = 0.1) -> list[Region]:
    """Dark blobs, those found at most thresholds first.

    A region's roundness is the lesser of its two variances by the greater; 1 is a disc.
    """
    groups: list[list[tuple[float, float, float, float]]] = []  # (y, x, radius, weight) from the lowest threshold on
    ys, xs = np.mgrid[0 : x.shape[0], 0 : x.shape[1]]
    for t in np.arange(first, last, step):
        label = labelled(x < t)
        inside = label >= 0
        if not inside.any():
            continue
        _, at = np.unique(label[inside], return_inverse=True)
        n = np.bincount(at)
        mean = lambda v: np.bincount(at, weights=v) / n  # noqa: E731, B023
        y, z = ys[inside].astype(float), xs[inside].astype(float)
        my, mx = mean(y), mean(z)
        a, c, b = mean(y * y) - my * my, mean(z * z) - mx * mx, mean(y * z) - my * mx
        turn = np.sqrt((a - c) ** 2 / 4 + b * b)
        low, high = (a + c) / 2 - turn, (a + c) / 2 + turn
        round_ = np.where(high > 1e-12, low / np.maximum(high, 1e-12), 1.0)
        before = [g[-1] for g in groups]
        for k in np.flatnonzero((n >= least) & (n <= most) & (round_ >= roundness)).tolist():
            one = (float(my[k]), float(mx[k]), float(np.sqrt(n[k] / np.pi)), float(max(round_[k], 0.0)))
            near = [(np.hypot(one[0] - p[0], one[1] - p[1]), j) for j, p in enumerate(before)]
            near = [(d, j) for d, j in near if d < distance and d < max(one[2], before[j][2])]
            if near:
                groups[min(near)[1]].append(one)
            else:
                groups.append([one])
    out = []
    for g in groups:
        if len(g) >= repeats:
            weight = np.array([p[3] ** 2 + 1e-9 for p in g])
            y, z = (float((np.array([p[c] for p in g]) * weight).sum() / weight.sum()) for c in (0, 1))
            out.append(Region(y, z, float(2 * np.median([p[2] for p in g])), float(len(g))))
    return sorted(out, key=lambda r: (-r.response, r.y, r.x))
