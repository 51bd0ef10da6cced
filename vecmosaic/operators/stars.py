"""Keypoints by centre and surround: the mean over a star against that over the ring up to a larger one.

A star is an upright square with a slanted one over it, and counts what is in both twice.  Sums over upright squares come
from an integral image.  For slanted ones two images hold the running sums along both diagonals; a step to the right
adds two stretches of diagonals and takes away two, so every size takes as many reads.  Extremes over place and size that
don't lie on a line are keypoints.
"""

from __future__ import annotations

import numpy as np

from vecmosaic.operators.boxes import box, integral
from vecmosaic.operators.keypoints import Keypoint

#: Half sides of the upright squares; a response is of one star and the one two sizes on.
SIZES = (1, 2, 3, 4, 6, 8, 11, 16, 22)


def slanted(x: np.ndarray, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums down to the right and down to the left, with ``margin`` places added on all sides."""
    wide = np.pad(x, margin)
    right, left = wide.copy(), wide.copy()
    for y in range(1, len(wide)):
        right[y, 1:] += right[y - 1, :-1]
        left[y, :-1] += left[y - 1, 1:]
    return right, left


def diamonds(sums: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], margin: int, radius: int) -> np.ndarray:
    """The sum around each pixel of those at most ``radius`` steps away; what lies outside counts as zero.

    ``margin`` is at least twice the radius and two more.
    """
    h, w, r = *shape, radius
    right, left = sums
    at = lambda a, dy, dx: a[margin + dy : margin + dy + h, margin - r + dx : margin + w + dx]
    come = at(right, 0, r) - at(right, -r - 1, -1) + at(left, r, 0) - at(left, 0, r)
    gone = at(left, 0, -r - 1) - at(left, -r - 1, 0) + at(right, r, -1) - at(right, 0, -r - 1)
    return (come - gone).cumsum(axis=1)[:, r:]


def responses(x: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[list[int], np.ndarray]:
    """The sizes that fit and their responses; not a number where a star leaves the image."""
    h, w = x.shape
    reach = lambda n: round(1.5 * n)
    fit = [n for n in sizes if 2 * reach(n) + 1 <= min(h, w)]
    if len(fit) < 3:
        return [], np.zeros((0, h, w))
    margin = 2 * reach(fit[-1]) + 2
    sums, cones = integral(x), slanted(x, margin)
    ys, xs = np.mgrid[0:h, 0:w]
    total = [box(sums, ys - n, xs - n, 2 * n + 1, 2 * n + 1) + diamonds(cones, x.shape, margin, reach(n)) for n in fit]
    area = [(2 * n + 1) ** 2 + 2 * reach(n) * (reach(n) + 1) + 1 for n in fit]
    out = []
    for k in range(len(fit) - 2):
        r = total[k] / area[k] - (total[k + 2] - total[k]) / (area[k + 2] - area[k])
        edge = reach(fit[k + 2])
        r[:edge], r[h - edge :], r[:, :edge], r[:, w - edge :] = (np.nan,) * 4
        out.append(r)
    return fit[:-2], np.stack(out)


def on_line(r: np.ndarray, y: int, x: int, size: int, ratio: float) -> bool:
    """Whether the response changes along one direction only, around a place."""
    while size > 1 and np.isnan(r[y - size : y + size + 1, x - size : x + size + 1]).any():
        size -= 1
    gy, gx = np.gradient(r[y - size : y + size + 1, x - size : x + size + 1])
    xx, yy, xy = (gx * gx).sum(), (gy * gy).sum(), (gx * gy).sum()
    return bool((xx + yy) ** 2 >= ratio * (xx * yy - xy * xy))


def star_keypoints(x: np.ndarray, threshold: float = 20.0, line: float = 10.0) -> list[Keypoint]:
    """Extremes over place and size, light or dark, of at least ``threshold`` grey levels, the strongest first."""
    sizes, stack = responses(np.asarray(x, dtype=float))
    out = []
    for sign in (1, -1):
        value = np.where(np.isnan(stack), -np.inf, sign * stack)
        for k in range(len(sizes)):
            lower, upper = max(0, k - 1), min(len(sizes), k + 2)
            for y, z in np.argwhere(value[k] > threshold).tolist():
                near = value[lower:upper, y - 1 : y + 2, z - 1 : z + 2]
                here = value[k, y, z]
                if np.isnan(stack[k, y - 1 : y + 2, z - 1 : z + 2]).any() or here < near.max() or (near == here).sum() > 1 or on_line(stack[k], y, z, max(2, sizes[k]), (line + 1) ** 2 / line):
                    continue
                out.append(Keypoint(float(y), float(z), float(2 * sizes[k] + 1), 0.0, float(here)))
    return sorted(out, key=lambda p: (-p.response, p.y, p.x, p.size))
