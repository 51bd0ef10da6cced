"""Keypoints and descriptors of single images: scale-space extrema with gradient histograms, and
oriented arcs over a pyramid with binary intensity tests.

The methods are the published ones (difference-of-Gaussian extrema with orientation histograms;
arcs with intensity centroids and steered binary tests).  A keypoint is (y, x, size, angle,
response) in pixels and radians of the image; binary descriptors are vectors of 1 and -1, so that
the signs of their components are the bits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from vecmosaic.operators.images import fast_score, gaussian, stretched

LEVELS = 3  # of an octave
BLUR = 1.6  # of an octave's first level


class Keypoint(NamedTuple):
    y: float
    x: float
    size: float
    angle: float
    response: float


def _octaves(x: np.ndarray) -> list[list[np.ndarray]]:
    """Blurred images by octave; each octave begins with every other pixel of the one before."""
    base, out = gaussian(stretched(x), np.sqrt(BLUR**2 - 0.25)), []
    while min(base.shape) >= 12:
        images = [base]
        for k in range(1, LEVELS + 3):
            before, now = (BLUR * 2 ** (i / LEVELS) for i in (k - 1, k))
            images.append(gaussian(images[-1], np.sqrt(now**2 - before**2)))
        out.append(images)
        base = images[LEVELS][::2, ::2]
    return out


def _extrema(d: np.ndarray, contrast: float, edge: float) -> list[tuple[float, float, float, float]]:
    """(level, y, x, response) of refined extrema among the 26 neighbours in a stack of differences."""
    if min(d.shape) < 3:
        return []
    inner = d[1:-1, 1:-1, 1:-1]
    shifts = [d[1 + a : d.shape[0] - 1 + a, 1 + b : d.shape[1] - 1 + b, 1 + c : d.shape[2] - 1 + c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    high, low = np.maximum.reduce(shifts), np.minimum.reduce(shifts)
    found = []
    for s, y, x in np.argwhere((np.abs(inner) > 0.5 * contrast) & ((inner > high) | (inner < low))) + 1:
        q = d[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2]
        g = 0.5 * np.array([q[2, 1, 1] - q[0, 1, 1], q[1, 2, 1] - q[1, 0, 1], q[1, 1, 2] - q[1, 1, 0]])
        h = np.empty((3, 3))
        h[0, 0], h[1, 1], h[2, 2] = q[2, 1, 1] + q[0, 1, 1] - 2 * q[1, 1, 1], q[1, 2, 1] + q[1, 0, 1] - 2 * q[1, 1, 1], q[1, 1, 2] + q[1, 1, 0] - 2 * q[1, 1, 1]
        h[0, 1] = h[1, 0] = 0.25 * (q[2, 2, 1] - q[2, 0, 1] - q[0, 2, 1] + q[0, 0, 1])
        h[0, 2] = h[2, 0] = 0.25 * (q[2, 1, 2] - q[2, 1, 0] - q[0, 1, 2] + q[0, 1, 0])
        h[1, 2] = h[2, 1] = 0.25 * (q[1, 2, 2] - q[1, 2, 0] - q[1, 0, 2] + q[1, 0, 0])
        step = -np.linalg.lstsq(h, g, rcond=None)[0]
        value = q[1, 1, 1] + 0.5 * g @ step
        trace, det = h[1, 1] + h[2, 2], h[1, 1] * h[2, 2] - h[1, 2] ** 2
        if np.abs(step).max() > 1 or abs(value) < contrast or det <= 0 or trace**2 * edge >= (edge + 1) ** 2 * det:
            continue
        found.append((s + step[0], y + step[1], x + step[2], float(abs(value))))
    return found


def _patch(image: np.ndarray, y: float, x: float, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dy, dx, size, angle) of the gradients around a point."""
    a, b, r = round(y), round(x), radius
    top, left = max(1, a - r), max(1, b - r)
    bottom, right = min(image.shape[0] - 1, a + r + 1), min(image.shape[1] - 1, b + r + 1)
    gy = image[top + 1 : bottom + 1, left:right] - image[top - 1 : bottom - 1, left:right]
    gx = image[top:bottom, left + 1 : right + 1] - image[top:bottom, left - 1 : right - 1]
    ys, xs = np.mgrid[top:bottom, left:right]
    return ys - y, xs - x, np.hypot(gx, gy), np.arctan2(gy, gx)


def _orientations(image: np.ndarray, y: float, x: float, scale: float) -> list[float]:
    dy, dx, size, angle = _patch(image, y, x, round(4.5 * scale))
    if not size.size:
        return []
    weight = size * np.exp(-(dy**2 + dx**2) / (2 * (1.5 * scale) ** 2))
    h = np.bincount((np.floor(angle / (2 * np.pi) * 36).astype(int) % 36).ravel(), weights=weight.ravel(), minlength=36)
    for _ in range(2):
        h = (np.roll(h, 1) + 2 * h + np.roll(h, -1)) / 4
    left, right = np.roll(h, 1), np.roll(h, -1)
    peaks = np.flatnonzero((h > left) & (h > right) & (h >= 0.8 * h.max()))
    bend = left[peaks] - 2 * h[peaks] + right[peaks]
    return ((peaks + 0.5 + 0.5 * (left[peaks] - right[peaks]) / np.where(bend, bend, 1)) * 2 * np.pi / 36 % (2 * np.pi)).tolist()


def gradient_histograms(image: np.ndarray, y: float, x: float, scale: float, angle: float) -> np.ndarray:
    """128 numbers: 4 x 4 cells of 8 directions in a window turned by the angle, shared among neighbours, limited to 0.2."""
    cell = 3 * scale
    dy, dx, size, direction = _patch(image, y, x, round(cell * np.sqrt(2) * 2.5))
    c, s = np.cos(angle), np.sin(angle)
    row, col = (c * dy - s * dx) / cell, (c * dx + s * dy) / cell
    weight = size * np.exp(-(row**2 + col**2) / 8)
    row, col, turn = row + 1.5, col + 1.5, (direction - angle) / (2 * np.pi) * 8
    inside = (row > -1) & (row < 4) & (col > -1) & (col < 4)
    row, col, turn, weight = row[inside], col[inside], turn[inside], weight[inside]
    r0, c0, t0 = (np.floor(v).astype(int) for v in (row, col, turn))
    out = np.zeros((6, 6, 8))
    for a in (0, 1):
        for b in (0, 1):
            for t in (0, 1):
                part = np.abs(1 - a - (row - r0)) * np.abs(1 - b - (col - c0)) * np.abs(1 - t - (turn - t0))
                np.add.at(out, (r0 + a + 1, c0 + b + 1, (t0 + t) % 8), weight * part)
    d = out[1:5, 1:5].ravel()
    d = np.minimum(d / (np.linalg.norm(d) or 1.0), 0.2)
    return d / (np.linalg.norm(d) or 1.0)


def scale_space_features(x: np.ndarray, contrast: float = 0.01, edge: float = 10.0) -> list[tuple[Keypoint, np.ndarray]]:
    """Extrema of differences of Gaussians with their gradient histograms, the strongest first."""
    out = []
    for octave, images in enumerate(_octaves(x)):
        d = np.stack([b - a for a, b in zip(images, images[1:], strict=False)])
        for s, y, z, response in _extrema(d, contrast, edge):
            level = min(max(round(s), 0), LEVELS + 2)
            scale, unit = BLUR * 2 ** (s / LEVELS), 2**octave
            for angle in _orientations(images[level], y, z, scale):
                out.append((Keypoint(y * unit, z * unit, scale * unit, angle, response), gradient_histograms(images[level], y, z, scale, angle)))
    return sorted(out, key=lambda f: (-f[0].response, f[0].y, f[0].x, f[0].angle))


def _tests(bits: int = 256, patch: int = 31, seed: int = 31) -> np.ndarray:
    """Pairs of places in a patch, drawn around its centre."""
    p = np.random.default_rng(seed).normal(0, patch / 5, (bits, 2, 2))
    return np.clip(p, -(patch // 2) + 2, patch // 2 - 2)


def binary_tests(smooth: np.ndarray, y: float, x: float, angle: float = 0.0, bits: int = 256) -> np.ndarray:
    """1 where the first place of a pair is darker than the second, else -1; the places turn with the angle."""
    p = _tests(bits)
    c, s = np.cos(angle), np.sin(angle)
    ys = np.clip(np.rint(y + c * p[..., 0] + s * p[..., 1]), 0, smooth.shape[0] - 1).astype(int)
    xs = np.clip(np.rint(x - s * p[..., 0] + c * p[..., 1]), 0, smooth.shape[1] - 1).astype(int)
    v = smooth[ys, xs]
    return np.where(v[:, 0] < v[:, 1], 1.0, -1.0)


def centroid_angle(x: np.ndarray, y: int, z: int, radius: int = 15) -> float:
    """The direction from a point to the centre of intensity of the disc around it."""
    ys, xs = np.mgrid[max(0, y - radius) : min(x.shape[0], y + radius + 1), max(0, z - radius) : min(x.shape[1], z + radius + 1)]
    inside = (ys - y) ** 2 + (xs - z) ** 2 <= radius**2
    v = x[ys, xs] * inside
    return float(np.arctan2((v * (ys - y)).sum(), (v * (xs - z)).sum()) % (2 * np.pi))


def _local_peaks(score: np.ndarray) -> np.ndarray:
    p = np.pad(score, 1, constant_values=-np.inf)
    near = np.stack([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]).max(axis=0)
    return np.argwhere((score > 0) & (score > near))


def _shrunk(x: np.ndarray, factor: float) -> np.ndarray:
    """The image at 1 / factor of its size, by bilinear samples of a blurred one."""
    if factor == 1:
        return x
    x = gaussian(x, 0.5 * factor)
    h, w = (max(1, int(n / factor)) for n in x.shape)
    ys, xs = np.minimum(np.arange(h) * factor, x.shape[0] - 1), np.minimum(np.arange(w) * factor, x.shape[1] - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    ty, tx = (ys - y0)[:, None], (xs - x0)[None, :]
    return (1 - ty) * ((1 - tx) * x[np.ix_(y0, x0)] + tx * x[np.ix_(y0, x1)]) + ty * ((1 - tx) * x[np.ix_(y1, x0)] + tx * x[np.ix_(y1, x1)])


def binary_features(x: np.ndarray, oriented: bool = True, levels: int = 8, factor: float = 1.2, threshold: float = 20.0) -> list[tuple[Keypoint, np.ndarray]]:
    """Arcs over a pyramid with steered binary tests, the strongest first; without orientation, of the image itself and upright."""
    out = []
    for k in range(levels if oriented else 1):
        unit = factor**k
        small = _shrunk(np.asarray(x, dtype=float), unit)
        if min(small.shape) < 7:
            break
        smooth, score = gaussian(small, 2.0), fast_score(small, threshold)
        for y, z in _local_peaks(score).tolist():
            angle = centroid_angle(small, y, z) if oriented else 0.0
            out.append((Keypoint(y * unit, z * unit, 31 * unit, angle, float(score[y, z])), binary_tests(smooth, y, z, angle)))
    return sorted(out, key=lambda f: (-f[0].response, f[0].y, f[0].x, f[0].size))
