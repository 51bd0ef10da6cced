"""Scale-space features from sums over boxes: extrema of approximated Hessian determinants with Haar-wavelet descriptors.

An integral image gives the sum over any box by four reads, so a filter costs the same at every size and the image
is never shrunk.  Second derivatives are box filters of growing size; maxima of their determinant over place and size
are keypoints.  The direction is that of the largest sum of wavelet responses within a sixth of a turn; the
descriptor has four sums of them in each of 4 x 4 cells of a window turned by it.
"""

from __future__ import annotations

import numpy as np

from vecmosaic.operators.images import stretched
from vecmosaic.operators.keypoints import Keypoint

#: Filter sizes of each octave; a keypoint lies at an inner one.
SIZES = ((9, 15, 21, 27), (15, 27, 39, 51), (27, 51, 75, 99))
#: Fixed value: the weight of the mixed derivative that makes up for its box filter.
MIXED = 0.81


def integral(x: np.ndarray) -> np.ndarray:
    """The sum of all pixels above and left of each place."""
    return np.pad(x, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)


def box(sums: np.ndarray, y: np.ndarray, x: np.ndarray, height: int, width: int) -> np.ndarray:
    """The sums over boxes from (y, x) on; what lies outside the image counts as zero."""
    h, w = sums.shape[0] - 1, sums.shape[1] - 1
    a, b, c, d = np.clip(y, 0, h), np.clip(y + height, 0, h), np.clip(x, 0, w), np.clip(x + width, 0, w)
    return sums[b, d] - sums[a, d] - sums[b, c] + sums[a, c]


def determinant(sums: np.ndarray, size: int) -> np.ndarray:
    """The Hessian determinant of every pixel by box filters of one size; minus infinity where the filter doesn't fit."""
    h, w = sums.shape[0] - 1, sums.shape[1] - 1
    y, x = np.mgrid[0:h, 0:w]
    third, half = size // 3, size // 2
    across = box(sums, y - third + 1, x - half, 2 * third - 1, size) - 3 * box(sums, y - third + 1, x - third // 2, 2 * third - 1, third)
    down = box(sums, y - half, x - third + 1, size, 2 * third - 1) - 3 * box(sums, y - third // 2, x - third + 1, third, 2 * third - 1)
    mixed = box(sums, y - third, x + 1, third, third) + box(sums, y + 1, x - third, third, third) - box(sums, y - third, x - third, third, third) - box(sums, y + 1, x + 1, third, third)
    out = (across * down - MIXED * mixed * mixed) / float(size) ** 4
    out[:half], out[h - half :], out[:, :half], out[:, w - half :] = (-np.inf,) * 4
    return out


def _peak(stack: np.ndarray, y: int, x: int) -> tuple[np.ndarray, float] | None:
    """The step from the middle to the refined maximum of a quadratic through the neighbours, and its value."""
    q = stack[:, y - 1 : y + 2, x - 1 : x + 2]
    if not np.isfinite(q).all():
        return None
    g = 0.5 * np.array([q[2, 1, 1] - q[0, 1, 1], q[1, 2, 1] - q[1, 0, 1], q[1, 1, 2] - q[1, 1, 0]])
    c = q[1, 1, 1]
    mixed = lambda a, b: 0.25 * (a[0] - a[1] - b[0] + b[1])
    hess = np.diag([q[2, 1, 1] + q[0, 1, 1] - 2 * c, q[1, 2, 1] + q[1, 0, 1] - 2 * c, q[1, 1, 2] + q[1, 1, 0] - 2 * c])
    hess[0, 1] = hess[1, 0] = mixed((q[2, 2, 1], q[2, 0, 1]), (q[0, 2, 1], q[0, 0, 1]))
    hess[0, 2] = hess[2, 0] = mixed((q[2, 1, 2], q[2, 1, 0]), (q[0, 1, 2], q[0, 1, 0]))
    hess[1, 2] = hess[2, 1] = mixed((q[1, 2, 2], q[1, 2, 0]), (q[1, 0, 2], q[1, 0, 0]))
    step = -np.linalg.lstsq(hess, g, rcond=None)[0]
    return (step, float(c + 0.5 * g @ step)) if np.abs(step).max() < 1 else None


def haar(sums: np.ndarray, y: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(dx, dy): right less left and lower less upper half of boxes around places."""
    half = max(1, size // 2)
    dx = box(sums, y - half, x, 2 * half, half) - box(sums, y - half, x - half, 2 * half, half)
    dy = box(sums, y, x - half, half, 2 * half) - box(sums, y - half, x - half, half, 2 * half)
    return dx, dy


def direction(sums: np.ndarray, y: float, x: float, scale: float) -> float:
    """The direction of the largest sum of wavelet responses in a window of a sixth of a turn."""
    i, j = np.mgrid[-6:7, -6:7]
    near = i * i + j * j < 36
    i, j = i[near], j[near]
    dx, dy = haar(sums, np.rint(y + i * scale).astype(int), np.rint(x + j * scale).astype(int), max(2, round(4 * scale)))
    weight = np.exp(-(i * i + j * j) / (2 * 2.5**2))
    dx, dy = dx * weight, dy * weight
    angle = np.arctan2(dy, dx)
    starts = np.arange(0, 2 * np.pi, 0.05)
    inside = (angle[None, :] - starts[:, None]) % (2 * np.pi) < np.pi / 3
    sx, sy = inside @ dx, inside @ dy
    k = int((sx * sx + sy * sy).argmax())
    return float(np.arctan2(sy[k], sx[k]) % (2 * np.pi))


def wavelet_sums(sums: np.ndarray, y: float, x: float, scale: float, angle: float) -> np.ndarray:
    """64 numbers: in each of 4 x 4 cells of 5 x 5 samples the sums of dx, |dx|, dy and |dy| along and across the direction."""
    u, v = np.mgrid[-10:10, -10:10] + 0.5  # v along the direction, u across it
    c, s = np.cos(angle), np.sin(angle)
    ys, xs = np.rint(y + scale * (v * s + u * c)).astype(int), np.rint(x + scale * (v * c - u * s)).astype(int)
    dx, dy = haar(sums, ys, xs, max(2, round(2 * scale)))
    weight = np.exp(-(u * u + v * v) / (2 * 3.3**2))
    along, across = weight * (c * dx + s * dy), weight * (-s * dx + c * dy)
    cells = lambda z: z.reshape(4, 5, 4, 5).sum(axis=(1, 3))
    d = np.stack([cells(along), cells(np.abs(along)), cells(across), cells(np.abs(across))], axis=-1).ravel()
    return d / (np.linalg.norm(d) or 1.0)


def box_features(x: np.ndarray, threshold: float = 0.0004, upright: bool = False) -> list[tuple[Keypoint, np.ndarray]]:
    """Maxima of box-filter determinants with their wavelet sums, the strongest first; ``upright`` ones have no direction."""
    sums, out = integral(stretched(np.asarray(x, dtype=float))), []
    layers: dict[int, np.ndarray] = {}
    for sizes in SIZES:
        if min(x.shape) <= sizes[-1] + 2:
            break
        for s in sizes:
            if s not in layers:
                layers[s] = determinant(sums, s)
        for k in (1, 2):
            stack = np.stack([layers[s] for s in sizes[k - 1 : k + 2]])
            inner = stack[1, 1:-1, 1:-1]
            near = np.full(inner.shape, -np.inf)
            h, w = stack.shape[1:]
            for a in range(3):
                for b in range(3):
                    for c in range(3):
                        if (a, b, c) != (1, 1, 1):
                            near = np.maximum(near, stack[a, b : h - 2 + b, c : w - 2 + c])
            for y, z in (np.argwhere((inner > threshold) & (inner > near)) + 1).tolist():
                found = _peak(stack, y, z)
                if found is None or found[1] <= threshold:
                    continue
                step, response = found
                scale = 1.2 * (sizes[k] + step[0] * (sizes[k + 1] - sizes[k])) / 9
                py, px = y + step[1], z + step[2]
                angle = 0.0 if upright else direction(sums, py, px, scale)
                out.append((Keypoint(float(py), float(px), float(scale), angle, response), wavelet_sums(sums, py, px, scale, angle)))
    return sorted(out, key=lambda f: (-f[0].response, f[0].y, f[0].x, f[0].size))
