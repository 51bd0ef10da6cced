"""Images as rows (image_id, height, width, pixels): grey values row by row as an array of doubles.

Each operator is one kernel over Arrow batches; an image is handled alone, so a batch of images
is all that a task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "image_id long, height int, width int, pixels array<double>"


def per_image(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The images after a kernel on their matrices."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, h, w, p in zip(frame["image_id"], frame["height"], frame["width"], frame["pixels"], strict=True):
                out = kernel(np.asarray(p, dtype=float).reshape(int(h), int(w)))
                rows.append((i, *out.shape, out.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "height", "width", "pixels"])

    return images.select("image_id", "height", "width", "pixels").mapInPandas(run, IMAGE)


def _around(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    h, w = x.shape
    return x[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]


#: Neighbours clockwise from the top left, the first has the highest bit.
_CLOCKWISE = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def lbp_original(x: np.ndarray) -> np.ndarray:
    centre = _around(x, 0, 0)
    code = np.zeros(centre.shape)
    for bit, (dy, dx) in enumerate(_CLOCKWISE):
        code += (_around(x, dy, dx) >= centre) * float(1 << (7 - bit))
    return code


def _circle(x: np.ndarray, radius: float, neighbors: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The centres and the bilinear samples on a circle around them."""
    theta = 2 * np.pi * np.arange(neighbors) / neighbors
    dy, dx = -radius * np.sin(theta), radius * np.cos(theta)
    top, left = int(-np.floor(min(dy.min(), 0))), int(-np.floor(min(dx.min(), 0)))
    bottom, right = int(np.ceil(max(dy.max(), 0))), int(np.ceil(max(dx.max(), 0)))
    h, w = x.shape[0] - top - bottom, x.shape[1] - left - right
    samples = []
    for a, b in zip(dy + top, dx + left, strict=True):
        ya, xa = int(np.floor(a)), int(np.floor(b))
        yb, xb, ty, tx = int(np.ceil(a)), int(np.ceil(b)), a - np.floor(a), b - np.floor(b)
        at = lambda y, z: x[y : y + h, z : z + w]
        samples.append((1 - ty) * ((1 - tx) * at(ya, xa) + tx * at(ya, xb)) + ty * ((1 - tx) * at(yb, xa) + tx * at(yb, xb)))
    return x[top : top + h, left : left + w], samples


def lbp_circular(radius: float = 1, neighbors: int = 8) -> Callable[[np.ndarray], np.ndarray]:
    def kernel(x: np.ndarray) -> np.ndarray:
        centre, samples = _circle(x, radius, neighbors)
        return sum(((s >= centre) * float(1 << i) for i, s in enumerate(samples)), np.zeros(centre.shape))

    return kernel


def lbp_variance(radius: float = 1, neighbors: int = 8) -> Callable[[np.ndarray], np.ndarray]:
    """The variance of the samples on the circle, over one less than their number."""
    return lambda x: np.var(np.stack(_circle(x, radius, neighbors)[1]), axis=0, ddof=1)


def grid_histogram(codes: np.ndarray, rows: int = 8, cols: int = 8, bins: int = 256) -> np.ndarray:
    """Density histograms of the cells of a grid, one after the other; the remainder at the border is left out."""
    py, px = codes.shape[0] // rows, codes.shape[1] // cols
    out = []
    for r in range(rows):
        for c in range(cols):
            cell = codes[r * py : (r + 1) * py, c * px : (c + 1) * px]
            h = np.bincount(cell.astype(int).ravel(), minlength=bins)[:bins].astype(float)
            out.append(h / max(h.sum(), 1.0))
    return np.concatenate(out)[None, :]


def spatial_histogram(operator: Callable[[np.ndarray], np.ndarray] = lbp_original, rows: int = 8, cols: int = 8, bins: int = 256) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: grid_histogram(operator(x), rows, cols, bins)


def equalized(bins: int = 256) -> Callable[[np.ndarray], np.ndarray]:
    def kernel(x: np.ndarray) -> np.ndarray:
        h, edges = np.histogram(x, bins, density=True)
        cdf = np.cumsum(h)
        return np.interp(x.ravel(), edges[:-1], 255 * cdf / cdf[-1]).reshape(x.shape)

    return kernel


def gaussian(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """A separable Gaussian with mirrored borders."""
    n = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(n, n) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(x, pad, mode="symmetric")
        x = np.apply_along_axis(lambda row: np.convolve(row, k, mode="valid"), axis, padded)
    return x


def difference_of_gaussians(x: np.ndarray, inner: float, outer: float) -> np.ndarray:
    """The wider Gaussian less the narrower one; what is only rounding, as in even areas, is zero."""
    d = gaussian(x, outer) - gaussian(x, inner)
    return np.where(np.abs(d) < 1e-9, 0.0, d)


def illumination_normalized(alpha: float = 0.1, tau: float = 10.0, gamma: float = 0.2, inner: float = 1.0, outer: float = 2.0) -> Callable[[np.ndarray], np.ndarray]:
    """Gamma, difference of Gaussians, two-stage contrast and a soft limit."""
    def kernel(x: np.ndarray) -> np.ndarray:
        x = difference_of_gaussians(np.power(x, gamma), inner, outer)
        level = lambda v: max(np.mean(np.power(v, alpha)) ** (1 / alpha), 1e-12)
        x = x / level(np.abs(x))
        x = x / level(np.minimum(np.abs(x), tau))
        return tau * np.tanh(x / tau)

    return kernel


def stretched(x: np.ndarray) -> np.ndarray:
    span = x.max() - x.min()
    return (x - x.min()) / span if span else np.zeros_like(x)


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.floor(255 * x)


def inverted(x: np.ndarray) -> np.ndarray:
    return x.max() - x


def contrast(x: np.ndarray, a: float) -> np.ndarray:
    return x * (a + 1) / (np.abs(x) + a)


def face_normalized(a: float = 0.5, inner: float = 1.0, outer: float = 2.0) -> Callable[[np.ndarray], np.ndarray]:
    """The ratio of a difference of Gaussians to their sum, with a contrast curve."""
    def kernel(x: np.ndarray) -> np.ndarray:
        c, s = gaussian(x, inner), gaussian(x, outer)
        return stretched(contrast((c - s) / (c + s + 1e-6), a))

    return kernel


def luv_channel(bgr: np.ndarray, channel: str) -> np.ndarray:
    """One channel of L*u*v* of a BGR byte image, stretched to whole bytes."""
    c = bgr[..., ::-1] / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    x, y, z = np.moveaxis(c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T, -1, 0)
    l = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    d = np.maximum(x + 15 * y + 3 * z, 1e-12)
    u, v = 13 * l * (4 * x / d - 0.19793943), 13 * l * (9 * y / d - 0.46831096)
    return np.floor(255 * stretched({"L": l, "U": u, "V": v}[channel.upper()]) + 0.5)


def minmax(images: DataFrame, low: float, high: float) -> DataFrame:
    """Pixels scaled by the least and the largest value of the whole table."""
    lo = images.agg(F.min(F.array_min("pixels"))).scalar()
    hi = images.agg(F.max(F.array_max("pixels"))).scalar()
    bounds = images.select("*", lo.alias("__lo"), hi.alias("__hi"))
    return bounds.select("image_id", "height", "width", F.transform("pixels", lambda p: low + F.try_divide((p - F.col("__lo")) * (high - low), F.col("__hi") - F.col("__lo"))).alias("pixels"))


def zscore(images: DataFrame) -> DataFrame:
    """Pixels centred and scaled by the mean and deviation of the whole table."""
    flat = images.select(F.explode("pixels").alias("p"))
    m, s = flat.agg(F.avg("p")).scalar(), flat.agg(F.stddev_pop("p")).scalar()
    with_ = images.select("*", m.alias("__m"), s.alias("__s"))
    return with_.select("image_id", "height", "width", F.transform("pixels", lambda p: F.try_divide(p - F.col("__m"), F.col("__s"))).alias("pixels"))


def corner_response(x: np.ndarray, k: float = 0.04) -> np.ndarray:
    if min(x.shape) < 2:
        return np.zeros(x.shape)
    gy, gx = np.gradient(x)
    a, b, c = gaussian(gx * gx, 1.5), gaussian(gx * gy, 1.5), gaussian(gy * gy, 1.5)
    return a * c - b * b - k * (a + c) ** 2


def least_eigenvalue(x: np.ndarray) -> np.ndarray:
    """The lesser eigenvalue of the mean products of gradients around each pixel: large where these go in several directions."""
    if min(x.shape) < 2:
        return np.zeros(x.shape)
    gy, gx = np.gradient(x)
    a, b, c = gaussian(gx * gx, 1.5), gaussian(gx * gy, 1.5), gaussian(gy * gy, 1.5)
    return (a + c) / 2 - np.sqrt((a - c) ** 2 / 4 + b * b)


CORNERS = {"HARRIS": corner_response, "GFTT": least_eigenvalue}


def fast_score(x: np.ndarray, threshold: float = 20.0, run: int = 9) -> np.ndarray:
    """How much an arc of a radius-three circle is brighter or darker than its centre; zero without one."""
    ring = ((0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1), (-3, 0), (-3, 1), (-2, 2), (-1, 3))
    h, w = x.shape
    score = np.zeros(x.shape)
    if h < 7 or w < 7:
        return score
    d = np.stack([x[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] - x[3 : h - 3, 3 : w - 3] for dy, dx in ring])
    for sign in (1, -1):
        ext = np.concatenate([sign * d, sign * d[: run - 1]])
        arcs = np.stack([ext[i : i + run].min(axis=0) for i in range(16)]).max(axis=0)
        score[3 : h - 3, 3 : w - 3] = np.maximum(score[3 : h - 3, 3 : w - 3], np.where(arcs > threshold, arcs, 0))
    return score


def peaks(r: np.ndarray, least: float, most: int | None = None) -> list[tuple[int, int, float]]:
    """(y, x, value) of values above all eight neighbours and the given one, the largest first."""
    if min(r.shape) < 3:
        return []
    p = np.pad(r, 1, constant_values=-np.inf)
    near = np.stack([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]).max(axis=0)
    ys, xs = np.nonzero((r > near) & (r > least))
    order = np.lexsort((xs, ys, -r[ys, xs]))[:most]
    return [(int(ys[k]), int(xs[k]), float(r[ys[k], xs[k]])) for k in order]


def gradient_cells(x: np.ndarray, places: list[tuple[int, int]]) -> list[list[float]]:
    """Orientation histograms of gradients in 4 x 4 cells of 4 pixels around each place, scaled to length one."""
    gy, gx = np.gradient(np.pad(x, 8, mode="edge"))
    size, turn = np.hypot(gx, gy), ((np.arctan2(gy, gx) + np.pi) / (2 * np.pi) * 8).astype(int) % 8
    cell = (np.arange(16)[:, None] // 4 * 4 + np.arange(16)[None, :] // 4) * 8
    out = []
    for a, b in places:
        d = np.bincount((cell + turn[a : a + 16, b : b + 16]).ravel(), weights=size[a : a + 16, b : b + 16].ravel(), minlength=128)
        out.append((d / (np.linalg.norm(d) or 1.0)).tolist())
    return out


DETECTORS = ("HARRIS", "GFTT", "FAST", "STAR", "DENSE", "MSER", "SIMPLEBLOB", "SIFT", "SURF", "BRISK", "ORB", "BRIEF")
#: Detectors that bring their own descriptor.
OWN = ("SIFT", "SURF", "BRISK", "ORB", "BRIEF")


def features_of(images: DataFrame, keypoint: str = "HARRIS", descriptor: str = "GRADIENT", max_kp: int = 9999, step: int = 8) -> DataFrame:
    """(feature_id, image_id, x, y, response, descriptor) of grey images.

    Corners (``HARRIS``, ``GFTT`` for the lesser eigenvalue), arcs (``FAST``), stars, stable regions, blobs or a dense grid;
    each is described by orientation histograms of gradients in a 4 x 4 grid around it, scaled to length one, or with
    ``FREAK`` by the bits of retinal fields.  ``SIFT``, ``SURF``, ``BRISK``, ``ORB`` and ``BRIEF`` are the scale-space,
    box-filter, ring, oriented and upright binary features of ``keypoints``, ``boxes`` and ``rings``, whatever the
    descriptor named with them.
    """
    from vecmosaic.operators import boxes, keypoints, regions, rings, stars

    kind, bits = keypoint.upper(), descriptor.upper()
    if kind not in DETECTORS or (kind not in OWN and bits not in ("GRADIENT", "FREAK")):
        raise ValueError(f"unknown keypoint {keypoint} or descriptor {descriptor}")
    own_kind = {
        "SIFT": keypoints.scale_space_features, "SURF": boxes.box_features, "BRISK": rings.ring_features,
        "ORB": keypoints.binary_features, "BRIEF": lambda x: keypoints.binary_features(x, False),
    }
    places = {"MSER": regions.stable_regions, "SIMPLEBLOB": regions.blobs, "STAR": stars.star_keypoints}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, h, w, p in zip(frame["image_id"], frame["height"], frame["width"], frame["pixels"], strict=True):
                x = np.asarray(p, dtype=float).reshape(int(h), int(w))
                if kind in OWN:
                    own = own_kind[kind](x)
                    rows += [(int(i) * 1_000_000 + k, int(i), q.x, q.y, q.response, d.tolist()) for k, (q, d) in enumerate(own[:max_kp])]
                    continue
                if kind == "DENSE":
                    found = [(a, b, 1.0) for a in range(step // 2, x.shape[0], step) for b in range(step // 2, x.shape[1], step)][:max_kp]
                elif kind in places:
                    found = [(q.y, q.x, q.response) for q in places[kind](x)[:max_kp]]
                else:
                    found = peaks(CORNERS[kind](x) if kind in CORNERS else fast_score(x), 0.0, max_kp)
                if bits == "FREAK":
                    described = [d.tolist() for d in rings.retinal_bits(x, [(a, b) for a, b, _ in found])]
                else:
                    described = gradient_cells(x, [(round(a), round(b)) for a, b, _ in found])
                for k, ((a, b, r), d) in enumerate(zip(found, described, strict=True)):
                    rows.append((int(i) * 1_000_000 + k, int(i), float(b), float(a), r, d))
            yield pd.DataFrame(rows, columns=["feature_id", "image_id", "x", "y", "response", "descriptor"])

    return images.select("image_id", "height", "width", "pixels").mapInPandas(run, "feature_id long, image_id int, x double, y double, response double, descriptor array<double>")


def crops(images: DataFrame, size: int, n: int, seed: int = 7) -> DataFrame:
    """n crops of each image at hashed places: (image_id, crop, left, top, height, width, pixels)."""
    place = lambda salt, span: F.pmod(F.xxhash64("image_id", "crop", F.lit(salt), F.lit(seed)), F.greatest(span - size + 1, F.lit(1))).cast("int")
    rows = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("crop")).where((F.col("height") >= size) & (F.col("width") >= size))
    rows = rows.withColumn("left", place(1, F.col("width"))).withColumn("top", place(2, F.col("height")))
    lines = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice("pixels", (F.col("top") + r) * F.col("width") + F.col("left") + 1, size))
    return rows.select("image_id", "crop", "left", "top", F.lit(size).alias("height"), F.lit(size).alias("width"), F.flatten(lines).alias("pixels"))


def warp(base: np.ndarray, other: np.ndarray, h: np.ndarray, clamp: int = 2000) -> np.ndarray:
    """``other`` brought into the frame of ``base`` by the homography h, laid under it on a common canvas."""
    hh, ww = other.shape
    ends = np.array([[0, 0, 1], [ww - 1, 0, 1], [0, hh - 1, 1], [ww - 1, hh - 1, 1]]) @ h.T
    ends = np.clip(ends[:, :2] / ends[:, 2:], -clamp, clamp)
    lo = np.floor(np.minimum(ends.min(axis=0), 0)).astype(int)
    hi = np.ceil(np.maximum(ends.max(axis=0), [base.shape[1] - 1, base.shape[0] - 1])).astype(int)
    ys, xs = np.mgrid[lo[1] : hi[1] + 1, lo[0] : hi[0] + 1]
    p = np.stack([xs, ys, np.ones_like(xs)], axis=-1) @ np.linalg.inv(h).T
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = p[..., 0] / p[..., 2], p[..., 1] / p[..., 2]
    ok = (u >= 0) & (v >= 0) & (u <= ww - 1) & (v <= hh - 1)
    u0, v0 = np.where(ok, np.floor(u), 0).astype(int), np.where(ok, np.floor(v), 0).astype(int)
    u1, v1 = np.minimum(u0 + 1, ww - 1), np.minimum(v0 + 1, hh - 1)
    tu, tv = np.where(ok, u, 0) - u0, np.where(ok, v, 0) - v0
    out = np.where(ok, (1 - tv) * ((1 - tu) * other[v0, u0] + tu * other[v0, u1]) + tv * ((1 - tu) * other[v1, u0] + tu * other[v1, u1]), 0.0)
    out[-lo[1] : -lo[1] + base.shape[0], -lo[0] : -lo[0] + base.shape[1]] = base
    return out


def resized_centre(share: float, height: int, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """An image brought to a share of its size by area means, then its centre."""
    def kernel(x: np.ndarray) -> np.ndarray:
        h, w = max(1, round(x.shape[0] * share)), max(1, round(x.shape[1] * share))
        cut = lambda n, m: np.linspace(0, n, m + 1).round().astype(int)
        ys, xs = cut(x.shape[0], h), cut(x.shape[1], w)
        small = np.array([[x[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(xs, xs[1:], strict=False)] for a, b in zip(ys, ys[1:], strict=False)])
        top, left = max(0, (h - height) // 2), max(0, (w - width) // 2)
        return small[top : top + height, left : left + width]

    return kernel
