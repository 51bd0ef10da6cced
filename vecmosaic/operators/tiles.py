"""Large images as tiles with halos, so that an image of any size is many tasks.

A tile is a row: a core, which belongs to it alone, and a halo of pixels around it that other tiles own, as far as
the image goes.  A kernel sees core and halo and its result is cut to the core, so results agree at the seams and
don't depend on the tile's size as long as the halo is as wide as the kernel reaches.  At the image's own border
the tile ends there too, and the kernel's border rule applies.

What needs a whole image (least and largest value, histogram, mean) is aggregated from the tiles and joined back.
Tiles come from images, or from a table of patches that no task ever puts together as one image.

An empty table has no tiles; null pixels are zero; pixels that no patch covers are zero; of patches at one
place the first in order of their values counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmosaic.operators import images as I

#: An image's size; the place and size of the pixels held; the place and size of the core.
TILE = "image_id long, height int, width int, top int, left int, rows int, cols int, core_top int, core_left int, core_rows int, core_cols int, pixels array<double>"
#: A part of a result of the given size, without overlap.
PIECE = "image_id long, height int, width int, top int, left int, rows int, cols int, pixels array<double>"
_NAMES = [x.split()[0] for x in TILE.split(", ")]


def _record(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "double": pa.float64()}
    fields = [x.split(" ", 1) for x in kind.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _spans(size: int, tile: int, halo: int) -> list[tuple[int, int, int, int]]:
    """(begin, length, core begin, core length) of the tiles along one side."""
    return [(max(0, a - halo), min(size, a + tile + halo) - max(0, a - halo), a, min(size, a + tile) - a) for a in range(0, size, tile)]


def tiles_of(images: DataFrame, tile: int, halo: int) -> DataFrame:
    """The tiles of (image_id, height, width, pixels)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                image, h, w = (batch.column(c)[i].as_py() for c in ("image_id", "height", "width"))
                x = _pixels(batch.column("pixels"), i).reshape(h, w)
                for t, n, ct, cn in _spans(h, tile, halo):
                    yield _record([(image, h, w, t, l, n, m, ct, cl, cn, cm, x[t : t + n, l : l + m].ravel()) for l, m, cl, cm in _spans(w, tile, halo)], TILE)

    return images.select("image_id", "height", "width", "pixels").mapInArrow(cut, TILE)


def _pixels(column: pa.Array, i: int) -> np.ndarray:
    return np.nan_to_num(column[i].values.to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)


def tiles_from_patches(patches: DataFrame, side: int, height: int, width: int, tile: int, halo: int) -> DataFrame:
    """The tiles of images of height x width pixels, from patches (image_id, row, col, pixels) of side x side pixels.

    Row and column count patches.  A patch goes to each tile whose core or halo it meets; every image that has a patch has
    all of its tiles.
    """
    parallel = int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tall, wide = -(-height // tile), -(-width // tile)

    def meets(at: str, most: int) -> Column:
        first = F.greatest(F.floor((F.col(at) * side - halo) / F.lit(tile)), F.lit(0))
        last = F.least(F.floor((F.col(at) * side + side - 1 + halo) / F.lit(tile)), F.lit(most - 1))
        return F.explode(F.sequence(first.cast("int"), F.greatest(last, first).cast("int")))

    inside = patches.where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") * side < height) & (F.col("col") * side < width))
    inside = inside.select(F.col("image_id").cast("long"), F.col("row").cast("int"), F.col("col").cast("int"), F.col("pixels").cast("array<double>"))
    placed = inside.withColumn("tr", meets("row", tall)).withColumn("tc", meets("col", wide))
    every = inside.select("image_id").distinct().select("image_id", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("array<double>").alias("pixels"))
    every = every.withColumn("tr", F.explode(F.sequence(F.lit(0), F.lit(tall - 1)))).withColumn("tc", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    met = placed.unionByName(every).repartition(parallel, "image_id", "tr", "tc").sortWithinPartitions("image_id", "tr", "tc", F.desc_nulls_last("row"), "col", F.desc("pixels"))
    rows, cols = _spans(height, tile, halo), _spans(width, tile, halo)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x = None, None

        def out() -> tuple:
            (t, n, ct, cn), (l, m, cl, cm) = rows[now[1]], cols[now[2]]
            return (now[0], height, width, t, l, n, m, ct, cl, cn, cm, x.ravel())

        for batch in batches:
            done = []
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("image_id", "tr", "tc")), strict=True)):
                if key != now:
                    if now:
                        done.append(out())
                    now, x = key, np.zeros((rows[key[1]][1], cols[key[2]][1]))
                r = batch.column("row")[i].as_py()
                if r is None or not batch.column("pixels")[i].is_valid:
                    continue
                p = _pixels(batch.column("pixels"), i)
                p = np.pad(p[: side * side], (0, max(0, side * side - len(p)))).reshape(side, side)
                a, b = r * side - rows[now[1]][0], batch.column("col")[i].as_py() * side - cols[now[2]][0]
                part = x[max(a, 0) : max(a + side, 0), max(b, 0) : max(b + side, 0)]
                part[:] = p[max(-a, 0) :, max(-b, 0) :][: part.shape[0], : part.shape[1]]
            if done:
                yield _record(done, TILE)
        if now:
            yield _record([out()], TILE)

    return met.select("image_id", "tr", "tc", "row", "col", "pixels").mapInArrow(put, TILE)


def per_tile(tiles: DataFrame, kernel: Callable[..., np.ndarray], margins: tuple[int, int, int, int] = (0, 0, 0, 0), aux: tuple[str, ...] = ()) -> DataFrame:
    """PIECEs: the kernel's results on the cores.

    ``margins`` are the lines that the kernel's result lacks at the top, left, bottom and right.  Columns named in
    ``aux`` go to the kernel after the pixels.
    """
    above, before, below, after = margins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in _NAMES[:-1]), strict=True)):
                image, h, w, top, left, rows, cols, ct, cl, cn, cm = row
                x = _pixels(batch.column("pixels"), i).reshape(rows, cols)
                height, width = h - above - below, w - before - after
                if height <= 0 or width <= 0 or rows <= above + below or cols <= before + after:
                    continue
                y = kernel(x, *(np.asarray(batch.column(c)[i].as_py(), dtype=float) for c in aux))
                # a result's place is that of the pixel it stands for, less the lines that are missing
                t, l = max(ct - above, 0), max(cl - before, 0)
                n, m = min(ct + cn - above, height) - t, min(cl + cm - before, width) - l
                if n > 0 and m > 0:
                    out.append((image, height, width, t, l, n, m, y[t - top : t - top + n, l - left : l - left + m].ravel()))
            if out:
                yield _record(out, PIECE)

    return tiles.select(*_NAMES, *aux).mapInArrow(run, PIECE)


def cores(tiles: DataFrame) -> DataFrame:
    """The pixels themselves as PIECEs."""
    return per_tile(tiles, lambda x: x)


def long(pieces: DataFrame, digits: int = 6) -> DataFrame:
    """(image_id, r, c, v): a row per pixel."""
    flat = pieces.select("image_id", "top", "left", "cols", F.posexplode("pixels").alias("k", "v"))
    at = lambda first, k: (F.col(first) + k).cast("long")
    return flat.select("image_id", at("top", F.floor(F.col("k") / F.col("cols"))).alias("r"), at("left", F.col("k") % F.col("cols")).alias("c"), (F.round("v", digits) + 0.0).alias("v"))


def assembled(pieces: DataFrame) -> DataFrame:
    """(image_id, height, width, pixels): whole images, each in one task; for images that fit one."""

    def join(group: pa.Table) -> pa.Table:
        h, w = group.column("height")[0].as_py(), group.column("width")[0].as_py()
        x = np.zeros((h, w))
        for r in group.to_pylist():
            x[r["top"] : r["top"] + r["rows"], r["left"] : r["left"] + r["cols"]] = np.reshape(r["pixels"], (r["rows"], r["cols"]))
        return pa.Table.from_batches([_record([(group.column("image_id")[0].as_py(), h, w, x.ravel())], I.IMAGE)])

    return pieces.groupBy("image_id").applyInArrow(join, I.IMAGE)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def with_range(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Tiles or pieces with the least and largest value (``lo``, ``hi``) of their image in ``pieces``."""
    of = pieces.groupBy("image_id").agg(F.min(F.array_min("pixels")).alias("lo"), F.max(F.array_max("pixels")).alias("hi"))
    return rows.join(of, "image_id")


def _mapped(rows: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn("pixels", F.transform("pixels", f))


def stretched(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Tiles or pieces scaled to 0..1 by the range of their image in ``pieces``; an even image is zero."""
    span = F.col("hi") - F.col("lo")
    return _mapped(with_range(rows, pieces), lambda p: F.coalesce(F.try_divide(p - F.col("lo"), span), F.lit(0.0))).drop("lo", "hi")


def inverted(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each value taken from the largest of its image in ``pieces``."""
    return _mapped(with_range(rows, pieces), lambda p: F.col("hi") - p).drop("lo", "hi")


def minmax(pieces: DataFrame, low: float, high: float) -> DataFrame:
    """Scaled by the least and the largest value of the whole table."""
    s = pieces.agg(F.min(F.array_min("pixels")).alias("lo"), F.max(F.array_max("pixels")).alias("hi")).first()  # one row
    if s["lo"] is None:
        return pieces
    return _mapped(pieces, lambda p: low + F.try_divide((p - F.lit(s["lo"])) * (high - low), F.lit(s["hi"] - s["lo"])))


def zscore(pieces: DataFrame) -> DataFrame:
    """Centred and scaled by the mean and deviation of the whole table."""
    s = pieces.agg(F.sum(_sum(F.col("pixels"))).alias("sum"), F.sum(F.size("pixels")).alias("n")).first()  # one row
    if not s["n"]:
        return pieces
    m = s["sum"] / s["n"]
    v = pieces.agg(F.sum(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))).first()[0] / s["n"]
    return _mapped(pieces, lambda p: F.try_divide(p - F.lit(m), F.lit(v**0.5)))


def equalized(tiles: DataFrame, bins: int = 256) -> DataFrame:
    """PIECEs with each image's values spread by the running sum of its histogram."""
    own = cores(tiles)
    ranged = with_range(own, own)
    width = (F.col("hi") - F.col("lo")) / bins
    of = lambda p: F.least(F.coalesce(F.floor(F.try_divide(p - F.col("lo"), width)), F.lit(0)).cast("int"), F.lit(bins - 1))
    counts = ranged.select("image_id", F.explode(F.transform("pixels", of)).alias("bin")).groupBy("image_id", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # a row per bin and image
    held = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("total"))
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0.0)))
    h = held.select("image_id", F.transform(each, lambda n: n / F.col("total")).alias("share"))
    ready = with_range(tiles, own).join(h, "image_id").withColumn("range", F.array("lo", "hi"))

    def spread(x: np.ndarray, share: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lo, hi = ends if ends[1] > ends[0] else (ends[0] - 0.5, ends[0] + 0.5)
        return np.interp(x.ravel(), np.linspace(lo, hi, bins + 1)[:-1], 255 * np.cumsum(share)).reshape(x.shape)

    return per_tile(ready, spread, aux=("share", "range"))


def histograms(pieces: DataFrame, rows: int, cols: int) -> DataFrame:
    """(image_id, cell, code, v): how often each value occurs in the cells of a grid, as a share of the cell's pixels.

    Cells are numbered row by row; the remainder at the border is left out.
    """
    py, px = F.floor(F.col("height") / rows), F.floor(F.col("width") / cols)
    flat = long(pieces).join(pieces.groupBy("image_id").agg(F.first("height").alias("height"), F.first("width").alias("width")), "image_id")
    gr, gc = F.floor(F.col("r") / py), F.floor(F.col("c") / px)
    cell = flat.where((gr < rows) & (gc < cols)).groupBy("image_id", (gr * cols + gc).alias("cell"), F.col("v").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.first(py * px).alias("area"))
    return cell.select("image_id", "cell", "code", (F.col("n") / F.col("area")).alias("v"))


def illumination_normalized(tiles: DataFrame, alpha: float = 0.1, tau: float = 10.0, gamma: float = 0.2, inner: float = 1.0, outer: float = 2.0) -> DataFrame:
    """PIECEs after gamma, difference of Gaussians, two-stage contrast over the image and a soft limit.

    The halo is to be at least four times ``outer``, rounded up.
    """

    def local(x: np.ndarray) -> np.ndarray:
        return I.difference_of_gaussians(np.power(x, gamma), inner, outer)

    def levelled(pieces: DataFrame, size: Callable[[Column], Column]) -> DataFrame:
        of = pieces.groupBy("image_id").agg((F.sum(_sum(F.transform("pixels", lambda p: F.pow(size(p), F.lit(alpha))))) / F.sum(F.size("pixels"))).alias("mean"))
        scale = F.greatest(F.pow("mean", F.lit(1 / alpha)), F.lit(1e-12))
        return _mapped(pieces.join(of.select("image_id", scale.alias("level")), "image_id"), lambda p: p / F.col("level")).drop("level")

    from vecmosaic.session import written

    pieces = written(per_tile(tiles, local), "tiles")
    pieces = written(levelled(pieces, F.abs), "tiles")
    pieces = levelled(pieces, lambda p: F.least(F.abs(p), F.lit(tau)))
    return _mapped(pieces, lambda p: tau * F.tanh(p / tau))


def face_normalized(tiles: DataFrame, a: float = 0.5, inner: float = 1.0, outer: float = 2.0) -> DataFrame:
    """PIECEs with the ratio of a difference of Gaussians to their sum, a contrast curve, scaled to 0..1."""

    def local(x: np.ndarray) -> np.ndarray:
        c, s = I.gaussian(x, inner), I.gaussian(x, outer)
        return I.contrast((c - s) / (c + s + 1e-6), a)

    from vecmosaic.session import written

    pieces = written(per_tile(tiles, local), "tiles")
    return stretched(pieces, pieces)


FOUND = "feature_id long, image_id long, x double, y double, response double, descriptor array<double>"


def features(tiles: DataFrame, keypoint: str = "HARRIS", step: int = 8) -> DataFrame:
    """FOUND: corners, arcs, or a dense grid over tiles with a halo of 18 at least, each with its gradient histograms.

    A keypoint belongs to the tile whose core it lies in.  Its id is made of the image and the place, so it
    doesn't depend on the tiles.
    """
    kind = keypoint.upper()
    if kind not in (*I.CORNERS, "FAST", "DENSE"):
        raise ValueError(f"{keypoint} isn't found in tiles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in _NAMES[:-1]), strict=True)):
                image, h, w, top, left, rows, cols, ct, cl, cn, cm = row
                x = _pixels(batch.column("pixels"), i).reshape(rows, cols)
                if kind == "DENSE":
                    found = [(a - top, b - left, 1.0) for a in range(step // 2, h, step) for b in range(step // 2, w, step) if ct <= a < ct + cn and cl <= b < cl + cm]
                else:
                    found = I.peaks(I.CORNERS[kind](x) if kind in I.CORNERS else I.fast_score(x), 0.0)
                    found = [(a, b, r) for a, b, r in found if ct <= a + top < ct + cn and cl <= b + left < cl + cm]
                for (a, b, r), d in zip(found, I.gradient_cells(x, [(a, b) for a, b, _ in found]), strict=True):
                    y, z = a + top, b + left
                    out.append((image << 32 | y << 16 | z, image, float(z), float(y), r, d))
            if out:
                yield _record(out, FOUND)

    return tiles.select(*_NAMES).mapInArrow(run, FOUND)


def crops(pieces: DataFrame, size: int, n: int, seed: int = 7) -> DataFrame:
    """n crops of each image at hashed places: (image_id, crop, left, top, total), with the sum of their pixels."""
    place = lambda salt, span: F.pmod(F.xxhash64("image_id", "crop", F.lit(salt), F.lit(seed)), F.greatest(F.col(span) - size + 1, F.lit(1))).cast("int")
    images = pieces.groupBy("image_id").agg(F.first("height").alias("h"), F.first("width").alias("w")).where((F.col("h") >= size) & (F.col("w") >= size))
    rows = images.withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x0", place(1, "w")).withColumn("y0", place(2, "h"))
    y0, x0, top, left, cols = (F.col(c) for c in ("y0", "x0", "top", "left", "cols"))
    met = rows.join(pieces, "image_id").where((top < y0 + size) & (top + F.col("rows") > y0) & (left < x0 + size) & (left + cols > x0))
    # the lines of a piece that lie in the crop
    first, last = F.greatest(y0, top), F.least(y0 + size, top + F.col("rows")) - 1
    a, b = F.greatest(x0, left), F.least(x0 + size, left + cols)
    line = lambda r: _sum(F.slice("pixels", ((r - top) * cols + a - left + 1).cast("int"), (b - a).cast("int")))
    part = _sum(F.transform(F.sequence(first, last), line))
    return met.select("image_id", "crop", x0, y0, part.alias("part")).groupBy("image_id", "crop", F.col("x0").alias("left"), F.col("y0").alias("top")).agg(F.sum("part").alias("total"))
