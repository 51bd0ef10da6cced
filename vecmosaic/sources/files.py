"""Readers and writers of the file layouts: images, keypoint files, homographies, face folders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmosaic.operators.images import IMAGE, luv_channel


def read_images(spark: SparkSession, path: str, channel: str = "L", stretch: bool = True, recursive: bool = True, drop_invalid: bool = True) -> DataFrame:
    """(path, image_id, height, width, pixels): one grey channel of every image below a folder.

    ``grey`` is the mean of the colours; L, U and V are channels of L*u*v*.  Ids are a hash of the path.
    """
    raw = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", recursive).load(path)
    rows = raw.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p, h, w, n, d in zip(frame["path"], frame["height"], frame["width"], frame["n"], frame["data"], strict=True):
                x = np.frombuffer(d, dtype=np.uint8).reshape(h, w, n).astype(float)
                x = x[..., :3] if n >= 3 else np.repeat(x, 3, axis=2)
                grey = luv_channel(x, channel) if stretch and channel.lower() != "grey" else x.mean(axis=2)
                out.append((p, h, w, grey.ravel().tolist()))
            yield pd.DataFrame(out, columns=["path", "height", "width", "pixels"])

    grey = rows.mapInPandas(run, "path string, height int, width int, pixels array<double>")
    return grey.select("path", F.xxhash64("path").alias("image_id"), "height", "width", "pixels")


def image_files(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.where(F.lower(F.col(path)).rlike(r"\.(jpe?g|png)$"))


def face_folder(images: DataFrame) -> DataFrame:
    """Images with a label per sub-directory, in name order."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    names = images.select(folder.alias("name")).distinct().withColumn("label", F.dense_rank().over(Window.orderBy("name")) - 1)  # a row per subject
    return images.withColumn("name", folder).join(names, "name")


def read_face_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, grp) from lines of path;class;group."""
    return spark.read.schema("path string, label int, grp int").option("sep", ";").csv(path)


def read_keypoints(spark: SparkSession, path: str, width: int = 128) -> DataFrame:
    """(path, feature_id, row, col, scale, orientation, descriptor) from keypoint text files.

    The header names the number and the width; another width is an error.  Descriptors are scaled
    to length one.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.btrim("value", F.lit(" \n\r\t")), r"\s+").alias("t"))
    n, d = F.element_at("t", 1).cast("int"), F.element_at("t", 2).cast("int")
    text = text.withColumn("n", F.when(d == width, n).otherwise(F.raise_error(F.concat(F.lit("descriptor width "), F.element_at("t", 2)))))
    one = text.where("n > 0").select("path", "t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    at = lambda j: F.element_at("t", F.col("k") * (4 + width) + 3 + j).cast("double")
    v = F.slice("t", F.col("k") * (4 + width) + 7, width).cast("array<double>")
    rows = one.select("path", F.col("k").alias("feature_id"), at(0).alias("row"), at(1).alias("col"), at(2).alias("scale"), at(3).alias("orientation"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).select("path", "feature_id", "row", "col", "scale", "orientation", F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))).alias("descriptor"))


def read_homographies(spark: SparkSession, path: str) -> DataFrame:
    """(path, h): nine numbers of 3 x 3 text matrices."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("path"), F.split(F.btrim("value", F.lit(" \n\r\t")), r"\s+").cast("array<double>").alias("h")).where(F.size("h") == 9)


def write_homographies(rows: DataFrame, path: str) -> None:
    """(name, h) as text matrices, a folder per name."""
    line = lambda k: F.array_join(F.transform(F.slice("h", 3 * k + 1, 3), lambda x: F.format_string("%.18e", x)), " ")
    rows.select("name", F.concat_ws("\n", *[line(k) for k in range(3)]).alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def saved_homography(first: Column, second: Column) -> Column:
    """The file with the homography of two images, next to them."""
    stem = lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.regexp_replace(first, r"[^/]*$", ""), stem(first), F.lit("_"), stem(second), F.lit("_hom.npy"))


def image_pairs(names: DataFrame, folder: str) -> DataFrame:
    """(pair, path1, path2): entries of at most six characters are keys of two images and a matrix."""
    at = lambda n: F.concat(F.lit(f"{folder}/"), "name", F.lit(f"_{n}.jpg"))
    return names.where(F.length("name") <= 6).select(F.col("name").alias("pair"), at(1).alias("path1"), at(2).alias("path2"))


def turntable_path(object_: Column, image_set: Column, angle: Column, camera: Column, lighting: int = 0) -> Column:
    """The pattern of a turntable image's name."""
    return F.format_string("imageset_%d/%s/%s/img_1-%03d_*_0.JPG", image_set, object_, camera, (angle + 360 * lighting).cast("int"))


def calibration_index(angle: Column, pattern: int) -> Column:
    return F.floor(angle / 5).cast("int") * 3 + 1 + pattern


def relative_homography(first: Column, other: Column) -> Column:
    """other times the inverse of first, both arrays of nine, scaled to a last element of one; null elements where that is zero."""
    e = lambda m, k: F.element_at(m, k + 1)
    co = [
        (4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3),
    ]
    # the inverse is this by the determinant, which the scaling takes out again
    adjugate = F.array(*[e(first, a) * e(first, b) - e(first, c) * e(first, d) for a, b, c, d in co])
    product = lambda m: F.array(*[sum((e(other, 3 * r + k) * e(m, 3 * k + c) for k in range(3)), F.lit(0.0)) for r in range(3) for c in range(3)])
    scaled = lambda p: F.transform(p, lambda v: F.try_divide(v, e(p, 8)))
    # each step's array is computed once, as an element that the next one is a function of
    return F.element_at(F.transform(F.transform(F.array(adjugate), product), scaled), 1)


def _png(grey: np.ndarray) -> bytes:
    """A grey image as PNG bytes."""
    import struct
    import zlib

    h, w = grey.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.clip(np.rint(grey), 0, 255).astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write each image as <image_id>.png below a folder that all executors reach; (image_id, path).

    A task that runs again writes the same bytes to the same names.
    """
    from pyarrow import fs

    from vecmosaic.session import checkpointed

    at = folder if ":/" in folder else f"file://{folder}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(at)
        system.create_dir(base, recursive=True)
        for frame in frames:
            for i, h, w, p in zip(frame["image_id"], frame["height"], frame["width"], frame["pixels"], strict=True):
                with system.open_output_stream(f"{base}/{i}.png", compression=None) as out:
                    out.write(_png(np.asarray(p, dtype=float).reshape(int(h), int(w))))
            yield pd.DataFrame({"image_id": frame["image_id"], "path": [f"{at}/{i}.png" for i in frame["image_id"]]})

    return checkpointed(images.select("image_id", "height", "width", "pixels").mapInPandas(run, "image_id long, path string"))


def write_keypoints(features: DataFrame, path: str) -> None:
    """(name, feature_id, row, col, scale, orientation, descriptor array<int>) as one keypoint text file per name."""
    line = F.concat_ws(" ", "row", "col", "scale", "orientation", F.array_join(F.col("descriptor").cast("array<string>"), " "))
    one = features.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("descriptor")).alias("d"), F.array_sort(F.collect_list(F.struct("feature_id", line.alias("line")))).alias("rows"))
    text = F.concat_ws("\n", F.concat_ws(" ", "n", "d"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    one.select("name", text.alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def write_model(model, spark: SparkSession, path: str) -> None:
    """A subspace as a table of numbers."""
    rows = [(k, list(b), float(v)) for k, (b, v) in enumerate(zip(model.basis, model.values, strict=True))] + [(-1, list(model.mean), 0.0)]
    spark.createDataFrame(rows, "k int, vector array<double>, value double").coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str):
    from vecmosaic.operators.faces import Subspace

    rows = {r["k"]: r for r in spark.read.parquet(path).collect()}  # a row per component
    keys = sorted(k for k in rows if k >= 0)
    return Subspace(tuple(rows[-1]["vector"]), tuple(tuple(rows[k]["vector"]) for k in keys), tuple(rows[k]["value"] for k in keys))


__all__ = ["IMAGE", "read_images", "image_files", "face_folder", "read_face_csv", "read_keypoints", "read_homographies", "write_homographies", "saved_homography", "image_pairs", "turntable_path", "calibration_index", "relative_homography", "write_model", "read_model"]
