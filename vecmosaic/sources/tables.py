"""Feature, face and graph tables read from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def features(spark: SparkSession, folder: str) -> DataFrame:
    """(feature_id, image_id, x, y, descriptor): one row per local feature.

    The embedding is the descriptor, its label the image; the keypoint is a fixed map of the first
    two components into a 1000 x 1000 frame.
    """
    v = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("long").alias("feature_id"), F.col("label").cast("int").alias("image_id"),
        (500 + 500 * F.element_at(v, 1)).alias("x"), (500 + 500 * F.element_at(v, 2)).alias("y"), v.alias("descriptor"),
    )


def faces(spark: SparkSession, folder: str, groups: int = 5) -> DataFrame:
    """(id, label, grp, vec): vectors with a class and a group for cross-validation."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"),
        (F.col("vec_id") % groups).cast("int").alias("grp"), F.col("embedding").cast("array<double>").alias("vec"),
    )
