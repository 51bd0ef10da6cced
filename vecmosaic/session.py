"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings win where present."""
    b = SparkSession.builder.appName("vecmosaic")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset.

    The fallback is for single-machine runs such as the tests; a cluster names the folder itself.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext.getCheckpointDir()
        if own:
            return own
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vecmosaic-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has had before."""
    return os.path.join(shared_dir(spark), "vecmosaic", f"{tag}-{uuid.uuid4().hex}")


def written_at(df: DataFrame, at: str) -> tuple[DataFrame, str]:
    """The frame written as Parquet and read back, and its path, for ``discard`` once nothing reads it any more."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: lineage is cut, columns still prune."""
    return written_at(df, new_path(df.sparkSession, tag))[0]


def discard(spark: SparkSession, at: str) -> None:
    """Delete a table of our own in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow frame; Spark's cleaner may remove it once unreferenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Nothing is sent where the workers find it anyway: by PYTHONPATH, or by the working folder of a
    local session.
    """
    sc = spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.master.startswith("local[") or sc.master == "local":
        known.append(os.getcwd())
    if str(ROOT) in known or sc.applicationId in _shipped:
        return
    at = os.path.join(tempfile.mkdtemp(prefix="vecmosaic-"), "vecmosaic.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted([*ROOT.glob("vecmosaic/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)
