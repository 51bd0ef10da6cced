"""Files in the shared folder, reached alike from the driver and from executors.

The folder may be a local mount or any store that Arrow's file systems open by URI.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession

from vecmosaic.session import shared_dir


def as_uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one; its name is unique, so a repeated run never meets old files."""
    at = as_uri(f"{shared_dir(spark)}/vecmosaic/{tag}-{uuid.uuid4().hex}")
    system, path = fs.FileSystem.from_uri(at)
    system.create_dir(path, recursive=True)
    return at


def writer(uri: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None)


def reader(uri: str) -> BinaryIO:
    """A file with random access."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
