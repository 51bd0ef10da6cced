"""Rows of a frame against a whole table: tasks hold some rows and read the table from the shared folder.

The table is written there once, so that a job which is quadratic in time takes disk in proportion to its tables: no
copies of rows are shuffled.  A task has a bounded number of its own rows and one batch of the table at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmosaic.session import new_path


@dataclass(frozen=True)
class Stored:
    """A table in the shared folder, read alike by every task; the folder may be any store that Arrow opens by URI."""

    uri: str

    @staticmethod
    def at(path: str) -> Stored:
        return Stored(path if ":/" in path else f"file://{path}")

    def batches(self, rows: int) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(self.uri)
        for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
            if info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as file:
                    yield from pq.ParquetFile(file).iter_batches(batch_size=rows, use_threads=False)


def stored(df: DataFrame, tag: str) -> Stored:
    at = new_path(df.sparkSession, tag)
    df.write.parquet(at)
    return Stored.at(at)


def held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task in tables of ``rows`` rows, the last one of fewer."""
    kept: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - have)
            batch, have = batch.slice(part.num_rows), have + part.num_rows
            kept.append(part)
            if have == rows:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, have = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def pass_over(rows: DataFrame, n: int | None, key: str, kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, hold: int = 16_384) -> DataFrame:
    """The rows, of which there are about ``n`` if known, dealt by the key and given to the kernel ``hold`` at a time."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts if n is None else max(1, min(n, max(parts, -(-n // hold))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in held(batches, hold):
            yield from kernel(table)

    return rows.repartition(parts, F.col(key)).mapInArrow(run, schema)
