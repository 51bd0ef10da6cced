"""Streams of new features against a static feature table.  An extension: the model itself is batch only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecmosaic.operators.knn import KnnOptions, knn_join


def match_stream(stream: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: KnnOptions = KnnOptions()) -> StreamingQuery:
    """Nearest neighbours of every micro-batch, handed to ``sink`` with the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(knn_join(batch, targets, options), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
