"""Whole groups from Arrow batches that are sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream sorted by the key; the last group waits for the next batch."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if kept and (cut or kept[-1].column(key)[-1].as_py() != k[0]):
            head = kept if not cut else [*kept, batch.slice(0, cut)]
            yield pa.Table.from_batches(head).combine_chunks()
            kept, batch = [], batch.slice(cut)
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
            batch = batch.slice(cut)
        kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def groups(table: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    k = table.column(key).to_numpy()
    cuts = np.flatnonzero(np.diff(k)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True)
