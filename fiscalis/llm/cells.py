"""Rows sorted by a `cell` column, handed to a function one cell at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _columns(batch: pa.RecordBatch, lists: tuple[str, ...]) -> dict[str, np.ndarray]:
    out = {}
    for name in batch.schema.names:
        column = batch.column(name)
        if name in lists:  # rows of equal length
            out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def each_cell(batches: Iterator[pa.RecordBatch], lists: tuple[str, ...] = ()) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of equal `cell`, as arrays. List columns must have one length within a partition."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _columns(batch, lists)
        if held is not None:
            now = {k: np.concatenate([held[k], now[k]]) for k in now}
        edges = np.r_[0, np.flatnonzero(np.diff(now["cell"])) + 1, len(now["cell"])].tolist()
        for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
            yield {k: v[lo:hi] for k, v in now.items()}
        held = {k: v[edges[-2]:] for k, v in now.items()}
    if held is not None:
        yield held
