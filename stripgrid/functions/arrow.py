"""Between Arrow record batches and NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..layout import Cells, Wide

MAX_EMIT = 1024


def matrix_of(batch: pa.RecordBatch, parts: list[Cells]) -> np.ndarray:
    """Rows of a batch as one dense matrix; several parts sit side by side."""
    pieces = []
    for part in parts:
        if isinstance(part, Wide):
            piece = np.empty((batch.num_rows, part.width))
            for j, name in enumerate(part.names):
                piece[:, j] = batch.column(name).to_numpy(zero_copy_only=False)
        else:
            piece = lists_to_matrix(batch.column(part.name), part.width)
        pieces.append(piece)
    return pieces[0] if len(pieces) == 1 else np.hstack(pieces)


def lists_to_matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if width is None:
        width = len(flat) // len(lists) if len(lists) else 0
    if len(flat) != len(lists) * width:
        raise ValueError(f"ragged matrix: rows are not all {width} long")
    return flat.reshape(len(lists), width)


def matrix_to_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def keyed_rows(constants: dict[str, int], matrix: np.ndarray):
    """Batches (constants..., i, vec), one row per matrix row, split so that no batch grows too large."""
    for start in range(0, len(matrix), MAX_EMIT):
        chunk = matrix[start : start + MAX_EMIT]
        columns = {name: pa.array(np.full(len(chunk), value, dtype=np.int32)) for name, value in constants.items()}
        columns["i"] = pa.array(np.arange(start, start + len(chunk), dtype=np.int32))
        columns["vec"] = matrix_to_lists(chunk)
        yield pa.RecordBatch.from_pydict(columns)
