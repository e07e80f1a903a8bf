"""Texts of Arrow batches as byte arrays, in runs of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are laid out at once; a longer text is a run of its own.
RUN = 1 << 21


def runs(column: pa.Array, most: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row beyond, bytes, offsets) of the texts of a column without nulls.

    A run holds whole texts of at most ``most`` bytes in all, or one longer text; ``offsets`` has where each
    of its rows begins in ``bytes``, and the end.
    """
    texts = column.cast(pa.large_string())
    if not len(texts):
        return
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        beyond = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        beyond = min(max(beyond, first + 1), len(texts))
        yield first, beyond, data[offsets[first] : offsets[beyond]], offsets[first : beyond + 1] - offsets[first]
        first = beyond


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column of bytes that are UTF-8 and the rows' offsets in them."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    ).cast(pa.string())
