"""Arrow batches in portions of bounded bytes.

A batch holds a number of rows, whatever their width. What a stage makes of it (an id of four or
eight bytes for each byte of text, sums of them, places) is many times wider, so it is made
of a portion at a time; a worker's memory then follows the portion and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomtally.session import release_memory

#: Bytes of text or of lists in a portion.
PORTION_BYTES = 1 << 20


def widths(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a column of texts or of lists of numbers; of a null none."""
    if pa.types.is_list(column.type):
        each, length = max(1, column.type.value_type.bit_width // 8), pc.list_value_length(column)
    else:
        each, length = 1, pc.binary_length(column)
    return pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64) * each


def portions(batches: Iterable[pa.RecordBatch], column: str | int, most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in slices of at most `most` bytes of a column, or of one row. Behind
    the last one the worker gives back what it has freed."""
    for batch in batches:
        ends = np.append(0, np.cumsum(widths(batch.column(column))))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()
