"""Arrow batches cut into pieces of bounded text, so that a worker copies little of one at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batches: Iterator[pa.RecordBatch], *columns: int | str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of each batch with at most ``most`` bytes in the text ``columns`` together, or with one row."""
    for batch in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in columns))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()
