"""Arrow batches cut by their bytes of text, so that working memory follows the texts and not the row count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, text: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices with about ``size`` bytes in the string column number ``text``; a longer text stands alone."""
    if not batch.num_rows:
        return
    lengths = batch.column(text).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset + 1 : lengths.offset + len(lengths) + 1]
    base = int(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset])
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, base + size, "right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop
