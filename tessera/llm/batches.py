"""Parts of Arrow batches bounded in rows and in bytes of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, text: int, rows: int = 1_000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows whose texts (column ``text``) have ``size`` bytes at most, or a single row."""
    at = 0
    while at < batch.num_rows:
        n = min(batch.num_rows - at, rows)
        while n > 1 and (pc.sum(pc.binary_length(batch.column(text).slice(at, n))).as_py() or 0) > size:
            n //= 2
        yield batch.slice(at, n)
        at += n
