"""Arrow string columns as flat numpy code-point arrays, and back.

A batch of texts is one ``uint32`` array of code points plus ``n + 1`` offsets.  One decode call
covers the whole batch; no Python string is made per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codepoints(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, character offsets (n + 1) and validity of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(len(column), bool)
    column = column.fill_null("").cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(starts) == 0 or starts[-1] == starts[0]:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64), valid
    raw = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    try:
        cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:  # ill-formed bytes in a row: each bad sequence becomes U+FFFD
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[:-1] - starts[0], starts[1:] - starts[0])]
        ends = np.cumsum([0, *map(len, rows)])
        return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), ends.astype(np.int64), valid
    seen = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=seen[1:])
    return cps, seen[starts - starts[0]], valid


def to_arrow(cps: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The Arrow string array of these code points; rows that are not valid become null."""
    width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    data = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    mask = None if valid is None or valid.all() else pa.array(valid).buffers()[1]
    big = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets].tobytes()), pa.py_buffer(data), mask)
    return big.cast(pa.string())


def row_ids(offsets: np.ndarray) -> np.ndarray:
    """For each code point the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def slices(batch: pa.RecordBatch, columns: list[int], rows: int = 4000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows whose texts have about ``size`` bytes; a longer text is a slice of its own.

    What is worked on at a time is so bounded, however long the texts of a batch are.
    """
    total = np.cumsum(sum(np.asarray(pc.binary_length(batch.column(c)).fill_null(0)).astype(np.int64) for c in columns))
    at = 0
    while at < len(batch):
        done = int(total[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, done + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end
