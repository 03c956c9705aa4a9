"""White-space words of Arrow text columns as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; one longer text is worked on alone.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes in a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else []
    for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
        yield batch.slice(a, b - a)


def words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word in the dictionary, the dictionary, and the words of each text (null: none)."""
    split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if empty >= 0:
        full = numbers != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        numbers = numbers[full]
    return numbers, coded.dictionary, sizes
