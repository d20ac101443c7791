"""Arrow helpers: text columns as bytes and code points, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters handled at once; one longer text forms a block of its own.
BLOCK_CHARS = 1 << 20


def blocks(texts: list, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` holding about ``limit`` characters each; null counts nothing."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(texts):
        yield a, len(texts)


def codepoints(text: str) -> np.ndarray:
    """Code points of ``text``."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column of a batch as Python objects."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def list_array(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list array of rows of the given lengths over flat values."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)
