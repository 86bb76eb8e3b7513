"""Words of a run of texts as Arrow arrays, found over the bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a run of its own.
RUN = 1 << 23
#: Bytes that belong to words, of the 256: anything but ASCII white space; letters a-z, digits and all of other scripts.
NOT_SPACE, ALPHANUMERIC = np.ones(256, bool), np.zeros(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def runs(column: pa.Array, limit: int = RUN) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of successive runs of a column, of about `limit` bytes each; null texts are empty."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = size[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield first, pc.fill_null(column.slice(first, stop - first), "")
        first = stop


def words(texts: pa.Array, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, the text's number of each): runs of `kept` bytes, A-Z in lower case; no word spans two texts."""
    data = pc.ascii_lower(texts)
    at = np.r_[0, np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64))]
    offsets = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset)
    flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(data) else np.zeros(0, np.uint8)
    inside = kept[flat]
    new = np.zeros(len(flat) + 1, bool)
    new[at[at < len(flat)]] = True  # the first byte of a text
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | new[1:-1]
    begin = np.flatnonzero(starts)
    letters = flat[inside]
    owner = np.searchsorted(at, begin, side="right") - 1
    place = np.cumsum(inside) - 1  # of each kept byte among the kept
    ends = np.r_[place[begin], len(letters)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes())]), owner
