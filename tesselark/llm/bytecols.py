"""Text columns as byte arrays: no Python string is made for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once within an Arrow batch; one longer text is worked on alone.
CHUNK_BYTES = 6 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its texts in them (one more than texts); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together (or one text)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(n, to)
        at = to


def class_of_bytes(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the class of the character it belongs to (``table`` by code point), and whether it begins one."""
    classes = table[:256][data]
    if not len(data) or data.max() < 0x80:
        return classes, np.ones(len(data), bool)
    begins = (data & 0xC0) != 0x80
    lead = np.flatnonzero(data >= 0xC0)
    b0 = data[lead].astype(np.int64)
    size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
    tail = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    two = ((b0 & 0x1F) << 6) | tail[0]
    three = ((b0 & 0x0F) << 12) | (tail[0] << 6) | tail[1]
    four = ((b0 & 0x07) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2]
    found = table[np.where(size == 2, two, np.where(size == 3, three, four))]
    classes[lead] = found
    for k in (1, 2, 3):
        has = size > k
        classes[lead[has] + k] = found[has]
    return classes, begins


def expand_runs(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes of runs of the given starts and lengths, run after run."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
