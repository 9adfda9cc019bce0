"""Words of many texts at once: the bytes of an Arrow column as one array, without an object for each text or word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from brolga.llm.common import release

#: Bytes of text that are worked on together; a longer text is a block of its own.
TOGETHER = 1 << 23


def fold_table(delimiters: list[int]) -> np.ndarray:
    """For each byte what it counts as: a delimiter as a blank, A-Z in lower case, all else as itself."""
    table = np.arange(256, dtype=np.uint8)
    table[delimiters] = 32
    table[65:91] = np.where(table[65:91] == 32, 32, table[65:91] + 32)
    return table


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each of them begins and the last one ends. A null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def edges_of(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of bytes inside begin and end, none over the end of a text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(inside))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Maximal runs of other bytes than blanks, none over the end of a text, and the text of each."""
    inside = data != 32
    starts, stops = edges_of(inside, bounds)
    ends = np.cumsum(stops - starts)
    letters = data[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(letters)])
    return words, np.searchsorted(bounds, starts, "right") - 1


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = TOGETHER) -> Iterator[pa.Table]:
    """The rows of all batches in tables of about `most` bytes of the column, in their order; no table is empty."""
    held, size = [], 0
    for batch in batches:
        sizes = np.diff(flat(batch.column(column))[1])
        at = 0
        while at < len(sizes):
            total = size + np.cumsum(sizes[at:])
            n = int(np.searchsorted(total, most, "right")) or (0 if held else 1)
            if n:
                held.append(batch.slice(at, n))
                size, at = int(total[n - 1]), at + n
            if at < len(sizes):
                yield pa.Table.from_batches(held)
                held, size = [], 0
                release()
    if held:
        yield pa.Table.from_batches(held)
