"""Vectorised word and shingle hashing shared by the text operators.

A batch of texts is joined into one UTF-8 buffer and every word is hashed with
numpy: blocks of eight bytes from the word's start are mixed with their place
and summed, then mixed with the length.  The hash of a word depends on its
bytes alone, never on its place in the buffer, so hashes computed in different
tasks can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd base of the polynomial over the hashes of a few words.
BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; a longer word is hashed alone.
BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first one to eight bytes of a block.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], dtype=U64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.empty(n, dtype=U64)
    out[0] = 1
    size, step = 1, base
    while size < n:
        m = min(size, n - size)
        out[size : size + m] = out[:m] * U64(step)
        size += m
        step = step * step & 0xFFFFFFFFFFFFFFFF
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 0x20 and 0x09-0x0D, and each text's first word."""
    ink = ~_SPACE[raw]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]  # a word never crosses texts
    begin[cut] = ink[cut]
    stop[cut - 1] = ink[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, none of them empty; another salt gives an independent one."""
    out = np.empty(len(starts), dtype=U64)
    first, last = mix(np.array([salt, ~salt & 0xFFFFFFFFFFFFFFFF], dtype=U64))
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, side="right")))
        part = raw[lo : ends[j - 1]]
        padded = np.zeros(len(part) + 8, dtype=np.uint8)
        padded[: len(part)] = _LOWER[part] if lower else part
        at_byte = np.ndarray(shape=(len(part),), dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place
        size, begin = ends[i:j] - starts[i:j], starts[i:j] - lo
        sums = mix(at_byte[begin] & _TAIL[np.minimum(size, 8) - 1] ^ first)
        more = np.flatnonzero(size > 8)
        if len(more):  # the blocks after the first one
            blocks = (size[more] - 1) >> 3
            head = np.cumsum(blocks) - blocks
            within = np.arange(1, blocks.sum() + 1) - np.repeat(head, blocks)
            values = at_byte[np.repeat(begin[more], blocks) + 8 * within]
            values[head + blocks - 1] &= _TAIL[(size[more] - 1) & 7]
            sums[more] += np.add.reduceat(mix(values ^ (first + within.astype(U64) * U64(0xD6E8FEB86659FD93))), head)
        out[i:j] = mix(sums + size.astype(U64) * U64(0xA0761D6478BD642F) + last)
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, by its first word; len(words) - n + 1 of them."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(m, dtype=U64)
    step = 1
    for k in range(n):
        step = step * BASE & 0xFFFFFFFFFFFFFFFF
        out += words[k : k + m] * U64(step)
    return mix(out)


def texts_of(batch: pa.RecordBatch, name: str, limit: int = 4 << 20):
    """Slices of a batch whose texts hold about `limit` bytes each, so that memory stays bounded."""
    raw, offsets = utf8(batch.column(name))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    pa.default_memory_pool().release_unused()  # workers live on; what the batch took doesn't


def lower_texts(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `limit` bytes of text each, their texts in lower case end to end, and offsets; only a slice is copied at a time."""
    for part, _, _ in texts_of(batch, "text", limit):
        yield part, *utf8(pc.utf8_lower(part.column("text").cast(pa.large_string())))


def small_parts(batch: pa.RecordBatch, rows: int = 64, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows and, unless one text is longer, a bounded number of bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        done = size[i - 1] if i else 0
        j = min(i + rows, max(i + 1, int(np.searchsorted(size, done + limit, side="right"))), batch.num_rows)
        yield batch.slice(i, j - i)
        i = j
