"""Vectorised scanning of text columns inside Arrow tasks.

A text column arrives as one byte buffer with offsets. The helpers here find words and hash byte
ranges for whole chunks of rows with numpy, so that no task handles single words in Python and
memory stays near ``CHUNK_BYTES`` times a small factor whatever the batch size. Null texts count
as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text forms a chunk of its own.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: Values of the bytes, in two tables for two independent hashes.
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between ASCII white space: [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, held = col.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, at + 65536, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no row border: starts, ends, and n + 1 offsets of rows in them."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty_like(member), np.empty_like(member)
    before[0] = after[-1] = False
    before[1:], after[:-1] = member[:-1], member[1:]
    inner = offsets[(offsets > 0) & (offsets < len(member))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        if len(_powers) > 1:
            _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """n + 1 prefix sums from which ``range_hash`` gets the hash of any byte range, the first or the second."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[which][data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(U64))


def packed_words(data: np.ndarray, member: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of ``member`` bytes as an Arrow array of strings, and the row of each."""
    starts, ends, at = spans(member, offsets)
    size = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(data[member])])
    return words, np.repeat(np.arange(len(offsets) - 1), np.diff(at))
