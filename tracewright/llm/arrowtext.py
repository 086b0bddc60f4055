"""Helpers shared by the operators whose tasks read text columns as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Separators of words in the contracts: space and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes that numpy kernels take at a time; temporaries are about ten times this.
BLOCK_BYTES = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def spans(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with at most `limit` bytes together, or of one longer row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): every row whole or, if longer than `limit`, cut after a separator.

    Operators whose result is a sum over words may add up the pieces of a row. A run of more than `limit` bytes without a separator is
    cut where no character is split or, with `whole`, is a piece of its own, whatever its length.
    """
    for at, end in spans(offsets, limit):
        lo, hi = int(offsets[at]), int(offsets[end])
        if end - at > 1 or hi - lo <= limit:
            yield np.arange(at, end), data[lo:hi], offsets[at : end + 1] - lo
            continue
        while lo < hi:
            cut = min(hi, lo + limit)
            if cut < hi:
                found = np.flatnonzero(IS_SPACE[data[lo:cut]])
                if len(found):
                    cut = lo + int(found[-1]) + 1
                elif whole:
                    while cut < hi and not IS_SPACE[data[cut : min(hi, cut + limit)]].any():
                        cut = min(hi, cut + limit)
                    if cut < hi:
                        cut += int(np.flatnonzero(IS_SPACE[data[cut : cut + limit]])[0])
                else:
                    while cut > lo + 1 and data[cut] & 0xC0 == 0x80:
                        cut -= 1
            yield np.array([at]), data[lo:cut], np.array([0, cut - lo])
            lo = cut


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of other bytes than separators, see `gap`) and the row of each; words don't cross rows."""
    solid = ~gap[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts_row = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_row] = solid[starts_row]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends_row = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends_row] = solid[ends_row]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32))


_POWER = np.array([1], np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        with np.errstate(over="ignore"):
            _POWER = np.cumprod(np.full(max(n, 256), 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
    return _POWER


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        size = end - start
        owner_start = np.repeat(start, size)
        total = int(size.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        value = (mix(data[owner_start + inside].astype(np.uint64) + np.uint64(1))) * _powers(int(size.max()) + 1)[inside]
        first = np.cumsum(size) - size
        return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def long_word_hash(data: np.ndarray, limit: int = BLOCK_BYTES) -> np.ndarray:
    """What word_hashes() gives for a single word, from parts of `limit` bytes."""
    base, total = int(_powers(2)[0]), 0
    with np.errstate(over="ignore"):
        for at in range(0, len(data), limit):
            part = data[at : at + limit]
            own = int((mix(part.astype(np.uint64) + np.uint64(1)) * _powers(max(2, len(part)))[: len(part)]).sum(dtype=np.uint64))
            total = (total + own * pow(base, at, 1 << 64)) % (1 << 64)
        return mix(np.array([total], np.uint64) + np.uint64(len(data)) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of `width` consecutive word hashes; of all of them if they are fewer; none without words."""
    if not len(hashes):
        return hashes
    take = min(width, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - take + 1, take, np.uint64)
        for k in range(take):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - take + 1 + k])
    return out
