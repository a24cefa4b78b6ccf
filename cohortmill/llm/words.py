"""Word hashes of whole Arrow text columns with numpy, in bounded memory.

Every word gets a 64-bit hash of its bytes. Rows are taken in groups of about
``limit`` bytes; a longer text is hashed piece by piece, cut between words, so
the working arrays follow ``limit`` and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1


class Spelling(NamedTuple):
    """Which bytes separate words, and what every other byte is read as."""
    separates: np.ndarray
    reads: np.ndarray


def spelling(separators: bytes, lower: bool) -> Spelling:
    separates = np.zeros(256, bool)
    separates[list(separators)] = True
    reads = np.arange(256, dtype=np.uint8)
    if lower:
        reads[65:91] += 32
    return Spelling(separates, reads)


#: Words between white space, as written.
BLANK = bytes([0x20, *range(0x09, 0x0E)])
#: Words of letters, digits and anything beyond ASCII.
PUNCTUATION = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Group(NamedTuple):
    """Words of rows ``first`` to ``first + len(bounds) - 2``; row i has words bounds[i]:bounds[i + 1]."""
    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    kinds: np.ndarray


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _kinds() -> np.ndarray:
    """Bit per byte class: lower, upper, digit, beyond ASCII, mark inside words, other."""
    kind = np.full(256, 32, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 4, 8
    kind[[44, 46]] = 16
    return kind


KINDS = _kinds()


def _piece(data: np.ndarray, cuts: np.ndarray, how: Spelling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, hash, byte classes) of each word; no word spans a cut."""
    inside = ~how.separates[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return starts, none, none.astype(np.uint8)
    bytes_at = np.flatnonzero(inside)
    first = np.searchsorted(bytes_at, starts)
    lengths = np.diff(np.append(first, len(bytes_at)))
    place = np.arange(len(bytes_at)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    raw = data[bytes_at]
    hashes = np.add.reduceat((how.reads[raw].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    return starts, mixed(hashes), np.bitwise_or.reduceat(KINDS[raw], first)


def _pieces(data: np.ndarray, how: Spelling, limit: int) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        end = at + limit
        if end < len(data):
            size = limit
            while end < len(data) and not (stops := np.flatnonzero(how.separates[data[end:end + size]])).size:
                end += size
            end = end + int(stops[0]) if end < len(data) else len(data)
        yield data[at:end]
        at = end


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def groups(column: pa.Array, how: Spelling, limit: int = 1 << 21) -> Iterator[Group]:
    """Hashed words of all rows, group by group."""
    offsets, data = text_buffers(column)
    row, n = 0, len(column)
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        upto = min(upto, n)
        part = data[offsets[row]:offsets[upto]]
        if upto == row + 1 and len(part) > limit:
            found = [_piece(p, np.array([0]), how) for p in _pieces(part, how, limit)]
            hashes = np.concatenate([f[1] for f in found])
            yield Group(row, np.array([0, len(hashes)]), hashes, np.concatenate([f[2] for f in found]))
        else:
            cuts = offsets[row:upto + 1] - offsets[row]
            starts, hashes, kinds = _piece(part, cuts, how)
            yield Group(row, np.searchsorted(starts, cuts), hashes, kinds)
        row = upto


def word_hashes(text: str, how: Spelling) -> np.ndarray:
    """Hashes of the words of one text."""
    parts = [g.hashes for g in groups(pa.array([text], pa.string()), how)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
