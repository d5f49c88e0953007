"""Words of many texts at once, as places in one array of bytes and 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SLICE = 1 << 20
LONG = 1 << 16
TABLE = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: White space of one byte, in Unicode and in ASCII; wide: white space of more bytes.
SPACES, ASCII_SPACES = (np.isin(np.arange(256), [c for c in range(128) if chr(c).isspace() and (c < 28 or wide or c == 32)]) for wide in (True, False))
WIDE = re.compile("[" + "".join(chr(c) for c in range(128, 0x3001) if chr(c).isspace()) + "]")


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(PRIME), n, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def contents(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each data[start:start + length]; start ascends."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    most = min(len(data), SLICE + int(length.max()))
    steps, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, x, np.uint64)]), dtype=np.uint64) for x in (PRIME, np.uint64(pow(int(PRIME), -1, 2**64))))
    for at in range(0, len(data), SLICE):
        own = slice(*np.searchsorted(start, [at, at + SLICE]))
        if own.start == own.stop:
            continue
        part, first = data[at : at + most], start[own] - at
        sums = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[part] * steps[: len(part)], dtype=np.uint64)])
        out[own] = (sums[first + length[own]] - sums[first]) * back[first] + length[own].astype(np.uint64) * TABLE[7]
    return mixed(out)


def words(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of each word of data, what `space` marks being between words; the last byte is a space."""
    apart = np.concatenate([[True], space[data]])
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    begin, length = edges[::2], edges[1::2] - edges[::2]
    out = contents(data, begin, np.minimum(length, LONG))
    for k in np.flatnonzero(length > LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[begin[k] : begin[k] + length[k]].tobytes())
    return begin, out


def lower_words(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word of the lower-cased texts, as `str.split` parts them."""
    found = [t.lower() for t in rows]
    found = [((t if t.isascii() else WIDE.sub(" ", t)) + " ").encode() for t in found]
    begin, h = words(np.frombuffer(b"".join(found), np.uint8), SPACES)
    return np.searchsorted(np.cumsum([len(t) for t in found]), begin, "right"), h
