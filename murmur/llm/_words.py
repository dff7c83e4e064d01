"""Words of a whole batch of texts at once, as numpy arrays over the batch's UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: The bytes that separate words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bits of the first bytes of an eight-byte number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first : int(offsets[-1])], offsets - first


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch: byte ranges, a 64-bit hash of each, and the first word of each text (n + 1 entries)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of every text: runs of bytes other than 0x20 and 0x09 to 0x0D."""
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inner[1:] & (~inner[:-1] | edge))
    ends = np.flatnonzero(inner[:-1] & (~inner[1:] | edge))
    return Words(starts, ends, hash_ranges(data, starts, ends), np.searchsorted(starts, offsets))


def _both_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first eight bytes, last eight bytes) of each range as numbers; the last ones are 0 for ranges of eight bytes
    or fewer. Ranges of up to 16 bytes that agree in all three are equal."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8 : len(data) + 8] = data
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    n = ends - starts
    return n, eight[starts + 8] & _FIRST[np.minimum(n, 8)], np.where(n > 8, eight[ends], np.uint64(0))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range data[start:end]: ranges of up to 16 bytes are mixed as numbers, which keeps those of up to
    eight apart for each length, longer ones are XXH64."""
    n, head, tail = _both_ends(data, starts, ends)
    out = mix(head ^ mix(tail + mix(n.astype(np.uint64))))
    far = np.flatnonzero(n > 16)
    if len(far):
        view = memoryview(np.ascontiguousarray(data))
        out[far] = np.fromiter((xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(starts[far].tolist(), ends[far].tolist())), np.uint64, len(far))
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one range of each distinct one, which of these each range is), compared by their bytes: where hashes agree, lengths, both
    ends and the bytes between are looked at, and ranges that differ from the first of their hash are told apart one by one."""
    _, one, which = np.unique(hash_ranges(data, starts, ends) if hashes is None else hashes, return_index=True, return_inverse=True)
    n, head, tail = _both_ends(data, starts, ends)
    like = one[which]
    other = (n != n[like]) | (head != head[like]) | (tail != tail[like])
    far = np.flatnonzero((n > 16) & ~other & (like != np.arange(len(n))))
    view = memoryview(np.ascontiguousarray(data))
    other[[k for k, m in zip(far.tolist(), like[far].tolist()) if view[starts[k] : ends[k]] != view[starts[m] : ends[m]]]] = True
    if other.any():
        more: dict[bytes, int] = {}
        added = []
        for k in np.flatnonzero(other).tolist():
            word = data[starts[k] : ends[k]].tobytes()
            if word not in more:
                more[word] = len(one) + len(added)
                added.append(k)
            which[k] = more[word]
        one = np.r_[one, added]
    return one, which


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(powers(base, width)):
        out += hashes[k : k + n] * factor
    return mix(out)


def within(first: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the n - width + 1 windows lie in one text."""
    count = max(0, n - width + 1)
    ok = np.ones(count + 1, bool)
    lengths = np.diff(first)
    for end, length in zip(first[1:], lengths):
        ok[max(int(end) - min(width - 1, int(length)), 0) : int(end)] = False
    return ok[:count]
