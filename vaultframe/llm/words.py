"""Words of texts as 64-bit hashes, computed over whole Arrow buffers with numpy.

A word is read in blocks of eight bytes; each block is added to the hash so far and mixed by a bijection of 64 bits, so
words of one length up to eight bytes never collide. What lies beyond LONG bytes of a word enters by its BLAKE2 digest.
Equal words have equal hashes; different ones collide with a chance near 2**-64 a pair, whatever patterns they hold.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x9FB21C651E98DF25)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are read in blocks.
LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and its offsets into them (null: empty)."""
    if text.null_count:
        text = text.fill_null("")
    wide = text.type == pa.large_string()
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32, len(text) + 1, text.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashed(text: pa.Array, lower: bool = False, kinds: np.ndarray | None = None, spaces: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, starts, ends): text k has the words offsets[k]:offsets[k+1]; starts and ends are bytes into raw(text)[0]. kinds: words are split, too, between bytes of different kinds that are both above 0."""
    data, offsets = raw(text)
    n = len(data)
    solid = ~spaces[data]
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]  # texts meet here without a space
        first[edge] = solid[edge]
        last[edge - 1] = solid[edge - 1]
        if kinds is not None:
            kind = kinds[data]
            turn = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            first[1:] |= turn
            last[:-1] |= turn
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    blocks = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # eight bytes from each byte on
    size = ends - starts
    hashes = mix((blocks[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _BASE)
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG:
        rest = size[more] - at
        hashes[more] = mix(hashes[more] * _STEP + (blocks[starts[more] + at] & _MASKS[np.minimum(rest, 8)]))
        more, at = more[rest > 8], at + 8
    if len(more):
        rest = np.array([int.from_bytes(blake2b(padded[s + LONG : e], digest_size=8).digest(), "little") for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True)], np.uint64)
        hashes[more] = mix(hashes[more] * _STEP + rest)
    return hashes, np.searchsorted(starts, offsets), starts, ends


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts' words joined by one space each; offsets, starts and ends as from hashed."""
    size = ends - starts + 1  # with the space before; the first word of a text has none
    to = np.cumsum(size)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    source = np.arange(len(out)) + np.repeat(starts - (to - size) - 1, size)
    begin = np.zeros(len(out), bool)
    begin[to - size] = True
    out[~begin] = data[source[~begin]]
    keep = np.ones(len(out), bool)
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[(to - size)[first]] = False
    ends_of = np.concatenate(([0], to))[offsets]
    left_out = np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
    return out[keep], ends_of - left_out


def segments(offsets: np.ndarray) -> np.ndarray:
    """For each place, the number of the segment that it lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by doubling; length max(0, len(h) - k + 1)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, power, span, at = None, 0, h, 1, 0
    rest = k
    while rest:
        if rest & 1:
            part = power[at : at + len(h) - k + 1]
            out = part.copy() if out is None else mix(out * np.uint64(0x9FB21C651E98DF25) + part)
            at += span
        rest >>= 1
        if rest:
            power = mix(power[:-span] * np.uint64(0xC2B2AE3D27D4EB4F) + power[span:])
            span *= 2
    return out
