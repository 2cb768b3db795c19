"""Hashes of all words of a column of texts, by vectors over the bytes.

A word is a run of bytes other than space and 9 to 13, A-Z read as a-z. Its hash is the sum of a random
number per byte value times a power of an odd number per place, modulo 2^64, mixed with its length; sums
of all words come from one running sum, divided by the power of the word's place. Words of more than
``LONG`` bytes are hashed one by one. Memory is bounded by ``BLOCK`` bytes of text at a time, whatever a text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 19
LONG = 1 << 16
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


_power: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _power:
        base = int(_M3)
        _power.extend([_powers(base, BLOCK), _powers(pow(base, -1, 1 << 64), BLOCK)])
    return _power


def _long(raw: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(raw.tobytes().lower())


def _block(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a block; at ``cuts`` texts begin."""
    power, inverse = _tables()
    word = _IS_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[cuts] = word[cuts]
    before = cuts[cuts > 0] - 1
    last[before] = word[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=running[1:])
    size = (end - start).astype(np.uint64)
    found = mix((running[end] - running[start]) * inverse[start] + size * _M1)
    for i in np.flatnonzero(size > LONG):
        found[i] = _long(data[start[i] : end[i]])
    return start, found


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each text; null has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    begin = np.unique(offsets[:-1])
    starts, hashes = [], []
    at, n = 0, len(data)
    while at < n:
        end = min(at + BLOCK, n)
        if end < n:
            text = int(begin[np.searchsorted(begin, end, side="right") - 1])  # the last text that begins up to here
            spaces = np.flatnonzero(~_IS_WORD[data[max(text, at) : end]])
            if spaces.size:
                end = max(text, at) + int(spaces[-1]) + 1
            elif text > at:
                end = text
            else:  # one word fills the block
                limit = int(offsets[np.searchsorted(offsets, at, side="right")])
                while end < limit and not (spaces := np.flatnonzero(~_IS_WORD[data[end : min(end + BLOCK, limit)]])).size:
                    end = min(end + BLOCK, limit)
                end += int(spaces[0]) if end < limit else 0
                starts.append(np.array([at]))
                hashes.append(np.array([_long(data[at:end])], np.uint64))
                at = end
                continue
        cuts = begin[np.searchsorted(begin, at) : np.searchsorted(begin, end)] - at
        start, found = _block(data[at:end], cuts)
        starts.append(start + at)
        hashes.append(found)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))
