"""Texts of an Arrow batch as flat numpy arrays: words, their hashes and the sums over documents, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; the tables of powers have this length. Longer texts are taken in pieces that end between words.
BLOCK = 1 << 16

_rng = np.random.Generator(np.random.PCG64(20240611))
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Whatever is neither an ASCII letter or digit nor part of a longer UTF-8 sequence.
NONWORD = np.ones(256, bool)
NONWORD[48:58] = NONWORD[65:91] = NONWORD[97:123] = NONWORD[128:] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, done = np.uint64(base), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
        step = step * step
    return out


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _cache.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            have = _cache[0] = (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hashed(data: np.ndarray, off: np.ndarray, codes: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    inside = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= gap[data[:-1]] | edge[1:n]
    last = inside.copy()
    last[:-1] &= gap[data[1:]] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * up[:n], out=total[1:])
        h = mix((total[e] - total[s]) * down[s])
    return h, np.searchsorted(s, off), s, e


def words(texts: pa.Array, fold: bool = False, gap: np.ndarray = SPACES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hash of each word, offsets of each row's words, starts, ends) for a few rows at a time.

    Words are what lies between bytes of ``gap``; ``fold`` ignores the case of ASCII letters. Starts and ends are bytes from
    the first row's start. Texts of any length are hashed whole, in blocks.
    """
    data, off = flat(texts)
    codes = _FOLDED if fold else _CODES
    for i, j in runs(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(d) <= BLOCK:
            h, w, s, e = _hashed(d, o, codes, gap)
            yield i, j, h, w, s, e
            continue
        parts, at = [], 0
        while at < len(d):
            to = min(len(d), at + BLOCK)
            if to < len(d):
                back = np.flatnonzero(gap[d[at:to]])
                if len(back):
                    to = at + int(back[-1]) + 1
                else:  # one word longer than a block: up to its end
                    ahead = np.flatnonzero(gap[d[to:]])
                    to = to + int(ahead[0]) + 1 if len(ahead) else len(d)
            h, _, s, e = _hashed(d[at:to], np.array([0, to - at]), codes, gap)
            parts.append((h, s + at, e + at))
            at = to
        h, s, e = (np.concatenate(x) for x in zip(*parts))
        yield i, j, h, np.array([0, len(h)]), s, e
