"""N-grams as columns of word codes in numpy: counted by chunks of the text, merged and estimated by parts.

A part has every n-gram whose last word but one falls into it by its hash. So an n-gram's suffixes of two words and more, and all n-grams with its context, are in its
own part: adjusted counts, the weights of contexts and probabilities need no further shuffle of the n-grams. What does travel between parts is short: a block of counts
(compressed, with its own dictionary of words), the numbers of contexts (to the part that has the context as an entry) and of words.

Rows of a part are sorted by the last word but one, the last, then the others from right to left, so that those with one suffix are neighbours.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.functions import text as T

#: Words that a task counts at once; bytes of text that are split at once; rows of a batch that is returned; bytes of a row with a part's table.
CHUNK, SLICE, BATCH, PIECE = 1 << 21, 1 << 20, 1 << 16, 1 << 24
BOS, EOS, UNK = (x.encode() for x in (T.BOS, T.EOS, T.UNK))
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None
_GAP = np.zeros(256, bool)
_GAP[[0, 9, 10, 13, 32]] = True
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


# --- bytes


def packed(arrays: Sequence[np.ndarray]) -> bytes:
    """Arrays of non-negative whole numbers, each in as few bytes as its greatest needs, compressed."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = np.dtype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
        out.append(np.array([kind.itemsize, len(a)], np.int64).tobytes())
        out.append(np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes())
    raw = b"".join(out)
    return np.array([len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), "zstd", asbytes=True)
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        width, n = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
        planes = np.frombuffer(raw, np.uint8, width * n, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}"))
        at += 16 + width * n
    return out


def _flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings without nulls."""
    wide = pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type)
    if len(x) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(x.buffers()[1], np.int64 if wide else np.int32, len(x) + 1, x.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _names(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def hashes(names: pa.Array) -> np.ndarray:
    data, off = _flat(names)
    if len(data) == 0:
        return np.zeros(len(names), np.uint64)
    with np.errstate(over="ignore"):
        at = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
        h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 4095], off[:-1])
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


# --- counting


def tokens(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, number of words before the end of each line) of some texts at a time: words and lines as ``text.lines`` and ``text.train_words`` have them."""
    data, off = _flat(texts.drop_null())
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1))
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
        gap = _GAP[d]
        first = ~gap
        inside = first.copy()
        edge = np.zeros(len(d) + 1, bool)
        edge[o] = True
        first[1:] &= gap[:-1] | edge[1:-1]
        start = np.flatnonzero(first)
        # a word's bytes: those inside from its start to the next one's
        before = np.zeros(len(d) + 1, np.int64)
        np.cumsum(inside, out=before[1:])
        lengths = np.diff(np.append(before[start], before[-1]))
        feeds = np.flatnonzero(d == 10)
        size = np.diff(o)
        last = np.zeros(len(size), bool)
        last[size > 0] = d[o[1:][size > 0] - 1] == 10
        ends = np.searchsorted(start, np.concatenate([feeds, o[1:][~last]]))
        yield _names(d[inside], lengths), np.sort(ends)


def _keys(cols: Sequence[np.ndarray], bits: int) -> list[np.ndarray]:
    per, out = max(1, 63 // bits), []
    for k in range(0, len(cols), per):
        x = cols[k].astype(np.int64)
        for c in cols[k + 1 : k + per]:
            x = (x << bits) | c
        out.append(x)
    return out


def summed(cols: list[np.ndarray], counts: np.ndarray | None, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, sorted, with their counts (of one each by default) summed."""
    if len(cols[0]) == 0:
        return cols, np.zeros(0, np.int64)
    bits = max(1, int(words - 1).bit_length())
    keys = _keys(cols, bits)
    if len(keys) == 1 and counts is None:
        keys[0].sort()
    else:
        cols = [None] * len(cols)  # they are in the keys
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        counts = None if counts is None else counts[order]
        del order
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    total = np.diff(np.append(at, len(new))) if counts is None else np.add.reduceat(counts, at, dtype=np.int64)
    out, per, mask = [], max(1, 63 // bits), (1 << bits) - 1
    for g, k in enumerate(keys):
        k, n = k[at], min(per, len(cols) - g * per)
        out += [((k >> (bits * (n - 1 - j))) & mask).astype(np.int32) for j in range(n)]
    return out, total


def in_sort_order(order: int) -> list[int]:
    """Places of an n-gram's words in the order that rows are sorted by."""
    return [0] if order == 1 else [order - 2, order - 1, *range(order - 3, -1, -1)]


def in_text_order(k: int) -> list[int]:
    """Columns of the words of a suffix of k words, from left to right."""
    return [0] if k == 1 else [*range(k - 1, 1, -1), 0, 1]


def block(names: pa.Array, cols: list[np.ndarray], numbers: Sequence[np.ndarray], whole: bool = False) -> bytes:
    """Rows with the words that they use, most frequent first (``whole``: with all words and codes as they are); the first column, which has long runs, as runs."""
    n, rows = len(names), len(cols[0])
    if whole:
        used = np.arange(n)
    elif n <= 16 * rows:
        freq = np.bincount(np.concatenate(cols), minlength=n)
        used = np.flatnonzero(freq)
        used = used[np.argsort(-freq[used], kind="stable")]
        to = np.zeros(n, np.int32)
        to[used] = np.arange(len(used), dtype=np.int32)
        cols = [to[c] for c in cols]
    else:
        used, inverse, freq = np.unique(np.concatenate(cols), return_inverse=True, return_counts=True)
        by = np.argsort(-freq, kind="stable")
        to = np.empty(len(by), np.int32)
        to[by] = np.arange(len(by), dtype=np.int32)
        used, cols = used[by], np.split(to[inverse], len(cols))
    data, off = _flat(names if whole else names.take(pa.array(used)))
    at = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])) if rows else np.zeros(0, np.int64)
    return packed([np.diff(off), data, cols[0][at], np.diff(np.append(at, rows)), *cols[1:], *numbers])


def opened(data: bytes, width: int, wide: bool = True) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """What ``block`` packed: words, ``width`` columns, numbers (not ``wide``: in as few bytes as they were packed)."""
    x = unpacked(data)
    first = np.repeat(x[2].astype(np.int32), x[3].astype(np.int64))
    return _names(x[1], x[0]), [first, *[c.astype(np.int32) for c in x[4 : 3 + width]]], [c.astype(np.int64) if wide else c for c in x[3 + width :]]


def listed(names: pa.Array, codes: np.ndarray, numbers: Sequence[np.ndarray]) -> bytes:
    """Some words and numbers of each."""
    data, off = _flat(names.take(pa.array(codes)))
    return packed([np.diff(off), data, *numbers])


def numbered(data: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    """What ``listed`` packed."""
    x = unpacked(data)
    return _names(x[1], x[0]), x[2:]


def together(blocks: list[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """Blocks, which are taken from their list, one after the other, by codes of one dictionary."""
    enc = pa.concat_arrays([b[0] for b in blocks]).dictionary_encode()
    code, at = enc.indices.to_numpy(zero_copy_only=False).astype(np.int32), 0
    cols: list[list[np.ndarray]] = []
    for names, c, _ in blocks:
        own = code[at : at + len(names)]
        cols.append([own[x] for x in c])
        at += len(names)
    numbers = [np.concatenate(x) for x in zip(*[b[2] for b in blocks])]
    blocks.clear()
    return enc.dictionary, [np.concatenate(x) for x in zip(*cols)], numbers


def counted(words: list[pa.Array], ends: list[np.ndarray], order: int, parts: int, skip: bool) -> Iterator[tuple[int, bytes]]:
    """(part, block) of the n-grams of some lines."""
    enc = pa.concat_arrays(words).dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 2
    base = np.cumsum([0, *[len(w) for w in words]])
    line = np.concatenate([e + b for e, b in zip(ends, base)])
    special = np.flatnonzero(pc.is_in(enc.dictionary, value_set=pa.array([BOS, EOS, UNK], enc.dictionary.type)).to_numpy(zero_copy_only=False)) + 2
    if len(special):
        if not skip:
            raise ValueError(f"special word in the text: {enc.dictionary[int(special[0]) - 2].as_py().decode()}")
        drop = np.isin(codes, special)
        line = line - np.append(0, np.cumsum(drop))[line]
        codes = codes[~drop]
    names = pa.concat_arrays([pa.array([BOS, EOS], enc.dictionary.type), enc.dictionary])
    part = (hashes(names) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")  # words of one part have neighbouring codes
    to = np.empty(len(by), np.int32)
    to[by] = np.arange(len(by), dtype=np.int32)
    names, part, codes = names.take(pa.array(by)), part[by], to[codes]
    lines = np.arange(len(line), dtype=np.int32)
    stream = np.full(len(codes) + order * len(line), to[0], np.int32)
    at = np.repeat(lines, np.diff(np.append(0, line)))
    at *= order
    at += np.arange(order - 1, len(codes) + order - 1, dtype=np.int32)[: len(at)]
    end = (line + order * lines + order - 1).astype(np.int32)
    stream[at], stream[end] = codes, to[1]
    del enc, codes
    last = np.concatenate([at, end]) - (order - 1)
    del at, end
    cols = [stream[last + k] for k in in_sort_order(order)]
    del stream, last
    cols, n = summed(cols, None, len(names))
    bounds = np.searchsorted(part[cols[0]], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[p], bounds[p + 1]
        yield int(p), block(names, [c[a:b] for c in cols], [n[a:b]])


def chunks(batches: Iterator[pa.RecordBatch], order: int, parts: int, skip: bool) -> Iterator[pa.RecordBatch]:
    """(part, data) of the texts of some batches."""
    words, ends, n = [], [], 0

    def done() -> pa.RecordBatch:
        got = list(counted(words, ends, order, parts, skip))
        words.clear()
        ends.clear()
        trimmed()
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([d for _, d in got], pa.binary())], ["part", "data"])

    for b in batches:
        for w, e in tokens(b.column(0)):
            words.append(w)
            ends.append(e)
            n += len(w) + len(e)
            if n >= CHUNK:
                yield done()
                n = 0
    if words:
        yield done()


# --- parts


def strings(names: pa.Array, codes: Sequence[np.ndarray]) -> pa.Array:
    """N-grams of columns of codes, from left to right."""
    x = [names.take(pa.array(c)).cast(pa.string()) for c in codes]
    return x[0] if len(x) == 1 else pc.binary_join_element_wise(*x, " ")


class Part:
    """The n-grams of one part, and of each order below: ``at`` (first rows), ``parent`` (the suffix), ``raw``, ``adjusted``, ``valid`` (an entry of its order)."""

    def __init__(self, names: pa.Array, cols: list[np.ndarray], raw: np.ndarray):
        self.names, self.cols, self.order, self.words = names, cols, len(cols), len(names)
        found = {x: i for i, x in enumerate(pc.index_in(pa.array([BOS, EOS, UNK], names.type), value_set=names).to_pylist())}
        self.bos, self.eos, self.unk = (next((c for c, i in found.items() if i == j and c is not None), -1) for j in range(3))
        self.at, self.parent, self.raw, self.lefts = {}, {}, {}, {}
        self.at[self.order], self.raw[self.order] = np.arange(len(raw), dtype=np.int32), raw
        new = np.zeros(len(raw), bool)
        new[:1] = True
        for k in range(1, self.order):
            new[1:] |= cols[k - 1][1:] != cols[k - 1][:-1]
            if k >= 2:
                self.at[k] = np.flatnonzero(new).astype(np.int32)
                self.raw[k] = np.add.reduceat(raw, self.at[k]) if len(raw) else raw
        for k in range(2, self.order):
            at = np.searchsorted(self.at[k + 1], self.at[k])
            self.lefts[k] = np.diff(np.append(at, len(self.at[k + 1])))
            self.parent[k + 1] = np.repeat(np.arange(len(at), dtype=np.int32), self.lefts[k])
        self.levels = [k for k in range(2, self.order + 1)]
        self.adjusted = {k: self.raw[k] if k == self.order else np.where(self.word(k, 0) == self.bos, self.raw[k], self.lefts[k]) for k in self.levels}
        self.valid = {k: self.word(k, 1) != self.bos for k in self.levels}

    def told(self, parts: int) -> list[np.ndarray]:
        """For each of the parts, the words whose numbers are told to it: those that fall into it by their hash, and end n-grams here or stand last but one."""
        if self.order == 1:
            some = np.ones(self.words, bool)
        else:
            some = np.bincount(self.word(2, 0), minlength=self.words) + np.bincount(self.word(2, 1), minlength=self.words) > 0
        used = np.flatnonzero(some)
        home = (hashes(self.names) % np.uint64(parts)).astype(np.int64)[used]
        by = np.argsort(home, kind="stable")
        return np.split(used[by], np.searchsorted(home[by], np.arange(1, parts)))

    def word(self, k: int, i: int) -> np.ndarray:
        """Codes of the i-th words of the suffixes of k words."""
        column = self.cols[in_text_order(k)[i]]
        return column if k == self.order else column[self.at[k]]

    def marked(self, limits: Sequence[int], listed: np.ndarray | None) -> None:
        """``pruned``: those counted at most as often as their order's limit, or with a word that isn't listed; ``kept``: the other entries."""
        self.pruned = {}
        for k in self.levels:
            x = self.raw[k] <= limits[k - 1] if limits[k - 1] else np.zeros(len(self.at[k]), bool)
            if listed is not None:
                for i in range(k):
                    x = x | ~listed[self.word(k, i)]
            self.pruned[k] = x
        self.kept = {k: self.valid[k] & ~self.pruned[k] for k in self.levels}

    def contexts(self) -> None:
        """``context`` of each n-gram, and by context: an n-gram with it, its sum of adjusted counts, what of that is pruned, kept n-grams counted once, twice, more often."""
        self.context, self.sums = {}, {}
        for k in self.levels:
            key = self.word(2, 0).astype(np.int64) if k == 2 else self.context[k - 1][self.parent[k]].astype(np.int64) * self.words + self.word(k, 0)
            _, one, ids = np.unique(key, return_index=True, return_inverse=True)
            ids = ids.astype(np.int32)
            a, kept, n = self.adjusted[k], self.kept[k], len(one)
            total = lambda x: np.bincount(ids, x, n).astype(np.int64)
            self.context[k] = ids
            self.sums[k] = (one, total(a * self.valid[k]), total(a * (self.valid[k] & self.pruned[k])), *[total(kept & (a == j if j < 3 else a >= 3)) for j in (1, 2, 3)])

    def gamma(self, k: int, discount: Sequence[float]) -> np.ndarray:
        _, den, lost, c1, c2, c3 = self.sums[k]
        with np.errstate(invalid="ignore", divide="ignore"):
            return (discount[0] * c1 + discount[1] * c2 + discount[2] * c3 + lost) / den

    def strings(self, codes: Sequence[np.ndarray]) -> pa.Array:
        """The words of each row, joined."""
        return strings(self.names, codes)

    def find(self, names: pa.Array, cols: list[np.ndarray]) -> np.ndarray:
        """Numbers of the n-grams of two words and more that are the given ones (columns in sort order, by their own dictionary); -1 if there is none."""
        code = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        cols = [code[c] for c in cols]
        bad = np.zeros(len(cols[0]), bool)
        out = np.zeros(len(cols[0]), np.int64)
        for k in range(2, len(cols) + 1):
            have = self.word(2, 0).astype(np.int64) * self.words + self.word(2, 1) if k == 2 else self.parent[k].astype(np.int64) * self.words + self.word(k, 0)
            want = cols[0] * self.words + cols[1] if k == 2 else out * self.words + cols[k - 1]
            bad |= (cols[k - 1] < 0) | (cols[0] < 0)
            out = np.searchsorted(have, want)
            bad |= out >= len(have)
            out[bad] = 0
            if len(have):
                bad |= have[out] != want
        return np.where(bad, -1, out)


def trimmed() -> None:
    """Give back what is freed: each task's process may be the next one's."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def merged(blocks: list[bytes], order: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """The distinct n-grams of blocks and their counts; merged as they come, so that memory follows what is distinct."""
    held, rows, last = [], 0, 0
    for b in blocks:
        held.append(opened(b, order, wide=False))
        rows += len(held[-1][1][0])
        if rows > max(CHUNK, 2 * last) and len(held) > 1:
            names, cols, (n,) = together(held)
            cols, n = summed(cols, n, len(names))
            held, rows = [(names, cols, [n])], len(n)
            last = rows
    names, cols, (n,) = together(held)
    cols, n = summed(cols, n, len(names))
    return names, cols, n
