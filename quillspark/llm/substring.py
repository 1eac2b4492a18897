"""Substring dedup: passages of ``min_words`` or more words that occur in two or more documents, by prefix-partitioned suffix trees.

*What is found.* Words are runs of non-space bytes. A window is ``min_words`` consecutive words of a document. A word is covered if
some window that holds it also occurs in another document. The result has one row for each maximal run of covered words.
With ``within`` a window at another place of the same document counts too, overlapping ones included. The result then has one row for each maximal
run of windows whose first copies (the least document, the least place in it) follow each other, and ``first_word``, where that copy begins;
so rows of a document may overlap, and text with a period of n words has a row every n words.

*How.*

1. Suffixes. The trees need no suffix at every word: a repeat of ``min_words`` words holds, whatever surrounds it, a word whose
   ``prefix_words``-gram has the least hash among ``min_words - prefix_words + 1`` neighbours, and holds it at the same place in
   each of its occurrences. Only such *anchors* become suffixes (one word in 13). Nothing is lost by it: what lies before an
   anchor is compared too, as a tree of reversed prefixes.
2. Prefixes. Suffixes are partitioned by their first ``prefix_words`` words. A prefix that only one document has (``within``: that occurs once) makes a leaf and
   goes. A prefix with more than ``memory_suffixes`` suffixes is lengthened: its suffixes start up to ``min_words - prefix_words``
   words earlier, and are partitioned by ``min_words`` words, so each part is a single node, counted without being held; nodes are told apart by two hashes of 64 bits.
3. Trees. The suffixes of a prefix are sorted by the words that follow, and by the reversed words that precede; with the lengths
   common to neighbours this is the suffix tree, a node being a run of suffixes with at least that much in common. A node of
   depth ``min_words - d`` that shares ``d`` words to the left and has leaves of two documents (``within``: two leaves) is a repeat. Long repeats have
   several anchors; their runs join in the result.

*At scale.* One shuffle of 20 bytes an anchor, one of the texts by document, one of 200 bytes for each anchor of a repeated
prefix; nothing is broadcast or collected. Comparisons are by a 64-bit hash of the prefix and a 32-bit hash of each further word, 25 of them at least, or by the two hashes of a node.

*Odd input.* A null or blank text, or one of fewer than ``min_words`` words, has no rows. Rows with a null ``doc_id`` are left out.
Rows that share a ``doc_id`` count as one document: what only they have in common is no repeat (``within``: unless at different places), and
their runs are joined as if of one text. Of first copies that tie, the least document (``within``: then the least place) is named. Texts of any length are taken whole. Ids of any type come back as
they are, and are compared in their order. An empty table gives no rows. Only the named columns are read, so extra ones, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import column, fresh, numbered, original
from quillspark.llm.textarrays import flat, mix, powers, words

SPANS = "doc_id bigint, start_word bigint, end_word bigint, n_words bigint, first_doc_id bigint"
PASSAGES = f"{SPANS}, first_word bigint"


def anchors(h: np.ndarray, off: np.ndarray, prefix: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, prefix hash) of each anchor of the rows whose word hashes are ``h``."""
    n = len(h) - prefix + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    with np.errstate(over="ignore"):
        up, down = powers(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        g = mix((total[prefix:] - total[:n]) * down[:n])
    # least of each window, by doubling; equal grams of a window are all anchors
    least, have = g, 1
    while have < window:
        more = min(have, window - have)
        least = np.minimum(least[: len(least) - more], least[more:])
        have += more
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    least[row[: len(least)] != row[window + prefix - 2 : window + prefix - 2 + len(least)]] = 0  # the window leaves its document
    # a gram is an anchor if it is the least of some window that holds it, so if the greatest of those windows' leasts is it
    pad = np.zeros(window - 1, np.uint64)
    top, have = np.concatenate([pad, least, pad]), 1
    while have < window:
        more = min(have, window - have)
        top = np.maximum(top[: len(top) - more], top[more:])
        have += more
    chosen = top == g
    at = np.flatnonzero(chosen)
    return row[at], at - off[row[at]], g[at]


def _anchor_batches(prefix: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, h, off, _, _ in words(b.column(1)):
                row, at, g = anchors(h, off, prefix, window)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[i:j][row].astype(np.int64)), pa.array(at.astype(np.int32))], ["g", "doc_id", "at"])

    return run


def _repeated(most: int, within: bool):
    """Of rows sorted by g: (doc_id, 2 * at + whether its prefix is oversized) for prefixes that two documents have, or that occur twice."""

    def differ(xs: list) -> bool:
        return min(x.min() for x in xs) != max(x.max() for x in xs)

    def out(g: list, d: list, at: list, hot: bool) -> pa.RecordBatch:
        d, at = np.concatenate(d), np.concatenate(at).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(2 * at + hot)], ["doc_id", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ds, ats, held = None, [], [], 0
        for b in batches:
            g, d, at = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(g):
                continue
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            lo = np.concatenate([[0], cuts])
            hi = np.concatenate([cuts, [len(g)]])
            # the first run may go on from the last batch, the last one into the next
            whole_lo = 0
            if last is not None:
                if g[0] == last:
                    if held != -1:
                        ds.append(d[: hi[0]]), ats.append(at[: hi[0]])
                        held += int(hi[0])
                    else:
                        yield out([], [d[: hi[0]]], [at[: hi[0]]], True)
                    whole_lo = 1
                if len(lo) > whole_lo:  # that run has ended
                    if held > 0 and (differ(ds) or within and differ(ats)):
                        yield out([], ds, ats, held > most)
                    last, ds, ats, held = None, [], [], 0
            if len(lo) > whole_lo:
                inner = slice(whole_lo, len(lo) - 1)
                if len(lo[inner]):
                    a, z = lo[inner], hi[inner]
                    seg = slice(a[0], z[-1])
                    n = z - a
                    few, many = np.minimum.reduceat(d[seg], a - a[0]), np.maximum.reduceat(d[seg], a - a[0])
                    twice = few != many
                    if within:
                        twice |= np.minimum.reduceat(at[seg], a - a[0]) != np.maximum.reduceat(at[seg], a - a[0])
                    keep = np.repeat(twice, n)
                    if keep.any():
                        yield out([], [d[seg][keep]], [at[seg][keep]], False) if (n <= most).all() else pa.RecordBatch.from_arrays(
                            [pa.array(d[seg][keep]), pa.array(2 * at[seg][keep].astype(np.int64) + np.repeat(n > most, n)[keep])], ["doc_id", "code"]
                        )
                last, ds, ats, held = g[-1], [d[lo[-1] :]], [at[lo[-1] :]], int(hi[-1] - lo[-1])
            if held > most:  # an oversized prefix is passed on as it comes
                yield out([], ds, ats, True)
                ds, ats, held = [], [], -1
        if held > 0 and (differ(ds) or within and differ(ats)):
            yield out([], ds, ats, held > most)

    return run


def _contexts(prefix: int, length: int):
    """For each anchor of a repeated prefix its prefix hash, and the words on both sides that decide on a window; -1-d marks a missing word."""
    side = length - prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hot", pa.bool_()), ("g", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("lefts", pa.int8()), ("rights", pa.int8()), ("around", pa.binary())])
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = b.column(2)
            coff = np.asarray(codes.offsets)
            values = codes.values.to_numpy(zero_copy_only=False)
            for i, j, h, off, _, _ in words(b.column(1)):
                mine = values[coff[i] : coff[j]]
                row = np.repeat(np.arange(j - i), np.diff(coff[i : j + 1]))
                real = (mine >> 1) + prefix <= np.diff(off)[row]  # of several rows with this doc_id, another may have it
                mine, row = mine[real], row[real]
                if not len(mine):
                    continue
                at, hot = mine >> 1, (mine & 1).astype(bool)
                p = off[row] + at
                with np.errstate(over="ignore"):
                    up, down = powers(len(h) + 1)
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(h * up[: len(h)], out=total[1:])
                    g = mix((total[p + prefix] - total[p]) * down[p])
                lefts = np.minimum(at, side)
                rights = np.minimum(off[row + 1] - p - prefix, side)
                short = h.astype(np.uint32)
                for c in range(0, len(p), 1 << 14):
                    c = slice(c, c + (1 << 14))
                    if not hot[c].all():
                        t = np.flatnonzero(~hot[c])
                        q = p[c][t]
                        k = np.arange(side)
                        left = short[np.maximum(q[:, None] - 1 - k, 0)]
                        right = short[np.minimum(q[:, None] + prefix + k, len(short) - 1)]
                        left[k >= lefts[c][t][:, None]] = 0
                        right[k >= rights[c][t][:, None]] = 0
                        body = np.ascontiguousarray(np.hstack([left, right]).astype(">u4"))
                        around = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer((np.arange(len(t) + 1) * body.shape[1] * 4).astype(np.int32)), pa.py_buffer(body)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(t), bool)), pa.array(g[c][t].view(np.int64)), pa.array(ids[i:j][row[c][t]]), pa.array(at[c][t].astype(np.int32)), pa.array(lefts[c][t].astype(np.int8)), pa.array(rights[c][t].astype(np.int8)), around], schema=schema)
                    if hot[c].any():  # lengthened prefixes: every window around the anchor by its own hash
                        t = np.flatnonzero(hot[c])
                        d = np.arange(side + 1)
                        ok = (d <= lefts[c][t][:, None]) & (side - d <= rights[c][t][:, None])
                        which, d = np.nonzero(ok)
                        q = p[c][t][which] - d
                        with np.errstate(over="ignore"):
                            w = mix((total[q + length] - total[q]) * down[q])
                            # the same window by other hashes of its words
                            second = np.zeros(len(h) + 1, np.uint64)
                            np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)) * up[: len(h)], out=second[1:])
                            w2 = np.ascontiguousarray(mix((second[q + length] - second[q]) * down[q]))
                        n = len(q)
                        also = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 8).astype(np.int32)), pa.py_buffer(w2)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.array(w.view(np.int64)), pa.array(ids[i:j][row[c][t]][which]), pa.array((q - off[row[c][t]][which]).astype(np.int32)), pa.array(np.zeros(n, np.int8)), pa.array(np.zeros(n, np.int8)), also], schema=schema)

    return run


def _common(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words that each sorted row shares with the one before it: the depth of their lowest common node."""
    same = x[1:] == x[:-1]
    out = np.zeros(len(x), np.int64)
    out[1:] = np.where(same.all(1), x.shape[1], np.argmin(same, 1))
    out[1:] = np.minimum(out[1:], np.minimum(n[1:], n[:-1]))
    return out


def tree_repeats(g: np.ndarray, doc: np.ndarray, at: np.ndarray, lefts: np.ndarray, rights: np.ndarray, left: np.ndarray, right: np.ndarray, prefix: int, length: int, within: bool = False) -> tuple[np.ndarray, ...]:
    """Repeats of all prefixes g at once: (doc, first word, word after the last, least document that has it) of windows in two documents.

    ``within``: of windows at two places, and the first word of the copy that comes first.
    """
    side, n = length - prefix, len(g)

    def ordered(x: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in the order of the trees, and the depth each shares with the one before (-1: another prefix, another tree)."""
        keys = np.empty((n, 8 + 4 * side), np.uint8)
        keys[:, :8] = (g.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8)
        keys[:, 8:] = np.ascontiguousarray(x).view(np.uint8).reshape(n, -1)
        order = np.argsort(keys.view(np.dtype((np.void, keys.shape[1]))).ravel())
        depth = _common(x[order], have[order])
        depth[np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))] = -1
        return order, depth

    ro, rd = ordered(right, rights)
    lo, ld = ordered(left, lefts)
    found = []
    node_r, node_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(side + 1):
        node_r[ro] = np.cumsum(rd < side - d)
        node_l[lo] = np.cumsum(ld < d)
        ok = np.flatnonzero((lefts >= d) & (rights >= side - d))
        if len(ok) < 2:
            continue
        key = node_r[ok] * (n + 1) + node_l[ok]
        order = np.lexsort((at[ok], doc[ok], key)) if within else np.argsort(key)
        k, docs = key[order], doc[ok][order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        first, last = np.minimum.reduceat(docs, begin), np.maximum.reduceat(docs, begin)
        size = np.diff(np.concatenate([begin, [len(k)]]))
        if within:
            place = at[ok][order]
            keep = np.repeat((first != last) | (place[begin] != place[begin + size - 1]), size)
        else:
            keep = np.repeat(first != last, size)
        if keep.any():
            w = ok[order][keep]
            one = (doc[w], at[w] - d, at[w] - d + length, np.repeat(first, size)[keep])
            found.append((*one, np.repeat(place[begin] - d, size)[keep]) if within else one)
    if not found:
        return (np.zeros(0, np.int64),) * (5 if within else 4)
    return tuple(np.concatenate(x) for x in zip(*found))


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching runs of a document as one, with the least of their first documents."""
    if not len(doc):
        return doc, start, end, first
    order = np.lexsort((start, doc))
    doc, start, end, first = doc[order], start[order], end[order], first[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span)
    new = np.concatenate([[True], start[1:] + group[1:] * span > reach[:-1]])
    new[1:] |= doc[1:] != doc[:-1]
    b = np.flatnonzero(new)
    return doc[b], start[b], np.maximum.reduceat(end, b), np.minimum.reduceat(first, b)


def passages(doc: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, word: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that follow each other word by word as one, if their first copies do that too."""
    if not len(doc):
        return doc, start, end, first, word
    order = np.lexsort((start, start - word, first, doc))
    doc, start, end, first, word = (x[order] for x in (doc, start, end, first, word))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | ((start - word)[1:] != (start - word)[:-1])
    reach = np.maximum.accumulate(end + np.cumsum(new) * (int(end.max()) + 1))  # runs of a group don't reach into the next one
    new[1:] |= (start + np.cumsum(new) * (int(end.max()) + 1))[1:] > reach[:-1] - length + 1
    b = np.flatnonzero(new)
    return doc[b], start[b], np.maximum.reduceat(end, b), first[b], word[b]


def _trees(prefix: int, length: int, within: bool, hold: int = 60_000):
    side = length - prefix
    names = ["doc_id", "start_word", "end_word", "first_doc_id", "first_word"][: 5 if within else 4]

    def solve(bs: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(bs).combine_chunks()
        g, doc, at, lefts, rights = (t.column(k).to_numpy() for k in ("g", "doc_id", "at", "lefts", "rights"))
        data, _ = flat(t.column("around"))
        around = data.view(">u4").reshape(len(g), 2 * side)
        runs = tree_repeats(g, doc, at.astype(np.int64), lefts.astype(np.int64), rights.astype(np.int64), around[:, :side], around[:, side:], prefix, length, within)
        out = passages(*runs, length) if within else joined(*runs)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names)

    def trees(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """The repeats of all prefixes held but the last, which may go on, and the rows of that one."""
        t = pa.Table.from_batches(held).combine_chunks()
        g = t.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        return (solve(t.slice(0, cut).to_batches()) if cut else None), t.slice(cut).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hot, g, the second hash if hot, doc_id (``within``: and at): first the trees, whole prefixes together until enough are held; then single nodes."""
        held, rows, enough = [], 0, hold
        last, first, place, waiting = None, None, None, []
        for b in batches:
            hot = b.column(0).to_numpy(zero_copy_only=False)
            n = int(np.searchsorted(hot, True))
            if n:
                held.append(b.slice(0, n))
                rows += n
                if rows >= enough:
                    done, held = trees(held)
                    if done is not None:
                        yield done
                    rows = sum(x.num_rows for x in held)
                    enough = max(hold, 2 * rows)
            if n == b.num_rows:
                continue
            if held:
                yield solve(held)
                held, rows = [], 0
            g, doc, at = (b.column(k).to_numpy()[n:] for k in (1, 2, 3))
            at = at.astype(np.int64)
            also = flat(b.column(6).slice(n))[0].view(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (also[1:] != also[:-1])]))
            end = np.concatenate([begin[1:], [len(g)]])
            firsts, places = doc[begin].copy(), at[begin].copy()
            if (g[0], also[0]) == last:
                firsts[0], places[0] = first, place
            else:
                waiting = []
            spread = doc[end - 1] != firsts
            if within:
                spread |= at[end - 1] != places
            if waiting and spread[0]:
                yield waiting[0] if len(waiting) == 1 else pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            if (g[0], also[0]) != last or spread[0] or len(begin) > 1:
                waiting = []
            size = end - begin
            least = np.repeat(firsts, size)
            columns = (doc, at, at + length, least, np.repeat(places, size))[: len(names)]
            out = lambda keep: pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64)) for x in columns], names)  # noqa: E731,B023
            keep = np.repeat(spread, size)
            if keep.any():
                yield out(keep)
            if not spread[-1]:  # one document (or place) so far; another may follow
                waiting.append(out(slice(int(begin[-1]), len(g))))
            last, first, place = (g[-1], also[-1]), firsts[-1], places[-1]
        if held:
            yield solve(held)

    return run


def earliest(doc: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, word: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Passages in which each window has the first of the copies that its runs give; an anchor that only some copies have knows only those."""
    n = end - start - length + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    doc, start, first, word = np.repeat(doc, n), np.repeat(start, n) + step, np.repeat(first, n), np.repeat(word, n) + step
    order = np.lexsort((word, first, start, doc))
    keep = np.ones(len(order), bool)
    keep[1:] = (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])
    w = order[keep]
    return passages(doc[w], start[w], start[w] + length, first[w], word[w], length)


def _join_passages(length: int, hold: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, runs = b.column(0).to_numpy(), b.column(1)
            off = np.asarray(runs.offsets) - runs.offsets[0].as_py()
            s = runs.flatten()
            start, end, first, word = (s.field(k).to_numpy() for k in range(4))
            total = np.concatenate([[0], np.cumsum(end - start - length + 1)])[off]
            i = 0
            while i < len(ids):  # documents of about ``hold`` windows at a time
                j = max(i + 1, int(np.searchsorted(total, total[i] + hold, "right")) - 1)
                c = slice(off[i], off[j])
                doc, s_, e_, f_, w_ = earliest(np.repeat(ids[i:j], np.diff(off[i : j + 1])), start[c], end[c], first[c], word[c], length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, s_, e_, e_ - s_, f_, w_)], [c.split()[0] for c in PASSAGES.split(", ")])
                i = j

    return run


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy()
        runs = b.column(1)
        n = np.diff(np.asarray(runs.offsets))
        s = runs.flatten()
        out = joined(np.repeat(ids, n), *(s.field(k).to_numpy() for k in range(3)))
        doc, start, end, first = (pa.array(x) for x in out)
        yield pa.RecordBatch.from_arrays([doc, start, end, pa.array(out[2] - out[1]), first], ["doc_id", "start_word", "end_word", "n_words", "first_doc_id"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, prefix_words: int = 0, memory_suffixes: int = 20_000, within: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id) of every maximal run of words covered by repeats; see the module.

    ``first_doc_id`` is the least document that shares any window of the run; a run with its own doc_id there is the first copy.
    ``memory_suffixes``: the suffixes of one prefix that a tree is built from in memory at most; more common prefixes are lengthened.
    ``within``: repeats inside one document count too, and rows tell by ``first_word`` where the first copy is; that copy itself has its own doc_id and
    start_word there.
    """
    prefix = prefix_words or (min_words + 1) // 2
    if not 0 < prefix <= min_words or min_words - prefix > 100:
        raise ValueError("prefix_words must lie within min_words, at most 100 below it")
    d, ids = numbered(docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text")).where("doc_id is not null and text is not null"), "doc_id")
    a = d.mapInArrow(_anchor_batches(prefix, min_words - prefix + 1), "g bigint, doc_id bigint, at int")
    a = a.repartition("g").sortWithinPartitions("g", "doc_id")
    codes = a.mapInArrow(_repeated(memory_suffixes, within), "doc_id bigint, code bigint").groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    both = d.join(codes, "doc_id").select("doc_id", "text", "codes")
    suffixes = both.mapInArrow(_contexts(prefix, min_words), "hot boolean, g bigint, doc_id bigint, at int, lefts tinyint, rights tinyint, around binary")
    suffixes = suffixes.repartition("hot", "g").sortWithinPartitions("hot", "g", F.when(F.col("hot"), F.col("around")), "doc_id", *(["at"] if within else []))
    found = suffixes.mapInArrow(_trees(prefix, min_words, within), "doc_id bigint, start_word bigint, end_word bigint, first_doc_id bigint" + ", first_word bigint" * within)
    columns = ("start_word", "end_word", "first_doc_id", "first_word")[: 4 if within else 3]
    runs = found.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("runs"))
    out = runs.mapInArrow(_join_passages(min_words), PASSAGES) if within else runs.mapInArrow(_join_spans, SPANS)
    return original(out, ids, ["doc_id", "first_doc_id"])


def without_repeats(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all but the first copy of each repeat cut from ``text``: the runs whose ``first_doc_id`` is another document.

    Of spans ``within`` documents, a run that is its own first copy stays whole even where others overlap it, so each passage is left somewhere. Without it a run
    joined of passages has one first document only, and a passage that this one lacks may be lost; so give spans of ``repeats(..., within=True)``.

    What is left keeps its bytes, spaces included. Documents without such runs, and null texts, stay as they are.
    """
    cid, list_ = fresh(docs, "__cut_id"), fresh(docs, "__cuts")
    own = F.expr("first_doc_id = doc_id" + " and first_word = start_word" * ("first_word" in spans.columns))
    cuts = spans.groupBy(F.col("doc_id").alias(cid)).agg(F.collect_list(F.struct("start_word", "end_word", own.alias("own"))).alias(list_)).where(F.exists(list_, lambda r: ~r["own"]))
    joined_ = docs.join(cuts, column(docs, doc_id) == cuts[cid], "left").drop(cid)

    @F.pandas_udf("string")
    def trimmed(t, c):  # type: ignore[no-untyped-def]
        import re

        def one(t: str, c) -> str:  # type: ignore[no-untyped-def]
            places = [m.span() for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", t)]
            gone = bytearray(len(places) + 1)
            for own in (False, True):
                for r in c:
                    if r["own"] == own:
                        a, b = min(r["start_word"], len(places)), min(r["end_word"], len(places))
                        gone[a:b] = bytes([not own]) * (b - a)
            out, at, a = [], 0, gone.find(1)
            while a >= 0:
                b = gone.find(0, a)
                out.append(t[at : places[a][0]])
                at = places[b - 1][1]
                a = gone.find(1, b)
            return "".join([*out, t[at:]])

        return t.combine(c, lambda a, b: a if a is None or b is None else one(a, b))

    t = column(joined_, text)
    new = F.when(F.col(list_).isNull() | t.isNull(), t).otherwise(trimmed(t, F.col(list_))).alias(text)
    return joined_.select(*[new if c == text else column(joined_, c) for c in docs.columns])


#: The same in SQL: all windows, by their text.
SQL = """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM t WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h FROM p),
r AS (SELECT h, min(doc_id) AS f FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, i, f FROM g JOIN r USING (h)),
m AS (SELECT *, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS fresh FROM c),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, max(i) + 50 - min(i) AS n_words, min(f) AS first_doc_id FROM n GROUP BY doc_id, run
"""
