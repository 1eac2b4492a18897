"""SimHash near-dedup: random bit-sampling hashing of 256-bit fingerprints, with verified distances.

*What is found.* The fingerprint of a text is the sign of the sum of random ±1 vectors, one for each distinct word (runs of ASCII
letters, digits and non-ASCII bytes, without the case of ASCII letters). Two documents match if their fingerprints differ in at most
``max_distance`` of 256 bits; 40 bits are about 0.88 in cosine, or four in five distinct words in common. A group is what chains of
matches connect; the least ``doc_id`` of a group stays. The result has one row for every other document of a group.

*How.* Equal fingerprints are one entry. Each table has its own random order of the bits; the first ``base_bits``
of it are the bucket, which is all that is shuffled by. A bucket of more than ``bucket_cap`` entries is split by further bits,
as far as needed, where it arrives, and again by other bits: as often as makes up for the pairs that a split separates, so that over all tables a pair at
``max_distance`` still meets with probability ``recall``. Entries that bits don't tell apart well enough to be worth it are compared
whole, in blocks. Within a bucket all distances are computed, and only a star of each group found goes on;
so neither thousands of copies nor a common bucket make a quadratic number of rows. The stars are joined by ``components``.

*At scale.* A text is read once and not shuffled; an entry is 48 bytes times the tables. Bits and tables follow from the number n of entries (``planned``): of all numbers of bits, each with as many tables as give
``recall`` at ``max_distance``, the one with the least work; bits grow with log2(n), and tables with them: 7 bits and 13 tables for 10^4 entries, 11 and 28 for 10^5 to 10^6, 22 and 180 for 10^9. The recall stays.
A bucket that would be too much for one task (over ``heavy`` entries, as a sample of 2**17 entries tells; no smaller table has one) is split by further bits before the shuffle, and repeatedly by
others, again so often that recall stays. There are n tables / ``heavy`` such buckets at most, and never more than 10^5, as ``heavy`` grows if need be.

*Odd input.* A null text, or one without words, has no fingerprint: it is in no group, so it stays. Rows with a null ``doc_id`` are in
no group either. Rows with the same ``doc_id`` are one document: each of their fingerprints counts for it, and they don't make a group
of their own. Ids of any type come back as they are; the least is the first in their order. Bits that the words leave even (ties) are 0 and 1 in turn. Texts of any length are hashed whole. An
empty table gives no rows. Columns other than the named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import column, components, cut, numbered, original, slots
from quillspark.llm.textarrays import NONWORD, mix, words

BITS = 256
LANES = BITS // 64
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint as 4 words of 64 bits, whether the text has words) of each row."""
    out, has = np.zeros((len(texts), LANES), np.uint64), np.zeros(len(texts), bool)
    for i, j, h, off, _, _ in words(texts, fold=True, gap=NONWORD):
        if not len(h):
            continue
        row = np.repeat(np.arange(j - i), np.diff(off))
        # distinct words of each document
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
        vocab, which = np.unique(h, return_inverse=True)
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        end = np.concatenate([begin[1:], [len(row)]])
        with np.errstate(over="ignore"):
            lanes = np.stack([mix(vocab ^ s) for s in _SEEDS], 1)
        signs = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").view(np.int8)
        rows = row[begin]
        has[i:j][rows] = True
        for r, b, e in zip(rows, begin, end):
            ones = np.zeros(BITS, np.int64)
            for c in range(b, e, 1 << 14):
                c_end = min(e, c + (1 << 14))
                ones += signs[which[c:c_end]].sum(0, dtype=np.int16 if c_end - c < 30000 else np.int64)
            # ties by a fixed pattern, so that an even split has no bias
            bits = 2 * ones + (np.arange(BITS) & 1) > e - b
            out[i + r] = np.packbits(bits, bitorder="little").view(np.uint64)
    return out, has


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f, has = fingerprints(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)[has].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids)] + [pa.array(f[has, k].view(np.int64)) for k in range(LANES)], ["doc_id"] + [f"f{k}" for k in range(LANES)])


def order_of(table: int, seed: int) -> np.ndarray:
    """The table's random order of the bits."""
    return np.random.Generator(np.random.PCG64([seed, table])).permutation(BITS)


def sampled(f: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The given bits of each fingerprint, packed into 64-bit numbers (one column for every 64 bits)."""
    out = np.zeros((len(f), -(-len(bits) // 64)), np.uint64)
    for k, b in enumerate(bits):
        out[:, k // 64] |= ((f[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)) << np.uint64(k % 64)
    return out


#: Bits of a bucket's number below its table.
PLACE = 48


def extra_bits(table: int, turn: int, order: np.ndarray, base_bits: int, more: int, seed: int) -> np.ndarray:
    """Bits that a heavy bucket of a table is split by in one of its turns."""
    return np.random.Generator(np.random.PCG64([seed, table, turn])).permutation(order[base_bits:])[:more]


def _buckets(tables: int, base_bits: int, seed: int, heavy: dict[int, tuple[int, int]] | None = None):
    """Entries by bucket. ``heavy``: (further bits, turns) of the buckets that are split."""
    known = np.array(sorted(heavy or ()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [order_of(t, seed) for t in range(tables)]
        for b in batches:
            f = np.stack([b.column(k).to_numpy() for k in range(1, 1 + LANES)], 1).view(np.uint64)
            for t, order in enumerate(orders):
                key = sampled(f, order[:base_bits])[:, 0].astype(np.int64) | np.int64(t << PLACE)
                whole = np.ones(len(key), bool)
                if len(known):
                    whole = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key
                    for k in np.unique(key[~whole]):
                        at = np.flatnonzero(key == k)
                        rows = b.take(pa.array(at))
                        for turn in range(heavy[int(k)][1]):
                            part = sampled(f[at], extra_bits(t, turn, order, base_bits, heavy[int(k)][0], seed))[:, 0]
                            with np.errstate(over="ignore"):
                                h = mix(part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(k) & ((1 << PLACE) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn))
                            mine = (h & np.uint64((1 << (PLACE - 1)) - 1)).astype(np.int64) | np.int64(t << PLACE) | np.int64(1 << (PLACE - 1))
                            yield pa.RecordBatch.from_arrays([pa.array(mine), *rows.columns], ["bucket", *b.schema.names])
                if whole.all():
                    yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], ["bucket", *b.schema.names])
                elif whole.any():
                    rows = b.take(pa.array(np.flatnonzero(whole)))
                    yield pa.RecordBatch.from_arrays([pa.array(key[whole]), *rows.columns], ["bucket", *b.schema.names])

    return run


def star(f: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id) of the entries that matches connect, all distances compared."""
    n = len(f)
    near = np.zeros((n, n), bool)
    for a in range(0, n, 256):
        d = np.zeros((len(f[a : a + 256]), n), np.uint16)
        for k in range(LANES):
            d += np.bitwise_count(f[a : a + 256, k][:, None] ^ f[None, :, k])
        near[a : a + 256] = d <= most
    linked = near.sum(1) > 1
    if not linked.any():
        return ids[:0], ids[:0]
    near, who = near[linked][:, linked], ids[linked]
    label = np.arange(len(who))  # ids are sorted
    while True:
        new = np.where(near, label[None, :], len(who)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(who))
    return who[keep], who[label[keep]]


def meeting(bits: int, used: int, most: int) -> float:
    """Chance that a pair at distance ``most`` agrees on ``bits`` random bits, given that it does on ``used`` others."""
    k = np.arange(bits)
    return float(np.prod(np.maximum(BITS - used - most - k, 0) / (BITS - used - k)))


def planned(n: int, most: int, recall: float) -> tuple[int, int]:
    """(bits, tables) with the least work for n entries among those by which a pair at distance ``most`` meets with probability ``recall``.

    Work is counted in comparisons: to send an entry to a bucket is worth 3000, and buckets are fuller by 8 than they would be if bits were even.
    """

    def of(bits: int) -> tuple[float, int]:
        tables = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(meeting(bits, 0, most), 1 - 1e-9)))))
        return tables * (3000 + 8 * n / 2**bits), tables

    bits = min(range(4, 33), key=lambda k: of(k)[0])
    return bits, of(bits)[1]


def turns(size: int, heavy: int, base_bits: int, most: int, need: float) -> tuple[int, int]:
    """(further bits, turns) by which a bucket of ``size`` entries comes into parts of about a half of ``heavy``, a share ``need`` of pairs meeting in some turn."""
    more = min(32, int(np.ceil(np.log2(size / heavy))) + 1)
    return more, int(np.ceil(np.log(1 - need) / np.log(1 - 0.99 * meeting(more, base_bits, most))))


def needed(tables: int, base_bits: int, most: int, recall: float) -> float:
    """Share of the pairs at distance ``most`` in a bucket that must be compared for ``recall`` over all tables."""
    return min(0.99, (1 - (1 - recall) ** (1 / tables)) / max(meeting(base_bits, 0, most), 1e-9))


def least_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers under ``n`` that the pairs (a, b) connect each with."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def blocks(f: np.ndarray, most: int, pivots: int = 32, size: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect whatever matches connect, all distances compared but those of entries that are connected already."""
    n = len(f)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = np.zeros((len(x), len(y)), np.uint16)
        for k in range(LANES):
            d += np.bitwise_count(x[:, k][:, None] ^ y[None, :, k])
        return d <= most

    left, right = [], []
    free = np.ones(n, bool)
    for _ in range(pivots):  # dense groups need no comparisons among themselves once a pivot has them
        if not free.any():
            break
        p = int(np.argmax(free))
        at = np.flatnonzero(near(f[p : p + 1], f)[0])
        left.append(np.full(len(at), p)), right.append(at)
        free[at] = False
    label = least_of(n, np.concatenate(left), np.concatenate(right))
    order = np.argsort(label, kind="stable")
    for i in range(0, n, size):
        x = order[i : i + size]
        for j in range(i, n, size):
            y = order[j : j + size]
            if label[x].min() == label[y].max() and label[x].max() == label[y].min():
                continue
            r, c = np.nonzero(near(f[x], f[y]))
            r, c = x[r], y[c]
            apart = label[r] != label[c]
            if apart.any():
                label = least_of(n, np.concatenate([label, r[apart]]), np.concatenate([np.arange(n), c[apart]]))
    return label, np.arange(n)


def matches(f: np.ndarray, ids: np.ndarray, bits: np.ndarray, base_bits: int, cap: int, most: int, need: float, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Stars of one bucket. Over ``cap`` entries it is split by random ones of the table's further ``bits``, until each entry has met
    those at distance ``most`` with probability ``need``; both entries of a pair take part until the first of them has.
    """
    if len(f) <= cap:
        return star(f, ids, most)
    rng = np.random.Generator(np.random.PCG64(seed))
    left, right, missed, live = [], [], np.ones(len(f)), np.arange(len(f))
    place = np.arange(len(f))
    chance = [meeting(k, base_bits, most) for k in range(len(bits) - base_bits + 1)]
    while len(live) > 1:
        order, todo = rng.permutation(bits[base_bits:]), [(live, 0)]
        while todo:
            at, used = todo.pop()
            parts = None
            if len(at) > cap:
                for more in (4, 8, 12):  # a split must save more comparisons than its repetition costs
                    if used + more > len(order):
                        break
                    key = sampled(f[at], order[used : used + more])[:, 0].astype(np.int64)
                    if (np.bincount(key).astype(float) ** 2).sum() * chance[used] < float(len(at)) ** 2 * chance[used + more]:
                        by = np.argsort(key, kind="stable")
                        parts = np.split(at[by], np.flatnonzero(np.diff(key[by])) + 1)
                        todo += [(x, used + more) for x in parts]
                        break
            if parts is None:
                missed[at] *= 1 - chance[used]
                if len(at) > 1:
                    a, b = star(f[at], place[at], most) if len(at) <= 2048 else (at[x] for x in blocks(f[at], most))
                    left.append(a), right.append(b)
        live = live[missed[live] > 1 - need]
    label = least_of(len(f), np.concatenate(left), np.concatenate(right)) if left else place
    moved = label != place
    return ids[moved], ids[label[moved]]


def _verified(cap: int, base_bits: int, most: int, need: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders: dict[int, np.ndarray] = {}
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            key, ids = t.column("bucket").to_numpy(), t.column("doc_id").to_numpy()
            f = np.stack([t.column(f"f{k}").to_numpy() for k in range(LANES)], 1).view(np.uint64)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.concatenate([begin[1:], [len(key)]])
            left, right = [], []
            for b, e in zip(begin[end - begin > 1], end[end - begin > 1]):
                table = int(key[b]) >> PLACE
                if table not in orders:
                    orders[table] = order_of(table, seed)
                order = np.argsort(ids[b:e], kind="stable")
                x, y = matches(f[b:e][order], ids[b:e][order], orders[table], base_bits, cap, most, need, [seed, int(key[b])])
                if len(x):
                    left.append(x), right.append(y)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            last = b.column(0).to_numpy()
            if last[0] != last[-1] or held[0].column(0)[0].as_py() != last[-1]:
                t = pa.Table.from_batches(held)
                key = t.column("bucket").to_numpy()
                at = int(np.searchsorted(key, key[-1]))
                yield from solve(t.slice(0, at))
                held = t.slice(at).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_distance: int = 40, tables: int = 0, base_bits: int = 0, bucket_cap: int = 1024, seed: int = 7, recall: float = 0.99, heavy: int = 1 << 16) -> DataFrame:
    """(``doc_id``, ``duplicate_of``) of each document that near-copies an earlier one of its group; see the module. ``tables`` and ``base_bits`` of 0 follow from the number of entries."""
    if not (0 <= base_bits < PLACE - 1 and 0 <= tables < 1 << 14):
        raise ValueError("base_bits must be 0 to 46, tables 0 to 16383")
    d, ids = numbered(docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text")).where("doc_id is not null and text is not null"), "doc_id")
    lanes = [f"f{k}" for k in range(LANES)]
    kinds = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in lanes)
    entries = cut(d.mapInArrow(_entries, kinds))
    distinct = cut(entries.groupBy(*lanes).agg(F.min("doc_id").alias("doc_id")).select("doc_id", *lanes))
    n = distinct.count()
    bits, many = planned(n, max_distance, recall)
    base_bits, tables = base_bits or bits, tables or many
    need = needed(tables, base_bits, max_distance, recall)
    split: dict[int, tuple[int, int]] = {}
    heavy = max(heavy, n * tables // 100_000)
    if n > heavy:
        one_in = max(1, n >> 17)
        some = distinct.where(F.pmod(slots("doc_id", F.lit(seed)), F.lit(one_in)) == 0).mapInArrow(_buckets(tables, base_bits, seed), f"bucket bigint, {kinds}")
        full = some.groupBy("bucket").agg((F.count("*") * one_in).alias("size")).where(F.col("size") > heavy).collect()
        split = {r["bucket"]: turns(r["size"], heavy, base_bits, max_distance, need) for r in full}
    buckets = distinct.mapInArrow(_buckets(tables, base_bits, seed, split), f"bucket bigint, {kinds}")
    near = buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verified(bucket_cap, base_bits, max_distance, need, seed), "a bigint, b bigint")
    same = entries.join(distinct.withColumnRenamed("doc_id", "least"), lanes).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    c = components(near.union(same)).where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))
    return original(c, ids, ["doc_id", "duplicate_of"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the later documents of each group; rows that share a ``doc_id`` stay or go together, null ids stay."""
    gone = groups(docs, doc_id, text, **options).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, column(docs, doc_id) == gone["__gone"], "left_anti")
