"""Embedding near-dedup: lattice hashing. Random projections are decoded to E8 lattice points in several tables.

*What is found.* Two vectors match if their cosine is at least ``threshold``. A group is what chains of matches connect; the least id
of a group stays. The result has one row for every other vector of a group.

*How.* Vectors are scaled to length 1 and equal ones are one entry. Each table projects to 8 random dimensions, scales by the cell
width, shifts, and decodes to the nearest point of E8 (the nearer of the nearest points of D8 and of D8 shifted by a half). A vector
is stored in its own cell and probes the ``probes`` neighbouring cells (of the 240 closest lattice neighbours) whose points are nearest to it;
of two vectors in one cell, at least one being stored there, the exact cosine decides. The cell goes through the shuffle with the
vector in it, so candidates need no join; in a cell only a star of each group found goes on, so thousands of copies make no
quadratic number of rows. The stars are joined by ``components``.

*At scale.* The shuffle is tables x (1 + probes) x (4 bytes a dimension + 24) a vector, each cell by itself; nothing is broadcast. Width, probes and tables follow from the number n of entries
(``planned``): for each width and number of probes, the share of made-up pairs at the threshold that meet in one table gives the tables that ``recall`` takes, and a sample of 2048 entries tells how
full cells get; the choice with the least work is taken. So the width shrinks and tables grow with n, and recall stays. A cell of more than ``cell_cap`` rows is
compared in blocks, once, none being left out; one that would be too much for one task (over ``heavy`` rows, as a sample tells; no smaller table has one) is dealt out in chunks, each pair of which is a task.

*Odd input.* Null ids, null, empty or zero vectors, vectors with a null, NaN or infinite number, and vectors whose length differs from
the most common one (of equally common ones the least) are in no group. Rows with one id are one: each vector counts for it. Ids of any type come back as they are; the least is the first in their
order. Pairs exactly at the threshold match. Empty tables give no rows. Only the named columns are read, whatever the names of others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import column, components, cut, numbered, original, slots
from quillspark.llm.textarrays import mix


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    for s in product((0.5, -0.5), repeat=8):
        if sum(x < 0 for x in s) % 2 == 0:
            out.append(np.array(s))
    return np.array(out)


NEIGHBOURS = _neighbours()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers with an even sum): round, and if the sum is odd, round the worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        d = x[odd] - r[odd]
        k = np.abs(d).argmax(1)
        r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit number for each lattice point of a table."""
    with np.errstate(over="ignore"):
        h = np.full(len(points), table + 1, np.uint64)
        for k in range(8):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (2 * points[:, k]).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def projection(table: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Eight random directions, orthonormal if the dimensions allow, times sqrt(dims / 8); and a random shift."""
    rng = np.random.Generator(np.random.PCG64([seed, table]))
    g = rng.normal(size=(dims, 8))
    if dims >= 8:
        g = np.linalg.qr(g)[0] * np.sqrt(dims / 8)
    return g, rng.uniform(0, 2, 8)


def placed(x: np.ndarray, tables: int, probes: int, width: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, cell, whether it is stored there) of each vector in every table."""
    for t in range(tables):
        g, shift = projection(t, x.shape[1], seed)
        y = x @ g / width + shift
        home = decode(y)
        rows = np.arange(len(x))
        yield rows, cells(home, t), True
        if probes:
            rest = y - home
            # the distance to a neighbour falls with its inner product with what is left; all have the same length
            near = np.argpartition(-(rest @ NEIGHBOURS.T), probes - 1, axis=1)[:, :probes] if probes < 240 else np.tile(np.arange(240), (len(x), 1))
            for k in range(near.shape[1]):
                yield rows, cells(home + NEIGHBOURS[near[:, k]], t), False


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * dims, column.offset * dims * 4).reshape(-1, dims)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.shape[1] * 4).astype(np.int32)), pa.py_buffer(x)])


def unit(embedding: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their vectors at length 1)."""
    n = pc_lengths(embedding)
    rows = np.flatnonzero(n == dims)
    if not len(rows):
        return rows, np.zeros((0, dims), np.float32)
    x = embedding.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    length = np.sqrt((x * x).sum(1))
    ok = np.isfinite(length) & (length > 0)
    return rows[ok], (x[ok] / length[ok][:, None]).astype(np.float32)


def pc_lengths(embedding: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(embedding), -1).to_numpy(zero_copy_only=False)


def _normal(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = unit(b.column(1), dims)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)).cast(pa.int64()), _binary(x)], ["id", "v"])

    return run


def _cells(dims: int, tables: int, probes: int, width: float, seed: int, heavy: dict[int, int] | None = None):
    """Entries by cell. ``heavy``: the number of chunks of the cells that are dealt out; a row goes to every pair of chunks that has its own."""
    known = np.array(sorted(heavy or ()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column(1), dims).astype(np.float64)
            for _, cell, stored in placed(x, tables, probes, width, seed):
                whole = np.ones(len(cell), bool)
                if len(known):
                    whole = known[np.minimum(np.searchsorted(known, cell), len(known) - 1)] != cell
                    with np.errstate(over="ignore"):
                        deal = mix(b.column(0).to_numpy().view(np.uint64) + np.uint64(seed))
                    for k in np.unique(cell[~whole]):
                        at, n = np.flatnonzero(cell == k), heavy[int(k)]
                        mine = (deal[at] % np.uint64(n)).astype(np.int64)
                        rows = b.take(pa.array(at))
                        for other in range(n):
                            with np.errstate(over="ignore"):
                                pair = mix(np.int64(k).view(np.uint64) + (np.minimum(mine, other) * n + np.maximum(mine, other) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), rows.column(0), rows.column(1), pa.array(np.full(len(at), stored))], ["cell", "id", "v", "stored"])
                rows = b if whole.all() else b.take(pa.array(np.flatnonzero(whole)))
                yield pa.RecordBatch.from_arrays([pa.array(cell[whole]), rows.column(0), rows.column(1), pa.array(np.full(rows.num_rows, stored))], ["cell", "id", "v", "stored"])

    return run


def least_of(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` (the least number of each group so far) after the pairs (a, b) have joined groups."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def linked(ids: np.ndarray, x: np.ndarray, stored: np.ndarray, threshold: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (id, another id) of what matches connect in one cell, all pairs compared once that have a stored one; in blocks if it is large."""
    order = np.lexsort((~stored, ids))
    ids, x, stored = ids[order], x[order], stored[order]
    n = len(ids)
    label = np.arange(n)
    block = min(block, 1024)
    for a in range(0, n, block):
        for b in range(a, n, block):
            near = x[a : a + block] @ x[b : b + block].T >= threshold
            near &= stored[a : a + block, None] | stored[None, b : b + block]
            near &= label[a : a + block, None] != label[None, b : b + block]
            i, j = np.nonzero(near)
            if len(i):
                label = least_of(n, a + i, b + j, label)
    keep = ids != ids[label]
    return ids[keep], ids[label[keep]]


def planned(n: int, dims: int, threshold: float, recall: float, sample: np.ndarray, seed: int) -> tuple[float, int, int]:
    """(width, probes, tables) with the least work for n entries, of which ``sample`` are some; see the module.

    Work is counted in comparisons of a pair: to send a row to a cell is worth 300.
    """
    rng = np.random.Generator(np.random.PCG64([seed, 99]))
    a = rng.normal(size=(2000, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold * threshold)) * b / np.maximum(np.linalg.norm(b, axis=1), 1e-12)[:, None]
    best, before = None, None
    for width in 0.7 * 2.0 ** (-np.arange(9) / 4):
        cell = next(placed(sample.astype(np.float64), 1, 0, width, seed))[1] if len(sample) else np.zeros(0, np.int64)
        _, size = np.unique(cell, return_counts=True)
        pairs, all_ = float((size * (size - 1)).sum()), max(1.0, float(len(cell)) * (len(cell) - 1))
        # too few to count: cells shrink with the eighth power of the width
        share = pairs / all_ if pairs >= 20 or before is None else before[0] * (width / before[1]) ** 8
        before = (share, width)
        full = share * n  # others in an entry's cell
        for probes in (0, 2, 6, 16):
            mine, other = list(placed(a, 1, probes, width, seed)), list(placed(b, 1, probes, width, seed))
            met = np.zeros(len(a), bool)
            for _, cell, _ in mine:
                met |= cell == other[0][1]
            for _, cell, _ in other:
                met |= cell == mine[0][1]
            p = min(max(float(met.mean()) - 0.02, 1e-3), 1 - 1e-6)  # less what 2000 pairs may be off
            tables = max(2, int(np.ceil(np.log(1 - recall) / np.log(1 - p))))
            work = tables * (1 + probes) * (300 + full)
            if best is None or work < best[0]:
                best = work, float(width), probes, tables
    return best[1:]


def _stars(dims: int, threshold: float, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            t = t.combine_chunks()
            b = t.to_batches()[0]
            cell, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            stored = b.column(3).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            end = np.concatenate([begin[1:], [len(cell)]])
            x = _vectors(b.column(2), dims)
            some = np.add.reduceat(stored.astype(np.int64), begin)
            left, right = [], []
            for s, e in zip(begin[(end - begin > 1) & (some > 0)], end[(end - begin > 1) & (some > 0)]):
                l, r = linked(ids[s:e], x[s:e], stored[s:e], threshold, block)  # noqa: E741
                if len(l):
                    left.append(l), right.append(r)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            cell = b.column(0).to_numpy()
            if cell[0] != cell[-1] or held[0].column(0)[0].as_py() != cell[-1]:
                t = pa.Table.from_batches(held)
                at = int(np.searchsorted(t.column(0).to_numpy(), cell[-1]))
                yield from solve(t.slice(0, at))
                held = t.slice(at).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def groups(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, tables: int = 0, probes: int = -1, width: float = 0.0, cell_cap: int = 1024, seed: int = 9, recall: float = 0.98, heavy: int = 1 << 16) -> DataFrame:
    """(``vec_id``, ``duplicate_of``) of each vector that nearly equals an earlier one of its group; see the module.

    ``tables`` and ``width`` of 0 and ``probes`` under 0 follow from the number of entries.
    """
    e, names = numbered(embeddings.select(column(embeddings, vec_id).alias("id"), column(embeddings, embedding).cast("array<float>").alias("e")).where("id is not null and e is not null"), "id")
    most = e.groupBy(F.size("e").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    if most is None:
        kind = "bigint" if names is None else names.schema["value"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, duplicate_of {kind}")
    dims = most["n"]
    all_ = cut(e.mapInArrow(_normal(dims), "id bigint, v binary"))
    distinct = cut(all_.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    n = distinct.count()
    some = distinct.orderBy(slots("id", F.lit(seed))).limit(2048).collect()
    w, p, t = planned(n, dims, threshold, recall, np.frombuffer(b"".join(bytes(r["v"]) for r in some), np.float32).reshape(-1, dims), seed)
    width, probes, tables = width or w, p if probes < 0 else probes, tables or t
    split: dict[int, int] = {}
    heavy = max(heavy, n * tables * (1 + probes) // 100_000)
    kinds = "cell bigint, id bigint, v binary, stored boolean"
    if n > heavy:
        one_in = max(1, n >> 17)
        rows = distinct.where(F.pmod(slots("id", F.lit(seed)), F.lit(one_in)) == 0).mapInArrow(_cells(dims, tables, probes, width, seed), kinds)
        full = rows.groupBy("cell").agg((F.count("*") * one_in).alias("size")).where(F.col("size") > heavy).collect()
        split = {r["cell"]: -(-2 * r["size"] // heavy) for r in full}
    rows = distinct.mapInArrow(_cells(dims, tables, probes, width, seed, split), kinds)
    near = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_stars(dims, threshold, cell_cap), "a bigint, b bigint")
    same = all_.join(distinct.withColumnRenamed("id", "least"), "v").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    c = components(near.union(same)).where("node <> root").select(F.col("node").alias("vec_id"), F.col("root").alias("duplicate_of"))
    return original(c, names, ["vec_id", "duplicate_of"])


#: groups(embeddings) in SQL: all pairs, and what they connect.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {0}),
n AS MATERIALIZED (SELECT id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
m AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND list_dot_product(a.e, b.e) >= 0.95 * a.l * b.l),
r(id, root) AS (SELECT a, a FROM m UNION SELECT m.b, r.root FROM r JOIN m ON r.id = m.a)
SELECT id AS vec_id, min(root) AS duplicate_of FROM r GROUP BY id HAVING min(root) < id
"""
