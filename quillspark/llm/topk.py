"""Exact top-k search by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

*What is found.* For every query the ``k`` other vectors with the greatest inner products; among equal products (to 9
places) the lesser id is first. The result is exact, and has k rows for each query (fewer only if there are not k others). Queries are
the rows for which ``queries`` holds, all by default; every query is searched in all vectors.

*How.* The right singular vectors of all vectors (from their 64 x 64, or d x d, sums of products) rotate them so that the first
coordinates hold most of the length. Vectors are sorted by descending length into parts of ``unit`` bytes. Parts are met in rounds, the first alone, then
8 times as many each. Before a round, a query whose k-th best product so far exceeds its length times the length of the longest vector left is done, and
others go only to the parts whose longest vector can still reach it. Within a part, blocks end where lengths are too short; for the rest the products are summed up in
stages, after the coordinates that hold a half, four fifths and 19 twentieths of all squares: what is summed up so far plus the product of the lengths of what is left
bounds the product, and only pairs that can reach the k-th best go on to the next stage; what gets through is multiplied in float64 with the vectors as given. Bounds
allow for float32 rounding. Where a stage leaves most pairs, all are multiplied out by a matrix product, which is cheaper than to pick.

*At scale.* An exact search compares, at worst, every query with every vector; lengths and spectrum decide how much is cut. On vectors of one length whose
directions are even, nothing is. In a round a task has one part of the vectors in memory and streams queries past it; a round's shuffle is the active queries times its
parts, and its vectors times the query parts. As the k-th best of an eighth of all is known by then, a query adds about 8 k rows a round, not k for each part. What
reaches the driver is d x d numbers and one length a part.

*Odd input.* Null ids, null or empty vectors, those with a null, NaN or infinite number, and those whose length differs from the most
common one take no part. Of rows that share an id, the least vector stands for it; it is a query if any of them is. Zero vectors are searched like others. Ids of any
type come back as they are, ties being in their order. An empty table, or one without queries, gives no rows. Columns other than the named ones are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.lattice import _binary, _vectors, pc_lengths
from quillspark.llm.shared import column, cut, dropped, numbered, original, shared_dir

GROWTH = 8


def _clean(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.flatnonzero(pc_lengths(b.column(1)) == dims)
            x = b.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            ok = np.isfinite(x).all(1)
            x, kept = x[ok], pa.array(rows[ok])
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), _binary(x), pa.array(np.sqrt((x.astype(np.float64) ** 2).sum(1))), b.column(2).take(kept)], ["id", "v", "length", "q"])

    return run


def _products(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(0), dims).astype(np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["at", "s"])

    return run


def stages_of(values: np.ndarray) -> tuple[int, ...]:
    """Numbers of leading coordinates that hold a half, four fifths and 19 twentieths of the squares, by descending eigenvalues."""
    share = np.cumsum(np.maximum(values, 0)) / max(float(np.maximum(values, 0).sum()), 1e-300)
    return tuple(sorted({min(len(values), int(np.searchsorted(share, x)) + 1) for x in (0.5, 0.8, 0.95)} - {len(values)}))


class Rotated:
    """Vectors with their rotated coordinates, and the length of what each stage leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, stages: tuple[int, ...]):
        self.ids, self.x = ids, x
        r = x.astype(np.float64) @ rotation
        self.length = np.sqrt((r * r).sum(1))
        self.left = [np.sqrt((r[:, s:] ** 2).sum(1)).astype(np.float32) for s in stages]
        ends = [0, *stages, r.shape[1]]
        self.parts = [np.ascontiguousarray(r[:, a:b], np.float32) for a, b in zip(ends, ends[1:])]


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, stages: tuple[int, ...], k: int, floor: np.ndarray | None = None):
        self.q, self.k, self.rotation, self.stages = Rotated(ids, x, rotation, stages), k, rotation, stages
        self.score = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), -1, np.int64)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        #: Pairs that came up, and those of them that were multiplied out.
        self.met = self.multiplied = 0

    def least(self) -> np.ndarray:
        """What a product must reach to matter to each query."""
        return np.maximum(self.floor, self.score[:, -1])

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Vectors in descending order of length."""
        self.meet_rotated(Rotated(ids, x, self.rotation, self.stages), slice(None))

    def meet_rotated(self, v: Rotated, rows: slice, chunk: int = 512) -> None:
        q, length = self.q, v.length[rows]
        self.met += len(q.ids) * len(length)
        slack = 4e-6 * q.length.max(initial=0) * length.max(initial=0) + 1e-9
        first = rows.start or 0
        for a in range(0, len(q.ids), chunk):
            some = slice(a, a + chunk)
            need = self.least()[some] - slack
            reach = (q.length[some, None] * length[None, :1] >= need[:, None]).any(1)  # Cauchy-Schwarz on whole lengths
            if not reach.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where((need > 0) & (q.length[some] > 0), need / q.length[some], 0.0)[reach].min()
            n = int(np.searchsorted(-length, -shortest, "right"))  # lengths descend, so the rest is shorter
            if not n:
                continue
            i, j = self.close(some, v, slice(first, first + n), need.astype(np.float32))
            keep = q.ids[some][i] != v.ids[first + j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            exact = np.empty(len(i))
            for c in range(0, len(i), 1 << 15):
                c = slice(c, c + (1 << 15))
                exact[c] = np.round((q.x[some][i[c]].astype(np.float64) * v.x[first + j[c]]).sum(1), 9)
            self.merge(a, i, exact, v.ids[first + j])

    def close(self, some: slice, v: Rotated, rows: slice, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query of the chunk, vector of the rows) of the pairs whose product may reach ``need``."""
        q, n = self.q, rows.stop - rows.start
        s = np.zeros((len(need), n), np.float32)
        bounding = True
        for t in range(len(v.parts)):
            s += q.parts[t][some] @ v.parts[t][rows].T
            if t == len(self.stages) or not bounding:
                continue
            open_ = s + q.left[t][some, None] * v.left[t][None, rows] >= need[:, None]
            left = int(np.count_nonzero(open_))
            if left <= 0.1 * open_.size:  # few enough to pick
                i, j = np.nonzero(open_)
                part = s[i, j]
                for u in range(t + 1, len(v.parts)):
                    if u == len(v.parts) - 1:
                        self.multiplied += len(i)
                    part = part + np.einsum("ij,ij->i", q.parts[u][some][i], v.parts[u][rows][j])
                    keep = part + (q.left[u][some][i] * v.left[u][rows][j] if u < len(self.stages) else 0) >= need[i]
                    i, j, part = i[keep], j[keep], part[keep]
                return i, j
            bounding = left < 0.5 * open_.size  # a stage that leaves most pairs is followed by others that do; their bounds would cost more than they save
        self.multiplied += s.size
        if n > 4 * self.k:  # only what is among the k best of these can matter, the query itself aside
            kth = np.partition(s, n - self.k - 1, axis=1)[:, n - self.k - 1]
            need = np.maximum(need, kth - np.float32(8e-6) * np.float32(q.length[some].max(initial=0) * v.length[rows.start]))
        return np.nonzero(s >= need[:, None])

    def merge(self, base: int, i: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        rows = np.unique(i)
        old = np.repeat(rows, self.k)
        i = np.concatenate([old, i])
        score = np.concatenate([self.score[base + rows].ravel(), score])
        who = np.concatenate([self.who[base + rows].ravel(), who])
        order = np.lexsort((who, -score, i))
        i, score, who = i[order], score[order], who[order]
        begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(i)]])))
        keep = rank < self.k
        self.score[base + i[keep], rank[keep]] = score[keep]
        self.who[base + i[keep], rank[keep]] = who[keep]

    def rows(self) -> pa.RecordBatch:
        keep = np.isfinite(self.score) & (self.score >= self.floor[:, None])
        q = np.repeat(self.q.ids, self.k).reshape(keep.shape)
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(self.who[keep]), pa.array(self.score[keep])], ["query_id", "neighbour_id", "score"])


def _sent(parts: list[int], longest: np.ndarray):
    """A row of each query for each of a round's parts that can matter to it; ``longest`` by part, descending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.searchsorted(-longest, -b.column(3).to_numpy(), "right")
            for k in range(int(n.max(initial=0))):
                rows = b.take(pa.array(np.flatnonzero(n > k)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, parts[k], np.int32)), *rows.columns[:3]], ["part", "id", "v", "floor"])

    return run


def _met(dims: int, rotation: np.ndarray, stages: tuple[int, ...], k: int, block: int = 2048, hold: int = 1024):
    """Rows of (part, slice of the queries): first its vectors by descending length, then its queries."""

    def solve(v: Rotated | None, ids: list, xs: list, floors: list) -> Iterator[pa.RecordBatch]:
        if v is None or not ids:
            return
        ids_, x, f = np.concatenate(ids), np.concatenate(xs), np.concatenate(floors)
        for c in range(0, len(ids_), hold):
            c = slice(c, c + hold)
            best = Best(ids_[c], x[c], rotation, stages, k, f[c])
            for a in range(0, len(v.ids), block):
                best.meet_rotated(v, slice(a, min(a + block, len(v.ids))))
            yield best.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, v, vids, vxs, ids, xs, floors, n = None, None, [], [], [], [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if at != (key[s, 0], key[s, 1]):
                    yield from solve(v, ids, xs, floors)
                    at, v, vids, vxs, ids, xs, floors, n = (key[s, 0], key[s, 1]), None, [], [], [], [], [], 0
                part = b.slice(s, e - s)
                who, x = part.column(3).to_numpy(), _vectors(part.column(4), dims)
                if key[s, 2] == 0:
                    vids.append(who), vxs.append(x)
                    continue
                if v is None and vids:
                    v = Rotated(np.concatenate(vids), np.concatenate(vxs), rotation, stages)
                    vids, vxs = [], []
                ids.append(who), xs.append(x), floors.append(part.column(5).to_numpy(zero_copy_only=False))
                n += e - s
                if n >= hold:
                    yield from solve(v, ids, xs, floors)
                    ids, xs, floors, n = [], [], [], 0
        yield from solve(v, ids, xs, floors)

    return run


def search(embeddings: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", queries: Column | None = None, unit: int = 1 << 25) -> DataFrame:
    """(``query_id``, ``rank`` from 1, ``neighbour_id``, ``score`` to 9 places) of every query; see the module.

    ``queries``: a condition on the rows; ``unit``: bytes of the vectors that a task holds.
    """
    spark = embeddings.sparkSession
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    e, names = numbered(embeddings.select(column(embeddings, vec_id).alias("id"), column(embeddings, embedding).cast("array<float>").alias("e"), asked.alias("q")).where("id is not null and e is not null"), "id")
    kind = "bigint" if names is None else names.schema["value"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"query_id {kind}, rank int, neighbour_id {kind}, score double")
    e = e.where("not exists(e, x -> x is null)")
    most = e.groupBy(F.size("e").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    if most is None:
        return nothing
    dims = most["n"]
    vectors = cut(e.groupBy("id").agg(F.min("e").alias("e"), F.max("q").alias("q")).mapInArrow(_clean(dims), "id bigint, v binary, length double, q boolean"))
    # summed by position, so what reaches the driver doesn't grow with the input
    sums = vectors.select("v").mapInArrow(_products(dims), "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    gram = np.zeros(dims * dims)
    for r in sums:
        gram[r["at"]] = r["s"]
    values, rotation = np.linalg.eigh((gram.reshape(dims, dims) + gram.reshape(dims, dims).T) / 2)
    rotation, stages = np.ascontiguousarray(rotation[:, ::-1]), stages_of(values[::-1])
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    if not n_queries:
        return nothing
    rows = max(1, unit // (4 * dims))
    parts = max(-(-n // rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // 2048)))
    slices = -(-n_queries // rows)
    folder = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    # a file has one part, so a round reads its own parts only
    vectors.select("id", "v", "length").repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id").withColumn("part", F.spark_partition_id()).write.parquet(folder)
    ordered = spark.read.parquet(folder)
    longest = {r["part"]: r["longest"] for r in ordered.groupBy("part").agg(F.max("length").alias("longest")).collect()}
    numbers = sorted(longest)
    bounds = np.array([longest[p] for p in numbers])
    todo, best, at, size = vectors.where("q").select("id", "v", "length"), None, 0, 1
    while at < len(numbers):
        end = min(len(numbers), at + size)
        if best is None:
            q = todo.select("id", "v", F.lit(float("-inf")).alias("floor"), F.lit(float("-inf")).alias("need"))
        else:
            # a query with k results needs vectors of some length at least; rounding of scores and lengths is allowed for
            known = best.where(F.col("rank") == k).select(F.col("query_id").alias("known"), F.col("score"))
            need = F.when((F.col("score") > 1e-9) & (F.col("length") > 0), (F.col("score") - 1e-9) / F.col("length") * (1 - 1e-6)).otherwise(F.lit(float("-inf")))
            q = todo.join(known, F.col("id") == F.col("known"), "left").select("id", "v", F.coalesce("score", F.lit(float("-inf"))).alias("floor"), need.alias("need")).where(F.col("need") <= float(bounds[at]))
        sent = q.mapInArrow(_sent(numbers[at:end], bounds[at:end]), "part int, id bigint, v binary, floor double")
        sent = sent.select("part", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "id", "v", "floor", F.lit(0.0).alias("length"))
        here = ordered.where(F.col("part").between(numbers[at], numbers[end - 1])).select("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("floor"), "length")
        both = sent.union(here).repartition((end - at) * slices, "part", "slice").sortWithinPartitions("part", "slice", "kind", F.desc("length"), "id")
        found = both.select("part", "slice", "kind", "id", "v", "floor").mapInArrow(_met(dims, rotation, stages, k), "query_id bigint, neighbour_id bigint, score double")
        if best is not None:
            found = found.union(best.select("query_id", "neighbour_id", "score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
        best = cut(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        at, size = end, size * GROWTH
    dropped(spark, folder)
    return original(best.select("query_id", "rank", "neighbour_id", "score"), names, ["query_id", "neighbour_id"])


#: search(embeddings, queries=vec_id % 50 = 0), in SQL.
SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.id AS query_id, b.id AS neighbour_id, round(list_dot_product(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, neighbour_id, s AS score FROM r WHERE rank <= 10
"""
