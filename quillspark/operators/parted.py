"""Counts and estimates by the parts of ``grams``, as DataFrames.

The text is read once; each task counts chunks of it and sends a block to each part. Parts merge their blocks and write down, once, their table, numbers of words and of contexts. From
these, with the probabilities of words, each part computes its entries when they are read; entries are not shuffled and not written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import counts as C
from quillspark.operators import grams as G
from quillspark.operators.durable import stored

TABLE, WORD, CONTEXT, STATS, ASKED, ADJUSTED = range(6)
NUMBERS = ("lefts", "raw", "ends", "den", "lost", "c1", "c2", "c3")
WRITTEN = "part int, kind int, code int, data binary, word string, " + ", ".join(f"{x} bigint" for x in NUMBERS)
READ = "part int, kind int, code int, data binary, listed boolean, ngram string"
ENTRIES = "order int, ngram string, p double, backoff double, gamma double, extends_left boolean, starts boolean"
_TYPES = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def number_of_parts(df: DataFrame) -> int:
    """As many as tables of this size deserve: of 4 MB of the input each by Spark's own estimate, less of small ones so that all cores are used; beyond 128 as the root of the size, as each part
    sends a block to each."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 46:  # unknown
        return most
    return max(1, min(most, size >> 18), min(size // 4_000_000, int(128 * (size / 512e6) ** 0.5)))


def blocks(df: DataFrame, column: str, order: int, skip_symbols: bool = True) -> tuple[DataFrame, int]:
    """(part, data) of the n-grams of a text column, each part in one task; the number of parts."""
    d = C.spread(df.select(F.col(column).cast("string").alias("text")).where("text is not null"))
    parts = number_of_parts(d)
    return d.mapInArrow(lambda x: G.chunks(x, order, parts, skip_symbols), "part int, data binary").repartitionById(parts, "part"), parts


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(p, []).append(d)
    for p in sorted(held):
        yield p, held.pop(p)
        G.trimmed()


def _batch(schema: str, n: int, **columns: object) -> pa.RecordBatch:
    """A batch with the given columns (arrays, or one value for all rows) of a schema; the others are null."""
    fields = [f.split() for f in schema.split(", ")]
    out = []
    for name, kind in fields:
        x, kind = columns.get(name), _TYPES[kind]
        if x is None:
            x = pa.nulls(n, kind)
        elif isinstance(x, (int, float, bool, bytes, str)):
            x = pa.repeat(pa.scalar(x, kind), n)
        elif isinstance(x, np.ndarray):
            x = pa.array(x, kind)
        out.append(x)
    return pa.RecordBatch.from_arrays(out, [name for name, _ in fields])


def _sliced(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + G.BATCH)) for a in range(0, n, G.BATCH))


def raw(df: DataFrame, order: int, column: str = "text") -> DataFrame:
    """(ngram, count) of the lines of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _grouped(batches):
            names, cols, n = G.merged(data, order)
            part = G.Part(names, cols, n)
            for a, b in _sliced(len(n)):
                yield _batch("ngram string, count bigint", b - a, ngram=part.strings([cols[k][a:b] for k in G.in_text_order(order)]), count=n[a:b])

    return blocks(df, column, order)[0].mapInArrow(run, "ngram string, count bigint")


def adjusted(df: DataFrame, order: int, n: int, column: str = "text") -> DataFrame:
    """(ngram, adjusted, raw) of one order of the estimate of another."""
    schema = "ngram string, adjusted bigint, raw bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _grouped(batches):
            part = G.Part(*G.merged(data, order))
            rows = np.flatnonzero(part.valid[n])
            for a, b in _sliced(len(rows)):
                x = rows[a:b]
                yield _batch(schema, b - a, ngram=part.strings([part.word(n, i)[x] for i in range(n)]), adjusted=part.adjusted[n][x], raw=part.raw[n][x])

    if n == 1:
        rows, *_, parts = written(df, order, [0] * order, None, column, True)
        return words_of(words(rows, parts), order).select(F.col("word").alias("ngram"), "adjusted", "raw")
    return blocks(df, column, order)[0].mapInArrow(run, schema)


def _numbers(part: G.Part) -> dict[str, np.ndarray]:
    """By code, numbers of the words of a marked part: as ends of n-grams (``lefts``: how many of two words, ``raw``: their counts, ``ends``: of these, entries) and as contexts of one word."""
    w, zero = part.words, np.zeros(part.words, np.int64)
    out = dict.fromkeys(NUMBERS, zero)
    if part.order == 1:
        out["lefts"] = out["raw"] = np.bincount(part.cols[0], part.raw[1], w).astype(np.int64)
        return out
    last = part.word(2, 1)
    one, *sums = part.sums[2]
    out |= {"lefts": np.bincount(last, minlength=w), "raw": np.bincount(last, part.raw[2], w).astype(np.int64), "ends": np.bincount(last[part.kept[2]], minlength=w)}
    for name, x in zip(("den", "lost", "c1", "c2", "c3"), sums):
        out[name] = zero.copy()
        out[name][part.word(2, 0)[one]] = x
    return out


def _derived(p: int, part: G.Part, parts: int) -> Iterator[pa.RecordBatch]:
    """What a marked part tells of words, of contexts to other parts, and of counts of counts."""
    part.contexts()
    numbers, data, to = _numbers(part), [], []
    for q, x in enumerate(part.told(parts)):
        if len(x):
            to.append(q)
            data.append(G.listed(part.names, x, [n[x] for n in numbers.values()]))
    yield _batch(WRITTEN, len(to), part=np.array(to, np.int32), kind=WORD, code=p, data=pa.array(data, pa.binary()))
    for k in part.levels:
        v, adj = part.valid[k], part.adjusted[k]
        n = [int((v & (adj == j)).sum()) for j in (1, 2, 3, 4)]
        yield _batch(WRITTEN, 1, part=p, kind=STATS, code=k, lefts=n[0], raw=n[1], ends=n[2], den=n[3], lost=int(v.sum()), c1=int(part.kept[k].sum()))
    home = (G.hashes(part.names) % np.uint64(parts)).astype(np.int64)
    for k in part.levels[1:]:
        one, *sums = part.sums[k]
        some = np.flatnonzero(sums[0] > 0)
        words_ = [part.word(k, i)[one[some]] for i in range(k - 1)]
        cols = [words_[i] for i in G.in_sort_order(k - 1)]
        to = home[cols[0]]
        by = np.lexsort([*cols[::-1], to])
        bounds = np.searchsorted(to[by], np.arange(parts + 1))
        at = np.flatnonzero(np.diff(bounds))
        data = []
        for q in at:
            x = by[bounds[q] : bounds[q + 1]]
            data.append(G.block(part.names, [c[x] for c in cols], [s[some[x]] for s in sums]))
        yield _batch(WRITTEN, len(at), part=at.astype(np.int32), kind=CONTEXT, code=k - 1, data=pa.array(data, pa.binary()))


def written(df: DataFrame, order: int, limits: Sequence[int], vocab: DataFrame | None, column: str, skip_symbols: bool) -> tuple[DataFrame, DataFrame | None, int]:
    """The parts' tables and numbers, written once (columns of ``WRITTEN``); if words are limited, (part, code, word) of all parts' words; the number of parts."""
    shuffled, parts = blocks(df, column, order, skip_symbols)
    limited = vocab is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, data in _grouped(batches):
            names, cols, n = G.merged(data, order)
            del data
            if order > 1:
                table = G.block(names, cols, [n], whole=True)
                for k, a in enumerate(range(0, len(table), G.PIECE)):
                    yield _batch(WRITTEN, 1, part=p, kind=TABLE, code=k, data=table[a : a + G.PIECE])
                del table
            part = G.Part(names, cols, n)
            del names, cols, n
            if limited and order > 1:  # which n-grams are pruned isn't known yet
                for a, b in _sliced(part.words):
                    yield _batch(WRITTEN, b - a, part=p, kind=WORD, code=np.arange(a, b, dtype=np.int32), word=part.strings([np.arange(a, b)]))
                continue
            part.marked(limits, None)
            yield from _derived(p, part, parts)

    out = stored(shuffled.mapInArrow(run, WRITTEN))
    if not limited or order == 1:
        return out, None, parts
    codes = out.where(f"kind = {WORD}").select("part", "code", "word")
    words = codes.join(allowed(vocab), "word", "left")
    both = _read(out.where(f"kind = {TABLE}"), "data").union(_read(words.withColumn("kind", F.lit(WORD)), "listed"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x in _parts(batches):
            part = x.opened(order)
            part.marked(limits, x.listed(part))
            yield from _derived(p, part, parts)

    more = stored(both.repartitionById(parts, "part").mapInArrow(again, WRITTEN))
    return out.where(f"kind = {TABLE}").union(more), codes, parts


def allowed(vocab: DataFrame) -> DataFrame:
    """(word, listed) of a vocabulary and the special words."""
    special = vocab.sparkSession.createDataFrame([(x,) for x in T.SPECIAL], "word string")
    return vocab.select("word").union(special).distinct().withColumn("listed", F.lit(True))


def _read(df: DataFrame, *have: str) -> DataFrame:
    """Rows with the columns of ``READ``."""
    have = ("part", "kind", "code", *have)
    fields = [f.split() for f in READ.split(", ")]
    return df.select(*[F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fields])


class _Inputs:
    """What came for one part."""

    def __init__(self) -> None:
        self.table: dict[int, bytes] = {}
        self.contexts: list[tuple[int, bytes]] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.numbers: dict[int, bytes] = {}
        self.asked: list[pa.Array] = []

    def opened(self, order: int) -> G.Part:
        names, cols, (n,) = G.opened(b"".join(self.table[k] for k in sorted(self.table)), order)
        return G.Part(names, cols, n)

    def listed(self, part: G.Part) -> np.ndarray:
        """Which words of a part are listed, by code."""
        out = np.zeros(part.words, bool)
        for code, known in self.words:
            out[code] = known
        return out

    def adjusted(self, part: G.Part, parts: int) -> np.ndarray:
        """Adjusted counts of a part's words, by code."""
        out = np.zeros(part.words, np.int64)
        for q, x in enumerate(part.told(parts)):
            if len(x):
                (out[x],) = G.unpacked(self.numbers[q])
        return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Inputs]]:
    held: dict[int, _Inputs] = {}
    for b in batches:
        part, kind = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for p in np.unique(part):
            x, mine = held.setdefault(int(p), _Inputs()), part == p
            for k in np.unique(kind[mine]):
                at = pa.array(np.flatnonzero(mine & (kind == k)))
                code = b.column(2).take(at)
                if k == WORD:
                    x.words.append((code.to_numpy(zero_copy_only=False), pc.fill_null(b.column(4).take(at), False).to_numpy(zero_copy_only=False)))
                elif k == ASKED:
                    x.asked.append(b.column(5).take(at).cast(pa.binary()))
                else:
                    for c, d in zip(code.to_pylist(), b.column(3).take(at).to_pylist()):
                        if k == TABLE:
                            x.table[c] = d
                        elif k == ADJUSTED:
                            x.numbers[c] = d
                        else:
                            x.contexts.append((c, d))
    for p in sorted(held):
        x = held.pop(p)
        if x.table:
            yield p, x
            G.trimmed()


def _split(ngrams: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of n-grams, one after the other, and where each begins."""
    x = pc.split_pattern(ngrams, b" ")
    return x.flatten(), np.asarray(x.offsets) - x.offsets[0].as_py()


def _homes(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Where n-grams of two words and more are looked up."""
    for b in batches:
        if b.num_rows:
            flat, off = _split(b.column(0).cast(pa.binary()))
            to = (G.hashes(flat.take(pa.array(off[1:] - 2))) % np.uint64(parts)).astype(np.int32)
            yield _batch(READ, b.num_rows, part=to, kind=ASKED, ngram=b.column(0))


class Entries:
    """The entries of a written estimate above the first order. ``told``: of ``words``; ``codes``: as of ``written``, with ``allowed`` the words that are listed; ``unigram``: what a word's probability
    is made of besides its adjusted count: the sum of these, and its share of what the discounts leave."""

    def __init__(self, rows: DataFrame, told: DataFrame, codes: DataFrame | None, vocab: DataFrame | None, parts: int, order: int, limits: Sequence[int], discounts: dict[int, tuple[float, float, float]], unigram: tuple[float, float]):
        self.rows, self.told, self.codes, self.vocab, self.parts, self.order, self.limits, self.limited = rows, told, codes, vocab, parts, order, limits, vocab is not None
        self.how = (order, parts, limits, self.limited, discounts, unigram)

    def _inputs(self, asked: DataFrame | None = None) -> DataFrame:
        x = _read(self.rows.where(F.col("kind").isin(TABLE, CONTEXT)), "data").union(_read(self.told.where(f"kind = {ADJUSTED}"), "data"))
        if self.limited:
            x = x.union(_read(self.codes.join(allowed(self.vocab), "word").withColumn("kind", F.lit(WORD)), "listed"))
        if asked is not None:
            parts = self.parts
            x = x.union(asked.select("ngram").where("instr(ngram, ' ') > 0").mapInArrow(lambda b: _homes(b, parts), READ))
        return x.repartitionById(self.parts, "part")

    def of(self, levels: Sequence[int], asked: DataFrame | None = None) -> DataFrame:
        """(order, ngram, p, backoff, gamma, extends_left, starts) of the entries of some orders above the first; of those ``asked`` (ngram) only, if given.

        ``extends_left``: a longer entry ends with it. ``starts``: a longer entry begins with it.
        """
        how, some = self.how, asked is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, x in _parts(batches):
                if some and not x.asked:
                    continue
                e = _computed(x, max(levels), *how)
                want = _places(e.part, x.asked) if some else None
                for k in levels:
                    rows = np.flatnonzero(e.part.kept[k]) if want is None else want.get(k, np.zeros(0, np.int64))
                    rows = rows if want is None else rows[e.part.kept[k][rows]]
                    for a, b in _sliced(len(rows)):
                        at = rows[a:b]
                        yield _batch(ENTRIES, b - a, order=k, ngram=e.part.strings([e.part.word(k, i)[at] for i in range(k)]), p=e.p[k][at], backoff=e.backoff[k][at], gamma=e.gamma[k][at], extends_left=e.ends[k][at], starts=e.starts[k][at])

        return self._inputs(asked).mapInArrow(run, ENTRIES)

    def rests(self, levels: Sequence[int]) -> DataFrame:
        """(order, ngram, p, rest) of the entries of some orders: the greatest probability of an entry and of all that end with it. Of order 1: words, with the greatest of a part's entries that end with them."""
        order, how = self.order, self.how
        schema = "order int, ngram string, p double, rest double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, x in _parts(batches):
                e = _computed(x, order, *how)
                part, rest = e.part, {}
                for k in reversed(part.levels):
                    rest[k] = np.where(part.kept[k], e.p[k], -1.0)
                    if k < order and len(rest[k]):
                        rest[k] = np.maximum(rest[k], np.maximum.reduceat(rest[k + 1], np.searchsorted(part.at[k + 1], part.at[k])))
                for k in levels:
                    if k == 1:
                        top = np.full(part.words, -1.0)
                        np.maximum.at(top, part.word(2, 1), rest[2])
                        rows = np.flatnonzero(top >= 0)
                        for a, b in _sliced(len(rows)):
                            yield _batch(schema, b - a, order=1, ngram=part.strings([rows[a:b]]), rest=top[rows[a:b]])
                        continue
                    rows = np.flatnonzero(part.kept[k])
                    for a, b in _sliced(len(rows)):
                        at = rows[a:b]
                        yield _batch(schema, b - a, order=k, ngram=part.strings([part.word(k, i)[at] for i in range(k)]), p=e.p[k][at], rest=rest[k][at])

        return self._inputs().mapInArrow(run, schema)

    def gammas(self, n: int) -> DataFrame:
        """(context, den, lost, c1, c2, c3) of the entries of an order above the second."""
        schema = "context string, den bigint, lost bigint, c1 bigint, c2 bigint, c3 bigint"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    names, cols, numbers = G.opened(data, n - 1)
                    context = G.strings(names, [cols[k] for k in G.in_text_order(n - 1)])
                    yield _batch(schema, len(context), context=context, **dict(zip(("den", "lost", "c1", "c2", "c3"), numbers)))

        return self.rows.where((F.col("kind") == CONTEXT) & (F.col("code") == n - 1)).select("data").mapInArrow(run, schema)


def discounted(a: np.ndarray, d: Sequence[float]) -> np.ndarray:
    return a - np.where(a == 0, 0.0, np.where(a == 1, d[0], np.where(a == 2, d[1], d[2])))


class _Computed:
    """A part's probabilities, back-offs and flags by order."""


def _computed(x: _Inputs, top: int, order: int, parts: int, limits: Sequence[int], limited: bool, discounts: dict[int, tuple[float, float, float]], unigram: tuple[float, float]) -> _Computed:
    e = _Computed()
    part = x.opened(order)
    low = discounted(x.adjusted(part, parts), discounts[1]) / unigram[0] + unigram[1]
    part.marked(limits, x.listed(part) if limited else None)
    part.contexts()
    e.part, e.p, e.backoff, e.gamma, e.ends, e.starts = part, {}, {}, {}, {}, {}
    for k in range(2, top + 1):
        d, a = discounts[k], part.adjusted[k]
        _, den, *_ = part.sums[k]
        gamma = part.gamma(k, d)[part.context[k]]
        below = low[part.word(2, 1)] if k == 2 else e.p[k - 1][part.parent[k]]
        with np.errstate(invalid="ignore", divide="ignore"):
            e.p[k] = discounted(a, d) / den[part.context[k]] + gamma * below
        e.gamma[k], n = gamma, len(a)
        e.backoff[k], e.starts[k], e.ends[k] = np.ones(n), np.zeros(n, bool), np.zeros(n, bool)
        if k < order and n:
            e.ends[k] = np.logical_or.reduceat(part.kept[k + 1], np.searchsorted(part.at[k + 1], part.at[k]))
    for k in range(2, top + 1):
        if told := [G.opened(data, k) for size, data in x.contexts if size == k]:
            names, cols, (den, lost, c1, c2, c3) = G.together(told)
            at, d = part.find(names, cols), discounts[k + 1]
            have = at >= 0
            e.backoff[k][at[have]] = ((d[0] * c1 + d[1] * c2 + d[2] * c3 + lost) / den)[have]
            e.starts[k][at[have]] = (c1 + c2 + c3 > 0)[have]
    for k in e.backoff:
        e.backoff[k][np.isin(part.word(k, k - 1), [part.eos, part.unk])] = 1.0
    return e


def _places(part: G.Part, asked: list[pa.Array]) -> dict[int, np.ndarray]:
    """By order, the numbers of the n-grams asked for that the part has."""
    flat, off = _split(pa.concat_arrays(asked))
    enc = flat.dictionary_encode()
    code, size = enc.indices.to_numpy(zero_copy_only=False), np.diff(off)
    out = {}
    for k in part.levels:
        at = off[:-1][size == k]
        found = part.find(enc.dictionary, [code[at + i] for i in G.in_sort_order(k)])
        out[k] = np.unique(found[found >= 0])
    return out


def words(rows: DataFrame, parts: int) -> DataFrame:
    """What parts tell of words, summed and written once (columns of ``WRITTEN``): words with their numbers, and back to each part its words' adjusted counts, in the order in which it told of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for q, p, d in zip(*[b.column(k).to_pylist() for k in range(3)]):
                held.setdefault(q, []).append((p, d))
        for q, told in sorted(held.items()):
            names, numbers = zip(*[G.numbered(d) for _, d in told])
            enc = pa.concat_arrays(names).dictionary_encode()
            code, n = enc.indices.to_numpy(zero_copy_only=False), len(enc.dictionary)
            total = [np.bincount(code, np.concatenate(x), n).astype(np.int64) for x in zip(*numbers)]
            for a, b in _sliced(n):
                yield _batch(WRITTEN, b - a, kind=WORD, word=enc.dictionary[a:b].cast(pa.string()), **{k: x[a:b] for k, x in zip(NUMBERS, total)})
            cuts = np.cumsum([len(x) for x in names])[:-1]
            back = [G.packed([total[0][c]]) for c in np.split(code, cuts)]
            yield _batch(WRITTEN, len(told), part=np.array([p for p, _ in told], np.int32), kind=ADJUSTED, code=q, data=pa.array(back, pa.binary()))

    told = rows.where(f"kind = {WORD} and data is not null").select("part", "code", "data")
    return stored(told.repartitionById(parts, "part").mapInArrow(run, WRITTEN))


def words_of(told: DataFrame, order: int) -> DataFrame:
    """(word, adjusted, raw, ends, den, lost, c1, c2, c3) of all words and the special ones: as unigrams, and as contexts (``den`` 0 if they are none)."""
    own = told.where(f"kind = {WORD}").select("word", *NUMBERS)
    zeros = told.sparkSession.createDataFrame([(T.UNK, *[0] * 8), (T.BOS, *[0] * 8)], "word string, " + ", ".join(f"{x} bigint" for x in NUMBERS))
    special = own.where(F.col("word").isin(T.UNK, T.BOS)).union(zeros).groupBy("word").agg(*[F.sum(x).alias(x) for x in NUMBERS])
    return own.where(~F.col("word").isin(T.UNK, T.BOS)).union(special).withColumnRenamed("lefts", "adjusted")
