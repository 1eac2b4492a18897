"""Packing to a mixture: deficit round-robin over source queues, filling every window to target token proportions.

*What is packed.* Each source is a queue of its documents' tokens (words, or a given count), in the keyed order of the documents. In every
round a source's deficit grows by its weight, and each token served costs one; the queue whose turn comes first, with half a token in
hand, is served (equal turns go to the lesser source). So the m-th token of a source with weight w has its turn at (m + 1/2) / w, and
windows are ``window`` tokens in the order of turns. A source's share of a window differs from its target by the deficit that it brings along from the
window before and the one that it hands on, each under one token (for each source). When a queue is empty, the others share its place in proportion. All windows are full but the last.

*How.* What a window takes of a source depends on the turn at which the window ends only, as the deficits carried to it are the
weight times that turn less what is served. So windows are solved side by side, in any partition: by bisecting the turn at which the sources
together have been served a multiple of ``window``. Documents know their offset in the queue by running sums over blocks of the order; each is cut
at the window ends in it, and windows gather their segments.

*Result.* One row for each window: window, n_tokens, and ``segments``, an array of (source, doc_id, start, n): tokens start to start + n - 1 of the document.
``materialised`` adds the texts.

*At scale.* Texts are read once, to count. The shuffles hold (id, source, tokens), the segments, and a row of counts for each
window and source in it; these are never broadcast. Totals by source come to the driver. Nothing depends on how the input is partitioned.

*Odd input.* As in mixing: a null source is '', rows without an id or without tokens are not packed, ids may have any type. Repeated rows are packed each
(further rows of an id have places of their own in the order, away from the first; of equal turns the lesser source is served, and documents whose keys tie are in the order of ids, then
tokens). A very long text fills as many windows as it takes. An empty table gives no windows. Only the named columns are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.mixing import WORD, counted, keyed
from quillspark.llm.shared import column


def served(turn: np.ndarray, weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Tokens of each source (column) whose turn (m + 1/2) / w has come at each given turn (row)."""
    c = np.floor(turn[:, None] * weights + 0.5)
    # by the very division that the order is defined with
    c += (c + 0.5) / weights <= turn[:, None]
    c -= (c > 0) & ((c - 0.5) / weights > turn[:, None])
    return np.minimum(c, totals)


def ends(n: np.ndarray, weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Tokens of each source (columns, in order of their names) among the first n of all (rows)."""
    lo, hi = np.zeros(len(n)), np.full(len(n), ((totals + 1) / weights).max())
    for _ in range(2000):
        mid = (lo + hi) / 2
        enough = served(mid, weights, totals).sum(1) >= n
        if not ((mid > lo) & (mid < hi)).any():
            break
        lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
    # hi is the turn of the last of them; of equal turns the later sources wait
    c, before = served(hi, weights, totals), served(lo, weights, totals)
    over = c.sum(1) - n
    for k in range(len(weights) - 1, -1, -1):
        less = np.minimum(over, c[:, k] - before[:, k])
        c[:, k] -= less
        over -= less
    return c.astype(np.int64)


def integer_weights(totals: dict[str, int], exponent: float) -> dict[str, int]:
    """Weights in proportion to share**exponent, as whole millionths (at least one), so that turns are the same everywhere."""
    all_ = sum(totals.values())
    p = {k: (v / all_) ** exponent for k, v in totals.items()}
    z = sum(p[k] for k in sorted(p))
    return {k: max(1, int(p[k] / z * 1e6 + 0.5)) for k in p}


def windows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", window: int = 2048, exponent: float = 0.7, weights: dict[str, float] | None = None, digits: int = 3, seed: int = 5) -> DataFrame:
    """(window, n_tokens, segments) of all tokens; targets are ``weights`` or else token shares to the power ``exponent``; see the module."""
    t = counted(docs, doc_id, source, text, seed)
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "tokens"))
    t = t.withColumn("copy", copy).withColumn("k", F.when(F.col("copy") == 1, F.col("k")).otherwise(keyed(seed, "doc_id", "copy"))).drop("copy")
    return packed(t, window, exponent, weights, digits)


def packed(t: DataFrame, window: int, exponent: float, weights: dict[str, float] | None, digits: int) -> DataFrame:
    """The windows of ``counted`` documents."""
    spark = t.sparkSession
    totals = {r["source"]: r["n"] for r in t.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    if weights is None:
        target = integer_weights(totals, exponent) if totals else {}
    else:
        z = sum(weights.get(k, 0.0) for k in totals) or 1.0
        target = {k: max(1, int(weights.get(k, 0.0) / z * 1e6 + 0.5)) for k in totals}
    names = sorted(totals, key=lambda k: k.encode())
    total = sum(totals.values())
    w = np.array([target[k] for k in names], float)
    n = np.array([totals[k] for k in names], float)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            for i in range(0, len(at), 1 << 12):
                a = at[i : i + (1 << 12)]
                first, last = ends(np.minimum(a * window, total), w, n), ends(np.minimum((a + 1) * window, total), w, n)
                r, c = np.nonzero(last > first)
                yield pa.RecordBatch.from_arrays([pa.array(a[r]), pa.array([names[k] for k in c], pa.string()), pa.array(first[r, c]), pa.array(last[r, c])], ["window", "source", "q_from", "q_to"])

    count = -(-total // window)
    quota = spark.range(0, count, 1, max(1, min(count, 2 * count // (1 << 14) + 1))).mapInArrow(solve, "window bigint, source string, q_from bigint, q_to bigint")
    # a document's place in its queue: the blocks before its own, and what is before it within the block
    t = t.withColumn("block", F.substring("k", 1, digits))
    blocks = t.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    over = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("block_start"))
    inner = Window.partitionBy("source", "block").orderBy("k", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        t.withColumn("before", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
        .join(blocks, ["source", "block"])
        .select("source", "doc_id", (F.col("block_start") + F.col("before")).alias("s"), (F.col("block_start") + F.col("before") + F.col("tokens")).alias("e"))
    )
    # quotas and documents are both ranges of the queue: they meet in the cells of a grid that they share
    cell = 4 * window
    q = quota.withColumn("cell", F.explode(F.sequence(F.expr(f"q_from div {cell}"), F.expr(f"(q_to - 1) div {cell}"))))
    d = spans.withColumn("cell", F.explode(F.sequence(F.expr(f"s div {cell}"), F.expr(f"(e - 1) div {cell}"))))
    # by sorting: of the quotas the planner sees only the range that they are made from, 8 bytes a window, and would broadcast many times that
    met = d.join(q.hint("merge"), ["source", "cell"]).where("s < q_to and q_from < e").where(f"greatest(s, q_from) div {cell} = cell")
    # a range over two cells meets in each; the piece is one, taken where it begins
    piece = met.select("window", F.struct("source", F.greatest("s", "q_from").alias("at"), "doc_id", (F.greatest("s", "q_from") - F.col("s")).alias("start"), (F.least("e", "q_to") - F.greatest("s", "q_from")).alias("n")).alias("x"))
    return piece.groupBy("window").agg(F.sum("x.n").alias("n_tokens"), F.sort_array(F.collect_list("x")).alias("x")).select(
        "window", "n_tokens", F.transform("x", lambda x: F.struct(x["source"].alias("source"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["n"].alias("n"))).alias("segments")
    )


def segments(packed_: DataFrame) -> DataFrame:
    """(window, slot, source, doc_id, start, n), a row for each segment."""
    return packed_.select("window", F.posexplode("segments").alias("slot", "x")).select("window", "slot", "x.source", "x.doc_id", "x.start", "x.n")


def materialised(packed_: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(window, n_tokens, text): the windows' words, joined by spaces. Of rows that share an id the least text is taken."""
    words = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("t")).where("doc_id is not null and t is not null").groupBy("doc_id").agg(F.min("t").alias("t"))
    s = segments(packed_).join(words, "doc_id").select("window", "slot", "n", F.array_join(F.slice(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), (F.col("start") + 1).cast("int"), F.col("n").cast("int")), " ").alias("t"))
    return s.groupBy("window").agg(F.sum("n").alias("n_tokens"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "t"))), lambda x: x["t"]), " ").alias("text"))


#: segments(windows()) with its defaults, in SQL: every token is a row, in the order of turns.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^ \t\n\r\x0B\f]+'))::BIGINT AS tokens FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source, tokens) AS copy FROM t WHERE tokens > 0),
k AS (SELECT *, md5('5:' || doc_id || CASE WHEN copy > 1 THEN ':' || copy ELSE '' END) AS k FROM c),
d AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM k),
n AS (SELECT source, sum(tokens) AS total FROM d GROUP BY source),
p AS (SELECT source, pow(total::DOUBLE / (SELECT sum(total) FROM n), 0.7) AS p FROM n),
w AS (SELECT source, greatest(1, floor(p / (SELECT list_sum(list(p ORDER BY source)) FROM p) * 1e6 + 0.5)) AS w FROM p),
m AS (SELECT source, doc_id, s, tokens, unnest(range(s, s + tokens)) AS m FROM d),
o AS (SELECT source, doc_id, s, m, (row_number() OVER (ORDER BY (m + 0.5) / w, source) - 1) // 2048 AS win FROM m JOIN w USING (source)),
g AS (SELECT win, source, doc_id, s, min(m) AS q_at, count(*) AS n FROM o GROUP BY win, source, doc_id, s)
SELECT win AS "window", (row_number() OVER (PARTITION BY win ORDER BY source, q_at) - 1)::INTEGER AS slot, source, doc_id, q_at - s AS start, n FROM g
"""
