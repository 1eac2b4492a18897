"""Mixing sources to target weights: temperature on token shares, realised as budgeted permutations of blocks.

*Weights.* A source with the share p of all tokens gets the weight p**a / sum(p**a). The exponent a is bisected on [0, 1] (0 is even,
1 is as it comes): the greatest for which the entropy is at least ``target_entropy`` of the most possible (ln of the number of
sources), and then the least from there on for which no source is repeated more than ``max_repetition`` times within the budget. It is rounded up to 6
places. With either target out of reach on [0, 1] the nearer end is taken (a = 1 repeats nothing if the budget is all tokens).

*Realisation.* With ``budget`` tokens (by default as many as there are; 0: as few as take every source once in full), a source has a quota of
floor(weight * budget). It is served by passes over all its documents, the last one being partial. Documents are in blocks by the leading
``digits`` hexadecimal digits of a keyed MD5 of their id; each pass permutes the blocks by a keyed MD5 and takes them in turn, documents within a block in the
order of their own, until the quota is met: the last document taken is the one that reaches it. So quotas are met to within one document, whatever the sizes, and a
pass over part of a source is a fresh random part of it.

*Result.* One row for each draw: doc_id, source, tokens, pass (from 0), start_token (in the pass). ``mixed`` returns the rows of the documents themselves, each as often as it is drawn.

*At scale.* Texts are read once, to count words. What is shuffled is (id, source, tokens): by source and block for the running sums, so a hot
source is 16**digits groups. Totals by source come to the driver, a row a source; totals by block stay distributed.

*Odd input.* A null source is the source ''. Texts that are null or without words have no tokens and are never drawn; rows with a null
doc_id are never drawn either. Ids may have any type and come back as they are. A very long text is one document, counted whole; a quota that ends in it is exceeded by what is left of it.
Rows that share an id are documents of their own, each in its own source; in a source they come together (equal ids have equal keys; ties are in the order of ids, then tokens, and rows that tie
in all of these stand for each other, of which ``mixed`` takes as many as are drawn). An empty table gives no draws. ``draws`` reads only the named columns; ``mixed`` keeps all, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import column, cut, fresh

WORD = r"[^ \t\n\r\x0B\f]+"


def n_words(text: Column | str) -> Column:
    """Number of runs of non-space characters."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def keyed(seed: int, *columns: Column | str) -> Column:
    """A keyed MD5 in hexadecimal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def source_of(docs: DataFrame, source: str) -> Column:
    return F.coalesce(column(docs, source).cast("string"), F.lit(""))


def counted(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 2) -> DataFrame:
    """(doc_id, source, tokens, k) of the documents that have tokens and an id, cut; k is the keyed order."""
    d = docs.select(column(docs, doc_id).alias("doc_id"), source_of(docs, source).alias("source"), n_words(column(docs, text)).alias("tokens"))
    return cut(d.where("doc_id is not null and tokens > 0").withColumn("k", keyed(seed, "doc_id")))


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def tempered(shares: list[float], a: float) -> list[float]:
    p = [s**a if s > 0 else 0.0 for s in shares]
    return [x / sum(p) for x in p]


@dataclass
class Mix:
    exponent: float
    budget: int
    weights: dict[str, float]
    quotas: dict[str, int]


def solve(totals: dict[str, int], target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None) -> Mix:
    """Exponent, weights and quotas for the sources' token totals."""
    names = sorted(n for n in totals if totals[n] > 0)
    all_ = sum(totals[n] for n in names)
    if not names:
        return Mix(1.0, 0, {}, {})
    shares = [totals[n] / all_ for n in names]
    a = 1.0
    if target_entropy is not None and entropy(tempered(shares, 1.0)) < target_entropy * math.log(len(names)):
        lo, hi = 0.0, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if entropy(tempered(shares, mid)) >= target_entropy * math.log(len(names)) else (lo, mid)
        a = lo

    def repetition(x: float) -> float:
        w = tempered(shares, x)
        b = (budget or all_) if budget != 0 else max(n / v for n, v in zip([totals[k] for k in names], w))
        return max(v * b / totals[k] for k, v in zip(names, w))

    if max_repetition is not None and repetition(a) > max_repetition:
        lo, hi = a, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if repetition(mid) <= max_repetition else (mid, hi)
        a = hi
    a = math.ceil(a * 1e6) / 1e6
    w = tempered(shares, a)
    if budget is None:
        budget = all_
    elif budget == 0:
        budget = math.ceil(max(totals[k] / v for k, v in zip(names, w)))
        return Mix(a, budget, dict(zip(names, w)), {k: max(totals[k], math.floor(v * budget)) for k, v in zip(names, w)})
    return Mix(a, budget, dict(zip(names, w)), {k: math.floor(v * budget) for k, v in zip(names, w)})


def solved(t: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: int | None) -> tuple[dict[str, int], Mix]:
    """(token totals by source, mix) of ``counted`` documents."""
    totals = {r["source"]: r["n"] for r in t.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    return totals, solve(totals, target_entropy, max_repetition, budget)


def draws(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None, digits: int = 3, seed: int = 2) -> DataFrame:
    """(doc_id, source, tokens, pass, start_token) of every draw; see the module."""
    t = counted(docs, doc_id, source, text, seed)
    return drawn(t, *solved(t, target_entropy, max_repetition, budget), digits, seed)


def drawn(t: DataFrame, totals: dict[str, int], mix: Mix, digits: int, seed: int) -> DataFrame:
    """The draws of a solved mix from ``counted`` documents."""
    spark = t.sparkSession
    plan = spark.createDataFrame([(k, totals[k], q) for k, q in mix.quotas.items() if q > 0], "source string, total bigint, quota bigint")
    t = t.withColumn("block", F.substring("k", 1, digits))
    blocks = t.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    passes = plan.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(quota - 1) div total"))).alias("pass"))
    w = Window.partitionBy("source", "pass").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        blocks.join(passes, "source")
        .withColumn("order", keyed(seed, "source", "pass", "block"))
        .withColumn("block_start", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .withColumn("want", F.least(F.col("total"), F.col("quota") - F.col("pass") * F.col("total")))
        .where("block_start < want")
        .select("source", "block", "pass", "block_start", "want")
    )
    inner = Window.partitionBy("source", "block").orderBy("k", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    within = t.withColumn("before", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    return (
        within.join(placed, ["source", "block"])
        .withColumn("start_token", F.col("block_start") + F.col("before"))
        .where("start_token < want")
        .select("doc_id", "source", "tokens", "pass", "start_token")
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None, digits: int = 3, seed: int = 2) -> DataFrame:
    """``docs`` with each row as often as it is drawn (not at all, if it is not), so that quotas hold for the rows returned."""
    t = counted(docs, doc_id, source, text, seed)
    d = drawn(t, *solved(t, target_entropy, max_repetition, budget), digits, seed)
    # rows with the same id, source and tokens stand for each other: there are n, and m draws of them
    kinds = ("doc_id", "source", "tokens")
    both = t.select(*kinds, F.lit(1).alias("n"), F.lit(0).alias("m")).union(d.select(*kinds, F.lit(0), F.lit(1)))
    times = cut(both.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("m > 0"))
    key = (column(docs, doc_id) == times["doc_id"]) & (source_of(docs, source) == times["source"]) & (n_words(column(docs, text)) == times["tokens"])
    columns = [column(docs, c) for c in docs.columns]
    again = fresh(docs, "__again")
    out = docs.join(times, key).where(times["m"] >= times["n"]).select(*columns, F.explode(F.sequence(F.lit(1), F.floor(times["m"] / times["n"]).cast("int"))).alias(again)).drop(again)
    # a partial pass can end between such rows, once in a source: so many of them come once more
    split = times.where("m % n > 0")
    if split.isEmpty():
        return out
    place = Window.partitionBy(times["doc_id"], times["source"], times["tokens"]).orderBy(F.xxhash64(*[c for c, f in zip(columns, docs.schema.fields) if f.dataType.typeName() != "map"]))
    more = docs.join(F.broadcast(split), (column(docs, doc_id) == split["doc_id"]) & (source_of(docs, source) == split["source"]) & (n_words(column(docs, text)) == split["tokens"]))
    more = more.withColumn(again, F.row_number().over(place)).where(F.col(again) <= times["m"] % times["n"])
    return out.union(more.select(*columns))


#: draws() with its defaults, in SQL.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^ \t\n\r\x0B\f]+'))::BIGINT AS tokens, md5('2:' || doc_id) AS k FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT *, substr(k, 1, 3) AS block FROM t WHERE tokens > 0),
s AS (SELECT source, sum(tokens)::BIGINT AS total FROM d GROUP BY source),
a AS (SELECT sum(total)::DOUBLE AS all_, count(*)::DOUBLE AS n FROM s),
l AS (SELECT list(total / all_ ORDER BY source) AS p, list(total::DOUBLE ORDER BY source) AS totals, any_value(all_) AS all_, any_value(n) AS n FROM s, a),
e(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN h >= 0.95 * ln(n) THEN mid ELSE lo END, CASE WHEN h >= 0.95 * ln(n) THEN hi ELSE mid END FROM (
    SELECT *, -list_sum(list_transform(list_transform(p, lambda x: pow(x, mid) / z), lambda x: x * ln(x))) AS h FROM (
      SELECT *, list_sum(list_transform(p, lambda x: pow(x, mid))) AS z FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, p, n FROM e, l WHERE i < 40)))),
e1 AS (SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) < 0.95 * ln(n) THEN (SELECT lo FROM e WHERE i = 40) ELSE 1.0 END AS a FROM l),
r(i, lo, hi) AS (SELECT 0, a, 1.0::DOUBLE FROM e1 UNION ALL
  SELECT i + 1, CASE WHEN m <= 4 THEN lo ELSE mid END, CASE WHEN m <= 4 THEN mid ELSE hi END FROM (
    SELECT *, list_max(list_transform(p, lambda x: pow(x, mid) / z / x)) AS m FROM (
      SELECT *, list_sum(list_transform(p, lambda x: pow(x, mid))) AS z FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, p FROM r, l WHERE i < 40)))),
x AS (SELECT ceil(CASE WHEN (SELECT list_max(list_transform(p, lambda y: pow(y, e1.a) / list_sum(list_transform(p, lambda q: pow(q, e1.a))) / y)) FROM l) > 4 THEN (SELECT hi FROM r WHERE i = 40) ELSE e1.a END * 1e6) / 1e6 AS a FROM e1),
w AS (SELECT source, total, floor(pow(total / all_, x.a) / (SELECT sum(pow(total / all_, x.a)) FROM s, a, x) * all_)::BIGINT AS quota FROM s, a, x),
b AS (SELECT source, block, sum(tokens) AS n FROM d GROUP BY source, block),
q AS (SELECT source, total, quota, unnest(range(0, (quota - 1) // total + 1)) AS pass FROM w WHERE quota > 0),
o AS (SELECT b.source, b.block, pass, coalesce(sum(n) OVER (PARTITION BY b.source, pass ORDER BY md5('2:' || b.source || ':' || pass || ':' || b.block), b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start, least(total, quota - pass * total) AS want FROM b JOIN q USING (source)),
v AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, block ORDER BY k, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT v.doc_id, v.source, v.tokens, pass, (block_start + before)::BIGINT AS start_token FROM v JOIN o USING (source, block) WHERE block_start + before < want
"""
