"""N-gram counts: raw, adjusted, counts of counts, discounts, and marks for pruning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.skew import ranked


#: Of ``count_of_counts``, by order.
COUNTS = ("n1", "n2", "n3", "n4", "total", "kept")


class BadDiscountError(ValueError):
    """Discounts can't be estimated from the counts of counts, and there is no fallback."""


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer partitions (as one small file does); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def sentences(df: DataFrame, column: str = "text", keep: Sequence[str] = (), skip_symbols: bool = True) -> DataFrame:
    """(``keep`` columns, ``words``) for each line of the text column; null texts have no lines."""
    d = spread(df.select(*keep, column).where(F.col(column).isNotNull()))
    return d.select(*keep, F.explode(T.lines(F.col(column))).alias("line")).select(*keep, T.train_words(F.col("line"), skip_symbols).alias("words"))


def raw_counts(sents: DataFrame, order: int) -> DataFrame:
    """(ngram, count) of the padded n-grams of ``words``; partial sums before the one shuffle."""
    p = sents.select(T.padded(F.col("words"), order).alias("p"))
    # places are exploded rather than n-grams: what joins the words is compiled then
    at = p.select("p", F.explode(F.sequence(F.lit(0), F.size("p") - order)).alias("i"))
    return at.select(F.concat_ws(" ", *[F.get("p", F.col("i") + k) for k in range(order)]).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("count"))


def token_stats(sents: DataFrame) -> DataFrame:
    """One row: sentences, tokens (without end markers), types (with the three special words)."""
    w = sents.select(F.explode_outer("words").alias("w"), F.lit(1).alias("one"))
    return sents.select(F.size("words").alias("n")).agg(F.count("*").alias("sentences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).crossJoin(
        w.agg((F.count_distinct("w") + 3).alias("types"))
    )


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(word, id): ids by first occurrence in the order (document, place), after <unk> 0, <s> 1 and </s> 2.

    The place is found by partial minima, and ranks by range: each partition of the sorted words starts at the number of those before it, so no single task
    sees the whole vocabulary.
    """
    w = docs.where(F.col(column).isNotNull()).select(F.col(doc_id).alias("d"), F.posexplode(T.train_words(F.regexp_replace(column, "\n", " "))).alias("p", "word"))
    first = w.groupBy("word").agg(F.min(F.struct("d", "p")).alias("at")).select("word", F.col("at.d").alias("d"), F.col("at.p").alias("p"))
    special = docs.sparkSession.createDataFrame([(T.UNK, 0), (T.BOS, 1), (T.EOS, 2)], "word string, id bigint")
    return special.union(ranked(first, ["d", "p", "word"], "r").select("word", (F.col("r") + 3).cast("bigint").alias("id")))


def adjusted(raw: DataFrame, order: int) -> dict[int, DataFrame]:
    """(ngram, adjusted, raw) of each order from the raw counts of the highest.

    Each order is one aggregation of the next: its rows are distinct left extensions, so counting them needs no distinct. Padded n-grams
    whose second word is <s> are entries of lower orders only. Unigrams have <unk> and <s> with 0.
    """
    spark = raw.sparkSession
    out: dict[int, DataFrame] = {}
    at = raw.select("ngram", F.col("count").alias("raw"), F.lit(1).cast("bigint").alias("lefts"))
    for n in range(order, 0, -1):
        rows = at.select("ngram", F.col("raw").alias("adjusted") if n == order else F.when(T.first(F.col("ngram")) == T.BOS, F.col("raw")).otherwise(F.col("lefts")).alias("adjusted"), "raw")
        if n > 1:
            rows = rows.where(F.element_at(F.split("ngram", " "), 2) != T.BOS)
        else:
            rows = rows.where(F.col("ngram") != T.BOS).union(spark.createDataFrame([(T.UNK, 0, 0), (T.BOS, 0, 0)], "ngram string, adjusted bigint, raw bigint"))
        out[n] = rows
        if n > 1:
            at = at.groupBy(T.suffix(F.col("ngram")).alias("ngram")).agg(F.sum("raw").alias("raw"), F.count("*").alias("lefts"))
    return out


def prune_thresholds(prune: Sequence[int], order: int) -> list[int]:
    """Thresholds by order: the last repeats, and none may be less than the one before."""
    t = list(prune) or [0]
    if len(t) > order:
        raise ValueError("more thresholds than orders")
    if any(x < 0 for x in t) or any(a > b for a, b in zip(t, t[1:])):
        raise ValueError("thresholds must not be negative or decrease")
    return t + [t[-1]] * (order - len(t))


def marked(counts: dict[int, DataFrame], prune: Sequence[int] = (0,), vocab: DataFrame | None = None) -> dict[int, DataFrame]:
    """The counts with ``pruned``: raw count at most the threshold, or a word outside ``vocab`` (word); special unigrams never."""
    limits = prune_thresholds(prune, max(counts))
    out = {}
    for n, rows in counts.items():
        mark = (F.col("raw") <= limits[n - 1]) if limits[n - 1] else F.lit(False)
        if vocab is not None:
            # n-grams with an unlisted word: their distinct words are few, so they decide first and join once
            words = rows.select("ngram", F.explode(F.split("ngram", " ")).alias("word")) if n > 1 else rows.select("ngram", F.col("ngram").alias("word"))
            listed = vocab.select("word").distinct()
            bad = words.where(~F.col("word").isin(*T.SPECIAL)).join(listed, "word", "left_anti").select("ngram").distinct().withColumn("bad", F.lit(True))
            rows = rows.join(bad, "ngram", "left")
            mark = mark | F.col("bad").isNotNull()
        if n == 1:
            mark = mark & ~F.col("ngram").isin(*T.SPECIAL)
        out[n] = rows.withColumn("pruned", mark).select("ngram", "adjusted", "raw", "pruned")
    return out


def count_of_counts(counts: dict[int, DataFrame]) -> DataFrame:
    """(order, n1, n2, n3, n4, total, kept): pruned entries count in n1 to n4 and the total."""
    rows = None
    for n, c in counts.items():
        k = c.select(F.lit(n).alias("order"), "adjusted", F.col("pruned") if "pruned" in c.columns else F.lit(False).alias("pruned"))
        rows = k if rows is None else rows.union(k)
    return rows.groupBy("order").agg(*[F.count(F.when(F.col("adjusted") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("total"), F.count(F.when(~F.col("pruned"), 1)).alias("kept"))


@dataclass
class DiscountConfig:
    """``fallback``: D1, D2, D3+ where the counts of counts give none (the last repeats); None raises. ``overwrite``: by order, in place of any estimate."""

    fallback: Sequence[float] | None = (0.5, 1.0, 1.5)
    overwrite: dict[int, Sequence[float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for d in [self.fallback or (), *self.overwrite.values()]:
            if any(not 0 <= x <= k for k, x in enumerate(d, 1)):
                raise ValueError("a discount must lie between 0 and the count that it is taken from")

    @staticmethod
    def filled(d: Sequence[float]) -> list[float]:
        d = list(d)
        return (d + [d[-1]] * 3)[:3]


def discounts(coc: DataFrame, config: DiscountConfig | None = None) -> DataFrame:
    """(order, d1, d2, d3) in closed form from the counts of counts, or else the fallback; lazily, so a failure raises when read."""
    config = config or DiscountConfig()
    n = [F.col(f"n{k}").cast("double") for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    some = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = [F.when(some, k - (k + 1) * y * n[k] / F.when(n[k - 1] > 0, n[k - 1])) for k in (1, 2, 3)]
    good = some
    for k, x in enumerate(d, 1):
        good = good & (x >= 0) & (x <= k)
    out = []
    for k in range(3):
        other = F.raise_error(F.concat(F.lit("BadDiscountError: the counts of counts of order "), F.col("order").cast("string"), F.lit(" give no discounts"))).cast("double") if config.fallback is None else F.lit(float(config.filled(config.fallback)[k]))
        x = F.when(good, d[k]).otherwise(other)
        for order, given in config.overwrite.items():
            x = F.when(F.col("order") == order, float(config.filled(given)[k])).otherwise(x)
        out.append(x.alias(f"d{k + 1}"))
    return coc.select("order", *out)
