"""Interpolated modified Kneser-Ney estimation.

The text is counted by parts (``parted``), whose counts are written once; the discounts, three numbers an order, come to the driver; entries are computed from
the parts' tables, the numbers of contexts and the probabilities of words wherever they are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import counts as C
from quillspark.operators import parted as P
from quillspark.operators.durable import stored
from quillspark.operators.model import Model


@dataclass
class Config:
    """Options of an estimate; ``limit_vocab`` is a DataFrame with a column ``word``."""

    order: int = 3
    interpolate_unigrams: bool = True
    skip_symbols: bool = True
    prune: Sequence[int] = (0,)
    limit_vocab: DataFrame | None = None
    discounts: C.DiscountConfig = field(default_factory=C.DiscountConfig)
    vocab_pad: int = 0
    collapse_values: bool = False

    def __post_init__(self) -> None:
        if self.order < 1:
            raise ValueError("the order must be at least 1")
        if self.vocab_pad and not self.interpolate_unigrams:
            raise ValueError("vocab_pad needs interpolate_unigrams")
        C.prune_thresholds(self.prune, self.order)


def log10(p: Column) -> Column:
    """Minus infinity for 0, which a discount may leave."""
    return F.when(p > 0, F.log10(p)).otherwise(F.lit(float("-inf")))


class Estimate:
    """The steps of one estimate, for whoever wants them apart."""

    def __init__(self, df: DataFrame, config: Config, column: str = "text"):
        self.config, self.order = config, config.order
        limits, vocab = C.prune_thresholds(config.prune, config.order), config.limit_vocab
        rows, codes, parts = P.written(df, self.order, limits, vocab, column, config.skip_symbols)
        told = P.words(rows, parts)
        words = P.words_of(told, self.order)
        mark = (F.col("raw") <= limits[0]) if limits[0] else F.lit(False)
        if vocab is not None:
            words = words.join(P.allowed(vocab), "word", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
            mark = mark | ~F.col("listed")
        else:
            words = words.withColumn("listed", F.lit(True))
        self.words = words.withColumn("pruned", mark & ~F.col("word").isin(*T.SPECIAL))
        if vocab is not None:
            self.words = stored(self.words)
        sums = [F.sum(x).alias(y) for x, y in zip(("lefts", "raw", "ends", "den", "lost", "c1"), C.COUNTS)]
        got = {r["code"]: tuple(r)[1:] for r in rows.where(F.col("kind") == P.STATS).groupBy("code").agg(*sums).collect()}
        got[1] = tuple(C.count_of_counts({1: self.words}).first())[1:]
        counts = [(n, *got.get(n, (0,) * 6)) for n in range(1, self.order + 1)]
        self.counts_of_counts = df.sparkSession.createDataFrame(counts, "order int, " + ", ".join(f"{x} bigint" for x in C.COUNTS))
        found = {r["order"]: r for r in C.discounts(self.counts_of_counts, config.discounts).collect()}
        self.kept = {n: x[-1] for n, *x in counts}
        self.discounts = {n: (r["d1"], r["d2"], r["d3"]) for n, r in found.items()}
        one = self.gamma(1).first()
        v = float(max(config.vocab_pad, self.kept[1] - 1))
        self.whole, self.left = float(one["den"] or 1), one["gamma"] if one["gamma"] is not None else 1.0
        self.share = self.left / v if config.interpolate_unigrams else 0.0
        self.entries = P.Entries(rows, told, codes, vocab, parts, self.order, limits, self.discounts, (self.whole, self.share))

    def _weight(self, n: int) -> Column:
        d1, d2, d3 = self.discounts[n]
        # numbers of kept rows by discount, so that the sum doesn't depend on the order of the rows
        return (F.lit(d1) * F.col("c1") + F.lit(d2) * F.col("c2") + F.lit(d3) * F.col("c3") + F.col("lost")) / F.col("den")

    def gamma(self, n: int) -> DataFrame:
        """(context, den, gamma) of one order, over all its rows: what is pruned leaves its mass to the lower order."""
        if n == 1:
            a, kept = F.col("adjusted"), ~F.col("pruned")
            of = [F.count(F.when(kept & (F.least(a, F.lit(3)) == k), 1)).alias(f"c{k}") for k in (1, 2, 3)]
            g = self.words.agg(F.sum("adjusted").alias("den"), F.sum(F.when(~kept, a).otherwise(0)).alias("lost"), *of).withColumn("context", F.lit(""))
        elif n == 2:
            g = self.words.where("den > 0").withColumnRenamed("word", "context")
        else:
            g = self.entries.gammas(n)
        return g.select("context", "den", self._weight(n).alias("gamma"))

    def unigrams(self) -> DataFrame:
        """(word, p, backoff, extends_left, starts) of all words; ``p`` is null for those pruned."""
        unk = self.share if self.config.interpolate_unigrams else self.left
        d1, d2, d3 = self.discounts[1]
        a, word = F.col("adjusted"), F.col("word")
        own = (a - F.when(a == 0, 0.0).when(a == 1, d1).when(a == 2, d2).otherwise(d3)) / F.lit(self.whole)
        p = F.when(word == T.BOS, 1.0).when(word == T.UNK, unk).otherwise(own + F.lit(self.share))
        ends = word.isin(T.UNK, T.EOS) | (F.col("den") == 0)
        backoff = F.lit(1.0) if self.order == 1 else F.when(ends, 1.0).otherwise(self._weight(2))
        return self.words.select("word", F.when(~F.col("pruned"), p).alias("p"), backoff.alias("backoff"), (F.col("ends") > 0).alias("extends_left"), (F.col("c1") + F.col("c2") + F.col("c3") > 0).alias("starts"))

    def first(self) -> DataFrame:
        """The unigrams that are kept, with the columns of the other entries."""
        return self.unigrams().where("p is not null").select(F.lit(1).alias("order"), F.col("word").alias("ngram"), "p", "backoff", F.lit(None).cast("double").alias("gamma"), "extends_left", "starts")

    def of(self, orders: Sequence[int], asked: DataFrame | None = None) -> DataFrame:
        """(order, ngram, p, backoff, gamma, extends_left, starts) of the entries of some orders, linear; of those ``asked`` (ngram) only, if given."""
        out = None
        if 1 in orders:
            out = self.first()
            if asked is not None:
                out = out.join(asked.where("instr(ngram, ' ') = 0").select("ngram"), "ngram", "left_semi").select(*out.columns)
        if high := [n for n in orders if n > 1]:
            x = self.entries.of(high, asked)
            out = x if out is None else out.union(x)
        return out

    def probabilities(self) -> dict[int, DataFrame]:
        """(ngram, p, backoff) of each order, linear; with ``gamma`` above the first."""
        return {n: self.of([n]).select("ngram", "p", "backoff", *(["gamma"] if n > 1 else [])) for n in range(1, self.order + 1)}

    def model(self) -> Model:
        if not self.config.collapse_values:
            return Estimated(self.logarithmic(self.of(range(1, self.order + 1))), self.order, self)
        every = stored(self.of(range(1, self.order + 1)))
        rows = None
        for n, x in collapsed({n: every.where(F.col("order") == n) for n in range(1, self.order + 1)}).items():
            x = x.select(F.lit(n).alias("order"), "ngram", log10(F.col("p")).alias("log10_prob"), (log10(F.col("backoff")) if n < self.order else F.lit(None).cast("double")).alias("log10_backoff"))
            rows = x if rows is None else rows.union(x)
        return Model(rows, self.order)

    def logarithmic(self, entries: DataFrame, *more: str | Column) -> DataFrame:
        """Entries as a model's rows."""
        back = F.when(F.col("order") < self.order, log10(F.col("backoff"))).alias("log10_backoff")
        return entries.select("order", "ngram", F.least(F.lit(0.0), log10(F.col("p"))).alias("log10_prob"), back, *more)


@dataclass
class Estimated(Model):
    """A model that is computed from its counts where it is read: what is asked of some orders or some n-grams is computed for these."""

    estimate: Estimate

    def of(self, n: int) -> DataFrame:
        return self.estimate.logarithmic(self.estimate.of([n]))

    def counts(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([(n, k) for n, k in sorted(self.estimate.kept.items()) if k], "order int, n bigint")

    def vocabulary(self) -> DataFrame:
        return self.estimate.first().select(F.col("ngram").alias("word"))

    def with_unk(self, log10_prob: float = -100.0) -> Model:
        return self

    def split(self) -> tuple[DataFrame, DataFrame]:
        low = self.estimate.logarithmic(self.estimate.of(range(1, self.order))) if self.order > 1 else self.rows.where("false")
        return self.rows.select("order", "ngram", "log10_prob"), low.select("order", "ngram", "log10_backoff")

    def _flagged(self, entries: DataFrame) -> DataFrame:
        below = F.col("order") < self.order
        x = self.estimate.logarithmic(entries, "extends_left", "starts").withColumn("log10_backoff", F.coalesce("log10_backoff", F.lit(0.0)))
        return x.select("order", "ngram", "log10_prob", "log10_backoff", F.lit(False).alias("blank"), (below & F.col("extends_left")).alias("extends_left"), (below & (F.col("starts") | (F.col("log10_backoff") != 0))).alias("has_extension"))

    def closed(self) -> DataFrame:
        """All its entries: it has every suffix of an entry, as thresholds don't fall and words are limited for all orders alike."""
        return self._flagged(self.estimate.of(range(1, self.order + 1)))

    def looked_up(self, asked: DataFrame) -> DataFrame:
        """``score.facts`` of n-grams (ngram, distinct); longer ones are sent to their parts, so the model itself isn't shuffled."""
        return self._flagged(self.estimate.of(range(1, self.order + 1), asked)).drop("order", "blank")

    def rests(self) -> DataFrame:
        """``compact.rest_max`` of the model."""
        e, log = self.estimate, lambda p: F.least(F.lit(0.0), log10(p))
        first = e.first()
        if self.order == 1:
            return first.select("order", "ngram", log(F.col("p")).alias("log10_prob"), log(F.col("p")).alias("rest"))
        above = e.entries.rests([1]).groupBy("ngram").agg(F.max("rest").alias("above"))
        first = first.join(above, "ngram", "left").select("order", "ngram", "p", F.greatest("p", "above").alias("rest"))
        return first.union(e.entries.rests(range(2, self.order + 1))).select("order", "ngram", log(F.col("p")).alias("log10_prob"), log(F.col("rest")).alias("rest"))


def collapsed(p: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """q(g) = p(g) delta(g), delta(g) = delta(suffix) / gamma(context) * backoff(g): back-offs folded into the probabilities."""
    out, delta = {}, None
    for n in sorted(p):
        rows = p[n]
        if n == 1:
            rows = rows.withColumn("delta", F.col("backoff"))
        else:
            rows = rows.withColumn("low", T.suffix(F.col("ngram"))).join(delta, "low").withColumn("delta", F.col("delta_low") / F.col("gamma") * F.col("backoff"))
        delta = rows.select(F.col("ngram").alias("low"), F.col("delta").alias("delta_low"))
        out[n] = rows.select("ngram", (F.col("p") * F.col("delta")).alias("p"), F.lit(1.0).alias("backoff"))
    return out


def prepared(df: DataFrame, config: Config | None = None, column: str = "text", **options) -> Estimate:
    """The estimate of the lines of a text column."""
    return Estimate(df, config or Config(**options), column)


def estimate(df: DataFrame, config: Config | None = None, column: str = "text", **options) -> Model:
    """The model of the lines of a text column."""
    return prepared(df, config, column, **options).model()
