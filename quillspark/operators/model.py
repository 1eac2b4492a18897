"""A back-off model: a DataFrame (order, ngram, log10_prob, log10_backoff), checks, closure and flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

SCHEMA = "order int, ngram string, log10_prob double, log10_backoff double"


class FormatError(ValueError):
    """A model that breaks a rule of its format."""


class VocabularyError(FormatError):
    """An n-gram with words or contexts that the model doesn't have."""


class SpecialWordMissingError(VocabularyError):
    """<s> or </s> is not among the unigrams."""


@dataclass
class Model:
    """``rows`` has the columns of ``SCHEMA``; the highest order has null back-offs."""

    rows: DataFrame
    order: int

    def of(self, n: int) -> DataFrame:
        return self.rows.where(F.col("order") == n)

    def counts(self) -> DataFrame:
        """(order, n) entries."""
        return self.rows.groupBy("order").agg(F.count("*").alias("n"))

    def vocabulary(self) -> DataFrame:
        """(word) of the unigrams."""
        return self.of(1).select(F.col("ngram").alias("word"))

    def with_unk(self, log10_prob: float = -100.0) -> Model:
        """The model with <unk>; one without gets it with the given probability and back-off 0. <UNK> is the same word."""
        rows = self.rows.withColumn("ngram", F.when((F.col("order") == 1) & (F.col("ngram") == "<UNK>"), T.UNK).otherwise(F.col("ngram")))
        have = rows.where((F.col("order") == 1) & (F.col("ngram") == T.UNK)).select(F.lit(1).alias("x")).limit(1)
        one = self.rows.sparkSession.createDataFrame([(1, T.UNK, log10_prob, 0.0 if self.order > 1 else None)], SCHEMA)
        return Model(rows.union(one.join(have, how="left_anti")), self.order)

    def checked(self, positive: str = "raise", markers: str = "raise") -> Model:
        """The model after its rules are checked (this runs them): contexts exist, numbers are finite, no n-gram comes twice, <s> and </s> are there.

        ``positive``: what is done about log-probabilities over 0: raise, or clamp them to 0. ``markers``: raise or ignore.
        """
        bad = self.rows.where(F.col("log10_prob").isNull() | F.isnan("log10_prob") | F.isnan("log10_backoff") | (F.abs("log10_backoff") == float("inf")))
        if not bad.isEmpty():
            raise FormatError(f"not a number: {bad.first()}")
        if positive == "raise" and not (over := self.rows.where("log10_prob > 0")).isEmpty():
            raise FormatError(f"a probability over 1: {over.first()}")
        if not (twice := self.rows.groupBy("ngram").count().where("count > 1")).isEmpty():
            raise FormatError(f"an n-gram that comes twice: {twice.first()['ngram']}")
        if not (top := self.of(self.order).where("log10_backoff <> 0")).isEmpty():
            raise FormatError(f"a back-off in the highest order: {top.first()['ngram']}")
        if markers == "raise" and self.of(1).where(F.col("ngram").isin(T.BOS, T.EOS)).count() < 2:
            raise SpecialWordMissingError("<s> or </s> is missing")
        for n in range(2, self.order + 1):
            lost = self.of(n).select("ngram", T.context(F.col("ngram"), n).alias("c")).join(self.of(n - 1).select(F.col("ngram").alias("c")), "c", "left_anti")
            if not lost.isEmpty():
                raise VocabularyError(f"its context is no entry: {lost.first()['ngram']}")
        words = self.rows.where("order > 1").select(F.explode(F.split("ngram", " ")).alias("word")).distinct().join(self.vocabulary(), "word", "left_anti")
        if not words.isEmpty():
            raise VocabularyError(f"no unigram: {words.first()['word']}")
        return Model(self.rows.withColumn("log10_prob", F.least(F.col("log10_prob"), F.lit(0.0))), self.order) if positive == "clamp" else self

    def closed(self) -> DataFrame:
        """All entries and blanks: (order, ngram, log10_prob, log10_backoff, blank, extends_left, has_extension).

        Every suffix of an entry is present; one that was not stored is a blank, with its back-off score and no back-off. ``extends_left``:
        a longer entry ends with it. ``has_extension``: its back-off is not 0, or a longer entry begins with it.
        """
        keys = {n: self.of(n).select("ngram") for n in range(1, self.order + 1)}
        missing: dict[int, DataFrame] = {}
        for n in range(self.order - 1, 1, -1):
            ends = keys[n + 1].select(T.suffix(F.col("ngram")).alias("ngram")).distinct()
            missing[n] = ends.join(keys[n], "ngram", "left_anti")
            keys[n] = keys[n].union(missing[n])
        rows = {n: self.of(n).select("ngram", "log10_prob", F.coalesce("log10_backoff", F.lit(0.0)).alias("log10_backoff"), F.lit(False).alias("blank")) for n in range(1, self.order + 1)}
        for n in range(2, self.order):
            low = rows[n - 1].select(F.col("ngram").alias("low"), F.col("log10_prob").alias("p"))
            b = rows[n - 1].select(F.col("ngram").alias("c"), F.col("log10_backoff").alias("b"))
            blanks = missing[n].withColumn("low", T.suffix(F.col("ngram"))).withColumn("c", T.context(F.col("ngram"), n)).join(low, "low").join(b, "c", "left")
            rows[n] = rows[n].union(blanks.select("ngram", (F.col("p") + F.coalesce("b", F.lit(0.0))).alias("log10_prob"), F.lit(0.0), F.lit(True)))
        out = None
        for n in range(1, self.order + 1):
            x = rows[n].withColumn("order", F.lit(n))
            if n < self.order:
                ends = rows[n + 1].select(T.suffix(F.col("ngram")).alias("ngram")).distinct().withColumn("extends_left", F.lit(True))
                starts = rows[n + 1].select(T.context(F.col("ngram"), n + 1).alias("ngram")).distinct().withColumn("starts", F.lit(True))
                x = x.join(ends, "ngram", "left").join(starts, "ngram", "left")
                x = x.select("order", "ngram", "log10_prob", "log10_backoff", "blank", F.coalesce("extends_left", F.lit(False)).alias("extends_left"), (F.coalesce("starts", F.lit(False)) | (F.col("log10_backoff") != 0)).alias("has_extension"))
            else:
                x = x.select("order", "ngram", "log10_prob", "log10_backoff", "blank", F.lit(False).alias("extends_left"), F.lit(False).alias("has_extension"))
            out = x if out is None else out.union(x)
        return out

    def split(self) -> tuple[DataFrame, DataFrame]:
        """(ngram, log10_prob) and (ngram, log10_backoff), apart."""
        return self.rows.select("order", "ngram", "log10_prob"), self.rows.where(F.col("order") < self.order).select("order", "ngram", "log10_backoff")

    def renumbered(self) -> DataFrame:
        """(word, id): <unk> 0, <s> 1, </s> 2, then the rank of a stable 64-bit hash of the word, then the word."""
        from pyspark.sql import Window

        v = self.vocabulary().where(~F.col("word").isin(*T.SPECIAL)).withColumn("h", F.xxhash64("word"))
        # ranks by the leading byte of the hash: 256 windows with the counts of those before them
        v = v.withColumn("b", F.shiftright("h", 56))
        base = v.groupBy("b").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "base")
        ranked = v.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h", "word"))).join(F.broadcast(base), "b")
        special = v.sparkSession.createDataFrame([(T.UNK, 0), (T.BOS, 1), (T.EOS, 2)], "word string, id bigint")
        return special.union(ranked.select("word", (F.col("base") + F.col("r") + 2).cast("bigint")))


def reunified(probs: DataFrame, backoffs: DataFrame) -> DataFrame:
    """Probabilities with their back-offs, one to one; raises when read if one has no other."""
    b = backoffs.select(F.col("order").alias("order_"), F.col("ngram").alias("ngram_"), "log10_backoff", F.lit(True).alias("has_b"))
    p = probs.select("order", "ngram", "log10_prob", F.lit(True).alias("has_p"))
    both = p.join(b, F.col("ngram") == F.col("ngram_"), "full_outer")
    ok = F.col("has_p").isNotNull() & F.col("has_b").isNotNull()
    return both.select("order", "ngram", F.when(ok, F.col("log10_prob")).otherwise(F.raise_error(F.lit("back-offs and probabilities don't match")).cast("double")).alias("log10_prob"), "log10_backoff")
