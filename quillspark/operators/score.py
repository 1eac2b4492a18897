"""Scoring: log10 probability and longest match of every word, sentence totals, perplexities.

A word's score depends on its last order - 1 words only, so there is no scan with a state: every window (history, word) is looked up. Distinct
windows are scored once: each asks for its suffixes (as entries) and its history's suffixes (as back-offs). Only what is asked for is taken from the model, by one pass over its
entries, which tells in the same step what longer entries begin or end with it; so the model isn't closed to score a text that asks for little of it. Few words and keys are met
by broadcasts that Spark chooses by their size; unigrams, which many windows ask for, are spread by a salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.counts import spread
from quillspark.operators.durable import cut, stored
from quillspark.operators.model import Model
from quillspark.operators.skew import attached

#: Parts in which the windows that ask for one unigram are spread.
SALTS = 16


def lines_of(df: DataFrame, column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(``keep``, line number, words) of a text column, tokenised as queries are."""
    d = spread(df.select(*keep, column).where(F.col(column).isNotNull()))
    return d.select(*keep, F.posexplode(T.lines(F.col(column))).alias("line", "value")).select(*keep, "line", T.query_words(F.col("value")).alias("words"))


def windows(model: Model, lines: DataFrame, keys: Sequence[str], bos: bool = True, eos: bool = True) -> DataFrame:
    """(``keys``, pos, word, oov, window) of every word; a window is the history, as far as it matters, and the word.

    Words that the model doesn't have are <unk>, in histories too. Which they are is found from the distinct words; only those unknown are joined with the text.
    """
    words = F.concat(F.col("words"), F.array(F.lit(T.EOS))) if eos else F.col("words")
    t = stored(lines.select(*keys, F.posexplode(words).alias("pos", "word")))
    seen = t.select("word").distinct()
    # <unk> in the text is no word of the vocabulary
    unknown = seen.join(model.vocabulary().where(F.col("word") != T.UNK).distinct(), "word", "left_anti").withColumn("oov", F.lit(True))
    t = attached(t, cut(unknown), "word").withColumn("oov", F.coalesce("oov", F.lit(False))).withColumn("w", F.when(F.col("oov"), T.UNK).otherwise(F.col("word")))
    w = Window.partitionBy(*keys).orderBy("pos")
    back = []
    for k in range(model.order - 1, 0, -1):
        before = F.lag("w", k).over(w)
        if bos:
            before = F.when(F.col("pos") == k - 1, T.BOS).otherwise(before)
        back.append(before)
    return t.withColumn("window", F.concat_ws(" ", *back, F.col("w"))).select(*keys, "pos", "word", "oov", "window")


def facts(model: Model, asked: DataFrame | None = None) -> DataFrame:
    """(ngram, log10_prob, log10_backoff, extends_left, has_extension) of the keys ``asked`` (ngram, distinct; all by default) that the closed model has.

    A key is in the closed model if it is an entry or ends a longer one; then it is a blank, whose probability is null here. ``extends_left``: a longer entry ends with
    it. ``has_extension``: its back-off is not 0, or it stands before the last word of an entry.
    """
    if asked is not None and hasattr(model, "looked_up"):
        return model.looked_up(stored(asked))
    n = F.col("order")
    none = F.lit(None).cast("double")

    def says(key, prob, backoff, ends: bool, starts: bool):  # type: ignore[no-untyped-def]
        return F.struct(key.alias("ngram"), prob.alias("p"), backoff.alias("b"), F.lit(ends).alias("ends"), F.lit(starts).alias("starts"))

    each = [says(F.col("ngram"), F.col("log10_prob"), F.coalesce("log10_backoff", F.lit(0.0)), False, False)]
    for k in range(1, model.order):
        each.append(says(F.when(n > k, F.substring_index("ngram", " ", -k)), none, none, True, False))
        each.append(says(F.when(n > k, F.expr(f"substring_index(substring_index(ngram, ' ', order - 1), ' ', -{k})")), none, none, False, True))
    x = model.rows.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("ngram is not null")
    if asked is not None:
        x = x.join(asked, "ngram", "left_semi")
    g = x.groupBy("ngram").agg(F.max("p").alias("log10_prob"), F.coalesce(F.max("b"), F.lit(0.0)).alias("log10_backoff"), F.max("ends").alias("extends_left"), F.max("starts").alias("starts"))
    # what only stands before last words is in the closed model through a longer entry's beginning, not its end: no key
    return g.where("log10_prob is not null or extends_left").select("ngram", "log10_prob", "log10_backoff", "extends_left", (F.col("starts") | (F.col("log10_backoff") != 0)).alias("has_extension"))


def score_windows(model: Model, distinct: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """(window, ngram_length, log10_prob, independent_left, state_length) of distinct windows. ``ready``: the model's ``facts``, if they are at hand."""
    order = model.order
    n = F.size(F.split("window", " "))
    d = distinct.select("window", n.alias("n"))
    ask = lambda key, k, back: F.struct(key.alias("ngram"), F.lit(k).alias("k"), F.lit(back).alias("back"))
    tails = [ask(F.when(F.col("n") >= k, F.substring_index("window", " ", -k)), k, False) for k in range(1, order + 1)]
    backs = [ask(F.when(F.col("n") > k, F.expr(f"substring_index(substring_index(window, ' ', n - 1), ' ', -{k})")), k, True) for k in range(1, order)]
    asked = d.select("window", "n", F.explode(F.array(*tails, *backs)).alias("x")).select("window", "n", "x.*").where("ngram is not null")
    known = stored(facts(model, asked.select("ngram").distinct())) if ready is None else ready
    # what few windows ask for needs no salt; unigrams are there in each part
    salt = F.when(F.instr("ngram", " ") == 0, F.pmod(F.xxhash64("window"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.instr("ngram", " ") == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = asked.withColumn("salt", salt).join(known.withColumn("salt", F.explode(every)), ["ngram", "salt"])
    g = found.groupBy("window").agg(
        F.first("n").alias("n"),
        F.max(F.when(~F.col("back"), F.struct("k", "extends_left"))).alias("best"),
        F.max(F.when(~F.col("back") & F.col("log10_prob").isNotNull(), F.struct("k", "log10_prob"))).alias("entry"),
        F.max(F.when(~F.col("back") & F.col("has_extension") & (F.col("k") < order), F.col("k"))).alias("state"),
        F.sort_array(F.collect_list(F.when(F.col("back"), F.struct("k", "log10_backoff")))).alias("backs"),
    )
    # what is backed off from: contexts at least as long as the entry, in order of their length so that sums are the same everywhere
    paid = F.aggregate("backs", F.lit(0.0), lambda a, x: a + F.when(x["k"] >= F.col("entry.k"), x["log10_backoff"]).otherwise(0.0))
    return g.select(
        "window",
        F.col("best.k").alias("ngram_length"),
        (F.col("entry.log10_prob") + paid).alias("log10_prob"),
        (~F.col("best.extends_left") | (F.col("n") > F.col("best.k")) | (F.col("best.k") == order)).alias("independent_left"),
        F.coalesce("state", F.lit(0)).alias("state_length"),
    )


def ready_for(model: Model, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``facts`` that any part of some lines (``keys``, words) asks for, written once; the model must have <unk>."""
    w = windows(model, lines, keys, bos=False, eos=False).select("window").distinct()
    tails = F.array(*[F.when(F.size(F.split("window", " ")) >= k, F.substring_index("window", " ", -k)) for k in range(1, model.order + 1)])
    return stored(facts(model, w.select(F.explode(tails).alias("ngram")).where("ngram is not null").distinct()))


def words(model: Model, lines: DataFrame, keys: Sequence[str], bos: bool = True, eos: bool = True, unknown: float = -100.0, ready: DataFrame | None = None) -> DataFrame:
    """(``keys``, pos, word, oov, ngram_length, log10_prob, independent_left, state_length) of every word.

    ``ready``: the ``facts`` of ``model``, which then has <unk> and is cheap to read.
    """
    if ready is None and not hasattr(model, "looked_up"):
        model = Model(cut(model.with_unk(unknown).rows), model.order)
    w = stored(windows(model, lines, keys, bos, eos))
    s = score_windows(model, w.select("window").distinct(), ready)
    return w.join(s, "window").drop("window")


def sentences(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(``keys``, tokens, oov, log10_prob, log10_oov, perplexity) of every line."""
    g = scored.groupBy(*keys).agg(F.count("*").alias("tokens"), F.count(F.when(F.col("oov"), 1)).alias("oov"), F.sum("log10_prob").alias("log10_prob"), F.sum(F.when(F.col("oov"), F.col("log10_prob")).otherwise(0.0)).alias("log10_oov"))
    return g.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("tokens")))


def summary(scored: DataFrame) -> DataFrame:
    """One row: tokens, oov, log10_prob, perplexity with and without what is out of the vocabulary."""
    g = scored.agg(F.count("*").alias("tokens"), F.count(F.when(F.col("oov"), 1)).alias("oov"), F.sum("log10_prob").alias("log10_prob"), F.sum(F.when(F.col("oov"), F.col("log10_prob")).otherwise(0.0)).alias("log10_oov"))
    return g.select(
        "tokens",
        "oov",
        "log10_prob",
        F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -(F.col("log10_prob") - F.col("log10_oov")) / F.when(F.col("tokens") > F.col("oov"), F.col("tokens") - F.col("oov"))).alias("perplexity_excl_oov"),
    )


def printed(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(``keys``, value): each line as a query tool prints it, its words with their scores, and the total.

    A part is the word, the length of its match and its log10 probability, separated by a space; parts are separated by TABs; the line ends with ``Total: p OOV: n``.
    """
    part = F.struct("pos", F.concat_ws(" ", "word", F.col("ngram_length").cast("string"), F.round("log10_prob", 6).cast("string")).alias("s"))
    g = scored.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("x"), F.sum("log10_prob").alias("total"), F.count(F.when(F.col("oov"), 1)).alias("oov"))
    return g.select(*keys, F.concat(F.array_join(F.transform("x", lambda x: x["s"]), "\t"), F.lit("\tTotal: "), F.round("total", 6).cast("string"), F.lit(" OOV: "), F.col("oov").cast("string")).alias("value"))
