"""Filters of n-grams by vocabularies and phrases, and target vocabularies from phrase tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.durable import cut
from quillspark.operators.skew import attached

MODES = ("copy", "single", "multiple", "union")


def check(mode: str, phrase: bool = False) -> None:
    """Raise unless the options go together."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if phrase and mode not in ("multiple", "union"):
        raise ValueError("phrases need the mode multiple or union")


def tested(g: str = "ngram", context: bool = False):  # type: ignore[no-untyped-def]
    """The words that decide: all, or all but the last with ``context``."""
    w = T.space_words(F.col(g))
    return F.when(F.size(w) > 0, F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w) if context else w


def sentence_vocabulary(lines: DataFrame, column: str = "words") -> DataFrame:
    """(sentence, word): sentences numbered from 0 in the order of ``line_no``, those without words left out."""
    from pyspark.sql import Window

    full = lines.where(F.size(column) > 0)
    # numbers by partial counts: lines in ranges of 65536, each starting at the sum of those before
    block = F.shiftright(F.col("line_no"), 16)
    per = full.groupBy(block.alias("b")).count()
    base = per.withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "base")
    at = full.withColumn("b", block).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("line_no")) - 1).join(base, "b")
    return at.select((F.col("base") + F.col("r")).alias("sentence"), F.explode(column).alias("word")).distinct()


def single(ngrams: DataFrame, vocab: DataFrame, context: bool = False) -> DataFrame:
    """N-grams whose words are all in ``vocab`` (word), tags aside."""
    words = ngrams.select("ngram", F.explode(tested(context=context)).alias("word")).where(~T.is_tag(F.col("word")))
    bad = words.join(vocab.select("word").distinct(), "word", "left_anti").select("ngram").distinct()
    return ngrams.join(bad, "ngram", "left_anti")


def pairs(ngrams: DataFrame, vocab: DataFrame, context: bool = False, hot: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """((sentence, ngram) of n-grams with words other than tags that a sentence has all of, (ngram) of those that are tags alone).

    An n-gram meets the sentences that have its rarest word, and only there are its other words looked up, among the sentence's own.
    """
    grams = cut(ngrams.select("ngram", F.array_distinct(F.filter(tested(context=context), lambda w: ~T.is_tag(w))).alias("ws")).distinct())
    vocab = cut(vocab.select("sentence", "word").distinct())
    often = vocab.groupBy("word").agg(F.count("*").alias("often"))
    some = attached(grams.where(F.size("ws") > 0).select("ngram", "ws", F.explode("ws").alias("word")), often, "word", hot)
    # a word that no sentence has settles it
    rare = some.groupBy("ngram").agg(F.first("ws").alias("ws"), F.min(F.struct("often", "word")).alias("rare"), F.count("*").alias("n"), F.count("often").alias("known")).where("n = known")
    met = rare.select("ngram", "ws", F.col("rare.word").alias("word")).join(vocab, "word")
    whole = vocab.groupBy("sentence").agg(F.collect_set("word").alias("have"))
    good = met.where(F.size("ws") == 1).select("sentence", "ngram").union(met.where(F.size("ws") > 1).join(whole, "sentence").where(F.size(F.array_except("ws", "have")) == 0).select("sentence", "ngram"))
    return good, grams.where(F.size("ws") == 0).select("ngram")


def multiple(ngrams: DataFrame, vocab: DataFrame, context: bool = False) -> DataFrame:
    """(sentence, ngram ...) for every sentence of ``vocab`` (sentence, word) that has all words of the n-gram, tags aside.

    N-grams of tags alone belong to every sentence.
    """
    good, tags = pairs(ngrams, vocab, context)
    return good.union(tags.crossJoin(vocab.select("sentence").distinct()).select("sentence", "ngram")).join(ngrams, "ngram")


def union(ngrams: DataFrame, vocab: DataFrame, context: bool = False) -> DataFrame:
    """N-grams that some one sentence has all words of, tags aside."""
    good, tags = pairs(ngrams, vocab, context)
    return ngrams.join(good.select("ngram").union(tags).distinct(), "ngram", "left_semi")


def phrase_index(phrases: DataFrame) -> DataFrame:
    """(sentence, part, kind) of ``phrases`` (sentence, words): kinds are sub, head, tail and whole."""
    n = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.struct(F.array_join(F.slice("words", i, j - i + 1), " ").alias("part"), (i == 1).alias("h"), (j == n).alias("t")))))
    s = phrases.where(n > 0).select("sentence", F.explode(spans).alias("x")).select("sentence", "x.*")
    kinds = F.array_compact(F.array(F.lit("sub"), F.when(F.col("h"), "head"), F.when(F.col("t"), "tail"), F.when(F.col("h") & F.col("t"), "whole")))
    return s.select("sentence", "part", F.explode(kinds).alias("kind")).distinct()


def phrase_pairs(ngrams: DataFrame, index: DataFrame, sentences: DataFrame, longest: int, context: bool = False) -> DataFrame:
    """(sentence, ngram) where the n-gram can be made of the sentence's phrases.

    It is part of one phrase, or the end of a phrase, whole phrases, and the beginning of a phrase, one after the other. A leading tag and
    whatever follows </s> are not looked at; n-grams of which nothing is left belong to all ``sentences`` (sentence). ``longest``: words of the longest n-gram.
    """
    w = tested(context=context)
    w = F.when((F.size(w) > 0) & T.is_tag(F.get(w, F.lit(0))), F.slice(w, F.lit(2), F.size(w))).otherwise(w)
    end = F.array_position(w, T.EOS)
    w = F.when(end > 0, F.slice(w, F.lit(1), (end - 1).cast("int"))).otherwise(w)
    g = ngrams.select("ngram", w.alias("ws")).distinct().withColumn("n", F.size("ws"))
    some = g.where("n > 0")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.transform(F.sequence(i, F.col("n")), lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice("ws", i, j - i + 1), " ").alias("part")))))
    hit = some.select("ngram", "n", F.explode(spans).alias("x")).select("ngram", "n", "x.*").join(index, "part")
    # which role a part can play depends on its place
    role = (
        F.when((F.col("kind") == "sub") & (F.col("i") == 1) & (F.col("j") == F.col("n")), "all")
        .when((F.col("kind") == "tail") & (F.col("i") == 1) & (F.col("j") < F.col("n")), "tail")
        .when((F.col("kind") == "whole") & (F.col("i") > 1) & (F.col("j") < F.col("n")), "whole")
        .when((F.col("kind") == "head") & (F.col("i") > 1) & (F.col("j") == F.col("n")), "head")
    )
    hit = hit.withColumn("role", role).where("role is not null")
    per = hit.groupBy("sentence", "ngram").agg(
        F.max(F.col("role") == "all").alias("all_"),
        F.collect_set(F.when(F.col("role") == "tail", F.col("j"))).alias("reach"),
        F.collect_set(F.when(F.col("role") == "whole", F.struct("i", "j"))).alias("wholes"),
        F.collect_set(F.when(F.col("role") == "head", F.col("i"))).alias("heads"),
    )
    reach = F.col("reach")
    for _ in range(max(0, longest - 2)):  # ends that can be reached by one more whole phrase
        per = per.withColumn("reach", F.array_union(reach, F.transform(F.filter("wholes", lambda x: F.array_contains(F.col("reach"), x["i"] - 1)), lambda x: x["j"])))
        reach = F.col("reach")
    good = per.where(F.col("all_") | F.exists("heads", lambda i: F.array_contains(F.col("reach"), i - 1))).select("sentence", "ngram")
    return good.union(g.where("n = 0").select("ngram").crossJoin(sentences.select("sentence").distinct()).select("sentence", "ngram"))


def phrase_multiple(ngrams: DataFrame, phrases: DataFrame, longest: int, context: bool = False) -> DataFrame:
    """(sentence, ngram ...) for every sentence whose phrases make the n-gram."""
    return phrase_pairs(ngrams, phrase_index(phrases), phrases, longest, context).join(ngrams, "ngram")


def phrase_union(ngrams: DataFrame, phrases: DataFrame, longest: int, context: bool = False) -> DataFrame:
    """N-grams that the phrases of some one sentence make."""
    return ngrams.join(phrase_pairs(ngrams, phrase_index(phrases), phrases, longest, context).select("ngram").distinct(), "ngram", "left_semi")


def phrase_table_vocabulary(sentences: DataFrame, table: DataFrame, longest: int = 7) -> DataFrame:
    """(sentence, word): the target words of all table entries whose source is part of the sentence, and the sentence's own words.

    ``sentences`` (sentence, words), ``table`` (source, target); sources of more than ``longest`` words are never met.
    """
    n = F.size("words")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(n, i + (longest - 1))), lambda j: F.array_join(F.slice("words", i, j - i + 1), " "))))
    asked = sentences.where(n > 0).select("sentence", F.explode(F.array_distinct(parts)).alias("source"))
    hit = asked.join(table.select("source", "target").distinct(), "source").select("sentence", F.explode(T.space_words(F.col("target"))).alias("word"))
    return hit.union(sentences.select("sentence", F.explode("words").alias("word"))).distinct()
