"""Rest costs, quantisation and the sizes of binary layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.durable import cut
from quillspark.operators.model import Model
from quillspark.operators.skew import ranked


def rest_max(model: Model) -> DataFrame:
    """(order, ngram, log10_prob, rest): the greatest probability of the n-gram and of all that end with it."""
    if hasattr(model, "rests"):
        return model.rests()
    rows = {n: model.of(n).select("ngram", "log10_prob") for n in range(1, model.order + 1)}
    top = rows[model.order].withColumn("rest", F.col("log10_prob"))
    out = top.withColumn("order", F.lit(model.order))
    for n in range(model.order - 1, 0, -1):
        above = top.groupBy(T.suffix(F.col("ngram")).alias("ngram")).agg(F.max("rest").alias("above"))
        top = rows[n].join(above, "ngram", "left").select("ngram", "log10_prob", F.greatest("log10_prob", "above").alias("rest"))
        out = top.withColumn("order", F.lit(n)).unionByName(out)
    return out.select("order", "ngram", "log10_prob", "rest")


def rest_lower(model: Model, lower: Sequence[Model]) -> DataFrame:
    """(order, ngram, log10_prob, rest): the n-gram's score under ``lower[n - 1]``, the model of order n; its own at the highest order."""
    from quillspark.operators import score as S

    out = model.of(model.order).withColumn("rest", F.col("log10_prob")).select("order", "ngram", "log10_prob", "rest")
    for n in range(1, model.order):
        if lower[n - 1].order != n:
            raise ValueError(f"lower model {n - 1} has order {lower[n - 1].order}")
        own = model.of(n)
        s = S.score_windows(lower[n - 1], own.select(F.col("ngram").alias("window"))).select(F.col("window").alias("ngram"), F.col("log10_prob").alias("rest"))
        out = out.union(own.join(s, "ngram").select("order", "ngram", "log10_prob", "rest"))
    return out


def codebook(values: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, code, centre): bins of equal frequency, each the mean of its values; an empty one has the centre of the one before (-inf at first).

    Ranks come from counts of distinct values, sorted by range over all tasks.
    """
    if bins < 1:
        raise ValueError("at least one bin")
    d = values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    d = ranked(d, [*by, "v"], "before", "c")
    whole = d.groupBy(*by).agg(F.min("before").alias("start"), F.sum("c").alias("n"))
    d = (d.join(F.broadcast(whole), list(by)) if by else d.crossJoin(whole)).withColumn("first", F.col("before") - F.col("start")).withColumn("upto", F.col("first") + F.col("c"))
    # bin i holds the ranks floor(n i / bins) to floor(n (i + 1) / bins) - 1; a run of equal values may spread over several
    bin_of = lambda rank: F.expr(f"((({rank}) + 1) * {bins} + n - 1) div n - 1")
    d = d.withColumn("code", F.explode(F.sequence(bin_of("first"), bin_of("upto - 1"))))
    share = F.least(F.col("upto"), F.expr(f"n * (code + 1) div {bins}")) - F.greatest(F.col("first"), F.expr(f"n * code div {bins}"))
    g = d.withColumn("share", share).where("share > 0").groupBy(*by, "code").agg((F.sum(F.col("v") * F.col("share")) / F.sum("share")).alias("mean"))
    every = whole.select(*by).crossJoin(d.sparkSession.range(bins).select(F.col("id").alias("code")))
    full = every.join(g, [*by, "code"], "left")
    keep = Window.partitionBy(*by).orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*by, F.col("code").cast("int"), F.coalesce(F.last("mean", ignorenulls=True).over(keep), F.lit(float("-inf"))).alias("centre"))


def below(df: DataFrame, x: Column, array: str, most: int, name: str) -> DataFrame:
    """``df`` with the number of elements of an ascending array, of at most ``most``, that are under x, by halving."""
    df = df.withColumn("__x", F.struct(F.lit(0).alias("lo"), F.size(array).alias("hi")))
    for _ in range(max(1, most).bit_length()):
        mid = F.expr("(__x.lo + __x.hi) div 2").cast("int")
        open_ = F.col("__x.lo") < F.col("__x.hi")
        less = F.coalesce(F.get(array, mid) < x, F.lit(False))
        df = df.withColumn("__x", F.struct(F.when(open_ & less, mid + 1).otherwise(F.col("__x.lo")).alias("lo"), F.when(open_ & ~less, mid).otherwise(F.col("__x.hi")).alias("hi")))
    return df.withColumn(name, F.col("__x.lo")).drop("__x")


def encoded(values: DataFrame, column: str, book: DataFrame, by: Sequence[str] = (), cell: int = 1024) -> DataFrame:
    """``values`` with ``code`` and ``decoded``: the nearest centre, the upper one of two as near.

    A book is looked up in two steps: the first centres of its cells of ``cell`` codes, which are broadcast (of 2**25 centres 2**15), tell the cell; the cell's
    own centres and the next one come by a join on it. A book of one cell is broadcast whole.
    """
    book = cut(book.withColumn("__cell", F.expr(f"code div {cell}").cast("int")))
    most = book.agg(F.max("code")).first()[0]
    listed = lambda of: F.transform(F.sort_array(F.collect_list(of)), lambda x: x["centre"])
    cells = book.groupBy(*by, "__cell").agg(listed(F.struct("code", "centre")).alias("__own"))
    follow = book.where(f"code % {cell} = 0 and code > 0").select(*by, (F.col("__cell") - 1).alias("__cell"), F.array("centre").alias("__next"))
    cells = cells.join(follow, [*by, "__cell"], "left").select(*by, "__cell", F.concat("__own", F.coalesce("__next", F.array().cast("array<double>"))).alias("__c"))
    x = F.col(column)
    if most is None or most < cell:
        v = values.join(F.broadcast(cells), list(by)) if by else values.crossJoin(F.broadcast(cells))
    else:
        firsts = book.where(f"code % {cell} = 0").groupBy(*by).agg(listed(F.struct("code", "centre")).alias("__f"))
        v = values.join(F.broadcast(firsts), list(by)) if by else values.crossJoin(F.broadcast(firsts))
        v = below(v, x, "__f", most // cell + 1, "__n").withColumn("__cell", F.greatest(F.col("__n") - 1, F.lit(0))).drop("__f", "__n").join(cells, [*by, "__cell"])
    v = below(v, x, "__c", cell + 1, "__lo")
    up, down = F.least(F.col("__lo"), F.size("__c") - 1), F.greatest(F.col("__lo") - 1, F.lit(0))
    at = lambda i: F.get("__c", i)
    place = F.when(F.col("__lo") == 0, 0).when(F.col("__lo") >= F.size("__c"), F.size("__c") - 1).when(x - at(down) < at(up) - x, down).otherwise(up)
    v = v.withColumn("__p", place.cast("int"))
    return v.withColumn("code", (F.col("__cell") * cell + F.col("__p")).cast("int")).withColumn("decoded", at(F.col("__p"))).select(*values.columns, "code", "decoded")


def codebooks(model: Model, prob_bits: int, backoff_bits: int) -> tuple[DataFrame, DataFrame]:
    """Books (order, code, centre) for the orders above 1: 2**q centres of probabilities, and of back-offs two codes for zero and 2**b - 2 centres."""
    for bits in (prob_bits, backoff_bits):
        if not 1 < bits <= 25:
            raise ValueError("2 to 25 bits")
    rows = model.rows.where("order > 1")
    return codebook(rows, "log10_prob", 1 << prob_bits, ["order"]), codebook(rows.where(f"order < {model.order} and log10_backoff <> 0"), "log10_backoff", (1 << backoff_bits) - 2, ["order"])


def quantized(model: Model, prob_bits: int, backoff_bits: int) -> Model:
    """The model with quantised numbers above the first order; a back-off of 0 stays."""
    p, b = codebooks(model, prob_bits, backoff_bits)
    first = model.of(1)
    high = encoded(model.rows.where("order > 1"), "log10_prob", p, ["order"]).select("order", "ngram", F.col("decoded").alias("log10_prob"), "log10_backoff")
    zero = high.where(f"order = {model.order} or log10_backoff = 0")
    rest = encoded(high.where(f"order < {model.order} and log10_backoff <> 0"), "log10_backoff", b, ["order"]).select("order", "ngram", "log10_prob", F.col("decoded").alias("log10_backoff"))
    return Model(first.union(zero).union(rest), model.order)


def bits_for(most: int) -> int:
    """Bits that a number up to ``most`` needs."""
    return max(0, int(most).bit_length())


def sizes(counts: Sequence[int], prob_bits: int = 8, backoff_bits: int = 8, pointer_bits: int = 22, multiplier: float = 1.5) -> dict[str, int]:
    """Bytes of a model with the given numbers of n-grams, by order, in each of six layouts.

    Hash tables hold ``multiplier`` slots an entry (8 bytes of key, 4 a number); tries hold bit-packed records of word, numbers and the place
    where their extensions begin, which the array variants compress by leaving out ``pointer_bits`` leading bits at most, if that is smaller.
    """
    order = len(counts)
    if order < 2:
        raise ValueError("layouts need an order of at least 2")

    def table(n: int, entry: int) -> int:
        return max(n + 1, int(multiplier * n)) * entry

    def probing(unigram: int, middle: int) -> int:
        return table(counts[0], 12) + (counts[0] + 1) * unigram + sum(table(n, middle) for n in counts[1:-1]) + table(counts[-1], 12)

    def packed(n: int, bits: int) -> int:
        return ((n + 1) * bits + 7) // 8 + 8

    def trie(quant: bool, array: bool) -> int:
        word = bits_for(counts[0])
        p, b = (prob_bits, backoff_bits) if quant else (31, 32)
        total = (counts[0] + 2) * 16
        if quant:
            total += (order - 1) * (1 << prob_bits) * 4 + (order - 2) * (1 << backoff_bits) * 4 + 8
        for n, above in zip(counts[1:-1], counts[2:]):
            point = bits_for(above)
            extra = 0
            if array:
                best = min(range(min(pointer_bits, point) + 1), key=lambda k: (1 << k) * bits_for(n) // 8 + (n + 1) * (point - k) // 8)
                extra, point = ((1 << best) * bits_for(n) + 7) // 8 if best else 0, point - best
            total += packed(n, word + p + b + point) + extra
        return total + packed(counts[-1], word + p)

    return {"probing": probing(8, 16), "rest_probing": probing(12, 20), "trie": trie(False, False), "quant_trie": trie(True, False), "array_trie": trie(False, True), "quant_array_trie": trie(True, True)}


