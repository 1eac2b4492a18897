"""Weights of an interpolation, tuned on text: perplexity, gradient and Hessian by aggregation, Newton steps on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import interpolate as I
from quillspark.operators import score as S
from quillspark.operators.durable import stored
from quillspark.operators.model import Model


def instances(models: Sequence[Model], lines: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((instance, n, context, ln_0, ...), (word, u_0, ...)): each distinct context with its number of tokens and their summed log probabilities; unigrams.

    The tuning text must not have the special words. Natural logarithms.
    """
    order = max(m.order for m in models)
    vocab = I.vocabulary(models).withColumn("known", F.lit(True))
    bad = lines.select(F.explode("words").alias("w")).where(F.col("w").isin(T.BOS, T.EOS))
    if not bad.isEmpty():
        raise ValueError("<s> or </s> in the tuning text")
    union = Model(vocab.select(F.lit(1).alias("order"), F.col("word").alias("ngram"), F.lit(0.0).alias("log10_prob"), F.lit(0.0).alias("log10_backoff")), order)
    w = S.windows(union, lines, keys)
    n = F.size(F.split("window", " "))
    w = w.select(T.last(F.col("window")).alias("word"), F.when(n > 1, F.expr("substring_index(window, ' ', size(split(window, ' ')) - 1)")).otherwise("").alias("context"))
    return w.groupBy("context", "word").agg(F.count("*").alias("n")), vocab


def tables(models: Sequence[Model], lines: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """What the derivatives are sums over, written once:

    ``unigrams`` (word, u_m); ``contexts`` (context, n, b_m: the whole back-off to unigrams); ``extensions`` (context, word, x_m: the log-probability
    of words that some model has an n-gram for, longer than one, after the context); ``correct`` (context, n, c_m: summed log-probabilities of what did come).
    """
    k_ = range(len(models))
    seen, vocab = instances(models, lines, keys)
    seen = stored(seen)
    ln = float(np.log(10))
    closed = [stored(m.closed().select("order", "ngram", "log10_prob", "log10_backoff")) for m in models]
    uni = vocab.select("word")
    for k, c in enumerate(closed):
        own = c.where("order = 1").select(F.col("ngram").alias("word"), (F.col("log10_prob") * ln).alias(f"u_{k}"))
        unk = c.where((F.col("order") == 1) & (F.col("ngram") == T.UNK)).select((F.col("log10_prob") * ln).alias("unk"))
        uni = uni.join(own, "word", "left").crossJoin(F.broadcast(unk)).withColumn(f"u_{k}", F.coalesce(f"u_{k}", "unk")).drop("unk")
    uni = stored(uni)
    ctx = seen.groupBy("context").agg(F.sum("n").alias("n"))
    words = F.split("context", " ")
    order = max(m.order for m in models)
    tails = ctx.where("context <> ''").select("context", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda s: F.struct(s.alias("size"), F.array_join(F.slice(words, F.size(words) - s + 1, s), " ").alias("c")))).alias("x")).select("context", "x.*")
    tails = stored(tails)
    ext = None
    for k, c in enumerate(closed):
        b = tails.join(c.select(F.col("ngram").alias("c"), (F.col("log10_backoff") * ln).alias("b")), "c")
        per = b.groupBy("context").agg(*[F.sum(F.when(F.col("size") >= s, F.col("b")).otherwise(0.0)).alias(f"from_{s}") for s in range(1, order)])
        ctx = ctx.join(per.select("context", F.col("from_1").alias(f"b_{k}")), "context", "left").withColumn(f"b_{k}", F.coalesce(f"b_{k}", F.lit(0.0)))
        # the longest of this model's n-grams for each word after the context
        hit = tails.join(c.where("order > 1").select(F.expr("substring_index(ngram, ' ', order - 1)").alias("c"), T.last(F.col("ngram")).alias("word"), "order", (F.col("log10_prob") * ln).alias("p")), "c")
        best = hit.groupBy("context", "word").agg(F.max(F.struct("order", "p")).alias("x")).select("context", "word", "x.*").join(per, "context", "left")
        left = F.lit(0.0)
        for s in range(2, order):
            left = F.when(F.col("order") == s, F.coalesce(f"from_{s}", F.lit(0.0))).otherwise(left)
        own = best.select("context", "word", F.lit(k).alias("m"), (F.col("p") + left).alias("x"))
        ext = own if ext is None else ext.union(own)
    ctx = stored(ctx)
    wide = ext.groupBy("context", "word").agg(*[F.max(F.when(F.col("m") == k, F.col("x"))).alias(f"x_{k}") for k in k_])
    wide = wide.join(uni, "word").join(ctx.select("context", *[f"b_{k}" for k in k_]), "context")
    wide = stored(wide.select("context", "word", *[F.coalesce(f"x_{k}", F.col(f"u_{k}") + F.col(f"b_{k}")).alias(f"x_{k}") for k in k_], *[f"u_{k}" for k in k_]))
    right = seen.join(uni, "word").join(ctx.drop("n"), "context").join(wide.select("context", "word", *[f"x_{k}" for k in k_]), ["context", "word"], "left")
    right = right.groupBy("context").agg(*[F.sum(F.col("n") * F.coalesce(f"x_{k}", F.col(f"u_{k}") + F.col(f"b_{k}"))).alias(f"c_{k}") for k in k_])
    return {"unigrams": uni, "contexts": ctx, "extensions": wide, "correct": right}


def moments(tables_: dict[str, DataFrame], weights: Sequence[float]) -> DataFrame:
    """(context, n, ln_z, e_m, e_ij): the normaliser, mean and second moment of the models' log-probabilities after each context."""
    k_ = range(len(weights))
    lam = [float(x) for x in weights]
    u = tables_["unigrams"].where(F.col("word") != T.BOS)
    score = I._sum([F.lit(lam[k]) * F.col(f"u_{k}") for k in k_])
    one = u.select(*[f"u_{k}" for k in k_], F.exp(score).alias("w"))
    # sums over all unigrams; a context shifts every one of them by the same back-offs
    base = one.agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"u_{k}")).alias(f"s_{k}") for k in k_], *[F.sum(F.col("w") * F.col(f"u_{i}") * F.col(f"u_{j}")).alias(f"s_{i}_{j}") for i in k_ for j in k_ if i <= j]).first()
    e = tables_["extensions"].where(F.col("word") != T.BOS)
    c = tables_["contexts"]
    e = e.join(c.select("context", *[f"b_{k}" for k in k_]), "context")
    new = F.exp(I._sum([F.lit(lam[k]) * F.col(f"x_{k}") for k in k_]))
    old = F.exp(I._sum([F.lit(lam[k]) * (F.col(f"u_{k}") + F.col(f"b_{k}")) for k in k_]))
    e = e.withColumn("new", new).withColumn("old", old)
    y = {k: F.col(f"u_{k}") + F.col(f"b_{k}") for k in k_}
    g = e.groupBy("context").agg(
        F.sum(F.col("new") - F.col("old")).alias("dz"),
        *[F.sum(F.col("new") * F.col(f"x_{k}") - F.col("old") * y[k]).alias(f"d_{k}") for k in k_],
        *[F.sum(F.col("new") * F.col(f"x_{i}") * F.col(f"x_{j}") - F.col("old") * y[i] * y[j]).alias(f"d_{i}_{j}") for i in k_ for j in k_ if i <= j],
    )
    r = c.join(g, "context", "left").na.fill(0.0)
    f = F.exp(I._sum([F.lit(lam[k]) * F.col(f"b_{k}") for k in k_]))
    r = r.withColumn("f", f).withColumn("z", F.col("f") * base["w"] + F.col("dz"))
    s = {k: F.col("f") * (F.lit(base[f"s_{k}"]) + F.col(f"b_{k}") * base["w"]) for k in k_}
    ss = {(i, j): F.col("f") * (F.lit(base[f"s_{i}_{j}"]) + F.col(f"b_{i}") * base[f"s_{j}"] + F.col(f"b_{j}") * base[f"s_{i}"] + F.col(f"b_{i}") * F.col(f"b_{j}") * base["w"]) for i in k_ for j in k_ if i <= j}
    return r.select("context", "n", F.ln("z").alias("ln_z"), *[((s[k] + F.col(f"d_{k}")) / F.col("z")).alias(f"e_{k}") for k in k_], *[((ss[i, j] + F.col(f"d_{i}_{j}")) / F.col("z")).alias(f"e_{i}_{j}") for i in k_ for j in k_ if i <= j])


def derivatives(tables_: dict[str, DataFrame], weights: Sequence[float]) -> DataFrame:
    """One row: tokens, perplexity, gradient g_m and Hessian h_i_j (i <= j) of the log-perplexity summed over tokens."""
    k_ = range(len(weights))
    m = moments(tables_, weights)
    right = tables_["correct"].agg(*[F.sum(f"c_{k}").alias(f"c_{k}") for k in k_])
    t = m.agg(
        F.sum("n").alias("tokens"),
        F.sum(F.col("n") * F.col("ln_z")).alias("ln_z"),
        *[F.sum(F.col("n") * F.col(f"e_{k}")).alias(f"e_{k}") for k in k_],
        *[F.sum(F.col("n") * (F.col(f"e_{i}_{j}") - F.col(f"e_{i}") * F.col(f"e_{j}"))).alias(f"h_{i}_{j}") for i in k_ for j in k_ if i <= j],
    )
    r = t.crossJoin(F.broadcast(right))
    total = F.col("ln_z") - I._sum([F.lit(float(weights[k])) * F.col(f"c_{k}") for k in k_])
    return r.select("tokens", F.exp(total / F.col("tokens")).alias("perplexity"), *[(F.col(f"e_{k}") - F.col(f"c_{k}")).alias(f"g_{k}") for k in k_], *[f"h_{i}_{j}" for i in k_ for j in k_ if i <= j])


def tune(models: Sequence[Model], lines: DataFrame, keys: Sequence[str], steps: int = 10, rate: float = 0.7) -> tuple[list[float], list[float]]:
    """(weights, perplexity before each step): damped Newton steps from even weights."""
    t = tables(models, lines, keys)
    n = len(models)
    lam = np.full(n, 1 / n)
    seen = []
    for _ in range(steps):
        r = derivatives(t, lam.tolist()).first()
        seen.append(r["perplexity"])
        g = np.array([r[f"g_{k}"] for k in range(n)])
        h = np.array([[r[f"h_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        lam = lam - rate * np.linalg.solve(h, g)
    return lam.tolist(), seen
