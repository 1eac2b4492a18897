"""Log-linear interpolation of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.durable import stored
from quillspark.operators.model import Model, VocabularyError


def vocabulary(models: Sequence[Model]) -> DataFrame:
    """(word) of all models; each must have <unk>."""
    out = None
    for m in models:
        if m.of(1).where(F.col("ngram") == T.UNK).isEmpty():
            raise VocabularyError("a model without <unk> can't be interpolated")
        out = m.vocabulary() if out is None else out.union(m.vocabulary())
    return out.distinct()


def merged(models: Sequence[Model]) -> dict[int, DataFrame]:
    """(ngram, p_1, from_1, ...) of all n-grams of any model, for each order.

    p_m is the log10 probability of the longest suffix that model m has, from_m the words of it.
    """
    order = max(m.order for m in models)
    out: dict[int, DataFrame] = {}
    for n in range(1, order + 1):
        keys = None
        for m in models:
            if n <= m.order:
                k = m.of(n).select("ngram")
                keys = k if keys is None else keys.union(k)
        keys = keys.distinct()
        rows = keys
        if n > 1:
            low = out[n - 1]
            rows = rows.withColumn("low", T.suffix(F.col("ngram"))).join(low.withColumnsRenamed({"ngram": "low", **{f"{c}_{k}": f"low_{c}_{k}" for k in range(len(models)) for c in ("p", "from")}}), "low")
        for k, m in enumerate(models):
            own = m.of(n).select("ngram", F.col("log10_prob").alias("own"))
            rows = rows.join(own, "ngram", "left")
            if n == 1:
                unk = m.of(1).where(F.col("ngram") == T.UNK).select(F.col("log10_prob").alias("unk"))
                rows = rows.crossJoin(F.broadcast(unk))
                rows = rows.withColumn(f"p_{k}", F.coalesce("own", "unk")).withColumn(f"from_{k}", F.lit(1)).drop("unk")
            else:
                rows = rows.withColumn(f"p_{k}", F.coalesce("own", f"low_p_{k}")).withColumn(f"from_{k}", F.when(F.col("own").isNotNull(), n).otherwise(F.col(f"low_from_{k}")))
            rows = rows.drop("own")
        out[n] = rows.select("ngram", *[f"{c}_{k}" for k in range(len(models)) for c in ("p", "from")])
    return out


def _sum(terms: list):  # type: ignore[no-untyped-def,type-arg]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def interpolated(models: Sequence[Model], weights: Sequence[float]) -> Model:
    """The normalised product of the models' probabilities to the power of their weights (any real numbers), as a back-off model.

    The models are closed first, so that every suffix exists.
    """
    if len(weights) != len(models):
        raise ValueError("as many weights as models")
    closed = []
    for m in models:
        rows = stored(m.closed().select("order", "ngram", "log10_prob", "log10_backoff"))
        closed.append(Model(rows, m.order))
    models, lam = closed, [F.lit(float(x)) for x in weights]
    k_ = range(len(models))
    order = max(m.order for m in models)
    each = {n: stored(x) for n, x in merged(models).items()}
    out = None
    # contexts' normalisers: z of the empty context first
    rows = each[1].withColumn("prob", _sum([lam[k] * F.col(f"p_{k}") for k in k_]))
    z0 = rows.agg((F.log10(F.sum(F.pow(F.lit(10.0), "prob")) - F.sum(F.when(F.col("ngram") == T.BOS, F.pow(F.lit(10.0), "prob")).otherwise(0.0)))).alias("z")).first()["z"]
    probs = {1: rows.select("ngram", F.when(F.col("ngram") == T.BOS, 0.0).otherwise(F.col("prob") - z0).alias("log10_prob"))}
    backoffs: dict[int, DataFrame] = {}
    z = None
    for n in range(2, order + 1):
        # back-off of each model for every suffix of the context; of contexts that it doesn't have, 0
        rows = each[n].withColumn("context", T.context(F.col("ngram"), n)).withColumn("low", T.suffix(F.col("ngram")))
        ctx = rows.select("context").distinct()
        for k, m in enumerate(models):
            for size in range(1, n):
                b = m.of(size).select(F.col("ngram").alias("c"), F.col("log10_backoff").alias(f"b_{k}_{size}"))
                tail = F.substring_index("context", " ", -size)
                ctx = ctx.withColumn("c", tail).join(b, "c", "left").drop("c").withColumn(f"b_{k}_{size}", F.coalesce(f"b_{k}_{size}", F.lit(0.0)))
        ctx = stored(ctx)
        rows = rows.join(ctx, "context")
        low = each[n - 1].select(F.col("ngram").alias("low"), *[F.col(f"p_{k}").alias(f"lp_{k}") for k in k_], *[F.col(f"from_{k}").alias(f"lf_{k}") for k in k_])
        rows = rows.join(low, "low")

        def backed(p: str, f: str, k: int, top: int):  # type: ignore[no-untyped-def]
            """The model's log-probability after a history of ``top`` words: the longest match, and the back-offs it took."""
            terms = [F.col(p)]
            for size in range(1, top + 1):
                terms.append(F.when(F.col(f) <= size, F.col(f"b_{k}_{size}")).otherwise(0.0))
            return _sum(terms)

        prob = _sum([lam[k] * backed(f"p_{k}", f"from_{k}", k, n - 1) for k in k_])
        lower = _sum([lam[k] * backed(f"lp_{k}", f"lf_{k}", k, n - 2) for k in k_])
        big_b = _sum([lam[k] * F.col(f"b_{k}_{n - 1}") for k in k_])
        rows = rows.select("ngram", "context", prob.alias("prob"), lower.alias("lower"), big_b.alias("bb"))
        shift = F.pow(F.lit(10.0), "prob") - F.pow(F.lit(10.0), F.col("lower") + F.col("bb"))
        g = rows.groupBy("context").agg(F.sum(shift).alias("moved"), F.first("bb").alias("bb"))
        if n == 2:
            g = g.withColumn("zl", F.lit(z0))
        else:
            g = g.withColumn("cl", T.suffix(F.col("context"))).join(z.withColumnsRenamed({"context": "cl", "z": "zl"}), "cl", "left").withColumn("zl", F.coalesce("zl", F.lit(z0)))
        z_n = stored(g.select("context", F.log10(F.pow(F.lit(10.0), F.col("zl") + F.col("bb")) + F.col("moved")).alias("z"), "zl", "bb"))
        probs[n] = rows.join(z_n.select("context", "z"), "context").select("ngram", (F.col("prob") - F.col("z")).alias("log10_prob"))
        backoffs[n - 1] = z_n.select(F.col("context").alias("ngram"), (F.col("zl") + F.col("bb") - F.col("z")).alias("log10_backoff"))
        z = z_n.select("context", "z")
    for n in range(1, order + 1):
        x = probs[n]
        x = x.join(backoffs[n], "ngram", "left").withColumn("log10_backoff", F.coalesce("log10_backoff", F.lit(0.0))) if n < order else x.withColumn("log10_backoff", F.lit(None).cast("double"))
        p = F.least(F.lit(0.0), F.col("log10_prob")) if n < order else F.col("log10_prob")
        x = x.select(F.lit(n).alias("order"), "ngram", p.alias("log10_prob"), "log10_backoff")
        out = x if out is None else out.union(x)
    return Model(out, order)
