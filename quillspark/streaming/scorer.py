"""Scores of a stream of texts: micro-batches against a static model; nothing is kept between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import score as S
from quillspark.operators.durable import cut
from quillspark.operators.model import Model


def start(stream: DataFrame, model: Model, sink: Callable[[DataFrame, int], None], checkpoint: str, column: str = "text", key: str = "id"):  # type: ignore[no-untyped-def]
    """Start scoring; ``sink(sentence scores, batch)`` gets each batch. With a sink that replaces what a batch wrote before, each row counts once."""
    # prepared once: batches write nothing of the model
    with_unk = Model(cut(model.with_unk().rows), model.order)
    ready = cut(S.facts(with_unk).repartition("ngram"))

    def batch(df: DataFrame, number: int) -> None:
        lines = S.lines_of(df, column, [key])
        sink(S.sentences(S.words(with_unk, lines, [key, "line"], ready=ready), [key, "line"]).withColumn("batch", F.lit(number)), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
