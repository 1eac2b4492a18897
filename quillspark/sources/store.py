"""Stored models: Parquet by order, with the order and kind beside it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import suffix_order
from quillspark.operators.model import Model

KIND = "quillspark-model-1"


class _Hook:
    """What an output hook has: ``sink(model)``."""

    def sink(self, model: Model) -> None:
        raise NotImplementedError


class ParquetHook(_Hook):
    def __init__(self, path: str):
        self.path = path

    def sink(self, model: Model) -> None:
        write(model, self.path)


class ArpaHook(_Hook):
    def __init__(self, path: str, verbose: dict[str, str] | None = None):
        self.path, self.verbose = path, verbose

    def sink(self, model: Model) -> None:
        from quillspark.sources import arpa

        arpa.write(model, self.path, self.verbose)


def output(model: Model, hooks: list[_Hook]) -> None:
    """The model to each hook in turn; it is computed once."""
    from quillspark.operators.durable import cut

    once = Model(cut(model.rows), model.order)
    for h in hooks:
        h.sink(once)


def write(model: Model, path: str) -> None:
    """Rows partitioned by order and sorted in suffix order in each part, so that statistics of row groups tell n-grams apart."""
    rows = model.rows.repartitionByRange("order", suffix_order(F.col("ngram"))).sortWithinPartitions("order", suffix_order(F.col("ngram")))
    rows.write.partitionBy("order").parquet(f"{path}/rows")
    spark = model.rows.sparkSession
    spark.createDataFrame([(json.dumps({"kind": KIND, "order": model.order}),)], "value string").coalesce(1).write.text(f"{path}/meta")


def is_stored(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str) -> Model:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if meta.get("kind") != KIND:
        raise ValueError(f"{path} is not a stored model")
    return Model(spark.read.schema("ngram string, log10_prob double, log10_backoff double, order int").parquet(f"{path}/rows").select("order", "ngram", "log10_prob", "log10_backoff"), meta["order"])


def lookup(model: Model, ngrams: DataFrame) -> DataFrame:
    """Stored rows of the given n-grams."""
    return ngrams.select("ngram").distinct().join(model.rows, "ngram", "left")


def write_by_sentence(pairs: DataFrame, path: str) -> None:
    """One folder for each sentence."""
    pairs.select("sentence", "ngram").repartition("sentence").write.partitionBy("sentence").text(path)
