"""The ARPA text format."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.model import SCHEMA, FormatError, Model
from quillspark.sources import lines as L


def parse(lines: Iterator[str]) -> Iterator[tuple]:
    """Header counts as (0, n, count), then (order, ngram, log10_prob, log10_backoff); raises FormatError at the first breach of the format."""
    at = iter(lines)

    def line() -> str:
        x = next(at, None)
        if x is None:
            raise FormatError("the file ends early")
        return x

    x = line()
    while not x.strip() or x.startswith("#"):
        x = line()
    if x.strip() != "\\data\\":
        raise FormatError(f"\\data\\ expected, not {x!r}")
    counts: list[int] = []
    while (x := line()).strip():
        m = re.fullmatch(r"ngram (\d+)=\s*(\d+)\s*", x)
        if not m:
            raise FormatError(f"a count expected, not {x!r}")
        if int(m[1]) != len(counts) + 1:
            raise FormatError(f"orders must follow one another: {x!r}")
        counts.append(int(m[2]))
        yield 0, str(len(counts)), float(counts[-1]), None
    if not counts:
        raise FormatError("no counts")
    for n, count in enumerate(counts, 1):
        while not (x := line()).strip():
            pass
        if x.strip() != f"\\{n}-grams:":
            raise FormatError(f"\\{n}-grams: expected, not {x!r}")
        for _ in range(count):
            x = line()
            f = re.split(r"[\t \r]+", x.strip("\t \r"))
            if len(f) not in (n + 1, n + 2):
                raise FormatError(f"{n} words expected in {x!r}")
            try:
                p = float(f[0])
                b = float(f[n + 1]) if len(f) == n + 2 else None
            except ValueError:
                raise FormatError(f"a number expected in {x!r}") from None
            if p != p or b is not None and (b != b or b in (float("inf"), float("-inf"))):
                raise FormatError(f"not a number: {x!r}")
            if n == len(counts) and b:
                raise FormatError(f"a back-off in the highest order: {x!r}")
            yield n, " ".join(f[1 : n + 1]), p, None if n == len(counts) else b or 0.0
        x = next(at, "\\end\\") if n == len(counts) and not count else line()
        if x.strip() and not x.startswith("\\"):
            raise FormatError(f"more {n}-grams than the header says: {x!r}")
        at = _again(x, at)
    while not (x := line()).strip():
        pass
    if x.strip() != "\\end\\":
        raise FormatError(f"\\end\\ expected, not {x!r}")
    for x in at:
        if x.strip():
            raise FormatError(f"something follows the end: {x!r}")


def _again(x: str, rest: Iterator[str]) -> Iterator[str]:
    yield x
    yield from rest


def read(spark: SparkSession, path: str) -> Model:
    """The model of an ARPA file, compressed or not: one task streams it, as lines only mean something after those before them."""

    def text(p: str) -> Iterator[str]:
        rest = b""
        for piece in L.inflated(L.opened(p)):
            *whole, rest = (rest + piece).split(b"\n")
            yield from (x.decode(errors="replace") for x in whole)
        if rest:
            yield rest.decode(errors="replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                held: list[tuple] = []
                for r in parse(text(p)):
                    held.append(r)
                    if len(held) == 50_000:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    from quillspark.operators.durable import cut

    rows = cut(spark.createDataFrame([(path,)], "path string").mapInArrow(run, SCHEMA))
    order = rows.where("order = 0").count()
    return Model(rows.where("order > 0"), order)


def read_parts(spark: SparkSession, path: str) -> Model:
    """The model of a folder that ``write`` wrote: rows say by their number of words what they are, so parts are read side by side."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 2).select(f.alias("f"))
    order = spark.read.text(path).where(F.col("value").rlike("^ngram \\d+=\\d+$")).count()
    words = T.length(F.col("f")[1]).cast("int")
    top = F.lit(order)
    back = F.when(words < top, F.coalesce(F.get(F.col("f"), F.lit(2)).cast("double"), F.lit(0.0)))
    return Model(rows.select(words.alias("order"), F.col("f")[1].alias("ngram"), F.col("f")[0].cast("double").alias("log10_prob"), back.alias("log10_backoff")), order)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    o, g, p, b = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(o, pa.int32()), pa.array(g, pa.string()), pa.array(p, pa.float64()), pa.array(b, pa.float64())], ["order", "ngram", "log10_prob", "log10_backoff"])


def number(x):  # type: ignore[no-untyped-def]
    """The shortest form of a number; whole ones without a point."""
    return F.regexp_replace(x.cast("string"), "\\.0$", "")


def lines(model: Model, header: list[str] | None = None) -> DataFrame:
    """(part, sub, key, value): the file's lines, in the order of part, sub and key."""
    spark = model.rows.sparkSession
    n = {r["order"]: r["n"] for r in model.counts().collect()}
    fixed = [(0, -1, "", f"# {x}") for x in header or []]
    fixed += [(0, 0, "", "\\data\\")] + [(0, k, "", f"ngram {k}={n.get(k, 0)}") for k in range(1, model.order + 1)]
    for k in range(1, model.order + 1):
        fixed += [(k, 0, "", ""), (k, 1, "", f"\\{k}-grams:")]
    fixed += [(model.order + 1, 0, "", ""), (model.order + 1, 1, "", "\\end\\")]
    value = F.concat_ws("\t", number(F.col("log10_prob")), "ngram", F.when(F.col("order") < model.order, number(F.coalesce("log10_backoff", F.lit(0.0)))))
    return spark.createDataFrame(fixed, "part int, sub int, key string, value string").union(model.rows.select("order", F.lit(2), "ngram", value))


def write(model: Model, path: str, verbose: dict[str, str] | None = None) -> None:
    """An ARPA file as the parts of a folder, to be joined in the order of their names; <s>, </s> and <unk> come first."""
    x = lines(model, [f"{k}: {v}" for k, v in (verbose or {}).items()])
    first = F.when(F.col("key") == T.UNK, 0).when(F.col("key") == T.BOS, 1).when(F.col("key") == T.EOS, 2).otherwise(3)
    x.withColumn("first", first).repartitionByRange("part", "sub", "first", "key").sortWithinPartitions("part", "sub", "first", "key").select("value").write.text(path)


def write_file(model: Model, path: str, verbose: dict[str, str] | None = None) -> None:
    """The same as one file on this machine; rows pass through the driver a partition at a time."""
    x = lines(model, [f"{k}: {v}" for k, v in (verbose or {}).items()])
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        for r in x.orderBy("part", "sub", "key").select("value").toLocalIterator():
            f.write(r["value"] + "\n")


def filtered(model: Model, kept: DataFrame) -> Model:
    """The rows whose n-gram is in ``kept`` (ngram): numbers as they were, the counts being those that are left."""
    return Model(model.rows.join(kept.select("ngram").distinct(), "ngram", "left_semi").select("order", "ngram", "log10_prob", "log10_backoff"), model.order)
