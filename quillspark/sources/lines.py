"""Lines of text files, compressed or not, with their place; compression is told by the first bytes, not by the name."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = {b"\x1f\x8b": "gz", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz"}


def kind_of(head: bytes) -> str | None:
    """gz, bz2, xz or None, by the first bytes."""
    return next((k for m, k in MAGIC.items() if head.startswith(m)), None)


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Decompressed bytes of a file given in pieces; members one after the other are joined."""
    head = next(chunks, b"")
    kind = kind_of(head)
    if kind is None:
        yield head
        yield from chunks
        return
    make = {"gz": lambda: zlib.decompressobj(31), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]
    z, piece = make(), head
    while piece:
        out = z.decompress(piece)
        if out:
            yield out
        piece = z.unused_data if z.eof else b""
        if z.eof:
            z = make()
        if not piece:
            piece = next(chunks, b"")


def opened(path: str) -> Iterator[bytes]:
    """Bytes of a file on any file system that pyarrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(name, compression=None) as f:
        while piece := f.read(1 << 20):
            yield piece


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, value) of all lines; one task a file, streamed. A CR at the end of a line goes, bytes that aren't UTF-8 are replaced.

    Files that are not compressed and need no line numbers are better read by ``spark.read.text``, which splits them.
    """
    paths = [path] if isinstance(path, str) else list(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                rest, at = b"", 0
                for piece in inflated(opened(p)):
                    *whole, rest = (rest + piece).split(b"\n")
                    if whole:
                        yield _batch(p, at, whole)
                        at += len(whole)
                if rest:
                    yield _batch(p, at, [rest])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(run, "path string, line_no bigint, value string")


def _batch(path: str, at: int, lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array([x.removesuffix(b"\r").decode(errors="replace") for x in lines])], ["path", "line_no", "value"]
    )


def cat(spark: SparkSession, path: str, out: str) -> None:
    """Write the decompressed lines of a file as text."""
    read(spark, path).orderBy("line_no").select("value").coalesce(1).write.text(out)


def words(spark: SparkSession, path: str) -> DataFrame:
    """(word): distinct words of a white-space separated list."""
    return spark.read.text(path).select(F.explode(F.split("value", "[\\s\\x00]+")).alias("word")).where("word <> ''").distinct()


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, words) of a file with one sentence a line."""
    return read(spark, path).select("line_no", F.filter(F.split("value", "[ \\t\\x0B\\f\\r\\x00]+"), lambda x: x != "").alias("words"))


def sentence_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, words): phrases between TAB or VT, one sentence a line; lines without words are no sentences."""
    from quillspark.operators.skew import ranked

    p = read(spark, path).select("line_no", F.explode(F.split("value", "[\\t\\x0B]")).alias("p")).select("line_no", F.filter(F.split("p", " "), lambda x: x != "").alias("words")).where(F.size("words") > 0)
    ids = ranked(p.select("line_no").distinct(), ["line_no"], "sentence")
    return p.join(ids, "line_no").select("sentence", "words")


def phrase_table(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of a table whose fields are separated by three vertical bars; a space on either side of them goes."""
    f = F.split("value", "\\|\\|\\|", 3)
    one = lambda k: F.regexp_replace(F.regexp_replace(F.get(f, F.lit(k)), " \\z", ""), "\\A ", "")
    return spark.read.text(path).where(F.size(f) >= 2).select(one(0).alias("source"), one(1).alias("target"))


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, rest) of a count file: the n-gram, a TAB, and anything."""
    f = F.split("value", "\t", 2)
    return spark.read.text(path).select(f[0].alias("ngram"), F.get(f, F.lit(1)).alias("rest"), "value")


def write_counts(rows: DataFrame, path: str) -> None:
    """Lines of (ngram, count), in suffix order within each part."""
    from quillspark.functions.text import suffix_order

    rows.repartitionByRange(suffix_order(F.col("ngram"))).sortWithinPartitions(suffix_order(F.col("ngram"))).select(F.concat_ws("\t", "ngram", F.col("count").cast("string"))).write.text(path)


def binary_counts(spark: SparkSession, path: str, order: int, vocab: DataFrame) -> DataFrame:
    """(ngram, count) of fixed-width records of ``order`` 32-bit word ids and a 64-bit count, little-endian, by ``vocab`` (word, id)."""
    import numpy as np

    width = 4 * order + 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("ids", "<u4", (order,)), ("count", "<u8")])
        for b in batches:
            for p in b.column(0).to_pylist():
                rest, row = b"", 0
                for piece in opened(p):
                    have = rest + piece
                    n = len(have) // width
                    x = np.frombuffer(have, kind, n)
                    rest = have[n * width :]
                    if n:
                        ids = x["ids"].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), pa.array(list(ids), pa.list_(pa.int64())), pa.array(x["count"].astype(np.int64))], ["row", "ids", "count"])
                        row += n
                if rest:
                    raise ValueError(f"{p} ends within a record")

    rows = spark.createDataFrame([(path,)], "path string").mapInArrow(run, "row bigint, ids array<bigint>, count bigint")
    at = rows.select("row", "count", F.posexplode("ids").alias("pos", "id")).join(vocab, "id", "left")
    word = F.when(F.col("word").isNull(), F.raise_error(F.lit("a word id outside the vocabulary")).cast("string")).otherwise(F.col("word"))
    g = at.groupBy("row").agg(F.first("count").alias("count"), F.sort_array(F.collect_list(F.struct("pos", word.alias("word")))).alias("x"))
    return g.select(F.array_join(F.transform("x", lambda x: x["word"]), " ").alias("ngram"), "count")


def vocabulary_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, id) of a list with a NUL after each word; ids are places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                rest, at = b"", 0
                for piece in opened(p):
                    *whole, rest = (rest + piece).split(b"\0")
                    if whole:
                        yield pa.RecordBatch.from_arrays([pa.array([x.decode(errors="replace") for x in whole]), pa.array(range(at, at + len(whole)), pa.int64())], ["word", "id"])
                        at += len(whole)

    return spark.createDataFrame([(path,)], "path string").mapInArrow(run, "word string, id bigint")
