"""One query for each operator, over its whole table with production parameters; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, lattice, mixing, packing, pii, simhash, substring, topk, toxicity, warc


#: A public key for the sake of repeatable runs; a real one is a secret of whoever runs this.
KEY = b"not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 or more words that two documents have."""
    return substring.repeats(_table(spark, sf_dir, "documents"))


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 or more words that occurs twice, in two documents or in one, with the place of its first copy."""
    return substring.repeats(_table(spark, sf_dir, "documents"), within=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of a mix of all tokens with 0.95 of the greatest entropy and no source repeated more than 4 times."""
    return mixing.draws(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture, from the raw request, response and metadata records of all pages; what is nested comes as JSON."""
    return warc.flat(warc.captures(warc.parsed(warc.from_pages(_table(spark, sf_dir, "pages")))))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 greatest inner products, among all vectors, of every vector whose id is divisible by 50."""
    return topk.search(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of the windows of 2048 tokens that all documents fill."""
    return packing.segments(packing.windows(_table(spark, sf_dir, "documents")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and their number."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is a near copy of an earlier one of its group."""
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offending sentences of every toxic document, by a model of ``labels``."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.offending(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector that is a near copy of an earlier one of its group."""
    return lattice.groups(_table(spark, sf_dir, "embeddings"))


def near_copies_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two near copies of each vector added, one of thrice the length and one a little off, so that there is something to find on any table."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = e.select(F.col("vec_id") + 1_000_000_000, F.transform("embedding", lambda x: x * F.lit(3).cast("float")))
    off = e.select(F.col("vec_id") + 2_000_000_000, F.transform("embedding", lambda x, i: (x + F.lit(0.01) * ((F.col("vec_id") * 31 + i * 17) % 7 - 3)).cast("float")))
    return lattice.groups(e.union(scaled).union(off))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose language is identified; those rejected have no row."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.classify(docs, langid.fit(docs)).where("accepted").select("doc_id", "predicted_lang", "confidence")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op1_passages, op2_mixing, op3_warc, op4_topk, op5_packing, op6_pii, op7_simhash, op8_toxicity, op9_lattice, near_copies_of_embeddings, op10_language_id)}
SQL = {"op1_substring_dedup": substring.SQL, "op2_mixing": mixing.SQL, "op3_warc": warc.SQL, "op4_topk": topk.SQL, "op5_packing": packing.SQL, "op9_lattice": lattice.SQL.format("embeddings")}
SQL["near_copies_of_embeddings"] = lattice.SQL.format("(SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x: (x * 3)::FLOAT) FROM embeddings UNION ALL SELECT vec_id + 2000000000, list_transform(embedding, lambda x, i: (x + 0.01::DOUBLE * ((vec_id * 31 + (i - 1) * 17) % 7 - 3))::FLOAT) FROM embeddings)")
