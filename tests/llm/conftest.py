import pytest

#: Columns that an operator might use names of; none is meant for it.
EXTRA = ["id", "i", "t", "l", "k", "g", "h", "a", "b", "v", "e", "n", "row", "node", "root", "tokens", "block", "pass", "copy", "kind", "form", "attempt", "window", "segments", "bucket", "f0", "raw", "least", "label", "words", "codes", "runs", "cell", "__id", "__pass", "__times", "a.b", "a`b", "`", "n_entities.x", "predicted_lang.x", "with space", "1", "select"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(rng, n, stem="w"):
    return " ".join(f"{stem}{int(x)}" for x in rng.integers(0, 5000, n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and blank and long texts, repeated rows and ids, and columns with clashing names."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    one = words_of(rng, 120)
    rows = [
        (1, one, "en", "a", len(one)),
        (2, one, "en", "a", len(one)),
        (2, one, "en", "a", len(one)),
        (3, None, "en", "b", None),
        (4, "", "fr", "b", 0),
        (5, "  \n\t ", None, None, 5),
        (None, one, "fr", "c", len(one)),
        (6, words_of(rng, 60_000, "v"), "fr", None, None),
        (7, "x" * 200_000, "en", "c", 200_000),
        (8, "one", None, "a", 3),
        (9, words_of(rng, 300, "u"), "en", "", 0),
        (10, "a b \x0bc\x0c 中文 \U0001f600 é", "fr", "b", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])  # names with dots and backticks too


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
