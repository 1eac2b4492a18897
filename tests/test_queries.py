"""Registered queries: names, SQL, and a selection run against their SQL on the smallest tables (the bench and driver run them all)."""

import pytest

import __spark_entry__ as entry
from quillspark.plans import queries

SF = "/root/testdata/sf0.001"


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and set(queries.QUERIES) <= set(q) and all(map(callable, q.values()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["order", "ngram", "log10_prob", "log10_backoff"]


@pytest.mark.parametrize("name", ["sentence_stats", "vocab_first_occurrence", "adjusted_counts_2", "discounts_fallback", "kn_model", "kn_pruned", "score_words", "chart_equivalence", "filter_multiple", "phrase_table_vocab", "tune_gradient_iter0", "quantize_codebook", "arpa_roundtrip"])
def test_same_as_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name])
