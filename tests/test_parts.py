"""Counting and estimation by parts: nothing large is shuffled twice or written as objects, and parts, chunks and blocks don't show in the results."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators import estimate as E
from quillspark.operators import grams as G
from quillspark.operators import parted as P
from quillspark.operators import score as S
from quillspark.operators.model import Model
from quillspark.plans import queries

SF = "/root/testdata/sf0.001"
TEXTS = ["a b a\nb  c\t<s> a\n", "", "\n", "\n\n", None, "é ü\x0bx\r\nü", "a b c d e f", " ", "a\n\nb </s>", "ab a b", "x" * 5000]


def brute(texts, order):
    out = collections.Counter()
    for t in texts:
        if t is None:
            continue
        for line in t.removesuffix("\n").split("\n"):
            for x in "\0\t\r":
                line = line.replace(x, " ")
            w = ["<s>"] * (order - 1) + [x for x in line.split(" ") if x not in ("", "<s>", "</s>", "<unk>")] + ["</s>"]
            out.update(" ".join(w[i : i + order]) for i in range(len(w) - order + 1))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_chunks_and_parts_by_brute_force(monkeypatch, order):
    """Chunks, slices and merges of few words; more words than fit into one key."""
    rng = random.Random(order)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    for name, value in (("CHUNK", 50), ("SLICE", 40)):
        monkeypatch.setattr(G, name, value)
    if order == 3:
        monkeypatch.setattr(G, "_keys", lambda cols, bits: list(cols))
        monkeypatch.setattr(G, "summed", lambda cols, counts, words: _plain(cols, counts))
    held = collections.defaultdict(list)
    for b in G.chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), order, 4, True):
        for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[p].append(d)
    got = collections.Counter()
    for p, blocks in held.items():
        names, cols, n = G.merged(blocks, order)
        got.update(dict(zip(G.strings(names, [cols[k] for k in G.in_text_order(order)]).to_pylist(), n.tolist())))
        assert {int(x) % 4 for x in G.hashes(names.take(pa.array(np.unique(cols[0]))))} == {p}
    assert got == brute(texts, order)


def _plain(cols, counts):
    rows = collections.Counter()
    for k, r in enumerate(zip(*[c.tolist() for c in cols])):
        rows[r] += 1 if counts is None else int(counts[k])
    keys = sorted(rows)
    return [np.array(x, np.int32) for x in zip(*keys)], np.array([rows[k] for k in keys], np.int64)


def test_bytes_of_blocks():
    """A row of a block takes a few bytes, where a shuffled string took 22 and a checkpointed one more than 60."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 2000) % 50_000) for _ in range(100)]
    b = next(G.chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), 3, 4, True))
    rows = sum(len(G.opened(d, 3)[1][0]) for d in b.column(1).to_pylist())
    assert sum(map(len, b.column(1).to_pylist())) < 10 * rows


def test_counts_that_a_byte_holds(spark):
    """Numbers are packed in as few bytes as they need, and added in eight."""
    df = spark.createDataFrame([("a b\n" * 300,), ("a b\n" * 200,)], "text string")
    assert {r["ngram"]: r["count"] for r in P.raw(df, 2).collect()} == {"<s> a": 500, "a b": 500, "b </s>": 500}


@pytest.mark.parametrize("options", [{"order": 4}, {"order": 3, "prune": (0, 1, 2)}, {"order": 2, "limit": True}])
def test_the_model_knows_itself(spark, options):
    """Flags, rest costs, numbers and looked up entries, which are computed by parts, against those of the model's rows by joins."""
    from quillspark.operators import compact as K

    df = queries.table(spark, SF, "benchmark")
    if options.pop("limit", False):
        options["limit_vocab"] = S.lines_of(queries.table(spark, SF, "conversations")).selectExpr("explode(words) as word").distinct()
    m = E.estimate(df, **options)
    plain = Model(spark.createDataFrame(m.rows.collect(), m.rows.schema), m.order)
    rows = lambda x: sorted((tuple(r) for r in x.select(sorted(x.columns)).collect()), key=repr)
    assert rows(m.closed()) == rows(plain.closed())
    assert rows(m.counts()) == rows(plain.counts())
    assert rows(m.vocabulary()) == rows(plain.vocabulary())
    assert rows(K.rest_max(m)) == rows(K.rest_max(plain))
    assert rows(m.split()[1]) == rows(plain.split()[1])
    asked = plain.rows.select("ngram").where("hash(ngram) % 3 = 0").union(spark.createDataFrame([("no such",), ("word",)], "ngram string")).distinct()
    assert rows(m.looked_up(asked)) == rows(S.facts(plain, asked))


def test_a_model_is_not_shuffled_as_rows(spark):
    """No n-grams of the model are joined or grouped: no plan of its rows has a join, and its one exchange by parts has blocks."""
    plan = E.estimate(queries.table(spark, SF, "benchmark")).rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_special_words_raise(spark):
    with pytest.raises(Exception, match="special word"):
        E.estimate(spark.createDataFrame([("a <s>",)], "text string"), skip_symbols=False).rows.collect()
