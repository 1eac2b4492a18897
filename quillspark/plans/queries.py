"""The registered queries over the standard tables, each with its SQL twin where SQL can say the same.

Models are trained on ``documents`` (all of it), and score ``benchmark`` and ``conversations``. N-grams are strings; doubles are rounded, as
sums and logarithms may differ in their last places between engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chart as H
from quillspark.operators import compact as K
from quillspark.operators import counts as C
from quillspark.operators import estimate as E
from quillspark.operators import filters as X
from quillspark.operators import interpolate as I
from quillspark.operators import parted as P
from quillspark.operators import score as S
from quillspark.operators import tune as U
from quillspark.operators.durable import cut, shared_dir
from quillspark.operators.model import Model
from quillspark.plans import sql as Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):  # type: ignore[no-untyped-def]
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def rounded(x, places: int = 6):  # type: ignore[no-untyped-def]
    """Rounded, and without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def shown(m: Model) -> DataFrame:
    return m.rows.select("order", "ngram", rounded("log10_prob").alias("log10_prob"), rounded("log10_backoff").alias("log10_backoff"))


R = "round({0}, 6) + 0"
SHOWN = 'SELECT ord AS "order", g AS ngram, round(lp, 6) + 0 AS log10_prob, round(lb, 6) + 0 AS log10_backoff FROM {0}'
DL = Z.lines("l", "documents", "doc_id")
M3 = Z.model("", "documents", "doc_id", 3)
BL = Z.lines("bl", "benchmark", "item_id")
CL = Z.lines("cl", "conversations", "conv_id * 1000000 + turn")


# --- text and counts


@query(Z.with_(DL) + f"SELECT word, count(*) AS \"count\" FROM (SELECT unnest({Z.W}) AS word FROM l) GROUP BY word")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.sentences(docs(spark, d)).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("count"))


@query(Z.with_(DL, f"w AS (SELECT {Z.W} AS w FROM l)") + "SELECT (SELECT count(*) FROM w) AS sentences, (SELECT sum(len(w))::BIGINT FROM w) AS tokens, (SELECT count(DISTINCT x) + 3 FROM (SELECT unnest(w) AS x FROM w)) AS types")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.token_stats(C.sentences(docs(spark, d)))


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(replace(text, chr(10), ' '), '[\t\r ]+'), lambda x: x <> '' AND x NOT IN ('<s>', '</s>', '<unk>')) AS w FROM documents),
f AS (SELECT w[i] AS word, min((doc_id, i)) AS seen FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t) GROUP BY 1)
SELECT word, row_number() OVER (ORDER BY seen) + 2 AS id FROM f UNION ALL SELECT * FROM (VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2))"""
)
def vocab_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return C.vocabulary(docs(spark, d))


def _counts(order: int) -> None:
    @query(Z.with_(DL, Z.grams("", "l", order)) + 'SELECT g AS ngram, c AS "count" FROM raw', f"ngram_counts_{order}")
    def raw(spark: SparkSession, d: str) -> DataFrame:
        return P.raw(docs(spark, d), order)

    @query(Z.with_(DL, Z.grams("", "l", 3), Z.adjusted("", 3)) + f"SELECT g AS ngram, a AS adjusted, raw FROM a{order}", f"adjusted_counts_{order}")
    def adjusted(spark: SparkSession, d: str) -> DataFrame:
        return P.adjusted(docs(spark, d), 3, order)


for _n in (1, 2, 3):
    _counts(_n)

_COC = Z.with_(DL, Z.grams("", "l", 3), Z.adjusted("", 3), Z.marks("", 3, [0], None), Z.discounts("", 3))


def _coc(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d).counts_of_counts


@query(_COC + 'SELECT ord AS "order", n1, n2, n3, n4, total, kept FROM coc')
def count_of_counts(spark: SparkSession, d: str) -> DataFrame:
    return _coc(spark, d)


@query(_COC + 'SELECT ord AS "order", round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3 FROM d')
def discounts(spark: SparkSession, d: str) -> DataFrame:
    return C.discounts(_coc(spark, d)).select("order", *[rounded(f"d{k}").alias(f"d{k}") for k in (1, 2, 3)])


@query(Z.with_(Z.lines("l", "region", "r_regionkey", "r_name"), Z.grams("", "l", 3), Z.adjusted("", 3), Z.marks("", 3, [0], None), Z.discounts("", 3)) + 'SELECT ord AS "order", round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3 FROM d')
def discounts_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Few enough words that the closed form fails."""
    coc = C.count_of_counts(C.adjusted(C.raw_counts(C.sentences(table(spark, d, "region"), "r_name"), 3), 3))
    return C.discounts(coc).select("order", *[rounded(f"d{k}").alias(f"d{k}") for k in (1, 2, 3)])


# --- estimation


def prepared(spark: SparkSession, d: str, order: int = 3, name: str = "documents", **options) -> E.Estimate:
    return E.prepared(table(spark, d, name), order=order, **options)


def trained(spark: SparkSession, d: str, order: int = 3, name: str = "documents", **options) -> Model:
    return prepared(spark, d, order, name, **options).model()


@query(Z.with_(M3) + " UNION ALL ".join(f'SELECT {n} AS "order", ctx AS context, den::BIGINT AS den, round(gamma, 6) AS gamma FROM g{n}' for n in (1, 2, 3)))
def context_gamma(spark: SparkSession, d: str) -> DataFrame:
    e = prepared(spark, d)
    out = None
    for n in (1, 2, 3):
        x = e.gamma(n).select(F.lit(n).alias("order"), "context", "den", rounded("gamma").alias("gamma"))
        out = x if out is None else out.union(x)
    return out


def _orders(n: int, name: str) -> None:
    @query(Z.with_(M3) + f"SELECT g AS ngram, round(lp, 6) + 0 AS log10_prob FROM model WHERE ord = {n}", name)
    def kn(spark: SparkSession, d: str) -> DataFrame:
        p = prepared(spark, d).probabilities()[n]
        return p.select("ngram", rounded(F.least(F.lit(0.0), E.log10(F.col("p")))).alias("log10_prob"))


for _n, _name in ((1, "kn_unigrams"), (2, "kn_bigrams"), (3, "kn_trigrams")):
    _orders(_n, _name)


@query(Z.with_(M3) + 'SELECT ord AS "order", g AS ngram, round(lb, 6) + 0 AS log10_backoff FROM model WHERE ord < 3')
def kn_backoffs(spark: SparkSession, d: str) -> DataFrame:
    return trained(spark, d).split()[1].select("order", "ngram", rounded("log10_backoff").alias("log10_backoff"))


@query(Z.with_(M3) + SHOWN.format("model"))
def kn_model(spark: SparkSession, d: str) -> DataFrame:
    return shown(trained(spark, d))


@query(Z.with_(Z.model("", "documents", "doc_id", 2, interpolate=False)) + SHOWN.format("model WHERE ord = 1"))
def kn_noninterp_unigrams(spark: SparkSession, d: str) -> DataFrame:
    return shown(trained(spark, d, 2, interpolate_unigrams=False)).where(F.col("order") == 1)


@query(Z.with_(Z.model("", "documents", "doc_id", 2, pad=10_000_000)) + SHOWN.format("model WHERE ord = 1"))
def kn_vocab_pad(spark: SparkSession, d: str) -> DataFrame:
    return shown(trained(spark, d, 2, vocab_pad=10_000_000)).where(F.col("order") == 1)


@query(Z.with_(Z.model("", "conversations", "conv_id * 1000000 + turn", 3, collapse=True)) + SHOWN.format("model"))
def kn_collapsed_q(spark: SparkSession, d: str) -> DataFrame:
    return shown(trained(spark, d, 3, "conversations", collapse_values=True))


@query(Z.with_(Z.model("", "documents", "doc_id", 3, prune=[0, 1, 1])) + SHOWN.format("model"))
def kn_pruned(spark: SparkSession, d: str) -> DataFrame:
    return shown(trained(spark, d, prune=(0, 1, 1)))


_VOCAB = f"vv AS (SELECT DISTINCT unnest({Z.Q}) AS w FROM cl)"


@query(Z.with_(CL, _VOCAB, Z.model("", "documents", "doc_id", 3, vocab="vv")) + SHOWN.format("model"))
def kn_limit_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Only words that conversations have."""
    v = S.lines_of(table(spark, d, "conversations")).select(F.explode("words").alias("word")).distinct()
    return shown(trained(spark, d, limit_vocab=v))


@query(Z.with_(Z.model("", "benchmark", "item_id", 5)) + SHOWN.format("model"))
def kn_order_5(spark: SparkSession, d: str) -> DataFrame:
    return shown(trained(spark, d, 5, "benchmark"))


@query(Z.with_(Z.model("", "conversations", "conv_id * 1000000 + turn", 1)) + SHOWN.format("model"))
def kn_order_1(spark: SparkSession, d: str) -> DataFrame:
    return shown(trained(spark, d, 1, "conversations"))


# --- scoring

_SW = Z.with_(M3, BL, Z.scored("s", "model", "bl", 3))
_SC = Z.with_(M3, CL, Z.scored("s", "model", "cl", 3))


def on_benchmark(spark: SparkSession, d: str, **options) -> DataFrame:
    lines = S.lines_of(table(spark, d, "benchmark"), keep=["item_id"])
    return S.words(trained(spark, d), lines, ["item_id", "line"], **options)


def on_conversations(spark: SparkSession, d: str) -> DataFrame:
    lines = S.lines_of(table(spark, d, "conversations"), keep=["conv_id", "turn"])
    return S.words(trained(spark, d), lines, ["conv_id", "turn", "line"])


@query(_SW + "SELECT d AS item_id, ln AS line, pos, word, oov, len AS ngram_length, round(lp, 6) + 0 AS log10_prob FROM sw")
def score_words(spark: SparkSession, d: str) -> DataFrame:
    return on_benchmark(spark, d).select("item_id", "line", "pos", "word", "oov", "ngram_length", rounded("log10_prob").alias("log10_prob"))


@query(_SW + "SELECT d AS item_id, ln AS line, count(*) AS tokens, count(*) FILTER (WHERE oov) AS oov, round(sum(lp), 4) + 0 AS log10_prob, round(pow(10, -sum(lp) / count(*)), 4) AS perplexity FROM sw GROUP BY d, ln")
def score_sentences(spark: SparkSession, d: str) -> DataFrame:
    return S.sentences(on_benchmark(spark, d), ["item_id", "line"]).select("item_id", "line", "tokens", "oov", rounded("log10_prob", 4).alias("log10_prob"), rounded("perplexity", 4).alias("perplexity"))


@query(_SC + "SELECT count(*) AS tokens, count(*) FILTER (WHERE oov) AS oov, round(sum(lp), 3) AS log10_prob, round(pow(10, -sum(lp) / count(*)), 4) AS perplexity FROM sw")
def corpus_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(on_conversations(spark, d)).select("tokens", "oov", rounded("log10_prob", 3).alias("log10_prob"), rounded("perplexity", 4).alias("perplexity"))


@query(_SC + "SELECT round(pow(10, -sum(lp) FILTER (WHERE NOT oov) / count(*) FILTER (WHERE NOT oov)), 4) AS perplexity_excl_oov FROM sw")
def perplexity_excl_oov(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(on_conversations(spark, d)).select(rounded("perplexity_excl_oov", 4).alias("perplexity_excl_oov"))


@query(_SC + 'SELECT word, count(*) AS "count" FROM sw WHERE oov GROUP BY word')
def oov_words(spark: SparkSession, d: str) -> DataFrame:
    return on_conversations(spark, d).where("oov").groupBy("word").agg(F.count("*").alias("count"))


@query(_SC + 'SELECT len AS ngram_length, count(*) AS "count" FROM sw GROUP BY len')
def ngram_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return on_conversations(spark, d).groupBy("ngram_length").agg(F.count("*").alias("count"))


@query(
    Z.with_(M3, "e AS (SELECT ord, g, EXISTS (SELECT 1 FROM (SELECT DISTINCT ord - 1 AS o, substr(g, strpos(g, ' ') + 1) AS s FROM model WHERE ord > 1) x WHERE x.o = m.ord AND x.s = m.g) AS l, EXISTS (SELECT 1 FROM (SELECT DISTINCT ord - 1 AS o, array_to_string(string_split(g, ' ')[1:ord - 1], ' ') AS c FROM model WHERE ord > 1) x WHERE x.o = m.ord AND x.c = m.g) OR coalesce(lb, 0) <> 0 AS r FROM model m)")
    + 'SELECT ord AS "order", false AS blank, l AS extends_left, r AND ord < 3 AS has_extension, count(*) AS n FROM e GROUP BY ALL'
)
def closure_flags(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the closed model by their flags; a model estimated here has no blanks."""
    return trained(spark, d).closed().groupBy("order", "blank", "extends_left", "has_extension").agg(F.count("*").alias("n"))


_HOLED = "h AS (SELECT * FROM model WHERE ord <> 2 OR g IN (SELECT array_to_string(string_split(g, ' ')[1:2], ' ') FROM model WHERE ord = 3)), k AS (SELECT DISTINCT substr(g, strpos(g, ' ') + 1) AS s FROM h WHERE ord = 3 AND substr(g, strpos(g, ' ') + 1) NOT IN (SELECT g FROM h WHERE ord = 2))"


@query(
    Z.with_(Z.model("", "benchmark", "item_id", 3), _HOLED)
    + "SELECT s AS ngram, round(coalesce(c.lb, 0) + u.lp, 6) + 0 AS log10_prob FROM k JOIN h u ON u.ord = 1 AND u.g = split_part(s, ' ', 2) LEFT JOIN h c ON c.ord = 1 AND c.g = split_part(s, ' ', 1)"
)
def blank_closure(spark: SparkSession, d: str) -> DataFrame:
    """Blanks of a model that lacks the bigrams which begin no trigram."""
    m = trained(spark, d, 3, "benchmark")
    m = Model(cut(m.rows), 3)
    starts = m.of(3).select(T.context(F.col("ngram"), 3).alias("ngram")).distinct()
    holed = Model(m.rows.where("order <> 2").union(m.of(2).join(starts, "ngram", "left_semi").select("order", "ngram", "log10_prob", "log10_backoff")), 3)
    return holed.closed().where("blank").select("ngram", rounded("log10_prob").alias("log10_prob"))


@query(Z.with_(M3, BL, Z.scored("s", "model", "bl", 3, bos=False, eos=False)) + "SELECT d AS item_id, ln AS line, round(sum(lp), 4) + 0 AS score FROM sw GROUP BY d, ln")
def fragment_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lines as fragments: without a begin or an end."""
    lines = S.lines_of(table(spark, d, "benchmark"), keep=["item_id"]).where(F.size("words") > 0)
    m = trained(spark, d)
    return H.fragments(m, lines, ["item_id", "line"], S.ready_for(m, lines, ["item_id", "line"])).select("item_id", "line", rounded("score", 4).alias("score"))


@query(Z.with_(M3, BL, Z.scored("s", "model", "bl", 3, bos=False, eos=False)) + "SELECT d AS item_id, ln AS line, round(sum(lp), 4) + 0 AS whole, round(sum(lp), 4) + 0 AS joined FROM sw GROUP BY d, ln HAVING count(*) > 1")
def chart_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Each line's score whole, and joined of its thirds: the first two, then the last."""
    m = trained(spark, d)
    keys = ["item_id", "line"]
    lines = S.lines_of(table(spark, d, "benchmark"), keep=["item_id"]).where(F.size("words") > 1)
    n = F.size("words")
    third = F.floor(n / 3).cast("int")
    cuts = [(F.lit(1), third), (third + 1, third), (2 * third + 1, n)]
    ready = S.ready_for(m, lines, keys)
    parts = [H.fragments(m, lines.select(*keys, F.slice("words", a, size).alias("words")), keys, ready) for a, size in cuts]
    out = H.joined(m, H.joined(m, parts[0], parts[1], keys, ready), parts[2], keys, ready).select(*keys, F.col("score").alias("joined"))
    return H.fragments(m, lines, keys, ready).join(out, keys).select(*keys, rounded("score", 4).alias("whole"), rounded("joined", 4).alias("joined"))


# --- filters

_G3 = Z.with_(Z.lines("l", "benchmark", "item_id"), Z.grams("", "l", 3), CL, f"v AS (SELECT DISTINCT d, ln, unnest({Z.Q}) AS w FROM cl)")
_NEED = "x AS (SELECT g, list_distinct(list_filter(string_split(g, ' '), lambda w: NOT (starts_with(w, '<') AND ends_with(w, '>')))) AS ws FROM raw), y AS (SELECT g, len(ws) AS n, unnest(ws) AS w FROM x), z AS (SELECT d, ln, g FROM y JOIN v USING (w) GROUP BY d, ln, g, n HAVING count(*) = n UNION ALL SELECT d, ln, g FROM x, (SELECT DISTINCT d, ln FROM v) WHERE len(ws) = 0)"


def _benchmark_grams(spark: SparkSession, d: str) -> DataFrame:
    return C.raw_counts(C.sentences(table(spark, d, "benchmark")), 3)


def _sentence_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Lines of conversations as sentences; their identifier is what the SQL has as (d, ln)."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("d"), "text")
    return S.lines_of(c, keep=["d"]).select(F.struct("d", "line").alias("sentence"), F.explode("words").alias("word")).distinct()


@query(_G3 + ", k AS (SELECT DISTINCT w FROM v) SELECT g AS ngram, c AS \"count\" FROM raw WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(g, ' ')) AS w) q WHERE NOT (starts_with(w, '<') AND ends_with(w, '>')) AND w NOT IN (SELECT w FROM k))")
def filter_single(spark: SparkSession, d: str) -> DataFrame:
    return X.single(_benchmark_grams(spark, d), _sentence_vocab(spark, d).select("word"))


@query(_G3 + ", " + _NEED + ' SELECT DISTINCT g AS ngram, c AS "count" FROM z JOIN raw USING (g)')
def filter_union(spark: SparkSession, d: str) -> DataFrame:
    return X.union(_benchmark_grams(spark, d), _sentence_vocab(spark, d))


@query(_G3 + ", " + _NEED + " SELECT d, ln AS line, g AS ngram FROM z")
def filter_multiple(spark: SparkSession, d: str) -> DataFrame:
    return X.multiple(_benchmark_grams(spark, d), _sentence_vocab(spark, d)).select("sentence.d", "sentence.line", "ngram")


@query(_G3 + ", " + _NEED.replace("string_split(g, ' '), lambda", "string_split(g, ' ')[1:2], lambda") + ' SELECT DISTINCT g AS ngram, c AS "count" FROM z JOIN raw USING (g)')
def filter_context(spark: SparkSession, d: str) -> DataFrame:
    return X.union(_benchmark_grams(spark, d), _sentence_vocab(spark, d), context=True)


@query(_G3 + ' SELECT g AS ngram, c AS "count" FROM raw')
def filter_copy(spark: SparkSession, d: str) -> DataFrame:
    X.check("copy")
    return _benchmark_grams(spark, d)


_PH = (
    Z.with_(
        Z.lines("l", "benchmark", "item_id"),
        Z.grams("", "l", 3),
        f"p AS (SELECT d * 1000 + ln AS s, ws[i:i + 2] AS ph FROM (SELECT d, ln, ws, unnest(range(1, len(ws) + 1, 3)) AS i FROM (SELECT d, ln, {Z.Q} AS ws FROM l)))",
        "e AS (SELECT s, ph, i, unnest(range(i, len(ph) + 1)) AS j FROM (SELECT s, ph, unnest(range(1, len(ph) + 1)) AS i FROM p))",
        "k AS (SELECT DISTINCT s, array_to_string(ph[i:j], ' ') AS part, i = 1 AS h, j = len(ph) AS t FROM e)",
        "w AS (SELECT g, string_split(regexp_replace(g, ' ?</s>.*$', ''), ' ') AS ws FROM raw)",
        "x AS (SELECT g, list_filter(CASE WHEN starts_with(ws[1], '<') AND ends_with(ws[1], '>') THEN ws[2:] ELSE ws END, lambda y: y <> '') AS ws FROM w)",
        "q AS (SELECT g, ws, len(ws) AS n FROM x)",
        "sub AS (SELECT DISTINCT s, part FROM k)",
        "hd AS (SELECT DISTINCT s, part FROM k WHERE h)",
        "tl AS (SELECT DISTINCT s, part FROM k WHERE t)",
        "wh AS (SELECT DISTINCT s, part FROM k WHERE h AND t)",
        """r AS (SELECT sub.s, g FROM q JOIN sub ON part = array_to_string(ws, ' ') WHERE n > 0
UNION SELECT tl.s, g FROM q JOIN tl ON tl.part = ws[1] JOIN hd ON hd.s = tl.s AND hd.part = array_to_string(ws[2:], ' ') WHERE n >= 2
UNION SELECT tl.s, g FROM q JOIN tl ON tl.part = array_to_string(ws[1:2], ' ') JOIN hd ON hd.s = tl.s AND hd.part = ws[3] WHERE n = 3
UNION SELECT tl.s, g FROM q JOIN tl ON tl.part = ws[1] JOIN wh ON wh.s = tl.s AND wh.part = ws[2] JOIN hd ON hd.s = tl.s AND hd.part = ws[3] WHERE n = 3
UNION SELECT s, g FROM q, (SELECT DISTINCT s FROM p) WHERE n = 0)""",
    )
)


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """Each line of benchmark is a sentence whose phrases are its words three by three."""
    lines = S.lines_of(table(spark, d, "benchmark"), keep=["item_id"]).where(F.size("words") > 0)
    cuts = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(3)), lambda i: F.slice("words", i, F.lit(3)))
    return lines.select((F.col("item_id") * 1000 + F.col("line")).alias("sentence"), F.explode(cuts).alias("words"))


@query(_PH + ' SELECT g AS ngram, c AS "count" FROM raw WHERE g IN (SELECT g FROM r)')
def filter_phrase_union(spark: SparkSession, d: str) -> DataFrame:
    return X.phrase_union(_benchmark_grams(spark, d), _phrases(spark, d), 3)


@query(_PH + " SELECT s AS sentence, g AS ngram FROM r")
def filter_phrase_multiple(spark: SparkSession, d: str) -> DataFrame:
    return X.phrase_multiple(_benchmark_grams(spark, d), _phrases(spark, d), 3).select("sentence", "ngram")


@query(
    Z.with_(Z.lines("l", "benchmark", "item_id"), Z.grams("", "l", 3), CL, "tb AS (SELECT DISTINCT array_to_string(string_split(g, ' ')[1:2], ' ') AS src, split_part(g, ' ', 3) AS tgt FROM raw)", f"s AS (SELECT d, ln, {Z.Q} AS ws FROM cl)", "o AS (SELECT DISTINCT d, ln, array_to_string(ws[i:i + 1], ' ') AS src FROM (SELECT d, ln, ws, unnest(range(1, len(ws))) AS i FROM s))")
    + "SELECT DISTINCT d, ln AS line, word FROM (SELECT d, ln, tgt AS word FROM o JOIN tb USING (src) UNION ALL SELECT d, ln, unnest(ws) FROM s)"
)
def phrase_table_vocab(spark: SparkSession, d: str) -> DataFrame:
    """A table from two words to the one that may follow, met by the lines of conversations."""
    g = _benchmark_grams(spark, d)
    t = g.select(T.context(F.col("ngram"), 3).alias("source"), T.last(F.col("ngram")).alias("target")).distinct()
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("d"), "text")
    s = S.lines_of(c, keep=["d"]).select(F.struct("d", "line").alias("sentence"), "words")
    return X.phrase_table_vocabulary(s, t).select("sentence.d", "sentence.line", "word")


# --- interpolation and tuning

LAMBDA = (0.6, 0.4)
_MM = [Z.model("a", "documents", "doc_id", 2), Z.model("b", "conversations", "conv_id * 1000000 + turn", 2)]
_VU = "vu AS (SELECT g AS w, coalesce(a.lp, (SELECT lp FROM amodel WHERE g = '<unk>')) AS ua, coalesce(b.lp, (SELECT lp FROM bmodel WHERE g = '<unk>')) AS ub, a.lb AS ba, b.lb AS bb FROM (SELECT g, lp, lb FROM amodel WHERE ord = 1) a FULL JOIN (SELECT g, lp, lb FROM bmodel WHERE ord = 1) b USING (g))"
_BI = "bi AS (SELECT g, split_part(g, ' ', 1) AS c, split_part(g, ' ', 2) AS w, a.lp AS pa, b.lp AS pb FROM (SELECT g, lp FROM amodel WHERE ord = 2) a FULL JOIN (SELECT g, lp FROM bmodel WHERE ord = 2) b USING (g))"
_NORM = [
    f"z0 AS (SELECT log10(sum(pow(10, {LAMBDA[0]} * ua + {LAMBDA[1]} * ub))) AS z0 FROM vu WHERE w <> '<s>')",
    f"sc AS (SELECT g, c, {LAMBDA[0]} * coalesce(pa, u.ua + coalesce(k.ba, 0)) + {LAMBDA[1]} * coalesce(pb, u.ub + coalesce(k.bb, 0)) AS p, {LAMBDA[0]} * u.ua + {LAMBDA[1]} * u.ub AS low, {LAMBDA[0]} * coalesce(k.ba, 0) + {LAMBDA[1]} * coalesce(k.bb, 0) AS bk FROM bi JOIN vu u ON u.w = bi.w JOIN vu k ON k.w = bi.c)",
    "zc AS (SELECT c, any_value(bk) AS bk, log10(pow(10, z0 + any_value(bk)) + sum(pow(10, p) - pow(10, low + bk))) AS z, z0 FROM sc, z0 GROUP BY c, z0)",
]


#: Interpolation is shown on the two smaller corpora.
_MI = [Z.model("a", "benchmark", "item_id", 2), Z.model("b", "conversations", "conv_id * 1000000 + turn", 2)]


def _two(spark: SparkSession, d: str, first: str = "documents") -> list[Model]:
    return [trained(spark, d, 2, n) for n in (first, "conversations")]


@query(
    Z.with_(*_MI, _VU, _BI)
    + "SELECT w AS ngram, round(ua, 6) + 0 AS p_0, 1 AS from_0, round(ub, 6) + 0 AS p_1, 1 AS from_1 FROM vu UNION ALL SELECT g, round(coalesce(pa, ua), 6) + 0, CASE WHEN pa IS NULL THEN 1 ELSE 2 END, round(coalesce(pb, ub), 6) + 0, CASE WHEN pb IS NULL THEN 1 ELSE 2 END FROM bi JOIN vu USING (w)"
)
def interp_merge(spark: SparkSession, d: str) -> DataFrame:
    m = I.merged(_two(spark, d, "benchmark"))
    return m[1].union(m[2]).select("ngram", rounded("p_0").alias("p_0"), "from_0", rounded("p_1").alias("p_1"), "from_1")


@query(
    Z.with_(*_MI, _VU, _BI, *_NORM)
    + f"SELECT 1 AS \"order\", w AS ngram, round(least(0, CASE WHEN w = '<s>' THEN 0 ELSE {LAMBDA[0]} * ua + {LAMBDA[1]} * ub - z0 END), 6) + 0 AS log10_prob FROM vu, z0 UNION ALL SELECT 2, g, round(p - z, 6) + 0 FROM sc JOIN zc USING (c)"
)
def interp_normalised(spark: SparkSession, d: str) -> DataFrame:
    return I.interpolated(_two(spark, d, "benchmark"), LAMBDA).rows.select("order", "ngram", rounded("log10_prob").alias("log10_prob"))


@query(Z.with_(*_MI, _VU, _BI, *_NORM) + "SELECT w AS ngram, round(coalesce(z0 + zc.bk - z, 0), 6) + 0 AS log10_backoff FROM vu LEFT JOIN zc ON w = c")
def interp_backoffs(spark: SparkSession, d: str) -> DataFrame:
    return I.interpolated(_two(spark, d, "benchmark"), LAMBDA).rows.where("order = 1").select("ngram", rounded("log10_backoff").alias("log10_backoff"))


_TUNE = [
    Z.lines("kl", "benchmark", "item_id"),
    f"tk AS (SELECT d, ln, i, ws[i] AS w FROM (SELECT d, ln, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT d, ln, list_concat({Z.Q}, ['</s>']) AS ws FROM kl)))",
    "tw AS (SELECT d, ln, i, coalesce(v.w, '<unk>') AS w FROM tk LEFT JOIN vu v USING (w))",
    "tc AS (SELECT w, coalesce(lag(w) OVER (PARTITION BY d, ln ORDER BY i), '<s>') AS c FROM tw)",
    "un AS (SELECT w, ua * ln(10) AS ua, ub * ln(10) AS ub, coalesce(ba, 0) * ln(10) AS ba, coalesce(bb, 0) * ln(10) AS bb FROM vu)",
    "cx AS (SELECT c, count(*) AS n, any_value(un.ba) AS ba, any_value(un.bb) AS bb FROM tc JOIN un ON un.w = tc.c GROUP BY c)",
    "ex AS (SELECT bi.c, bi.w, coalesce(pa * ln(10), un.ua + cx.ba) AS xa, coalesce(pb * ln(10), un.ub + cx.bb) AS xb, un.ua + cx.ba AS ya, un.ub + cx.bb AS yb FROM bi JOIN cx USING (c) JOIN un ON un.w = bi.w)",
    "bs AS (SELECT sum(e) AS w0, sum(e * ua) AS sa, sum(e * ub) AS sb FROM (SELECT exp(0.5 * ua + 0.5 * ub) AS e, ua, ub FROM un WHERE w <> '<s>'))",
    "dz AS (SELECT c, sum(exp(0.5 * xa + 0.5 * xb) - exp(0.5 * ya + 0.5 * yb)) AS dz, sum(exp(0.5 * xa + 0.5 * xb) * xa - exp(0.5 * ya + 0.5 * yb) * ya) AS da, sum(exp(0.5 * xa + 0.5 * xb) * xb - exp(0.5 * ya + 0.5 * yb) * yb) AS db FROM ex GROUP BY c)",
    "mo AS (SELECT n, f * w0 + coalesce(dz, 0) AS z, f * (sa + ba * w0) + coalesce(da, 0) AS ea, f * (sb + bb * w0) + coalesce(db, 0) AS eb FROM (SELECT *, exp(0.5 * ba + 0.5 * bb) AS f FROM cx) LEFT JOIN dz USING (c), bs)",
    "co AS (SELECT sum(coalesce(xa, un.ua + cx.ba)) AS ca, sum(coalesce(xb, un.ub + cx.bb)) AS cb FROM tc JOIN un ON un.w = tc.w JOIN cx ON cx.c = tc.c LEFT JOIN ex ON ex.c = tc.c AND ex.w = tc.w)",
]


@query(
    Z.with_(*_MM, _VU, _BI, *_TUNE)
    + "SELECT sum(n)::BIGINT AS tokens, round(exp((sum(n * ln(z)) - 0.5 * any_value(ca) - 0.5 * any_value(cb)) / sum(n)), 3) AS perplexity, round(sum(n * ea / z) - any_value(ca), 3) AS g_0, round(sum(n * eb / z) - any_value(cb), 3) AS g_1 FROM mo, co"
)
def tune_gradient_iter0(spark: SparkSession, d: str) -> DataFrame:
    lines = S.lines_of(table(spark, d, "benchmark"), keep=["item_id"])
    t = U.tables(_two(spark, d), lines, ["item_id", "line"])
    return U.derivatives(t, (0.5, 0.5)).select("tokens", rounded("perplexity", 3).alias("perplexity"), rounded("g_0", 3).alias("g_0"), rounded("g_1", 3).alias("g_1"))


def _newton(steps: int = 10, rate: float = 0.7) -> list[str]:
    """w0 ... (la, lb): weights after each damped Newton step, and s0 ... with the perplexity before it."""
    out = ["w0 AS (SELECT 0.5::DOUBLE AS la, 0.5::DOUBLE AS lb)"]
    for k in range(steps):
        e, old = "exp(la * ua + lb * ub)", "exp(la * ya + lb * yb)"
        new = "exp(la * xa + lb * xb)"
        out += [
            f"b{k} AS (SELECT sum(e) AS w, sum(e * ua) AS sa, sum(e * ub) AS sb, sum(e * ua * ua) AS saa, sum(e * ua * ub) AS sab, sum(e * ub * ub) AS sbb FROM (SELECT {e} AS e, ua, ub FROM un, w{k} WHERE w <> '<s>'))",
            f"z{k} AS (SELECT c, " + ", ".join(f"sum(n * {x} - o * {y}) AS d{t}" for t, x, y in (("", "1", "1"), ("a", "xa", "ya"), ("b", "xb", "yb"), ("aa", "xa * xa", "ya * ya"), ("ab", "xa * xb", "ya * yb"), ("bb", "xb * xb", "yb * yb"))) + f" FROM (SELECT *, {new} AS n, {old} AS o FROM ex, w{k}) GROUP BY c)",
            f"m{k} AS (SELECT cx.n, f * w + coalesce(d, 0) AS z, f * (sa + ba * w) + coalesce(da, 0) AS ea, f * (sb + bb * w) + coalesce(db, 0) AS eb, f * (saa + 2 * ba * sa + ba * ba * w) + coalesce(daa, 0) AS eaa, f * (sab + ba * sb + bb * sa + ba * bb * w) + coalesce(dab, 0) AS eab, f * (sbb + 2 * bb * sb + bb * bb * w) + coalesce(dbb, 0) AS ebb FROM (SELECT *, exp(la * ba + lb * bb) AS f FROM cx, w{k}) cx LEFT JOIN z{k} USING (c), b{k})",
            f"s{k} AS (SELECT la, lb, exp((sum(n * ln(z)) - la * any_value(ca) - lb * any_value(cb)) / sum(n)) AS ppl, sum(n * ea / z) - any_value(ca) AS ga, sum(n * eb / z) - any_value(cb) AS gb, sum(n * (eaa / z - (ea / z) * (ea / z))) AS haa, sum(n * (eab / z - (ea / z) * (eb / z))) AS hab, sum(n * (ebb / z - (eb / z) * (eb / z))) AS hbb FROM m{k}, w{k}, co GROUP BY la, lb)",
            f"w{k + 1} AS (SELECT la - {rate} * (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS la, lb - {rate} * (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS lb FROM s{k})",
        ]
    return out


@query(Z.with_(*_MM, _VU, _BI, *_TUNE, *_newton()) + "SELECT 0 AS model, round(la, 4) + 0 AS weight, round((SELECT ppl FROM s9), 3) AS perplexity FROM w10 UNION ALL SELECT 1, round(lb, 4) + 0, round((SELECT ppl FROM s9), 3) FROM w10")
def tune_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights after ten Newton steps on benchmark."""
    lines = S.lines_of(table(spark, d, "benchmark"), keep=["item_id"])
    lam, seen = U.tune(_two(spark, d), lines, ["item_id", "line"])
    return spark.createDataFrame([(k, round(float(x), 4) + 0.0, round(float(seen[-1]), 3)) for k, x in enumerate(lam)], "model int, weight double, perplexity double")


# --- compact forms


@query(
    Z.with_(M3, "r3 AS (SELECT g, lp, lp AS r FROM model WHERE ord = 3)", "r2 AS (SELECT m.g, m.lp, greatest(m.lp, coalesce(x.r, m.lp)) AS r FROM model m LEFT JOIN (SELECT substr(g, strpos(g, ' ') + 1) AS s, max(r) AS r FROM r3 GROUP BY 1) x ON x.s = m.g WHERE ord = 2)", "r1 AS (SELECT m.g, m.lp, greatest(m.lp, coalesce(x.r, m.lp)) AS r FROM model m LEFT JOIN (SELECT substr(g, strpos(g, ' ') + 1) AS s, max(r) AS r FROM r2 GROUP BY 1) x ON x.s = m.g WHERE ord = 1)")
    + " UNION ALL ".join(f'SELECT {n} AS "order", g AS ngram, round(r, 6) + 0 AS rest FROM r{n}' for n in (1, 2, 3))
)
def rest_costs_max(spark: SparkSession, d: str) -> DataFrame:
    return K.rest_max(trained(spark, d)).select("order", "ngram", rounded("rest").alias("rest"))


_BOOK = "v AS (SELECT ord, lp, row_number() OVER (PARTITION BY ord ORDER BY lp) AS rn, count(*) OVER (PARTITION BY ord) AS n FROM model WHERE ord > 1), bk AS (SELECT ord, (rn * 256 + n - 1) // n - 1 AS code, avg(lp) AS centre FROM v GROUP BY 1, 2)"


@query(Z.with_(M3, _BOOK) + 'SELECT ord AS "order", code::INTEGER AS code, round(centre, 6) + 0 AS centre FROM bk')
def quantize_codebook(spark: SparkSession, d: str) -> DataFrame:
    """256 centres of the probabilities of each order above the first."""
    return K.codebook(trained(spark, d).rows.where("order > 1"), "log10_prob", 256, ["order"]).select("order", "code", rounded("centre").alias("centre"))


@query(Z.with_(M3, _BOOK, "rc AS (SELECT m.ord, m.g, round(min(abs(m.lp - b.centre)), 6) + 0 AS e FROM (SELECT * FROM model WHERE ord > 1) m JOIN bk b ON b.ord = m.ord GROUP BY m.ord, m.g)") + 'SELECT ord AS "order", g AS ngram, e AS error FROM rc')
def quantize_encode(spark: SparkSession, d: str) -> DataFrame:
    """How far each probability is from the centre that it is encoded as; the SQL looks for the nearest of all."""
    rows = trained(spark, d).rows.where("order > 1")
    e = K.encoded(rows, "log10_prob", K.codebook(rows, "log10_prob", 256, ["order"]), ["order"])
    return e.select("order", "ngram", rounded(F.abs(F.col("log10_prob") - F.col("decoded"))).alias("error"))


_BITS = "length(bin({0}))"
_PACK = "((({0}) + 1) * ({1}) + 7) // 8 + 8"


def _sizes() -> str:
    """SQL of ``compact.sizes`` for three orders (a, b, c), with w, pb and pc bits for a word, a place among b and one among c, and k bits cut by the array."""
    trie = lambda p, q, point: f"(a + 2) * 16 + {_PACK.format('b', f'w + {p} + {q} + {point}')} + {_PACK.format('c', f'w + {p}')}"
    books, array = "2 * 256 * 4 + 256 * 4 + 8", f"CASE WHEN k > 0 THEN ((1 << k) * pb + 7) // 8 ELSE 0 END"
    rows = {
        "probing": "greatest(a + 1, floor(1.5 * a)) * 12 + (a + 1) * 8 + greatest(b + 1, floor(1.5 * b)) * 16 + greatest(c + 1, floor(1.5 * c)) * 12",
        "rest_probing": "greatest(a + 1, floor(1.5 * a)) * 12 + (a + 1) * 12 + greatest(b + 1, floor(1.5 * b)) * 20 + greatest(c + 1, floor(1.5 * c)) * 12",
        "trie": trie(31, 32, "pc"),
        "quant_trie": f"{books} + {trie(8, 8, 'pc')}",
        "array_trie": f"{array} + {trie(31, 32, 'pc - k')}",
        "quant_array_trie": f"{books} + {array} + {trie(8, 8, 'pc - k')}",
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS layout, ({size})::BIGINT AS bytes FROM k" for name, size in rows.items())


@query(
    Z.with_(
        M3,
        "n AS (SELECT max(c) FILTER (WHERE ord = 1) AS a, max(c) FILTER (WHERE ord = 2) AS b, max(c) FILTER (WHERE ord = 3) AS c FROM (SELECT ord, count(*) AS c FROM model GROUP BY ord))",
        f"p AS (SELECT *, {_BITS.format('a')} AS w, {_BITS.format('b')} AS pb, {_BITS.format('c')} AS pc FROM n)",
        "k AS (SELECT *, (SELECT arg_min(j, ((1 << j::INTEGER) * pb // 8 + (b + 1) * (pc - j) // 8, j)) FROM range(0, 23) r(j) WHERE j <= pc)::INTEGER AS k FROM p)",
    )
    + _sizes()
)
def binary_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the six layouts."""
    n = {r["order"]: r["n"] for r in trained(spark, d).counts().collect()}
    return spark.createDataFrame(list(K.sizes([n[k] for k in sorted(n)]).items()), "layout string, bytes bigint")


# --- formats


@query(Z.with_(Z.model("", "benchmark", "item_id", 3)) + SHOWN.format("model"))
def arpa_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A model written as ARPA and read again."""
    from quillspark.sources import arpa

    m = Model(cut(trained(spark, d, 3, "benchmark").rows), 3)
    path = f"{shared_dir(spark)}/arpa-{uuid.uuid4().hex}"
    arpa.write(m, path)
    return shown(arpa.read_parts(spark, path))


@query(Z.with_(Z.model("", "benchmark", "item_id", 3)) + SHOWN.format("model"))
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A model stored as Parquet and read again."""
    from quillspark.sources import store

    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    store.write(trained(spark, d, 3, "benchmark"), path)
    return shown(store.read(spark, path))
