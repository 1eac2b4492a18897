"""Counting, estimation, scoring, filters, interpolation, compact forms and formats on small inputs."""

import bz2
import gzip
import lzma
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.api import LanguageModel
from quillspark.functions import text as T
from quillspark.operators import chart, compact, filters, interpolate, score, tune
from quillspark.operators import counts as C
from quillspark.operators import estimate as E
from quillspark.operators.model import SCHEMA, FormatError, Model, SpecialWordMissingError, VocabularyError, reunified
from quillspark.sources import arpa, lines, store

TOY = {"toy0": "a a b a\nb a a b", "toy1": "a a b b b b b b b\nc"}


def toy(spark, name, order=3, **options):
    return E.estimate(spark.createDataFrame([(TOY[name],)], "text string"), order=order, **options)


@pytest.fixture(scope="module")
def toys(spark):
    out = []
    for name in TOY:
        m = toy(spark, name)
        rows = [tuple(r) for r in m.rows.collect()]
        out.append(Model(spark.createDataFrame(rows, SCHEMA), 3))
    return out


def rows_of(m):
    return {r["ngram"]: (r["log10_prob"], r["log10_backoff"]) for r in m.rows.collect()}


# --- counts


def test_counts_of_five_lines(spark):
    text = "looking on a little more loin\non a little more loin\non foo little more loin\nbar\n\n"
    s = C.sentences(spark.createDataFrame([(text,), (None,)], "text string"))
    got = {r["ngram"]: r["count"] for r in C.raw_counts(s, 3).collect()}
    assert got["little more loin"] == 3 and got["<s> <s> on"] == 2 and got["<s> <s> </s>"] == 1 and got["on a little"] == 2 and len(got) == 15
    assert C.token_stats(s).first()["types"] == 11 and C.token_stats(s).first()["sentences"] == 5


def test_adjusted_counts(spark):
    raw = spark.createDataFrame([("<s> <s> <s> x", 3), ("y y y z", 5), ("<s> <s> x z", 5)], "ngram string, count bigint")
    a = {n: {r["ngram"]: r["adjusted"] for r in x.collect()} for n, x in C.adjusted(raw, 4).items()}
    assert a[4] == {"y y y z": 5} and a[1] == {"x": 1, "z": 2, "<unk>": 0, "<s>": 0}
    assert a[2] == {"<s> x": 3, "x z": 1, "y z": 1} and a[3] == {"<s> x z": 5, "y y z": 1}
    with pytest.raises(Exception, match="BadDiscountError"):
        C.discounts(C.count_of_counts(C.adjusted(raw, 4)), C.DiscountConfig(fallback=None)).collect()


def test_options_are_checked():
    with pytest.raises(ValueError):
        C.prune_thresholds([2, 1], 3)
    with pytest.raises(ValueError):
        C.DiscountConfig(fallback=(2.0,))
    with pytest.raises(ValueError):
        E.Config(vocab_pad=9, interpolate_unigrams=False)
    assert C.prune_thresholds([0, 1], 4) == [0, 1, 1, 1] and T.byte_size("1G") == 1 << 30 and T.byte_size("80%", 100) == 80


def test_tokenisers(spark):
    r = spark.createDataFrame([("a\tb\r c\x0bd  <s> e\f",)], "x string").select(T.train_words(F.col("x")).alias("t"), T.query_words(F.col("x")).alias("q"), T.space_words(F.col("x")).alias("s")).first()
    assert r["t"] == ["a", "b", "c\x0bd", "e\f"] and r["q"] == ["a", "b", "c", "d", "<s>", "e"] and r["s"] == ["a\tb\r", "c\x0bd", "<s>", "e\f"]
    with pytest.raises(Exception, match="special word"):
        C.sentences(spark.createDataFrame([("a <s>",)], "text string"), skip_symbols=False).collect()
    g = spark.createDataFrame([("a b c",)], "g string").select(T.context(F.col("g"), 3), T.suffix(F.col("g")), T.first(F.col("g")), T.last(F.col("g")), T.length(F.col("g")), T.context_order(F.col("g"))).first()
    assert tuple(g) == ("a b", "b c", "a", "c", 3, ["b", "a", "c"])


# --- estimation


def test_goldens(toys):
    a = rows_of(toys[0])
    for g, p, b in (("<unk>", -0.90309, 0), ("a", -0.46943438, -0.30103), ("a </s>", -0.58682007, 0), ("<s> a a", -0.14885087, None)):
        assert abs(a[g][0] - p) < 1e-6 and (b is None and a[g][1] is None or abs(a[g][1] - b) < 1e-6)
    assert [sum(g.count(" ") == n for g in a) for n in range(3)] == [5, 7, 7]
    assert [sum(g.count(" ") == n for g in rows_of(toys[1])) for n in range(3)] == [6, 7, 6]


@pytest.mark.parametrize("options", [{}, {"prune": (0, 1, 1)}, {"interpolate_unigrams": False}, {"order": 1}, {"order": 4}])
def test_probabilities_sum_to_one(spark, options):
    text = "\n".join(["the cat sat on the mat", "the dog sat on the cat", "a dog", "the cat sat", ""] * 2 + ["a cat ran to the dog on a mat"])
    m = E.estimate(spark.createDataFrame([(text,)], "text string"), **options)
    p = rows_of(m)
    words = [g for g in p if " " not in g and g != "<s>"]
    for h in {g.rsplit(" ", 1)[0] for g in p if " " in g} | {""}:
        total = 0.0
        for w in words:
            c, back = h, 0.0
            while c and f"{c} {w}" not in p:
                back += (p[c][1] or 0.0) if c in p else 0.0
                c = c.partition(" ")[2]
            total += 10 ** (back + p[f"{c} {w}" if c else w][0])
        assert abs(total - 1) < 1e-9, h


def test_vocabulary_limit_and_pad(spark):
    df = spark.createDataFrame([("a b c a b\nb c a",)], "text string")
    v = spark.createDataFrame([("a",), ("b",)], "word string")
    p = rows_of(E.estimate(df, order=2, limit_vocab=v))
    assert "c" not in p and "a b" in p and not any("c" in g.split() for g in p)
    assert rows_of(E.estimate(df, order=2, vocab_pad=1000))["<unk>"][0] < rows_of(E.estimate(df, order=2))["<unk>"][0]


def test_collapsed_scores_are_path_independent(spark):
    df = spark.createDataFrame([("a b a\nb a b b\na a b",)], "text string")
    plain, q = rows_of(E.estimate(df, order=2)), rows_of(E.estimate(df, order=2, collapse_values=True))
    assert all(b in (0, None) for _, b in q.values())
    for g in plain:  # q of a bigram: its probability times delta; delta = b(w) / gamma(context), so their sum telescopes
        if " " in g:
            c, w = g.split()
            assert abs(q[g][0] - (plain[g][0] + plain[w][1] - plain[c][1])) < 1e-9


# --- models and scoring


def small(spark):
    rows = [
        (1, "<unk>", -1.0, 0.0), (1, "<s>", -99.0, -0.3), (1, "</s>", -0.9, 0.0), (1, "a", -0.7, -0.2), (1, "b", -0.8, -0.4), (1, "c", -1.1, 0.5),
        (2, "<s> a", -0.4, -0.1), (2, "a b", -0.3, -0.25), (2, "b c", -0.6, 0.0), (2, "c a", -0.5, 0.0),
        (3, "<s> a b", -0.2, None), (3, "a b a", -0.35, None), (3, "c a c", -0.15, None),
    ]
    return Model(spark.createDataFrame(rows, SCHEMA), 3)


def test_scores_by_hand(spark):
    m = small(spark)
    lines_ = spark.createDataFrame([(1, "a b zzz a"), (2, ""), (3, "c a c")], "id int, text string")
    got = score.words(m, score.lines_of(lines_, keep=["id"]), ["id", "line"]).collect()
    by = {(r["id"], r["pos"]): r for r in got}
    want = {(1, 0): (2, -0.4), (1, 1): (3, -0.2), (1, 2): (1, -0.25 - 0.4 - 1.0), (1, 3): (1, 0.0 - 0.7), (1, 4): (1, -0.2 - 0.9), (2, 0): (1, -0.3 - 0.9), (3, 0): (1, -0.3 - 1.1), (3, 1): (2, -0.5), (3, 2): (3, -0.15), (3, 3): (1, 0.0 + 0.5 - 0.9)}
    assert {k: r["ngram_length"] for k, r in by.items()} == {k: n for k, (n, _) in want.items()}
    for k, (_, p) in want.items():
        assert abs(by[k]["log10_prob"] - p) < 1e-12, k
    assert by[1, 2]["oov"] and by[1, 2]["independent_left"]
    s = score.sentences(score.words(m, score.lines_of(lines_, keep=["id"]), ["id", "line"]), ["id"]).where("id = 2").first()
    assert s["tokens"] == 1 and abs(s["perplexity"] - 10**1.2) < 1e-9


def test_blanks_and_flags(spark):
    c = {r["ngram"]: r for r in small(spark).closed().collect()}
    assert {g for g, r in c.items() if r["blank"]} == {"b a", "a c"}
    assert abs(c["b a"]["log10_prob"] - (-0.4 - 0.7)) < 1e-12 and abs(c["a c"]["log10_prob"] - (-0.2 - 1.1)) < 1e-12
    assert c["a b"]["extends_left"] and c["a b"]["has_extension"] and not c["b c"]["has_extension"] and c["b a"]["extends_left"]


def test_checks(spark):
    good = small(spark)
    good.checked()
    bad = lambda *rows: Model(good.rows.union(spark.createDataFrame(list(rows), SCHEMA)), 3)
    for rows, error in (([(2, "b x", -1.0, 0.0)], VocabularyError), ([(3, "b b a", -1.0, None)], VocabularyError), ([(1, "d", 0.5, 0.0)], FormatError), ([(1, "a", -1.0, 0.0)], FormatError), ([(3, "b c a", -1.0, 0.2)], FormatError), ([(1, "d", float("nan"), 0.0)], FormatError)):
        with pytest.raises(error):
            bad(*rows).checked()
    with pytest.raises(SpecialWordMissingError):
        Model(good.rows.where("ngram <> '</s>'"), 3).checked()
    bad((1, "d", 0.5, 0.0)).checked(positive="clamp")
    no = Model(good.rows.where("ngram <> '<unk>'"), 3).with_unk()
    assert rows_of(no)["<unk>"] == (-100.0, 0.0) and good.with_unk().rows.count() == good.rows.count()
    p, b = good.split()
    assert reunified(p.where("order < 3"), b).count() == 10
    with pytest.raises(Exception, match="don't match"):
        reunified(p, b).collect()
    ids = {r["word"]: r["id"] for r in good.renumbered().collect()}
    assert (ids["<unk>"], ids["<s>"], ids["</s>"]) == (0, 1, 2) and sorted(ids.values()) == list(range(6))


def test_python_api_agrees(spark, tmp_path):
    m = small(spark)
    lm = LanguageModel.of(m)
    lines_ = spark.createDataFrame([("a b zzz a c a c",)], "text string")
    want = [r["log10_prob"] for r in score.words(m, score.lines_of(lines_), ["line"]).orderBy("pos").collect()]
    got = list(lm.full_scores("a b zzz a c a c"))
    assert np.allclose([p for p, _, _ in got], want) and lm.order == 3 and "a" in lm and "zzz" not in lm and "<unk>" not in lm
    assert abs(lm.score("a b") - sum(p for p, _, _ in lm.full_scores("a b"))) < 1e-12 and abs(lm.perplexity("a b") - 10 ** (-lm.score("a b") / 3)) < 1e-9
    s, state = lm.base_full_score(lm.begin_sentence(), "a")
    assert lm.local.full_forgot_state(["<s>"], "a") == (s, state)
    store.write(m, str(tmp_path / "m"))
    import pickle

    again = pickle.loads(pickle.dumps(LanguageModel(str(tmp_path / "m"), spark)))
    assert again.score("a b") == lm.score("a b")


def test_any_bracketing_gives_the_same(spark):
    lm = chart.LocalModel(small(spark))
    words = "a b a c a c b zzz a b c a".split()
    whole, _ = chart.score_fragment(lm, words)
    rng = np.random.default_rng(1)

    def tree(ws):
        if len(ws) == 1:
            return chart.score_fragment(lm, ws)
        k = int(rng.integers(1, len(ws)))
        (p, f), (q, g) = tree(ws[:k]), tree(ws[k:])
        add, both = chart.subsume(lm, f, g)
        return p + q + add, both

    for _ in range(40):
        assert abs(tree(words)[0] - whole) < 1e-9
    r = chart.Rule(lm)
    r.begin_sentence()
    p, f = chart.score_fragment(lm, words)
    r.non_terminal(f, p)
    state, total = lm.begin(), 0.0
    for w in words:
        s, state = lm.full(state, w)
        total += s.log10_prob
    assert abs(r.finish() - total) < 1e-9


# --- filters


def test_filters(spark):
    g = spark.createDataFrame([("a b",), ("a c",), ("<s> a",), ("<s> </s>",), ("d",)], "ngram string")
    v = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (1, "a")], "sentence int, word string")
    names = lambda d: sorted(r["ngram"] for r in d.collect())
    assert names(filters.single(g, spark.createDataFrame([("a",), ("b",)], "word string"))) == ["<s> </s>", "<s> a", "a b"]
    assert names(filters.union(g, v)) == ["<s> </s>", "<s> a", "a b", "a c"]
    many = sorted((r["sentence"], r["ngram"]) for r in filters.multiple(g, v).collect())
    assert many == [(0, "<s> </s>"), (0, "<s> a"), (0, "a b"), (1, "<s> </s>"), (1, "<s> a"), (1, "a c")]
    assert names(filters.union(g, v)) == sorted({n for _, n in many})
    assert names(filters.union(g, v, context=True)) == names(g)
    with pytest.raises(ValueError):
        filters.check("single", phrase=True)
    lines_ = spark.createDataFrame([(0, ["a"]), (1, []), (2, ["b", "b"])], "line_no bigint, words array<string>")
    assert sorted(map(tuple, filters.sentence_vocabulary(lines_).collect())) == [(0, "a"), (1, "b")]


def accepts(phrases, words):
    words = words[1:] if words and words[0].startswith("<") and words[0].endswith(">") else words
    words = words[: words.index("</s>")] if "</s>" in words else words
    n = len(words)
    if not n:
        return True
    sub = {tuple(p[i:j]) for p in phrases for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    if tuple(words) in sub:
        return True
    head, tail, whole = ({tuple(p[:j]) for p in phrases for j in range(1, len(p) + 1)}, {tuple(p[i:]) for p in phrases for i in range(len(p))}, {tuple(p) for p in phrases})
    reach = {i for i in range(1, n) if tuple(words[:i]) in tail}
    for i in range(1, n):
        if i in reach:
            reach |= {j for j in range(i + 1, n) if tuple(words[i:j]) in whole}
    return any(tuple(words[i:]) in head for i in reach)


def test_phrases_by_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: "abc"[int(rng.integers(0, 3))]
    phrases = [(s, [word() for _ in range(int(rng.integers(1, 4)))]) for s in range(3) for _ in range(3)]
    grams = {" ".join(word() for _ in range(int(rng.integers(1, 6)))) for _ in range(150)} | {"<s> a b", "<s>", "a </s> x", "</s>"}
    g = spark.createDataFrame([(x,) for x in grams], "ngram string")
    p = spark.createDataFrame(phrases, "sentence int, words array<string>")
    got = {(r["sentence"], r["ngram"]) for r in filters.phrase_multiple(g, p, 5).collect()}
    assert got == {(s, x) for s in range(3) for x in grams if accepts([w for k, w in phrases if k == s], x.split())}
    assert {r["ngram"] for r in filters.phrase_union(g, p, 5).collect()} == {x for _, x in got}


def test_phrase_table(spark):
    s = spark.createDataFrame([(0, "x y z".split()), (1, ["y"])], "sentence int, words array<string>")
    t = spark.createDataFrame([("x y", "u v"), ("y", "w"), ("z x", "no")], "source string, target string")
    got = {(r["sentence"], r["word"]) for r in filters.phrase_table_vocabulary(s, t).collect()}
    assert got == {(0, w) for w in "xyzuvw"} | {(1, "y"), (1, "w")}


# --- interpolation and tuning


def full_score(p, order, history, word):
    h = list(history)[-(order - 1) :]
    back = 0.0
    while h:
        g = " ".join([*h, word])
        if g in p:
            return back + p[g][0]
        back += p.get(" ".join(h), (0, 0.0))[1] or 0.0
        h = h[1:]
    return back + p.get(word, p["<unk>"])[0]


def test_interpolation_by_brute_force(toys):
    lam = (0.6, 0.7)
    p = [rows_of(m) for m in toys]
    q = rows_of(interpolate.interpolated(toys, lam))
    words = sorted({g for x in p for g in x if " " not in g} - {"<s>"})
    for h in ([], ["<s>"], ["a"], ["a", "a"], ["<s>", "a"], ["b", "b"], ["c"], ["a", "c"]):
        raw = {w: 10 ** sum(la * full_score(x, 3, h, w) for la, x in zip(lam, p)) for w in words}
        z = sum(raw.values())
        for w in words:
            assert abs(full_score(q, 3, h, w) - math.log10(raw[w] / z)) < 1e-9, (h, w)


def test_tuning_by_brute_force(spark, toys):
    lines_ = spark.createDataFrame([(1, ["c"]), (2, ["a", "b", "q"])], "id int, words array<string>")
    t = tune.tables(toys, lines_, ["id"])
    p = [rows_of(m) for m in toys]
    words = sorted({g for x in p for g in x if " " not in g} - {"<s>"})

    def loss(lam):
        total = 0.0
        for ws in (["c"], ["a", "b", "q"]):
            h = ["<s>"]
            for w in [*ws, "</s>"]:
                w = w if w in words else "<unk>"
                ln = lambda v: sum(la * full_score(x, 3, h, v) for la, x in zip(lam, p)) * math.log(10)  # noqa: B023,E731
                total += math.log(sum(math.exp(ln(v)) for v in words)) - ln(w)
                h.append(w)
        return total

    lam, e = (0.5, 0.4), 1e-4
    r = tune.derivatives(t, lam).first()
    assert r["tokens"] == 6 and abs(math.log(r["perplexity"]) * 6 - loss(lam)) < 1e-8
    for k in range(2):
        up, down = list(lam), list(lam)
        up[k] += e
        down[k] -= e
        assert abs((loss(up) - loss(down)) / (2 * e) - r[f"g_{k}"]) < 1e-5
        assert abs((loss(up) - 2 * loss(lam) + loss(down)) / e**2 - r[f"h_{k}_{k}"]) < 1e-3
    weights, seen = tune.tune(toys, lines_, ["id"], steps=3)
    assert seen[-1] <= seen[0] and len(weights) == 2
    with pytest.raises(ValueError):
        tune.tables(toys, spark.createDataFrame([(1, ["<s>"])], "id int, words array<string>"), ["id"])


# --- compact forms


def test_codebooks_by_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, bins in ((100, 8), (5, 8), (37, 4), (1, 3)):
        x = sorted(float(v) for v in np.round(rng.normal(size=n), 1))
        want, last = [], float("-inf")
        for i in range(bins):
            part = x[n * i // bins : n * (i + 1) // bins]
            last = sum(part) / len(part) if part else last
            want.append(last)
        df = spark.createDataFrame([(v,) for v in x], "x double")
        book = compact.codebook(df, "x", bins)
        got = [r["centre"] for r in book.orderBy("code").collect()]
        assert np.allclose(got, want)
        if n >= bins:
            for r in compact.encoded(df, "x", book).collect():
                assert abs(abs(r["x"] - r["decoded"]) - min(abs(r["x"] - c) for c in want)) < 1e-12


def test_rest_costs_and_sizes(spark):
    m = small(spark)
    r = {x["ngram"]: x["rest"] for x in compact.rest_max(m).collect()}
    assert r["b"] == -0.2 and r["a b"] == -0.2 and r["<unk>"] == -1.0
    assert r["c"] == -0.6 and "a c" not in r  # blanks have no rest cost of their own
    low = Model(m.rows.where("order = 1").withColumn("log10_backoff", F.lit(None).cast("double")), 1)
    mid = Model(m.rows.where("order < 3").withColumn("log10_backoff", F.when(F.col("order") < 2, F.col("log10_backoff"))), 2)
    low_rest = {x["ngram"]: x["rest"] for x in compact.rest_lower(m, [low, mid]).collect()}
    assert low_rest["a"] == -0.7 and low_rest["a b"] == -0.3 and low_rest["a b a"] == -0.35
    s = compact.sizes([1000, 5000, 8000])
    assert s["quant_trie"] < s["trie"] < s["probing"] < s["rest_probing"] and s["array_trie"] <= s["trie"]
    q = compact.quantized(m, 2, 2)
    assert q.rows.count() == m.rows.count()
    with pytest.raises(ValueError):
        compact.codebooks(m, 1, 8)


# --- formats


def test_arpa_round_trip(spark, tmp_path):
    m = small(spark)
    path = str(tmp_path / "m.arpa")
    arpa.write_file(m, path, {"Input file": "x"})
    text = open(path, encoding="utf-8").read()
    assert text.startswith("# Input file: x\n\\data\\\nngram 1=6\n") and text.endswith("\\end\\\n") and "\n-0.2\t<s> a b\n" in text
    for suffix, pack in ((".gz", gzip.compress), (".any", bz2.compress), (".x", lzma.compress), (".two.gz", lambda b: gzip.compress(b[:100]) + gzip.compress(b[100:]))):
        with open(path + suffix, "wb") as f:
            f.write(pack(text.encode()))
        assert rows_of(arpa.read(spark, path + suffix)) == rows_of(m)
    arpa.write(m, str(tmp_path / "parts"))
    assert rows_of(arpa.read_parts(spark, str(tmp_path / "parts"))) == rows_of(m)
    parts = sorted((tmp_path / "parts").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    assert {tuple(r) for r in arpa.parse(iter(whole.split("\n")))} == {tuple(r) for r in arpa.parse(iter(text.split("\n")))}


@pytest.mark.parametrize(
    "change",
    [("\\data\\", "\\dat\\"), ("ngram 2=4", "ngram 4=4"), ("\\2-grams:", "\\3-grams:"), ("-0.2\t<s> a b", "-0.2\t<s> a b\t1.5"), ("-0.2\t<s> a b", "nan\t<s> a b"), ("\\end\\\n", "\\end\\\nmore\n"), ("ngram 3=3", "ngram 3=4"), ("-0.2\t<s> a b", "-0.2\ta b")],
)
def test_bad_files_raise(spark, tmp_path, change):
    path = str(tmp_path / "m.arpa")
    arpa.write_file(small(spark), path)
    text = open(path, encoding="utf-8").read()
    assert change[0] in text
    with pytest.raises(FormatError):
        list(arpa.parse(iter(text.replace(*change).split("\n"))))


def test_readers(spark, tmp_path):
    (tmp_path / "s").write_text("a b\r\n\nc\n")
    assert [(r["line_no"], r["value"]) for r in lines.read(spark, str(tmp_path / "s")).orderBy("line_no").collect()] == [(0, "a b"), (1, ""), (2, "c")]
    (tmp_path / "p").write_text("a b\tc\n\nd\x0be f\n")
    assert sorted((r["sentence"], tuple(r["words"])) for r in lines.sentence_phrases(spark, str(tmp_path / "p")).collect()) == [(0, ("a", "b")), (0, ("c",)), (1, ("d",)), (1, ("e", "f"))]
    (tmp_path / "t").write_text("x y ||| u v ||| 0.5\nz ||| w\n")
    assert sorted(map(tuple, lines.phrase_table(spark, str(tmp_path / "t")).collect())) == [("x y", "u v"), ("z", "w")]
    (tmp_path / "v").write_bytes(b"<unk>\0<s>\0</s>\0a\0")
    v = lines.vocabulary_list(spark, str(tmp_path / "v"))
    assert {r["word"]: r["id"] for r in v.collect()} == {"<unk>": 0, "<s>": 1, "</s>": 2, "a": 3}
    (tmp_path / "b").write_bytes(struct.pack("<IIQ", 1, 3, 7) + struct.pack("<IIQ", 3, 2, 9))
    assert sorted(map(tuple, lines.binary_counts(spark, str(tmp_path / "b"), 2, v).collect())) == [("<s> a", 7), ("a </s>", 9)]
    (tmp_path / "b").write_bytes(struct.pack("<IIQ", 1, 9, 7))
    with pytest.raises(Exception, match="outside the vocabulary"):
        lines.binary_counts(spark, str(tmp_path / "b"), 2, v).collect()
    (tmp_path / "c").write_text("a b\t3\nc\n")
    assert [(r["ngram"], r["rest"]) for r in lines.counts(spark, str(tmp_path / "c")).collect()] == [("a b", "3"), ("c", None)]
    lines.write_counts(spark.createDataFrame([("b a", 1), ("a a", 2), ("a b", 3)], "ngram string, count bigint").coalesce(1), str(tmp_path / "w"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "w").glob("part-*"))) == "a a\t2\nb a\t1\na b\t3\n"
    assert lines.words(spark, str(tmp_path / "s")).count() == 3


def test_store_and_hooks(spark, tmp_path):
    m = small(spark)
    store.output(m, [store.ParquetHook(str(tmp_path / "a")), store.ArpaHook(str(tmp_path / "b"))])
    assert rows_of(store.read(spark, str(tmp_path / "a"))) == rows_of(m) == rows_of(arpa.read_parts(spark, str(tmp_path / "b")))
    assert store.is_stored(spark, str(tmp_path / "a")) and not store.is_stored(spark, str(tmp_path / "b"))
    assert store.lookup(m, spark.createDataFrame([("a b",)], "ngram string")).first()["log10_prob"] == -0.3


def test_stream(spark, tmp_path):
    from quillspark.streaming import scorer

    src, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "a b"), (2, "c")], "id int, text string").write.parquet(src)
    stream = spark.readStream.schema("id int, text string").parquet(src)
    q = scorer.start(stream, small(spark), lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    lm = LanguageModel.of(small(spark))
    assert {r["id"]: round(r["log10_prob"], 9) for r in seen} == {1: round(lm.score("a b"), 9), 2: round(lm.score("c"), 9)}
