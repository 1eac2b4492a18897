"""Scores, states and fragments of an order-5 model with blanks, by DataFrames and on the local model; interpolation and tuning by hand."""

import math

import numpy as np
import pytest
from model_of_order_5 import FIVE

from quillspark.operators import chart, compact, interpolate, score, tune
from quillspark.operators.model import SCHEMA, Model

KEYS = ["id"]


def made(spark, unk=True):
    rows = []
    for g, (p, b) in FIVE.items():
        n = len(g.split())
        if unk or "<unk>" not in g.split():
            rows.append((n, g, p, None if n == 5 else b or 0.0))
    return Model(spark.createDataFrame(rows, SCHEMA), 5)


@pytest.fixture(scope="module")
def five(spark):
    m = made(spark)
    return Model(m.rows.cache(), 5)


@pytest.fixture(scope="module")
def local(five):
    return chart.LocalModel(five)


#: (sentence start, words, lengths, log10 probabilities, lengths of the state after each word where known)
CASES = [
    (True, "looking on a little the biarritz not_found more . </s>", [2, 3, 4, 5, 1, 1, 1, 1, 2, 3], [-0.484652, -0.348837, -0.0155266, -0.00306122, -4.04005, -1.9889, -2.29666, -21.20632, -0.51363, -0.0191651], {9: 0}),
    (True, "looking on a little more loin", [2, 3, 4, 5, 5, 5], [-0.484652, -0.348837, -0.0155266, -0.00306122, -0.00181395, -0.0432557], {4: 4, 5: 1}),
    (False, "also would consider higher looking", [1, 2, 3, 4, 5], [-1.687872, -2, -3, -4, -5], {4: 1}),
    (False, "also would consider not_found", [1, 2, 3, 1], [-1.687872, -2, -3, -9.296665], {}),
    (False, "higher looking not_found", [1, 2, 1], [-1.509559, -1.586971, -2.4727562], {1: 1}),
    (False, "higher looking consider", [1, 2, 1], [-1.509559, -1.586971, -2.1649932], {}),
    (False, "would consider higher looking", [1, 2, 3, 4], [-1.687872, -1.988902, -1.810589, -1.586971], {0: 1, 1: 2, 2: 3}),
    (False, "not_found not_found2 not_found3", [1, 2, 2], [-1.995635, -15, -17], {}),
    (False, "not_found however not_found3", [1, 2, 3], [-1.995635, -4, -6], {}),
    (False, "baz", [1], [-6.535897], {0: 0}),
    (False, "foo bar bar", [1, 2, 1], [-3.141592, -6, 0.281719], {0: 1, 1: 1, 2: 1}),
    (False, "to look a", [1, 2, 3], [-1.687872, -0.2922095, -7], {1: 2}),
]
LEFT = {0: [True] * 10, 2: [False, True, True, True, True], 4: [False, False, True], 6: [False] * 4, 7: [False, True, True], 9: [True], 10: [True, True, True], 11: [False, True, True]}


def test_words_by_dataframes(spark, five):
    for bos in (True, False):
        rows = [(i, c[1].split()) for i, c in enumerate(CASES) if c[0] == bos]
        lines = spark.createDataFrame(rows, "id int, words array<string>")
        got = {(r["id"], r["pos"]): r for r in score.words(five, lines, KEYS, bos=bos, eos=False).collect()}
        ready = score.words(Model(five.with_unk().rows, 5), lines, KEYS, bos=bos, eos=False, ready=score.facts(five))
        assert sorted(map(str, got.values())) == sorted(str(r) for r in ready.collect())
        for i, words in rows:
            _, _, lengths, probs, states = CASES[i]
            for k in range(len(words)):
                r = got[i, k]
                assert r["ngram_length"] == lengths[k] and abs(r["log10_prob"] - probs[k]) < 2e-5 * max(1, abs(probs[k])), (words, k, r)
                assert r["oov"] == words[k].startswith("not_found")
                if k in states:
                    assert r["state_length"] == states[k]
                if i in LEFT:
                    assert r["independent_left"] == LEFT[i][k] or bos, (words, k)


def test_words_by_states(local):
    for i, (bos, text, lengths, probs, states) in enumerate(CASES):
        state = local.begin() if bos else local.null()
        for k, w in enumerate(text.split()):
            s, state = local.full(state, w)
            assert s.ngram_length == lengths[k] and abs(s.log10_prob - probs[k]) < 2e-5 * max(1, abs(probs[k]))
            if k in states:
                assert len(state.words) == states[k]
            if i in LEFT and not bos:
                assert s.independent_left == LEFT[i][k]


def test_model_without_unk(spark):
    m = made(spark, unk=False)
    local = chart.LocalModel(m)
    assert local.full(local.null(), "nothing")[0].log10_prob == -100
    r = score.words(m, spark.createDataFrame([(0, ["nothing", "more"])], "id int, words array<string>"), KEYS, bos=False, eos=False).orderBy("pos").collect()
    assert r[0]["log10_prob"] == -100 and r[0]["oov"] and not r[1]["oov"] and m.with_unk().vocabulary().count() == 37


def test_rest_costs_of_greatest_probability(five):
    rest = {r["ngram"]: r["rest"] for r in compact.rest_max(five).collect()}
    assert abs(rest["."] + 0.2705918) < 1e-6 and abs(rest[". </s>"] + 0.01916512) < 1e-6


def test_fragments_by_hand(local):
    def rule(*parts, begin=False):
        r = chart.Rule(local)
        if begin:
            r.begin_sentence()
        for p in parts:
            r.terminal(p) if isinstance(p, str) else r.non_terminal(p[1], p[0])
        return r.finish(), r.fragment

    base = rule("more", "loin")
    assert abs(base[0] + 1.5624855) < 1e-5 and base[1].left == ("more", "loin") and base[1].right.words == ("loin",)
    assert abs(rule("little", base)[0] + 1.56538) < 1e-4 and abs(rule("to", base)[0] + 3.5513875) < 1e-4
    charge = rule("on", "more")
    assert abs(charge[0] + 3.1929992) < 1e-5
    longer = rule("looking", charge)
    assert abs(longer[0] + 3.91039) < 1e-4 and longer[1].right.words == ("more",)
    assert abs(rule(longer, begin=True)[0] + 3.471169) < 1e-4


TEXTS = [
    "in biarritz watching considering looking . on a little more loin also would consider higher to look good unknown the screening foo bar , unknown however unknown </s>",
    "on a little more loin also would consider higher to look good",
    "also would consider higher to look",
    "would consider higher looking",
    "consider higher",
    "<s> looking on a little more loin",
]


def test_fragments_join_in_any_order(spark, five, local):
    """Left to right, right to left and by halves, as tables: the same scores, and those of the local rules."""
    keys = ["id"]
    texts = {i: t.split() for i, t in enumerate(TEXTS)}
    one = {i: chart.score_fragment(local, w)[0] for i, w in texts.items()}
    frame = lambda x: chart.fragments(five, spark.createDataFrame(x, "id int, words array<string>"), keys)
    whole = {r["id"]: r for r in frame(list(texts.items())).collect()}
    assert all(abs(whole[i]["score"] - one[i]) < 1e-9 for i in texts)
    for cuts in ((0.25, 0.5), (0.5, 0.75), (0.1, 0.9)):
        parts = [[], [], []]
        for i, w in texts.items():
            a, b = int(len(w) * cuts[0]), int(len(w) * cuts[1])
            for p, x in zip(parts, (w[:a], w[a:b], w[b:])):
                p.append((i, x))
        x, y, z = map(frame, parts)
        for got in (chart.joined(five, chart.joined(five, x, y, keys), z, keys), chart.joined(five, x, chart.joined(five, y, z, keys), keys)):
            for r in got.collect():
                assert abs(r["score"] - one[r["id"]]) < 1e-9 and r["right"] == whole[r["id"]]["right"], (cuts, r)


# --- interpolation and tuning by hand


def test_unigrams_are_normalised(spark):
    values = [-0.3, 1.2, -9.8, 4.0, -7.0, 0.0]
    words = ["<unk>", "a", "b", "c", "d", "<s>"]
    m = Model(spark.createDataFrame([(1, w, v, None) for w, v in zip(words, values)], SCHEMA), 1)
    got = {r["ngram"]: r["log10_prob"] for r in interpolate.interpolated([m], [1.0]).rows.collect()}
    z = math.log10(sum(10**v for v in values[:-1]))
    assert all(abs(got[w] - min(0.0, v - z)) < 1e-9 for w, v in zip(words[:-1], values))


def test_interpolation_by_brute_force(spark):
    """Every probability and back-off of two trigram models' product, from the definition: the sum over all words after each context."""
    rng = np.random.default_rng(3)
    words = ["<unk>", "a", "b", "c", "</s>"]

    def random_model(k):
        rows = [(1, w, -float(rng.uniform(0.2, 2)), -float(rng.uniform(0, 0.5))) for w in words] + [(1, "<s>", -99.0, -0.3)]
        two = [f"{x} {y}" for x in ["<s>", "a", "b", "c"] for y in words if rng.random() < 0.5]
        three = [f"{g} {y}" for g in two if not g.endswith("</s>") for y in words if rng.random() < 0.4]
        rows += [(2, g, -float(rng.uniform(0.1, 1.5)), -float(rng.uniform(0, 0.4))) for g in two] + [(3, g, -float(rng.uniform(0.1, 1)), None) for g in three]
        return rows

    tables = [random_model(k) for k in range(2)]
    models = [Model(spark.createDataFrame(t, SCHEMA), 3) for t in tables]
    weights = (0.7, 0.5)
    entry = [{g: (p, b or 0.0) for _, g, p, b in t} for t in tables]

    def lp(m, context, w):
        while context and " ".join([*context, w]) not in entry[m]:
            return entry[m].get(" ".join(context), (0, 0.0))[1] + lp(m, context[1:], w)
        return entry[m][" ".join([*context, w])][0]

    def raw(context, w):
        return sum(k * lp(m, context, w) for m, k in enumerate(weights))

    def wanted(context, w):
        return raw(context, w) - math.log10(sum(10 ** raw(context, x) for x in words))

    rows = {r["ngram"]: r for r in interpolate.interpolated(models, weights).rows.collect()}
    closed = {g for t in tables for _, g, _, _ in t}
    for g in closed:
        w = g.split()
        if w[-1] != "<s>":
            assert abs(rows[g]["log10_prob"] - min(0.0, wanted(w[:-1], w[-1]))) < 1e-9 or len(w) == 3 and abs(rows[g]["log10_prob"] - wanted(w[:-1], w[-1])) < 1e-9, g

    def backed(context, w):
        if (" ".join([*context, w])) in rows or not context:
            return rows[" ".join([*context, w])]["log10_prob"]
        c = rows.get(" ".join(context))
        return (c["log10_backoff"] if c is not None else 0.0) + backed(context[1:], w)

    for context in (["a"], ["b"], ["<s>"], ["a", "b"], ["<s>", "a"], ["b", "c"], ["c", "c"]):
        if " ".join(context) in rows:
            for w in words:
                assert abs(backed(context, w) - wanted(context, w)) < 1e-6, (context, w)


def test_derivatives_by_hand(spark):
    """Three words and <s>, two models, one context; one extension each, as sums written out."""
    u = np.log([[0.1, 0.6], [0.4, 0.3], [0.5, 0.1]])
    b, lam = np.log([0.2, 0.4]), np.array([0.9, 1.2])
    x = u + b
    x[1, 1], x[2, 0] = math.log(1 - 0.6 * 0.4 - 0.1 * 0.4), math.log(1 - 0.1 * 0.2 - 0.4 * 0.2)
    names = ["v0", "v1", "v2"]
    uni = spark.createDataFrame([(n, float(r[0]), float(r[1])) for n, r in zip(names, u)] + [("<s>", 0.0, 0.0)], "word string, u_0 double, u_1 double")
    ctx = spark.createDataFrame([("c", 1, float(b[0]), float(b[1]))], "context string, n bigint, b_0 double, b_1 double")
    ext = spark.createDataFrame([("c", names[k], float(x[k, 0]), float(x[k, 1]), float(u[k, 0]), float(u[k, 1])) for k in (1, 2)], "context string, word string, x_0 double, x_1 double, u_0 double, u_1 double")
    right = spark.createDataFrame([("c", float(x[1, 0]), float(x[1, 1]))], "context string, c_0 double, c_1 double")
    r = tune.derivatives({"unigrams": uni, "contexts": ctx, "extensions": ext, "correct": right}, lam.tolist()).first()
    p = np.exp(x @ lam)
    p, z = p / p.sum(), math.log(p.sum())
    mean = p @ x
    h = (x * p[:, None]).T @ x - np.outer(mean, mean)
    assert np.allclose([r["g_0"], r["g_1"]], mean - x[1]) and np.allclose([r["h_0_0"], r["h_0_1"], r["h_1_1"]], [h[0, 0], h[0, 1], h[1, 1]])
    assert abs(math.log(r["perplexity"]) - (z - lam @ x[1])) < 1e-9


def test_tuning_instances_of_two_toys(spark):
    from quillspark.operators import estimate as E

    toys = [E.estimate(spark.createDataFrame([(t,)], "text string"), order=3) for t in ("a a b a\nb a a b", "a a b b b b b b b\nc")]
    lines = score.lines_of(spark.createDataFrame([(0, "c")], "id int, text string"), keep=["id"])
    t = tune.tables(toys, lines, ["id", "line"])
    ln = math.log(10)
    ctx = {r["context"]: r for r in t["contexts"].collect()}
    assert len(ctx) == 2
    begin, after = ctx["<s>"], ctx["<s> c"]
    assert abs(begin["b_0"] / ln + 0.30103) < 1e-5 and abs(begin["b_1"] / ln + 0.30103) < 1e-5 and abs(after["b_0"]) < 1e-9 and abs(after["b_1"] / ln + 0.60206) < 1e-5
    ext = {(r["context"], r["word"]): r for r in t["extensions"].collect()}
    want = {("<s>", "a"): (-0.37712017, -0.4301247), ("<s>", "c"): (None, -0.4740302), ("<s>", "b"): (-0.41574955, None), ("<s> c", "</s>"): (None, -0.09113217)}
    for k, v in want.items():
        for m, p in enumerate(v):
            if p is not None:
                assert abs(ext[k][f"x_{m}"] / ln - p) < 1e-5
    assert set(ext) == set(want)
