"""Scores of fragments that are joined in any order: of tables of fragments by ``fragments`` and ``joined``, of single ones on a model held in memory by ``Rule``."""

from __future__ import annotations

from dataclasses import dataclass, field

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.model import Model


@dataclass(frozen=True)
class State:
    """The most recent words that can matter to what follows."""

    words: tuple[str, ...] = ()

    def __lt__(self, other: State) -> bool:
        return (len(self.words), self.words) < (len(other.words), other.words)


@dataclass(frozen=True)
class FullScore:
    log10_prob: float
    ngram_length: int
    oov: bool
    independent_left: bool


class LocalModel:
    """A closed model as dictionaries on one machine. ``most`` bounds the entries that are collected; beyond it, score by DataFrames."""

    def __init__(self, model: Model, most: int = 5_000_000, unknown: float = -100.0):
        rows = model.with_unk(unknown).rows
        model = Model(rows, model.order)
        got = model.closed().limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"over {most} entries: score DataFrames instead")
        self.order = model.order
        self.entry = {r["ngram"]: (r["log10_prob"], r["log10_backoff"], r["extends_left"], r["has_extension"]) for r in got}
        self.rest: dict[str, float] = {}

    def __contains__(self, word: str) -> bool:
        return word != T.UNK and word in self.entry

    def begin(self) -> State:
        return State((T.BOS,))

    def null(self) -> State:
        return State()

    def mapped(self, word: str) -> str:
        return word if word in self.entry and " " not in word else T.UNK

    def full(self, state: State, word: str) -> tuple[FullScore, State]:
        """Score of a word after a state, and the state after it."""
        w = self.mapped(word)
        history = state.words[max(0, len(state.words) - self.order + 1) :]
        n = 0
        while n < len(history) and " ".join((*history[len(history) - n - 1 :], w)) in self.entry:
            n += 1
        key = " ".join((*history[len(history) - n :], w)) if n else w
        p, _, left, _ = self.entry[key]
        for k in range(n + 1, len(history) + 1):
            p += self.entry.get(" ".join(history[len(history) - k :]), (0, 0.0))[1]
        whole = (*history, w)
        keep = 0
        for k in range(1, min(n + 1, self.order - 1) + 1):
            if self.entry[" ".join(whole[len(whole) - k :])][3]:
                keep = k
        return FullScore(p, n + 1, w == T.UNK, not left or len(history) > n or n + 1 == self.order), State(whole[len(whole) - keep :] if keep else ())

    def full_forgot_state(self, context: list[str], word: str) -> tuple[FullScore, State]:
        """The same from the words before, in their order, instead of a state."""
        return self.full(self.state_of(context), word)

    def state_of(self, context: list[str]) -> State:
        """The state after the given words."""
        words = tuple(self.mapped(w) if w != T.BOS else w for w in context)[-(self.order - 1) :] if self.order > 1 else ()
        keep = 0
        for k in range(1, len(words) + 1):
            e = self.entry.get(" ".join(words[len(words) - k :]))
            if e is None:
                break
            if e[3]:
                keep = k
        return State(words[len(words) - keep :] if keep else ())


@dataclass
class Fragment:
    """What joining needs of a fragment: the words whose score may change by what comes before, and the state after it."""

    left: tuple[str, ...] = ()
    right: State = State()
    full: bool = False
    words: int = 0


@dataclass
class Rule:
    """Scores a concatenation of words and fragments from left to right; fragments joined in another order give the same."""

    model: LocalModel
    fragment: Fragment = field(default_factory=Fragment)
    prob: float = 0.0

    def begin_sentence(self) -> None:
        self.fragment = Fragment((), self.model.begin(), True, 0)

    def terminal(self, word: str) -> None:
        s, state = self.model.full(self.fragment.right, word)
        self.prob += s.log10_prob
        f = self.fragment
        left = f.left
        closed = f.full
        if not closed:
            if len(left) < self.model.order - 1:
                left = (*left, self.model.mapped(word))
            closed = s.independent_left or len(left) >= self.model.order - 1
        self.fragment = Fragment(left, state, closed, f.words + 1)

    def begin_non_terminal(self, other: Fragment, prob: float) -> None:
        self.fragment, self.prob = Fragment(other.left, other.right, other.full, other.words), prob

    def non_terminal(self, other: Fragment, prob: float) -> None:
        """Join a fragment scored without context: the words at its left are scored again after what is here."""
        self.prob += prob + reveal_before(self.model, self.fragment.right, other)
        f = self.fragment
        state = f.right
        if other.full:
            right = other.right
        else:  # all of its words are in its left, so the state goes through them
            for w in other.left:
                _, state = self.model.full(state, w)
            right = state
        left, closed = f.left, f.full
        if not closed:
            left = (f.left + other.left)[: self.model.order - 1]
            closed = other.full or len(left) >= self.model.order - 1
        self.fragment = Fragment(left, right, closed, f.words + other.words)

    def finish(self) -> float:
        return self.prob


def reveal_before(model: LocalModel, revealed: State, seen: Fragment) -> float:
    """What revealing words before a fragment adds to its score."""
    total, here, alone = 0.0, revealed, State()
    for w in seen.left:
        a, here = model.full(here, w)
        b, alone = model.full(alone, w)
        total += a.log10_prob - b.log10_prob
    return total


def reveal_after(model: LocalModel, left: Fragment, revealed: Fragment) -> float:
    """What a fragment adds to the score of one that comes to stand after it: the same sum from the other side."""
    return reveal_before(model, left.right, revealed)


def subsume(model: LocalModel, first: Fragment, second: Fragment) -> tuple[float, Fragment]:
    """(what joining two fragments adds to their scores, the joint fragment)."""
    r = Rule(model)
    r.begin_non_terminal(first, 0.0)
    r.non_terminal(second, 0.0)
    return r.prob, r.fragment


def score_fragment(model: LocalModel, words: list[str]) -> tuple[float, Fragment]:
    """(score without context, fragment) of some words."""
    r = Rule(model)
    for w in words:
        if w == T.BOS and r.fragment.words == 0 and not r.fragment.full:
            r.begin_sentence()
        else:
            r.terminal(w)
    return r.finish(), r.fragment


def attach_rest(model: LocalModel, rest: DataFrame, most: int = 5_000_000) -> None:
    """Rest costs (order, ngram, log10_prob, rest) for estimates of fragments' left words; at most as many as ``LocalModel`` holds entries."""
    got = rest.select("ngram", "rest").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"over {most} rest costs: keep them as a DataFrame")
    model.rest = {r["ngram"]: r["rest"] for r in got}


def unrest(model: LocalModel, words: tuple[str, ...]) -> float:
    """What the left words' probabilities are over their rest costs, summed."""
    total, history = 0.0, ()
    for w in words:
        history = (*history, w)[-model.order :]
        n = len(history)
        while n > 1 and " ".join(history[-n:]) not in model.entry:
            n -= 1
        g = " ".join(history[-n:])
        total += model.entry[g][0] - model.rest.get(g, model.entry[g][0])
    return total


#: What a table of fragments has besides its keys: the score without context, the words whose scores may change by what comes before, the words that may matter to
#: what follows, and whether nothing before the left words can matter.
FRAGMENT = ("score", "left", "right", "full")


def fragments(model: Model, lines: DataFrame, keys: Sequence[str], ready: DataFrame | None = None) -> DataFrame:
    """(``keys``, score, left, right, full) of each line (``keys``, words); a leading <s> begins a sentence. ``ready``: as in ``score.words``."""
    from quillspark.operators import score as S

    begun = F.coalesce(F.get("words", F.lit(0)) == T.BOS, F.lit(False))
    plain = lines.where(~begun).select(*keys, "words")
    sentences = lines.where(begun).select(*keys, F.slice("words", F.lit(2), F.size("words")).alias("words"))
    out = None
    for rows, bos in ((plain, False), (sentences, True)):
        s = S.words(model, rows, keys, bos=bos, eos=False, ready=ready)
        g = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "word", "log10_prob", "independent_left", "state_length"))).alias("x"))
        x = rows.join(g, list(keys), "left").withColumn("x", F.coalesce("x", F.array().cast(g.schema["x"].dataType)))
        n = F.size("x")
        whole = F.concat(F.array(F.lit(T.BOS)), F.transform("x", lambda r: r["word"])) if bos else F.transform("x", lambda r: r["word"])
        state = F.when(n > 0, F.element_at("x", F.when(n > 0, n).otherwise(1))["state_length"]).otherwise(1 if bos else 0)
        closed = F.array_position(F.transform("x", lambda r: r["independent_left"]), F.lit(True))
        left = F.least(F.lit(model.order - 1), F.when(closed > 0, closed).otherwise(n)).cast("int")
        x = x.select(
            *keys,
            F.aggregate("x", F.lit(0.0), lambda a, r: a + r["log10_prob"]).alias("score"),
            F.array().cast("array<string>").alias("left") if bos else F.slice(F.transform("x", lambda r: r["word"]), F.lit(1), left).alias("left"),
            F.slice(whole, F.size(whole) - state + 1, state).alias("right"),
            F.lit(True).alias("full") if bos else ((closed > 0) | (n >= model.order - 1)).alias("full"),
        )
        out = x if out is None else out.union(x)
    return out


def joined(model: Model, first: DataFrame, second: DataFrame, keys: Sequence[str], ready: DataFrame | None = None) -> DataFrame:
    """Each fragment of ``first`` joined with that of ``second`` with the same ``keys``, as ``fragments`` would score their words together.

    Only the seam is scored: the state of the first, then the left words of the second, which change by it.
    """
    from quillspark.operators import score as S
    from quillspark.operators.durable import cut

    a = first.select(*keys, *[F.col(c).alias(f"a_{c}") for c in FRAGMENT])
    b = second.select(*keys, *[F.col(c).alias(f"b_{c}") for c in FRAGMENT])
    both = cut(a.join(b, list(keys)))
    seam = both.select(*keys, F.lit("seam").alias("__part"), F.concat("a_right", "b_left").alias("words")).union(both.select(*keys, F.lit("alone"), "b_left"))
    s = S.words(model, seam, [*keys, "__part"], bos=False, eos=False, ready=ready)
    row = F.struct("pos", "word", "log10_prob", "state_length")
    g = s.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("__part") == p, row))).alias(p) for p in ("seam", "alone")])
    x = both.join(g, list(keys), "left")
    off = F.size("a_right")
    after = F.aggregate(F.coalesce(F.slice("seam", off + 1, F.greatest(F.size("seam"), F.lit(1))), F.col("alone")), F.lit(0.0), lambda t, r: t + r["log10_prob"])
    before = F.aggregate("alone", F.lit(0.0), lambda t, r: t + r["log10_prob"])
    n = F.size("seam")
    state = F.element_at("seam", F.when(n > 0, n).otherwise(1))["state_length"]
    through = F.when(n > 0, F.slice(F.concat("a_right", "b_left"), n - state + 1, state)).otherwise(F.col("a_right"))
    left = F.slice(F.concat("a_left", "b_left"), 1, model.order - 1)
    return x.select(
        *keys,
        (F.col("a_score") + F.col("b_score") + F.coalesce(after - before, F.lit(0.0))).alias("score"),
        F.when(F.col("a_full"), F.col("a_left")).otherwise(left).alias("left"),
        F.when(F.col("b_full"), F.col("b_right")).otherwise(through).alias("right"),
        (F.col("a_full") | F.col("b_full") | (F.size(left) >= model.order - 1)).alias("full"),
    )
