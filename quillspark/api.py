"""A model to call from Python for a few sentences at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from quillspark.functions import text as T
from quillspark.operators.chart import LocalModel, State
from quillspark.operators.model import Model


class LanguageModel:
    """Scores of sentences; ``path`` is an ARPA file (compressed or not) or a stored model."""

    def __init__(self, path: str, spark: SparkSession | None = None, model: Model | None = None):
        from quillspark.sources import arpa, store

        self.path = path
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        if model is None:
            model = store.read(spark, path) if store.is_stored(spark, path) else arpa.read(spark, path)
        self.local = LocalModel(model)

    @classmethod
    def of(cls, model: Model) -> LanguageModel:
        return cls("", model.rows.sparkSession, model)

    def __reduce__(self):  # type: ignore[no-untyped-def]
        return (LanguageModel, (self.path,))

    @property
    def order(self) -> int:
        return self.local.order

    def __contains__(self, word: str) -> bool:
        return word in self.local

    def __repr__(self) -> str:
        return f"<LanguageModel from {self.path or 'memory'}>"

    def full_scores(self, sentence: str, bos: bool = True, eos: bool = True) -> Iterator[tuple[float, int, bool]]:
        """(log10 probability, length of the match, whether out of the vocabulary) of each word and the end."""
        state = self.local.begin() if bos else self.local.null()
        for w in [*sentence.split(), *([T.EOS] if eos else [])]:
            s, state = self.local.full(state, w)
            yield s.log10_prob, s.ngram_length, s.oov

    def score(self, sentence: str, bos: bool = True, eos: bool = True) -> float:
        return sum(p for p, _, _ in self.full_scores(sentence, bos, eos))

    def perplexity(self, sentence: str) -> float:
        return 10.0 ** (-self.score(sentence) / (len(sentence.split()) + 1))

    def begin_sentence(self) -> State:
        return self.local.begin()

    def null_context(self) -> State:
        return self.local.null()

    def base_score(self, state: State, word: str) -> tuple[float, State]:
        s, after = self.local.full(state, word)
        return s.log10_prob, after

    def base_full_score(self, state: State, word: str):  # type: ignore[no-untyped-def]
        return self.local.full(state, word)
