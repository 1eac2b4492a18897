"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, are trained from labels of whole documents.

*Model.* A sentence ends at ``.``, ``!``, ``?`` or a line feed. Its probability comes from the sum of the weights of its
distinct features (hashed to ``2**bits``): its words (runs of ASCII letters, digits and non-ASCII bytes without ASCII case) and their
first 4, 5 and 6 bytes, so that inflected forms of a stem share what is learnt. It is what a logistic function of the sum adds to that of no
evidence at all, ``1 - p = (1 - f(z + bias)) / (1 - f(bias))``, so a sentence without evidence has ``p = 0`` exactly, and a text isn't toxic for being long. A document is toxic
by a leaky noisy-or, ``P = 1 - (1 - leak) prod(1 - p)``: the leak is what a document may be without a sentence that shows it, once a document, not once a sentence. Training and
scoring use the same ``P``; many sentences of little evidence each add up in both. The loss of ``P`` reaches each sentence in proportion to its share of the
blame, which is what tells the offending sentences from their neighbours. Weights are not negative and shrink towards zero (an L1
step), features of fewer than ``min_docs`` sampled documents have none; so words that merely accompany labels gather no weight.

*Training.* On a sample of ``max_rows`` labelled documents at most (the least hashes of the ids that have a text). Of a text of more than ``max_chars`` characters an excerpt of that
length trains, from a hashed place in it. A fifth is held out to choose below which weight features have none (the most that costs no F1 worth mentioning), and to set the threshold of ``P`` that has the best F1, in the middle of the gap that it leaves. All documents are scored whole.

*Result.* For each document whose ``P`` reaches the threshold, a row for each sentence that reaches it alone; where none does, for each whose ``p`` is at least ``sentence_share`` of the
worst: number, byte range, text, and the two scores.

*Odd input.* Null, empty and wordless texts are clean. Texts of any length are scored whole. Null labels, ids or texts don't train; several labels of an id train it as
toxic if any is. Of equal scores, all count alike: ties reach the threshold together. Without labels of both kinds nothing is flagged. Rows without an id have no result, repeated rows are
each scored, ids of any type come back as they are. An empty table gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import column, slots
from quillspark.llm.textarrays import NONWORD, flat, mix, words

STEMS = (4, 5, 6)
STOPS = np.zeros(256, bool)
STOPS[[10, 33, 46, 63]] = True
FOUND = "doc_score double, sentence int, start_byte bigint, end_byte bigint, sentence_score double, sentence_text string"


def sentences(data: np.ndarray, off: np.ndarray, woff: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each word, document of each sentence, start, end) for sentences that have words; bytes from the first row's start."""
    stop = np.flatnonzero(STOPS[data])
    row = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    part = np.searchsorted(stop, starts)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
    b = np.flatnonzero(new)
    doc = row[b]
    end = np.minimum(np.concatenate([stop, [len(data)]])[part[b]] + 1, off[doc + 1])
    return np.cumsum(new) - 1, doc, starts[b], end


def features(data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature) of words and their beginnings."""
    which, out = [np.arange(len(h))], [h]
    code, done = np.zeros(len(h), np.uint64), 0
    for n in STEMS:
        long = ends - starts > n
        for k in range(done, n):
            b = data[np.minimum(starts + k, len(data) - 1)]
            code |= np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64) << np.uint64(8 * k)
        done = n
        which.append(np.flatnonzero(long)), out.append(mix(code[long] ^ np.uint64(n << 56)))
    return np.concatenate(which), (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float
    bits: int
    leak: float = 0.01

    def evidence(self, word: np.ndarray, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """-log(1 - p) of each sentence, each distinct feature counted once."""
        at = np.flatnonzero(self.weights[feature] != 0)  # most have none
        pair = np.unique((sentence[word[at]] << self.bits) + feature[at])
        z = np.bincount(pair >> self.bits, self.weights[pair & ((1 << self.bits) - 1)], n) if len(pair) else np.zeros(n)
        return softplus(z + self.bias) - softplus(np.float64(self.bias))


def noisy_or(evidence: np.ndarray, doc: np.ndarray, n: int, leak: float = 0.0) -> np.ndarray:
    """Probability that each document is toxic, from -log(1 - p) of its sentences; one without sentences has the leak alone."""
    return 1 - (1 - leak) * np.exp(-np.bincount(doc, evidence, n) if len(doc) else np.zeros(n))


def train(texts: list[str], labels: list[int], bits: int = 20, epochs: int = 16, rate: float = 3.0, shrink: float = 1e-4, min_docs: int = 3, leak: float = 0.01, seed: int = 8) -> Model:
    """Fit to labelled documents, a fifth held out for the threshold."""
    y = np.array(labels, float)
    model = Model(np.zeros(1 << bits), -6.0, 2.0, bits, leak)
    if len(set(labels)) < 2:
        return model
    rng = np.random.Generator(np.random.PCG64(seed))
    bags: list[tuple[np.ndarray, np.ndarray, int]] = []
    for t in texts:
        a = pa.array([t])
        data, off = flat(a)
        hs, ss = [], []
        n = 0
        for _, _, h, woff, s, e in words(a, fold=True, gap=NONWORD):
            sent, doc, _, _ = sentences(data, off, woff, s)
            word, feature = features(data, h, s, e, bits)
            pair = np.unique((sent[word] << bits) + feature)
            hs.append(pair & ((1 << bits) - 1)), ss.append(pair >> bits)
            n = len(doc)
        bags.append((np.concatenate(hs) if hs else np.zeros(0, np.int64), np.concatenate(ss) if ss else np.zeros(0, np.int64), n))
    order = rng.permutation(len(texts))
    held, fit_rows = order[: len(texts) // 5], order[len(texts) // 5 :]
    df = np.zeros(1 << bits, np.int32)
    for i in fit_rows:
        df[np.unique(bags[i][0])] += 1
    allowed = df >= min_docs
    squares = np.full(1 << bits, 1e-8)
    # an even start: the rate of toxic documents spread over the sentences of a usual one
    usual = max(1.0, float(np.mean([b[2] for b in bags])))
    model.bias = float(np.log(max(y.mean(), 1e-3) / usual * 0.1))

    def batch(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first = np.concatenate([[0], np.cumsum([bags[i][2] for i in rows])])
        k = np.concatenate([bags[i][0] for i in rows])
        s = np.concatenate([bags[i][1] + first[j] for j, i in enumerate(rows)])
        keep = allowed[k]
        return k[keep], s[keep], np.repeat(np.arange(len(rows)), np.diff(first)), first

    for epoch in range(epochs):
        order = rng.permutation(fit_rows)
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            k, s, doc, first = batch(rows)
            if not len(k):
                continue
            z = np.bincount(s, model.weights[k], len(doc)) + model.bias
            whole = noisy_or(softplus(z) - softplus(np.float64(model.bias)), doc, len(rows), leak)
            # of the log loss: f(z) for a clean document, -(1 - P) / P * f(z) for a toxic one
            blame = np.where(y[rows] > 0, -(1 - whole) / np.maximum(whole, 1e-9), 1.0)[doc] * (1 / (1 + np.exp(-np.clip(z, -40, 40)))) / len(rows)
            ids, which = np.unique(k, return_inverse=True)
            grad = np.bincount(which, blame[s], len(ids))
            squares[ids] += grad * grad
            step = rate / np.sqrt(squares[ids])
            model.weights[ids] = np.maximum(model.weights[ids] - step * (grad + shrink), 0)
    rows = held if len(held) and 0 < y[held].sum() < len(held) else order
    k, s, doc, first = batch(rows)

    def best(weights: np.ndarray) -> tuple[float, float]:
        """(F1, threshold): the best F1, in the middle between its last toxic score and the next lower one."""
        p = noisy_or(softplus(np.bincount(s, weights[k], len(doc)) + model.bias) - softplus(np.float64(model.bias)), doc, len(rows), leak)
        ranked = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[rows][ranked])
        f1 = 2 * hits / (np.arange(1, len(rows) + 1) + y[rows].sum())
        at = int(np.argmax(f1))
        lower = p[ranked[at + 1]] if at + 1 < len(rows) else leak
        # what has no evidence is clean, however common toxic documents are
        return float(f1[at]), float(max((p[ranked[at]] + lower) / 2, leak + 1e-6))

    # words that hardly weigh go, as far as the held-out documents allow: in a long text they would add up
    tried = [(best(np.where(model.weights >= level, model.weights, 0.0)), level) for level in (0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0)]
    (_, model.threshold), level = [x for x in tried if x[0][0] >= max(f1 for (f1, _), _ in tried) - 0.005][-1]
    model.weights[model.weights < level] = 0
    return model


def excerpt(text: Column, key: Column, most: int) -> Column:
    """The text, or ``most`` characters of it from a place that depends on ``key`` and its length."""
    n = F.length(text)
    return F.when(n <= most, text).otherwise(F.substring(text, (F.pmod(F.xxhash64(key, n), n - most + 1) + 1).cast("int"), F.lit(most)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", max_rows: int = 6000, max_chars: int = 20_000, **options) -> Model:
    """A model of the labels; at most ``2 * max_rows`` sampled ids (that bound makes them fit for a broadcast) are looked up in ``docs``, and ``max_rows`` of those that have a text train."""
    l = labels.select(column(labels, label_id).alias("i"), column(labels, label).cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))  # noqa: E741
    h = slots("i", F.lit(8))
    total = l.count()
    share = min(1.0, 2.5 * max_rows / max(1, total))
    l = l.where(h <= min((1 << 63) - 1, int(share * (1 << 63)))).orderBy(h, "i").limit(2 * max_rows)  # noqa: E741
    d = docs.select(column(docs, doc_id).alias("i"), column(docs, text).alias("t")).where("i is not null and t is not null")
    rows = d.join(F.broadcast(l), "i").select(h.alias("h"), excerpt(F.col("t"), F.col("i"), max_chars).alias("t"), "y").orderBy("h", "t").limit(max_rows).select("t", "y").collect()
    return train([r["t"] for r in rows], [int(r["y"] > 0) for r in rows], **options)


def offending(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", sentence_share: float = 0.5) -> DataFrame:
    """The offending sentences of toxic documents; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(1))
            for i, j, h, woff, starts, ends in words(b.column(1), fold=True, gap=NONWORD):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                sent, doc, s, e = sentences(d, o, woff, starts)
                if not len(doc):
                    continue
                evidence = model.evidence(*features(d, h, starts, ends, model.bits), sent, len(doc))
                p, whole = 1 - np.exp(-evidence), noisy_or(evidence, doc, j - i, model.leak)
                worst = np.zeros(j - i)
                np.maximum.at(worst, doc, p)
                alone = 1 - (1 - model.leak) * (1 - p) >= model.threshold
                any_ = np.bincount(doc[alone], minlength=j - i) > 0
                first = np.searchsorted(doc, np.arange(j - i))
                at = np.flatnonzero((whole[doc] >= model.threshold) & np.where(any_[doc], alone, (p > 0) & (p >= sentence_share * worst[doc])))
                if not len(at):
                    continue
                body = bytes(d)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(doc[at])), pa.array(np.round(whole[doc[at]], 6)), pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(s[at] - o[doc[at]]), pa.array(e[at] - o[doc[at]]), pa.array(np.round(p[at], 6)), pa.array([body[x:y].decode(errors="replace") for x, y in zip(s[at], e[at])])],
                    ["doc_id", "doc_score", "sentence", "start_byte", "end_byte", "sentence_score", "sentence_text"],
                )

    d = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("t")).where("doc_id is not null and t is not null")
    kind = d.schema["doc_id"]
    return d.mapInArrow(run, T.StructType([kind, *T._parse_datatype_string(FOUND).fields]))
