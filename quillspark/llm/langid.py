"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

*Model.* A text's features are its byte n-grams (``ORDERS``) with ASCII letters folded and spaces kept, hashed to ``buckets`` rows of
an embedding table. Their mean goes through a linear layer to a softmax over the languages. The embeddings start at zero: n-grams that
training never saw pull the mean towards zero and the softmax towards even odds. For scoring, table and layer are multiplied
out once, so a text costs one gather an n-gram.

*Training.* On a sample of ``max_rows`` labelled rows at most: the least hashes of the ids of each language, ``min_rows`` of it or as many as it has (fewer if there are so many
languages that these alone would exceed the sample), and the rest in proportion to the languages. Of a text of more than ``max_chars`` characters an excerpt of that
length trains, from a hashed place in it. A fifth is held out. Whatever is scored is scored whole.

*Rejection.* A text is rejected if its share of n-grams that training has seen is under half of what all but ``max_loss`` of the held-out texts
have: it is in no language that was learnt. The temperature that minimises the log loss of ``piece``-byte pieces of the held-out texts calibrates the probabilities
(whole texts of a few languages are told apart so well that they would fit any temperature); as the mean of n n-grams is surer than that of
the m in a piece, a longer text's logits are multiplied by sqrt(n / m). A text is rejected too if its best
probability is under the threshold: the least one for which held-out accuracy reaches ``target`` and at least ``floor`` (under a half
no language is likelier than not), but no more than rejects ``max_loss`` of the held-out texts that are classified right.

*Odd input.* Null and empty texts, and those without any n-gram, are rejected: language null, confidence 0. Rows without a label,
text or id don't train. If no language can be trained (an empty table), every row is rejected. Repeated rows are each scored. Of languages that are equally probable the
first in the order of their names is taken. Texts of any length are scored whole. Ids of any type will do. Extra columns stay as they are, whatever their names; columns named like the
added ones are replaced. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import column, extended, slots
from quillspark.llm.textarrays import BLOCK, SPACES, flat, runs
from quillspark.llm.toxicity import excerpt

ORDERS = (2, 3, 4)
_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[65:91] += 32
_PLAIN[SPACES] = 32


def grams(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte."""
    x = _PLAIN[data]
    n = len(x) - order + 1
    code = x[:n].copy()
    for k in range(1, order):
        code |= x[k : k + n] << np.uint32(8 * k)
    with np.errstate(over="ignore"):
        code *= np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519 + 2 * order)
    return code >> np.uint32(32 - bits)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: what each n-gram adds to the mean logits; then whether training saw it
    temperature: float
    threshold: float
    bits: int
    least_known: float = 0.0
    piece_grams: float = 1.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean logits, share of known n-grams and number of n-grams of each text."""
        data, off = flat(texts)
        z, n = np.zeros((len(off) - 1, len(self.languages) + 1)), np.zeros(len(off) - 1)
        for i, j in runs(off):
            for order in ORDERS:
                lo, hi = off[i:j], np.maximum(off[i + 1 : j + 1] - order + 1, off[i:j])
                n[i:j] += hi - lo
                # blocks, each with the bytes that its last n-grams reach into
                for a in range(int(off[i]), int(off[j]), BLOCK):
                    b = min(a + BLOCK, int(off[j]))
                    part = data[a : min(b + order - 1, int(off[j]))]
                    if len(part) < order:
                        continue
                    g = grams(part, order, self.bits)
                    total = np.zeros((len(g) + 1, z.shape[1]))
                    np.cumsum(self.table[g], axis=0, dtype=np.float64, out=total[1:])
                    z[i:j] += total[np.clip(hi - a, 0, len(g))] - total[np.clip(lo - a, 0, len(g))]
        z /= np.maximum(n, 1)[:, None]
        return z[:, :-1], z[:, -1], n

    def probabilities(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of texts of n n-grams."""
        return softmax(z * np.sqrt(np.maximum(1, n / self.piece_grams))[:, None] / self.temperature)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability, whether it is accepted) of each text."""
        if not self.languages:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
        z, known, n = self.logits(texts)
        p = self.probabilities(z, n)
        best = p.argmax(1)
        top = np.where(n > 0, p[np.arange(len(p)), best], 0.0)
        return best, top, (n > 0) & (top >= self.threshold) & (known >= self.least_known)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], bits: int = 18, width: int = 16, epochs: int = 6, rate: float = 1.0, target: float = 0.99, floor: float = 0.5, max_loss: float = 0.001, piece: int = 24, seed: int = 10) -> Model:
    """Fit to labelled texts, every fifth held out for calibration."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << bits, 1), np.float32), 1.0, 1.0, bits)
    rng = np.random.Generator(np.random.PCG64(seed))
    y = np.array([languages.index(x) for x in labels])
    bags = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        g = np.concatenate([grams(data, o, bits) for o in ORDERS if len(data) >= o] or [np.zeros(0, np.uint32)])
        ids, count = np.unique(g, return_counts=True)
        bags.append((ids.astype(np.int64), (count / max(1, count.sum())).astype(np.float32)))
    shuffled = rng.permutation(len(texts))
    held = shuffled[: len(texts) // 5]
    fit = shuffled[len(texts) // 5 :]
    table = np.zeros((1 << bits, width), np.float32)
    layer = rng.normal(0, 1 / np.sqrt(width), (width, len(languages))).astype(np.float32)
    squares = np.full(1 << bits, 1e-6, np.float32)  # of each row's gradients, for its step size
    steps, done = epochs * max(1, len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, w = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            mean = w @ table[ids]
            p = softmax((mean @ layer)[None])[0]
            p[y[i]] -= 1
            back = layer @ p
            layer -= 0.05 * lr * np.outer(mean, p)
            size = w * w * float(back @ back)
            squares[ids] += size
            table[ids] -= (lr * w / np.sqrt(squares[ids]))[:, None] * back
    model = Model(languages, np.hstack([table @ layer, (squares > 1e-6)[:, None]]).astype(np.float32), 1.0, floor, bits)
    if len(held):
        pieces, of = [], []
        for i in held:
            data = texts[i].encode()
            at = int(rng.integers(0, max(1, len(data) - piece)))
            pieces.append(data[at : at + piece].decode(errors="ignore")), of.append(y[i])
        zp, _, n = model.logits(pa.array(pieces))
        zp, of = zp[n > 0], np.array(of)[n > 0]
        if len(of):
            scales = np.exp(np.linspace(np.log(0.01), np.log(100), 200))
            loss = [-np.log(np.maximum(softmax(zp / t)[np.arange(len(of)), of], 1e-12)).mean() for t in scales]
            model.temperature = float(scales[int(np.argmin(loss))])
            model.piece_grams = float(np.median(n[n > 0]))
        z, known, n = model.logits(pa.array([texts[i] for i in held]))
        if (n > 0).any():
            model.least_known = float(np.quantile(known[n > 0], max_loss)) / 2
        p = model.probabilities(z, n)
        top, right = p.max(1), p.argmax(1) == y[held]
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= target)
        need = top[order][good[-1]] if len(good) else 1.0
        model.threshold = float(max(floor, min(need, np.quantile(top[right], max_loss)))) if right.any() else floor
        if len(good) == 0 or good[-1] == len(order) - 1:
            model.threshold = max(floor, model.threshold if len(good) == 0 else floor)
    return model


def quotas(counts: dict[str, int], max_rows: int, min_rows: int) -> dict[str, int]:
    """Rows of each language in the sample: ``min_rows`` or all it has, then in proportion to what is left."""
    if len(counts) > max_rows:  # not even one each: the commonest
        counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:max_rows])
    least = min(min_rows, max_rows // max(1, len(counts)))
    out = {k: min(n, least) for k, n in counts.items()}
    more = {k: n - out[k] for k, n in counts.items()}
    room = min(max_rows - sum(out.values()), sum(more.values()))
    return {k: n + more[k] * room // max(1, sum(more.values())) for k, n in out.items()}


def sample(docs: DataFrame, doc_id: str, text: str, label: str, max_rows: int, max_chars: int, min_rows: int) -> tuple[list[str], list[str]]:
    """At most ``max_rows`` labelled rows, the least hashes of the ids in each language; see the module."""
    d = docs.select(column(docs, doc_id).alias("i"), column(docs, text).alias("t"), column(docs, label).cast("string").alias("l")).where("i is not null and t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    # hashes are even, so a share of their range holds about that share of the rows; half as many again are looked at
    wanted = [(k, q, min((1 << 63) - 1, int((1.5 * q + 50) / counts[k] * (1 << 63)))) for k, q in quotas(counts, max_rows, min_rows).items()]
    plan = docs.sparkSession.createDataFrame(wanted, "l string, quota bigint, most bigint")  # at most max_rows languages
    few = d.join(F.broadcast(plan), "l").withColumn("h", slots("i", F.lit(10))).where("h <= most").select("h", "l", "quota", excerpt(F.col("t"), F.col("i"), max_chars).alias("t"))
    rows = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where("r <= quota").orderBy("h", "t", "l").select("t", "l").collect()
    return [r["t"] for r in rows], [r["l"] for r in rows]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", max_rows: int = 3000, max_chars: int = 20_000, min_rows: int = 50, **options) -> Model:
    """A model of the labels in ``docs``; see the module for the sample."""
    return train(*sample(docs, doc_id, text, label, max_rows, max_chars, min_rows), **options)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``predicted_lang`` (null if rejected), ``confidence`` (rounded to 6 places) and ``accepted``."""
    added = ("predicted_lang", "confidence", "accepted")
    d = docs.select(*[column(docs, c) for c in docs.columns if c not in added])
    at = d.columns.index(text)
    names = np.array([*model.languages, ""], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, top, ok = model.predict(b.column(at))
            lang = pa.array([names[k] if o else None for k, o in zip(best, ok)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, pa.array(np.round(top, 6)), pa.array(ok)], [*b.schema.names, *added])

    kinds = zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()))
    return extended(d, run, [T.StructField(c, k) for c, k in kinds])
