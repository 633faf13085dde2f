"""Quality classifier: supervised subword embeddings.

A word's features are hashed: the word itself and its character n-grams, and one feature for
each word that repeats the word before it. Each feature has a learned vector; a document is the
average of its features' vectors, put through a linear layer and a softmax. Both layers are
trained by stochastic gradient descent in numpy, over a bounded sample of labelled rows.

When scoring, the linear layer's output for an average is the average of its outputs, so the
model travels as one number a feature and a word costs one look-up.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import is_held_out, sample

REPEAT = "\x00repeat"


def features(word: str, buckets: int, shortest: int, longest: int) -> list[int]:
    marked = f"<{word}>"
    grams = [word]
    for n in range(shortest, longest + 1):
        grams += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return [xxhash.xxh3_64_intdigest(g) % buckets for g in grams]


def _counts(buckets: int, shortest: int, longest: int):
    """Distinct features of a text and how often each occurs, as two arrays' bytes."""

    @F.pandas_udf("ids binary, counts binary")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in texts:
            out = []
            for text in batch:
                words = text.split()
                all_ids: list[int] = []
                for w in words:
                    if (f := known.get(w)) is None:
                        if len(known) > 100_000:
                            known.clear()
                        f = known[w] = features(w, buckets, shortest, longest)
                    all_ids += f
                again = sum(map(operator.eq, words, words[1:]))
                all_ids += [xxhash.xxh3_64_intdigest(REPEAT) % buckets] * again
                ids, counts = np.unique(np.array(all_ids, dtype=np.int32), return_counts=True)
                out.append((ids.tobytes(), counts.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["ids", "counts"])

    return count


@dataclass
class Model:
    weight: np.ndarray  # a feature's vector times the difference of the two output rows
    bias: float
    buckets: int
    shortest: int
    longest: int


def train(rows: list[tuple[np.ndarray, np.ndarray, int, float]], *, buckets: int, shortest: int, longest: int, dim: int = 10, epochs: int = 12, rate: float = 0.4, seed: int = 11) -> Model:
    """rows: distinct feature ids, their counts, the label and the row's weight."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((2, dim), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    mean = np.mean([w for *_, w in rows]) if rows else 1.0
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, counts, label, weight = rows[i]
            lr = rate * (1 - step / steps) * min(4.0, weight / mean)
            step += 1
            share = counts / max(1.0, counts.sum())
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            vectors[ids] -= (lr * len(ids) ** 0.5) * np.outer(share, back)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]), buckets, shortest, longest)


class _Grams(dict):
    """Weights of character n-grams, of which there are few; starts anew when it has `limit` entries."""

    def __init__(self, weight: np.ndarray, limit: int = 200_000):
        super().__init__()
        self.weight, self.limit = weight, limit

    def __missing__(self, gram: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        w = self[gram] = float(self.weight[xxhash.xxh3_64_intdigest(gram) % len(self.weight)])
        return w


class _Worth(dict):
    """Of a word: the sum of its features' weights (see `features`), and as the imaginary part how many it has."""

    def __init__(self, weight: np.ndarray, shortest: int, longest: int, limit: int = 300_000):
        super().__init__()
        self.weight, self.limit = weight, limit
        self.sizes, self.grams = range(shortest, longest + 1), _Grams(weight)

    def __missing__(self, word: str) -> complex:
        if len(self) >= self.limit:
            self.clear()
        marked = f"<{word}>"
        size = len(marked)
        grams = [marked[i : i + n] for n in self.sizes for i in range(size - n + 1)]
        own = float(self.weight[xxhash.xxh3_64_intdigest(word) % len(self.weight)])
        value = self[word] = complex(own + sum(map(self.grams.__getitem__, grams)), 1 + len(grams))
        return value


def _scorer(shared):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias, shortest, longest = shared.value
        worth = _Worth(weight, shortest, longest)
        repeat = float(weight[xxhash.xxh3_64_intdigest(REPEAT) % len(weight)])
        for batch in texts:
            out = np.empty(len(batch))
            for i, text in enumerate(batch):
                words = text.split() if text else []
                again = sum(map(operator.eq, words, words[1:]))
                total = sum(map(worth.__getitem__, words), complex(repeat * again, again))
                out[i] = bias + total.real / max(1.0, total.imag)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    return score


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", *, max_rows: int = 4000, buckets: int = 1 << 18, shortest: int = 2, longest: int = 4, **options) -> Model:
    """Learns from at most about `max_rows` rows of each class, none of them held out."""
    chosen = sample(docs, labels, label_col, max_rows=max_rows)
    rows = chosen.withColumn("f", _counts(buckets, shortest, longest)("text")).select("id", "label", "weight", "f.ids", "f.counts")
    found = sorted(rows.toLocalIterator(), key=lambda r: r.id)
    return train([(np.frombuffer(r.ids, dtype=np.int32), np.frombuffer(r.counts, dtype=np.float32), r.label, r.weight) for r in found], buckets=buckets, shortest=shortest, longest=longest, **options)


def scored(docs: DataFrame, model: Model, text_col: str = "text", result: str = "_score") -> DataFrame:
    """`docs` with each whole text's probability of label 1; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.shortest, model.longest))
    return docs.withColumn(result, _scorer(shared)(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; repeated rows stay repeated.

    Without a single label the model is its start, and every score is 0.5. Labels, language,
    source and id are not inputs of a score; other columns are not read.
    """
    own = docs.select("doc_id", "text")
    result = scored(own, fit(own, labels, **options))
    return result.select("doc_id", is_held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
