"""Toxicity by a classifier chain over labelled rows.

The categories are predicted one after another: each has a linear (logistic) model over word features and
the probabilities of the categories before it. For training, those probabilities are out-of-fold predictions: a row's
earlier probabilities come from models that never saw it, so a later model doesn't learn to trust
probabilities better than those it will meet.

Categories: the ``label_columns`` that were asked for, in order, and last a row that has all of them at
once. A category that the sample has on one side only, or that no word tells, is predicted by its share; a document is never rejected for that.

The models are fitted on at most ``sample_rows`` labelled rows, chosen by a hash of the id, whose words (as 32-bit hashes, once each)
come to the driver; ``sample_rows`` bounds that whatever the corpus's size. Words that occur in at least
``least_rows`` of them and tell the category best are its features, ``most_features`` at most. Scoring is one pass over whole texts where they lie,
with the models (a few thousand numbers) in the task closure.

Rows: null or empty text has no words and gets the categories' probabilities without any; null ids are kept; repeated
labels count by their largest value, null labels not at all; without labelled rows nothing is rejected (probability 0).
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm import _common as c

#: Documents at this probability or above are rejected; held-out rows show no clean document there.
THRESHOLD = 0.3

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_features(text: str | None) -> np.ndarray:
    """The distinct words of a text as sorted 32-bit hashes: ASCII letters and digits, lower-cased, and all beyond ASCII."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_SPLIT).split()) if text else ()
    return np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))


@dataclass
class Linear:
    """A logistic model over some words and the probabilities before it."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    chained: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0
    constant: float | None = None

    def score(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        out = np.empty(len(rows))
        for i, words in enumerate(rows):
            at = np.searchsorted(self.words, words)
            at[at == len(self.words)] = 0
            out[i] = self.weights[at[self.words[at] == words]].sum() if len(self.words) else 0.0
        return 1 / (1 + np.exp(-np.clip(out + before @ self.chained + self.bias, -40, 40)))


def _telling_words(rows: list[np.ndarray], y: np.ndarray, least: int, most: int) -> np.ndarray:
    """Words by the strength of their tie to the category (the chi-squared of presence against it)."""
    words, inverse, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    with_y = np.bincount(inverse, weights=np.repeat(y, [len(r) for r in rows]), minlength=len(words))
    total, share = len(rows), y.mean()
    chi = (with_y - n * share) ** 2 / np.maximum(n * share * (1 - share) * (1 - n / total + 1e-9), 1e-9)
    chi[n < least] = -1
    chosen = np.argsort(-chi, kind="stable")[:most]
    return np.sort(words[chosen[chi[chosen] > 6.6]])  # one in a hundred by chance


def fit_linear(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, least: int = 5, most: int = 2000, steps: int = 300, decay: float = 1e-5) -> Linear:
    """Logistic regression by Adam over the whole sample, with the telling words as features."""
    if len(y) == 0 or y.min() == y.max():
        return Linear(constant=float(y[0]) if len(y) else 0.0)
    words = _telling_words(rows, y, least, most)
    if not len(words) and not before.shape[1]:
        return Linear(constant=float(y.mean()))
    columns, lengths = [], []
    for r in rows:
        at = np.searchsorted(words, r)
        at[at == len(words)] = 0
        hit = at[words[at] == r] if len(words) else at[:0]
        columns.append(hit)
        lengths.append(len(hit))
    column, owner = np.concatenate(columns), np.repeat(np.arange(len(rows)), lengths)
    k, d = len(words), before.shape[1]
    w = np.zeros(k + d + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[column], minlength=len(rows)) + before @ w[k : k + d] + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.concatenate([np.bincount(column, weights=r[owner], minlength=k), r @ before, [r.sum()]]) / len(rows)
        g[:-1] += decay * w[:-1] / max(1, k) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Linear(words, w[:k], w[k : k + d], float(w[-1]))


@dataclass
class Chain:
    """Models of the categories in order."""

    names: list[str]
    models: list[Linear]

    def tells(self, name: str) -> bool:
        """Whether any word speaks for the category; if none does, its probability is the sample's share, which rejects nothing."""
        return any(len(m.words) and m.constant is None for m in self.models[: self.names.index(name) + 1])

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        p = np.empty((len(rows), len(self.models)))
        for j, model in enumerate(self.models):
            p[:, j] = model.score(rows, p[:, :j])
        return p


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, names: list[str], folds: int = 4) -> Chain:
    """Fits the chain; each later model sees out-of-fold probabilities of the earlier ones."""
    n = len(rows)
    fold = np.arange(n) % folds
    held_out, models = np.zeros((n, len(names))), []
    for j in range(len(names)):
        y, before = labels[:, j].astype(float), held_out[:, :j]
        models.append(fit_linear(rows, before, y))
        if j + 1 < len(names):
            for f in range(folds):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(outside) and len(inside):
                    part = fit_linear([rows[i] for i in inside], before[inside], y[inside])
                    held_out[outside, j] = part.score([rows[i] for i in outside], before[outside])
    return Chain(names, models)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_columns: list[str], sample_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Word features and 0/1 labels of at most ``sample_rows`` labelled documents; equal samples on every run."""
    known = labels.where(" and ".join(f"{x} is not null" for x in ["doc_id", *label_columns]))
    known = known.groupBy("doc_id").agg(*[F.max(F.col(x).cast("int")).alias(f"__{i}") for i, x in enumerate(label_columns)])
    order = F.xxhash64("doc_id"), F.col("doc_id")
    # sample_rows rows of a few numbers: small by its own bound.
    drawn = F.broadcast(known.orderBy(*order).limit(sample_rows).select(F.col("doc_id").alias("__id"), *[f"__{i}" for i in range(len(label_columns))]))
    texts = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("__id")).select("doc_id", "text", *[f"__{i}" for i in range(len(label_columns))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            words = [word_features(t).tobytes() for t in batch.column(1).to_pylist()]
            if words:
                yield [batch.column(0), words, [*zip(*(batch.column(2 + i).to_pylist() for i in range(len(label_columns))))]]

    got = c.map_batches(texts, work, "doc_id long, words binary, labels array<int>").orderBy(F.xxhash64("doc_id"), "doc_id", "words").limit(sample_rows).collect()
    rows = [np.frombuffer(bytes(r["words"]), np.uint32) for r in got]
    return rows, np.array([r["labels"] for r in got], np.int64).reshape(len(rows), len(label_columns))


def train(docs: DataFrame, labels: DataFrame, label_columns: tuple[str, ...] = ("toxic",), low_columns: tuple[str, ...] = ("quality",), sample_rows: int = 12_000) -> Chain:
    """A chain over ``low_columns`` turned round (0 is the bad side), then ``label_columns``, then all of them at once."""
    rows, y = labelled_sample(docs, labels, [*low_columns, *label_columns], sample_rows)
    y[:, : len(low_columns)] = 1 - y[:, : len(low_columns)]
    names = [*[f"low_{x}" for x in low_columns], *label_columns, "all_at_once"]
    return fit_chain(rows, np.column_stack([y, y.min(axis=1)]) if len(y) else np.zeros((0, len(names)), np.int64), names)


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per document: doc_id and p_<category> of each category."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            if batch.num_rows:
                p = chain.score([word_features(t) for t in batch.column(1).to_pylist()])
                yield [batch.column(0), *p.T.copy()]

    return c.map_batches(c.pick(docs, "doc_id", "text"), work, "doc_id long" + "".join(f", p_{n} double" for n in chain.names))


def drop_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their columns, whose probability of ``category`` is under ``threshold``."""
    if not chain.tells(category):
        return docs
    c.modest(docs.sparkSession)
    at = chain.names.index(category)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.small(batches):
            if batch.num_rows:
                p = chain.score([word_features(t) for t in batch.column(names.index("text")).to_pylist()])
                yield batch.filter(pa.array(p[:, at] < threshold))

    return docs.mapInArrow(work, docs.schema)
