"""Quality by nearest neighbours: labelled latent-semantic vectors, exact cosines, votes weighted by similarity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_fields, bounded_batches, labelled_sample, text_of

#: Hashed features of words, and after them those of word shapes, repeats and lengths.
WORDS, SHAPES = 4096, 1024
FEATURES = WORDS + SHAPES
#: The share of a vector's length that words get; the rest is that of the shapes.
WORD_SHARE = 0.3
#: Latent dimensions; labelled rows of each class that are kept at most (those of smallest hash).
RANK, EXAMPLES_PER_LABEL = 48, 1000
NEIGHBOURS, BLOCK_ROWS = 15, 256
MEMO_WORDS = 200_000
REPEAT = FEATURES - 1


def shape_of(word: str) -> str:
    """Upper, lower, digit and other letters as A, a, 0, x, other characters as they are; runs are cut to one."""
    bare = word[:64]
    if bare.isalpha():
        if bare.islower():
            return "a"
        if bare.isupper():
            return "A"
        if bare[1:].islower():
            return "Aa"
    out = []
    for c in bare:
        kind = "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def hashed(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode("utf-8")) % buckets


class Features:
    """Counts of hashed words, shapes and repeats of a text; a bounded memory of raw words keeps that cheap."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """The word's bucket and, above it, that of its shape, from 1 on."""
        found = (hashed(shape_of(word), SHAPES - 1) + 1) * WORDS + hashed(word.lower(), WORDS)
        if len(word) <= 64:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def counts(self, text: str) -> np.ndarray:
        known, new, words = self.memo.get, self.word, text.split()
        out = np.zeros(FEATURES, np.float32)
        if words:
            codes = np.array([known(w) or new(w) for w in words])
            out[:WORDS] = np.bincount(codes % WORDS, minlength=WORDS)
            out[WORDS:REPEAT] = np.bincount(codes // WORDS - 1, minlength=SHAPES - 1)
            out[REPEAT] = np.count_nonzero(codes[1:] == codes[:-1])
        return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as vectors: words by log frequency and idf, shapes by their share of the text; both scaled."""
    out = np.zeros_like(counts)
    words = np.log1p(counts[:, :WORDS]) * idf[:WORDS]
    shapes = counts[:, WORDS:]
    total = counts[:, :WORDS].sum(axis=1, keepdims=True)
    shapes = np.sqrt(shapes / np.maximum(total, 1)) * idf[WORDS:]
    for part, share, at in ((words, WORD_SHARE, slice(0, WORDS)), (shapes, 1 - WORD_SHARE, slice(WORDS, None))):
        length = np.linalg.norm(part, axis=1, keepdims=True)
        out[:, at] = part / np.maximum(length, 1e-12) * np.float32(share ** 0.5)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each hashed feature, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, seen, rows = Features(), np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen[:FEATURES] += features.counts(text) > 0
            rows += len(batch)
        seen[FEATURES] = rows
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": at, "n": seen[at]})

    rows = (docs.select(text_of().alias("text")).mapInPandas(count, "feature long, n long")
            .groupBy("feature").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        out[r["feature"]] = r["n"]
    return int(out[FEATURES]), out[:FEATURES]


class Model:
    """idf, the latent directions, and the labelled vectors with labels and class weights."""

    def __init__(self, idf, directions, vectors, labels, weights, prior):
        self.idf, self.directions, self.vectors, self.labels, self.weights, self.prior = idf, directions, vectors, labels, weights, prior

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.idf) @ self.directions).astype(np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors by exact cosine; the prior alone where nothing is similar."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        power = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** 4
        mass = power * self.weights[near]
        total = mass.sum(axis=1)
        smooth = 1e-3
        return ((mass * self.labels[near]).sum(axis=1) + smooth * self.prior) / (total + smooth)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = EXAMPLES_PER_LABEL) -> Model:
    """Fit on the labelled training rows: of each class the ``per_label`` rows of smallest hash; idf over all documents.

    The driver gets hashed counts of at most that many rows and FEATURES numbers a row, never texts. The
    latent directions are the leading right singular vectors of their weighted rows. Without labelled rows
    every score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    examples, totals = labelled_sample(docs, labels, label, per_label)
    n_docs, seen = document_frequency(docs)
    idf = (np.log((n_docs + 1) / (seen + 1)) + 1).astype(np.float32)
    if examples is None:
        return Model(idf, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            rows = []
            for i, x, text in zip(batch["doc_id"], batch["label"], batch["text"]):
                counts = features.counts(text)
                at = np.flatnonzero(counts)
                rows.append((i, x, at.tolist(), counts[at].tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "at", "n"])

    rows = (examples.select("doc_id", "label", "text")
            .mapInPandas(count, "doc_id long, label int, at array<int>, n array<float>").orderBy("doc_id").collect())
    counts = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["n"]
    given = np.array([r["label"] for r in rows], dtype=float)
    sizes = {x: max(1, int((given == x).sum())) for x in totals}
    weights = np.array([totals[int(x)] / sizes[int(x)] for x in given])
    matrix = weighted(counts, idf).astype(np.float64)
    values, left = np.linalg.eigh(matrix @ matrix.T)
    top = np.argsort(-values)[:min(RANK, len(values))]
    top = top[values[top] > 1e-9]
    directions = (matrix.T @ left[:, top] / np.sqrt(values[top])).astype(np.float32)
    model = Model(idf, directions, None, given, weights, float((weights * given).sum() / weights.sum()))
    model.vectors = model.latent(counts)
    return model


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Every text is compared with every labelled vector, in blocks of rows. Null and empty texts are similar to
    nothing and get the share of label 1 as score; repeated rows are scored each; input columns named like
    the results are replaced.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, features = held.value, Features()
        for texts in batches:
            out = [known.scores(np.stack([features.counts(t) for t in texts.iloc[i:i + BLOCK_ROWS]])) for i in range(0, len(texts), BLOCK_ROWS)]
            yield pd.Series(np.clip(np.concatenate(out), 0.0, 1.0) if out else np.empty(0))

    found = add_fields(docs, F.struct(scored(text_of(text_col)).alias("score")), ["score"])
    return add_fields(found, F.struct((F.col("score") >= threshold).cast("int").alias("predicted")), ["predicted"])
