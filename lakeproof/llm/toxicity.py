"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_fields, bounded_batches, labelled_sample, staged, text_of

#: Labelled examples of each class that the index holds at most (those of smallest hash), and terms of its vocabulary.
EXAMPLES_PER_LABEL, MAX_TERMS = 2000, 4096
NEIGHBOURS, BLOCK = 15, 64
#: A term counts where the log ratio of its rates among toxic and other examples, less so many standard
#: errors, is this high.
LEAST_LOG_RATIO, STANDARD_ERRORS = 1.0, 2.5
#: Lengths of word beginnings that are terms as well, and how often a term must occur for each of its levels.
PREFIXES, LEVELS = (4, 5, 6), (1, 2, 3, 5)
HEAD = min(PREFIXES)
MEMO_WORDS = 200_000
#: Terms of examples that a worker holds as Python objects before it gives them away.
TERMS_AT_ONCE = 50_000


def word_terms(word: str) -> list[str]:
    """The stems of one raw word: its letters and digits in lower case, and their first few."""
    core = "".join(c for c in word.lower() if c.isalnum())
    return [core, *(core[:n] + "~" for n in PREFIXES if len(core) > n)] if core else []


def levelled(counts: Counter) -> dict[str, int]:
    """Terms ``stem@level`` with their counts, for each level that the stem's count reaches."""
    return {f"{t}@{x}": n - x + 1 for t, n in counts.items() for x in LEVELS if n >= x}


class Terms:
    """Counts the vocabulary's terms in texts.

    Most words are told from their first letters: if those are letters that begin no stem of the
    vocabulary, the word has none. The others are looked at whole, with a bounded memory of them.
    """

    def __init__(self, vocabulary: list[str]):
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.stems, self.memo = {t.rpartition("@")[0] for t in vocabulary}, {}
        self.heads = {t[:HEAD] for t in self.stems}

    def word(self, word: str) -> tuple[str, ...]:
        found = tuple(t for t in word_terms(word) if t in self.stems)
        if len(word) <= 64:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def counts(self, text: str) -> dict[int, int]:
        known, out, heads = self.memo.get, Counter(), self.heads
        for w in [w for w in text.lower().split() if w[:HEAD] in heads or not w[:HEAD].isalpha()]:
            found = known(w)
            if found is None:
                found = self.word(w)
            if found:
                out.update(found)
        return {self.number[t]: n for t, n in levelled(out).items() if t in self.number} if out else {}


def example_terms(examples: DataFrame) -> DataFrame:
    """``doc_id, label, terms`` (all distinct terms with their counts) of labelled texts.

    A text has several times its size in terms, so a batch of texts gives its rows in parts of about TERMS_AT_ONCE terms.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for i, label, text in zip(batch["doc_id"], batch["label"], batch["text"]):
                found = levelled(Counter(t for w, n in Counter(text.split()).items() for t in word_terms(w) * n))
                rows.append((i, label, list(found), list(found.values())))
                held += len(found)
                if held >= TERMS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=["doc_id", "label", "terms", "counts"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "label", "terms", "counts"])

    return examples.select("doc_id", "label", "text").mapInPandas(count, "doc_id long, label int, terms array<string>, counts array<int>")


def chosen_vocabulary(terms: DataFrame, sizes: dict[int, int]) -> list[str]:
    """The terms that tell the toxic examples apart, at most MAX_TERMS, strongest first."""
    toxic, other = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    rates = (terms.select(F.explode("terms").alias("term"), "label").groupBy("term")
             .agg(F.sum(F.col("label")).alias("t"), F.sum(1 - F.col("label")).alias("o")))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (other + 1))
    least = ratio - STANDARD_ERRORS * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
    rows = (rates.where("t > 0").select("term", least.alias("least")).where(F.col("least") >= LEAST_LOG_RATIO)
            .orderBy(F.desc("least"), "term").limit(MAX_TERMS).collect())
    return [r["term"] for r in rows]


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[int, int]]:
    """The number of documents, and of those with each term, over all rows (one sum of vocabulary size per task)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, out = Terms(known.value), Counter()
        for batch in batches:
            for text in batch["text"]:
                out.update(terms.counts(text).keys())
            out[-1] += len(batch)
        yield pd.DataFrame({"term": list(out), "n": list(out.values())}, dtype="int64")

    rows = (docs.select(text_of().alias("text")).mapInPandas(count, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())
    found = {r["term"]: r["n"] for r in rows}
    return found.pop(-1, 0), found


class BlockMaxIndex:
    """Unit vectors of examples as postings by (block, term), and for each block and term the largest weight.

    A query bounds every block by the sum of its weights times those maxima, goes through the blocks from
    the highest bound on, and stops where no bound reaches its k-th cosine: the k found are exact (equal
    cosines go to the smaller example).
    """

    def __init__(self, vectors: list[dict[int, float]], terms: int, block: int = BLOCK):
        self.block, self.n = block, len(vectors)
        blocks = max(1, -(-len(vectors) // block))
        self.most = np.zeros((terms, blocks))
        self.postings: dict[tuple[int, int], tuple[list[int], list[float]]] = {}
        for d, vector in enumerate(vectors):
            for t, w in vector.items():
                held = self.postings.setdefault((d // block, t), ([], []))
                held[0].append(d)
                held[1].append(w)
                self.most[t, d // block] = max(self.most[t, d // block], w)

    def nearest(self, vector: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """Up to k ``(cosine, example)`` of positive cosine, highest first."""
        if not vector:
            return []
        bounds = sum(w * self.most[t] for t, w in vector.items())
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[0][0] - 1e-9:
                break
            scores: dict[int, float] = {}
            for t, w in vector.items():
                for d, x in zip(*self.postings.get((b, t), ((), ()))):
                    scores[d] = scores.get(d, 0.0) + w * x
            for d, s in scores.items():
                if d != without:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -d))
        return [(s, -d) for s, d in sorted(best, reverse=True)]


class Model:
    """Weights of the vocabulary, the examples' index and labels, and the calibration of votes."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, ids: list[int], labels: list[int], counts: list[dict[int, int]], weights: dict[int, float]):
        self.vocabulary, self.idf, self.ids, self.labels, self.weights = vocabulary, idf, ids, labels, weights
        vectors = [self.vector(c) for c in counts]
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=vectors[i].get, default=-1), ids[i]))
        self.ids, self.labels = [ids[i] for i in order], [labels[i] for i in order]
        vectors = [vectors[i] for i in order]
        self.index = BlockMaxIndex(vectors, max(1, len(vocabulary)))
        self.prior = self.weight(1) / max(1e-9, self.weight(1) + self.weight(0))
        votes = [self.vote(self.index.nearest(v, NEIGHBOURS, without=i)) for i, v in enumerate(vectors)]
        self.calibrate(votes)

    def weight(self, label: int) -> float:
        return self.weights.get(label, 0.0) * sum(x == label for x in self.labels)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {t: float(w / length) for t, w in raw.items()} if length else {}

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        """The share of toxic examples among the neighbours, weighted by cosine and by what each class stands for."""
        mass = [(s * self.weights[self.labels[d]], self.labels[d]) for s, d in near]
        total = sum(w for w, _ in mass)
        return sum(w for w, label in mass if label) / total if total else None

    def calibrate(self, votes: list[float | None]) -> None:
        """The toxic rate among examples by their own vote (itself left out), made monotone by pooling neighbours.

        Examples and texts without any neighbour have a rate of their own.
        """
        weight = [self.weights[x] for x in self.labels]
        bare = [(w, x) for v, w, x in zip(votes, weight, self.labels) if v is None]
        self.bare = (sum(w * x for w, x in bare) + self.prior) / (sum(w for w, _ in bare) + 1)
        pools: list[list[float]] = []  # weight, toxic weight, highest vote
        for v, w, x in sorted((v, w, x) for v, w, x in zip(votes, weight, self.labels) if v is not None):
            if pools and pools[-1][2] == v:
                pools[-1][0] += w
                pools[-1][1] += w * x
            else:
                pools.append([w, w * x, v])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                w1, t1, v1 = pools.pop()
                pools[-1] = [pools[-1][0] + w1, pools[-1][1] + t1, v1]
        self.steps = [v for *_, v in pools]
        self.rates = [(t + self.prior) / (w + 1) for w, t, _ in pools]

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(self.vector(counts), NEIGHBOURS) if counts else []
        vote = self.vote(near)
        if vote is None or not self.steps:
            return self.bare, near
        at = min(int(np.searchsorted(self.steps, vote)), len(self.rates) - 1)
        return float(self.rates[at]), near


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = EXAMPLES_PER_LABEL) -> Model:
    """Fit on the labelled training rows: of each class the ``per_label`` rows of smallest hash; idf over all documents.

    The driver gets the examples' chosen terms only (at most ``per_label`` rows a class and MAX_TERMS terms a
    row) and one number per term. Without labelled rows the model has no examples and scores 0.5.
    """
    bounded_batches(docs.sparkSession)
    examples, totals = labelled_sample(docs, labels, label, per_label)
    terms = None if examples is None else staged(example_terms(examples), "terms")
    sizes = {} if terms is None else {r["label"]: r["n"] for r in terms.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    vocabulary = [] if terms is None else chosen_vocabulary(terms, sizes)
    total, seen = document_frequency(docs, vocabulary)
    idf = np.array([math.log((total + 1) / (seen.get(i, 0) + 1)) + 1 for i in range(len(vocabulary))])
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = []
    if terms is not None:
        wanted = F.array(*[F.lit(t) for t in vocabulary]) if vocabulary else F.expr("cast(array() as array<string>)")
        pairs = F.filter(F.arrays_zip("terms", "counts"), lambda p: F.array_contains(wanted, p["terms"]))
        rows = terms.select("doc_id", "label", pairs.alias("pairs")).orderBy("doc_id").collect()
    weights = {x: totals[x] / sizes[x] for x in sizes}
    return Model(vocabulary, idf, [r["doc_id"] for r in rows], [r["label"] for r in rows],
                 [{number[p["terms"]]: p["counts"] for p in r["pairs"]} for r in rows], weights or {0: 1.0, 1: 1.0})


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents with ``score`` (calibrated, 0 to 1), ``predicted`` (1 from the threshold on) and ``evidence``.

    ``evidence`` are the nearest examples, at most three: ``struct<doc_id, toxic, cosine>``. Null, empty and
    other texts without a term of the vocabulary have no neighbour; their score is the toxic rate of such
    examples. Repeated rows are scored each; input columns named like the results are replaced.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<struct<doc_id:long, toxic:int, cosine:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = held.value
        terms = Terms(known.vocabulary)
        for texts in batches:
            rows = []
            for text in texts:
                score, near = known.score(terms.counts(text))
                rows.append((score, [{"doc_id": known.ids[d], "toxic": known.labels[d], "cosine": s} for s, d in near[:3]]))
            yield pd.DataFrame(rows, columns=["score", "evidence"])

    found = add_fields(docs, scored(text_of(text_col)), ["score", "evidence"])
    return add_fields(found, F.struct((F.col("score") >= threshold).cast("int").alias("predicted")), ["predicted"])
