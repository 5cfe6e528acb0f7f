"""A corpus pipeline of five stages over the documents table; every stage gets what the one before it kept.

Stages read the columns ``doc_id`` and ``text`` (and ``n_chars`` where lines go); all other columns pass through under names of
their own, so that none can meet a column an operator makes. Null texts count as empty and stay null; null ids
are rows like any other; rows that repeat id and text are decided alike; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.llm import bpe, decontaminate, linededup, simhash, toxicity
from lakeproof.llm.common import staged
from lakeproof.llm.queries import RANKS, table
from lakeproof.operators.skew import quoted

READ = ("doc_id", "text", "n_chars")
CODED = ("n_tokens", "token_ids", "round_trip")


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The frame with names of their own for columns that no stage reads, and the columns that bring the names back."""
    held = [c if c in READ else f"kept_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*held), [quoted(new).alias(old) for new, old in zip(held, docs.columns)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity votes reject go; the model learns from the labelled rows among them."""
    held, back = apart(docs)
    model = toxicity.fit(held, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(held, model).where("predicted = 0").select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines, short ones too, one line stays; documents keep their row with the lines left."""
    held, back = apart(docs)
    return linededup.dedup_lines(held, least_chars=1).select(*back)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents one stays."""
    held, back = apart(docs)
    return simhash.one_of_each(held).select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    held, back = apart(docs)
    return decontaminate.decontaminate(held, table(spark, sf_dir, "benchmark")).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether the ids decode to the bytes of the text."""
    ranks = public_tokenizers.path(RANKS)
    held, back = apart(docs)
    coded = bpe.decode_documents(bpe.encode_documents(held, ranks, public_tokenizers.PATTERN), ranks)
    whole = (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip")
    other = [c for c, name in zip(back, docs.columns) if name.lower() not in CODED]  # results replace columns of their names
    return coded.select(*other, "n_tokens", "token_ids", whole)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

ORACLE_SQL: str | None = None  # votes, MinHash and SimHash classes and BPE are not SQL; the tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
