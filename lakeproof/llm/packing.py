"""Best-fit packing of documents into training sequences, planned over the histogram of their lengths."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import quoted
from .common import bounded_batches, fresh, staged, text_of
from .token_counts import as_ranks

CAPACITY, END_ID = 1024, 2


@lru_cache(maxsize=2)
def id_encoder(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text as the tokenizers library gives them for a .json file, without added special tokens.

    A byte-level BPE file is loaded as equal ranks; any other goes through its library. A worker loads a file once.
    """
    ranks = as_ranks(path)
    if ranks is not None:
        return lambda text: ranks.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its id, ``piece`` (from 0), ``start``, ``length`` and ``ids``.

    A document is its ids and ``end_id``. One of more than ``capacity`` ids is cut into pieces of that
    length, of which the first may be shorter; all others are one piece. ``ids`` holds unsigned 32-bit
    integers, little-endian, as bytes. Null text is empty (one piece, the end id); a null id stays; each
    of several equal rows has pieces of its own; no other column is read.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer)
        for batch in batches:
            rows, piece, start, length, ids = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                held = encode(text).astype("<u4").tobytes() + end
                total = len(held) // 4
                at, size, number = 0, (total - 1) % capacity + 1, 0
                while at < total:
                    rows.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    ids.append(held[4 * at:4 * (at + size)])
                    at, size, number = at + size, capacity, number + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    pieces = docs.select(quoted(id_col), text_of(text_col)).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids binary")
    return pieces.withColumnRenamed("id", id_col)


class Run(NamedTuple):
    """Ranks ``rank`` and on of a length: ``each`` of them into every sequence from ``sequence`` on, from ``offset`` on."""
    length: int
    rank: int
    each: int
    sequence: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Best-fit over counts, longest first: the runs of every length in the order of rank, and the number of sequences.

    Sequences of equal contents are handled together as a run of numbers, so the work and the plan depend
    on the capacity and not on the number of documents: a length leaves at most two more runs than it
    found, and a run takes at most as many lengths as different ones fit (45 for 1,024).
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: first sequence, how many
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit a capacity of {capacity}")
        left, rank, least = counts[length], 0, length
        while left:
            while least < capacity and not room[least]:
                least += 1
            each = least // length
            if not room[least]:  # nothing fits: open as many as the rest needs
                needed = -(-left // each)
                room[least].append((sequences, needed))
                sequences += needed
            first, many = room[least].pop()
            whole = min(many, left // each)
            if whole:
                plan.append(Run(length, rank, each, first, capacity - least))
                room[least - each * length].append((first, whole))
                rank, left = rank + whole * each, left - whole * each
            if whole < many and left:  # fewer than fill a sequence of the run are left
                plan.append(Run(length, rank, left, first + whole, capacity - least))
                room[least - left * length].append((first + whole, 1))
                whole, rank, left = whole + 1, rank + left, 0
            if whole < many:
                room[least].append((first + whole, many - whole))
    return plan, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``, packed best-fit into sequences of at most ``capacity``.

    The lengths (1 to ``capacity``, not null; else ValueError) are counted by writing task and length; the
    plan is made from their histogram, at most ``capacity`` numbers. A row's rank within its length is its
    number within task and length plus the rows of that length in earlier tasks, so no length, however
    frequent, meets in one task. The row then takes the planned slot of its length and rank. Columns of
    the names of the results are replaced; rows are never dropped, and no rows give no rows.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    row, task, rank, of_task, of_size, first = (fresh(pieces, x) for x in ("_row", "_task", "_rank", "_of_task", "_of_size", "_first"))
    held = staged(pieces.select(*[quoted(c) for c in names], F.monotonically_increasing_id().alias(row)), "pieces")
    held = held.withColumn(task, F.shiftright(row, 33))
    size = quoted(length_col).cast("long")
    sizes = staged(held.groupBy(task, size.alias("_size")).agg(F.count(F.lit(1)).alias("_many")), "lengths")
    counts = {r["_size"]: r["n"] for r in sizes.where(f"_size between 1 and {capacity}").groupBy("_size").agg(F.sum("_many").alias("n")).collect()}
    if not sizes.where(f"_size is null or _size not between 1 and {capacity}").isEmpty():
        raise ValueError(f"lengths must be 1 to {capacity}")
    plan, _ = best_fit(counts, capacity)
    runs = np.array(sorted(plan), np.int64).reshape(-1, len(Run._fields))
    starts = {length: np.flatnonzero(runs[:, 0] == length) for length in counts}

    @F.arrow_udf("sequence_id long, offset long")
    def slot(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        lengths, ranks = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        found = np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            mine, own = lengths == length, starts[int(length)]
            found[mine] = own[np.searchsorted(runs[own, 1], ranks[mine], side="right") - 1]
        _, first, each, sequence, offset = runs[found].T
        behind = ranks - first
        return pa.StructArray.from_arrays([pa.array(sequence + behind // each), pa.array(offset + behind % each * lengths)], ["sequence_id", "offset"])

    earlier = Window.partitionBy("_size").orderBy(task)
    before = sizes.select(F.col(task).alias(of_task), F.col("_size").alias(of_size),
                          (F.sum("_many").over(earlier) - F.col("_many")).alias(first))
    within = Window.partitionBy(task, size).orderBy(row)
    ranked = held.withColumn(rank, (F.row_number().over(within) - 1).cast("long"))
    joined = ranked.join(before, (F.col(task) == F.col(of_task)) & (size == F.col(of_size)))
    placed = joined.withColumn(rank, slot(size, F.col(rank) + F.col(first)))
    return placed.select(*[quoted(c) for c in names], *[F.col(rank)[c].alias(c) for c in ("sequence_id", "offset")])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of ``cut_documents``, token ids included, with their places by ``pack``."""
    return pack(cut_documents(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
