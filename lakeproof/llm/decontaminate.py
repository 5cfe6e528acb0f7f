"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned against every token window."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import quoted
from .common import add_fields, bounded_batches, fresh, text_of

WINDOW = 10
#: Bytes of distinct windows (as words) that one broadcast set may hold; more are scanned set after set.
SET_BYTES = 32 << 20
SEEDS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
FILTER_BITS = 22

FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

#: Bytes of text in lower case where a word goes on, a space elsewhere (letters, digits and all of non-ASCII).
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split()


def windows_of(words: list[bytes], n: int) -> Iterator[bytes]:
    """Windows of ``n`` consecutive words, joined by a space; fewer words, but not none, are one window."""
    for i in range(max(1, len(words) - n + 1) if words else 0):
        yield b" ".join(words[i:i + n])


class Windows:
    """The windows of some benchmark items, ready to be looked up in documents."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.ids: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = {}
        hashes = defaultdict(list)
        for window, items in rows:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in window.split(b" ")]
            key = np.array(ids, dtype=np.uint64)
            self.items[key.tobytes()] = items
            hashes[len(ids)].append(self.rolled(key, len(ids))[0])
        self.maybe = {}
        for n, values in hashes.items():
            self.maybe[n] = np.zeros(1 << FILTER_BITS, dtype=bool)
            self.maybe[n][self.slot(np.array(values))] = True

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(SEEDS[1])) >> np.uint64(64 - FILTER_BITS)

    @staticmethod
    def rolled(ids: np.ndarray, n: int) -> np.ndarray:
        """A polynomial hash of each window of n ids."""
        out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for i in range(n):
            out = out * np.uint64(SEEDS[0]) + ids[i:len(ids) - n + 1 + i]
        return out

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Starts and ends (in words, end exclusive) of hit windows as one flat list, and the items they come from."""
        get, spans, found = self.ids.get, [], set()
        ids = np.array([get(w, 0) for w in words], dtype=np.uint64)
        for n, maybe in self.maybe.items():
            if len(ids) < n:
                continue
            for i in np.flatnonzero(maybe[self.slot(self.rolled(ids, n))]).tolist():
                items = self.items.get(ids[i:i + n].tobytes())
                if items is not None:
                    spans += (i, i + n)
                    found.update(items)
        return spans, found


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct ``words`` (binary) of all items with the sorted ``items`` (as strings; null ids give no name)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(dict.fromkeys(windows_of(words_of(text), window)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text_of().alias("text"))
    return (rows.mapInArrow(cut, "item string, words binary")
            .groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """The documents with ``n_words``, ``hit_spans``, ``hit_items``, ``n_hit``, ``n_items`` and ``contaminated``.

    ``hit_spans`` are the merged runs of hit words (start, end exclusive), ``hit_items`` the sorted ids (as
    strings) of items with a window in the text. Text is normalised by lower-casing A-Z; words are runs of
    ASCII letters, digits and non-ASCII characters. Null and empty texts have no words and no hits; items
    without words have no windows; an item without an id still hits, but is not listed. Equal items of
    repeated rows count once. The windows are broadcast as sets of at most ``set_bytes``; a larger benchmark
    is cut into several sets by a hash of the window and the documents are scanned once for each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    grams = benchmark_windows(benchmark, window)
    total = grams.agg(F.sum(F.octet_length("words") + F.octet_length(F.concat_ws(",", "items")) + 64)).first()[0] or 0
    slices = int(total // set_bytes) + 1
    state, fields = fresh(docs, "_hits"), ["n_words", "hit_spans", "hit_items", "n_hit", "n_items", "contaminated"]
    result = "n_words long, spans array<int>, items array<string>"
    found = docs.withColumn(state, F.expr("cast(null as struct<n_words:long, spans:array<int>, items:array<string>>)"))
    for k in range(slices):
        part = grams.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == k)
        rows = [(bytes(r["words"]), list(r["items"])) for r in part.toLocalIterator()]
        held = spark.sparkContext.broadcast(rows)
        found = found.withColumn(state, scanner(held, result)(text_of(), F.col(state)))
    length = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spans = F.expr(f"transform(sequence(0, size({state}.spans) div 2 - 1), i -> named_struct("
                   f"'start', {state}.spans[2 * i], 'end', {state}.spans[2 * i + 1]))")
    spans = F.when(F.size(F.col(state)["spans"]) > 0, spans).otherwise(F.expr("cast(array() as array<struct<start:int, end:int>>)"))
    found = add_fields(found, F.struct(F.col(state)["n_words"].alias("n_words"), spans.alias("hit_spans"),
                                       F.col(state)["items"].alias("hit_items")), fields[:3]).drop(state)
    return add_fields(found, F.struct(length.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                                      (F.size("hit_spans") > 0).alias("contaminated")), fields[3:])


def merged(spans: list[int]) -> list[int]:
    """Flat starts and ends, sorted, runs that touch or overlap joined."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def scanner(held, result: str):
    @F.arrow_udf(result)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = Windows(held.value)
        for texts, earlier in batches:
            rows = []
            for text, before in zip(texts.to_pylist(), earlier.to_pylist()):
                words = words_of(text)
                spans, names = known.scan(words)
                if before is not None:
                    spans, names = spans + before["spans"], names.union(before["items"])
                rows.append({"n_words": len(words), "spans": merged(spans), "items": sorted(names)})
            yield pa.array(rows, FOUND)

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW,
                  text_col: str = "text") -> DataFrame:
    """Clean documents with the columns of ``docs``.

    ``remove="documents"`` drops every contaminated document; ``remove="spans"`` keeps it and cuts the
    characters from the first to the last word of each hit run out of its text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    own = [quoted(c) for c in docs.columns]
    row = docs.select(F.struct(*own).alias("row"), quoted(text_col).alias("text"))
    found = contamination(row, benchmark, window)
    if remove == "documents":
        return found.where(~F.col("contaminated")).select("row.*")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(s) else without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)], dtype=object)

    flat = found.withColumn("text", cut("text", "hit_spans"))
    return flat.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words."""
    raw = text.encode("utf-8")
    folded, places, at = raw.translate(FOLD), [], 0
    for word in folded.split():
        at = folded.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, kept = [], 0
    for a, b in spans:
        out.append(raw[kept:places[a][0]])
        kept = places[b - 1][1]
    return b"".join([*out, raw[kept:]]).decode("utf-8")
