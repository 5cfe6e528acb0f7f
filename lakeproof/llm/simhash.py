"""SimHash near-duplicates by Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import quoted
from .common import add_fields, bounded_batches, components, fresh, staged, text_of
from .groups import edges_batch, forest, in_units, runs

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Shingles of a text that are hashed at a time.
CHUNK_SHINGLES = 1 << 17
#: Fingerprints of one key that a task compares at most twice as many of.
CHUNK = 20_000

#: The binary Golay code of 23 bits with 12 message bits, by its generator polynomial.
CODE_BITS, CHECK_BITS, GENERATOR = 23, 11, 0b101011100011

SEGMENTS, SEGMENT_BITS = 4, 16
#: Which segment must agree, and which other one may differ by a bit. Three errors leave one of four
#: segments without any, and at most one of the other three has two or more: so of any two others, one
#: has no more than one.
PLANS = [(i, (i + step) % SEGMENTS) for i in range(SEGMENTS) for step in (1, 2)]


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, the lowest first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the hashes of its word shingles.

    A-Z are lower-cased, words are parted by ASCII white space, repeats count; fewer words than a shingle
    are one shingle, no words give zero.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    hashed, total = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, total, CHUNK_SHINGLES):
        part = words[start:start + CHUNK_SHINGLES + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [part]
        counts += bits_set(np.array([hashed(b" ".join(g), SEED) for g in grams], dtype=np.uint64))
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def add_fingerprints(docs: DataFrame, name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """The documents with the fingerprint of every whole text as a long; null counts as the empty text."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([signed(fingerprint(t, shingle)) for t in texts.to_pylist()], pa.int64())

    return add_fields(docs, F.struct(of(text_of()).alias(name)), [name])


def remainder(words: np.ndarray) -> np.ndarray:
    """Words of CODE_BITS bits modulo the generator polynomial: their syndromes."""
    out = words.copy()
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return out


def near_patterns(most: int = 4) -> np.ndarray:
    """For each syndrome, all error patterns of at most ``most`` bits that give it, padded with the first.

    The code is perfect: each syndrome has one pattern of up to three bits. Where that has three, five
    patterns of four bits give it too, else none.
    """
    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for n in range(most + 1):
        words = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(CODE_BITS), n)], dtype=np.int64)
        for word, syndrome in zip(words.tolist(), remainder(words).tolist()):
            found[syndrome].append(word)
    width = max(map(len, found))
    return np.array([(p + p[:1] * width)[:width] for p in found], dtype=np.int64)


def segment_codes(patterns: np.ndarray) -> np.ndarray:
    """The indices of the codewords within four bits of every value of a segment (filled up with zero bits).

    Two values that differ by at most a bit share an index: the codeword nearest to one, no more than three
    bits off, is no more than four from the other.
    """
    words = np.arange(1 << SEGMENT_BITS, dtype=np.int64)
    return (words[:, None] ^ patterns[remainder(words)]) >> CHECK_BITS


def keys_of(prints: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of fingerprints and, for each, the row of its fingerprint.

    A key is the number of the plan, the segment that must agree and one index of the other segment.
    """
    keys, rows = [], []
    segments = [(prints.view(np.uint64) >> np.uint64(SEGMENT_BITS * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(SEGMENTS)]
    width = codes.shape[1]
    for number, (same, fuzzy) in enumerate(PLANS):
        near = codes[segments[fuzzy]]
        key = (number << SEGMENT_BITS | segments[same])[:, None] << (CODE_BITS - CHECK_BITS) | near
        own = np.ones(key.shape, dtype=bool)
        own[:, 1:] = near[:, 1:] != near[:, :1]
        keys.append(key[own])
        rows.append(np.repeat(np.arange(len(prints)), width).reshape(key.shape)[own])
    return np.concatenate(keys), np.concatenate(rows)


def near_bits(prints: np.ndarray, i: int, waiting: np.ndarray) -> np.ndarray:
    rest = np.flatnonzero(waiting)
    return rest[np.bitwise_count(prints[rest] ^ prints[i]) <= DISTANCE]


def links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fp`` (long) connected by pairs of at most DISTANCE bits.

    Any such pair has a key in common; members of a key are compared exactly, and of the links of a key a
    spanning forest is kept.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = segment_codes(near_patterns())
        for batch in batches:
            values = batch.column(0).to_numpy()
            for i in range(0, len(values), 4096):
                part = values[i:i + 4096]
                keys, rows = keys_of(part, codes)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs(batches, ["key", "unit", "fp"]):
            values = table.column("fp").to_numpy()
            bits, length = values.view(np.uint64), np.diff(at)
            two = at[:-1][length == 2]
            linked = np.bitwise_count(bits[two] ^ bits[two + 1]) <= DISTANCE
            a, b = [values[two][linked]], [values[two + 1][linked]]
            for start, n in zip(at[:-1][length > 2].tolist(), length[length > 2].tolist()):
                own = bits[start:start + n]
                found = forest(n, functools.partial(near_bits, own))
                if found:
                    ends = np.array(found) + start
                    a.append(values[ends[:, 0]])
                    b.append(values[ends[:, 1]])
            yield edges_batch(np.concatenate(a), np.concatenate(b))

    keys = prints.select("fp").mapInArrow(keyed, "key long, fp long")
    return in_units(keys, "key", "fp", chunk).select("key", "unit", "fp").mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """``id_col, fingerprint, component_id``: one row per document row.

    ``fingerprint`` is 16 lower-case hexadecimal digits; ``component_id`` is the smallest id reachable over
    fingerprints that differ by at most DISTANCE bits, null only where no document of the class has an id.
    Texts without words (null, empty) have fingerprint zero and are linked like any other; repeated rows
    have the same class. Only fingerprints and ids are shuffled, equal fingerprints are reduced to one first.
    """
    own = docs.select(quoted(id_col).alias("id"), F.col("text"))
    prints = staged(add_fingerprints(own, "fp", shingle).select("id", "fp"), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    classes = staged(components(links(distinct, chunk)), "classes")
    rooted = staged(distinct.join(classes, F.col("fp") == F.col("node"), "left")
                    .select("fp", "first", F.coalesce("component", "fp").alias("root")), "rooted")
    first = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "first")
    known = staged(rooted.join(first, "root").select(F.col("fp").alias("print"), "component_id"), "known")
    found = prints.join(known, F.col("fp") == F.col("print"))
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents with their own columns, of each class only the row of the smallest id.

    Of several rows with that id the one of smallest text hash stays, of equal ones any one; of a class
    without ids one row stays.
    """
    key, digest = quoted(id_col), F.xxhash64(text_of())
    prints = staged(add_fingerprints(docs.select(key.alias("id"), "text"), "fp")
                    .select("id", "fp", F.xxhash64(text_of()).alias("hash")), "prints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    distinct = staged(prints.groupBy("fp").agg(F.min(rank).alias("first")), "distinct")
    classes = staged(components(links(distinct)), "classes")
    rooted = distinct.join(classes, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("component", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first")["id"].alias("_id"), F.col("first")["hash"].alias("_hash"))
    kept = staged(kept, "kept")
    rest = docs.join(kept, key.eqNullSafe(F.col("_id")) & (digest == F.col("_hash")), "left_semi")
    if rest.count() == kept.count():
        return rest
    mark = fresh(docs, "_hash")
    return rest.withColumn(mark, digest).dropDuplicates([id_col, mark]).drop(mark)
