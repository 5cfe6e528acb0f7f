"""Token counts through a digest cache: only texts whose digest the cache lacks are encoded, once each."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_fields, bounded_batches, fresh, staged, text_of

#: Part of the version digest; a change of how texts are normalised or counted needs a new one.
COUNTING = "utf8-text/no-added-tokens/1"
CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the way of counting."""
    held = hashlib.sha256(COUNTING.encode())
    with open(path, "rb") as file:
        held.update(file.read())
    return held.hexdigest()


#: Fixed values of the byte-level BPE family: the pattern that the library's byte-level step splits by.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def as_ranks(path: str):
    """A rank encoder equal to a byte-level BPE .json, and its special strings; None where it is of another kind.

    The ranks are the ids, which is right where ids of merged tokens rise in the order of the merges.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = (model.get("type", "BPE") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
             and split.get("use_regex", True) and spec.get("normalizer") is None and not model.get("dropout")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
             and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))
    if not plain:
        return None
    names = byte_names()
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(names[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    order = [ranks[bytes(names[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
    if order != sorted(order):
        return None
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens as the library for the file does: tokenizers for .json, sentencepiece for .model.

    A byte-level BPE .json is loaded as equal ranks, which count five times as fast as the library
    itself; every other .json goes through the library.
    """
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    ranks = as_ranks(path)
    if ranks is not None:
        return lambda texts: [len(ranks.encode(t, allowed_special="all", disallowed_special=())) for t in texts]
    return library_counter(path)


def library_counter(path: str) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()

    def count(texts: list[str]) -> list[int]:
        return [len(whole.encode(t, add_special_tokens=False)) for t in texts]

    return count


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version; empty where nothing was cached yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(path).where(F.col("version") == version).select("digest", "n_tokens")


def fill_cache(docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text") -> str:
    """Encode the distinct texts that the cache lacks, append their counts to it, and give the version digest.

    The texts of equal digest are reduced before the shuffle, so a text with many copies is sent once
    per task. Running it again after a crash encodes what is still missing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    version = tokenizer_version(tokenizer)

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(tokenizer)
        for texts in batches:
            yield pa.array(count(texts.to_pylist()), pa.int64())

    texts = docs.select(text_of(text_col).alias("text")).select(digest_of("text").alias("digest"), "text")
    misses = texts.dropDuplicates(["digest"]).join(read_cache(spark, cache, version), "digest", "left_anti")
    (misses.select(F.lit(version).alias("version"), "digest", tokens("text").alias("n_tokens"))
     .write.mode("append").partitionBy("version").parquet(cache))
    return version


def digest_of(name: str):
    return F.unhex(F.sha2(text_of(name).cast("binary"), 256))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """The documents with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is a file that every executor can open, ``cache`` a Parquet folder that all can reach; it
    keeps the counts of all versions. Null counts as the empty text, which has no tokens; repeated texts are
    encoded once and counted for each row; input columns named like the results are replaced.
    """
    spark = docs.sparkSession
    version = fill_cache(docs, tokenizer, cache, text_col)
    counts = staged(read_cache(spark, cache, version).dropDuplicates(["digest"]), "counts")
    key = fresh(docs, "_digest")
    counts = counts.select(F.col("digest").alias(key), F.col("n_tokens").alias(f"{key}_n"))
    found = docs.withColumn(key, digest_of(text_col)).join(counts, key)
    fields = ["n_bytes", "n_tokens", "over_limit"]
    result = F.struct(F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), F.col(f"{key}_n").alias("n_tokens"),
                      (F.col(f"{key}_n") > limit).alias("over_limit"))
    return add_fields(found, result, fields).drop(key, f"{key}_n")
