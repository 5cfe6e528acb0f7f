import hashlib
import os
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import AWKWARD, awkward, nothing
from tokenizers import Tokenizer

from lakeproof.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def random_texts(n, most):
    r = random.Random(5)
    return ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0, 40), r.randrange(0x80, 0x3000), 0x85, 0xA0, 0x1C, 0x2028,
                                  0x1F600, 97, 97, 98])) for _ in range(r.randrange(most))) for _ in range(n)]


def test_encoder_equals_the_library_on_random_and_long_texts(reference):
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = random_texts(1500, 60) + ["a" * 5000, "ab" * 3000, "\n" * 500 + "x", "x " * 20_000, "<|endoftext|>", ""]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_texts_longer_than_a_chunk_and_a_small_memory_give_the_same(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    monkeypatch.setattr(bpe, "CHUNK_PIECES", 7)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 5)
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = random_texts(200, 150)
    assert [x.tolist() for x in encoder.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_memory_holds_packed_ids_and_pairs_of_bytes_have_a_table(reference):
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [*random_texts(300, 60), "z" * 200 + " q"]  # one piece is too long to be remembered
    assert [x.tolist() for x in encoder.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert encoder.memo and all(isinstance(x, bytes) and len(x) % 4 == 0 for x in encoder.memo.values())
    two, at = np.arange(256), np.arange(65536).reshape(256, 256) % 64
    one = encoder.pairs.byte
    assert (encoder.pairs.first(two[:, None], two, at) == encoder.pairs.leaf(one[:, None], one[two], at)).all()


def test_an_encoder_holds_few_mb_over_ever_new_pieces():
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [[" ".join("".join(chr(97 + i // 26 ** k % 26) for k in range(5)) + "qx" for i in range(at, at + 1000))
              for at in range(first, first + 100_000, 1000)] for first in range(0, 600_000, 100_000)]
    tracemalloc.start()
    try:
        for part in texts:
            for ids in encoder.encode_all(part):
                assert len(ids) >= 1000
        assert tracemalloc.get_traced_memory()[1] < 70e6  # four workers of an executor may hold an encoder each
    finally:
        tracemalloc.stop()


def test_merging_alone_and_together_agree():
    ranks = bpe.read_ranks(RANKS)
    words = [w.encode() for w in {t[:20] for t in random_texts(800, 40)} if 1 < len(w.encode()) <= 64 and w.encode() not in ranks]
    assert bpe.merge_many(words, bpe.Pairs(ranks)) == [tuple(bpe.merge(w, ranks)) for w in words]


def test_lists_are_joined_without_an_object_for_every_id():
    token = {i: t for t, i in bpe.read_ranks(RANKS).items()}
    lists = pa.array([[7], [1, 2, 3], None, [], [4], [5, 6]], pa.list_(pa.int32()))
    whole = [None if x is None else b"".join(token[i] for i in x) for x in lists.to_pylist()]
    assert bpe.joined(lists, token).to_pylist() == whole and bpe.joined(lists[1:5], token).to_pylist() == whole[1:5]
    hidden = pa.ListArray.from_arrays(pa.array([0, 2, 4], pa.int32()), pa.array([1, 2, 3, 4], pa.int32()), mask=pa.array([True, False]))
    assert bpe.joined(hidden, token).to_pylist() == [None, token[3] + token[4]]
    with pytest.raises(KeyError):
        bpe.joined(pa.array([[1, -1]], pa.list_(pa.int32())), token)
    with pytest.raises(pa.ArrowInvalid):
        bpe.joined(pa.array([[1, None]], pa.list_(pa.int32())), token)

    def least(work):
        spent = []
        for _ in range(3):
            began = time.process_time()
            work()
            spent.append(time.process_time() - began)
        return min(spent)

    ids = [[i % 50_000 for i in range(k, k + 400)] for k in range(1000)]
    plain, many = least(lambda: [b"".join(map(token.__getitem__, x)) for x in ids]), pa.array(ids, pa.list_(pa.int32()))
    assert least(lambda: bpe.joined(many, token)) < 4 * plain  # an object for every id takes some 10 times as long


def test_documents_round_trip(spark, reference):
    coded = bpe.encode_documents(awkward(spark), RANKS, public_tokenizers.PATTERN)
    got = bpe.decode_documents(coded, RANKS).collect()
    assert len(got) == len(AWKWARD) and set(coded.columns) == {"doc_id", "text", "source", "score", "_fields", "token_ids", "n_tokens"}
    for row in got:
        assert row["token_ids"] == reference.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode() and row["n_tokens"] == len(row["token_ids"])
    assert bpe.encode_documents(nothing(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(JSON)


def test_counter_equals_the_library():
    whole, count = library(), token_counts.counter(JSON)
    texts = random_texts(800, 80) + ["a <|endoftext|> b<|endoftext|>", "<|endoftext|", "  \n\n  x", ""]
    assert count(texts) == [len(whole.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.library_counter(JSON)(texts[-4:]) == count(texts[-4:])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_through_their_library(name):
    path = public_tokenizers.path(name)
    assert name.endswith(".model") or token_counts.as_ranks(path) is None
    assert all(n > 0 for n in token_counts.counter(path)(["Some words", "und andere"]))


def test_counts_and_cache(spark, tmp_path):
    cache, whole = str(tmp_path / "cache"), library()
    got = token_counts.count_tokens(awkward(spark), JSON, cache).collect()
    assert len(got) == len(AWKWARD)
    for row in got:
        text = row["text"] or ""
        n = len(whole.encode(text, add_special_tokens=False))
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 512)
    version = token_counts.tokenizer_version(JSON)
    known = token_counts.read_cache(spark, cache, version).collect()
    assert {bytes(r["digest"]) for r in known} == {hashlib.sha256((t or "").encode()).digest() for _, t, _ in AWKWARD}
    assert len(known) == len({t or "" for _, t, _ in AWKWARD})


def test_only_misses_are_encoded_and_versions_do_not_mix(spark, tmp_path):
    cache, docs = str(tmp_path / "cache"), awkward(spark)
    version = token_counts.fill_cache(docs.where("doc_id = 1"), JSON, cache)
    assert token_counts.read_cache(spark, cache, version).count() == 1
    token_counts.fill_cache(docs, JSON, cache)
    rows = token_counts.read_cache(spark, cache, version).collect()
    assert len(rows) == len({bytes(r["digest"]) for r in rows}) == len({t or "" for _, t, _ in AWKWARD})
    token_counts.fill_cache(docs, JSON, cache)
    assert token_counts.read_cache(spark, cache, version).count() == len(rows)
    assert token_counts.read_cache(spark, cache, "another").count() == 0
    assert token_counts.count_tokens(nothing(spark), JSON, cache).count() == 0
