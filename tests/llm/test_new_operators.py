"""Packing, source divergence and hard negatives against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, nothing
from pyspark.sql import functions as F

from lakeproof.llm import divergence, negatives, packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


# ---- packing --------------------------------------------------------------------------------

def sequential_best_fit(lengths, capacity):
    """One document after the other, longest first, into the fullest sequence that has room."""
    room = []
    for length in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= length]
        if not fit:
            room.append(capacity)
            fit = [len(room) - 1]
        room[min(fit, key=lambda i: room[i])] -= length
    return sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_planning_by_counts_equals_best_fit_document_by_document(seed):
    draw, capacity = random.Random(seed), [16, 40, 100, 100, 64, 1024][seed]
    lengths = [min(capacity, 1 + int(draw.expovariate(6 / capacity))) for _ in range(300)]
    plan, sequences = packing.best_fit(Counter(lengths), capacity)
    used, ranks = Counter(), Counter()
    for run in sorted(plan):
        assert run.rank == ranks[run.length]
        rank = run.rank
        follows = [r.rank for r in plan if r.length == run.length and r.rank > rank]
        many = (min(follows) if follows else Counter(lengths)[run.length]) - rank
        for k in range(many):
            used[run.sequence + k // run.each] += run.length
        ranks[run.length] += many
    assert ranks == Counter(lengths) and len(used) == sequences
    assert sorted(capacity - x for x in used.values()) == sequential_best_fit(lengths, capacity)


def test_planning_does_not_grow_with_the_counts():
    few, _ = packing.best_fit({i: 3 for i in range(1, 1025)})
    many, sequences = packing.best_fit({i: 3_000_000_000 for i in range(1, 1025)})
    assert len(many) < 4 * len(few) < 40_000
    assert sequences >= sum(i * 3_000_000_000 for i in range(1, 1025)) / 1024


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def library_pieces(text, capacity, end):
    ids = library().encode(text or "", add_special_tokens=False).ids + [end]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def gapless(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pieces_and_places_of_awkward_documents(spark):
    docs = awkward(spark)
    got = packing.pack_documents(docs, JSON, capacity=64).collect()
    expected = Counter((r["doc_id"], *x[:3], tuple(x[3])) for r in docs.collect() for x in library_pieces(r["text"], 64, 2))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in got) == expected
    total = sum(r["length"] for r in got)
    assert gapless(got, 64) <= math.ceil(total / 64) + 1


def test_a_hot_length_over_many_tasks_and_clashing_columns(spark):
    lengths = [7] * 900 + [5] * 200 + [16] * 50 + [1] * 40
    rows = spark.createDataFrame([(n, i, "x", -1, 0) for i, n in enumerate(lengths)], "length int, _row long, _task string, sequence_id int, `a b` int")
    got = packing.pack(rows.repartition(13), 16)
    assert got.columns == ["length", "_row", "_task", "a b", "sequence_id", "offset"]
    found = got.collect()
    assert sorted(r["_row"] for r in found) == list(range(len(lengths)))
    assert gapless(found, 16) == len(sequential_best_fit(lengths, 16))


def test_packing_nothing_and_lengths_that_do_not_fit(spark):
    assert packing.pack_documents(nothing(spark), JSON).collect() == []
    for bad in (0, 17, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(3,), (bad,)], "length int"), 16)


def test_the_query_packs_every_document_of_the_tables(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op11_best_fit_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    expected = Counter((r["doc_id"], *x[:3], crc(x[3])) for r in docs for x in library_pieces(r["text"], 1024, 2))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    assert gapless(got, 1024) <= math.ceil(sum(r["length"] for r in got) / 1024 * 1.01)


# ---- divergence -----------------------------------------------------------------------------

def plain_audit(rows, least_docs, top):
    words = [(r["lang"] or "", r["source"] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})))
             for r in rows]
    in_docs = Counter((lang, t) for lang, _, w in words for t in set(w))
    out = []
    for lang in {x[0] for x in words}:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least_docs)
        sources = sorted({s for x, s, _ in words if x == lang})
        count = {s: Counter(t for x, y, w in words if (x, y) == (lang, s) for t in w if t in set(kept)) for s in sources}
        whole = sum(count.values(), Counter())
        part = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: part(count[s]) for s in sources}, part(whole)
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pair, key=lambda x: (x[0], x[1].encode())), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(sorted(term, key=lambda x: (x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


def prose(seed=3, many=120):
    draw = random.Random(seed)
    vocabulary = ["Alpha", "beta", "ÄÖ", "漢字", "don't", "x1y", "gamma", "DELTA", "éa", "zeta", "eta", "theta"]
    return [{"text": draw.choice([None, "", "12 34 ..", " ".join(draw.choices(vocabulary, k=draw.randrange(1, 30)))]) if i % 3 == 0
             else " ".join(draw.choices(vocabulary[: 3 + i % 9], k=12)) + ("\n" + "word " * 50 if i % 11 == 0 else ""),
             "lang": draw.choice(["en", "en", "de", None]), "source": draw.choice(["a", "b", "ä", "", None, "z"])} for i in range(many)]


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_audit_equals_the_plain_version_with_any_number_of_collisions(spark, monkeypatch, bits):
    rows = prose()
    docs = spark.createDataFrame([(r["text"], r["lang"], r["source"], "en", 1) for r in rows], "text string, lang string, source string, item string, rank int")
    if bits == 3:  # several chunks of terms and tiles of sources
        monkeypatch.setattr(divergence, "CHUNK", 4)
    got = divergence.audit_sources(docs.repartition(5), least_docs=9, top=4, digest_bits=bits)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 9, 4)


def test_audit_without_kept_terms_without_rows_and_in_many_flushes(spark, monkeypatch):
    rows = prose(5, 40)
    docs = spark.createDataFrame([(r["text"], r["lang"], r["source"]) for r in rows], "text string, lang string, source string")
    got = divergence.audit_sources(docs, least_docs=1000)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 1000, 50)
    monkeypatch.setattr(divergence, "HELD", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        passed_on = divergence.audit_sources(docs, least_docs=3)
        assert sorted(map(tuple, passed_on.collect())) == plain_audit(rows, 3, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert divergence.audit_sources(docs.where("false")).collect() == []


def test_shares_are_exact_beyond_products_of_64_bits(spark):
    cases = [(0, 0, 1), (10**12 + 7, 3 * 10**12 + 1, 10**6), (8 * 10**15, 8 * 10**15, 3), (0, 8 * 10**15, 10**9), (5, 7, 0), (0, 0, 0)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    for c, n, v, p in df.collect():
        assert p == (1 + 10**9 * (c + 5) // (n + 5 * v) if n + 5 * v else None)


def test_sources_in_several_tiles(monkeypatch):
    """Differences of two tiles of sources, as one task computes them."""
    import pandas as pd

    monkeypatch.setattr(divergence, "TILE", 2)
    base = [("en", 0, 0, 1, s, None, None, 10 + s) for s in range(4)]
    have = [("en", 0, 0, 1, s, t, None, 100 * s + t) for s in range(4) for t in range(5) if (s + t) % 2]
    frame = pd.DataFrame(base + have, columns="lang chunk a b s digest split p".split())
    got = {(r.i, r.j): (r.f, r.met) for r in divergence.gaps(frame).itertuples()}
    p = {(s, t): 100 * s + t if (s + t) % 2 else 10 + s for s in range(4) for t in range(5)}
    assert got == {(i, j): (sum(abs(p[i, t] - p[j, t]) for t in range(5)), 5) for i in (0, 1) for j in (2, 3)}


# ---- hard negatives -------------------------------------------------------------------------

def plain_negatives(rows, anchors, positives=5, count=5):
    held = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = []
    for a in anchors:
        label, v = held[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in held.items() if i != a}
        for p in sorted((i for i in score if held[i][0] == label), key=lambda i: (-score[i], i))[:positives]:
            near = [i for i in score if held[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k, n, score[p], score[n]) for k, n in enumerate(sorted(near, key=lambda i: (-score[i], i))[:count], 1)]
    return sorted(out)


@pytest.mark.parametrize(("width", "size"), [(8, 1), (64, 1), (3, 2000), (700, 1e4)])
def test_mining_equals_the_plain_version(spark, monkeypatch, width, size):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "TILE", 3)
    draw = np.random.default_rng(width)
    rows = [(i, int(draw.integers(0, 3)), (draw.integers(-3, 8, width) * size / 4).tolist()) for i in range(150)]
    rows += [(200 + i, 2, rows[i][2]) for i in range(20)]  # ties
    odd = [(300, None, [1.0] * width), (301, 1, None), (302, 1, [float("nan")] * width), (303, 1, [None] * width),
           (304, 1, [float("inf")] + [0.0] * (width - 1)), (None, 1, [1.0] * width), (306, 1, [1e300] * width)]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd + rows[:3]], "vec_id long, label int, embedding array<double>, score int")
    got = negatives.hard_negatives(df, F.col("id") % 9 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(map(tuple, got.collect()))
    assert found == plain_negatives(rows, [i for i, *_ in rows if i % 9 == 0]) and found


def test_residues_are_exact_at_the_limits():
    for width, largest in ((1, 2**29), (64, 2**26), (3000, 2**23), (5000, 9)):
        draw = np.random.default_rng(width)
        a = draw.integers(-largest, largest, (5, width)) if width > 1 else np.array([[largest], [-largest], [0], [1], [largest - 1]])
        bound = int((a.astype(object) ** 2).sum(axis=1).max())
        assert bound < negatives.NORM_LIMIT * 1.1
        held = negatives.Residues(width, bound)
        rows = held.of(a.astype(float))
        assert (held.scores(rows, rows).astype(object) == a.astype(object) @ a.astype(object).T).all()
        assert len(held.primes) >= 2 or bound < 10**4


def test_mining_with_vectors_of_several_widths_no_anchor_and_no_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [0.9, 1.0, 5.0]), (3, 2, []), (4, 1, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = negatives.hard_negatives(df, F.col("id") == 0, negatives=2)
    exact = [(i, label, [np.float32(x).item() for x in v] + [0.0] * (3 - len(v))) for i, label, v in rows]
    assert sorted(map(tuple, got.collect())) == plain_negatives(exact, [0], 5, 2)
    assert negatives.hard_negatives(df, F.col("id") > 9).collect() == []
    assert negatives.hard_negatives(df.where("false"), F.col("id") == 0).collect() == []
