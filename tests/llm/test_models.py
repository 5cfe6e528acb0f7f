import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import AWKWARD, awkward, nothing

from lakeproof.llm import quality, topk, toxicity
from lakeproof.llm.common import labelled_sample

CLEAN = ["the river runs past an old mill and a garden", "a letter arrived late in the evening", "bread and soup were on the table",
         "they walked along the coast until dusk", "the train left the station on time"]
RUDE = ["you utter nitwit get lost", "what a nitwit and a bonehead", "such boneheads should go", "nitwits everywhere"]


def corpus():
    r = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        good = i % 4 != 1
        text = " ".join(r.choice(CLEAN, 4)) + (" " + " ".join(r.choice(RUDE, 2)) if toxic else "")
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    extra = [(None, "x"), (0, rows[0][1]), (900, None), (901, "")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows + extra], "doc_id long, text string, predicted string")
    known = spark.createDataFrame(labels + [(0, 0, 0), (2, None, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, known


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(spark, name):
    docs, labels = frames(spark)
    if name == "quality":
        got = quality.score_quality(docs, quality.fit(docs, labels))
    else:
        got = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    got = got.collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: (q, t)[name == "toxic"] for i, q, t in corpus()[1]}
    tested = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in truth and held_out(r["doc_id"])]
    assert len(tested) > 60 and sum(a == b for a, b in tested) / len(tested) > 0.97
    assert len({r["score"] for r in got if not r["text"]}) == 1


def test_only_training_rows_are_learned_from_and_the_sample_is_bounded(spark):
    docs, labels = frames(spark)
    rows, totals = labelled_sample(docs, labels, "toxic", 10)
    got = rows.collect()
    assert not any(held_out(r["doc_id"]) for r in got) and len(got) == 20
    assert sum(totals.values()) == sum(not held_out(i) for i in range(300))


def test_models_without_labels_score_all_alike(spark):
    docs, none = awkward(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (quality.score_quality(docs, quality.fit(docs, none)), toxicity.score_toxicity(docs, toxicity.fit(docs, none))):
        assert len({r["score"] for r in got.collect()}) == 1 and got.count() == len(AWKWARD)
    empty = nothing(spark)
    assert quality.score_quality(empty, quality.fit(empty, none)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, none)).count() == 0


def test_terms_of_examples_leave_a_worker_in_small_parts():
    class Caught:
        def select(self, *_):
            return self

        def mapInPandas(self, function, _):
            return function

    texts = [" ".join(f"w{(i * 37 + k) % 5000:04d}x" for k in range(400)) for i in range(300)] + ["", "one one"]
    batch = pd.DataFrame({"doc_id": range(len(texts)), "label": [i % 2 for i in range(len(texts))], "text": texts})
    parts = list(toxicity.example_terms(Caught())(iter([batch, batch[:0], batch[:1]])))
    expected = [toxicity.levelled(Counter(t for w in x.split() for t in toxicity.word_terms(w))) for x in texts]
    most = max(map(len, expected))
    assert sum(map(len, expected)) > 2 * toxicity.TERMS_AT_ONCE
    assert all(0 < sum(map(len, p["terms"])) < toxicity.TERMS_AT_ONCE + most for p in parts)
    rows = [(i, x, dict(zip(t, n))) for p in parts for i, x, t, n in p.itertuples(index=False)]
    assert rows == [(i, i % 2, x) for i, x in [*enumerate(expected), (0, expected[0])]]


def test_block_max_search_is_exact():
    r = np.random.default_rng(1)
    vectors = []
    for _ in range(300):
        raw = {int(t): float(w) for t, w in zip(r.choice(40, 5, replace=False), r.random(5).round(1) + 0.1)}
        length = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / length for t, w in raw.items()})
    vectors += vectors[:20]
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    for q in vectors[:60]:
        scores = [(sum(w * v.get(t, 0.0) for t, w in q.items()), d) for d, v in enumerate(vectors)]
        want = sorted((x for x in scores if x[0] > 0), key=lambda x: (-round(x[0], 9), x[1]))[:7]
        got = index.nearest(q, 7)
        assert np.allclose([s for s, _ in got], [s for s, _ in want])
        assert index.nearest(q, 7, without=5) == [x for x in index.nearest(q, 8) if x[1] != 5][:7]
    assert index.nearest({}, 3) == []


def test_cosines_and_votes_are_exact():
    r = np.random.default_rng(2)
    counts = r.poisson(0.02, (50, quality.FEATURES)).astype(np.float32)
    directions = r.standard_normal((quality.FEATURES, 8)).astype(np.float32)
    model = quality.Model(np.ones(quality.FEATURES, np.float32), directions, None, (np.arange(50) % 3 == 0).astype(float), np.ones(50), 0.3)
    model.vectors = model.latent(counts)
    got = model.scores(counts)
    for i in range(50):
        cos = model.vectors[i].astype(float) @ model.vectors.T.astype(float)
        near = np.argsort(-cos)[:quality.NEIGHBOURS]
        mass = np.maximum(cos[near], 0) ** 4
        want = ((mass * model.labels[near]).sum() + 1e-3 * 0.3) / (mass.sum() + 1e-3)
        assert got[i] == pytest.approx(want, abs=1e-4)


def plain_top(rows, asked, k):
    ints = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in ints:
        if q in asked:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def vectors(n, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, 6))
    rows = [(i, [float(x) for x in (centres[i % 5] + 0.3 * r.standard_normal(6)).round(2)]) for i in range(n)]
    same = [(n + i, [0.5] * 6) for i in range(60)]
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6),
           (2004, [1.0, 2.0]), (2005, []), (3, rows[3][1])]
    return rows + same + odd


@pytest.mark.parametrize("k, data_block, query_block", [(4, 4096, 1024), (4, 40, 15), (20, 30, 10), (500, 100, 50)])
def test_top_k(spark, k, data_block, query_block):
    rows = vectors(240, k)
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k, data_block=data_block, query_block=query_block)
    want = plain_top(rows, asked, k)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 0


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, one).count() == 0


def test_cover_tree_of_rows_that_are_all_as_far_apart_has_whole_leaves():
    rows = np.floor(64 * np.random.default_rng(5).standard_normal((3000, 64)) / 8)
    rows[7:27] = rows[7]  # twenty equal rows tie
    tree = topk.CoverTree(rows)
    leaves = [n for n in tree.nodes if not n[3]]
    assert sorted(np.concatenate([n[4] for n in leaves]).tolist()) == list(range(3000)) and len(tree.nodes) < 60
    for middle, _, radius, _, members in tree.nodes:
        assert np.sqrt(((rows[members] - middle) ** 2).sum(axis=1)).max() <= radius + 1e-9
    best = topk.Best(np.arange(100), 20, np.full(100, -np.inf))
    topk.search(topk.CoverTree(rows[:100]), tree, np.arange(3000), best)
    for i in range(100):
        order = sorted((-float(rows[i] @ rows[j]), j) for j in range(3000) if j != i)[:20]
        assert best.found[i].tolist() == [j for _, j in order] and best.score[i].tolist() == [-s for s, _ in order]


def test_cover_tree_covers_and_prunes():
    r = np.random.default_rng(3)
    rows = np.concatenate([r.standard_normal((300, 3)) * 0.1 + c for c in (np.zeros(3), np.full(3, 9.0), np.full(3, -9.0))])
    tree = topk.CoverTree(rows, leaf=8)
    assert sorted(np.concatenate([n[4] for n in tree.nodes if not n[3]]).tolist()) == list(range(900))
    for middle, _, radius, _, members in tree.nodes:
        assert np.sqrt(((rows[members] - middle) ** 2).sum(axis=1)).max() <= radius + 1e-9
    queries, seen = topk.CoverTree(rows[300:320], leaf=8), []
    best = topk.Best(np.arange(300, 320), 3, np.full(20, -np.inf))
    add = best.add
    best.add = lambda members, ids, scores: (seen.append(scores.size), add(members, ids, scores))
    topk.search(queries, tree, np.arange(900), best)
    assert sum(seen) < 20 * 900 / 2
    for i in range(20):
        order = sorted((-float(rows[300 + i] @ rows[j]), j) for j in range(900) if j != 300 + i)[:3]
        assert best.found[i].tolist() == [j for _, j in order]
