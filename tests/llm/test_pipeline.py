import os

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, nothing

from lakeproof.llm import bpe, decontaminate, linededup, simhash
from lakeproof.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"  # the smallest tables have too few labels for any document to be rejected
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    results = []
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.staged(stage(spark, kept, SF), "stage")
        results.append(kept)
    assert all(r.columns == columns for r in results[:-1])
    toxic, lines, distinct, clean, coded = results
    assert 0 < clean.count() <= distinct.count() <= lines.count() == toxic.count() < docs.count()
    rejected = {r["doc_id"] for r in QUERIES["op10_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in toxic.collect()} == rejected
    left = [x for r in lines.collect() for x in {linededup.normal(y) for y in r["text"].split("\n")} if len(x) >= linededup.LEAST_CHARS]
    assert len(left) == len(set(left))
    classes = {r["component_id"] for r in simhash.near_duplicates(lines).collect()}
    assert {r["doc_id"] for r in distinct.collect()} == classes
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.contamination(distinct, bench).where("contaminated").collect()}
    assert hit and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in distinct.collect()} - hit
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in coded.collect():
        assert r["round_trip"] and list(r["token_ids"]) == reference.encode_ordinary(r["text"])


def test_run_gives_the_rows_of_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_stages_with_awkward_rows_and_columns_that_clash(spark):
    docs = awkward(spark).selectExpr("*", "7 as predicted", "'e' as evidence", "3 as `a.b c`", "1 as component_id", "9 as decoded", "'k' as _hash")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.staged(stage(spark, kept, SF), "stage")
        assert kept.columns == columns, name
        assert kept.where("predicted <> 7 or evidence <> 'e' or score <> 1.5 or decoded <> 9 or _hash <> 'k' or N_Tokens <> 7").isEmpty()
    assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in docs.collect()} and kept.count() > 0
    coded = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert coded.columns == [c for c in columns if c != "N_Tokens"] + ["n_tokens", "token_ids", "round_trip"]
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in coded.collect())
    kept = nothing(spark)
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.staged(stage(spark, kept, SF), "stage")
        assert kept.count() == 0
