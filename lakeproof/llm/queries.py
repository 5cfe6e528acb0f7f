"""The registered queries of the text operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, decontaminate, divergence, linededup, negatives, packing, quality, secrets, sharding, simhash, token_counts, topk, toxicity
from .common import training_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~training_row()).alias("held_out"), "score", "predicted")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = scratch_path(spark, "token-cache")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


OP4_SQL = """
with ints as (select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::double) as v from embeddings
              where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, d.vec_id, list_dot_product(q.v, d.v)::bigint as score
           from ints q, ints d where q.vec_id % 20 = 0 and q.vec_id <> d.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""


@query("op4_exact_top_k", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


FOLDED = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP5_SQL = f"""
with docs as (select doc_id, row_number() over () as r, {FOLDED} as w from documents),
items as (select item_id, {FOLDED} as w from benchmark),
wins as (select distinct item_id, len(g) as n, array_to_string(g, ' ') as gram
         from (select item_id, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: w[i + 1:i + 10])) as g
               from items where len(w) > 0)),
sizes as (select distinct n from wins),
doc_wins as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
             from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
hits as (select d.r, d.n, d.i, v.item_id from doc_wins d join wins v using (n, gram)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
named as (select r, count(*) as n_items, string_agg(x, ',' order by x) as names
          from (select distinct r, cast(item_id as varchar) as x from hits) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join named using (r)
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("hit_items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), "contaminated")


@query("op6_secret_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.expr(f"cast(size(filter(base_secrets, s -> s.kind = {k})) as long)").alias(f"n_{kind}")
             for k, kind in enumerate(secrets.KINDS[:3])]
    base = F.sha2(secrets.spelled(F.col("base_secrets")).cast("binary"), 256)
    return found.select("doc_id", *count, base.alias("base_sha256"), secrets.spelled(F.col("secrets")).alias("spans"))


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "token_ids")
    ids = F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256)
    decoded = bpe.decode_documents(coded, ranks)
    return decoded.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=1)
    return found.select(F.col("key").alias("doc_id"), "line_no", F.col("first_key").alias("class_doc_id"),
                        F.col("first_line").alias("class_line_no"), "kept")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~training_row()).alias("held_out"), "score", "predicted", "evidence")


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut_documents(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


OP12_SQL = """
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                     regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') as w
              from documents),
words as (select r, lang, source, unnest(w) as t from docs),
kept as (select lang, t from words group by lang, t having count(distinct r) >= 30),
sizes as (select lang, count(*) as v from kept group by lang),
places as (select distinct lang, source from docs),
hits as (select lang, source, t, count(*) as c from words group by lang, source, t),
grid as (select p.lang, p.source, k.t, coalesce(h.c, 0) as c, s.v
         from places p join kept k using (lang) join sizes s using (lang) left join hits h using (lang, source, t)),
shares as (select lang, source, t, c, 1 + (1000000000::hugeint * (c + 5)) // (sum(c) over (partition by lang, source) + 5 * v) as p,
                  1 + (1000000000::hugeint * (sum(c) over (partition by lang, t) + 5)) // (sum(c) over (partition by lang) + 5 * v) as q
           from grid),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.f, 0)::bigint as value
          from places a join places b on a.lang = b.lang and a.source <> b.source
          left join (select y.lang, y.source, z.source as other, sum(abs(y.p - z.p)) as f
                     from shares y join shares z on y.lang = z.lang and y.t = z.t group by all) x
               on x.lang = a.lang and x.source = a.source and x.other = b.source),
terms as (select lang, source, 'term' as part, t as item, (p - q)::bigint as value from shares where c > 0 and p > q)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 50
"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = """
with rows as (select distinct vec_id as id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label,
                     list_transform(embedding, lambda x: floor(256 * x::double)::double) as v
              from embeddings where vec_id is not null and label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.id as anchor_id, b.id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
           from rows a, rows b where a.id % 100 = 0 and a.id <> b.id),
positives as (select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id,
       cast(row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as integer) as rank,
       n.id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
     and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify rank <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy.alias("label"))
    return negatives.hard_negatives(vectors, F.col("id") % 100 == 0)
