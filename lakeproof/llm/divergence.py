"""Source divergence audit: how the terms of each source differ from its language and from the other sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import quoted
from .common import bounded_batches, staged, text_of

LEAST_DOCS, TOP = 30, 50
#: Added to every count, and what a share of one is worth.
PRIOR, UNIT = 5, 1_000_000_000
#: Terms of a chunk and sources of a tile that one task compares, and terms of groups that a worker holds (some 150 MB) before it passes them on.
CHUNK, TILE, HELD = 4096, 256, 1_000_000
#: Kept digests that are sent to all tasks (some 30 MB); more are joined by a shuffle.
SENT = 200_000

#: Every byte that is no letter of ASCII and no part of a longer character becomes a blank; A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted_terms(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, d``: occurrences and documents of each term among the rows of a task; and one
    row without term for each group, which stands for the group where no term does. At most ``most`` terms are held beyond a batch."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            size = len(n) + 1
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            counts = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[x] for x in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, *counts],
                                             ["lang", "source", "term", "n", "d"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(LETTERS).split()
            n.update(words)
            d.update(set(words))
        if sum(len(n) for n, _ in held.values()) > most:
            yield from passed_on()
    yield from passed_on()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)) by long division in three steps of a thousand.

    Exact in 64-bit integers for totals below 9 * 10^15; null where there is no term.
    """
    whole = total + PRIOR * terms
    per = F.when(whole > 0, whole)
    rest, digits = count + PRIOR, F.lit(1).cast("long")
    for worth in (1_000_000, 1_000, 1):
        digits = digits + F.call_function("div", rest * 1000, per) * worth
        rest = (rest * 1000) % per
    return digits


def staged_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str, digest_bits: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    read = docs.select(text_of(lang_col), text_of(source_col), text_of(text_col).cast("binary"))
    most = HELD
    counts = read.mapInArrow(lambda batches: counted_terms(batches, most), "lang string, source string, term string, n long, d long")
    digest = F.shiftrightunsigned(F.xxhash64("term"), 64 - digest_bits)  # made again by each pass: cheaper than stored
    return staged(counts, "terms").withColumn("digest", F.when(F.col("term").isNotNull(), digest))


def kept_terms(found: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """``lang, source, digest, split, n`` of every kept term and group it occurs in, and ``lang, digest, low``.

    Counts travel by digest alone, in hash aggregates that every task reduces first: documents of each digest, then, for digests
    that reach ``least_docs``, occurrences in each source. The least and greatest string of each kept digest tell whether several
    terms share it; only such a digest is counted again by its strings (``split``, null elsewhere).
    """
    docs = found.where("digest is not null").groupBy("lang", "digest").agg(F.sum("d").alias("docs"))
    wanted = staged(docs.where(F.col("docs") >= least_docs).select("lang", "digest"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    near = found.join(wanted, ["lang", "digest"], "left_semi")
    candidates = staged(near.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n")), "candidates")
    spelt = near.select("lang", "digest", "term").distinct()  # a hash aggregate; extremes of strings would sort all rows
    texts = staged(spelt.groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "texts")
    shared = texts.where("low <> high").select("lang", "digest")
    apart = (found.join(shared, ["lang", "digest"], "left_semi").groupBy("lang", "source", "digest", "term")
             .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
             .withColumn("docs", F.sum("d").over(Window.partitionBy("lang", "digest", "term")))
             .where(F.col("docs") >= least_docs).select("lang", "source", "digest", F.col("term").alias("split"), "n"))
    whole = candidates.join(shared, ["lang", "digest"], "left_anti").select("lang", "source", "digest", F.lit(None).cast("string").alias("split"), "n")
    return staged(whole.unionByName(apart), "kept"), texts.select("lang", "digest", "low")


def gaps(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one chunk of terms and one pair of source tiles: for each two sources the sum of differences, and the terms met.

    Rows without digest give the share of a term that the source lacks; all others that of a term it has.
    """
    base = frame[frame["digest"].isna()].sort_values("s")
    have = frame[frame["digest"].notna()]
    sources, lacking = base["s"].to_numpy(), base["p"].to_numpy(np.int64)
    column = np.searchsorted(sources, have["s"].to_numpy())
    row = have.groupby(["digest", "split"], dropna=False).ngroup().to_numpy() if len(have) else np.array([], np.int64)
    terms = int(row.max()) + 1 if len(row) else 0
    shares = np.repeat(lacking[None, :], terms, axis=0)
    shares[row, column] = have["p"].to_numpy(np.int64)
    a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
    out = []
    for i in np.flatnonzero(sources // TILE == a):
        others = np.flatnonzero((sources // TILE == b) & (sources > sources[i]))
        if len(others):
            sums = np.abs(shares[:, others] - shares[:, [i]]).sum(axis=0)
            out.append(pd.DataFrame({"i": sources[i], "j": sources[others], "f": sums, "met": terms}))
    whole = pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "f": [], "met": []}).astype("int64")
    return whole.assign(lang=frame["lang"].iloc[0])[["lang", "i", "j", "f", "met"]]


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", digest_bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source of a language against the other sources and the language.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; a language keeps those in at least
    ``least_docs`` of its documents. A group's share of a kept term is ``share`` of its count. Part ``pair``: every other source of the
    language, with the differences of their shares over all kept terms; part ``term``: the ``top`` terms whose share
    in the group exceeds that in the language by most. Equal values rank by item.

    Terms are counted in the task that reads them and added up by digest; strings come back for the kept digests alone.
    Sources are compared in tiles of ``TILE``, over chunks of ``CHUNK`` terms, so a task's memory is bounded.
    Null text, language and source are ''; repeated rows count each; a text without letters adds its group only; no rows
    give no rows; other columns are not read. ``digest_bits`` below 64 makes collisions, for tests.
    """
    found = staged_terms(docs, text_col, lang_col, source_col, digest_bits)
    kept, texts = kept_terms(found, least_docs)
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_distinct("digest", F.coalesce("split", F.lit(""))).alias("terms"))
    names = found.where("digest is null").select("lang", "source").distinct()
    many = names.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))
    zero = F.lit(0).cast("long")
    sized = (names.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").join(many, "lang")
             .select("lang", "source", "many", *[F.coalesce(c, zero).alias(c) for c in ("own", "whole", "terms")]))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = staged(sized.withColumn("s", number).withColumn("lacking", share(zero, F.col("own"), F.col("terms"))), "groups")
    shares = staged(kept.join(groups, ["lang", "source"])
                    .withColumn("p", share(F.col("n"), F.col("own"), F.col("terms")))
                    .withColumn("in_lang", F.sum("n").over(Window.partitionBy("lang", "digest", "split")))
                    .withColumn("q", share(F.col("in_lang"), F.col("whole"), F.col("terms")))
                    .select("lang", "source", "s", "many", "terms", "digest", "split", "p", "q"), "shares")

    # the terms of a group
    over = shares.where("p > q").withColumn("value", F.expr("p - q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = over.withColumn("rank", F.rank().over(by_value)).where(F.col("rank") <= top).join(texts, ["lang", "digest"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (first.withColumn("item", F.coalesce("split", "low")).withColumn("rank", F.row_number().over(ranked))
             .where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

    # the pairs of sources of a language
    def dealt(df: DataFrame, chunk: Column) -> DataFrame:
        """A row for each pair of source tiles that its own tile takes part in."""
        tile = F.floor(F.col("s") / TILE).cast("int")
        other = F.explode(F.expr(f"sequence(0, cast((many - 1) div {TILE} as int))"))
        tiled = df.withColumn("chunk", chunk).withColumn("own_tile", tile).withColumn("other", other)
        return tiled.select("lang", "chunk", F.least("own_tile", "other").alias("a"), F.greatest("own_tile", "other").alias("b"), "s", "digest", "split", "p")

    chunks = F.expr(f"greatest(1, cast((terms + {CHUNK - 1}) div {CHUNK} as int))")
    lacking = groups.select("lang", "s", "many", "terms", F.lit(None).cast("long").alias("digest"), F.lit(None).cast("string").alias("split"),
                            F.coalesce("lacking", zero).alias("p"))
    both = dealt(shares, F.pmod(F.xxhash64("digest", "split"), chunks).cast("int")).unionByName(
        dealt(lacking.withColumn("at", F.explode(F.sequence(F.lit(0), chunks - 1))), F.col("at")))
    parts = both.groupBy("lang", "chunk", "a", "b").applyInPandas(gaps, "lang string, i int, j int, f long, met long")
    summed = parts.groupBy("lang", "i", "j").agg(F.sum("f").alias("f"), F.sum("met").alias("met"))
    left = groups.select("lang", F.col("s").alias("i"), F.col("source").alias("left"), F.coalesce("lacking", zero).alias("p"), "terms")
    right = groups.select("lang", F.col("s").alias("j"), F.col("source").alias("right"), F.coalesce("lacking", zero).alias("q"))
    valued = summed.join(left, ["lang", "i"]).join(right, ["lang", "j"]).withColumn("value", F.expr("f + (terms - met) * abs(p - q)"))
    pairs = (valued.selectExpr("lang", "inline(array(struct(left as source, right as item), struct(right as source, left as item)))", "value")
             .withColumn("rank", F.row_number().over(ranked)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))
    return pairs.unionByName(terms)
