"""Fuzzy line de-duplication: MinHash of character shingles, banding, exact Jaccard, one line per component."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import quoted
from .common import bounded_batches, components, fresh, mixed, staged, text_of
from .groups import edges_batch, forest, in_units, runs

#: Characters of a shingle, the least Jaccard similarity, and the least characters of a line that gets a row
#: unless the caller asks for longer ones: every line that is not blank.
SHINGLE, SIMILARITY, LEAST_CHARS = 8, 0.8, 1
#: Bands and rows of the signature: a pair of similarity 0.8 shares a band with a probability of 99.5 %.
BANDS, ROWS = 10, 4
BINS = BANDS * ROWS
#: Characters hashed at a time, and of the lines of a group (or, of a larger group, of a bucket) that a task compares at most twice as many of.
BLOCK_CHARS, CHUNK_CHARS = 1 << 20, 2 << 20
EMPTY = np.uint64(1 << 62)
#: Lines of a unit up to which all its pairs are counted, together with those of other such units.
FEW = 8


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> int:
    """A signed 64-bit digest of a normalised line (n lines meet wrongly with a probability of n^2 / 2^65)."""
    value = xxhash.xxh3_64_intdigest(line.encode("utf-8"))
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all character shingles of the lines, one after the other, and the line of each."""
    lengths = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    rolled, width = codes, 1
    while width < SHINGLE:
        factor = np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64))
        rolled = rolled[:-width] * factor + rolled[width:] if len(rolled) > width else rolled[:0]
        width *= 2
    ends = np.cumsum(lengths)
    line = np.repeat(np.arange(len(lines)), lengths)[:len(rolled)]
    whole = np.arange(len(rolled)) + SHINGLE <= ends[line] if len(rolled) else np.zeros(0, bool)
    return mixed(rolled[whole]), line[whole]


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash: the smallest hash of each bin; an empty bin takes the next one's, marked by the distance."""
    hashes, line = shingle_hashes(lines)
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    flat = np.full(len(lines) * BINS, EMPTY)
    np.minimum.at(flat, line * BINS + bins, hashes & np.uint64(0xFFFFFFFF))
    out = flat.reshape(len(lines), BINS)
    bare = out == EMPTY
    for far in range(1, BINS):
        rows = np.flatnonzero(bare.any(axis=1))
        if not len(rows):
            break
        other = np.roll(out[rows], -far, axis=1)
        usable = bare[rows] & (other < np.uint64(1 << 32))
        out[rows] = np.where(usable, other + np.uint64(far << 32), out[rows])
        bare[rows] &= ~usable
    return out


def band_keys(sign: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each line and band."""
    rows = sign.reshape(len(sign), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for i in range(ROWS):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, i])
    return key.view(np.int64)


def lines_of(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """``key, hash, line_no, id`` of every line of so many characters."""
    for batch in batches:
        for start in range(0, len(batch), 100):
            part = batch.slice(start, 100)
            own, number, ids = [], [], []
            for row, text in enumerate(part.column(2).to_pylist()):
                for i, line in enumerate(text.split("\n")):
                    line = normal(line)
                    if len(line) >= least_chars:
                        own.append(row)
                        number.append(i)
                        ids.append(line_id(line))
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(number, pa.int32()), pa.array(ids, pa.int64())],
                                             ["key", "hash", "line_no", "id"])


def distinct_lines(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of the distinct lines of a batch with their ids; lines without a shingle have no others to be similar to."""
    least_chars = max(least_chars, SHINGLE)
    for batch in batches:
        seen: dict[int, str] = {}
        for text in batch.column(0).to_pylist():
            for line in map(normal, text.split("\n")):
                if len(line) >= least_chars:
                    seen.setdefault(line_id(line), line)
        yield from blocks(seen.items())


def blocks(known: Iterable[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    """The ids and lines in blocks of about BLOCK_CHARS characters."""
    ids, lines, room = [], [], BLOCK_CHARS
    for i, line in known:
        ids.append(i)
        lines.append(line)
        room -= len(line)
        if room <= 0:
            yield ids, lines
            ids, lines, room = [], [], BLOCK_CHARS
    if ids:
        yield ids, lines


def keys_of(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """``key, id`` so that lines of equal band keys are linked by equal keys, with few rows for a hot key.

    Of the lines of a block that share a band key, only the first sends it; each other sends a key of its
    own for the link to the first, which sends that too.
    """
    for ids, lines in distinct_lines(batches, least_chars):
        keys = band_keys(signatures(lines)).reshape(-1)
        owner = np.repeat(np.array(ids, dtype=np.int64), BANDS)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        head = owner[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        other = ~first
        pair = np.unique(np.stack([head[other], owner[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
        link = mixed(mixed(pair[0].view(np.uint64)) + pair[1].view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[keys[first], link, link]), pa.array(np.r_[owner[first], pair[0], pair[1]])], ["key", "id"])


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of neighbours with an equal key; the rows come sorted by key."""
    last_key, last_id = None, None
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        if last_key is not None:
            keys, ids = np.r_[last_key, keys], np.r_[last_id, ids]
        last_key, last_id = keys[-1], ids[-1]
        same = (keys[1:] == keys[:-1]) & (ids[1:] != ids[:-1])
        yield edges_batch(ids[:-1][same], ids[1:][same])


def lines_with_text(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    for ids, lines in distinct_lines(batches, least_chars):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["id", "line"])


def bands_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, id``: all band keys of the lines ``id, line``."""
    for batch in batches:
        for ids, lines in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(signatures(lines)).reshape(-1)), pa.array(np.repeat(np.array(ids, np.int64), BANDS))], ["key", "id"])


def buckets(found: DataFrame, chunk_chars: int) -> DataFrame:
    """``group, id, line, chars`` with groups of more than ``chunk_chars`` characters parted into their buckets: lines that share a band key.

    Chains of lines that are hardly similar join more and more of all lines to one group as the input grows; to compare each two
    of its members would take the square of it. A line stands in at most BANDS buckets, and of buckets of the same lines one is kept.
    """
    large = staged(found.groupBy("group").agg(F.sum("chars").alias("n")).where(F.col("n") > chunk_chars).select("group"), "large")
    if large.isEmpty():
        return found
    lines = staged(found.join(large, "group", "left_semi").select("id", "line", "chars"), "hot-lines")
    keys = staged(lines.select("id", "line").mapInArrow(bands_of, "key long, id long").distinct(), "hot-keys")
    same = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("members")).where(F.col("n") > 1)
    once = staged(same.groupBy("n", "members").agg(F.min("key").alias("group")).select("group"), "buckets")
    parted = keys.join(once, F.col("key") == F.col("group")).select("group", "id").join(lines, "id")
    return found.join(large, "group", "left_anti").select("group", "id", "line", "chars").unionByName(parted.select("group", "id", "line", "chars"))


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` of lines of one unit whose shingle sets have a Jaccard similarity of SIMILARITY or more."""
    for table, at in runs(batches, ["group", "unit", "id", "line"]):
        ids, unit = table.column("id").to_numpy(), np.repeat(np.arange(len(at) - 1), np.diff(at))
        kept = np.unique(np.stack([unit, ids]), axis=1, return_index=True)[1]
        unit, ids = unit[kept], ids[kept]
        wide = np.bincount(unit, minlength=len(at) - 1)[unit] > 1
        unit, ids, kept = unit[wide], ids[wide], kept[wide]
        if len(ids):
            sets = ShingleSets(table.column("line").take(pa.array(kept)).to_pylist())
            found = np.array(sets.pairs(unit), dtype=np.int64).reshape(-1, 2)
            yield edges_batch(ids[found[:, 0]], ids[found[:, 1]])


class ShingleSets:
    """The shingle sets of lines, one after the other, and which of them are similar."""

    def __init__(self, lines: list[str]):
        hashes, line = shingle_hashes(lines)
        order = np.lexsort((hashes, line))
        hashes, line = hashes[order], line[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])]
        self.hashes, self.line = hashes[new], line[new]
        self.sizes = np.bincount(self.line, minlength=len(lines))
        self.starts = np.r_[0, np.cumsum(self.sizes)]

    def pairs(self, unit: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect what pairs of similar lines of equal unit connect; the lines come unit by unit."""
        at = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
        length = np.diff(at)
        out = self.few(at[:-1][length <= FEW], length[length <= FEW])
        for first, n in zip(at[:-1][length > FEW].tolist(), length[length > FEW].tolist()):
            out += [(first + i, first + j) for i, j in self.of_unit(first, n)]
        return out

    def few(self, first: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        """All similar pairs of small units (their first lines and numbers of lines), from one sort of the shingles of all of them."""
        unit = np.full(len(self.sizes), -1)
        unit[spread(first, first + n)] = np.repeat(np.arange(len(n)), n)
        mine = unit[self.line]
        line, hashes, mine = self.line[mine >= 0], self.hashes[mine >= 0], mine[mine >= 0]
        order = np.lexsort((hashes, mine))  # lines stay in order
        line, hashes, mine = line[order], hashes[order], mine[order]
        run = np.cumsum(np.r_[True, (mine[1:] != mine[:-1]) | (hashes[1:] != hashes[:-1])])[:len(mine)]
        base = np.r_[0, np.cumsum(n * n)]
        common, at, step = np.zeros(base[-1], np.int64), np.arange(len(run)), 0
        while len(at):
            u, i, j = mine[at], line[at], line[at + step]
            if step:
                common += np.bincount(base[u] + (i - first[u]) * n[u] + j - first[u], minlength=len(common))
            step += 1
            at = at[at + step < len(run)]
            at = at[run[at + step] == run[at]]
        place = np.flatnonzero(common)
        common, u = common[place], np.searchsorted(base, place, "right") - 1
        i, j = np.divmod(place - base[u], n[u])
        i, j = i + first[u], j + first[u]
        near = common >= SIMILARITY * (self.sizes[i] + self.sizes[j] - common) - 1e-9
        return list(zip(i[near].tolist(), j[near].tolist()))

    def of_unit(self, first: int, n: int) -> list[tuple[int, int]]:
        """The same for n lines of one unit. Sets that similar have one of their rarest shingles in common.

        Of a set of m shingles, rarest first, those are the first m - ceil(SIMILARITY m) + 1: only lines
        that share one, and are long enough, are counted in full. What two sets share beyond those shingles lies in the
        rest of the one whose own end first, so few in common rule most pairs out before that.
        """
        span = slice(self.starts[first], self.starts[first + n])
        sizes, starts = self.sizes[first:first + n], self.starts[first:first + n + 1] - self.starts[first]
        shingles, times = np.unique(self.hashes[span], return_inverse=True, return_counts=True)[1:]
        line = self.line[span] - first
        rank = np.empty(len(times), dtype=np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        mine = rank[shingles]
        mine = mine[np.lexsort((mine, line))]
        head = sizes - np.ceil(SIMILARITY * sizes - 1e-9).astype(int) + 1
        rare = np.arange(len(mine)) - starts[line] < head[line]
        order = np.argsort(mine[rare], kind="stable")
        last = mine[starts[:-1] + np.minimum(head, sizes) - 1] if len(mine) else head
        owner, known, left = line[rare][order], mine[rare][order], n
        marked = np.zeros(len(times), dtype=bool)

        def linked(i: int, waiting: np.ndarray) -> np.ndarray:
            nonlocal owner, known, left
            if 2 * (now := np.count_nonzero(waiting)) < left:  # what was reached is not looked for again
                still = waiting[owner]
                owner, known, left = owner[still], known[still], now
            own = mine[starts[i]:starts[i + 1]]
            probe = own[:head[i]]
            start, end = np.searchsorted(known, probe), np.searchsorted(known, probe, "right")
            meets = np.concatenate([owner[:0], *(owner[a:b] for a, b in zip(start.tolist(), end.tolist()))])
            shared = np.bincount(meets, minlength=n)
            near = np.flatnonzero((shared > 0) & waiting)
            rest = np.where(last[i] <= last[near], sizes[i] - head[i], sizes[near] - head[near])
            near = near[(shared[near] + rest) * (1 + SIMILARITY) >= SIMILARITY * (sizes[i] + sizes[near]) - 1e-6]
            near = near[(sizes[near] >= SIMILARITY * sizes[i] - 1e-9) & (sizes[near] * SIMILARITY <= sizes[i] + 1e-9)]
            if not len(near):
                return near
            marked[own] = True
            common = np.add.reduceat(marked[mine[spread(starts[near], starts[near + 1])]], np.r_[0, np.cumsum(sizes[near])[:-1]], dtype=np.int64)
            marked[own] = False
            return near[common >= SIMILARITY * (sizes[i] + sizes[near] - common) - 1e-9]

        return forest(n, linked)


def spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    counts = end - start
    return np.repeat(start - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())


def line_classes(docs: DataFrame, id_col: str = "doc_id", chunk_chars: int = CHUNK_CHARS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``key, hash, line_no, id, root, kept``: a row for every line of ``least_chars`` or more (1: every line that is not blank).

    ``key`` is the document's id, ``hash`` that of its text, ``line_no`` counts from 0, ``root`` names the
    component of similar lines; ``kept`` marks its first line, by document id (nulls last), line number and
    hash. Lines are compared in lower case with white space folded; those shorter than a shingle are similar
    to equal ones only. Null texts have no lines. Rows that repeat both id and text are decided alike.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(quoted(id_col).cast("long").alias("key"), F.xxhash64(text_of()).alias("hash"), text_of().alias("text"))
    texts = own.select("text")
    lines = staged(own.mapInArrow(partial(lines_of, least_chars=least_chars), "key long, hash long, line_no int, id long"), "lines")
    keys = texts.mapInArrow(partial(keys_of, least_chars=least_chars), "key long, id long").repartition("key").sortWithinPartitions("key")
    candidates = components(keys.mapInArrow(chained, "a long, b long"))
    groups = candidates.selectExpr("component group", "node member")
    groups = staged(groups.unionByName(groups.selectExpr("group", "group member").distinct()), "groups")
    found = texts.mapInArrow(partial(lines_with_text, least_chars=least_chars), "id long, line string").join(groups, F.col("id") == F.col("member"))
    once = found.select("group", "id", "line").dropDuplicates(["id"])  # a common line comes from many batches
    found = staged(once.withColumn("chars", F.length("line").cast("long")), "candidates")
    verified = in_units(buckets(found, chunk_chars), "group", "id", chunk_chars, "chars").select("group", "unit", "id", "line").mapInArrow(similar, "a long, b long")
    classes = staged(components(verified), "classes")
    rooted = staged(lines.join(classes, F.col("id") == F.col("node"), "left")
                    .select("key", "hash", "line_no", "id", F.coalesce("component", "id").alias("root")), "rooted")
    rank = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("line_no"), F.col("hash"))
    first = staged(rooted.groupBy("root").agg(F.min(rank).alias("first")).withColumnRenamed("root", "top"), "first")
    return rooted.join(first, F.col("root") == F.col("top")).select(
        *rooted.columns, (F.col("first") == rank).alias("kept"), F.col("first")["key"].alias("first_key"), F.col("first")["line_no"].alias("first_line"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents with their own columns; of each component of similar lines only the first line is left.

    Lines of fewer characters than ``least_chars`` stay (1: only blank ones). Documents keep their row, with the
    text that is left, which may be empty; null texts stay null. Their
    ``n_chars``, where they have such a column, is that of the new text.
    """
    found = line_classes(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), least_chars=least_chars)
    gone = (found.where(~F.col("kept")).select("key", "hash", "line_no").distinct()
            .groupBy("key", "hash").agg(F.array_sort(F.collect_list("line_no")).alias("gone")))
    gone = staged(gone, "gone").selectExpr("key _key", "hash _hash", "gone _gone")
    text = text_of(text_col)
    joined = docs.join(gone, quoted(id_col).cast("long").eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_hash")), "left")
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    new = F.when(F.col("_gone").isNull(), quoted(text_col)).otherwise(rest)
    out = joined.select(*[new.alias(c) if c == text_col else quoted(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out
