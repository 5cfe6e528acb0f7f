"""Byte-level BPE encoding and decoding with a segment tree over byte positions."""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import quoted
from .common import add_fields, bounded_batches, text_of

#: Pieces of one generation that a worker remembers, the longest one in bytes, and how many are merged together.
MEMO_PIECES, MEMO_BYTES, TOGETHER = 160_000, 64, 8192
#: Characters of texts that are split at a time, and pieces of a longer text.
CHUNK_CHARS, CHUNK_PIECES = 1 << 18, 1 << 16

#: Children of a node of the tree; a leaf is rank and position in one number.
FAN, SHIFT = 16, 40
POSITION, NEVER = (1 << SHIFT) - 1, 1 << 80
#: No pair, in the arrays of many trees.
FAR = 1 << 60


@functools.lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: merge the leftmost pair of the lowest rank until no pair has one.

    A segment tree with FAN children a node stands over the byte positions. Leaf ``i`` is the rank of the
    pair that starts at byte ``i`` (with the position as low digits, so that the minimum is the leftmost),
    an inner node the minimum below it. A merge changes three leaves, its own and those of its live
    neighbours, and walks up from each.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, rank_of = len(piece), ranks.get
    ranked = [rank_of(piece[i:i + 2]) for i in range(n - 1)]
    level = [NEVER if r is None else r << SHIFT | i for i, r in enumerate(ranked)]
    levels = [level]
    while len(level) > FAN:
        level = [min(level[i:i + FAN]) for i in range(0, len(level), FAN)]
        levels.append(level)
    leaves, upper = levels[0], levels[1:]
    top = levels[-1]
    following, before = list(range(1, n + 2)), list(range(-1, n))
    while (first := min(top)) < NEVER:
        i = first & POSITION
        gone = following[i]
        following[i] = after = following[gone]
        changed = [(i, NEVER)]
        if after < n:
            before[after] = i
            r = rank_of(piece[i:following[after]])
            if r is not None:
                changed = [(i, r << SHIFT | i)]
            changed.append((gone, NEVER))
        ahead = before[i]
        if ahead >= 0:
            r = rank_of(piece[ahead:after])
            changed.append((ahead, NEVER if r is None else r << SHIFT | ahead))
        for at, value in changed:
            leaves[at] = value
            below = leaves
            for nodes in upper:
                at //= FAN
                low = min(below[at * FAN:at * FAN + FAN])
                if nodes[at] == low:
                    break
                nodes[at] = low
                below = nodes
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:following[i]]])
        i = following[i]
    return out


class Pairs:
    """Which two neighbouring tokens make a token, and its rank, for whole arrays at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found) or [-1], np.int64)
        self.ranks = np.array([found[k] for k in sorted(found)] or [0], np.int64)
        pair = np.arange(256)
        self.bytes = self.rank(self.byte[:, None], self.byte[pair])  # of any two bytes

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, FAR for no token."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], FAR)

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaves of pairs that start at the given positions."""
        return self.placed(self.rank(left, right), at)

    def first(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaves of pairs of single bytes."""
        return self.placed(self.bytes[left, right], at)

    @staticmethod
    def placed(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank < FAR, rank << 8 | at, FAR)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[tuple[int, ...]]:
    """``merge`` of many pieces of 2 to 64 bytes at once."""
    ids, ends = merged(pieces, pairs)
    out = ids.tolist()
    return [tuple(out[a:b]) for a, b in zip([0, *ends], ends)]


def merged(pieces: list[bytes], pairs: Pairs) -> tuple[np.ndarray, list[int]]:
    """The ids of all pieces of 2 to 64 bytes behind each other, and where each piece ends: one tree per piece, one merge in each per round."""
    size = 1 << max(len(p) for p in pieces).bit_length()
    rows = len(pieces)
    n = np.array([len(p) for p in pieces])
    at = np.arange(size)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
    ids = pairs.byte[raw]
    tree = np.full((rows, 2 * size), FAR)
    tree[:, size:-1] = np.where(at[1:] < n[:, None], pairs.first(raw[:, :-1], raw[:, 1:], at[:-1]), FAR)
    half = size // 2
    while half:
        tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        half //= 2
    following = np.broadcast_to(at + 1, (rows, size)).copy()
    before = np.broadcast_to(at - 1, (rows, size)).copy()
    alive = at < n[:, None]
    flat, ids, following, before, alive = (x.reshape(-1) for x in (tree, ids, following, before, alive))
    base = np.flatnonzero(tree[:, 1] < FAR)
    while len(base):
        leaf, row = flat[base * 2 * size + 1], base * size
        i = leaf & 255
        gone = following[row + i]
        after = following[row + gone]
        ids[row + i] = token = leaf >> 8
        following[row + i] = after
        alive[row + gone] = False
        inside = after < n[base]
        next_one = np.where(inside, after, 0)
        before[(row + after)[inside]] = i[inside]
        ahead = before[row + i]
        last = np.maximum(ahead, 0)
        changed = [(gone, np.full(len(base), FAR)),
                   (i, np.where(inside, pairs.leaf(token, ids[row + next_one], i), FAR)),
                   (np.where(ahead >= 0, ahead, size - 1), np.where(ahead >= 0, pairs.leaf(ids[row + last], token, last), FAR))]
        root = base * 2 * size
        for place, value in changed:
            node = root + size + place
            flat[node] = value
        for place, _ in changed:
            node = size + place
            while node[0] > 1:
                node = node >> 1
                low = root + 2 * node
                flat[root + node] = np.minimum(flat[low], flat[low + 1])
        base = base[flat[root + 1] < FAR]
    return ids[alive], np.cumsum(alive.reshape(rows, size).sum(axis=1)).tolist()


def packed(ids) -> bytes:
    return np.asarray(ids, np.int32).tobytes()


class Encoder:
    """Encodes texts by ranks; every match of the pattern is merged on its own.

    The unknown pieces of a chunk of texts are merged together. Merged pieces are remembered, their ids as 32-bit integers in
    bytes, in two generations of bounded size: a full one becomes the old one, and what is met again moves to the new one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.pairs = ranks, regex.compile(pattern), Pairs(ranks)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, unknown: set[str]) -> None:
        """Put short pieces into the memory, those of like length together."""
        groups: dict[int, list[str]] = {}
        for piece in unknown:
            ids = self.old.get(piece)
            if ids is None:
                raw = piece.encode("utf-8")
                whole = self.ranks.get(raw)
                if whole is None:
                    if len(raw) <= MEMO_BYTES:
                        groups.setdefault(len(raw).bit_length(), []).append(piece)
                    continue
                ids = packed(whole)
            self.memo[piece] = ids
        for group in groups.values():
            for i in range(0, len(group), TOGETHER):
                part = group[i:i + TOGETHER]
                ids, ends = merged([p.encode("utf-8") for p in part], self.pairs)
                flat, ends = packed(ids), [4 * n for n in ends]
                self.memo.update(zip(part, [flat[a:b] for a, b in zip([0, *ends], ends)]))

    def assemble(self, pieces: list[str]) -> np.ndarray:
        try:
            ids = b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:  # a piece too long to be remembered
            known = self.memo.get
            ids = b"".join([known(p) or packed(merge(p.encode("utf-8"), self.ranks)) for p in pieces])
        return np.frombuffer(ids, np.int32)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; short texts share a chunk, long ones are gone through in several."""
        start = 0
        while start < len(texts):
            end, room = start, CHUNK_CHARS
            while end < len(texts) and (room >= len(texts[end]) or end == start):
                room -= len(texts[end])
                end += 1
            if room < 0:
                yield self.encode_long(texts[start])
            else:
                split = [self.pattern.findall(t) for t in texts[start:end]]
                self.learn(set().union(*split).difference(self.memo))
                for pieces in split:
                    yield self.assemble(pieces)
            self.turn()
            start = end

    def encode_long(self, text: str) -> np.ndarray:
        parts = []
        found = (m.group() for m in self.pattern.finditer(text))
        while pieces := list(itertools.islice(found, CHUNK_PIECES)):
            self.learn(set(pieces).difference(self.memo))
            parts.append(self.assemble(pieces))
            self.turn()
        return np.concatenate(parts)

    def turn(self) -> None:
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.old = {}, self.memo

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


@functools.lru_cache(maxsize=2)
def encoder_of(ranks_path: str, pattern: str) -> Encoder:
    """The encoder of a worker, which keeps its memory from task to task."""
    return Encoder(read_ranks(ranks_path), pattern)


def arrays(values: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The documents with ``token_ids`` (array of int) and ``n_tokens`` (long) of every whole text.

    ``ranks_path`` is a tiktoken rank file that every executor can open. A null or empty text has no
    tokens; repeated rows are encoded each; input columns named like the results are replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(ranks_path, pattern)
        for texts in batches:
            yield arrays(list(encoder.encode_all(texts.to_pylist())))

    found = add_fields(docs, F.struct(ids(text_of()).alias("token_ids")), ["token_ids"])
    return add_fields(found, F.struct(F.size("token_ids").cast("long").alias("n_tokens")), ["n_tokens"])


def joined(lists: pa.ListArray, token: dict[int, bytes]) -> pa.Array:
    """The bytes of each list of ids, null for a null list; the ids of all lists leave Arrow as one array, not as an object each."""
    ids, out, end = lists.flatten().to_numpy(), [], 0
    for n in lists.value_lengths().to_pylist():
        if n is not None:
            start, end = end, end + n
            n = b"".join(map(token.__getitem__, ids[start:end].tolist()))
        out.append(n)
    return pa.array(out, pa.binary())


def decode_documents(df: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """The frame with ``decoded`` (binary): the bytes of the ids. Null gives null; an unknown id fails the job."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = {i: t for t, i in read_ranks(ranks_path).items()}
        for lists in batches:
            yield joined(lists, token)

    return add_fields(df, F.struct(text(quoted(ids_col)).alias("decoded")), ["decoded"])
