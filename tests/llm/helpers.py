"""Small documents with the awkward cases, and plain versions of what the operators compute."""

import re
from collections import defaultdict

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "x"),
    (2, None, "x"),
    (3, "", "y"),
    (None, "A row without an id is a row like any other, is it not", "y"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today", None),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today", None),
    (7, "  \t\n ", "z"),
    (8, "ünïcode ÄÖÜ 漢字 \U0001f600 words and breaks", "z"),
    (9, "one", "z"),
    (10, "long " * 60_000 + "end", "z"),
]


def awkward(spark):
    """The documents with extra columns named like results and helper columns of the operators."""
    rows = [(i, t, s, 1.5, "mine", 7) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, _fields string, N_Tokens int")


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


class Union:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def contract_words(text, pattern):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(pattern, low)


def groups(pairs):
    out = defaultdict(set)
    for key, member in pairs:
        out[key].add(member)
    return out
