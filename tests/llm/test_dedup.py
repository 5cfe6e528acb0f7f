import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, Union, awkward, contract_words, nothing

from lakeproof.llm import common, linededup, simhash
from lakeproof.llm.common import components
from lakeproof.llm.groups import forest, in_units

SPACE_WORDS = r"[^\x20\x09-\x0D]+"


def plain_fingerprint(text):
    words = contract_words(text, SPACE_WORDS)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """The smallest id of the class of each (id, fingerprint)."""
    links = Union()
    distinct = sorted({f for _, f in prints})
    for i, a in enumerate(distinct):
        for b in distinct[i:]:
            if (a ^ b).bit_count() <= 3:
                links.join(a, b)
    first = {}
    for i, f in prints:
        if i is not None:
            first[links.root(f)] = min(first.get(links.root(f), i), i)
    return {(i, f): first.get(links.root(f)) for i, f in prints}


@pytest.mark.parametrize("seed", [3, 4])
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(-5, i) for i in range(500, 700)] + [(i, i + 1) for i in range(1000, 1100)]
    links = Union()
    for a, b in pairs:
        links.join(a, b)
    want = {x: links.root(x) for x in list(links.parent) if links.root(x) != x}
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition([7, 60][seed % 2]))
    assert {x["node"]: x["component"] for x in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_live_links_shrink_from_round_to_round(spark, monkeypatch):
    """One link in each partition, so that no forest helps: paths in order, a star with a middle centre, and pairs."""
    written, write = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    pairs = [(i, i + 1) for i in range(400)] + [(5000, 5000 + i) for i in range(-300, 300) if i] + [(i, i + 1) for i in range(9000, 9200, 2)]
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(1200))
    assert got.count() == 400 + 599 + 100 and got.select("component").distinct().count() == 102
    live = [df.count() for name, df in written if name == "live"]
    assert len(live) <= 40 and sum(live) <= 8 * len(pairs)


def test_golay_keys_meet_for_every_pair_of_up_to_three_errors():
    patterns = simhash.near_patterns()
    assert patterns.shape == (2048, 6) and {int(np.unique(p).size) for p in patterns} == {1, 6}
    codes, r = simhash.segment_codes(patterns), np.random.default_rng(1)
    for _ in range(300):
        a = int(r.integers(0, 1 << 63)) * 2 + int(r.integers(0, 2))
        flips = r.choice(64, int(r.integers(0, 4)), replace=False)
        b = a ^ sum(1 << int(f) for f in flips)
        both = np.array([a, b], dtype=np.uint64).view(np.int64)
        keys, rows = simhash.keys_of(both, codes)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_links_connect_what_is_near(spark, chunk):
    r, prints = np.random.default_rng(2), set()
    for _ in range(12):  # balls of fingerprints around centres, chained beyond three bits
        x = int(r.integers(0, 1 << 62))
        for _ in range(15):
            x ^= sum(1 << int(f) for f in r.choice(64, int(r.integers(1, 6)), replace=False))
            prints.add(x)
    near = 7 << 60
    prints |= {near ^ (1 << i) ^ (1 << j) for i in range(20, 26) for j in range(30, 36)}
    signed = [simhash.signed(p) for p in prints]
    got = Union()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for row in components(simhash.links(frame, chunk)).collect():
        got.join(row["component"], row["node"])
    want = Union()
    for i, a in enumerate(signed):
        for b in signed[i:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                want.join(a, b)
    assert {p: got.root(p) for p in signed} == {p: want.root(p) for p in signed}


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t, _ in AWKWARD]
    want = plain_classes(prints)
    assert len(got) == len(AWKWARD)
    assert sorted((r["doc_id"] or -1, int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted((i or -1, f, want[i, f]) for i, f in prints)
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def test_one_document_of_each_class_stays(spark):
    docs = awkward(spark)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i or -1 for i in ids) == [-1, 1, 2, 8, 9, 10]  # 2 stands for the texts without words, 1 for its copies
    repeated = spark.createDataFrame([(5, "same words in a row"), (5, "same words in a row")], "doc_id long, text string")
    assert simhash.one_of_each(repeated).count() == 1
    assert simhash.one_of_each(nothing(spark)).count() == 0


LINES = ["the committee approved the annual budget after a long debate on monday", "completely different content about sailing boats"]


def line_docs():
    changed = [LINES[0].replace("monday", "sunday"), LINES[0].upper(), "  " + LINES[0].replace(" ", "  ")]
    return [
        (4, LINES[0] + "\nshort\n" + LINES[1]), (2, changed[0] + "\n\nshort"), (3, changed[1] + "\n" + changed[2]),
        (None, LINES[1] + "\nonly here stands this particular sentence"), (6, None), (7, ""), (8, "\n\n"),
        (9, LINES[1] + "\n" + LINES[1]), (9, LINES[1] + "\n" + LINES[1]), (11, "x" * 300_000 + "\nzz")]


def plain_line_classes(docs):
    lines = [((i is None, i or 0, n), linededup.normal(x)) for i, t in docs for n, x in enumerate((t or "").split("\n"))]
    lines = [(at, x) for at, x in lines if len(x) >= linededup.LEAST_CHARS]
    sets = {x: {x[i:i + 8] for i in range(len(x) - 7)} for _, x in lines}
    links = Union()
    for a in sets:
        for b in sets:
            if a == b or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.join(a, b)
    first = {}
    for at, x in lines:
        first[links.root(x)] = min(first.get(links.root(x), at), at)
    return {at: first[links.root(x)] for at, x in lines}


@pytest.mark.parametrize("chunk", [linededup.CHUNK_CHARS, 100])
def test_line_classes(spark, chunk):
    docs = line_docs()
    got = linededup.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), chunk_chars=chunk).collect()
    want = plain_line_classes(docs)
    assert {(r["key"] is None, r["key"] or 0, r["line_no"]): (r["first_key"] is None, r["first_key"] or 0, r["first_line"]) for r in got} == want
    assert all(r["kept"] == ((r["key"], r["line_no"]) == (r["first_key"], r["first_line"])) for r in got)


def short_line_docs():
    return [(2, "les.\nand ornd.\n\n  \nThe End"), (1, "LES.\nthe  end\nbut slyly ironic ide"), (3, "les.\nbut slyly ironic idea\nbut slyly ironic ides"),
            (5, "x\nX\nabcdefgh\nabcdefgi\nabcdefg"), (None, "x\nabcdefgh\nles."), (6, None), (7, LINES[0] + "\nles."), (8, LINES[0])]


def test_every_line_that_is_not_blank_has_a_class(spark):
    docs = short_line_docs() + line_docs()[:1] + line_docs()[-3:]
    lines = [((i is None, i or 0, n), linededup.normal(x)) for i, t in docs for n, x in enumerate((t or "").split("\n"))]
    lines = [(at, x) for at, x in lines if x]
    sets = {x: {x[i:i + 8] for i in range(len(x) - 7)} or {x} for _, x in lines}
    links, first = Union(), {}
    for a in sets:
        for b in sets:
            if a == b or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.join(a, b)
    for at, x in lines:
        first[links.root(x)] = min(first.get(links.root(x), at), at)
    got = linededup.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), least_chars=1).collect()
    assert len(got) == len(lines)
    assert {(r["key"] is None, r["key"] or 0, r["line_no"]): (r["first_key"] is None, r["first_key"] or 0, r["first_line"])
            for r in got} == {at: first[links.root(x)] for at, x in lines}


def test_copies_of_short_lines_are_removed(spark):
    got = linededup.dedup_lines(spark.createDataFrame(short_line_docs(), "doc_id long, text string"), least_chars=1)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts == {1: "LES.\nthe  end\nbut slyly ironic ide", 2: "and ornd.\n\n  ", 3: "", 5: "x\nabcdefgh\nabcdefgi\nabcdefg",
                     None: "", 6: None, 7: LINES[0], 8: ""}


def test_lines_are_removed_and_documents_stay(spark):
    docs = spark.createDataFrame([(*d, 5, "gone") for d in line_docs()], "doc_id long, text string, n_chars long, gone string")
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == len(line_docs())
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert texts[2][0] == LINES[0].replace("monday", "sunday") + "\n\nshort" and texts[2][1] == len(texts[2][0])
    assert texts[4][0] == LINES[1] and texts[3][0] == "" and texts[9][0] == ""
    assert texts[None][0] == "only here stands this particular sentence" and texts[6] == (None, None)
    assert texts[11][0].endswith("\nzz") and texts[7][0] == ""
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(empty).count() == 0


def test_similar_lines_are_found_by_signature():
    r, lines = np.random.default_rng(4), []
    words = ["".join(map(chr, r.integers(97, 123, int(r.integers(2, 9))))) for _ in range(400)]
    for _ in range(150):
        base = list(r.choice(words, 50))
        changed = list(base)
        changed[int(r.integers(0, 50))] = "changed"
        lines += [" ".join(base), " ".join(changed)]
    keys = linededup.band_keys(linededup.signatures(lines))
    found = [bool(set(keys[i]) & set(keys[i + 1])) for i in range(0, len(lines), 2)]
    assert sum(found) / len(found) >= 0.98


def test_a_chain_of_hardly_similar_lines_is_not_compared_all_with_all(spark, monkeypatch):
    """Lines that share 13 of 15 words with the next (a similarity of 0.75): one group of candidates, of which few are similar."""
    units, cut, r = [], linededup.in_units, np.random.default_rng(5)
    monkeypatch.setattr(linededup, "in_units", lambda *a: units.append(cut(*a)) or units[-1])
    words = ["".join(map(chr, r.integers(97, 123, 7))) for _ in range(800)]
    lines = [" ".join(words[i:i + 15]) for i in range(0, 780, 2)]
    lines += [x + " end" for x in lines[::9]]
    docs = [(i, x) for i, x in enumerate(lines)]
    got = linededup.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), chunk_chars=1000).collect()
    want = plain_line_classes(docs)
    assert {(False, r["key"], r["line_no"]): (False, r["first_key"], r["first_line"]) for r in got} == want
    assert len(set(want.values())) == 390
    assert units[0].count() <= 5 * len(lines)


def test_units_let_every_two_members_of_a_hot_key_meet(spark):
    rows = [(1, i) for i in range(50)] + [(2, i) for i in range(5)]
    got = in_units(spark.createDataFrame(rows, "k long, m long"), "k", "m", 10).collect()
    units = {}
    for r in got:
        units.setdefault((r["k"], r["unit"]), set()).add(r["m"])
    for i in range(50):
        for j in range(50):
            assert any({i, j} <= m for (k, _), m in units.items() if k == 1)
    assert units[2, 0] == set(range(5)) and max(map(len, units.values())) < 35


def test_forest_spans_what_is_linked():
    near = lambda i, waiting: np.flatnonzero(waiting & (np.abs(np.arange(9) - i) == 2))
    links = forest(9, near)
    union = Union()
    for a, b in links:
        union.join(a, b)
    assert len(links) == 7 and len({union.root(i) for i in range(9)}) == 2


@pytest.mark.parametrize("few", [1, linededup.FEW, 50])
def test_similar_pairs_are_the_same_in_units_of_any_size(monkeypatch, few):
    monkeypatch.setattr(linededup, "FEW", few)
    r, lines, unit = np.random.default_rng(11), [], []
    for k, n in enumerate(r.integers(2, 40, 40).tolist()):
        base = r.integers(97, 102, int(r.integers(12, 150))).tolist()
        for _ in range(n):
            x = list(base)
            for _ in range(int(r.integers(0, 4))):
                at = int(r.integers(0, len(x)))
                x[at:at + int(r.integers(0, 2))] = r.integers(97, 102, int(r.integers(0, 3))).tolist()
            lines.append("".join(map(chr, x if len(x) >= linededup.SHINGLE else base)))
            unit.append(k)
    got, want = Union(), Union()
    for a, b in linededup.ShingleSets(lines).pairs(np.array(unit)):
        got.join(a, b)
    sets = [{x[i:i + 8] for i in range(len(x) - 7)} for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            if unit[i] == unit[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.join(i, j)
    assert [got.root(i) for i in range(len(lines))] == [want.root(i) for i in range(len(lines))]
    assert 100 < len({want.root(i) for i in range(len(lines))}) < len(lines) - 100


def test_similar_pairs_equal_brute_force():
    r, lines, unit = np.random.default_rng(9), [], []
    for k, n in enumerate([2, 2, 3, 40, 2, 25]):
        base = "".join(map(chr, r.integers(97, 123, 300)))
        for _ in range(n):
            at, length = int(r.integers(0, 250)), int(r.integers(1, 45))
            lines.append(base[:at] + "".join(map(chr, r.integers(97, 123, length))) + base[at + int(r.integers(0, 45)):])
            unit.append(k)
    got, want = Union(), Union()
    for a, b in linededup.ShingleSets(lines).pairs(np.array(unit)):
        got.join(a, b)
    sets = [{x[i:i + 8] for i in range(len(x) - 7)} for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            if unit[i] == unit[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.join(i, j)
    assert [got.root(i) for i in range(len(lines))] == [want.root(i) for i in range(len(lines))]
    assert 10 < len({want.root(i) for i in range(len(lines))}) < 70
