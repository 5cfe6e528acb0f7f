"""Secret scans in built-in functions: known shapes, and sliding-window entropy over candidate strings."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_fields, fresh, text_of

#: The kinds of secrets with a known shape, in their order, and the shape.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Candidate strings, the window, and the bits per character that a window of each class must reach.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8}

#: Candidates that are no secrets: ids, numbers, words joined by marks, fillers and samples.
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9_=+/-]+$",
    r"^[+/_=-]*([A-Za-z]+[+/_=-]+)*[A-Za-z]*$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|1234567890",
]


def located(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """``array<struct<start, kind, end, hit>>`` of all matches, leftmost first, positions in characters.

    What lies between the matches (a split by the pattern) and the matches themselves take turns, so
    their lengths add up to the positions. ``least`` drops matches whose group is shorter.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("groups"))
    empty = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint, kind:int, end:bigint, hit:string>>))")
    number = KINDS.index(kind)

    def spans(x: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(x["gaps"][i])
            hit = x["hits"][i]
            end = start + F.length(hit)
            span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), hit.alias("hit"))
            kept = F.when(F.length(x["groups"][i]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct(end.cast("long").alias("at"), kept.alias("spans"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1), empty, step, lambda s: s["spans"])

    none = F.expr("cast(array() as array<struct<start:bigint, kind:int, end:bigint, hit:string>>)")
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(F.array(found), spans)[0]).otherwise(none)


def weight(count: Column) -> Column:
    """c * log2(c), looked up: a window has at most WINDOW equal characters."""
    return F.element_at(F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 1)]), count + 1)


def hot_range(hit: Column, least_bits: Column, alphabet: str = ALPHABET, window: int = WINDOW) -> Column:
    """Start of the first and end of the last window of enough entropy (``struct<lo, hi>``, -1 where none has).

    The window slides by a character: one count goes up, one goes down, and the sum of c * log2(c) follows
    from the four values concerned; the entropy is log2(window) less that sum by the window.
    """
    zero = F.array_repeat(F.lit(0), len(alphabet))
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    codes = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(alphabet), c))

    def scan(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            into = F.element_at(codes, i + 1)
            out = F.when(i >= window, F.element_at(codes, F.greatest(i + 1 - window, F.lit(1)))).otherwise(F.lit(0))
            counts = state["counts"]
            up = F.element_at(counts, into)
            down = F.element_at(counts, F.greatest(out, F.lit(1)))
            total = F.when(into == out, state["sum"]).otherwise(
                state["sum"] + weight(up + 1) - weight(up)
                + F.when(out > 0, weight(F.greatest(down - 1, F.lit(0))) - weight(down)).otherwise(F.lit(0.0)))
            moved = F.when(into == out, counts).otherwise(F.transform(
                counts, lambda c, k: c + (k + 1 == into).cast("int") - (k + 1 == out).cast("int")))
            return F.struct(moved.alias("counts"), total.alias("sum"), state["lo"].alias("lo"), state["hi"].alias("hi"), i.alias("i"))

        def noted(state: Column, i: Column) -> Column:
            return F.transform(F.array(step(state, i)), lambda s: F.struct(
                s["counts"].alias("counts"), s["sum"].alias("sum"),
                F.when(hot(s), F.when(s["lo"] < 0, s["i"] + 1 - window).otherwise(s["lo"])).otherwise(s["lo"]).alias("lo"),
                F.when(hot(s), s["i"] + 1).otherwise(s["hi"]).alias("hi")))[0]

        def hot(s: Column) -> Column:
            return (s["i"] + 1 >= window) & (F.lit(log2(window)) - s["sum"] / window >= least_bits - 1e-9)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, noted, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))

    return F.transform(F.array(codes), scan)[0]


def class_of(hit: Column) -> Column:
    """The character class of a candidate: only hexadecimal digits, letters and digits, or also + / _ = -."""
    return (F.when(F.rlike(hit, F.lit("^[0-9a-f]+$|^[0-9A-F]+$")), "hex")
            .when(F.rlike(hit, F.lit("^[A-Za-z0-9]+$")), "alnum").otherwise("base64"))


def entropy_spans(text: Column) -> Column:
    """Spans of kind ``entropy``: of every candidate that is not allow-listed, from its first to its last hot window."""
    allowed = F.lit("|".join(f"(?:{p})" for p in ALLOWED))
    candidates = F.filter(located(text, CANDIDATE, "entropy"), lambda s: ~F.rlike(s["hit"], allowed))
    bits = F.create_map(*[F.lit(x) for pair in LEAST_BITS.items() for x in pair])
    ranged = F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), hot_range(s["hit"], bits[class_of(s["hit"])]).alias("at")))
    return F.transform(F.filter(ranged, lambda s: s["at"]["lo"] >= 0), lambda s: F.struct(
        (s["start"] + s["at"]["lo"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (s["start"] + s["at"]["hi"]).alias("end")))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``base_secrets`` and ``secrets``: arrays of ``struct<start, kind, end>``.

    Positions are characters (code points) of the whole text, the end exclusive, sorted by start and then by
    the order of KINDS, which ``kind`` numbers. ``base_secrets`` are the matches of known shape (assignments
    with a value of 8 or more characters, access keys of 16 or more, lower-case hexadecimal runs of 32 or
    more); ``secrets`` adds the entropy spans that do not lie within a base span. Null counts as the empty
    text and has none; repeated rows are scanned each; input columns named like the results are replaced.
    """
    base, extra = fresh(docs, "_base"), fresh(docs, "_extra")
    text = text_of(text_col)
    bare = "struct<start:bigint, kind:int, end:bigint>"
    shapes = F.concat(located(text, ASSIGN, "assign", 2, 8), located(text, ACCESS, "access"), located(text, HEX, "hex"))
    found = docs.withColumn(base, F.array_sort(F.transform(shapes, lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(f"array<{bare}>")))
    found = found.withColumn(extra, entropy_spans(text).cast(f"array<{bare}>"))
    added = F.filter(extra, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    result = F.struct(F.col(base).alias("base_secrets"), F.array_sort(F.concat(F.col(base), added)).alias("secrets"))
    return add_fields(found, result, ["base_secrets", "secrets"]).drop(base, extra)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every secret span of the text replaced by the mask; overlapping spans become one."""
    found = scan_secrets(docs, text_col)
    text = text_of(text_col)
    start = F.expr("named_struct('at', 0L, 'out', cast(array() as array<string>))")

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"], F.array(F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mask)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.coalesce(gap, F.expr("cast(array() as array<string>)"))).alias("out"))

    masked = F.aggregate("secrets", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, masked).otherwise(F.col(text_col)))
