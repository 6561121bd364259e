"""Secrets in text: fixed patterns, and strings whose characters look random."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds: pattern of an assignment, least lengths of its value, of an access key and of a hex run.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Candidates of the entropy rule: runs of 20 or more base-64 characters with a digit among them. The look-behind
#: keeps a run from being tried again at each of its characters.
_RUN = "[A-Za-z0-9+/_=-]"
CANDIDATE = f"(?<!{_RUN})(?=[A-Za-z+/_=-]*+[0-9]){_RUN}{{20,}}+"
WINDOW = 20
#: Per character class: its characters and the least entropy (bits) of a window.
CLASSES = {
    "hex": ("0123456789abcdefABCDEF", 3.0),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
}
#: Harmless strings: numbers, UUIDs, placeholders, counting sequences, one character over and over, paths.
ALLOWED = (
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[-_]|lorem",
    r"(?i)0123456789|123456789|abcdefgh",
    r"(.)\1{7}",
    r"^/[^/]+/[^/]+/",
)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
KINDS = ("assign", "access", "hex", "entropy")


def _span(start: Column, end: Column, kind: str, value: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                    F.lit(kind).alias("kind"), value.alias("value"))


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as an array of spans, in code points, end exclusive.

    Positions follow from the lengths of the matches and of the pieces between them. ``keep`` filters on the
    matched string. Beyond the first test, work is only done in texts with a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("n"), match.alias("value")))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        one = _span(begin, begin + x["n"], kind, x["value"])
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    nothing = F.array().cast(SPAN)
    out = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), nothing.alias("out")), add, lambda acc: acc["out"])
    if keep is not None:
        out = F.filter(out, lambda s: keep(s["value"]))
    return F.when(text.rlike(pattern), out).otherwise(nothing)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds. A run that is too short drops out; for access keys and hex runs the least
    length stands in the pattern, which is the same since such a run holds no other match of that length."""
    return F.concat(
        spans(text, ASSIGN, "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= ASSIGN_LEAST),
        spans(text, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", "access"),
        spans(text, f"[0-9a-f]{{{HEX_LEAST},}}", "hex"))


def random_windows(value: Column, alphabet: str, least: float, window: int = WINDOW) -> Column:
    """First and last start (from 0) of the windows whose entropy has ``least`` bits or more; -1 without any.

    H = log2 w - (1/w) sum of c log2 c. The counts of a window follow from those before by the character that
    enters and the one that leaves, and so does the sum. A character outside the alphabet breaks the window.
    """
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))
    before = F.concat(F.array_repeat(F.lit(0), window), codes)
    steps = F.zip_with(codes, F.slice(before, 1, F.length(value)), lambda e, x: F.struct(e.alias("e"), x.alias("x")))
    bits = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    empty = F.array_repeat(F.lit(0), len(alphabet))
    most = window * (math.log2(window) - least)

    def count(acc: Column, code: Column) -> Column:
        return F.element_at(acc["counts"], code)

    def step(acc: Column, c: Column) -> Column:
        full = acc["run"] >= window
        a = count(acc, c["e"])
        entered = acc["s"] + F.element_at(bits, a + 2) - F.element_at(bits, a + 1)
        b = count(acc, c["x"]) + (c["x"] == c["e"]).cast("int")
        s = F.when(full, entered + F.element_at(bits, b) - F.element_at(bits, b + 1)).otherwise(entered)
        counts = F.transform(acc["counts"], lambda n, i: n + (i + 1 == c["e"]).cast("int")
                             - (full & (i + 1 == c["x"])).cast("int"))
        run, at = acc["run"] + 1, acc["at"] + 1
        hot = (run >= window) & (s <= most + 1e-9)
        new = F.struct(counts.alias("counts"), s.alias("s"), run.alias("run"), at.alias("at"),
                       F.when(hot & (acc["first"] < 0), at - window).otherwise(acc["first"]).alias("first"),
                       F.when(hot, at - window).otherwise(acc["last"]).alias("last"))
        broken = F.struct(empty.alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("run"), at.alias("at"),
                          acc["first"].alias("first"), acc["last"].alias("last"))
        return F.when(c["e"] == 0, broken).otherwise(new)

    start = F.struct(empty.alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("run"), F.lit(0).alias("at"),
                     F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """Stretches of candidate strings from the first to the last random window of a class, allow-list removed."""
    allowed = [lambda v, p=p: v.rlike(p) for p in ALLOWED]

    def suspicious(v: Column) -> Column:
        bad = F.lit(False)
        for test in allowed:
            bad = bad | test(v)
        return ~bad

    def stretch(span: Column) -> Column:
        hexes, wide = (random_windows(span["value"], *CLASSES[name], window) for name in ("hex", "base64"))
        hot = F.when(hexes["first"] >= 0, hexes).otherwise(wide)
        return F.struct(span.alias("span"), hot.alias("hot"))

    found = F.transform(spans(text, CANDIDATE, "entropy", suspicious), stretch)
    found = F.filter(found, lambda x: x["hot"]["first"] >= 0)
    return F.transform(found, lambda x: _span(
        x["span"]["start"] + x["hot"]["first"], x["span"]["start"] + x["hot"]["last"] + window, "entropy",
        F.substring(x["span"]["value"], x["hot"]["first"] + 1, x["hot"]["last"] - x["hot"]["first"] + window)))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: (key, base, spans), arrays of (start, rank, end, kind, value) in text order.

    Base kinds: assignments of passwords and tokens, access keys, long hex runs. The method adds strings with a
    window of high Shannon entropy for their character class, unless the allow-list knows them or a base span
    overlaps them. NULL text counts as empty and has empty arrays; rows are mapped one by one, so repeated keys
    repeat and a very long text costs its length only.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("k"), content.alias("t")).withColumn("base", F.array_sort(base_spans(F.col("t"))))
    extra = F.filter(entropy_spans(F.col("t"), window), lambda s: ~F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    every = F.array_sort(F.concat("base", extra))
    return base.select(F.col("k").alias(key), "base", every.alias("spans"))


def as_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
