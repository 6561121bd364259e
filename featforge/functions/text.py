"""Text expressions: trimming, splitting, and the rules that clean author names.

The name rules are data (see ``fixed_values``); here they become one nested
expression per row, so cleaning a table is a single projection without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


# The characters that Unicode counts as white space, and the four separators U+001C to U+001F.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: Runs of the characters that Unicode counts as white space, as ``(?U)\\s+`` but listed: that one looks up each character.
BLANKS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_line(c: Column) -> Column:
    """Trim a line and delete no-break spaces inside it."""
    return F.replace(strip(c), F.lit("\u00a0"), F.lit(""))


def blank_to_mark(c: Column, mark: str = "_") -> Column:
    """Empty or missing token becomes a visible mark."""
    return F.when(c.isNull() | (c == ""), F.lit(mark)).otherwise(c)


def lines(c: Column, drop_last: bool = False) -> Column:
    """Lines of a whole text, in order."""
    parts = F.split(c, "\n", -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))) if drop_last else parts


def blank_tokens(c: Column) -> Column:
    """Non-empty tokens between white space."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def all_digits(c: Column) -> Column:
    """True for decimal digits of any script."""
    return c.rlike(r"^\p{Nd}+$")


def base_name(path: Column, separator: str = "/") -> Column:
    return F.element_at(F.split(path, "\\\\" if separator == "\\" else separator), -1)


def matches(name: Column, glob: str) -> Column:
    """True for names that a file pattern (``*``, ``?``, ``[a-c]``, ``{jpg,png}``) describes."""
    def plain(part: str) -> str:
        return "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in part)

    out, depth = "", 0
    for part in re.split(r"(\[\^?[^\]]+\]|[{},])", glob):
        if part == "{" or (part == "}" and depth):
            depth += 1 if part == "{" else -1
            out += "(?:" if part == "{" else ")"
        elif part == "," and depth:
            out += "|"
        else:
            out += part if part.startswith("[") and part.endswith("]") else plain(part)
    return name.rlike(f"(?s)^{out}\\z")


def stem(name: Column) -> Column:
    """Text before the first dot."""
    return F.substring_index(name, ".", 1)


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", -1))


def rejoin_blanks(c: Column, separator: str = " _ ") -> Column:
    return F.array_join(F.split(c, " ", -1), separator)


def _quick(pattern: str) -> str:
    """The same pattern, given up at once where the text does not begin as any of its alternatives does."""
    start = V.STARTS.get(pattern)
    return f"(?={start}){pattern}" if start else pattern


def _replaced(c: Column, pattern: str, replacement: str) -> Column:
    """``regexp_replace``, as a plain replacement where the pattern has no sign of its own."""
    if any(x in r"\.^$|?*+()[]{}" for x in pattern) or any(x in "\\$" for x in replacement):
        return F.regexp_replace(c, F.lit(_quick(pattern)), F.lit(replacement))
    return F.replace(c, F.lit(pattern), F.lit(replacement))


def apply_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regular-expression replacements."""
    return reduce(lambda acc, rule: _replaced(acc, *rule), rules, c)


def apply_literals(c: Column, rules: Sequence[tuple[str, str]] = V.LITERAL_RULES) -> Column:
    """Ordered literal replacements, then every run of blanks becomes one blank."""
    done = reduce(lambda acc, rule: F.replace(acc, F.lit(rule[0]), F.lit(rule[1])), rules, c)
    return F.regexp_replace(done, " +", " ")


def _text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def not_stopped(entries: Column, stop: Sequence[str] = V.STOP_ENTRIES) -> Column:
    """Drop stop entries. Compared before trimming, so a blank entry may survive."""
    stop_list = list(stop)
    return F.filter(entries, lambda e: ~e.isin(*stop_list))


def comma_entries(c: Column, drop_containing: str = V.VOLUME_MARK) -> Column:
    """Trimmed comma-separated entries without those holding the volume mark."""
    kept = F.filter(F.split(c, ",", -1), lambda e: ~e.contains(drop_containing))
    return F.transform(kept, strip)


def second_split(c: Column) -> Column:
    """Split at the second delimiter list; delimiters stay as entries of their own."""
    marked = F.regexp_replace(c, F.lit(_quick(V.SECOND_DELIMITERS)), F.lit("\u0001$1\u0001"))
    return F.transform(F.split(marked, "\u0001", -1),
                       lambda e: F.regexp_replace(e, F.lit(V.BRACKET_MARKS), F.lit("")))


def _through_last_alias(entry: Column) -> Column:
    """The part of an entry that can hold an alias.

    Without the rest the search below is not tried from every character of a long tail.
    """
    tail = F.substring_index(entry, "(", -1)
    before = F.substring(entry, F.lit(1), F.length(entry) - F.length(tail) - 1)
    closed = F.concat(before, F.lit("("), F.substring_index(tail, ")", 1), F.lit(")"))
    open_end = F.substring(entry, F.lit(1), F.length(entry) - F.length(F.substring_index(entry, ")", -1)))
    part = F.when(tail.contains(")"), closed).otherwise(open_end)
    return F.when(entry.contains("(") & entry.contains(")"), part).otherwise(F.lit(""))


def split_aliases(entries: Column) -> Column:
    """Entries ``name (alias)`` become two names each, other entries stay."""
    cut = F.transform(entries, lambda e: F.struct(e.alias("e"), _through_last_alias(e).alias("h")))
    found = F.transform(cut, lambda s: F.struct(
        s.e.alias("e"),
        F.transform(F.regexp_extract_all(s.h, F.lit(V.NAME_AND_ALIAS), F.lit(1)), strip).alias("n"),
        F.transform(F.regexp_extract_all(s.h, F.lit(V.NAME_AND_ALIAS), F.lit(2)), strip).alias("a")))

    def parts(s: Column) -> Column:
        wide_alias = F.size(F.split(F.get(s.a, F.lit(0)), " ", -1)) >= 2
        two_parts = (F.size(s.n) == 2) | (
            (F.size(s.n) == 1) & (wide_alias | s.e.rlike(V.WORD_OR_SPACE_IN_PARENS)))
        return F.when(two_parts, F.array(F.array_join(s.n, " "), F.array_join(s.a, " "))
                      ).otherwise(F.array(s.e))

    return F.flatten(F.transform(found, parts))


def split_scripts(entry: Column) -> Column:
    """Two Thai words followed by two Latin words are two names."""
    words = F.split(entry, " ", -1)
    pair = entry.rlike(V.THAI_THEN_LATIN) & (F.size(words) == 4)
    return F.when(pair, F.array(
        F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))),
        F.concat_ws(" ", F.get(words, F.lit(2)), F.get(words, F.lit(3))),
    )).otherwise(F.array(entry))


def override_entry(entry: Column) -> Column:
    out = F.array(entry)
    for text, parts in V.ENTRY_OVERRIDES:
        out = F.when(entry == text, _text_array(parts)).otherwise(out)
    return out


def name_case(entry: Column, exceptions: Sequence[str] = V.CASE_EXCEPTIONS) -> Column:
    """Capital first letter per word, other letters small, listed words unchanged.

    A letter whose capital form has two letters keeps only the first one large.
    """
    keep = list(exceptions)
    words = F.filter(F.split(strip(entry), BLANKS), lambda w: w != "")

    def capital(w: Column) -> Column:
        first = F.upper(F.substring(w, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 9)),
                        F.lower(F.substring(w, 2, 1 << 30)))

    fixed = F.transform(words, lambda w: F.when(w.isin(*keep), w).otherwise(capital(w)))
    return F.array_join(fixed, " ")


def _each(entries: Column, pattern: str) -> Column:
    return F.transform(entries, lambda e: _replaced(e, pattern, ""))


def clean_names(c: Column) -> Column:
    """Author names of a delimited text, in order; an empty array for NULL."""
    whole = apply_rules(F.array_join(comma_entries(c), ","), V.PHRASE_RULES)
    entries = F.transform(not_stopped(second_split(whole)), strip)
    entries = split_aliases(entries)
    entries = _each(entries, V.DEGREES)
    entries = F.flatten(F.transform(entries, override_entry))
    entries = _each(entries, V.TITLES_FIRST)
    entries = _each(entries, V.ISOLATED_MA)
    entries = F.flatten(F.transform(entries, split_scripts))
    entries = _each(entries, V.TITLES_SECOND)
    entries = F.transform(not_stopped(entries), strip)
    names = F.transform(entries, lambda e: name_case(e))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(names)
