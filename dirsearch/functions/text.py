"""Column functions for text.  All of them build JVM-side expressions; nothing
here runs Python per row."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirsearch.functions.lexicons import PY_WHITESPACE


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_regex(pattern: str) -> str:
    """Give a Python ``re`` pattern Python's Unicode meaning of ``\\w \\b \\s \\d`` in Java."""
    return pattern if pattern.startswith("(?U)") else "(?U)" + pattern


def strip(c: Column | str) -> Column:
    """``str.strip()``: remove Python whitespace from both ends."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def clean_lines(text: Column | str, sep: str = "\n") -> Column:
    """array<string>: split on ``sep``, strip every line, drop empty ones.

    This is the ordered line list every extractor works on; positions in it
    are the 0-based line numbers.  Pure array functions, so a text never
    leaves its row (no shuffle).
    """
    parts = F.split(col_of(text), re.escape(sep), -1)
    return F.filter(F.transform(parts, strip), lambda x: x != F.lit(""))


def any_contains(c: Column | str, needles: Sequence[str]) -> Column:
    """True when any needle is a case-sensitive substring of ``c``.

    One regex of escaped literal alternatives (a single expression, built
    with one call instead of one per needle)."""
    c = col_of(c)
    if not needles:
        return F.lit(False)
    return c.rlike("|".join(re.escape(n) for n in needles))


def holds_any(c: Column | str, needles: Sequence[str]) -> Column:
    """As :func:`any_contains`, by one byte search a needle: for a few needles several times as fast on long texts.  Each
    reads ``c``, which should be a plain column."""
    c = col_of(c)
    return reduce(or_, [c.contains(n) for n in needles]) if needles else F.lit(False)


_SEP = "\u0001"


def literal_array(values: Sequence[str]) -> Column:
    """Constant array<string> built from one joined literal (folded by the optimizer)."""
    if not values:
        return F.array().cast("array<string>")
    if any(_SEP in v for v in values):
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit(_SEP.join(values)), _SEP, -1)


def any_equals(c: Column | str, values: Sequence[str]) -> Column:
    return col_of(c).isin(list(values))


def dict_hits(text: Column | str, dictionary: Sequence[str]) -> Column:
    """array<string>: dictionary entries occurring as substrings of ``text``,
    in dictionary order (theta join text x small dictionary, row-local)."""
    return F.filter(literal_array(dictionary), lambda d: F.contains(col_of(text), d))


def first_hit_by_position(text: Column | str, dictionary: Sequence[str]) -> Column:
    """The dictionary entry that occurs earliest in ``text`` (ties: dictionary order)."""
    t = col_of(text)
    hits = F.array(*[F.when(t.contains(d), F.struct(F.instr(t, d).alias("p"), F.lit(i).alias("i"), F.lit(d).alias("v")))
                     for i, d in enumerate(dictionary)])
    return F.array_min(hits)["v"]


def first_in_order(text: Column | str, keywords: Sequence[str]) -> Column:
    """First keyword of ``keywords`` (list order) contained in ``text``."""
    t = col_of(text)
    out = None
    for k in reversed(keywords):
        out = F.when(t.contains(k), F.lit(k)) if out is None else F.when(t.contains(k), F.lit(k)).otherwise(out)
    return out if out is not None else F.lit(None).cast("string")


def regex_first(text: Column | str, patterns: Sequence[str], group: int = 0) -> Column:
    """First pattern (in order) that matches ``text``; its match (or group)."""
    t = col_of(text)
    outs = [F.when(t.rlike(p), F.regexp_extract(t, p, group)) for p in patterns]
    return F.coalesce(*outs) if len(outs) > 1 else outs[0]


def capitalize_word(w: Column) -> Column:
    """Python ``str.capitalize`` for one word: first char upper, rest lower."""
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))


def name_from_slug(slug: Column | str, roman: Sequence[str], suffixes: Sequence[str]) -> Column:
    """Turn ``robert-fiske-jr`` into ``Robert Fiske Jr``: roman numerals and
    single letters upper-cased, other parts capitalised."""
    parts = F.split(col_of(slug), "-", -1)
    roman_arr = F.array(*[F.lit(r) for r in roman])

    def fix(p: Column) -> Column:
        return (F.when(F.array_contains(roman_arr, p), F.upper(p))
                .when(F.length(p) == 1, F.upper(p))
                .when(p.contains("'"), F.initcap(p))
                .otherwise(capitalize_word(p)))

    return F.when(col_of(slug).isNotNull(), F.array_join(F.transform(parts, fix), " "))


def truncate_preview(c: Column | str, n: int) -> Column:
    c = col_of(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(col_of(c), r"(?U)\s+", " "))


def words_in_text(text: Column | str, words: Column | str) -> Column:
    """Those of an array of lower-case words that occur in the text; the text is lower-cased once."""
    found = F.transform(F.array(F.lower(col_of(text))), lambda low: F.filter(col_of(words), lambda k: F.instr(low, k) > 0))
    return F.element_at(found, 1)
