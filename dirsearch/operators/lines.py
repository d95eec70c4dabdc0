"""Ordered line tables and section windows.

A text becomes ``(doc, pos, line)``: split on newlines, every line stripped,
empty ones dropped, numbered from 0 (array functions inside the row, then one
``posexplode``).  Everything that looks at neighbouring lines is a window over
``partitionBy(doc).orderBy(pos)``: one document's lines come from a single
input row, so a window partition is bounded by one text, never by a key
shared across the table.  Windows with the same spec share one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirsearch.functions.text import any_contains, clean_lines, col_of

# FIXED VALUES: elements of HTML that stand within a line; every other tag breaks the line.
INLINE_TAGS = ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
               "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
               "time", "tt", "u", "var", "wbr"]
SCRIPT_RE = r"(?is)<script[^>]*>.*?</script>"
STYLE_RE = r"(?is)<style[^>]*>.*?</style>"
COMMENT_RE = r"(?s)<!--.*?-->"
BODY_RE = r"(?is)<body[^>]*>(.*)</body>"
INLINE_RE = r"(?i)</?(?:" + "|".join(INLINE_TAGS) + r")(?:\s[^>]*)?/?>"
TAG_RE = r"<[^>]*>"
REFERENCE_RE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

# Named character references of HTML 4 and apos, from the standard library's table.
ENTITY_NAMES = sorted(name2codepoint) + ["apos"]
ENTITY_CHARS = [chr(name2codepoint[n]) for n in ENTITY_NAMES[:-1]] + ["'"]


def unescape(text: Column | str) -> Column:
    """Numeric and named character references decoded; what is none stays as it is."""
    sep = "\x01"
    names = F.map_from_arrays(F.split(F.lit(sep.join(ENTITY_NAMES)), sep), F.split(F.lit(sep.join(ENTITY_CHARS)), sep))

    def decoded(part: Column) -> Column:
        ref = F.regexp_extract(part, REFERENCE_RE, 1)
        code = (F.when(F.lower(ref).startswith("#x"), F.conv(F.substr(ref, F.lit(3)), 16, 10).cast("int"))
                .when(ref.startswith("#"), F.substr(ref, F.lit(2)).cast("int")))
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        found = F.coalesce(char, F.try_element_at(names, ref))
        return F.when((ref != "") & found.isNotNull(), F.concat(found, F.substr(part, F.length(ref) + 2))) \
            .otherwise(F.concat(F.lit("&"), part))

    parts = F.split(col_of(text), "&", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")


def html_to_text(html: Column | str) -> Column:
    """Visible body text of a page: block tags and ``br`` break the line, inline tags do not."""
    h = col_of(html)
    body = F.regexp_extract(h, BODY_RE, 1)
    t = F.when(body != "", body).otherwise(h)
    for pat in (SCRIPT_RE, STYLE_RE, COMMENT_RE, INLINE_RE):
        t = F.regexp_replace(t, pat, "")
    return unescape(F.regexp_replace(t, TAG_RE, "\n"))


def text_lines(df: DataFrame, id_col: str, text_col: str | Column, keep: Sequence[str] = ()) -> DataFrame:
    """``(id, pos, line)`` for every non-empty stripped line of every text."""
    return df.select(F.col(id_col), *keep, F.posexplode(clean_lines(col_of(text_col))).alias("pos", "line"))


def page_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return text_lines(pages, id_col, html_to_text(html_col))


def _w(id_col: str) -> Window:
    return Window.partitionBy(id_col).orderBy("pos")


def prev_equals_any(lines: DataFrame, id_col: str, labels: Sequence[str], lookback: int = 5,
                    out: str = "prev_hit") -> DataFrame:
    """Does one of the previous ``lookback`` lines equal a label."""
    prev = F.collect_list("line").over(_w(id_col).rowsBetween(-lookback, -1))
    lab = F.array(*[F.lit(x) for x in labels])
    return lines.withColumn(out, F.coalesce(F.arrays_overlap(prev, lab), F.lit(False)))


def next_contains_any(lines: DataFrame, id_col: str, labels: Sequence[str], out: str = "next_hit") -> DataFrame:
    """Does the next line contain a label (false on the last line)."""
    nxt = F.lead("line", 1).over(_w(id_col))
    return lines.withColumn(out, F.coalesce(any_contains(nxt, labels), F.lit(False)))


def mark_sections(lines: DataFrame, id_col: str, opens: Column, closes: Column) -> DataFrame:
    """Re-openable sections.  ``mark`` is 1 on opening lines, 0 on closing
    lines (an opening test wins), ``in_section`` is true on lines after an
    opening line and before the next closing one; marked lines are excluded."""
    mark = F.when(opens, F.lit(1)).when(closes, F.lit(0))
    state = F.last("mark", ignorenulls=True).over(_w(id_col).rowsBetween(Window.unboundedPreceding, 0))
    return (lines.withColumn("mark", mark).withColumn("state", state)
            .withColumn("in_section", F.coalesce((F.col("state") == 1) & F.col("mark").isNull(), F.lit(False))))


def mark_first_section(lines: DataFrame, id_col: str, opens: Column, closes: Column) -> DataFrame:
    """One-shot section: lines after the first opening line up to (not
    including) the first closing line after it; later opening lines are
    skipped, nothing after the closing line counts."""
    mark = F.when(opens, F.lit(1)).when(closes, F.lit(0))
    whole = Window.partitionBy(id_col)
    m = lines.withColumn("mark", mark)
    m = m.withColumn("first_open", F.min(F.when(F.col("mark") == 1, F.col("pos"))).over(whole))
    m = m.withColumn("first_close", F.min(F.when((F.col("mark") == 0) & (F.col("pos") > F.col("first_open")),
                                                 F.col("pos"))).over(whole))
    inside = ((F.col("pos") > F.col("first_open"))
              & (F.col("first_close").isNull() | (F.col("pos") < F.col("first_close")))
              & F.col("mark").isNull())
    return m.withColumn("in_section", F.coalesce(inside, F.lit(False)))


def ordered_join(line: Column | str, pos: Column | str, sep: str) -> Column:
    """A7 aggregate: lines of a group joined in ``pos`` order."""
    items = F.array_sort(F.collect_list(F.struct(col_of(pos).alias("p"), col_of(line).alias("l"))))
    return F.array_join(F.transform(items, lambda s: s["l"]), sep)


def ordered_list(line: Column | str, pos: Column | str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(col_of(pos).alias("p"), col_of(line).alias("l"))))
    return F.transform(items, lambda s: s["l"])


def first_by_pos(value: Column | str, pos: Column | str = "pos") -> Column:
    """A6 aggregate: value of the earliest line (nulls ignored by ``min_by``'s filter)."""
    return F.min_by(col_of(value), col_of(pos))
