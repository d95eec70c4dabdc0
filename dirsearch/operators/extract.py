"""Profile fields from pages: each extractor is a Column expression over one
text, or an aggregate over a document's line table.  Lexicons default to the
fixed values in :mod:`dirsearch.functions.lexicons` and can be replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import (any_contains, col_of, collapse_spaces, dict_hits, first_hit_by_position,
                                      first_in_order, name_from_slug, strip)
from dirsearch.operators.lines import mark_first_section, mark_sections, ordered_join, ordered_list


def _nz(c: Column) -> Column:
    return F.when(c != "", c)


# ---------------------------------------------------------------- per text
def name_from_url(url: Column | str, pattern: str = L.URL_SLUG) -> Column:
    """Name from the profile URL slug (null when the URL does not match)."""
    slug = F.regexp_extract(F.lower(col_of(url)), pattern, 1)
    return F.when(slug != "", name_from_slug(slug, L.ROMAN_PARTS, L.SUFFIX_PARTS))


def email(text: Column | str, domain: str) -> Column:
    """First e-mail address of the domain, lower-cased.

    An address starts where its run of characters starts, so each run is tried once."""
    return F.lower(_nz(F.regexp_extract(col_of(text), r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]++@" + domain, 0)))


def phone(text: Column | str, patterns: Sequence[str] = L.PHONE_PATTERNS) -> Column:
    """First hit of the first phone pattern (in priority order) that matches."""
    t = col_of(text)
    return F.coalesce(*[strip(_nz(F.regexp_extract(t, p, 0))) for p in patterns])


def office(text: Column | str, offices: Sequence[str] = L.OFFICES) -> Column:
    """The office name occurring first in the text."""
    return first_hit_by_position(text, offices)


def dictionary_values(text: Column | str, dictionary: Sequence[str]) -> Column:
    """Every dictionary value found in the text (dictionary order), null if none."""
    hits = F.array(dict_hits(text, dictionary))  # in an array, so that the text is searched once
    return F.get(F.filter(hits, lambda h: F.size(h) > 0), F.lit(0))


def word_pattern(word: str, ignore_case: bool = True) -> str:
    """Whole-word match with explicit Unicode word classes (same in Java and RE2)."""
    import re

    flag = "(?i)" if ignore_case else ""
    return flag + r"(^|[^\p{L}\p{N}_])" + re.escape(word) + r"([^\p{L}\p{N}_]|$)"


# ------------------------------------------------------- per line table
def title_of(lines: DataFrame, id_col: str, keywords: Sequence[str] = L.TITLE_KEYWORDS) -> DataFrame:
    """First line holding a keyword, then the first keyword (list order) in it."""
    hit = lines.where(any_contains("line", keywords))
    return hit.groupBy(id_col).agg(F.min_by(first_in_order("line", keywords), "pos").alias("title"))


def near_match(lines: DataFrame, id_col: str, anchor: Column, candidate: Column, lookback: int = 5,
               out: str = "name") -> DataFrame:
    """For the first anchor line that has one, the earliest candidate line
    among the ``lookback`` lines before it."""
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(-lookback, -1)
    m = (lines.withColumn("_cand", F.first(F.when(candidate, F.col("line")), ignorenulls=True).over(w))
         .where(anchor & F.col("_cand").isNotNull()))
    return m.groupBy(id_col).agg(F.min_by("_cand", "pos").alias(out))


def line_before(lines: DataFrame, id_col: str, trigger: Column, candidate_ok, out: str = "name") -> DataFrame:
    """The line just before the first trigger line whose predecessor passes ``candidate_ok``."""
    w = Window.partitionBy(id_col).orderBy("pos")
    m = lines.withColumn("_prev", F.lag("line", 1).over(w))
    m = m.where(trigger & F.col("_prev").isNotNull() & candidate_ok(F.col("_prev")))
    return m.groupBy(id_col).agg(F.min_by("_prev", "pos").alias(out))


def first_line_matching(lines: DataFrame, id_col: str, pred: Column, head: int | None = None,
                        out: str = "line") -> DataFrame:
    """A6 (+T6): earliest line satisfying ``pred``, optionally only in the first ``head`` lines."""
    m = lines.where(pred) if head is None else lines.where((F.col("pos") < head) & pred)
    return m.groupBy(id_col).agg(F.min_by("line", "pos").alias(out))


def section_lines(lines: DataFrame, id_col: str, opens: Column, closes: Column, keep: Column,
                  once: bool = False) -> DataFrame:
    """Lines inside sections that also satisfy ``keep``."""
    marked = (mark_first_section if once else mark_sections)(lines, id_col, opens, closes)
    return marked.where(F.col("in_section") & keep).select(id_col, "pos", "line")


def education_lines(lines: DataFrame, id_col: str, header: str = L.EDUCATION_HEADER,
                    stops: Sequence[str] = L.EDUCATION_STOPS, marks: Sequence[str] = L.EDUCATION_DEGREE_MARKS,
                    school_words: Sequence[str] = L.EDUCATION_SCHOOL_WORDS,
                    max_len: int = L.EDUCATION_MAX_LEN) -> DataFrame:
    """Education lines (degree mark, or school word in a short line), ordered."""
    keep = any_contains("line", marks) | (any_contains("line", school_words) & (F.length("line") < max_len))
    s = section_lines(lines, id_col, F.col("line").contains(header), any_contains("line", stops), keep)
    return s.groupBy(id_col).agg(ordered_list("line", "pos").alias("school"))


def clerkship(lines: DataFrame, id_col: str, header: str = L.CLERKSHIP_HEADER,
              stops: Sequence[str] = L.CLERKSHIP_STOPS, words: Sequence[str] = L.CLERKSHIP_WORDS) -> DataFrame:
    """X11: matching lines of the first clerkship section joined by ', '."""
    s = section_lines(lines, id_col, F.col("line").contains(header), any_contains("line", stops),
                      any_contains("line", words), once=True)
    return s.groupBy(id_col).agg(ordered_join("line", "pos", ", ").alias("clerkship"))


def capability_values(lines: DataFrame, id_col: str, dictionary: Sequence[str] = L.REGIONS,
                      header: str = L.CAPABILITIES_HEADER, stops: Sequence[str] = L.CAPABILITIES_STOPS,
                      skips: Sequence[str] = L.CAPABILITIES_SKIPS, out: str = "region") -> DataFrame:
    """Dictionary values found in the text of the Capabilities sections."""
    keep = ~any_contains(F.lower("line"), skips)
    s = section_lines(lines, id_col, F.col("line").contains(header), any_contains("line", stops), keep)
    text = s.groupBy(id_col).agg(ordered_join("line", "pos", "\n").alias("_t"))
    return text.select(id_col, dictionary_values("_t", dictionary).alias(out)).where(F.col(out).isNotNull())


def languages(lines: DataFrame, id_col: str, words: Sequence[str] = L.LANGUAGES, header: str = L.LANGUAGE_HEADER,
              stops: Sequence[str] = L.LANGUAGE_STOPS) -> DataFrame:
    """Distinct dictionary words (whole word, any case) inside Languages sections."""
    s = section_lines(lines, id_col, F.col("line").contains(header), any_contains("line", stops), F.lit(True))
    found = F.filter(F.array(*[F.when(F.col("line").rlike(word_pattern(w)), F.lit(w)) for w in words]),
                     lambda x: x.isNotNull())
    per_line = s.select(id_col, found.alias("_f"))
    return (per_line.groupBy(id_col).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_f"))))
                                         .alias("language"))
            .where(F.size("language") > 0))


def experience(lines: DataFrame, id_col: str, header: str = L.EXPERIENCE_HEADER,
               header_max_len: int = L.EXPERIENCE_HEADER_MAX_LEN, stops: Sequence[str] = L.EXPERIENCE_STOPS,
               keep_line: str = L.EXPERIENCE_KEEP_LINE, nav: Sequence[str] = L.EXPERIENCE_NAV,
               skips: Sequence[str] = L.EXPERIENCE_SKIPS, min_len: int = L.EXPERIENCE_MIN_LEN,
               lookback: int = L.NAV_LOOKBACK) -> DataFrame:
    """Experience section text (W1 + W2 + W4 + A7); null unless longer than ``min_len``."""
    w = Window.partitionBy(id_col).orderBy("pos")
    line = F.col("line")
    is_header = (line == header) | (line.startswith(header) & (F.length(line) < header_max_len))
    nxt = F.lead("line", 1).over(w)
    prev = F.collect_list("line").over(w.rowsBetween(-lookback, -1))
    nav_arr = F.array(*[F.lit(x) for x in nav])
    is_nav = nxt.isNotNull() & (F.coalesce(any_contains(nxt, nav), F.lit(False))
                                | F.coalesce(F.arrays_overlap(prev, nav_arr), F.lit(False)))
    m = lines.withColumn("_open", is_header & ~is_nav)
    whole = Window.partitionBy(id_col)
    m = m.withColumn("_start", F.min(F.when(F.col("_open"), F.col("pos"))).over(whole))
    closes = any_contains(line, stops) & (line != keep_line) & ~F.col("_open")
    m = m.withColumn("_stop", F.min(F.when(closes & (F.col("pos") > F.col("_start")), F.col("pos"))).over(whole))
    inside = ((F.col("pos") > F.col("_start")) & (F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
              & ~F.col("_open") & ~any_contains(F.lower(line), skips))
    kept = m.where(F.coalesce(inside, F.lit(False)))
    text = kept.groupBy(id_col).agg(ordered_join("line", "pos", " ").alias("_t"))
    txt = collapse_spaces("_t")
    return text.select(id_col, F.when(F.length(txt) > min_len, txt).alias("experience")).where(
        F.col("experience").isNotNull())


# --------------------------------------------------------- education tokens
ALL_DEGREES = L.LAW_DEGREES + L.UNDERGRAD_DEGREES + L.GRAD_DEGREES


def degree_fields(line: Column | str) -> Column:
    """struct(degree_type, school_name, honors, is_law_degree) of one education line."""
    ln = col_of(line)
    raw = first_in_order(ln, ALL_DEGREES)
    deg = F.regexp_replace(raw, r"^\.+|\.+$", "")
    is_law = F.coalesce(raw.isin(L.LAW_DEGREES), F.lit(False)).cast("int")
    cleaned = F.when(deg.isNull(), ln).otherwise(
        F.replace(F.replace(ln, F.concat(deg, F.lit(".")), F.lit("")), deg, F.lit("")))
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, r"^[,\s]+", ""), r"[,\s]+$", "")
    by_pattern = F.coalesce(*[_nz(F.regexp_extract(cleaned, p, 1)) for p in L.SCHOOL_PATTERNS])
    by_pattern = strip(F.regexp_replace(strip(by_pattern), r"[,\s]+", " "))
    parts = F.filter(F.transform(F.split(cleaned, ",", -1), strip),
                     lambda p: (F.length(p) > L.SCHOOL_FALLBACK_MIN_LEN)
                     & ~F.lower(p).isin(L.SCHOOL_FALLBACK_SKIP))
    school = F.coalesce(_nz(by_pattern), F.try_element_at(parts, F.lit(1)))
    honors = F.coalesce(*[_nz(F.regexp_extract(ln, "(?i)" + h, 0)) for h in L.HONORS])
    return F.struct(deg.alias("degree_type"), school.alias("school_name"), honors.alias("honors"),
                    is_law.alias("is_law_degree"))


def education_rows(profiles_school: DataFrame, id_col: str, school_col: str = "school",
                   aliases: DataFrame | None = None) -> DataFrame:
    """One row per education line: tokens, alias-normalised school, full text."""
    from dirsearch.operators.aliases import resolve

    e = profiles_school.select(F.col(id_col).alias("profile_id"), F.explode(school_col).alias("full_text"))
    e = e.where(F.col("full_text").isNotNull() & (F.col("full_text") != ""))
    e = e.select("profile_id", "full_text", degree_fields("full_text").alias("t")).select(
        "profile_id", "full_text", "t.*")
    if aliases is None:
        return e.withColumn("school_normalized", F.col("school_name"))
    # a null school name matches no key and resolves to null
    return resolve(e, "school_name", aliases, "school_normalized")


# ------------------------------------------------------------- name repair
def name_from_email(email_col: Column | str) -> Column:
    """Name from an e-mail local part: dots and hyphens become spaces, words
    capitalised; only if it gives at least two words and under 50 chars."""
    e = col_of(email_col)
    cand = F.initcap(F.regexp_replace(F.substring_index(e, "@", 1), r"[.\-]", " "))
    words = F.filter(F.split(strip(cand), r"\s+", -1), lambda w: w != "")
    return F.when(e.contains("@") & (F.size(words) >= 2) & (F.length(cand) < 50), cand)


def repair_name(name: Column | str, email_col: Column | str, url: Column | str, blacklist: Sequence[str],
                url_marker: str = "/lawyers/") -> Column:
    """Blacklisted name -> from e-mail local part -> from URL slug -> unchanged."""
    n = col_of(name)
    low = F.lower(strip(n))
    bad = n.isNotNull() & any_contains(low, blacklist)
    u = col_of(url)
    slug = F.substring_index(F.substring_index(u, url_marker, -1), "?", 1)
    slug_name = F.initcap(F.regexp_replace(slug, "-", " "))
    slug_words = F.filter(F.split(strip(slug_name), r"\s+", -1), lambda w: w != "")
    from_slug = F.when(u.contains(url_marker) & (F.size(slug_words) >= 2) & (F.length(slug_name) < 50), slug_name)
    return F.when(bad, F.coalesce(name_from_email(email_col), from_slug, n)).otherwise(n)


def split_first_last(name: Column | str) -> tuple[Column, Column]:
    """First word and the rest; both '' when the name is null."""
    parts = F.split(strip(F.coalesce(col_of(name), F.lit(""))), r"\s+", 2)
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    last = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return first, last
