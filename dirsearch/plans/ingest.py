"""Batch ingest: pages -> profile rows, facet rows, education rows, experience
text and an error (dead-letter) table.

Fields that need only the page text (URL name, e-mail, phone, office,
dictionary facets) are computed row-locally on the page scan and travel with
the page's first line; the HTML column is dropped, and the line table
(page_id, pos, line) is shuffled once, for all line-based fields.  The per-field extractors in
:mod:`dirsearch.operators.extract` express the same rules one field at a
time; tests check that both give the same profiles.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import any_contains, clean_lines, collapse_spaces, first_in_order, holds_any
from dirsearch.operators import extract as X
from dirsearch.operators import lines as LN
from dirsearch.operators.criteria import valid_name
from dirsearch.operators.upsert import explode_facets, profile_id


@dataclass
class Lexicon:
    practices: list = field(default_factory=lambda: list(L.PRACTICES))
    industries: list = field(default_factory=lambda: list(L.INDUSTRIES))
    offices: list = field(default_factory=lambda: list(L.OFFICES))
    regions: list = field(default_factory=lambda: list(L.REGIONS))
    titles: list = field(default_factory=lambda: list(L.TITLE_KEYWORDS))
    languages: list = field(default_factory=lambda: list(L.LANGUAGES))
    name_blacklist: list = field(default_factory=lambda: list(L.NAME_BLACKLIST))
    stored_blacklist: list = field(default_factory=lambda: list(L.STORED_NAME_BLACKLIST))
    url_slug: str = L.URL_SLUG
    email_domain: str = r"[a-zA-Z0-9.-]+\.[a-zA-Z]+"  # a regular expression; by default any domain
    head_lines: int | None = None  # look for a name-shaped line in so many first lines; None: in all


@dataclass
class Parsed:
    profiles: DataFrame
    facets: DataFrame
    schools: DataFrame
    educations: DataFrame
    experience: DataFrame
    errors: DataFrame


def _sorted_lines(cond):
    return F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("pos").alias("p"), F.col("line").alias("l")))))


def _nonempty(arr):
    return F.when(F.size(arr) > 0, arr)


def parsed_rows(pages: DataFrame, lex: Lexicon | None = None, *, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", keep_raw: bool = False) -> DataFrame:
    """One row a page with everything that parsing finds: lists stay nested.

    Plan shape: row-local fields on the page scan; the cleaned text is
    exploded into ``(page_id, pos, line)``, the row-local fields go with the
    first line; one shuffle by ``page_id``; three stacked window passes over
    that one partitioning compute every per-line flag (neighbour lines,
    section states, first/last markers); one grouped aggregation with filtered
    ``min_by`` / ``collect_list`` gives all fields.  No join, nothing runs here.
    """
    lex = lex or Lexicon()
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        LN.html_to_text(F.col(html_col)).alias("text"),
                        *([F.col(html_col).alias("raw_html")] if keep_raw else []))
    local = F.struct(
        "url", *(["raw_html"] if keep_raw else []),
        X.name_from_url("url", lex.url_slug).alias("url_name"),
        X.email("text", lex.email_domain).alias("email"),
        X.phone("text").alias("phone"),
        X.office("text", lex.offices).alias("office_location"),
        X.dictionary_values("text", lex.practices).alias("practice"),
        X.dictionary_values("text", lex.industries).alias("industry"),
        F.size("lines").alias("n_lines"))
    rows = (base.withColumn("lines", F.coalesce(clean_lines("text"), F.array().cast("array<string>")))
            .select("page_id", local.alias("local"), "lines")
            .select("page_id", "local", F.posexplode_outer("lines").alias("pos", "line"))
            .withColumn("local", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("local"))))
    parsed = _line_fields(rows, lex).select("page_id", "local.*", *LINE_FIELDS)
    name = F.coalesce("url_name", "near_name", "line_name", "title_name")
    # write-time check: a blacklisted name is replaced from the e-mail, else NULL
    bad = any_contains(F.lower(name), lex.stored_blacklist)
    parsed = parsed.withColumn("name", F.when(bad, X.name_from_email("email")).otherwise(name))
    first, last = X.split_first_last(F.col("name"))
    return parsed.withColumns({"id": profile_id("url"), "first_name": first, "last_name": last})


def tables_of(rows: DataFrame, school_aliases: DataFrame | None = None) -> Parsed:
    """The tables of parsed rows.  Written rows are parsed once and read by every table."""
    good = rows.where(F.col("n_lines") > 0)
    profiles = good.select("id", "url", "name", "first_name", "last_name", "email", "phone", "title", "office_location", "clerkship",
                           *(["raw_html"] if "raw_html" in rows.columns else []))
    facets = explode_facets(good, "id", ["practice", "industry", "region", "language"])
    schools = good.select("id", "school").where(F.col("school").isNotNull())
    educations = X.education_rows(schools, "id", aliases=school_aliases)
    experience = good.where(F.col("experience").isNotNull()).select("id", F.col("experience").alias("content"))
    errors = rows.where(F.col("n_lines") == 0).select("page_id", "url", F.lit("empty page").alias("error"))
    return Parsed(profiles, facets, schools, educations, experience, errors)


def parse_pages(pages: DataFrame, lex: Lexicon | None = None, *, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", keep_raw: bool = False,
                school_aliases: DataFrame | None = None) -> Parsed:
    """Parse every page into profile rows, facets, schools, experience and errors; lazy, so each table that is used
    parses the pages.  :func:`ingest_pages` parses once for all of them."""
    return tables_of(parsed_rows(pages, lex, id_col=id_col, url_col=url_col, html_col=html_col, keep_raw=keep_raw), school_aliases)


COUNTERS = ("processed", "errors", "with_experience")


def ingest_pages(pages: DataFrame, path: str, existing_urls: DataFrame | None = None, lex: Lexicon | None = None, *,
                 school_aliases: DataFrame | None = None, keep_raw: bool = False) -> tuple[Parsed, DataFrame]:
    """One parse of the pages that are not stored yet, written to ``path`` as one nested row a page; the tables read from
    there, and the run counters (A5) as ``(metric, value)`` rows: seen, skipped (already stored), processed, errors,
    with_experience.

    What the parse finds is counted in flight, by an observation in the job's last stage (whose tasks count once, also
    if executors are lost); seen and skipped read the URLs only.
    """
    spark = pages.sparkSession
    new = pages if existing_urls is None else skip_existing(pages, existing_urls)
    counted = Observation(f"ingest-{uuid.uuid4().hex}")
    good = F.col("n_lines") > 0
    rows = parsed_rows(new, lex, keep_raw=keep_raw).observe(
        counted, F.count_if(good).alias("processed"), F.count_if(~good).alias("errors"), F.count_if(good & F.col("experience").isNotNull()).alias("with_experience"))
    rows.write.mode("overwrite").parquet(path)
    seen = pages.agg(F.count("*").alias("value")).select(F.lit("seen").alias("metric"), "value")
    if existing_urls is not None:
        known = pages.select("url").join(existing_urls.select("url").distinct(), "url", "left_semi")
        seen = seen.unionAll(known.agg(F.count("*").alias("value")).select(F.lit("skipped"), "value"))
    found = counted.get
    counters = seen.unionAll(spark.createDataFrame([(c, int(found.get(c) or 0)) for c in COUNTERS], "metric string, value long"))
    return tables_of(spark.read.schema(rows.schema).parquet(path), school_aliases), counters


LINE_FIELDS = ["near_name", "line_name", "title_name", "title", "school", "region", "language", "clerkship", "experience"]


def _line_fields(lines: DataFrame, lex: Lexicon) -> DataFrame:
    """All line-based fields of every page: one exchange, three window passes, one aggregate."""
    w = Window.partitionBy("page_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    valid = valid_name(line, lex.name_blacklist, L.NAME_SHAPE, L.NAME_BAD_CHARS)

    def mark(header, stops):
        return F.when(line.contains(header), F.lit(1)).when(holds_any(line, stops), F.lit(0))

    m = (lines.withColumn("valid", valid)
         .withColumn("title_word", first_in_order(line, lex.titles))
         .withColumn("m_edu", mark(L.EDUCATION_HEADER, L.EDUCATION_STOPS))
         .withColumn("m_cap", mark(L.CAPABILITIES_HEADER, L.CAPABILITIES_STOPS))
         .withColumn("m_lang", mark(L.LANGUAGE_HEADER, L.LANGUAGE_STOPS))
         .withColumn("m_clerk", mark(L.CLERKSHIP_HEADER, L.CLERKSHIP_STOPS)))
    # pass 1: neighbours and running section states
    m = m.select(
        "*",
        F.first(F.when(F.col("valid"), line), ignorenulls=True).over(w.rowsBetween(-5, -1)).alias("near_cand"),
        F.lag("line", 1).over(w).alias("prev"),
        F.lag("valid", 1).over(w).alias("prev_valid"),
        F.lead("line", 1).over(w).alias("next"),
        F.collect_list("line").over(w.rowsBetween(-L.NAV_LOOKBACK, -1)).alias("prev5"),
        F.last("m_edu", ignorenulls=True).over(upto).alias("s_edu"),
        F.last("m_cap", ignorenulls=True).over(upto).alias("s_cap"),
        F.last("m_lang", ignorenulls=True).over(upto).alias("s_lang"),
        F.coalesce(F.max((F.col("m_clerk") == 1).cast("int")).over(before), F.lit(0)).alias("clerk_opened"))
    # pass 2: experience opening lines (need next/prev5) and clerkship closing state
    hdr = L.EXPERIENCE_HEADER
    is_header = (line == hdr) | (line.startswith(hdr) & (F.length(line) < L.EXPERIENCE_HEADER_MAX_LEN))
    nav_arr = F.array(*[F.lit(x) for x in L.EXPERIENCE_NAV])
    is_nav = F.col("next").isNotNull() & (F.coalesce(any_contains(F.col("next"), L.EXPERIENCE_NAV), F.lit(False))
                                          | F.coalesce(F.arrays_overlap("prev5", nav_arr), F.lit(False)))
    m = m.withColumn("x_open", is_header & ~is_nav)
    clerk_close = (F.col("m_clerk") == 0) & (F.col("clerk_opened") == 1)
    m = m.select("*",
                 F.coalesce(F.max(F.col("x_open").cast("int")).over(before), F.lit(0)).alias("x_opened"),
                 F.max(clerk_close.cast("int")).over(upto).alias("clerk_closed"))
    # pass 3: experience closing state
    x_close = ((F.col("x_opened") == 1) & ~F.col("x_open") & (line != L.EXPERIENCE_KEEP_LINE)
               & holds_any(line, L.EXPERIENCE_STOPS))
    m = m.withColumn("x_closed", F.max(x_close.cast("int")).over(upto))

    pos = F.col("pos")
    low = F.lower(line)
    mail_re = r"(?i)[a-zA-Z0-9._%+-]+@" + lex.email_domain
    has_title = F.col("title_word").isNotNull()
    edu_in = (F.col("s_edu") == 1) & F.col("m_edu").isNull()
    edu_keep = any_contains(line, L.EDUCATION_DEGREE_MARKS) | (
        any_contains(line, L.EDUCATION_SCHOOL_WORDS) & (F.length(line) < L.EDUCATION_MAX_LEN))
    cap_in = (F.col("s_cap") == 1) & F.col("m_cap").isNull() & ~any_contains(low, L.CAPABILITIES_SKIPS)
    lang_in = (F.col("s_lang") == 1) & F.col("m_lang").isNull()
    lang_found = F.filter(F.array(*[F.when(line.rlike(X.word_pattern(x)), F.lit(x)) for x in lex.languages]),
                          lambda v: v.isNotNull())
    clerk_in = ((F.col("clerk_opened") == 1) & (F.col("clerk_closed") == 0) & F.col("m_clerk").isNull()
                & any_contains(line, L.CLERKSHIP_WORDS))
    x_in = ((F.col("x_opened") == 1) & (F.col("x_closed") == 0) & ~F.col("x_open")
            & ~any_contains(low, L.EXPERIENCE_SKIPS))
    in_head = F.lit(True) if lex.head_lines is None else pos < lex.head_lines
    agg = m.groupBy("page_id").agg(
        F.first("local", ignorenulls=True).alias("local"),
        F.min_by("near_cand", F.when(F.col("near_cand").isNotNull() & line.rlike(mail_re), pos)).alias("near_name"),
        F.min_by("line", F.when(in_head & F.col("valid") & line.rlike(L.NAME_LINE), pos))
        .alias("line_name"),
        F.min_by("prev", F.when(F.col("prev_valid") & F.col("prev").isNotNull() & has_title, pos)).alias("title_name"),
        F.min_by("title_word", F.when(has_title, pos)).alias("title"),
        _sorted_lines(edu_in & edu_keep).alias("_edu"),
        _sorted_lines(cap_in).alias("_cap"),
        F.flatten(F.collect_list(F.when(lang_in, lang_found))).alias("_lang"),
        _sorted_lines(clerk_in).alias("_clerk"),
        _sorted_lines(x_in).alias("_exp"))
    exp_text = collapse_spaces(F.array_join(F.transform("_exp", lambda s: s["l"]), " "))
    cap_text = F.array_join(F.transform("_cap", lambda s: s["l"]), "\n")
    return agg.select(
        "page_id", "local", "near_name", "line_name", "title_name", "title",
        _nonempty(F.transform("_edu", lambda s: s["l"])).alias("school"),
        F.when(F.size("_cap") > 0, X.dictionary_values(cap_text, lex.regions)).alias("region"),
        _nonempty(F.array_sort(F.array_distinct("_lang"))).alias("language"),
        F.when(F.size("_clerk") > 0, F.array_join(F.transform("_clerk", lambda s: s["l"]), ", ")).alias("clerkship"),
        F.when(F.length(exp_text) > L.EXPERIENCE_MIN_LEN, exp_text).alias("experience"))


def skip_existing(pages: DataFrame, existing: DataFrame, force: bool = False, url_col: str = "url") -> DataFrame:
    """Pages whose URL is not stored yet (all pages when ``force``)."""
    if force:
        return pages
    return pages.join(existing.select(F.col(url_col).alias(url_col)).distinct(), url_col, "left_anti")
