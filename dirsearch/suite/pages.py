"""Line-table, section-window and field-extraction keys
over ``documents`` and ``pages`` with stand-in lexicons that occur in the
synthetic text."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import any_contains, clean_lines, strip, truncate_preview
from dirsearch.operators import extract as X
from dirsearch.operators.dictionary import dictionary_hits
from dirsearch.operators import lines as LN
from dirsearch.suite import standins as S
from dirsearch.suite.registry import register, sql_list, sql_str, table

WS_SQL = " || ".join(f"chr({ord(c)})" for c in L.PY_WHITESPACE)


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def lines_sql(src: str, id_col: str, text: str) -> str:
    return (f"select {id_col}, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as line from "
            f"(select {id_col}, list_filter(list_transform(string_split({text}, chr(10)), "
            f"lambda x: {strip_sql('x')}), lambda x: x <> '') as ls from {src})")


DOC_LINES = "l as (" + lines_sql("documents", "doc_id", "text") + ")"


def doc_lines(spark, sf):
    return LN.text_lines(table(spark, sf, "documents"), "doc_id", "text")


def any_sql(x: str, needles, fn="contains") -> str:
    return "(" + " or ".join(f"{fn}({x}, {sql_str(n)})" for n in needles) + ")"


def first_in_order_sql(x: str, needles) -> str:
    return "case " + " ".join(f"when contains({x}, {sql_str(n)}) then {sql_str(n)}" for n in needles) + " end"


# stand-in vocabulary (occurs in the synthetic documents)
NAV_EQ = ["Of.", "Ietzte."]
NAV_SUB = ["Stteen", "And ornd"]
HEADER = "The"
STOPS = [" whi", "Licensed"]

# --------------------------------------------------------------- HTML pages
_ENT_CHARS = "[" + ", ".join("chr(%d)" % ord(c) for c in LN.ENTITY_CHARS) + "]"
_DECODED = (f"case when i = 1 then p when r like '#x%' or r like '#X%' then chr(('0x' || substr(r, 3))::int) || substr(p, length(r) + 2) "
            "when r like '#%' then chr(substr(r, 2)::int) || substr(p, length(r) + 2) "
            f"when list_contains({sql_list(LN.ENTITY_NAMES)}, r) then {_ENT_CHARS}[list_position({sql_list(LN.ENTITY_NAMES)}, r)] "
            "|| substr(p, length(r) + 2) else '&' || p end")
HTML_SQL = ("(with b as (select page_id, url, html, regexp_extract(html, " + sql_str(LN.BODY_RE) + ", 1) as body from pages), "
            "t as (select page_id, url, "
            + "regexp_replace(" * 5 + "case when body <> '' then body else html end, "
            + ", ".join(f"{sql_str(x)}, '', 'g')" for x in (LN.SCRIPT_RE, LN.STYLE_RE, LN.COMMENT_RE, LN.INLINE_RE))
            + f", {sql_str(LN.TAG_RE)}, chr(10), 'g') as t from b), "
            "u as (select page_id, url, unnest(string_split(t, '&')) as p, generate_subscripts(string_split(t, '&'), 1) as i from t), "
            f"r as (select page_id, url, p, i, regexp_extract(p, {sql_str(LN.REFERENCE_RE)}, 1) as r from u) "
            f"select page_id, url, string_agg({_DECODED}, '' order by i) as text from r group by page_id, url)")


@register("page_lines", sql="select * from (" + lines_sql(HTML_SQL, "page_id", "text") + ")")
def page_lines(spark, sf):
    """Visible page text as numbered non-empty lines."""
    return LN.page_lines(table(spark, sf, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "line")


@register("page_text", sql="select page_id, len(ls) as n_lines, array_to_string(ls, chr(10)) as text from "
          f"(select page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), "
          f"lambda x: x <> '') as ls from {HTML_SQL})")
def page_text(spark, sf):
    """Every page reduced to its cleaned text, one row per page (row-local)."""
    ls = clean_lines(LN.html_to_text("html"))
    return table(spark, sf, "pages").select("page_id", F.size(ls).cast("long").alias("n_lines"),
                                            F.array_join(ls, "\n").alias("text"))


URL_ANY = r"^https?://(?:www\.|m\.|blog\.)?([a-z0-9\-]+)\.example\."
URL_WWW = r"^https?://www\.([a-z0-9\-]+)\.example\."


def _slug_name_sql(slug: str) -> str:
    roman = sql_list(L.ROMAN_PARTS)
    return (f"case when {slug} <> '' then array_to_string(list_transform(string_split({slug}, '-'), lambda p: "
            f"case when list_contains({roman}, p) then upper(p) when length(p) = 1 then upper(p) "
            f"else upper(left(p, 1)) || lower(substr(p, 2)) end), ' ') end")


@register("name_from_url", sql="select page_id, " + _slug_name_sql(f"regexp_extract(lower(url), {sql_str(URL_ANY)}, 1)")
          + " as name from pages")
def name_from_url(spark, sf):
    """Name from the URL (test URLs carry the host label as the slug)."""
    return table(spark, sf, "pages").select("page_id", X.name_from_url("url", URL_ANY).alias("name"))


PAGE_LINES = "pl as (" + lines_sql(HTML_SQL, "page_id", "text") + ")"
NAME_LINE_RE = r"^([A-Z][a-z]+(\s+[A-Z][a-z]+)+)$"


@register("name_coalesce", sql=f"with {PAGE_LINES}, "
          "a as (select page_id, " + _slug_name_sql(f"regexp_extract(lower(url), {sql_str(URL_WWW)}, 1)")
          + " as n0 from pages), "
          "w as (select page_id, pos, line, first(case when length(line) < 25 then line end ignore nulls) over "
          "(partition by page_id order by pos rows between 5 preceding and 1 preceding) as cand from pl), "
          "b as (select page_id, arg_min(cand, pos) as n1 from w where contains(line, 'the') and cand is not null "
          "group by 1), "
          f"c as (select page_id, arg_min(line, pos) as n2 from pl where pos < 30 and regexp_full_match(line, "
          f"{sql_str(NAME_LINE_RE[1:-1])}) group by 1), "
          "d0 as (select page_id, pos, line, lag(line) over (partition by page_id order by pos) as prev from pl), "
          "d as (select page_id, arg_min(prev, pos) as n3 from d0 where contains(line, 'Ietzte') and prev is not null "
          "and length(prev) < 40 group by 1) "
          "select a.page_id, coalesce(n0, n1, n2, n3) as name from a left join b using (page_id) "
          "left join c using (page_id) left join d using (page_id)")
def name_coalesce(spark, sf):
    """URL name, else short line near an anchor, else name-shaped line in the
    first 30, else the line before a title line."""
    pages = table(spark, sf, "pages")
    pl = LN.page_lines(pages)
    n1 = X.near_match(pl, "page_id", F.col("line").contains("the"), F.length("line") < 25, out="n1")
    n2 = X.first_line_matching(pl, "page_id", F.col("line").rlike(NAME_LINE_RE), head=30, out="n2")
    n3 = X.line_before(pl, "page_id", F.col("line").contains("Ietzte"), lambda p: F.length(p) < 40, out="n3")
    base = pages.select("page_id", X.name_from_url("url", URL_WWW).alias("n0"))
    out = base.join(n1, "page_id", "left").join(n2, "page_id", "left").join(n3, "page_id", "left")
    return out.select("page_id", F.coalesce("n0", "n1", "n2", "n3").alias("name"))


# ------------------------------------------------------------ documents
@register("head_lines", sql=f"with {DOC_LINES} select doc_id, pos, line from l where pos < 30")
def head_lines(spark, sf):
    """The first 30 lines of every document."""
    return doc_lines(spark, sf).where(F.col("pos") < 30).select("doc_id", F.col("pos").cast("long").alias("pos"),
                                                                "line")


@register("win_prev5", sql=f"with {DOC_LINES} select doc_id, pos, coalesce(list_has_any(list(line) over "
          f"(partition by doc_id order by pos rows between 5 preceding and 1 preceding), {sql_list(NAV_EQ)}), false) "
          "as nav from l")
def win_prev5(spark, sf):
    """Does one of the 5 previous lines equal a navigation label."""
    return (LN.prev_equals_any(doc_lines(spark, sf), "doc_id", NAV_EQ, 5, out="nav")
            .select("doc_id", F.col("pos").cast("long").alias("pos"), "nav"))


@register("win_next", sql=f"with {DOC_LINES} select doc_id, pos, coalesce("
          + any_sql("lead(line) over (partition by doc_id order by pos)", NAV_SUB) + ", false) as next_nav from l")
def win_next(spark, sf):
    """Does the next line contain a navigation label."""
    return (LN.next_contains_any(doc_lines(spark, sf), "doc_id", NAV_SUB, out="next_nav")
            .select("doc_id", F.col("pos").cast("long").alias("pos"), "next_nav"))


_SEC_MARK = "case when length(line) < 30 then 1 when contains(line, ' whi') then 0 end"


@register("sections_reopen", sql=f"with {DOC_LINES}, m as (select *, {_SEC_MARK} as mk from l), "
          "s as (select *, last_value(mk ignore nulls) over (partition by doc_id order by pos rows between "
          "unbounded preceding and current row) as st from m) "
          "select doc_id, string_agg(line, ' ' order by pos) as body from s where st = 1 and mk is null group by doc_id")
def sections_reopen(spark, sf):
    """Text of re-openable sections (short line opens, ' whi' closes)."""
    m = LN.mark_sections(doc_lines(spark, sf), "doc_id", F.length("line") < 30, F.col("line").contains(" whi"))
    return m.where("in_section").groupBy("doc_id").agg(LN.ordered_join("line", "pos", " ").alias("body"))


@register("sections_first", sql=f"with {DOC_LINES}, m as (select *, {_SEC_MARK} as mk from l), "
          "f as (select *, min(case when mk = 1 then pos end) over (partition by doc_id) as fo from m), "
          "g as (select *, min(case when mk = 0 and pos > fo then pos end) over (partition by doc_id) as fc from f) "
          "select doc_id, string_agg(line, ' ' order by pos) as body from g "
          "where pos > fo and (fc is null or pos < fc) and mk is null group by doc_id")
def sections_first(spark, sf):
    """Text of the first section only (stops for good at its closing line)."""
    m = LN.mark_first_section(doc_lines(spark, sf), "doc_id", F.length("line") < 30,
                              F.col("line").contains(" whi"))
    return m.where("in_section").groupBy("doc_id").agg(LN.ordered_join("line", "pos", " ").alias("body"))


@register("win_near_match", sql=f"with {DOC_LINES}, w as (select doc_id, pos, line, first(case when length(line) < 40 "
          "then line end ignore nulls) over (partition by doc_id order by pos rows between 5 preceding and "
          "1 preceding) as cand from l) select doc_id, arg_min(cand, pos) as name from w "
          "where contains(line, '@') and cand is not null group by doc_id")
def win_near_match(spark, sf):
    """Earliest short line among the 5 before the first e-mail line that has one."""
    return X.near_match(doc_lines(spark, sf), "doc_id", F.col("line").contains("@"), F.length("line") < 40)


@register("win_lag_title", sql=f"with {DOC_LINES}, d as (select *, lag(line) over (partition by doc_id order by pos) "
          "as prev from l) select doc_id, arg_min(prev, pos) as name from d where "
          + any_sql("line", ["Ietzte", "Stteen"]) + " and prev is not null and length(prev) < 60 group by doc_id")
def win_lag_title(spark, sf):
    """The line before the first title-keyword line with a short predecessor."""
    return X.line_before(doc_lines(spark, sf), "doc_id", any_contains("line", ["Ietzte", "Stteen"]),
                         lambda p: F.length(p) < 60)


FIRST_RE = r"^[A-Z][a-z]+\.$"


@register("first_line_match", sql=f"with {DOC_LINES} select doc_id, arg_min(line, pos) as line from l "
          f"where regexp_full_match(line, {sql_str(FIRST_RE[1:-1])}) group by doc_id")
def first_line_match(spark, sf):
    """Earliest one-word sentence line of every document."""
    return X.first_line_matching(doc_lines(spark, sf), "doc_id", F.col("line").rlike(FIRST_RE))


CLERK_WORDS = ["the", "und"]


@register("section_text", sql=f"with {DOC_LINES}, m as (select *, case when contains(line, {sql_str(HEADER)}) then 1 "
          f"when {any_sql('line', STOPS)} then 0 end as mk from l), "
          "f as (select *, min(case when mk = 1 then pos end) over (partition by doc_id) as fo from m), "
          "g as (select *, min(case when mk = 0 and pos > fo then pos end) over (partition by doc_id) as fc from f) "
          "select doc_id, string_agg(line, ', ' order by pos) as clerkship from g "
          f"where pos > fo and (fc is null or pos < fc) and mk is null and {any_sql('line', CLERK_WORDS)} group by doc_id")
def section_text(spark, sf):
    """Matching lines of the first section joined by ', ' (clerkship rule)."""
    return X.clerkship(doc_lines(spark, sf), "doc_id", HEADER, STOPS, CLERK_WORDS)


def _reopen_sql(keep: str) -> str:
    return (f"m as (select *, case when contains(line, {sql_str(HEADER)}) then 1 when {any_sql('line', STOPS)} "
            "then 0 end as mk from l), s as (select *, last_value(mk ignore nulls) over (partition by doc_id order by "
            f"pos rows between unbounded preceding and current row) as st from m), "
            f"k as (select doc_id, pos, line from s where st = 1 and mk is null and {keep})")


REGION_DICT = ["The", "Und", "Et", "Que", "Der"]
SKIPS = ["print", "download", "view"]


@register("section_dict_match", sql=f"with {DOC_LINES}, " + _reopen_sql(f"not {any_sql('lower(line)', SKIPS)}")
          + ", t as (select doc_id, string_agg(line, chr(10) order by pos) as t from k group by doc_id) "
          f"select doc_id, list_filter({sql_list(REGION_DICT)}, lambda d: contains(t, d)) as region from t "
          f"where len(list_filter({sql_list(REGION_DICT)}, lambda d: contains(t, d))) > 0")
def section_dict_match(spark, sf):
    """Dictionary values found only inside the (re-openable) capability sections."""
    return X.capability_values(doc_lines(spark, sf), "doc_id", REGION_DICT, HEADER, STOPS, SKIPS)


EDU_MARKS = ["!!", "###"]
EDU_WORDS = ["the", "und"]


@register("section_filter_lines", sql=f"with {DOC_LINES}, "
          + _reopen_sql(f"({any_sql('line', EDU_MARKS)} or ({any_sql('line', EDU_WORDS)} and length(line) < 100))")
          + " select doc_id, list(line order by pos) as school from k group by doc_id")
def section_filter_lines(spark, sf):
    """Education-rule lines inside sections, in order."""
    return X.education_lines(doc_lines(spark, sf), "doc_id", HEADER, STOPS, EDU_MARKS, EDU_WORDS, 100)


LANG_WORDS = ["the", "und", "et", "que", "die", "der", "la"]


def _word_sql(x: str, w: str) -> str:
    return f"regexp_matches({x}, {sql_str(X.word_pattern(w))})"


@register("section_word_match", sql=f"with {DOC_LINES}, " + _reopen_sql("true")
          + ", f as (select doc_id, list_filter([" + ", ".join(
              f"case when {_word_sql('line', w)} then {sql_str(w)} end" for w in LANG_WORDS)
          + "], lambda x: x is not null) as f from k) "
          "select doc_id, list_sort(list_distinct(flatten(list(f)))) as language from f group by doc_id "
          "having len(list_distinct(flatten(list(f)))) > 0")
def section_word_match(spark, sf):
    """Distinct whole words (any case) inside the language sections."""
    return X.languages(doc_lines(spark, sf), "doc_id", LANG_WORDS, HEADER, STOPS)


EXP = dict(header="Ietzte", header_max_len=20, stops=["Licensed", "And ornd."], keep_line="And ornd.",
           nav=["Of.", "Stteen Erachtz."], skips=["print", "download"], min_len=50)


@register("experience_text", sql=f"with {DOC_LINES}, "
          "a as (select *, lead(line) over (partition by doc_id order by pos) as nxt, list(line) over (partition by "
          "doc_id order by pos rows between 5 preceding and 1 preceding) as prv from l), "
          f"b as (select *, (line = {sql_str(EXP['header'])} or (starts_with(line, {sql_str(EXP['header'])}) and "
          f"length(line) < {EXP['header_max_len']})) and not (nxt is not null and ("
          f"coalesce({any_sql('nxt', EXP['nav'])}, false) or coalesce(list_has_any(prv, {sql_list(EXP['nav'])}), false)))"
          " as op from a), "
          "c as (select *, min(case when op then pos end) over (partition by doc_id) as st from b), "
          f"d as (select *, min(case when {any_sql('line', EXP['stops'])} and line <> {sql_str(EXP['keep_line'])} "
          "and not op and pos > st then pos end) over (partition by doc_id) as sp from c), "
          "e as (select doc_id, string_agg(line, ' ' order by pos) as t from d where pos > st and (sp is null or pos < sp)"
          f" and not op and not {any_sql('lower(line)', EXP['skips'])} group by doc_id), "
          f"f as (select doc_id, {strip_sql('regexp_replace(t, ' + sql_str(chr(92) + 's+') + ', chr(32), ' + sql_str('g') + ')')} as x from e) "
          f"select doc_id, x as experience from f where length(x) > {EXP['min_len']}")
def experience_text(spark, sf):
    """Experience section text with navigation-header detection."""
    return X.experience(doc_lines(spark, sf), "doc_id", **EXP)


MAIL = r"mail[0-9]+\.example\.com"


@register("extract_email", sql="select doc_id, lower(regexp_extract(text, "
          + sql_str(r"[a-zA-Z0-9._%+-]+@" + MAIL) + ", 0)) as email from documents where regexp_matches(text, "
          + sql_str(r"[a-zA-Z0-9._%+-]+@" + MAIL) + ")")
def extract_email(spark, sf):
    """First e-mail address of the (stand-in) domain."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.email("text", MAIL).alias("email")).where(F.col("email").isNotNull())


@register("extract_phone", sql="select doc_id, p as phone from (select doc_id, coalesce("
          + ", ".join(f"{strip_sql('nullif(regexp_extract(text, ' + sql_str(p) + ', 0), ' + sql_str('') + ')')}"
                      for p in L.PHONE_PATTERNS)
          + ") as p from documents) where p is not null")
def extract_phone(spark, sf):
    """Phone by the four patterns in priority order."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.phone("text").alias("phone")).where(F.col("phone").isNotNull())


OFFICE_DICT = ["Licensed", "Ietzte", "Stteen", "Nicht"]


@register("extract_office", sql="select doc_id, arg_min(o, p) as office, list(o order by i) as offices from "
          "(select doc_id, unnest(" + sql_list(OFFICE_DICT) + ") as o, generate_subscripts("
          + sql_list(OFFICE_DICT) + ", 1) as i, instr(text, unnest(" + sql_list(OFFICE_DICT) + ")) as p from documents) "
          "where p > 0 group by doc_id")
def extract_office(spark, sf):
    """Office named first in the text, plus every office named."""
    d = table(spark, sf, "documents")
    hits = X.dictionary_values("text", OFFICE_DICT)
    return (d.select("doc_id", X.office("text", OFFICE_DICT).alias("office"), hits.alias("offices"))
            .where(F.col("office").isNotNull()))


PRACTICE_DICT = ["The", "Licensed under", "Nicht", "Que", "token", "password"]


@register("dict_match", sql=f"select doc_id, list_filter({sql_list(PRACTICE_DICT)}, lambda d: contains(text, d)) as practice "
          f"from documents where len(list_filter({sql_list(PRACTICE_DICT)}, lambda d: contains(text, d))) > 0")
def dict_match(spark, sf):
    """Dictionary values occurring as substrings (theta join with a small dictionary)."""
    d = table(spark, sf, "documents")
    return (d.select("doc_id", X.dictionary_values("text", PRACTICE_DICT).alias("practice"))
            .where(F.col("practice").isNotNull()))


ENTRIES_SQL = ("entries as (select c_name as entry from customer union select p_name || ' ' || p_partkey from part union select p_name from part union "
               "select array_to_string(list_slice(ws, i, i + 2), ' ') from (select ws, unnest(range(1, len(ws) - 1)) as i from "
               "(select string_split_regex(text, '\\s+') as ws from benchmark)))")


def dictionary_entries(spark, sf):
    """A dictionary of names (customers, numbered parts, parts) and of three-word terms from the benchmark texts."""
    part = table(spark, sf, "part")
    words = table(spark, sf, "benchmark").select(F.split("text", r"\s+", -1).alias("ws"))
    terms = words.select("ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 2)).alias("i")).select(F.array_join(F.slice("ws", F.col("i"), 3), " ").alias("entry"))
    return (table(spark, sf, "customer").select(F.col("c_name").alias("entry"))
            .unionAll(part.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))).unionAll(part.select("p_name")).unionAll(terms))


@register("dict_match_large", sql=f"with {ENTRIES_SQL} select doc_id, entry from documents join entries on contains(text, entry) where entry <> ''")
def dict_match_large(spark, sf):
    """A dictionary table of many thousand entries against whole texts, through each entry's rarest gram."""
    hits = dictionary_hits(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), dictionary_entries(spark, sf))
    return hits.withColumnRenamed("id", "doc_id")


@register("extract_title", sql=f"with {DOC_LINES} select doc_id, arg_min({first_in_order_sql('line', ['Stteen Erachtz', 'Erachtz', 'Ietzte', 'And ornd', 'ornd'])}, pos) as title "
          f"from l where {any_sql('line', ['Stteen Erachtz', 'Erachtz', 'Ietzte', 'And ornd', 'ornd'])} group by doc_id")
def extract_title(spark, sf):
    """First keyword line, then its most specific keyword."""
    return X.title_of(doc_lines(spark, sf), "doc_id", ["Stteen Erachtz", "Erachtz", "Ietzte", "And ornd", "ornd"])


@register("distinct_terms", sql="select doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), "
          + sql_str(r"\p{L}{12,}") + "))) as terms from documents")
def distinct_terms(spark, sf):
    """Sorted distinct long words of every document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{12,}"), 0)))
                    .alias("terms"))


@register("preview_text", sql="select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end "
          "as preview from documents")
def preview_text(spark, sf):
    """Scalar: 200-character preview with an ellipsis."""
    return table(spark, sf, "documents").select("doc_id", truncate_preview("text", L.PREVIEW_CHARS).alias("preview"))


@register("facets_long", sql="select doc_id, facet, value from ("
          f"select doc_id, 'practice' as facet, unnest(list_filter({sql_list(PRACTICE_DICT)}, lambda d: contains(text, d))) as value from documents "
          f"union all select doc_id, 'office', unnest(list_filter({sql_list(OFFICE_DICT)}, lambda d: contains(text, d))) from documents "
          "union all select doc_id, 'language', lang from documents)")
def facets_long(spark, sf):
    """Parsed list fields exploded into one long facet table."""
    d = table(spark, sf, "documents")
    arr = F.array(
        F.struct(F.lit("practice").alias("facet"), X.dictionary_values("text", PRACTICE_DICT).alias("values")),
        F.struct(F.lit("office").alias("facet"), X.dictionary_values("text", OFFICE_DICT).alias("values")),
        F.struct(F.lit("language").alias("facet"), F.array("lang").alias("values")))
    e = d.select("doc_id", F.explode(arr).alias("f"))
    return e.select("doc_id", F.col("f.facet").alias("facet"), F.explode("f.values").alias("value"))


@register("scalar_suite", sql="select c_custkey as id, lower(c_name) as name_lower, upper(c_mktsegment) as seg_upper, "
          "split_part(c_name, '#', 1) as first_name, split_part(c_name, '#', 2) as last_name, length(c_name) as name_len, "
          "replace(c_name, '#', ' ') as spaced, regexp_replace(c_mktsegment, '[AEIOU]', '*', 'g') as masked, "
          "coalesce(try_cast(regexp_extract(c_name, '[0-9]+', 0) as integer), -1) as num, "
          "c_name || '/' || c_mktsegment as joined, substr(c_name, 1, 8) as head from customer")
def scalar_suite(spark, sf):
    """Scalar functions: lower, upper, split, length, replace, regexp_replace, try_cast, concat, substring."""
    c = table(spark, sf, "customer")
    parts = F.split("c_name", "#", 2)
    return c.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name_lower"),
                    F.upper("c_mktsegment").alias("seg_upper"),
                    F.try_element_at(parts, F.lit(1)).alias("first_name"),
                    F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("last_name"),
                    F.length("c_name").cast("long").alias("name_len"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("spaced"),
                    F.regexp_replace("c_mktsegment", "[AEIOU]", "*").alias("masked"),
                    F.coalesce(F.expr("try_cast(regexp_extract(c_name, '[0-9]+', 0) as int)"), F.lit(-1)).alias("num"),
                    F.concat_ws("/", "c_name", "c_mktsegment").alias("joined"),
                    F.substring("c_name", 1, 8).alias("head"))


# ------------------------------------------------------- education tokens
EDU_LINE_SQL = ("case p_type when 'ECONOMY' then 'J.D., Yale ' || p_name || ' Law School, magna cum laude' "
                "when 'SMALL' then 'B.A., Economics, Tel Aviv ' || p_name || ' University' "
                "when 'MEDIUM' then 'LL.M., Tax, New York ' || p_name || ' University School of Law' "
                "when 'LARGE' then 'Ph.D., ' || p_name || ' studies' "
                "when 'PROMO' then 'MBA, Harvard ' || p_name || ' College, With Honors' "
                "else p_name || ', Tax' end")


def edu_line(p):
    t, n = p["p_type"], p["p_name"]
    return (F.when(t == "ECONOMY", F.concat(F.lit("J.D., Yale "), n, F.lit(" Law School, magna cum laude")))
            .when(t == "SMALL", F.concat(F.lit("B.A., Economics, Tel Aviv "), n, F.lit(" University")))
            .when(t == "MEDIUM", F.concat(F.lit("LL.M., Tax, New York "), n, F.lit(" University School of Law")))
            .when(t == "LARGE", F.concat(F.lit("Ph.D., "), n, F.lit(" studies")))
            .when(t == "PROMO", F.concat(F.lit("MBA, Harvard "), n, F.lit(" College, With Honors")))
            .otherwise(F.concat(n, F.lit(", Tax"))))


def _deg_sql() -> str:
    raw = first_in_order_sql("line", X.ALL_DEGREES)
    law = sql_list(L.LAW_DEGREES)
    pats = ", ".join(f"nullif(regexp_extract(cleaned, {sql_str(p)}, 1), '')" for p in L.SCHOOL_PATTERNS)
    hon = ", ".join(f"nullif(regexp_extract(line, {sql_str('(?i)' + h)}, 0), '')" for h in L.HONORS)
    skip = sql_list(L.SCHOOL_FALLBACK_SKIP)
    return ("d1 as (select *, " + raw + " as raw from e), "
            "d2 as (select *, regexp_replace(raw, '^\\.+|\\.+$', '', 'g') as degree_type, "
            f"coalesce(list_contains({law}, raw), false)::int as is_law_degree from d1), "
            "d3 as (select *, regexp_replace(regexp_replace(case when degree_type is null then line else "
            "replace(replace(line, degree_type || '.', ''), degree_type, '') end, '^[,\\s]+', ''), '[,\\s]+$', '') "
            "as cleaned from d2), "
            f"d4 as (select *, coalesce({pats}) as sp, coalesce({hon}) as honors from d3), "
            f"d5 as (select *, coalesce(nullif({strip_sql('regexp_replace(' + strip_sql('sp') + ', ' + sql_str('[,' + chr(92) + 's]+') + ', chr(32), ' + sql_str('g') + ')')}, ''), "
            f"list_filter(list_transform(string_split(cleaned, ','), lambda p: {strip_sql('p')}), "
            f"lambda p: length(p) > {L.SCHOOL_FALLBACK_MIN_LEN} and not list_contains({skip}, lower(p)))[1]) "
            "as school_name from d4)")


@register("education_tokens", sql=f"with e as (select p_partkey as id, {EDU_LINE_SQL} as line from part), "
          + _deg_sql() + " select id, degree_type, school_name, honors, is_law_degree from d5")
def education_tokens(spark, sf):
    """Degree, school, honours and law flag of composed education lines."""
    p = table(spark, sf, "part")
    e = p.select(F.col("p_partkey").alias("id"), edu_line(p).alias("line"))
    return e.select("id", X.degree_fields("line").alias("t")).select("id", "t.*")


@register("education_rows", sql=f"with {S.PART_ALIAS_KEYS_SQL}, e as (select p_partkey as profile_id, {EDU_LINE_SQL} as line "
          "from part), " + _deg_sql()
          + " select profile_id, line as full_text, degree_type, school_name, "
          "case when school_name is null then null else " + S.resolve_sql("school_name") + " end as school_normalized, "
          "honors, is_law_degree from d5")
def education_rows(spark, sf):
    """Education rows with the school name resolved through the alias table."""
    p = table(spark, sf, "part")
    schools = p.select(F.col("p_partkey").alias("id"), F.array(edu_line(p)).alias("school"))
    r = X.education_rows(schools, "id", "school", S.part_aliases(spark, sf))
    return r.select("profile_id", "full_text", "degree_type", "school_name", "school_normalized", "honors",
                    "is_law_degree")


REPAIR_BLACK = ["customer#0000001"]


@register("repair_names", sql="with p as (select c_custkey as id, c_name as name, lower(c_name) || '@x.com' as email, "
          "'https://x/lawyers/' || lower(c_mktsegment) || '-' || c_custkey as url from customer), "
          "q as (select *, split_part(split_part(url, '/lawyers/', -1), '?', 1) as slug from p), "
          "r as (select *, upper(left(slug, 1)) || lower(substr(replace(slug, '-', ' '), 2)) as sn from q) "
          "select id, name, case when contains(lower(name), 'customer#0000001') then coalesce("
          "case when len(string_split_regex(trim(sn), '\\s+')) >= 2 and length(sn) < 50 then sn end, name) "
          "else name end as repaired, contains(lower(name), 'customer#0000001') as bad from r")
def repair_names(spark, sf):
    """Blacklisted names repaired from the e-mail, else the URL slug, else kept."""
    c = table(spark, sf, "customer")
    p = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                 F.concat(F.lower("c_name"), F.lit("@x.com")).alias("email"),
                 F.concat(F.lit("https://x/lawyers/"), F.lower("c_mktsegment"), F.lit("-"),
                          F.col("c_custkey").cast("string")).alias("url"))
    bad = any_contains(F.lower(strip("name")), REPAIR_BLACK)
    return p.select("id", "name", X.repair_name("name", "email", "url", REPAIR_BLACK).alias("repaired"),
                    bad.alias("bad"))
