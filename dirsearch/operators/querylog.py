"""Jobs over a table of query strings: routing tags, clause splitting, and
criteria extraction into a long ``(query_id, clause, field, op, value)`` table
that :func:`batch_search` answers for every query at once.

Extraction follows the original rule order within each clause, including the
removal of what a rule matched before the next rule looks (year, name,
school, region, practice, title, language, then the name fallback).  Region
runs before practice so that "in asia" is a region, and clauses are split on
"and" first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import col_of, py_regex, strip
from dirsearch.operators.criteria import name_tokens
from dirsearch.session import written


# ---------------------------------------------------------------- routing
def route_tag(query: Column | str, simple: Sequence[str] = L.SIMPLE_PATTERNS,
              complex_: Sequence[str] = L.COMPLEX_PATTERNS, unicode: bool = True) -> Column:
    """Q1: 'simple' when a simple pattern matches and no complex one does;
    'complex' when a complex one matches; else 'unknown'."""
    q = strip(F.lower(col_of(query)))
    conv = py_regex if unicode else (lambda p: p)
    any_simple = _any_rlike(q, [conv(p) for p in simple])
    any_complex = _any_rlike(q, [conv(p) for p in complex_])
    return F.when(any_simple & ~any_complex, F.lit("simple")).when(any_complex, F.lit("complex")) \
        .otherwise(F.lit("unknown"))


def _any_rlike(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def route_final(tag: Column | str, fallback: Column | None = None, default: str = "complex") -> Column:
    """Q2: unknown tags take the fallback (a judge's answer), else the default."""
    t = col_of(tag)
    fb = F.when(fallback.isin("simple", "complex"), fallback) if fallback is not None else F.lit(None)
    return F.when(t != "unknown", t).otherwise(F.coalesce(fb, F.lit(default)))


def route_mix(tags: DataFrame, tag_col: str = "route") -> DataFrame:
    """Q3: share of each routing tag; the total is a scalar subquery."""
    counts = tags.groupBy(tag_col).agg(F.count("*").alias("n"))
    total = tags.agg(F.count("*").alias("total")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


# ------------------------------------------------------------ clause split
def split_clauses(queries: DataFrame, id_col: str = "query_id", text_col: str = "query",
                  sep: str = L.CLAUSE_SPLIT) -> DataFrame:
    """Q4: ``(query_id, clause_no, clause)`` from the lower-cased, stripped query."""
    q = strip(F.lower(F.col(text_col)))
    return (queries.select(F.col(id_col).alias("query_id"), F.posexplode(F.split(q, py_regex(sep), -1))
                           .alias("clause_no", "clause"))
            .withColumn("clause", strip("clause")))


# ----------------------------------------------------- criteria extraction
@dataclass(frozen=True)
class Rule:
    field: str
    patterns: tuple[tuple[str, str], ...]  # (pattern, op)
    value: str = "group"  # how the value is formed: group | year | title | school | latin | fixed:<v>


def default_rules() -> list[Rule]:
    return [
        Rule("law_school_year", tuple(L.YEAR_PATTERNS), "group"),
        Rule("name", tuple((p, "contains") for p in L.NAME_PATTERNS), "group"),
        Rule("school", tuple((p, "contains") for p in L.SCHOOL_QUERY_PATTERNS), "school"),
        Rule("region", tuple((p, "eq") for p in L.REGION_QUERY_PATTERNS), "region"),
        Rule("practice", tuple((p, "eq") for p in L.PRACTICE_QUERY_PATTERNS), "practice"),
        Rule("title", tuple((p, "eq") for p, _ in L.TITLE_QUERY_PATTERNS), "title_map"),
        Rule("title_is", ((L.TITLE_IS_PATTERN, "eq"),), "title"),
        Rule("language", tuple((p, "contains") for p in L.LANGUAGE_QUERY_PATTERNS), "group"),
    ]


TITLE_MAP = dict(L.TITLE_QUERY_PATTERNS)


def extract_criteria(clauses: DataFrame, rules: Sequence[Rule] | None = None, unicode: bool = True,
                     articles: str = L.SCHOOL_ARTICLES, stop_words: Sequence[str] = L.QUERY_STOP_WORDS,
                     min_word_len: int = L.FALLBACK_MIN_WORD_LEN) -> DataFrame:
    """Q5-Q12: long criteria rows ``(query_id, clause_no, field, op, value)``.

    Practice values come out raw (``value``) and are normalised by
    :func:`normalise_practice`, which needs the alias map (a join).
    """
    rules = default_rules() if rules is None else rules
    conv = py_regex if unicode else (lambda p: p)
    # One projected column per step: the working text of rule i is a column,
    # so no rule's expression embeds the whole chain before it.
    df = clauses.withColumn("_t", F.col("clause"))
    found: list[str] = []
    for i, r in enumerate(rules):
        pats = [(conv(p), op) for p, op in r.patterns]
        text = F.col("_t")
        which = None
        for idx in range(len(pats) - 1, -1, -1):
            hit = text.rlike(pats[idx][0])
            which = F.when(hit, F.lit(idx)) if which is None else F.when(hit, F.lit(idx)).otherwise(which)
        df = df.withColumn(f"_w{i}", which)
        w = F.col(f"_w{i}")
        op = F.element_at(F.array(*[F.lit(o) for _, o in pats]), w + 1)
        val = strip(_pick(text, w, [p for p, _ in pats], group=0 if r.value == "title_map" else 1))
        if r.value == "school":
            val = strip(F.regexp_replace(val, conv(articles), ""))
        elif r.value == "region":
            val = F.when(val.contains("latin america"), F.lit("Latin America")).otherwise(F.initcap(val))
        elif r.value == "title_map":
            val = F.element_at(F.array(*[F.lit(TITLE_MAP[p]) for p, _ in r.patterns]), w + 1)
        elif r.value == "title":
            val = F.initcap(val)
        matched = w.isNotNull()
        if r.field == "title_is" and found:
            have_title = F.exists(F.array(*[F.col(c) for c in found]),
                                  lambda s: F.coalesce(s["field"] == "title", F.lit(False)))
            matched = matched & ~have_title
        emit = F.coalesce(matched & ((val != "") if r.value == "school" else F.lit(True)), F.lit(False))
        field = "title" if r.field == "title_is" else r.field
        df = df.withColumn(f"_c{i}", F.when(emit, F.struct(F.lit(field).alias("field"), op.alias("op"),
                                                           val.alias("value"))))
        df = df.withColumn("_t", F.when(F.col(f"_c{i}").isNotNull(),
                                        strip(_remove(text, w, [p for p, _ in pats]))).otherwise(text))
        found.append(f"_c{i}")
    crit = F.filter(F.array(*[F.col(c) for c in found]), lambda s: s.isNotNull())
    crit = F.transform(crit, lambda s: F.struct(s["field"].alias("field"), s["op"].alias("op"),
                                                s["value"].alias("value"), F.lit(False).alias("by_fallback")))
    words = F.filter(F.split(F.col("_t"), py_regex(r"\s+"), -1),
                     lambda w: (~F.lower(w).isin(list(stop_words))) & (F.length(w) >= min_word_len))
    fallback = F.when(F.size(words) > 0, F.array(F.struct(F.lit("name").alias("field"), F.lit("contains").alias("op"),
                                                          F.array_join(words, " ").alias("value"),
                                                          F.lit(True).alias("by_fallback"))))
    empty = F.array().cast("array<struct<field:string,op:string,value:string,by_fallback:boolean>>")
    allc = F.when(F.size(crit) > 0, crit).otherwise(F.coalesce(fallback, empty))
    return (df.select("query_id", "clause_no", F.explode(allc).alias("c"))
            .select("query_id", "clause_no", "c.field", "c.op", "c.value", "c.by_fallback"))


def _pick(text: Column, which: Column, patterns: Sequence[str], group: int) -> Column:
    out = F.lit(None).cast("string")
    for i, p in enumerate(patterns):
        out = F.when(which == i, F.regexp_extract(text, p, group)).otherwise(out)
    return out


def _remove(text: Column, which: Column, patterns: Sequence[str]) -> Column:
    out = text
    for i, p in enumerate(patterns):
        out = F.when(which == i, F.regexp_replace(text, p, "")).otherwise(out)
    return out


def normalise_practice(criteria: DataFrame, practice_map: DataFrame) -> DataFrame:
    """Practice values: alias map (lower-cased keys, last wins) else title case."""
    m = practice_map.select(F.col("alias").alias("_k"), F.col("normalized").alias("_n"))
    is_p = F.col("field") == "practice"
    j = criteria.join(m, is_p & (F.lower("value") == F.col("_k")), "left")
    return j.withColumn("value", F.when(is_p, F.coalesce("_n", F.initcap("value"))).otherwise(F.col("value"))) \
        .drop("_k", "_n")


# ---------------------------------------------------------- query normalise
def normalise_queries(queries: DataFrame, aliases: DataFrame, max_words: int | None = None, id_col: str = "query_id",
                      text_col: str = "query") -> DataFrame:
    """Q13: ``(query_id, normalized)``: whole words and phrases that are aliases become their canonical names.

    ``aliases`` are alias rows (see :mod:`dirsearch.operators.aliases`), matched without case, the earliest row first.
    Every run of words, up to as many as the table's longest alias has (or ``max_words``), meets the alias table in an
    equi-join.  From left to right the longest alias that starts at a word replaces it, and what it covers is not looked
    at again.
    """
    from dirsearch.operators.aliases import lookup_keys

    words = F.filter(F.split(strip(F.lower(F.col(text_col))), r"\s+", -1), lambda w: w != "")
    q = queries.select(F.col(id_col).alias("query_id"), words.alias("words"))
    spaced = lookup_keys(aliases).where(F.col("key").isNotNull()).withColumn("key", F.array_join(F.filter(F.split(F.lower("key"), r"\s+", -1), lambda w: w != ""), " "))
    most = F.lit(max_words) if max_words else F.coalesce(spaced.agg(F.max(F.size(F.split("key", " ")))).scalar(), F.lit(1))
    starts = q.select("query_id", "words", F.posexplode("words").alias("at", "word"))
    runs = starts.select("query_id", "at", F.explode(F.sequence(F.lit(1), F.least(most, F.size("words") - F.col("at")))).alias("n"),
                         "words").select("query_id", "at", "n", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("key"))
    keys = (spaced.where("key <> ''").groupBy("key")
            .agg(F.min_by("normalized", F.struct("ord", "pos")).alias("normalized")))
    longest = (runs.join(keys, "key").groupBy("query_id", "at").agg(F.max(F.struct("n", "normalized")).alias("m"))
               .groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "m"))).alias("found")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))

    def step(state: Column, x: Column) -> Column:
        m = F.try_element_at(F.col("found"), x["at"])
        taken = F.struct(F.concat(state["out"], F.array(m["normalized"])).alias("out"), (x["at"] + m["n"]).alias("next"))
        plain = F.struct(F.concat(state["out"], F.array(x["word"])).alias("out"), state["next"].alias("next"))
        return F.when(x["at"] < state["next"], state).when(m.isNotNull(), taken).otherwise(plain)

    numbered = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    return (q.join(longest, "query_id", "left")
            .select("query_id", F.array_join(F.aggregate(numbered, start, step)["out"], " ").alias("normalized")))


# ------------------------------------------------------------ batch search
def name_matches(word_sets: DataFrame, name_sets: DataFrame) -> DataFrame:
    """Pairs ``(qtoks, ntoks)`` where every token of the word set is a token of the name set.

    Both sides are distinct sorted token arrays.  Each word set is joined only
    through its rarest token (the shortest posting list, found with a grouped
    count), and the other words are checked row-locally with
    ``array_contains``; a hot token shared by a third of all names does not
    drive a join unless it is the rarest word of the query.
    """
    postings = name_sets.select("ntoks", F.explode("ntoks").alias("token"))
    freq = postings.groupBy("token").agg(F.count("*").alias("df"))
    rated = word_sets.select("qtoks", F.explode("qtoks").alias("token")).join(freq, "token", "left")
    # a word with no posting makes the set unmatchable: drop such sets
    rare = (rated.groupBy("qtoks")
            .agg(F.min_by("token", F.struct(F.coalesce(F.col("df"), F.lit(0)).alias("df"), "token")).alias("token"),
                 F.count_if(F.col("df").isNull()).alias("missing"))
            .where(F.col("missing") == 0).drop("missing"))
    cand = rare.join(postings, "token")
    return cand.where(F.forall("qtoks", lambda t: F.array_contains(F.col("ntoks"), t))).select("qtoks", "ntoks")


def substring_matches(needles: DataFrame, values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, needle, value)`` where a distinct value contains a distinct needle, without case.

    ``by`` are columns of both sides that must agree.  A needle of three
    characters or more meets the values through its rarest trigram, a shorter
    one through itself as a gram; then the whole needle is checked.  Empty
    needles match nothing.
    """
    grams = lambda c, n: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, n)))
    on = [*by, "n", "gram"]
    v = values.where(F.col("value").isNotNull()).select(*by, "value", F.lower("value").alias("low"))
    q = needles.where(F.length("needle") > 0).select(*by, "needle", F.lower("needle").alias("find"))
    q = q.withColumn("n", F.least(F.length("find"), F.lit(3)))
    asked = q.select(*by, "needle", "find", "n", F.explode(grams(F.col("find"), F.col("n"))).alias("gram"))
    v = v.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("length(low) >= n")
    postings = v.select(*by, "value", "low", "n", F.explode(grams(F.col("low"), F.col("n"))).alias("gram"))
    freq = postings.groupBy(*on).agg(F.count("*").alias("df"))
    # a gram that no value holds makes the needle unmatchable
    rare = (asked.join(freq, on, "left").groupBy(*by, "needle", "find", "n")
            .agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count_if(F.col("df").isNull()).alias("missing"))
            .where("missing = 0").drop("missing"))
    return rare.join(postings, on).where(F.col("low").contains(F.col("find"))).select(*by, "needle", "value")


PROFILE_TEXT = {"title": "title", "office": "office_location", "clerkship": "clerkship"}
FACETS = ["practice", "industry", "region", "language"]
YEARS = ("law_school_year", "undergrad_year")
YEAR_OPS = ["gt", "lt", "gte", "lte", "eq"]


def _supported(field: Column, op: Column) -> Column:
    return ((field.isin("name", "school", *PROFILE_TEXT, *FACETS) & op.isin("eq", "contains"))
            | (field.isin(*YEARS) & op.isin(*YEAR_OPS)))


KEY = ["field", "op", "value"]
CHECKS, SLICES = 4_000_000, 64  # pairs of hit and set that one slice of a lead checks; slices at most
QUERY_BLOCK, HIT_BLOCK, RUN = 4096, 4096, 256  # queries and hits of a set that move as one array; hits that a query's run of result rows has


def _checked(criteria: DataFrame, facets: DataFrame | None, educations: DataFrame | None) -> DataFrame:
    """The distinct criteria of each query; one that cannot be answered is an error when the plan runs."""
    known = _supported(F.col("field"), F.col("op"))
    if facets is None:
        known = known & ~F.col("field").isin(FACETS)
    if educations is None:
        known = known & ~F.col("field").isin("school", *YEARS)
    refuse = F.raise_error(F.concat(F.lit("criterion not supported: "), F.coalesce("field", F.lit("null")), F.lit(" "),
                                    F.coalesce("op", F.lit("null")))).cast("boolean")
    return criteria.where(F.when(F.coalesce(known, F.lit(False)), F.lit(True)).otherwise(refuse)).select("query_id", *KEY)


def _spaced(c: str) -> Column:
    return F.concat(F.lit(" "), F.array_join(name_tokens(F.col(c)), " "), F.lit(" "))


def _directory_values(profiles: DataFrame, facets: DataFrame | None, educations: DataFrame | None) -> DataFrame:
    """``(id, part, text)``: every value that a criterion can meet, one row for each profile that has it."""
    texts = {f: F.col(c).cast("string") for f, c in PROFILE_TEXT.items() if c in profiles.columns}
    own = F.array(*[F.struct(F.lit(f).alias("part"), c.alias("text")) for f, c in {"name": _spaced("name"), **texts}.items()])
    rows = profiles.select("id", F.inline(own))
    if facets is not None:
        rows = rows.unionAll(facets.where(F.col("facet").isin(FACETS)).select("profile_id", "facet", "value"))
    if educations is not None:
        year = F.when(F.col("is_law_degree").cast("int") == 1, "law_school_year").when(F.col("is_law_degree").cast("int") == 0, "undergrad_year")
        held = F.array(*[F.struct(p.alias("part"), c.alias("text")) for p, c in (
            (F.lit("school_name"), F.col("school_name")), (F.lit("school_normalized"), F.col("school_normalized")), (year, F.col("year").cast("string")))])
        rows = rows.unionAll(educations.select("profile_id", F.inline(held)))
    return rows.where("part is not null and text is not null").distinct()


def _met_values(asked: DataFrame, values: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``(field, op, value, part, text, n)``: the distinct values that each distinct criterion meets; n profiles have the value."""
    toks = lambda c: F.array_sort(F.array_distinct(c))
    schools = asked.where("field = 'school'")
    if aliases is not None:
        from dirsearch.operators.aliases import resolve

        schools = resolve(schools, "value", aliases, "canonical")
    else:
        schools = schools.withColumn("canonical", F.col("value"))
    looked = F.array(F.struct(F.lit("school_name").alias("part"), F.col("value").alias("find")),
                     F.struct(F.lit("school_normalized").alias("part"), F.col("canonical").alias("find")))
    texts = (asked.where(F.col("field").isin(*PROFILE_TEXT, *FACETS)).select(*KEY, F.col("field").alias("part"), F.col("value").alias("find"))
             .unionAll(schools.select(*KEY, F.inline(looked))))
    fold = lambda c: F.when(F.col("part") == "language", F.lower(c)).otherwise(F.col(c))
    same = (texts.where("op = 'eq'").withColumn("_k", fold("find"))
            .join(values.where(~F.col("part").isin("name", *YEARS)).withColumn("_k", fold("text")), ["part", "_k"]))
    inside = texts.where("op = 'contains'")
    stored = values.where(~F.col("part").isin("name", *YEARS))
    pairs = substring_matches(inside.select("part", F.col("find").alias("needle")).distinct(), stored.select("part", F.col("text").alias("value")), ["part"])
    within = (inside.join(pairs.select("part", F.col("needle").alias("find"), F.col("value").alias("text")), ["part", "find"])
              .join(stored, ["part", "text"]))
    # names: distinct word sets against distinct token sets
    names = asked.where("field = 'name'").withColumn("qtoks", toks(name_tokens(F.col("value")))).where(F.size("qtoks") > 0)
    held = values.where("part = 'name'").withColumn("ntoks", toks(F.filter(F.split("text", " "), lambda t: t != "")))
    sets = name_matches(names.select("qtoks").distinct(), held.select("ntoks").distinct())
    named = (names.join(sets, "qtoks").join(held, "ntoks")
             .where((F.col("op") == "contains") | F.col("text").contains(_spaced("value"))))
    # distinct years are a calendar's worth
    meets = F.expr("case op when 'gt' then text > y when 'lt' then text < y when 'gte' then text >= y when 'lte' then text <= y else text = y end"
                   .replace("text", "cast(text as int)"))
    years = (asked.where(F.col("field").isin(list(YEARS))).withColumn("y", F.expr("try_cast(value as int)"))
             .join(values.where(F.col("part").isin(list(YEARS))), F.col("field") == F.col("part")).where(meets))
    columns = [*KEY, "part", "text", "n"]
    return same.select(*columns).unionAll(within.select(*columns)).unionAll(named.select(*columns)).unionAll(years.select(*columns))


def _meets_all(profile_columns: Sequence[str]) -> Column:
    """Whether the profile of a candidate row meets every criterion of ``criteria``."""
    texts = [f for f in PROFILE_TEXT if f in profile_columns]

    def text_meets(c: Column, text: Column, find: Column, low: Column, fold: bool = False) -> Column:
        eq = (F.lower(text) == low) if fold else (text == find)
        return F.when(c["op"] == "eq", eq).otherwise((F.length(find) > 0) & F.contains(F.lower(text), low))

    def one(c: Column) -> Column:
        met = F.when(c["field"] == "name", (F.size(c["qtoks"]) > 0) & (F.size(F.array_except(c["qtoks"], F.col("ntoks"))) == 0)
                     & ((c["op"] == "contains") | F.contains(F.col("spaced"), c["spaced"])))
        for f in texts:
            met = met.when(c["field"] == f, text_meets(c, F.col(f"own_{f}"), c["value"], c["low"]))
        met = met.when(c["field"] == "school", F.exists("schools", lambda s: text_meets(c, s["school_name"], c["value"], c["low"])
                                                        | text_meets(c, s["school_normalized"], c["canonical"], c["canonical_low"])))
        compare = lambda y: (F.when(c["op"] == "gt", y > c["year"]).when(c["op"] == "lt", y < c["year"]).when(c["op"] == "gte", y >= c["year"])
                             .when(c["op"] == "lte", y <= c["year"]).otherwise(y == c["year"]))
        law = F.when(c["field"] == "law_school_year", 1).otherwise(0)
        met = met.when(c["field"].isin(list(YEARS)), F.exists("schools", lambda s: (s["law"] == law) & compare(s["year"])))
        return F.coalesce(met.otherwise(F.exists("facets", lambda f: (f["facet"] == c["field"]) & F.when(
            c["field"] == "language", text_meets(c, f["value"], c["value"], c["low"], fold=True)).otherwise(text_meets(c, f["value"], c["value"], c["low"])))),
            F.lit(False))

    return F.forall("criteria", one)


@dataclass(frozen=True)
class BatchSearch:
    """The tables of one batch search: queries with their criteria sets, the candidates of each set, the sets' results."""

    queries: DataFrame  # (query_id, set)
    candidates: DataFrame  # (set, id): hits of the set's rarest criterion
    led: DataFrame  # (lead, id, slice): those of sets of several criteria, once for all sets that one criterion leads
    found: DataFrame  # (set, id, hits): those that meet every criterion
    sets: DataFrame  # (set, asked, hits): queries of a set, hits of its rarest criterion


def batch_candidates(criteria: DataFrame, profiles: DataFrame, facets: DataFrame | None = None,
                     educations: DataFrame | None = None, aliases: DataFrame | None = None) -> BatchSearch:
    """Conjunctive search led by each criteria set's rarest criterion; see :func:`batch_search`."""
    given = F.array_sort(F.collect_set(F.struct(*KEY)))
    per_query = written(_checked(criteria, facets, educations).groupBy("query_id").agg(given.alias("criteria")), "batch-criteria")
    sets = per_query.groupBy("criteria").agg(F.min("query_id").alias("set"), F.count("*").alias("asked"))  # a set is named by its least query
    rows = _directory_values(profiles, facets, educations)
    each = sets.select("set", "asked", F.size("criteria").alias("size"), F.inline("criteria"))
    values = rows.groupBy("part", "text").agg(F.count("*").alias("n"))
    met = written(_met_values(each.select(*KEY).distinct(), values, aliases), "batch-values")
    hits = met.groupBy(*KEY).agg(F.sum("n").alias("hits"))
    # a set with a criterion that nothing meets has no result
    lead = (each.join(hits, KEY).groupBy("set", "asked", "size").agg(F.count("*").alias("met"), F.min(F.struct("hits", *KEY)).alias("lead"))
            .where("met = size").select("set", "asked", "size", *[F.col(f"lead.{c}").alias(c) for c in ("hits", *KEY)]))
    ids = met.join(lead.select(*KEY).distinct(), KEY, "left_semi").join(rows, ["part", "text"]).select(*KEY, "id").distinct()
    candidates = lead.join(ids, KEY).select("set", "size", "id", "hits")
    # sets with one rarest criterion meet its hits together; a lead is named by its least set, and its hits are dealt to
    # slices where there is much to check
    several = lead.where("size > 1")
    leads = several.groupBy(*KEY).agg(F.min("set").alias("lead"), F.expr(f"least(count(*) * max(hits) div {CHECKS}, {SLICES} - 1) + 1").alias("slices"))
    led = ids.join(leads, KEY).select("lead", "id", F.expr("pmod(xxhash64(id), slices)").alias("slice"))

    # what the criteria need, worked out once a set
    detail = F.transform("criteria", lambda c: F.struct(
        c["field"].alias("field"), c["op"].alias("op"), c["value"].alias("value"), F.lower(c["value"]).alias("low"),
        F.array_distinct(name_tokens(c["value"])).alias("qtoks"), F.concat(F.lit(" "), F.array_join(name_tokens(c["value"]), " "), F.lit(" ")).alias("spaced"),
        c["value"].try_cast("int").alias("year"),
        F.coalesce(F.try_element_at("canon", c["value"]), c["value"]).alias("canonical"),
        F.lower(F.coalesce(F.try_element_at("canon", c["value"]), c["value"])).alias("canonical_low")))
    asked_schools = each.where("field = 'school' and value is not null").select("set", "value")
    if aliases is not None:
        from dirsearch.operators.aliases import resolve

        canon = resolve(asked_schools.select("value").distinct(), "value", aliases, "canonical")
        canon = asked_schools.join(canon, "value").groupBy("set").agg(F.map_from_entries(F.collect_set(F.struct("value", "canonical"))).alias("canon"))
        with_canon = sets.join(canon, "set", "left")
    else:
        with_canon = sets.withColumn("canon", F.lit(None).cast("map<string,string>"))
    detailed = with_canon.select("set", detail.alias("criteria"))
    wanted = led.select("id").distinct()
    texts = {f: c for f, c in PROFILE_TEXT.items() if c in profiles.columns}
    people = profiles.join(wanted, "id", "left_semi").select("id", _spaced("name").alias("spaced"), name_tokens(F.col("name")).alias("ntoks"), *[
        F.col(c).cast("string").alias(f"own_{f}") for f, c in texts.items()])
    none = F.array()
    if facets is not None:
        held = (facets.where(F.col("facet").isin(FACETS)).join(wanted, F.col("profile_id") == F.col("id"), "left_semi").groupBy(F.col("profile_id").alias("id"))
                .agg(F.collect_set(F.struct("facet", "value")).alias("facets")))
        people = people.join(held, "id", "left")
    else:
        people = people.withColumn("facets", none.cast("array<struct<facet:string,value:string>>"))
    if educations is not None:
        held = (educations.join(wanted, F.col("profile_id") == F.col("id"), "left_semi").groupBy(F.col("profile_id").alias("id"))
                .agg(F.collect_set(F.struct("school_name", "school_normalized", F.col("is_law_degree").cast("int").alias("law"), "year")).alias("schools")))
        people = people.join(held, "id", "left")
    else:
        people = people.withColumn("schools", none.cast("array<struct<school_name:string,school_normalized:string,law:int,year:int>>"))
    people = people.withColumns({c: F.coalesce(c, none) for c in ("facets", "schools")})
    asking = (several.join(leads, KEY).select("lead", "slices", "set", "hits").join(detailed, "set")
              .withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)"))).drop("slices"))
    # the wide rows of people move once a lead, not once a set
    checked = led.join(people, "id").join(asking, ["lead", "slice"]).where(_meets_all(list(texts))).select("set", "id", "hits")
    found = candidates.where("size = 1").select("set", "id", "hits").unionAll(checked)
    return BatchSearch(per_query.join(sets, "criteria").select("query_id", "set"), candidates.select("set", "id"), led, found, lead.select("set", "asked", "hits"))


def _result_rows(search: BatchSearch) -> DataFrame:
    """``(query_id, id)`` of every query of a set and every hit of the set.

    The rows are made where they are written: blocks of a set's queries meet blocks of its hits as arrays, each pair of
    blocks once, and their rows come in runs (one query, the same few hits query after query), which a columnar file
    keeps as run lengths and short repeats.
    """
    parts = int(search.queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda n, size: F.expr(f"{n} div {size} + 1")
    # structs keep null keys in the arrays
    asked = (search.queries.join(search.sets, "set").withColumn("part", F.pmod(F.xxhash64("query_id"), blocks("asked", QUERY_BLOCK)))
             .groupBy("set", "hits", "part").agg(F.collect_list(F.struct("query_id")).alias("queries"))
             .select("set", F.explode(F.sequence(F.lit(0).cast("long"), blocks("hits", HIT_BLOCK) - 1)).alias("block"), "queries"))
    met = search.found.withColumn("block", F.pmod(F.xxhash64("id"), blocks("hits", HIT_BLOCK)))
    # the numbers of partitions are given: few bytes make many rows here, so small partitions are not to be joined
    met = met.repartition(parts, "set", "block").groupBy("set", "block").agg(F.collect_list(F.struct("id")).alias("ids"))
    ids = lambda i: F.transform(F.slice("ids", i * RUN + 1, RUN), lambda x: x["id"])
    runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size(ids) - 1) div {RUN}")), ids)
    # explode holds the rows of one array at a time, so that of the queries, not both at once, is cut up by transform
    return (asked.repartition(parts, "set", "block").join(met, ["set", "block"]).select("queries", F.explode(runs).alias("run"))
            .select("run", F.explode(F.transform("queries", lambda q: q["query_id"])).alias("query_id"))
            .select("query_id", F.explode("run").alias("id")))


def batch_search(criteria: DataFrame, profiles: DataFrame, facets: DataFrame | None = None,
                 educations: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Q14: answer a whole table of AND-ed criteria.

    criteria (query_id, field, op, value); a query's criteria are its distinct
    (field, op, value), whichever clause they come from, and a profile must
    meet all of them.  Fields are those of the criteria search: name, title,
    office, clerkship, practice, industry, region, language, school (through
    the aliases) and the graduation years with their degree flag.  A field or
    operation that is none of these, or that needs a table which is not given,
    is an error when the plan runs.  Values are literal (no wildcards).

    Queries with the same criteria are solved once.  Distinct criteria meet
    distinct values (equi-joins, rarest token, rarest trigram), which gives
    each criterion's number of hits without a row for each; a set with a
    criterion that nothing meets is done.  Only the hits of a set's rarest
    criterion become candidate rows; its other criteria are checked on the
    candidates' own values.  Two work tables are written to the shared folder
    while the plan is built: the queries' criteria sets (so that what
    ``criteria`` computes runs once) and the met values.

    Returns ``(query_id, id)``.
    """
    return _result_rows(batch_candidates(criteria, profiles, facets, educations, aliases))
