"""Query-log keys (Q1-Q14, S2, S3, J9, T9).  Queries are the user turns of
``conversations`` (whitespace collapsed), query_id = conv_id*1000 + turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.operators import aliases as A
from dirsearch.operators import querylog as QL
from dirsearch.suite import standins as S
from dirsearch.suite.pages import strip_sql
from dirsearch.suite.registry import register, sql_list, sql_str, table

SIMPLE = [r"(^|[^\p{L}])the([^\p{L}]|$)"]
COMPLEX = ["tion"]
COMPOSED_SQL = ("case p_type when 'ECONOMY' then 'Lawyers named ' || p_name || ' and graduated after ' || (1990 + p_size) "
                "when 'SMALL' then 'Partners who went to the ' || p_name || ' University' "
                "when 'MEDIUM' then 'associates in Asia who speak ' || p_name "
                "when 'LARGE' then 'lawyers in ' || p_name || ' and title is senior ' || p_name "
                "when 'PROMO' then 'Of Counsel with name is ' || p_name || ' and law school before ' || (1980 + p_size) "
                "else 'region is latin america and ' || p_name || ' ' || lower(p_type) end")
Q_SQL = ("qs as (select conv_id * 1000 + turn as query_id, regexp_replace(text, '\\s+', ' ', 'g') as query "
         "from conversations where role = 'user' union all select 1000000000 + p_partkey, " + COMPOSED_SQL + " from part)")


def composed(p):
    """Query strings composed from part rows so that every extraction rule fires."""
    t, n, z = p["p_type"], p["p_name"], p["p_size"]
    return (F.when(t == "ECONOMY", F.concat(F.lit("Lawyers named "), n, F.lit(" and graduated after "),
                                            (F.lit(1990) + z).cast("string")))
            .when(t == "SMALL", F.concat(F.lit("Partners who went to the "), n, F.lit(" University")))
            .when(t == "MEDIUM", F.concat(F.lit("associates in Asia who speak "), n))
            .when(t == "LARGE", F.concat(F.lit("lawyers in "), n, F.lit(" and title is senior "), n))
            .when(t == "PROMO", F.concat(F.lit("Of Counsel with name is "), n, F.lit(" and law school before "),
                                         (F.lit(1980) + z).cast("string")))
            .otherwise(F.concat(F.lit("region is latin america and "), n, F.lit(" "), F.lower(t))))


def log_queries(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    conv = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                    F.regexp_replace("text", r"\s+", " ").alias("query"))
    p = table(spark, sf, "part")
    comp = p.select((F.lit(1000000000) + F.col("p_partkey")).alias("query_id"), composed(p).alias("query"))
    return conv.unionByName(comp)


ROUTE_SQL = (f"case when regexp_matches(lower({strip_sql('query')}), {sql_str(SIMPLE[0])}) and not "
             f"regexp_matches(lower({strip_sql('query')}), 'tion') then 'simple' when regexp_matches(lower({strip_sql('query')}), "
             "'tion') then 'complex' else 'unknown' end")


@register("route_tag", sql=f"with {Q_SQL} select query_id, {ROUTE_SQL} as route from qs")
def route_tag(spark, sf):
    """Q1: simple / complex / unknown by pattern."""
    q = log_queries(spark, sf)
    return q.select("query_id", QL.route_tag("query", SIMPLE, COMPLEX, unicode=False).alias("route"))


@register("route_final", sql=f"with {Q_SQL} select query_id, case when {ROUTE_SQL} <> 'unknown' then {ROUTE_SQL} "
          "when length(query) < 60 then 'simple' else 'complex' end as route from qs")
def route_final(spark, sf):
    """Q2: unknown tags go to a fallback (here: short queries are simple), default complex."""
    q = log_queries(spark, sf)
    tag = QL.route_tag("query", SIMPLE, COMPLEX, unicode=False)
    fb = F.when(F.length("query") < 60, F.lit("simple"))
    return q.select("query_id", QL.route_final(tag, fb).alias("route"))


@register("route_mix", sql=f"with {Q_SQL}, t as (select {ROUTE_SQL} as route from qs) select route, count(*) as n, "
          "round(count(*) / sum(count(*)) over (), 6) as share from t group by route")
def route_mix(spark, sf):
    """Q3: share of queries settled by each routing tag."""
    q = log_queries(spark, sf)
    return QL.route_mix(q.select(QL.route_tag("query", SIMPLE, COMPLEX, unicode=False).alias("route")))


CLAUSES_SQL = (f"cl as (select query_id, generate_subscripts(ps, 1) - 1 as clause_no, {strip_sql('unnest(ps)')} as clause "
               f"from (select query_id, string_split_regex(lower({strip_sql('query')}), {sql_str(L.CLAUSE_SPLIT)}) as ps from qs))")


@register("clause_split", sql=f"with {Q_SQL}, {CLAUSES_SQL} select query_id, clause_no, clause from cl")
def clause_split(spark, sf):
    """Q4: clauses split on 'and'."""
    return QL.split_clauses(log_queries(spark, sf)).select("query_id", F.col("clause_no").cast("long").alias("clause_no"),
                                                           "clause")


def _initcap_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda s: upper(left(s, 1)) || lower(substr(s, 2))), ' ')"


def extraction_sql(src: str) -> str:
    """DuckDB twin of :func:`QL.extract_criteria` (same rules, same order)."""
    ctes = [f"x0 as (select query_id, clause_no, clause as t, []::STRUCT(field VARCHAR, op VARCHAR, value VARCHAR)[] "
            f"as found from {src})"]
    for i, r in enumerate(QL.default_rules()):
        pats = list(r.patterns)
        w = "case " + " ".join(f"when regexp_matches(t, {sql_str(p)}) then {k}" for k, (p, _) in enumerate(pats)) + " end"
        grp = 0 if r.value == "title_map" else 1
        raw = "case w " + " ".join(f"when {k} then regexp_extract(t, {sql_str(p)}, {grp})"
                                   for k, (p, _) in enumerate(pats)) + " end"
        val = strip_sql(raw)
        if r.value == "school":
            val = strip_sql(f"regexp_replace({val}, {sql_str(L.SCHOOL_ARTICLES)}, '', 'g')")
        elif r.value == "region":
            val = f"case when contains({val}, 'latin america') then 'Latin America' else {_initcap_sql(val)} end"
        elif r.value == "title_map":
            val = "case w " + " ".join(f"when {k} then {sql_str(QL.TITLE_MAP[p])}" for k, (p, _) in enumerate(pats)) + " end"
        elif r.value == "title":
            val = _initcap_sql(val)
        op = "case w " + " ".join(f"when {k} then {sql_str(o)}" for k, (_, o) in enumerate(pats)) + " end"
        emit = "w is not null"
        if r.value == "school":
            emit += " and v <> ''"
        if r.field == "title_is":
            emit += " and not list_contains(list_transform(found, lambda s: s.field), 'title')"
        rem = "case w " + " ".join(f"when {k} then {strip_sql('regexp_replace(t, ' + sql_str(p) + ', ' + sql_str('') + ', ' + sql_str('g') + ')')}"
                                   for k, (p, _) in enumerate(pats)) + " end"
        field = "title" if r.field == "title_is" else r.field
        ctes.append(f"y{i} as (select *, {w} as w from x{i})")
        ctes.append(f"z{i} as (select *, {val} as v, {op} as o from y{i})")
        ctes.append(f"x{i + 1} as (select query_id, clause_no, case when {emit} then {rem} else t end as t, "
                    f"case when {emit} then list_append(found, struct_pack(field := {sql_str(field)}, op := o, value := v)) "
                    f"else found end as found from z{i})")
    n = len(QL.default_rules())
    ctes.append(f"fin as (select query_id, clause_no, found, list_filter(string_split_regex(t, '\\s+'), lambda w: not "
                f"list_contains({sql_list(L.QUERY_STOP_WORDS)}, lower(w)) and length(w) >= {L.FALLBACK_MIN_WORD_LEN}) "
                f"as words from x{n})")
    ctes.append("crit as (select query_id, clause_no, struct_extract(c, 'field') as field, struct_extract(c, 'op') as op, "
                "struct_extract(c, 'value') as value, struct_extract(c, 'by_fallback') as by_fallback from ("
                "select query_id, clause_no, unnest(case when len(found) > 0 then list_transform(found, lambda s: "
                "struct_pack(field := s.field, op := s.op, value := s.value, by_fallback := false)) when len(words) > 0 "
                "then [struct_pack(field := 'name', op := 'contains', value := array_to_string(words, ' '), "
                "by_fallback := true)] else [] end) as c from fin))")
    return ", ".join(ctes)


PRACTICE_MAP_SQL = ("pmap as (select lower(alias) as alias, arg_max(normalized, ord * 10 + pos) as normalized from ("
                    "select p_brand as alias, p_brand as normalized, p_partkey as ord, 0 as pos from part "
                    "union all select p_name, p_brand, p_partkey, 1 from part union all select p_type, p_brand, p_partkey, 2 "
                    "from part) group by 1)")
CRIT_SQL = (f"with {Q_SQL}, {CLAUSES_SQL}, {extraction_sql('cl')}, {PRACTICE_MAP_SQL}, "
            "crit2 as (select query_id, clause_no, field, op, case when field = 'practice' then coalesce(pmap.normalized, "
            + _initcap_sql("value") + ") else value end as value, by_fallback from crit left join pmap on "
            "crit.field = 'practice' and lower(crit.value) = pmap.alias) ")


def criteria_rows(spark, sf):
    cl = QL.split_clauses(log_queries(spark, sf))
    crit = QL.extract_criteria(cl, unicode=False)
    pmap = A.last_wins_ci(S.part_aliases(spark, sf))
    return QL.normalise_practice(crit, pmap).select(
        "query_id", F.col("clause_no").cast("long").alias("clause_no"), "field", "op", "value", "by_fallback")


def _crit_key(key, where_spark, where_sql, doc):
    @register(key, sql=CRIT_SQL + f"select query_id, clause_no, op, value from crit2 where {where_sql}")
    def q(spark, sf):
        return criteria_rows(spark, sf).where(F.expr(where_spark)).select("query_id", "clause_no", "op", "value")

    q.__doc__ = doc
    return q


for _key, _where, _doc in [
        ("criteria_year", "field = 'law_school_year'", "Q5: graduation-year criterion"),
        ("criteria_name", "field = 'name' and not by_fallback", "Q6: name criterion"),
        ("criteria_school", "field = 'school'", "Q7: school criterion, articles removed"),
        ("criteria_practice", "field = 'practice'", "Q8: practice criterion via the alias map, else title case"),
        ("criteria_title", "field = 'title'", "Q9: title criterion"),
        ("criteria_region", "field = 'region'", "Q10: region criterion"),
        ("criteria_language", "field = 'language'", "Q11: language criterion"),
        ("criteria_fallback", "by_fallback", "Q12: remaining words as a name criterion")]:
    _crit_key(_key, _where, _where, _doc)

NORM_KEYS_SQL = ("ak as (select key, arg_min(normalized, ord * 10 + pos) as normalized from (select lower(key) as key, normalized, ord, pos "
                 "from alias_keys where key is not null and not contains(key, ' ')) group by key)")


@register("query_normalize", sql=f"with {Q_SQL}, {S.PART_ALIAS_KEYS_SQL}, {NORM_KEYS_SQL}, "
          f"w as (select query_id, list_filter(string_split_regex(lower({strip_sql('query')}), '\\s+'), lambda x: x <> '') as ws from qs), "
          "u as (select query_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w) "
          "select w.query_id, coalesce(max(x.t), '') as normalized from w left join (select query_id, "
          "string_agg(coalesce(ak.normalized, word), ' ' order by i) as t from u left join ak on ak.key = u.word group by query_id) x "
          "using (query_id) group by w.query_id")
def query_normalize(spark, sf):
    """Q13: whole words of the query that are aliases become their canonical names (single-word aliases here)."""
    rows = A.alias_rows(table(spark, sf, "part"), "p_brand", ["p_name", "p_type"], "p_partkey")
    return QL.normalise_queries(log_queries(spark, sf), rows, max_words=1)


_FOLD = "list_filter(string_split_regex(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
SEARCH_SQL = (CRIT_SQL.rstrip() + f", {S.PART_DIRECTORY_SQL.strip()}, {S.PART_ALIAS_KEYS_SQL.strip()}, "
              "cd as (select distinct query_id, field, op, value from crit2), ak as (select distinct field, op, value from cd), "
              "sv as (select field, op, value, " + S.resolve_sql("value") + " as canonical from ak where field = 'school'), "
              "ed as (select distinct profile_id as id, school_name, school_normalized, is_law_degree, year from educations), "
              f"nt as (select id, {_FOLD.format('name')} as toks from profiles), "
              "met as (select field, op, value, id from ak join nt on field = 'name' and len(" + _FOLD.format("value") + ") > 0 and case op when 'contains' then "
              f"list_has_all(toks, {_FOLD.format('value')}) else contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || array_to_string({_FOLD.format('value')}, ' ') || ' ') end "
              "union select field, op, ak.value, id from ak join profiles on field = 'title' and case op when 'eq' then title = ak.value else contains(lower(title), lower(ak.value)) end "
              "union select ak.field, op, ak.value, id from ak join fa on fa.field = ak.field and case when op = 'eq' and ak.field = 'language' then lower(fa.value) = lower(ak.value) "
              "when op = 'eq' then fa.value = ak.value else contains(lower(fa.value), lower(ak.value)) end "
              "union select field, op, value, id from sv join ed on case op when 'eq' then school_name = value or school_normalized = canonical else "
              "contains(lower(school_name), lower(value)) or contains(lower(school_normalized), lower(canonical)) end "
              "union select field, op, value, id from ak join ed on (field = 'law_school_year' and is_law_degree = 1 or field = 'undergrad_year' and is_law_degree = 0) "
              "and case op when 'gt' then year > try_cast(value as int) when 'lt' then year < try_cast(value as int) when 'gte' then year >= try_cast(value as int) when 'lte' then year <= value::int else year = try_cast(value as int) end) "
              "select query_id, id from cd join met using (field, op, value) join (select query_id, count(*) as need from cd group by 1) using (query_id) "
              "group by query_id, id having count(*) = max(need)")


@register("search_log", sql=SEARCH_SQL)
def search_log(spark, sf):
    """Q4-Q12, Q14: query strings to clauses to criteria to profiles, for the whole log."""
    profiles, facets, educations = S.part_directory(spark, sf)
    return QL.batch_search(criteria_rows(spark, sf), profiles, facets, educations, S.part_aliases(spark, sf))


@register("batch_search", sql="with pr as (select p_partkey as id, list_filter(string_split_regex(strip_accents(lower(p_name)), "
          "'[^\\p{L}\\p{N}]+'), lambda t: t <> '') as toks from part) "
          "select q.id as query_id, p.id from pr q join pr p on list_has_all(p.toks, q.toks)")
def batch_search(spark, sf):
    """Q14: a table of name criteria (one per part name) answered in one join plan."""
    parts = S.part_profiles(spark, sf)
    crit = parts.select(F.col("id").alias("query_id"), F.lit(0).alias("clause_no"), F.lit("name").alias("field"),
                        F.lit("contains").alias("op"), F.col("name").alias("value"))
    return QL.batch_search(crit, parts)


# ------------------------------------------------------------ alias tables
@register("alias_first_wins", sql="select alias, arg_min(normalized, ord * 10 + pos) as normalized from ("
          "select p_name as alias, p_brand as normalized, p_partkey as ord, 1 as pos from part "
          "union all select p_type, p_brand, p_partkey, 2 from part) group by alias")
def alias_first_wins(spark, sf):
    """One row per alias, the first alias-file row wins."""
    return A.first_wins(S.part_aliases(spark, sf))


@register("alias_last_wins", sql="with " + PRACTICE_MAP_SQL + " select alias, normalized from pmap")
def alias_last_wins(spark, sf):
    """S3: case-folded map with identity rows, the last alias-file row wins."""
    return A.last_wins_ci(S.part_aliases(spark, sf))


VALUES_SQL = ("vals as (select p_partkey as id, case when p_size < 15 then upper(p_name) when p_size < 30 then p_brand "
              "else 'x-' || p_name end as value from part)")


@register("alias_resolve", sql=f"with {S.PART_ALIAS_KEYS_SQL}, {VALUES_SQL} select id, value, "
          + S.resolve_sql("value") + " as resolved from vals")
def alias_resolve(spark, sf):
    """Exact key, else case-insensitive key, else the value itself."""
    p = table(spark, sf, "part")
    vals = p.select(F.col("p_partkey").alias("id"),
                    F.when(F.col("p_size") < 15, F.upper("p_name")).when(F.col("p_size") < 30, F.col("p_brand"))
                    .otherwise(F.concat(F.lit("x-"), F.col("p_name"))).alias("value"))
    return A.resolve(vals, "value", S.part_aliases(spark, sf)).select("id", "value", "resolved")


@register("batch_search_and", sql="with pr as (select p_partkey as id, list_filter(string_split_regex(strip_accents(lower(p_name)), "
          "'[^\\p{L}\\p{N}]+'), lambda t: t <> '') as toks, p_type from part) "
          "select q.id as query_id, p.id from pr q join pr p on list_has_all(p.toks, q.toks) and p.p_type = q.p_type")
def batch_search_and(spark, sf):
    """Q14 with two AND-ed clauses per query (name words, then title equality)."""
    parts = S.part_profiles(spark, sf)
    name = parts.select(F.col("id").alias("query_id"), F.lit(0).alias("clause_no"), F.lit("name").alias("field"),
                        F.lit("contains").alias("op"), F.col("name").alias("value"))
    title = parts.select(F.col("id").alias("query_id"), F.lit(1).alias("clause_no"), F.lit("title").alias("field"),
                         F.lit("eq").alias("op"), F.col("title").alias("value"))
    return QL.batch_search(name.unionByName(title), parts)
