"""Criteria search keys."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import clean_lines
from dirsearch.operators.criteria import name_index_search, search, valid_name
from dirsearch.session import shared_dir
from dirsearch.sources.directory import write_directory
from dirsearch.suite import standins as S
from dirsearch.suite.registry import register, sql_str, table

P = S.CUSTOMER_PROFILES_SQL


def _cust(spark, sf, criteria, mode="entity", limit=None, facets=True, edu=False, aliases=False):
    return search(S.customer_profiles(spark, sf), criteria,
                  facets=S.facets(spark, sf) if facets else None,
                  educations=S.educations(spark, sf) if edu else None,
                  aliases=S.part_aliases(spark, sf) if aliases else None,
                  mode=mode, limit=limit, order_by_name=False)


def _exists(facet, pred):
    return f"exists (select 1 from ({S.FACET_SQL[facet]}) f where f.profile_id = profiles.id and {pred})"


def _edu_exists(pred):
    return f"exists (select 1 from educations e where e.profile_id = profiles.id and {pred})"


@register("crit_all", sql=f"with {P} select distinct id, name, url from profiles")
def crit_all(spark, sf):
    return _cust(spark, sf, [])


@register("crit_title_eq", sql=f"with {P} select id, name, url from profiles where title = 'BUILDING'")
def crit_title_eq(spark, sf):
    return _cust(spark, sf, [{"field": "title", "op": "eq", "value": "BUILDING"}])


@register("crit_title_contains", sql=f"with {P} select id, name, url from profiles where title ilike '%Mach%'")
def crit_title_contains(spark, sf):
    return _cust(spark, sf, [{"field": "title", "op": "contains", "value": "Mach"}])


@register("crit_facet_eq", sql=f"with {P} select id, name, url from profiles where "
          + _exists("practice", "f.value = '1-URGENT'"))
def crit_facet_eq(spark, sf):
    return _cust(spark, sf, [{"field": "practice", "op": "eq", "value": "1-URGENT"}])


@register("crit_facet_contains", sql=f"with {P} select id, name, url from profiles where "
          + _exists("practice", "f.value ilike '%high%'"))
def crit_facet_contains(spark, sf):
    return _cust(spark, sf, [{"field": "practice", "op": "contains", "value": "high"}])


@register("crit_industry", sql=f"with {P} select id, name, url from profiles where "
          + _exists("industry", "f.value = 'P'"))
def crit_industry(spark, sf):
    return _cust(spark, sf, [{"field": "industry", "op": "eq", "value": "P"}])


@register("crit_region", sql=f"with {P} select id, name, url from profiles where "
          + _exists("region", "f.value ilike '%r%'"))
def crit_region(spark, sf):
    return _cust(spark, sf, [{"field": "region", "op": "contains", "value": "r"}])


@register("crit_language", sql=f"with {P} select id, name, url from profiles where "
          + _exists("language", "lower(f.value) = lower('FR')"))
def crit_language(spark, sf):
    return _cust(spark, sf, [{"field": "language", "op": "eq", "value": "FR"}])


def _year_key(op, sym, year):
    @register(f"crit_year_{op}", sql=f"with {P}, {S.EDUCATIONS_SQL} select id, name, url from profiles where "
              + _edu_exists(f"(e.year {sym} {year} and e.is_law_degree = 1)"))
    def q(spark, sf):
        return _cust(spark, sf, [{"field": "law_school_year", "op": op, "value": year}], facets=False, edu=True)

    return q


for _op, _sym, _y in [("gt", ">", 1999), ("lt", "<", 1997), ("gte", ">=", 2000), ("lte", "<=", 1996),
                      ("eq", "=", 1998)]:
    _year_key(_op, _sym, _y)


@register("crit_year_undergrad", sql=f"with {P}, {S.EDUCATIONS_SQL} select id, name, url from profiles where "
          + _edu_exists("(e.year = 1998 and e.is_law_degree = 0)") + " and not "
          + _edu_exists("(e.year > 1999 and e.is_law_degree = 1)"))
def crit_year_undergrad(spark, sf):
    """Undergraduate year uses degree flag 0; NOT negates the whole (year, flag) pair."""
    return _cust(spark, sf, [{"field": "undergrad_year", "op": "eq", "value": 1998}, {"op": "NOT"},
                             {"field": "graduated", "op": "gt", "value": 1999}], facets=False, edu=True)


@register("crit_school", sql=f"with {P}, {S.EDUCATIONS_SQL}, {S.PART_ALIAS_KEYS_SQL} "
          "select id, name, url from profiles where "
          + _edu_exists("(e.school_name ilike '%red widget%' or e.school_normalized ilike '%' || "
                        + S.resolve_sql("'red widget'") + " || '%')"))
def crit_school(spark, sf):
    return _cust(spark, sf, [{"field": "school", "op": "contains", "value": "red widget"}], facets=False,
                 edu=True, aliases=True)


@register("crit_school_eq", sql=f"with {P}, {S.EDUCATIONS_SQL}, {S.PART_ALIAS_KEYS_SQL} "
          "select id, name, url from profiles where "
          + _edu_exists("(e.school_name = 'SMALL' or e.school_normalized = " + S.resolve_sql("'SMALL'") + ")"))
def crit_school_eq(spark, sf):
    """School equality: the value 'SMALL' is an alias (a part type) resolved to its brand."""
    return _cust(spark, sf, [{"field": "school", "op": "eq", "value": "SMALL"}], facets=False,
                 edu=True, aliases=True)


@register("crit_name_tokens", sql=f"with {S.PART_PROFILES_SQL} select id, name, url from profiles "
          "where list_has_all(string_split(lower(name), ' '), ['red', 'widget'])")
def crit_name_tokens(spark, sf):
    return search(S.part_profiles(spark, sf), [{"field": "name", "op": "contains", "value": "Widget red"}],
                  order_by_name=False)


@register("crit_name_phrase", sql=f"with {S.PART_PROFILES_SQL} select id, name, url from profiles "
          "where contains(' ' || lower(name) || ' ', ' red widget ')")
def crit_name_phrase(spark, sf):
    return search(S.part_profiles(spark, sf), [{"field": "name", "op": "eq", "value": "Red widget"}],
                  order_by_name=False)


@register("crit_name_index", sql=f"with {S.PART_PROFILES_SQL} select id, name, url from profiles "
          "where list_has_all(string_split(lower(name), ' '), ['red', 'widget'])")
def crit_name_index(spark, sf):
    """Name words matched through the exploded token index, semi-joined back."""
    from dirsearch.operators.criteria import name_index_search
    from dirsearch.operators.upsert import name_index

    parts = S.part_profiles(spark, sf)
    return name_index_search(parts, name_index(parts), "Widget red")


@register("crit_and", sql=f"with {P} select id, name, url from profiles where "
          + _exists("practice", "f.value = '1-URGENT'") + " and " + _exists("industry", "f.value = 'F'"))
def crit_and(spark, sf):
    """AND of two facets; the unknown field in between is skipped."""
    return _cust(spark, sf, [{"field": "practice", "op": "eq", "value": "1-URGENT"},
                             {"field": "shoe_size", "op": "eq", "value": "9"},
                             {"op": "AND"}, {"field": "industry", "op": "eq", "value": "F"}])


@register("crit_or", sql=f"with {P} select id, name, url from profiles where "
          + _exists("region", "f.value = 'N'") + " or title = 'BUILDING'")
def crit_or(spark, sf):
    return _cust(spark, sf, [{"field": "region", "op": "eq", "value": "N"}, {"op": "OR"},
                             {"field": "title", "op": "eq", "value": "BUILDING"}])


@register("crit_not", sql=f"with {P} select id, name, url from profiles where title = 'BUILDING' and not "
          + _exists("industry", "f.value = 'F'"))
def crit_not(spark, sf):
    return _cust(spark, sf, [{"field": "title", "op": "eq", "value": "BUILDING"}, {"op": "AND"}, {"op": "NOT"},
                             {"field": "industry", "op": "eq", "value": "F"}])


@register("crit_bool_mix", sql=f"with {P} select id, name, url from profiles where "
          + _exists("practice", "f.value = '1-URGENT'") + " or (not " + _exists("industry", "f.value = 'F'")
          + " and title = 'BUILDING')")
def crit_bool_mix(spark, sf):
    """A OR NOT B AND C with SQL precedence: A OR ((NOT B) AND C)."""
    return _cust(spark, sf, [{"field": "practice", "op": "eq", "value": "1-URGENT"}, {"op": "OR"}, {"op": "NOT"},
                             {"field": "industry", "op": "eq", "value": "F"},
                             {"field": "title", "op": "eq", "value": "BUILDING"}])


def stored(spark, sf, profiles=S.customer_profiles):
    """The stand-in directory, stored in buckets."""
    name = f"dir_{uuid.uuid4().hex}"
    return write_directory(name, os.path.join(shared_dir(spark), name), profiles(spark, sf), S.facets(spark, sf), S.educations(spark, sf), buckets=8)


STORED_MIX = [{"field": "practice", "op": "eq", "value": "1-URGENT"}, {"op": "AND"}, {"field": "industry", "op": "contains", "value": "f"},
              {"op": "AND"}, {"op": "NOT"}, {"field": "region", "op": "eq", "value": "N"}, {"op": "OR"},
              {"field": "law_school_year", "op": "gte", "value": 1997}, {"op": "AND"}, {"op": "NOT"}, {"field": "practice", "op": "eq", "value": "5-LOW"}]


@register("crit_stored_mix", sql=f"with {P}, " + S.EDUCATIONS_SQL.strip() + " select id, name, url from profiles where ("
          + _exists("practice", "f.value = '1-URGENT'") + " and " + _exists("industry", "contains(lower(f.value), 'f')") + " and not "
          + _exists("region", "f.value = 'N'") + ") or (exists (select 1 from educations e where e.profile_id = id and e.is_law_degree = 1 and e.year >= 1997) "
          "and not " + _exists("practice", "f.value = '5-LOW'") + ")")
def crit_stored_mix(spark, sf):
    """J2/P4-P8/P12 on the stored directory: five conditions, one pass over each child table, no shuffle of a stored table."""
    d = stored(spark, sf)
    return search(d.profiles, STORED_MIX, facets=d.facets, educations=d.educations, order_by_name=False)


@register("crit_stored_name", sql="select p_partkey as id, p_name as name, 'part/' || p_partkey as url from part "
          "where list_has_all(string_split(lower(p_name), ' '), ['bolt', 'red'])")
def crit_stored_name(spark, sf):
    """J1/P10 on the stored directory: only the token partitions of the words are read."""
    d = stored(spark, sf, S.part_profiles)
    return name_index_search(d.profiles, d.name_index, "Red BOLT")


@register("crit_row_mode", sql="select distinct c_custkey as id, c_name as name, 'cust/' || c_custkey as url "
          "from customer left join orders on o_custkey = c_custkey where not (o_orderpriority = '1-URGENT')")
def crit_row_mode(spark, sf):
    return _cust(spark, sf, [{"op": "NOT"}, {"field": "practice", "op": "eq", "value": "1-URGENT"}], mode="row")


@register("crit_entity_mode", sql="select c_custkey as id, c_name as name, 'cust/' || c_custkey as url "
          "from customer where not exists (select 1 from orders where o_custkey = c_custkey "
          "and o_orderpriority = '1-URGENT')")
def crit_entity_mode(spark, sf):
    return _cust(spark, sf, [{"op": "NOT"}, {"field": "practice", "op": "eq", "value": "1-URGENT"}])


@register("crit_row_pair", sql="select distinct c_custkey as id, c_name as name, 'cust/' || c_custkey as url "
          "from customer left join orders on o_custkey = c_custkey "
          "where o_orderpriority = '1-URGENT' and o_orderpriority = '2-HIGH'")
def crit_row_pair(spark, sf):
    """Row mode: two values of one facet on one joined row can never both hold."""
    return _cust(spark, sf, [{"field": "practice", "op": "eq", "value": "1-URGENT"},
                             {"field": "practice", "op": "eq", "value": "2-HIGH"}], mode="row")


@register("crit_office", sql=f"with {P} select id, name, url from profiles where office_location ilike '%nation_1%'")
def crit_office(spark, sf):
    return _cust(spark, sf, [{"field": "office", "op": "contains", "value": "nation_1"}], facets=False)


@register("join_left_facets", sql="select distinct c_custkey as id, c_name as name, o_orderpriority as practice "
          "from customer left join orders on o_custkey = c_custkey")
def join_left_facets(spark, sf):
    prof = S.customer_profiles(spark, sf)
    prac = S.facets(spark, sf).where(F.col("facet") == "practice")
    return (prof.join(prac, prof.id == prac.profile_id, "left")
            .select("id", "name", F.col("value").alias("practice")).distinct())


@register("sort_name_limit", sql=f"with {P} select id, name, url from profiles where title = 'BUILDING' "
          "order by name, id limit 25")
def sort_name_limit(spark, sf):
    return search(S.customer_profiles(spark, sf), [{"field": "title", "op": "eq", "value": "BUILDING"}],
                  limit=25)


def _valid_name_sql(x: str) -> str:
    black = " or ".join(f"contains(lower(trim({x})), {sql_str(b)})" for b in L.NAME_BLACKLIST)
    bad = " or ".join(f"contains({x}, {sql_str(c)})" for c in L.NAME_BAD_CHARS)
    words = f"string_split_regex(trim({x}), '\\s+')"
    return (f"(not ({black}) and regexp_full_match({x}, {sql_str(L.NAME_SHAPE[1:-1])}) "
            f"and length({x}) between 3 and 50 and not ({bad}) and len({words}) >= 2 "
            f"and list_bool_and(list_transform({words}, lambda w: length(w) <= 1 or "
            f"regexp_full_match(replace(w, '.', ''), '\\p{{L}}+'))))")


@register("valid_names", sql="with l as (select doc_id, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as line "
          "from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), "
          "lambda x: x <> '') as ls from documents)) "
          f"select doc_id, pos, line from l where {_valid_name_sql('line')}")
def valid_names(spark, sf):
    """Lines of every document that pass the name validity predicate."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(clean_lines("text")).alias("pos", "line"))
    ok = valid_name(F.col("line"), L.NAME_BLACKLIST, L.NAME_SHAPE, L.NAME_BAD_CHARS)
    return lines.where(ok).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")
