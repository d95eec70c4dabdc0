"""Stand-ins: directory tables derived from the test tables (see FIXTURES.md).

Each builder has a DuckDB twin (``*_SQL``) used inside oracle queries, so both
sides derive the same profiles, facets and education rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dirsearch.operators.aliases import alias_rows
from dirsearch.suite.registry import table


def customer_profiles(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    F.concat(F.lit("cust/"), F.col("c_custkey").cast("string")).alias("url"),
                    F.col("c_mktsegment").alias("title"), F.col("n_name").alias("office_location"),
                    F.lit(None).cast("string").alias("clerkship")))


CUSTOMER_PROFILES_SQL = """
profiles as (select c_custkey as id, c_name as name, 'cust/' || c_custkey as url, c_mktsegment as title,
                    n_name as office_location
             from customer left join nation on c_nationkey = n_nationkey)"""


def part_profiles(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                    F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("url"),
                    F.col("p_type").alias("title"))


PART_PROFILES_SQL = """
profiles as (select p_partkey as id, p_name as name, 'part/' || p_partkey as url, p_type as title from part)"""


def facets(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    d = table(spark, sf, "documents")
    practice = o.select(F.col("o_custkey").alias("profile_id"), F.lit("practice").alias("facet"),
                        F.col("o_orderpriority").alias("value"))
    industry = o.select(F.col("o_custkey").alias("profile_id"), F.lit("industry").alias("facet"),
                        F.col("o_orderstatus").alias("value"))
    region = (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("o_custkey").alias("profile_id"), F.lit("region").alias("facet"),
                      F.col("l_returnflag").alias("value")))
    language = d.select(F.col("doc_id").alias("profile_id"), F.lit("language").alias("facet"),
                        F.col("lang").alias("value"))
    return practice.unionByName(industry).unionByName(region).unionByName(language)


FACET_SQL = {
    "practice": "select o_custkey as profile_id, o_orderpriority as value from orders",
    "industry": "select o_custkey as profile_id, o_orderstatus as value from orders",
    "region": "select o_custkey as profile_id, l_returnflag as value from lineitem join orders on l_orderkey = o_orderkey",
    "language": "select doc_id as profile_id, lang as value from documents",
}


def educations(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .select(F.col("o_custkey").alias("profile_id"), F.col("p_name").alias("school_name"),
                    F.col("p_brand").alias("school_normalized"),
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_law_degree"),
                    F.year("o_orderdate").alias("year")))


EDUCATIONS_SQL = """
educations as (select o_custkey as profile_id, p_name as school_name, p_brand as school_normalized,
                      (o_orderpriority = '1-URGENT')::int as is_law_degree, year(o_orderdate) as year
               from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""


def part_aliases(spark, sf):
    """Alias rows as if each part were one line ``brand,name,type`` of an alias file."""
    return alias_rows(table(spark, sf, "part"), "p_brand", ["p_name", "p_type"], "p_partkey")


PART_ALIAS_KEYS_SQL = """
alias_keys as (select p_brand as key, p_brand as normalized, p_partkey as ord, 0 as pos from part
               union all select p_name, p_brand, p_partkey, 1 from part
               union all select p_type, p_brand, p_partkey, 2 from part)"""


def resolve_sql(value_sql: str) -> str:
    """DuckDB expression resolving ``value_sql`` through ``alias_keys`` (exact, then folded, then itself)."""
    return (f"coalesce((select arg_min(normalized, (key <> {value_sql})::int * 1000000000 + ord * 10 + pos) "
            f"from alias_keys where key = {value_sql} or lower(key) = lower({value_sql})), {value_sql})")


def part_directory(spark, sf):
    """A directory in which the composed query strings find people: parts as profiles with facets and schools."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    kind = F.col("p_size") % 5
    title = (F.when(kind == 0, "Partner").when(kind == 1, "Associate").when(kind == 2, "Of Counsel")
             .when(kind == 3, "Counsel").otherwise(F.concat(F.lit("Senior "), F.initcap("p_name"))))
    profiles = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), title.alias("title"))
    region = F.when(kind < 3, "Asia").otherwise("Latin America")
    own = F.array(*[F.struct(F.lit(f).alias("facet"), v.alias("value")) for f, v in
                    (("practice", F.col("p_brand")), ("region", region), ("language", F.initcap("p_name")))])
    facets = p.select(F.col("p_partkey").alias("profile_id"), F.explode(own).alias("x")).select("profile_id", "x.*")
    schools = F.array(*[F.struct(F.concat("p_name", F.lit(s)).alias("school_name"), F.col("p_brand").alias("school_normalized"),
                                 F.lit(law).alias("is_law_degree"), (F.lit(y) + F.col("p_size")).alias("year"))
                        for s, law, y in ((" University", 1, 1995), (" College", 0, 1960), (" Law School", 1, 1970))])
    educations = p.select(F.col("p_partkey").alias("profile_id"), F.explode(schools).alias("x")).select("profile_id", "x.*")
    return profiles, facets, educations


_INITCAP_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
PART_DIRECTORY_SQL = f"""
dp as (select *, p_size % 5 as kind, {_INITCAP_NAME} as cap from part),
profiles as (select p_partkey as id, p_name as name, case kind when 0 then 'Partner' when 1 then 'Associate' when 2 then 'Of Counsel'
                    when 3 then 'Counsel' else 'Senior ' || cap end as title from dp),
fa as (select p_partkey as id, 'practice' as field, p_brand as value from dp
       union all select p_partkey, 'region', case when kind < 3 then 'Asia' else 'Latin America' end from dp
       union all select p_partkey, 'language', cap from dp),
educations as (select p_partkey as profile_id, p_name || ' University' as school_name, p_brand as school_normalized, 1 as is_law_degree, 1995 + p_size as year from part
       union all select p_partkey, p_name || ' College', p_brand, 0, 1960 + p_size from part
       union all select p_partkey, p_name || ' Law School', p_brand, 1, 1970 + p_size from part)"""
