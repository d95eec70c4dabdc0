"""Ingest, keyed-write, export and streaming keys (S1, S6-S11, J7, A3, A5, ST1, ST2, V6)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from dirsearch.functions.text import clean_lines, strip
from dirsearch.operators import embed as E
from dirsearch.operators import lines as LN
from dirsearch.operators import upsert as U
from dirsearch.plans import ingest as I
from dirsearch.session import shared_dir
from dirsearch.sources import files as FS
from dirsearch.suite import standins as S
from dirsearch.suite.pages import HTML_SQL, strip_sql
from dirsearch.suite.registry import register, sql_str, table


@register("src_seed_urls", sql=f"select {strip_sql('url')} as url from pages where starts_with({strip_sql('url')}, 'http')")
def src_seed_urls(spark, sf):
    """Seed list = trimmed lines starting with 'http' (here the page URLs)."""
    return FS.seed_urls(table(spark, sf, "pages"), "url")


STREAM_DOMAIN = r"[a-z0-9.-]+\.[a-z]+"  # any host: the test pages have no one domain
T0, T1 = "2020-01-01 00:00:00", "2021-06-01 00:00:00"


def _base_profiles(spark, sf):
    p = S.customer_profiles(spark, sf)
    return p.select("url", "name", "title", F.lit(T0).cast("timestamp").alias("created_at"),
                    F.lit(T0).cast("timestamp").alias("updated_at"))


def _batch(spark, sf):
    p = S.customer_profiles(spark, sf)
    upd = p.where(F.col("title") == "BUILDING").select("url", F.upper("name").alias("name"),
                                                      F.lit("UPDATED").alias("title"))
    s = table(spark, sf, "supplier")
    new = s.select(F.concat(F.lit("supp/"), F.col("s_suppkey").cast("string")).alias("url"),
                   F.col("s_name").alias("name"), F.lit("NEW").alias("title"))
    return upd.unionByName(new)


@register("upsert_profiles", sql="with base as (select 'cust/' || c_custkey as url, c_name as name, c_mktsegment as title "
          "from customer), batch as (select 'cust/' || c_custkey as url, upper(c_name) as name, 'UPDATED' as title "
          "from customer where c_mktsegment = 'BUILDING' union all select 'supp/' || s_suppkey, s_name, 'NEW' from supplier) "
          f"select coalesce(b.url, a.url) as url, coalesce(b.name, a.name) as name, coalesce(b.title, a.title) as title, "
          f"case when a.url is null then '{T1}' else '{T0}' end as created_at, "
          f"case when b.url is null then '{T0}' else '{T1}' end as updated_at "
          "from base a full join batch b on a.url = b.url")
def upsert_profiles(spark, sf):
    """Keyed upsert by url; created_at kept, updated_at from the batch."""
    out = U.upsert(_base_profiles(spark, sf), _batch(spark, sf), key="url", batch_ts=F.lit(T1).cast("timestamp"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return out.select("url", "name", "title", F.date_format("created_at", fmt).alias("created_at"),
                      F.date_format("updated_at", fmt).alias("updated_at"))


@register("replace_children", sql="select o_custkey as profile_id, o_orderpriority as value from orders "
          "where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') "
          "union all select c_custkey, 'NEW-' || c_mktsegment from customer where c_mktsegment = 'BUILDING' "
          "union all select c_custkey, 'NATION-' || c_nationkey from customer where c_mktsegment = 'BUILDING'")
def replace_children(spark, sf):
    """All children of touched profiles replaced by the batch's children."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("value"))
    c = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    new = c.select(F.col("c_custkey").alias("profile_id"), F.concat(F.lit("NEW-"), "c_mktsegment").alias("value")) \
        .unionByName(c.select(F.col("c_custkey").alias("profile_id"),
                              F.concat(F.lit("NATION-"), F.col("c_nationkey").cast("string")).alias("value")))
    return U.replace_children(o, new, c.select(F.col("c_custkey").alias("profile_id")))


@register("replace_embeddings", sql="select vec_id, label, round(embedding[1]::double, 6) as v0 from embeddings "
          "where label <> 0 union all select vec_id, 100, round(list_reverse(embedding)[1]::double, 6) from embeddings "
          "where label = 0")
def replace_embeddings(spark, sf):
    """One vector per profile; re-embedded profiles replace theirs."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("profile_id"), "label", "embedding")
    batch = e.where(F.col("label") == 0).select("profile_id", F.lit(100).alias("label"),
                                                F.reverse("embedding").alias("embedding"))
    out = U.replace_children(e, batch, batch.select("profile_id"))
    return out.select(F.col("profile_id").alias("vec_id"), "label",
                      F.round(F.element_at("embedding", 1).cast("double"), 6).alias("v0"))


@register("group_concat_distinct", sql="select o_custkey as id, list_sort(list(distinct o_orderpriority)) as priorities, "
          "list_sort(list(distinct year(o_orderdate))) as years from orders group by 1")
def group_concat_distinct(spark, sf):
    """A3: distinct child values per profile, pre-aggregated (no fan-out)."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"),
        F.array_sort(F.collect_set(F.year("o_orderdate").cast("long"))).alias("years"))


@register("listagg_distinct", sql="select o_custkey as id, string_agg(distinct o_orderpriority, ',' order by "
          "o_orderpriority) as priorities from orders group by 1")
def listagg_distinct(spark, sf):
    """A3 string form: distinct values joined in sorted order."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


def export_nested_df(profiles, facets, educations, kinds=("practice", "industry", "region", "language")):
    """Profile + nested children.  The long facet table is aggregated
    once (one conditional ``collect_set`` per facet kind, partial aggregation
    before the shuffle), education structs once, then two left joins: no
    cross-child fan-out and one shuffle per child table."""
    sets = [F.array_sort(F.collect_set(F.when(F.col("facet") == f, F.col("value")))).alias(f + "s") for f in kinds]
    fa = facets.where(F.col("facet").isin(*kinds)).groupBy(F.col("profile_id").alias("id")).agg(*sets)
    fa = fa.select("id", *[F.when(F.size(f + "s") > 0, F.col(f + "s")).alias(f + "s") for f in kinds])
    edu = educations.groupBy(F.col("profile_id").alias("id")).agg(F.array_sort(F.collect_set(
        F.struct(F.col("year").cast("long").alias("year"), "school_name", "school_normalized"))).alias("educations"))
    return profiles.join(fa, "id", "left").join(edu, "id", "left")


@register("export_nested", sql=f"with {S.EDUCATIONS_SQL}, "
          + ", ".join(f"{f} as (select profile_id as id, list_sort(list(distinct value)) as {f}s from ({S.FACET_SQL[f]}) "
                      "group by 1)" for f in ("practice", "industry", "region", "language"))
          + ", edu as (select profile_id as id, list_sort(list(distinct year || '|' || school_name || '|' || "
          "school_normalized)) as educations from educations group by 1) "
          "select c_custkey as id, 'cust/' || c_custkey as url, c_name as name, c_mktsegment as title, practices, "
          "industrys, regions, languages, educations from customer "
          "left join practice on practice.id = c_custkey left join industry on industry.id = c_custkey "
          "left join region on region.id = c_custkey left join language on language.id = c_custkey "
          "left join edu on edu.id = c_custkey")
def export_nested(spark, sf):
    """Nested export (arrays of values and of education structs per profile)."""
    prof = S.customer_profiles(spark, sf).select("id", "url", "name", "title")
    out = export_nested_df(prof, S.facets(spark, sf), S.educations(spark, sf))
    # struct elements rendered as 'year|school|normalized' for an engine-neutral comparison
    flat = F.array_sort(F.transform("educations", lambda e: F.concat_ws("|", e["year"].cast("string"),
                                                                        e["school_name"], e["school_normalized"])))
    return out.withColumn("educations", flat)


def _page_errors(spark, sf):
    p = table(spark, sf, "pages")
    n = F.size(clean_lines(LN.html_to_text("html")))
    err = (F.when(~F.col("html").contains("<body"), F.lit("no body")).when(n < 5, F.lit("too few lines"))
           .when(F.col("url").contains("spam"), F.lit("blocked host")))
    return p.select("page_id", "url", err.alias("error"))


@register("dead_letter", sql="select page_id, url, error from (select page_id, url, case when not contains(html, '<body') "
          "then 'no body' when len(list_filter(list_transform(string_split(text, chr(10)), lambda x: "
          f"{strip_sql('x')}), lambda x: x <> '')) < 5 then 'too few lines' when contains(url, 'spam') then 'blocked host' "
          f"end as error from (select p.page_id, p.url, p.html, h.text from pages p join {HTML_SQL} h using (page_id))) "
          "where error is not null")
def dead_letter(spark, sf):
    """Rows that failed go to the dead-letter output, the rest continue."""
    return _page_errors(spark, sf).where(F.col("error").isNotNull())


@register("anti_existing", sql="select page_id, url from pages p where not exists (select 1 from pages b where "
          "contains(b.html, 'lang=\"en\"') and b.url = p.url)")
def anti_existing(spark, sf):
    """Pages whose URL is not stored yet (stored = the English pages)."""
    p = table(spark, sf, "pages")
    existing = p.where(F.col("html").contains('lang="en"')).select("url")
    return I.skip_existing(p, existing).select("page_id", "url")


@register("parse_profiles")
def parse_profiles(spark, sf):
    """Lifecycle C: full page -> profile parse with the default lexicon (rows-only)."""
    return I.parse_pages(table(spark, sf, "pages")).profiles


_N_LINES_SQL = ("(select page_id, url, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + strip_sql("x")
                + f"), lambda x: x <> '')) as n from {HTML_SQL})")


def composed_pages(spark, sf):
    """The pages, of which each fifth is empty and each fifth is a short profile with an experience section."""
    kind = F.col("page_id") % 5
    body = F.concat(F.lit("<html><body><p>Experience</p><p>Represented the owners of "), "url", F.lit(" in three courts over many years.</p></body></html>"))
    return table(spark, sf, "pages").withColumn("html", F.when(kind == 0, "<html><body></body></html>").when(kind == 1, body).otherwise(F.col("html")))


@register("ingest_stats", sql="with old as (select distinct url from pages where contains(html, 'lang=\"en\"')), "
          "new as (select page_id, url, case page_id % 5 when 0 then 0 when 1 then 2 else n end as n "
          f"from {_N_LINES_SQL} where url not in (select url from old)) "
          "select 'seen' as metric, count(*) as value from pages union all select 'skipped', count(*) from pages where url in (select url from old) "
          "union all select 'processed', count(*) from new where n > 0 union all select 'errors', count(*) from new where n = 0 "
          "union all select 'with_experience', count(*) from new where page_id % 5 = 1")
def ingest_stats(spark, sf):
    """A5: run counters of a batch ingest, counted while its one parse runs."""
    existing = table(spark, sf, "pages").where(F.col("html").contains('lang="en"')).select("url")
    path = os.path.join(shared_dir(spark), f"ingest-{uuid.uuid4().hex}")
    return I.ingest_pages(composed_pages(spark, sf), path, existing)[1]


@register("raw_archive", sql=f"select p.url, p.html as raw_html from pages p join {_N_LINES_SQL} l using (page_id) where l.n > 0")
def raw_archive(spark, sf):
    """Profiles with the raw page kept (Parquet compresses it)."""
    return I.parse_pages(table(spark, sf, "pages"), keep_raw=True).profiles.select("url", "raw_html")


@register("stream_ingest", sql=f"with last as (select url, max(page_id) as page_id from pages group by url) "
          f"select h.url, lower(nullif(regexp_extract(h.text, {sql_str('[a-zA-Z0-9._%+-]+@' + STREAM_DOMAIN)}, 0), '')) as email, "
          f"1::bigint as first_epoch, 2::bigint as epoch from {HTML_SQL} h join last using (page_id) "
          f"where len(list_filter(list_transform(string_split(h.text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')) > 0")
def stream_ingest(spark, sf):
    """ST1: pages through Structured Streaming, then the same pages again, forced, as a second epoch; pages of one
    URL are one profile."""
    from dirsearch.streaming.ingest_stream import apply_batch, read_table, start_ingest

    root = os.path.join(shared_dir(spark), f"stream-ingest-{uuid.uuid4().hex}")
    pages = table(spark, sf, "pages")
    lex = I.Lexicon(email_domain=STREAM_DOMAIN)
    q = start_ingest(spark, os.path.join(sf, "pages*.parquet"), pages.schema, root, lex=lex)
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    apply_batch(spark, pages, root, last + 1, lex, force=True)
    out = read_table(spark, root, "profiles")
    return out.select("url", "email", (F.col("first_epoch") + 1).cast("long").alias("first_epoch"),
                      (F.col("epoch") - last + 1).cast("long").alias("epoch"))


@register("index_refresh", sql="with np as (select p_partkey as id, case when p_size > 40 then p_name || ' v2' "
          "else p_name end as name from part where p_size >= 3), "
          "t as (select id, list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ts from np) "
          "select unnest(ts) as token, id as profile_id, generate_subscripts(ts, 1) - 1 as pos from t")
def index_refresh(spark, sf):
    """ST2: token index kept in step with renamed and deleted profiles."""
    parts = S.part_profiles(spark, sf)
    idx = U.name_index(parts)
    p = table(spark, sf, "part")
    changed = p.where(F.col("p_size") > 40).select(F.col("p_partkey").alias("id"),
                                                   F.concat(F.col("p_name"), F.lit(" v2")).alias("name"))
    deleted = p.where(F.col("p_size") < 3).select(F.col("p_partkey").alias("id"))
    out = U.refresh_index(idx, changed, deleted)
    return out.select("token", "profile_id", F.col("pos").cast("long").alias("pos"))


@register("embed_documents")
def embed_documents(spark, sf):
    """V6: embed every document with the default offline embedder (rows-only)."""
    return E.embed_texts(table(spark, sf, "documents"), "doc_id", "text")


_CLEAN_SQL = f"(select doc_id, {strip_sql('regexp_replace(text, ' + sql_str('[' + chr(10) + chr(9) + ']') + ', ' + sql_str(' ') + ', ' + sql_str('g') + ')')} as t from documents)"
FEATURES_SQL = ("fe as (select doc_id, unnest(list_distinct(list_transform(list_filter(string_split_regex(lower(t), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), "
                f"lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 256))) as feature from {_CLEAN_SQL} where t <> '')")


@register("embed_counts", sql=f"with {FEATURES_SQL} select feature::int as feature, count(*) as df from fe group by 1 "
          f"union all select -1, count(*) from {_CLEAN_SQL} where t <> ''")
def embed_counts(spark, sf):
    """V6: document counts by feature, of two batches added."""
    d = table(spark, sf, "documents")
    batches = [d.where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    return E.merged_counts(*[E.feature_counts(b, "text") for b in batches])


@register("embed_invariants", sql=f"with {FEATURES_SQL}, c as (select feature, count(*) as df from fe group by 1), "
          f"x as (select doc_id, count(*) as nnz from fe join c using (feature) where c.df < (select count(*) from {_CLEAN_SQL} where t <> '') group by 1) "
          f"select d.doc_id as id, 256::bigint as dim, coalesce(x.nnz, 0) as nnz, (x.nnz is not null)::int::double as length from {_CLEAN_SQL} d left join x using (doc_id) where t <> ''")
def embed_invariants(spark, sf):
    """V6: dimensions, filled features and length of every document's vector, embedded in two batches with counts of both."""
    d = table(spark, sf, "documents")
    batches = [d.where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    counts = E.merged_counts(*[E.feature_counts(b, "text") for b in batches])
    rows = E.embed_hashed(batches[0], counts, "doc_id", "text").unionAll(E.embed_hashed(batches[1], counts, "doc_id", "text"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return rows.select("id", F.size("embedding").cast("long").alias("dim"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nnz"),
                       F.round(length, 3).alias("length"))


@register("facet_strip_check", sql=f"select doc_id, {strip_sql('source')} as source from documents")
def facet_strip_check(spark, sf):
    """Scalar: Python-style strip of a text column."""
    return table(spark, sf, "documents").select("doc_id", strip("source").alias("source"))
