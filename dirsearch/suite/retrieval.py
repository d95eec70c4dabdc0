"""Retrieval-cascade keys.

Stand-ins: every user turn of ``conversations`` is a query (id conv_id*1000+turn)
whose vector is the embedding with vec_id = conv_id; ``embeddings`` is the
profile-vector corpus, ``documents`` (doc_id = vec_id) the stored profile
text, ``customer`` (c_custkey = vec_id) the profile rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import strip
from dirsearch.operators import judge as J
from dirsearch.operators import keywords as K
from dirsearch.operators.knn import knn_exact
from dirsearch.operators.postings import write_postings
from dirsearch.plans import cascade as C
from dirsearch.session import shared_dir, written
from dirsearch.suite.pages import WS_SQL, strip_sql
from dirsearch.suite.registry import register, sql_list, sql_str, table

INDUSTRY = ["the", "tion", "ing", "und", "que"]
CAP_RE = r"(^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)([^\p{L}\p{N}_]|$)"
KW_OPTS = dict(companies=[], industry=INDUSTRY, capitalised=(CAP_RE, 2))


def queries(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return (c.join(e, c.conv_id == e.vec_id)
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"),
                    "embedding"))


def corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def profiles(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    F.concat(F.lit("cust/"), F.col("c_custkey").cast("string")).alias("url"))


def keywords(spark, sf):
    return queries(spark, sf).select("query_id", K.extract_keywords("query", **KW_OPTS).alias("keywords"))


Q_SQL = ("queries as (select c.conv_id * 1000 + c.turn as query_id, c.text as query, e.embedding "
         "from conversations c join embeddings e on e.vec_id = c.conv_id where c.role = 'user')")
KW_SQL = ("kw as (select query_id, list_sort(list_distinct(list_concat(list_concat("
          f"list_filter({sql_list(INDUSTRY)}, lambda k: instr(lower(query), k) > 0), "
          f"list_transform(regexp_extract_all(query, {sql_str(L.QUOTED_PHRASE)}, 1), lambda x: trim(lower(x), {WS_SQL}))), "
          f"list_transform(regexp_extract_all(query, {sql_str(CAP_RE)}, 2), lambda x: lower(x))))) as keywords "
          "from queries)")


def hits_sql(kmax: int) -> str:
    cos = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"
    return (f"hits as (select * from (select q.query_id, e.vec_id as id, {cos} as score, row_number() over "
            f"(partition by q.query_id order by {cos} desc, e.vec_id) as rank from queries q, embeddings e) "
            f"where rank <= {kmax})")


CAND_SQL = ("cand as (select h.* from hits h join kw using (query_id) where h.rank <= case when len(kw.keywords) >= 3 "
            "then 30 when len(kw.keywords) >= 1 then 40 else 50 end)")
TEXTS_SQL = "texts as (select doc_id as id, text from documents)"
SC_SQL = ("sc as (select c.*, k.keywords, t.text, t.text is null as missing, coalesce(len(list_filter(k.keywords, "
          "lambda w: instr(lower(t.text), w) > 0)), 0) as matches from cand c join kw k using (query_id) "
          "left join texts t using (id))")
STRANGERS_SQL = ("hx as (select query_id, id, rank, score from hits union all select query_id, id + 1000000000, rank, score from hits)")
SMART_SQL = ("cnt as (select query_id, count(*) filter (where missing or matches >= 2) as n_strict, "
             "count(*) filter (where missing or matches >= 1) as n_loose, max(len(keywords)) as n_kw from sc group by 1), "
             "kept as (select sc.* from sc join cnt using (query_id) where case when (case when n_kw >= 3 then "
             "(case when n_strict >= 5 then n_strict else n_loose end) when n_kw >= 1 then n_loose else 1 end) > 0 "
             "then (case when n_kw >= 3 then (case when n_strict >= 5 then missing or matches >= 2 else missing or "
             "matches >= 1 end) when n_kw >= 1 then missing or matches >= 1 else true end) else rank <= 20 end)")
_HITS = "list_filter(kept.keywords, lambda w: instr(lower(t.text), w) > 0)"
JUDGE_SQL = (f"jd as (select kept.query_id, kept.id, kept.rank, kept.score, case when t.text is null then false "
             f"when len(kept.keywords) = 0 then true else len({_HITS}) >= 1 end as passes, case when t.text is null "
             f"then 'Error: no profile text' else 'matched: ' || array_to_string({_HITS}, ', ') end as reasoning "
             "from kept left join texts t using (id))")
CASCADE_SQL = (f"with {Q_SQL}, {KW_SQL}, {hits_sql(50)}, {CAND_SQL}, {TEXTS_SQL}, {SC_SQL}, {SMART_SQL}, {JUDGE_SQL}, "
               "res as (select jd.query_id, row_number() over (partition by jd.query_id order by jd.rank) as result_no, "
               "jd.rank, jd.id, c.c_name as name, 'cust/' || c.c_custkey as url, round(jd.score, 6) as score, "
               "jd.passes, jd.reasoning from jd join customer c on c.c_custkey = jd.id where jd.passes) ")


@register("keyword_extract", sql=f"with {Q_SQL}, {KW_SQL} select query_id, keywords from kw")
def keyword_extract(spark, sf):
    """V7: keyword set of every query."""
    return keywords(spark, sf)


@register("keyword_match_count", sql="select doc_id, len(list_filter(['the', 'tion', 'ing', 'zzz'], "
          "lambda k: contains(lower(text), k))) as matches from documents")
def keyword_match_count(spark, sf):
    """A4: number of keywords present in every document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", K.match_count("text", F.array(*[F.lit(x) for x in ["the", "tion", "ing", "zzz"]]))
                    .alias("matches"))


def _cands(spark, sf):
    return C.candidates(queries(spark, sf), corpus(spark, sf), keywords(spark, sf), k_max=50)


@register("adaptive_k", sql=f"with {Q_SQL}, {KW_SQL}, {hits_sql(50)}, {CAND_SQL} "
          "select query_id, id, round(score, 6) as score, rank from cand")
def adaptive_k(spark, sf):
    """T5: per-query pool size from the keyword count, applied to exact top-k."""
    return _cands(spark, sf).select("query_id", "id", F.round("score", 6).alias("score"),
                                    F.col("rank").cast("long").alias("rank"))


@register("keyword_filter", sql=f"with {Q_SQL}, {KW_SQL}, {hits_sql(50)}, {CAND_SQL}, {TEXTS_SQL}, {SC_SQL} "
          "select query_id, id, rank, matches from sc where len(keywords) = 0 or missing or matches >= 1")
def keyword_filter(spark, sf):
    """V8: keep candidates with at least one keyword hit (or no keywords / no text)."""
    kept = K.keyword_filter(_cands(spark, sf), keywords(spark, sf), texts(spark, sf), min_matches=0)
    return kept.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "matches")


def with_strangers(hits):
    """Hits, and as many of ids that no other table holds."""
    return hits.select("query_id", F.explode(F.array(F.col("id"), F.col("id") + 1000000000)).alias("id"), "rank", "score")


@register("join_keep_missing", sql=f"with {Q_SQL}, {KW_SQL}, {hits_sql(50)}, {STRANGERS_SQL}, {CAND_SQL.replace('from hits h', 'from hx h')}, "
          + TEXTS_SQL + ", " + SC_SQL + " select query_id, id, rank, missing from sc where len(keywords) = 0 or missing or matches >= 2")
def join_keep_missing(spark, sf):
    """Candidates without stored text are kept (half of the candidates have none)."""
    kept = K.keyword_filter(with_strangers(_cands(spark, sf)), keywords(spark, sf), texts(spark, sf), min_matches=2)
    return kept.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "missing")


@register("smart_filter", sql=f"with {Q_SQL}, {KW_SQL}, {hits_sql(50)}, {CAND_SQL}, {TEXTS_SQL}, {SC_SQL}, {SMART_SQL} "
          "select query_id, id, rank from kept")
def smart_filter(spark, sf):
    """Adaptive keyword filter for every query (candidate lists are top-k, so bounded)."""
    kept = K.smart_filter(_cands(spark, sf), keywords(spark, sf), texts(spark, sf), bounded=True)
    return kept.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@register("smart_filter_postings", sql=f"with {Q_SQL}, {KW_SQL}, {hits_sql(50)}, {CAND_SQL}, {TEXTS_SQL}, {SC_SQL}, {SMART_SQL} "
          "select query_id, id, rank, matches from kept")
def smart_filter_postings(spark, sf):
    """V8/V9 against the gram postings of the stored texts; the filter reads no text."""
    index = write_postings(texts(spark, sf), os.path.join(shared_dir(spark), f"postings-{uuid.uuid4().hex}"))
    cand = written(_cands(spark, sf), "postings-candidates")  # read by the postings' plan and by the filter
    kept = K.smart_filter(cand, keywords(spark, sf), index, bounded=True)
    return kept.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "matches")


@register("judge_default", sql=f"with {Q_SQL}, {KW_SQL}, {hits_sql(50)}, {CAND_SQL}, {TEXTS_SQL}, {SC_SQL}, "
          f"{SMART_SQL}, {JUDGE_SQL} select query_id, id, passes, reasoning from jd")
def judge_default(spark, sf):
    """Default judge over the filtered candidates of every query."""
    kept = K.smart_filter(_cands(spark, sf), keywords(spark, sf), texts(spark, sf), bounded=True)
    return J.default_judge(kept)


@register("cascade", sql=CASCADE_SQL + "select * from res")
def cascade(spark, sf):
    """V12 flagship: the whole complex-query path for every query."""
    out = C.cascade(queries(spark, sf), corpus(spark, sf), texts(spark, sf), profiles(spark, sf),
                    keyword_options=KW_OPTS)
    return out.withColumn("score", F.round("score", 6))


@register("ranked_output", sql=CASCADE_SQL + "select query_id, result_no, id from res")
def ranked_output(spark, sf):
    """1-based numbering of each query's final results."""
    return cascade(spark, sf).select("query_id", "result_no", "id")


def _hits10(spark, sf):
    return knn_exact(corpus(spark, sf), queries(spark, sf), 10, id_col="id", query_id_col="query_id")


@register("join_hydrate", sql=f"with {Q_SQL}, {hits_sql(10)}, {STRANGERS_SQL} select h.query_id, h.rank, h.id, c.c_name as name "
          "from hx h join customer c on c.c_custkey = h.id")
def join_hydrate(spark, sf):
    """Hits joined to profile rows; ids without a profile (half of them here) are dropped."""
    return with_strangers(_hits10(spark, sf)).join(profiles(spark, sf).select("id", "name"), "id").select("query_id", F.col("rank").cast("long").alias("rank"), "id", "name")


@register("join_embed_profiles", sql="select c_custkey as id, c_name as name, len(embedding) as dim "
          "from embeddings join customer on c_custkey = vec_id")
def join_embed_profiles(spark, sf):
    """Embeddings joined to their profiles."""
    e = table(spark, sf, "embeddings")
    return (e.join(profiles(spark, sf), e.vec_id == F.col("id"))
            .select("id", "name", F.size("embedding").cast("long").alias("dim")))


@register("explain_hits", sql=f"with {Q_SQL}, {hits_sql(5)}, {STRANGERS_SQL} select h.query_id, h.rank, h.id, c.c_name as name, "
          "round(h.score, 4) as score, 'cust/' || c.c_custkey as url, coalesce(case when length(d.text) > 200 then "
          "left(d.text, 200) || '...' else d.text end, 'No experience data') as preview from hx h "
          "left join customer c on c.c_custkey = h.id left join documents d on d.doc_id = h.id")
def explain_hits(spark, sf):
    """Top-5 per query with name, score, url and experience preview; half of the hits have none of these."""
    exp = texts(spark, sf).withColumnRenamed("text", "content")
    hits = knn_exact(corpus(spark, sf), queries(spark, sf), 5, id_col="id", query_id_col="query_id")
    return C.explain_hits(with_strangers(hits), profiles(spark, sf), exp, n=5)


@register("hybrid_rank", sql=f"with {Q_SQL}, {KW_SQL}, {hits_sql(10)}, {TEXTS_SQL}, "
          "b as (select h.query_id, h.id, h.score, 0.7 * h.score + 0.3 * case when len(kw.keywords) = 0 then 0.0 else "
          "coalesce(len(list_filter(kw.keywords, lambda w: instr(lower(t.text), w) > 0)), 0)::double / len(kw.keywords) "
          "end as hybrid from hits h left join kw using (query_id) left join texts t using (id)) "
          "select query_id, id, round(score, 6) as score, round(hybrid, 6) as hybrid, row_number() over (partition by "
          "query_id order by hybrid desc, id) as hybrid_rank from b")
def hybrid_rank(spark, sf):
    """Cosine blended with keyword coverage, re-ranked."""
    out = C.hybrid_rank(_hits10(spark, sf), keywords(spark, sf), texts(spark, sf), 0.7)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.round("hybrid", 6).alias("hybrid"),
                      "hybrid_rank")


@register("judge_parse", sql="select conv_id, turn, coalesce(regexp_matches(r, '(?s)<answer>.*?</answer>') and "
          f"lower({strip_sql('regexp_extract(r, ' + sql_str('(?s)<answer>(.*?)</answer>') + ', 1)')}) = 'pass', "
          f"false) as passes, {strip_sql('regexp_extract(r, ' + sql_str('(?s)<thinking>(.*?)</thinking>') + ', 1)')} "
          "as reasoning from (select conv_id, turn, '<thinking> ' || text || ' </thinking><answer> ' || case when "
          "length(text) > 300 then 'PASS' when length(text) > 100 then 'Fail' else 'maybe' end || ' </answer>' as r "
          "from conversations where role = 'assistant')")
def judge_parse(spark, sf):
    """pass/fail and reasoning parsed from tagged judge responses."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    verdict = (F.when(F.length("text") > 300, "PASS").when(F.length("text") > 100, "Fail").otherwise("maybe"))
    r = F.concat(F.lit("<thinking> "), F.col("text"), F.lit(" </thinking><answer> "), verdict, F.lit(" </answer>"))
    p = J.parse_response(r)
    return c.select("conv_id", "turn", p["passes"].alias("passes"), p["reasoning"].alias("reasoning"))


@register("embed_clean", sql=f"select doc_id, t as clean from (select doc_id, {strip_sql('regexp_replace(text, ' + sql_str('[' + chr(10) + chr(9) + ']') + ', ' + sql_str(' ') + ', ' + sql_str('g') + ')')} "
          "as t from documents) where t <> ''")
def embed_clean(spark, sf):
    """V5: text prepared for embedding (newlines/tabs to spaces, stripped, empty dropped), ids kept."""
    d = table(spark, sf, "documents")
    t = strip(F.regexp_replace("text", "[\n\t]", " "))
    return d.select("doc_id", t.alias("clean")).where(F.col("clean") != "")


@register("embed_coverage", sql="select count(*) as n_embeddings, count(*) > 0 as has_embeddings from embeddings "
          "where embedding is not null")
def embed_coverage(spark, sf):
    """A2: how many profiles have vectors (the cascade's pre-check)."""
    e = table(spark, sf, "embeddings").where(F.col("embedding").isNotNull())
    return e.agg(F.count("*").alias("n_embeddings")).withColumn("has_embeddings", F.col("n_embeddings") > 0)


def word_judge(pdf):
    """A caller-style Python judge: pass when 'the' occurs in the text."""
    import pandas as pd

    low = pdf["text"].fillna("").str.lower()
    ok = low.str.contains("the", regex=False) & pdf["text"].notna()
    return pd.DataFrame({"passes": ok, "reasoning": ok.map({True: "python judge: pass", False: "python judge: fail"})})


@register("cascade_python_judge", sql=f"with {Q_SQL}, {KW_SQL}, {hits_sql(50)}, {CAND_SQL}, {TEXTS_SQL}, {SC_SQL}, "
          f"{SMART_SQL} select kept.query_id, kept.rank, kept.id, 'python judge: pass' as reasoning "
          "from kept join texts t using (id) join customer c on c.c_custkey = kept.id "
          "where contains(lower(t.text), 'the')")
def cascade_python_judge(spark, sf):
    """V10 pluggable judge: the cascade with a Python judge run through mapInPandas."""
    out = C.cascade(queries(spark, sf), corpus(spark, sf), texts(spark, sf), profiles(spark, sf),
                    keyword_options=KW_OPTS, judge=word_judge)
    return out.select("query_id", "rank", "id", "reasoning")
