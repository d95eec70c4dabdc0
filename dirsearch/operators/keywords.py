"""Keyword extraction and the keyword pre-filter of the retrieval cascade.

All per-query decisions of the original (how many keywords, how strict the
filter, whether to fall back to the first candidates) are columns here, so a
whole table of queries runs as one plan with no driver-side branching.
Per-query survivor counts are a window over ``query_id`` when candidate
lists are bounded by a top-k step, else a grouped aggregate joined back
(partial aggregation before the shuffle), so one query with a huge candidate
list never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import col_of, py_regex, strip, words_in_text
from dirsearch.operators.postings import Postings

DEFAULT_COMPANY = [(py_regex("(?i)" + p), 0) for p in L.COMPANY_PATTERNS]
DEFAULT_CAPITALISED = (py_regex(L.CAPITALISED_ENTITY), 1)


def extract_keywords(query: Column | str, *, companies: Sequence[tuple[str, int]] = DEFAULT_COMPANY,
                     industry: Sequence[str] = L.INDUSTRY_KEYWORDS, quoted: str = L.QUOTED_PHRASE,
                     capitalised: tuple[str, int] | None = DEFAULT_CAPITALISED) -> Column:
    """V7: sorted distinct lower-case keywords of a query text."""
    q = col_of(query)
    parts = [F.transform(F.regexp_extract_all(q, F.lit(p), g), lambda x: F.lower(x)) for p, g in companies]
    low = F.lower(q)
    parts.append(F.filter(F.array(*[F.lit(k) for k in industry]), lambda k: F.instr(low, k) > 0))
    parts.append(F.transform(F.regexp_extract_all(q, F.lit(quoted), 1), lambda x: strip(F.lower(x))))
    if capitalised is not None:
        p, g = capitalised
        parts.append(F.transform(F.regexp_extract_all(q, F.lit(p), g), lambda x: F.lower(x)))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def match_count(text: Column | str, keywords: Column | str) -> Column:
    """A4: number of keywords occurring (substring) in the lower-cased text."""
    return F.size(words_in_text(text, keywords)).cast("long")


def pool_size(n_keywords: Column, many: int = L.POOL_K_MANY, some: int = L.POOL_K_SOME,
              none: int = L.POOL_K_NONE, strict_at: int = L.STRICT_KEYWORDS) -> Column:
    """T5: candidate pool k from the keyword count."""
    return F.when(n_keywords >= strict_at, F.lit(many)).when(n_keywords >= 1, F.lit(some)).otherwise(F.lit(none))


def keyword_filter(candidates: DataFrame, keywords: DataFrame, texts: DataFrame | Postings, min_matches: int = 0) -> DataFrame:
    """V8: candidates ``(query_id, id, rank)`` kept when the query has no
    keywords, the candidate has no stored text, or enough keywords match.

    ``keywords`` is ``(query_id, keywords array)``, ``texts`` is ``(id, text)``.
    """
    j = _scored(candidates, keywords, texts)
    need = F.lit(1) if min_matches == 0 else F.lit(min_matches)
    keep = (F.size("keywords") == 0) | F.col("missing") | (F.col("matches") >= need)
    return j.where(keep)


def keyword_hits(pairs: DataFrame, texts: DataFrame | Postings) -> DataFrame:
    """Keyword hits per candidate document, each (document, keyword) tested once.

    ``pairs`` holds ``(id, keywords)`` for every (query, candidate) pair.  The
    distinct keywords of a document are gathered first (partial aggregation),
    so the text store is joined once and each text lower-cased once, however
    many queries share it.  Returns ``(id, found)`` for documents with a text.
    With :class:`~dirsearch.operators.postings.Postings` of the texts in their
    place no text is read.
    """
    if isinstance(texts, Postings):
        return texts.hits(pairs)
    need = (pairs.select("id", F.explode_outer("keywords").alias("kw"))
            .groupBy("id").agg(F.collect_set("kw").alias("kws")))
    return texts.select("id", "text").where(F.col("text").isNotNull()).join(need, "id") \
        .select("id", words_in_text("text", "kws").alias("found"))


def _scored(candidates: DataFrame, keywords: DataFrame, texts: DataFrame | Postings) -> DataFrame:
    """candidates with ``keywords``, ``missing`` (no text), ``matches`` and ``hits`` (null when missing)."""
    j = (candidates.join(keywords, "query_id", "left")
         .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))))
    j = j.join(keyword_hits(j.select("id", "keywords"), texts), "id", "left")
    # a document's hits of all its queries shrink to the query's own before anything is shuffled again
    own = F.when(F.col("found").isNotNull(), F.array_intersect("keywords", "found"))
    return (j.withColumn("hits", own).drop("found")
            .withColumn("missing", F.col("hits").isNull())
            .withColumn("matches", F.coalesce(F.size("hits"), F.lit(0)).cast("long")))


def smart_filter(candidates: DataFrame, keywords: DataFrame, texts: DataFrame | Postings,
                 strict_at: int = L.STRICT_KEYWORDS, strict_hits: int = L.STRICT_HITS,
                 relax_below: int = L.RELAX_BELOW, fallback_top: int = L.FALLBACK_TOP,
                 bounded: bool = False) -> DataFrame:
    """V9 (+W8, T4): adaptive keyword filter for every query at once.

    >= ``strict_at`` keywords: keep candidates with >= ``strict_hits`` matches,
    relaxed to 1 match when fewer than ``relax_below`` survive; 1..strict_at-1
    keywords: >= 1 match; no keywords: keep all.  Candidates without stored
    text always pass.  If nothing survives, the first ``fallback_top`` by rank.

    ``bounded=True`` says each query has at most k candidates (they come from
    a top-k step): survivor counts are then a window over ``query_id``, which
    follows the top-k window's partitioning and reads the candidates once.
    Otherwise the counts are a grouped aggregate joined back (safe for one
    query with an unbounded candidate list).
    """
    from pyspark.sql import Window

    j = _scored(candidates, keywords, texts)
    strict = F.col("missing") | (F.col("matches") >= strict_hits)
    loose = F.col("missing") | (F.col("matches") >= 1)
    if bounded:
        w = Window.partitionBy("query_id")
        j = (j.withColumn("n_strict", F.count_if(strict).over(w)).withColumn("n_loose", F.count_if(loose).over(w))
             .withColumn("n_kw", F.max(F.size("keywords")).over(w)))
    else:
        counts = (j.groupBy("query_id")
                  .agg(F.count_if(strict).alias("n_strict"), F.count_if(loose).alias("n_loose"),
                       F.max(F.size("keywords")).alias("n_kw")))
        j = j.join(counts, "query_id")
    nkw = F.col("n_kw")
    rule = (F.when(nkw >= strict_at, F.when(F.col("n_strict") >= relax_below, strict).otherwise(loose))
            .when(nkw >= 1, loose).otherwise(F.lit(True)))
    survivors = (F.when(nkw >= strict_at, F.when(F.col("n_strict") >= relax_below, F.col("n_strict"))
                        .otherwise(F.col("n_loose")))
                 .when(nkw >= 1, F.col("n_loose")).otherwise(F.lit(1)))
    keep = F.when(survivors > 0, rule).otherwise(F.col("rank") <= fallback_top)
    return j.where(keep).drop("n_strict", "n_loose", "n_kw")
