"""Hits and their strangers (F5 of FINDINGS_r03.md), on rows of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirsearch.operators import keywords as K
from dirsearch.plans import cascade as C
from dirsearch.suite.retrieval import with_strangers


def test_hits_with_strangers_are_filtered_without_broadcasts(spark):
    """a union of the hits and their strangers failed in a sort merge join ("Can't zip RDDs")."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(40)], "query_id long, embedding array<double>")
        corpus = spark.createDataFrame([(i, [1.0, float(i % 5)]) for i in range(30)], "id long, embedding array<double>")
        keywords = queries.select("query_id", F.array(F.lit("a"), F.lit("b")).alias("keywords"))
        texts = corpus.select("id", F.when(F.col("id") % 2 == 0, "A b").otherwise("a").alias("text"))
        hits = C.candidates(queries, corpus, keywords, k_max=5)
        got = K.keyword_filter(with_strangers(hits), keywords, texts, min_matches=2).select("query_id", "id", "rank", "missing").collect()
        want = {(r.query_id, r.id + add, r["rank"], bool(add)) for r in hits.collect() for add in (0, 1_000_000_000) if add or r.id % 2 == 0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
