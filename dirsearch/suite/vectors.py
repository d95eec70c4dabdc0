"""Vector search keys (V1-V4, T3, W7, J11) over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirsearch.operators import knn
from dirsearch.operators.vector_index import build_index
from dirsearch.suite.registry import register, table

_CENTROID_SQL = """
u as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings)"""


@register("cosine_pairs", sql=f"""
with {_CENTROID_SQL},
c as (select label, i, avg(x::double) as m from u group by label, i),
cv as (select label, list(m order by i) as centroid from c group by label)
select e.vec_id, e.label,
       round(list_cosine_similarity(e.embedding::double[], cv.centroid), 6) as score
from embeddings e join cv on e.label = cv.label
""")
def cosine_pairs(spark, sf):
    """V1: cosine of every vector with the centroid of its label."""
    emb = table(spark, sf, "embeddings")
    cents = knn.centroid(emb, "embedding", by=["label"])
    return (knn.cosine_to(emb.select("vec_id", "label", "embedding"), cents, ["label"], "embedding", "centroid")
            .select("vec_id", "label", F.round("score", 6).alias("score")))


@register("knn_single", sql=f"""
with {_CENTROID_SQL},
cv as (select list(m order by i) as q from (select i, avg(x::double) as m from u group by i)),
s as (select vec_id, list_cosine_similarity(embedding::double[], cv.q) as s from embeddings, cv)
select vec_id as id, round(s, 6) as score, row_number() over (order by s desc, vec_id) as rank
from s qualify rank <= 50
""")
def knn_single(spark, sf):
    """Top-50 for one query vector (the corpus centroid)."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = knn.centroid(emb, "embedding", out_col="embedding")
    return (knn.knn_single(emb, q, 50, id_col="vec_id")
            .select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")))


@register("knn_batch", sql="""
select * from (
  select q.vec_id as query_id, e.vec_id as id,
         round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score,
         row_number() over (partition by q.vec_id
                            order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) as rank
  from embeddings e, embeddings q)
where rank <= 10
""")
def knn_batch(spark, sf):
    """Top-10 neighbours of every vector, all vectors as queries."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = knn.knn_exact(emb, emb.withColumnRenamed("vec_id", "query_id"), 10, id_col="vec_id")
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("knn_tiled", sql="""
select * from (
  select q.vec_id as query_id, e.vec_id as id,
         round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score,
         row_number() over (partition by q.vec_id
                            order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) as rank
  from embeddings e, embeddings q)
where rank <= 10
""")
def knn_tiled(spark, sf):
    """V3 with block and tile counts given (corpus blocks x query tiles)."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = knn.knn_exact(emb, emb.withColumnRenamed("vec_id", "query_id"), 10, id_col="vec_id",
                        corpus_blocks=4, query_tiles=3)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


LSH_RECALL, LSH_SHARE = 0.95, 0.10


def changed(emb):
    """Queries: every vector, changed to a cosine of about 0.95."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")) / F.size("embedding"))
    sign = lambda i: F.pmod(F.xxhash64("vec_id", i), F.lit(2)) * 2 - 1
    return emb.select(F.col("vec_id").alias("query_id"), F.transform(
        "embedding", lambda x, i: x.cast("double") + F.lit(0.33) * size * sign(i)).alias("embedding"))


@register("knn_pivot", sql="""
select * from (
  select q.vec_id as query_id, e.vec_id as id,
         round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score,
         row_number() over (partition by q.vec_id
                            order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) as rank
  from embeddings e, embeddings q)
where rank <= 10
""")
def knn_pivot(spark, sf):
    """Exact top-10 of every vector through the index, blocks that cannot matter skipped."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = build_index(emb, id_col="vec_id").search(emb.withColumnRenamed("vec_id", "query_id"), 10).rows
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


IVF_RECALL, IVF_SHARE = 0.9, 0.75


@register("knn_ivf", sql="select count(*) as n_queries, true as recall_ok, true as share_ok from embeddings")
def knn_ivf(spark, sf):
    """V4: ordinary top-10 lists by the nearest inverted lists, measured against the exact ones.

    One row: the number of queries, whether the lists hold at least 0.9 of the exact neighbours, and whether at most
    three quarters of all pairs were scored.  (The test vectors have no clusters: half of all lists must be probed for
    0.9; vectors with clusters take far fewer.)
    """
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = emb.withColumnRenamed("vec_id", "query_id")
    found = build_index(emb, id_col="vec_id").search(queries, 10, recall=0.95)
    exact = knn.knn_exact(emb, queries, 10, id_col="vec_id")
    hits = exact.join(found.rows.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(
        F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    share = found.pairs.crossJoin(emb.agg(F.count("*").alias("n"))).select((F.col("pairs") / (F.col("n") * F.col("n"))).alias("share"))
    return hits.crossJoin(share).select("n_queries", (F.col("recall") >= IVF_RECALL).alias("recall_ok"), (F.col("share") <= IVF_SHARE).alias("share_ok"))


@register("knn_ivf_topk")
def knn_ivf_topk(spark, sf):
    """V4: the approximate top 10 of every vector themselves (rows-only: approximate)."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = build_index(emb, id_col="vec_id").search(emb.withColumnRenamed("vec_id", "query_id"), 10, recall=0.95).rows
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("knn_lsh", sql="select count(*) as n_queries, true as recall_ok, true as share_ok from embeddings")
def knn_lsh(spark, sf):
    """V4: every vector, changed to a cosine of about 0.95, finds its source among the approximate top 10.

    One row: whether the share of queries that find it is at least 0.95, and
    whether at most a tenth of all pairs were scored.
    """
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = changed(emb)
    found = knn.knn_lsh(emb, queries, 10, id_col="vec_id").where("query_id = id").agg(F.count("*").alias("n"))
    counts = [emb.agg(F.count("*").alias("n")), found, knn.lsh_pairs(emb, queries, id_col="vec_id").select(F.col("pairs").alias("n"))]
    rows = [df.select(F.lit(i).alias("i"), F.col("n").cast("long").alias("n")) for i, df in enumerate(counts)]
    total, hits, pairs = (F.max(F.when(F.col("i") == i, F.col("n"))) for i in range(3))
    return (rows[0].unionAll(rows[1]).unionAll(rows[2])
            .agg(total.alias("n_queries"), (hits >= LSH_RECALL * total).alias("recall_ok"),
                 (pairs <= LSH_SHARE * total * total).alias("share_ok")))


@register("knn_lsh_topk")
def knn_lsh_topk(spark, sf):
    """V4: the near neighbours of the changed vectors themselves (rows-only: approximate)."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = knn.knn_lsh(emb, changed(emb), 10, id_col="vec_id")
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
