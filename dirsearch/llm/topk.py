"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are dealt into blocks and queries into tiles.  A block keeps postings: for each term the numbers of the
candidates whose component is not 0, and these components.  A tile works through its terms one at a time and scatters
each query's weight times the postings into a dense array of scores (queries by candidates).  Each query then selects
its k best of the block by partition, and a ranking over blocks merges them.  Every candidate is scored.

Defined results: vectors that are null, empty of components or hold null or non-finite ones take no part; vectors of
different lengths agree on the shorter length's terms, the rest counts as 0; ties go to the smaller id; null ids take no
part; rows that repeat an id are candidates each.  Components are floor(1024 * x) and products add up exactly: in 64 bits
where a bound on the block's sums allows it, else in whole numbers of any size.  Components beyond 64 bits count as the
outermost 64-bit number, and so do scores (the least is -(2**63 - 1)).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dirsearch.llm.registry import register, table
from dirsearch.llm.store import written

SCALE = 1024
LARGEST = (1 << 63) - 1
BLOCK_VALUES = 1 << 20  # components of a candidate block
TILE_VALUES = 1 << 17  # components of a query tile
K = 10


def quantised(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): the usable vectors as whole numbers."""
    x = F.col(f"`{vector}`").cast("array<double>")
    usable = F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(F.lit(SCALE) * c).cast("long"))
    return vectors.where(usable).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _most(m: np.ndarray) -> int:
    """The largest size of a number of m, as a number that cannot overflow."""
    return max(int(m.max()), -int(m.min())) if m.size else 0


def best(queries: tuple[np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray], k: int) -> pd.DataFrame:
    """The k best candidates of a block for each query."""
    (qid, q), (cid, c) = queries, block
    exact = np.int64 if _most(q) * _most(c) * min(q.shape[1], c.shape[1]) <= LARGEST else object
    q, c = q.astype(exact, copy=False), c.astype(exact, copy=False)
    scores = np.zeros((len(qid), len(cid)), exact)
    for term in range(min(q.shape[1], c.shape[1])):
        posting = np.flatnonzero(c[:, term])
        weight = c[posting, term]
        asking = np.flatnonzero(q[:, term])
        dense = len(posting) == len(cid)
        for i in asking:
            if dense:
                scores[i] += q[i, term] * weight
            else:
                scores[i, posting] += q[i, term] * weight
    if exact is object:
        scores = np.clip(scores, -LARGEST, LARGEST).astype(np.int64)
    found = []
    for i, s in enumerate(scores):
        others = np.flatnonzero(cid != qid[i])
        s, ids = s[others], cid[others]
        if len(s) > k:
            least = s[np.argpartition(s, len(s) - k)[len(s) - k :]].min()
            near = np.flatnonzero(s >= least)  # ties at the last place stay until they are ranked by id
            s, ids = s[near], ids[near]
        order = np.lexsort((ids, -s))[:k]
        found.append(pd.DataFrame({"query_id": np.full(len(order), qid[i]), "vec_id": ids[order], "score": s[order]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for tables (vec_id, v) of whole-number vectors; a query is not its own candidate."""
    size = lambda df: df.agg(F.count("*"), F.sum(F.size("v"))).first()  # noqa: E731  two numbers
    (_, n_c), (_, n_q) = size(candidates), size(queries)
    blocks, tiles = -(-(n_c or 1) // BLOCK_VALUES), -(-(n_q or 1) // TILE_VALUES)
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.select("vec_id", "v", dealt(blocks, 1).alias("block")).withColumn("tile", span(tiles))
    q = queries.select("vec_id", "v", dealt(tiles, 2).alias("tile")).withColumn("block", span(blocks))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(left["v"].str.len().max(), right["v"].str.len().max())
        block = right["vec_id"].to_numpy(), _matrix(right["v"], width)
        step = max(1, (1 << 22) // len(right))  # queries at a time, so that the array of scores stays small
        return pd.concat([best((left["vec_id"].to_numpy()[i : i + step], _matrix(left["v"].iloc[i : i + step], width)), block, k)
                          for i in range(0, len(left), step)])

    scored = q.groupBy("block", "tile").cogroup(c.groupBy("block", "tile")).applyInPandas(score, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@register("op4_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
           where embedding is not null and len(embedding) > 0 and vec_id is not null
             and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
q as (select vec_id query_id, unnest(v) x, generate_subscripts(v, 1) i from v where vec_id % 100 = 0),
c as (select vec_id, unnest(v) x, generate_subscripts(v, 1) i from v),
s as (select query_id, vec_id, sum(q.x * c.x)::bigint score from q join c using (i) where query_id <> vec_id group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""")
def op4_exact_topk(spark, sf_dir):
    vectors = written(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "topk-vectors")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)
