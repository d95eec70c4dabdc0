"""Nearest-neighbour search over an embeddings table.

Exact search never forms the query x corpus pairs as rows and uses no cross
join.  The corpus is hashed into blocks and the queries into tiles; every
(block, tile) pair meets in one cogroup, like the tiles of a matrix product,
so memory per task is bounded by block and tile and neither table passes
through the driver.  Block and tile counts come from
``spark.sql.shuffle.partitions`` (or arguments) and, where that would make
them too large, from row counts inside the plan.

Only k rows per query per task leave Python; a ``row_number`` window (planned
as a partial ``WindowGroupLimit`` before its shuffle) makes the final cut with
ties broken by id.

Approximate search (``knn_lsh``) is for near neighbours: random projections
put unit vectors into buckets, and each bucket's queries are scored exactly
against its corpus vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dirsearch.functions.vector import cosine

_PARTIAL_SCHEMA = "query_id long, id long, score double"
TILE_BYTES, BLOCK_BYTES = 16 << 20, 32 << 20  # of vectors as doubles (and of the tile's k best) in a task
QUERY_CHUNK = 256
CORPUS_CHUNK = 4096


def _block_key(c: str, n: Column):
    return F.pmod(F.xxhash64(F.col(c)), n).cast("int")


def _pieces(df: DataFrame, vec: str, more: int, most: int, least: int) -> Column:
    """How many pieces of df hold at most ``most`` bytes each, a row being its vector in doubles and ``more`` bytes; ``least`` or more."""
    needed = F.ceil(F.count("*") * (8 * F.max(F.size(vec)) + more) / most)
    return F.greatest(F.lit(least), df.agg(needed.alias("n")).scalar()).cast("int")


def _stack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _reached(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a score that k entries or more reach, and few more: of the maxima of groups of columns the k-th best.

    With NaN among the scores it is the k-th best score itself.
    """
    n = scores.shape[1]
    width = n // (4 * k)
    if width < 2 or np.isnan(scores.max(initial=-np.inf)):
        return np.partition(scores, n - k, axis=1)[:, n - k]
    groups = n // width
    most = scores[:, :groups * width].reshape(len(scores), width, groups).max(axis=1)
    return np.partition(most, groups - k, axis=1)[:, groups - k]


def best_of_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best entries of each row (score desc, id asc).

    Only entries that reach a bound which at least k of the row reach are
    sorted, so ties at the cut are still broken by id.
    """
    if scores.shape[1] > k:
        row, col = np.nonzero(scores >= _reached(scores, k)[:, None])
    else:
        row, col = np.nonzero(np.isfinite(scores))
    keep = np.isfinite(scores[row, col])
    row, col = row[keep], col[keep]
    order = np.lexsort((ids[row, col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]


class Best:
    """Running exact top-k per query (score desc, id asc): two (n_queries x k) arrays, best first."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.s = np.full((len(qids), k), -np.inf)
        self.i = np.full((len(qids), k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, sc: np.ndarray) -> None:
        """Scores ``sc`` of the queries at places ``at`` against ``ids``."""
        most = sc.max(axis=1)
        can = ~(most < self.s[at, -1])
        full = can & np.isfinite(self.s[at, -1]) & np.isfinite(most)  # these take only what reaches their k-th best
        if full.any():
            self._more(at[full], ids, sc[full])
        can &= ~full
        if not can.any():
            return
        at, sc = at[can], sc[can]
        cat_s, cat_i = sc, np.broadcast_to(ids, sc.shape)
        if np.isfinite(self.s[at, 0]).any():
            cat_s, cat_i = np.concatenate([self.s[at], cat_s], axis=1), np.concatenate([self.i[at], cat_i], axis=1)
        row, col = best_of_rows(cat_s, cat_i, self.k)
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        s, i = np.full((len(at), self.k), -np.inf), np.full((len(at), self.k), np.iinfo(np.int64).max)
        s[row, place], i[row, place] = cat_s[row, col], cat_i[row, col]
        self.s[at], self.i[at] = s, i

    def _more(self, at: np.ndarray, ids: np.ndarray, sc: np.ndarray) -> None:
        """The same for queries that have k scores: what reaches the k-th joins them, and the k best stay."""
        new, col = np.nonzero(sc >= self.s[at, -1][:, None])
        row = np.concatenate([np.repeat(np.arange(len(at)), self.k), new])
        s, i = np.concatenate([self.s[at].ravel(), sc[new, col]]), np.concatenate([self.i[at].ravel(), ids[col]])
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < self.k
        self.s[at], self.i[at] = s[best].reshape(-1, self.k), i[best].reshape(-1, self.k)

    def frame(self) -> pd.DataFrame:
        keep = np.isfinite(self.s)
        rows = np.nonzero(keep)
        return pd.DataFrame({"query_id": self.qids[rows[0]], "id": self.i[keep], "score": self.s[keep]})


def _empty() -> pd.DataFrame:
    return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"),
                         "score": pd.Series([], dtype="float64")})


def _tile_topk(k: int):
    """cogroup function: one corpus block x one query tile -> k best per query."""

    def score(key, corpus: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(corpus) == 0 or len(queries) == 0:
            return _empty()
        best = Best(queries["query_id"].to_numpy(dtype=np.int64), k)
        q, ids, vecs = _unit(_stack(queries["qvec"])), corpus["id"].to_numpy(dtype=np.int64), corpus["vec"]
        for a in range(0, len(corpus), CORPUS_CHUNK):
            c = _unit(_stack(vecs.iloc[a:a + CORPUS_CHUNK]))
            for b in range(0, len(q), QUERY_CHUNK):  # the score matrix stays small
                part = np.arange(b, min(len(q), b + QUERY_CHUNK))
                best.add(part, ids[a:a + CORPUS_CHUNK], q[part] @ c.T)
        return best.frame()

    return score


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def knn_exact(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "embedding",
              query_id_col: str = "query_id", query_vec_col: str = "embedding", corpus_blocks: int | None = None,
              query_tiles: int | None = None) -> DataFrame:
    """Exact cosine top-k for every query row.

    Returns ``(query_id, id, score, rank)``; rank is 1-based, ties broken by id.
    Rows without a vector are skipped.  Corpus rows are copied to each query
    tile, query rows to each corpus block.  By default blocks x tiles is about
    the number of shuffle partitions, and more once a block or a tile would pass
    ``BLOCK_BYTES`` or ``TILE_BYTES`` (counted by the same plan).
    """
    spark = corpus.sparkSession
    parts = _partitions(spark)
    least = query_tiles or max(1, math.isqrt(parts))
    c = (corpus.where(F.col(vec_col).isNotNull())
         .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")))
    q = (queries.where(F.col(query_vec_col).isNotNull())
         .select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vec_col).alias("qvec")))
    tiles = F.lit(query_tiles) if query_tiles else _pieces(q, "qvec", 16 * k, TILE_BYTES, least)
    blocks = F.lit(corpus_blocks) if corpus_blocks else _pieces(c, "vec", 0, BLOCK_BYTES, max(1, -(-parts // least)))
    cb = (c.withColumn("blk", _block_key("id", blocks))
          .withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1))))
    qb = (q.withColumn("tile", _block_key("query_id", tiles))
          .withColumn("blk", F.explode(F.sequence(F.lit(0), blocks - 1))))
    partial = (cb.groupBy("blk", "tile").cogroup(qb.groupBy("blk", "tile"))
               .applyInPandas(_tile_topk(k), _PARTIAL_SCHEMA))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return (partial.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def knn_single(corpus: DataFrame, query_vector: DataFrame, k: int = 50, *, id_col: str = "id",
               vec_col: str = "embedding", query_vec_col: str = "embedding") -> DataFrame:
    """Top-k for one query vector given as a one-row DataFrame (``query_vec_col``)."""
    qv = query_vector.select(F.lit(0).cast("long").alias("query_id"), F.col(query_vec_col).alias("embedding"))
    return (knn_exact(corpus, qv, k, id_col=id_col, vec_col=vec_col, query_tiles=1)
            .select("id", "score", "rank"))


def centroid(df: DataFrame, vec_col: str = "embedding", by: list[str] | None = None,
             out_col: str = "centroid") -> DataFrame:
    """Element-wise mean vector (per group), one pass with map-side combine."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    g = df.where(F.col(vec_col).isNotNull())
    agg = Summarizer.mean(array_to_vector(F.col(vec_col)))
    out = g.groupBy(*(by or [])).agg(agg.alias("_m"))
    return out.select(*(by or []), vector_to_array("_m").alias(out_col))


def cosine_to(df: DataFrame, other: DataFrame, on: list[str], vec_col: str, other_vec_col: str,
              out_col: str = "score") -> DataFrame:
    """Join each row to its partner vector on ``on`` and score the pair."""
    return df.join(other, on=on, how="inner").withColumn(out_col, cosine(vec_col, other_vec_col))


# ---------------------------------------------------------------- approximate search
LSH_TABLES, LSH_HASHES, LSH_BLOCK_BYTES = 16, 8, 4 << 20
LSH_STEP_BYTES = 8 << 20  # of copied vectors in a frame that leaves a worker, and of scores at once


def _bucketed(df: DataFrame, tables: int, hashes: int, seed: int) -> DataFrame:
    """``(kind, key, vec)`` rows to one row per hash table with its bucket.

    A bucket is ``hashes`` random projections of the unit vector, each cut from a
    random offset into steps of twice the spread that projections of unit
    vectors have (with Gaussian directions: steps of 2, at any length); vectors meet in a table only when all of them agree.
    """

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        for f in frames:
            for dim, part in f.groupby(f["vec"].str.len()):
                step = max(1, LSH_STEP_BYTES // (8 * tables * int(dim)))
                for a in range(0, len(part), step):
                    yield dim, part.iloc[a:a + step]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, part in slices(frames):
            if dim not in made:
                rng = np.random.default_rng([seed, int(dim)])
                made[dim] = rng.normal(size=(int(dim), tables * hashes)), rng.random(tables * hashes)
            proj, offset = made[dim]
            step = np.floor(_unit(_stack(part["vec"])) @ proj / 2 + offset).astype(np.int64)
            bucket = np.zeros((len(part), tables), np.int64)
            with np.errstate(over="ignore"):
                for h in range(hashes):
                    bucket = bucket * np.int64(1_000_003) + step[:, h::hashes]
            yield pd.DataFrame({"kind": np.repeat(part["kind"].to_numpy(), tables), "key": np.repeat(part["key"].to_numpy(), tables),
                                "tbl": np.tile(np.arange(tables, dtype=np.int32), len(part)), "bkt": bucket.reshape(-1),
                                "vec": np.repeat(part["vec"].to_numpy(), tables)})

    return df.mapInPandas(run, "kind int, key long, tbl int, bkt long, vec array<double>")


def _score_buckets(k: int):
    """mapInPandas function over rows sorted by (tbl, bkt, csub, qsub): each group's queries against its corpus rows."""
    names = ["tbl", "bkt", "csub", "qsub"]

    def scored(f: pd.DataFrame) -> pd.DataFrame:
        group = f.groupby(names, sort=False).ngroup().to_numpy()
        cut = np.flatnonzero(np.diff(group)) + 1
        vec, key, kind = _unit(_stack(f["vec"])), f["key"].to_numpy(), f["kind"].to_numpy()
        out = []
        for part in np.split(np.arange(len(f)), cut):
            c, q = part[kind[part] == 0], part[kind[part] == 1]
            step = min(QUERY_CHUNK, max(1, LSH_STEP_BYTES // (8 * max(1, len(c)))))
            for a in range(0, len(q) if len(c) else 0, step):
                qs = q[a:a + step]
                sc = vec[qs] @ vec[c].T
                row, col = best_of_rows(sc, np.broadcast_to(key[c], sc.shape), k)
                out.append((key[qs[row]], key[c[col]], sc[row, col]))
        if not out:
            return _empty()
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "id", "score"))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            last = (f[names] == f[names].iloc[-1]).all(axis=1)  # the group may go on in the next batch
            rest, ready = f[last], f[~last].reset_index(drop=True)
            if len(ready):
                yield scored(ready)
        if rest is not None:
            yield scored(rest.reset_index(drop=True))

    return run


def _lsh_rows(corpus: DataFrame, queries: DataFrame, id_col: str, vec_col: str, query_id_col: str, query_vec_col: str,
              tables: int, hashes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """All bucketed rows, and the size of every bucket that has both queries and corpus vectors."""
    side = lambda df, i, v, kind: (df.where(F.col(v).isNotNull() & (F.size(v) > 0))
                                   .select(F.lit(kind).alias("kind"), F.col(i).cast("long").alias("key"),
                                           F.col(v).cast("array<double>").alias("vec")))
    rows = _bucketed(side(corpus, id_col, vec_col, 0).unionAll(side(queries, query_id_col, query_vec_col, 1)), tables, hashes, seed)
    sizes = (rows.groupBy("tbl", "bkt").agg(F.count_if(F.col("kind") == 0).alias("nc"), F.count_if(F.col("kind") == 1).alias("nq"),
                                            F.max(F.size("vec")).alias("dim"))
             .where((F.col("nc") > 0) & (F.col("nq") > 0)))
    return rows, sizes


def knn_lsh(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "embedding",
            query_id_col: str = "query_id", query_vec_col: str = "embedding", tables: int = LSH_TABLES,
            hashes: int = LSH_HASHES, block_bytes: int = LSH_BLOCK_BYTES, seed: int = 7) -> DataFrame:
    """Approximate cosine top-k for near neighbours: random-projection buckets, scored exactly.

    Meant for neighbours with a cosine of about 0.9 and more (near copies,
    slightly changed vectors), which it finds while scoring a few per cent of
    the pairs.  For ordinary top-k lists, whose members are far from the query,
    no hashing that keeps recall high scores less than :func:`knn_exact`: use that.

    Buckets without a query or without corpus vectors are dropped before any
    vector moves.  A bucket is split so that neither side of a group exceeds
    ``block_bytes``; corpus parts meet every query part.  No pair is a row: k
    rows per query and group leave Python; pairs found in several tables are
    de-duplicated before the final rank.
    """
    rows, sizes = _lsh_rows(corpus, queries, id_col, vec_col, query_id_col, query_vec_col, tables, hashes, seed)
    parts = lambda n: F.ceil(F.col(n) * F.col("dim") * 8 / block_bytes).cast("int")
    dealt = rows.join(sizes.select("tbl", "bkt", parts("nc").alias("cs"), parts("nq").alias("qs")), ["tbl", "bkt"])
    own = lambda n: F.array(F.pmod(F.xxhash64("key"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    corpus_row = F.col("kind") == 0
    dealt = (dealt.withColumn("csub", F.explode(F.when(corpus_row, own("cs")).otherwise(every("cs"))))
             .withColumn("qsub", F.explode(F.when(corpus_row, every("qs")).otherwise(own("qs"))))
             .select("tbl", "bkt", "csub", "qsub", "kind", "key", "vec")
             .repartition("tbl", "bkt", "csub", "qsub").sortWithinPartitions("tbl", "bkt", "csub", "qsub"))
    partial = dealt.mapInPandas(_score_buckets(k), _PARTIAL_SCHEMA)
    best = partial.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lsh_pairs(corpus: DataFrame, queries: DataFrame, *, id_col: str = "id", vec_col: str = "embedding",
              query_id_col: str = "query_id", query_vec_col: str = "embedding", tables: int = LSH_TABLES,
              hashes: int = LSH_HASHES, seed: int = 7) -> DataFrame:
    """One row: how many pairs :func:`knn_lsh` scores (pairs that meet in several tables count each time)."""
    sizes = _lsh_rows(corpus, queries, id_col, vec_col, query_id_col, query_vec_col, tables, hashes, seed)[1]
    return sizes.agg(F.coalesce(F.sum(F.col("nc") * F.col("nq")), F.lit(0)).alias("pairs"))
