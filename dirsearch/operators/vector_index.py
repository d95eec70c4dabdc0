"""A stored vector index: inverted lists around trained centroids, packed as blocks that queries meet one by one.

``build_index`` trains centroids by mini-batch k-means on a bounded sample
(``SAMPLE_ROWS`` rows, ``SAMPLE_BYTES`` bytes), puts **every** row into the
list of its nearest centroid and packs each list, ordered by the angle to its
centroid, into blocks of at most ``BLOCK_BYTES``: a list with a third of all
rows is many blocks, and each block is a shell between two angles.

``search`` answers a table of queries:

* approximate (``recall`` or ``probes`` given): each query meets the blocks of
  its nearest lists and is scored exactly there.  How many lists a recall
  takes is measured on the sample when the index is built;
* exact (neither given): the nearest lists give each query a score that its
  k-th best at least has; then every other block is met unless the triangle
  inequality on angles shows that nothing in it can score as much.  The test
  is always on and leaves a margin for rounding, so the result is that of
  scoring all pairs.

Queries meet blocks in cogroups of one group of blocks and one tile of queries,
both bounded in bytes; a query travels once to each group, with one flag a list.  ``Found.pairs`` tells how many (query, row) pairs were
scored.  Rows and queries without a vector, or with components that are not
finite, take no part; vectors of length zero score 0 and are never skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from dirsearch.operators.knn import Best, _empty, _partitions
from dirsearch.session import written

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
MOST_LISTS = 1024  # the centroids go to every task
BLOCK_BYTES = 4 << 20
GROUP_BYTES = 16 << 20  # of the blocks, and of the queries, that a task holds
SLICE_ROWS = 1024
STEPS, BATCH = 80, 1024
MARGIN = 1e-9
DIGITS = 12  # of scores: equal vectors score alike wherever they stand
LOOSE = -1  # the list of vectors without a direction


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def _normalised(vecs: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vecs])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _angles(u: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ centroids.T, -1.0, 1.0))


def mini_batch_centroids(u: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Unit centroids of unit vectors: batches move their nearest centroids, each less the more it has seen."""
    rng = np.random.default_rng(seed)
    centroids = u[rng.choice(len(u), min(lists, len(u)), replace=False)].copy()
    seen = np.zeros(len(centroids))
    for _ in range(STEPS):
        batch = u[rng.integers(0, len(u), BATCH)]
        nearest = (batch @ centroids.T).argmax(axis=1)
        count = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, batch)
        hit = count > 0
        seen[hit] += count[hit]
        centroids[hit] += (total[hit] - count[hit, None] * centroids[hit]) / seen[hit, None]
        size = np.linalg.norm(centroids, axis=1, keepdims=True)
        centroids = np.divide(centroids, size, out=np.zeros_like(centroids), where=size > 0)
    return centroids


def recall_curve(u: np.ndarray, centroids: np.ndarray, k: int = 10, queries: int = 500) -> np.ndarray:
    """Share of the sample's k nearest neighbours that the first 1, 2, ... lists of a query hold."""
    q = u[:queries]
    near = np.argsort(-(q @ u.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    own = (u @ centroids.T).argmax(axis=1)
    at = np.take_along_axis(place, own[near], axis=1)
    return np.cumsum(np.bincount(at.ravel(), minlength=len(centroids))) / max(1, at.size)


@dataclass(frozen=True)
class Found:
    rows: DataFrame  # (query_id, id, score, rank)
    pairs: DataFrame  # one row: pairs, how many were scored


@dataclass(frozen=True)
class VectorIndex:
    """Centroids, the share of neighbours found by probes on the sample, and the written blocks
    (list, block, n, lo, hi, ids, vecs)."""

    centroids: np.ndarray
    curve: np.ndarray
    blocks: DataFrame

    def probes_for(self, recall: float) -> int:
        """The least number of lists that reached the recall on the sample."""
        return int(min(np.searchsorted(self.curve, recall) + 1, max(1, len(self.curve))))

    def search(self, queries: DataFrame, k: int, *, recall: float | None = None, probes: int | None = None, query_id_col: str = "query_id",
               query_vec_col: str = "embedding") -> Found:
        """The k best rows of every query, ties by id; exact unless ``recall`` or ``probes`` is given."""
        exact = recall is None and probes is None
        if probes is None:
            probes = max(1, len(self.centroids) // 16) if exact else self.probes_for(recall)
        asked = _vectors(queries, query_id_col, query_vec_col).withColumnRenamed("id", "query_id").withColumn("least", F.lit(None).cast("double"))
        held = {r["list"]: r for r in self.blocks.groupBy("list").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        near = _nearest(self.centroids, probes)
        scored = self._scored(asked, near, held, k)
        pairs = self._met(asked.mapInPandas(_counted(near), _MET))
        if not exact:
            return Found(_ranked(scored, k), _pairs(pairs))
        first = written(_ranked(scored, k), "index-first")
        least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        bounded = asked.drop("least").join(least.select("query_id", "least"), "query_id", "left")
        possible = _possible(self.centroids, probes, held)
        rest = self._scored(bounded, possible, held, k)
        pairs = pairs.unionAll(self._met(bounded.mapInPandas(_counted(possible, each=True), _MET)))
        return Found(_ranked(first.select("query_id", "id", "score").unionAll(rest), k), _pairs(pairs))

    def _met(self, asked: DataFrame) -> DataFrame:
        """The blocks of the queries' lists, without those that cannot reach a query's least score: rows n, met by m queries."""
        met = asked.join(self.blocks.select("list", "n", "lo", "hi"), "list")
        best = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("hi"), F.col("lo") - F.col("angle")))
        return met.where(F.col("least").isNull() | (best >= F.col("least") - MARGIN)).select("n", "m")

    def _groups(self, held: dict[int, Row]) -> dict[int, tuple[int, int]]:
        """The groups of blocks of each list, as (first, number): short lists share a group, a long one has several."""
        size = 8 * max(1, self.centroids.shape[1])
        total = sum(r["n"] for r in held.values()) * size
        most = max(1, min(GROUP_BYTES, total // math.isqrt(_partitions(self.blocks.sparkSession))))
        out, group, full = {}, 0, 0
        for i in sorted(held):
            own = held[i]["n"] * size
            if full and full + own > most:
                group, full = group + 1, 0
            parts = max(1, -(-own // most))
            out[i] = (group, parts)
            group, full = (group + parts, 0) if parts > 1 else (group, full + own)
        return out

    def _scored(self, asked: DataFrame, lists, held: dict[int, Row], k: int) -> DataFrame:
        """The k best rows of each query in each group of blocks, of the blocks that it meets.

        Groups of blocks meet tiles of queries, both bounded in bytes; a query goes to a group once, however many of its
        blocks it meets, and leaves it with k rows.
        """
        spark, dim, centroids = self.blocks.sparkSession, self.centroids.shape[1], self.centroids
        slots, groups = len(centroids) + 1, self._groups(held)
        rows = max(1, GROUP_BYTES // (8 * max(1, dim) + 16 * k + slots))
        tiles = F.greatest(F.lit(math.isqrt(_partitions(spark))), F.ceil(asked.agg(F.count("*")).scalar() / rows)).cast("int")
        right = (asked.mapInPandas(_spread(lists, groups, slots), "query_id long, q binary, lists binary, least double, groups array<int>")
                 .withColumn("tile", F.pmod(F.xxhash64("query_id"), tiles).cast("int")).withColumn("group", F.explode("groups")).drop("groups"))
        dealt = spark.createDataFrame([(i, *x) for i, x in groups.items()], "list int, first int, parts int")
        left = (self.blocks.join(dealt, "list")
                .select((F.col("first") + F.pmod(F.xxhash64("block"), F.col("parts"))).cast("int").alias("of_group"),
                        F.explode(F.sequence(F.lit(0), tiles - 1)).alias("of_tile"), "list", "lo", "hi", "ids", "vecs"))

        def score(blocks: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
            if not len(blocks) or not len(met):
                return _empty()
            q, least = _units(list(met["q"]), dim), met["least"].to_numpy(np.float64)
            meets = np.unpackbits(np.frombuffer(b"".join(met["lists"]), np.uint8).reshape(len(q), -1), axis=1)[:, :slots] > 0
            best = Best(met["query_id"].to_numpy(np.int64), k)
            for own, lo, hi, ids, vecs in zip(*(blocks[c] for c in ("list", "lo", "hi", "ids", "vecs"))):
                at = np.flatnonzero(meets[:, own])  # LOOSE is the last
                if own != LOOSE:
                    angle = _angles(q[at], centroids[own : own + 1])[:, 0]
                    reach = np.cos(np.maximum(0.0, np.maximum(angle - hi, lo - angle)))
                    at = at[np.isnan(least[at]) | (reach >= least[at] - MARGIN)]
                ids, vecs = np.frombuffer(ids, np.int64), _units([vecs], dim)
                step = max(1, (BLOCK_BYTES // 8) // len(ids))
                for a in range(0, len(at), step):
                    part = at[a : a + step]
                    best.add(part, ids, np.round(q[part] @ vecs.T, DIGITS) + 0.0)
            return best.frame()

        return left.groupBy("of_group", "of_tile").cogroup(right.groupBy("group", "tile")).applyInPandas(score, "query_id long, id long, score double")


_MET = "list int, angle double, least double, m long"


def _nearest(centroids: np.ndarray, probes: int):
    """Unit vectors to their nearest lists, and the list of loose vectors, as one flag a list (the last for LOOSE)."""

    def run(u: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = _angles(u, centroids)
        open_ = np.zeros((len(u), len(centroids) + 1), bool)
        np.put_along_axis(open_, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
        open_[:, LOOSE] = True
        return open_, angle

    return run


def _possible(centroids: np.ndarray, probes: int, held: dict[int, Row]):
    """Unit vectors with their least scores to the other lists that may hold as good a row."""
    lo, hi = (np.array([held[i][x] if i in held else none for i in range(len(centroids))]) for x, none in (("lo", np.inf), ("hi", -np.inf)))

    def run(u: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = _angles(u, centroids)
        with np.errstate(invalid="ignore"):
            best = np.cos(np.maximum(0.0, np.maximum(angle - hi, lo - angle)))
        open_ = np.isfinite(lo) & ((best >= least[:, None] - MARGIN) | np.isnan(least)[:, None])
        np.put_along_axis(open_, np.argsort(angle, axis=1, kind="stable")[:, :probes], False, axis=1)
        return np.column_stack([open_, np.zeros(len(u), bool)]), angle

    return run


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for f in frames:
        for a in range(0, len(f), SLICE_ROWS):
            part = f.iloc[a : a + SLICE_ROWS]
            yield part, _normalised(part["vec"]), part["least"].to_numpy(np.float64)


def _spread(lists, groups: dict[int, tuple[int, int]], slots: int):
    """Queries to one row each, with the flags of their lists and the groups that hold these."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = np.zeros((slots, 1 + max((a + n - 1 for a, n in groups.values()), default=0)), np.float32)
        for i, (a, n) in groups.items():
            of[i, a : a + n] = 1.0  # LOOSE is the last
        for f, u, least in _slices(frames):
            open_ = lists(u, least)[0]
            yield pd.DataFrame({"query_id": f["query_id"].to_numpy(), "q": [x.tobytes() for x in u], "lists": [x.tobytes() for x in np.packbits(open_, axis=1)],
                                "least": least, "groups": [np.flatnonzero(x).astype(np.int32) for x in open_.astype(np.float32) @ of > 0]})

    return run


def _counted(lists, each: bool = False):
    """How many queries meet each list, batch by batch; with ``each`` one row for each query and list, with its angle and least score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, u, least in _slices(frames):
            open_, angle = lists(u, least)
            if each:
                row, own = np.nonzero(open_)  # never LOOSE
                yield pd.DataFrame({"list": own.astype(np.int32), "angle": angle[row, own], "least": least[row], "m": np.ones(len(row), np.int64)})
            else:
                own = np.append(np.arange(open_.shape[1] - 1), LOOSE).astype(np.int32)
                yield pd.DataFrame({"list": own, "angle": np.zeros(len(own)), "least": np.full(len(own), np.nan), "m": open_.sum(axis=0)})

    return run


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(met: DataFrame) -> DataFrame:
    return met.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"))


def build_index(corpus: DataFrame, *, id_col: str = "id", vec_col: str = "embedding", lists: int | None = None, block_bytes: int = BLOCK_BYTES,
                seed: int = 7) -> VectorIndex:
    """Trains, assigns and packs; runs jobs, and writes the blocks to the shared folder.

    ``lists`` defaults to twice the square root of the number of rows, at most ``MOST_LISTS``.
    """
    rows = _vectors(corpus, id_col, vec_col)
    n, dim, least = rows.agg(F.count("*"), F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if n and dim != least:
        raise ValueError("vectors of an index have one length")
    dim = dim or 1
    sample = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    lists = min(MOST_LISTS, lists or max(1, int(2 * n**0.5)))
    share = min(1.0, 1.2 * sample / max(1, n))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(sample)

    def train(f: pd.DataFrame) -> pd.DataFrame:
        u = _normalised(f["vec"])
        u = u[np.linalg.norm(u, axis=1) > 0]
        if not len(u):
            return pd.DataFrame({"kind": [], "at": [], "x": []})
        c = mini_batch_centroids(u, lists, seed)
        curve = recall_curve(u, c)
        return pd.DataFrame({"kind": [0] * len(c) + [1], "at": [*range(len(c)), 0], "x": [*c.tolist(), curve.tolist()]})

    learnt = some.groupBy().applyInPandas(train, "kind int, at int, x array<double>").collect()  # at most MOST_LISTS + 1 rows
    centroids = np.array([r["x"] for r in sorted((r for r in learnt if r["kind"] == 0), key=lambda r: r["at"])]).reshape(-1, dim)
    curve = np.array(next((r["x"] for r in learnt if r["kind"] == 1), []))
    if not len(centroids):
        centroids, curve = np.zeros((1, dim)), np.ones(1)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                u = _normalised(f["vec"])
                angle = _angles(u, centroids)
                own = angle.argmin(axis=1)
                loose = ~u.any(axis=1)
                yield pd.DataFrame({"list": np.where(loose, LOOSE, own).astype(np.int32), "angle": np.where(loose, 0.0, angle[np.arange(len(u)), own]),
                                    "id": f["id"], "vec": [x.tobytes() for x in u]})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = max(1, block_bytes // (8 * dim))
        for f in frames:
            own = f["list"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else []
            out = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                for a in range(x, y, most):
                    part = f.iloc[a : min(y, a + most)]
                    out.append((int(own[a]), len(part), part["angle"].min(), part["angle"].max(), part["id"].to_numpy(np.int64).tobytes(), b"".join(part["vec"])))
            yield pd.DataFrame(out, columns=["list", "n", "lo", "hi", "ids", "vecs"])

    dealt = (rows.mapInPandas(assign, "list int, angle double, id long, vec binary").repartitionByRange("list", "angle", "id")
             .sortWithinPartitions("list", "angle", "id"))
    blocks = dealt.mapInPandas(pack, "list int, n long, lo double, hi double, ids binary, vecs binary").withColumn("block", F.monotonically_increasing_id())
    return VectorIndex(centroids, curve, written(blocks, "index-blocks"))
