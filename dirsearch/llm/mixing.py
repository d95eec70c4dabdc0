"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources in code point order weigh 5, 2, 1, repeating; their targets share ``SHARE`` of all words, none above ``MOST`` times
its source.  Documents of a source are dealt into blocks by a hash; blocks stand in a permuted order.  A target is so many
whole passes over the source, then blocks in order up to the target; of the block at the end, the largest documents that
still fit.  That fixes each source's quota of block draws.

The quotas are split among output shards by a tree: a node halves its shards and draws, multivariate-hypergeometrically,
how many draws of each source go left, so each shard gets its exact number of draws and a random mixture of sources.
Shards take consecutive draws of each source's permuted order, so they are disjoint, and shuffle their rows locally.  There
is a shard for each ``SHARD_WORDS`` words of the targets, and ``SHARDS`` at least.

All numbers depend on seeds and data only, so reruns agree.  Per-source tables have one row a source, and a source has at
most ``MOST_BLOCKS`` blocks; these are the only things ordered in one task.

Defined results: null texts have size 0; documents without words add nothing and are not drawn; the null source comes last; sources without words have target 0; null ids are
mixed like others; rows equal in id and text share their draws; extra columns pass through ``mixture``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dirsearch.llm.registry import register, table
from dirsearch.llm.store import KEY_HASH, KEY_ID, NULL_ID, keyed, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_DOCS, MOST_BLOCKS = 256, 4096
SHARDS, SHARD_WORDS = 16, 2_000_000
SEED = 7


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Key, source, a source key without nulls, and size of each document."""
    s = F.col(f"`{source}`").cast("string")
    return keyed(docs, text).select(KEY_ID, KEY_HASH, s.alias("source"), F.when(s.isNull(), "-").otherwise(F.concat(F.lit("="), s)).alias("skey"),
                                    words_in(text).alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """(skey, source_size, n_docs, target) of every source: shares by weight, levelled off at MOST times the source.

    With the sources in order of cap by weight, the first k are capped and the others get the level times their weight.
    The level that would remain after each k is known from running sums; the one that holds is the largest below its own
    source's cap by weight.
    """
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.first("source").alias("source"))
    everything = Window.partitionBy()  # over one row a source
    ranked = by_source.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = (ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("at") % len(WEIGHTS) + 1).cast("int")))
               .withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
               .withColumn("all", SHARE * F.sum("source_size").over(everything)))
    before = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy("ratio", "at").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    open_ = weighed.withColumn("level", level).withColumn("level", F.when(F.col("level") < F.col("ratio"), F.col("level")))
    found = open_.withColumn("level", F.max("level").over(everything))
    return found.select("skey", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the block at the end of a target: the largest documents that still fit, those that come first among equals."""
    rows = rows.sort_values(["size", "mixed"], ascending=[False, True])
    room, chosen = int(rows["room"].iloc[0]), []
    for size in rows["size"]:
        chosen.append(0 < size <= room)
        room -= size if chosen[-1] else 0
    return rows.loc[chosen, [KEY_ID, KEY_HASH]]


def _split(shards: int, seed: int):
    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        """(skey, draws) to (skey, shard, first, end): which of its draws, in order, each shard takes."""
        rows = rows.sort_values("skey")
        counts = np.zeros((shards, len(rows)), np.int64)
        total = int(rows["draws"].sum())
        edges = [total * k // shards for k in range(shards + 1)]

        def node(lo: int, hi: int, left: np.ndarray) -> None:
            if hi - lo == 1:
                counts[lo] = left
                return
            mid = (lo + hi) // 2
            rng = np.random.default_rng([seed, lo, hi])
            part = rng.multivariate_hypergeometric(left, edges[mid] - edges[lo], method="marginals")
            node(lo, mid, part)
            node(mid, hi, left - part)

        node(0, shards, rows["draws"].to_numpy(np.int64))
        end = np.cumsum(counts, axis=0)
        return pd.DataFrame({"skey": np.tile(rows["skey"].to_numpy(), shards), "shard": np.repeat(np.arange(shards), len(rows)),
                             "first": (end - counts).reshape(-1), "end": end.reshape(-1)})

    return tree


def copies(docs: DataFrame, text: str = "text", source: str = "source", shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size and target; the mixture's rows as key, size, shard and place in the shard)."""
    sizes = written(sized(docs, text, source), "mixing-sizes")
    plan = written(targets(sizes), "mixing-targets")
    if shards is None:  # one for each SHARD_WORDS, and SHARDS at least
        shards = max(SHARDS, int((plan.agg(F.sum("target")).first()[0] or 0) // SHARD_WORDS))
    placed = sizes.join(plan, "skey").withColumn("mixed", F.xxhash64(F.lit(seed), KEY_ID, KEY_HASH))
    n_blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS))
    placed = placed.withColumn("block", F.pmod("mixed", n_blocks).cast("int"))

    blocks = placed.groupBy("skey", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    permuted = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    upto = F.sum("words").over(permuted)
    quota = (blocks.withColumn("passes", whole).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
             .withColumn("room", F.col("rest") - (upto - F.col("words"))).withColumn("order", F.row_number().over(permuted))
             .withColumn("last", F.when((F.col("room") >= F.col("words")) & (F.col("words") > 0), "all").when((F.col("room") > 0) & (F.col("words") > 0), "part")))
    quota = written(quota.select("skey", "block", "passes", "room", "order", "last"), "mixing-quota")

    # every draw of a block: (skey, block, pass, part of the block or all), numbered in permuted order
    draws = (quota.withColumn("pass", F.explode(F.expr("sequence(1, passes + if(last is null, 0, 1))")))
             .where("passes + if(last is null, 0, 1) > 0").where("pass between 1 and passes + if(last is null, 0, 1)")
             .withColumn("part", (F.col("pass") > F.col("passes")) & (F.col("last") == "part"))
             .withColumn("n", F.row_number().over(Window.partitionBy("skey").orderBy("pass", "order")) - 1))
    shares = (draws.groupBy("skey").agg(F.count("*").alias("draws")).groupBy(F.lit(0).alias("root"))
              .applyInPandas(lambda rows: _split(shards, seed)(rows), "skey string, shard int, first long, end long"))
    numbered = shares.where("end > first").withColumn("n", F.explode(F.expr("sequence(first, end - 1)"))).select("skey", "n", "shard")
    dealt = written(draws.join(numbered, ["skey", "n"]).select("skey", "block", "pass", "part", "shard"), "mixing-draws")

    ends = quota.where("last = 'part'").select("skey", "block", "room")
    filled = (placed.join(ends, ["skey", "block"]).select("skey", KEY_ID, KEY_HASH, "size", "mixed", "room")
              .groupBy("skey").applyInPandas(_fill, f"{KEY_ID} long, {KEY_HASH} long"))
    drawn = placed.where("size > 0").select(KEY_ID, KEY_HASH, "skey", "block", "size").join(dealt, ["skey", "block"])
    rows = drawn.where("not part").unionByName(drawn.where("part").join(filled.distinct(), [KEY_ID, KEY_HASH], "left_semi"))
    rows = rows.select(KEY_ID, KEY_HASH, "size", "pass", "shard", F.xxhash64(F.lit(seed + 2), "shard", KEY_ID, KEY_HASH, "pass").alias("place"))
    return placed.select(KEY_ID, KEY_HASH, "source", "size", "source_size", "target"), rows


def mixture(docs: DataFrame, text: str = "text", source: str = "source", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed documents, as often as they are drawn, dealt by shard and shuffled within each."""
    rows = copies(docs, text, source, shards, seed)[1].select(KEY_ID, KEY_HASH, "pass", F.col("shard").alias("_m_shard"), F.col("place").alias("_m_place"))
    rows = rows.distinct()  # rows equal in id and text share their draws
    return (keyed(docs, text).join(rows, [KEY_ID, KEY_HASH]).repartitionByRange("_m_shard", "_m_place").sortWithinPartitions("_m_shard", "_m_place")
            .select(*[f"`{c}`" for c in docs.columns]))


@register("op7_mixing")
def op7_mixing(spark, sf_dir):
    docs, rows = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = rows.groupBy(KEY_ID, KEY_HASH).agg(F.count_distinct("pass").alias("times"))
    return (docs.join(taken, [KEY_ID, KEY_HASH], "left")
            .select(F.when(F.col(KEY_ID) != NULL_ID, F.col(KEY_ID)).alias("doc_id"), "size", "source_size", "target",
                    (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken")))
