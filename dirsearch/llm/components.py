"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so hubs are pre-aggregated and, in the join, split by Spark.  The edge table
is checkpointed after every round; only two numbers per round reach the driver.  Few edges run in few tasks, whatever
number of shuffle partitions the session has: a round has several shuffles, each with files and a log entry for every task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirsearch.llm.store import checkpointed

EDGES = 100_000  # of the edge table for one task


def _towards_minimum(adjacent: DataFrame, large: bool, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """adjacent (u, v): for each u, links its neighbours to the least of u and them."""
    least = few(adjacent.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    linked = adjacent.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node of its component."""
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = checkpointed(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before, tasks = tuple(state), -(-state[0] // EDGES)
        few = (lambda df: df.coalesce(tasks)) if tasks < most else (lambda df: df)  # noqa: B023
        e = few(e)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = few(few(_towards_minimum(both, True, few)).distinct())
        e = checkpointed(few(few(_towards_minimum(grown, False, few).where("u <> v")).distinct()))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select("v", "v")).distinct()
