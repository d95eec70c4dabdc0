"""Tasks of the connected components (the pipeline's disk on check_h), on rows of their own."""

from __future__ import annotations

import uuid

from dirsearch.llm.components import components


def test_components_of_few_edges_take_few_tasks(spark):
    """pipeline: a round over a small table took all the session's shuffle partitions in each of its shuffles."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(64) if i != 40], "a long, b long")
    sc, group = spark.sparkContext, f"components-{uuid.uuid4().hex}"
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, "components")
        got = {r.node: r.root for r in components(chain, "a", "b").collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 if i <= 40 else 41 for i in range(65)}
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 64 * 24
