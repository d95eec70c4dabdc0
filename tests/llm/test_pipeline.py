"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from conftest import SMOKE

from dirsearch.llm.store import written


def test_stages(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    names = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SMOKE), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen.append((docs, out))
        docs = out
    quality, lines, near, mixed, coded = seen
    assert quality[1].count() < quality[0].count()
    assert lines[1].count() == lines[0].count() and lines[1].where("n_chars <> length(text)").count() == 0
    assert near[1].count() <= near[0].count() and near[1].select("doc_id").distinct().count() == near[1].count()
    assert mixed[1].groupBy("doc_id").count().where("count > 2").count() == 0 and mixed[1].where("length(text) = 0").count() == 0
    assert coded[1].count() == coded[0].count()


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMOKE).count() > 0
    spark.read.parquet(f"{SMOKE}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
