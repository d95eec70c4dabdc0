"""Corpus pipeline over ``documents``: each stage's rows are written as Parquet and reread as the next one's input.

Stages are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``:

1. quality rules: documents that the rules reject go;
2. line dedup: lines that stand earlier are cut from the texts (and ``n_chars`` follows); no document goes;
3. MinHash near-dedup: of each group of near copies the document with the least id stays;
4. mixing: documents stand as often as the mix draws them, dealt by shard and shuffled within;
5. byte-level BPE: the ids of each row's text, and the digests of the ids and of what they decode to.

Empty tables give empty results; null texts pass as empty ones; extra columns pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirsearch.llm.bpe import digests
from dirsearch.llm.line_dedup import without_later_runs
from dirsearch.llm.mixing import mixture
from dirsearch.llm.near_dup import keep_one
from dirsearch.llm.quality_rules import quality_filter
from dirsearch.llm.store import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules with adaptive thresholds; rejected documents go."""
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go, in runs of any length."""
    out = without_later_runs(docs, gram=1, span=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return mixture(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digests of the ids and of the text that they decode to."""
    return digests(docs, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage),
          ("byte_bpe", bpe_stage)]

ORACLE_SQL = None  # SQL does not express byte-level BPE and the seeded draws; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
