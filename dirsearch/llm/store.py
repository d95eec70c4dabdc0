"""Where intermediate results go: the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_ID, KEY_HASH = "_k_id", "_k_hash"
NULL_ID = -(1 << 63)  # stands for a null id in internal keys


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only where that is unset (tests) is a scratch folder chosen."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A small table of an iteration, cut from its lineage with checkpoint()."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an internal row key: its id (null: the smallest long) and a hash of its text.

    Rows that agree in both are one document to the operators; their results are attached to each of them.
    """
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(KEY_ID),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(KEY_HASH), "*")
