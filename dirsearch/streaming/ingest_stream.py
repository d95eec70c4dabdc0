"""Incremental ingest with Structured Streaming.

New page files arrive in a folder.  The stream carries the names of the files;
each micro-batch reads its files.  It drops pages whose URL is already stored
(unless forced) and keeps one page per URL, both decided on the URLs and page
ids alone.  The pages that stay are parsed once, into one nested row a page
under ``root/parsed/epoch=N``; every table is derived from these rows and
written as plain Parquet under ``root/<table>/epoch=N``.  Readers take, for
each URL, the rows of its latest epoch, so a page parsed again replaces its
profile and all its children.

A replayed batch overwrites its own epoch and looks only at earlier epochs for
known URLs, so it writes the same rows again.  ``root`` must be shared storage
on a cluster.
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dirsearch.operators.upsert import name_index
from dirsearch.plans.ingest import Lexicon, parsed_rows, tables_of

PROFILE_COLS = ["id", "url", "name", "first_name", "last_name", "email", "phone", "title", "office_location", "clerkship"]
CHILDREN = {"facets": "profile_id", "educations": "profile_id", "experience": "id", "name_index": "profile_id"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _all(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    path = f"{root}/{table}"
    return spark.read.parquet(path) if _exists(spark, path) else None


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The current rows of a table: profiles, one of CHILDREN, or errors (all of them); None before the first batch."""
    rows = _all(spark, root, table)
    if rows is None or table == "errors":
        return rows
    if table == "profiles":
        others = [c for c in rows.columns if c != "url"]
        latest = rows.groupBy("url").agg(F.max_by(F.struct(*others), "epoch").alias("r"), F.min("epoch").alias("first_epoch"))
        return latest.select("url", "r.*", "first_epoch").select(*PROFILE_COLS, "first_epoch", "epoch")
    key = CHILDREN[table]
    current = _all(spark, root, "profiles").groupBy(F.col("id").alias(key)).agg(F.max("epoch").alias("epoch"))
    return rows.join(current, [key, "epoch"]).select(*rows.columns)


def pages_to_parse(pages: DataFrame, known_urls: DataFrame | None = None, order: str = "page_id") -> DataFrame:
    """Of pages with one URL the one that comes last in ``order``, none of known URLs.

    What goes is found on the narrow columns; the HTML only meets the list of pages that go (an anti join, which adaptive
    execution broadcasts while that list is small).  Pages repeated in URL and ``order`` are one page.
    """
    keys = pages.select("url", order).groupBy("url", order).agg(F.count("*").alias("n"))
    last = keys.groupBy("url").agg(F.max(order).alias("last")).withColumnRenamed("url", "of_url")
    judged = keys.join(last, F.col("url").eqNullSafe(F.col("of_url")), "left").withColumn("gone", ~F.col(order).eqNullSafe(F.col("last")))
    if known_urls is not None:
        known = known_urls.select(F.col("url").alias("known_url")).distinct().withColumn("known", F.lit(True))
        judged = judged.join(known, F.col("url") == F.col("known_url"), "left").withColumn("gone", F.col("gone") | F.coalesce("known", F.lit(False)))
    judged = judged.where("gone or n > 1").select(F.col("url").alias("k_url"), F.col(order).alias("k_order"), "gone")
    same = F.col("url").eqNullSafe(F.col("k_url")) & F.col(order).eqNullSafe(F.col("k_order"))
    kept = pages.join(judged, same, "left_anti")
    repeated = judged.where("not gone")
    if not repeated.isEmpty():
        kept = kept.unionByName(pages.join(repeated, same, "left_semi").dropDuplicates(["url", order]))
    return kept


def apply_batch(spark: SparkSession, pages: DataFrame, root: str, epoch: int, lex: Lexicon | None = None,
                force: bool = False, school_aliases: DataFrame | None = None) -> None:
    """One micro-batch: the tables of ``epoch`` from ``pages`` and what earlier epochs hold."""
    stored = None if force else _all(spark, root, "profiles")
    known = None if stored is None else stored.where(F.col("epoch") < epoch).select("url")
    rows = parsed_rows(pages_to_parse(pages, known), lex)
    path = f"{root}/parsed/epoch={epoch}"
    rows.write.mode("overwrite").parquet(path)
    parsed = tables_of(spark.read.schema(rows.schema).parquet(path), school_aliases)
    profiles = parsed.profiles.select(*PROFILE_COLS)
    tables = {"facets": parsed.facets, "educations": parsed.educations, "experience": parsed.experience, "errors": parsed.errors,
              "name_index": name_index(profiles), "profiles": profiles}
    for name, table in tables.items():  # profiles last: readers find children through them
        table.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")


def start_ingest(spark: SparkSession, source: str, schema, root: str, checkpoint: str | None = None,
                 lex: Lexicon | None = None, force: bool = False, available_now: bool = True,
                 max_files_per_trigger: int | None = None, school_aliases: DataFrame | None = None) -> StreamingQuery:
    """ST1: stream page files from ``source`` (a folder or glob) into the tables under ``root``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source).select(F.col("_metadata.file_path").alias("file"))

    def each(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        files = [unquote(r["file"]) for r in batch.distinct().collect()]  # the files of one trigger
        pages = session.read.schema(schema).parquet(*files) if files else session.createDataFrame([], schema)
        apply_batch(session, pages, root, int(epoch_id), lex, force, school_aliases)

    w = (stream.writeStream.foreachBatch(each)
         .option("checkpointLocation", checkpoint or os.path.join(root, "_checkpoint")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
