"""File sources and sinks: seed URL lists, ragged alias files, JSON export and
the dead-letter output.  Everything is read and written by Spark; nothing is
parsed on the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirsearch.functions.text import strip

PACKAGE_DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
SCHOOL_ALIAS_FILE = os.path.join(PACKAGE_DATA, "school_alias.csv")
PRACTICE_ALIAS_FILE = os.path.join(PACKAGE_DATA, "practice_alias.csv")


def seed_urls(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trimmed non-empty lines starting with 'http' -> ``(url)``."""
    u = strip(F.col(col))
    return lines.select(u.alias("url")).where(F.col("url").startswith("http"))


def read_seed_urls(spark: SparkSession, path: str) -> DataFrame:
    return seed_urls(spark.read.text(path))


def read_alias_file(spark: SparkSession, path: str) -> DataFrame:
    """S2/S3 source: ragged ``normalized,alias1,alias2,...`` lines (first line is a
    header, no quoting, lines with fewer than two fields skipped) as long rows
    ``(normalized, alias, ord, pos)``; ``ord`` keeps file order."""
    raw = (spark.read.text(path)
           .withColumn("_file", F.input_file_name())
           .withColumn("ord", F.monotonically_increasing_id()))
    first = raw.groupBy("_file").agg(F.min("ord").alias("_first"))
    body = raw.join(first, "_file").where(F.col("ord") > F.col("_first"))
    parts = F.transform(F.split(strip("value"), ",", -1), strip)
    rows = body.select("ord", parts.alias("p")).where((F.size("p") >= 2) & (F.col("p")[0] != ""))
    return (rows.select(F.col("p")[0].alias("normalized"), "ord",
                        F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("pos0", "alias"))
            .where(F.col("alias") != "")
            .select("normalized", "alias", "ord", (F.col("pos0") + 1).alias("pos")))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S10 sink: one JSON object per profile (nested arrays and structs kept)."""
    df.write.mode(mode).json(path)


def write_dead_letter(errors: DataFrame, path: str, url_col: str = "url", mode: str = "overwrite") -> None:
    """S11 sink: failed URLs as text, one per line (retry list), plus the
    reasons as Parquet next to it."""
    errors.select(url_col).write.mode(mode).text(os.path.join(path, "urls"))
    errors.write.mode(mode).parquet(os.path.join(path, "reasons"))
