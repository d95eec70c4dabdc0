"""Stored directory: profiles, facets and educations as tables bucketed by profile id, facets partitioned by facet,
and the name-token index partitioned by a hash of the token.

Searches that group the children by profile and join them to the profiles need no shuffle of a stored table: rows of one
profile lie in the same bucket of every table.  Conditions on a facet read its partition only; a name search reads the
partitions of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
TOKEN_PARTS = 256


@dataclass(frozen=True)
class Directory:
    profiles: DataFrame
    facets: DataFrame
    educations: DataFrame
    name_index: DataFrame


def token_part(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(TOKEN_PARTS)).cast("int")


def write_directory(name: str, path: str, profiles: DataFrame, facets: DataFrame, educations: DataFrame, buckets: int = BUCKETS) -> Directory:
    """Writes the tables ``<name>_profiles`` and so on under ``path`` (shared storage) and returns them."""
    from dirsearch.operators.upsert import name_index

    def bucketed(df: DataFrame, table: str, key: str, by: list[str] = []) -> None:  # noqa: B006
        # one task writes a bucket, so a bucket is one file (in each partition)
        rows = df.repartition(buckets, key).write.mode("overwrite").option("path", f"{path}/{table}").bucketBy(buckets, key).sortBy(key)
        (rows.partitionBy(*by) if by else rows).saveAsTable(f"{name}_{table}")

    bucketed(profiles, "profiles", "id")
    bucketed(facets, "facets", "profile_id", ["facet"])
    bucketed(educations, "educations", "profile_id")
    index = name_index(profiles).withColumn("part", token_part(F.col("token")))
    index.repartition("part").write.mode("overwrite").option("path", f"{path}/name_index").partitionBy("part").saveAsTable(f"{name}_name_index")
    return read_directory(profiles.sparkSession, name)


def read_directory(spark: SparkSession, name: str) -> Directory:
    return Directory(*(spark.table(f"{name}_{t}") for t in ("profiles", "facets", "educations", "name_index")))
