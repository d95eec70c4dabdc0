"""Alias tables: long form, first/last-wins maps and three-step resolution.

The alias table is a dictionary (a few rows per canonical name).  Joins
against it carry no broadcast hint: AQE turns them into broadcast joins once
the shuffle stage has proven the dictionary small, and keeps a sort-merge
join if it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirsearch.functions.text import col_of


def alias_rows(df: DataFrame, normalized: str, aliases: list[str], ord_col: str) -> DataFrame:
    """Long form ``(normalized, alias, ord, pos)`` from a wide table whose row
    holds a canonical name and several alias columns (like one line of the
    ragged alias file).  ``pos`` is the field position (1 = first alias)."""
    arr = F.array(*[F.col(a).cast("string") for a in aliases])
    return (df.select(F.col(normalized).cast("string").alias("normalized"), F.col(ord_col).alias("ord"),
                      F.posexplode(arr).alias("pos0", "alias"))
            .where(F.col("alias").isNotNull() & (F.col("alias") != ""))
            .select("normalized", "alias", "ord", (F.col("pos0") + 1).alias("pos")))


def first_wins(rows: DataFrame) -> DataFrame:
    """One row per alias; the earliest (ord, pos) wins (unique-alias insert)."""
    return rows.groupBy("alias").agg(F.min_by("normalized", F.struct("ord", "pos")).alias("normalized"))


def last_wins_ci(rows: DataFrame) -> DataFrame:
    """Case-folded map where every canonical name also maps to itself and a
    later entry overwrites an earlier one (dictionary assignment order)."""
    ident = rows.select("normalized", F.col("normalized").alias("alias"), "ord", F.lit(0).alias("pos")).distinct()
    keyed = ident.unionByName(rows).select(F.lower("alias").alias("alias"), "normalized", "ord", "pos")
    return keyed.groupBy("alias").agg(F.max_by("normalized", F.struct("ord", "pos")).alias("normalized"))


def lookup_keys(rows: DataFrame) -> DataFrame:
    """Every canonical name and alias as a lookup key with its row order:
    ``(key, normalized, ord, pos)``; the canonical name itself has pos 0."""
    canon = rows.select(F.col("normalized").alias("key"), "normalized", "ord", F.lit(0).alias("pos"))
    alias = rows.select(F.col("alias").alias("key"), "normalized", "ord", "pos")
    return canon.unionByName(alias)


def resolve(df: DataFrame, value_col: str, rows: DataFrame, out_col: str = "resolved") -> DataFrame:
    """Three-step resolution of ``value_col``: exact key match, else
    case-insensitive key match, else the value itself.  On several matches
    the earliest alias-table row wins."""
    keys = lookup_keys(rows)
    exact = keys.groupBy("key").agg(F.min_by("normalized", F.struct("ord", "pos")).alias("_exact"))
    ci = (keys.withColumn("key", F.lower("key")).groupBy("key")
          .agg(F.min_by("normalized", F.struct("ord", "pos")).alias("_ci")))
    out = (df.join(exact, df[value_col] == exact["key"], "left").drop("key")
           .join(ci, F.lower(df[value_col]) == ci["key"], "left").drop("key"))
    return out.withColumn(out_col, F.coalesce("_exact", "_ci", F.col(value_col))).drop("_exact", "_ci")


def resolve_scalar(value: str, rows: DataFrame) -> Column:
    """Resolution of one literal value as a scalar subquery Column."""
    keys = lookup_keys(rows)
    hit = keys.where((F.col("key") == F.lit(value)) | (F.lower("key") == F.lit(value.lower())))
    best = hit.agg(F.min_by("normalized", F.struct((F.col("key") != F.lit(value)).alias("ci"), "ord", "pos"))
                   .alias("n"))
    return F.coalesce(best.scalar(), F.lit(value))


__all__ = ["alias_rows", "first_wins", "last_wins_ci", "lookup_keys", "resolve", "resolve_scalar", "col_of"]
