"""Keyed writes expressed as DataFrame algebra (for table formats without MERGE).

* :func:`upsert` — insert or overwrite every column by key; the newest batch
  wins, ``created_at`` keeps the earliest value, ``updated_at`` comes from the
  batch.  A grouped ``max_by`` (partial aggregation, no window), so applying
  the same batch twice gives the same table.
* :func:`replace_children` — delete every child of the touched keys, insert
  the batch's children (left-anti join + union).
* :func:`name_index` / :func:`refresh_index` — the token index kept in step
  with profile inserts, updates and deletes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirsearch.operators.criteria import name_tokens


def profile_id(url: Column | str) -> Column:
    """Deterministic profile id from the URL (no auto-increment counter)."""
    return F.xxhash64(F.col(url) if isinstance(url, str) else url)


def upsert(base: DataFrame, batch: DataFrame, key: str = "url", batch_ts: Column | None = None,
           created: str = "created_at", updated: str = "updated_at", order: str | None = None) -> DataFrame:
    """Keyed upsert of ``batch`` into ``base`` (same columns).

    Of batch rows with one key, the one that is last by ``order`` (a column of
    the batch) wins; without it the greatest row, so that reruns agree.
    """
    if order is not None:
        rest = [c for c in batch.columns if c not in (key, order)]
        batch = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(key, "_b.*")
    ts = batch_ts if batch_ts is not None else F.current_timestamp()
    cols = [c for c in base.columns if c not in (created, updated)]
    b = base.select(*cols, created, updated, F.lit(0).alias("_v"))
    n = batch.select(*cols, ts.alias(created), ts.alias(updated), F.lit(1).alias("_v"))
    both = b.unionByName(n)
    values = [F.col(c) for c in cols if c != key]
    latest = F.max_by(F.struct(*values, F.col(updated)), F.struct("_v", *values))
    out = both.groupBy(key).agg(latest.alias("_r"), F.min(created).alias(created))
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols if c != key], created, F.col(f"_r.{updated}")
                      .alias(updated)).select(*base.columns)


def replace_children(children: DataFrame, new_children: DataFrame, touched: DataFrame, key: str = "profile_id") -> DataFrame:
    """Children of ``touched`` keys replaced by ``new_children``."""
    keys = touched.select(key).distinct()
    return children.join(keys, key, "left_anti").unionByName(new_children.select(*children.columns))


def name_index(profiles: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """Token index ``(token, profile_id, pos)`` of the case-folded name."""
    return profiles.select(F.col(id_col).alias("profile_id"),
                           F.posexplode(name_tokens(F.col(name_col))).alias("pos", "token")) \
        .select("token", "profile_id", "pos")


def refresh_index(index: DataFrame, changed: DataFrame, deleted: DataFrame | None = None, id_col: str = "id",
                  name_col: str = "name") -> DataFrame:
    """ST2: drop entries of changed or deleted profiles, add re-tokenised changed ones."""
    gone = changed.select(F.col(id_col).alias("profile_id"))
    if deleted is not None:
        gone = gone.unionByName(deleted.select(F.col(id_col).alias("profile_id")))
    kept = index.join(gone.distinct(), "profile_id", "left_anti")
    return kept.select("token", "profile_id", "pos").unionByName(name_index(changed, id_col, name_col))


def explode_facets(parsed: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """List fields of parsed profiles as a long ``(profile_id, facet, value)`` table."""
    arr = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("values")) for f in fields])
    e = parsed.select(F.col(id_col).alias("profile_id"), F.explode(arr).alias("f"))
    return e.select("profile_id", F.col("f.facet").alias("facet"), F.explode("f.values").alias("value"))
