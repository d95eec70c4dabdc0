"""Embedding texts (V5, V6).

The default embedder hashes words into features and weighs them by inverse
document frequency, then scales to length 1; words are split by built-in functions
and counted in Arrow batches, each distinct word hashed once a batch, so that no word
is shuffled.  What it
learns from a corpus is one table of document counts by feature
(:func:`feature_counts`).  Counts are sums, so those of a later batch are added
(:func:`merged_counts`) and stored with the corpus, and any batch is embedded
with the same stored counts (:func:`embed_hashed`): no fitting, and equal
texts get equal vectors whichever batch they come in.

A caller may pass ``embedder(pandas.Series of texts) -> list of vectors``; it
runs through ``mapInPandas`` in Arrow batches of ``batch_size`` rows, ids
travel with their texts (a dropped or failed text can never shift vectors onto
other ids), and a failed batch yields error rows instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import col_of, strip

SLICE_ROWS = 512
EMBED_SCHEMA = "id long, embedding array<float>, error string"


def clean_for_embedding(text: Column | str) -> Column:
    """V5: newlines and tabs become spaces, ends stripped; empty -> null."""
    t = strip(F.regexp_replace(col_of(text), "[\n\t]", " "))
    return F.when(t != "", t)


def embed_texts(df: DataFrame, id_col: str, text_col: str, embedder: Callable[[pd.Series], list] | None = None,
                num_features: int = 256, batch_size: int = L.EMBED_BATCH) -> DataFrame:
    """``(id, embedding, error)`` for every non-empty text; the default embedder weighs by these texts themselves."""
    if embedder is None:
        return embed_hashed(df, feature_counts(df, text_col, num_features), id_col, text_col, num_features)
    rows = _cleaned(df, id_col, text_col)

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                try:
                    vecs = embedder(part["text"])
                    if len(vecs) != len(part):
                        raise ValueError(f"embedder returned {len(vecs)} vectors for {len(part)} texts")
                    yield pd.DataFrame({"id": part["id"].to_numpy(),
                                        "embedding": [np.asarray(v, dtype=np.float32) for v in vecs],
                                        "error": None})
                except Exception as e:  # noqa: BLE001 - a failed call fails its rows only
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": None, "error": f"Error: {e}"})

    return rows.mapInPandas(run, EMBED_SCHEMA)


def _cleaned(df: DataFrame, id_col: str | Column, text_col: str) -> DataFrame:
    return df.select(col_of(id_col).cast("long").alias("id"), clean_for_embedding(text_col).alias("text")).where(F.col("text").isNotNull())


def _words(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(col_of(text)), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _features(words: pa.ListArray, num_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every word: its MD5 sum's first 32 bits modulo their number, so any engine gives the same.

    Each distinct word of the rows is hashed once.
    """
    coded = words.flatten().dictionary_encode()
    own = np.array([int.from_bytes(md5(w.encode()).digest()[:4], "big") % num_features for w in coded.dictionary.to_pylist()], np.int64)
    return np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy())), own[coded.indices.to_numpy()]


def _counts(words: pa.ListArray, num_features: int) -> np.ndarray:
    """Word counts by row and feature."""
    row, feature = _features(words, num_features)
    return np.bincount(row * num_features + feature, minlength=len(words) * num_features).reshape(-1, num_features)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, SLICE_ROWS):
            yield whole.slice(first, SLICE_ROWS)


DOCUMENTS = -1  # the feature that every text has


def feature_counts(df: DataFrame, text_col: str, num_features: int = 256) -> DataFrame:
    """``(feature, df)``: the number of texts that hold each feature; feature -1 counts the texts."""
    rows = _cleaned(df, F.lit(0), text_col).select(_words("text").alias("words"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + num_features, np.int64)
        for b in _slices(batches):
            total += np.append(b.num_rows, (_counts(b.column(0), num_features) > 0).sum(axis=0))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(there == 0, DOCUMENTS, there - 1), pa.int32()), pa.array(total[there])], names=["feature", "df"])

    return rows.mapInArrow(held, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Counts of several batches as those of all their texts."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("feature").agg(F.sum("df").alias("df"))


def embed_hashed(df: DataFrame, counts: DataFrame, id_col: str, text_col: str, num_features: int = 256) -> DataFrame:
    """``(id, embedding, error)``: word counts by feature, times ln((texts + 1) / (texts with it + 1)), scaled to length 1.

    A text without words, or with none that tells texts apart, gets zeros.  ``counts`` has ``num_features`` + 1 rows at most.
    """
    total = F.max(F.when(F.col("feature") == DOCUMENTS, F.col("df")))
    held = F.map_from_entries(F.collect_list(F.struct("feature", "df")))
    known = counts.agg(total.alias("n"), held.alias("held"))
    weight = lambda f: F.coalesce(F.log((F.col("n") + 1) / (F.coalesce(F.try_element_at("held", f), F.lit(0)) + 1)), F.lit(0.0))
    weights = known.select(F.transform(F.sequence(F.lit(0), F.lit(num_features - 1)), weight).alias("w")).scalar()
    rows = _cleaned(df, id_col, text_col).select("id", _words("text").alias("words"), weights.alias("w"))

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            raw = _counts(b.column(1), num_features) * b.column(2).slice(0, 1).flatten().to_numpy()
            size = np.sqrt(np.cumsum(raw * raw, axis=1)[:, -1:])  # summed in the order of the features
            vecs = np.divide(raw, size, out=np.zeros_like(raw), where=size > 0).astype(np.float32)
            at = pa.array(np.arange(0, vecs.size + 1, num_features), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(vecs.ravel()))], names=["id", "embedding"])

    out = rows.mapInArrow(embedded, "id long, embedding array<float>")
    return out.withColumn("error", F.lit(None).cast("string"))
