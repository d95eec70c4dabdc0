"""Substring dedup by phrases and windows looked up in an indexed reference of all documents.

The reference is the whole corpus, cut into phrases by content: each window of ``window`` words is assigned to its anchor
(the first of its smallest gram hashes), and a phrase is the stretch of words that an anchor's windows span.  Equal
windows have equal anchors, wherever they stand, so the index (phrases by anchor, dealt over blocks by hash) finds every
repeat.

Each phrase is looked up on its own, by anchor and hash: where it is in the index as a whole, all its windows are repeats.
Otherwise its windows themselves are checked: each is looked up among the windows of the phrases that share its anchor, of
which one occurrence each stands in the reference.  This replaces a greedy parse: no factor over several phrases, length
or reference place is formed, as the result needs only which windows are repeated.
So windows are hashed for such phrases only,
copies in any number cost one reference occurrence, and no pairs of occurrences are made.

Defined results: null and empty texts have no words; texts shorter than a window keep all words; rows equal in id and
text are two documents, so what they share goes from both; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirsearch.llm import flat
from dirsearch.llm.registry import register, table
from dirsearch.llm.store import KEY_HASH, KEY_ID, NULL_ID, keyed, written

WINDOW = 35
GRAM = 8

REPEATED, BOUNDARY, REFERENCE = 1, 2, 4

_KEYS = [T.StructField(KEY_ID, T.LongType()), T.StructField(KEY_HASH, T.LongType())]


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


class Parse:
    """The phrases of a chunk of texts: at[i] is the anchor's word, lo[i]..hi[i] are the starts of its windows."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int):
        s, e, self.row = flat.words(buf, offs)
        self.h = flat.span_hash(buf, s, e)
        self.bounds = flat.row_bounds(self.row, len(offs) - 1)
        n, self.window = len(self.h) - window + 1, window
        self.at = self.lo = self.hi = np.zeros(0, np.int64)
        self.a = np.zeros(0, np.uint64)
        if n > 0:
            grams = np.zeros(len(self.h) - GRAM + 1, np.uint64)
            for i in range(GRAM):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + self.h[i : i + len(grams)]
            grams = flat.mix(grams)
            start = np.flatnonzero(self.row[:n] == self.row[window - 1 :])
            at = start + sliding_window_view(grams, window - GRAM + 1)[start].argmin(axis=1)
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1]
            last = np.ones(len(at), bool)
            last[:-1] = first[1:]
            self.at, self.lo, self.hi = at[first], start[first], start[last]
            self.a = grams[self.at]

    def contexts(self) -> np.ndarray:
        """Hash of each phrase and of the anchor's place in it."""
        c = flat.span_hash(self.h, self.lo, self.hi + self.window)
        return flat.mix(c ^ ((self.at - self.lo).astype(np.uint64) << np.uint64(32)))

    def find(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the phrases by row and anchor word."""
        return np.searchsorted(self.at, self.bounds[rows] + at)

    def covered(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which words lie in windows that start at lo..hi."""
        change = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(change, lo, 1)
        np.add.at(change, hi + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def _flat_list(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of rows lo..hi of a list column (null: no values)."""
    part = column.slice(lo, hi - lo)
    lengths = np.array([0 if x is None else x for x in part.value_lengths().to_pylist()], np.int64)
    return np.repeat(np.arange(hi - lo), lengths), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return keyed(docs, text).select(KEY_ID, KEY_HASH, F.col(f"`{text}`").cast("string").alias("text"))


def anchors(docs: DataFrame, text: str, window: int) -> DataFrame:
    """The anchor hash of every phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in flat.chunks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(flat.signed(Parse(buf, offs, window).a))], names=["a"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, T.StructType(_long("a")))


def phrases(docs: DataFrame, text: str, window: int) -> DataFrame:
    """Every phrase: document, anchor word, anchor hash, phrase hash."""
    schema = T.StructType([*_KEYS, *_long("at", "a", "c")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in flat.chunks(b.column(2)):
                p = Parse(buf, offs, window)
                row = p.row[p.at]
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(p.at - p.bounds[row]),
                                                  pa.array(flat.signed(p.a)), pa.array(flat.signed(p.contexts()))], names=schema.names)

    return _texts(docs, text).mapInArrow(run, schema)


def _kept(raw: bytes, keep: np.ndarray | None) -> str:
    words = raw.split()  # bytes.split() takes just the separators of words
    return b" ".join(words if keep is None else compress(words, keep.tolist())).decode()


def parsed(texts: DataFrame, window: int) -> DataFrame:
    """Documents and the marks of their phrases to kept texts; those with boundaries wait with their text and marks."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*_KEYS, *_long("n_words", "n_removed"), T.StructField("kept", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("at", longs), T.StructField("code", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in flat.chunks(b.column(2)):
                p = Parse(buf, offs, window)
                row, at = _flat_list(b.column(3), lo, hi)
                code = _flat_list(b.column(4), lo, hi)[1]
                sure = p.find(row[code == REPEATED], at[code == REPEATED])
                gone = p.covered(p.lo[sure], p.hi[sure])
                waits = np.bincount(row[code != REPEATED], minlength=hi - lo) > 0
                removed = np.bincount(p.row[gone], minlength=hi - lo)
                kept = [None if waits[i] else _kept(buf[offs[i] : offs[i + 1]].tobytes(),
                                                    ~gone[p.bounds[i] : p.bounds[i + 1]] if removed[i] else None) for i in range(hi - lo)]
                wait = pa.array(np.arange(lo, hi), mask=~waits)  # null for those that are done
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(p.bounds)), pa.array(removed),
                     pa.array(kept, pa.string()), b.column(2).take(wait), b.column(3).take(wait),
                     b.column(4).take(wait)], names=schema.names)

    return texts.mapInArrow(run, schema)


def boundary_windows(waiting: DataFrame, window: int) -> DataFrame:
    """The windows of boundary and reference phrases, by two hashes."""
    schema = T.StructType([*_KEYS, *_long("start", "x", "y"), T.StructField("asked", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in flat.chunks(b.column(2)):
                p = Parse(buf, offs, window)
                row, at = _flat_list(b.column(3), lo, hi)
                code = _flat_list(b.column(4), lo, hi)[1]
                row, at, code = row[code != REPEATED], at[code != REPEATED], code[code != REPEATED]
                k = p.find(row, at)
                size = p.hi[k] - p.lo[k] + 1
                start = np.repeat(p.lo[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row = np.repeat(row, size)
                take = pa.array(row + lo)
                x, y = (flat.signed(flat.span_hash(p.h, start, start + window, f)) for f in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(start - p.bounds[row]), pa.array(x),
                                                  pa.array(y), pa.array(np.repeat(code == BOUNDARY, size))], names=schema.names)

    return waiting.select(KEY_ID, KEY_HASH, "text", "at", "code").mapInArrow(run, schema)


def finished(waiting: DataFrame, window: int) -> DataFrame:
    """Waiting documents and the starts of their repeated boundary windows to kept texts."""
    schema = T.StructType([*_KEYS, *_long("n_words", "n_removed"), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in flat.chunks(b.column(2)):
                p = Parse(buf, offs, window)
                row, at = _flat_list(b.column(3), lo, hi)
                code = _flat_list(b.column(4), lo, hi)[1]
                srow, start = _flat_list(b.column(5), lo, hi)
                sure = p.find(row[code == REPEATED], at[code == REPEATED])
                start = start + p.bounds[srow]
                gone = p.covered(np.concatenate([p.lo[sure], start]), np.concatenate([p.hi[sure], start]))
                kept = [_kept(buf[offs[i] : offs[i + 1]].tobytes(), ~gone[p.bounds[i] : p.bounds[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(p.bounds)),
                                                  pa.array(np.bincount(p.row[gone], minlength=hi - lo)), pa.array(kept, pa.string())],
                                                 names=schema.names)

    return waiting.select(KEY_ID, KEY_HASH, "text", "at", "code", "starts").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document its key, n_words, n_removed and the kept words joined by one space."""
    key = [KEY_ID, KEY_HASH]
    common = anchors(docs, text, window).groupBy("a").agg(F.count("*").alias("total")).where("total > 1").select("a")
    shared = written(phrases(docs, text, window).join(common, "a"), "substring-phrases")
    index = shared.groupBy("a", "c").agg(F.count("*").alias("n"))
    several = index.groupBy("a").agg(F.count("*").alias("contexts"))
    index = written(index.join(several, "a"), "substring-index")
    placed = shared.join(index, ["a", "c"])
    reference = (placed.where("n > 1 and contexts > 1").groupBy("a", "c").agg(F.min(F.struct(*key, "at")).alias("m"))
                 .select("m.*", F.lit(REFERENCE).alias("code")))
    marks = (placed.select(*key, "at", F.when(F.col("n") > 1, REPEATED).otherwise(BOUNDARY).alias("code")).unionAll(reference)
             .groupBy(*key).agg(F.collect_list(F.struct("at", F.col("code").cast("long").alias("code"))).alias("m"))
             .select(*key, F.col("m.at").alias("at"), F.col("m.code").alias("code")))
    state = written(parsed(_texts(docs, text).join(marks, key, "left"), window), "substring-state", compression="zstd")
    waiting = state.where("text is not null")
    windows = boundary_windows(waiting, window)
    twice = windows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    starts = windows.where("asked").join(twice, ["x", "y"]).groupBy(*key).agg(F.collect_list("start").alias("starts"))
    rest = finished(waiting.join(starts, key, "left"), window)
    return state.where("text is null").select(*key, "n_words", "n_removed", "kept").unionAll(rest)


@register("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.when(F.col(KEY_ID) != NULL_ID, F.col(KEY_ID)).alias("doc_id"), "n_words", "n_removed",
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
