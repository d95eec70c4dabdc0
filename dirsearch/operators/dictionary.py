"""Texts against a large dictionary: which entries occur as substrings of which texts.

The list form (:func:`dirsearch.functions.text.dict_hits`) writes every entry
into the plan and suits some hundred entries.  Here the dictionary is a table.
Each entry is found through one of its grams, a run of bytes whose length is
the largest power of two, up to ``WIDEST``, that fits into the entry; so grams
are exact 64-bit numbers, not hashes.

1. The dictionary's grams become a bitmap of ``BITS`` bits (its size does not
   depend on the dictionary); a first pass over the texts counts, for grams
   that hit it, the texts that hold them.
2. An entry with a gram that no text holds is done.  Of the others the gram in
   the fewest texts is the anchor.
3. A second pass emits (text, gram) for grams that hit the anchors' bitmap;
   these meet the anchors in an equi-join, and what meets is verified against
   the whole text.

A bitmap only spares rows: grams that hit it by chance find no partner in the
joins.  When a dictionary outgrows the bitmap the result stays the same and
the joins see more rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirsearch.session import written

WIDEST = 8
WIDTHS = [1, 2, 4, 8]
BITS = 1 << 25  # 4 MB
BATCH_BYTES = 1 << 20


def _grams(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and gram (the bytes as one number) at every place of the rows where the width fits."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = buf.astype(np.uint64)
    have = 1
    while have < width:
        g = (g[: len(g) - have] << np.uint64(8 * have)) | g[have:]
        have *= 2
    row = np.searchsorted(offs, np.arange(n), side="right") - 1
    inside = np.arange(n) + width <= offs[row + 1]
    return row[inside], g[inside].view(np.int64)


def _distinct(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, gram) pairs."""
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _spot(gram: np.ndarray, width: int) -> np.ndarray:
    """The gram's bit."""
    h = (gram.view(np.uint64) + np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of the texts, about ``BATCH_BYTES`` at a time; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BATCH_BYTES, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _entry_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of every entry, of the entry's own width."""
    for b in batches:
        for lo, hi, buf, offs in _runs(b.column(0)):
            size = np.diff(offs)
            for k, width in enumerate(WIDTHS):
                own = (size >= width) & ((size < 2 * width) | (width == WIDEST))
                row, gram = _grams(buf, offs, width)
                row, gram = _distinct(row[own[row]], gram[own[row]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(np.full(len(row), width, np.int32)),
                                                  pa.array(gram), pa.array(_spot(gram, width))], names=["entry", "width", "gram", "spot"])


def _bitmap(grams: DataFrame) -> np.ndarray:
    """One flag for each bit that a gram sets; as a bitmap it passes the driver (``BITS`` / 8 bytes at most)."""
    place = F.col("spot") + 1  # Spark's buckets of 4,096 bytes count from 1
    rows = grams.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    flags = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * (1 << 12)
        flags[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return flags


def _text_grams(bitmap: np.ndarray, counted: bool):
    """Grams of the texts that hit the bitmap: distinct ones of each text, or in how many texts of a batch each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, buf, offs in _runs(b.column(1)):
                for width in WIDTHS:
                    row, gram = _grams(buf, offs, width)
                    spot = _spot(gram, width)
                    hit = (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                    row, gram = _distinct(row[hit], gram[hit])
                    if counted:
                        found, n = np.unique(gram, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), width, np.int32)), pa.array(found), pa.array(n)], names=["width", "gram", "n"])
                    else:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + lo)), pa.array(np.full(len(row), width, np.int32)), pa.array(gram)],
                                                         names=["id", "width", "gram"])

    return run


def dictionary_hits(texts: DataFrame, dictionary: DataFrame, *, id_col: str = "id", text_col: str = "text", entry_col: str = "entry",
                    fold: bool = False) -> DataFrame:
    """``(id, entry)``: every distinct entry that occurs in the text, anywhere (with ``fold``: in any case).

    ``id`` is the texts' key.  Empty and null entries and null texts match
    nothing.  Runs jobs for the two bitmaps while the plan is built.
    """
    cased = (lambda c: F.lower(c)) if fold else (lambda c: F.col(c))
    entries = dictionary.select(F.col(entry_col).cast("string").alias("entry")).where("entry <> ''").distinct()
    look = entries.select(cased("entry").alias("entry")).distinct()
    body = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''").withColumn("text", cased("text"))
    grams = written(look.mapInArrow(_entry_grams, "entry string, width int, gram long, spot long"), "dictionary-grams")
    counts = (body.mapInArrow(_text_grams(_bitmap(grams), True), "width int, gram long, n long").groupBy("width", "gram").agg(F.sum("n").alias("n")))
    key = F.struct("n", "width", "gram", "spot")
    anchors = (grams.join(counts, ["width", "gram"], "left").groupBy("entry").agg(F.min(key).alias("a"), F.count_if(F.col("n").isNull()).alias("missing"))
               .where("missing = 0").select("entry", "a.width", "a.gram", "a.spot"))
    anchors = written(anchors, "dictionary-anchors")
    places = body.mapInArrow(_text_grams(_bitmap(anchors), False), f"id {texts.schema[id_col].dataType.simpleString()}, width int, gram long")
    maybe = places.join(anchors.select("entry", "width", "gram"), ["width", "gram"]).groupBy("id").agg(F.collect_list("entry").alias("maybe"))
    hits = maybe.join(body, "id").select("id", F.explode(F.filter("maybe", lambda e: F.contains(F.col("text"), e))).alias("entry"))
    if not fold:
        return hits
    return hits.withColumnRenamed("entry", "low").join(entries.withColumn("low", F.lower("entry")), "low").select("id", "entry")
