"""Positional gram postings of stored texts: substring tests that read no text.

``write_postings`` runs once for a store.  The grams of each text in lower
case (four bytes as one number), with their positions, become at most
``PARTS`` rows a text, one for each remainder of its grams; texts shorter than a gram, and
the last bytes of every text, are padded with the byte 0xFF, which UTF-8
never uses.  A row holds its distinct grams in order, how many positions each
has, and all positions one after the other.  The table is laid out in ``PARTS`` folders
by that remainder, so a batch of long keywords reads the folders of its own grams only.

``Postings.hits`` answers ``(id, keywords)`` pairs: a keyword is the grams at
offsets 0, 4, 8, ... and the one that ends it; it occurs where the positions
of its grams agree.  Keywords of fewer than four bytes are compared with the
first one, two or three bytes of the grams.  A bitmap of fixed size keeps
grams that nobody asked of their text in the tasks that read them.  The answer is that of looking for each keyword
in each text (tests compare both).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirsearch.session import written

WIDTH = 4
PARTS = 61
SLICE_BYTES = 1 << 20
BITS = 1 << 26  # 8 MB
MOST_PLACES = 0xFFFF  # of one entry; a gram with more has several


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary rows of ``sizes`` values each."""
    bounds = np.append(0, np.cumsum(sizes)) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of the binary rows, and how many each row has."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data.view(kind) if data.ctypes.data % 4 == 0 else data.copy().view(kind), np.diff(bounds) // np.dtype(kind).itemsize


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... in each of the groups of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, grams, counts, places) of every text: grams in 32 bits, counts in 16, places in 16 or, in long texts, 32."""
    for whole in batches:
        step = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
        for first in range(0, whole.num_rows, step):
            b = whole.slice(first, step)
            texts = [t.encode() for t in b.column(1).to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            buf = np.frombuffer(b"".join(t + b"\xff" * (WIDTH - 1) for t in texts), np.uint8).astype(np.int64)
            start = np.cumsum(size + WIDTH - 1) - (size + WIDTH - 1)
            row, pos = np.repeat(np.arange(len(texts)), size), _within(size)
            at = start[row] + pos
            gram = buf[at] << 24 | buf[at + 1] << 16 | buf[at + 2] << 8 | buf[at + 3]
            part = gram % PARTS
            order = np.lexsort((gram, row * PARTS + part))  # stable: positions stay in order
            row, part, gram, pos = row[order], part[order], gram[order], pos[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
            begin = np.flatnonzero(new)
            new[begin.repeat((np.diff(np.append(begin, len(row))) - 1) // MOST_PLACES) + MOST_PLACES * (1 + _within((np.diff(np.append(begin, len(row))) - 1) // MOST_PLACES))] = True
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(row)))
            for wide in (False, True):
                own = (size > MOST_PLACES) == wide
                entry, place = own[row[begin]], own[row]
                if not entry.any():
                    continue
                r, p = row[begin][entry], part[begin][entry]
                opens = np.ones(len(r), bool)
                opens[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
                opens = np.flatnonzero(opens)
                entries = np.diff(np.append(opens, len(r)))
                places = np.add.reduceat(count[entry], opens)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r[opens])), pa.array(p[opens].astype(np.int32)), _binary(gram[begin][entry].astype("<u4"), entries),
                                                  _binary(count[entry].astype("<u2"), entries), _binary(pos[place].astype("<u4" if wide else "<u2"), places)],
                                                 names=["id", "part", "grams", "counts", "places"])


def write_postings(texts: DataFrame, path: str) -> Postings:
    """Postings of ``texts`` (id, text) under ``path``, and the ids that have a text."""
    spark = texts.sparkSession
    body = texts.where(F.col("text").isNotNull()).select(F.col("id").cast("long").alias("id"), F.lower(F.col("text").cast("string")).alias("text"))
    rows = body.where("text <> ''").mapInArrow(_posting_rows, "id long, part int, grams binary, counts binary, places binary")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/grams", compression="zstd")
    body.select("id").write.mode("overwrite").parquet(f"{path}/ids")
    return Postings(spark, path)


def _spot(ids: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The bit of a gram of a text."""
    h = (ids.view(np.uint64) + gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)


def _longs(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_spot(_longs(b.column(0)), _longs(b.column(1))))], names=["spot"])


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """One bit for each (id, gram) that is asked; it passes the driver (``BITS`` / 8 bytes at most)."""
    place = F.col("spot") + 1  # Spark's buckets of 4,096 bytes count from 1
    rows = (pairs.mapInArrow(_spots, "spot long").groupBy(F.bitmap_bucket_number(place).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect())
    flags = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * (1 << 12)
        flags[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return flags


def _asked_grams(bitmap: np.ndarray):
    """Stored rows to (id, gram, places) of the grams that hit the bitmap, places in 32 bits; and (id, head) of the first
    bytes of grams that hit it, with a place that says nothing."""

    def hit(ids, gram):
        spot = _spot(ids, gram)
        return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
            for first in range(0, whole.num_rows, step):
                b = whole.slice(first, step)
                grams, entries = _values(b.column(1), "<u4")
                counts, _ = _values(b.column(2), "<u2")
                gram, count, row = grams.astype(np.int64), counts.astype(np.int64), np.repeat(np.arange(b.num_rows), entries)
                own = _longs(b.column(0))[row]
                # bytes of a place in each row
                sizes = _values(b.column(3), "u1")[1]
                width = sizes // np.maximum(1, np.add.reduceat(count, np.cumsum(entries) - entries)) if len(row) else sizes
                data = _values(b.column(3), "u1")[0]
                begin = np.cumsum(count * width[row]) - count * width[row]
                at = np.flatnonzero(hit(own, gram))
                n, w = count[at], width[row[at]].repeat(count[at])
                byte = begin[at].repeat(n) + _within(n) * w
                places = data[byte].astype(np.uint32) | data[byte + 1].astype(np.uint32) << np.uint32(8)
                far = np.flatnonzero(w == 4)
                places[far] |= data[byte[far] + 2].astype(np.uint32) << np.uint32(16) | data[byte[far] + 3].astype(np.uint32) << np.uint32(24)
                opens = np.ones(len(at), bool)  # entries of one gram follow each other
                opens[1:] = (row[at][1:] != row[at][:-1]) | (gram[at][1:] != gram[at][:-1])
                opens = np.flatnonzero(opens)
                sums = np.add.reduceat(n, opens) if len(opens) else n
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at][opens])), pa.array(gram[at][opens]), _binary(places.astype("<u4"), sums)], names=["id", "gram", "places"])
                for k in range(1, WIDTH):
                    head = _head(k, gram >> 8 * (WIDTH - k))
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (head[1:] != head[:-1])
                    at = np.flatnonzero(new & hit(own, head))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at])), pa.array(head[at]), _binary(np.zeros(len(at), "<u4"), np.ones(len(at), np.int64))], names=["id", "gram", "places"])

    return run


def _head(size, number):
    """The number of the first ``size`` bytes of grams, beyond all grams."""
    return number + size * (1 << 8 * WIDTH)


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, kw, lists of offset and places of the keyword's grams) to the pairs whose grams agree somewhere."""
    for b in batches:
        keep = []
        for offsets, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            common = None
            for o, p in sorted(zip(offsets, places), key=lambda x: len(x[1])):
                begins = np.frombuffer(p, "<i4") - o
                common = begins if common is None else np.intersect1d(common, begins, assume_unique=True)
                if not len(common):
                    break
            keep.append(len(common) > 0)
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["id", "kw"])


@dataclass(frozen=True)
class Postings:
    spark: SparkSession
    path: str

    def hits(self, pairs: DataFrame) -> DataFrame:
        """``(id, found)``: of the keywords asked for each id with a text, those that its text contains (keywords are in lower case).

        What is asked is written to the shared folder and its bitmap is made while the plan is built."""
        schema = "id long, grams binary, counts binary, places binary, part int"
        ids = self.spark.read.schema("id long").parquet(f"{self.path}/ids").distinct()
        asked = written(pairs.select(F.col("id").cast("long").alias("id"), F.explode("keywords").alias("kw")).where("kw is not null").distinct(), "postings-asked")
        distinct = asked.select("kw").distinct().withColumn("b", F.col("kw").cast("binary")).withColumn("size", F.octet_length("kw"))
        number = lambda b: F.conv(F.hex(b), 16, 10).cast("long")
        # offsets 0, 4, 8, ... and that of the last gram
        offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("size") - WIDTH, F.lit(WIDTH)), F.array(F.col("size") - WIDTH)))
        long = (distinct.where(F.col("size") >= WIDTH).select("kw", F.size(offsets).alias("need"), F.explode(offsets).alias("o"), "b")
                .select("kw", "need", "o", number(F.substring("b", F.col("o") + 1, F.lit(WIDTH))).alias("gram"), F.lit(False).alias("head")))
        # short keywords: a gram of the text begins with them; the padding byte keeps ends apart
        short = (distinct.where((F.col("size") < WIDTH) & (F.col("size") > 0))
                 .select("kw", F.lit(1).alias("need"), F.lit(0).alias("o"), _head(F.col("size").cast("long"), number(F.col("b"))).alias("gram"), F.lit(True).alias("head")))
        wanted = asked.join(long.unionAll(short), "kw")
        parts = [r["part"] for r in long.select(F.pmod("gram", F.lit(PARTS)).cast("int").alias("part")).distinct().collect()] if short.isEmpty() else range(PARTS)
        grams = (self.spark.read.schema(schema).parquet(f"{self.path}/grams").where(F.col("part").isin(list(parts)))
                 .select("id", "grams", "counts", "places").mapInArrow(_asked_grams(_bitmap(wanted.select("id", "gram"))), "id long, gram long, places binary"))
        met = (grams.join(wanted, ["gram", "id"]).groupBy("id", "kw")
               .agg(F.first("need").alias("need"), F.first("head").alias("head"), F.collect_list(F.struct("o", "places")).alias("x")).where((F.size("x") == F.col("need")) | F.col("head"))
               .select("id", "kw", F.col("x.o").alias("o"), F.col("x.places").alias("places")).mapInArrow(_occurring, "id long, kw string"))
        empty = asked.where("kw = ''")
        found = met.unionAll(empty.select("id", "kw")).groupBy("id").agg(F.collect_set("kw").alias("found"))
        return ids.join(pairs.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").join(found, "id", "left").select(
            "id", F.coalesce("found", F.array().cast("array<string>")).alias("found"))
