"""Line dedup by winnowing over line hashes.

Lines that hold a word, trimmed of separators, are hashed; ``GRAM`` lines make a gram, and of each ``SPAN`` grams in a
row the least hash (the last among equals) is a fingerprint.  So any run of ``SPAN + GRAM - 1`` lines that occurs twice
has a fingerprint in common.  Fingerprints found twice are joined back to their positions, and each such match is
extended both ways to the whole windows around it; the windows are compared by hash.  A window whose lines also stand
earlier (by id, then position) is deleted; longer repeated runs are rows of such windows.

Defined results: null texts stay null, empty texts empty; lines without a word are neither compared nor deleted, but a
text that loses all its other lines becomes empty; rows equal in id and text count as one document, so none of them is
earlier; null ids come first; extra columns pass through.

The least run is a parameter: op3_line_dedup has runs of ``RUN`` = 3 lines, as its SQL says; the corpus pipeline calls
``without_later_runs`` with gram = span = 1, where each line that stands earlier goes, so that runs of any length and
texts of one or two lines are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirsearch.llm import flat
from dirsearch.llm.registry import register, table
from dirsearch.llm.store import KEY_HASH, KEY_ID, NULL_ID, keyed, written

GRAM, SPAN = 2, 2
RUN = GRAM + SPAN - 1

_KEYS = [T.StructField(KEY_ID, T.LongType()), T.StructField(KEY_HASH, T.LongType())]


def hashed_lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and line number of the lines that hold a word."""
    s, e, _ = flat.words(buf, offs)
    ls, le, row, number = flat.lines(buf, offs)
    first, last = np.searchsorted(s, ls, side="left"), np.searchsorted(e, le, side="right") - 1
    has = first <= last
    return flat.span_hash(buf, s[first[has]], e[last[has]]), row[has], number[has]


def winnowed(h: np.ndarray, row: np.ndarray, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of gram + span - 1 lines; the place and the hash of the fingerprint of each."""
    least = gram + span - 1
    n = len(h) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(g)]
    g = flat.mix(g)
    start = np.flatnonzero(row[:n] == row[least - 1 :])
    place = start + span - 1 - sliding_window_view(g, span)[start, ::-1].argmin(axis=1)
    return start, place, g[place]


def fingerprints(docs: DataFrame, text: str, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """The selected fingerprints, one row for each place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in flat.chunks(b.column(0)):
                h, row, _ = hashed_lines(buf, offs)
                _, place, f = winnowed(h, row, gram, span)
                new = np.ones(len(f), bool)  # windows in a row share a fingerprint
                new[1:] = place[1:] != place[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(flat.signed(f[new]))], names=["f"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, T.StructType([T.StructField("f", T.LongType())]))


def windows(docs: DataFrame, text: str, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Every window of gram + span - 1 lines: document, start, fingerprint and two hashes of its lines."""
    schema = T.StructType([*_KEYS, *(T.StructField(n, T.LongType()) for n in ("start", "f", "x", "y"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in flat.chunks(b.column(2)):
                h, row, _ = hashed_lines(buf, offs)
                start, _, f = winnowed(h, row, gram, span)
                x, y = (flat.signed(flat.span_hash(h, start, start + gram + span - 1, k)) for k in (0, 1))
                r = row[start]
                take = pa.array(r + lo)
                at = start - flat.row_bounds(row, hi - lo)[r]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at), pa.array(flat.signed(f)),
                                                  pa.array(x), pa.array(y)], names=schema.names)

    return keyed(docs, text).select(KEY_ID, KEY_HASH, F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def later_windows(docs: DataFrame, text: str = "text", gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """For each document that repeats earlier runs: the starts of the windows to delete."""
    common = fingerprints(docs, text, gram, span).groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    matched = written(windows(docs, text, gram, span).join(common, "f").drop("f"), "line-windows")
    place = F.struct(KEY_ID, KEY_HASH, "start")
    first = matched.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("x", "y", "first")
    return matched.join(first, ["x", "y"]).where(place != F.col("first")).groupBy(KEY_ID, KEY_HASH).agg(F.collect_list("start").alias("_starts"))


def without_later_runs(docs: DataFrame, text: str = "text", gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """docs with the later repeated runs deleted from its texts, and the counts ``_n_lines`` and ``_n_removed``."""
    least = gram + span - 1
    names = docs.columns
    at = names.index(text)
    joined = (keyed(docs, text).join(later_windows(docs, text, gram, span), [KEY_ID, KEY_HASH], "left")
              .select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in names], "_starts"))
    schema = T.StructType([*joined.schema.fields[:-1], T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts = b.column(at), b.column(len(names))
            for lo, hi, buf, offs in flat.chunks(texts):
                _, row, number = hashed_lines(buf, offs)
                bounds = flat.row_bounds(row, hi - lo)
                out, gone = texts.slice(lo, hi - lo).to_pylist(), np.zeros(hi - lo, np.int64)
                for i in np.flatnonzero(starts.slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)):
                    first = np.array(starts[lo + int(i)].as_py())
                    drop = np.zeros(bounds[i + 1] - bounds[i], bool)
                    for k in range(least):
                        drop[first + k] = True
                    gone[i] = drop.sum()
                    dead = set(number[bounds[i] : bounds[i + 1]][drop].tolist())
                    out[i] = "" if drop.all() else "\n".join(x for k, x in enumerate(out[i].split("\n")) if k not in dead)
                part = [c.slice(lo, hi - lo) for c in b.columns[: len(names)]]
                part[at] = pa.array(out, texts.type)
                yield pa.RecordBatch.from_arrays([*part, pa.array(np.diff(bounds)), pa.array(gone)], names=schema.names)

    return joined.mapInArrow(run, schema)


ORACLE = rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) num from documents),
n as (select doc_id, num, row_number() over (partition by doc_id order by num) pos,
             regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') line
      from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
w as (select doc_id, pos, {" || chr(10) || ".join(["line", *(f"lead(line, {k}) over p" for k in range(1, RUN))])} win
      from n window p as (partition by doc_id order by pos)),
later as (select doc_id, pos from (select *, row_number() over (partition by win order by doc_id, pos) r from w where win is not null) where r > 1),
gone as (select distinct doc_id, pos + k pos from later, range({RUN}) t(k)),
marked as (select n.doc_id, n.num, g.pos is not null dead from n left join gone g using (doc_id, pos)),
c as (select doc_id, count(*) n_lines, count(*) filter (dead) n_removed from marked group by doc_id),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.num) t from l left join marked m using (doc_id, num)
         where not coalesce(dead, false) group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed,
       sha256(case when n_removed = n_lines and n_lines > 0 then '' else coalesce(t, '') end) kept_sha256
from documents d left join c using (doc_id) left join kept using (doc_id)
"""


@register("op3_line_dedup", ORACLE)
def op3_line_dedup(spark, sf_dir):
    out = without_later_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
