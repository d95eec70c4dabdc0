"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Main path: one Arrow pass measures every whole text; integer rates go into bucket sketches (counts per bucket, merged
by adding counts) per (language, source); the quartiles of a sketch give an upper fence for each rate; a join applies
the fences.  Groups with few documents borrow the merged sketch of their language, or of everything.

Defined results: a null text counts as empty; null language or source form groups of their own; an empty table gives
an empty result; rows that are equal are measured alike; extra columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dirsearch.llm import flat
from dirsearch.llm.registry import register, table
from dirsearch.llm.store import written

# The symbols that are counted, and the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# Each rate is an integer; the fence is q3 + FENCE * max(q3 - q1, least spread).
FENCE = 3
RATES = {  # name: (numerator, denominator, scale, least spread)
    "symbols": ("n_symbols", "n_words", 1000, 60),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 150),
    "repeats": ("n_repeat_words", "n_words", 1000, 120),
    "word_length": ("word_chars", "n_words", 100, 200),
    "capitals": ("n_capitals", "word_chars", 1000, 60),
}
MIN_GROUP = 50  # documents a group needs for thresholds of its own

SLICE_BYTES = 4 << 20  # of a batch that goes back at once

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a column."""
    out = {c: np.zeros(len(column), np.int64) for c in COUNTS}
    for lo, hi, buf, offs in flat.chunks(column):
        n = hi - lo
        s, e, row = flat.words(buf, offs)
        out["n_words"][lo:hi] = np.bincount(row, minlength=n)
        byte_row = np.repeat(np.arange(n), np.diff(offs))
        in_word = ~flat._IS_SEP[buf] & ((buf & 0xC0) != 0x80)  # one byte of each code point
        out["word_chars"][lo:hi] = np.bincount(byte_row[in_word], minlength=n)
        out["n_symbols"][lo:hi] = np.bincount(byte_row[_SYM[buf]], minlength=n)
        out["n_capitals"][lo:hi] = np.bincount(byte_row[(buf >= 65) & (buf <= 90)], minlength=n)
        ls, le, lrow, _ = flat.lines(buf, offs)
        has_word = np.searchsorted(s, le, side="left") > np.searchsorted(s, ls, side="left")
        ls, le, lrow = ls[has_word], le[has_word], lrow[has_word]
        n_lines = np.bincount(lrow, minlength=n)
        _, kept = flat.distinct_per_row(flat.span_hash(buf, ls, le), lrow)
        out["n_lines"][lo:hi] = n_lines
        out["n_dup_lines"][lo:hi] = n_lines - np.bincount(kept, minlength=n)
        at, g = flat.grams(flat.span_hash(buf, s, e), row, 3)
        again = np.zeros(len(s), bool)
        if len(at):
            order = np.lexsort((g, row[at]))
            gs, rs = g[order], row[at][order]
            same = (gs[1:] == gs[:-1]) & (rs[1:] == rs[:-1])
            twice = np.zeros(len(gs), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = at[order[twice]]
            for i in range(3):
                again[hit + i] = True
        out["n_repeat_words"][lo:hi] = np.bincount(row[again], minlength=n)
    return out


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "_q_", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) and the counts of each text under prefixed names."""
    keep = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    if text in keep and isinstance(docs.schema[text].dataType, T.StringType):
        at = keep.index(text)  # no second copy of the texts
    else:
        at = len(keep)
        source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(prefix + "text"))
    schema = T.StructType([*source.schema.fields[: len(keep)], *(T.StructField(prefix + c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
            for first in range(0, whole.num_rows, rows):
                b = whole.slice(first, rows)
                counts = measure(b.column(at))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(counts[c]) for c in COUNTS)],
                                                 names=[*keep, *(prefix + c for c in COUNTS)])

    return source.mapInArrow(run, schema)


def rate(name: str, prefix: str = "_q_"):
    """The integer rate, null where its denominator is 0."""
    num, den, scale, _ = RATES[name]
    return F.when(F.col(prefix + den) > 0, F.expr(f"{scale} * `{prefix}{num}` div `{prefix}{den}`"))


def bucket(v):
    """Bucket of an integer >= 0: exact below 64, then 32 buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return shift * 64 + F.call_function("shiftright", v, shift)


def bucket_top(b):
    """The largest value of a bucket."""
    shift = F.call_function("div", b, F.lit(64)).cast("int")
    return F.call_function("shiftleft", (b % 64).cast("long") + 1, shift) - 1


def thresholds(counted: DataFrame, prefix: str = "_q_", min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): the fence of each rate."""
    long = counted.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), rate(r, prefix).alias("v")) for r in RATES])).alias("x")).select("lang", "source", "x.*")
    sketch = written(long.where("v is not null").groupBy("lang", "source", "rate", bucket(F.col("v")).alias("bucket"))
                     .agg(F.count("*").alias("n")), "quality-sketch")
    levels = (sketch.select(F.lit(0).alias("level"), "lang", "source", "rate", "bucket", "n")
              .unionAll(sketch.select(F.lit(1), "lang", F.lit(None).cast("string"), "rate", "bucket", "n"))
              .unionAll(sketch.select(F.lit(2), F.lit(None).cast("string"), F.lit(None).cast("string"), "rate", "bucket", "n")))
    merged = levels.groupBy("level", "lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("level", "lang", "source", "rate")  # at most some 2,000 buckets
    ranked = (merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
              .withColumn("total", F.sum("n").over(w)))
    at = lambda p: F.min(F.when(F.expr(f"4 * upto >= {p} * total"), F.col("bucket")))
    fence = (ranked.groupBy("level", "lang", "source", "rate")
             .agg(bucket_top(at(1)).alias("q1"), bucket_top(at(3)).alias("q3"), F.first("total").alias("total")))
    spread = F.create_map(*[F.lit(x) for r, (_, _, _, least) in RATES.items() for x in (r, least)])
    fence = fence.withColumn("fence", F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("rate")]))
    own = fence.where("level = 0").select("lang", "source", "rate", "fence", "total")
    by_lang = fence.where("level = 1").select("lang", "rate", F.col("fence").alias("lang_fence"), F.col("total").alias("lang_total"))
    over_all = fence.where("level = 2").select("rate", F.col("fence").alias("all_fence"))
    f = (own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.rate") == F.col("l.rate")))
         .join(over_all.alias("a"), F.col("o.rate") == F.col("a.rate"))
         .select("o.lang", "o.source", "o.rate",
                 F.when(F.col("total") >= min_group, F.col("fence"))
                 .when(F.col("lang_total") >= min_group, F.col("lang_fence")).otherwise(F.col("all_fence")).alias("fence")))
    wide = f.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, F.col("fence"))).alias("fence_" + r) for r in RATES])
    return written(wide, "quality-thresholds")


def base_failed(prefix: str = "_q_"):
    return (F.col(prefix + "n_words") < MIN_WORDS) | (
        F.col(prefix + "n_repeat_words") * 100 > MAX_REPEAT_PERCENT * F.col(prefix + "n_words"))


def judged(counted: DataFrame, fences: DataFrame, prefix: str = "_q_") -> DataFrame:
    """counted with ``<prefix>base_failed`` and ``<prefix>kept``.

    The thresholds are a written table, so Spark knows their size: it broadcasts them if they are small and else
    joins by sorting, splitting a hot source.
    """
    names = ["fence_" + r for r in RATES]
    f = fences.select(F.col("lang").alias(prefix + "lang"), F.col("source").alias(prefix + "source"),
                      *[F.col(n).alias(prefix + n) for n in names])
    joined = counted.join(f, F.col("lang").eqNullSafe(F.col(prefix + "lang"))
                          & F.col("source").eqNullSafe(F.col(prefix + "source")), "left")
    over = F.lit(False)
    for r in RATES:
        over = over | F.coalesce(rate(r, prefix) > F.col(prefix + "fence_" + r), F.lit(False))
    return (joined.withColumn(prefix + "base_failed", base_failed(prefix))
            .withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & ~over)
            .drop(prefix + "lang", prefix + "source", *[prefix + n for n in names]))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    fences = thresholds(with_counts(docs, keep=["lang", "source"]))
    return judged(with_counts(docs), fences).where("_q_kept").select(*[f"`{c}`" for c in docs.columns])


def _sql() -> str:
    def rate_sql(r):
        num, den, scale, _ = RATES[r]
        return f"case when {den} > 0 then {scale} * {num} // {den} end"

    buckets = "(greatest(length(bin(v)) - 6, 0) * 64 + (v >> greatest(length(bin(v)) - 6, 0)))"
    top = lambda b: f"((({b} % 64 + 1) << ({b} // 64)::int) - 1)"
    spreads = " ".join(f"when '{r}' then {x[3]}" for r, x in RATES.items())
    longs = " union all ".join(f"select lang, source, '{r}' rate, {rate_sql(r)} v from counts" for r in RATES)
    over = " or ".join(f"coalesce({rate_sql(r)} > fence_{r}, false)" for r in RATES)
    return rf"""
with d as (select row_number() over () rn, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select rn, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
u as (select rn, unnest(ws) word, generate_subscripts(ws, 1) i from w),
g as (select rn, i, word || ' ' || lead(word) over p || ' ' || lead(word, 2) over p gram from u
      window p as (partition by rn order by i)),
g2 as (select rn, i, count(*) over (partition by rn, gram) c from g where gram is not null),
cov as (select rn, count(distinct j) n from (select rn, unnest([i, i + 1, i + 2]) j from g2 where c > 1) group by rn),
ln as (select rn, unnest(string_split(t, chr(10))) line from d),
l2 as (select rn, count(*) n, count(distinct line) nd from ln where regexp_matches(line, '[^\x20\x09-\x0D]') group by rn),
counts as (
  select d.*, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
         coalesce(l2.n, 0)::bigint n_lines, coalesce(l2.n - l2.nd, 0)::bigint n_dup_lines,
         coalesce(cov.n, 0)::bigint n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint n_capitals
  from d join w using (rn) left join l2 using (rn) left join cov using (rn)),
long as ({longs}),
b as (select lang, source, rate, {buckets} bucket, count(*) n from long where v is not null group by all),
lev as (select 0 level, lang, source, rate, bucket, n from b
  union all select 1, lang, null, rate, bucket, n from b union all select 2, null, null, rate, bucket, n from b),
m as (select level, lang, source, rate, bucket, sum(n) n from lev group by all),
r as (select *, sum(n) over (partition by level, lang, source, rate order by bucket) upto,
             sum(n) over (partition by level, lang, source, rate) total from m),
q as (select level, lang, source, rate, max(total) total, min(bucket) filter (4 * upto >= total) b1,
             min(bucket) filter (4 * upto >= 3 * total) b3 from r group by all),
f as (select level, lang, source, rate, total,
             {top('b3')} + {FENCE} * greatest({top('b3')} - {top('b1')}, case rate {spreads} end) fence from q),
t as (select o.lang, o.source, o.rate, case when o.total >= {MIN_GROUP} then o.fence
             when l.total >= {MIN_GROUP} then l.fence else a.fence end fence
      from f o join f l on l.level = 1 and l.lang is not distinct from o.lang and l.rate = o.rate
      join f a on a.level = 2 and a.rate = o.rate where o.level = 0),
wide as (select lang, source, {', '.join(f"max(fence) filter (rate = '{r}') fence_{r}" for r in RATES)} from t group by all),
v as (select c.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed, ({over}) over_fence
      from counts c left join wide x on c.lang is not distinct from x.lang and c.source is not distinct from x.source)
"""


ORACLE = _sql() + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not over_fence kept from v"


@register("op10_quality_rules", ORACLE)
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = written(with_counts(docs, keep=["doc_id", "lang", "source"]), "quality-counts")
    out = judged(counted, thresholds(counted))
    return out.select("doc_id", *[F.col("_q_" + c).alias(c) for c in COUNTS[:5]],
                      F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))
