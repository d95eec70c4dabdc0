"""Quality classifier on supervised subword embeddings.

A text is the average of learned vectors of its features: its words, the byte n-grams of its words (with the separators
around them) and, for each word, how long ago it stood in the text before (by powers of two); all are hashed into
``BUCKETS`` rows.  A softmax over two classes sits on the average.  Vectors and softmax are trained by stochastic gradient
descent in numpy, in one task, on at most ``SAMPLE`` labelled documents of each class, chosen by hash; whole texts of all
documents are scored.

For scoring, the vectors are multiplied by the softmax once, which leaves one number for each bucket.

Defined results: null and empty texts have no features and get the softmax of nothing, the bias; without labels of both
classes the score is the share of the one there is, or 0.5; a document with several labels takes the smallest; rows that
are equal score alike; labels, language, source and ids are never inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirsearch.llm import flat
from dirsearch.llm.registry import register, table

BUCKETS, AGES = 1 << 18, 24
GRAMS = (3, 4, 5)
AGE_WEIGHT = 8  # an age counts as so many features, for a word has many n-grams
WIDTH = 8
SAMPLE = 1500  # labelled documents of each class that the model is fitted on
EPOCHS, RATE = 8, 0.5
THRESHOLD = 0.3


def features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, rows, weight in the average) of each kind of feature; AGES buckets before the hashed ones are for word ages."""
    s, e, row = flat.words(buf, offs)
    h = flat.span_hash(buf, s, e)
    yield (h % np.uint64(BUCKETS)).astype(np.int64) + AGES, row, 1
    order = np.lexsort((np.arange(len(h)), h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    age = np.zeros(len(h), np.int64)
    age[order[1:][again]] = 1 + np.log2(np.diff(order)[again]).astype(np.int64)
    yield np.minimum(age, AGES - 1), row, AGE_WEIGHT
    n = len(buf)
    sep = flat._IS_SEP[buf]
    letters = np.where(sep, np.uint8(32), buf).astype(np.uint32)
    byte_row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inner = np.concatenate([[0], np.cumsum(sep)])
    for k in GRAMS:
        if n < k:
            continue
        g = np.full(n - k + 1, k, np.uint32)
        for i in range(k):
            g = g * np.uint32(0x01000193) + letters[i : n - k + 1 + i]
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA6B)
        g ^= g >> np.uint32(13)
        at = np.flatnonzero((inner[k - 1 : n] == inner[1 : n - k + 2]) & (byte_row[: n - k + 1] == byte_row[k - 1 :]))
        yield (g[at] & np.uint32(BUCKETS - 1)).astype(np.int64) + AGES, byte_row[at], 1


def _examples(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares."""
    out = []
    for lo, hi, buf, offs in flat.chunks(column):
        parts = list(features(buf, offs))
        b, r = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        w = np.concatenate([np.full(len(p[0]), p[2], np.float32) for p in parts])
        order = np.argsort(r, kind="stable")
        bounds = flat.row_bounds(r[order], hi - lo)
        for i in range(hi - lo):
            mine = order[bounds[i] : bounds[i + 1]]
            found, at = np.unique(b[mine], return_inverse=True)
            n = np.bincount(at, weights=w[mine], minlength=len(found))
            out.append((found, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 1) -> dict:
    """Trains vectors and softmax; returns the number of each bucket and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS + AGES, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    examples = _examples(texts)
    counts = np.bincount(labels, minlength=2)
    if not counts.all():
        share = 0.5 if not counts.any() else counts[1] / counts.sum()
        return {"weights": np.zeros(BUCKETS + AGES, np.float32), "bias": float(np.clip(np.log(max(share, 1e-3) / max(1 - share, 1e-3)), -7, 7))}
    weight = counts.sum() / (2 * counts)  # classes count alike
    steps, done = EPOCHS * len(examples), 0
    gain_v = np.zeros(BUCKETS + AGES, np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            rate = RATE * (1 - done / steps)
            done += 1
            found, share = examples[i]
            v = vectors[found]
            hidden = share @ v
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = out.T @ p
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            step = share * np.sqrt((back * back).sum())
            gain_v[found] += step * step
            vectors[found] = v - rate * (share / np.sqrt(gain_v[found] + 1e-8))[:, None] * back
    return {"weights": vectors @ (out[1] - out[0]), "bias": float(bias[1] - bias[0])}


def logits(column: pa.Array, model: dict) -> np.ndarray:
    out = np.full(len(column), model["bias"])
    for lo, hi, buf, offs in flat.chunks(column):
        total, n = np.zeros(hi - lo), np.zeros(hi - lo)
        for b, r, w in features(buf, offs):
            total += w * np.bincount(r, weights=model["weights"][b], minlength=hi - lo)
            n += w * np.bincount(r, minlength=hi - lo)
        out[lo:hi] += total / np.maximum(n, 1)
    return out


def held_out(doc_id: str):
    """Whether no label of the document may be learned."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of a bounded sample of labelled documents that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    mixed = F.xxhash64(F.lit(3), "doc_id")
    chosen = [usable.where(F.col("y") == y).orderBy(mixed, "doc_id").limit(sample) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * sample ids
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(ids, "doc_id")
    rows = rows.repartition(1).sortWithinPartitions(mixed, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        texts = pa.concat_arrays([b.column(1) for b in parts]) if parts else pa.array([], pa.string())
        y = np.concatenate([b.column(2).to_numpy() for b in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, y))], pa.binary())], names=["model"])

    made = rows.mapInArrow(run, T.StructType([T.StructField("model", T.BinaryType())])).first()
    return pickle.loads(made[0]) if made else fit(pa.array([], pa.string()), np.zeros(0, np.int64))  # no row: nothing to learn from


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with ``_score``: the probability of label 1."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number a bucket: 1 MB
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.clip(logits(b.column(len(names)), shared.value), -30, 30)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], names=schema.names)

    return docs.select(*[f"`{c}`" for c in names], F.col(f"`{text}`").cast("string").alias("_c_text")).mapInArrow(run, schema)


@register("op6_quality_model")
def op6_quality_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"),
                      F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
