"""Large dictionary against texts: equal to the substring test of every pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dirsearch.operators.dictionary import dictionary_hits


@pytest.mark.parametrize("fold", [False, True])
def test_hits_equal_brute_force(spark, fold):
    rng = random.Random(1)
    alphabet = "ab cé字Z"
    texts = [(i, "".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 40, 3000])))) for i in range(60)] + [(90, None), (91, "Tax Law"), (92, "x" * 20)]
    entries = ["".join(rng.choices(alphabet, k=k)) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20) for _ in range(12)]
    entries += [t[i : i + 11] for _, t in texts if t and len(t) > 30 for i in (0, 7, len(t) - 11)] + ["", None, "tax", "Tax Law", "TAX LAW", "x" * 20, "x" * 21, "字", "not there at all"]
    got = dictionary_hits(spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(e,) for e in entries * 2], "entry string"), fold=fold)
    case = (lambda s: s.lower()) if fold else (lambda s: s)
    want = {(i, e) for i, t in texts for e in set(entries) if t and e and case(e) in case(t)}
    rows = [(r["id"], r["entry"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 300


def test_no_texts_and_no_entries(spark):
    texts, entries = spark.createDataFrame([(1, "abc")], "id long, text string"), spark.createDataFrame([("b",)], "entry string")
    assert dictionary_hits(texts.where("false"), entries).count() == 0
    assert dictionary_hits(texts, entries.where("false")).count() == 0


def test_entries_do_not_stand_in_the_plan(spark):
    texts = spark.range(200).select("id", F.concat(F.lit("Person Number"), F.col("id").cast("string"), F.lit(" wrote this")).alias("text"))
    entries = spark.range(100_000).select(F.concat(F.lit("Person Number"), F.col("id").cast("string")).alias("entry"))
    hits = dictionary_hits(texts, entries)
    assert len(hits._jdf.queryExecution().analyzed().toString()) < 20_000
    # Number17 is found in Number170 ... Number179 and in itself
    assert hits.count() == sum(str(i).startswith(str(j)) for i in range(200) for j in range(200))
