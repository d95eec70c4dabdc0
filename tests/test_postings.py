"""Gram postings against the substring test of every pair."""

from __future__ import annotations

import random

import pytest

from dirsearch.operators import keywords as K
from dirsearch.operators.postings import write_postings


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choices("abé字 C", k=rng.choice([0, 1, 2, 3, 7, 50, 2000])))) for i in range(50)] + [(60, None), (61, "Capital Markets, capital"), (62, "aaaaaaaaaa")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    return dict(texts), df, write_postings(df, str(tmp_path_factory.mktemp("p") / "index"))


def test_hits_equal_the_search_in_the_texts(spark, store):
    texts, df, index = store
    rng = random.Random(4)
    words = ["".join(rng.choices("abé字 c", k=k)) for k in (1, 2, 3, 4, 5, 6, 8, 9, 13) for _ in range(8)] + ["capital", "capital markets", "arkets, c", "aaaa", "aaaaaaaaaa", "aaaaaaaaaaa", "zz", "é", ""]
    words += [t.lower()[i : i + 14] for t in texts.values() if t and len(t) > 100 for i in (0, 500, len(t) - 14)]
    pairs = spark.createDataFrame([(i, rng.sample(words, 25)) for i in [*texts, 61, 62, 999] for _ in range(2)], "id long, keywords array<string>")
    plain = {r["id"]: sorted(r["found"]) for r in K.keyword_hits(pairs, df).collect()}
    got = {r["id"]: sorted(r["found"]) for r in K.keyword_hits(pairs, index).collect()}
    assert got == plain and sum(map(len, got.values())) > 150 and 60 not in got and 999 not in got


def test_the_filter_reads_postings_and_not_texts(spark, store):
    texts, df, index = store
    cand = spark.createDataFrame([(q, i, r) for q in (1, 2, 3) for r, i in enumerate([*range(20), 60, 61, 62], 1)], "query_id long, id long, rank int")
    kw = spark.createDataFrame([(1, ["capital", "markets", "ab"]), (2, ["aaaa"]), (3, [])], "query_id long, keywords array<string>")
    a, b = K.smart_filter(cand, kw, df), K.smart_filter(cand, kw, index)
    columns = ["query_id", "id", "rank", "matches", "missing"]
    assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "places" in plan and "text" not in plan


def test_nothing_stored_and_nothing_asked(spark, store, tmp_path):
    _, df, index = store
    none = write_postings(df.where("false"), str(tmp_path / "none"))
    pairs = spark.createDataFrame([(1, ["ab"])], "id long, keywords array<string>")
    assert none.hits(pairs).count() == 0 and index.hits(pairs.where("false")).count() == 0


def test_short_keywords_join_by_their_bytes(spark, store):
    _, _, index = store
    asked = spark.createDataFrame([(62, ["a", "aa", "aaa", "b"]), (61, ["cap", "é"])], "id long, keywords array<string>")
    hits = index.hits(asked)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "head" in plan and "gram#" in plan and not [x for x in plan.split("\n") if "Join" in x and ("<=" in x or ">=" in x)]
    assert {r["id"]: sorted(r["found"]) for r in hits.collect()} == {62: ["a", "aa", "aaa"], 61: ["cap"]}


def test_long_texts_and_grams_of_many_places(spark, tmp_path):
    rng = random.Random(6)
    texts = {1: "a" * 70_000 + "bcd", 2: "".join(rng.choices("abcd ", k=66_000)) + "end of it", 3: "xyz" * 25_000 + "é", 4: "a" * 65_536, 5: "aaaaz"}
    df = spark.createDataFrame([*texts.items()], "id long, text string").coalesce(1)
    index = write_postings(df, str(tmp_path / "long"))
    words = ["aaaabcd", "a" * 50, "of it", "nd of", "zxyzx", "yzé", "zé", "é", "aaz", "cd", "aaaaz", "end of it", texts[2][65_000:65_040]]
    pairs = spark.createDataFrame([(i, words) for i in texts], "id long, keywords array<string>")
    got = {r["id"]: set(r["found"]) for r in index.hits(pairs).collect()}
    assert got == {i: {w for w in words if w in t} for i, t in texts.items()}


def test_the_index_is_small_and_only_asked_grams_move(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=5000))) for i in range(300)]
    index = write_postings(spark.createDataFrame(rows, "id long, text string").coalesce(1), str(tmp_path / "small"))
    size = sum(f.stat().st_size for f in (tmp_path / "small").rglob("*.parquet"))
    assert size < 6 * 300 * 5000
    hits = index.hits(spark.createDataFrame([(1, ["abcdef", "ab"]), (7, [rows[7][1][40:60]])], "id long, keywords array<string>"))
    assert {r["id"]: r["found"] for r in hits.collect()} == {1: [w for w in ("ab", "abcdef") if w in rows[1][1]], 7: [rows[7][1][40:60]]}
    plan = hits._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = next(x for x in reversed(plan[:next(k for k, x in enumerate(plan) if "Relation" in x and "grams#" in x)]) if "MapInArrow" in x or "Join" in x)
    assert "MapInArrow" in above  # what was not asked goes before any join
