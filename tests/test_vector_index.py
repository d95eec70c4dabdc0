"""Vector index: exact search equals brute force and skips blocks, probing reaches its recall, odd vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from dirsearch.operators import vector_index as VI


def _frame(spark, m, name="id", extra=()):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(m)] + list(extra), f"{name} long, embedding array<double>").repartition(3)


def _brute(c, q, k):
    u = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    s = np.round(u(q) @ u(c).T, 9)
    return {(i, j, float(s[i, j])) for i in range(len(q)) for j in np.lexsort((np.arange(len(c)), -s[i]))[:k]}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    corpus = np.concatenate([c + 0.05 * rng.normal(size=(60, 16)) for c in centres])
    corpus[5] = corpus[6] = corpus[7]  # equal vectors
    corpus[100:340] = corpus[100]  # a third of all rows
    corpus[50] = 0.0
    queries = np.concatenate([corpus[::40] + 0.02, np.zeros((1, 16))])
    return corpus, queries


@pytest.mark.parametrize("block_bytes", [VI.BLOCK_BYTES, 16 * 8 * 20])
def test_exact_search_equals_brute_force_and_skips_pairs(spark, clustered, block_bytes):
    corpus, queries = clustered
    index = VI.build_index(_frame(spark, corpus), lists=12, block_bytes=block_bytes)
    assert index.blocks.agg({"n": "sum"}).first()[0] == len(corpus)
    found = index.search(_frame(spark, queries, "query_id"), 5)
    got = found.rows.collect()
    want = _brute(corpus, queries, 5)
    assert {(r["query_id"], r["id"], round(r["score"], 9)) for r in got} == want and len(got) == len(want)
    assert found.pairs.first()["pairs"] < (0.6 if block_bytes < VI.BLOCK_BYTES else 0.8) * len(corpus) * len(queries)


def test_search_of_vectors_without_clusters_is_exact_too(spark):
    m = np.random.default_rng(4).normal(size=(300, 8))
    index = VI.build_index(_frame(spark, m))
    got = index.search(_frame(spark, m[:40], "query_id"), 10).rows.collect()
    assert {(r["query_id"], r["id"], round(r["score"], 9)) for r in got} == _brute(m, m[:40], 10)


def test_probing_reaches_its_recall_and_scores_less(spark, clustered):
    corpus, queries = clustered
    index = VI.build_index(_frame(spark, corpus), lists=12)
    found = index.search(_frame(spark, queries[:-1], "query_id"), 5, recall=0.95)
    want = {(q, i) for q, i, _ in _brute(corpus, queries[:-1], 5)}
    hit = len({(r["query_id"], r["id"]) for r in found.rows.collect()} & want) / len(want)
    assert hit >= 0.9 and found.pairs.first()["pairs"] < 0.7 * len(corpus) * (len(queries) - 1)
    assert index.probes_for(0.0) == 1 and index.probes_for(1.0) <= 12


def test_vectors_that_take_no_part(spark):
    m = np.random.default_rng(5).normal(size=(30, 4))
    odd = [(900, None), (901, []), (902, [float("nan"), 1.0, 1.0, 1.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [None, 1.0, 1.0, 1.0])]
    index = VI.build_index(_frame(spark, m, extra=odd))
    rows = index.search(_frame(spark, m[:3], "query_id", odd), 50).rows.collect()
    assert {r["query_id"] for r in rows} == {0, 1, 2} and len(rows) == 90 and max(r["id"] for r in rows) < 30


def test_empty_corpus_and_mixed_lengths(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    index = VI.build_index(none)
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3).rows.count() == 0
    with pytest.raises(ValueError):
        VI.build_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>"))


def test_a_query_travels_once_to_a_group_however_many_lists_it_meets(spark):
    m = np.random.default_rng(6).normal(size=(400, 8))
    index = VI.build_index(_frame(spark, m), lists=40)
    held = {r["list"]: r for r in index.blocks.groupBy("list").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    groups = index._groups(held)
    assert len(groups) == len(held) and len({a + i for a, n in groups.values() for i in range(n)}) <= 4  # 8 shuffle partitions: blocks of lists share groups
    asked = pd.DataFrame({"query_id": range(400), "vec": list(m), "least": np.nan})
    rows = pd.concat(VI._spread(VI._nearest(index.centroids, 40), groups, 41)([asked]))
    assert len(rows) == 400 and rows["lists"].map(len).max() == 6  # one flag for each of 41 lists
    found = index.search(_frame(spark, m, "query_id"), 10, probes=40)
    assert {(r["query_id"], r["id"]) for r in found.rows.collect()} == {(q, i) for q, i, _ in _brute(m, m, 10)}
    assert found.pairs.first()["pairs"] == 400 * 400


def test_a_long_list_is_dealt_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(VI, "GROUP_BYTES", 16 * 8 * 20)
    rng = np.random.default_rng(7)
    m = np.concatenate([np.ones((200, 16)) + 0.01 * rng.normal(size=(200, 16)), rng.normal(size=(100, 16))])
    index = VI.build_index(_frame(spark, m), lists=5, block_bytes=16 * 8 * 7)
    for found in (index.search(_frame(spark, m[::7], "query_id"), 10), index.search(_frame(spark, m[::7], "query_id"), 10, probes=5)):
        assert {(r["query_id"], r["id"]) for r in found.rows.collect()} == {(q, i) for q, i, _ in _brute(m, m[::7], 10)}


def test_running_best_equals_a_full_sort_and_sorts_few():
    import numpy as np

    from dirsearch.operators import knn

    rng = np.random.default_rng(3)
    for k, m, digits in [(1, 40, 1), (3, 700, 1), (10, 5, 1), (50, 900, 2), (10, 4096, 4)]:
        best, seen = knn.Best(np.arange(6), k), []
        for part in range(4):
            at, ids = np.sort(rng.choice(6, 4, replace=False)), rng.permutation(10_000)[:m].astype(np.int64)
            scores = np.round(rng.normal(size=(4, m)), digits)
            best.add(at, ids, scores)
            seen += [(q, -s, i) for q, row in zip(at.tolist(), scores.tolist()) for s, i in zip(row, ids.tolist())]
        want = {q: sorted(x[1:] for x in seen if x[0] == q)[:k] for q in range(6)}
        got = {q: [(-s, i) for s, i in zip(best.s[q].tolist(), best.i[q].tolist()) if np.isfinite(s)] for q in range(6)}
        assert got == want
    scores = rng.normal(size=(8, 4096))
    reach = (scores >= knn._reached(scores, 50)[:, None]).sum(axis=1)
    assert reach.min() >= 50 and reach.max() < 100
