"""Pluggable embedder (V6) and the file sinks."""

from __future__ import annotations

import os
import uuid

import numpy as np

from dirsearch.operators import embed as E
from dirsearch.session import shared_dir
from dirsearch.sources import files as FS


def test_python_embedder_keeps_ids_and_reports_errors(spark):
    df = spark.createDataFrame([(1, "alpha\nbeta"), (2, "   "), (3, "gamma"), (4, "boom")], "id long, text string")

    def embedder(texts):
        if any(t == "boom" for t in texts):
            raise RuntimeError("remote failure")
        return [np.array([len(t), 1.0]) for t in texts]

    out = {r["id"]: r for r in E.embed_texts(df, "id", "text", embedder=embedder, batch_size=1).collect()}
    assert set(out) == {1, 3, 4}  # the empty text is dropped, ids never shift
    assert list(out[1]["embedding"]) == [10.0, 1.0] and out[1]["error"] is None
    assert out[4]["embedding"] is None and "remote failure" in out[4]["error"]


def test_default_embedder_is_unit_length(spark):
    # every term occurs in one document only, so no vector is all-zero after IDF
    df = spark.createDataFrame([(1, "red widget"), (2, "blue gear"), (3, "green bolt")], "id long, text string")
    rows = E.embed_texts(df, "id", "text", num_features=32).collect()
    for r in rows:
        assert abs(float(np.linalg.norm(np.array(r["embedding"]))) - 1.0) < 1e-5


def test_sinks_write_and_read_back(spark):
    base = os.path.join(shared_dir(spark), f"test-sinks-{uuid.uuid4().hex}")
    prof = spark.createDataFrame([(1, "A B", ["Tax"]), (2, "C D", None)], "id long, name string, practices array<string>")
    FS.write_json(prof, os.path.join(base, "export"))
    back = {r["id"]: r for r in spark.read.json(os.path.join(base, "export")).collect()}
    assert back[1]["practices"] == ["Tax"] and back[2]["practices"] is None
    errs = spark.createDataFrame([("https://x/1", "empty page")], "url string, error string")
    FS.write_dead_letter(errs, os.path.join(base, "dead"))
    assert [r[0] for r in spark.read.text(os.path.join(base, "dead", "urls")).collect()] == ["https://x/1"]


def test_batches_are_embedded_alike_with_stored_counts(spark):
    import hashlib
    import math

    rows = [(1, "red house, RED door"), (2, "blue house"), (3, "!!!"), (4, None), (5, "red"), (5, "blue sky"), (6, "house house")]
    df = spark.createDataFrame(rows, "id long, text string")
    first, second = df.where("id < 4"), df.where("id >= 4")
    counts = E.merged_counts(E.feature_counts(first, "text", 64), E.feature_counts(second, "text", 64))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, E.feature_counts(df, "text", 64).collect()))
    parts = [r for b in (first, second) for r in E.embed_hashed(b, counts, "id", "text", 64).collect()]
    assert sorted(map(str, parts)) == sorted(map(str, E.embed_texts(df, "id", "text", num_features=64).collect())) and len(parts) == 6
    assert [list(r["embedding"]) for r in parts if r["id"] == 3] == [[0.0] * 64]
    # by hand: text 2 has blue (2 of 6 texts) and house (3 of 6)
    feature = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64
    blue, house = math.log(7 / 3), math.log(7 / 4)
    vec = next(r["embedding"] for r in parts if r["id"] == 2)
    assert abs(vec[feature("blue")] - blue / math.hypot(blue, house)) < 1e-6 and abs(vec[feature("house")] - house / math.hypot(blue, house)) < 1e-6


def test_no_word_becomes_a_row_on_its_way_to_a_vector(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "A, b"), (3, "..."), (4, None), (5, "")], "id long, text string")
    counts = E.feature_counts(df, "text", 16)
    vecs = E.embed_hashed(df, counts, "id", "text", 16)
    for plan in (counts, vecs):
        assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r["feature"]: r["df"] for r in counts.collect()}[E.DOCUMENTS] == 3
    assert {r["id"]: sum(x != 0 for x in r["embedding"]) for r in vecs.collect()}[3] == 0
