"""The corpus operators against brute force, with null, empty, repeated and clashing rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, SMOKE
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dirsearch.llm import bpe, flat, html_main, line_dedup, lm, mixing, near_dup, quality_model, quality_rules, substring, topk
from dirsearch.llm.components import components
from dirsearch.llm.store import KEY_ID, NULL_ID

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, size long, shard int, band long"
LOREM = "the quick brown fox jumps over the lazy dog and runs far away from the red house on a hill near some water".split()


def _text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{LOREM[i]}{j}" for i, j in zip(rng.integers(0, len(LOREM), n), rng.integers(0, 9, n)))


def _rows() -> list[tuple]:
    base, shared = _text(1, 120), _text(2, 60)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one", "one", base, base, " ".join(near), base.upper(), shared + "\n" + _text(3, 40), _text(4, 50) + " " + shared,
             "a\nb\nc\nd", "x\na\nb\nc\ny", "a\n\nb\nc", "z z z z z z z z", _text(5, 9000), _text(6, 9000) + "\n" + base, "über straße x y 字字字 🙂",
             "k\nk\nk\nk\nk\nk", "### $$$ | <b> %%% &&& ***"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s0"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base + " tail", "en", "s1", 5), (None, None, None, None, None)]
    return [(*r, 1, "r", 2, 3, 4) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_store_keeps_to_the_named_folder(spark):
    from dirsearch.llm.store import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# -- flat text ---------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té字\x0b", max_size=30)), max_size=8))
def test_words_and_lines_of_a_column(texts):
    col = pa.array(texts, pa.string())
    words, lines = [[] for _ in texts], [[] for _ in texts]
    for lo, hi, buf, offs in flat.chunks(col, 16):
        raw = buf.tobytes()
        s, e, row = flat.words(buf, offs)
        for a, b, r in zip(s, e, row):
            words[lo + r].append(raw[a:b].decode())
        s, e, row, num = flat.lines(buf, offs)
        for a, b, r, k in zip(s, e, row, num):
            assert k == len(lines[lo + r])
            lines[lo + r].append(raw[a:b].decode())
    assert words == [WORD.findall(t or "") for t in texts]
    assert lines == [(t or "").split("\n") for t in texts]


def test_equal_spans_hash_alike_and_others_do_not():
    v = np.frombuffer(b"abcxabcxxabd", np.uint8)
    h = flat.span_hash(v, np.array([0, 4, 9]), np.array([3, 7, 12]))
    assert h[0] == h[1] != h[2]


# -- byte-level BPE ----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def codecs():
    import tiktoken

    m = bpe.multilingual()
    own = bpe.codec(**m)
    return own, tiktoken.Encoding("own", pat_str=m["pattern"], mergeable_ranks=own.ranks, special_tokens={})


PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'", "'s", "'re", "a", "A", "ing", "the", "1", "22", "!", "é", "ß", "字", "🙂", "aaaa", "zzz", " ", "\x85"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(PIECES, PIECES)
def test_bpe_joins_as_a_monoid(codecs, a, b):
    own, library = codecs
    a, b = "".join(a), "".join(b)
    assert own.join(own.segment(a), own.segment(b)).ids == library.encode_ordinary(a + b)
    assert own.decode(library.encode_ordinary(a + b)) == (a + b).encode()


def test_bpe_small_leaves(codecs, monkeypatch):
    own, library = codecs
    monkeypatch.setattr(bpe, "LEAF", 7)
    for t in [_text(8, 300), "x" * 500, " " * 300, "ab " * 90, "字" * 200, "a\n\n b  c" * 40]:
        assert own.encode(t) == library.encode_ordinary(t)


def test_bpe_query_columns(spark, docs, none, codecs):
    got = bpe.encode(docs, **bpe.multilingual(), segment=200)
    assert got.columns == [*docs.columns, "ids"] and bpe.encode(none, **bpe.multilingual()).count() == 0
    back = bpe.decode(got, **bpe.multilingual()).collect()
    assert len(back) == docs.count()
    for r in back:
        assert bpe.unpack(r.ids) == codecs[1].encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_clashing_names_and_long_texts(spark, codecs):
    rows = [("a b " * 60, b"x", "u", 1), (None, None, None, None), ("house, red. Ok! no?yes " * 9, b"y", "v", 2)]
    clash = spark.createDataFrame(rows, "text string, ids binary, _bpe_text string, key long")
    got = bpe.encode(clash, **bpe.multilingual(), segment=100).collect()
    assert got[0].__fields__ == ["text", "_bpe_text", "key", "ids"]
    assert {(r.text, r._bpe_text, r.key) for r in got} == {(t, b, k) for t, _, b, k in rows}
    assert all(bpe.unpack(r.ids) == codecs[1].encode_ordinary(r.text or "") for r in got)


def test_op1_digests(spark, registry, codecs):
    for r in registry[0]["op1_byte_bpe"](spark, SMOKE).join(spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        ids = codecs[1].encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# -- line dedup --------------------------------------------------------------------------------------------------------
def _line_brute(rows: list[tuple]) -> dict:
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if WORD.search(x)]
        plain = [lines[k].strip(" \t\n\r\x0b\x0c") for k in at]
        dead = set()
        for k in range(len(plain) - 2):
            run = tuple(plain[k : k + 3])
            if run in seen:
                dead |= set(range(k, k + 3))
            seen.add(run)
        gone = {at[k] for k in dead}
        out[i, t] = None if t is None else "" if at and len(dead) == len(at) else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    e = _line_brute(rows)
    got = line_dedup.without_later_runs(docs.withColumn("was", F.col("text"))).where("doc_id is not null").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == e[r.doc_id, r.was], r.doc_id
    assert line_dedup.without_later_runs(none).count() == 0


def test_pipeline_cuts_every_line_that_stands_earlier(spark, docs):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    seen, e = set(), {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        kept, words, cut = [], 0, 0
        for line in (t or "").split("\n"):
            plain = line.strip(" \t\n\r\x0b\x0c")
            has = bool(WORD.search(line))
            words, cut = words + has, cut + (has and plain in seen)
            if not (has and plain in seen):
                kept.append(line)
            if has:
                seen.add(plain)
        e[i, t] = None if t is None else "" if words and cut == words else "\n".join(kept)
    got = corpus_pipeline.line_stage(spark, docs.withColumn("was", F.col("text")), SMOKE).where("doc_id is not null").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == e[r.doc_id, r.was], r.doc_id
    one = {r.doc_id: r.text for r in got}
    assert one[3] == "one" and one[4] == "" and one[9] and "k" == one[18]  # copies of one line


# -- near duplicates ---------------------------------------------------------------------------------------------------
def _near_brute(rows: list[tuple]) -> dict:
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, none, registry):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").distinct().collect()]
    e = _near_brute(rows)
    got = near_dup.near_duplicates(docs.where("doc_id is not null")).collect()
    assert len(got) == docs.where("doc_id is not null").count()
    for r in got:
        assert (r.n_shingles, r.component) == e[r[KEY_ID]]
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [i for i in sorted(e) if e[i][1] == i and i != 5]  # the null id is less
    assert near_dup.near_duplicates(none).count() == 0
    nulls = [r for r in near_dup.near_duplicates(docs).collect() if r[KEY_ID] == NULL_ID]
    assert len(nulls) == 2


def test_near_duplicates_of_a_bridge(spark, monkeypatch):
    """Chains whose ends are not alike, in blocks of two."""
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    words = _text(9, 200).split()
    rows = [(k, " ".join(words[6 * k :][:140] + [f"u{k}"])) for k in range(10)] + [(50 + k, _text(60 + k, 100)) for k in range(5)]
    e = _near_brute(rows)
    for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_shingles, r.component) == e[r[KEY_ID]]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 62, 900)
    a, b = (" ".join(map(str, np.concatenate([both, rng.integers(0, 1 << 62, 50)]))) for _ in range(2))
    col = pa.array([a, b])
    (_, _, buf, offs), = flat.chunks(col)
    s = near_dup.features(buf, offs)["sketch"]
    alike = near_dup.most_bits(0.9)
    assert abs(int(np.bitwise_count(s[0] ^ s[1]).sum()) - alike) < 40 < near_dup.most_bits(0.5) - alike


# -- substrings --------------------------------------------------------------------------------------------------------
def _sub_brute(rows: list[tuple], window: int) -> list[tuple]:
    words = [WORD.findall(t or "") for _, t in rows]
    n = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substrings(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    real = lambda i: None if i == NULL_ID else i
    got = [(real(r[KEY_ID]), r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _sub_brute(rows, 35)))
    assert substring.without_repeats(none).count() == 0


def test_substrings_with_many_partial_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(["a", "b", "c"], int(n)))) for k, n in enumerate(rng.integers(0, 120, 60))]
    parts = [_text(40 + k, 30).split() for k in range(6)]
    rows += [(100 + k, " ".join(w for p in rng.integers(0, 6, 4) for w in parts[p][int(rng.integers(0, 9)) :])) for k in range(60)]
    got = [(r[KEY_ID], r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=20).collect()]
    assert sorted(got) == sorted(_sub_brute(rows, 20))


def test_op5_against_brute_force(spark, registry):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    e = {i: (n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in _sub_brute(rows, 35)}
    for r in registry[0]["op5_substring_dedup"](spark, SMOKE).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == e[r.doc_id]


# -- mixing ------------------------------------------------------------------------------------------------------------
def _levels(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    whole, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = whole - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and left * weight[s] / w > 2 * sizes[s] + 1e-9}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in sizes}
        capped |= more


def test_mixing_targets_and_draws(spark, docs, none):
    for df, close in ((docs, 0.35), (spark.read.parquet(f"{SMALL}/documents.parquet"), 0.01)):
        sizes = collections.Counter()
        for r in df.select("source", "text").collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        all_docs, rows = mixing.copies(df)
        target = {r.source: r.target for r in all_docs.select("source", "target").distinct().collect()}
        e = _levels(dict(sizes))
        assert all(abs(target[s] - e[s]) < 1e-6 * max(1, e[s]) for s in e)
        key = [c for c in all_docs.columns if c.startswith("_k_")]
        own = all_docs.select(*key, "source").distinct()
        taken = collections.Counter({r.source: r.n for r in rows.distinct().join(own, key).groupBy("source").agg(F.sum("size").alias("n")).collect()})
        if close < 0.1:
            assert all(abs(taken[s] - e[s]) <= close * e[s] for s in e)
        assert rows.groupBy(*key).agg(F.count_distinct("pass").alias("n")).where("n > 2").count() == 0
    assert mixing.mixture(docs).columns == docs.columns and mixing.mixture(none).count() == 0


def test_mixing_again_and_by_shards(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.copies(df.repartition(n))[1].collect())) for n in (2, 5))
    assert one == two
    places = [(r[0], r[1], r[3]) for r in one]
    assert len(places) == len(set(places))  # a pass draws a document once, so shards are disjoint
    assert {r[4] for r in one} == set(range(mixing.SHARDS))


# -- top-k -------------------------------------------------------------------------------------------------------------
def test_topk_of_large_components(spark):
    vectors = [(0, [70000.0, -3.5e9, 1.0]), (1, [1e9, 2.0, -1e9]), (2, [-1e9, 3.0e6, 0.5]), (3, [1e300, 0.0, 0.0]), (4, [0.0, 0.0, 1.0]),
               (5, [float("nan"), 0.0, 0.0]), (100, [2.0, 2.0, 2.0])]
    df = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    most = (1 << 63) - 1
    whole = {i: [max(-most - 1, min(most, math.floor(1024 * x))) for x in v] for i, v in vectors if i != 5}
    for r in topk.top_k(df.where("vec_id % 100 = 0"), df, 3).collect():
        scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[r.query_id], v)))), i) for i, v in whole.items() if i != r.query_id)
        assert scores[r["rank"] - 1] == (-r.score, r.vec_id)


def test_topk(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in np.where(rng.random(12) < 0.6, 0, rng.normal(0, 1, 12))]) for i in range(400)]
    vectors[7] = (7, vectors[107][1])
    vectors += [(1000, None), (1001, [float("nan")] * 12), (1002, [None] + [1.0] * 11), (1003, []), (None, [1.0] * 12), (1004, [float("inf")] * 12), (1200, [0.0] * 12), (1300, [0.5, -0.25])]
    df = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    got = collections.defaultdict(list)
    old = topk.BLOCK_VALUES, topk.TILE_VALUES
    topk.BLOCK_VALUES, topk.TILE_VALUES = 900, 24
    try:
        for r in topk.top_k(df.where("vec_id % 100 = 0"), df).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
    finally:
        topk.BLOCK_VALUES, topk.TILE_VALUES = old
    for q in [i for i in whole if i % 100 == 0]:
        s = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:10]
        assert got[q] == [(k, i, -n) for k, (n, i) in enumerate(s, 1)]
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0


# -- quality -----------------------------------------------------------------------------------------------------------
def test_quality_rules_edges(docs, none):
    counted = quality_rules.with_counts(docs)
    out = quality_rules.judged(counted, quality_rules.thresholds(counted))
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[0]._q_n_words == 0 and by[0]._q_base_failed and by[19]._q_n_symbols == 18 and by[18]._q_n_dup_lines == 5
    assert by[14]._q_n_repeat_words == 8 and by[17]._q_word_chars == len("".join(WORD.findall(_rows()[17][1])))
    assert quality_rules.quality_filter(none).count() == 0 and quality_rules.quality_filter(docs).columns == docs.columns


def test_quality_rules_keep_clean_documents(spark, registry):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = registry[0]["op10_quality_rules"](spark, SMALL).where("not base_failed").join(labels, "doc_id").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_quality_model_on_held_out_documents(spark, registry, docs, none):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = registry[0]["op6_quality_model"](spark, SMALL).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    model = quality_model.trained(docs, spark.createDataFrame([(6, 1), (6, 0), (19, 0), (None, 1), (7, None)], "doc_id long, quality int"))
    out = quality_model.scored(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r._score <= 1 for r in out)
    assert quality_model.scored(none, quality_model.trained(none, labels)).count() == 0


# -- pages -------------------------------------------------------------------------------------------------------------
def test_blocks_of_a_page():
    page = "<!DOCTYPE html><title>T</title><script>var a='</p>';</script><!-- x --><div class='Ad x' id=q>A &amp; B</div><p>one  <b>two</b>\nthree<br>four<p>five&eacute;<ul><li>i<li>j</ul>tail"
    got = [(b.path, b.text) for b in html_main.blocks(page)]
    assert got == [(("title",), "T"), (("div", "ad", "x", "q"), "A & B"), (("p",), "one two three four"), (("p",), "fiveé"), (("ul", "li"), "i"), (("ul", "li"), "j"), ((), "tail")]


def test_labeller_on_unseen_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").union(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", ""), (10**6 + 2, "u", "<p")], "page_id long, url string, html string"))
    model = html_main.trained(pages, sample=60)
    rows = html_main.extracted(pages, model).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(html)
    wrong = 0
    for r in rows:
        page = html_main.blocks(html[r.page_id] or "")
        html_main.label(page)
        if r.page_id < 10**6:
            wrong += r.text != "\n\n".join(b.text for b in page if b.main)
    assert wrong <= 0.02 * len(rows)
    assert [r.text for r in rows if r.page_id in (10**6, 10**6 + 1)] == ["", ""]


def test_labeller_gradients():
    pages = [html_main.blocks(f"<nav><a>m{k}</a></nav><article><h1>t</h1><p>some words {k}.</p></article><footer>f</footer>" * (1 + k)) for k in range(3)]
    for p in pages:
        html_main.label(p)
    batch, p = html_main.Inputs(pages), {k: v.astype(np.float64) for k, v in html_main.initial().items()}
    drop = np.ones(batch.size, np.float32)

    def loss():
        z = html_main.forward(p, batch, drop)[0].astype(np.float64)
        return np.mean(np.log1p(np.exp(-np.where(batch.y > 0, z, -z))))

    g = html_main.gradients(p, batch, drop)
    for k, at in (("ahead", (3, 5)), ("back", (30, 20)), ("out", (4,)), ("ahead_bias", (17,)), ("paths", (int(batch.paths[0]), 2)), ("words", (int(batch.words[0]), 1))):
        old, eps = p[k][at], 1e-2
        p[k][at] = old + eps
        up = loss()
        p[k][at] = old - eps
        down = loss()
        p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


# -- language model ----------------------------------------------------------------------------------------------------
def _lm_parts(seed: int = 0):
    rng = np.random.default_rng(seed)
    c = np.sort(rng.integers(1, 500, 300))[::-1]
    v = lm.Vocabulary(np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64)), c, int(c.sum()) + 900, 700)
    return v, lm.initial(v)


def test_lm_is_a_distribution():
    v, p = _lm_parts()
    ids = np.arange(v.size)
    total = 0.0
    for i in [*ids, lm.VOCABULARY]:  # after the same token each
        total += 10 ** lm.log10_probabilities(p, np.array([5, i]), np.array([0, 2]))[1]
    assert abs(total - 1) < 1e-3


def test_lm_carries_its_state_over_windows():
    v, p = _lm_parts()
    rng = np.random.default_rng(2)
    bounds = np.concatenate([[0], np.cumsum(rng.integers(1, 90, 25))])
    ids = rng.integers(0, v.size, bounds[-1])
    one = lm.log10_probabilities(p, ids, bounds, lanes=4, window=7)
    two = lm.log10_probabilities(p, ids, bounds, lanes=25, window=1000)
    alone = np.concatenate([lm.log10_probabilities(p, ids[a:b], np.array([0, b - a])) for a, b in zip(bounds, bounds[1:])])
    assert np.allclose(one, two, atol=1e-4) and np.allclose(one, alone, atol=1e-4)


def test_lm_gradients():
    v, p = _lm_parts()
    p = {k: x.astype(np.float64) for k, x in p.items()}
    rng = np.random.default_rng(1)
    tok, live, starts = rng.integers(0, v.size, (5, 3)), np.ones((5, 3), bool), np.zeros((5, 3), bool)
    starts[0] = starts[3, 1] = True
    h = np.zeros((3, lm.HIDDEN))

    def loss():
        ids, total = tok, 0.0
        for k in range(3):
            cut = [0, *([3] if k == 1 else []), 5]
            total += sum(lm.log10_probabilities(p, ids[a:b, k], np.array([0, b - a])).sum() for a, b in zip(cut, cut[1:]))
        return -total * np.log(10) / 15

    g, _ = lm._window_gradients(p, tok, live, starts, h)
    for k, at in (("wh", (2, 50)), ("wx", (3, 10)), ("embed", (int(tok[0, 0]), 2)), ("class_w", (0, 3)), ("word_b", (int(tok[1, 1]) // lm.CLASS, int(tok[1, 1]) % lm.CLASS)), ("start", (4,)), ("b", (30,))):
        old, eps = p[k][at], 1e-2
        p[k][at] = old + eps
        up = loss()
        p[k][at] = old - eps
        down = loss()
        p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-3 + 0.05 * abs(g[k][at]), k


def test_lm_softmax_of_any_logits():
    """Plain exp where the type holds it, less the largest elsewhere: shares add up, and nothing overflows."""
    rng = np.random.default_rng(4)
    for scale, shift in ((1, 0), (40, 0), (1, 300), (1, -300)):
        x = (rng.normal(0, scale, (50, lm.CLASS)) + shift).astype(np.float32)
        exact = x.astype(np.float64)
        exact = exact - np.log(np.exp(exact - exact.max(1, keepdims=True)).sum(1, keepdims=True)) - exact.max(1, keepdims=True)
        at = rng.integers(0, lm.CLASS, 50)
        assert np.allclose(lm._picked(x.copy(), at), exact[np.arange(50), at], rtol=1e-4, atol=1e-4)
        assert np.allclose(lm._softmax(x, 0.25), np.exp(exact) / 4, atol=1e-5)
    assert lm._softmax(np.zeros((0, lm.CLASS), np.float32)).shape == (0, lm.CLASS)


def test_lm_gates_saturate():
    v, p = _lm_parts()
    p = {**p, "b": np.concatenate([np.full(lm.HIDDEN, 1000), np.full(2 * lm.HIDDEN, -1000)]).astype(np.float32)}  # the state is kept
    assert np.allclose(lm.log10_probabilities(p, np.array([5, 5]), np.array([0, 2])), lm.log10_probabilities(p, np.array([5, 5]), np.array([0, 1, 2])))


def test_lm_words_stand_by_class():
    rng = np.random.default_rng(6)
    v, p = _lm_parts()
    tok = np.sort(np.append(rng.integers(0, lm.VOCABULARY, 400), [lm.VOCABULARY] * 9))
    hid = np.ones((len(tok), lm.HIDDEN + 1), np.float32)
    hid[:, : lm.HIDDEN] = rng.normal(size=(len(tok), lm.HIDDEN))
    classes = lm._classes(tok)
    assert [x for c, a, b in classes for x in [c] * (b - a)] == (tok[:-9] // lm.CLASS).tolist()
    got = lm._word_logits(hid, lm._with_bias(p, "word"), classes)
    want = [p["word_w"][t // lm.CLASS] @ h[:-1] + p["word_b"][t // lm.CLASS] for t, h in zip(tok[:-9], hid)]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4) and lm._word_logits(hid[:0], lm._with_bias(p, "word"), []).shape == (0, lm.CLASS)


def test_lm_scores(spark, docs, none, registry):
    rows = registry[0]["op2_lm_score"](spark, SMOKE).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    words = {i: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in texts.items()}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for i in train for w in words[i])
    n, z = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    for r in rows:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10(c[x] + 0.5) - z for x in w)) < 1e-6 * len(w)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.scores(docs).count() == docs.count() and lm.scores(none).count() == 0


def test_lm_trains_on_every_training_document(spark):
    words = [f"only{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([w] * 5)) for i, w in enumerate(words)], "doc_id long, text string")
    h = lm.tokens(*_bytes(words))[0][::2]
    order = np.argsort(h)
    v = lm.Vocabulary(h[order], np.full(len(h), 5), 10_000_000, 70)  # as if of a large corpus: one pass
    before, after = lm.initial(v)["embed"], lm.trained(docs, v)["embed"]
    moved = {words[order[k]] for k in range(len(words)) if np.abs(before[k] - after[k]).max() > 1e-5}
    assert moved == {w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 5 != 1}
    assert [lm.passes(n) for n in (0, 500_000, 1_000_000, 10_000_000)] == [4, 4, 2, 1]


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return next((buf, offs) for _, _, buf, offs in flat.chunks(pa.array(texts)))
