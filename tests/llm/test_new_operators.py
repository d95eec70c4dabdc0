"""Collocations, token alignment and token files against brute force, with null, empty, repeated and clashing rows."""

from __future__ import annotations

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMOKE

from dirsearch.llm import alignment, bpe, collocations, lm, token_files, units, workers
from dirsearch.llm.store import NULL_ID, shared_dir

SCHEMA = ("doc_id long, text string, lang string, source string, key long, page long, row long, start long, grp string, word string, block long, "
          "pair long, n long, f long, a long, w0 long, items binary")
HARD = [None, "", " ", "  two  spaces ", "\n\t a b c d ", "a ▁ b", "don't <|endoftext|> <|startoftext|>x", "über straße déjà vu é",
        "字字 字字字 🙂🙂 x", "tail space ", "tab\t and\x0bvt \x0c ff", "x" * 3000, "́a ́b é Å", "1234 56 7.8, (nine) -- ten!?", "ΑΣ ΣΑΣ. İı ﬁ",
        "\x00nul \x01", "　wide　 space", "three   spaces    here", "nl \n\n nl\n x"]


def _docs(spark, extra=()):
    rng = np.random.default_rng(5)
    words = "red house blue sky green tree and the of a in it".split()
    prose = [" ".join(words[i] + (". " if k % 9 == 8 else "") for k, i in enumerate(rng.zipf(1.6, 400) % len(words))) for _ in range(12)]
    texts = [*HARD, *prose, prose[0], prose[0].upper(), "Red House, red house; RED HOUSE " * 30, *extra]
    rows = [(i, t, ["en", "de", None][i % 3], "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s")] * 2 + [(None, prose[1], "en", None), (None, None, None, None)]
    return rows, spark.createDataFrame([(*r, *([7] * 4), "g", "w", *([7] * 6), b"x") for r in rows], SCHEMA).repartition(3)


# -- parts of texts ----------------------------------------------------------------------------------------------------
def test_spans_are_told_apart_and_spread():
    buf = np.frombuffer(b"ab cd ab x", np.uint8)
    which, words = units.distinct(buf, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 10]))
    assert [words[i] for i in which] == [b"ab", b"cd", b"ab", b"x"]
    coder = units.Encoded(lambda ws: [np.arange(len(w), dtype="<i4").tobytes() for w in ws], most=2)
    values, count = units.spread(coder.codes(words), which)
    assert values[:, 0].tolist() == [0, 1, 0, 1, 0, 1, 0] and count.tolist() == [2, 2, 2, 1]


# -- collocations ------------------------------------------------------------------------------------------------------
def _brute_collocations(rows, least, inside, top, longest):
    counts = [collections.Counter() for _ in range(longest)]
    total = collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, longest + 1):
                counts[m - 1].update((lang, *ws[i : i + m]) for i in range(len(ws) - m + 1))
    f = {k: v for c in counts for k, v in c.items() if v >= least}
    out = collections.defaultdict(list)
    for k, a in f.items():
        lang, ws = k[0], k[1:]
        if len(ws) < 2:
            continue
        cuts = [(1000000 * a * a // (f[lang, *ws[:i]] * f[lang, *ws[i:]]), i, f[lang, *ws[:i]], f[lang, *ws[i:]]) for i in range(1, len(ws))]
        held = any(len(o) > len(k) and o[0] == lang and 100 * v >= inside * a and any(o[1 + i : 1 + i + len(ws)] == ws for i in range(len(o) - len(ws)))
                   for o, v in f.items())
        if not held:
            score, _, left, right = min(cuts)
            out[lang].append((score, a, " ".join(ws), left, right))
    return sorted((lang, i + 1, p, a, x, y, total[lang], s) for lang, found in out.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(found, key=lambda r: (-r[0], -r[1], r[2].encode()))[:top]))


@pytest.mark.parametrize("longest,top,block", [(3, 2000, 4 << 20), (4, 25, 500)])
def test_collocations_against_brute_force(spark, monkeypatch, longest, top, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rows, docs = _docs(spark)
    got = collocations.collocations(docs, longest=longest, top=top)
    assert got.columns == ["grp", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = _brute_collocations(rows, 10, 50, top, longest)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_collocations_of_nothing(spark):
    _, docs = _docs(spark)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.where("text is null or text = ''")).count() == 0


def test_scores_past_64_bits(spark):
    df = spark.sql("select 3000000000001L a, 3000000000007L l, 9000000000000L r")
    s = df.select(collocations._floor_score(*[df[c] for c in "alr"])).first()[0]
    assert s == 1000000 * 3000000000001**2 // (3000000000007 * 9000000000000)


def test_occurrence_relation_is_sorted_by_piece_and_position():
    buf = np.frombuffer(b"a b. c\td\ne f", np.uint8)
    s, e, broken = collocations.positions(buf, np.array([0, 6, 12]))
    assert [buf[x:y].tobytes().decode() for x, y in zip(s, e)] == list("abcdef")
    assert broken.tolist() == [False, True, True, True, False, True]


# -- token alignment ---------------------------------------------------------------------------------------------------
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole_text_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    to_byte = alignment._byte_of()
    names = {i: t for t, i in a.get_vocab().items()}

    def tokens(text):
        """(ids, bytes of each) by A and by B of the whole text at once."""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        return [(i, bytes(to_byte[c] for c in names[i])) for i in ids_a], list(zip(ids_b, bytes_b))

    return tokens


def _brute_alignment(rows, tokens):
    per_doc, counts = [], collections.Counter()
    for doc_id, text, *_ in rows:
        a, b = tokens(text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(x) for _, x in s]).tolist() if s else [] for s in (a, b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        links, j = [], 0
        for i, (ida, x) in enumerate(a):
            lo, hi = ends[0][i] - len(x), ends[0][i]
            while ends[1][j] <= lo:
                j += 1
            k = j
            while k < len(b) and ends[1][k] - len(b[k][1]) < hi:
                links.append((ida, b[k][0]))
                k += 1
        groups = []
        for lo, hi in zip([0, *common], common):
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(s, es) if lo < e <= hi) for s, es in zip((a, b), ends)))
        counts.update(set(links))
        per_doc.append((doc_id, len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = collections.Counter()
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    return sorted(((d, na, nb, g, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, g, ls, sha in per_doc), key=str)


def test_alignment_against_whole_texts(spark, whole_text_tokens):
    smoke = [r[0] for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("text").limit(60).collect()]
    rows, docs = _docs(spark, smoke)
    blocks = alignment.align(docs, A_PATH, B_PATH, block_bytes=6000, batch_bytes=2000)
    assert blocks.count() > 3
    got = alignment.scored(blocks, alignment.pair_counts(blocks))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = _brute_alignment(rows, whole_text_tokens)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(w[1] == 0 for w in want) >= 4  # null, empty, U+2581


def test_alignment_of_nothing(spark):
    _, docs = _docs(spark)
    for empty in (docs.where("false"), docs.where("text is null")):
        blocks = alignment.align(empty, A_PATH, B_PATH)
        got = alignment.scored(blocks, alignment.pair_counts(blocks))
        assert got.count() == empty.count() and got.where("n_a > 0 or groups_sha256 <> ''").count() == 0


def test_overlaps_are_found_from_both_sides():
    a = pd.DataFrame({"doc": [0, 0, 0, 1], "start": [0, 3, 5, 9]})
    b = pd.DataFrame({"doc": [0, 0, 1], "start": [0, 4, 9]})
    assert sorted(zip(*map(list, alignment.overlaps(a, b)))) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2)]


def test_parts_are_encoded_by_both_sides_at_once(whole_text_tokens, monkeypatch):
    """One look-up a part for both tokenizers; a run that a tokenizer does not give back leaves the others as they are."""
    alignment._LOADED.clear()
    known, (len_a, len_b) = alignment.loaded(A_PATH, B_PATH)
    words = [f"w{i}é" for i in range(3 * alignment.RUN + 5)]
    words[alignment.RUN + 3] = "x▁y"
    codes = known.codes([w.encode() for w in words])
    for word, (of_a, of_b) in zip(words, codes):
        a, b = whole_text_tokens(word)
        assert np.frombuffer(of_a, "<i4").tolist() == [i for i, _ in a]
        assert np.frombuffer(of_b, "<i4").tolist() == ([i for i, _ in b] if "▁" not in word else [-1])

    def fails(parts):
        raise AssertionError("encoded again")

    monkeypatch.setattr(known, "encode", fails)
    assert known.codes([w.encode() for w in words]) == codes


def test_a_token_across_parts_sends_only_its_run_part_by_part():
    token_bytes = [b" a", b" b", b" a b", b" c"]
    ids = {"a": [0], "b": [1], "c": [3], "a b": [2]}
    asked = []

    def encode(texts):
        asked.append(list(texts))
        return [[i for x in (t.replace("a b", "a_b").split(" ")) for i in ids[x.replace("_", " ")]] for t in texts]

    parts = ["c"] * alignment.RUN + ["c"] * (alignment.RUN - 2) + ["a", "b"] + ["c"] * 5
    got = alignment._codes(parts, encode, token_bytes, np.array([2, 2, 4, 2]))
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [ids[p] for p in parts]
    assert asked[1:] == [parts[alignment.RUN : 2 * alignment.RUN]]


# -- token files -------------------------------------------------------------------------------------------------------
W_PATH = public_tokenizers.path("word_bpe_49k.json")


def _whole_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(W_PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files_against_whole_texts(spark, tmp_path):
    rows, docs = _docs(spark)
    path = str(tmp_path / "ids")
    token_files.write(docs, path, W_PATH, page_ids=300, part_keys=7)
    got = token_files.read(spark, path, token_files.lookup(spark, path, docs)).collect()
    ids = _whole_ids([r[1] for r in rows])
    want = collections.Counter((r[0], tuple(i)) for r, i in zip(rows, ids))
    assert collections.Counter((g["doc_id"], tuple(np.frombuffer(g["ids"], "<u4").tolist())) for g in got) == want
    got.sort(key=lambda g: g["start"])
    keys = [NULL_ID if g["doc_id"] is None else g["doc_id"] for g in got]
    assert keys == sorted(keys)
    assert [g["start"] for g in got] == np.cumsum([0, *(g["n_tokens"] for g in got)])[:-1].tolist()
    assert all(len(g["ids"]) == 4 * g["n_tokens"] for g in got)


def test_token_files_by_key(spark, tmp_path):
    rows, docs = _docs(spark)
    path = str(tmp_path / "ids")
    token_files.write(docs, path, W_PATH, page_ids=100)
    keys = spark.createDataFrame([(3,), (None,), (5,), (10**12,), (-4,), (3,)], "doc_id long")
    places = token_files.lookup(spark, path, keys)
    assert {r["key"] for r in places.collect()} >= {3, 5, NULL_ID}
    got = collections.Counter(r["doc_id"] for r in token_files.read(spark, path, places).collect())
    assert got == {3: 3, 5: 1, None: 2}  # keys that are not there have no rows


def test_a_key_with_a_third_of_all_rows_has_one_place(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text number {i % 5}") for i in range(200)] + [(i, "x y") for i in range(400)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    token_files.write(docs.repartition(4), path, W_PATH, page_ids=50)
    place = token_files.lookup(spark, path, docs.where("doc_id = 7"))
    assert place.count() == 1 and place.first()["rows"] == 201 and place.first()["pages"] > 10
    assert token_files.read(spark, path, place).count() == 201


def test_token_files_of_nothing(spark, tmp_path):
    _, docs = _docs(spark)
    path = str(tmp_path / "ids")
    token_files.write(docs.where("false"), path, W_PATH)
    assert token_files.read(spark, path, token_files.lookup(spark, path, docs)).count() == 0


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 63), 1 << 62, 20000))
    bits, ranks, slots = token_files.perfect_hash(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert (token_files.probe(keys, bits, ranks) == slots).all()
    others = np.setdiff1d(np.random.default_rng(2).integers(0, 1 << 62, 5000), keys)
    prints = np.zeros(len(keys), np.uint32)
    prints[slots] = token_files.fingerprint(keys)
    at = token_files.probe(others, bits, ranks)
    assert ((at < 0) | (prints[np.maximum(at, 0)] != token_files.fingerprint(others))).all()


def test_words_are_encoded_as_in_the_whole_text():
    texts = pa.array(HARD)
    got = [r for lo, hi, ids, sizes in token_files.encoded(texts, W_PATH) for r in np.split(ids, np.cumsum(sizes)[:-1])]
    assert [g.tolist() for g in got] == _whole_ids(HARD)


def test_op13_query_on_the_small_table(spark, registry):
    got = {r["doc_id"]: r for r in registry[0]["op13_token_files"](spark, SMOKE).collect()}
    docs = sorted(spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for d, ids in zip(docs, _whole_ids([d["text"] for d in docs])):
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op12_query_on_the_small_table(spark, registry, whole_text_tokens):
    rows = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, registry[0]["op12_token_alignment"](spark, SMOKE).collect()), key=str)
    assert got == _brute_alignment(rows, whole_text_tokens)


def test_the_codec_drops_what_earlier_operators_kept():
    dropped = []
    workers.kept(lambda: dropped.append(1))
    bpe.codec.cache_clear()
    bpe.codec(**bpe.multilingual())
    assert dropped == [1]


def test_digests_hand_the_text_to_python_once(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, source string")
    plan = bpe.digests(docs, keep=["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    taken = re.search(r"MapInArrow run\((.*?)\)", plan).group(1)
    assert len(re.findall(r"#\d+", taken)) == 2  # the id and the text
    kept = bpe.digests(docs, keep=["text", "doc_id"]).orderBy("doc_id").collect()
    assert [(r.text, r.doc_id, r.n_tokens > 0) for r in kept] == [("a b", 1, True), (None, 2, False)]


def test_lm_trainers_leave_no_weights_behind(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w1") for i in range(200)], "doc_id long, text string")
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    assert lm.scores(docs).count() == 200
    assert not [f for f in set(os.listdir(folder)) - before if "weights" in f]  # they were as many as tasks, each a whole model, in every round
