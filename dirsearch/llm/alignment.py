"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of aligned token pairs.

Tokenizer A is a byte-level BPE that reads space + text, B a piece model that puts the space itself; so both cover the
same bytes.  Both sides of a batch's documents are laid out on one line of bytes, and a search by place gives each token's start the
other side's token that covers it; the union of both directions is every pair of tokens whose byte ranges overlap (links).
Where tokens of both sides end at the same byte, a group ends.

Pair counts: a block of about ``BLOCK_BYTES`` of texts has one row with its distinct id pairs and in how many of its
documents each is linked; these are summed over the corpus, compared with the highest count of their A id, and sent back
to the blocks that hold the pair.  A pair that a third of all documents hold is one row a block.

Texts are cut before a space that follows a character other than white space, and every distinct part of a batch is
encoded once by both, many parts in one call.  That is exact: A's pattern has no match that goes on with a space after another character, and none of
B's pieces holds a space after another character (checked when the model is loaded), so no merge of either reaches
across such a place.

Defined results: texts that are null, empty, or not restored by both token sequences have no tokens, zero counts and an
empty group string; repeated rows are documents of their own; texts of any length are whole (a block holds at least
one); an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirsearch.llm import flat, units, workers
from dirsearch.llm.registry import register, table
from dirsearch.llm.store import written

BATCH_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
RUN = 64
SPACE = "▁"

_LOADED: dict[tuple[str, str], tuple[units.Encoded, list[np.ndarray]]] = {}


def _byte_of() -> dict[str, int]:
    """The bytes behind the printable characters of byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def loaded(a_path: str, b_path: str):
    """The worker's encoder of parts by A and by B, and the lengths in bytes of their ids."""
    if (a_path, b_path) not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        a.encode_special_tokens = True
        to_byte = _byte_of()
        a_bytes = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab().items():
            a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        b_bytes = []
        for i in range(b.vocab_size()):
            piece = b.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"texts cannot be cut at spaces for {b_path}: a piece holds one inside")
            b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(SPACE, " ").encode())

        lengths = [np.array([len(x) for x in side], np.int64) for side in (a_bytes, b_bytes)]

        def encode(parts: list[str]) -> list[tuple[bytes, bytes]]:
            of_a = _codes(parts, lambda texts: [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], a_bytes, lengths[0])
            return list(zip(of_a, _codes(parts, lambda texts: b.encode(texts, num_threads=1), b_bytes, lengths[1])))

        workers.kept(_LOADED.clear)
        _LOADED[a_path, b_path] = units.Encoded(encode), lengths
    return _LOADED[a_path, b_path]


def _codes(parts: list[str], encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes], lengths: np.ndarray) -> list[bytes]:
    """The ids of each part, or -1 where they do not give the part back; ``RUN`` parts are encoded in one text."""
    runs = [parts[i : i + RUN] for i in range(0, len(parts), RUN)]
    texts = [" ".join(r) for r in runs]
    got = encode(texts)
    same = [b"".join(map(token_bytes.__getitem__, ids)) == b" " + t.encode() for ids, t in zip(got, texts)]
    ids = np.array(list(itertools.chain.from_iterable(itertools.compress(got, same))), "<i4")
    kept = list(itertools.chain.from_iterable(itertools.compress(runs, same)))
    upto, bounds = np.zeros(len(ids) + 1, np.int64), np.zeros(len(kept) + 1, np.int64)
    np.cumsum(lengths[ids], out=upto[1:])
    np.cumsum(np.fromiter(map(len, map(str.encode, kept)), np.int64, len(kept)) + 1, out=bounds[1:])
    cuts = np.searchsorted(upto, bounds)
    across = set((np.flatnonzero(upto[cuts] != bounds) // RUN).tolist())  # kept runs with a token that reaches across parts
    code, at = ids.tobytes(), (4 * cuts).tolist()
    codes = [code[x:y] for x, y in zip(at, at[1:])]
    if len(kept) == len(parts) and not across:
        return codes
    out, k = [], 0
    for run, ok in zip(runs, same):
        if ok and k // RUN not in across:
            out += codes[k : k + len(run)]
        else:
            for p, each in zip(run, encode(run)):
                back = b"".join([token_bytes[i] for i in each]) == b" " + p.encode()
                out.append(np.array(each if back else [-1], "<i4").tobytes())
        k += len(run) if ok else 0
    return out


def parts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the parts of texts, without the space before each but a row's first."""
    n = len(buf)
    rows = np.flatnonzero(np.diff(offs) > 0)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.zeros(n, np.uint8)
    before[1:] = buf[:-1]
    second = np.zeros(n, np.uint8)
    second[2:] = buf[:-2]
    # a printable ASCII character, or a character of two bytes that is no white space
    plain = ((before > 32) & (before < 127)) | ((before >= 128) & (second >= 0xC3) & (second <= 0xDF))
    cut = (buf == 32) & plain
    cut[offs[:-1][rows]] = False
    cut[offs[1:][rows] - 1] = False
    at = np.flatnonzero(cut)
    starts = np.sort(np.concatenate([offs[:-1][rows], at + 1]))
    row = np.searchsorted(offs, starts, side="right") - 1
    ends = np.concatenate([starts[1:] - 1, [0]])
    last = np.ones(len(starts), bool)
    last[:-1] = row[1:] != row[:-1]
    ends[last] = offs[row[last] + 1]
    return starts, ends, row


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of all pairs of tokens that overlap; both hold (doc, start), sorted by start, and cover the same
    bytes, so that the first tokens of a document start at one place on both sides."""
    start_a, start_b = a["start"].to_numpy(), b["start"].to_numpy()
    of_a = np.searchsorted(start_b, start_a, side="right") - 1
    of_b = np.searchsorted(start_a, start_b, side="right") - 1
    # tokens that start together are found from both sides
    alone = np.flatnonzero(start_a[of_b] != start_b)
    return np.concatenate([np.arange(len(a)), of_b[alone]]), np.concatenate([of_a, alone])


class _Numbers:
    """Ids as decimal strings with what follows them; their texts are joined by taking them."""

    def __init__(self, most: int):
        plain = [str(i) for i in range(most)]
        self.most, self.strings = most, pa.array([x + c for c in ",|;" for x in plain], pa.large_string())

    def joined(self, ids: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all strings, and where each begins."""
        taken = self.strings.take(pa.array(ids + self.most * follows))
        _, offsets, data = taken.buffers()
        return np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[: len(ids) + 1]


def aligned(texts: pa.Array, a_path: str, b_path: str, batch_bytes: int = BATCH_BYTES) -> Iterator[dict]:
    """For runs of rows: counts per row, digest of the groups, and the links as (row, A id * 2**32 + B id, times), sorted."""
    known, (len_a, len_b) = loaded(a_path, b_path)
    numbers = _Numbers(max(len(len_a), len(len_b)))
    bits_a, bits_b = len(len_a).bit_length(), len(len_b).bit_length()
    for lo, hi, buf, offs in flat.chunks(texts, batch_bytes):
        n = hi - lo
        s, e, part_row = parts(buf, offs)
        which, words = units.distinct(buf, s, e)
        sides = []
        valid = np.ones(n, bool)
        for codes, lengths in zip(zip(*known.codes(words)) if words else ((), ()), (len_a, len_b)):
            ids, count = units.spread(codes, which)
            ids = ids[:, 0].astype(np.int64)
            row = np.repeat(part_row, count)
            valid[row[ids < 0]] = False
            sides.append((ids, row, lengths))
        tokens = []
        for ids, row, lengths in sides:
            keep = valid[row]
            ids, row = ids[keep], row[keep]
            size = lengths[ids]
            end = np.cumsum(size)  # the bytes of all valid rows before count on both sides alike
            tokens.append((ids, row, end - size, end))
        (ia, ra, sa, ea), (ib, rb, sb, eb) = tokens
        at_a, at_b = overlaps(pd.DataFrame({"doc": ra, "start": sa}), pd.DataFrame({"doc": rb, "start": sb})) if len(ia) else (ra, rb)
        ends = np.zeros(int(ea[-1]) + 1 if len(ea) else 1, np.int8)
        ends[ea] = 1
        ends[eb] += 1
        last_a, last_b = ends[ea] == 2, ends[eb] == 2
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        # within a group A's tokens come first, then B's
        upto_a, upto_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        order_a = np.arange(len(ia)) + (np.cumsum(upto_b) - upto_b)[group_a]
        order_b = np.arange(len(ib)) + np.cumsum(upto_a)[group_b]
        ids, follows, row = (np.zeros(len(ia) + len(ib), np.int64) for _ in range(3))
        ids[order_a], ids[order_b] = ia, ib
        follows[order_a], follows[order_b] = last_a, 2 * last_b
        row[order_a], row[order_b] = ra, rb
        data, begin = numbers.joined(ids, follows)
        bounds = begin[np.searchsorted(row, np.arange(n + 1))]
        digests = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:])]
        link_row = ra[at_a]
        count = [np.bincount(x, minlength=n) for x in (ra, rb, ra[last_a], link_row)]
        key = (link_row << bits_a | ia[at_a]) << bits_b | ib[at_b]  # sorted as plain numbers
        key.sort()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else at_a
        key, times = key[start], np.diff(start, append=len(key))
        pair = (key >> bits_b & (1 << bits_a) - 1) << 32 | key & (1 << bits_b) - 1
        yield {"lo": lo, "hi": hi, "counts": count, "digests": digests, "links": (key >> bits_a + bits_b, pair, times)}


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
DOC = "doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string"


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
          batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The blocks of docs: (block, docs, pairs, held, links).

    ``docs`` are the block's rows in order: id, tokens of A and of B, groups, links, digest of the group string.
    ``pairs`` are its distinct id pairs (A id * 2**32 + B id) and ``held`` the number of its documents that link them;
    ``links`` are, row after row, the row's number of distinct pairs, the steps between their places in ``pairs``, and how
    often each is linked, as 32-bit integers packed with zstd.
    """
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = f"block long, docs array<struct<{DOC}>>, pairs array<long>, held array<long>, links binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []  # (ids, counts, digests)
        links: list[tuple] = []  # (row, pair, times), rows counted from the block's first
        size = first = 0

        def packed() -> pa.RecordBatch:
            counts = [np.concatenate([r[1][i] for r in rows]) for i in range(len(COUNTS))]
            row, pair, times = (np.concatenate([x[i] for x in links]) for i in range(3))
            pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)
            each = np.bincount(row, minlength=first)
            step = np.diff(place, prepend=0)
            begins = np.cumsum(each) - each
            begins = begins[each > 0]
            step[begins] = place[begins]
            raw = np.concatenate([each, step, times]).astype("<i4").tobytes()
            done = pa.StructArray.from_arrays([pa.concat_arrays([r[0] for r in rows]), *map(pa.array, counts),
                                               pa.array([d for r in rows for d in r[2]], pa.string())], names=["doc_id", *COUNTS, "groups_sha256"])
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.ListArray.from_arrays([0, len(done)], done), pa.ListArray.from_arrays([0, len(pairs)], pa.array(pairs)),
                pa.ListArray.from_arrays([0, len(pairs)], pa.array(held)), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())],
                names=["block", "docs", "pairs", "held", "links"])

        for b in batches:
            for x in aligned(b.column(1), a_path, b_path, batch_bytes):
                row, pair, times = x["links"]
                links.append((row + first, pair, times))
                rows.append((b.column(0).slice(x["lo"], x["hi"] - x["lo"]), x["counts"], x["digests"]))
                first += x["hi"] - x["lo"]
                size += int(x["counts"][0].sum()) * 3 + x["hi"] - x["lo"]
                if size >= block_bytes:
                    yield packed()
                    rows, links, size, first, block = [], [], 0, 0, block + 1
        if rows:
            yield packed()

    return written(source.mapInArrow(run, schema), "alignment", "zstd")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each pair is linked, and whether that is its A id's highest count."""
    each = blocks.select(F.inline(F.arrays_zip("pairs", "held")).alias("pair", "held"))
    counts = written(each.groupBy("pair").agg(F.sum("held").alias("count")), "alignment-pairs")
    a_id = F.shiftright("pair", 32)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    return counts.withColumn("a_id", a_id).join(most, "a_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each document: its id and counts, n_best, count_sum and the digest of its groups."""
    seen = (blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
            .groupBy("block").agg(F.collect_list(F.struct("at", (F.col("count") * 2 + F.col("best").cast("int")).alias("v"))).alias("x"))
            .select("block", F.col("x.at").alias("at"), F.col("x.v").alias("v")))
    rows = blocks.select("block", "docs", "links").join(seen, "block", "left").select("docs", "links", "at", "v")
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs = b.column(0)[i].values
                raw = np.frombuffer(pa.decompress(b.column(1)[i].as_buffer(), _unpacked(b.column(1)[i].as_buffer()), "zstd"), "<i4").astype(np.int64)
                n = len(docs)
                each, rest = raw[:n], raw[n:]
                step, times = rest[: len(rest) // 2], rest[len(rest) // 2 :]
                row = np.repeat(np.arange(n), each)
                total = np.cumsum(step)
                begins = (np.cumsum(each) - each)[each > 0]
                base = np.zeros(n, np.int64)
                base[each > 0] = total[begins] - step[begins]
                place = total - base[row]
                value = np.zeros(len(place), np.int64)
                if len(place):
                    known = np.zeros(int(place.max()) + 1, np.int64)
                    known[b.column(2)[i].values.to_numpy()] = b.column(3)[i].values.to_numpy()
                    value = known[place]
                sums = [np.zeros(n, np.int64) for _ in range(2)]
                np.add.at(sums[0], row, times * (value & 1))
                np.add.at(sums[1], row, times * (value >> 1))
                fields = [docs.field(c) for c in ("doc_id", *COUNTS)]
                yield pa.RecordBatch.from_arrays([*fields, *map(pa.array, sums), docs.field("groups_sha256")], names=names)

    return rows.mapInArrow(run, schema)


def _unpacked(packed: pa.Buffer) -> int:
    """Bytes that a zstd frame holds."""
    import zstandard

    return zstandard.get_frame_parameters(packed.to_pybytes()[:18]).content_size


@register("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    blocks = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return scored(blocks, pair_counts(blocks))
