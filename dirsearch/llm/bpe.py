"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An encoded segment is an element of a monoid: ``join(encode(a), encode(b)) == encode(a + b)``.  Texts are halved down
to leaves, and pieces (matches of the pattern) down to bytes or known tokens; neighbours are joined by encoding anew a
window around the seam, which grows until what lies outside provably stays:

* tokens of one piece: a row of tokens is the BPE encoding of its bytes exactly if each two neighbours are the encoding
  of their own concatenation (the first merge across a token boundary would also take place in that pair alone).  So a
  window is done when its outermost tokens and those next to them pass this test.  It relies on ranks as training
  gives them: a token ranks after its parts;
* pieces of a text: under this pattern a single space between two other characters always begins a piece, and pieces
  do not depend on what lies beyond such spaces.  So a text is a row of units, each from one such space to the next; all
  units of the left segment but the last stay, and those of the right segment from the first boundary on that both
  splits share.

Texts longer than ``segment`` characters are cut into segments that different tasks encode; rounds of grouped joins
bring neighbours together, ``FAN_IN`` at a time.  Decoding concatenates the bytes of the ids up the same tree.

Defined results: null and empty texts have no ids; the special tokens' strings are ordinary text; rows that are equal
are encoded alike; extra columns pass through.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirsearch.llm import workers
from dirsearch.llm.registry import register, table
from dirsearch.llm.store import written

LEAF = 4096  # characters
SEGMENT = 1 << 16  # characters
FAN_IN = 8
CACHE = 1 << 16  # entries of a cache's generation
WORDS = 1 << 17  # that of whole words
SHORT = 16  # bytes; encodings of halves of pieces up to this length are kept
BATCH_BYTES = 4 << 20
_CLOSE = re.compile(r"\s | \s")  # spaces beside other white space
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def unit_words(text: str) -> list[str]:
    """The units of a text, without the space that begins each but the first."""
    return _BETWEEN.split(text) if _CLOSE.search(text) else text.split(" ")


class Generations(dict):
    """A cache of two generations: bounded, and what is used stays."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Words(Generations):
    """Ids of words after a space; those of letters only are kept, the others are put together from their pieces."""

    def __init__(self, codec: Codec):
        super().__init__(lambda w: codec.piece(" " + w), WORDS)
        self.ids_of = codec.ids_of
        # marks that the pattern takes for a piece of their own after a word
        self.marks = {m: codec.piece(m) for m in ".,;:!?" if codec.findall(" a" + m) == [" a", m]}

    def __missing__(self, word):
        if word.isalpha():
            return super().__missing__(word)
        mark = self.marks.get(word[-1:])
        if mark is not None and word[:-1].isalpha():
            return self[word[:-1]] + mark
        return self.ids_of(" " + word)


class Codec:
    """Ranks and the joins over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.pieces = Generations(self.piece)
        self.halves = Generations(self.tree)
        self.fits = Generations(self.fit)
        self.seams = Generations(self.merged)
        self.parts = {}  # token: the two that its last merge joins; None if merges don't make it, or if it is a byte
        self.spaced = Words(self)

    # -- one piece ---------------------------------------------------------------------------------------------
    def merged(self, b: bytes, below: int = 1 << 32) -> tuple[int, ...]:
        """The merges themselves, lowest rank first, leftmost first among equals; for windows and single tokens."""
        n, rank = len(b), self.ranks.get
        end = list(range(1, n + 1)) + [n]  # end[i]: end of the part that begins at i; 0 where none begins any more
        before = list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := rank(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if r >= below:
                break
            j = end[i]
            if not j or j >= n or rank(b[i : end[j]]) != r:
                continue  # one of the two parts is gone or has grown
            k = end[i] = end[j]
            end[j] = 0
            before[k] = i
            if k < n and (r := rank(b[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank(b[h:k])) is not None:
                heapq.heappush(heap, (r, h))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i : end[i]]])
            i = end[i]
        return tuple(out)

    def split(self, b: bytes) -> tuple[bytes, bytes] | None:
        if b not in self.parts:
            two = self.merged(b, self.ranks[b]) if len(b) > 1 else ()
            self.parts[b] = (self.bytes_of[two[0]], self.bytes_of[two[1]]) if len(two) == 2 else None
        return self.parts[b]

    def fit(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay two: goes back through the merges that made them, latest first, and looks whether
        the parts that touch would have merged before either merged with what lies further inside."""
        rank = self.ranks
        (r1, r2), never = pair, 1 << 32
        a, b = self.bytes_of[r1], self.bytes_of[r2]
        until1 = until2 = never
        while True:
            r = rank.get(a + b, never)
            if r < until1 and r <= until2 and r != never:
                return False
            one, two = self.split(a), self.split(b)
            if one is None and two is None:
                return True
            if two is None or (one is not None and r1 > r2):
                until1, a = r1, one[1]
                r1 = rank[a]
            else:
                until2, b = r2, two[0]
                r2 = rank[b]

    def join_tokens(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        if self.fits[a[-1], b[0]]:
            return a + b
        i = j = 1
        while True:
            window = b"".join(map(self.bytes_of.__getitem__, a[len(a) - i :] + b[:j]))
            seam = self.seams[window] if len(window) < 32 else self.merged(window)
            left = i == len(a) or self.fits[a[-i - 1], seam[0]]
            right = j == len(b) or self.fits[seam[-1], b[j]]
            if left and right:
                return a[: len(a) - i] + seam + b[j:]
            if not left:
                i = min(2 * i, len(a))
            if not right:
                j = min(2 * j, len(b))

    def tree(self, b: bytes) -> tuple[int, ...]:
        r = self.ranks.get(b)
        if r is not None and (len(b) == 1 or self.split(b)):
            return (r,)
        mid = len(b) // 2
        if len(b) <= SHORT:
            return self.join_tokens(self.halves[b[:mid]], self.halves[b[mid:]])
        return self.join_tokens(self.tree(b[:mid]), self.tree(b[mid:]))

    def piece(self, p: str) -> tuple[int, ...]:
        b = p.encode()
        r = self.ranks.get(b)  # a piece that is a token is that token, whatever its merges
        return (r,) if r is not None else self.tree(b)

    # -- one text ----------------------------------------------------------------------------------------------
    def ids_of(self, text: str) -> list[int]:
        out = []
        for p in self.findall(text):
            out += self.spaced[p[1:]] if p[0] == " " and p[1:].isalpha() else self.pieces[p]
        return out

    def unit_ids(self, words: list[str]) -> list:
        """Ids of the units of a text, which are words: the first one without the space before it."""
        return [self.ids_of(words[0]), *map(self.spaced.__getitem__, words[1:])]

    def units(self, text: str) -> tuple[list[int], list]:
        """Ends and ids of the units of a text."""
        words = unit_words(text)
        return list(accumulate(map((1).__add__, map(len, words[1:])), initial=len(words[0]))), self.unit_ids(words)

    def segment(self, text: str) -> Segment:
        """The element of a text: its units' ends and token counts, and its ids."""
        if len(text) <= LEAF:
            ends, ids = self.units(text)
            return Segment(text, ends, list(map(len, ids)), list(chain.from_iterable(ids)))
        mid = len(text) // 2
        return self.join(self.segment(text[:mid]), self.segment(text[mid:]))

    def join(self, a: Segment, b: Segment) -> Segment:
        if not a.text or not b.text:
            return b if not a.text else a
        text = a.text + b.text
        keep = len(a.ends) - 1
        start = a.ends[keep - 1] if keep else 0
        j = 1
        while True:
            j = min(j, len(b.ends))
            stop = len(a.text) + b.ends[j - 1]
            ends, seam = self.units(text[start:stop])
            ends = [start + e for e in ends]
            if j == len(b.ends):
                rest = j
                break
            # the last unit of the window may still change; a shared boundary before it ends the search
            known = {len(a.text) + e: i for i, e in enumerate(b.ends[:j], 1)}
            shared = next((e for e in reversed(ends[:-1]) if e in known), None)
            if shared is not None:
                rest = known[shared]
                n = bisect_left(ends, shared) + 1
                ends, seam = ends[:n], seam[:n]
                break
            j *= 2
        return Segment(text, a.ends[:keep] + ends + [len(a.text) + e for e in b.ends[rest:]],
                       a.counts[:keep] + [len(t) for t in seam] + b.counts[rest:],
                       a.ids[: sum(a.counts[:keep])] + list(chain.from_iterable(seam)) + b.ids[sum(b.counts[:rest]) :])

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.unit_ids(unit_words(text)))) if len(text) <= LEAF else self.segment(text).ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class Segment:
    __slots__ = ("text", "ends", "counts", "ids")

    def __init__(self, text: str, ends: list[int], counts: list[int], ids: list[int]):
        self.text, self.ends, self.counts, self.ids = text, ends, counts, ids


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """The codec of a ranks file (lines of base64 token and rank), once per worker."""
    workers.release()  # what earlier operators kept in this worker
    workers.kept(codec.cache_clear)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return Codec(ranks, pattern)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some megabytes, or of one row."""
    for b in batches:
        rows = max(1, b.num_rows * BATCH_BYTES // max(1, b.nbytes))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def pack(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    return packed.tobytes() if sys.byteorder == "little" and packed.itemsize == 4 else np.asarray(ids, "<u4").tobytes()


def unpack(b: bytes) -> list[int]:
    return np.frombuffer(b, "<u4").tolist()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids",
           segment: int = SEGMENT) -> DataFrame:
    """docs and a binary column ``out``: the ids of each text as little-endian unsigned 32-bit integers.  A column of docs
    that is named like ``out`` is replaced."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != out.lower() or c == text])
    if out.lower() == text.lower():
        raise ValueError("the ids need another column than the text")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])
    n = len(docs.columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in small(batches):
            ids = [pack(c.encode(t.as_py())) for t in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(ids, pa.binary())], names=schema.names)

    return (_sized(docs, text, segment, short=True).mapInArrow(whole, schema)
            .unionAll(encode_long(docs, ranks_path, pattern, text, out, segment)))


def _sized(docs: DataFrame, text: str, segment: int, short: bool) -> DataFrame:
    """The rows with short or with long texts, and the text once more as the last column, null as empty."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    fits = F.length(whole) <= segment
    return docs.where(fits if short else ~fits).select(*[f"`{c}`" for c in docs.columns], whole.alias(_free("_bpe_text", docs.columns)))


def _free(name: str, taken: list[str]) -> str:
    """A column name that is not taken, in any case of letters."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def encode_long(docs: DataFrame, ranks_path: str, pattern: str, text: str, out: str, segment: int = SEGMENT) -> DataFrame:
    """``encode`` of the rows whose texts are longer than a segment: their segments are encoded and joined in rounds."""
    names = docs.columns
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.where(F.length(whole) > segment).select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"),
                                                          whole.alias("_bpe_text"))
    cut = f"transform(sequence(0, cast((length(_bpe_text) - 1) div {segment} as int)), i -> substring(_bpe_text, i * {segment} + 1, {segment}))"
    parts = written(source.select(F.monotonically_increasing_id().alias("key"), "row", F.expr(cut).alias("parts"))
                    .select("key", "row", F.posexplode("parts").alias("at", "part"))
                    .withColumn("row", F.when(F.col("at") == 0, F.col("row"))), "bpe-parts")
    element = T.StructType([T.StructField(n, T.BinaryType()) for n in ("ends", "counts", "ids")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            done = [c.segment(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([pack(getattr(s, n)) for s in done], pa.binary()) for n in element.names)],
                                             names=["key", "at", "part", *element.names])

    wide = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType()),
                         T.StructField("part", T.StringType()), *element.fields])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        c = codec(ranks_path, pattern)
        rows = rows.sort_values("at")
        done = [Segment(r.part, unpack(r.ends), unpack(r.counts), unpack(r.ids)) for r in rows.itertuples()]
        while len(done) > 1:  # neighbours, pair by pair
            done = [c.join(*done[i : i + 2]) if i + 1 < len(done) else done[i] for i in range(0, len(done), 2)]
        s = done[0]
        return pd.DataFrame({"key": rows["key"].iloc[:1].to_numpy(), "at": [int(rows["at"].iloc[0]) // FAN_IN], "part": [s.text],
                             "ends": [pack(s.ends)], "counts": [pack(s.counts)], "ids": [pack(s.ids)]})

    level = parts.select("key", "at", "part").mapInArrow(each, wide)
    most = parts.agg(F.max("at")).first()[0] or 0
    while most > 0:
        level = level.groupBy("key", F.expr(f"at div {FAN_IN}")).applyInPandas(joined, wide)
        most //= FAN_IN
    return (parts.where("at = 0").select("key", "row").join(level.select("key", "ids"), "key")
            .select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("ids").alias(out)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """df (or its columns ``keep``) and a binary column ``out``: the bytes of each row's ids."""
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in small(batches):
            done = [c.decode(unpack(x.as_py())) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(done, pa.binary())], names=[*keep, out])

    return df.select(*[f"`{c}`" for c in keep], F.col(f"`{ids}`").alias("_bpe_ids")).mapInArrow(run, schema)


def multilingual() -> dict[str, str]:
    """Ranks and pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def digests(docs: DataFrame, keep: list[str], with_ids: bool = False) -> DataFrame:
    """The columns ``keep``, the token count and the digests of the ids and of what they decode to; ids if asked for.

    Texts of one segment are encoded, decoded from their ids and digested in one pass; longer ones by ``encode_long`` and
    ``decode``."""
    docs, tokenizer = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]), multilingual()
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")),
                           *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(**tokenizer)
        for b in small(batches):
            n, coded, back, packed = [], [], [], []
            for t in b.column(b.num_columns - 1):
                ids = c.encode(t.as_py())
                raw = pack(ids)
                n.append(len(ids))
                coded.append(sha256(raw).hexdigest())
                back.append(sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    packed.append(raw)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string()),
                                              *([pa.array(packed, pa.binary())] if with_ids else [])], names=schema.names)

    short = _sized(docs, "text", SEGMENT, short=True)
    short = short.select(*[F.col(f"`{c}`") for c in [*keep, short.columns[-1]]]).mapInArrow(run, schema)  # the text goes to Python once
    long = encode_long(docs, **tokenizer, text="text", out="_ids")
    long = decode(long, **tokenizer, ids="_ids", out="_decoded", keep=[*keep, "_ids"])
    return short.unionAll(long.select(*keep, (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"),
                                      F.sha2("_decoded", 256).alias("decoded_sha256"), *([F.col("_ids").alias("ids")] if with_ids else [])))


@register("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), keep=["doc_id"])
