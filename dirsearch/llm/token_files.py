"""Token ids of a corpus as binary pages, with a minimal perfect hash index from document keys to their places.

``write(docs, path, tokenizer_path)`` sorts documents by id into shards by range; rows with the same id are ordered by
a hash of their text and may spread over shards.  Texts are encoded, each followed by ``end_id``, and their ids are
written one after the other as raw little-endian unsigned integers, of 16 bits if the vocabulary allows it, else of 32.
The format is three Parquet tables:

* ``pages``: (shard, page, n, width, ids, keys, sizes): ids of whole documents, at least ``PAGE_IDS`` of them but for a
  shard's last page, the bytes of an id, and the documents' keys and numbers of ids;
* ``shards``: (shard, first_page, first_id): pages and ids of all shards before;
* ``index``: (part, parts, bits, ranks, prints, places): for each hash part of the keys, about ``PART_KEYS`` of them, a
  minimal perfect hash as levels of bits, and for each of its slots a fingerprint and the key's place.

The hash: at each level the keys left fall on 2 bits a key by a seeded mix; a bit that one key hits alone is set and
holds it, the others go on to the next level.  A key's slot is the number of set bits before its own.  A place is
(shard, page, row in the page, pages that hold the key, rows): all rows of a key stand next to each other, so that even
a key that holds a third of all rows has one place.

``lookup(spark, path, keys)`` finds places: keys meet their part's index row, are probed level by level and compared
with the fingerprint; a key that the index does not hold passes the fingerprint with a probability of 2**-32 and is then
refused by the page's own keys.  ``read(spark, path, places)`` joins places with pages and gives a row for each document.

Defined results: null and empty texts have the end id alone; a null key stands for the smallest long and comes first;
rows repeated are written as often as they come; texts of any length are whole (a page holds at least one); an empty
table gives empty tables; columns other than the id and the text are not read.

Texts are cut at ASCII white space and every distinct word of a batch is encoded once, many words in one call: the
tokenizer drops white space before it forms tokens, and neither its normaliser nor its patterns reach across it.  Words
that differ in the case of A-Z are one, and ``.,;:!?%&$*#`` after a letter at a word's end stand for themselves, where
that gives the same ids (``words``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dirsearch.llm import flat, units, workers
from dirsearch.llm.registry import register, table
from dirsearch.llm.store import NULL_ID, shared_dir

PAGE_IDS = 1 << 17
PART_KEYS = 50_000
BITS_PER_KEY = 2
END_ID = 1
CHUNK_BYTES = 3 << 20
RUN = 64
MOST_WORDS = 350_000
CLOSING = 6

_CLOSES = np.zeros(256, bool)
_CLOSES[list(b".,;:!?%&$*#")] = True
_WORDS: dict[str, units.Encoded] = {}


def word_codes(tokenizer_path: str) -> units.Encoded:
    """The worker's codes of words by the tokenizer file."""
    if tokenizer_path not in _WORDS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)

        def encode(words: list[str]) -> list[bytes]:
            out = []
            runs = [words[i : i + RUN] for i in range(0, len(words), RUN)]
            for run, e in zip(runs, tokenizer.encode_batch([" ".join(r) for r in runs], add_special_tokens=False)):
                begins = np.cumsum([0, *(len(w) + 1 for w in run)])
                at = np.fromiter([o[0] for o in e.offsets], np.int64, len(e))  # a token's first character
                cuts = np.searchsorted(at, begins) * 4
                ids = np.array(e.ids, "<i4").tobytes()
                out += [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            return out

        workers.kept(_WORDS.clear)
        _WORDS[tokenizer_path] = units.Encoded(encode, MOST_WORDS)
    return _WORDS[tokenizer_path]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with fewer cases, and starts, ends and rows of their words.

    A-Z become a-z unless a combining mark may follow (the normaliser composes before it lowers the case), and a run of
    punctuation at a word's end is a word of its own if an ASCII or Latin-1 letter stands before it (no pattern of the
    tokenizer goes on there).  Texts with ``<|`` keep their case: special tokens are told by it.
    """
    s, e, row = flat.words(buf, offs)
    if not len(s):
        return buf, s, e, row
    if b"<|" not in buf.tobytes():
        after = np.zeros(len(buf), np.uint8)
        after[:-1] = buf[1:]
        free = (after < 0x80) | ((after >= 0xC3) & (after <= 0xCA))
        buf = np.where(free, flat.lower(buf), buf)
    own = np.flatnonzero(_CLOSES[buf[e - 1]])
    cut = e[own]
    for _ in range(CLOSING):  # words that close with more stay whole
        cut -= _CLOSES[buf[cut - 1]] & (cut > s[own] + 1)
    last, before = buf[cut - 1], buf[np.maximum(cut - 2, 0)]
    letter = ((last | 32) >= 97) & ((last | 32) <= 122)
    letter |= (before == 0xC3) & (cut > s[own] + 1) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
    own, cut = own[letter], cut[letter]
    ends = e.copy()
    ends[own] = cut
    return buf, np.insert(s, own + 1, cut), np.insert(ends, own + 1, e[own]), np.insert(row, own + 1, row[own])


def encoded(texts: pa.Array, tokenizer_path: str, end_id: int = END_ID) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, ids of each row) for runs of rows; each row's ids end with ``end_id``."""
    known = word_codes(tokenizer_path)
    for lo, hi, buf, offs in flat.chunks(texts, CHUNK_BYTES):
        buf, s, e, row = words(buf, offs)
        which, distinct = units.distinct(buf, s, e)
        values, count = units.spread(known.codes(distinct), which)
        sizes = units.per_row(count, row, hi - lo) + 1
        out = np.full(int(sizes.sum()), end_id, "<u4")
        body = np.ones(len(out), bool)
        body[np.cumsum(sizes) - 1] = False
        out[body] = values[:, 0]
        yield lo, hi, out, sizes


PAGES = "shard int, page int, n long, width int, ids binary, keys array<long>, sizes array<long>"
SHARDS = "shard int, first_page long, first_id long"
INDEX = "part long, parts long, bits array<binary>, ranks array<long>, prints binary, places binary"
PLACE = np.dtype([("page", "<i8"), ("row", "<i8"), ("pages", "<i8"), ("rows", "<i8")])


def write(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
          page_ids: int = PAGE_IDS, part_keys: int = PART_KEYS) -> None:
    """Writes the pages, shards and index of docs under path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    source = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID)).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    order = ["key", F.xxhash64("text"), F.monotonically_increasing_id()]
    in_order = (source.withColumns({"h": order[1], "m": order[2]}).repartitionByRange("key", "h", "m")
                .sortWithinPartitions("key", "h", "m").select("key", "text"))

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            ids, k, z = (np.concatenate(x) for x in (held, keys, sizes))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([len(ids)], pa.int64()),
                                               pa.array([width], pa.int32()), pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary()), pa.ListArray.from_arrays([0, len(k)], pa.array(k)),
                                               pa.ListArray.from_arrays([0, len(z)], pa.array(z))], names=["shard", "page", "n", "width", "ids", "keys", "sizes"])

        for b in batches:
            key_column = b.column(0).to_numpy()
            for lo, hi, ids, size in encoded(b.column(1), tokenizer_path, end_id):
                at, upto = 0, np.cumsum(size)
                have = sum(map(len, held))
                while at < len(size):  # whole documents until the page is full
                    before = int(upto[at - 1]) if at else 0
                    end = min(len(size), int(np.searchsorted(upto, before + page_ids - have, side="left")) + 1)
                    held.append(ids[before : upto[end - 1]])
                    keys.append(key_column[lo + at : lo + end])
                    sizes.append(size[at:end])
                    have += int(upto[end - 1]) - before
                    at = end
                    if have >= page_ids:
                        yield row()
                        held, keys, sizes, have, page = [], [], [], 0, page + 1
        if keys:
            yield row()

    in_order.mapInArrow(paged, PAGES).write.parquet(f"{path}/pages", compression="zstd")
    pages = _table(spark, path, "pages", PAGES)
    # one row a shard: as many as the sort had partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    total = pages.groupBy("shard").agg(F.count("*").alias("p"), F.sum("n").alias("n"))
    (total.select("shard", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("first_page"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_id"))
     .write.parquet(f"{path}/shards"))

    rows = (pages.join(_table(spark, path, "shards", SHARDS), "shard")
            .select((F.col("first_page") + F.col("page")).alias("page"), F.posexplode("keys").alias("row", "key")))
    places = rows.groupBy("key").agg(F.min(F.struct("page", "row")).alias("first"), F.max("page").alias("last"), F.count("*").alias("rows"))
    parts = max(1, -(-(pages.select(F.sum(F.size("keys"))).first()[0] or 0) // part_keys))

    def indexed(group: pd.DataFrame) -> pd.DataFrame:
        bits, ranks, slots = perfect_hash(group["key"].to_numpy(np.int64))
        place, prints = np.zeros(len(group), PLACE), np.zeros(len(group), "<u4")
        prints[slots] = fingerprint(group["key"].to_numpy(np.int64))
        for name in PLACE.names:
            place[name][slots] = group[name]
        return pd.DataFrame({"part": group["part"].iloc[:1].to_numpy(), "parts": [parts], "bits": [bits], "ranks": [ranks], "prints": [prints.tobytes()], "places": [place.tobytes()]})

    (places.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "key", F.col("first.page").alias("page"), F.col("first.row").cast("long").alias("row"),
                   (F.col("last") - F.col("first.page") + 1).alias("pages"), "rows")
     .groupBy("part").applyInPandas(indexed, INDEX).write.parquet(f"{path}/index", compression="zstd"))


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


# -- minimal perfect hash ----------------------------------------------------------------------------------------------
def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % (1 << 64))
    return (flat.mix(keys.view(np.uint64) + seed) % np.uint64(bits)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key that the levels of the hash do not use."""
    return (flat.mix(flat.mix(keys.view(np.uint64)) ^ np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(keys: np.ndarray) -> tuple[list[bytes], list[int], np.ndarray]:
    """Bits and the number of set bits before them, level by level, and each key's slot; the keys are distinct."""
    slots = np.zeros(len(keys), np.int64)
    left = np.arange(len(keys))
    bits, ranks, done = [], [], 0
    while len(left):
        n = -(-BITS_PER_KEY * len(left) // 64) * 64
        spot = _spot(keys[left], len(bits), n)
        alone = np.bincount(spot, minlength=n) == 1
        rank = np.cumsum(alone) - alone
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        ranks.append(done)
        own = alone[spot]
        slots[left[own]] = done + rank[spot[own]]
        done += int(alone.sum())
        left = left[~own]
    return bits, ranks, slots


def probe(keys: np.ndarray, bits: list[bytes], ranks: list[int]) -> np.ndarray:
    """The slot of each key, or -1 where no level holds it."""
    slots = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    for level, (packed, done) in enumerate(zip(bits, ranks)):
        flags = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        spot = _spot(keys[left], level, len(flags))
        rank = np.cumsum(flags) - flags
        own = flags[spot]
        slots[left[own]] = done + rank[spot[own]]
        left = left[~own]
    return slots


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, row, pages, rows) of the distinct keys that the index holds; page counts over all shards."""
    index = _table(spark, path, "index", INDEX)
    parts = index.agg(F.max("parts")).first()[0] or 1
    asked = keys.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID)).alias("key")).distinct()
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))

    def probed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in ("key", *PLACE.names)})
        k, r = left["key"].to_numpy(np.int64), right.iloc[0]
        slots = probe(k, list(r["bits"]), list(r["ranks"]))
        prints, places = np.frombuffer(r["prints"], "<u4"), np.frombuffer(r["places"], PLACE)
        own = (slots >= 0) & (prints[np.maximum(slots, 0)] == fingerprint(k))
        found = places[slots[own]]
        return pd.DataFrame({"key": k[own], **{n: found[n] for n in PLACE.names}})

    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(probed, "key long, page long, row long, pages long, rows long")


def read(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every row of the keys in places, read from their pages.

    start counts the ids of all documents before, ids are 32-bit integers; the null key comes back as null.
    """
    pages = (_table(spark, path, "pages", PAGES).join(_table(spark, path, "shards", SHARDS), "shard")
             .select((F.col("first_page") + F.col("page")).alias("page"), "first_id", "width", "ids", "keys", "sizes", "shard", "n"))
    # ids of the shard before the page; a page has one row, without its ids
    before = Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select("shard", "page", "n", "first_id").select("page", (F.col("first_id") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    wanted = (places.select("key", F.explode(F.sequence(F.col("page"), F.col("page") + F.col("pages") - 1)).alias("page"))
              .groupBy("page").agg(F.array_sort(F.collect_list("key")).alias("wanted")))
    rows = pages.join(starts, "page").join(wanted, "page").select("start", "width", "ids", "keys", "sizes", "wanted")
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start, width, ids, keys, sizes, asked = (c[i] for c in b.columns)
                sizes, keys = sizes.values.to_numpy(), keys.values.to_numpy()
                ends = np.cumsum(sizes)
                rows = np.flatnonzero(np.isin(keys, asked.values.to_numpy()))
                raw = np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}")
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[rows], mask=keys[rows] == NULL_ID), pa.array(start.as_py() + ends[rows] - sizes[rows]), pa.array(sizes[rows]),
                    pa.array([raw[ends[r] - sizes[r] : ends[r]].astype("<u4").tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(documents, schema)


@register("op13_token_files")
def op13_token_files(spark, sf_dir):
    """Every document's place and checksum, read back from the files by its key through the index."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/llm-token-files-{uuid.uuid4().hex}"
    write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path, lookup(spark, path, docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
