"""MinHash near-duplicate groups with odd sketches.

Every document's MinHash samples are cut into bands and, folded by parity, make an odd sketch: a bitmap whose XOR with
another one has a population count that gives the similarity of the two sets, precisely so where it is high.

1. Documents with equal shingle sets are one node.
2. Nodes that share a band meet in a bucket.  Each node is compared with the first node of each of its buckets; the
   closest by sketch is confirmed on full sets.  This joins nearly all of a group by one comparison a node.
3. Where a bucket still holds several components, each node outside the first node's component is compared by sketch
   with all others of the bucket, block by block, so a large bucket is spread over tasks.  First only the closest node of
   another component is confirmed, which joins what belongs together by one comparison a node.
4. Where a bucket holds several components even then, the nodes that have a node of another component near the
   threshold by sketch meet once more, now with their whole sets: all such pairs are confirmed inside the task, unless
   confirmed links already join the two, and only links that join components are rows.
5. The confirmed links make the components.

A pair at the threshold shares none of the bands with a probability of (1 - 0.75 ** 4) ** 32 = 5e-6, and a link's sketch
is five standard errors from being passed over.  Confirmation compares whole sets.

Defined results: null and empty texts have no shingles and no links; a text of fewer words than a shingle is one
shingle; rows equal in id and text are one document, whose result each of them gets; null ids stay null and count as
the smallest; extra columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirsearch.llm import flat, workers
from dirsearch.llm.components import components
from dirsearch.llm.registry import register, table
from dirsearch.llm.store import KEY_HASH, KEY_ID, NULL_ID, keyed, written

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = 256  # MinHash samples; the first BANDS * ROWS make the bands, all make the sketch
SKETCH_BITS = 2048
BLOCK = 1024
LEAST_ESTIMATE = 0.62

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def most_bits(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """Expected population count of the XOR of two odd sketches of sets of this similarity."""
    return int(np.ceil(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity)))))


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, in row order."""
    buf = flat.lower(buf)
    s, e, row = flat.words(buf, offs)
    h = flat.span_hash(buf, s, e)
    at, g = flat.grams(h, row, WORDS)
    bounds = flat.row_bounds(row, len(offs) - 1)
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < WORDS))
    whole = np.zeros(len(few), np.uint64)
    for i, r in enumerate(few):
        whole[i] = flat.span_hash(h, bounds[r : r + 1], bounds[r + 1 : r + 2])[0]
    return flat.distinct_per_row(np.concatenate([g, whole]), np.concatenate([row[at], few]))


def features(buf: np.ndarray, offs: np.ndarray) -> dict[str, list | np.ndarray]:
    n = len(offs) - 1
    h, row = shingles(buf, offs)
    bounds = flat.row_bounds(row, n)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    bands = np.zeros((n, BANDS), np.uint64)
    bitmap = np.zeros((n, SKETCH_BITS), np.uint8)
    node = np.zeros((n, 2), np.uint64)
    if len(full):
        first = bounds[full]
        node[full, 0] = np.add.reduceat(flat.mix(h), first)
        node[full, 1] = np.add.reduceat(flat.mix(h ^ np.uint64(0x5DEECE66D1234567)), first)
        for j in range(SAMPLES):
            least = np.minimum.reduceat(h * _MUL[j] + _ADD[j], first)
            np.add.at(bitmap, (full, (flat.mix(least ^ np.uint64(j)) % np.uint64(SKETCH_BITS)).astype(np.int64)), 1)
            if (b := j // ROWS) < BANDS:
                bands[full, b] = flat.mix(bands[full, b] * np.uint64(31) + least + np.uint64(b + 1))
    sketch = np.packbits(bitmap & 1, axis=1).view(np.uint64)
    return {"n": size, "node": node, "bands": bands, "sketch": sketch}


def _array(rows: np.ndarray) -> pa.Array:
    """A 2-D uint64 array as a list column of int64."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(flat.signed(rows.reshape(-1))))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Key, set size, node (hash of the set), bands and odd sketch of each document; no text."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(KEY_ID, T.LongType()), T.StructField(KEY_HASH, T.LongType()), T.StructField("n_shingles", T.LongType()),
                           T.StructField("node", T.BinaryType()), T.StructField("bands", longs), T.StructField("sketch", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for b in batches:
            for lo, hi, buf, offs in flat.chunks(b.column(2)):
                f = features(buf, offs)
                raw = f["node"].tobytes()
                node = pa.array([raw[16 * i : 16 * i + 16] for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(f["n"].astype(np.int64)),
                                                  node, _array(f["bands"]), _array(f["sketch"])], names=schema.names)

    return keyed(docs, text).select(KEY_ID, KEY_HASH, F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def with_sets(texts: DataFrame) -> DataFrame:
    """(nid, text) to (nid, shingles)."""
    schema = T.StructType([T.StructField("nid", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for b in batches:
            for lo, hi, buf, offs in flat.chunks(b.column(1)):
                h, row = shingles(buf, offs)
                sets = pa.ListArray.from_arrays(pa.array(flat.row_bounds(row, hi - lo), pa.int32()), pa.array(flat.signed(h)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), sets], names=schema.names)

    return texts.select("nid", "text").mapInArrow(run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    one = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                                                      F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.where(f"100 * n >= {PERCENT} * (na + nb - n)").select("a", "b")


GROUP = ["band", "block", "side"]


def _grouped(work):
    """mapInPandas function over rows sorted by GROUP: work on each group; a group may go on over batches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workers.release()
        rest = None

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            found = [r for _, g in rows.groupby(GROUP, sort=False) if len(g) > 1 and len(r := work(g))]
            if found:
                yield pd.concat(found, ignore_index=True)

        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if len(f):
                last = (f[GROUP] == f[GROUP].iloc[-1]).all(axis=1)
                rest = f[last]
                yield from done(f[~last])
        if rest is not None:
            yield from done(rest)

    return run


def _distances(rows: pd.DataFrame, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(minor rows, own rows, differing bits) of a group, some minor rows at a time; over limit within a component."""
    comp, sketch = rows["comp"].to_numpy(), np.stack(rows["sketch"].to_numpy()).view(np.uint64)
    left, right = np.flatnonzero(rows["minor"].to_numpy()), np.flatnonzero(rows["own"].to_numpy())
    for lo in range(0, len(left) if len(right) else 0, 256):
        x = left[lo : lo + 256]
        bits = np.zeros((len(x), len(right)), np.int32)
        for k in range(sketch.shape[1]):
            bits += np.bitwise_count(sketch[x, k][:, None] ^ sketch[right, k][None, :])
        bits[comp[x][:, None] == comp[right][None, :]] = limit + 1
        yield x, right, bits


def _closest(limit: int):
    """For each minor row of a group its closest row of another component: (a, b, bits)."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        nid, out = rows["nid"].to_numpy(), [np.zeros((3, 0), np.int64)]
        for x, right, bits in _distances(rows, limit):
            j = bits.argmin(axis=1)
            i = np.flatnonzero(bits[np.arange(len(x)), j] <= limit)
            out.append(np.stack([nid[x[i]], nid[right[j[i]]], bits[i, j[i]]]))
        a, b, bits = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": a, "b": b, "bits": bits})

    return work


def _near(limit: int):
    """The rows of a group that have a near row of another component."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(rows), bool)
        for x, right, bits in _distances(rows, limit):
            near = bits <= limit
            keep[x[near.any(axis=1)]] = keep[right[near.any(axis=0)]] = True
        return rows[keep]

    return work


def _confirmed(limit: int):
    """Links (a, b) of a group, confirmed on whole sets, that join components which links of the group do not yet join."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        nid, root = rows["nid"].to_numpy(), {c: c for c in rows["comp"]}
        comp, sets = rows["comp"].tolist(), [np.sort(s) for s in rows["shingles"]]
        size, links = np.array([len(s) for s in sets]), []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for x, right, bits in _distances(rows, limit):
            for i, row in zip(x, bits):
                own = find(comp[i])
                others = [j for j in right[row <= limit] if find(comp[j]) != own]
                if not others:
                    continue
                values = np.concatenate([sets[j] for j in others])
                at = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
                n = np.add.reduceat(sets[i][at] == values, np.cumsum([0, *size[others[:-1]]]), dtype=np.int64)
                for j in np.asarray(others)[100 * n >= PERCENT * (size[i] + size[others] - n)]:
                    if find(comp[i]) != find(comp[j]):
                        root[find(comp[j])] = find(comp[i])
                        links.append((nid[i], nid[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return work


def open_groups(members: DataFrame, comp: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, dealt into groups of about two BLOCKs of nodes at most.

    A minor node is one outside the first node's component.  Nodes are dealt to blocks, minor nodes also to sides; each
    block meets each side, so every pair of a minor node and another one is in one group.  A row says as what its node
    stands in the group: as one of the block (own), as one of the side (minor), or both.
    """
    placed = (members.join(comp.select(F.col("node").alias("nid"), F.col("root").alias("comp")), "nid", "left")
              .withColumn("comp", F.coalesce("comp", "nid")))
    open_ = (placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                        F.max(F.when(F.col("nid") == F.col("leader"), F.col("comp"))).alias("main"))
             .where("lo < hi").select("band", "main"))
    live = (placed.join(open_, "band").withColumn("outside", F.col("comp") != F.col("main"))
            .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
            .withColumn("home", F.expr("pmod(xxhash64(nid), blocks)")).withColumn("away", F.expr("pmod(xxhash64(nid, 1), blocks)")))
    cells = F.expr("""concat(
        transform(sequence(0L, blocks - 1L), k -> struct(home as block, k as side, true as own, outside and k = away as minor)),
        if(outside, transform(filter(sequence(0L, blocks - 1L), k -> k <> home),
                              k -> struct(k as block, away as side, false as own, true as minor)), array()))""")
    return (live.withColumn("cell", F.explode(cells)).join(sketches, "nid")
            .select("band", "cell.block", "cell.side", "nid", "comp", "cell.minor", "cell.own", "sketch"))


def _in_order(groups: DataFrame) -> DataFrame:
    return groups.repartition(*GROUP).sortWithinPartitions(*GROUP)


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each document: its key, n_shingles, component_id (least id reachable) and keeper (the component's one row)."""
    feats = written(with_features(docs, text), "near-features")
    nodes = (feats.where("n_shingles > 0").groupBy("node")
             .agg(F.min(KEY_ID).alias("id"), F.min_by(KEY_HASH, KEY_ID).alias("hash"), F.first("bands").alias("bands"),
                  F.first("sketch").alias("sketch")))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("nid"), "*"), "near-nodes")
    sketches = nodes.select("nid", "sketch")
    banded = nodes.select("nid", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("nid").alias("leader")).where("n > 1")
    members = written(banded.join(buckets, "band"), "near-buckets")

    keys = members.select("nid").distinct().join(nodes.select("nid", "id", "hash"), "nid")
    texts = (keyed(docs, text).select(KEY_ID, KEY_HASH, F.col(f"`{text}`").alias("text"))
             .join(keys.select("nid", F.col("id").alias(KEY_ID), F.col("hash").alias(KEY_HASH)), [KEY_ID, KEY_HASH]))
    sets = written(with_sets(texts).dropDuplicates(["nid"]), "near-sets")

    # first links: each node and the closest of its buckets' first nodes
    limit = most_bits(LEAST_ESTIMATE)
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    stars = members.where("nid <> leader").select(F.col("nid").alias("a"), F.col("leader").alias("b")).distinct()
    ranked = (stars.join(sketches.select(F.col("nid").alias("a"), F.col("sketch").alias("sa")), "a")
              .join(sketches.select(F.col("nid").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", differ.alias("bits")))
    best = ranked.where(F.col("bits") <= limit).groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    first = written(confirmed(best, sets), "near-links")
    comp = components(first, "a", "b")

    # what is left: buckets that still hold several components
    again = (_in_order(open_groups(members, comp, sketches)).mapInPandas(_grouped(_closest(limit)), "a long, b long, bits long")
             .groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
    roots = lambda: comp.select(F.col("node").alias("a"), F.col("root").alias("b"))
    comp = components(roots().unionAll(confirmed(again, sets)), "a", "b")
    groups = open_groups(members, comp, sketches)
    near = written(_in_order(groups).mapInPandas(_grouped(_near(limit)), groups.schema), "near-groups")
    last = _in_order(near.join(sets, "nid")).mapInPandas(_grouped(_confirmed(limit)), "a long, b long")
    links = components(roots().unionAll(last), "a", "b")

    whole = (nodes.select("nid", "node", "id", "hash").join(links.select(F.col("node").alias("nid"), "root"), "nid", "left")
             .withColumn("root", F.coalesce("root", "nid")))
    least = whole.groupBy("root").agg(F.min("id").alias("component"), F.min_by("hash", "id").alias("keeper"))
    return (feats.select(KEY_ID, KEY_HASH, "n_shingles", "node")
            .join(whole.select("node", "root").join(least, "root").drop("root"), "node", "left")
            .select(KEY_ID, KEY_HASH, "n_shingles", F.coalesce("component", KEY_ID).alias("component"), F.coalesce("keeper", KEY_HASH).alias("keeper")))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without the near copies: of each component the row with the least id stays."""
    found = near_duplicates(docs, text)
    stay = (found.where((F.col(KEY_ID) == F.col("component")) & (F.col(KEY_HASH) == F.col("keeper")))
            .select(F.col(KEY_ID).alias("_s_id"), F.col(KEY_HASH).alias("_s_hash")).distinct())
    kept = keyed(docs, text).join(stay, (F.col(KEY_ID) == F.col("_s_id")) & (F.col(KEY_HASH) == F.col("_s_hash")), "left_semi")
    return kept.dropDuplicates([KEY_ID, KEY_HASH]).select(*[f"`{c}`" for c in docs.columns])


@register("op8_near_dedup")
def op8_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(real(KEY_ID).alias("doc_id"), "n_shingles", real("component").alias("component_id"),
                        (F.col(KEY_ID) == F.col("component")).alias("kept"))
