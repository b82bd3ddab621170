"""Exact Jaccard self-join of word n-gram sets with parity sketches.

The n-grams of a document are dealt by hash into blocks and XORed there.  Two sets that differ in d n-grams
differ in at most d blocks, so the number of blocks that differ is a lower bound of the symmetric difference.
The similarity bounds d by the sizes: with more than d blocks filled, a linked pair has an equal filled block,
and documents meet in a join on the blocks.  Sizes are banded, so that a document needs blocks for its own band
and, near its end, the next.

A document with more than d blocks that no other has is done.  The others keep their d + 1 rarest blocks: of
the blocks that a linked pair shares, the rarest is among those of both.  First every document is verified
against two leaders it shares most blocks with, which joins groups of near copies without all their pairs.
Then only pairs of different components are left, and a pair passes the join only if the Hamming distance of
the documents' parity bits, again at most d, allows it; those are verified on their n-gram sets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import stage
from .common import Block, attach, blocks, mix, words
from .components import components

#: Words of parity bits that candidates are compared by.
PARITY = 8
#: Blocks are this much more than the differences they must outnumber.
SLACK = 1.1
_STEP = np.uint64(0xA24BAED4963EE407)


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct word n-grams of a block's texts, sorted; fewer words than ``size`` count as one n-gram."""
    n_texts = len(block.bounds) - 1
    _, _, owner, word = words(block)
    count = np.bincount(owner, minlength=n_texts)
    m = max(0, len(word) - size + 1)
    whole = word[:m].copy()
    for j in range(1, size):
        whole = mix(whole * _STEP + word[j : j + m], j)
    inside = owner[:m] == owner[size - 1 :][:m]
    owners, hashes = owner[:m][inside], whole[inside]
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        value = word[first[short]].copy()
        for j in range(1, size):
            more = count[short] > j
            value[more] = mix(value[more] * _STEP + word[first[short[more]] + j], j)
        owners, hashes = np.concatenate([owners, short]), np.concatenate([hashes, mix(value, 77 + size)])
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
    return owners[new], hashes[new]


class Bounds:
    """What a similarity of ``percent`` allows: sizes, differences, and the number of blocks of a band."""

    def __init__(self, percent: int):
        self.percent = percent

    def largest(self, n: np.ndarray) -> np.ndarray:
        return 100 * n // self.percent

    def differences(self, n: np.ndarray) -> np.ndarray:
        """The most n-grams in which a set of ``n`` can differ from a partner."""
        return (100 - self.percent) * (n + self.largest(n)) // (100 + self.percent)

    def band(self, n: np.ndarray) -> np.ndarray:
        """Two to this power is the number of blocks."""
        wanted = SLACK * (self.differences(n) + 1) + 1
        return np.ceil(np.log2(wanted)).astype(np.int64)


def _slots(owner: np.ndarray, value: np.ndarray, there: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number (text by text) and hash of the n-grams of the texts marked in ``there``, sorted by block."""
    use = there[owner]
    hashed = value[use]
    slot = owner[use] * (1 << band) + (mix(hashed, 9) & np.uint64((1 << band) - 1)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    return slot[order], hashed[order]


def _sizes(docs: DataFrame, size: int, bounds: Bounds) -> DataFrame:
    """Per row: doc_id, number of n-grams, a 128-bit hash of the set, differences allowed, its bands with their filled blocks, parity bits."""
    names = ["doc_id", "n", "a", "b", "allowed", "own", "own_filled", "far", "far_filled"]
    width = 64 * PARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, *more = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64, *[np.int64] * 5))
            parity = np.zeros((batch.num_rows, PARITY), np.int64)
            for block in blocks(batch.column(1)):
                owner, value = shingle_sets(block, size)
                count = np.bincount(owner, minlength=len(block.bounds) - 1)
                n[block.rows] = count
                if len(owner):
                    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    a[block.rows.start + owner[at]] = np.add.reduceat(mix(value, 5), at)
                    b[block.rows.start + owner[at]] = np.add.reduceat(mix(value, 6), at)
                bits = np.bincount(owner * width + (mix(value, 12) & np.uint64(width - 1)).astype(np.int64), minlength=len(count) * width)
                parity[block.rows] = np.packbits((bits & 1).astype(np.uint8).reshape(len(count), width), axis=1).view(np.int64)
                bands = bounds.band(count), bounds.band(bounds.largest(count))
                more[0][block.rows] = bounds.differences(count)
                for band, to, filled in zip(bands, more[1::2], more[2::2]):
                    to[block.rows] = band
                    for one in np.unique(band):
                        slot, _ = _slots(owner, value, band == one, int(one))
                        slot = slot[np.concatenate(([True], slot[1:] != slot[:-1]))[: len(slot)]]
                        filled[block.rows] += np.bincount(slot >> int(one), minlength=len(count))
            columns = [batch.column(0), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *map(pa.array, more)]
            columns += [pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names += [f"p{i}" for i in range(PARITY)]
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _sketches(docs: DataFrame, size: int, bounds: Bounds) -> DataFrame:
    """Per filled block of a document: ``key`` (band in the low five bits) and doc_id.

    A document whose filled blocks may not outnumber its differences also shows its empty blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                owner, value = shingle_sets(block, size)
                n = np.bincount(owner, minlength=len(block.bounds) - 1)
                allowed = bounds.differences(n)
                own, far = bounds.band(n), bounds.band(bounds.largest(n))
                for band in np.unique(np.concatenate([own, far])):
                    there = (allowed > 0) & ((own == band) | (far == band))
                    slot, hashed = _slots(owner, value, there, int(band))
                    if not len(slot):
                        continue
                    count = 1 << int(band)
                    at = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
                    parity = np.bitwise_xor.reduceat(mix(hashed, 10), at)
                    slot = slot[at]
                    filled = np.bincount(slot // count, minlength=len(n))
                    for i in np.flatnonzero(there & (filled <= allowed)):
                        empty = np.setdiff1d(i * count + np.arange(count), slot)
                        slot, parity = np.concatenate([slot, empty]), np.concatenate([parity, np.zeros(len(empty), np.uint64)])
                    key = mix(parity * _STEP + (slot % count).astype(np.uint64), int(band))
                    key = (key & ~np.uint64(31)) | np.uint64(band)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(ids[block.rows][slot // count])], names=["key", "doc_id"]
                    )

    return docs.mapInArrow(run, "key long, doc_id long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted (key, doc_id) whose key another document has too; repeated rows once."""
    key, doc, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def out(k: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(d)], names=["key", "doc_id"])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        doc = np.concatenate([doc, batch.column(1).to_numpy()])
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))[: len(key)]
        key, doc = key[new], doc[new]
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        keep = np.concatenate(([met], same)) | np.concatenate((same, [False]))
        yield out(key[:-1][keep[:-1]], doc[:-1][keep[:-1]])
        met = bool(keep[-1])
        key, doc = key[-1:], doc[-1:]
    if met:
        yield out(key, doc)


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose n-gram sets are as similar as asked."""
    wanted = stage(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "verify-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                owner, value = shingle_sets(block, size)
                at = np.searchsorted(owner, np.arange(len(block.bounds)))
                sets = [value[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.rows.start, len(sets)), pa.array(sets, pa.binary())], names=["doc_id", "items"]
                )

    sets = stage(attach(docs, wanted, "doc_id", "inner", 16).select("doc_id", "text").mapInArrow(run, "doc_id long, items binary"), "verify-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"])

    one = sets.select(F.col("doc_id").alias("u"), F.col("items").alias("x"))
    two = sets.select(F.col("doc_id").alias("v"), F.col("items").alias("y"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y").mapInArrow(compare, "u long, v long").distinct()


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` (set size) and ``component_id``.

    Words are runs without white space, A-Z in lower case; a set holds the distinct ``size``-word n-grams, or the
    whole sequence if there are fewer words.  Two documents link when 100 * intersection >= ``percent`` * union;
    ``component_id`` is the smallest id reachable by links.  A null or wordless text has an empty set and links
    with nothing, a null id takes no part (null component).  Rows that repeat an id are one document: whatever
    links with one of its texts links with all.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bounds = Bounds(percent)
    rows = stage(_sizes(docs, size, bounds), "shingle-sizes")

    # Documents of one set are one node, named by the smallest id.
    some = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    names = some.groupBy("a", "b", "n").agg(F.min("doc_id").alias("node"))
    named = stage(some.join(names, ["a", "b", "n"]).drop("a", "b"), "shingle-nodes")
    same_id = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.max(F.expr("doc_id = node")).alias("first"))
    copies = stage(same_id.where(~F.col("first")).select("doc_id"), "shingle-copies")
    texts = attach(docs.where(F.col("doc_id").isNotNull()), copies, "doc_id", "left_anti", 16)
    met = (
        _sketches(texts, size, bounds)
        .repartition("key")
        .sortWithinPartitions("key", "doc_id")
        .mapInArrow(_shared, "key long, doc_id long")
    )
    met = stage(met.withColumn("band", F.col("key").bitwiseAND(F.lit(31))), "shared-blocks")

    # How many blocks a document fills in a band, and how many of them it shares.  A document that shows its
    # empty blocks too, or an id with several texts, keeps all its blocks.
    parity = [f"p{i}" for i in range(PARITY)]
    bands = F.array(*[F.struct(F.col(c).cast("long").alias("band"), F.col(f"{c}_filled").alias("filled")) for c in ("own", "far")])
    banded = named.select("doc_id", "n", "allowed", *parity, F.inline(bands)).distinct()
    about = banded.groupBy("doc_id", "band").agg(
        F.max("n").alias("n"),
        F.max("allowed").alias("allowed"),
        F.max("filled").alias("filled"),
        ((F.count(F.lit(1)) > 1) | (F.max("filled") <= F.max("allowed"))).alias("all"),
        # Without one set, no parity says anything.
        *[F.when(F.count(F.lit(1)) == 1, F.max(c)).alias(c) for c in parity],
    )
    sizes = stage(met.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "block-sizes")
    mine = W.partitionBy("doc_id", "band")
    ranked = (
        met.join(sizes, "key")
        .withColumns({"shared": F.count(F.lit(1)).over(mine), "r": F.row_number().over(mine.orderBy("c", "key"))})
        .join(about, ["doc_id", "band"])
    )
    blocks_of = ranked.where(F.col("all") | (F.col("r") + F.greatest(F.col("filled") - F.col("shared"), F.lit(0)) <= F.col("allowed") + 1))
    kept = stage(blocks_of.select("key", "doc_id", "n", *parity, "shared"), "blocks")

    # Each document with two leaders of its blocks: the smallest id, and the one that shares most blocks at all.
    leaders = kept.groupBy("key").agg(F.min("doc_id").alias("least"), F.max(F.struct("shared", (-F.col("doc_id")).alias("i"))).alias("top"))
    led = kept.select("key", "doc_id").join(leaders.select("key", "least", (-F.col("top.i")).alias("top")), "key")
    star = led.select("doc_id", F.col("least").alias("v"), F.lit(0).alias("kind")).union(led.select("doc_id", "top", F.lit(1)))
    star = star.where("doc_id <> v").groupBy("doc_id", "kind", "v").agg(F.count(F.lit(1)).alias("c"))
    star = star.groupBy("doc_id", "kind").agg(F.max(F.struct("c", (-F.col("v")).alias("i"))).alias("m"))
    star = stage(star.select(F.col("doc_id").alias("u"), (-F.col("m.i")).alias("v")).distinct(), "star")
    links = stage(_verified(docs, star, size, percent), "links").union(same_id.where("u <> v").select("u", "v"))
    grouped = components(links)

    # Pairs of different components that share blocks, as far as their parity bits allow.
    labelled = kept.drop("shared").join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = stage(labelled.withColumn("component", F.coalesce("component", "doc_id")), "blocks-labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left = stage(labelled.join(mixed, "key"), "blocks-mixed")
    x, y = (left.select("key", *[F.col(c).alias(f"{c}_{s}") for c in left.columns if c != "key"]) for s in "uv")
    apart = sum((F.coalesce(F.bit_count(F.col(f"{p}_u").bitwiseXOR(F.col(f"{p}_v"))), F.lit(0)) for p in parity), F.lit(0))
    near = F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("n_u") + F.col("n_v"))
    fits = (F.lit(percent) * F.col("n_u") <= 100 * F.col("n_v")) & (F.lit(percent) * F.col("n_v") <= 100 * F.col("n_u"))
    meet = (x["key"] == y["key"]) & (F.col("doc_id_u") < F.col("doc_id_v")) & (F.col("component_u") != F.col("component_v"))
    pairs = x.join(y, meet & (fits | F.col("p0_u").isNull() | F.col("p0_v").isNull()) & near)
    pairs = pairs.select(F.col("doc_id_u").alias("u"), F.col("doc_id_v").alias("v")).distinct()
    links = links.union(_verified(docs, stage(pairs, "candidates"), size, percent))
    final = components(links.union(grouped.select("node", "component")))

    node = named.groupBy("doc_id").agg(F.min("node").alias("node"))
    place = node.join(final, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    return rows.join(place, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
