"""Helpers shared by the operators: bounded joins, running totals, and texts as byte arrays."""
from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..staging import stage

#: Size up to which the small side of a join is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that one block of array work holds (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20
#: Learners never see rows of this remainder.
HELD_OUT_OF = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0 (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_OF == 0


def attach(rows: DataFrame, staged: DataFrame, on: str | list[str], how: str, row_bytes: int, more: int = 0) -> DataFrame:
    """Join ``staged`` to ``rows``; it is broadcast if its rows, counted from file footers, are small enough.

    ``row_bytes`` is the size of a row without what varies, ``more`` the size of all that varies.  Beyond
    ``BROADCAST_BYTES`` both sides are shuffled on the key instead.
    """
    small = staged.count() * row_bytes + more <= BROADCAST_BYTES
    return rows.join(F.broadcast(staged) if small else staged, on, how)


_SHARES = 1 << 31


def sample_ids(rows: DataFrame, group: Column, key: str, most: int, seed: int) -> DataFrame:
    """Staged ids of at most ``most`` rows of each group, by a hash of the id, with the group as ``__label``.

    A group is thinned by its count first, so that about twice ``most`` of its rows are shuffled and ranked.
    """
    found = rows.select(key, group.alias("__g")).where(F.col("__g").isNotNull() & F.col(key).isNotNull())
    sizes = found.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(_SHARES))
    # One row per label.
    thin = found.join(F.broadcast(sizes), "__g").withColumn("__o", share).where(F.col("__o") * F.col("__n") <= F.lit(2.0 * most * _SHARES))
    rank = F.row_number().over(W.partitionBy("__g").orderBy("__o", key))
    return stage(thin.withColumn("__r", rank).where(F.col("__r") <= most).select(key, F.col("__g").alias("__label")), "sample")


def first_ids(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """Staged ids (``k``) of at most ``most`` rows, the first by a hash of the id.

    A count of one row in 64 tells how far to thin the rows, so that a few times ``most`` of them are sorted.
    """
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(_SHARES))
    usable = rows.where(F.col(key).isNotNull())
    rough = 64 * usable.where(share % 64 == 0).count()
    if rough > 8 * most:
        usable = usable.where(share < int(_SHARES * 4 * most / rough))
    return stage(usable.select(F.col(key).alias("k"), share.alias("o")).distinct().orderBy("o", "k").limit(most).select("k"), "sample")


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], bytes]) -> bytes | None:
    """What ``fit`` makes of a bounded sample, in one task; only the model reaches the driver.

    The sample is gathered by a shuffle, so that the scan it comes from stays parallel.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [p for p in parts if len(p)]
        if rows:
            yield pd.DataFrame({"model": [fit(pd.concat(rows, ignore_index=True))]})

    found = sample.repartition(1).sortWithinPartitions(*sample.columns).mapInPandas(run, "model binary").collect()
    return bytes(found[0][0]) if found else None


def running_total(rows: DataFrame, group: str | None, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before, within ``group`` (or overall), in the order given.

    ``order`` must begin with ``group`` and be a total order.  Rows are range-partitioned once, so that a
    group of any size spreads over many tasks; each task sums its run, and a table with one row per task
    and group supplies what came before.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField(out, T.LongType())])
    names = [*rows.columns, "__pid"]
    arranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = None
        carry, begun = 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            starts = np.zeros(len(v), bool)
            if group is not None:
                g = batch.column(group)
                codes = g.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts[1:] = codes[1:] != codes[:-1]
                starts[0] = not begun or g[0].as_py() != last
                last = g[-1].as_py()
            else:
                starts[0] = not begun
            begun = True
            first = np.maximum.accumulate(np.where(starts, np.arange(len(v)), -1))
            total = np.where(first >= 0, before - before[np.maximum(first, 0)], before + carry)
            carry = int(total[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(total)], names=[*names, out])

    local = stage(arranged.mapInArrow(sums, schema), "running")
    by = ["__pid"] if group is None else ["__pid", group]
    labels = [F.col("__pid").alias("__p")] if group is None else [F.col("__pid").alias("__p"), F.col(group).alias("__g")]
    earlier = W.orderBy("__pid") if group is None else W.partitionBy(group).orderBy("__pid")
    # One row per task and group that meet: as many as there are tasks and groups together, at most.
    offsets = (
        local.groupBy(*by)
        .agg(F.sum(value).alias("__all"))
        .select(*labels, F.coalesce(F.sum("__all").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    )
    on = F.col("__pid") == F.col("__p")
    if group is not None:
        on = on & F.col(group).eqNullSafe(F.col("__g"))
    return local.join(F.broadcast(offsets), on).select(*rows.columns, (F.col(out) + F.col("__off")).alias(out))


# ---- texts as arrays ----------------------------------------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF95)
_table = np.random.RandomState(11).randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 2**64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Block:
    """Some texts of a batch, end to end: UTF-8 bytes, and where each begins and ends."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray

    def owner(self) -> np.ndarray:
        """Which text a byte belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, most: int | None = None) -> Iterator[Block]:
    """The texts of a column in runs of at most ``limit`` bytes and ``most`` rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.fill_null("").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, first + (most or n), n)
        yield Block(slice(first, last), data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def words(block: Block, lower: bool = True, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, owner and 64-bit hash of every word; ``inside`` marks the byte values of words (default: no white space)."""
    data = LOWER[block.data] if lower else block.data
    n = len(data)
    within = np.zeros(n + 2, bool)
    within[1:-1] = (~SPACE if inside is None else inside)[data]
    here = within[1:-1]
    edge = np.zeros(n + 1, bool)
    edge[block.bounds] = True
    begins = np.flatnonzero(here & (~within[:-2] | edge[:-1]))
    ends = np.flatnonzero(here & (~within[2:] | edge[1:])) + 1
    owner = np.repeat(np.arange(len(block.bounds) - 1), np.diff(np.searchsorted(begins, block.bounds)))
    return begins, ends, owner, spans_hash(data, begins, ends)


_PIECES = 8
_low = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def spans_hash(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time, or for the very long from one running polynomial sum."""
    size = ends - begins
    out = size.astype(np.uint64) * _MIX
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    longest = min(int(size.max()), 8 * _PIECES)
    at, start, left = None, begins, size
    for i in range(-(-longest // 8)):
        if i:
            more = np.flatnonzero(left > 8)
            at = more if at is None else at[more]
            start, left = start[more] + 8, left[more] - 8
        piece = eight[start] & _low[np.minimum(left, 8)]
        if at is None:
            out = mix(out ^ piece * _ODD)
        else:
            out[at] = mix(out[at] ^ piece * _ODD)
    long = np.flatnonzero(size > 8 * _PIECES)
    if len(long):
        up, down = _power(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_table[data] * up[: len(data)], out=total[1:])
        out[long] = mix((total[ends[long]] - total[begins[long]]) * down[begins[long]] + size[long].astype(np.uint64) * _MIX)
    return out


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all byte strings of ``size``, a multiple of 8, by start."""
    n = max(0, len(data) - size + 1)
    out = np.full(n, size, np.uint64)
    if n:
        eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
        for at in range(0, size, 8):
            out = mix(out * _MIX ^ eight[at : at + n] * _ODD)
    return out


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one binary value."""
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        return {k: arrays[k] for k in arrays.files}
