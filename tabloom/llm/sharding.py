"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until they meet a tolerance.

Rows are ordered by (hash of the text, id), so equal texts are neighbours and a group of copies of any size
can still be cut between two ids.  Each round counts, in one aggregate over three narrow columns, the bytes
below 256 further boundaries inside the interval of every splitter that is not yet good enough.  The rows
then move once, by range, and slots come from positions inside the written partitions.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import stage

_LOWEST = -(2**63)
#: Bits of the key that a round resolves, and bits of the whole key (text hash, then id).
ROUND_BITS, KEY_BITS = 8, 128


@dataclass
class _Splitter:
    """The bytes wanted below a boundary, and the key prefix within which the boundary lies."""

    target: float
    prefix: int = 0
    below: int = 0
    boundary: int | None = None


def _prefix_is(high: Column, low: Column, bits: int, prefix: int) -> Column:
    """Whether the first ``bits`` bits of the key are ``prefix``."""
    if not bits:
        return F.lit(True)
    if bits <= 64:
        return F.shiftrightunsigned(high, 64 - bits) == _signed(prefix)
    rest = bits - 64
    return (high == _signed(prefix >> rest)) & (F.shiftrightunsigned(low, 64 - rest) == _signed(prefix & ((1 << rest) - 1)))


def _digit(high: Column, low: Column, bits: int) -> Column:
    """The ``ROUND_BITS`` bits of the key after the first ``bits``."""
    word, at = (high, bits) if bits < 64 else (low, bits - 64)
    return F.shiftrightunsigned(word, 64 - at - ROUND_BITS).bitwiseAND(F.lit((1 << ROUND_BITS) - 1))


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def splitters(narrow: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries (text hash, id) that cut ``narrow`` (``__h``, ``__d``, ``__size``) into ``shards`` parts of near equal bytes.

    A boundary is accepted when the bytes below it miss their target by at most ``tolerance`` of a shard, or
    when the key is exhausted.  The driver holds 256 sums per splitter.
    """
    # Flipping the sign bit turns the signed order into the order of the bits.
    high, low = F.col("__h").bitwiseXOR(F.lit(_LOWEST)), F.col("__d").bitwiseXOR(F.lit(_LOWEST))
    total = narrow.agg(F.sum("__size")).first()[0] or 0
    allowed = tolerance * total / shards
    wanted = [_Splitter(total * i / shards) for i in range(1, shards)]
    if not total:
        return []
    for bits in range(0, KEY_BITS, ROUND_BITS):
        still = [s for s in wanted if s.boundary is None]
        if not still:
            break
        prefixes = sorted({s.prefix for s in still})
        slot = F.lit(None).cast("int")
        for i, prefix in reversed(list(enumerate(prefixes))):
            slot = F.when(_prefix_is(high, low, bits, prefix), F.lit(i)).otherwise(slot)
        counted = (
            narrow.select(slot.alias("s"), _digit(high, low, bits).alias("d"), "__size")
            .where(F.col("s").isNotNull())
            .groupBy("s", "d")
            .agg(F.sum("__size").alias("n"))
            .collect()
        )
        sums = {(r["s"], r["d"]): r["n"] for r in counted}
        left = KEY_BITS - bits - ROUND_BITS
        for s in still:
            i, at = prefixes.index(s.prefix), s.below
            for digit in range(1 << ROUND_BITS):
                after = at + sums.get((i, digit), 0)
                if after >= s.target or digit == (1 << ROUND_BITS) - 1:
                    break
                at = after
            extended = (s.prefix << ROUND_BITS) | digit
            near = after if after - s.target < s.target - at else at
            if abs(near - s.target) <= allowed or not left:
                s.boundary = (extended + (near == after and after != at)) << left
            s.prefix, s.below = extended, at
    found = [min(s.boundary, 2**KEY_BITS - 1) for s in wanted]
    return [(_signed((b >> 64) ^ 2**63), _signed((b & (2**64 - 1)) ^ 2**63)) for b in found]


def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1, near equal bytes) and ``slot`` (gapless from 0 within the shard).

    A row counts the UTF-8 bytes of its text (null: none) plus 1.  Rows are ordered by text hash, then id;
    a null text has a hash of its own and a null id comes first.  Rows equal in both stay together.  No rows
    give no rows.  Columns named ``shard`` or ``slot`` in ``docs`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    keyed = docs.withColumns(
        {
            "__h": F.xxhash64(F.col(text)),
            "__d": F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)),
            "__size": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1,
        }
    )
    cuts = splitters(stage(keyed.select("__h", "__d", "__size"), "shard-keys"), shards, tolerance)
    place = F.lit(0)
    for h, d in cuts:
        place = place + ((F.col("__h") > h) | ((F.col("__h") == h) & (F.col("__d") >= d))).cast("int")
    order = ("shard", "__h", "__d")
    moved = stage(
        keyed.withColumn("shard", place)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}),
        "shards",
    )
    earlier = W.partitionBy("shard").orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    # One row per written partition and shard that meet: at most as many as partitions and shards together.
    starts = (
        moved.groupBy("__pid", "shard")
        .agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .select("__pid", "shard", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    )
    slotted = moved.join(F.broadcast(starts), ["__pid", "shard"])
    return slotted.select(*docs.columns, "shard", (F.col("__at") - F.col("__first") + F.col("__off")).alias("slot"))
