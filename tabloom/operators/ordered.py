"""Global window functions without a single-partition window.

A window with no PARTITION BY sends every row to one task.  Here the rows are range-partitioned by the whole
sort key instead, sorted, and written once with the partition's number as their bucket and their place in it:

1. The tie-breaker is part of the key, so one value that holds a third of all rows spans many buckets.  A scan
   without one breaks ties by a hash of the row.
2. A map-side-combined aggregate over the narrow columns yields one summary row per bucket; prefix sums over
   that table, which has a row per partition, are the offsets.
3. Places are offsets plus the place in the bucket; other functions are windows within the bucket.

Peer functions (rank, RANGE sums, average rank) stay exact: only the first and the last key of a bucket can span
buckets, and the summary carries the counts needed to stitch those keys.
"""
from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.cells import col
from ..staging import stage

_B, _AT = "__bucket", "__place"


@dataclass(frozen=True)
class Key:
    """One sort column; NULLs are last in both directions."""

    name: str
    desc: bool = False

    def order(self) -> Column:
        c = col(self.name)
        return c.desc_nulls_last() if self.desc else c.asc_nulls_last()


def asc(name: str) -> Key:
    return Key(name)


def desc(name: str) -> Key:
    return Key(name, True)


@dataclass(frozen=True)
class Out:
    """One output column: a function kind and its arguments."""

    kind: str
    column: str | None = None
    size: int = 0


def row_number() -> Out:
    return Out("row_number")


def rank() -> Out:
    return Out("rank")


def dense_rank() -> Out:
    return Out("dense_rank")


def percent_rank() -> Out:
    return Out("percent_rank")


def average_rank() -> Out:
    """Mean position of the peer group."""
    return Out("average_rank")


def row_count() -> Out:
    """Number of rows in the whole input."""
    return Out("row_count")


def ntile(tiles: int) -> Out:
    return Out("ntile", size=tiles)


def running_sum(column: str) -> Out:
    """ROWS UNBOUNDED PRECEDING."""
    return Out("running_sum", column)


def running_sum_peers(column: str) -> Out:
    """RANGE UNBOUNDED PRECEDING: peers share the total."""
    return Out("running_sum_peers", column)


def lag(column: str, offset: int = 1) -> Out:
    return Out("lag", column, offset)


def moving_avg(column: str, rows: int) -> Out:
    """Mean over the current and the ``rows - 1`` preceding rows."""
    return Out("moving_avg", column, rows)


def moving_sum(column: str, rows: int) -> Out:
    return Out("moving_sum", column, rows)


_NEIGHBOUR = {"lag", "moving_avg", "moving_sum"}
_PEER = {"rank", "dense_rank", "percent_rank", "average_rank", "running_sum_peers"}


def arrange(df: DataFrame, keys: Sequence[Key], buckets: int | None = None) -> DataFrame:
    """``df`` written in the order of ``keys``, with the number of each row's bucket and its place in it from 0.

    Spark samples the key to place the boundaries; their number follows ``buckets`` or the session's shuffle
    partitions, which adaptive execution lowers for small inputs.
    """
    order = [k.order() for k in keys]
    ranged = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stage(ranged.sortWithinPartitions(*order).withColumns({_B: F.spark_partition_id(), _AT: place}), "ordered")


def _row_hash(df: DataFrame) -> Column:
    """A tie-breaker that depends on the row alone."""
    return F.xxhash64(*[col(f.name) for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def scan(
    df: DataFrame,
    order: Sequence[Key],
    outputs: dict[str, Out],
    *,
    tie: Sequence[Key] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Add global window columns to ``df``.

    ``order`` defines peers; ``tie`` makes the order total (needed for a reproducible ROW_NUMBER, running sum, lag
    or moving window when peers exist).  Without it a hash of the row breaks ties.  ``df`` is read twice: for the
    sample and for the write.
    """
    names = list(df.columns)
    if not tie:
        df = df.withColumn("__tie", _row_hash(df))
        tie = [Key("__tie")]
    peers = [k.name for k in order]
    rows = arrange(df, [*order, *tie], buckets)
    placed = {n: o for n, o in outputs.items() if o.kind not in _NEIGHBOUR}
    near = {n: o for n, o in outputs.items() if o.kind in _NEIGHBOUR}
    out = rows
    if placed:
        out = _positions(rows, order, peers, placed)
    if near:
        out = _neighbours(rows, out, near)
    return out.select(*[col(n) for n in names], *[col(n) for n in outputs])


def _summary(rows: DataFrame, peers: Sequence[str], outputs: dict[str, Out]) -> DataFrame:
    """Offsets per bucket: a table with one row per written partition."""
    kinds = {o.kind for o in outputs.values()}
    sums = sorted({o.column for o in outputs.values() if o.kind.startswith("running_sum")})
    stitched = bool(kinds & _PEER)
    # A struct keeps NULL keys comparable.
    key = F.struct(*[col(c) for c in peers])
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(col(c)).alias(f"s{i}") for i, c in enumerate(sums)]]
    if stitched:
        aggs += [F.min_by(key, col(_AT)).alias("lo"), F.max_by(key, col(_AT)).alias("hi")]
    found = rows.groupBy(_B).agg(*aggs)
    by_bucket = W.orderBy(_B)
    earlier = by_bucket.rowsBetween(W.unboundedPreceding, -1)
    offsets = [
        col(_B),
        col("n"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off_n"),
        F.sum("n").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_n"),
        *[F.sum(f"s{i}").over(earlier).alias(f"off_s{i}") for i in range(len(sums))],
    ]
    if not stitched:
        return stage(found.select(*offsets), "offsets")

    ends = stage(found, "bucket-ends")
    edge = rows.join(F.broadcast(ends.select(_B, "lo", "hi")), _B)
    head, tail = key.eqNullSafe(col("lo")), key.eqNullSafe(col("hi"))
    counts = [F.count_if(head).alias("head_n"), F.count_if(tail).alias("tail_n")]
    if "dense_rank" in kinds:
        counts.append(F.count_distinct(key).alias("d"))
    peer_sums = range(len(sums)) if "running_sum_peers" in kinds else ()
    counts += [F.sum(F.when(head, col(sums[i]))).alias(f"head_s{i}") for i in peer_sums]
    dense = ends.join(edge.groupBy(_B).agg(*counts), _B)

    # A key that begins in one bucket goes on in the next if that one begins with it.
    joint = F.coalesce(col("lo").eqNullSafe(F.lag("hi").over(by_bucket)) & F.lag("n").over(by_bucket).isNotNull(), F.lit(False))
    one_key = col("lo").eqNullSafe(col("hi"))
    dense = dense.withColumns({"joint": joint, "fresh": (~(joint & one_key)).cast("int")})
    dense = dense.withColumn("tail_run", F.sum("fresh").over(by_bucket))
    dense = dense.withColumn("head_run", F.when(col("joint"), F.lag("tail_run").over(by_bucket)).otherwise(-col(_B) - 1))
    back = W.partitionBy("tail_run").orderBy(_B)
    ahead = W.partitionBy("head_run").orderBy(F.desc(_B))
    runs = {"run_tail": F.sum("tail_n").over(back), "run_head": F.sum("head_n").over(ahead)}
    runs |= {f"run_head_s{i}": F.sum(f"head_s{i}").over(ahead) for i in peer_sums}
    dense = dense.withColumns(runs)
    goes_on = F.lead("joint").over(by_bucket)
    offsets += [
        col("lo"),
        col("hi"),
        F.when(col("joint"), F.lag("run_tail").over(by_bucket)).otherwise(0).alias("carry_n"),
        F.when(goes_on, F.lead("run_head").over(by_bucket)).otherwise(0).alias("fwd_n"),
        *[F.when(goes_on, F.lead(f"run_head_s{i}").over(by_bucket)).alias(f"fwd_s{i}") for i in peer_sums],
    ]
    if "dense_rank" in kinds:
        # 1 where the bucket's first key began in an earlier bucket, so it is counted once.
        dense = dense.withColumn("span", col("joint").cast("long"))
        offsets += [col("span"), F.coalesce(F.sum(col("d") - col("span")).over(earlier), F.lit(0)).alias("off_d")]
    return stage(dense.select(*offsets), "offsets")


def _plus(*parts: Column) -> Column:
    """Sum that ignores NULL parts and is NULL only if all parts are."""
    total = parts[0]
    for part in parts[1:]:
        total = F.coalesce(total + part, total, part)
    return total


def _positions(rows: DataFrame, order: Sequence[Key], peers: Sequence[str], outputs: dict[str, Out]) -> DataFrame:
    # One row per written partition, so the broadcast is bounded by the number of tasks.
    summary = F.broadcast(_summary(rows, peers, outputs).drop("n"))
    sums = sorted({o.column for o in outputs.values() if o.kind.startswith("running_sum")})
    full = W.partitionBy(_B).orderBy(_AT)
    by_peer = W.partitionBy(_B).orderBy(*[k.order() for k in order])
    kinds = {o.kind for o in outputs.values()}

    local: dict[str, Column] = {}
    if "running_sum" in kinds:
        for i, c in enumerate(sums):
            local[f"__run{i}"] = F.sum(col(c)).over(full.rowsBetween(W.unboundedPreceding, 0))
    if kinds & {"rank", "percent_rank", "average_rank"}:
        local["__rank"] = F.rank().over(by_peer)
    if "dense_rank" in kinds:
        local["__dense"] = F.dense_rank().over(by_peer)
    if "average_rank" in kinds:
        local["__peers"] = F.count(F.lit(1)).over(by_peer.rangeBetween(0, 0))
    if "running_sum_peers" in kinds:
        for i, c in enumerate(sums):
            local[f"__range{i}"] = F.sum(col(c)).over(by_peer.rangeBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns(local).join(summary, _B)

    if kinds & _PEER:
        key = F.struct(*[col(c) for c in peers])
        head, tail = key.eqNullSafe(col("lo")), key.eqNullSafe(col("hi"))
        rank_value = (
            F.when(head, col("off_n") - col("carry_n") + 1).otherwise(col("off_n") + col("__rank"))
            if "__rank" in local
            else F.lit(None)
        )
    number = col("off_n") + col(_AT) + 1
    values: dict[str, Column] = {}
    for name, out in outputs.items():
        if out.kind == "row_number":
            value = number
        elif out.kind == "row_count":
            value = col("all_n")
        elif out.kind == "rank":
            value = rank_value
        elif out.kind == "dense_rank":
            value = col("off_d") - col("span") + col("__dense")
        elif out.kind == "percent_rank":
            value = F.when(col("all_n") > 1, (rank_value - 1) / F.greatest(col("all_n") - 1, F.lit(1))).otherwise(0.0)
        elif out.kind == "average_rank":
            peer_rows = (
                col("__peers")
                + F.when(head, col("carry_n")).otherwise(0)
                + F.when(tail, col("fwd_n")).otherwise(0)
            )
            value = rank_value + (peer_rows - 1) / F.lit(2.0)
        elif out.kind == "ntile":
            value = tile_of(number, col("all_n"), out.size)
        elif out.kind == "running_sum":
            i = sums.index(out.column)
            value = _plus(col(f"off_s{i}"), col(f"__run{i}"))
        elif out.kind == "running_sum_peers":
            i = sums.index(out.column)
            value = _plus(col(f"off_s{i}"), col(f"__range{i}"), F.when(tail, col(f"fwd_s{i}")))
        else:
            raise ValueError(f"unknown window output: {out.kind}")
        values[name] = value
    return rows.withColumns(values)


def tile_of(number: Column, total: Column, tiles: int) -> Column:
    """NTILE from a row number and the row count."""
    n = F.lit(tiles)
    size = F.floor(total / n)
    longer = total - size * n
    return F.when(
        number <= longer * (size + 1), F.floor((number - 1) / (size + 1)) + 1
    ).otherwise(longer + F.floor((number - 1 - longer * (size + 1)) / F.greatest(size, F.lit(1))) + 1)


def _neighbours(rows: DataFrame, out: DataFrame, outputs: dict[str, Out]) -> DataFrame:
    """Lag and moving windows: each bucket also sees the last rows before it."""
    reach = max(o.size if o.kind == "lag" else o.size - 1 for o in outputs.values())
    own = out.withColumn("__halo", F.lit(False))
    if reach:
        own = own.unionByName(_halo(rows, outputs, reach), allowMissingColumns=True)
    window = W.partitionBy(_B).orderBy(_AT)
    values: dict[str, Column] = {}
    for name, o in outputs.items():
        if o.kind == "lag":
            value = F.lag(col(o.column), o.size).over(window)
        else:
            frame = window.rowsBetween(1 - o.size, 0)
            value = (F.avg if o.kind == "moving_avg" else F.sum)(col(o.column)).over(frame)
        values[name] = value
    return own.withColumns(values).where(~col("__halo"))


def _halo(rows: DataFrame, outputs: dict[str, Out], reach: int) -> DataFrame:
    """The ``reach`` rows preceding each bucket, relabelled to that bucket, at negative places.

    A row precedes every following bucket that begins at most ``reach`` places after it.  How far that is, is read
    off the bucket sizes, of which the driver holds one number per written partition.
    """
    used = list(dict.fromkeys(o.column for o in outputs.values()))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(_B).count().collect())
    starts = list(itertools.accumulate([n for _, n in sizes], initial=0))
    reached = [
        (b, starts[i], starts[i + 1], other, starts[j])
        for i, (b, _) in enumerate(sizes)
        for j, (other, _) in itertools.takewhile(lambda x: starts[x[0]] < starts[i + 1] + reach, enumerate(sizes[i + 1 :], i + 1))
    ]
    table = rows.sparkSession.createDataFrame(reached, f"{_B} int, __start long, __end long, __to int, __to_start long")
    number = col("__start") + col(_AT)
    return (
        rows.select(_B, _AT, *[col(c) for c in used])
        .join(F.broadcast(table), _B)
        .where(number >= col("__to_start") - reach)
        .select(col("__to").alias(_B), (number - col("__to_start")).alias(_AT), *[col(c) for c in used], F.lit(True).alias("__halo"))
    )
