"""Exact percentiles (linear interpolation) of numeric expressions, of the whole table or of groups, by radix selection.

A double becomes a long in the same order.  A pass counts the rows of every bin of keys, combined on the map side, and
the bin that holds a wanted rank is the next pass's interval; a bin whose least and largest key are equal is the
answer.  What is shuffled is counts of bins, however many rows there are.  Groups keep their intervals in a table that
is joined to the rows, so the values of a group never meet in one task.
"""
from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.cells import col
from ..staging import stage

#: Bins of one pass, over all columns; and the bits by which an interval shrinks in a pass, at least and at most.
CELLS, LEAST_BITS, MOST_BITS = 1 << 17, 8, 12
#: First bins of groups: a double's sign, exponent and so many bits of its fraction.
FRACTION_BITS = 8
#: Up to this size a table of intervals is broadcast; a larger one is joined by key.
BROADCAST_BYTES, INTERVAL_BYTES = 64 << 20, 200

_ONE = 1 << 52
_LEAST_NORMAL = 2.0**-1022


def ordered_keys(df: DataFrame, values: Mapping[str, Column], *kept: Column) -> DataFrame:
    """The ``values`` as longs in the order of the doubles: the bits of the absolute value, with its sign.

    NULL and NaN have no key; zeros have one.  Written as steps, so that each is computed once in a row.
    """
    names = list(values)
    rest = [f"__rest{i}" for i in range(len(kept))]
    given = df.select(*[c.alias(r) for c, r in zip(kept, rest)], *[v.cast("double").alias(n) for n, v in values.items()])
    size = lambda n: F.abs(col(n))
    power = given.select("*", *[F.least(F.floor(F.log2(size(n))), F.lit(1023)).alias(f"__e_{n}") for n in names])
    part = power.select("*", *[(size(n) / F.pow(F.lit(2.0), col(f"__e_{n}"))).alias(f"__m_{n}") for n in names])

    def key(n: str) -> Column:
        e, m = col(f"__e_{n}"), col(f"__m_{n}")
        whole = lambda up, fraction: (e + (1023 + up)) * F.lit(_ONE) + ((fraction - 1) * F.lit(float(_ONE))).cast("long")
        bits = (
            F.when(size(n) == 0, F.lit(0).cast("long"))
            .when(size(n) == float("inf"), F.lit(2047 * _ONE))
            .when(size(n) < _LEAST_NORMAL, (size(n) * F.lit(2.0**537) * F.lit(2.0**537)).cast("long"))
            # The logarithm may be off by one next to a power of two.
            .when(m < 1, whole(-1, 2 * m))
            .when(m >= 2, whole(1, m / 2))
            .otherwise(whole(0, m))
        )
        return F.when(col(n).isNotNull() & ~F.isnan(col(n)), bits * F.when(col(n) < 0, -1).otherwise(1)).alias(n)

    return part.select(*rest, *map(key, names))


def key_of(value: float) -> int:
    """The ordered key of a double."""
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def _value(key: Column) -> Column:
    """The same as a column: exponent and fraction put together again."""
    bits = F.abs(key)
    power, fraction = F.shiftright(bits, 52), bits.bitwiseAND(F.lit(_ONE - 1)).cast("double") / F.lit(float(_ONE))
    normal = (1 + fraction) * F.pow(F.lit(2.0), power - 1023)
    found = (
        F.when(power == 2047, F.lit(float("inf")))
        .when(power == 0, fraction * F.lit(_LEAST_NORMAL))
        .otherwise(normal)
    )
    return F.when(key < 0, -found).otherwise(found)


def _shift(low: float, high: float, bits: int) -> int:
    """The bits of a key to drop so that an interval has at most 2^bits bins."""
    first, last = key_of(low), key_of(high)
    return next(s for s in range(65) if (last >> s) - (first >> s) < 1 << bits)


def _ranks(p: float, rows: int) -> tuple[int, int]:
    position = p * (rows - 1)
    return math.floor(position), math.ceil(position)


def _interpolate(p: float, rows: int, at: Mapping[int, float]) -> float | None:
    if not rows:
        return None
    position = p * (rows - 1)
    low, high = _ranks(p, rows)
    if low == high:
        return at[low]
    return (high - position) * at[low] + (position - low) * at[high]


def _bins(values: DataFrame, intervals: Sequence[tuple[str, float | None, float | None]], shifts: Sequence[int]) -> tuple[np.ndarray, ...]:
    """Interval, rows, least and largest value of every bin of the intervals (column, low, high; None: all of it), in order."""
    by_column: dict[str, list[int]] = {}
    for i, (c, _, _) in enumerate(intervals):
        by_column.setdefault(c, []).append(i)
    cells = []
    for c, those in by_column.items():
        number = F.lit(None).cast("int")
        for i in those:
            _, low, high = intervals[i]
            holds = col(c).isNotNull() if low is None else col(c).between(F.lit(low), F.lit(high))
            number = F.when(holds, F.lit(i)).otherwise(number)
        cells.append((number.alias("i"), col(c).alias("v")))
    if len(cells) == 1:
        pairs = values.select(*cells[0])
    else:
        # The keys come after the explode, so that their code is short; the outer form has no size filter to compute.
        pairs = values.select(F.explode_outer(F.array(*[F.struct(*cell) for cell in cells])).alias("p")).select("p.*")
    keyed = ordered_keys(pairs.where("i is not null"), {"k": col("v")}, col("i"), col("v"))
    dropped = F.element_at(F.array(*map(F.lit, shifts)), col("i") + 1).alias("s")
    binned = keyed.select(col("__rest0").alias("i"), col("__rest1").alias("v"), "k").select("i", "v", "k", dropped)
    counts = binned.groupBy("i", F.expr("shiftright(k, s)").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    found = counts.toArrow()
    i, b, n, low, high = (found.column(k).to_numpy() for k in ("i", "b", "n", "low", "high"))
    order = np.lexsort((b, i))
    return i[order], n[order], low[order], high[order]


def exact_quantiles_of(df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Percentiles of the values of each expression, as Python floats (a constant-size result).

    All expressions share the passes over ``df``: the first counts bins of every value's sign, exponent and leading
    fraction; the others, as many as the values need to be told apart (seven at most, one as a rule), narrow the bins that
    hold a wanted rank.
    """
    if not values:
        return {}
    names = [f"k{i}" for i in range(len(values))]
    cells = [v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())]
    given = df.select(*cells).select(*[F.when(~F.isnan(f"v{i}"), col(f"v{i}")).alias(n) for i, n in enumerate(names)])
    at: dict[str, dict[int, float]] = {n: {} for n in names}
    rows: dict[str, int] = {}
    # Wanted ranks by interval (column, low, high) and the rows below it.
    wanted: dict[tuple, set[int]] = {(n, None, None, 0): set() for n in names}
    fraction = max(0, min(10, int(math.log2(CELLS / (16 * len(names))))))
    while wanted:
        places = list(wanted)
        bits = max(LEAST_BITS, min(MOST_BITS, int(math.log2(CELLS / len(places)))))
        shifts = [52 - fraction if low is None else _shift(low, high, bits) for _, low, high, _ in places]
        i, n, low, high = _bins(given, [p[:3] for p in places], shifts)
        narrowed: dict[tuple, set[int]] = {}
        for j, place in enumerate(places):
            name, first, last = place[0], *np.searchsorted(i, [j, j + 1])
            upto = place[3] + np.cumsum(n[first:last])
            if place[1] is None:
                rows[name] = int(n[first:last].sum())
                wanted[place] = {rank for p in probabilities for rank in _ranks(p, rows[name])} if rows[name] else set()
            for rank in wanted[place]:
                b = first + int(np.searchsorted(upto, rank, "right"))
                if low[b] == high[b]:
                    at[name][rank] = float(low[b])
                else:
                    narrowed.setdefault((name, float(low[b]), float(high[b]), int(upto[b - first] - n[b])), set()).add(rank)
        wanted = narrowed
    return {name: [_interpolate(p, rows[n], at[n]) for p in probabilities] for name, n in zip(values, names)}


def exact_quantiles(df: DataFrame, value: Column, probabilities: Sequence[float]) -> list[float | None]:
    """Percentiles of one expression."""
    return exact_quantiles_of(df, {"value": value}, probabilities)["value"]


def grouped_medians(df: DataFrame, groups: Sequence[str], value: Column, name: str = "median") -> DataFrame:
    """The median of each group that has values.

    Bins of every group are counted first; then only the rows in the bins of the middle ranks are kept, written, and
    counted in ever finer bins until each holds one value.  ``df`` is read twice.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    rows = ordered_keys(df, {"__k": value}, *[col(g) for g in groups])
    rows = rows.select(*[col(f"__rest{i}").alias(k) for i, k in enumerate(keys)], "__k").where("__k is not null")
    counts = [F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__low"), F.max("__k").alias("__high")]
    bins = rows.groupBy(*keys, F.shiftright("__k", 52 - FRACTION_BITS).alias("__b")).agg(*counts)
    group = W.partitionBy(*keys)
    total = F.sum("__n").over(group)
    middle = F.array_distinct(F.array(F.floor((total - 1) / 2), F.ceil((total - 1) / 2)))
    ranked = bins.withColumns({"__ranks": middle, "__upto": F.sum("__n").over(group.orderBy("__b").rowsBetween(W.unboundedPreceding, 0))})
    state = stage(_narrowed(ranked, keys), "median-bins")
    done = state.where("__low = __high")
    still = state.where("__low < __high")
    left = rows
    # An interval loses at least LEAST_BITS bits in a pass.
    while (n := still.count()):
        marked = still.select(*[col(k).alias(f"__s{i}") for i, k in enumerate(keys)], "__low", "__high", "__below", "__ranks")
        same = col("__k").between(col("__low"), col("__high"))
        for i, k in enumerate(keys):
            same = same & col(k).eqNullSafe(col(f"__s{i}"))
        small = n * INTERVAL_BYTES <= BROADCAST_BYTES
        left = stage(left.join(F.broadcast(marked) if small else marked, same).select(*keys, "__k", "__low", "__high", "__below", "__ranks"), "median-rows")
        # Bits above LEAST_BITS of the interval's width; any number gives the same result.
        width = F.ceil(F.log2(F.greatest(col("__high").cast("double") - col("__low").cast("double"), F.lit(1.0))))
        shift = F.greatest(width - LEAST_BITS, F.lit(0)).cast("int").alias("__shift")
        binned = left.select(*keys, "__k", col("__low").alias("__from"), "__below", "__ranks", shift)
        bins = binned.groupBy(*keys, "__from", "__below", "__ranks", F.expr("shiftright(__k, __shift)").alias("__b")).agg(*counts)
        inner = W.partitionBy(*keys, "__from").orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
        ranked = bins.withColumn("__upto", col("__below") + F.sum("__n").over(inner))
        state = stage(_narrowed(ranked, keys), "median-bins")
        done = done.unionByName(state.where("__low = __high"))
        still = state.where("__low < __high")
        left = left.select(*keys, "__k")
    found = done.select(*keys, _value(col("__low")).alias("__v")).groupBy(*keys).agg(F.avg("__v").alias(name))
    return found.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], name)


def _narrowed(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bins that hold a wanted rank, with the ranks in them and the rows below; ``bins`` has running counts."""
    inside = F.filter("__ranks", lambda r: (r < col("__upto")) & (r >= col("__upto") - col("__n")))
    found = bins.withColumn("__ranks", inside).where(F.size("__ranks") > 0)
    return found.select(*keys, "__low", "__high", (col("__upto") - col("__n")).alias("__below"), "__ranks")
