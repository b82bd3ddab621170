"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a hash of the id.  A document's virtual finish time is the number of its source's
words up to its end, copies of earlier rounds included, divided by the source's target; all documents of all
sources are sorted by finish time and the list is cut where the budget is spent.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import running_total

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[int], limit: int) -> list[float]:
    """Words wanted of each source: all words by weight, at most ``limit`` times the source's own, the excess reshared.

    A source is capped if it reaches its cap at the share that the sources with later caps would get; taking
    them by cap per weight, whole numbers decide.
    """
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    queue = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    for i in queue:
        if limit * sizes[i] * weight <= weights[i] * left:
            out[i] = float(limit * sizes[i])
            left, weight = left - limit * sizes[i], weight - weights[i]
        else:
            out[i] = float(weights[i] * left) / weight
    return out


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    limit: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: key, source, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Sources in code point order, null last, take the weights in turn.  ``size`` is the number of words (null
    text: 0) and ``taken`` the words that the mix takes, ``copies`` times the size.  A document without words
    is taken 0 times.  Rows with equal ids follow each other in the order of their sizes.  The same rows give
    the same mix.  The list of sources is held on the driver; documents are not.
    """
    narrow = stage(
        docs.select(
            F.col(source).cast("string").alias("source"),
            F.col(key).alias("doc_id"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("__m"),
        ),
        "mix-sizes",
    )
    found = sorted(
        ((r[0], r[1]) for r in narrow.groupBy("source").agg(F.sum("size")).collect()),
        key=lambda r: (r[0] is None, r[0] or ""),
    )
    weight = [weights[i % len(weights)] for i in range(len(found))]
    wanted = targets([n for _, n in found], weight, limit)
    budget = sum(n for _, n in found)
    table = docs.sparkSession.createDataFrame(
        [(s, i, n, t) for i, ((s, n), t) in enumerate(zip(found, wanted))],
        "__source string, __rank int, source_size long, target double",
    )
    ranked = narrow.join(table, narrow["source"].eqNullSafe(table["__source"])).drop("__source")
    placed = stage(running_total(ranked, "__rank", ["__rank", "__m", "doc_id", "size"], "size", "__before"), "mix-order")

    turn = F.col("__turn")
    finish = (turn * F.col("source_size") + F.col("__before") + F.col("size")).cast("double") / F.col("target")
    # Only sources whose target exceeds their size need a second or third turn.
    turns = F.ceil(F.col("target") / F.col("source_size")).cast("int")
    queue = (
        placed.where((F.col("size") > 0) & (F.col("target") > 0))
        .withColumn("__turn", F.explode(F.sequence(F.lit(0), turns - 1)))
        .select("size", finish.alias("__finish"), "__rank", "__before", "__turn")
    )
    order = ["__finish", "__rank", "__before", "__turn"]
    spent = running_total(queue, None, order, "size", "__spent")
    last = spent.where(F.col("__spent") + F.col("size") <= budget).agg(F.max(F.struct(*order))).first()[0]
    copies = F.lit(0)
    if last is not None:
        cut = F.struct(F.lit(last[0]), F.lit(last[1]).cast("int"), F.lit(last[2]).cast("long"), F.lit(last[3]).cast("int"))
        for i in range(limit):
            ends = (F.lit(i) * F.col("source_size") + F.col("__before") + F.col("size")).cast("double") / F.col("target")
            at = F.struct(ends, F.col("__rank"), F.col("__before"), F.lit(i))
            taken = (F.col("size") > 0) & (F.col("target") > 0) & (F.lit(i) < turns) & (at <= cut)
            copies = copies + F.when(taken, 1).otherwise(0)
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
