"""Interaction audit of a set of filters: what each one removes, in every order in which they can be applied.

Every filter's failing rows are stored as a table of ids.  Level by level, a left-semi join with one of these
tables takes out of the survivors those it removes, and a left-anti join keeps the others; removed rows go
through the later levels too, since in another order they would still be there.  After the last level a row is
known by the filters it fails, and the survivors of a prefix are the rows that fail none of it, whatever the
order within the prefix: with k filters 2k joins on ids answer all k! orders.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import stage
from .common import attach

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_SPACE = "[ \\t-\\r]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Five failure conditions of a text (null: empty): short, repetitive, shouting, symbols; ``E`` is added by ``repeats``."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, _SPACE, -1), "")
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(whole),
        "D": whole.rlike("[#$%&*|]"),
    }


def repeats(rows: DataFrame, key: str, digest: str, row: str) -> DataFrame:
    """Staged ``row`` ids of the rows whose digest a row with a smaller ``key`` has too.

    Only digests that occur with several keys are joined back, so a digest without copies is not shuffled twice.
    """
    known = rows.where(F.col(key).isNotNull())
    least = known.groupBy(digest).agg(F.min(key).alias("__first"), F.max(key).alias("__last")).where("__first < __last")
    copied = stage(least.select(digest, "__first"), "audit-copied")
    return stage(attach(known, copied, digest, "inner", 64).where(F.col(key) > F.col("__first")).select(row), "audit-fails")


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
    repeated: str | None = "E",
) -> DataFrame:
    """One row for each part, order of the filters and step, with counts.

    ``filters`` maps one-letter names to failure conditions over the columns of ``docs`` (default:
    ``text_filters``); ``repeated`` names one more, which a row fails if a row with a smaller key has the same
    text (null and empty are the same).  Columns: part (null: ''), filter_order, step (from 1), and for the
    step's filter: kept (rows after the step), removed (by it), redundant (rows that fail it, removed before),
    unique_fails (rows that fail it alone), good_lost and toxic_lost (of the removed, those with a label
    quality = 1 or toxic = 1), shapley (removed, summed over all orders).

    A condition that is null does not fail.  Rows that repeat a key are rows of their own; a row without a key
    is never a repeat, and has no label.  An empty table gives no rows.  Extra columns are ignored.
    """
    conditions = dict(text_filters(F.col(text)) if filters is None else filters)
    names = [*conditions, *([repeated] if repeated else [])]
    if len(set(names)) != len(names) or not names:
        raise ValueError("filters need distinct names")
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256) if repeated else F.lit(None).cast("string")
    # One pass over the texts; what is kept of a row is small.
    rows = docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(key).alias("__key"),
        F.coalesce(F.col(part), F.lit("")).cast("string").alias("__part"),
        digest.alias("__digest"),
        *[F.coalesce(c, F.lit(False)).alias(f"__fails{i}") for i, c in enumerate(conditions.values())],
    )
    rows = stage(rows, "audit-rows")
    fails = [stage(rows.where(f"__fails{i}").select("__row"), "audit-fails") for i in range(len(conditions))]
    if repeated:
        fails.append(repeats(rows, "__key", "__digest", "__row"))

    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("__good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("__toxic"),
    )
    marks = stage(marks.where("__good + __toxic > 0"), "audit-labels")
    level = attach(rows.select("__row", "__key", "__part"), marks, "__key", "left", 24).select(
        "__row", "__part", F.coalesce("__good", F.lit(0)).alias("__good"), F.coalesce("__toxic", F.lit(0)).alias("__toxic"), F.lit(0).alias("__failed")
    )
    for i, failing in enumerate(fails):
        level = stage(level, "audit-level")
        removed = attach(level, failing, "__row", "left_semi", 16).withColumn("__failed", F.col("__failed") + (1 << i))
        level = removed.unionByName(attach(level, failing, "__row", "left_anti", 16))
    # At most 2^k rows for each part.
    cells = level.groupBy("__part", "__failed").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__good").alias("__good"), F.sum("__toxic").alias("__toxic")
    )
    return _steps(stage(cells, "audit-cells"), names)


def _steps(cells: DataFrame, names: list[str]) -> DataFrame:
    """Every order and step from the rows of each set of failed filters."""
    k = len(names)
    steps = [
        ("".join(names[f] for f in order), at + 1, sum(1 << f for f in order[:at]), 1 << order[at])
        for order in itertools.permutations(range(k))
        for at in range(k)
    ]
    # k * k! rows, which do not grow with the data.
    told = F.broadcast(cells.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int"))
    # A cell meets every filter with every set of others before it: k * 2^(k-1) of them, numbered.
    half = 1 << (k - 1)
    met = cells.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(k * half - 1))))
    own = F.get(F.array(*[F.lit(1 << f) for f in range(k)]), F.floor(F.col("__i") / half).cast("int"))
    others = F.col("__i") % half
    below = others.bitwiseAND(own - 1)
    met = met.withColumns({"filter": own, "before": below + 2 * (others - below)})
    # Orders in which exactly these others come before the filter.
    ways = F.array(*[F.lit(math.factorial(n) * math.factorial(k - 1 - n)) for n in range(k)])
    counted = met.withColumn("orders", F.get(ways, F.bit_count("before")))
    failed, before, own = F.col("__failed"), F.col("before"), F.col("filter")
    there, fails = failed.bitwiseAND(before) == 0, failed.bitwiseAND(own) != 0
    total = lambda holds, what="__n": F.sum(F.when(holds, F.col(what)).otherwise(F.lit(0).cast("long")))
    found = counted.groupBy("__part", "before", "filter", "orders").agg(
        total(there & ~fails).alias("kept"),
        total(there & fails).alias("removed"),
        total(~there & fails).alias("redundant"),
        total(failed == own).alias("unique_fails"),
        total(there & fails, "__good").alias("good_lost"),
        total(there & fails, "__toxic").alias("toxic_lost"),
    )
    shapley = F.sum(F.col("removed") * F.col("orders")).over(W.partitionBy("__part", "filter"))
    return (
        found.withColumn("shapley", shapley)
        .join(told, ["before", "filter"])
        .select(F.col("__part").alias("part"), "filter_order", "step", *COUNTS, "shapley")
    )
