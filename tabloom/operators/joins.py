"""Join helpers: size-checked lookups and the keyed joins of the analyses."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col, number, sort_rows
from ..staging import stage

#: Estimated bytes up to which a lookup side is broadcast; a larger one is joined by key.
LOOKUP_BYTES = 32 << 20
#: A key counts as heavy from this multiple of the rows that a task has on average.
HEAVY = 2.0


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of an ungrouped aggregate (exactly one row) to every row."""
    return df.crossJoin(F.broadcast(one_row))


def row_bytes(df: DataFrame) -> int:
    """Estimated bytes of a row of fixed-width columns; text counts 64."""
    return sum(64 if f.dataType.simpleString() in ("string", "binary") else 16 for f in df.schema)


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", *, broadcast_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """Join ``df`` to a table that is unique on ``on``.

    The table is staged, so its size is known before the join is planned.  A small one is broadcast and ``df`` is not
    shuffled.  A large one is joined by key, except for the keys that hold more than ``HEAVY`` times an average task's
    rows of ``df``: there are at most as many of those as tasks, and their table rows are broadcast.  NULL keys match
    nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup joins are left or inner")
    staged = stage(table, "lookup")
    keys = list(on)
    # The count comes from the file footers.
    if staged.count() * row_bytes(staged) <= broadcast_bytes:
        return df.join(F.broadcast(staged), keys, how)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stage(df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n")), "key-sizes")
    limit = HEAVY * (counts.agg(F.sum("__n")).first()[0] or 0) / tasks
    heavy = stage(counts.where(col("__n") > limit).drop("__n"), "heavy-keys")
    if heavy.isEmpty():
        return df.join(staged, keys, how)
    # Fewer than tasks / HEAVY keys can exceed the limit.
    marked = df.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), keys, "left")
    few = staged.join(F.broadcast(heavy), keys)
    light = marked.where("__heavy IS NULL").drop("__heavy").join(staged, keys, how)
    return light.unionByName(marked.where("__heavy").drop("__heavy").join(F.broadcast(few), keys, how))


def inner_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Equi-join of two loaded tables; Spark picks broadcast or sort-merge by size and splits skewed keys."""
    return left.join(right, col(left_on) == col(right_on), "inner")


def group_average(df: DataFrame, group: str, value: str, name: str = "avg_value") -> DataFrame:
    return df.groupBy(col(group)).agg(F.avg(number(df, value)).alias(name))


def join_group_average(
    df: DataFrame,
    group: str,
    value: str,
    *,
    how: str = "left",
    mean_name: str = "group_mean",
    diff_name: str | None = "diff_from_group_mean",
) -> DataFrame:
    """Every row with its group's mean (and the difference).

    ``how='inner'`` drops rows of the NULL group; ``'left'`` keeps them without a mean.
    """
    means = group_average(df.where(col(group).isNotNull()), group, value, mean_name)
    joined = lookup(df, means, [group], how)
    order = [*df.columns, mean_name]
    joined = joined.select(*[col(c) for c in order])
    if diff_name is None:
        return joined
    return joined.withColumn(diff_name, number(df, value) - col(mean_name))


def above_average(df: DataFrame, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose value exceeds the overall mean, largest first."""
    mean = df.agg(F.avg(number(df, value)).alias("__mean"))
    kept = with_constants(df, mean).where(number(df, value) > col("__mean")).drop("__mean")
    return sort_rows(kept.select(*[col(c) for c in columns or df.columns]), col(value).desc_nulls_last())


def first_seen(df: DataFrame, entity: str, when: str, name: str = "first_seen") -> DataFrame:
    return df.where(col(when).isNotNull()).groupBy(col(entity)).agg(F.min(col(when)).alias(name))


def share_of(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``whole``; NULL when the whole is zero."""
    return F.round(F.try_divide(part * 100, whole), digits)
