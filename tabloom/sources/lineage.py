"""Number the rows of a file scan in file order, in parallel.

A scan exposes the file path and the start of the split a row came from.  Rows of
one split have consecutive ids, so the position in the split is the distance from
the split's smallest id, and the position in the table adds the rows of all earlier
splits.  Only the per-split counts (one row per input split) are ordered globally;
the rows are not shuffled.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.cells import ROW
from ..staging import stage

# Up to this size the split table is broadcast (about 300 bytes a split, mostly the path); beyond, it is joined by key.
BROADCAST_BYTES, SPLIT_BYTES = 64 << 20, 300

_FILE, _START, _ID = "__file", "__start", "__id"


def tag_splits(scan: DataFrame) -> DataFrame:
    """Attach the split of each row; call directly on a file scan, before any filter."""
    return scan.select(
        "*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_START)
    )


def number_rows(tagged: DataFrame, start: int = 1, *, skip_per_file: int = 0, name_of_row: str = ROW) -> DataFrame:
    """Replace the split columns by a row number; optionally drop the first rows of each file."""
    rows = tagged.withColumn(_ID, F.monotonically_increasing_id())
    splits = rows.groupBy(_FILE, _START).agg(F.min(_ID).alias("__first"), F.count(F.lit(1)).alias("__n"))
    # Staged, so that its size is known and it is counted once: one row per split.
    splits = stage(splits, "splits")
    few = splits.count() * SPLIT_BYTES <= BROADCAST_BYTES
    in_file = W.partitionBy(_FILE).orderBy(_START).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy(_FILE, _START).rowsBetween(W.unboundedPreceding, -1)
    above = F.coalesce(F.sum("__n").over(in_file), F.lit(0))
    splits = (
        splits.withColumn("__drop", F.least(F.greatest(F.lit(skip_per_file) - above, F.lit(0)), F.col("__n")))
        .withColumn("__before", F.coalesce(F.sum(F.col("__n") - F.col("__drop")).over(before), F.lit(0)))
    )
    joined = rows.join(F.broadcast(splits) if few else splits, [_FILE, _START], "left")
    place = F.col(_ID) - F.col("__first") - F.col("__drop")
    wanted = F.coalesce(place >= 0, F.lit(True))
    names = [c for c in tagged.columns if c not in (_FILE, _START)]
    cells = [F.col(c) for c in names]
    if skip_per_file:
        # A caller's filter may be evaluated together with the one that drops the skipped
        # rows, so those rows must not show it their cells.
        cells = [F.when(wanted, c).alias(name) for c, name in zip(cells, names)]
    # Splits that changed after they were counted are an error, never a wrong number.
    known = F.coalesce(F.col(_ID).between(F.col("__first"), F.col("__first") + F.col("__n") - 1), F.lit(False))
    number = F.when(known, F.col("__before") + place + F.lit(start)).otherwise(
        F.raise_error(F.lit("input splits changed after the rows were counted; load the table again")).cast("long")
    )
    return joined.where(wanted).select(*cells, number.cast("long").alias(name_of_row))
