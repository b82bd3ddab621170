"""Records of delimited text whose quoted cells may hold line breaks, read from split files.

A line break belongs to a record if the quotes before it in the file are odd in number.  Quotes are counted per
split; the parity of all earlier splits of a file, one bit for each, is the state in which a split begins.  Each split
then puts its own records together as its lines stream by, without a shuffle.  Only the pieces at its two ends
can belong to a record of another split; these, two for each split at most, are joined by file and order.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.cells import FILE, ROW
from ..staging import stage
from .lineage import BROADCAST_BYTES, SPLIT_BYTES, tag_splits

_FILE, _START = "__file", "__start"
#: Kinds of pieces: a record, the end of one that began in an earlier split, the start of one that goes on, and its middle.
WHOLE, END, BEGIN, MIDDLE = 0, 1, 2, 3


def _quotes(line) -> object:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order, with the parity their split begins in, to records and pieces of records."""
    split: tuple | None = None
    odd, begun, held = False, True, []
    schema = pa.schema([(_FILE, pa.string()), (_START, pa.int64()), ("value", pa.string()), ("kind", pa.int32())])

    def rest() -> list[tuple]:
        """What is open at the end of a split."""
        return [(*split, "\n".join(held), BEGIN if begun else MIDDLE)] if held else []

    def batch_of(rows: Sequence[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    for batch in batches:
        out: list[tuple] = []
        files, starts, states = batch.column(_FILE), batch.column(_START).to_numpy(), batch.column("odd").to_numpy(zero_copy_only=False)
        lines = batch.column("value")
        turns = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2 == 1
        codes = files.dictionary_encode().indices.to_numpy()
        changes = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])]))
        texts = lines.to_pylist()
        for first, last in zip(changes, [*changes[1:], len(texts)]):
            here = (files[int(first)].as_py(), int(starts[first]))
            if here != split:
                out += rest() if split else []
                split, odd, held = here, bool(states[first]), []
                begun = not odd
            for text, turn in zip(texts[first:last], turns[first:last]):
                if not odd and not turn:
                    out.append((*split, text, WHOLE))
                    continue
                held.append(text)
                odd ^= bool(turn)
                if not odd:
                    out.append((*split, "\n".join(held), WHOLE if begun else END))
                    held, begun = [], True
        if out:
            yield batch_of(out)
    if split and rest():
        yield batch_of(rest())


def _attach(rows: DataFrame, splits: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(splits) if few else splits, [_FILE, _START])


def quoted_records(spark: SparkSession, path: str | Sequence[str], blank, *, skip_per_file: int = 0) -> DataFrame:
    """Records (``value``) that are not ``blank(value)``, with file and number from 1, each file's first ones left out.

    A file's records go in its order, files by path.  Line breaks inside a record are kept; a carriage return at its end is
    not.  A quote that is never closed makes the rest of its file one record.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = tag_splits(spark.read.option("lineSep", "\n").text(paths))
    parity = lines.groupBy(_FILE, _START).agg((F.sum(_quotes(F.col("value"))) % 2).alias("own"))
    before = W.partitionBy(_FILE).orderBy(_START).rowsBetween(W.unboundedPreceding, -1)
    splits = stage(parity.select(_FILE, _START, (F.coalesce(F.sum("own").over(before), F.lit(0)) % 2 == 1).alias("odd")), "split-states")
    few = splits.count() * SPLIT_BYTES <= BROADCAST_BYTES
    # A join by key would part the lines of a split; so many splits go one by one, in a partition each.
    stated = _attach(lines, splits, few)
    if not few:
        stated = stated.repartition(_FILE, _START).sortWithinPartitions(_FILE, _START, F.monotonically_increasing_id())
    kinds = f"{_FILE} string, {_START} long, value string, kind int"
    pieces = stated.select(_FILE, _START, "value", "odd").mapInArrow(_pieces, kinds)

    # A record across splits is put where it begins.  Pieces are two for each split at most.
    broken = stage(pieces.where(f"kind <> {WHOLE}"), "split-pieces")
    order = W.partitionBy(_FILE).orderBy(_START, F.col("kind") == BEGIN)
    run = broken.withColumn("run", F.sum((F.col("kind") == BEGIN).cast("int")).over(order))
    joined = run.groupBy(_FILE, "run").agg(F.min(_START).alias(_START), F.sort_array(F.collect_list(F.struct(_START, "value"))).alias("parts"))
    trim = lambda c: F.regexp_replace(c, r"\r$", "")
    glued = joined.select(_FILE, _START, trim(F.array_join(F.transform("parts", lambda p: p["value"]), "\n")).alias("value"))
    glued = stage(glued.where(~blank(F.col("value"))), "split-records")

    whole = pieces.where(f"kind = {WHOLE}").select(_FILE, _START, trim(F.col("value")).alias("value"))
    whole = whole.where(~blank(F.col("value"))).withColumn("__id", F.monotonically_increasing_id())
    counted = whole.groupBy(_FILE, _START).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__whole"))
    counted = counted.join(glued.select(_FILE, _START, F.lit(1).alias("__glued")), [_FILE, _START], "full")
    counted = stage(counted.select(_FILE, _START, "__first", F.coalesce("__whole", F.lit(0)).alias("__whole"), F.coalesce("__glued", F.lit(0)).alias("__glued")), "split-counts")
    own = F.col("__whole") + F.col("__glued")
    above = F.coalesce(F.sum(own).over(before), F.lit(0))
    counted = counted.withColumn("__drop", F.least(F.greatest(F.lit(skip_per_file) - above, F.lit(0)), own))
    earlier = W.orderBy(_FILE, _START).rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("__before", F.coalesce(F.sum(own - F.col("__drop")).over(earlier), F.lit(0)))
    placed = _attach(whole, counted, few).select("value", F.col(_FILE).alias(FILE), (F.col("__id") - F.col("__first") - F.col("__drop")).alias("__place"), "__before")
    last = _attach(glued, counted, few).select("value", F.col(_FILE).alias(FILE), (F.col("__whole") - F.col("__drop")).alias("__place"), "__before")
    rows = placed.unionByName(last).where("__place >= 0")
    return rows.select("value", FILE, (F.col("__before") + F.col("__place") + 1).cast("long").alias(ROW))
