"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors are quantised to whole numbers.  The rows are dealt to blocks, and each block is indexed once: a posting
is a row and its component in one dimension, and postings of equal impact, a power-of-two band of the
component's size, form segments, one list for each dimension.  A block of queries takes a block's segments by
descending impact and adds their contributions.  What a row has not yet shown is bounded by the length of its
components still to come times the query's.  A row is dropped only when its upper bound is below the k-th best
lower bound, or below the k-th best score that the query has met in another block; the segments stop when
rescoring the rows that are left costs less than the next segment, and those are rescored exactly.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import stage

#: Rows of the index in a block, queries in a block, and queries that go through the segments together.
INDEX_BLOCK, QUERY_BLOCK, STRIP = 4096, 1024, 128
_EXACT = 2**53
#: Pairs rescored at once.
_PAIRS = 1 << 16

#: Postings of one impact: the end of each dimension's list, then rows and components, list after list.
Segment = tuple[np.ndarray, np.ndarray, np.ndarray]
_INDEX = "block long, impact int, ids array<long>, ends array<int>, row array<int>, size array<long>"


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of whole numbers; a shorter one is filled with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def segments(rows: np.ndarray) -> Iterator[tuple[int, Segment]]:
    """(impact, postings) of a block by descending impact; zeros have no posting."""
    dimension, row = np.nonzero(rows.T)
    size = rows[row, dimension]
    impact = np.frexp(np.abs(size.astype(np.float64)))[1]
    for b in np.unique(impact)[::-1]:
        here = impact == b
        ends = np.searchsorted(dimension[here], np.arange(rows.shape[1]), "right")
        yield int(b), (ends, row[here], size[here])


def best(
    queries: np.ndarray, query_ids: np.ndarray, parts: Sequence[Segment], ids: np.ndarray, k: int, least: np.ndarray | None = None
) -> tuple[list[tuple[int, int, int]], int]:
    """(query, row, score) of each query's ``k`` best rows of a block, ties to the smaller id, and the products it took.

    Rows of the query's id are left out.  A query's rows below its ``least`` score may be left out too.
    """
    n, m = len(ids), len(queries)
    width = max((len(ends) for ends, _, _ in parts), default=0)
    asked = np.zeros((m, width), np.int64)
    asked[:, : queries.shape[1]] = queries[:, :width]
    biggest = max((int(np.abs(size).max(initial=0)) for _, _, size in parts), default=0)
    exact = int(np.abs(asked).max(initial=0)) * biggest * max(width, 1) < _EXACT
    kind = np.float64 if exact else np.int64
    by_dimension = np.ascontiguousarray(asked.T.astype(kind))
    length = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    # Length and number of the components that a row has in the segments after each.
    rest, number = [np.zeros(n)], [np.zeros(n, np.int64)]
    for _, row, size in reversed(parts[1:]):
        rest.append(rest[-1] + np.bincount(row, size.astype(np.float64) ** 2, n))
        number.append(number[-1] + np.bincount(row, minlength=n))
    rest, number = rest[::-1], number[::-1]
    possible = ids[:, None] != query_ids[None, :]
    seen = np.zeros((n, m), kind)
    floor = np.full(m, -np.inf) if least is None else least.astype(np.float64)
    products, taken = 0, 0
    for (ends, row, size), left, later in zip(parts, rest, number):
        open_rows = possible.any(axis=1)
        begin = 0
        for d, end in enumerate(ends):
            where, what = row[begin:end], size[begin:end]
            begin = end
            keep = open_rows[where]
            where, what = where[keep], what[keep]
            if len(where):
                seen[where] += what[:, None].astype(kind) * by_dimension[d]
                products += len(where) * m
        taken += 1
        if not exact:
            continue
        bound = np.sqrt(left)[:, None] * length
        low = np.where(possible, seen - bound, -np.inf)
        if n > k and (low.max(axis=0) > floor).any():
            floor = np.maximum(floor, np.partition(low, n - k, axis=0)[n - k])
        possible &= seen + bound >= floor
        rows_left = possible.sum(axis=1)
        coming = parts[taken][1] if taken < len(parts) else row[:0]
        if (rows_left * later).sum() <= (rows_left[coming] > 0).sum() * m:
            break
    row, query = np.nonzero(possible)
    score = seen[row, query].astype(np.int64)
    if taken < len(parts) and len(row):
        still = np.zeros((n, width), kind)
        for ends, where, what in parts[taken:]:
            still[where, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] = what
        for at in range(0, len(row), _PAIRS):
            some = slice(at, at + _PAIRS)
            score[some] += np.einsum("ij,ij->i", still[row[some]], asked[query[some]].astype(kind)).astype(np.int64)
        products += int(number[taken - 1][row].sum())
    order = np.lexsort((ids[row], -score, query))
    row, query, score = row[order], query[order], score[order]
    first = np.searchsorted(query, query)
    top = np.arange(len(query)) - first < k
    return list(zip(query[top].tolist(), row[top].tolist(), score[top].tolist())), products


def _indexed(rows: pd.DataFrame) -> pd.DataFrame:
    """The segments of one block; its ids stand in a row of their own."""
    block, ids = int(rows["block"].iloc[0]), rows["id"].to_numpy()
    none: list[int] = []
    found = [(block, -(2**31), ids, none, none, none)]
    found += [(block, impact, none, *lists) for impact, lists in segments(_matrix(rows["v"]))]
    return pd.DataFrame(found, columns=["block", "impact", "ids", "ends", "row", "size"])


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each row where ``is_query`` holds: query_id, rank, vec_id, score.

    A component x counts as floor(scale * x).  Rows with a null id or vector, or a null or non-finite component,
    take no part; an empty vector scores 0 and a shorter one is filled with zeros.  Of rows with one id the
    one with the smallest vector counts.  A query with no other row has no result.  Scores must fit a long.
    """
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(F.col("v"), lambda c: F.floor(F.lit(scale) * c))
    rows = stage(
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"))
        .where(F.col("id").isNotNull() & x.isNotNull() & finite)
        .groupBy("id")
        .agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
        .select("id", whole.alias("v"), "is_query"),
        "topk-rows",
    )
    count = rows.count()
    index_blocks = max(1, -(-count // INDEX_BLOCK))
    query_blocks = max(1, -(-rows.where("is_query").count() // QUERY_BLOCK))
    # Blocks are dealt by a hash of the id; each query block meets each index block in a group of its own.
    block = F.pmod(F.xxhash64("id"), F.lit(index_blocks))
    index = stage(rows.select("id", "v", block.alias("block")).groupBy("block").applyInPandas(_indexed, _INDEX), "topk-index")
    asked = rows.where("is_query").select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).alias("query_block"))

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            left = left.sort_values("impact", ascending=False)
            ids, query_ids = np.concatenate(left["ids"].to_list()).astype(np.int64), right["id"].to_numpy()
            parts = [(e, r, s) for e, r, s in zip(left["ends"], left["row"], left["size"]) if len(r)]
            queries, least = _matrix(right["v"]), right["least"].fillna(-np.inf).to_numpy(np.float64)
            for at in range(0, len(queries), STRIP):
                some = slice(at, at + STRIP)
                scored, _ = best(queries[some], query_ids[some], parts, ids, k, least[some])
                found += [(int(query_ids[at + i]), int(ids[j]), score) for i, j, score in scored]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def met(pairs, asked: DataFrame) -> DataFrame:
        meet = ("block", "query_block")
        blocks = index.withColumn("query_block", every(query_blocks)).where(pairs)
        blocks_asked = asked.withColumn("block", every(index_blocks)).where(pairs)
        return blocks.groupBy(*meet).cogroup(blocks_asked.groupBy(*meet)).applyInPandas(answer, "query_id long, vec_id long, score long")

    # A query's k-th best score in its first block is the score to beat in all others.
    first_block = F.pmod(F.col("query_block"), F.lit(index_blocks)) == F.col("block")
    found = stage(met(first_block, asked.withColumn("least", F.lit(None).cast("double"))), "topk-first")
    if index_blocks > 1:
        least = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
        found = found.unionByName(met(~first_block, asked.join(least, "id", "left")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
