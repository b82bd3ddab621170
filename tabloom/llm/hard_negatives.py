"""Hard negatives by exact search in cover trees over norm-augmented vectors.

Vectors are quantised to whole numbers and one component is added to each, so that all have the same length; then
the angle between a query and a row alone decides their inner product.  Each block of rows keeps one cover tree for
each label: a node's rows lie within its covering radius, and radii at least halve from level to level.  A
node's centre and radius bound every inner product below it.  A search goes down best-first: it opens the nodes with the
largest upper bounds, skips those whose bounds lie outside every window still wanted, and scores the rows of
leaves exactly.
"""
from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import stage

#: Rows of the index in a block, and anchors in a block.
INDEX_BLOCK, ANCHOR_BLOCK = 4096, 1024
#: Rows below which a node is a leaf, and nodes opened at a time.
LEAF, OPENED = 24, 256
#: Sums of products below this are exact in a double.
_EXACT = 2**53


@dataclass
class Trees:
    """The cover trees of a block, flat: nodes by level, children side by side, the rows of a leaf side by side."""

    ids: np.ndarray  # of the rows, in the order of the leaves
    rows: np.ndarray  # whole numbers, in that order
    centre: np.ndarray  # row of a node's centre
    radius: np.ndarray  # largest distance, between augmented vectors, of the centre to a row below the node
    first: np.ndarray  # first child, or first row of a leaf
    count: np.ndarray  # children, or rows of a leaf
    leaf: np.ndarray
    roots: np.ndarray  # node of each label's tree
    labels: np.ndarray  # label of each root
    length: np.ndarray  # common length of the augmented vectors

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Trees:
        with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
            return Trees(**{k: arrays[k] for k in arrays.files})


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows; a shorter one is filled with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def augmented(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """The rows with a component that brings each to the largest length there is, and that length."""
    square = (rows.astype(np.float64) ** 2).sum(axis=1)
    most = square.max(initial=0.0)
    return np.column_stack([rows, np.sqrt(most - square)]), float(np.sqrt(most))


def plant(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Trees:
    """One cover tree for each label of a block."""
    points, length = augmented(rows)
    centre, radius, first, count, leaf, order = [], [], [], [], [], []
    names = np.unique(labels)
    queue: list[tuple[np.ndarray, np.ndarray]] = []  # rows below a node, its centre first, and their distances from it
    for label in names:
        below = np.flatnonzero(labels == label)
        queue.append((below, np.linalg.norm(points[below] - points[below[0]], axis=1)))
    at = 0
    while at < len(queue):
        below, away = queue[at]
        queue[at] = (below[:1], away[:1])
        at += 1
        r = away.max()
        centre.append(below[0])
        radius.append(r)
        if r == 0 or len(below) <= LEAF:
            leaf.append(True)
            first.append(len(order))
            count.append(len(below))
            order.extend(below)
            continue
        leaf.append(False)
        first.append(len(queue))
        # Centres more than half the radius apart cover everything; the node's own centre goes on as one of them.
        begun = len(queue)
        while len(below):
            near = away <= r / 2
            queue.append((below[near], away[near]))
            below = below[~near]
            if len(below):
                away = np.linalg.norm(points[below] - points[below[0]], axis=1)
        count.append(len(queue) - begun)
    order = np.array(order, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    whole = lambda x: np.array(x, np.int64)
    return Trees(ids[order], rows[order], place[whole(centre)], np.array(radius), whole(first), whole(count), np.array(leaf), np.arange(len(names)), names, np.array(length))


def _products(q: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products with whole numbers; beyond the doubles' exact range as Python integers."""
    if exact:
        return rows @ q
    return rows.astype(object) @ q.astype(object)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def search(trees: Trees, q: np.ndarray, roots: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, without: int | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window [low, high] the ``k`` best rows (ids, scores) among the trees at ``roots``, and the rows scored.

    Higher scores come first, ties by smaller id; the id ``without`` is left out.
    """
    width = max(len(q), trees.rows.shape[1])
    q = np.pad(q, (0, width - len(q)))
    rows = np.pad(trees.rows, ((0, 0), (0, width - trees.rows.shape[1])))
    exact = int(np.abs(q).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(width, 1) < _EXACT
    if exact:
        q, rows = q.astype(np.float64), rows.astype(np.float64)
    norm, length = float(np.sqrt((q.astype(np.float64) ** 2).sum())), float(trees.length)
    slack = 1e-9 * norm * length + 1e-6
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.float64 if exact else object)) for _ in low]
    floor = low.astype(np.float64) if exact else low.astype(object)
    scored = 0

    def bounds(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of the rows below nodes, from the angles to their centres and their radii."""
        nonlocal scored
        scored += len(nodes)
        centre = _products(q, rows[trees.centre[nodes]], exact).astype(np.float64)
        if norm * length == 0:
            return centre, centre
        to_centre = np.arccos(np.clip(centre / (norm * length), -1, 1))
        reach = 2 * np.arcsin(np.clip(trees.radius[nodes] / (2 * length), 0, 1))
        most = norm * length * np.cos(np.maximum(to_centre - reach, 0))
        least = norm * length * np.cos(np.minimum(to_centre + reach, np.pi))
        spread = norm * trees.radius[nodes]
        return np.maximum(least, centre - spread) - slack, np.minimum(most, centre + spread) + slack

    nodes = roots
    least, most = bounds(nodes)
    while len(nodes) and len(low):
        wanted = ((most[:, None] >= floor.astype(np.float64)) & (least[:, None] <= high.astype(np.float64))).any(axis=1)
        nodes, least, most = nodes[wanted], least[wanted], most[wanted]
        if not len(nodes):
            break
        if len(nodes) > OPENED:
            top = np.argpartition(most, len(nodes) - OPENED)[-OPENED:]
        else:
            top = np.arange(len(nodes))
        opened = nodes[top]
        keep = np.ones(len(nodes), bool)
        keep[top] = False
        nodes, least, most = nodes[keep], least[keep], most[keep]
        is_leaf = trees.leaf[opened]
        leaves, inner = opened[is_leaf], opened[~is_leaf]
        if len(leaves):
            at = _ranges(trees.first[leaves], trees.count[leaves])
            found, ids = _products(q, rows[at], exact), trees.ids[at]
            scored += len(at)
            if without is not None:
                found, ids = found[ids != without], ids[ids != without]
            for j in range(len(low)):
                inside = (found >= floor[j]) & (found <= high[j])
                if not inside.any():
                    continue
                all_ids, scores = np.concatenate([best[j][0], ids[inside]]), np.concatenate([best[j][1], found[inside]])
                order = np.lexsort((all_ids, -scores)) if exact else np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], all_ids[i])))
                order = order[:k]
                best[j] = (all_ids[order], scores[order])
                if len(order) == k:
                    floor[j] = max(floor[j], scores[order[-1]])
        if len(inner):
            children = _ranges(trees.first[inner], trees.count[inner])
            down, up = bounds(children)
            nodes, least, most = np.concatenate([nodes, children]), np.concatenate([least, down]), np.concatenate([most, up])
    return best, scored


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    shares: tuple[int, int] = (30, 90),
    scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its positives, the hardest rows of other labels in a window of scores.

    A component x counts as floor(scale * x); a score is the integer inner product with the anchor; higher scores come
    first, ties by smaller id.  An anchor's positives are its first ``positives`` other rows of its label (all, if fewer).  Its
    negatives for a positive are the first ``negatives`` rows of other labels (all, if fewer) with shares[0] *
    positive score <= 100 * score <= shares[1] * positive score.  Columns: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or a null or non-finite component take no part; an empty vector scores 0 and a
    shorter one is filled with zeros.  Of rows with one id the one with the smallest (vector, label) counts.
    An anchor without another row of its label, or whose window is empty, has no rows; so has an empty table.
    """
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), label.alias("g"), is_anchor.alias("a"))
    one = given.where(F.col("id").isNotNull() & F.col("g").isNotNull() & x.isNotNull() & finite).groupBy("id").agg(F.min(F.struct("v", "g", "a")).alias("r"))
    rows = stage(one.select("id", F.transform("r.v", lambda c: F.floor(F.lit(scale) * c)).alias("v"), F.col("r.g").cast("string").alias("g"), F.col("r.a").alias("a")), "negatives-rows")
    anchors = rows.where("a")
    index_blocks = max(1, -(-rows.count() // INDEX_BLOCK))
    anchor_blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))

    def grow(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        trees = plant(block["id"].to_numpy(), matrix(block["v"]), block["g"].to_numpy().astype(str))
        return pd.DataFrame({"block": [int(block["block"].iloc[0])], "trees": [trees.dump()]})

    # Blocks are dealt by a hash of the id, so copies of one vector and rows of one label spread evenly.
    blocks = rows.select("id", "v", "g", F.pmod(F.xxhash64("id"), F.lit(index_blocks)).alias("block"))
    forest = stage(blocks.groupBy("block").applyInPandas(grow, "block long, trees binary"), "negatives-trees")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    meet = ("block", "part")
    indexed = forest.withColumn("part", every(anchor_blocks)).groupBy(*meet)
    asked = anchors.select("id", "v", "g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(anchor_blocks)).alias("part"))

    def alike(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            trees = Trees.load(left["trees"].iloc[0])
            everything = (np.array([-np.inf]), np.array([np.inf]))
            for anchor, q, g in zip(right["id"], matrix(right["v"]), right["g"]):
                best, _ = search(trees, q, trees.roots[trees.labels == g], *everything, positives, int(anchor))
                found += [(anchor, i, int(s)) for i, s in zip(*best[0])]
        return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")

    near = indexed.cogroup(asked.withColumn("block", every(index_blocks)).groupBy(*meet)).applyInPandas(alike, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    # Windows beside each anchor: as many as it has positives.
    chosen = near.withColumn("place", place).where(F.col("place") <= positives)
    windows = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("w"))
    windowed = stage(asked.join(windows, F.col("id") == F.col("anchor_id")).select("id", "v", "g", "part", "w"), "negatives-windows")

    def other(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            trees = Trees.load(left["trees"].iloc[0])
            for anchor, q, g, w in zip(right["id"], matrix(right["v"]), right["g"], right["w"]):
                low, high = np.array([[-(-shares[0] * p["positive_score"] // 100), shares[1] * p["positive_score"] // 100] for p in w], dtype=object).T
                best, _ = search(trees, q, trees.roots[trees.labels != g], low, high, negatives)
                for p, (ids, scores) in zip(w, best):
                    found += [(anchor, p["positive_id"], p["positive_score"], i, int(s)) for i, s in zip(ids, scores)]
        return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    each = indexed.cogroup(windowed.withColumn("block", every(index_blocks)).groupBy(*meet)).applyInPandas(other, schema)
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
