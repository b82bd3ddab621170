"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of words.  Their TF-IDF vectors (hashed words, frequencies counted over the steps
of all texts and of all items; the rarer of the two weighs, so that a widely leaked item keeps its weight) are projected onto the leading singular vectors of the benchmark's
passages, found by a randomised SVD whose products are sums over Spark partitions.  Items are searched by pieces of one
step, which lie whole inside some passage wherever an item begins.  A passage whose cosine with a piece is high enough,
and which holds enough of the piece's weight, makes the piece's item a candidate; the longest common subsequence with
the whole item, and with its closing words (the answer), then decides.

A passage much longer than an item drowns it, so short items are searched by shorter steps, in a space of their own.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import Block, blocks, mix, words


@dataclass(frozen=True)
class Settings:
    """A passage is two steps of words; an item takes the longest of ``steps`` that is under twice its words.

    ``buckets`` and ``rank`` are the least; both grow with the words and passages of the benchmark.
    """

    steps: tuple[int, ...] = (24, 8, 2)
    step: int = 24
    buckets: int = 1 << 14
    rank: int = 192
    extra: int = 8
    rounds: int = 2
    cosine: float = 0.4
    holds: float = 0.5
    alike: float = 0.8
    partly: float = 0.65
    answer: float = 0.6
    answer_share: float = 0.25
    item_bytes: int = 8 << 20


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLOCK = 1 << 18
#: The same characters, for the JVM.
_WORD = r"[0-9A-Za-z[^\x00-\x7F]]+"
#: Searches that one plan holds; each keeps its space in a Python worker.
_STACKED = 3
#: Tasks over one part of the items.
_TASKS = 8
#: Pieces that are compared with a block of passages at once.
_SLICE = 1 << 12


@dataclass
class Steps:
    """Words of a block in steps: hash and owner of each word, first word and owner of each step."""

    hashes: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    of: np.ndarray

    def number(self) -> np.ndarray:
        """The step of each word."""
        return np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.hashes))))

    def after(self) -> np.ndarray:
        """Per step, the number of the following step of the same text, or its own."""
        n = len(self.first)
        following = np.minimum(np.arange(n) + 1, max(n - 1, 0))
        return np.where(self.of[following] == self.of, following, np.arange(n))


def steps(block: Block, step: int) -> Steps:
    _, _, owner, hashes = words(block, inside=_INSIDE)
    count = np.bincount(owner, minlength=len(block.bounds) - 1)
    start = np.repeat(np.cumsum(count) - count, count)
    first = np.flatnonzero((np.arange(len(owner)) - start) % step == 0)
    return Steps(hashes, owner, first, owner[first])


def _bucket(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    return (mix(hashes, 21) & np.uint64(settings.buckets - 1)).astype(np.int64)


def _summed(weights: np.ndarray, row: np.ndarray, found: Steps, settings: Settings) -> np.ndarray:
    """Sum of the weight rows of the words of each step; words without a row are passed over."""
    ids = row[_bucket(found.hashes, settings)]
    used = np.flatnonzero(ids >= 0)
    out = np.zeros((len(found.first), weights.shape[1]), weights.dtype)
    if len(used):
        ids, count = ids[used], np.bincount(found.number()[used], minlength=len(out))
        # The first words of all steps, then all second ones, and so on; the steps with most words lead.
        order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        at, fewer = (np.cumsum(count) - count)[order], -count[order]
        total = weights[ids[at]]
        for k in range(1, -fewer[0]):
            left = np.searchsorted(fewer, -k)
            total[:left] += weights[ids[at[:left] + k]]
        out[order] = total
    return out


def passages(weights: np.ndarray, row: np.ndarray, found: Steps, settings: Settings) -> np.ndarray:
    """One vector per step: the step and the one after it; ``row`` gives the row of weights of a bucket, or -1."""
    one = _summed(weights, row, found, settings)
    after = found.after()
    return one + np.where((after != np.arange(len(after)))[:, None], one[after], 0)


def frequencies(docs: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """In how many steps of all texts each bucket occurs, and the number of steps."""
    width = settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for block in blocks(batch.column(0), _BLOCK):
                found = steps(block, settings.step)
                which = found.number()
                pairs = np.sort(which * width + _bucket(found.hashes, settings))
                pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)]]
                counts += np.bincount(pairs % width, minlength=width)
                n += len(found.first)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], names=["bucket", "n"])

    rows = docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    found = {r[0]: r[1] for r in rows}
    out = np.zeros(width, np.int64)
    for bucket, n in found.items():
        if bucket >= 0:
            out[bucket] = n
    return out, found.get(-1, 0)


def latent_space(texts: DataFrame, idf: np.ndarray, row: np.ndarray, settings: Settings) -> np.ndarray:
    """Leading right singular vectors (rows x rank) of the TF-IDF passages of ``texts`` (one column).

    ``idf`` has a weight per row, ``row`` the row of a bucket or -1.  A randomised range finder: each round
    multiplies by the plain and the transposed matrix, as a sum over partitions whose size does not grow with the
    number of passages.
    """
    width = min(settings.rank + settings.extra, len(idf))
    basis = np.random.RandomState(7).standard_normal((len(idf), width))

    def product(now: np.ndarray, square: bool) -> np.ndarray:
        weighted = (idf[:, None] * now).astype(np.float32)
        shape = (width, width) if square else now.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for block in blocks(batch.column(0), _BLOCK):
                    found = steps(block, settings.step)
                    if not len(found.first):
                        continue
                    vectors = passages(weighted, row, found, settings)
                    if square:
                        total += vectors.T.astype(np.float64) @ vectors
                        continue
                    # A word adds its passages' vectors: that of its step and of the step before.
                    before = np.zeros_like(vectors)
                    after = found.after()
                    linked = after != np.arange(len(after))
                    before[after[linked]] = vectors[linked]
                    ids = row[_bucket(found.hashes, settings)]
                    np.add.at(total, ids[ids >= 0], (vectors + before)[found.number()[ids >= 0]])
            for i in range(0, len(total), 1024):
                part = total[i : i + 1024]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": rows["at"][:1], "part": [np.sum([np.frombuffer(p) for p in rows["part"]], axis=0).tobytes()]})

        out = np.zeros(shape)
        for at, part in texts.mapInArrow(run, "at long, part binary").groupBy("at").applyInPandas(add, "at long, part binary").collect():
            found = np.frombuffer(bytes(part)).reshape(-1, width)
            out[at : at + len(found)] = found
        return out if square else idf[:, None] * out

    for _ in range(settings.rounds):
        basis, _ = np.linalg.qr(product(basis, False))
    values, turn = np.linalg.eigh(product(basis, True))
    kept = np.argsort(-values)[: settings.rank]
    return basis @ turn[:, kept[values[kept] > 1e-9 * values.max(initial=1e-300)]]


def pieces(n: int, step: int) -> list[tuple[int, int]]:
    """Word ranges of an item of ``n`` words: every full step, and the last ``step`` words if some are left."""
    starts = list(range(0, n - step + 1, step)) or [0]
    if n > step and n % step:
        starts.append(n - step)
    return [(a, min(a + step, n)) for a in starts]


def common_run(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence: one bit per word of the item, one step per word of the region."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    state = full
    for word in region:
        hit = state & masks.get(word, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return len(item) - state.bit_count()


def judged(item: list[int], region: list[int], settings: Settings) -> tuple[float, bool]:
    """Share of the item that the region holds in order, and whether that or its closing words make a leak."""
    whole = common_run(item, region) / len(item)
    if whole >= settings.alike or whole < settings.partly:
        return whole, whole >= settings.alike
    tail = max(1, int(len(item) * settings.answer_share))
    return whole, common_run(item[-tail:], region) / tail >= settings.answer


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_key: str = "item_id",
    item_text: str = "text",
    keep: tuple[str, ...] | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """The ``keep`` columns (default: all) with ``contaminated``, ``leaked_item`` and ``leaked_share``.

    A document is contaminated if it holds ``alike`` of an item's words in order, or ``partly`` of them and
    ``answer`` of the closing words.  ``leaked_item`` is the item of which it holds the largest share (ties: the
    smallest id), among the items that its passages resemble.  Null and wordless texts are clean, null and
    wordless items are ignored.  A benchmark beyond ``item_bytes`` is searched in parts, each with its own space.
    """
    names = ["contaminated", "leaked_item", "leaked_share"]
    kept = [c for c in (keep or docs.columns) if c not in names]
    # A text that is kept is not sent twice.
    column, extra = (text, []) if text in kept else ("__text", [F.col(text).alias("__text")])
    found = docs.select(
        *kept,
        *extra,
        F.lit(False).alias("contaminated"),
        F.lit(None).cast("long").alias("leaked_item"),
        F.lit(0.0).alias("leaked_share"),
    )
    n_words = F.size(F.regexp_extract_all("text", F.lit(_WORD), 0))
    scales = sorted(settings.steps, reverse=True)
    step = F.coalesce(*[F.when(2 * F.col("words") > s, s) for s in scales], F.lit(scales[-1]))
    items = benchmark.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    items = stage(items.withColumn("words", n_words).where("words > 0").withColumn("step", step), "items")
    sizes = items.groupBy("step").agg(F.sum(F.octet_length("text")).alias("size"), F.sum("words").alias("words")).collect()

    searches = 0
    for scale in sorted(sizes, key=lambda r: -r.step):
        here = items.where(F.col("step") == scale.step)
        width = max(settings.buckets, 1 << (2 * min(scale.words, settings.item_bytes // 4) - 1).bit_length())
        now = replace(settings, step=scale.step, buckets=width)
        seen, n = frequencies(docs.select(F.col(text)), now)
        parts = -(-scale.size // settings.item_bytes)
        for part in range(parts):
            of_part = here.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "text")
            if searches and searches % _STACKED == 0:
                found = stage(found, "searched")
            # Each search improves on what those before it found.
            found = _searched(found, column, of_part, seen, n, now)
            searches += 1
    return found.select(*kept, *names)


def _space(items: DataFrame, seen: np.ndarray, n: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weighted vector of each used bucket in the space of these items, and the vector's row (or -1) of every bucket."""
    # At most ``item_bytes``; each task adds a matrix to the sums, and these meet.
    items = items.coalesce(_TASKS).select("text")
    in_items, m = frequencies(items, settings)
    # A leak makes an item's words common in the texts, but not among the items.
    idf = np.maximum(np.log((n + 1.0) / (seen + 1.0)), np.log((m + 1.0) / (in_items + 1.0))) + 1e-3
    used = np.flatnonzero(in_items > 0)
    row = np.full(settings.buckets, -1, np.int32)
    row[used] = np.arange(len(used))
    settings = replace(settings, rank=max(settings.rank, 2 * isqrt(m)))
    return (idf[used][:, None] * latent_space(items, idf[used], row, settings)).astype(np.float32), row


def _searched(rows: DataFrame, column: str, items: DataFrame, seen: np.ndarray, n: int, settings: Settings) -> DataFrame:
    weights, row = _space(items, seen, n, settings)
    numbers, contents, vectors, owners = [], [], [], []
    # One part of the items, of at most about ``item_bytes``.
    for number, words_of in sorted(map(tuple, items.collect())):
        for block in blocks(pa.array([words_of], pa.string())):
            found = steps(block, settings.step)
            if len(found.hashes):
                ids = row[_bucket(found.hashes, settings)]
                for a, b in pieces(len(ids), settings.step):
                    own = ids[a:b]
                    vectors.append(weights[own[own >= 0]].sum(axis=0))
                    owners.append(len(numbers))
                numbers.append(number)
                contents.append(found.hashes.tolist())
    targets = np.array(vectors, np.float32).reshape(len(owners), weights.shape[1])
    owner = np.array(owners, np.int64)
    length = np.maximum(np.linalg.norm(targets, axis=1), 1e-9)
    # The lightest piece first: a passage cannot hold enough of a piece that is much heavier than itself.
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 1e-6]
    owner, length = owner[order], length[order]
    directions = np.ascontiguousarray((targets[order] / length[:, None]).T)
    carried = rows.columns[:-3]
    sent = rows.sparkSession.sparkContext.broadcast((weights, row, numbers, contents, owner, length, directions))

    def resembling(latent: np.ndarray) -> list[tuple[int, int]]:
        """Passages and the items that they may hold, each pair once."""
        _, _, numbers, _, owner, length, directions = sent.value
        size = np.linalg.norm(latent, axis=1)
        pairs = []
        for at in range(0, len(owner), _SLICE):
            part = slice(at, at + _SLICE)
            some = np.flatnonzero(size >= settings.holds * length[at])
            shown = latent[some] @ directions[:, part]
            s, t = np.nonzero((shown >= settings.holds * length[part]) & (shown >= settings.cosine * size[some][:, None]))
            pairs.append(some[s] * len(numbers) + owner[part][t])
        return [divmod(int(x), len(numbers)) for x in np.unique(np.concatenate(pairs))] if pairs else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, row, numbers, contents, *_ = sent.value
        for batch in batches:
            bad = batch.column("contaminated").to_numpy(zero_copy_only=False).copy()
            share = batch.column("leaked_share").to_numpy().copy()
            item = batch.column("leaked_item").to_pylist()
            for block in blocks(batch.column(column), _BLOCK):
                here = steps(block, settings.step)
                if not len(here.first) or not numbers:
                    continue
                ends = np.append(here.first, len(here.hashes))
                text_ends = np.searchsorted(here.owner, np.arange(len(block.bounds)))
                seen = set()
                for s, i in resembling(passages(weights, row, here, settings)):
                    d = here.of[s]
                    reach = max(settings.step, len(contents[i]))
                    lo = max(text_ends[d], ends[s] - reach)
                    hi = min(text_ends[d + 1], ends[s] + 2 * settings.step + reach)
                    # Nothing is left to find in the same words again, or once a document holds all of an item.
                    if (d, i) in seen or (lo, hi, i) in seen:
                        continue
                    whole, leak = judged(contents[i], here.hashes[lo:hi].tolist(), settings)
                    seen.add((d, i) if whole == 1 else (lo, hi, i))
                    at = block.rows.start + d
                    bad[at] |= leak
                    if whole > share[at] or (whole == share[at] and item[at] is not None and numbers[i] < item[at]):
                        share[at], item[at] = whole, numbers[i]
            columns = [*[batch.column(c) for c in carried], pa.array(bad), pa.array(item, pa.int64()), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "contaminated", "leaked_item", "leaked_share"])

    return rows.mapInArrow(run, rows.schema)
