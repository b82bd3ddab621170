"""Removal of byte strings that an earlier document holds, by interval expansion on Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``least`` bytes that also starts in a document with a smaller id.

1. Texts are cut where their content says so.  A chunk, with the bytes that strings starting in it reach,
   which an earlier document has too settles all strings that start in it; copies end here.  The first
   document that has a string never has it settled, so what is left still holds every string's first place.
2. Equal strings share their minimizer, the least hash of their short pieces.  Pieces that only one
   document has are dropped; the others' surroundings, the segments, are grouped by minimizer.
3. For the distinct segments of some minimizers together, a suffix array bounded in depth gives the transform,
   and breadth-first backward extension of its intervals derives the common prefixes by increasing length,
   stopping at ``least``.  What is still joined then are equal strings, and the smallest id keeps them.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import _ODD, attach, blocks, grams, mix
from .ngram_join import _shared

GRAM = 16
#: One place in so many begins a chunk.
CHUNK = 128
#: Bytes of segments that one transform holds, and distinct segments of one minimizer that a task holds before they are dealt anew by longer pieces.
GROUP_BYTES, GROUP_SEGMENTS = 1 << 19, 1 << 14
#: Bytes of segments of whole minimizers that a task holds before it compares their strings.
HELD_BYTES = 1 << 23


# ---- one text -----------------------------------------------------------------------------------------------------


def chunks(hashes: np.ndarray, size: int, least: int) -> np.ndarray:
    """Starts of the chunks of a text's string starts (0 to size - least)."""
    n = size - least + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    cut = (hashes[:n] & np.uint64(CHUNK - 1)) == 0
    cut[1:] &= ~cut[:-1].copy()
    cut[0] = True
    return np.flatnonzero(cut)


def chunk_hashes(data: bytes, starts: np.ndarray, least: int) -> np.ndarray:
    """128-bit hashes, as two numbers, of the chunks with the bytes that their strings reach."""
    ends = np.append(starts[1:], len(data) - least + 1) + least - 1
    found = [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def minimizers(hashes: np.ndarray, size: int, least: int, gram: int = GRAM) -> np.ndarray:
    """Per string start, the least hash of the short pieces of the string."""
    n, width = size - least + 1, least - gram + 1
    now, reach = hashes[: n + width - 1], 1
    while reach * 2 <= width:
        now = np.minimum(now[:-reach], now[reach:])
        reach *= 2
    return np.minimum(now[:n], now[width - reach : width - reach + n])


def open_starts(data: bytes, hashes: np.ndarray, settled: np.ndarray, least: int) -> np.ndarray:
    """Which string starts lie in no settled chunk."""
    out = np.ones(max(0, len(data) - least + 1), bool)
    if len(settled) and len(out):
        starts = chunks(hashes, len(data), least)
        done = np.isin(chunk_hashes(data, starts, least)[:, 0], settled)
        out = ~np.repeat(done, np.diff(np.append(starts, len(out))))
    return out


def _each(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Row, bytes and piece hashes of every text."""
    for block in blocks(batch.column(column)):
        hashes = grams(block.data, GRAM)
        whole = block.data.tobytes()
        for i in range(len(block.bounds) - 1):
            lo, hi = int(block.bounds[i]), int(block.bounds[i + 1])
            yield block.rows.start + i, whole[lo:hi], hashes[lo : max(lo, hi - GRAM + 1)]


# ---- one group of segments ----------------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by doubling; symbols are below 512."""
    n, reach = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(reach, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(reach):
        key = key << 9 | padded[i : n + i]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        if reach >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: max(0, n - reach)] += rank[reach:] + 1
        reach *= 2


def common_prefixes(transform: np.ndarray, least: int) -> np.ndarray:
    """Common prefix length of each suffix with the one before it, where below ``least``; else -1.

    ``transform`` holds the symbol before each suffix in suffix order.  Symbol 0 is an end mark: marks are all
    different, so no prefix reaches over one.  The intervals of all strings of one length are extended backward
    by one symbol at a time; an interval's end that is seen for the first time has the current length as its
    common prefix.
    """
    n = len(transform)
    back = np.empty(n, np.int64)
    back[np.argsort(transform.astype(np.int16), kind="stable")] = np.arange(n)
    found = np.full(n + 1, -1, np.int64)
    # Strings of one symbol, end marks each by itself.
    counts = np.bincount(transform)
    lo = np.concatenate([np.arange(counts[0]), np.cumsum(counts)[:-1][counts[1:] > 0]])
    hi = np.append(lo[1:], n)
    found[lo] = 0
    found[n] = 0
    for length in range(1, least):
        if not len(lo):
            break
        single = hi - lo == 1
        at = lo[single]
        at = back[at[transform[at] > 0]]
        new_lo, new_hi = [at], [at + 1]
        lo, hi = lo[~single], hi[~single]
        if len(lo):
            size = hi - lo
            which = np.repeat(np.arange(len(lo)), size)
            places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            symbol = transform[places]
            inner = symbol > 0
            key, places = which[inner] * 512 + symbol[inner], places[inner]
            # Rows of one symbol keep their order, so the first leads to the begin of the new interval.
            order = np.argsort(key, kind="stable")
            key, places = key[order], places[order]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
            count = np.diff(np.append(begin, len(key)))
            new_lo.append(back[places[begin]])
            new_hi.append(back[places[begin]] + count)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = found[hi] < 0
        lo, hi = lo[fresh], hi[fresh]
        found[hi] = length
    return found[:n]


def repeated(segments: list[bytes], ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and start, in that order, of every string of ``least`` bytes that a segment with a smaller id has too."""
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    symbols = np.zeros(n, np.int64)
    inner = np.ones(n, bool)
    inner[ends] = False
    symbols[inner] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    order = suffix_array(symbols, least)
    same = common_prefixes(symbols[order - 1], least) < 0
    group = np.cumsum(~same) - 1
    owner = np.repeat(np.arange(len(segments)), sizes + 1)[order]
    begin = np.concatenate(([0], ends[:-1] + 1))
    # The smallest id of a group: its rows are side by side.
    smallest = np.minimum.reduceat(ids[owner], np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    gone = np.flatnonzero(smallest[group] < ids[owner])
    found, start = owner[gone], order[gone] - begin[owner[gone]]
    sorted_ = np.lexsort((start, found))
    return found[sorted_], start[sorted_]


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all byte strings of ``size``, by start."""
    whole = size // 8 * 8
    out = grams(data, whole)[: max(0, len(data) - size + 1)]
    for at in range(whole, size):
        out = mix(out ^ data[at : at + len(out)].astype(np.uint64) * _ODD)
    return out


def candidates(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
    """Which of the segments (``bounds`` in ``data``) hold a string that seems to occur under another id, by a hash of it."""
    hashes = string_hashes(data, least)
    starts = np.zeros(len(data) + 1, np.int64)
    np.add.at(starts, bounds[:-1], 1)
    np.add.at(starts, bounds[1:] - least + 1, -1)
    at = np.flatnonzero(np.cumsum(starts[: len(hashes)]) > 0)
    owner = np.searchsorted(bounds, at, "right") - 1
    order = np.argsort(hashes[at])
    h, owner = hashes[at][order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    own = ids[owner]
    several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    out = np.zeros(len(ids), bool)
    out[owner[np.repeat(several, np.diff(np.append(first, len(h))))]] = True
    return out


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


# ---- all texts ----------------------------------------------------------------------------------------------------


def _settled(docs: DataFrame, least: int) -> DataFrame:
    """Per text, the chunks (first half of the hash) that an earlier document has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], [np.zeros((0, 2), np.int64)]
            for i, data, hashes in _each(batch, "text"):
                if len(data) >= least:
                    found.append(chunk_hashes(data, chunks(hashes, len(data), least), least))
                    rows.append(np.full(len(found[-1]), i))
            at, both = pa.array(np.concatenate([np.zeros(0, np.int64), *rows])), np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column("doc_id").take(at), batch.column("mark").take(at)],
                names=["a", "b", "doc_id", "mark"],
            )

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by chunk and document, those that come after the chunk's first document."""
        last = np.zeros(3, np.int64)
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, doc = (batch.column(i).to_numpy() for i in range(3))
            new = np.concatenate(([not begun or a[0] != last[0] or b[0] != last[1]], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            at = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            first = np.where(at >= 0, doc[np.maximum(at, 0)], last[2])
            last, begun = np.array([a[-1], b[-1], first[-1]]), True
            keep = pa.array(doc > first)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 2, 3)], names=["a", "doc_id", "mark"])

    found = docs.mapInArrow(cut, "a long, b long, doc_id long, mark long")
    done = found.repartition("a").sortWithinPartitions("a", "b", "doc_id").mapInArrow(later, "a long, doc_id long, mark long")
    return stage(done.groupBy("doc_id", "mark").agg(F.collect_set("a").alias("settled")), "settled")


def _pieces(docs: DataFrame, least: int) -> DataFrame:
    """The minimizers of the open strings of each document, once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, settled = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("settled")
            rows, keys = [], []
            for i, data, hashes in _each(batch, "text"):
                if len(data) < least:
                    continue
                free = open_starts(data, hashes, np.array(settled[i].as_py() or (), np.int64), least)
                if free.any():
                    some = minimizers(hashes, len(data), least)[free]
                    # Neighbouring strings mostly share their minimizer.
                    some = np.unique(some[np.concatenate(([True], some[1:] != some[:-1]))])
                    keys.append(some.view(np.int64))
                    rows.append(np.full(len(some), ids[i]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rows))], names=["key", "doc_id"])

    return docs.mapInArrow(run, "key long, doc_id long")


def _segments(docs: DataFrame, least: int) -> DataFrame:
    """Per run of open strings with one minimizer that seems shared: the bytes they cover and where they start.

    The shared minimizers of a document come as the low 32 bits; a minimizer that is taken for shared by mistake
    meets no other document later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, starts, bytes_ = [], [], [], []
            for i, data, hashes in _each(batch, "text"):
                if len(data) < least:
                    continue
                free = open_starts(data, hashes, np.array(batch.column("settled")[i].as_py() or (), np.int64), least)
                mine = minimizers(hashes, len(data), least).view(np.int64)
                use = free & np.isin(mine.astype(np.int32), np.array(batch.column("keys")[i].as_py() or (), np.int32))
                at = np.flatnonzero(use)
                if not len(at):
                    continue
                new = np.concatenate(([True], (np.diff(at) > 1) | (mine[at[1:]] != mine[at[:-1]])))
                begin = at[new]
                last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
                rows += [i] * len(begin)
                keys += mine[begin].tolist()
                starts += begin.tolist()
                bytes_ += [data[s : e + least] for s, e in zip(begin.tolist(), last.tolist())]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(bytes_, pa.binary())],
                names=["doc_id", "mark", "key", "start", "segment"],
            )

    return docs.mapInArrow(run, "doc_id long, mark long, key long, start int, segment binary")


_RANGES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("segment", pa.binary())])


def _ranges(doc: np.ndarray, mark: np.ndarray, lo: np.ndarray, hi: np.ndarray, segment: pa.Array | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.binary()) if segment is None else segment
    columns = [pa.array(doc), pa.array(mark), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), none]
    return pa.RecordBatch.from_arrays(columns, schema=_RANGES)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each value begins and ends."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _transformed(rows: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """Ranges of the rows (sorted by key, segment, document; no segment under a larger document twice) that others hold.

    Segments none of whose strings occurs elsewhere, by a hash, are left out; the others of some minimizers together make one
    transform.
    """
    key, doc, mark, start = (rows.column(c).to_numpy() for c in ("key", "doc_id", "mark", "start"))
    segment = rows.column("segment")
    new = np.concatenate(([True], (key[1:] != key[:-1]) | pc.not_equal(segment.slice(1), segment.slice(0, len(segment) - 1)).to_numpy(zero_copy_only=False)))
    distinct = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    some = segment.take(pa.array(distinct))
    wanted = candidates(*_bytes_of(some), doc[distinct], least)
    chosen = np.flatnonzero(wanted)
    # Transforms end between minimizers.
    sizes = np.diff(_bytes_of(some)[1])[chosen]
    part = np.cumsum(sizes) // GROUP_BYTES
    keys = key[distinct[chosen]]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    part = np.repeat(part[begins], np.diff(np.append(begins, len(keys))))
    by_segment = np.concatenate((distinct, [len(which)]))
    for group in np.split(chosen, np.flatnonzero(part[1:] != part[:-1]) + 1):
        if not len(group):
            continue
        owner, at = repeated(some.take(pa.array(group)).to_pylist(), doc[distinct[group]], least)
        if not len(owner):
            continue
        fresh = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + least))))
        lo, hi, owner = at[fresh], at[np.append(fresh[1:] - 1, len(at) - 1)] + least, group[owner[fresh]]
        # Every row with the segment has the range.
        times = (by_segment[owner + 1] - by_segment[owner]).astype(np.int64)
        row = np.repeat(by_segment[owner] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        lo, hi = np.repeat(lo, times), np.repeat(hi, times)
        yield _ranges(doc[row], mark[row], start[row] + lo, start[row] + hi)


def _expanded(segments: DataFrame, least: int) -> DataFrame:
    """Ranges of texts that smaller documents have, from segments sorted by minimizer, bytes and document.

    Each task reads its minimizers one after the other, whole batches at a time.  A segment that a smaller document has goes
    whole and is not kept; minimizers with several distinct segments go through transforms.  A minimizer with more
    distinct segments than ``GROUP_SEGMENTS`` is passed on as it is (``segment`` not null), to be dealt anew in smaller groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None  # rows of the last minimizer so far; of a crowded one only its last segment
        crowded: int | None = None
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                yield from _transformed(pa.Table.from_batches(held).combine_chunks().to_batches()[0], least)
                held.clear()
                size = 0

        def take(batch: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal carry, crowded, size
            told = carry.num_rows if carry is not None and crowded is not None else 0
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            segment = batch.column("segment")
            n = len(key)
            other = pc.not_equal(segment.slice(1), segment.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | other))
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            later = doc > doc[first]
            mark, start = batch.column("mark").to_numpy(), batch.column("start").to_numpy().astype(np.int64)
            length = pc.binary_length(segment).to_numpy().astype(np.int64)
            if later.any():
                yield _ranges(doc[later], mark[later], start[later], start[later] + length[later])
            stays = ~later
            if crowded is not None:
                here = stays & (key == crowded)
                here[:told] = False
                if here.any():
                    yield _ranges(doc[here], mark[here], start[here], start[here] + length[here], segment.filter(pa.array(here)))
            # Distinct segments of each minimizer.
            number = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
            distinct = np.bincount(number, weights=new)
            open_ = np.zeros(n, bool) if last else number == number[-1]
            use = stays & ~open_ & (distinct[number] > 1)
            if crowded is not None:
                use &= key != crowded
            if use.any():
                held.append(batch.filter(pa.array(use)))
                size += int(length[use].sum())
            if last:
                return
            tail = stays & open_
            if crowded is not None and key[-1] != crowded:
                crowded = None
            if crowded is None and distinct[-1] > GROUP_SEGMENTS:
                crowded = int(key[-1])
                yield _ranges(doc[tail], mark[tail], start[tail], start[tail] + length[tail], segment.filter(pa.array(tail)))
            if crowded is not None:
                tail &= first == first[-1]
            carry = batch.filter(pa.array(tail))

        for batch in batches:
            if batch.num_rows:
                yield from take(batch, False)
                if size >= HELD_BYTES:
                    yield from flush()
        if carry is not None:
            rest, carry = carry, None
            if crowded is None:
                yield from take(rest, True)
        yield from flush()

    order = ["key", "segment", "doc_id"]
    arranged = segments.select("key", "segment", "doc_id", "mark", "start").repartition("key").sortWithinPartitions(*order)
    return arranged.mapInArrow(run, "doc_id long, mark long, lo int, hi int, segment binary")


def _narrower(crowded: DataFrame, least: int, gram: int) -> DataFrame:
    """Crowded segments dealt anew by the least hash of longer pieces, so that fewer strings share one.

    Equal strings still have equal keys.  With pieces as long as the strings, a segment is one string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, starts, bytes_ = [], [], [], []
            for i, (lo, data) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("segment").to_pylist())):
                mine = minimizers(string_hashes(np.frombuffer(data, np.uint8), gram), len(data), least, gram).view(np.int64)
                begin = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                last = np.append(begin[1:], len(mine)) - 1
                rows += [i] * len(begin)
                keys += mine[begin].tolist()
                starts += (lo + begin).tolist()
                bytes_ += [data[s : e + least] for s, e in zip(begin.tolist(), last.tolist())]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(bytes_, pa.binary())],
                names=["doc_id", "mark", "key", "start", "segment"],
            )

    return crowded.mapInArrow(run, "doc_id long, mark long, key long, start int, segment binary")


def _merged(ranges: DataFrame) -> DataFrame:
    """Per text, the removed ranges without overlaps, as one list of begins and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[x for r in _joined([(r["lo"], r["hi"]) for r in row]) for x in r] for row in batch.column("ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "mark", "ranges"])

    listed = ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return listed.mapInArrow(run, "doc_id long, mark long, ranges array<int>")


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 50) -> DataFrame:
    """``docs`` with ``kept`` (bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs).

    Texts are UTF-8 bytes; a null text is empty.  Strings are judged on the input.  Only a document with a
    smaller id counts, so rows that share an id leave each other alone, and a null id takes no part.  Columns
    named like the results are replaced.
    """
    names = ["kept", "n_bytes", "n_removed", "n_spans"]
    docs = docs.drop(*names)
    columns = docs.columns
    # The text's hash tells rows that share an id apart.
    extra = {"__id": F.col(key).cast("long"), "__text": F.coalesce(F.col(text), F.lit(""))}
    marked = docs.withColumns(extra).withColumn("__mark", F.xxhash64("__text"))
    narrow = marked.where("__id IS NOT NULL").select(F.col("__id").alias("doc_id"), F.col("__mark").alias("mark"), F.col("__text").alias("text"))
    by = ["doc_id", "mark"]

    settled = _settled(narrow, least)
    many = settled.agg(F.sum(F.size("settled"))).first()[0] or 0
    free = attach(narrow, settled, by, "left", 64, 8 * many)
    shared = _pieces(free, least).repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_shared, "key long, doc_id long")
    # The low 32 bits, sign and all, of the key.
    low = F.shiftright(F.shiftleft(F.col("key"), 32), 32).cast("int")
    keys = stage(shared.groupBy("doc_id").agg(F.collect_set(low).alias("keys")), "shared-pieces")
    found = keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    segments = _segments(attach(free, keys, "doc_id", "inner", 48, 4 * found), least)
    ranges = stage(_expanded(segments, least), "ranges")
    plain, crowded = ranges.where("segment IS NULL").drop("segment"), ranges.where("segment IS NOT NULL")
    # Strings of a crowded minimizer are dealt by ever longer pieces, in the end by themselves.
    for gram in sorted({min(2 * GRAM, least), min(3 * GRAM, least), least}):
        if crowded.isEmpty():
            break
        ranges = stage(_expanded(_narrower(crowded, least, gram), least), "ranges")
        plain, crowded = plain.union(ranges.where("segment IS NULL").drop("segment")), ranges.where("segment IS NOT NULL")
    marks = stage(settled.join(_merged(plain), by, "full").withColumnsRenamed({"doc_id": "__id", "mark": "__mark"}), "removals")
    listed = marks.agg(F.sum(F.greatest(F.size("ranges"), F.lit(0)))).first()[0] or 0
    rows = attach(marked, marks, ["__id", "__mark"], "left", 96, 8 * many + 4 * listed).select(*columns, "__text", "settled", "ranges")
    schema = rows.drop("__text", "settled", "ranges").schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, gone, spans = [], [], [], []
            for i, data, hashes in _each(batch, "__text"):
                done, listed = batch.column("settled")[i].as_py(), np.array(batch.column("ranges")[i].as_py() or (), np.int64)
                edges = np.zeros(len(data) + 1, np.int64)
                if done:
                    starts = np.flatnonzero(np.diff(np.concatenate(([0], ~open_starts(data, hashes, np.array(done, np.int64), least), [0])).astype(np.int8)))
                    np.add.at(edges, starts[::2], 1)
                    np.add.at(edges, starts[1::2] + least - 1, -1)
                np.add.at(edges, listed[::2], 1)
                np.add.at(edges, listed[1::2], -1)
                removed = np.cumsum(edges[:-1]) > 0
                stays = data if not removed.any() else np.frombuffer(data, np.uint8)[~removed].tobytes()
                kept.append(stays)
                size.append(len(data))
                gone.append(len(data) - len(stays))
                spans.append(int((np.diff(np.concatenate(([False], removed)).astype(np.int8)) > 0).sum()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (size, gone, spans)]], names=[*columns, *names]
            )

    return rows.mapInArrow(cut, schema)
