"""Toxicity by multiple-instance learning.

Only documents are labelled.  A sentence has a logistic score over hashed words and word beginnings; a
document is toxic if any of its sentences is (noisy-or), so the document labels train the sentence weights,
and the weights then tell which sentences offend.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Block, attach, blocks, fitted, held_out, mix, pack, sample_ids, spans_hash, unpack, words


@dataclass(frozen=True)
class Settings:
    """Bounds of learning; every document is scored whole."""

    per_label: int = 2000
    buckets: int = 1 << 17
    beginnings: tuple[int, ...] = (4, 5, 6)
    least: int = 4
    steps: int = 150
    rate: float = 0.25
    penalty: float = 5e-4
    start: float = -6.0


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


@dataclass
class Sentences:
    """Features of a block: one row of buckets per word, the sentence of each word, the text of each sentence."""

    buckets: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def sentences(block: Block, settings: Settings) -> Sentences:
    """Sentences end at ``. ! ?``, line breaks and text ends."""
    n = len(block.data)
    begins, ends, owner, whole = words(block, inside=_INSIDE)
    data = LOWER[block.data]
    mask = np.uint64(settings.buckets - 1)
    kinds = [mix(whole, 1) & mask]
    for size in settings.beginnings:
        kinds.append(mix(spans_hash(data, begins, np.minimum(begins + size, ends)), 1 + size) & mask)
    cut = np.zeros(n + 1, bool)
    cut[1:] = _STOP[block.data]
    cut[block.bounds] = True
    starts = np.flatnonzero(cut[:n])
    sentence = np.searchsorted(starts, begins, "right") - 1
    used, sentence = np.unique(sentence, return_inverse=True)
    at = starts[used]
    after = np.append(starts, n)[used + 1]
    return Sentences(np.stack(kinds).astype(np.int64), sentence, np.searchsorted(block.bounds, at, "right") - 1, at, after)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(sample: pd.DataFrame, settings: Settings) -> bytes:
    """Sentence weights from ``text``, ``__label`` (0 or 1) and ``__weight``, by gradient steps on the noisy-or likelihood.

    Weights are kept at 0 or above, as a harmless word takes nothing back, and pay a penalty on their sum.
    """
    buckets, sentence, text, done, so_far = [], [], [], 0, 0
    for block in blocks(pa.array(sample["text"], pa.string())):
        s = sentences(block, settings)
        buckets.append(s.buckets)
        sentence.append(s.sentence + so_far)
        text.append(s.text + done)
        so_far += len(s.text)
        done += len(block.bounds) - 1
    feature, sentence, text = np.concatenate(buckets, axis=1), np.concatenate(sentence), np.concatenate(text)
    label = sample["__label"].to_numpy().astype(float)
    weight = sample["__weight"].to_numpy()
    # Buckets of too few documents say nothing; the others are renumbered.
    of_word = text[sentence] if len(sentence) else np.zeros(0, np.int64)
    pairs = np.unique((feature * len(sample) + of_word).ravel())
    known = np.flatnonzero(np.bincount(pairs // max(len(sample), 1), minlength=settings.buckets) >= settings.least)
    number = np.full(settings.buckets, len(known))
    number[known] = np.arange(len(known))
    where = np.tile(sentence, len(feature))
    flat = number[feature].ravel()
    use = flat < len(known)
    flat, where = flat[use], where[use]
    w, b = np.zeros(len(known)), settings.start
    m, v, mb, vb = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    for step in range(1, settings.steps + 1):
        z = b + np.bincount(where, w[flat], len(text))
        t = np.bincount(text, _softplus(z), len(sample))
        gone = np.exp(-np.maximum(t, 1e-12))
        slope = np.where(label > 0, -gone / (1 - gone), 1.0) * weight
        g = slope[text] * np.exp(-_softplus(-z))
        gw, gb = np.bincount(flat, g[where], len(known)) + settings.penalty, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = settings.rate * (1 - 0.9 * step / settings.steps)
        up, down = 1 - 0.9**step, 1 - 0.99**step
        w = np.maximum(w - rate * (m / up) / (np.sqrt(v / down) + 1e-8), 0)
        b = b - rate * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    return pack(known=known, w=w, b=np.array([b]))


def learn(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, settings: Settings = Settings()) -> bytes | None:
    """A model from labelled documents that are not held out; None unless both labels occur."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("__y"))
    counts = dict(marked.groupBy("__y").count().collect())
    if len(counts) < 2:
        return None
    ids = sample_ids(marked, F.col("__y"), key, settings.per_label, 3)
    total = sum(counts.values())
    # A label of which only a part is seen counts for all of its documents.
    weight = F.when(F.col("__label") == 1, F.lit(counts[1] / total / min(counts[1], settings.per_label))).otherwise(
        F.lit(counts[0] / total / min(counts[0], settings.per_label))
    )
    sample = attach(docs.select(key, F.col(text).alias("text")), ids, key, "inner", 32)
    return fitted(sample.select(key, "__label", weight.alias("__weight"), "text"), lambda rows: fit(rows, settings))


def toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", keep: tuple[str, ...] | None = None, settings: Settings = Settings()
) -> DataFrame:
    """The ``keep`` columns (default: all) with ``toxicity`` (0 to 1) and ``offending``, the code point spans of bad sentences.

    A sentence offends if its own score is 0.5 or more.  A null, empty or wordless text scores 0, as does every
    text when nothing could be learned.  Of several labels of one document the largest counts.  Columns named
    like the results are replaced.
    """
    model = learn(docs, labels, text, key, label, settings)
    kept = [c for c in (keep or docs.columns) if c not in ("toxicity", "offending")]
    rows = docs.select(*kept, F.col(text).alias("__text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("toxicity", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None
        if model:
            parts = unpack(model)
            weights, bias = np.zeros(settings.buckets), float(parts["b"][0])
            weights[parts["known"]] = parts["w"]
        for batch in batches:
            p, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for block in blocks(batch.column("__text")) if weights is not None else ():
                s = sentences(block, settings)
                z = bias + np.bincount(s.sentence, weights[s.buckets].sum(axis=0), len(s.text))
                p[block.rows] = 1 - np.exp(-np.bincount(s.text, _softplus(z), len(block.bounds) - 1))
                bad = np.flatnonzero(z >= 0)
                if len(bad):
                    points = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
                    for i in bad:
                        zero = points[block.bounds[s.text[i]]]
                        spans[block.rows.start + s.text[i]].append({"start": int(points[s.begins[i]] - zero), "end": int(points[s.ends[i]] - zero)})
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.clip(p, 0, 1)), pa.array(spans, spans_type)], names=[*kept, "toxicity", "offending"]
            )

    return rows.mapInArrow(score, schema)
