"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (lengths 1 to 4, lower case) present in both, divided
by the root of the product of their numbers.  Some learning texts serve as Nystrom landmarks; kernel ridge
regression, one language against the rest, is solved in the landmarks' space.  Texts are scored a block at a
time, as a product of the block's presence matrix with the landmarks' and then with the coefficients.
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

from .common import LOWER, Block, attach, blocks, fitted, held_out, pack, sample_ids, unpack

UNKNOWN = "und"
#: Texts that learning takes at a time.  A multiple of the rows that products are tiled by, so that sums stay the same.
_RUN = 240


@dataclass(frozen=True)
class Settings:
    """Bounds of learning; everything is scored, only the learner sees a sample."""

    per_language: int = 300
    landmarks: int = 96
    gram: int = 4
    buckets: int = 1 << 14
    ridge: float = 1e-2
    sharpness: float = 5.0
    #: A text is unlike all learned ones if it has less than this share of the known n-grams of the least typical of them.
    margin: float = 0.8
    rows_per_block: int = 256


def presence(block: Block, settings: Settings) -> np.ndarray:
    """Which hashed n-grams each text of a block has (texts x buckets)."""
    n_texts, width = len(block.bounds) - 1, settings.buckets
    # The last column takes what would reach into the next text.
    found = np.zeros((n_texts, width + 1), bool)
    flat = found.reshape(-1)
    data = LOWER[block.data].astype(np.uint32)
    base = block.owner() * (width + 1)
    shift = np.uint32(32 - (width.bit_length() - 1))
    code = data
    for size in range(1, settings.gram + 1):
        if size > 1:
            code = code[:-1] | (data[size - 1 :] << np.uint32(8 * (size - 1)))
        if not len(code):
            break
        bucket = ((code + np.uint32(0x85EBCA6B * size % 2**32)) * np.uint32(0x9E3779B1) >> shift).astype(np.int64)
        for back in range(1, size):
            over = block.bounds[1:] - back
            bucket[over[(over >= 0) & (over < len(bucket))]] = width
        flat[base[: len(bucket)] + bucket] = True
    return found[:, :width]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Presence rows divided by the root of their number of n-grams: their product is the kernel."""
    rows = rows.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def _known(grams: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The share of each text's n-grams that are among those held."""
    return grams[:, held].sum(axis=1) / np.maximum(grams.sum(axis=1), 1)


def _grams(texts: pa.Array, settings: Settings) -> np.ndarray:
    """Presence rows of a few texts."""
    return np.concatenate([presence(b, settings) for b in blocks(texts, most=settings.rows_per_block)])


def fit(sample: pd.DataFrame, settings: Settings) -> bytes:
    """Landmarks and one-against-rest coefficients from ``text`` and ``__label``.

    The n-grams of the landmarks are held, those of all texts only ``_RUN`` texts at a time.
    """
    labels = sorted(sample["__label"].unique())
    texts, which = pa.array(sample["text"], pa.string()), sample["__label"].to_numpy()
    each = -(-settings.landmarks // len(labels))
    chosen = np.concatenate([np.flatnonzero(which == label)[:each] for label in labels])[: settings.landmarks]
    marks = _unit(_grams(texts.take(pa.array(chosen)), settings))
    # N-grams of an eighth of the landmarks, and how few of them the other texts of the sample have.
    held = (marks > 0).sum(axis=0) >= max(1.0, len(marks) / 8)
    kernel, known = np.empty((len(which), len(marks))), np.empty(len(which))
    for first in range(0, len(which), _RUN):
        run = slice(first, first + _RUN)
        grams = _grams(texts[run], settings)
        kernel[run], known[run] = _unit(grams) @ marks.T, _known(grams, held)
    others = np.delete(known, chosen)
    floor = settings.margin * others.min() if len(others) else 0.0
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = np.column_stack([kernel @ root, np.ones(len(which))])
    wanted = np.where(which[:, None] == np.array(labels, object)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many texts it has.
    weight = 1.0 / np.array([(which == w).sum() for w in which])
    gram = features.T @ (features * weight[:, None]) + settings.ridge * np.eye(features.shape[1]) / len(which)
    answer = np.linalg.solve(gram, features.T @ (wanted * weight[:, None]))
    return pack(
        held=held, floor=np.array(floor), marks=marks > 0, norms=np.sqrt((marks > 0).sum(axis=1)).astype(np.float32), coefficients=root @ answer[:-1], bias=answer[-1], labels=np.array(labels)
    )


def learn(docs: DataFrame, text: str, key: str, lang: str, settings: Settings = Settings()) -> bytes | None:
    """A model from labelled documents that are not held out; None if there are none."""
    usable = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = sample_ids(usable, F.col(lang), key, settings.per_language, 4)
    sample = attach(usable.select(key, F.col(text).alias("text")), ids, key, "inner", 32)
    return fitted(sample.select(key, "__label", "text"), lambda rows: fit(rows, settings))


def identify(
    docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", keep: tuple[str, ...] | None = None, settings: Settings = Settings()
) -> DataFrame:
    """The ``keep`` columns (default: all) with ``lang_pred``, ``lang_score`` and ``lang_known`` (0 to 1).

    ``lang_known`` is 1 for a text whose n-grams are as common among the landmarks as those of learned texts are, and less for a
    script or language of which nothing was learned, whichever learned one it is nearest to.  A null text, one without a letter, or any text when nothing could be
    learned is ``und`` with score 0 and nothing known.
    Ids repeated with other texts are rows of their own.  Languages with equal scores: the first by name.
    Columns named like the results are replaced.
    """
    model = learn(docs, text, key, lang, settings)
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "lang_score", "lang_known")]
    # A text that is kept is not sent twice.
    column, extra = (text, []) if text in kept else ("__text", [F.col(text).alias("__text")])
    rows = docs.select(*kept, *extra, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_known", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields[: len(kept)], *found])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = unpack(model) if model else None
        for batch in batches:
            n = batch.num_rows
            named, sure, known = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            if parts:
                marks = (parts["marks"] / parts["norms"][:, None]).astype(np.float32).T
                for block in blocks(batch.column(column), most=settings.rows_per_block):
                    grams = presence(block, settings)
                    known[block.rows] = np.minimum(_known(grams, parts["held"]) / max(float(parts["floor"]), 1e-9), 1.0)
                    margin = (_unit(grams) @ marks) @ parts["coefficients"] + parts["bias"]
                    share = np.exp(settings.sharpness * (margin - margin.max(axis=1, keepdims=True)))
                    share /= share.sum(axis=1, keepdims=True)
                    named[block.rows] = parts["labels"][margin.argmax(axis=1)]
                    sure[block.rows] = share.max(axis=1)
                blank = ~batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
                named[blank], sure[blank], known[blank] = UNKNOWN, 0.0, 0.0
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(named, pa.string()), pa.array(sure), pa.array(known)], names=[*kept, "lang_pred", "lang_score", "lang_known"]
            )

    return rows.mapInArrow(score, schema)
