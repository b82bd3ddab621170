"""Personal data by patterns and a skip-chain conditional random field.

Patterns find what is written in a standard form.  The field labels every token that holds a digit, ``@`` or
``+``: neighbouring tokens share transition potentials, and tokens of one document that repeat or resemble
each other, however far apart, share skip potentials with one hub.  Loopy message passing then carries a label from a
clear mention to an unclear one.  The field learns from the patterns' own matches in a bounded sample.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, first_ids, fitted, pack, unpack

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none; label i + 1 is ``KINDS[i]``.
LABELS = len(KINDS) + 1


@dataclass(frozen=True)
class Settings:
    """``fit_documents`` bounds the learning sample, of texts of up to ``fit_length`` bytes; every document is labelled whole.

    Messages of a document pass until none changes by more than ``settled``, whatever its neighbours in a batch do; a
    document that never settles stands as it is after ``rounds``.
    ``alike`` is the starting weight between two tokens that resemble each other.
    """

    fit_documents: int = 3000
    fit_length: int = 1 << 16
    buckets: int = 1 << 12
    steps: int = 80
    rate: float = 0.3
    decay: float = 2e-3
    rounds: int = 100
    settled: float = 1e-3
    sure: float = 0.5
    alike: float = 2.0


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A leftmost match cannot begin inside a run of digits, so starts there are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_HINT = re.compile(r"[0-9@+]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """The check sum of payment card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind, without those that fail its test."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if not _HINT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found["phone"].append(m.span())
    return found


@dataclass
class Graph:
    """Nodes of some documents: spans, feature buckets, and the two kinds of edges; hubs are numbered after the tokens."""

    spans: list[Span]
    document: list[int]
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    hubs: int

    def unary(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([w[self.features].sum(axis=1), np.zeros((self.hubs, LABELS))])


def _shape(token: str) -> str:
    """Character classes of a token, runs once."""
    kinds = re.sub("[A-Z]", "A", re.sub("[0-9]", "9", re.sub(r"[^\W\d_]", "a", token)))
    return re.sub(r"(.)\1+", r"\1", kinds)


def _features(token: str, before: str, after: str) -> list[str]:
    core = token.strip(".,;:!?\"'()[]<>#$%&*|")
    digits = sum(c.isdigit() for c in core)
    return [
        "shape " + _shape(core)[:24],
        f"digits {min(digits, 20)}",
        f"length {min(len(core), 40) // 4}",
        f"dots {min(core.count('.'), 4)} at {'@' in core} plus {core[:1] == '+'}",
        "before " + before.lower()[-16:],
        "after " + after.lower()[:16],
        "start " + core[:1] + " end " + core[-1:],
    ]


def _resembles(token: str) -> str:
    """Tokens with the same answer resemble each other: the last seven digits, or the letters and digits; short ones only if equal."""
    digits = re.sub("[^0-9]", "", token)
    if len(digits) >= 7:
        return digits[-7:]
    plain = re.sub(r"[\W_]", "", token).lower()
    return plain if len(plain) >= 6 else "=" + token.strip(".,;:!?\"'")


def graph(texts: list[str], settings: Settings) -> Graph:
    """Tokens with a digit, ``@`` or ``+``; edges to the adjacent such token and to the hub of those of the document that it resembles."""
    spans, document, features, chain, skip, classes = [], [], [], [], [], []
    for d, text in enumerate(texts):
        alike: dict[str, list[int]] = {}
        previous, previous_node = "", -1
        pending: int | None = None
        for m in _TOKEN.finditer(text):
            token = m.group()
            if pending is not None:
                features[pending][5] = "after " + token.lower()[:16]
                pending = None
            node = -1
            if _HINT.search(token):
                node = len(spans)
                spans.append(m.span())
                document.append(d)
                features.append(_features(token, previous, ""))
                pending = node
                if previous_node >= 0:
                    chain.append((previous_node, node))
                alike.setdefault(_resembles(token), []).append(node)
            previous, previous_node = token, node
        classes += [nodes for nodes in alike.values() if len(nodes) > 1]
    for hub, nodes in enumerate(classes):
        skip += [(node, len(spans) + hub) for node in nodes]
    hashed = [[zlib.crc32(f.encode("utf-8", "replace")) % settings.buckets for f in each] for each in features]
    return Graph(
        spans,
        document,
        np.array(hashed, np.int64).reshape(len(spans), 7),
        np.array(chain, np.int64).reshape(-1, 2),
        np.array(skip, np.int64).reshape(-1, 2),
        len(classes),
    )


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _beliefs(g: Graph, unary: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], settings: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """Loopy sum-product: marginals of the nodes, and of the ends of each kind of edge.

    Edges begin at tokens and stay in one document; a document's messages rest once all of them have settled.
    """
    there = [np.zeros((len(e), LABELS)) for e, _ in pairs]
    back = [np.zeros((len(e), LABELS)) for e, _ in pairs]

    def total() -> np.ndarray:
        out = unary.copy()
        for (edges, _), a, b in zip(pairs, there, back):
            np.add.at(out, edges[:, 1], a)
            np.add.at(out, edges[:, 0], b)
        return out

    document = np.array(g.document, np.int64)
    owner = [document[e[:, 0]] for e, _ in pairs]
    moving = np.ones(int(document.max(initial=-1)) + 1, bool)
    for _ in range(settings.rounds):
        now = total()
        moved = np.zeros(len(moving), bool)
        for k, (edges, potential) in enumerate(pairs):
            use = np.flatnonzero(moving[owner[k]])
            if len(use):
                left, right = edges[use].T
                a = _log_sum((now[left] - back[k][use])[:, :, None] + potential[None], 1)
                b = _log_sum((now[right] - there[k][use])[:, None, :] + potential[None], 2)
                a, b = a - _log_sum(a, 1)[:, None], b - _log_sum(b, 1)[:, None]
                step = np.maximum(np.abs(a - there[k][use]).max(axis=1), np.abs(b - back[k][use]).max(axis=1))
                moved[owner[k][use[step > settings.settled]]] = True
                there[k][use], back[k][use] = a, b
        moving &= moved
        if not moving.any():
            break
    now = total()
    ends = []
    for k, (edges, potential) in enumerate(pairs):
        both = (now[edges[:, 0]] - back[k])[:, :, None] + (now[edges[:, 1]] - there[k])[:, None, :] + potential[None]
        flat = both.reshape(len(edges), LABELS * LABELS)
        ends.append(np.exp(flat - _log_sum(flat, 1)[:, None]).reshape(both.shape) if len(edges) else both)
    return np.exp(now - _log_sum(now, 1)[:, None]) if len(now) else now, ends


def _labels(g: Graph, texts: list[str]) -> np.ndarray:
    """The pattern's kind of each node that a match overlaps, else none."""
    out = np.zeros(len(g.spans), np.int64)
    nodes: dict[int, list[int]] = {}
    for i, d in enumerate(g.document):
        nodes.setdefault(d, []).append(i)
    for d, own in nodes.items():
        # Tokens stand in order and apart, so those that a match overlaps follow each other.
        starts, ends = ([g.spans[i][side] for i in own] for side in (0, 1))
        base = base_spans(texts[d])
        for k, kind in enumerate(KINDS):
            for start, end in base[kind]:
                out[own[0] + bisect_right(ends, start) : own[0] + bisect_left(starts, end)] = k + 1
    return out


def _to_hub(weight: float) -> float:
    """The weight of two edges in a row that say as much as one of ``weight``: the root of the matrix of its factors."""
    a = np.sqrt(np.exp(weight) - 1)
    b = (np.sqrt(a * a + LABELS) - a) / LABELS
    return float(np.log((a + b) / b))


def fit(sample: pd.DataFrame, settings: Settings) -> bytes:
    """Unary, chain and skip weights by gradient steps; the expectation comes from message passing.

    A token that no pattern matches but that resembles a matched one counts as unlabelled, not as none.
    """
    texts = sample["text"].tolist()
    g = graph(texts, settings)
    labels = _labels(g, texts)
    # A hub has the kind of a matched token, if it has one.
    labels = np.concatenate([labels, np.zeros(g.hubs, np.int64)])
    token, hub = g.skip.T
    np.maximum.at(labels, hub, labels[token])
    truth = np.eye(LABELS)[labels]
    sure = np.ones(len(labels), bool)
    sure[token[(labels[hub] > 0) & (labels[token] == 0)]] = False
    own = sure[: len(g.spans)]
    w = np.zeros((settings.buckets, LABELS))
    chain, skip = np.zeros((LABELS, LABELS)), _to_hub(settings.alike) * np.eye(LABELS)
    parts = [w, chain, skip]
    prior = [p.copy() for p in parts]
    squares = [np.zeros_like(p) for p in parts]
    n = max(len(g.spans), 1)
    for _ in range(settings.steps if len(g.spans) else 0):
        p, (chain_p, skip_p) = _beliefs(g, g.unary(w), [(g.chain, chain), (g.skip, skip)], settings)
        slope = np.zeros_like(w)
        for f in range(g.features.shape[1]):
            np.add.at(slope, g.features[own, f], (truth - p)[: len(own)][own])
        steps = [slope]
        for edges, q in ((g.chain, chain_p), (g.skip, skip_p)):
            use = sure[edges].all(axis=1)
            steps.append(truth[edges[use, 0]].T @ truth[edges[use, 1]] - q[use].sum(axis=0))
        for part, s, square, start in zip(parts, steps, squares, prior):
            s = s / n - settings.decay * (part - start)
            square += s * s
            part += settings.rate * s / (np.sqrt(square) + 1e-8)
    return pack(w=w, chain=chain, skip=skip)


def _added(g: Graph, p: np.ndarray, texts: list[str], base: list[dict[str, list[Span]]], settings: Settings) -> list[dict[str, list[Span]]]:
    """Runs of adjacent nodes of one likely kind that no pattern match touches."""
    out: list[dict[str, list[Span]]] = [{k: [] for k in KINDS} for _ in texts]
    linked = {int(b): int(a) for a, b in g.chain}
    best = p.argmax(axis=1)
    runs: list[list[int]] = []
    for i in range(len(g.spans)):
        if best[i] and p[i, best[i]] > settings.sure:
            if runs and linked.get(i) == runs[-1][-1] and best[runs[-1][-1]] == best[i]:
                runs[-1].append(i)
            else:
                runs.append([i])
    # Per document, where matches begin, in order, and how far those that begin up to there reach.
    matches = [sorted(s for spans in b.values() for s in spans) for b in base]
    reach = [list(accumulate((end for _, end in m), max, initial=-1)) for m in matches]
    for run in runs:
        d, kind = g.document[run[0]], KINDS[best[run[0]] - 1]
        start, end = g.spans[run[0]][0], g.spans[run[-1]][1]
        text = texts[d]
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start < end and reach[d][bisect_left(matches[d], (end,))] <= start:
            out[d][kind].append((start, end))
    return out


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The ``keep`` columns (default: all) with ``pii``: spans of kind, start and end (code points), and whether a pattern found it.

    Spans are ordered by kind as in ``KINDS``, then start.  A null or empty text has none.  What a text gets
    does not depend on the rows beside it.  Without a learning sample only the patterns are used.  A column named ``pii`` is replaced.
    """
    hinted = docs.where(F.col(key).isNotNull() & (F.octet_length(text) <= settings.fit_length) & F.col(text).rlike("[0-9@+]"))
    ids = first_ids(hinted, key, settings.fit_documents, 5)
    sample = attach(hinted.select(F.col(key).alias("k"), F.col(text).alias("text")), ids, "k", "inner", 16)
    model = fitted(sample.select("k", "text"), lambda rows: fit(rows, settings))
    kept = [c for c in (keep or docs.columns) if c != "pii"]
    rows = docs.select(*kept, F.col(text).alias("__text"))
    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pattern", T.BooleanType())]
    )
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("pii", T.ArrayType(span))])
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.bool_())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = unpack(model) if model else None
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            column = batch.column("__text")
            for first in range(0, batch.num_rows, 512):
                texts = [t or "" for t in column.slice(first, 512).to_pylist()]
                some = [i for i, t in enumerate(texts) if _HINT.search(t)]
                texts = [texts[i] for i in some]
                base = [base_spans(t) for t in texts]
                extra: list[dict[str, list[Span]]] = [{k: [] for k in KINDS} for _ in texts]
                if parts and texts:
                    g = graph(texts, settings)
                    if g.spans:
                        p, _ = _beliefs(g, g.unary(parts["w"]), [(g.chain, parts["chain"]), (g.skip, parts["skip"])], settings)
                        extra = _added(g, p, texts, base, settings)
                for i, b, e in zip(some, base, extra):
                    for kind in KINDS:
                        both = [(s, t, True) for s, t in b[kind]] + [(s, t, False) for s, t in e[kind]]
                        out[first + i] += [{"kind": kind, "start": s, "end": t, "pattern": q} for s, t, q in sorted(both)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, kind_type)], names=[*kept, "pii"])

    return rows.mapInArrow(label, schema)


def listed(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end``, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
