"""Secret scan whose false positives a random forest removes.

Candidates are runs of letters, digits and ``+ / _ -`` with at least one digit, and whatever is assigned to a name for
credentials or stands in a URL's user part, of any length and alphabet.  The forest sees a candidate's
length, the likelihood of its character transitions, how much of it ordinary words cover, the path of the
document, and the words and marks around it.  It learns from findings of the corpus that high-precision rules
have labelled; half of them are shown without their surroundings, so that shape alone is learned too, and made-up
assignments of arbitrary values are added, so that surroundings alone are.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import BLOCK_BYTES, attach, blocks, first_ids, fitted, pack, unpack, words


@dataclass(frozen=True)
class Settings:
    """``fit_documents`` bounds the documents whose findings are learned from, of up to ``fit_length`` bytes; every document is scanned whole.

    ``least`` is the length of runs that nothing names; ``made_up`` the least number of made-up assignments.
    """

    least: int = 12
    made_up: int = 800
    fit_documents: int = 4000
    fit_length: int = 1 << 16
    trees: int = 25
    depth: int = 8
    least_leaf: int = 3
    cuts: int = 24
    sure: float = 0.5


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 45, 47, 95]] = True
_KEYWORD = re.compile(r"(?i)(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth|bearer|credential)")
_NAME = r"(?i:token|password|passwd|passphrase|pwd|secret|(?:api|access|secret|private)[_-]?key)[\"']?"
_ASSIGNED = re.compile(_NAME + r"\s*[=:]+>?\s*[\"']?\Z")
_VALUE = re.compile((_NAME + r"[ \t]*[=:]+>?[ \t]*(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|([^\s\"']\S*))").encode())
_URL_USER = re.compile(rb"://(?:[^\s/:@]*:([^\s/@]+)|([^\s/:@]+))@")
_IN_URL = re.compile(r"://[^\s/@]*\Z")
_REFERENCE = re.compile(r"[$<{%*].*|[A-Za-z_][\w.]*[(\[].*|.*\}\}|x+|\.+", re.S)
_KNOWN = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})\Z")
_TESTING = re.compile(r"(?i)test|example|sample|mock|fixture|demo")
NAMES = ("length", "digits", "upper", "hex", "entropy", "changes", "transition", "covered", "keyword", "assigned", "quoted", "mark", "joined", "before", "after", "depth", "testing")


@dataclass
class Candidate:
    """A run of a text: byte span, its text and what stands around it, and the code point it begins at."""

    start: int
    end: int
    value: str
    before: str
    after: str
    point: int = 0
    #: How it is named: "quoted", "plain" or "url"; "part" of such a value; or not at all.
    named: str = ""


def _named(data: bytes) -> dict[tuple[int, int], str]:
    """Spans of values that are assigned to a name for credentials or stand in a URL's user part."""
    out = {}
    for m in _VALUE.finditer(data):
        kind = 1 if m[1] is not None else 2 if m[2] is not None else 3
        start, end = m.span(kind)
        if kind == 3:
            end = start + len(m[3].rstrip(b",;.)]}>\"'"))
        if start < end:
            out[start, end] = "plain" if kind == 3 else "quoted"
    for m in _URL_USER.finditer(data):
        out[m.span(1 if m[1] is not None else 2)] = "url"
    return out


def candidates(texts: pa.Array, settings: Settings) -> Iterator[tuple[int, Candidate]]:
    """Row and candidate, by row and start."""
    for block in blocks(texts, BLOCK_BYTES):
        begins, ends, owner, _ = words(block, lower=False, inside=_INSIDE)
        digit = np.concatenate(([0], np.cumsum((block.data >= 48) & (block.data <= 57))))
        use = np.flatnonzero((ends - begins >= settings.least) & (digit[ends] > digit[begins]))
        points = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
        data = block.data.tobytes()
        runs: dict[int, list[int]] = {}
        for i in use:
            runs.setdefault(int(owner[i]), []).append(i)
        for d in range(len(block.bounds) - 1):
            lo, hi = int(block.bounds[d]), int(block.bounds[d + 1])
            text = data[lo:hi]
            spans = _named(text)
            if d in runs:
                # Where values begin, in order, and how far those that begin up to there reach.
                values = np.array(sorted(spans), np.int64).reshape(-1, 2)
                reach = np.concatenate(([-1], np.maximum.accumulate(values[:, 1])))
                b, e = begins[runs[d]] - lo, ends[runs[d]] - lo
                inside = reach[np.searchsorted(values[:, 0], b, "right")] >= e
                for span, part in zip(zip(b.tolist(), e.tolist()), inside):
                    spans.setdefault(span, "part" if part else "")
            for (b, e), named in sorted(spans.items()):
                before, after = text[max(0, b - 48) : b].decode("utf-8", "replace"), text[e : e + 48].decode("utf-8", "replace")
                yield block.rows.start + d, Candidate(b, e, text[b:e].decode(), before, after, int(points[lo + b] - points[lo]), named)


def known(c: Candidate) -> float:
    """The rules that label: 1 for a published key format or a value that a name or URL gives away, 0 for what nothing names, else NaN."""
    if _KNOWN.match(c.value):
        return 1.0
    if c.named in ("quoted", "url", "plain") and _REFERENCE.fullmatch(c.value):
        return 0.0
    if c.named in ("quoted", "url"):
        return 1.0
    if c.named == "part":
        return np.nan
    if c.named == "plain" or _ASSIGNED.search(c.before):
        return 1.0 if len(c.value) >= 16 and any(x.isdigit() for x in c.value) else np.nan
    return 0.0


_FORMS = ('password = "', "token='", '"secret": "', "API_KEY=", "db://user:", "passwd: ", "pwd = ", "secret: ", "token = ", "password: ")
_MARKS = "0123456789!#$%&*+-_?"


def _made_up(texts: list[str], n: int, random: np.random.RandomState) -> Iterator[tuple[Candidate, float]]:
    """Words of the texts, half of them with digits and marks, assigned in all forms; bare words and calls that are not quoted are no secrets."""
    pool = sorted({w for text in texts for w in re.findall(r"[^\s\"'@]{3,24}", text)})
    for _ in range(n if pool else 0):
        value, form = pool[random.randint(len(pool))], _FORMS[random.randint(len(_FORMS))]
        plain = form[-1] == " " and random.rand() < 0.6
        if plain:
            value = value.strip(_MARKS + ".,;:()[]") or "word"
            value += ("", "", "", "(", "[0")[random.randint(5)]
        elif random.rand() < 0.5 or form[-1] == " ":
            at = random.randint(len(value) + 1)
            value = value[:at] + "".join(_MARKS[random.randint(len(_MARKS))] for _ in range(random.randint(1, 5))) + value[at:]
        before, after = pool[random.randint(len(pool))] + " " + form, (form[-1] if form[-1] in "\"'" else "@" if "://" in form else "") + " " + pool[random.randint(len(pool))]
        yield Candidate(0, 0, value, before, after), float(not plain)


def _transitions(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of character pairs, and a table of the four-letter pieces of words."""
    counts = np.ones((128, 128))
    pieces = np.zeros(1 << 16, bool)
    for text in texts:
        for word in set(re.findall(r"[A-Za-z]{4,}", text)):
            codes = word.lower().encode()
            for a, b in zip(codes, codes[1:]):
                counts[a, b] += 1
            for i in range(len(codes) - 3):
                pieces[zlib.crc32(codes[i : i + 4]) & 0xFFFF] = True
    return np.log(counts / counts.sum(axis=1, keepdims=True)), pieces


def features(c: Candidate, path: str, transitions: np.ndarray, pieces: np.ndarray) -> list[float]:
    """The numbers of ``NAMES``."""
    value = c.value
    codes = value.lower().encode()
    n = len(codes)
    counts = np.bincount(np.frombuffer(codes, np.uint8))
    share = counts[counts > 0] / n
    kinds = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "o" for x in value]
    covered = np.zeros(n, bool)
    for i in range(n - 3):
        if codes[i : i + 4].isalpha() and pieces[zlib.crc32(codes[i : i + 4]) & 0xFFFF]:
            covered[i : i + 4] = True
    words_before = c.before.split()
    return [
        n,
        kinds.count("d") / n,
        kinds.count("u") / n,
        float(bool(re.fullmatch("[0-9a-fA-F]+", value))),
        float(-(share * np.log2(share)).sum()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1),
        float(np.mean([transitions[a & 127, b & 127] for a, b in zip(codes, codes[1:])])) if n > 1 else 0.0,
        float(covered.mean()),
        float(bool(_KEYWORD.search(c.before[-24:]) or _IN_URL.search(c.before))),
        float(bool(re.search(r"[=:]\s*[\"']?\Z", c.before))),
        float(c.before[-1:] in "\"'" and c.before != ""),
        float(zlib.crc32(c.before[-1:].encode()) % 16),
        float(c.before[-1:].isspace() + 2 * c.after[:1].isspace()),
        len(words_before[-1]) if words_before else 0,
        len((c.after.split() or [""])[0]),
        path.count("/"),
        float(bool(_TESTING.search(path))),
    ]


_SURROUNDINGS = slice(NAMES.index("keyword"), NAMES.index("depth"))


def _grow(x: np.ndarray, y: np.ndarray, depth: int, random: np.random.RandomState, settings: Settings, nodes: list[list[float]]) -> int:
    """Add a tree's nodes (feature, cut, left, right, share); returns the number of its root."""
    here = len(nodes)
    nodes.append([-1, 0, -1, -1, (y.sum() + 0.5) / (len(y) + 1)])
    if depth == 0 or len(y) < 2 * settings.least_leaf or y.min() == y.max():
        return here
    best = (0.0, -1, 0.0)
    parent = y.mean() * (1 - y.mean()) * len(y)
    for f in random.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1]))), replace=False):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        middle = (values[1:] + values[:-1]) / 2
        for cut in middle if len(middle) <= settings.cuts else np.quantile(middle, np.linspace(0, 1, settings.cuts)):
            left = x[:, f] <= cut
            a, b = y[left], y[~left]
            if min(len(a), len(b)) < settings.least_leaf:
                continue
            gain = parent - a.mean() * (1 - a.mean()) * len(a) - b.mean() * (1 - b.mean()) * len(b)
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
    if best[1] >= 0:
        left = x[:, best[1]] <= best[2]
        nodes[here][:2] = [best[1], best[2]]
        nodes[here][2] = _grow(x[left], y[left], depth - 1, random, settings, nodes)
        nodes[here][3] = _grow(x[~left], y[~left], depth - 1, random, settings, nodes)
    return here


def fit(sample: pd.DataFrame, settings: Settings) -> bytes:
    """Character tables and a forest from ``text`` and ``path``."""
    texts = [t or "" for t in sample["text"]]
    transitions, pieces = _transitions(texts)
    found = list(candidates(pa.array(texts, pa.string()), settings))
    y = np.array([known(c) for _, c in found], float)
    found, y = [found[i] for i in np.flatnonzero(~np.isnan(y))], y[~np.isnan(y)]
    x = np.array([features(c, sample["path"].iloc[i] or "", transitions, pieces) for i, c in found]).reshape(len(found), len(NAMES))
    random = np.random.RandomState(9)
    x[random.rand(len(x)) < 0.5, _SURROUNDINGS] = 0
    nodes: list[list[float]] = []
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        more = list(_made_up(texts, max(settings.made_up, int(y.sum())), random))
        x = np.concatenate([x, np.array([features(c, "", transitions, pieces) for c, _ in more]).reshape(len(more), len(NAMES))])
        y = np.concatenate([y, [label for _, label in more]])
        for _ in range(settings.trees):
            rows = np.concatenate([random.choice(np.flatnonzero(y == v), (y == v).sum()) for v in (0, 1)])
            roots.append(_grow(x[rows], y[rows], settings.depth, random, settings, nodes))
    return pack(transitions=transitions, pieces=pieces, nodes=np.array(nodes).reshape(-1, 5), roots=np.array(roots, np.int64))


def forest(x: np.ndarray, nodes: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Mean share over the trees."""
    total = np.zeros(len(x))
    for root in roots:
        at = np.full(len(x), root)
        while True:
            split = nodes[at, 0] >= 0
            if not split.any():
                break
            f = nodes[at, 0].astype(int)
            left = x[np.arange(len(x)), np.maximum(f, 0)] <= nodes[at, 1]
            at = np.where(split, np.where(left, nodes[at, 2], nodes[at, 3]).astype(int), at)
        total += nodes[at, 4]
    return total / max(len(roots), 1)


def secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row per finding: ``doc_id``, ``start`` and ``end`` (code points), and the forest's ``score``.

    Only findings with a score of ``sure`` or more are returned.  A null or empty text has none.  If the sample
    holds no finding of either label, the labelling rules alone decide (score 1; what they leave open is found unless it
    is a bare word).  A run inside a value that is found is not reported again.  Rows that repeat an id are
    scanned one by one.  The work in a text grows with its length and its findings, not with their product.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.col(path).cast("string") if path else F.lit("")).alias("path"), F.col(text).alias("text"))
    short = rows.where(F.octet_length("text") <= settings.fit_length)
    likely = short.where(F.col("doc_id").isNotNull() & F.col("text").rlike(f"[0-9][A-Za-z0-9+/_-]{{6}}|{_NAME}[ \\t]*[=:]|://[^ /@]+@"))
    # The expression is dear: one scan with it, and the sample is drawn from the ids that it leaves.
    ids = first_ids(stage(likely.select("doc_id"), "likely"), "doc_id", settings.fit_documents, 9).withColumnRenamed("k", "doc_id")
    model = fitted(attach(short, ids, "doc_id", "inner", 16).select("doc_id", "path", "text"), lambda part: fit(part, settings))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = unpack(model) if model else None
        for batch in batches:
            column, paths = batch.column("text"), batch.column("path")
            found = list(candidates(column, settings))
            if not found:
                continue
            if parts and len(parts["roots"]):
                x = np.array([features(c, paths[i].as_py() or "", parts["transitions"], parts["pieces"]) for i, c in found])
                score = forest(x, parts["nodes"], parts["roots"])
            else:
                rules = np.array([known(c) for _, c in found])
                score = np.where(np.isnan(rules), [c.named != "part" and not c.value.isalpha() for _, c in found], rules)
            keep, last = [], (-1, 0)
            # By start, a value comes before its parts, unless a part begins it.
            for k in sorted(np.flatnonzero(score >= settings.sure), key=lambda k: (found[k][0], found[k][1].start, -found[k][1].end)):
                i, c = found[k]
                if c.named != "part" or last[0] != i or c.end > last[1]:
                    keep.append(k)
                if c.named not in ("", "part"):
                    last = (i, c.end)
            starts = [found[k][1].point for k in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array([found[k][0] for k in keep], pa.int64())),
                    pa.array(starts, pa.int32()),
                    pa.array([s + len(found[k][1].value) for s, k in zip(starts, keep)], pa.int32()),
                    pa.array(score[keep]),
                ],
                names=["doc_id", "start", "end", "score"],
            )

    return rows.mapInArrow(scan, "doc_id long, start int, end int, score double")
