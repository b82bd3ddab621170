"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to one string.  Successive prefixes of a
conversation are rendered; if one output begins with the output before it, what was added is the new turn's
span.  If it does not, the template has rewritten history, which is reported.  Rendering the same prefix with
two probe texts in place of the turn's own tells where inside its span the text stands: that is the loss mask of an
answer.  Nothing is known of the template but what it returns.

A conversation of any length is cut into segments of a bounded number of turns, each rendered after the turns just before
it, so no task holds a conversation.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: Turns of a segment, and turns before it that a template may look back at.
SEGMENT, CONTEXT = 32, 1
#: Texts that differ in their first and last character and in nothing that a template would trim or escape.
_PROBES = ("a1b", "c2d")

_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_SEGMENTS = pa.schema([
    ("conv_id", pa.int64()),
    ("segment", pa.int64()),
    ("n_turns", pa.int64()),
    ("formatted", pa.string()),
    ("loss", pa.list_(_SPAN)),
    ("rewritten_at", pa.int64()),
])

_END = "</turn>\n"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """``text`` with no control string in it: every ``\\`` and ``#`` and the slash of every ``</`` is marked."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    """The inverse of ``escape`` (and of a line break in a role)."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def marked_turns(turns: Sequence[Turn]) -> str:
    """The built-in template: ``### role``, the text, ``</turn>``; both parts escaped reversibly."""
    out = []
    for role, text in turns:
        head = escape(role).replace("\n", "\\n")
        out.append(f"### {head}\n{escape(text)}{_END}")
    return "".join(out)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of an output of ``marked_turns``; anything else is an error."""
    if not formatted:
        return []
    if not formatted.endswith(_END):
        raise ValueError("the output does not end with a turn")
    found = []
    for turn in formatted[: -len(_END)].split(_END):
        head, mark, text = turn.partition("\n")
        if not mark or not head.startswith("### "):
            raise ValueError("a turn has no role")
        found.append((unescape(head[4:]), unescape(text)))
    return found


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(turns: Sequence[Turn], template: Template, known: int = 0) -> tuple[list[tuple[str, int, int]], int | None]:
    """Spans of ``turns[known:]``: (what the turn adds, begin and end of its text in that), and the first turn that rewrites.

    The first ``known`` turns are context.  From a rewriting turn on nothing is located.  Begin and end are -1
    where the template changes the text's surroundings with the text, so that its place is not certain.
    """
    before = template(turns[:known]) if known else ""
    found: list[tuple[str, int, int]] = []
    for i in range(known, len(turns)):
        whole = template(turns[: i + 1])
        if not whole.startswith(before):
            return found, i
        added = whole[len(before) :]
        one, two = (template([*turns[:i], (turns[i][0], probe)]) for probe in _PROBES)
        head, tail = _common(one, two), _common(one[::-1], two[::-1])
        certain = len(one) == len(two) == head + tail + len(_PROBES[0]) and len(whole) >= head + tail and head >= len(before)
        certain = certain and whole.startswith(one[:head]) and (not tail or whole.endswith(one[-tail:]))
        begin, end = (head - len(before), len(whole) - tail - len(before)) if certain else (-1, -1)
        found.append((added, begin, end))
        before = whole
    return found, None


def format_chats(
    turns: DataFrame,
    template: Template = marked_turns,
    answers: str = "assistant",
    conv: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    segment: int = SEGMENT,
    context: int = CONTEXT,
) -> DataFrame:
    """One row for each segment of a conversation: conv_id, segment (from 0), n_turns, formatted, loss, rewritten_at.

    ``formatted`` is what the segment's turns add to the output; a conversation's output is that of its segments, in
    order.  ``loss`` has the (begin, end) of every answer's text in it, in code points; an answer whose place is not
    certain has none.  ``rewritten_at`` is the number of the first turn, from 0, at which the template changed what it
    had written before (null: it never did); such a turn and those after it in its segment are left out.

    A template may look back ``context`` turns, and know whether a turn is the first.  Turns go by ``order`` (null
    first), equal ones by role and text; repeated rows are turns of their own.  A null role or text is empty.
    Rows without a conversation make up one of their own, with a null id.  An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv).cast("long").alias("c"),
        F.col(order).cast("long").alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"),
        F.lit(1).alias("one"),
    )
    placed = running_total(rows, "c", ["c", "t", "r", "x"], "one", "place")
    own = F.floor(F.col("place") / segment)
    # The last turns of a segment also go to the next one, as context.
    ends = F.array(own, own + 1)
    meets = F.when(F.pmod(F.col("place"), F.lit(segment)) >= segment - context, ends).otherwise(F.array(own))
    met = placed.select("c", "place", "r", "x", F.explode(meets).alias("segment"))

    def rendered(group: list[dict]) -> dict | None:
        part, first = group[0]["segment"], group[0]["place"]
        known = max(0, part * segment - first)
        if known == len(group):  # nothing follows the context
            return None
        sequence = [(row["r"], row["x"]) for row in group]
        spans, rewrite = locate(sequence, template, known)
        at, loss = 0, []
        for (added, begin, end), (who, _) in zip(spans, sequence[known:]):
            if who == answers and begin >= 0:
                loss.append({"begin": at + begin, "end": at + end})
            at += len(added)
        return {
            "conv_id": group[0]["c"],
            "segment": part,
            "n_turns": len(group) - known,
            "formatted": "".join(s[0] for s in spans),
            "loss": loss,
            "rewritten_at": None if rewrite is None else first + rewrite,
        }

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # At most the turns of one segment and its context are held at a time.
        group: list[dict] = []
        for batch in batches:
            done: list[dict | None] = []
            for row in batch.to_pylist():
                if group and (row["c"], row["segment"]) != (group[0]["c"], group[0]["segment"]):
                    done.append(rendered(group))
                    group = []
                group.append(row)
            if any(done):
                yield pa.RecordBatch.from_pylist([row for row in done if row], schema=_SEGMENTS)
        if group and (last := rendered(group)):
            yield pa.RecordBatch.from_pylist([last], schema=_SEGMENTS)

    schema = "conv_id long, segment long, n_turns long, formatted string, loss array<struct<begin:long, end:long>>, rewritten_at long"
    return met.repartition("c", "segment").sortWithinPartitions("c", "segment", "place").mapInArrow(render, schema)


def digests(chats: DataFrame) -> DataFrame:
    """What an output of ``format_chats`` with the built-in template says, read back: one row for each conversation.

    Columns: conv_id, n_turns, turns_sha256 (of role, line break, text, line break for each turn), loss_chars and
    loss_sha256 (all text under the loss mask), formatted_chars.  Segments stream by in order; a digest holds no
    text, so a conversation of any length takes no memory, though its digest is one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        said, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = size = 0
        out: list[tuple] = []

        def close() -> None:
            if now is not run:
                out.append((now, n, said.hexdigest(), chars, loss.hexdigest(), size))

        def drained() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out], schema=kept)
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    close()
                    now, n, chars, size = row["conv_id"], 0, 0, 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                formatted = row["formatted"]
                for who, text in read_turns(formatted):
                    n += 1
                    said.update(f"{who}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(formatted[span["begin"] : span["end"]])
                    chars += len(text)
                    loss.update(text.encode())
                size += len(formatted)
            if out:
                yield drained()
        close()
        if out:
            yield drained()

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kept = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))))
    ordered = chats.select("conv_id", "segment", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
