"""List-valued cells: parse, compare and align short codes inside one row.

Everything works on ``array<string>`` columns with built-in array functions, so
a comparison of code lists needs no shuffle beyond the keyed join.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import strip

# Width of one packed code, width of its group prefix, gap marker.
CODE_WIDTH = 4
PREFIX_WIDTH = 2
NO_MATCH = "No Match"
NO_DATA = "NO DATA"
# Control characters that part joined codes, and runs of them; lists that hold one are treated code by code.
_GAP, _BREAK = "\x01", "\x02"

# Cells of printable ASCII: a JSON array of texts without blanks, quotes and backslashes, and packed codes that are no array.
_PLAIN_TEXT = r'"[!#-&(-\[\]-~]*"'
_PLAIN_LIST = rf"^\[{_PLAIN_TEXT}(?:, *{_PLAIN_TEXT})*\]\z"
_PLAIN_PACKED = r"^[!-Z\\-~][!-~]*\z"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once however often ``use`` mentions it; NULL for NULL."""
    return F.get(F.transform(F.when(value.isNotNull(), F.array(value)), use), F.lit(0))


def parse_codes(c: Column, *, distinct: bool = True, empty_marker: str | None = None) -> Column:
    """Sorted codes of a cell: a JSON array, or packed 4-character chunks.

    ``distinct`` drops repeats.  ``empty_marker`` replaces an empty list by a
    one-element list holding the marker.
    """
    text = strip(c.cast("string"))

    def parse(text: Column) -> Column:
        listed = F.transform(F.from_json(F.regexp_replace(text, "'", '"'), "array<string>"), strip)
        packed = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CODE_WIDTH}}}"), F.lit(0))
        filled = F.filter(packed, lambda code: strip(code) != "")
        return F.when(text.isin("nan", ""), F.array().cast("array<string>")).otherwise(
            F.coalesce(
                F.when(text.startswith("[") & text.endswith("]"), F.array_remove(listed, "")),
                F.when(text.rlike(r"\s"), filled).otherwise(packed),
            )
        )

    # Most cells are lists of plain texts or packed without blanks, which a pattern tells: nothing to trim or unescape.
    cell = c.cast("string")
    listed = F.array_remove(F.split(F.substr(cell, F.lit(3), F.length(cell) - 4), '", *"'), "")
    chunks = F.regexp_extract_all(cell, F.lit(rf".{{1,{CODE_WIDTH}}}"), F.lit(0))
    plain = F.when(cell.rlike(_PLAIN_LIST), listed).when(cell.rlike(_PLAIN_PACKED) & (cell != "nan"), chunks)
    codes = plain.otherwise(F.coalesce(once(text, parse), F.array().cast("array<string>")))
    codes = F.sort_array(F.array_distinct(codes) if distinct else codes)
    if empty_marker is not None:
        codes = F.when(F.size(codes) == 0, F.array(F.lit(empty_marker))).otherwise(codes)
    return codes


def to_json_list(codes: Column) -> Column:
    return F.to_json(codes)


def only_in(first: Column, second: Column) -> Column:
    """Codes of ``first`` absent from ``second``, sorted; NULL counts as empty."""
    empty = F.array().cast("array<string>")
    return F.sort_array(F.array_except(F.coalesce(first, empty), F.coalesce(second, empty)))


def joined(codes: Column) -> Column:
    return F.array_join(codes, ", ")


def difference_text(own: Column, other: Column, empty_marker: str | None = NO_DATA) -> Column:
    """Text of the codes only ``own`` has; ``empty_marker`` if ``own`` has none at all."""
    text = joined(only_in(own, other))
    if empty_marker is None:
        return text
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, F.lit(empty_marker)).otherwise(text)


def _prefix(code: Column) -> Column:
    return F.substring(code, 1, PREFIX_WIDTH)


def aligned_pairs(left_only: Column, right_only: Column) -> Column:
    """Pair left-only with right-only codes that share a prefix, by position.

    The shorter side is padded with ``No Match``.  Returns
    ``array<struct<left:string,right:string>>``.
    """
    prefixes = F.sort_array(F.array_distinct(F.transform(F.concat(left_only, right_only), _prefix)))

    def pairs(prefix: Column) -> Column:
        ours = F.filter(left_only, lambda code: _prefix(code) == prefix)
        theirs = F.filter(right_only, lambda code: _prefix(code) == prefix)
        width = F.greatest(F.size(ours), F.size(theirs))
        return F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.struct(
                F.coalesce(F.get(ours, i), F.lit(NO_MATCH)).alias("left"),
                F.coalesce(F.get(theirs, i), F.lit(NO_MATCH)).alias("right"),
            ),
        )

    return F.flatten(F.transform(prefixes, pairs))


def prefix_conflicts(codes: Column) -> Column:
    """Codes sharing an upper-cased prefix, as ``P(a/b), Q(c/d)``; NULL if there are none.

    In a sorted list of upper-case codes those with one prefix stand side by side, so one pattern over the joined list
    finds them; other lists are gone through prefix by prefix.
    """
    joined = F.array_join(codes, _GAP)
    width = PREFIX_WIDTH
    code = f"[^{_GAP}]"
    # A code of the prefix's width at least, and those after it that begin alike.
    runs = F.regexp_extract_all(joined, F.lit(rf"(?<=^|{_GAP})({code}{{{width}}}){code}*(?:{_GAP}\1{code}*)+"), F.lit(0))
    marked = F.regexp_replace(F.array_join(runs, _BREAK), rf"(?<=^|{_BREAK})(.{{{width}}})", "$1($1")
    shown = F.concat(F.replace(F.replace(marked, F.lit(_BREAK), F.lit("), ")), F.lit(_GAP), F.lit("/")), F.lit(")"))
    plain = (joined == F.upper(joined)) & ~joined.rlike(rf"(?s)[{_BREAK}]|(^|{_GAP}){code}{{0,{width - 1}}}($|{_GAP})")
    sorted_ = (codes == F.sort_array(codes)) & (F.size(codes) == F.size(F.split(joined, _GAP, -1)))
    return F.when(plain & sorted_, F.when(F.size(runs) > 0, shown)).otherwise(_conflicts_by_prefix(codes))


def _conflicts_by_prefix(codes: Column) -> Column:
    upper = F.array_distinct(F.transform(codes, lambda code: F.upper(_prefix(code))))

    def described(prefix: Column) -> Column:
        members = F.filter(codes, lambda code: F.upper(_prefix(code)) == prefix)
        return once(
            members,
            lambda m: F.when(F.size(m) > 1, F.concat(prefix, F.lit("("), F.array_join(m, "/"), F.lit(")"))),
        )

    return F.nullif(F.array_join(F.transform(upper, described), ", "), F.lit(""))
