"""Guess header, key:value layout and delimiter from a few sample lines."""
from __future__ import annotations

import csv
from collections.abc import Sequence

HEADER_SAMPLE = 6
KEY_VALUE_SAMPLE = 20
SAMPLE_LINES = KEY_VALUE_SAMPLE + 1


def split_lines(lines: Sequence[str], sep: str = ",") -> list[list[str]]:
    """Sample lines as rows of cells, blank rows left out."""
    return [row for row in csv.reader(lines, delimiter=sep) if any(cell.strip() for cell in row)]


def _numbers(row: Sequence[str]) -> int:
    found = 0
    for cell in row:
        try:
            float(cell.strip())
        except ValueError:
            continue
        found += 1
    return found


def has_header(rows: Sequence[Sequence[str]]) -> bool:
    """The first row is a header if it has under half the numbers of an average following row."""
    following = rows[1:HEADER_SAMPLE]
    if not following:
        return False
    return _numbers(rows[0]) < 0.5 * sum(map(_numbers, following)) / len(following)


def is_key_value(rows: Sequence[Sequence[str]], header: bool = False) -> bool:
    """Over half of the non-blank cells between first and last hold a colon."""
    body = rows[1:] if header else rows
    middle = [cell for row in body[:KEY_VALUE_SAMPLE] for cell in row[1:-1] if cell.strip()]
    return bool(middle) and sum(":" in cell for cell in middle) > len(middle) / 2


SEPARATORS = (",", ";", "\t", "|")


def sniff(lines: Sequence[str]) -> str:
    """The separator that cuts the sample into the most cells per line, equally many in all lines if any does.

    A separator inside quotes does not count.  Without any, it is the comma.
    """

    def score(sep: str) -> tuple[bool, int]:
        widths = [len(row) for row in split_lines(lines, sep)]
        return (len(set(widths)) == 1 and widths[0] > 1, min(widths)) if widths and min(widths) > 1 else (False, 1)

    # The first of equals wins, so the comma is preferred.
    return max(SEPARATORS, key=score)


def delimiter(first_line: str) -> str:
    """Semicolon before tab before comma."""
    return next((sep for sep in (";", "\t") if sep in first_line), ",")
