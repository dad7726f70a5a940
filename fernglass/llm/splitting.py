"""Splitting oversized items at natural boundaries.

Every line end gets a boundary strength. The cut of each piece is the
strongest boundary in the window of permissible lengths, found with a sparse
table for range maxima (two overlapping power-of-two spans answer any range),
the rightmost of equals. The next piece starts ``overlap`` lines before the
cut.

Defined results: items within the limit yield nothing; a null limit means no
limit; a limit below 1 counts as 1; an overlap of the limit or more is lowered
so that every piece advances; a null or empty text has no lines; null start
lines count from 1. Lines end with LF or CRLF and are kept whole, so joining
the non-overlapping parts of all pieces gives back the item's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PIECES = "item_id string, piece int, n_pieces int, start_line int, end_line int, n_lines int, strength int, text string"

_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^#{1,6}\s")
_CLOSER = re.compile(r"^\s*[\])}]+[;,)]*\s*$")
_TABLE_OR_LIST = re.compile(r"^\s*(\||[-*+]\s|\d+[.)]\s)")


def strengths(lines: list[str], prose: bool) -> np.ndarray:
    """Strength of the boundary after each line: 0 within a statement or fence, more for outer ends."""
    n = len(lines)
    out = np.zeros(n, dtype=np.int16)
    indent = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    fenced = False
    for i, line in enumerate(lines):
        nxt = lines[i + 1] if i + 1 < n else ""
        if prose:
            if _FENCE.match(line):
                fenced = not fenced
            if fenced:
                continue
            if _HEADING.match(nxt):
                out[i] = 9
            elif not line.strip():
                out[i] = 6
            elif _HEADING.match(line):
                out[i] = 0
            elif _TABLE_OR_LIST.match(nxt):
                out[i] = 3
            else:
                out[i] = 2 if line.rstrip().endswith((".", "!", "?", ":")) else 1
        else:
            depth = min((x for x in (indent[i], indent[i + 1] if i + 1 < n else 0) if x >= 0), default=0)
            outer = max(0, 4 - depth // 2)
            if not line.strip():
                out[i] = 4 + outer
            elif _CLOSER.match(line):
                out[i] = 3 + outer
            elif line.rstrip().endswith((";", "}")):
                out[i] = 1 + outer
            elif line.rstrip().endswith(("*/", "{")):
                out[i] = 0
    return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds, for each i, the position of the maximum of ``values[i : i + 2**k]``, rightmost of equals."""
    at = np.arange(len(values))
    levels, span = [at], 1
    while 2 * span <= len(values):
        left, right = levels[-1][: len(values) - 2 * span + 1], levels[-1][span : len(values) - span + 1]
        levels.append(np.where(values[right] >= values[left], right, left))
        span *= 2
    return levels


def strongest(levels: list[np.ndarray], values: np.ndarray, lo: int, hi: int) -> int:
    """Position of the maximum in ``lo..hi`` (both included), rightmost of equals."""
    k = (hi - lo + 1).bit_length() - 1
    a, b = levels[k][lo], levels[k][hi - (1 << k) + 1]
    return int(b if values[b] >= values[a] else a)


def cuts(values: np.ndarray, limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int, int]]:
    """(first, last, strength) of each piece, 0-based lines."""
    n = len(values)
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    short = min(limit, max(overlap + 1, int(limit * least)))
    levels = sparse_table(values)
    out, s = [], 0
    while n - s > limit:
        c = strongest(levels, values, s + short - 1, s + limit - 1)
        out.append((s, c, int(values[c])))
        s = c + 1 - overlap
    out.append((s, n - 1, -1))
    return out


def split_oversized(items: DataFrame) -> DataFrame:
    """Pieces of every item over its limit.

    ``items`` has item_id string, text string (exactly the item's lines),
    first_line int, limit int, overlap int, prose boolean; other columns are
    ignored. Only oversized items should be passed (others yield nothing): each
    row is handled by itself, so work follows the bytes of those items and no
    shuffle is needed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item_id, text, first, limit, overlap, prose in zip(pdf.item_id, pdf.text, pdf.first_line, pdf.limit, pdf.overlap, pdf.prose, strict=True):
                if not text or pd.isna(limit):
                    continue
                lines = text.split("\n")
                if lines[-1] == "":
                    lines.pop()
                if len(lines) <= max(1, limit):
                    continue
                base = 1 if pd.isna(first) else int(first)
                v = strengths([x.rstrip("\r") for x in lines], bool(prose))
                pieces = cuts(v, int(limit), 0 if pd.isna(overlap) else int(overlap))
                for i, (a, b, w) in enumerate(pieces):
                    rows.append((item_id, i, len(pieces), base + a, base + b, b - a + 1, w, "\n".join(lines[a : b + 1])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return items.select("item_id", "text", "first_line", "limit", "overlap", "prose").mapInPandas(run, PIECES)
