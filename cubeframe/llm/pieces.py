"""Splitting oversized texts at natural boundaries: balanced targets, each snapped to the strongest boundary nearby.

A text of N tokens needs at least n pieces of at most ``limit`` tokens when each repeats the last ``overlap`` of the one
before. n - 1 targets of equal distance are set; each moves to the strongest boundary within a quarter of the limit (a
cell's start, then an empty line, a line, a sentence, a space, any character; of equals the nearest); if a piece is then
above the limit, n grows by one. Tokens are those of ByT5: one per byte of UTF-8, without end mark.

A character is never cut: where the 128th token back lies inside a character, the overlap begins at that character, so it
has ``overlap`` to ``overlap`` + 3 tokens. Texts and cells under the limit never leave the JVM.

Defined results: null and short texts give no rows; null, falling or outlying cell starts are left out; every piece
without its overlap, put together in order, is the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4096, 128

_KIND = "array<struct<cell_no:int,piece:int,pieces:int,char_from:int,char_to:int,n_tokens:int>>"


def _sizes(codes: np.ndarray) -> np.ndarray:
    """Tokens before each character."""
    return np.r_[0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))]


def _strengths(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Strength of a cut before each character."""
    s = np.zeros(len(codes) + 1, np.int8)
    if len(codes) > 1:
        before = codes[:-1]
        space = (before == 32) | (before == 9) | (before == 0xA0)
        s[1:-1][space] = 1
        stop = (codes == 46) | (codes == 33) | (codes == 63) | (codes == 0x3002)
        s[2:-1][space[1:] & stop[:-2]] = 2
        line = before == 10
        s[1:-1][line] = 3
        s[2:-1][line[1:] & (codes[:-2] == 10)] = 4
        s[1:-1][codes[1:] == 10] = np.minimum(s[1:-1], 1)[codes[1:] == 10]  # rather after the last line break
    s[starts[(starts > 0) & (starts < len(codes))]] = 5
    return s


def _check(limit: int, overlap: int) -> None:
    """A piece must go on by a character of four bytes at least, beyond an overlap that is rounded up to a character."""
    if not 0 <= overlap <= limit - 8:
        raise ValueError(f"an overlap of {overlap} leaves no room in pieces of {limit}")


def cut(sizes: np.ndarray, strengths: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first character, character after the last) of each piece, overlap included."""
    _check(limit, overlap)
    total, most = int(sizes[-1]), overlap + 3
    if total <= limit:
        return [(0, len(sizes) - 1)]
    n = 1 + -(-(total - limit) // (limit - overlap))
    reach = limit // 4
    while True:
        length = (total + (n - 1) * most) / n
        out, start = [], 0
        for i in range(1, n):
            target = i * length - (i - 1) * most
            # characters at which this piece may end: nearby, within the limit, and beyond the overlap
            low = np.searchsorted(sizes, max(target - reach, sizes[start] + most + 1, (out[-1][1] and sizes[out[-1][1]] + 1) if out else 1))
            high = np.searchsorted(sizes, min(target + reach, sizes[start] + limit), "right") - 1
            if low > high:
                low = high
            s = strengths[low : high + 1]
            best = np.flatnonzero(s == s.max()) + low
            end = int(best[np.argmin(np.abs(sizes[best] - target))])
            if out and end <= out[-1][1] or end <= start:
                break
            out.append((start, end))
            start = int(np.searchsorted(sizes, sizes[end] - overlap, "right")) - 1
        else:
            if total - sizes[start] <= limit:
                return [*out, (start, len(sizes) - 1)]
        n += 1


def split_text(text: str, cell_starts, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces of the text (cell 0) and of every cell above the limit: cell, piece, pieces, from, to, tokens."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = _sizes(codes)
    starts = np.array([x for x in (cell_starts if cell_starts is not None else []) if x is not None and x == x], np.int64)
    numbers = np.array([k for k, x in enumerate(cell_starts if cell_starts is not None else [], 1) if x is not None and x == x], np.int64)
    good = (starts >= 0) & (starts <= len(codes)) & (starts >= np.maximum.accumulate(starts) if len(starts) else True)
    starts, numbers = starts[good], numbers[good]
    strengths = _strengths(codes, starts)
    parts = [(0, 0, len(codes))] + list(zip(numbers.tolist(), starts.tolist(), [*starts[1:].tolist(), len(codes)]))
    out = []
    for cell, a, b in parts:
        if sizes[b] - sizes[a] > limit:
            p = cut(sizes[a : b + 1] - sizes[a], strengths[a : b + 1], limit, overlap)
            out += [(cell, k, len(p), a + i, a + j, int(sizes[a + j] - sizes[a + i])) for k, (i, j) in enumerate(p, 1)]
    return out


def split_oversized(docs: DataFrame, doc: str = "doc_id", text: str = "text", cell_starts: str = "cell_starts", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """doc, cell_no (0: the document), piece, pieces, char_from, char_to, n_tokens and, if wanted, the piece's text."""
    _check(limit, overlap)

    @F.pandas_udf(_KIND)
    def pieces(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, s, limit, overlap) for t, s in zip(texts, starts)])

    large = docs.select(doc, F.col(text).alias("_text"), F.col(cell_starts).alias("_starts")).where(F.octet_length("_text") > limit)
    rows = large.withColumn("_p", F.explode(pieces("_text", "_starts")))
    out = rows.select(doc, "_p.*", *([F.substring("_text", F.col("_p.char_from") + 1, F.col("_p.char_to") - F.col("_p.char_from")).alias("text")] if with_text else []))
    return out
