"""Cutting oversized texts at natural boundaries, with a fixed overlap.

Every position of a text has a boundary strength: paragraph, line, sentence, clause, blank, or nothing.  A sparse
table answers "where is the strongest boundary in this window, the rightmost of equals" in constant time; each piece
ends there, and the next one begins ``overlap`` characters before.  The table covers a stretch of the text at a time,
so its size does not grow with the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary strengths: a cut is made in front of the position that has one.
NONE, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_BLANKS = np.array([9, 10, 12, 13, 32], np.uint32)
#: Marks that end a clause or a sentence before a blank, and marks that end a sentence by themselves.
_CLAUSE_MARKS = np.array([ord(c) for c in ",;:"], np.uint32)
_SENTENCE_MARKS = np.array([ord(c) for c in ".!?…"], np.uint32)
_WIDE_MARKS = np.array([ord(c) for c in "。！？"], np.uint32)


@dataclass(frozen=True)
class Limits:
    """Pieces hold at most ``size`` characters; consecutive ones share ``overlap``.  A boundary is first sought in
    the last ``1 - fill`` of the piece, then anywhere behind the overlap."""

    size: int = 2000
    overlap: int = 200
    fill: float = 0.5

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below size")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32)


def strengths(cp: np.ndarray) -> np.ndarray:
    """The strength of a cut before each position 0..n (the end of the text is a paragraph end)."""
    n = len(cp)
    out = np.zeros(n + 1, np.uint8)
    blank = np.isin(cp, _BLANKS)
    after = np.flatnonzero(blank) + 1  # a cut behind a blank
    out[after] = BLANK
    if n > 1:
        for marks, strength in ((_CLAUSE_MARKS, CLAUSE), (_SENTENCE_MARKS, SENTENCE)):
            out[np.flatnonzero(np.isin(cp[:-1], marks) & blank[1:]) + 2] = strength
    out[np.flatnonzero(np.isin(cp, _WIDE_MARKS)) + 1] = SENTENCE
    line = cp == 10
    out[np.flatnonzero(line) + 1] = LINE
    if n > 1:
        out[np.flatnonzero(line[:-1] & line[1:]) + 2] = PARAGRAPH
    # a cut inside a run of blanks belongs behind the run
    inside = np.flatnonzero(blank) + 0
    out[inside[out[inside] < LINE]] = NONE
    out[n] = PARAGRAPH
    return out


def strengths_between(text: str, low: int, high: int) -> np.ndarray:
    """The strengths of the positions low..high, both included, from the characters around them alone."""
    first = max(0, low - 2)
    part = text[first : min(len(text), high + 1)]
    return strengths(code_points(part))[low - first : high - first + 1]


class StrongestCut:
    """Sparse table over ``strength`` for windows of up to ``widest`` positions; ties go to the right."""

    def __init__(self, strength: np.ndarray, widest: int | None = None):
        n = len(strength)
        level = strength.astype(np.int64) * (n + 1) + np.arange(n)
        self.levels, self.n, width = [level], n, 1
        while 2 * width <= min(n, widest or n):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """(position, strength) of the strongest cut in low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        best = int(max(level[low], level[high - (1 << k) + 1]))
        return best % (self.n + 1), best // (self.n + 1)


#: Pieces whose boundaries one sparse table covers.
_STRETCH = 64


def cuts(text: str, limits: Limits = Limits()) -> list[tuple[int, int, int]]:
    """(begin, end, strength of the end) of each piece.  A text within the limit is one piece; an empty one none."""
    n, size = len(text), limits.size
    if n <= size:
        return [(0, n, PARAGRAPH)] if n else []
    out, begin, base, last, index = [], 0, 0, -1, None
    while n - begin > size:
        high = begin + size
        if high > last:
            base, last = begin, min(n, begin + _STRETCH * size)
            index = StrongestCut(strengths_between(text, base, last), size + 1)
        end, strength = index.query(max(begin + limits.overlap + 1, begin + int(size * limits.fill)) - base, high - base)
        if strength == NONE:
            end, strength = index.query(begin + limits.overlap + 1 - base, high - base)
        out.append((begin, base + end, strength))
        begin = base + end - limits.overlap
    out.append((begin, n, PARAGRAPH))
    return out


def longest_unbroken(text: str) -> int:
    """Length of the longest run without space, tab, line feed, carriage return or form feed."""
    longest, open_ = 0, 0  # open_: the run that reaches the end of what was read
    for lo in range(0, len(text), 1 << 20):
        cp = code_points(text[lo : lo + (1 << 20)])
        at = np.flatnonzero(np.isin(cp, _BLANKS))
        if not len(at):
            open_ += len(cp)
            continue
        inner = int(np.diff(at).max() - 1) if len(at) > 1 else 0
        longest = max(longest, open_ + int(at[0]), inner)
        open_ = len(cp) - 1 - int(at[-1])
    return max(longest, open_)


def stitched(pieces_: DataFrame, id_col: str = "id", limits: Limits = Limits()) -> DataFrame:
    """``(id_col, md5, within)``: the checksum of the text that the pieces make without their overlaps, and whether all
    are within the limit.  Pieces of one text meet, which together are as long as it was."""
    part = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.substring("text", limits.overlap + 1, limits.size))
    whole = pieces_.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("piece", part.alias("part")))).alias("p"), F.max("char_count").alias("n"))
    return whole.select(id_col, F.md5(F.array_join(F.transform("p", lambda x: x["part"]), "").cast("binary")).alias("md5"), (F.col("n") <= limits.size).alias("within"))


PIECES = "piece int, begin int, end int, text string, char_count int, strength int, longest_unbroken int"


def pieces(df: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = (), limits: Limits = Limits(), only_long: bool = False) -> DataFrame:
    """``(id_col, *keep, piece, begin, end, text, char_count, strength, longest_unbroken)``: the ordered pieces of
    every text; ``strength`` is that of the boundary at the piece's end (0: cut inside a word), ``longest_unbroken``
    that of the whole text.

    Null and empty texts have no piece.  ``only_long`` leaves out texts within the limit before they reach Python.
    Rows are cut each by itself: repeated ids give repeated pieces (see ``newest``).  No shuffle.
    """
    src = df.where(F.length(text_col) > limits.size) if only_long else df
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (id_col, *keep)), PIECES])
    extra = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if text:
                    run_length = longest_unbroken(text)
                    for k, (a, b, s) in enumerate(cuts(text, limits)):
                        at.append(i)
                        rows.append((k, a, b, text[a:b], b - a, s, run_length))
            cols = list(zip(*rows)) or [[]] * len(extra)
            types_ = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, cols, types_)], [id_col, *keep, *extra])

    return src.select(id_col, *keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def newest(df: DataFrame, id_col: str = "id", time_col: str = "created_at") -> DataFrame:
    """One row for each id: the latest by ``time_col`` (null times last; of equals any, as re-delivered rows agree)."""
    others = [c for c in df.columns if c != id_col]
    order = F.struct(F.col(time_col).isNotNull(), time_col)
    return df.groupBy(id_col).agg(F.max_by(F.struct(*others), order).alias("_r")).select(id_col, *(F.col("_r")[c].alias(c) for c in others))
