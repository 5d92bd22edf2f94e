"""Problem 3: texts above a size limit cut at natural boundaries, with an overlap between consecutive pieces.

Agglomerative merging: a text starts as atomic segments, adjacent pairs wait in a heap by the strength of the boundary between
them, and the weakest boundary whose two sides fit together, overlap included, goes first. What cannot be merged any more is a piece.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import spread

#: Fixed value: Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = re.compile(f"[^{SPACE}]+")
PARAGRAPH = re.compile(f"(?:\r\n|\n|\r(?!\n)|[\x85 ])[{SPACE}]*[\n\r\x85 ]| ")
SENTENCE = re.compile(f"[.!?…。！？।؟۔][\"'”’»›)\\]」』）]*(?=[{SPACE}]+(?:[^a-z{SPACE}]))")
#: Fixed value: words with a period that seldom end a sentence.
ABBREVIATIONS = frozenset(
    "mr. mrs. ms. dr. prof. st. no. nos. vs. e.g. i.e. cf. approx. fig. sec. art. inc. corp. co. ltd. bros. jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec. u.s. a.m. p.m.".split()
)
BETWEEN_WORDS, SENTENCE_END, PARAGRAPH_END = 1, 2, 3


def atoms(text: str, starts: np.ndarray, ends: np.ndarray, first_most: int, most: int) -> tuple[list[int], list[int]]:
    """(first word of each atomic segment, strength of the boundary before it).

    Atoms are sentences; a sentence above the limit is a row of full slices, which is what merging its words from the left, all
    of them at equally weak boundaries, comes to.
    """
    n = len(starts)
    strength = np.zeros(n, np.int8)
    for m in SENTENCE.finditer(text):
        i = int(np.searchsorted(starts, m.end()))
        word = text[starts[i - 1] : ends[i - 1]]
        if i < n and word.lower() not in ABBREVIATIONS and not (len(word) == 2 and word[0].isupper()):
            strength[i] = SENTENCE_END
    for m in PARAGRAPH.finditer(text):
        i = int(np.searchsorted(starts, m.start()))
        if 0 < i < n:
            strength[i] = PARAGRAPH_END
    cuts = [0, *np.flatnonzero(strength).tolist(), n]
    firsts, strengths = [], []
    for a, b in zip(cuts, cuts[1:]):
        at = a
        while at < b:
            firsts.append(at)
            strengths.append(int(strength[a]) if at == a else BETWEEN_WORDS)
            at += first_most if at == 0 and b - at > first_most else most if at and b - at > most else b - at
    return firsts, strengths


def merge(firsts: list[int], strengths: list[int], n: int, first_most: int, most: int) -> list[int]:
    """The first words of the pieces of n words."""
    k = len(firsts)
    ends = [*firsts[1:], n]
    after, before = list(range(1, k + 1)), list(range(-1, k - 1))
    gone = [False] * k
    waiting = [(strengths[i], i) for i in range(1, k)]
    heapq.heapify(waiting)
    while waiting:
        _, j = heapq.heappop(waiting)
        i = before[j]
        # sizes only grow: a pair that does not fit now never will
        if ends[j] - firsts[i] <= (first_most if i == 0 else most):
            ends[i], gone[j], after[i] = ends[j], True, after[j]
            if after[j] < k:
                before[after[j]] = i
    return [f for f, g in zip(firsts, gone) if not g]


def cut_text(text: str | None, limit: int = 512, overlap: int = 64) -> list[tuple[int, int, int, int]]:
    """(start, own start, end, words) of each piece of text, as offsets; a piece after the first starts with overlapped words."""
    if not text:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(spans[0][0], spans[0][0], spans[-1][1], n)] if n else []
    starts, ends = np.array(spans).T
    most = limit - overlap
    cuts = [*merge(*atoms(text, starts, ends, limit, most), n, limit, most), n]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        back = max(a - overlap, cuts[len(out) - 1] - overlap if len(out) > 1 else 0, 0) if out else a
        out.append((int(starts[back]), int(starts[a]), int(ends[b - 1]), b - back))
    return out


def cut(df: DataFrame, keys: list[str], text: str = "text", limit: int = 512, overlap: int = 64, with_text: bool = True) -> DataFrame:
    """Pieces of at most limit words: keys, piece_no from 1, char_start, own_start, char_end, n_words and, if asked, piece.

    Offsets count code points of text. A piece after the first starts at char_start with the last overlap words of the one before
    it; its own words start at own_start. Null, empty and blank texts have no piece, repeated rows keep theirs each, and other
    columns of df are not read. No shuffle; the size of a task is that of its texts, however long one is.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    names = [*keys, "piece_no", "char_start", "own_start", "char_end", "n_words"] + ["piece"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            row, rest = [], []
            for i, t in enumerate(texts):
                for no, piece in enumerate(cut_text(t, limit, overlap), 1):
                    row.append(i)
                    rest.append((no, *piece))
            numbers = np.array(rest, np.int32).reshape(-1, 5).T
            at = pa.array(row, pa.int32())
            columns = [c.take(at) for c in batch.columns[: len(keys)]] + [pa.array(x) for x in numbers]
            if with_text:
                columns.append(pa.array([texts[i][p[1] : p[3]] for i, p in zip(row, rest)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [f"`{k}` {t}" for k, t in zip(keys, kinds)] + [f"{c} int" for c in names[len(keys) : len(keys) + 5]] + ["piece string"] * with_text
    return spread(df.select(*keys, F.col(text).alias("__text"))).mapInArrow(run, ", ".join(fields))
