"""Cutting oversized texts at natural boundaries, by agglomerative merging.

A text begins as atomic segments: words, and short stretches of runs that offer no boundary. The boundary between two
neighbours has a strength (paragraph, line, sentence, clause, space, mark, none). A heap of the adjacent pairs merges the
weakest boundary first, of equal ones the smallest pair, as long as the merged piece and the overlap it must repeat fit
the limit; what is left when nothing fits are the pieces. Each piece after the first repeats the last ``overlap``
characters before it.

Boundaries without strength (``none``) stand inside a run of characters that are neither white space nor a
sentence-ending mark. They are merged before all others, so one that is left shows a run that did not fit. The cut of a
text is ``forced`` if such a run alone is longer than the limit, else ``natural``; a run that only the overlap made too
long is cut too, at a boundary ``none``, but is no reason for a forced cut.

Texts within the limit, null and empty texts give no row. Rows that repeat an id are one record: the one with the largest
``order_column``, of equal ones the largest text (without that column, the largest text).
"""

from __future__ import annotations

import heapq
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that end a sentence, in any script.
STOPS = ".!?…。！？؟।॥｡．"
FORCED, MARK, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
NAMES = ("none", "mark", "space", "clause", "sentence", "line", "paragraph")
_RUN = re.compile(rf"[^\s{re.escape(STOPS)}]*")
_ATOM = re.compile(rf"[^\s{re.escape(STOPS)}]*(?:[{re.escape(STOPS)}]+[\"”“»’」』)\]）】]*)?\s*")
_GRAIN = 64


def _strength(atom: str) -> int:
    """Of the boundary after ``atom``."""
    body = atom.rstrip()
    gap = atom[len(body) :]
    if gap.count("\n") > 1:
        return PARAGRAPH
    if "\n" in gap or "\r" in gap:
        return LINE
    core = body.rstrip("\"”“»’」』)]）】")
    if core and core[-1] in STOPS and (gap or core[-1] not in ".…"):
        return SENTENCE
    if gap and core and core[-1] in ",;:，；：、،":
        return CLAUSE
    return SPACE if gap else MARK


def atoms(text: str) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary after it) of the atomic segments."""
    out = []
    for m in _ATOM.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        while b - a > 2 * _GRAIN:
            cut = a + _GRAIN
            while cut < b and unicodedata.combining(text[cut]):
                cut += 1
            out.append((a, cut, FORCED))
            a = cut
        out.append((a, b, _strength(text[a:b])))
    return out


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before it) of the pieces, without what they repeat."""
    return merge(atoms(text), limit, overlap)


def cut_kind(text: str, parts: list[tuple[int, int, int]], pieces: list[tuple[int, int, int]], limit: int) -> str:
    """forced if a boundary of the pieces was left inside a run that is longer than the limit, else natural."""
    place = {start: i for i, (start, _, _) in enumerate(parts)}
    for start, _, before in pieces:
        if before != FORCED:
            continue
        first = last = place[start]
        while first and parts[first - 1][2] == FORCED:
            first -= 1
        while parts[last][2] == FORCED and last + 1 < len(parts):
            last += 1
        if _RUN.match(text, parts[last][0]).end() - parts[first][0] > limit:
            return "forced"
    return "natural"


def merge(parts: list[tuple[int, int, int]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """The pieces that are left of the atoms when no pair fits any more."""
    n = len(parts)
    start, end = [p[0] for p in parts], [p[1] for p in parts]
    nxt, prv, alive = list(range(1, n)) + [-1], list(range(-1, n - 1)), [True] * n
    heap = [(parts[i][2], end[i + 1] - start[i], i, i + 1, end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    strength = [p[2] for p in parts]
    while heap:
        _, _, i, j, e = heapq.heappop(heap)
        if not alive[i] or not alive[j] or nxt[i] != j or end[j] != e:
            continue
        if end[j] - start[i] + min(overlap, start[i]) > limit:
            continue
        end[i], strength[i], alive[j] = end[j], strength[j], False
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
            heapq.heappush(heap, (strength[i], end[nxt[i]] - start[i], i, nxt[i], end[nxt[i]]))
        if prv[i] >= 0:
            heapq.heappush(heap, (strength[prv[i]], end[i] - start[prv[i]], prv[i], i, end[i]))
    out, before = [], PARAGRAPH
    for i in range(n):
        if alive[i]:
            out.append((start[i], end[i], before))
            before = strength[i]
    return out


def split_oversized(items: DataFrame, id_column: str, text_column: str, limit: int, overlap: int, order_column: str | None = None) -> DataFrame:
    """(item_id, cut_kind, piece_no, start_pos, end_pos, repeated, boundary, piece) of the texts over ``limit`` characters.

    ``piece`` is the text from start_pos to end_pos, of which the first ``repeated`` characters are those of the piece before.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    kind = items.schema[id_column].dataType.simpleString()
    schema = f"item_id {kind}, cut_kind string, piece_no int, start_pos bigint, end_pos bigint, repeated int, boundary string, piece string"

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for i, t in zip(pdf["item_id"], pdf["text"]):
                parts = atoms(t)
                pieces = merge(parts, limit, overlap)
                cut = cut_kind(t, parts, pieces, limit)
                for k, (a, b, s) in enumerate(pieces):
                    back = min(overlap, a)
                    rows.append((i, cut, k, a - back, b, back, NAMES[s] if k else "start", t[a - back : b]))
            yield pd.DataFrame(rows, columns=["item_id", "cut_kind", "piece_no", "start_pos", "end_pos", "repeated", "boundary", "piece"])

    order = [F.col(order_column).alias("o")] if order_column else []
    one = items.groupBy(F.col(id_column).alias("item_id")).agg(F.max(F.struct(*order, F.col(text_column).alias("text")))["text"].alias("text"))
    return one.filter(F.length("text") > limit).mapInPandas(run, schema)
