"""Splitting oversized texts at natural boundaries by recursive bisection.

A text of more code points than its limit is cut at the strongest boundary near its midpoint - paragraph, turn, line,
sentence, word, value, in that order - and each half that still exceeds the limit minus the overlap is cut again. Overlaps are
attached last: every piece but the first starts ``overlap`` code points before its own part, so neighbours share exactly
those and no piece is above the limit. The pieces' own parts, joined, are the text.

Cases: null and empty texts, and texts within the limit, give no pieces. A text without any boundary is cut at the
midpoint, but not inside a run of combining marks where there is another place. Repeated rows are split once per
(origin, id, text). An overlap of half the limit or more can't be attached to pieces cut at midpoints: the operator gives such
limits the greatest overlap below half, so pieces stay within them; negative and null overlaps count as 0, and limits that
aren't positive cut nothing.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak; a cut is at the end of the match.
BOUNDARIES = [
    re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:(?:\r\n|\r|\n)[^\S\r\n]*)+"),  # paragraph: a blank line
    re.compile(r"(?:\r\n|\r|\n)(?=[^\W\d_][\w .-]{0,30}: )"),  # turn: a line that names its speaker
    re.compile(r"\r\n|\r|\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*"),
    re.compile(r"\s+"),
    re.compile(r"[}\])],|[,;|&/、，；]"),  # within text without white space: the end of a value
]
#: A cut falls within this share of a part on either side of its midpoint, if there is a boundary.
NEAR = 0.25


def _nearest(at: list[int], middle: int, lo: int, hi: int) -> int | None:
    """The member of ``at`` nearest to ``middle`` within [lo, hi]."""
    i, j = bisect_left(at, lo), bisect_right(at, hi)
    if i >= j:
        return None
    k = bisect_left(at, middle, i, j)
    return min(at[max(i, k - 1) : min(j, k + 1)], key=lambda x: abs(x - middle))


def piece_bounds(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own, end) of each piece: it is text[start:end], and text[start:own] is shared with the piece before."""
    if len(text) <= limit:
        return []
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half of the limit")
    room = limit - overlap
    places: dict[int, list[int]] = {}

    def of(level: int) -> list[int]:
        if level not in places:
            places[level] = [m.end() for m in BOUNDARIES[level].finditer(text)]
        return places[level]

    def cut(lo: int, hi: int) -> int:
        middle, reach = (lo + hi) // 2, max(1, int((hi - lo) * NEAR))
        low = max(lo + 1, middle - reach, overlap if lo == 0 else 0)
        for span in ((low, middle + reach), (max(lo + 1, overlap if lo == 0 else 0), hi - 1)):
            for level in range(len(BOUNDARIES)):
                if (x := _nearest(of(level), middle, *span)) is not None:
                    return x
        at = middle
        while at > lo + 1 and unicodedata.combining(text[at]) and middle - at < 32:
            at -= 1
        return at if not unicodedata.combining(text[at]) else middle

    parts, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        # the first part has no overlap to carry
        if hi - lo <= (limit if lo == 0 else room):
            parts.append((lo, hi))
            continue
        x = cut(lo, hi)
        todo += [(x, hi), (lo, x)]
    return [(max(0, lo - overlap) if lo else 0, lo, hi) for lo, hi in parts]


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for origin, item, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            for seq, (start, own, end) in enumerate(piece_bounds(text, limit, min(max(overlap or 0, 0), (limit - 1) // 2))):
                out.append((origin, item, seq, start, own, end, text[start:end]))
                held += end - start
            if held > 1 << 22:  # bounded output batches, however long a text is
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of ``items(origin, item_id, text)`` above their origin's limit in ``limits(origin, max_chars, overlap_chars)``.

    Columns: origin, item_id, seq, start, own_start, end (code points of the stored text) and piece. ``limits`` has a row
    per origin and is broadcast only within the checked size. Only oversized texts leave the JVM.
    """
    from memloom.session import small

    lim = small(limits.select("origin", "max_chars", "overlap_chars").where("max_chars > 0"))
    over = items.select("origin", "item_id", "text").where(F.col("text").isNotNull()).join(lim, "origin").where(
        F.char_length("text") > F.col("max_chars")
    )
    fields = [("origin", pa.string()), ("item_id", pa.int64()), ("seq", pa.int32()), ("start", pa.int32()),
              ("own_start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())]
    schema = pa.schema(fields)
    return over.select("origin", "item_id", "text", "max_chars", "overlap_chars").mapInArrow(
        lambda batches: _pieces(batches, schema),
        "origin string, item_id bigint, seq int, start int, own_start int, end int, piece string",
    )
