"""Encoding a corpus with a public byte-level BPE tokenizer.

Vectorised pre-tokenisation: code points map to classes through an array; the left context of every character - a state
of a small automaton - comes from an associative scan over transition functions, of which only the apostrophe's is not
constant; boundaries then follow from state, class and next class, without a regular expression. Each distinct slice is
merged once per worker and kept; byte offsets are kept where they are asked for, so ids can be decoded to their place.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.arrow import blocks, codepoints, list_array
from memloom.session import spread

#: Where the vocabularies lie unless a caller says otherwise.
TOKENIZER_DIR = "/opt/tokenizers"
#: Distinct slices kept per worker; beyond it the store is emptied and filled again.
KEPT_SLICES = 400_000

LETTER, NUMBER, OTHER, QUOTE, SPACE, BLANK = range(6)
_B, _P, _L, _N, _O, _A = range(6)  # after: boundary, space, letters, numbers, others, an apostrophe that began a slice
#: Transition functions by class, as tables over the states; only the apostrophe's isn't constant.
_FUNCTIONS = np.array(
    [[_L] * 6, [_N] * 6, [_O] * 6, [_A, _O, _A, _A, _O, _O], [_P] * 6, [_B] * 6], dtype=np.uint8
)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point; white space is the Unicode property White_Space."""
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
        elif kind == "Z":
            out[c] = BLANK
    out[[9, 10, 11, 12, 13, 0x85]] = BLANK
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    return out


def slice_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Flags of the characters that begin a slice; ``firsts`` are the places at which texts begin."""
    n = len(points)
    kind = classes()[points]
    head = np.zeros(n + 1, dtype=bool)
    head[firsts] = True
    head[n] = True
    # Inclusive scan of transition functions. All but the apostrophe's are constant, so a prefix ending in one is known
    # from that function alone; the apostrophe composed with itself is constant too (OTHER), so one round closes the scan.
    known = (kind != QUOTE) | head[:n]
    after = _FUNCTIONS[kind, _B]
    todo = np.flatnonzero(~known)
    after[todo] = np.where(known[todo - 1], _FUNCTIONS[QUOTE][after[todo - 1]], _O)
    prev = np.empty(n, dtype=np.uint8)
    prev[0] = _B
    prev[1:] = after[:-1]
    prev[head[:n]] = _B
    blank = kind >= SPACE
    first = head[:n]
    prev_blank = np.zeros(n, dtype=bool)
    prev_blank[1:] = blank[:-1]
    prev_blank[first] = False
    next_solid = np.zeros(n, dtype=bool)
    next_solid[:-1] = ~blank[1:] & ~head[1:n]
    # solid characters: same run continues, or the space before is attached
    same = ((prev == _L) & (kind == LETTER)) | ((prev == _N) & (kind == NUMBER))
    same |= ((prev == _O) | (prev == _A)) & ((kind == OTHER) | (kind == QUOTE))
    start = np.where(blank, ~prev_blank | next_solid, ~same & (prev != _P))
    start |= first
    # contractions at apostrophes that began a slice
    at = np.flatnonzero((after == _A) & (kind == QUOTE))
    at = at[(at + 1 < n)]
    at = at[~head[at + 1]]
    if len(at):
        one = points[at + 1]
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        longer = np.zeros(len(at), dtype=bool)
        two_ok = (at + 2 < n) & ~head[np.minimum(at + 2, n)]
        two = points[np.minimum(at + 2, n - 1)]
        for a, b in ("re", "ve", "ll"):
            longer |= two_ok & (one == ord(a)) & (two == ord(b))
        for hit, size in ((at[short], 2), (at[longer], 3)):
            start[hit + 1] = False
            end = hit + size
            start[end[end < n]] = True
    return start


def merge(ranks: dict[bytes, int], piece: bytes) -> tuple[int, ...]:
    """Ids of one slice: the adjacent pair of least rank is merged until none can be; O(n log n) for any length."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if n < 256:  # pair ranks are kept and only those beside a merge looked up again
        none = len(ranks)
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(n - 1)]
        while pairs and (r := min(pairs)) < none:
            i = pairs.index(r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return tuple([ranks[p] for p in parts])
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = end[i]
        if j >= n or end[j] != stop or not alive[j]:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


@lru_cache(4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Ids of whole texts, many at a time; null and empty texts have none."""

    def __init__(self, path: str):
        self.ranks = ranks_of(path)
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, slices: list[str]) -> list[tuple[int, ...]]:
        if len(self.known) > KEPT_SLICES:
            self.known.clear()
        found = list(map(self.known.get, slices))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    s = slices[i]
                    ids = self.known.get(s)
                    if ids is None:
                        ids = merge(self.ranks, s.encode("utf-8", "replace"))
                        if len(s) <= 256:
                            self.known[s] = ids
                    found[i] = ids
        return found

    def slices(self, texts: list) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, str]:
        """Ids of each slice, characters at which slices begin (and the end), slices before each text, the joined text."""
        sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
        joined = "".join(t for t in texts if t)
        ends = np.cumsum(sizes)
        if not joined:
            return [], np.zeros(1, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64), ""
        firsts = (ends - sizes)[sizes > 0]
        at = np.flatnonzero(slice_starts(codepoints(joined), firsts))
        marks = np.append(at, len(joined))
        m = marks.tolist()
        ids = self._of([joined[a:b] for a, b in itertools.pairwise(m)])
        return ids, marks, np.concatenate([[0], np.searchsorted(at, ends)]), joined

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each text has."""
        ids, _, before, _ = self.slices(texts)
        per = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        upto = np.concatenate([[0], np.cumsum(per)])
        flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(upto[-1]))
        return flat, np.diff(upto[before])

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of each token of one text: the offsets in its UTF-8 form."""
        words = {v: k for k, v in self.ranks.items()}
        out, at = [], 0
        for i in self.encode([text])[0].tolist():
            out.append((i, at, at := at + len(words[i])))
        return out


def vocabulary(name: str, folder: str = TOKENIZER_DIR) -> str:
    return str(Path(folder, f"{name}.tiktoken"))


def shipped(spark: SparkSession, name: str, folder: str) -> str:
    """The name under which workers find a vocabulary: the driver's file goes to every executor, which needs none of its own.

    Byte-level vocabularies alone are known here; a name without one is refused before any task starts.
    """
    path = Path(vocabulary(name, folder))
    if not path.is_file():
        raise ValueError(f"no byte-level vocabulary {name!r} in {folder}; there are {sorted(p.stem for p in Path(folder).glob('*.tiktoken'))}")
    spark.sparkContext.addFile(str(path))
    return path.name


def _encoded(batches: Iterator[pa.RecordBatch], path: str, counts_only: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(SparkFiles.get(path))
    for batch in batches:
        key, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in blocks(texts):
            flat, per = encoder.encode(texts[a:b])
            out = pa.array(per, pa.int32()) if counts_only else list_array(per, pa.array(flat))
            yield pa.RecordBatch.from_arrays([key.slice(a, b - a), out], ["doc_id", "n_tokens" if counts_only else "ids"])


def encode_corpus(docs: DataFrame, tokenizer: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text",
                  folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``; one row out for each row in, repeats included.

    Empty and null texts have an empty list; strings that look like special tokens are ordinary text. Nothing is shuffled
    unless the input has fewer partitions than the cluster runs tasks.
    """
    path = shipped(docs.sparkSession, tokenizer, folder)
    return spread(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))).mapInArrow(
        lambda batches: _encoded(batches, path, False), "doc_id bigint, ids array<int>"
    )


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text",
                 folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs``, as :func:`encode_corpus` but without the ids."""
    path = shipped(docs.sparkSession, tokenizer, folder)
    return spread(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))).mapInArrow(
        lambda batches: _encoded(batches, path, True), "doc_id bigint, n_tokens int"
    )
