"""Pages of strung-together keywords, bare links or product tags.

Each text is cut into lines, and lines into blocks. A page is a sequence of terms: its words, and one term per kind for each
link, price and hash tag. What decides is how terms recur:

* *gaps*: the distances at which a term comes back. Sentences repeat function words at irregular gaps and content words far
  apart; stuffed text repeats its few content terms, a list its links, prices or tags, at short or constant gaps;
* *positional autocorrelation*: the greatest share of places that repeat the term a fixed lag before, over windows of lags up to
  half of the sequence;
* *lists of distinct nouns*: blocks with next to no function words and no sentence form, whose terms hardly recur at all.

Lines that are tables, code, logs, check output, encoded data or headings by their form, and sentences, are none of the
sought whatever recurs in them. A page is found if the characters of the blocks found are more than half of its characters,
white space apart. Null, empty and blank texts are never found. All figures are fixed values, the same at every size;
nothing is fitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memloom.session import spread

#: Fixed value: share of a page's characters that must be junk.
SHARE = 0.5
#: Words between two links or tags of a list at most, and between two prices; characters between them at most.
LIST_GAP, PRODUCT_GAP, LIST_CHARS = 6, 24, 40
#: Function words by language (fixed values).
FUNCTION_WORDS = frozenset(
    # English
    "a an the of to and or nor but if so that this these those it its is are was were be been by for from with without within "
    "on at as into onto out over under after before since until while when whenever where whether why how what which who whom "
    "whose not no nobody never none every each any some all both than then there their they them he she his her we us our you "
    "your i my me do does did has have had can could must may might shall should will would against because although though "
    "even unless despite between about more most once again only just also too other another "
    # German
    "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist sind war waren wird werden wurde hat "
    "haben wir sie er es ich ihr von vom zu zum zur mit ohne nach vor seit bis bei für gegen durch um als wie wenn weil dass ob "
    "obwohl warum noch nie nur auch aus auf in im am an jeden jede jedes niemand bitte "
    # French
    "le la les l un une des du de d à et ou mais ni ne pas plus que qui quoi dont où est sont était il elle ils elles on nous vous "
    "je ce cet cette ces son sa ses leur leurs au aux en dans par pour sur sous avec sans avant après depuis pendant chaque "
    "personne pourquoi n s c j qu faudra côté "
    # Spanish
    "el los las lo al del y o u pero ni no más que quien quién se es son era fue hay ha han su sus un una unos unas con sin por "
    "para según desde hasta hacia entre sobre antes después cada todo todos nadie porque cuando donde como solo ya "
    # Russian
    "и а но или не ни что чтобы как где когда почему потому это этот эта эти тот та те он она оно они мы вы я их его её в во на "
    "с со из за от до по под над при про для без через о об у к ко же ли бы ещё еще уже только каждый никто нужно все всё".split()
)
#: Commerce prepositions that stuffed text uses as keywords are no sign of a sentence by themselves (fixed values).
WEAK = frozenset("in en me pas no for".split())

_LINK = re.compile(r"(?:https?://|www\.)[^\s\"'<>\])]+|(?<![\w@./-])(?:[\w-]+\.)+[a-z]{2,12}(?:/[^\s\"'<>\])]*)?(?![\w])", re.I)
_TAG = re.compile(r"</?[a-z][^>]*>", re.I)
_CONTENT = re.compile(r"=\s*[\"']([^\"'<>]*\s[^\"'<>]*)[\"']")  # attribute values of several words
_BBCODE = re.compile(r"\[/?(?:url|b|i|img|size|color)\b[^\]]*\]", re.I)
_WORDS = re.compile(r"[^\W_]+")
_PRICE = re.compile(r"(?:[$€£¥₽]\s?\d[\d.,]*|\d[\d.,]*\s?(?:EUR|USD|GBP|JPY|RUB|CNY|руб|元|円|€|\$|£|₽))", re.I)
_HASHTAG = re.compile(r"(?<!\w)#[^\W\d_][\w-]*")
_BULLET = re.compile(r"^\s*(?:[-*•+]|\d+[.)]|\[[ xX]\]|[-*] \[[ xX]\])\s+")
_LOG = re.compile(r"^\[?\d[\d:., TZ/+-]{7,}\]?\s+\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b")
_CHECK = re.compile(r"(?:\.\.\.+|:)\s*(?:ok|failed|passed|skipped|ignored|error)\s*$", re.I)
_CODE = re.compile(
    r"^\s*(?:def |class |return\b|let |const |var |import |from \w+ import|if .*:$|elif |else:|for .*:$|while .*:$|fn |func |#include|//|/\*|\}|\{|@\w+)"
    r"|[\w\])]\s*(?:\+=|-=|==|!=|=>|->|:=|&&|\|\|)\s*\S|\w\(.*\)\s*[;:{]|\w::\w|^[^;]*;\s*$|^\s*[\w.-]+\s*=\s*\S|^\s*[\w-]+:\s+[A-Z0-9_]+(?:[.,]\d+)*\s*(?:#|$)"
)
_JSON = re.compile(r"^\s*[\[{].*[\]}],?\s*$|^\s*\"[^\"]+\"\s*:")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_CJK_SENTENCE = re.compile(r"[぀-ゟ]{2}[。、]|[はがをにでとも][㐀-鿿゠-ヿA-Za-z]|[了的着过在是]|。")
_LOG_START, _CHECK_END = frozenset("[0123456789"), tuple(x for w in ("ok", "failed", "passed", "skipped", "ignored", "error") for x in (w, w.upper(), w.capitalize()))
# What a line must hold for the patterns above to be worth trying.
_MAY_CODE, _MAY_LINK = re.compile(r"[=(){};:\[\]&|@#/]|^(?:return|import|class|else)\b"), re.compile(r"://|www\.|[\w-]\.[a-z]{2}", re.I)
_MAY_PRICE = re.compile(r"[$€£¥₽元円]|EUR|USD|GBP|JPY|RUB|CNY|руб", re.I)
_KNOWN = re.compile("[a-zß-ɏЀ-ӿ぀-ヿ㐀-鿿가-힯]", re.I)  # scripts with function words above, or sentence marks
_STOP = re.compile(r"[.!?…。！？]+(?:[\"'”’»)\]」]*)(?:\s|$)")
_FENCE = ("```", "~~~")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_LEET = str.maketrans("0134578@$", "oleastbas")

LEGIT, LISTED, WORDS = range(3)
#: The terms that stand for a link, a price and a hash tag.
LINK, PRICE, TAG = "\0link", "\0price", "\0tag"
#: Lags looked at one by one; longer ones where a gap names them.
NEAR_LAGS = 32


def recurrence(terms: list[str]) -> tuple[float, float, float]:
    """Of a term sequence: the share of the terms that recur at regular gaps - short ones, or constant ones of any length; the
    greatest share of places that repeat the term a fixed lag before; and the share of its two commonest terms."""
    n = len(terms)
    if n < 6:
        return 0.0, 0.0, 0.0
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(t, len(number)) for t in terms])
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    gaps = np.diff(order)[sorted_codes[1:] == sorted_codes[:-1]]
    whose = sorted_codes[1:][sorted_codes[1:] == sorted_codes[:-1]]
    count = np.bincount(codes)
    top = float(np.sort(count)[-2:].sum()) / n
    if not len(gaps):
        return 0.0, 0.0, top
    again = np.maximum(count - 1, 1)
    mean = np.bincount(whose, gaps, len(count)) / again
    spread = np.sqrt(np.maximum(np.bincount(whose, gaps.astype(float) ** 2, len(count)) / again - mean**2, 0))
    steady = (count > 1) & ((mean <= 16) & (spread <= 1.1 * mean) | (count > 3) & (spread <= 0.2 * mean))
    seen, often = np.unique(gaps, return_counts=True)
    long = seen[(seen > NEAR_LAGS) & (seen <= n // 2)]
    lags = [*range(1, min(NEAR_LAGS, n // 2) + 1), *long[np.argsort(-often[(seen > NEAR_LAGS) & (seen <= n // 2)], kind="stable")[:4]].tolist()]
    lag = max(np.count_nonzero(codes[k:] == codes[:-k]) / (n - k) for k in lags)
    return float(count[steady].sum()) / n, float(lag), top


def listed(terms: list[str], chars: int) -> bool:
    """Whether links, prices or tags recur in a sequence as in a list: at gaps of few words or characters, the ends of the
    sequence counted as recurrences, and no gap far beyond the others."""
    at = [i for i, t in enumerate(terms) if t[0] == "\0"]
    if not at:
        return False
    gaps = [b - a - 1 for a, b in zip([-1, *at], [*at, len(terms)])]
    mean = (len(terms) - len(at)) / len(at)
    spread = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    limit = PRODUCT_GAP if all(terms[i] == PRICE for i in at) else LIST_GAP
    return (mean <= limit or chars < LIST_CHARS * len(at)) and spread <= 1.1 * mean + LIST_GAP


def _may_link(line: str) -> bool:
    return "." in line and ("://" in line or _MAY_LINK.search(line) is not None)


def _by_form(line: str) -> bool:
    """Whether a line is a table row, heading, code, log, check output or encoded data by its form alone."""
    c = line[0]
    if c == "|" and line[-1] == "|" or c == "#" and line[1:2] in " #" or c == ">" and line[1:2] == " ":
        return True
    if c in _LOG_START and _LOG.match(line) or line.endswith(_CHECK_END) and _CHECK.search(line):
        return True
    if "<" in line and _TAG.search(line) or "[" in line and _BBCODE.search(line):
        return False
    if c in '[{"' and _JSON.match(line):
        return not line.startswith("[") or "{" in line or '"' in line
    if _MAY_CODE.search(line) and _CODE.search(line) or len(line) >= 40 and _ENCODED.search(line):
        return not (_may_link(line) and _LINK.search(line))
    return False


def _line(line: str) -> tuple[int, list[str], float]:
    """Kind of a line, its terms, and the share of its words that are function words."""
    if _by_form(line):
        return LEGIT, [], 0.0
    bare, linked, marked = line, 0, []
    if "<" in bare:
        bare = _TAG.sub(lambda m: " " + " ".join(_CONTENT.findall(m[0])) + " ", bare)
    if "[" in bare:
        bare = _BBCODE.sub(" ", bare)
    if _may_link(line):
        bare = _LINK.sub(" ", bare)
        linked = len(_LINK.findall(line))
    if "#" in bare:
        marked = _HASHTAG.findall(bare)
    named = [w for w in _WORDS.findall(_BULLET.sub("", bare).lower()) if not w.isdigit()]
    few = len([w for w in named if w in FUNCTION_WORDS and w not in WEAK])
    share = few / len(named) if named else 0.0
    cjk = 0 if bare.isascii() else len(_CJK.findall(bare))
    # without blanks between words, terms are whole clauses
    clauses = cjk >= 8 and bool(_CJK_SENTENCE.search(bare)) and cjk / max(1, len(named)) > 4
    if clauses:
        return (WORDS if len(named) >= 12 and 8 * len(set(named)) <= len(named) and _repeats(named, strictly=True) else LEGIT), named, share
    sentence = share >= 0.15 and len(named) >= 4
    if linked:
        sentence = sentence or len(named) >= 4 and sum(w in FUNCTION_WORDS for w in named) >= 0.3 * len(named)
        return (LEGIT, [], share) if sentence else (LISTED, _with(named, LINK, linked), share)
    if share < 0.25 and len(named) <= 24 and _MAY_PRICE.search(bare) and (priced := len(_PRICE.findall(bare))):
        return LISTED, _with(named, PRICE, priced), share
    if sentence:
        return (WORDS if _stuffed(named, share) else LEGIT), named, share
    if marked and sum(map(len, marked)) > 0.7 * len(bare.strip()):
        return LISTED, [TAG] * len(marked), share
    return WORDS, named, share


def _with(words: list[str], term: str, n: int) -> list[str]:
    """``words`` of a line with ``n`` of a term, evenly between them: in a line their order says nothing."""
    step = -(-len(words) // n) if words else 1
    out: list[str] = []
    for i in range(n):
        out += [*words[i * step : (i + 1) * step], term]
    return out


def _repeats(terms: list[str], strictly: bool) -> bool:
    """Whether terms come back too regularly for sentences; less is needed where there are no function words."""
    regular, lag, top = recurrence(terms)
    if strictly:
        return top >= 0.34 and (lag >= 0.2 or regular >= 0.5) or lag >= 0.45 and regular >= 0.6
    return regular >= 0.1 or lag >= 0.04


def _stuffed(terms: list[str], share: float) -> bool:
    """Whether a sequence of terms with function words repeats its content too regularly for sentences."""
    if len(terms) < 12 or share > 0.3 or share > 0.15 and len(terms) < 24:
        return False
    return _repeats([t for t in terms if t not in FUNCTION_WORDS], strictly=True)


def junk_share(text: str | None) -> float:
    """The share of a text's characters, white space apart, that lie in junk blocks."""
    if not text:
        return 0.0
    text = _INVISIBLE.sub("", text)
    total = junk = 0
    fenced = False
    block: list[tuple[int, list[str], str]] = []  # size, terms, line
    run: list[tuple[int, list[str]]] = []  # size, terms of lines with links, prices or tags

    def close_run() -> int:
        """Characters of the run of lines with links, prices or tags that are a list."""
        if listed([t for r in run for t in r[1]], sum(len(t) for r in run for t in r[1] if t[0] != "\0")):
            return sum(r[0] for r in run)
        # one odd line doesn't clear the others
        return sum(r[0] for r in run if listed(r[1], sum(len(t) for t in r[1] if t[0] != "\0")))

    def close() -> int:
        """Characters of the block of word lines that are junk."""
        size, terms = sum(b[0] for b in block), [t.translate(_LEET) for b in block for t in b[1]]
        named = len(terms)
        few = sum(t in FUNCTION_WORDS and t not in WEAK for t in terms) / named if named else 0.0
        if len(block) == 1 and named < 6:
            return 0
        if _stuffed(terms, few):
            return size
        if few >= 0.05 or named < 6:
            return 0
        stops = sum(len(_STOP.findall(b[2])) for b in block)
        if stops and 5 <= named / stops <= 40 and not (len(block) >= 4 and stops <= 0.25 * len(block)):
            return 0  # sentences by their form
        if not _KNOWN.search("".join(terms)):
            return 0  # no function words are known to miss
        # nouns that hardly recur, or terms that recur as keywords do
        return size if len(set(terms)) >= 0.6 * named or _repeats(terms, strictly=False) else 0

    for raw in text.splitlines():
        line = raw.strip()
        if not line:
            continue
        size = len(line) - line.count(" ")
        total += size
        if line.startswith(_FENCE):
            fenced = not fenced
            continue
        if fenced:
            continue
        kind, terms, share = _line(line)
        if kind == WORDS:
            block.append((size, terms, line))
        elif kind == LISTED:
            run.append((size, terms))
        else:
            if block:
                junk += close()
                block = []
            if run:
                junk += close_run()
                run = []
    if block:
        junk += close()
    if run:
        junk += close_run()
    return junk / total if total else 0.0


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = [junk_share(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64()), *batch.columns[2:]], ["doc_id", "junk_share", *batch.schema.names[2:]])


def junk_shares(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """``doc_id, junk_share`` of every row of ``docs``, and the column ``keep``; one row out for each row in."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), *([docs[keep]] if keep else []))
    kind = "doc_id bigint, junk_share double" + (f", {keep} {docs.schema[keep].dataType.simpleString()}" if keep else "")
    return spread(rows).mapInArrow(_found, kind)


def junk_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of the rows that are junk pages."""
    return junk_shares(docs, key, text).where(f"junk_share > {SHARE}").select("doc_id")
