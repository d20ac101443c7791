"""Text functions as Column builders: terms, splitting, clean-up and parsing of model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes in the order they are tried (fixed values); the first that matches is taken off.
SUFFIXES = ("ing", "edly", "ed", "ly", "ies", "es", "s")
_EDGE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without surrounding Unicode white space."""
    return F.regexp_replace(text, _EDGE, "")


def terms(text: Column) -> Column:
    """F-11: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def stem(term: Column) -> Column:
    """F-11: the term without the first listed suffix it ends in, if enough is left."""
    out = term
    for suffix in reversed(SUFFIXES):
        fits = term.endswith(suffix)
        long = F.octet_length(term) > len(suffix) + 2
        cut = F.when(long, F.substring(term, F.lit(1), F.length(term) - len(suffix))).otherwise(term)
        out = F.when(fits, cut).otherwise(out)
    return out


def stems(text: Column) -> Column:
    """Stemmed terms of a text, in order, repeats included."""
    return F.transform(terms(text), stem)


def truncate(text: Column, n: int) -> Column:
    """F-13: at most n code points, with ``...`` only if cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 12)


def section_key(section: Column) -> Column:
    """F-14: what stands before ``#chunk``."""
    return F.substring_index(section, "#chunk", 1)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n", "\n")


def paragraphs(text: Column) -> Column:
    """F-15: parts between blank lines, stripped, empty ones dropped; the whole stripped text if there is none."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > 0)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text)))


def turns(text: Column) -> Column:
    """F-17: blank-line parts of a transcript after line ends are made one."""
    return F.filter(F.transform(F.split(unix_lines(text), "\n\n"), strip), lambda p: F.length(p) > 0)


def statement_lines(reply: Column) -> Column:
    """F-16: statements a model gave one per line; empty if it gave none, so that the caller falls back."""
    return F.filter(F.transform(F.split(reply, "\r?\n"), strip), lambda p: F.length(p) > 0)


def seed_examples(text: Column, width: int = 4000) -> Column:
    """F-18: its lines if there are two or more that aren't empty, else the text in pieces of ``width`` code points."""
    lines = statement_lines(text)
    whole = strip(text)
    places = F.sequence(F.lit(0), F.greatest(F.floor((F.length(whole) - 1) / width), F.lit(0)).cast("int"))
    pieces = F.filter(F.transform(places, lambda i: F.substring(whole, i * width + 1, F.lit(width))), lambda p: F.length(p) > 0)
    return F.when(F.size(lines) >= 2, lines).otherwise(pieces)


def entity_document(statements: Column, rephrases: Column) -> Column:
    """F-12: statements and the texts of outgoing rephrase edges, separated by blanks."""
    every = F.filter(F.concat(statements, F.coalesce(rephrases, F.array().cast("array<string>"))), lambda t: F.length(t) > 0)
    return F.array_join(every, " ")


CLAIM_TYPE = "array<struct<text: string, kind: string, valid_from: string, turns: array<int>>>"
KINDS = ("fact", "claim", "document", "question", "conclusion")


def parse_claims(reply: Column) -> Column:
    """F-19: the claims of a model reply: the JSON array between the first ``[`` and the last ``]``, a lone nested one
    unwrapped. Empty texts are dropped, unknown kinds become fact. Null when there is no array: ask again."""
    inner = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    once = F.regexp_replace(inner, r"(?s)^\[\s*(\[.*\])\s*\]$", "$1")
    claims = F.from_json(F.when(F.length(once) > 0, once), CLAIM_TYPE)
    kept = F.filter(claims, lambda c: F.length(strip(F.coalesce(c["text"], F.lit("")))) > 0)
    return F.transform(kept, lambda c: F.struct(
        strip(c["text"]).alias("text"),
        F.when(F.lower(c["kind"]).isin(*KINDS), F.lower(c["kind"])).otherwise("fact").alias("kind"),
        c["valid_from"].alias("valid_from"),
        F.filter(c["turns"], lambda t: t >= 1).alias("turns"),
    ))


def parse_contradiction(reply: Column) -> Column:
    """F-20: whether a verdict says that the old statement is replaced."""
    up = F.upper(reply)
    return F.coalesce((up.contains("CONTRADICT") | up.contains("UPDATE")) & ~up.contains("RELATED"), F.lit(False))


def parse_time(text: Column) -> Column:
    """F-21: ``YYYY-MM-DDTHH:MM:SS``, fraction and zone ignored; null for anything shorter."""
    return F.when(F.length(text) >= 19, F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))


def date_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def strip_think(reply: Column) -> Column:
    """F-37: without thinking blocks, closed or open."""
    return strip(F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def strip_name_prefixes(name: Column) -> Column:
    """F-37: a name without list marks, labels and quotes a model put around it."""
    bare = F.regexp_replace(strip(name), r"(?i)^(?:[-*#]+\s*|\d+[.)]\s*|(?:name|label|title)\s*:\s*)+", "")
    return strip(F.regexp_replace(strip(bare), "^[\"'`]+|[\"'`.]+$", ""))
