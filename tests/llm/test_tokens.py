import random

import pytest

from memloom.llm import tokens as tk

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return tk.Encoder(tk.vocabulary("byte_bpe_50k"))


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def split(flat, per):
    out, at = [], 0
    for n in per.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_random_strings(encoder, reference):
    rng = random.Random(2)
    alphabet = ["a", "'", "s", "d", "t", "m", "l", "r", "v", "e", " ", " ", "1", "\n", "\t", "\r", ".", "é", "漢", "'ll", "'ve", "'re", "²", " ", "​", "😀", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(16))) for _ in range(20000)]
    got = split(*encoder.encode(texts))
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_long_slices(encoder, reference):
    for text in ("a" * 5000, "ab" * 3000 + "=+" * 400, "漢字" * 2000, " " * 3000, "\n" * 500 + "x", "x" * 255 + " " + "y" * 257):
        assert split(*encoder.encode([text]))[0] == reference.encode_ordinary(text)


def test_null_empty_and_round_trip(encoder, reference):
    assert split(*encoder.encode([None, "", "a", None])) == [[], [], reference.encode_ordinary("a"), []]
    text = "Ünï 'tis the day's end\r\n  漢字 <|endoftext|>"
    spans = encoder.spans(text)
    raw = text.encode()
    words = {v: k for k, v in encoder.ranks.items()}
    assert all(raw[a:b] == words[i] for i, a, b in spans) and spans[-1][2] == len(raw)


def test_kept_slices_are_bounded(encoder, reference, monkeypatch):
    monkeypatch.setattr(tk, "KEPT_SLICES", 10)
    texts = [f"word{i} other{i}" for i in range(200)]
    assert split(*encoder.encode(texts)) == [reference.encode_ordinary(t) for t in texts]


def test_operator(spark, reference):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "c", "x"), (4, "d" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in tk.encode_corpus(docs).collect()), key=str)
    assert got == sorted(((i, reference.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    counts = {(r.doc_id, r.n_tokens) for r in tk.count_tokens(docs).collect()}
    assert (2, 0) in counts and (1, 2) in counts
    assert tk.encode_corpus(docs.limit(0)).count() == 0


def test_unknown_vocabulary_is_refused_at_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        tk.encode_corpus(docs, "word_bpe_49k")
