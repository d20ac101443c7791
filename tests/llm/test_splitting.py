import random

import pytest

from memloom.llm import splitting as sp


def check(text, limit, overlap):
    out = sp.piece_bounds(text, limit, overlap)
    if len(text) <= limit:
        assert out == []
        return out
    assert out[0][0] == out[0][1] == 0 and out[-1][2] == len(text)
    assert "".join(text[own:end] for _, own, end in out) == text
    for (s, own, end) in out:
        assert 0 < end - s <= limit and end > own
    for a, b in zip(out, out[1:]):
        assert a[2] == b[1] and b[1] - b[0] == overlap and b[0] >= a[0]
    return out


@pytest.mark.parametrize("limit,overlap", [(10, 0), (10, 4), (200, 20), (2000, 200)])
def test_random_texts(limit, overlap):
    rng = random.Random(limit)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b ", ". ", "\n", "\n\n", "\r\n", "é", "語", "é", "user: ", "。"]) for _ in range(rng.randrange(0, 4000)))
        check(text, limit, overlap)


def test_boundary_order():
    text = "aaaa bbbb. cccc\ndddd\n\neeee ffff"
    (_, _, end), _ = check(text, 24, 0)[:2]
    assert text[:end].endswith("\n\n")
    words = "word " * 400
    assert all(words[own - 1] == " " for _, own, _ in check(words, 100, 10)[1:])


def test_no_boundary_and_very_long():
    check("x" * 1_000_000, 2000, 200)
    check("́" * 5000, 100, 10)


def test_bad_overlap():
    with pytest.raises(ValueError):
        sp.piece_bounds("x" * 100, 10, 5)


def test_operator_cases(spark):
    rows = [("direct_job", 1, "x" * 25, 1), ("direct_job", 1, "x" * 25, 1), ("direct_job", 2, "", 1), ("direct_job", 3, None, 1), ("ingest_record", 4, "y " * 30, 1), ("other", 5, "z" * 99, 1),
            ("direct_job", 6, "é" * 20, 1), (None, None, "w" * 99, 1)]
    items = spark.createDataFrame(rows, "origin string, item_id bigint, text string, max_chars int")
    limits = spark.createDataFrame([("direct_job", 20, 5), ("ingest_record", 50, 5)], "origin string, max_chars int, overlap_chars int")
    got = sp.split_oversized(items, limits)
    assert {(r.origin, r.item_id) for r in got.collect()} == {("direct_job", 1), ("ingest_record", 4)}
    assert sp.split_oversized(items.limit(0), limits).count() == 0
    assert all(len(r.piece) <= 50 and r.piece == r.piece for r in got.collect())


def test_wide_overlap_of_one_limit_stops_nothing(spark):
    items = spark.createDataFrame([("a", 1, "word " * 30), ("b", 2, "word " * 30), ("c", 3, "x" * 50)], "origin string, item_id bigint, text string")
    limits = spark.createDataFrame([("a", 20, 10), ("b", 20, None), ("c", 0, 5)], "origin string, max_chars int, overlap_chars int")
    got = {}
    for r in sp.split_oversized(items, limits).collect():
        got.setdefault(r.origin, []).append(r)
    assert set(got) == {"a", "b"} and all(len(r.piece) <= 20 for v in got.values() for r in v)


def test_values_are_kept_whole():
    text = "[" + ",".join('{"k":"%s"}' % ("v" * 7) for _ in range(60)) + "]"
    assert all(text[own - 1] == "," for _, own, _ in sp.piece_bounds(text, 100, 10)[1:])
