"""Golden values of scalar functions, worked out by hand from their definitions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.functions import text as tx
from memloom.functions import vec

T = dt.datetime(2026, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(float(x)).cast("float") for x in xs])


def test_hashes(spark):
    assert value(spark, sc.content_hash(F.lit("abc"))).startswith("ba7816bf8f01")
    s = F.struct(F.lit("ticket").alias("scheme"), F.lit("42").alias("object_id"), F.lit("disc").alias("section"))
    assert value(spark, sc.source_id(s)).startswith("e22ecb2692ce")
    empty = F.struct(F.lit("ticket").alias("scheme"), F.lit("").alias("object_id"), F.lit("x").alias("section"))
    assert value(spark, sc.source_id(empty)) is None


@pytest.mark.parametrize("word,stem", [("running", "runn"), ("cats", "cat"), ("happily", "happi"), ("bus", "bus"), ("the", "the"), ("studies", "stud"), ("boxes", "box"), ("repeatedly", "repeat")])
def test_stem(spark, word, stem):
    assert value(spark, tx.stem(F.lit(word))) == stem


def test_terms(spark):
    assert value(spark, tx.stems(F.lit("Running, the Cats!"))) == ["runn", "the", "cat"]
    assert value(spark, tx.stems(F.lit(""))) == [] and value(spark, tx.stems(F.lit(None).cast("string"))) is None


def test_confidence(spark):
    one = lambda a, b: value(spark, sc.conf_lcb(F.lit(a), F.lit(b)))
    assert one(2, 1) == pytest.approx(0.430964, abs=1e-6) and one(20, 10) == pytest.approx(0.582, abs=1e-6) and one(1.5, 1.5) == pytest.approx(0.25)
    assert value(spark, sc.conf_mean(F.lit(0), F.lit(0))) == 0.5 and value(spark, sc.conf_variance(F.lit(0), F.lit(0))) == 0
    clamp = lambda c, who: tuple(value(spark, sc.clamp_confidence(F.lit(c).cast("double"), F.lit(who))))
    assert clamp(None, "user") == (0.5, "claim") and clamp(1.0, "user") == (1.0, "fact") and clamp(1.0, "agent") == (0.95, "claim") and clamp(0.001, "user") == (0.01, "claim")


def test_heat(spark):
    day = 86_400
    at = lambda h, days: value(spark, sc.decayed(F.lit(h), F.lit(T), F.lit(T + dt.timedelta(days=days)), F.lit(day)))
    assert at(8.0, 1) == pytest.approx(4) and at(8.0, 2) == pytest.approx(2) and at(8.0, 1.5) == pytest.approx(2.828427, abs=1e-6)
    assert at(8.0, -1) == 8 and at(-1.0, 1) == 0
    assert value(spark, sc.decayed(F.lit(8.0), F.lit(None).cast("timestamp"), F.lit(T), F.lit(day))) == 8
    assert value(spark, sc.deposit(F.lit(8.0), F.lit(T), F.lit(T + dt.timedelta(days=1)), F.lit(day), F.lit(1.5))) == pytest.approx(5.5)


def test_qbst(spark):
    assert value(spark, sc.qbst(F.lit(3), F.lit(86_400.0))) == pytest.approx(0.046120, abs=1e-6)
    assert value(spark, sc.qbst(F.lit(1000), F.lit(0.0))) == pytest.approx(0.1)


@pytest.mark.parametrize("d,p", [(0.30, 1), (0.35, 1), (0.45, 0.880797), (0.55, 0.5), (0.65, 0.119203), (0.75, 0)])
def test_acceptance(spark, d, p):
    assert value(spark, sc.acceptance_probability(F.lit(d), F.lit(0.35), F.lit(0.75))) == pytest.approx(p, abs=1e-6)


def test_ttl(spark):
    a, b, n = F.lit(T), F.lit(T + dt.timedelta(1)), F.lit(None).cast("timestamp")
    assert value(spark, sc.resolve_valid_until(a, b)) == T and value(spark, sc.resolve_valid_until(n, b)) == T + dt.timedelta(1)
    assert value(spark, sc.resolve_valid_until(n, n)) is None and value(spark, sc.valid_until_from_retention(a, F.lit(0))) is None


def test_edge_evidence(spark):
    assert value(spark, sc.edge_evidence(F.lit(0.5), F.lit(0.95), F.lit(0), 0.3, 0.2)) == pytest.approx(0.34)


def test_vectors(spark):
    assert value(spark, vec.cosine(arr(1, 0), arr(1, 0, 5))) == pytest.approx(1) and value(spark, vec.cosine(arr(0, 0), arr(1, 0))) == 0
    q = value(spark, vec.quantize_int8(arr(1.0, -0.6, 0.25)))
    assert q.scale == pytest.approx(1 / 127) and q.q == [127, -76, 32]
    assert value(spark, vec.quantize_int8(arr(0, 0))).scale == 1
    assert value(spark, vec.int8_cosine_distance(vec.quantize_int8(arr(1, 2)), vec.quantize_int8(arr(2, 4)))) == pytest.approx(0, abs=1e-4)
    assert value(spark, vec.int8_cosine_distance(vec.quantize_int8(arr(0, 0)), vec.quantize_int8(arr(2, 4)))) == 1
    assert value(spark, vec.average_vec(arr(1, 3), arr(3, 5, 9))) == [2, 4]
    back = value(spark, vec.dequantize_int8(vec.quantize_int8(arr(1.0, -0.6, 0.25))))
    assert back == pytest.approx([1.0, -0.6, 0.25], abs=1 / 127)
    h = vec.hamming_cosine_distance(vec.binary_code(arr(1, -1, 1, 1)), vec.binary_code(arr(1, 1, 1, -1)), F.lit(4))
    assert value(spark, h) == pytest.approx(1 - math.cos(math.pi / 2))
    assert not value(spark, vec.usable(arr(float("nan"), 1))) and not value(spark, vec.usable(arr(0, 0))) and value(spark, vec.usable(arr(0, 1)))


def test_mean_pool(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0]), ("b", [1.0, 2.0]), ("c", [1.0, 0.0]), ("c", [-1.0, 0.0])], "k string, v array<float>")
    got = {r.k: r.pooled for r in vec.mean_pool(rows, ["k"], "v").collect()}
    assert got["a"] == pytest.approx([0.70710678] * 2) and got["b"] is None and got["c"] is None


def test_text(spark):
    assert value(spark, tx.paragraphs(F.lit("a\n\nb\n\nc"))) == ["a", "b", "c"] and value(spark, tx.turns(F.lit("\r\na\r\n\r\nb"))) == ["a", "b"]
    assert value(spark, tx.paragraphs(F.lit(" x　"))) == ["x"]
    assert value(spark, tx.truncate(F.lit("abcdef"), 3)) == "abc..." and value(spark, tx.truncate(F.lit("abc"), 3)) == "abc"
    assert value(spark, tx.section_key(F.lit("doc#chunk7"))) == "doc"
    assert value(spark, tx.parse_time(F.lit("2026-01-02T03:04:05.9+02:00"))) == dt.datetime(2026, 1, 2, 3, 4, 5) and value(spark, tx.parse_time(F.lit("2026-01-02"))) is None
    assert value(spark, tx.strip_think(F.lit("<think>x</think> yes <think>open"))) == "yes"
    assert value(spark, tx.strip_name_prefixes(F.lit('1. Name: "Old vault".'))) == "Old vault"


def test_claims(spark):
    parse = lambda s: value(spark, tx.parse_claims(F.lit(s)))
    got = parse('sure: [[{"text": " a ", "kind": "odd", "turns": [0, 2]}, {"text": " "}]] ok')
    assert [(c.text, c.kind, c.turns) for c in got] == [("a", "fact", [2])]
    assert parse("no list") is None and parse("[]") == []
    verdict = lambda s: value(spark, tx.parse_contradiction(F.lit(s)))
    assert verdict("contradict") and verdict("UPDATE") and not verdict("RELATED, not CONTRADICT") and not verdict("none")


def test_seed_examples(spark):
    assert value(spark, tx.seed_examples(F.lit("a\n\nb\n"))) == ["a", "b"]
    assert [len(x) for x in value(spark, tx.seed_examples(F.lit("x" * 9000)))] == [4000, 4000, 1000]
