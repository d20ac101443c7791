"""The write path, upkeep and the graph convolution on small tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memloom.operators import gnn, maintenance, writes
from memloom.sources import embedding, intake

T = dt.datetime(2026, 1, 1)


def test_chunks(spark):
    rows = [(1, "one", "claim", T), (2, "a\n\nb", "fact", T), (2, "a\n\nb", "fact", T + dt.timedelta(1)), (3, None, "claim", T), (4, "  ", "claim", T)]
    jobs = spark.createDataFrame(rows, "job_id bigint, text string, kind string, received_at timestamp")
    got = writes.chunked(jobs).collect()
    assert sorted((r.job_id, r["index"], r.kind) for r in got) == [(1, -1, "document"), (2, -1, "fact"), (2, 0, "fact"), (2, 1, "fact")]
    assert writes.provenance_edges(writes.chunked(jobs)).count() == 2


def test_supersede(spark):
    v = spark.createDataFrame([("a", "x", T), ("b", "x", T + dt.timedelta(1)), ("c", None, T)], "entity_id string, external_id string, created_at timestamp")
    got = {r.entity_id: (r.status, r.superseded_by, r.n_before) for r in writes.supersede(v).collect()}
    assert got == {"a": ("superseded", "b", 0), "b": ("active", None, 1), "c": ("active", None, 0)}


def edges(spark, rows):
    return spark.createDataFrame(rows, "reason_id string, kern_id string, from_id string, to_id string, to_kern_id string, kind int, score double")


def test_degrade(spark):
    r = edges(spark, [(f"r{i}", "k", "a", f"b{i}", None, 0, s) for i, s in enumerate([1.0, 1.0, 0.13, 1.0])])
    got = {x.reason_id: (round(x.score, 6), x.removed) for x in writes.degrade(r, spark.createDataFrame([("a",)], "entity_id string")).collect()}
    assert got == {"r0": (0.85, False), "r1": (0.8875, False), "r2": (0.045625, True), "r3": (0.936719, False)}


def people(spark):
    return spark.createDataFrame([("f", "k", "active", "fact"), ("c", "k", "active", "claim"), ("g", "remote-k", "active", "fact")], "entity_id string, kern_id string, status string, kind string")


def test_forget(spark):
    e, r = people(spark), edges(spark, [("1", "k", "f", "c", None, 0, 1.0), ("2", "k", "g", "f", None, 0, 1.0), ("3", "k", "f", "f", None, 0, 1.0)])
    left, rest, kept = writes.forget(e, r, e)
    assert [x.entity_id for x in left.collect()] == ["f"] and [x.reason_id for x in rest.collect()] == ["3"] and [x.entity_id for x in kept.collect()] == ["f"]
    assert writes.forget(e, r, e, force=True)[0].count() == 0


def test_move(spark):
    e, r = people(spark), edges(spark, [("1", "k", "f", "c", None, 0, 1.0), ("2", "k", "c", "f", None, 0, 1.0)])
    moves = spark.createDataFrame([("f", "n"), ("c", "nowhere")], "entity_id string, kern_id string")
    e2, r2 = writes.move(e, r, moves, spark.createDataFrame([("n",), ("k",)], "kern_id string"))
    assert {x.entity_id: x.kern_id for x in e2.collect()} == {"f": "n", "c": "k", "g": "remote-k"}
    assert {x.reason_id: (x.kern_id, x.to_kern_id) for x in r2.collect()} == {"1": ("n", None), "2": ("k", "n")}


def test_claim_kinds(spark):
    reg = spark.createDataFrame([("b", "a"), ("c", "b")], "child string, parent string")
    assert writes.add_claim_kind(reg, "d", ["c"]).count() == 3
    for child, parent in (("a", "c"), ("a", "a"), ("x", "unknown")):
        with pytest.raises(ValueError):
            writes.add_claim_kind(reg, child, [parent])
    assert {(r.child, r.parent) for r in writes.remove_claim_kind(reg, "b").collect()} == set()


def test_distil_and_retry(spark):
    docs = spark.createDataFrame([(1, "user: hi\n\nassistant: it is noon"), (2, "user: x\n\nassistant: refuse")], "doc_id bigint, text string")
    model = lambda p: "no" if "refuse" in p else intake.stub_distiller(p)
    claims, retry = writes.distil(docs, model)
    assert [(r.doc_id, r.text, r.section) for r in claims.collect()] == [(1, "it is noon", "2")] and [r.doc_id for r in retry.collect()] == [2]


def test_contradictions(spark):
    pairs = spark.createDataFrame([("a", "x is 1", "b", "x is 2"), ("c", "y", "d", "z")], "old_id string, old_text string, new_id string, new_text string")

    def judge(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["CONTRADICT" if o.split()[0] == n.split()[0] else "RELATED" for o, n in zip(old, new)])

    assert [r.old_id for r in writes.contradictions(pairs, judge).collect()] == ["a"]


def test_embedding_failures(spark):
    def model(texts):
        if len(texts) > 1:
            raise RuntimeError("batch")
        if "bad" in texts[0]:
            raise embedding.Permanent("no")
        return [[1.0, 2.0]]

    assert embedding.embed_safely(["a", "bad"], model, ()) == [[1.0, 2.0], None]
    rows = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    got = embedding.embedded(rows).collect()
    assert len(got[0].vector) == embedding.HASHED_DIM and got[1].vector is None and not got[2].embed_failed
    assert np.linalg.norm(embedding.hashed(["the same words", "words the same"])[0]) == pytest.approx(1)


def test_clusters(spark):
    rows = [("k", f"e{i}", [1.0, 0.01 * i]) for i in range(6)] + [("k", f"z{i}", [-0.1, 1.0]) for i in range(3)] + [("k", "n", None)]
    c = maintenance.clusters(spark.createDataFrame(rows, "kern_id string, entity_id string, vector array<float>"), 2)
    assert sorted((r["size"], r["count"]) for r in c.groupBy("cluster", "size").count().collect()) == [(3, 3), (6, 6)]
    assert c.where("is_centre").count() == 2


def test_decay_evidence(spark):
    e = spark.createDataFrame([("a", "active", 3.0, 1.0, T), ("b", "superseded", 3.0, 1.0, T)], "entity_id string, status string, conf_alpha double, conf_beta double, updated_at timestamp")
    got = {r.entity_id: r.conf_alpha for r in maintenance.decay_evidence(e.withColumn("score", F.lit(0.5)), F.lit(T + dt.timedelta(1)), 86_400).collect()}
    assert got == {"a": 2.0, "b": 3.0}


def numeric_gradient(f, x, at, h=1e-6):
    x[at] += h
    up = f()
    x[at] -= 2 * h
    down = f()
    x[at] += h
    return (up - down) / (2 * h)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 32))
    g = gnn.Graph.build(12, np.array([(i, (i + 1) % 12) for i in range(12)] + [(0, 5), (5, 0), (3, 3)]))
    assert np.allclose(g.spread(x), g.dense() @ x) and len(g.pairs) == 13
    model, neg = gnn.Model(32, rng), gnn.negatives(g, 13, rng)
    loss = lambda: gnn.link_loss(model.forward(g, x), g.pairs, neg)[0]
    _, d = gnn.link_loss(model.forward(g, x), g.pairs, neg)
    grads = model.backward(g, d)
    for name, at in (("w1", (3, 2)), ("b1", (1,)), ("w2", (4, 7)), ("b2", (5,)), ("gain", (2,)), ("shift", (3,))):
        assert grads[name][at] == pytest.approx(numeric_gradient(loss, model.p[name], at), rel=1e-3, abs=1e-7)


def test_training_learns_and_repeats():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))
    edges_ = np.array([(i, (i + 1) % 40) for i in range(40)])
    ids = [f"e{i}" for i in range(40)]
    out, losses, weights = gnn.propagate(ids, x, edges_)
    assert losses[-1] < losses[0] and np.allclose(np.linalg.norm(out, axis=1), 1)
    assert np.array_equal(out, gnn.propagate(ids, x, edges_)[0])
    assert np.array_equal(gnn.Model.from_bytes(weights, 16).p["w1"], gnn.Model.from_bytes(weights, 16).p["w1"])
    with pytest.raises(ValueError):
        gnn.Model.from_bytes(weights, 64)
    assert gnn.propagate(ids[:3], x[:3], np.zeros((0, 2)))[1] == []


def test_sigmoid_is_stable():
    assert np.allclose(gnn.sigmoid(np.array([-1000.0, 0.0, 1000.0])), [0, 0.5, 1])
