"""The whole recall pipeline and the walk against the same computations in plain Python, over whole small tables."""

import datetime as dt

import pytest
import recall_reference as ref
from conftest import DATA
from pyspark.sql import functions as F

from memloom.operators import filters, retrieval
from memloom.plans import base as b
from memloom.plans import search_queries as sq


@pytest.fixture(scope="module")
def world(spark):
    e = {r.entity_id: r.asDict() for r in b.entities(spark, DATA).collect()}
    r = [x.asDict() for x in b.reasons(spark, DATA).collect()]
    a = {x.entity_id: x.access_count for x in b.accesses(spark, DATA).collect()}
    return e, r, a, b.attractors(spark, DATA)


NOW = dt.datetime.fromisoformat(b.NOW)


def expected(world, **how):
    e, r, a, g = world
    return {x.kern_id: ref.recall(e, r, a, (list(x.graviton_vec), x.graviton_text, [(list(y.graviton_vec), y.mass) for y in g]), NOW, **how) for x in g}


def check(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.entity_id, r.score))
    assert set(got) == {q for q, (hits, _) in want.items() if hits}
    for q, hits in got.items():
        assert [x[:2] for x in sorted(hits)] == [x[:2] for x in want[q][0]], q
        assert [x[2] for x in sorted(hits)] == pytest.approx([float(x[2]) for x in want[q][0]], abs=3e-6), q


def test_retrieve_hybrid(spark, world):
    check(sq.retrieve_hybrid(spark, DATA).collect(), expected(world))


def test_retrieve_filtered(spark, world):
    keep = lambda r: r["review"] != "pending" and r["review"] is not None and r["score"] is not None and not r["score"] < 0.3 and (r["valid_until"] is None or r["valid_until"] >= NOW)
    check(sq.retrieve_filtered(spark, DATA).collect(), expected(world, keep=keep, expires=False))


def test_chains(spark, world):
    e, r, a, g = world
    o = filters.QueryOptions(kind="fact")
    _, chains = retrieval.recall(b.entities(spark, DATA), b.reasons(spark, DATA), b.accesses(spark, DATA), g, b.now(), options=o)
    got = {}
    for x in chains.orderBy("chain_no").collect():
        got.setdefault(x.query_id, []).append(tuple(x.nodes))
    want = expected(world, keep=lambda x: x["kind"] == "fact")
    for q, (_, every) in want.items():
        held = [p for p, _ in every if all(e[n]["kind"] == "fact" for n in p[::2] if n in e)]
        assert got.get(q, []) == held


@pytest.mark.parametrize("name", ["beam_expand", "beam_in_rounds"])
def test_walks(spark, world, name):
    e, r, _, g = world
    got = {}
    for x in getattr(sq, name)(spark, DATA).collect():
        got.setdefault(x.query_id, {})[x.entity_id] = x.score
    for x in g:
        q = list(x.graviton_vec)
        seeds = ref.best({n: ref.cosine(v["vector"], q) for n, v in e.items() if v["status"] != "superseded" and ref.usable(v["vector"], len(q))}, 25)
        hits, _ = ref.walk(e, r, q, seeds, 800, (0.5, 0.3, 0.2))
        assert got[x.kern_id] == pytest.approx(dict(hits), abs=2e-6)


def test_sections_and_lexical_weight(spark):
    """Two entities of one section deliver one; the lexical bonus lifts the verbatim match."""
    rows = [(f"e{i}", "kern-1", "claim", "active", f"plain words number {i}" if i else "zebra crossing", [1.0, 0.1 * i], None, 2.0, 1.0, 0.6, None, None, None,
             ("file", "o", "s1#chunk1" if i == 1 else "s1#chunk2" if i == 2 else "", None)) for i in range(4)]
    kind = ("entity_id string, kern_id string, kind string, status string, text string, vector array<float>, gnn_vector array<float>, conf_alpha double, conf_beta double, "
            "score double, accessed_at timestamp, created_at timestamp, valid_until timestamp, source struct<scheme:string,object_id:string,section:string,system:string>")
    e = spark.createDataFrame(rows, kind)
    r = spark.createDataFrame([], "reason_id string, kern_id string, from_id string, to_id string, to_net_id string, kind int, score double, text string")
    a = spark.createDataFrame([], "entity_id string, access_count long")
    from pyspark.sql import Row

    g = [Row(kern_id="q", graviton_vec=[0.0, 1.0], graviton_text="zebra", mass=0.0)]
    plain = [x.entity_id for x in retrieval.retrieve(e, r, a, g, F.current_timestamp()).orderBy("rank").collect()]
    assert set(plain) == {"e0", "e2", "e3"} and plain[0] != "e0"
    lifted = [x.entity_id for x in retrieval.retrieve(e, r, a, g, F.current_timestamp(), retrieval.Settings(lexical_weight=5.0)).orderBy("rank").collect()]
    assert lifted[0] == "e0" and set(lifted) == set(plain)


def test_filtered_recall_ranks_without_rounds(spark, monkeypatch):
    """A graph above 2^20 edges times queries was ranked in written rounds, with filters too."""
    from pyspark.sql import Row

    from memloom.operators import walks

    rows = [(f"e{i}", "kern-1", "fact" if i % 2 else "claim", "active", f"zebra number {i}", [1.0, 0.1 * i], None, 2.0, 1.0, 0.6, None, None, None) for i in range(6)]
    e = spark.createDataFrame(rows, "entity_id string, kern_id string, kind string, status string, text string, vector array<float>, gnn_vector array<float>, conf_alpha double, "
                                    "conf_beta double, score double, accessed_at timestamp, created_at timestamp, valid_until timestamp")
    r = spark.createDataFrame([(f"r{i}", "kern-1", f"e{i}", f"e{i + 1}", None, 0, 0.9, None) for i in range(5)],
                              "reason_id string, kern_id string, from_id string, to_id string, to_net_id string, kind int, score double, text string")
    a = spark.createDataFrame([], "entity_id string, access_count long")
    labels = []
    monkeypatch.setattr(walks, "written", lambda df, label="step", f=walks.written: labels.append(label) or f(df, label))
    monkeypatch.setattr(walks, "pagerank", lambda *x, f=walks.pagerank, **k: f(*x, **k | {"n_edges": (1 << 20) + 1}))
    g = [Row(kern_id="q", graviton_vec=[0.0, 1.0], graviton_text="zebra", mass=0.0)]
    got = retrieval.retrieve(e, r, a, g, F.current_timestamp(), options=filters.QueryOptions(kind="fact")).collect()
    assert {x.entity_id for x in got} == {"e1", "e3", "e5"} and "walked" in labels and "powers" not in labels
