"""Ranking, walks and search on small graphs with hand-worked results."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memloom import config
from memloom.functions import vec
from memloom.operators import filters, ranking, retrieval, search, stats, walks


def test_log_sum_exp(spark):
    rows = spark.createDataFrame([("a", 0.9), ("a", 0.4), ("b", 0.5), ("b", 0.5), ("c", 7.0), ("d", float("nan")), ("c", float("inf"))], "k string, score double")
    got = {r.k: r.score for r in ranking.log_sum_exp(rows, ["k"]).collect()}
    assert got["a"] == pytest.approx(1.374077, abs=1e-6) and got["b"] == pytest.approx(1.193147, abs=1e-6) and got["c"] == 7 and "d" not in got


def test_rrf(spark):
    a = spark.createDataFrame([("q", "x", 0.9), ("q", "y", 0.5)], "query_id string, entity_id string, score double")
    b = spark.createDataFrame([("q", "z", 0.9), ("q", "x", 0.5)], "query_id string, entity_id string, score double")
    got = {r.entity_id: r.score for r in ranking.rrf([(a, 1.0), (b, 1.0)], 10).collect()}
    assert got["x"] == pytest.approx(0.032522, abs=1e-6) and got["z"] == pytest.approx(1 / 61)


def test_bm25(spark):
    docs = spark.createDataFrame([("d1", "the quick brown fox"), ("d2", "lazy dog programming"), ("d3", "quick quick fox"), ("d4", None)], "entity_id string, text string")
    got = {r.entity_id: r.score for r in search.bm25(docs, [("q", "quick fox")], 10).collect()}
    assert got["d3"] == pytest.approx(1.155008, abs=1e-6) and got["d1"] == pytest.approx(0.868914, abs=1e-6) and "d2" not in got
    assert search.bm25(docs.limit(0), [("q", "quick")], 3).count() == 0 and search.bm25(docs, [], 3).count() == 0 and search.bm25(docs, [("q", None)], 3).count() == 0


def test_pagerank(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "c", 1)], "src string, dst string, w int")
    seeds = spark.createDataFrame([("q", "a", 1.0)], "query_id string, entity_id string, score double")
    got = {r.entity_id: r["rank"] for r in walks.pagerank(edges, seeds, 10, tolerance=None).collect()}
    assert got == pytest.approx({"a": 0.453238, "b": 0.190011, "c": 0.356751}, abs=1e-6)
    more = {r.entity_id: r["rank"] for r in walks.pagerank(edges, seeds, 200).collect()}
    assert sum(more.values()) == pytest.approx(1)


def test_pagerank_at_its_defaults(spark):
    # a line that ends in a cycle: ten rounds reach n10 only
    links = [(i, i + 1) for i in range(15)] + [(15, 12)]
    edges = spark.createDataFrame([(f"n{u}", f"n{v}", 1) for u, v in links], "src string, dst string, w int")
    seeds = spark.createDataFrame([("q", "n0", 1.0)], "query_id string, entity_id string, score double")
    rank = tele = np.eye(16)[0]
    for _ in range(25):
        flow = np.zeros(16)
        for u, v in links:
            flow[v] += 0.85 * rank[u]
        rank = flow + (1 - flow.sum()) * tele
    s = retrieval.Settings()
    got = {r.entity_id: r["rank"] for r in walks.pagerank(edges, seeds, s.pagerank_rounds).collect()}
    assert s.pagerank_rounds == config.DEFAULTS["retrieval"]["pagerank_rounds"] == 25
    assert got == pytest.approx({f"n{i}": x for i, x in enumerate(rank)}, abs=1e-8)


def test_pagerank_of_numbers_takes_no_rounds(spark, monkeypatch):
    """60,000 edges and 20 queries were above the bound of edges times queries, so they were walked in written rounds."""
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(u) << 33, int(v) << 33, 1 + i % 3) for i, (u, v) in enumerate(sorted({(int(u), int(v)) for u, v in rng.integers(0, 40, (150, 2)) if u != v}))], "src long, dst long, w long")
    seeds = spark.createDataFrame([(f"q{k}", (k + j) << 33, float(j - 1) * (k > 1)) for k in range(20) for j in range(4)] + [("q5", 99, 0.5)], "query_id string, entity_id long, score double")
    got, want = ({(r.query_id, r.entity_id): r["rank"] for r in rows.collect()} for rows in (
        walks.pagerank(edges, seeds, n_edges=60_000), walks.pagerank(edges, seeds, read_whole=0, rank_whole=0)))
    assert len(want) > 700 and got == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(walks, "written", lambda *a: pytest.fail("a step was written"))
    assert walks.pagerank(edges, seeds, n_edges=60_000).count() == len(want)


def test_uniform_teleport_without_positive_seeds(spark):
    edges = spark.createDataFrame([], "src string, dst string, w int")
    seeds = spark.createDataFrame([("q", "a", -1.0), ("q", "b", 0.0)], "query_id string, entity_id string, score double")
    assert {r.entity_id: r["rank"] for r in walks.pagerank(edges, seeds, 2, tolerance=None).collect()} == {"a": 0.5, "b": 0.5}


def beam(rows, content=0.5, most=100):
    return walks._beam(pd.DataFrame([("q", *r) for r in rows], columns=["query_id", "kind", "edge", "a", "b", "x"]), content, most, 0.25)


def test_beam_reaches_and_credits():
    out = beam([("seed", None, "s", None, 0.8), ("node", None, "s", None, 0.8), ("node", None, "n", None, 0.1), ("node", None, "far", None, 0.0), ("edge", "e1", "s", "n", 0.2), ("edge", "e2", "n", "far", 0.01)])
    hits = {r.entity_id: r.score for r in out[out.kind == "hit"].itertuples()}
    chains = [(r.nodes, r.score) for r in out[out.kind == "chain"].itertuples()]
    assert chains == [(["s", "e1", "n"], pytest.approx(0.25))]
    # the walk score 0.25 is lifted by 2 x 0.8 x 0.2, capped at 0.5, staying below the source
    assert hits["n"] == pytest.approx(0.25 + 0.32) and "far" not in hits
    assert hits["s"] == pytest.approx(0.8)  # its credit can't pass its crediting source


def test_beam_ceiling_and_limit():
    out = beam([("seed", None, "s", None, 0.3), ("node", None, "s", None, 0.3), ("node", None, "n", None, 0.0), ("edge", "e1", "s", "n", 0.28)])
    hits = {r.entity_id: r.score for r in out[out.kind == "hit"].itertuples()}
    assert hits["n"] < 0.3 and hits["n"] == pytest.approx(0.3)
    assert set(beam([("seed", None, "s", None, 0.3), ("node", None, "s", None, 0.3), ("node", None, "n", None, 0.5), ("edge", "e", "s", "n", 0.2)], most=1).entity_id) == {"s"}


def store(spark, links):
    """Entities and edges of a small graph: near the query are those named q*, all others at right angles to it."""
    ids = sorted({e for link in links for e in link})
    entities = spark.createDataFrame([(e, [1.0, 0.01 * i] if e[0] == "q" else [0.0, 1.0]) for i, e in enumerate(ids)], "entity_id string, vector array<float>")
    reasons = spark.createDataFrame([(f"e{i:04}", u, v, 0, 0.9, None) for i, (u, v) in enumerate(links)],
                                    "reason_id string, from_id string, to_id string, kind int, score double, to_net_id string")
    return entities, reasons


def walked(spark, links, seeds, most=800):
    entities, reasons = store(spark, links)
    rows = spark.createDataFrame([("q", e, x) for e, x in seeds], "query_id string, entity_id string, score double")
    return retrieval.expansion(entities, reasons, [("q", [1.0, 0.0])], retrieval.Settings(max_expansions=most), rows).collect()


def test_walk_has_no_hop_limit(spark):
    line = [f"n{i}" for i in range(8)]
    links = list(zip(line, line[1:]))
    rows = walked(spark, links, [("n0", 0.9)])
    assert {r.entity_id for r in rows if r.kind == "hit"} == set(line)
    assert max(len(r.nodes) for r in rows) == 15
    # pops are the only limit
    assert {r.entity_id for r in walked(spark, links, [("n0", 0.9)], most=5) if r.kind == "hit"} == set(line[:5])


def test_hub_beyond_the_pops(spark):
    # z is the last of the hub's neighbours, for both directions of its edge; it is a seed, and the only way to the hub
    links = [("hub", f"q{i}") for i in range(9)] + [("z", "hub"), ("hub", "behind")]
    got, want = ({r.entity_id: r.score for r in walked(spark, links, [("z", 0.9)], most) if r.kind == "hit"} for most in (6, 800))
    assert "hub" in got and len(got) == 6 and "behind" in want and len(want) == 12
    # credit of the hub reaches a neighbour beyond those it may follow: z as a seed is popped first, the hub vouches later
    got, want = ({r.entity_id: r.score for r in walked(spark, links, [("hub", 0.9), ("z", 0.2)], most) if r.kind == "hit"} for most in (11, 800))
    few = {r.entity_id: r.score for r in walked(spark, links, [("hub", 0.9), ("z", 0.89)], 4) if r.kind == "hit"}
    assert few["z"] > 0.89 and len(few) == 4
    assert got["z"] == pytest.approx(want["z"])


def test_ancestors_cycle(spark):
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "c")], "newer string, older string")
    got = {(r.entity_id, r.depth) for r in walks.ancestors(spark.createDataFrame([("c",)], "head string"), links).collect()}
    assert got == {("b", 1), ("a", 2)}


def test_dead_partitions_of_a_half_filled_tree(spark):
    from memloom.plans import registry

    kerns = spark.createDataFrame([("root", None, None), ("kern-1", "root", None), ("kern-2", "kern-1", None), ("kern-8", "root", None), ("kern-9", "kern-8", ""), ("kern-a", "root", "named")],
                                  "kern_id string, parent_id string, graviton_text string")
    held = spark.createDataFrame([("e1", "kern-2"), ("e9", "kern-9")], "entity_id string, kern_id string")
    dead = lambda e: {r.kern_id for r in walks.dead_partitions(spark, kerns, e).collect()}
    assert dead(held) == set() and dead(held.where("kern_id < 'kern-8'")) == {"kern-8", "kern-9"}
    assert "kern-8" not in registry.oracle_sql()["dead_partitions"]


def test_structure_vectors_train_all_epochs(spark, monkeypatch):
    from conftest import DATA

    from memloom.operators import gnn, maintenance
    from memloom.plans import upkeep_queries

    seen, train = [], maintenance.structure_vectors
    monkeypatch.setattr(maintenance, "structure_vectors", lambda *a, **k: seen.append(k.get("epochs", gnn.EPOCHS)) or train(*a, **k))
    upkeep_queries.gcn_propagate(spark, DATA)
    assert seen == [24]


def test_section_dedup(spark):
    rows = [("q", "a", "doc#chunk0", 0.4, 3), ("q", "b", "doc#chunk1", 0.9, 1), ("q", "c", "other#chunk0", 0.5, 2), ("q", "d", None, 0.1, 4), ("q", "e", "", 0.1, 5)]
    hits = spark.createDataFrame(rows, "query_id string, entity_id string, section string, score double, rank int")
    assert {r.entity_id for r in ranking.section_dedup(hits).collect()} == {"b", "c", "d", "e"}


def test_mmr_prefers_new():
    rows = pd.DataFrame({"query_id": "q", "entity_id": ["a", "b", "c"], "score": [0.9, 0.8, 0.7], "rank": [1, 2, 3], "cosine": [0.95, 0.94, 0.7], "vector": [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]]})
    assert ranking._mmr(rows, 2, 50, 0.75)["entity_id"].tolist() == ["a", "c"]
    assert ranking._mmr(rows, 3, 50, 0.75)["entity_id"].tolist() == ["a", "b", "c"]
    rows["vector"] = None
    assert len(ranking._mmr(rows, 1, 50, 0.75)) == 1


def test_cooldown(spark):
    t = dt.datetime(2026, 1, 1)
    log = spark.createDataFrame([("e", t + dt.timedelta(seconds=s)) for s in (0, 30, 60, 100, 121, 121)] + [("f", t), (None, t), ("f", None)], "entity_id string, ts timestamp")
    got = ranking.accepted_accesses(log).groupBy("entity_id").count().collect()
    assert {(r.entity_id, r["count"]) for r in got} == {("e", 3), ("f", 1)}


def test_gini_and_percentiles(spark):
    g = lambda xs: stats.gini(spark.createDataFrame([(x,) for x in xs], "v bigint"), "v").first().gini
    assert g([]) == 0 and g([5, 5, 5]) == pytest.approx(0) and g([0, 0, 0]) == 0 and g([10, 0, 0]) == pytest.approx(2 / 3)
    p = {r.share: r.value for r in stats.nearest_rank(spark.createDataFrame([(i,) for i in range(1, 11)], "v bigint"), "v", [0.5, 0.95]).collect()}
    assert p == {0.5: 5, 0.95: 10}


def test_delivery_floor(spark):
    rows = [("q", "a", "active", 0.9), ("q", "b", "active", 0.2), ("q", "c", "superseded", 1.0), ("r", "d", "active", 0.1)]
    hits = spark.createDataFrame(rows, "query_id string, entity_id string, status string, score double")
    assert {(r.query_id, r.entity_id) for r in filters.deliverable(hits, 0.5, 10).collect()} == {("q", "a"), ("r", "d")}


def test_chain_filter(spark):
    chains = spark.createDataFrame([("q", 1, ["a", "e1", "b"], 0.5), ("q", 2, ["a", "e2", "c"], 0.4)], "query_id string, chain_no int, nodes array<string>, score double")
    ok = spark.createDataFrame([("a", True), ("b", False)], "entity_id string, ok boolean")
    assert [r.chain_no for r in filters.whole_chains(chains, ok).collect()] == [2]


def test_options_are_checked():
    with pytest.raises(ValueError):
        filters.predicate(filters.QueryOptions(scheme="ftp"))
    with pytest.raises(ValueError):
        filters.predicate(filters.QueryOptions(kind="odd"))
    assert not filters.QueryOptions().is_active and filters.QueryOptions(user_id="u").is_active


def test_topk_dirty_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 1.0]), ("f", [1.0, 1.0])]
    store = spark.createDataFrame(rows, "entity_id string, vector array<float>")
    got = [(r.entity_id, r["rank"]) for r in search.vector_topk(store, [("q", [1.0, 0.0])], 5).orderBy("rank").collect()]
    assert got == [("a", 1), ("f", 2)]
    assert search.vector_topk(store, [], 5).count() == 0


def test_nearest_other_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[150:160] = x[:10]
    rows = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)], "entity_id string, vector array<float>")
    got = {r.query_id: r.entity_id for r in search.nearest_other(rows.selectExpr("entity_id as query_id", "vector"), rows, 8, 1, block_rows=70).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    assert got == {f"{i:03}": f"{int(s[i].argmax()):03}" for i in range(300)}


def test_eval_metrics(spark):
    rows = spark.createDataFrame([(1, [1]), (2, [2, 9]), (1, [])], "gold_n int, ranks array<int>")
    m = stats.eval_metrics(rows).first()
    assert m.recall_any_1 == pytest.approx(1 / 3, abs=1e-6) and m.recall_all_10 == pytest.approx(2 / 3, abs=1e-6) and m.mrr == pytest.approx(0.5)
    ideal = 1 + 1 / math.log2(3)
    assert m.ndcg_10 == pytest.approx((1 + (1 / math.log2(3) + 1 / math.log2(10)) / ideal) / 3, abs=1e-6)


def test_gravity_takes_the_strongest(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0])], "entity_id string, vector array<float>")
    got = {r.entity_id: r.pull for r in ranking.pulls(store, [("g", [1.0, 0.0], 2.0), ("h", [1.0, 1.0], 1.0)]).collect()}
    assert got == {"a": pytest.approx(2.0)} and vec.top_k is not None


def test_presets():
    assert retrieval.PRESETS["tight"].deliver == 12 and retrieval.PRESETS["relaxed"].seed_k == 25


def test_kind_closure_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", None)], "child string, parent string")
    got = {r.reached for r in filters.closure(spark, edges).where(F.col("start") == "a").collect()}
    assert got == {"a", "b", "c"}


def test_whole_and_rounds_agree(spark, monkeypatch):
    """A graph above 2^20 half-edges over all queries is still walked without rounds, and both forms give the same hits and chains: with
    loops, parallels, a hub, unusable vectors, an unknown end and an unknown seed."""
    rng = np.random.default_rng(5)
    ids = [f"n{i:02}" for i in range(40)]
    vectors = {e: [float(x) for x in rng.normal(size=3)] for e in ids} | {"n07": None, "n08": [1.0], "n09": [0.0, 0.0, 0.0], "n10": [float("nan"), 1.0, 0.0]}
    links = [(ids[a], ids[b]) for a, b in rng.integers(0, 40, (90, 2))] + [("n00", x) for x in ids[1:20]] + [("n03", "n03"), ("n03", "n04"), ("n03", "n04"), ("n05", "lost")]
    entities = spark.createDataFrame(list(vectors.items()), "entity_id string, vector array<float>")
    reasons = spark.createDataFrame([(f"e{(i * 37) % 200:03}", u, v, 0, [0.9, None, 0.2, 2.0][i % 4], None) for i, (u, v) in enumerate(links)],
                                    "reason_id string, from_id string, to_id string, kind int, score double, to_net_id string")
    queries = [("a", [1.0, 0.2, 0.0]), ("b", [-0.3, 0.5, 1.0])]
    seeds = spark.createDataFrame([("a", "n01", 0.9), ("a", "gone", 0.8), ("a", "n00", 0.2), ("b", "n20", 0.4)], "query_id string, entity_id string, score double")
    read = []
    monkeypatch.setattr(walks, "expand", lambda *a, f=walks.expand, **k: read.append(1) or f(*a, **k))
    for most in (12, 800):
        s, got = retrieval.Settings(max_expansions=most), []
        for whole in (walks.WALK_WHOLE, 0):
            rows = retrieval.expansion(entities, reasons, queries, s, seeds, whole).where("kind <> 'open'").collect()
            got.append({(r.query_id, r.kind, r.entity_id, tuple(r.nodes), r.chain_no): r.score for r in rows})
        assert got[0] == pytest.approx(got[1], abs=2e-6) and len(got[0]) > 20
    assert len(read) == 2
    graph = (retrieval.walk_graph(reasons, s)[0], (1 << 20) // 2 + 1, False)
    assert retrieval.expansion(entities, reasons, queries, s, seeds, graph=graph).count() and len(read) == 2


def test_rounds_read_an_edge_once_for_all_queries(spark, monkeypatch):
    """Rounds gave every query its own rows of what it read; together or one by one, hits and chains are those of the whole graph."""
    links = [(f"n{i:03}", f"n{(i * 7 + k) % 60:03}") for i in range(60) for k in (1, 5)]
    entities, reasons = store(spark, links)
    queries = [(f"q{k}", [1.0, 0.1 * k]) for k in range(5)]
    seeds = spark.createDataFrame([(q, f"n{k:03}", 0.5) for k, (q, _) in enumerate(queries)], "query_id string, entity_id string, score double")
    rows = []

    def written(df, label="step", f=walks.written):
        out = f(df, label)
        rows.extend([out.count()] * (label == "edges"))
        return out

    got = []
    for together, whole in ((64, 0), (2, 0), (64, walks.WALK_WHOLE)):
        monkeypatch.setattr(walks, "TOGETHER", together)
        if not whole:
            monkeypatch.setattr(walks, "written", written)
        walked = retrieval.expansion(entities, reasons, queries, retrieval.Settings(max_expansions=20), seeds, whole).where("kind <> 'open'").collect()
        got.append({(r.query_id, r.kind, r.entity_id, tuple(r.nodes), r.chain_no): r.score for r in walked})
        if together == 64 and not whole:
            assert rows and sum(rows) <= len(links)
    assert got[0] == pytest.approx(got[2], abs=2e-6) and got[1] == pytest.approx(got[2], abs=2e-6) and len(got[2]) > 100


def test_hops_ahead_end_with_room(spark, monkeypatch):
    """A round reads ahead as many entities as a walk may pop, not that many for each of ever more hops."""
    links = [(f"n{i}", f"n{c}") for i in range(1, 200) for c in (2 * i, 2 * i + 1)]
    ahead = []

    def written(df, label="step", f=walks.written):
        out = f(df, label)
        ahead.extend([out.count()] * (label == "ahead"))
        ahead.extend([0] * (label == "walked"))
        return out

    monkeypatch.setattr(walks, "written", written)
    entities, reasons = store(spark, links)
    seeds = spark.createDataFrame([("q", f"n{i}", 0.9) for i in (1, 100, 101, 102, 103, 104)], "query_id string, entity_id string, score double")
    s = retrieval.Settings(max_expansions=8)
    rows = retrieval.expansion(entities, reasons, [("q", [1.0, 0.0])], s, seeds, 0).where("kind = 'hit'").collect()
    rounds = "".join("." if n else "|" for n in ahead).split("|")
    assert len(rows) == 8 and max(len(r) for r in rounds) <= 2 and sum(ahead) <= 16
