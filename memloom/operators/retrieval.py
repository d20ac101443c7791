"""The recall pipeline, batched over queries: seed, fuse, walk, merge, boost, filter, diversify (R-01 to R-21)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.functions import vec
from memloom.operators import filters, ranking, search, walks
from memloom.session import small, written

GC_HALF_LIFE_S = 7 * 86_400


@dataclass(frozen=True)
class Settings:
    """Sizes of the pipeline; presets as fixed values below."""

    seed_k: int = 25
    max_expansions: int = 800
    deliver: int = 40
    floor: float = 0.0
    mode: str = "hybrid"
    pagerank_rounds: int = 25
    pagerank_top: int = 100
    lexical_weight: float = 0.0
    half_life_days: int = 30
    dedup_threshold: float = 0.98


PRESETS = {
    "relaxed": Settings(),
    "medium": Settings(seed_k=15, max_expansions=500, deliver=25, half_life_days=7, dedup_threshold=0.95),
    "tight": Settings(seed_k=10, max_expansions=250, deliver=12, half_life_days=3, dedup_threshold=0.90),
}


def cold_victims(entities: DataFrame, now: Column, half_life_s: int = GC_HALF_LIFE_S) -> DataFrame:
    """M-03: entities cold enough to spill."""
    heat = sc.decayed(F.col("heat"), F.col("accessed_at"), now, F.lit(half_life_s))
    return entities.withColumn("heat_now", heat).where(
        sc.is_cold_victim(F.col("kern_id"), F.col("status"), F.col("kind"), F.col("heat_now"), F.col("accessed_at"), F.col("created_at"), now)
    )


def dense_hits(entities: DataFrame, reasons: DataFrame, queries: search.Queries, s: Settings, keep: Column | None) -> DataFrame:
    """R-02: blended hits, or edge origins in reason mode."""
    if s.mode == "reason":
        return search.seed_by_reason(search.reason_vectors(reasons, entities), queries, s.seed_k)
    return search.blended(entities, queries, s.seed_k, keep).select("query_id", "entity_id", "score")


def pooled_seeds(hits: DataFrame, important: DataFrame, s: Settings) -> DataFrame:
    """R-02: hits pooled with the important entities, the best seed_k."""
    pooled = ranking.log_sum_exp(hits.unionByName(important.select("query_id", "entity_id", "score")), ["query_id", "entity_id"])
    return vec.top_k(pooled, s.seed_k, "score").select("query_id", "entity_id", "score")


def walk_graph(reasons: DataFrame, s: Settings) -> tuple[DataFrame, int, bool]:
    """Half-edges (reason_id, u, v, score, first, hub) of the edges a walk may use, written, their number and whether there are hubs."""
    half = walks.half_edges(walks.local_edges(reasons).select("reason_id", F.col("from_id").alias("u"), F.col("to_id").alias("v"), "score"))
    hubs = half.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > s.max_expansions).select("u", F.lit(True).alias("hub"))
    half = written(half.join(hubs, "u", "left").withColumn("hub", F.coalesce("hub", F.lit(False))), "half")
    n, hub = half.agg(F.count("*"), F.coalesce(F.max("hub"), F.lit(False))).first()
    return half, n, hub


def numbered_nodes(entities: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Entities (n, entity_id, vector, known), and seeds that are none, numbered in the order of their ids, written."""
    rows = entities.select("entity_id", "vector", F.lit(True).alias("known"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("entity_id").distinct().join(entities.select("entity_id"), "entity_id", "left_anti").select(
            "entity_id", F.lit(None).cast("array<float>").alias("vector"), F.lit(False).alias("known")))
    return written(walks.numbered(rows, "entity_id", "n"), "nodes")


def numbered_edges(half: DataFrame) -> DataFrame:
    """The edges of ``half`` once, numbered in the order of their ids, written."""
    return written(walks.numbered(half.where("first").drop("first"), "reason_id", "e"), "edges")


def expansion(entities: DataFrame, reasons: DataFrame, queries: search.Queries, s: Settings, seeds: DataFrame | None = None,
              read_whole: int = walks.WALK_WHOLE, graph: tuple[DataFrame, int, bool] | None = None, nodes: DataFrame | None = None,
              edges: DataFrame | None = None) -> DataFrame:
    """R-07, R-08: walks of every query, each over what it reaches; a graph of at most ``read_whole`` half-edges over all
    queries, of which a task can hold one, is read at once, a larger one round by round, with the same result. ``nodes`` and
    ``edges`` are the numbered entities (all seeds among them) and edges, where they were written before."""
    w_content, w_reason, w_edge = ranking.MODES[s.mode]
    with ThreadPoolExecutor(2) as pool:  # what doesn't depend on each other shares the cluster
        graph_coming = pool.submit(copy_context().run, lambda: graph or walk_graph(reasons, s))
        if seeds is None:
            seeds = written(search.vector_topk(entities, queries, s.seed_k).select("query_id", "entity_id", F.col("cosine").alias("score")))
        half, n, hubs = graph_coming.result()
    q = F.broadcast(entities.sparkSession.createDataFrame([(n, [float(x) for x in v]) for n, v in queries], "query_id string, qv array<float>"))  # a bounded list
    tasks, names, matrix = entities.sparkSession.sparkContext.defaultParallelism, [str(n) for n, _ in queries], np.array([v for _, v in queries], dtype=np.float64)
    dim = matrix.shape[1] if len(queries) else 0
    usable = (F.size("vector") == dim) & vec.usable(F.col("vector"))
    whole = n <= walks.WALK_ALONE and n * len(queries) <= read_whole
    vectors = entities.select("entity_id", "vector")
    by_number = whole or not hubs
    if by_number:
        nodes = numbered_nodes(entities, seeds) if nodes is None else nodes
        vectors = nodes.where("known").select("n", "entity_id", "vector")
    else:
        vectors = written(vectors, "vectors")
    cosines = vectors.join(small(seeds.select("query_id", "entity_id").distinct()), "entity_id").join(q, "query_id").select(
        "query_id", "n" if by_number else "entity_id", F.round(vec.cosine(F.col("vector"), F.col("qv")), 6).alias("cosine"))
    if by_number:
        edges = numbered_edges(half) if edges is None else edges
        held = nodes.where("known").select("entity_id", "n", "vector", usable.alias("ok"))
    if whole:
        both = edges.join(held.select(F.col("entity_id").alias("u"), F.col("n").alias("nu"), F.col("vector").alias("va"), F.col("ok").alias("ka")), "u").join(
            held.select(F.col("entity_id").alias("v"), F.col("n").alias("nv"), F.col("vector").alias("vb"), F.col("ok").alias("kb")), "v")
        blocks = both.select("e", "nu", "nv", "score", "va", "vb", "ka", "kb").mapInArrow(
            lambda it: vec.edge_blocks(it, names, matrix, w_reason, w_edge), "query_id string, block binary")
        return walks.expand_whole(seeds, cosines, nodes, edges, blocks, w_content, s.max_expansions)
    if not hubs:
        u, v = (held.select(F.col("entity_id").alias(end), F.col("n").alias(f"n{end}")) for end in "uv")
        links = written(edges.join(u, "u").join(v, "v").select("e", "nu", "nv", "score"), "links")

        def scored(links: DataFrame, part: list[str]) -> DataFrame:
            """Blocks of ``links``. Vectors are read for their ends only."""
            at = [names.index(n) for n in part]
            both = links.join(held.select(F.col("n").alias("nu"), F.col("vector").alias("va"), F.col("ok").alias("ka")), "nu").join(
                held.select(F.col("n").alias("nv"), F.col("vector").alias("vb"), F.col("ok").alias("kb")), "nv")
            return both.select("e", "nu", "nv", "score", "va", "vb", "ka", "kb").mapInArrow(
                lambda it: vec.shared_edge_blocks(it, matrix[at], w_reason, w_edge), "block binary, scores array<binary>")

        # what a round reads for queries that share it is about what a task may hold
        mean = -(-n // max(1, nodes.count()))
        together = max(1, min(walks.TOGETHER, walks.WALK_ALONE // max(1, s.max_expansions * mean)))
        return walks.expand(seeds, cosines, half, scored, w_content, s.max_expansions, hubs=False,
                            near={"queries": names, "nodes": nodes, "edges": edges, "links": links, "together": together})

    def read(front: DataFrame) -> DataFrame:
        """Half-edges from ``front(query_id, entity_id)``, to known entities. Vectors are read for their ends only."""
        near = written(half.join(small(front.withColumnRenamed("entity_id", "u")), "u"), "near")
        ends = near.select(F.explode(F.array("u", "v")).alias("entity_id")).distinct()
        held = written(vectors.join(small(ends), "entity_id", "left_semi").withColumn("ok", usable), "ends")
        both = near.join(held.select(F.col("entity_id").alias("v"), F.col("vector").alias("vb"), F.col("ok").alias("kb")), "v").join(
            held.select(F.col("entity_id").alias("u"), F.when(F.col("ok"), F.col("vector")).alias("va"), F.col("ok").alias("ka")), "u").repartition(tasks)
        out = both.select("query_id", "reason_id", "u", "v", "hub", "score", "va", "vb", "ka", "kb").mapInArrow(
            lambda it: vec.edge_cosines(it, names, matrix), "query_id string, reason_id string, u string, v string, hub boolean, score double, cosine double, mid double")
        return out.select("query_id", "reason_id", "u", "v", "hub", F.round("cosine", 6).alias("cosine"),
                          F.round(sc.edge_evidence(F.col("mid"), F.col("score"), F.lit(0), w_reason, w_edge), 6).alias("evidence"))

    return walks.expand(seeds, written(cosines), half.select("u", "v"), read, w_content, s.max_expansions, hubs=hubs)


def recall(entities: DataFrame, reasons: DataFrame, accesses: DataFrame, attractors: list, now: Column, s: Settings = Settings(),
           options: filters.QueryOptions | None = None, trust: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and chains of every query.

    Results: query_id, rank, entity_id, score, kind, kern_id, remote, confidence. Chains: query_id, chain_no, nodes, score, of
    which no known entity fails the filters (P-15). The queries are the attractors given: their vector and text. Seeds come
    from dense, lexical and important lists and PageRank, fused by rank (a query without text has its dense seeds
    alone; what no mass reaches has no place in the PageRank list);
    fused seeds score by their cosine; the walk's and the seeds' scores pool by log-sum-exp. Filters act in every seed list
    and again before delivery cuts the pool. Then come the asked order, sections (where entities have a source or a section),
    diversity, and the late lexical bonus (where ``lexical_weight`` is positive).
    """
    options = options or filters.QueryOptions()
    keep = filters.predicate(options) if options.is_active else None
    queries = [(r.kern_id, list(r.graviton_vec)) for r in attractors]
    texts = [(r.kern_id, r.graviton_text) for r in attractors if r.graviton_text]
    spark = entities.sparkSession
    hybrid = s.mode == "hybrid" and bool(texts)
    # what doesn't depend on each other shares the cluster
    with ThreadPoolExecutor(7) as pool:
        run = lambda f: pool.submit(copy_context().run, f)  # noqa: E731 - a scope of steps holds in its threads too
        reasons_coming = run(lambda: written(reasons, "reasons"))
        accesses_coming = run(lambda: written(accesses, "accesses"))
        entities = written(entities, "entities")
        nodes_coming = run(lambda: numbered_nodes(entities))
        passing = entities.where(keep).select("entity_id") if keep is not None else None
        lexical_coming = run(lambda: written(search.bm25(entities, texts, 4 * s.seed_k, passing).select("query_id", "entity_id", "score"))) if hybrid else None
        reasons, accesses = reasons_coming.result(), accesses_coming.result()
        hits_coming = run(lambda: written(dense_hits(entities, reasons, queries, s, keep)))
        important_coming = run(lambda: written(search.important(entities, accesses, queries, keep)))

        def graphs() -> tuple[tuple[DataFrame, int, bool], DataFrame | None]:
            graph = walk_graph(reasons, s)
            return graph, numbered_edges(graph[0]) if graph[1] <= walks.WALK_ALONE else None

        def voting() -> tuple[DataFrame, int]:
            votes = written(walks.voting_edges(reasons, nodes_coming.result()), "votes")
            return votes, votes.count()

        graph_coming = run(graphs)

        votes_coming = run(voting) if hybrid else None
        dense = written(pooled_seeds(hits_coming.result(), important_coming.result(), s))
        lexical = lexical_coming.result() if lexical_coming else None
        (graph, edges), nodes, votes = graph_coming.result(), nodes_coming.result(), votes_coming.result() if votes_coming else None
    important = important_coming.result()
    q = F.broadcast(spark.createDataFrame([(n, [float(x) for x in v]) for n, v in queries], "query_id string, qv array<float>"))  # a bounded list
    seeds = dense
    if hybrid:
        names = nodes.select("entity_id", "n")
        starts = names.join(small(dense.unionByName(lexical)), "entity_id").select("query_id", F.col("n").alias("entity_id"), "score")
        ppr = walks.pagerank(votes[0], starts, s.pagerank_rounds, n_edges=votes[1]).where("rank > 0")
        # numbers are in the order of the ids, which ties go by
        ppr = vec.top_k(ppr.withColumnRenamed("rank", "score"), s.pagerank_top, "score", decimals=9).select("query_id", F.col("entity_id").alias("n"), "score")
        ppr = ppr.join(names, "n").select("query_id", "entity_id", "score")
        fused = written(ranking.rrf([(dense, 1.0), (lexical, 1.0), (important, 0.5), (ppr, 0.5)], 2 * s.seed_k), "fused")
        texted = [n for n, _ in texts]
        fused = fused.where(F.col("query_id").isin(texted))
        cos = entities.select("entity_id", "vector").join(small(fused.select("query_id", "entity_id")), "entity_id").join(q, "query_id").select(
            "query_id", "entity_id", F.nanvl(F.round(vec.cosine(F.col("vector"), F.col("qv")), 6), F.lit(0.0)).alias("cosine"))
        seeds = written(ranking.rescore(fused, cos).unionByName(dense.where(~F.col("query_id").isin(texted))))
    # an origin of an edge may be no entity
    walked = expansion(entities, reasons, queries, s, seeds, graph=graph, nodes=nodes if s.mode != "reason" else None, edges=edges)
    hits = walked.where("kind = 'hit'").select("query_id", "entity_id", "score")
    pooled = written(ranking.log_sum_exp(hits.unionByName(seeds), ["query_id", "entity_id"]), "pool")
    found = entities.join(small(pooled.select("entity_id").distinct()), "entity_id", "left_semi")
    rows = found.withColumnRenamed("score", "own_score").join(small(pooled), "entity_id").join(accesses, "entity_id", "left")
    if trust and "source" in entities.columns:
        rows = rows.withColumn("scheme", F.col("source.scheme"))
    rows = ranking.confidence_boost(rows, now, trust if "scheme" in rows.columns else None)
    rows = ranking.remote_trust(ranking.gravity(rows, ranking.pulls(found, [(r.kern_id, list(r.graviton_vec), r.mass) for r in attractors])))
    chains = walked.where("kind = 'chain'").select("query_id", "chain_no", "nodes", "score")
    if keep is not None:
        rows = rows.withColumnRenamed("score", "hit_score").withColumnRenamed("own_score", "score").where(keep).withColumnRenamed(
            "score", "own_score").withColumnRenamed("hit_score", "score")
        chains = filters.whole_chains(chains, found.select("entity_id", keep.alias("ok")))
    rows = rows.where(filters.not_expired(options, now)).withColumn("score", F.round("score", 6))
    rows = filters.deliverable(rows, s.floor, max(ranking.MMR_POOL, s.deliver))
    rows = rows.withColumn("confidence", sc.conf_mean(F.col("conf_alpha"), F.col("conf_beta")))
    rows = ranking.resorted(rows, options.sort, options.ascending)
    section = "source.section" if "source" in entities.columns else "section" if "section" in entities.columns else None
    if section is not None:
        rows = ranking.section_dedup(rows, section)
    rows = written(rows.join(q, "query_id").withColumn("cosine", F.when(F.size("vector") > 0, vec.cosine(F.col("vector"), F.col("qv")))).select(
        "query_id", "entity_id", "score", "rank", "cosine", "vector", "kind", "kern_id", "confidence"), "delivered")
    final = ranking.mmr(rows, s.deliver)
    if s.lexical_weight > 0 and texts:
        final = ranking.lexical_boost(final, search.bm25(entities, texts, s.deliver).drop("rank"), s.lexical_weight)
    shown = rows.select("query_id", "entity_id", "kind", "kern_id", sc.is_remote(F.col("kern_id")).alias("remote"), F.round("confidence", 6).alias("confidence"))
    return final.join(shown, ["query_id", "entity_id"]).select("query_id", "rank", "entity_id", "score", "kind", "kern_id", "remote", "confidence"), chains


def retrieve(entities: DataFrame, reasons: DataFrame, accesses: DataFrame, attractors: list, now: Column, s: Settings = Settings(),
             options: filters.QueryOptions | None = None) -> DataFrame:
    """Delivered results of every query, as :func:`recall`."""
    return recall(entities, reasons, accesses, attractors, now, s, options)[0]
