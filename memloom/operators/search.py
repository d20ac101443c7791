"""Top-k search: exact vectors (V-01 to V-10, V-13), lexical (V-11, V-12), overlay (V-05), nearest-other joins (V-14, W-04)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.functions import vec
from memloom.session import small

#: Weights of content and structure vectors where both found an entity (fixed values).
BLEND_CONTENT, BLEND_GNN = 0.4, 0.6
#: Lexical weights (fixed values).
K1, B = 1.2, 0.75
IMPORTANT_COSINE, IMPORTANT_ACCESSES = 0.20, 3
#: Rows of a slice or block of a nearest-other join (expected).
BLOCK_ROWS = 20_000

Queries = list[tuple[str, list]]


def vector_topk(store: DataFrame, queries: Queries, k: int, keep: Column | None = None, vector: str = "vector") -> DataFrame:
    """V-01, V-02, V-13: the best ``k`` by exact cosine for each query, of the rows that pass ``keep``.

    The filter is below the ranking, so a sparse one still fills k. Superseded rows aren't in the index (V-06).
    """
    rows = store.where(F.col("status") != "superseded") if "status" in store.columns else store
    rows = rows.where(keep) if keep is not None else rows
    return vec.top_k(vec.score_against(rows.select("entity_id", F.col(vector).alias("vector")), queries, k), k)


def blended(store: DataFrame, queries: Queries, k: int, keep: Column | None = None) -> DataFrame:
    """V-07: content hits and structure hits per entity - both: 0.4 and 0.6 of them, one: itself - and the best k."""
    width = max(2 * k, 64)
    c = vector_topk(store, queries, width, keep).select("query_id", "entity_id", F.col("cosine").alias("c"))
    g = vector_topk(store, queries, width, keep, "gnn_vector").select("query_id", "entity_id", F.col("cosine").alias("g"))
    both = c.join(g, ["query_id", "entity_id"], "full_outer")
    score = F.when(F.col("c").isNotNull() & F.col("g").isNotNull(), BLEND_CONTENT * F.col("c") + BLEND_GNN * F.col("g")).otherwise(F.coalesce("c", "g"))
    return vec.top_k(both.select("query_id", "entity_id", score.alias("score")), k, "score")


def reason_vectors(reasons: DataFrame, entities: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Edges with their vector, the midpoint of their ends' vectors (null where an end has no usable one)."""
    ends = entities.select("entity_id", "vector")
    a = ends.select(F.col("entity_id").alias("from_id"), F.col("vector").alias("va"))
    b = ends.select(F.col("entity_id").alias("to_id"), F.col("vector").alias("vb"))
    both = reasons.join(a, "from_id", "left").join(b, "to_id", "left")
    ok = (F.size("va") == F.size("vb")) & vec.usable(F.col("va")) & vec.usable(F.col("vb"))
    return both.withColumn("vector", F.when(ok, vec.average_vec(F.col("va"), F.col("vb")))).drop("va", "vb")


def reason_topk(reasons: DataFrame, queries: Queries, k: int) -> DataFrame:
    """V-08: best edges by their vectors; ``entity_id`` holds the reason_id."""
    return vec.top_k(vec.score_against(reasons.select(F.col("reason_id").alias("entity_id"), "vector"), queries, k), k)


def seed_by_reason(reasons: DataFrame, queries: Queries, k: int) -> DataFrame:
    """V-09: the best edge score of each origin among the best k edges, at least 0."""
    hits = reason_topk(reasons, queries, k).withColumnRenamed("entity_id", "reason_id")
    return hits.join(reasons.select("reason_id", "from_id"), "reason_id").groupBy("query_id", F.col("from_id").alias("entity_id")).agg(
        F.greatest(F.max("cosine"), F.lit(0.0)).alias("score")
    )


def important(entities: DataFrame, accesses: DataFrame, queries: Queries, keep: Column | None = None) -> DataFrame:
    """V-10: local facts and entities accessed three times or more, of a cosine of 0.2 or more; not cut to k."""
    rows = entities.join(accesses.select("entity_id", "access_count"), "entity_id", "left")
    rows = rows.where(
        (~F.col("kern_id").startswith("remote-") & (F.col("kind") == "fact")) | (F.coalesce("access_count", F.lit(0)) >= IMPORTANT_ACCESSES)
    )
    rows = rows.where(keep) if keep is not None else rows
    return vec.score_against(rows.select("entity_id", "vector"), queries, 0, IMPORTANT_COSINE - 1e-7).withColumn(
        "score", F.round("cosine", 6)
    ).where(F.col("score") >= IMPORTANT_COSINE).select("query_id", "entity_id", "score")


def postings(docs: DataFrame) -> DataFrame:
    """V-12: (term, entity_id, tf, dl) of ``docs(entity_id, text)``; derived, so insert, remove and rebuild are rewrites."""
    held = docs.select("entity_id", tx.stems(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") > 0)
    return held.select("entity_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "entity_id").agg(
        F.count("*").alias("tf"), F.first("dl").alias("dl")
    )


def bm25(docs: DataFrame, queries: list[tuple[str, str]], k: int, keep: DataFrame | None = None) -> DataFrame:
    """V-11: the best k of ``docs(entity_id, text)`` for each query text, scores rounded to 6 places.

    Document count, frequencies and average length are of all documents; a filter (``keep(entity_id)``) applies below
    the ranking. A repeated query term counts as often as it comes. Query terms are a bounded list, so the postings are
    cut to them in the scan and only matching postings are shuffled. Texts without terms are no documents.
    """
    spark = docs.sparkSession
    if len(queries) > 4096:
        raise ValueError("a query list holds at most 4096 texts")
    asked = spark.createDataFrame([(str(q), t or "") for q, t in queries], "query_id string, text string")
    terms = asked.select("query_id", F.explode(tx.stems(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    held = docs.select("entity_id", tx.stems(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") > 0)
    stats = held.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    vocabulary = terms.select("term").distinct()
    hits = held.select("entity_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(F.broadcast(vocabulary), "term").groupBy(
        "term", "entity_id"
    ).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(stats), F.lit(True))
    n, dfc, tf = F.col("n"), F.col("df"), F.col("tf")
    idf = F.log((n - dfc + 0.5) / (dfc + 0.5) + 1.0)
    weight = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))
    per = scored.select("term", "entity_id", weight.alias("w")).join(F.broadcast(terms), "term").groupBy("query_id", "entity_id").agg(
        F.sum(F.col("w") * F.col("qtf")).alias("score")
    )
    if keep is not None:
        per = per.join(keep.select("entity_id").distinct(), "entity_id", "left_semi")
    return vec.top_k(per, k, "score")


def overlay(snapshot: DataFrame, delta: DataFrame, tombstones: DataFrame, score: str = "score") -> DataFrame:
    """V-05: (snapshot without tombstones) and delta, the best score of each id: a log-structured read."""
    base = snapshot.join(tombstones.select("entity_id").distinct(), "entity_id", "left_anti")
    return base.select("query_id", "entity_id", score).unionByName(delta.select("query_id", "entity_id", score)).groupBy(
        "query_id", "entity_id"
    ).agg(F.max(score).alias(score))


def _slice_topk(asks: pd.DataFrame, store: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """Best k stored rows of a slice for each asking row."""
    none = pd.DataFrame({"query_id": pd.Series(dtype=str), "entity_id": pd.Series(dtype=str), "cosine": pd.Series(dtype=float)})
    if asks.empty or store.empty:
        return none
    out = []
    m = np.stack(store["sv"].to_numpy()).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = store["entity_id"].to_numpy()
    for i in range(0, len(asks), 1024):
        part = asks.iloc[i : i + 1024]
        q = np.stack(part["qv"].to_numpy()).astype(np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        s = np.round(q @ m.T, 6)
        s[part["query_id"].to_numpy()[:, None] == ids[None, :]] = -2
        border = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        r, c = np.nonzero((s >= border[:, None]) & (s >= least))
        out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[r], "entity_id": ids[c], "cosine": s[r, c]}))
    return pd.concat(out)


def nearest_other(asking: DataFrame, store: DataFrame, dim: int, k: int, least: float = -1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """V-14, W-04: for each asking row the k nearest other stored rows, exactly, in blocks.

    ``asking(query_id, vector)`` is a stated query set; ``store(entity_id, vector)`` is cut into slices and the query set into
    blocks, by a hash, of about ``block_rows`` rows each. Every block meets every slice in a task of bounded size, which
    keeps its best k per asking row; those are ranked. No pair leaves a task but the best.
    """
    ok = (F.size("vector") == dim) & vec.usable(F.col("vector"))
    s = store.where(ok).select("entity_id", F.col("vector").alias("sv"))
    a = asking.where(ok).select("query_id", F.col("vector").alias("qv"))
    slices, blocks = (max(1, -(-x.count() // block_rows)) for x in (s, a))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    s = s.withColumn("slice", F.pmod(F.xxhash64("entity_id"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    a = a.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))
    met = a.groupBy("slice", "block").cogroup(s.groupBy("slice", "block")).applyInPandas(
        lambda x, y: _slice_topk(x, y, k, least), "query_id string, entity_id string, cosine double"
    )
    return vec.top_k(met.where(F.col("query_id") != F.col("entity_id")), k)
