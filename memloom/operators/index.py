"""A vector index of posting lists: build, filtered search, nearest-other joins, consolidation (V-01 to V-04, V-06).

Centroids are fitted on a bounded sample and kept as a small table; every usable vector of an entity that isn't superseded is
filed under its nearest centroid. A search reads the lists nearest to its queries only - of a store's table, laid out by
list, only their buckets - and scores them exactly. A filter acts below the ranking: where it leaves a query short of k, the
search widens until it is filled or all lists were read, so sparse filters still fill k. Removal is a tombstone
(an anti-join) until the lists are rewritten; new rows are a delta searched exactly, until there are CONSOLIDATE of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import vec
from memloom.operators import search
from memloom.session import small, written

#: Vectors the centroids are fitted on, at most; rows a list should hold; lists at most; lists a query reads first.
SAMPLE, LIST_ROWS, MAX_LISTS, PROBE = 16_384, 512, 4096, 8
#: Rows outside of the lists from which on they are filed (fixed value).
CONSOLIDATE = 10_000


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.linalg.norm(values, axis=-1, keepdims=True)


def usable_rows(entities: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """V-06: (entity_id, vector) of what belongs in the index."""
    rows = entities.where(F.col("status") != "superseded") if "status" in entities.columns else entities
    return rows.where((F.size(vector) == dim) & vec.usable(F.col(vector))).select("entity_id", F.col(vector).alias("vector"))


def fit(rows: DataFrame, lists: int | None = None, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of ``rows(entity_id, vector)``: spherical k-means on at most SAMPLE of them, drawn by a hash of the id."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("entity_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(SAMPLE + SAMPLE // 8).toArrow()
    if not drawn.num_rows:
        drawn = rows.select("vector").limit(64).toArrow()
    if not drawn.num_rows:
        return np.zeros((0, 0), np.float64)
    x = _unit(np.array(drawn.column("vector").to_pylist(), dtype=np.float64))
    k = max(1, min(lists or n // LIST_ROWS, MAX_LISTS, len(x) // 4 or 1))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        who = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, who, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), x[rng.integers(0, len(x), size=k)])
    return c


def _file(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, probe: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each row once for each of its ``probe`` nearest lists."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit(np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1))
        p = min(probe, len(centroids))
        near = np.argpartition(-(x @ centroids.T), p - 1, axis=1)[:, :p]
        rows = pa.array(np.repeat(np.arange(len(x)), p))
        yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column(0).take(rows), batch.column(1).take(rows)], ["list", *names])


def postings(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list, entity_id, vector): every one of ``rows(entity_id, vector)`` in its nearest list."""
    return rows.mapInArrow(lambda it: _file(it, centroids, 1, ["entity_id", "vector"]), "list int, entity_id string, vector array<float>")


def lists_of(queries: search.Queries, centroids: np.ndarray, probe: int) -> list[int]:
    """The lists any of the queries reads."""
    q = _unit(np.array([v for _, v in queries], dtype=np.float64))
    p = min(probe, len(centroids))
    return sorted(set(np.argpartition(-(q @ centroids.T), p - 1, axis=1)[:, :p].ravel().tolist()))


def topk(lists: DataFrame, centroids: np.ndarray, queries: search.Queries, k: int, keep: DataFrame | None = None, gone: DataFrame | None = None,
         probe: int = PROBE) -> DataFrame:
    """V-01, V-02, V-04: the best k of each query among what the lists hold: query_id, entity_id, cosine, rank.

    ``keep(entity_id)`` is a filter, ``gone(entity_id)`` are tombstones. Queries are a bounded list. Queries left with fewer than
    k rows search four times as many lists, up to all of them.
    """
    spark = lists.sparkSession
    found, left = None, queries
    if not len(centroids) or not queries:
        return spark.createDataFrame([], "query_id string, entity_id string, cosine double, rank int")
    while left:
        rows = lists.where(F.col("list").isin(lists_of(left, centroids, probe))) if probe < len(centroids) else lists
        rows = rows.join(keep.select("entity_id").distinct(), "entity_id", "left_semi") if keep is not None else rows
        rows = rows.join(small(gone.select("entity_id").distinct()), "entity_id", "left_anti") if gone is not None else rows
        best = written(vec.top_k(vec.score_against(rows.select("entity_id", "vector"), left, k), k), "indexed")
        full = {r[0] for r in best.groupBy("query_id").count().where(F.col("count") >= k).collect()}  # queries are a bounded list
        done = full if probe < len(centroids) else {str(n) for n, _ in left}
        part = best.where(F.col("query_id").isin(*done)) if done else best.limit(0)
        found = part if found is None else found.unionByName(part)
        left, probe = [(n, v) for n, v in left if str(n) not in done], 4 * probe
    return found


def nearest_other(asking: DataFrame, lists: DataFrame, centroids: np.ndarray, k: int, least: float = -1.0, probe: int = PROBE) -> DataFrame:
    """V-14, W-04: for each of ``asking(query_id, vector)`` the k nearest other rows of the lists it probes.

    Vectors of ``asking`` have the index' length and are usable. A list above LIST_ROWS x 4 rows is cut by a hash of the id into
    parts that each asking row meets one by one, so no task holds an unbounded list; only the best k of a task are shuffled.
    """
    if not len(centroids):
        return asking.sparkSession.createDataFrame([], "query_id string, entity_id string, cosine double, rank int")
    spec = "list int, query_id string, qv array<float>"
    asks = asking.select("query_id", F.col("vector").alias("qv")).mapInArrow(lambda it: _file(it, centroids, probe, ["query_id", "qv"]), spec)
    sizes = written(lists.groupBy("list").agg(F.ceil(F.count("*") / F.lit(4 * LIST_ROWS)).cast("int").alias("parts")), "parts")  # a row per list
    stored = lists.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int"))
    asks = asks.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = asks.select("list", "part", "query_id", "qv").groupBy("list", "part").cogroup(
        stored.select("list", "part", "entity_id", F.col("vector").alias("sv")).groupBy("list", "part")).applyInPandas(
        lambda x, y: search._slice_topk(x, y, k, least), "query_id string, entity_id string, cosine double")
    return vec.top_k(met.where(F.col("query_id") != F.col("entity_id")).distinct(), k)


def blended_other(asking: DataFrame, entities: DataFrame, dim: int, k: int, least: float = -1.0, probe: int = PROBE, width: int = 64) -> DataFrame:
    """V-15, W-04: as :func:`nearest_other` by the blended score: content and structure hits, where both, 0.4 and 0.6 of them."""
    found = []
    for vector, name in (("vector", "c"), ("gnn_vector", "g")):
        rows = written(usable_rows(entities, dim, vector), "usable")
        c = fit(rows)
        found.append(nearest_other(asking, written(postings(rows, c), "lists") if len(c) else rows, c, max(2 * k, width), -1.0, probe).select(
            "query_id", "entity_id", F.col("cosine").alias(name)))
    both = found[0].join(found[1], ["query_id", "entity_id"], "full_outer")
    score = F.when(F.col("c").isNotNull() & F.col("g").isNotNull(), search.BLEND_CONTENT * F.col("c") + search.BLEND_GNN * F.col("g")).otherwise(F.coalesce("c", "g"))
    return vec.top_k(both.select("query_id", "entity_id", score.alias("cosine")).where(F.col("cosine") >= least), k)


def table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """Centroids as rows (list, centroid), to be kept beside the lists."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>")


def loaded(rows: DataFrame) -> np.ndarray:
    """The centroids of :func:`table`; at most MAX_LISTS."""
    held = rows.orderBy("list").limit(MAX_LISTS + 1).collect()
    if len(held) > MAX_LISTS:
        raise ValueError(f"more than {MAX_LISTS} lists")
    return np.array([r.centroid for r in held], dtype=np.float64) if held else np.zeros((0, 0))


def delta(entities: DataFrame, lists: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """V-05, V-06: (rows not filed yet, ids filed that don't belong any more)."""
    now = usable_rows(entities, dim)
    ids = lists.select("entity_id").distinct()
    return now.join(ids, "entity_id", "left_anti"), ids.join(now.select("entity_id"), "entity_id", "left_anti")


def overlaid(lists: DataFrame, centroids: np.ndarray, entities: DataFrame, dim: int, queries: search.Queries, k: int, keep: Column | None = None, probe: int = PROBE) -> DataFrame:
    """V-05: the best k of the lists without tombstones and of the delta, which is searched exactly."""
    fresh, gone = delta(entities, lists, dim)
    allowed = entities.where(keep).select("entity_id") if keep is not None else None
    if allowed is not None:
        fresh = fresh.join(allowed, "entity_id", "left_semi")
    a = topk(lists, centroids, queries, k, allowed, gone, probe).select("query_id", "entity_id", "cosine")
    b = vec.top_k(vec.score_against(fresh, queries, k), k).select("query_id", "entity_id", "cosine")
    return vec.top_k(a.unionByName(b).groupBy("query_id", "entity_id").agg(F.max("cosine").alias("cosine")), k)
