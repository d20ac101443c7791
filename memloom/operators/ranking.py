"""Fusing, boosting and diversifying ranked hits, all batched by query_id over bounded hit lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.functions import text as tx
from memloom.functions import vec

RRF_K, MMR_LAMBDA, MMR_POOL = 60.0, 0.75, 50
#: Weights (content, reason, edge) by mode (fixed values; R-01).
MODES = {"content": (0.70, 0.15, 0.15), "reason": (0.20, 0.60, 0.20), "hybrid": (0.50, 0.30, 0.20)}


def log_sum_exp(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """A-01: ``max + ln(sum(exp(score - max)))`` per group; scores that aren't finite are skipped.

    Both passes are partial aggregates, so a hot key is combined before the shuffle.
    """
    x = F.col(score).cast("double")
    ok = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*by, x.alias("x"))
    top = ok.groupBy(*by).agg(F.max("x").alias("m"))
    return ok.join(top, by).groupBy(*by, "m").agg(F.sum(F.exp(F.col("x") - F.col("m"))).alias("s")).select(
        *by, (F.col("m") + F.log("s")).alias(score)
    )


def ranked(hits: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Rank within each query by score, ties by id; scores that aren't finite are dropped."""
    ok = hits.where(F.col(score).isNotNull() & ~F.isnan(score))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "entity_id")))


def rrf(lists: list[tuple[DataFrame, float]], k: int, constant: float = RRF_K) -> DataFrame:
    """R-05: sum of weight / (constant + rank) over the lists, the best k of each query."""
    every = None
    for hits, weight in lists:
        part = ranked(hits).select("query_id", "entity_id", (F.lit(weight) / (F.lit(constant) + F.col("rank"))).alias("score"))
        every = part if every is None else every.unionByName(part)
    return vec.top_k(every.groupBy("query_id", "entity_id").agg(F.sum("score").alias("score")), k, "score", decimals=9)


def rescore(hits: DataFrame, cosines: DataFrame) -> DataFrame:
    """R-06: the query cosine in place of the fused score; 0 where there is none."""
    return hits.select("query_id", "entity_id").join(cosines, ["query_id", "entity_id"], "left").select(
        "query_id", "entity_id", F.coalesce("cosine", F.lit(0.0)).alias("score")
    )


def confidence_boost(hits: DataFrame, now: Column, trust: dict[str, float] | None = None) -> DataFrame:
    """R-10: (score x confidence bound + use bonus + fact bonus) x trust of the source scheme.

    Columns used: score, conf_alpha, conf_beta, access_count, accessed_at, kind, kern_id and, with ``trust``, scheme.
    """
    lcb = sc.conf_lcb(F.col("conf_alpha"), F.col("conf_beta"))
    age = sc.seconds(now) - sc.seconds(F.col("accessed_at"))
    fact = F.when((F.col("kind") == "fact") & ~sc.is_remote(F.col("kern_id")), F.lit(sc.Fixed.FACT_BONUS)).otherwise(0.0)
    factor = F.lit(1.0)
    for name, value in sorted((trust or {}).items()):
        factor = F.when(F.col("scheme") == name, F.lit(float(value))).otherwise(factor)
    return hits.withColumn("score", (F.col("score") * lcb + sc.qbst(F.col("access_count"), age) + fact) * factor)


def gravity(hits: DataFrame, pulls: DataFrame) -> DataFrame:
    """R-11: add 0.15 of the strongest pull, ``pulls(entity_id, pull)`` with pull = max over attractors of mass x max(cos, 0)."""
    return hits.join(pulls, "entity_id", "left").withColumn(
        "score", F.col("score") + sc.Fixed.GRAVITY * F.coalesce("pull", F.lit(0.0))
    ).drop("pull")


def pulls(store: DataFrame, gravitons: list[tuple[str, list, float]]) -> DataFrame:
    """Strongest pull on each entity of ``store(entity_id, vector)`` by a bounded list of (id, vector, mass)."""
    mass = {g: m for g, _, m in gravitons}
    scored = vec.score_against(store, [(g, v) for g, v, _ in gravitons], 0, 0.0)
    weight = F.create_map(*[x for g, m in sorted(mass.items()) for x in (F.lit(g), F.lit(float(m)))]) if mass else F.create_map()
    return scored.groupBy("entity_id").agg(F.max(F.element_at(weight, F.col("query_id")) * F.col("cosine")).alias("pull"))


def remote_trust(hits: DataFrame, trust: float = sc.Fixed.REMOTE_TRUST) -> DataFrame:
    """R-12: scores of remote entities times ``trust``; nothing if it is 1 or more."""
    if trust >= 1:
        return hits
    return hits.withColumn("score", F.when(sc.is_remote(F.col("kern_id")), F.col("score") * trust).otherwise(F.col("score")))


def resorted(hits: DataFrame, sort: str | None, ascending: bool = False) -> DataFrame:
    """R-14: rank by a field, keeping the previous rank among equals; only where a sort is asked."""
    if sort is None:
        return hits
    column = {"score": "score", "date": "created_at", "access": "access_count", "confidence": "confidence"}[sort]
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "rank")))


def section_dedup(hits: DataFrame, section: str = "section", by: str = "query_id") -> DataFrame:
    """R-15: of hits with the same non-empty section key the best, ties to the first; hits without a key all stay."""
    key = tx.section_key(F.coalesce(F.col(section), F.lit("")))
    order = Window.partitionBy(by, "_key").orderBy(F.desc("score"), "rank")
    return hits.withColumn("_key", F.when(key != "", key).otherwise(F.concat(F.lit("\u0000"), F.col("entity_id")))).withColumn(
        "_n", F.row_number().over(order)
    ).where("_n = 1").drop("_n", "_key")


def _mmr(group: pd.DataFrame, target: int, pool: int, lam: float) -> pd.DataFrame:
    """Greedy maximal marginal relevance over one query's best ``pool`` hits; the first of equal values wins."""
    group = group.sort_values("rank", kind="stable")
    if len(group) <= target:
        out = group[["query_id", "entity_id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out
    head = group.iloc[: min(pool, len(group))]
    vectors = [np.asarray(v if v is not None else [], dtype=np.float64) for v in head["vector"]]
    dim = max(map(len, vectors), default=0)
    whole, has = np.array([len(v) == dim and dim > 0 for v in vectors]), np.array([len(v) > 0 for v in vectors])
    m = np.zeros((len(head), dim))
    for i, v in enumerate(vectors):
        n = np.linalg.norm(v) if whole[i] else 0.0
        if n != 0:  # not finite: no cosine with anything
            m[i] = v / n if np.isfinite(n) else np.nan

    def near(i: int) -> np.ndarray:
        """Cosines of all with i, over the shorter length; what isn't a number doesn't count."""
        s = m @ m[i] if whole[i] else np.zeros(len(head))
        for j in range(len(head)) if not whole[i] else np.flatnonzero(~whole & has).tolist():
            k = min(len(vectors[i]), len(vectors[j]))
            x, y = vectors[i][:k], vectors[j][:k]
            both = np.linalg.norm(x) * np.linalg.norm(y)
            s[j] = x @ y / both if both > 0 and np.isfinite(both) else 0.0
        return np.where(np.isnan(s), -1.0, s)

    relevance = np.where(has, head["cosine"].astype(float), head["score"].astype(float))
    worst, left, chosen = np.zeros(len(head)), np.ones(len(head), dtype=bool), []
    while len(chosen) < min(target, len(head)):
        value = np.round(lam * relevance - (1 - lam) * worst, 12)
        value = np.where(np.isnan(value), -1e9, value)  # a relevance that isn't a number comes last
        value[~left] = -np.inf
        i = int(value.argmax())
        left[i] = False
        chosen.append(i)
        if has[i]:
            worst = np.where(has, np.maximum(worst, near(i)), worst)
    out = pd.concat([head.iloc[chosen], group.iloc[len(head):]])[["query_id", "entity_id", "score"]].iloc[:target].copy()
    out["rank"] = range(1, len(out) + 1)
    return out


def mmr(hits: DataFrame, target: int, pool: int = MMR_POOL, lam: float = MMR_LAMBDA) -> DataFrame:
    """R-16: (query_id, entity_id, score, rank) diversified; only queries with more than ``target`` hits change.

    ``hits(query_id, entity_id, score, rank, cosine, vector)`` are bounded by delivery, so a query is one small group.
    """
    return hits.select("query_id", "entity_id", "score", "rank", "cosine", "vector").groupBy("query_id").applyInPandas(
        lambda g: _mmr(g, target, pool, lam), "query_id string, entity_id string, score double, rank int"
    )


def lexical_boost(hits: DataFrame, lexical: DataFrame, weight: float) -> DataFrame:
    """R-17: add weight x (lexical score over the query's best lexical score) and rank again; nothing for weight 0."""
    if weight <= 0:
        return hits
    top = lexical.groupBy("query_id").agg(F.max("score").alias("top"))
    part = lexical.join(top, "query_id").select("query_id", "entity_id", (F.col("score") / F.col("top")).alias("part"))
    up = hits.drop("rank").join(part, ["query_id", "entity_id"], "left").withColumn(
        "score", F.col("score") + weight * F.coalesce("part", F.lit(0.0))
    ).drop("part")
    return ranked(up)


def rendered_chains(chains: DataFrame, entities: DataFrame, reasons: DataFrame, most: int = 5) -> DataFrame:
    """R-18: (query_id, chain_no, rendered): the first five chains of each query as text.

    Entity texts are cut at 200 characters and marked where they come from a remote partition; edges show their text, cut
    at 100, or their kind.
    """
    order = Window.partitionBy("query_id").orderBy("chain_no")
    some = chains.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    steps = some.select("query_id", "chain_no", F.posexplode("nodes").alias("at", "id"))
    names = F.array(*[F.lit(x) for x in ("similarity", "provenance", "question", "spawn", "supersedes", "ratification", "rephrase")])
    e = entities.select(F.col("entity_id").alias("id"), F.concat(
        F.when(sc.is_remote(F.col("kern_id")), "[UNTRUSTED] ").otherwise(""), tx.truncate(F.coalesce("text", F.lit("")), 200)).alias("etext"))
    r = reasons.select(F.col("reason_id").alias("id"), F.coalesce(tx.truncate(F.col("text"), 100), F.element_at(names, F.col("kind") + 1)).alias("rtext"))
    shown = steps.join(e, "id", "left").join(r, "id", "left").withColumn(
        "part", F.when(F.col("at") % 2 == 0, F.col("etext")).otherwise(F.concat(F.lit("-["), F.col("rtext"), F.lit("]-")))
    ).where(F.col("part").isNotNull())
    return shown.groupBy("query_id", "chain_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]), " ").alias("rendered")
    )


def cold_fill(hot: DataFrame, cold_hits: DataFrame, k: int) -> DataFrame:
    """R-19: hot hits, and where a query has fewer than k, cold hits it hasn't got, best first, flagged."""
    n = hot.groupBy("query_id").agg(F.count("*").alias("have"))
    extra = cold_hits.join(hot.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti").join(n, "query_id", "left")
    extra = ranked(extra).where(F.col("rank") <= k - F.coalesce("have", F.lit(0))).select("query_id", "entity_id", "score", F.lit(True).alias("cold"))
    return hot.select("query_id", "entity_id", "score", F.lit(False).alias("cold")).unionByName(extra)


def envelope(hits: DataFrame, entities: DataFrame, reasons: DataFrame) -> DataFrame:
    """R-21: what a caller is given: ids, score, confidence, text cut at 500 and the number and kinds of incident edges.

    Edges are looked up for the delivered entities only.
    """
    ids = hits.select("entity_id").distinct()
    flat = reasons.select("reason_id", "kind", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("entity_id")).distinct()
    # distinct kinds are at most seven
    edges = flat.join(ids, "entity_id", "left_semi").groupBy("entity_id").agg(
        F.count("*").alias("n_edges"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("edge_kinds")
    )
    shown = entities.select(
        "entity_id", "kind", "status", "kern_id", tx.truncate(F.coalesce("text", F.lit("")), 500).alias("text"),
        F.round(sc.conf_mean(F.col("conf_alpha"), F.col("conf_beta")), 6).alias("confidence"),
        F.round(sc.conf_variance(F.col("conf_alpha"), F.col("conf_beta")), 6).alias("variance"),
    )
    return hits.join(shown, "entity_id").join(edges, "entity_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def lookup(wanted: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """R-23: (asked, found, expired) for every asked id; a missing id has found false."""
    w = wanted.select("asked").distinct()
    e = entities.select(F.col("entity_id").alias("asked"), F.coalesce(F.col("valid_until") < now, F.lit(False)).alias("expired"))
    return w.join(e.withColumn("found", F.lit(True)), "asked", "left").select(
        "asked", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("expired", F.lit(False)).alias("expired")
    )


def accepted_accesses(log: DataFrame, cooldown_s: int = 60) -> DataFrame:
    """R-22, T-01: accesses (entity_id, ts) that count: the first of each entity, and each at least ``cooldown_s`` after the
    last that counted. A lag is not enough, since what was refused doesn't move the last stamp.

    Rows are partitioned by entity and sorted within partitions, then folded as they stream by with one stamp of state:
    a hot entity is never gathered. Repeats at one time count once.
    """
    step = cooldown_s * 1_000_000

    def scan(batches):
        entity, last = None, None
        for batch in batches:
            keep = []
            for i, (e, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if e != entity or t - last >= step:
                    entity, last = e, t
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    rows = log.select(F.col("entity_id").cast("string").alias("entity_id"), F.unix_micros("ts").alias("ts_us")).where(
        "entity_id is not null and ts_us is not null"
    )
    return rows.repartition("entity_id").sortWithinPartitions("entity_id", "ts_us").mapInArrow(scan, "entity_id string, ts_us bigint")


def committed_accesses(counts: DataFrame, entities: DataFrame, now: Column, half_life_s: int, producer: str = "local") -> DataFrame:
    """R-22: counter slots and heat after committing ``counts(entity_id, n)`` accepted accesses at ``now``."""
    return counts.join(entities.select("entity_id", "heat", "accessed_at"), "entity_id").select(
        "entity_id", F.lit(producer).alias("replica"), "n",
        sc.deposit(F.col("heat"), F.col("accessed_at"), now, F.lit(half_life_s), F.col("n").cast("double")).alias("heat"),
        now.alias("accessed_at"),
    )


