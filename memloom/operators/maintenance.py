"""Periodic upkeep as batch plans: collection, decay, clustering, spawning, naming, edges, questions, structure vectors (M-03 to M-17)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.functions import text as tx
from memloom.functions import vec
from memloom.operators import gnn, retrieval, search
from memloom.session import small

#: Fixed values of clustering, naming, spawning, questions and graviton equivalence.
CLUSTER_SAMPLE, COHESION, NAME_SIZE, NAME_COHESION, SPAWN_SIZE, QUESTION_COSINE, SAME_GRAVITON = 200, 0.60, 5, 0.50, 10, 0.80, 0.85
COLD_CAP, COLD_SLACK = 50_000, 1024


def collect_garbage(entities: DataFrame, reasons: DataFrame, now: Column, half_life_s: int = retrieval.GC_HALF_LIFE_S) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M-03: (spilled rows, remaining entities, remaining edges) in one plan."""
    cold = retrieval.cold_victims(entities, now, half_life_s)
    gone = cold.select("entity_id")
    e = entities.join(gone, "entity_id", "left_anti")
    r = reasons.join(gone.withColumnRenamed("entity_id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("entity_id", "to_id"), "to_id", "left_anti")
    return cold.withColumn("spilled_at", now), e, r


def capped_cold(cold: DataFrame, cap: int = COLD_CAP, slack: int = COLD_SLACK) -> DataFrame:
    """K-08: the newest ``cap`` cold rows once there are more than cap + slack, ties by id.

    The border comes from an ordered limit of narrow rows, then a filter: no window over the tier.
    """
    n = cold.count()
    if n <= cap + slack:
        return cold
    border = cold.select("created_at", "entity_id").orderBy(F.desc_nulls_last("created_at"), "entity_id").limit(cap)
    return cold.join(border.select("entity_id"), "entity_id", "left_semi")


def decay_evidence(entities: DataFrame, now: Column, half_life_s: int) -> DataFrame:
    """M-04: alpha and beta of active rows decay toward 1; a half-life of 0 turns it off."""
    if half_life_s <= 0:
        return entities
    fade = lambda c: F.when(F.col("status") == "superseded", F.col(c).cast("double")).otherwise(
        1.0 + sc.decayed(F.col(c) - 1.0, F.col("updated_at"), now, F.lit(half_life_s)))
    e = entities.withColumn("conf_alpha", fade("conf_alpha")).withColumn("conf_beta", fade("conf_beta"))
    return e.withColumn("score", F.when(F.col("status") == "superseded", F.col("score")).otherwise(sc.conf_mean(F.col("conf_alpha"), F.col("conf_beta"))))


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one partition's sampled rows in id order; a row joins the first seed it is close enough to."""
    rows = rows.sort_values("entity_id")
    m = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    left = np.ones(len(rows), dtype=bool)
    cluster = np.full(len(rows), -1)
    k = 0
    for i in range(len(rows)):
        if left[i]:
            near = left & (np.round(unit @ unit[i], 9) >= COHESION)
            near[i] = True
            cluster[near], left[near] = k, False
            k += 1
    out = rows[["kern_id", "entity_id"]].copy()
    out["cluster"] = cluster
    size, cohesion, central = np.zeros(len(rows), int), np.zeros(len(rows)), np.zeros(len(rows), bool)
    for c in range(k):
        at = np.flatnonzero(cluster == c)
        centre = m[at].mean(0)
        n = np.linalg.norm(centre)
        cos = unit[at] @ (centre / n) if n > 0 else np.zeros(len(at))
        size[at], cohesion[at] = len(at), cos.mean()
        central[at[int(np.round(cos, 9).argmax())]] = True
    out["size"], out["cohesion"], out["is_centre"] = size, cohesion, central
    return out


def clusters(entities: DataFrame, dim: int, sample: int = CLUSTER_SAMPLE) -> DataFrame:
    """M-05, M-06: (kern_id, entity_id, cluster, size, cohesion, is_centre) of the first ``sample`` usable rows of each partition.

    The sample is the operator's own feature; it is taken with a ranked limit before the shuffle, so a partition of any
    size sends at most ``sample`` rows per task.
    """
    ok = entities.where((F.size("vector") == dim) & vec.usable(F.col("vector"))).select("kern_id", "entity_id", "vector")
    first = ok.withColumn("n", F.row_number().over(Window.partitionBy("kern_id").orderBy("entity_id"))).where(F.col("n") <= sample).drop("n")
    return first.groupBy("kern_id").applyInPandas(
        _greedy, "kern_id string, entity_id string, cluster int, size int, cohesion double, is_centre boolean")


def centroids(clustered: DataFrame, entities: DataFrame, kerns: DataFrame) -> DataFrame:
    """M-06: per cluster its size, cohesion and whether it is core: its centroid within 0.6 of the partition's attractor."""
    rows = clustered.join(entities.select("entity_id", "vector"), "entity_id")
    mean = vec.mean_pool(rows, ["kern_id", "cluster"], "vector")
    shape = clustered.groupBy("kern_id", "cluster").agg(F.max("size").alias("size"), F.max("cohesion").alias("cohesion"))
    k = kerns.select("kern_id", "graviton_text", "graviton_vec").dropDuplicates(["kern_id"])
    x = mean.join(shape, ["kern_id", "cluster"]).join(k, "kern_id", "left")
    core = (F.size("pooled") == F.size("graviton_vec")) & (vec.cosine(F.col("pooled"), F.col("graviton_vec")) >= COHESION)
    return x.select("kern_id", "cluster", "size", "cohesion", "pooled", F.coalesce("graviton_text", F.lit("")).alias("name"), F.coalesce(core, F.lit(False)).alias("is_core"))


def spawned(clustered: DataFrame, shaped: DataFrame, size: int = SPAWN_SIZE, cohesion: float = COHESION) -> DataFrame:
    """M-07: (entity_id, kern_id, new_part): members of big cohesive non-core clusters of named partitions move to a child each."""
    ok = shaped.where((F.col("name") != "") & ~F.col("is_core") & (F.col("size") >= size) & (F.col("cohesion") >= cohesion)).select("kern_id", "cluster")
    child = F.concat(F.lit("part-"), F.substring(F.sha2(F.concat_ws("/", "kern_id", F.col("cluster").cast("string")), 256), 1, 16))
    return clustered.join(ok, ["kern_id", "cluster"]).select("entity_id", "kern_id", child.alias("new_part"))


def naming(clustered: DataFrame, shaped: DataFrame, entities: DataFrame, model: Callable[[str], str] | None = None,
           size: int = NAME_SIZE, cohesion: float = NAME_COHESION) -> DataFrame:
    """M-08: (kern_id, cluster, name): a name for each unnamed partition's largest cohesive cluster, from its ten first members.

    ``model`` is asked with the members' texts; without one the name is the first member's text, cut at 40.
    """
    ok = shaped.where((F.col("name") == "") & (F.col("size") >= size) & (F.col("cohesion") >= cohesion))
    best = ok.groupBy("kern_id").agg(F.max(F.struct("size", (-F.col("cluster")).alias("c"))).alias("b")).select("kern_id", (-F.col("b.c")).alias("cluster"))
    rows = clustered.join(best, ["kern_id", "cluster"]).join(entities.select("entity_id", "text"), "entity_id")
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("kern_id").orderBy(F.desc("is_centre"), "entity_id"))).where("n <= 10")
    asked = few.groupBy("kern_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("t")))).alias("m"))
    if model is None:
        return asked.select("kern_id", "cluster", tx.truncate(F.col("m")[0]["t"], 40).alias("name"))
    reply = F.pandas_udf(lambda p: p.map(model), "string")
    prompt = F.array_join(F.transform("m", lambda s: s["t"]), "\n")
    return asked.select("kern_id", "cluster", tx.strip_name_prefixes(tx.strip_think(reply(prompt))).alias("name"))


def promotable(kerns: DataFrame, attractors: list) -> DataFrame:
    """M-08: named partitions that may move to the root: no attractor there has their name or a vector within 0.85."""
    named = kerns.where((F.col("parent_id") != "root") & (F.coalesce("graviton_text", F.lit("")) != "")).select(
        F.col("kern_id").alias("entity_id"), "graviton_text", F.col("graviton_vec").alias("vector")).dropDuplicates(["entity_id"])
    close = vec.score_against(named, [(a.kern_id, list(a.graviton_vec)) for a in attractors], 0, SAME_GRAVITON).select("entity_id").distinct()
    names = sorted({a.graviton_text for a in attractors})
    return named.where(~F.col("graviton_text").isin(*names) if names else F.lit(True)).join(close, "entity_id", "left_anti").select(
        F.col("entity_id").alias("kern_id"), "graviton_text")


def enrichable(reasons: DataFrame, entities: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """M-09: (reason_id, prompt or sentence): edges without text, neither spawn nor question, with both ends local."""
    local = entities.where(~sc.is_remote(F.col("kern_id"))).select("entity_id", F.coalesce("text", F.lit("")).alias("t"))
    r = reasons.where((F.length(F.coalesce("text", F.lit(""))) == 0) & ~F.col("kind").isin(sc.Fixed.SPAWN, sc.Fixed.QUESTION))
    both = r.join(local.select(F.col("entity_id").alias("from_id"), F.col("t").alias("a")), "from_id").join(
        local.select(F.col("entity_id").alias("to_id"), F.col("t").alias("b")), "to_id")
    prompt = F.concat(tx.truncate(F.col("a"), 200), F.lit(" -> "), tx.truncate(F.col("b"), 200))
    if model is None:
        return both.select("reason_id", prompt.alias("sentence"))
    return both.select("reason_id", tx.strip_think(F.pandas_udf(lambda p: p.map(model), "string")(prompt)).alias("sentence"))


def seed_questions(chunks: DataFrame, model: Callable[[str], str], most: int = 3) -> DataFrame:
    """M-10: open question edges on the root: at most three questions a model asks about each new chunk."""
    reply = F.pandas_udf(lambda p: p.map(model), "string")
    q = chunks.select("entity_id", F.slice(tx.statement_lines(tx.strip_think(reply("text"))), 1, most).alias("q"))
    return q.select("entity_id", F.explode("q").alias("text")).select(
        sc.reason_id(F.col("entity_id"), F.lit(""), F.lit(sc.Fixed.QUESTION), F.col("text"), F.lit("")).alias("reason_id"),
        F.lit("root").alias("kern_id"), F.col("entity_id").alias("from_id"), F.lit("").alias("to_id"), F.lit(sc.Fixed.QUESTION).alias("kind"), "text")


def resolve_questions(questions: DataFrame, entities: DataFrame, dim: int) -> DataFrame:
    """M-11, C-13: (reason_id, to_id, kind, cosine): each open question ``(reason_id, vector)`` answered by its nearest entity, if near enough."""
    near = search.nearest_other(questions.select(F.col("reason_id").alias("query_id"), "vector"), entities, dim, 1, QUESTION_COSINE)
    return near.select(F.col("query_id").alias("reason_id"), F.col("entity_id").alias("to_id"), F.lit(sc.Fixed.SIMILARITY).alias("kind"), "cosine")


def _train(rows: pd.DataFrame, epochs: int) -> pd.DataFrame:
    nodes = rows[rows["vector"].notna()].drop_duplicates("a").sort_values("a")
    ids = nodes["a"].tolist()
    at = {e: i for i, e in enumerate(ids)}
    links = rows[rows["vector"].isna()]
    edges = np.array([(at[a], at[b]) for a, b in zip(links["a"], links["b"]) if a in at and b in at], dtype=np.int64).reshape(-1, 2)
    x = np.stack(nodes["vector"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out, losses, _ = gnn.propagate(ids, x, edges, epochs)
    return pd.DataFrame({"kern_id": rows["kern_id"].iloc[0], "entity_id": ids, "gnn_vector": [v.astype(np.float32) for v in out],
                         "first_loss": losses[0] if losses else None, "last_loss": losses[-1] if losses else None})


def structure_vectors(entities: DataFrame, reasons: DataFrame, dim: int, least: int = gnn.LEAST_NODES, epochs: int = gnn.EPOCHS, most: int = 200_000) -> DataFrame:
    """M-15, M-16: (kern_id, entity_id, gnn_vector, first_loss, last_loss) for every partition of ``least`` or more usable entities.

    A partition is the unit of training, as its graph is trained as a whole; one above ``most`` entities is refused by
    an error rather than cut, since partitions of that size are to be split first (M-07).
    """
    ok = entities.where((F.size("vector") == dim) & vec.usable(F.col("vector"))).select("kern_id", "entity_id", "vector")
    sizes = ok.groupBy("kern_id").agg(F.count("*").alias("n"))
    too_big = sizes.where(F.col("n") > most).limit(1).collect()
    if too_big:
        raise ValueError(f"partition {too_big[0][0]} has {too_big[0][1]} entities; split it first")
    big = small(sizes.where(F.col("n") >= least).select("kern_id"))
    nodes = ok.join(big, "kern_id", "left_semi").select("kern_id", F.col("entity_id").alias("a"), F.lit(None).cast("string").alias("b"), "vector")
    member = ok.select("entity_id", "kern_id")
    links = reasons.where("to_net_id is null").join(member.select(F.col("entity_id").alias("from_id"), F.col("kern_id").alias("k1")), "from_id").join(
        member.select(F.col("entity_id").alias("to_id"), F.col("kern_id").alias("k2")), "to_id").where("k1 = k2 and from_id <> to_id")
    links = links.select(F.col("k1").alias("kern_id"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(None).cast("array<float>").alias("vector")).join(big, "kern_id", "left_semi")
    return nodes.unionByName(links).groupBy("kern_id").applyInPandas(
        lambda g: _train(g, epochs), "kern_id string, entity_id string, gnn_vector array<float>, first_loss double, last_loss double")


def apply_structure(entities: DataFrame, learned: DataFrame, weight: float = 0.1) -> DataFrame:
    """M-17: active rows with a learned vector: set it, and count the alignment of old and new as evidence."""
    l = learned.select("entity_id", F.col("gnn_vector").alias("new_gnn"))
    e = entities.join(l, "entity_id", "left")
    use = F.col("new_gnn").isNotNull() & (F.col("status") == "active")
    align = vec.cosine_align(F.col("vector"), F.col("new_gnn"))
    o = sc.observe(F.col("conf_alpha").cast("double"), F.col("conf_beta").cast("double"), weight * F.when(align >= 0.5, align).otherwise(1.0 - align), align >= 0.5)
    return e.select(*[
        F.when(use, {"gnn_vector": F.col("new_gnn"), "conf_alpha": o["alpha"], "conf_beta": o["beta"]}[c]).otherwise(F.col(c)).alias(c)
        if c in ("gnn_vector", "conf_alpha", "conf_beta") else F.col(c) for c in entities.columns])
