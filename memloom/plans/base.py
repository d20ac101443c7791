"""What the query modules share: current tables, attractors, fixed times, and the SQL fragments that mirror them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import vec
from memloom.functions.scalars import lit_ts
from memloom.operators import crdt
from memloom.session import table

#: The time at which queries are evaluated, the heat half-life and the vector length of the test tables.
NOW, HALF_LIFE_S, DIM = "2026-03-01 00:00:00", 30 * 86_400, 64
#: Attractors are a fixed, small table; more than this many is refused rather than gathered.
MAX_ATTRACTORS = 4096


def now() -> Column:
    return lit_ts(NOW)


def entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity (C-03)."""
    return crdt.entity_join(table(spark, d, "entities"))


def reasons(spark: SparkSession, d: str) -> DataFrame:
    """One row per edge (C-06)."""
    return crdt.reason_join(table(spark, d, "reasons"))


def accesses(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, access_count) from the counter feed."""
    slots = crdt.counter_slots(table(spark, d, "pending_deltas"))
    return crdt.counter_values(slots).select(F.col("object_id").alias("entity_id"), F.col("total").alias("access_count"))


def attractors(spark: SparkSession, d: str) -> list:
    """The named children of the root with a usable vector, as rows."""
    k = table(spark, d, "kerns").where(
        (F.col("parent_id") == "root") & ~F.coalesce("graviton_text", F.lit("")).isin("", "generic")
        & (F.size("graviton_vec") == DIM) & vec.usable(F.col("graviton_vec"))
    ).dropDuplicates(["kern_id"]).orderBy("kern_id").limit(MAX_ATTRACTORS + 1).collect()
    if len(k) > MAX_ATTRACTORS:
        raise ValueError("too many attractors")
    return k


def vector_queries(spark: SparkSession, d: str) -> list[tuple[str, list]]:
    return [(r.kern_id, list(r.graviton_vec)) for r in attractors(spark, d)]


def text_queries(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return [(r.kern_id, r.graviton_text) for r in attractors(spark, d)]


def usable_sql(v: str) -> str:
    return (
        f"{v} IS NOT NULL AND len({v}) = {DIM} AND len(list_filter({v}, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} "
        f"AND len(list_filter({v}, lambda x: x <> 0)) > 0"
    )


def cos_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


E_SQL = """e AS MATERIALIZED (
  SELECT entity_id, any_value(kern_id) AS kern_id, any_value(external_id) AS external_id, any_value(kind) AS kind,
    any_value(review) AS review, any_value(text) AS text, any_value(vector) AS vector, any_value(gnn_vector) AS gnn_vector,
    any_value(conf_alpha)::DOUBLE AS conf_alpha, any_value(conf_beta)::DOUBLE AS conf_beta, any_value(score) AS score,
    any_value(valid_from) AS valid_from, any_value(valid_to) AS valid_to, any_value(invalidated_at) AS invalidated_at,
    any_value(producer_id) AS producer_id, any_value(user_id) AS user_id, any_value(agent_id) AS agent_id, any_value(session_id) AS session_id,
    CASE WHEN bool_or(coalesce(status = 'superseded', false)) THEN 'superseded' ELSE 'active' END AS status,
    max(superseded_by) AS superseded_by, min(created_at) AS created_at, max(updated_at) AS updated_at, max(accessed_at) AS accessed_at,
    max(heat)::DOUBLE AS heat, max(valid_until) AS valid_until
  FROM entities GROUP BY entity_id)"""
R_SQL = """r AS MATERIALIZED (
  SELECT reason_id, any_value(kern_id) AS kern_id, any_value(from_id) AS from_id, any_value(to_id) AS to_id, any_value(to_kern_id) AS to_kern_id,
    any_value(to_net_id) AS to_net_id, any_value(kind) AS kind, any_value(text) AS text, any_value(score) AS score
  FROM reasons GROUP BY reason_id)"""
G_SQL = f"""g AS MATERIALIZED (
  SELECT kern_id, any_value(graviton_text) AS graviton_text, any_value(graviton_vec) AS graviton_vec, any_value(inner_radius) AS inner_radius,
    any_value(outer_radius) AS outer_radius, any_value(mass) AS mass
  FROM kerns WHERE parent_id = 'root' AND coalesce(graviton_text, '') NOT IN ('', 'generic') AND {usable_sql('graviton_vec')} GROUP BY kern_id)"""
A_SQL = """a AS MATERIALIZED (
  SELECT object_id AS entity_id, sum(value)::BIGINT AS access_count FROM (
    SELECT object_id, replica, max(value) AS value FROM pending_deltas
    WHERE target = 0 AND value BETWEEN 1 AND 1000000 AND length(replica) > 0 GROUP BY object_id, replica) GROUP BY object_id)"""
#: Lower-cased runs of letters and digits, and the stem of one.
TERMS_SQL = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 0)"
STEM_SQL = "CASE " + " ".join(
    f"WHEN suffix({{t}}, '{s}') THEN CASE WHEN strlen({{t}}) > {len(s) + 2} THEN left({{t}}, length({{t}}) - {len(s)}) ELSE {{t}} END"
    for s in ("ing", "edly", "ed", "ly", "ies", "es", "s")
) + " ELSE {t} END"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
