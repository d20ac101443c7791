"""Queries of the general data problems: change feed replay (p2) and attribute history (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import changefeed, history
from memloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.replay(table(spark, d, "pending_deltas"), closed=True).select(
        "object_id", "target", "lamport", "producer"
    )


def p2_state(spark: SparkSession, d: str) -> DataFrame:
    """The state exposed at the contiguous committed watermark, the feed being open still."""
    return changefeed.replay(table(spark, d, "pending_deltas")).select(
        "object_id", "target", "lamport", "producer", F.round("lww_double", 6).alias("lww_double"),
        F.unix_micros("lww_ts").alias("lww_ts_us"),
    )


def p2_watermark(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.committed_watermark(table(spark, d, "pending_deltas"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.attribute_history(table(spark, d, "direct_jobs")).select(
        "object_id", "section", "from_us", F.coalesce("to_us", F.lit(-1).cast("long")).alias("to_us")
    )


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions per attribute with time covered, a report over the whole history."""
    h = history.attribute_history(table(spark, d, "direct_jobs"))
    return h.groupBy("object_id", "section").agg(
        F.count("*").alias("n_versions"), F.min("from_us").alias("first_us"),
        F.sum(F.when(F.col("to_us").isNull(), 1).otherwise(0)).alias("n_open"),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_state, p2_watermark, p4_found, p4_versions)}

_P2 = r"""
WITH c AS (
  SELECT object_id, target, lamport, producer, lower(trim(op, E' \t\n\r\x0b\x0c')) AS o, lww_value, lww_double, lww_ts, arrival_seq
  FROM pending_deltas WHERE target IN (2, 3) AND lamport IS NOT NULL),
e AS (
  SELECT * FROM c WHERE o = 'delete' OR (o IN ('insert', 'update') AND coalesce(
    (target = 2 AND octet_length(lww_value) = 8)
    OR (target = 3 AND octet_length(lww_value) = 1 AND hex(lww_value) = '00')
    OR (target = 3 AND octet_length(lww_value) IN (7, 11) AND hex(lww_value)[1:2] = '01'), false)))
"""
_P2_ALL = """, r AS (
  SELECT *, row_number() OVER (PARTITION BY object_id, target ORDER BY lamport DESC, producer DESC NULLS LAST,
    (o = 'delete') DESC, lww_value DESC NULLS LAST) AS rn FROM e)
"""
_P2_MARK = """, s AS (SELECT DISTINCT arrival_seq AS s FROM pending_deltas WHERE arrival_seq IS NOT NULL),
w AS (SELECT min(a.s) AS mark FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.s = a.s + 1)),
f AS (SELECT *, min(arrival_seq) OVER (PARTITION BY object_id, target, lamport, producer) AS seq FROM e),
x AS (SELECT *, max(seq) OVER (PARTITION BY lamport, producer) AS commit_seq FROM f),
r AS (
  SELECT *, row_number() OVER (PARTITION BY object_id, target ORDER BY lamport DESC, producer DESC NULLS LAST,
    (o = 'delete') DESC, lww_value DESC NULLS LAST) AS rn FROM x WHERE commit_seq <= (SELECT mark FROM w))
"""

_P4 = r"""
WITH j AS (
  SELECT DISTINCT job_id, source.object_id AS object_id, source.section AS section, valid_from, valid_until,
    trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t,
    kind, confidence
  FROM direct_jobs),
k AS (
  SELECT * FROM j WHERE object_id IS NOT NULL AND section IS NOT NULL AND valid_from IS NOT NULL
    AND (valid_until IS NULL OR valid_until > valid_from)
  QUALIFY row_number() OVER (PARTITION BY object_id, section, valid_from ORDER BY job_id DESC NULLS LAST) = 1),
p AS (
  SELECT *, least(valid_until, lead(valid_from) OVER (PARTITION BY object_id, section ORDER BY valid_from)) AS e FROM k),
m AS (
  SELECT *, CASE WHEN lag(e) OVER w = valid_from AND lag(t) OVER w IS NOT DISTINCT FROM t
    AND lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(confidence) OVER w IS NOT DISTINCT FROM confidence
    THEN 0 ELSE 1 END AS fresh
  FROM p WINDOW w AS (PARTITION BY object_id, section ORDER BY valid_from)),
g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY object_id, section ORDER BY valid_from ROWS UNBOUNDED PRECEDING) AS isle FROM m),
v AS (
  SELECT object_id, section, epoch_us(min(valid_from)) AS from_us, coalesce(epoch_us(arg_max_null(e, valid_from)), -1) AS to_us
  FROM g GROUP BY object_id, section, isle)
"""

ORACLE = {
    "p2_found": _P2 + _P2_ALL + "SELECT object_id, target, lamport, producer FROM r WHERE rn = 1 AND o <> 'delete'",
    "p2_state": _P2 + _P2_MARK + "SELECT object_id, target, lamport, producer, round(lww_double, 6) AS lww_double, "
    "epoch_us(lww_ts) AS lww_ts_us FROM r WHERE rn = 1 AND o <> 'delete'",
    "p2_watermark": "WITH s AS (SELECT DISTINCT arrival_seq AS s FROM pending_deltas WHERE arrival_seq IS NOT NULL) "
    "SELECT min(s) AS first_seq, max(s) AS last_seq, count(*) AS distinct_seqs, "
    "(SELECT min(a.s) FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.s = a.s + 1)) AS watermark FROM s",
    "p4_found": _P4 + "SELECT object_id, section, from_us, to_us FROM v",
    "p4_versions": _P4 + "SELECT object_id, section, count(*) AS n_versions, min(from_us) AS first_us, "
    "CAST(count(*) FILTER (to_us = -1) AS BIGINT) AS n_open FROM v GROUP BY object_id, section",
}
