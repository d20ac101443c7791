"""Filters (P), search (V), ranking (R) and walks over whole tables, with the attractors as the stated query set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.functions import vec
from memloom.operators import filters, ranking, retrieval, search, walks
from memloom.plans import base as b
from memloom.plans.base import A_SQL, E_SQL, G_SQL, R_SQL, cos_sql, usable_sql, with_
from memloom.session import table, written

QUERIES, ORACLE = {}, {}
K, SEED_K = 15, 25


def query(sql: str | None = None):
    """Register a query with its SQL."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return keep


# ---- filters

_FILTERS = {
    "filter_pending": (filters.QueryOptions(exclude_pending=True), "review <> 'pending'"),
    "filter_kind": (filters.QueryOptions(kind="claim"), "kind = 'claim'"),
    "filter_confidence": (filters.QueryOptions(min_conf=0.5), "NOT (score < 0.5)"),
    "filter_created": (filters.QueryOptions(since="2025-03-01 00:00:00", before="2025-09-01 00:00:00"),
                       "(created_at IS NULL OR created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00') AND (created_at IS NULL OR created_at <= TIMESTAMPTZ '2025-09-01 00:00:00+00')"),
    "filter_ttl": (filters.QueryOptions(valid_at=b.NOW), f"(valid_until IS NULL OR valid_until >= TIMESTAMPTZ '{b.NOW}+00')"),
    "filter_bitemporal": (filters.QueryOptions(as_of="2025-10-01 00:00:00"),
                          "(coalesce(valid_from, created_at) IS NULL OR coalesce(valid_from, created_at) <= TIMESTAMPTZ '2025-10-01 00:00:00+00') "
                          "AND (valid_to IS NULL OR TIMESTAMPTZ '2025-10-01 00:00:00+00' < valid_to)"),
    "filter_tenancy": (filters.QueryOptions(user_id="user-babamar", agent_id="agent-1"), "user_id = 'user-babamar' AND agent_id = 'agent-1'"),
    "filter_everything": (filters.QueryOptions(exclude_pending=True, kind="fact", min_conf=0.2, since="2025-01-01", valid_at=b.NOW, as_of=b.NOW),
                          "review <> 'pending' AND kind = 'fact' AND NOT (score < 0.2) AND (created_at IS NULL OR created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00') "
                          f"AND (valid_until IS NULL OR valid_until >= TIMESTAMPTZ '{b.NOW}+00') AND (coalesce(valid_from, created_at) IS NULL OR "
                          f"coalesce(valid_from, created_at) <= TIMESTAMPTZ '{b.NOW}+00') AND (valid_to IS NULL OR TIMESTAMPTZ '{b.NOW}+00' < valid_to)"),
}


def _filter_query(name: str, options: filters.QueryOptions):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return b.entities(spark, d).where(filters.predicate(options)).select("entity_id", "kind", "kern_id")

    run.__name__, run.__doc__ = name, f"P-01 with {options}."
    return run


for _name, (_options, _sql) in _FILTERS.items():
    QUERIES[_name] = _filter_query(_name, _options)
    ORACLE[_name] = with_(E_SQL) + f"SELECT entity_id, kind, kern_id FROM e WHERE {_sql}"


@query("""SELECT DISTINCT job_id FROM direct_jobs WHERE source.scheme = 'ticket' AND source.system = 'tracker'""")
def filter_source(spark: SparkSession, d: str) -> DataFrame:
    """P-03, P-05 on the intake table, which carries sources."""
    return table(spark, d, "direct_jobs").where(filters.predicate(filters.QueryOptions(scheme="ticket", system="tracker"))).select("job_id").distinct()


@query(with_(E_SQL) + f"SELECT entity_id FROM e WHERE valid_until IS NULL OR valid_until >= TIMESTAMPTZ '{b.NOW}+00'")
def drop_expired(spark: SparkSession, d: str) -> DataFrame:
    """P-13."""
    return b.entities(spark, d).where(filters.not_expired(filters.QueryOptions(), b.now())).select("entity_id")


_KIND_CLOSURE = """RECURSIVE k AS (SELECT DISTINCT kern_id AS child, parent_id AS parent FROM kerns WHERE kern_id IS NOT NULL AND parent_id IS NOT NULL),
  down AS (SELECT x AS start, x AS reached, 0 AS depth FROM (SELECT parent AS x FROM k UNION SELECT child FROM k)
    UNION SELECT start, child, depth + 1 FROM down JOIN k ON parent = reached WHERE depth < 64)"""


@query("WITH " + _KIND_CLOSURE + " SELECT start, reached, min(depth) AS depth FROM down GROUP BY ALL")
def kind_closure(spark: SparkSession, d: str) -> DataFrame:
    """P-06: the closure of a child-parent registry, here the partition tree."""
    k = table(spark, d, "kerns").select(F.col("kern_id").alias("child"), F.col("parent_id").alias("parent"))
    return filters.closure(spark, k)


@query("WITH " + _KIND_CLOSURE + ", t AS (SELECT DISTINCT kern_id, entity_id FROM entities) SELECT entity_id FROM t WHERE kern_id IN "
       "(SELECT reached FROM down WHERE start = (SELECT min(kern_id) FROM kerns WHERE parent_id = 'root'))")
def kind_filter(spark: SparkSession, d: str) -> DataFrame:
    """P-06: entities at or below one node of a registry."""
    k = table(spark, d, "kerns")
    first = k.where("parent_id = 'root'").agg(F.min("kern_id")).first()[0]
    rows = table(spark, d, "entities").select("entity_id", "kern_id").distinct()
    return filters.of_kinds(rows, "kern_id", [first], k.select(F.col("kern_id").alias("child"), F.col("parent_id").alias("parent"))).select("entity_id")


@query(with_(E_SQL, G_SQL) + f""", s AS (SELECT g.kern_id AS query_id, entity_id, round({cos_sql('vector', 'graviton_vec')}, 6) AS score FROM e JOIN g ON true
    WHERE status <> 'superseded' AND {usable_sql('vector')}), m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s)
  SELECT query_id, entity_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank
    FROM m WHERE score >= 0.45 OR best < 0.45) WHERE rank <= 40""")
def filter_delivery(spark: SparkSession, d: str) -> DataFrame:
    """P-14."""
    e = b.entities(spark, d)
    hits = vec.score_against(e, b.vector_queries(spark, d)).withColumn("score", F.round("cosine", 6)).join(e.select("entity_id", "status"), "entity_id")
    return filters.deliverable(hits, 0.45, 40).select("query_id", "entity_id", "score", "rank")


@query("""SELECT len(vector)::INT AS dim, count(*) AS n_vectors FROM (SELECT entity_id, any_value(vector) AS vector, bool_or(status = 'superseded') AS s FROM entities
  GROUP BY entity_id) WHERE NOT s AND len(vector) > 0 GROUP BY ALL ORDER BY n_vectors DESC, dim DESC LIMIT 1""")
def dominant_dim(spark: SparkSession, d: str) -> DataFrame:
    """A-04, P-16."""
    return filters.dominant_dim(b.entities(spark, d))


@query("""WITH t AS (SELECT source.scheme AS s, source.object_id AS o FROM direct_jobs WHERE source.scheme = 'ticket' AND source.object_id IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, o LIMIT 1)
  SELECT DISTINCT job_id, source.section AS section FROM direct_jobs JOIN t ON source.scheme = s AND source.object_id = o""")
def forget_by_source_selector(spark: SparkSession, d: str) -> DataFrame:
    """P-17: all sections of the ticket with the most rows."""
    j = table(spark, d, "direct_jobs")
    o = j.where("source.scheme = 'ticket' and source.object_id is not null").groupBy("source.object_id").count().orderBy(F.desc("count"), "object_id").first()
    return j.where(filters.forgotten_by_source(j, "ticket", o[0])).select("job_id", "source.section").distinct()


@query(f"SELECT DISTINCT kern_id FROM kerns WHERE kern_id <> 'root' AND last_access <= TIMESTAMPTZ '{b.NOW}+00' - INTERVAL 300 SECONDS")
def idle_partitions(spark: SparkSession, d: str) -> DataFrame:
    """P-18, M-14."""
    return table(spark, d, "kerns").where(filters.idle(b.now(), 300)).select("kern_id").distinct()


@query(with_(E_SQL) + """, w AS (SELECT CASE WHEN ascii(entity_id) % 2 = 0 THEN entity_id ELSE left(entity_id, 16) END AS asked FROM e),
  x AS (SELECT asked, e.entity_id, 0 AS way FROM w JOIN e ON e.entity_id = asked
    UNION SELECT asked, e.entity_id, 2 FROM w JOIN e ON left(e.entity_id, 12) = left(asked, 12) AND starts_with(e.entity_id, asked))
  SELECT asked, entity_id, way FROM x QUALIFY row_number() OVER (PARTITION BY asked ORDER BY way, entity_id) = 1""")
def id_prefix(spark: SparkSession, d: str) -> DataFrame:
    """P-19."""
    e = b.entities(spark, d).select("entity_id")
    w = e.select(F.when(F.ascii("entity_id") % 2 == 0, F.col("entity_id")).otherwise(F.substring("entity_id", 1, 16)).alias("asked"))
    return filters.resolve_ids(w, e)


# ---- search

def _topk_sql(vector: str, where: str, k: int = K) -> str:
    return (
        f"SELECT query_id, entity_id, cosine, rank::INT AS rank FROM (SELECT g.kern_id AS query_id, entity_id, round({cos_sql(vector, 'graviton_vec')}, 6) AS cosine, "
        f"row_number() OVER (PARTITION BY g.kern_id ORDER BY round({cos_sql(vector, 'graviton_vec')}, 6) DESC, entity_id) AS rank "
        f"FROM e JOIN g ON true WHERE {where} AND {usable_sql(vector)}) WHERE rank <= {k}"
    )


@query(with_(E_SQL, G_SQL) + _topk_sql("vector", "status <> 'superseded'"))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """V-01: exact top-k of every attractor."""
    return search.vector_topk(b.entities(spark, d), b.vector_queries(spark, d), K)


@query(with_(E_SQL, G_SQL) + _topk_sql("vector", "status <> 'superseded' AND kind = 'question' AND review <> 'pending'"))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """V-02: the filter below the ranking."""
    keep = filters.predicate(filters.QueryOptions(kind="question", exclude_pending=True))
    return search.vector_topk(b.entities(spark, d), b.vector_queries(spark, d), K, keep)


_BLEND = """c AS (%s), n AS (%s), m AS (SELECT coalesce(c.query_id, n.query_id) AS query_id, coalesce(c.entity_id, n.entity_id) AS entity_id,
    round(CASE WHEN c.cosine IS NOT NULL AND n.cosine IS NOT NULL THEN 0.4 * c.cosine + 0.6 * n.cosine ELSE coalesce(c.cosine, n.cosine) END, 6) AS score
    FROM c FULL JOIN n ON c.query_id = n.query_id AND c.entity_id = n.entity_id)"""


def _blend_sql(k: int) -> str:
    w = max(64, 2 * k)
    return _BLEND % (_topk_sql("vector", "status <> 'superseded'", w), _topk_sql("gnn_vector", "status <> 'superseded'", w))


@query(with_(E_SQL, G_SQL, _blend_sql(K)) + f"SELECT query_id, entity_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM m) WHERE rank <= {K}")
def blend_topk(spark: SparkSession, d: str) -> DataFrame:
    """V-07, V-16."""
    return search.blended(b.entities(spark, d), b.vector_queries(spark, d), K)


_REASON_VEC = f"""rv AS MATERIALIZED (SELECT reason_id, from_id, list_transform(list_zip(x.vector::DOUBLE[], y.vector::DOUBLE[]), lambda p: ((p[1] + p[2]) / 2)::FLOAT) AS v
  FROM r JOIN e x ON x.entity_id = from_id JOIN e y ON y.entity_id = to_id WHERE {usable_sql('x.vector')} AND {usable_sql('y.vector')}),
 rh AS (SELECT query_id, reason_id, cosine, rank::INT AS rank FROM (SELECT g.kern_id AS query_id, reason_id, round({cos_sql('v', 'graviton_vec')}, 6) AS cosine,
   row_number() OVER (PARTITION BY g.kern_id ORDER BY round({cos_sql('v', 'graviton_vec')}, 6) DESC, reason_id) AS rank FROM rv JOIN g ON true WHERE {usable_sql('v')}) WHERE rank <= {SEED_K})"""


@query(with_(E_SQL, R_SQL, G_SQL, _REASON_VEC) + "SELECT query_id, reason_id, cosine, rank FROM rh")
def reason_topk(spark: SparkSession, d: str) -> DataFrame:
    """V-08."""
    rv = search.reason_vectors(b.reasons(spark, d), b.entities(spark, d))
    return search.reason_topk(rv, b.vector_queries(spark, d), SEED_K).withColumnRenamed("entity_id", "reason_id")


@query(with_(E_SQL, R_SQL, G_SQL, _REASON_VEC) + "SELECT query_id, from_id AS entity_id, greatest(max(cosine), 0) AS score FROM rh JOIN r USING (reason_id) GROUP BY ALL")
def reason_seed(spark: SparkSession, d: str) -> DataFrame:
    """V-09."""
    rv = search.reason_vectors(b.reasons(spark, d), b.entities(spark, d))
    return search.seed_by_reason(rv, b.vector_queries(spark, d), SEED_K)


_IMPORTANT = f"""i AS (SELECT g.kern_id AS query_id, e.entity_id, round({cos_sql('vector', 'graviton_vec')}, 6) AS score FROM e LEFT JOIN a ON a.entity_id = e.entity_id JOIN g ON true
  WHERE ((NOT starts_with(e.kern_id, 'remote-') AND kind = 'fact') OR coalesce(access_count, 0) >= 3) AND {usable_sql('vector')}
    AND round({cos_sql('vector', 'graviton_vec')}, 6) >= 0.2)"""


@query(with_(E_SQL, A_SQL, G_SQL, _IMPORTANT) + "SELECT query_id, entity_id, score FROM i")
def important_scan(spark: SparkSession, d: str) -> DataFrame:
    """V-10."""
    return search.important(b.entities(spark, d), b.accesses(spark, d), b.vector_queries(spark, d))


def _stems_sql(text: str) -> str:
    return f"list_transform({b.TERMS_SQL.format(t=text)}, lambda w: {b.STEM_SQL.format(t='w')})"


_BM25 = f"""dt AS MATERIALIZED (SELECT entity_id, {_stems_sql('text')} AS t FROM e WHERE text IS NOT NULL),
 ds AS MATERIALIZED (SELECT entity_id, len(t) AS dl, t FROM dt WHERE len(t) > 0), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ds),
 po AS (SELECT entity_id, dl, term, count(*) AS tf FROM (SELECT entity_id, dl, unnest(t) AS term FROM ds) GROUP BY ALL),
 qt AS (SELECT kern_id AS query_id, term, count(*) AS qtf FROM (SELECT kern_id, unnest({_stems_sql('graviton_text')}) AS term FROM g) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
 bm AS (SELECT query_id, entity_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score
   FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _ranked_sql(source: str, k: int) -> str:
    return f"SELECT query_id, entity_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM {source}) WHERE rank <= {k}"


@query(with_(E_SQL, G_SQL, _BM25) + _ranked_sql("bm", K))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """V-11."""
    return search.bm25(b.entities(spark, d), b.text_queries(spark, d), K)


@query(with_(E_SQL, G_SQL, _BM25) + _ranked_sql("(SELECT * FROM bm WHERE entity_id IN (SELECT entity_id FROM e WHERE kind = 'claim'))", K))
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """V-11 with a filter below the ranking; statistics stay global."""
    e = b.entities(spark, d)
    return search.bm25(e, b.text_queries(spark, d), K, e.where("kind = 'claim'"))


@query(with_(E_SQL) + f", t AS (SELECT entity_id, unnest({_stems_sql('text')}) AS term FROM e WHERE text IS NOT NULL), "
       "p AS (SELECT entity_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM p GROUP BY term")
def lexical_index(spark: SparkSession, d: str) -> DataFrame:
    """V-12: the term statistics of the derived postings."""
    return search.postings(b.entities(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


_SPLIT = "TIMESTAMPTZ '2025-10-01 00:00:00+00'"


@query(with_(E_SQL, G_SQL) + f""", s AS (SELECT g.kern_id AS query_id, entity_id, round({cos_sql('vector', 'graviton_vec')}, 6) AS score, created_at, status
    FROM e JOIN g ON true WHERE {usable_sql('vector')}),
  o AS (SELECT query_id, entity_id, score FROM s WHERE created_at < {_SPLIT} AND status <> 'superseded' UNION ALL SELECT query_id, entity_id, score FROM s WHERE created_at >= {_SPLIT}),
  b AS (SELECT query_id, entity_id, max(score) AS score FROM o GROUP BY ALL) """ + _ranked_sql("b", K))
def overlay_topk(spark: SparkSession, d: str) -> DataFrame:
    """V-05: snapshot before a date without tombstones, and the delta since."""
    e = b.entities(spark, d)
    hits = vec.score_against(e, b.vector_queries(spark, d)).withColumn("score", F.round("cosine", 6)).join(e.select("entity_id", "created_at", "status"), "entity_id")
    old = F.col("created_at") < sc.lit_ts("2025-10-01 00:00:00")
    return vec.top_k(search.overlay(hits.where(old), hits.where(~old), e.where(old & (F.col("status") == "superseded"))), K, "score")


_COLD_AGE = f"(epoch_us(TIMESTAMPTZ '{b.NOW}+00') - epoch_us(accessed_at)) / 1e6"
COLD_SQL = f"""h AS MATERIALIZED (SELECT *, CASE WHEN heat <= 0 THEN 0 WHEN accessed_at IS NULL OR {_COLD_AGE} <= 0 THEN heat ELSE heat * pow(2.0, -({_COLD_AGE}) / 604800.0) END AS heat_now FROM e),
 cold AS MATERIALIZED (SELECT * FROM h WHERE NOT (NOT starts_with(kern_id, 'remote-') AND status = 'active' AND kind IN ('fact', 'document'))
   AND heat_now < 0.01 AND epoch_us(TIMESTAMPTZ '{b.NOW}+00') - epoch_us(coalesce(accessed_at, created_at)) > 604800000000)"""


@query(with_(E_SQL, G_SQL, COLD_SQL) + _topk_sql("vector", "true").replace("FROM e JOIN g", "FROM cold JOIN g"))
def cold_search(spark: SparkSession, d: str) -> DataFrame:
    """V-13: brute cosine over the cold tier (what a collection would spill), vectors only."""
    cold = retrieval.cold_victims(b.entities(spark, d), b.now())
    return search.vector_topk(cold.select("entity_id", "vector"), b.vector_queries(spark, d), K)


_ASK = "(('0x' || substr(entity_id, 50, 15))::UBIGINT % 100) = 0"


def asking(e: DataFrame) -> DataFrame:
    """The stated query set of nearest-other joins: entities whose id, read as a number, is divisible by 100."""
    return e.where(F.pmod(F.conv(F.substring("entity_id", 50, 15), 16, 10).cast("long"), F.lit(100)) == 0)


_NEAREST = f"""q AS (SELECT entity_id AS query_id, vector FROM e WHERE {_ASK} AND {usable_sql('vector')}),
 s AS (SELECT query_id, entity_id, round({cos_sql('q.vector', 'e.vector')}, 6) AS cosine FROM q JOIN e ON query_id <> entity_id WHERE status <> 'superseded' AND {usable_sql('e.vector')}),
 x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, entity_id) AS rank FROM s)"""


@query(with_(E_SQL, _NEAREST) + "SELECT query_id, entity_id, cosine FROM x WHERE rank = 1")
def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    """W-04, V-15: the nearest other entity of every asking one."""
    e = b.entities(spark, d)
    q = asking(e).select(F.col("entity_id").alias("query_id"), "vector")
    return search.nearest_other(q, e.where("status <> 'superseded'"), b.DIM, 1).select("query_id", "entity_id", "cosine")


@query(with_(E_SQL, _NEAREST) + "SELECT query_id, entity_id, cosine, cosine >= 0.5 AS duplicate FROM x WHERE rank = 1 AND cosine >= 0.3")
def find_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """V-14, W-02: the nearest entity, if near enough to be the same."""
    e = b.entities(spark, d)
    q = asking(e).select(F.col("entity_id").alias("query_id"), "vector")
    return search.nearest_other(q, e.where("status <> 'superseded'"), b.DIM, 1, 0.3).select("query_id", "entity_id", "cosine", (F.col("cosine") >= 0.5).alias("duplicate"))


@query("SELECT min(doc_id) AS keep, count(*) AS n_copies, count(DISTINCT source) AS n_sources FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    """F-01, S-06: documents of one content id."""
    return table(spark, d, "documents").where("text is not null").groupBy(sc.content_hash(F.col("text")).alias("h")).agg(
        F.min("doc_id").alias("keep"), F.count("*").alias("n_copies"), F.countDistinct("source").alias("n_sources")
    ).where("n_copies > 1").drop("h")


# ---- ranking

@query("""WITH t AS (SELECT object_id, replica, ln(value::DOUBLE) AS x FROM pending_deltas WHERE target = 0 AND value > 0),
  m AS (SELECT object_id, max(x) AS m FROM t GROUP BY object_id) SELECT object_id, round(any_value(m) + ln(sum(exp(x - m))), 6) AS score FROM t JOIN m USING (object_id) GROUP BY object_id""")
def lse_merge(spark: SparkSession, d: str) -> DataFrame:
    """A-01 over all access totals of each object."""
    t = table(spark, d, "pending_deltas").where("target = 0 and value > 0").select("object_id", F.log("value").alias("score"))
    return ranking.log_sum_exp(t, ["object_id"]).select("object_id", F.round("score", 6).alias("score"))


_RRF = f"""dl AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, entity_id) AS p FROM ({_topk_sql('vector', "status <> 'superseded'", SEED_K)})),
 ll AS (SELECT query_id, entity_id, rank AS p FROM ({_ranked_sql('bm', 4 * SEED_K)})), il AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS p FROM i),
 f AS (SELECT query_id, entity_id, round(sum(w / (60.0 + p)), 9) AS score FROM (SELECT *, 1.0 AS w FROM dl UNION ALL SELECT *, 1.0 FROM ll UNION ALL SELECT *, 0.5 FROM il) GROUP BY ALL)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    e, q = b.entities(spark, d), b.vector_queries(spark, d)
    dense = search.vector_topk(e, q, SEED_K).withColumnRenamed("cosine", "score").drop("rank")
    lexical = search.bm25(e, b.text_queries(spark, d), 4 * SEED_K).drop("rank")
    return ranking.rrf([(dense, 1.0), (lexical, 1.0), (search.important(e, b.accesses(spark, d), q), 0.5)], 2 * SEED_K)


@query(with_(E_SQL, A_SQL, G_SQL, _BM25, _IMPORTANT, _RRF) + _ranked_sql("f", 2 * SEED_K))
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """R-03, R-05: dense, lexical and important lists fused."""
    return _fused(spark, d)


@query(with_(E_SQL, A_SQL, G_SQL, _BM25, _IMPORTANT, _RRF) + f""", z AS ({_ranked_sql("f", 2 * SEED_K)})
  SELECT query_id, entity_id, CASE WHEN {usable_sql('vector')} THEN round({cos_sql('vector', 'graviton_vec')}, 6) ELSE 0 END AS score FROM z JOIN e USING (entity_id) JOIN g ON g.kern_id = query_id""")
def rescored_seeds(spark: SparkSession, d: str) -> DataFrame:
    """R-06."""
    cos = vec.score_against(b.entities(spark, d), b.vector_queries(spark, d)).withColumn("cosine", F.round("cosine", 6))
    return ranking.rescore(_fused(spark, d), cos)


_PULL = f"pl AS (SELECT entity_id, max(mass * {cos_sql('vector', 'graviton_vec')}) AS pull FROM e JOIN g ON true WHERE {usable_sql('vector')} AND {cos_sql('vector', 'graviton_vec')} >= 0 GROUP BY entity_id)"


@query(with_(E_SQL, A_SQL, G_SQL, _PULL) + f"""SELECT e.entity_id, round(((score * greatest(0, conf_alpha / (conf_alpha + conf_beta) - sqrt(conf_alpha * conf_beta / ((conf_alpha + conf_beta) ** 2 * (conf_alpha + conf_beta + 1))))
    + least(0.1, ln(coalesce(access_count, 0) + 1.0) * 0.02 + CASE WHEN accessed_at IS NULL THEN 0 ELSE 0.05 * exp(-greatest({_COLD_AGE}, 0) / 86400.0) END)
    + CASE WHEN kind = 'fact' AND NOT starts_with(kern_id, 'remote-') THEN 0.3 ELSE 0 END) + 0.15 * coalesce(pull, 0)) * CASE WHEN starts_with(kern_id, 'remote-') THEN 0.4 ELSE 1 END, 6) AS score
  FROM e LEFT JOIN a ON a.entity_id = e.entity_id LEFT JOIN pl ON pl.entity_id = e.entity_id WHERE conf_alpha + conf_beta > 0""")
def boosts(spark: SparkSession, d: str) -> DataFrame:
    """R-10, R-11, R-12: every entity's own score boosted."""
    e = b.entities(spark, d).where("conf_alpha + conf_beta > 0")
    rows = ranking.confidence_boost(e.join(b.accesses(spark, d), "entity_id", "left"), b.now())
    pull = ranking.pulls(e, [(r.kern_id, list(r.graviton_vec), r.mass) for r in b.attractors(spark, d)])
    return ranking.remote_trust(ranking.gravity(rows, pull)).select("entity_id", F.round("score", 6).alias("score"))


@query(with_(E_SQL, A_SQL, G_SQL) + f", t AS ({_topk_sql('vector', chr(39) + 'x' + chr(39) + ' = ' + chr(39) + 'x' + chr(39), 40)}) SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY access_count DESC NULLS LAST, rank)::INT AS place FROM t LEFT JOIN a USING (entity_id)")
def sort_option(spark: SparkSession, d: str) -> DataFrame:
    """R-14: hits by access count, the previous order among equals."""
    hits = vec.top_k(vec.score_against(b.entities(spark, d), b.vector_queries(spark, d), 40), 40).join(b.accesses(spark, d), "entity_id", "left")
    return ranking.resorted(hits, "access").select("query_id", "entity_id", F.col("rank").alias("place"))


@query("""WITH j AS (SELECT DISTINCT job_id, source.scheme AS scheme, coalesce(split_part(source.section, '#chunk', 1), '') AS k, coalesce(confidence, 0) AS score FROM direct_jobs WHERE source.scheme IS NOT NULL),
  n AS (SELECT *, row_number() OVER (PARTITION BY scheme, CASE WHEN k = '' THEN job_id::VARCHAR ELSE 'k' || k END ORDER BY score DESC, job_id) AS n FROM j) SELECT scheme, job_id FROM n WHERE n = 1""")
def section_dedup(spark: SparkSession, d: str) -> DataFrame:
    """R-15: per scheme the best job of each section."""
    j = table(spark, d, "direct_jobs").where("source.scheme is not null").select(
        F.col("source.scheme").alias("query_id"), F.col("job_id").alias("entity_id"), F.col("source.section").alias("section"),
        F.coalesce("confidence", F.lit(0.0)).alias("score"), F.col("job_id").alias("rank")).distinct()
    return ranking.section_dedup(j).select(F.col("query_id").alias("scheme"), F.col("entity_id").alias("job_id"))


@query()
def mmr_rerank(spark: SparkSession, d: str) -> DataFrame:
    """R-16: the attractors' hits diversified to 10 of a pool of 50."""
    e = b.entities(spark, d)
    hits = search.vector_topk(e, b.vector_queries(spark, d), 60).withColumn("score", F.col("cosine")).join(e.select("entity_id", "vector"), "entity_id")
    return ranking.mmr(hits, 10)


@query(with_(E_SQL, G_SQL, _BM25) + f""", t AS ({_topk_sql('vector', "status <> 'superseded'", 40)}), mx AS (SELECT query_id, max(score) AS top FROM bm GROUP BY query_id),
  u AS (SELECT t.query_id, t.entity_id, round(cosine + 0.2 * coalesce(bm.score / top, 0), 6) AS score FROM t LEFT JOIN bm ON bm.query_id = t.query_id AND bm.entity_id = t.entity_id LEFT JOIN mx ON mx.query_id = t.query_id)
  SELECT query_id, entity_id, score FROM u""")
def lexical_boost(spark: SparkSession, d: str) -> DataFrame:
    """R-17."""
    e = b.entities(spark, d)
    hits = search.vector_topk(e, b.vector_queries(spark, d), 40).withColumnRenamed("cosine", "score")
    every = search.bm25(e, b.text_queries(spark, d), 1 << 30).drop("rank")
    return ranking.lexical_boost(hits, every, 0.2).select("query_id", "entity_id", F.round("score", 6).alias("score"))


@query(with_(E_SQL, G_SQL, COLD_SQL) + f""", hot AS (SELECT query_id, entity_id, cosine AS score FROM ({_topk_sql('vector', "status = 'active' AND kind = 'question' AND " + cos_sql('vector', 'graviton_vec') + ' >= 0.35', 10)})),
  c AS (SELECT query_id, entity_id, cosine AS score FROM ({_topk_sql('vector', 'true', 10).replace('FROM e JOIN g', 'FROM cold JOIN g')})),
  n AS (SELECT query_id, count(*) AS have FROM hot GROUP BY query_id),
  x AS (SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY score DESC, c.entity_id) AS rank FROM c ANTI JOIN hot ON hot.query_id = c.query_id AND hot.entity_id = c.entity_id)
  SELECT *, false AS cold FROM hot UNION ALL SELECT x.query_id, x.entity_id, x.score, true FROM x LEFT JOIN n ON n.query_id = x.query_id WHERE rank <= 10 - coalesce(have, 0)""")
def cold_fill(spark: SparkSession, d: str) -> DataFrame:
    """R-19: few hot hits filled up with cold ones."""
    e, q = b.entities(spark, d), b.vector_queries(spark, d)
    hot = vec.score_against(e.where("status = 'active' and kind = 'question'"), q, 10, 0.35)
    hot = vec.top_k(hot, 10).select("query_id", "entity_id", F.col("cosine").alias("score"))
    cold = search.vector_topk(retrieval.cold_victims(e, b.now()).select("entity_id", "vector"), q, 10).select("query_id", "entity_id", F.col("cosine").alias("score"))
    return ranking.cold_fill(hot, cold, 10)


@query("WITH RECURSIVE " + R_SQL + """, l AS (SELECT DISTINCT from_id AS newer, to_id AS older FROM r WHERE kind = 4),
  w AS (SELECT newer AS head, older AS entity_id, 1 AS depth FROM l UNION SELECT head, older, depth + 1 FROM w JOIN l ON newer = entity_id WHERE depth < (SELECT count(*) FROM l))
  SELECT head, entity_id, min(depth)::INT AS depth FROM w WHERE head <> entity_id GROUP BY ALL""")
def supersede_history(spark: SparkSession, d: str) -> DataFrame:
    """R-20: all ancestors of every head over supersedes edges."""
    links = b.reasons(spark, d).where(F.col("kind") == sc.Fixed.SUPERSEDES).select(F.col("from_id").alias("newer"), F.col("to_id").alias("older"))
    return walks.ancestors(links.select(F.col("newer").alias("head")), links)


@query(with_(E_SQL, R_SQL, G_SQL) + f""", t AS ({_topk_sql('vector', "status <> 'superseded'", 5)}),
  n AS (SELECT entity_id, count(*) AS n_edges, string_agg(DISTINCT kind::VARCHAR, ',' ORDER BY kind::VARCHAR) AS edge_kinds FROM
    (SELECT reason_id, kind, from_id AS entity_id FROM r UNION SELECT reason_id, kind, to_id FROM r) GROUP BY entity_id)
  SELECT query_id, entity_id, cosine, rank, kind, status, kern_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE coalesce(text, '') END AS text,
    round(conf_alpha / (conf_alpha + conf_beta), 6) AS confidence, round(conf_alpha * conf_beta / ((conf_alpha + conf_beta) ** 2 * (conf_alpha + conf_beta + 1)), 6) AS variance,
    coalesce(n_edges, 0) AS n_edges, edge_kinds FROM t JOIN e USING (entity_id) LEFT JOIN n USING (entity_id)""")
def result_envelope(spark: SparkSession, d: str) -> DataFrame:
    """R-21."""
    e = b.entities(spark, d)
    return ranking.envelope(search.vector_topk(e, b.vector_queries(spark, d), 5), e, b.reasons(spark, d))


@query(with_(E_SQL) + f""", w AS (SELECT DISTINCT object_id AS asked FROM pending_deltas WHERE target IN (0, 3) AND object_id IS NOT NULL)
  SELECT asked, entity_id IS NOT NULL AS found, coalesce(valid_until < TIMESTAMPTZ '{b.NOW}+00', false) AS expired FROM w LEFT JOIN e ON entity_id = asked""")
def id_lookup(spark: SparkSession, d: str) -> DataFrame:
    """R-23: a batch of ids, with what is missing or expired."""
    w = table(spark, d, "pending_deltas").where("target in (0, 3) and object_id is not null").select(F.col("object_id").alias("asked"))
    return ranking.lookup(w, b.entities(spark, d), b.now())


@query("""WITH RECURSIVE f AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  a AS (SELECT user_id, min(t) AS t FROM f GROUP BY ALL UNION ALL
    SELECT a.user_id, (SELECT min(f.t) FROM f WHERE f.user_id = a.user_id AND f.t >= a.t + 3600000000) AS t FROM a WHERE a.t IS NOT NULL)
  SELECT user_id::VARCHAR AS entity_id, count(*) AS n_accepted, min(t) AS first_us FROM a WHERE t IS NOT NULL GROUP BY ALL""")
def access_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """R-22, T-01: events as accesses, those that count under a cooldown."""
    log = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"))
    return ranking.accepted_accesses(log, 3600).groupBy("entity_id").agg(F.count("*").alias("n_accepted"), F.min("ts_us").alias("first_us"))


# ---- walks

def _pagerank_sql(rounds: int = 25) -> str:
    parts = [E_SQL, R_SQL, G_SQL,
             "ed AS MATERIALIZED (SELECT from_id AS src, to_id AS dst, count(*)::DOUBLE AS w FROM r WHERE NOT starts_with(kern_id, 'remote-') AND from_id <> to_id "
             "AND from_id IN (SELECT entity_id FROM e) AND to_id IN (SELECT entity_id FROM e) GROUP BY ALL)",
             "sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM ed)",
             f"sd AS (SELECT query_id, entity_id, greatest(cosine, 0) AS s FROM ({_topk_sql('vector', chr(39) + 'a' + chr(39) + ' <> status', SEED_K)}))".replace("'a' <> status", "status <> 'superseded'"),
             "te AS MATERIALIZED (SELECT query_id, entity_id, s / sum(s) OVER (PARTITION BY query_id) AS t FROM sd)", "k0 AS (SELECT query_id, entity_id, t AS rank FROM te)"]
    for i in range(1, rounds + 1):
        parts += [
            f"m{i} AS (SELECT query_id, dst AS entity_id, 0.85 * sum(rank * share) AS inflow FROM k{i - 1} JOIN sh ON src = entity_id GROUP BY ALL)",
            f"c{i} AS (SELECT query_id, sum(inflow) AS carried FROM m{i} GROUP BY query_id)",
            f"b{i} AS (SELECT te.query_id, entity_id, (1 - coalesce(carried, 0)) * t AS base FROM te LEFT JOIN c{i} ON c{i}.query_id = te.query_id)",
            f"k{i} AS MATERIALIZED (SELECT coalesce(m.query_id, b.query_id) AS query_id, coalesce(m.entity_id, b.entity_id) AS entity_id, coalesce(inflow, 0) + coalesce(base, 0) AS rank "
            f"FROM m{i} m FULL JOIN b{i} b ON m.query_id = b.query_id AND m.entity_id = b.entity_id)",
        ]
    return with_(*parts) + f"SELECT query_id, entity_id, round(rank, 6) AS rank FROM k{rounds}"


def _pagerank(spark: SparkSession, d: str, read_whole: int) -> DataFrame:
    e = b.entities(spark, d).select("entity_id", "vector", "status")
    seeds = search.vector_topk(e, b.vector_queries(spark, d), SEED_K).select("query_id", "entity_id", F.col("cosine").alias("score"))
    ranks = walks.pagerank(walks.voting_edges(b.reasons(spark, d), e), seeds, read_whole=read_whole)
    return ranks.select("query_id", "entity_id", F.round("rank", 6).alias("rank"))


@query(_pagerank_sql())
def pagerank_personalised(spark: SparkSession, d: str) -> DataFrame:
    """R-04 from every attractor's dense seeds: up to 25 rounds, ending once settled to 1e-9."""
    return _pagerank(spark, d, walks.READ_WHOLE)


@query(_pagerank_sql())
def pagerank_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    """R-04 by the distributed rounds that graphs above READ_WHOLE take."""
    return _pagerank(spark, d, 0)


def _beam(spark: SparkSession, d: str, read_whole: int) -> DataFrame:
    e = written(b.entities(spark, d).select("entity_id", "vector", "status"), "entities")
    walked = retrieval.expansion(e, b.reasons(spark, d), b.vector_queries(spark, d), retrieval.Settings(), read_whole=read_whole)
    return walked.where("kind = 'hit'").select("query_id", "entity_id", F.round("score", 6).alias("score"))


@query()
def beam_expand(spark: SparkSession, d: str) -> DataFrame:
    """R-07, R-08: best-first walks from every attractor's seeds, with traversal credit."""
    return _beam(spark, d, walks.WALK_WHOLE)


@query()
def beam_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    """R-07, R-08 read round by round, as graphs above WALK_WHOLE are."""
    return _beam(spark, d, 0)


@query()
def provenance_chains(spark: SparkSession, d: str) -> DataFrame:
    """R-18: the first chains of every query as text."""
    e, r = written(b.entities(spark, d), "entities"), written(b.reasons(spark, d), "reasons")
    walked = retrieval.expansion(e, r, b.vector_queries(spark, d), retrieval.Settings()).where("kind = 'chain'")
    return ranking.rendered_chains(walked, e, r)


@query()
def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The whole recall pipeline for every attractor as query."""
    return retrieval.retrieve(b.entities(spark, d), b.reasons(spark, d), b.accesses(spark, d), b.attractors(spark, d), b.now())


@query()
def retrieve_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline with filters that are active in every stage."""
    o = filters.QueryOptions(exclude_pending=True, min_conf=0.3, valid_at=b.NOW)
    return retrieval.retrieve(b.entities(spark, d), b.reasons(spark, d), b.accesses(spark, d), b.attractors(spark, d), b.now(), options=o)


_TREE = """RECURSIVE k AS (SELECT DISTINCT kern_id, parent_id FROM kerns), t AS (SELECT kern_id, 0 AS depth, [kern_id] AS path FROM k WHERE coalesce(parent_id, '') = ''
  UNION ALL SELECT k.kern_id, depth + 1, list_append(path, k.kern_id) FROM t JOIN k ON k.parent_id = t.kern_id WHERE NOT list_contains(path, k.kern_id))"""


@query("WITH " + _TREE + " SELECT kern_id, depth, array_to_string(path, '/') AS path FROM t")
def partition_tree(spark: SparkSession, d: str) -> DataFrame:
    """A-06: the partition tree."""
    return walks.tree(spark, table(spark, d, "kerns")).select("kern_id", "depth", F.array_join("path", "/").alias("path"))


@query("WITH " + _TREE + " SELECT kern_id, depth, pow(0.5, depth) AS strength FROM t WHERE pow(0.5, depth) >= 0.05")
def pulse_reach(spark: SparkSession, d: str) -> DataFrame:
    """M-01, M-02."""
    return walks.pulse(spark, table(spark, d, "kerns"))


@query("""WITH RECURSIVE k AS (SELECT DISTINCT kern_id, parent_id, kern_id = 'root' OR coalesce(graviton_text, '') <> '' OR kern_id IN (SELECT kern_id FROM entities) AS own FROM kerns),
  u AS (SELECT kern_id, parent_id FROM k WHERE own UNION SELECT k.kern_id, k.parent_id FROM u JOIN k ON k.kern_id = u.parent_id) SELECT kern_id FROM k WHERE kern_id NOT IN (SELECT kern_id FROM u)""")
def dead_partitions(spark: SparkSession, d: str) -> DataFrame:
    """M-13: partitions to evict, over all entities."""
    return walks.dead_partitions(spark, table(spark, d, "kerns"), table(spark, d, "entities"))
