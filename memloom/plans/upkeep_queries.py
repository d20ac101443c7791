"""Writes (W), upkeep (M), replication (C), statistics (A) and the change feed (S-09) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.operators import crdt, maintenance, retrieval, search, stats, writes
from memloom.plans import base as b
from memloom.plans.base import A_SQL, E_SQL, G_SQL, R_SQL, cos_sql, usable_sql, with_
from memloom.plans.scalar_queries import trim_sql
from memloom.plans.search_queries import COLD_SQL
from memloom.session import table
from memloom.sources import intake
from memloom.streaming import feed

QUERIES, ORACLE = {}, {}
NOW_SQL = f"TIMESTAMPTZ '{b.NOW}+00'"


def query(sql: str | None = None):
    """Register a query with its SQL."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return keep


# ---- writes

_CHUNKS = f"""l AS (SELECT job_id, arg_max(text, received_at) AS text, arg_max(kind, received_at) AS kind FROM direct_jobs WHERE length({trim_sql('text')}) > 0 GROUP BY job_id),
 p AS (SELECT job_id, kind, sha256(text) AS document_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {trim_sql('x')}), lambda x: length(x) > 0) AS parts FROM l),
 ch AS (SELECT job_id, sha256(text) AS entity_id, document_id, -1 AS index, CASE kind WHEN 'fact' THEN 'fact' ELSE 'document' END AS kind FROM p
   UNION ALL SELECT job_id, sha256(part), document_id, index, kind FROM (SELECT job_id, kind, document_id, unnest(parts) AS part, unnest(range(len(parts)))::INT AS index FROM p) WHERE sha256(part) <> document_id)"""


@query(with_(_CHUNKS) + "SELECT job_id, entity_id, document_id, index, kind FROM ch")
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """W-01."""
    return writes.chunked(table(spark, d, "direct_jobs")).select("job_id", "entity_id", "document_id", "index", "kind")


@query(with_(_CHUNKS) + "SELECT DISTINCT entity_id AS from_id, document_id AS to_id, 1 AS kind, 0.85::DOUBLE AS score FROM ch WHERE index >= 0")
def provenance_edges(spark: SparkSession, d: str) -> DataFrame:
    """W-05."""
    return writes.provenance_edges(writes.chunked(table(spark, d, "direct_jobs"))).select("from_id", "to_id", "kind", "score")


_ARRIVALS = "status <> 'superseded' AND review = 'pending'"


@query(with_(E_SQL) + f""", q AS (SELECT * FROM e WHERE {_ARRIVALS} AND {usable_sql('vector')}), s AS (SELECT * FROM e WHERE status <> 'superseded' AND review <> 'pending' AND {usable_sql('vector')}),
  x AS (SELECT q.entity_id AS i, s.entity_id AS o, round({cos_sql('q.vector', 's.vector')}, 6) AS c FROM q JOIN s ON true),
  m AS (SELECT * FROM x WHERE c >= 0.4 QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, o) = 1)
  SELECT s.entity_id, round(any_value(s.conf_alpha) + sum(q.conf_alpha / (q.conf_alpha + q.conf_beta)), 6) AS conf_alpha, count(*) AS n_merged,
    epoch_us(least(any_value(s.valid_until), min(q.valid_until))) AS until_us FROM m JOIN q ON q.entity_id = i JOIN s ON s.entity_id = o GROUP BY s.entity_id""")
def merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """W-02: pending rows merged into the nearest reviewed one, at a low threshold."""
    e = b.entities(spark, d).where("status <> 'superseded'")
    q, s = e.where("review = 'pending'"), e.where("review <> 'pending'")
    near = search.nearest_other(q.select(F.col("entity_id").alias("query_id"), "vector"), s, b.DIM, 1, 0.4)
    updated, _, _ = writes.merge_duplicates(s, q, near)
    return updated.select("entity_id", F.round("conf_alpha", 6).alias("conf_alpha"), "n_merged", F.unix_micros("valid_until").alias("until_us"))


@query(with_(E_SQL, G_SQL) + f""", x AS (SELECT entity_id, g.kern_id, mass, inner_radius AS i, outer_radius AS o, 1 - {cos_sql('vector', 'graviton_vec')} AS dist FROM e JOIN g ON true WHERE {usable_sql('vector')}),
  p AS (SELECT *, round(CASE WHEN dist <= i THEN 1 WHEN dist >= o THEN 0 ELSE 1 / (1 + exp(8 * ((dist - i) / (o - i) - 0.5))) END, 9) AS p FROM x),
  w AS (SELECT * FROM p WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY p DESC, round(dist / greatest(mass, 1e-6), 9), kern_id) = 1)
  SELECT e.entity_id, coalesce(w.kern_id, 'generic') AS kern_id FROM e LEFT JOIN w ON w.entity_id = e.entity_id""")
def route_entities(spark: SparkSession, d: str) -> DataFrame:
    """W-03."""
    return writes.route(b.entities(spark, d), b.attractors(spark, d))


@query("""WITH v AS (SELECT event_id::VARCHAR AS entity_id, user_id::VARCHAR || '/' || event_type AS external_id, ts FROM events)
  SELECT entity_id, external_id, CASE WHEN lead(entity_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status, lead(entity_id) OVER w AS superseded_by,
    epoch_us(lead(ts) OVER w) AS to_us, (row_number() OVER w - 1)::INT AS n_before FROM v WINDOW w AS (PARTITION BY external_id ORDER BY ts, entity_id)""")
def supersede_scd2(spark: SparkSession, d: str) -> DataFrame:
    """W-06: every event a version of its user's state of that type."""
    v = table(spark, d, "events").select(F.col("event_id").cast("string").alias("entity_id"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("external_id"),
                                         F.col("ts").cast("timestamp").alias("created_at"))
    s = writes.supersede(v)
    return s.select("entity_id", "external_id", "status", "superseded_by", F.unix_micros("valid_to").alias("to_us"), "n_before")


@query("""WITH r AS (SELECT DISTINCT record_id, source_uri, replaces, modified_at, sha256(content) AS h FROM ingest_records),
  m AS (SELECT n.record_id, n.source_uri, o.record_id AS replaced_id, coalesce(n.h, '') = coalesce(o.h, '') AS pure_rename, o.modified_at AS t, o.h AS oh FROM r n JOIN r o ON n.replaces = o.source_uri AND o.record_id <> n.record_id AND o.modified_at < n.modified_at)
  SELECT record_id, source_uri, replaced_id, pure_rename FROM m QUALIFY row_number() OVER (PARTITION BY record_id, source_uri ORDER BY t DESC, replaced_id DESC, oh DESC NULLS LAST) = 1""")
def supersede_rename(spark: SparkSession, d: str) -> DataFrame:
    """W-07."""
    return writes.supersede_on_rename(table(spark, d, "ingest_records"))


@query(with_(E_SQL, R_SQL) + """, g AS (SELECT entity_id FROM e WHERE user_id = 'user-babamar' AND NOT (NOT starts_with(kern_id, 'remote-') AND status = 'active' AND kind = 'fact'))
  SELECT 'entities' AS what, count(*) AS n FROM e WHERE entity_id NOT IN (SELECT entity_id FROM g)
  UNION ALL SELECT 'edges', count(*) FROM r WHERE from_id NOT IN (SELECT entity_id FROM g) AND to_id NOT IN (SELECT entity_id FROM g)
  UNION ALL SELECT 'kept', count(*) FROM e WHERE user_id = 'user-babamar' AND NOT starts_with(kern_id, 'remote-') AND status = 'active' AND kind = 'fact'""")
def forget_cascade(spark: SparkSession, d: str) -> DataFrame:
    """W-12: everything of one user forgotten, local active facts kept."""
    e = b.entities(spark, d)
    left, edges, kept = writes.forget(e, b.reasons(spark, d), e.where("user_id = 'user-babamar'"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(left, "entities").unionByName(count(edges, "edges")).unionByName(count(kept, "kept"))


@query(with_(E_SQL, R_SQL) + """, f AS (SELECT reason_id, score, from_id AS x FROM r UNION SELECT reason_id, score, to_id FROM r),
  h AS (SELECT reason_id, score, 0.15 * pow(0.75, row_number() OVER (PARTITION BY x ORDER BY reason_id) - 1) AS loss FROM f WHERE x IN (SELECT entity_id FROM e WHERE kind = 'question')),
  s AS (SELECT reason_id, any_value(score) - sum(loss) AS n FROM h GROUP BY reason_id) SELECT reason_id, round(greatest(n, 0), 6) AS score, n < 0.05 AS removed FROM s""")
def degrade_edges(spark: SparkSession, d: str) -> DataFrame:
    """W-13 around all questions."""
    return writes.degrade(b.reasons(spark, d), b.entities(spark, d).where("kind = 'question'")).select("reason_id", F.round("score", 6).alias("score"), "removed")


@query(with_(E_SQL, R_SQL) + """, t AS (SELECT max(kern_id) AS k FROM kerns), m AS (SELECT entity_id FROM e WHERE kind = 'conclusion')
  SELECT reason_id, CASE WHEN from_id IN (SELECT entity_id FROM m) THEN k ELSE kern_id END AS kern_id, CASE WHEN to_id IN (SELECT entity_id FROM m) THEN k ELSE to_kern_id END AS to_kern_id FROM r, t""")
def move_entities(spark: SparkSession, d: str) -> DataFrame:
    """W-14: all conclusions moved to one partition; the edges."""
    e, kerns = b.entities(spark, d), table(spark, d, "kerns")
    target = kerns.agg(F.max("kern_id").alias("kern_id"))
    moves = e.where("kind = 'conclusion'").select("entity_id").join(F.broadcast(target), F.lit(True))
    return writes.move(e, b.reasons(spark, d), moves, kerns)[1].select("reason_id", "kern_id", "to_kern_id")


@query(with_(E_SQL) + "SELECT entity_id, CASE WHEN review = 'pending' AND kind = 'claim' THEN 'active' ELSE review END AS review FROM e")
def promote_review(spark: SparkSession, d: str) -> DataFrame:
    """W-15."""
    e = b.entities(spark, d)
    return writes.promote(e, e.where("kind = 'claim'")).select("entity_id", "review")


@query(with_(E_SQL) + """, n AS (SELECT kern_id, count(*) AS n FROM e GROUP BY kern_id) SELECT DISTINCT k.kern_id, graviton_text, mass, coalesce(n, 0) AS n_entities FROM kerns k LEFT JOIN n ON n.kern_id = k.kern_id
  WHERE parent_id = 'root' AND coalesce(graviton_text, '') NOT IN ('', 'generic')""")
def graviton_list(spark: SparkSession, d: str) -> DataFrame:
    """W-16."""
    return writes.list_gravitons(table(spark, d, "kerns"), b.entities(spark, d))


@query(with_(E_SQL) + f""", v AS (SELECT kern_id, vector FROM e WHERE {usable_sql('vector')}), c AS (SELECT kern_id, i, avg(x::DOUBLE) AS m FROM (SELECT kern_id, unnest(vector) AS x, unnest(range(64)) AS i FROM v) GROUP BY ALL)
  SELECT kern_id, round(sum(m) / sqrt(sum(m * m)), 6) AS unit_sum FROM c GROUP BY kern_id""")
def pooled_partitions(spark: SparkSession, d: str) -> DataFrame:
    """F-05, W-16: mean-pooled vectors of partitions."""
    from memloom.functions import vec

    ok = b.entities(spark, d).where((F.size("vector") == b.DIM) & vec.usable(F.col("vector")))
    p = vec.mean_pool(ok, ["kern_id"], "vector")
    return p.select("kern_id", F.round(F.aggregate("pooled", F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


@query(with_(E_SQL) + f", w AS (SELECT *, {NOW_SQL} + to_seconds(ascii(entity_id) * 86400) AS t FROM e WHERE kind = 'fact') SELECT entity_id, epoch_us(least(valid_until, t)) AS until_us, valid_until IS NULL OR t < valid_until AS changed FROM w")
def ttl_write(spark: SparkSession, d: str) -> DataFrame:
    """W-18."""
    e = b.entities(spark, d).where("kind = 'fact'")
    w = e.select("entity_id", F.timestamp_micros(F.unix_micros(b.now()) + F.ascii("entity_id") * 86_400_000_000).alias("ttl"))
    return writes.set_deadline(e, w, "local").select("entity_id", F.unix_micros("valid_until").alias("until_us"), "changed")


@query(with_(R_SQL) + "SELECT from_id, to_id, CASE WHEN starts_with(kern_id, 'remote-') THEN 0.95 ELSE 1.0 END::DOUBLE AS score FROM r WHERE kind = 0 AND text IS NOT NULL")
def asserted_links(spark: SparkSession, d: str) -> DataFrame:
    """W-11."""
    r = b.reasons(spark, d).where("kind = 0 and text is not null")
    return writes.link(r, ~sc.is_remote(F.col("kern_id"))).select("from_id", "to_id", "score")


@query()
def reembedded(spark: SparkSession, d: str) -> DataFrame:
    """W-19, S-10, M-12: all entity texts embedded anew by the hashed model."""
    e, r = writes.reembed(b.entities(spark, d), b.reasons(spark, d))
    n = r.agg(F.sum(F.col("vector").isNotNull().cast("long")).alias("n_edges"))
    return e.groupBy("kern_id").agg(F.count("vector").alias("n_vectors"), F.sum(F.col("embed_failed").cast("int")).alias("n_failed")).join(F.broadcast(n), F.lit(True))


@query()
def distilled(spark: SparkSession, d: str) -> DataFrame:
    """W-09: transcripts distilled by a stub that makes each assistant line a claim."""
    docs = table(spark, d, "documents").where("text like '%assistant:%'").select("doc_id", "text")
    claims, _ = writes.distil(docs, intake.stub_distiller)
    return claims.select("doc_id", "entity_id", "section", "title")


# ---- upkeep

@query(with_(E_SQL, COLD_SQL) + "SELECT entity_id, kern_id, kind, round(heat_now, 6) AS heat_now FROM cold")
def gc_victims(spark: SparkSession, d: str) -> DataFrame:
    """M-03, F-33."""
    return retrieval.cold_victims(b.entities(spark, d), b.now()).select("entity_id", "kern_id", "kind", F.round("heat_now", 6).alias("heat_now"))


@query(with_(E_SQL, R_SQL, COLD_SQL) + "SELECT kern_id, count(*) AS n_left FROM r WHERE from_id NOT IN (SELECT entity_id FROM cold) AND to_id NOT IN (SELECT entity_id FROM cold) GROUP BY kern_id")
def gc_sweep(spark: SparkSession, d: str) -> DataFrame:
    """M-03: edges left after collection, by partition."""
    return maintenance.collect_garbage(b.entities(spark, d), b.reasons(spark, d), b.now())[2].groupBy("kern_id").agg(F.count("*").alias("n_left"))


@query(with_(E_SQL, COLD_SQL) + "SELECT entity_id FROM cold ORDER BY created_at DESC NULLS LAST, entity_id LIMIT 100")
def cold_cap(spark: SparkSession, d: str) -> DataFrame:
    """K-08 with a small cap."""
    return maintenance.capped_cold(retrieval.cold_victims(b.entities(spark, d), b.now()), 100, 0).select("entity_id")


_D = f"epoch_us({NOW_SQL}) - epoch_us(updated_at)"
_FADE = "round(CASE WHEN status = 'superseded' THEN {c} ELSE 1 + CASE WHEN {c} - 1 <= 0 THEN 0 WHEN updated_at IS NULL OR " + _D + " <= 0 THEN {c} - 1 ELSE ({c} - 1) * pow(2.0, -(" + _D + ") / 1e6 / 2592000.0) END END, 5)"


@query(with_(E_SQL) + f"SELECT entity_id, {_FADE.format(c='conf_alpha')} AS alpha, {_FADE.format(c='conf_beta')} AS beta FROM e")
def evidence_decay(spark: SparkSession, d: str) -> DataFrame:
    """M-04."""
    e = b.entities(spark, d).withColumn("conf_alpha", F.col("conf_alpha").cast("double")).withColumn("conf_beta", F.col("conf_beta").cast("double"))
    return maintenance.decay_evidence(e, b.now(), b.HALF_LIFE_S).select("entity_id", F.round("conf_alpha", 5).alias("alpha"), F.round("conf_beta", 5).alias("beta"))


@query()
def greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """M-05, M-06: clusters of every partition."""
    c = maintenance.clusters(b.entities(spark, d), b.DIM)
    return c.groupBy("kern_id", "cluster").agg(F.max("size").alias("size"), F.round(F.max("cohesion"), 6).alias("cohesion"), F.min(F.when(F.col("is_centre"), F.col("entity_id"))).alias("centre"))


@query()
def spawn_and_name(spark: SparkSession, d: str) -> DataFrame:
    """M-07, M-08: members that would move to children, and names of unnamed partitions; sizes as small as the test partitions."""
    e, k = b.entities(spark, d), table(spark, d, "kerns")
    c = maintenance.clusters(e, b.DIM)
    shaped = maintenance.centroids(c, e, k)
    moves = maintenance.spawned(c, shaped, size=2).groupBy("kern_id", F.col("new_part").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("spawn"))
    names = maintenance.naming(c, shaped, e, size=1).select("kern_id", "name", F.lit(1).cast("long").alias("n"), F.lit("name").alias("what"))
    return moves.unionByName(names)


@query(with_(G_SQL) + f""", n AS (SELECT kern_id, any_value(graviton_text) AS t, any_value(graviton_vec) AS v FROM kerns WHERE parent_id <> 'root' AND coalesce(graviton_text, '') <> '' GROUP BY kern_id)
  SELECT kern_id, t AS graviton_text FROM n WHERE t NOT IN (SELECT graviton_text FROM g) AND kern_id NOT IN (SELECT n.kern_id FROM n JOIN g ON true WHERE {usable_sql('v')} AND {cos_sql('v', 'g.graviton_vec')} >= 0.85)""")
def promotable_partitions(spark: SparkSession, d: str) -> DataFrame:
    """M-08, W-16: named partitions that may move to the root."""
    return maintenance.promotable(table(spark, d, "kerns"), b.attractors(spark, d))


def _cut(c: str) -> str:
    return f"CASE WHEN length({c}) > 200 THEN left({c}, 200) || '...' ELSE coalesce({c}, '') END"


@query(with_(E_SQL, R_SQL) + f"""SELECT reason_id, {_cut('x.text')} || ' -> ' || {_cut('y.text')} AS sentence FROM r JOIN e x ON x.entity_id = from_id JOIN e y ON y.entity_id = to_id
  WHERE coalesce(r.text, '') = '' AND r.kind NOT IN (2, 3) AND NOT starts_with(x.kern_id, 'remote-') AND NOT starts_with(y.kern_id, 'remote-')""")
def enrichable_edges(spark: SparkSession, d: str) -> DataFrame:
    """M-09: what the model would be asked."""
    return maintenance.enrichable(b.reasons(spark, d), b.entities(spark, d))


@query(with_(E_SQL, R_SQL) + f""", q AS (SELECT reason_id, vector FROM r JOIN e ON e.entity_id = from_id WHERE r.kind = 2 AND {usable_sql('vector')}),
  x AS (SELECT reason_id, entity_id AS to_id, round({cos_sql('q.vector', 'e.vector')}, 6) AS cosine FROM q JOIN e ON true WHERE e.kind <> 'question' AND {usable_sql('e.vector')})
  SELECT reason_id, to_id, 0 AS kind, cosine FROM x WHERE cosine >= 0.8 QUALIFY row_number() OVER (PARTITION BY reason_id ORDER BY cosine DESC, to_id) = 1""")
def resolve_questions(spark: SparkSession, d: str) -> DataFrame:
    """M-11, C-13: open questions, with their asker's vector, answered by the nearest entity that is no question."""
    e = b.entities(spark, d)
    q = b.reasons(spark, d).where("kind = 2").join(e.select(F.col("entity_id").alias("from_id"), "vector"), "from_id").select("reason_id", "vector")
    return maintenance.resolve_questions(q, e.where("kind <> 'question'"), b.DIM)


@query()
def gcn_propagate(spark: SparkSession, d: str) -> DataFrame:
    """M-15 to M-17, G: structure vectors of partitions of 16 or more entities; figures that don't depend on summation order."""
    v = maintenance.structure_vectors(b.entities(spark, d), b.reasons(spark, d), b.DIM, least=16)
    n = F.sqrt(F.aggregate("gnn_vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.groupBy("kern_id").agg(F.count("*").alias("n_vectors"), F.round(F.max(n), 3).alias("norm"), F.max(F.col("last_loss") < F.col("first_loss")).alias("learned"))


# ---- replication

@query("""SELECT object_id, replica, max(value) AS value FROM pending_deltas WHERE target = 0 AND value BETWEEN 1 AND 1000000 AND length(replica) > 0 GROUP BY ALL""")
def gcounter_merge(spark: SparkSession, d: str) -> DataFrame:
    """C-01."""
    return crdt.counter_slots(table(spark, d, "pending_deltas"))


@query("""SELECT object_id, sum(v)::BIGINT AS total FROM (SELECT object_id, replica, max(value) AS v FROM pending_deltas WHERE target = 1 AND value BETWEEN 1 AND 1000000 AND length(replica) > 0 GROUP BY ALL) GROUP BY object_id""")
def traversal_totals(spark: SparkSession, d: str) -> DataFrame:
    """C-01, C-06 for edges."""
    return crdt.counter_values(crdt.counter_slots(table(spark, d, "pending_deltas"), crdt.TRAVERSAL))


@query("""SELECT object_id, target, lamport, producer FROM pending_deltas WHERE lamport IS NOT NULL AND object_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY object_id, target ORDER BY lamport DESC, producer DESC NULLS LAST) = 1""")
def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    """C-02."""
    rows = table(spark, d, "pending_deltas").where("lamport is not null and object_id is not null")
    return crdt.lww(rows, ["object_id", "target"], [])


@query(with_(E_SQL) + "SELECT entity_id, kern_id, status, superseded_by, epoch_us(created_at) AS created_us, epoch_us(accessed_at) AS accessed_us, round(heat, 4) AS heat, epoch_us(valid_until) AS until_us FROM e")
def entity_join(spark: SparkSession, d: str) -> DataFrame:
    """C-03, C-05."""
    raw = table(spark, d, "entities")
    return crdt.absorb(raw.where("kind = 'fact'"), raw).select(
        "entity_id", "kern_id", "status", "superseded_by", F.unix_micros("created_at").alias("created_us"), F.unix_micros("accessed_at").alias("accessed_us"),
        F.round(F.col("heat").cast("double"), 4).alias("heat"), F.unix_micros("valid_until").alias("until_us"))


@query(with_(R_SQL) + "SELECT reason_id, kern_id, from_id, to_id, kind, score FROM r")
def reason_join(spark: SparkSession, d: str) -> DataFrame:
    """C-06."""
    return b.reasons(spark, d).select("reason_id", "kern_id", "from_id", "to_id", "kind", "score")


@query(with_(E_SQL) + """, l AS (SELECT * FROM e WHERE NOT starts_with(kern_id, 'remote-')), n AS (SELECT kern_id, entity_id, row_number() OVER (PARTITION BY kern_id ORDER BY entity_id) AS n FROM e WHERE starts_with(kern_id, 'remote-'))
  SELECT entity_id, kern_id, 0.5::DOUBLE AS score FROM n WHERE n <= 20""")
def remote_insert(spark: SparkSession, d: str) -> DataFrame:
    """C-04: remote entities offered to a store that has only local ones, with a small cap."""
    e = b.entities(spark, d)
    local = e.where(~sc.is_remote(F.col("kern_id")))
    return crdt.remote_insert(local, e.where(sc.is_remote(F.col("kern_id"))), 20).select("entity_id", "kern_id", "score")


_STATE3 = """WITH c AS (SELECT object_id, target, lamport, producer, lower(trim(op, E' \\t\\n\\r\\x0b\\x0c')) AS o, lww_value, lww_ts FROM pending_deltas WHERE target = 3 AND lamport IS NOT NULL),
  f AS (SELECT * FROM c WHERE o = 'delete' OR (o IN ('insert', 'update') AND coalesce((octet_length(lww_value) = 1 AND hex(lww_value) = '00') OR (octet_length(lww_value) IN (7, 11) AND hex(lww_value)[1:2] = '01'), false))),
  s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY lamport DESC, producer DESC NULLS LAST, (o = 'delete') DESC, lww_value DESC NULLS LAST) = 1),
  d AS (SELECT entity_id, any_value(kern_id) AS kern_id, arg_max_null(valid_until, (coalesce(valid_until_lamport, 0), coalesce(valid_until_producer, ''))) AS valid_until,
    max((coalesce(valid_until_lamport, 0), coalesce(valid_until_producer, ''))) AS stamp FROM entities GROUP BY entity_id)"""


@query(_STATE3 + """ SELECT entity_id, epoch_us(CASE WHEN starts_with(kern_id, 'remote-') AND o <> 'delete' AND (s.lamport, coalesce(s.producer, '')) > stamp THEN lww_ts ELSE valid_until END) AS until_us
  FROM d LEFT JOIN s ON object_id = entity_id""")
def apply_deltas(spark: SparkSession, d: str) -> DataFrame:
    """C-07: deadlines after the feed, in remote partitions only."""
    _, e, _ = crdt.apply_deltas(b.entities(spark, d), b.reasons(spark, d), table(spark, d, "pending_deltas"))
    return e.select("entity_id", F.unix_micros("valid_until").alias("until_us"))


@query(with_(E_SQL) + "SELECT entity_id, round(heat, 4) AS heat FROM e WHERE NOT starts_with(kern_id, 'remote-') ORDER BY e.heat DESC, entity_id LIMIT 32")
def hottest_batch(spark: SparkSession, d: str) -> DataFrame:
    """C-08."""
    return crdt.hottest(b.entities(spark, d)).select("entity_id", F.round(F.col("heat").cast("double"), 4).alias("heat"))


@query(with_(E_SQL) + "SELECT entity_id, producer_id FROM e WHERE producer_id IS DISTINCT FROM 'net-28ffd3' AND sha256(text) = entity_id")
def entity_sync(spark: SparkSession, d: str) -> DataFrame:
    """C-09, F-34."""
    return crdt.entity_sync(b.entities(spark, d), "net-28ffd3").select("entity_id", "producer_id")


@query(with_(E_SQL) + """SELECT coalesce(CASE WHEN NOT coalesce(sha256(text) = entity_id, false) THEN 'forged_id' WHEN producer_id NOT IN ('net-28ffd3', 'net-eebc16') THEN 'writer_not_admissible'
  WHEN kind NOT IN ('fact', 'claim') THEN 'kind_not_admissible' END, 'ok') AS verdict, count(*) AS n FROM e GROUP BY ALL""")
def contract_validate(spark: SparkSession, d: str) -> DataFrame:
    """C-10: verdicts in order of the checks."""
    r = crdt.refusal(F.col("entity_id"), F.col("text"), F.col("producer_id"), ["net-28ffd3", "net-eebc16"], F.col("kind"), ["fact", "claim"])
    return b.entities(spark, d).groupBy(F.coalesce(r, F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT entity_id, max(coalesce(valid_until_lamport, 0)) AS lamport FROM entities GROUP BY entity_id),
  r AS (SELECT entity_id, CASE WHEN lamport % 5 = 3 THEN lamport - 1 ELSE lamport END AS have FROM l WHERE NOT contains('19', left(entity_id, 1)))
  SELECT l.entity_id, lamport FROM l LEFT JOIN r USING (entity_id) WHERE have IS NULL OR have < lamport""")
def anti_entropy_diff(spark: SparkSession, d: str) -> DataFrame:
    """C-10: what a replica lacks or has older, by differing buckets."""
    local = table(spark, d, "entities").groupBy("entity_id").agg(F.max(F.coalesce("valid_until_lamport", F.lit(0))).alias("lamport"))
    remote = local.where(~F.substring("entity_id", 1, 1).isin("1", "9")).select("entity_id", F.when(F.col("lamport") % 5 == 3, F.col("lamport") - 1).otherwise(F.col("lamport")).alias("lamport"))
    return crdt.contract_diff(local, remote)


@query("""SELECT user_id AS peer, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, count(*) AS n, greatest(count(*) - 2, 0) AS refused FROM events GROUP BY ALL""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """C-11: events as frames, two an hour."""
    f = table(spark, d, "events").select(F.col("user_id").alias("peer"), F.col("ts").cast("timestamp").alias("ts"))
    return crdt.over_rate(f, 2, "1 hour").select("peer", F.unix_micros("window_start").alias("start_us"), "n", "refused")


@query("""SELECT user_id, event_type, floor(epoch_us(ts) / 3600000000)::BIGINT AS slot, epoch_us(min(ts)) AS ts_us, count(*) AS n_sights FROM events GROUP BY ALL""")
def seen_set(spark: SparkSession, d: str) -> DataFrame:
    """C-11: first sights per hour."""
    f = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return crdt.first_seen(f, ["user_id", "event_type"], 3600).select("user_id", "event_type", "slot", F.unix_micros("ts").alias("ts_us"), "n_sights")


_FOLD = """WITH RECURSIVE f AS (SELECT DISTINCT {key}, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  a AS (SELECT {key}, min(t) AS t FROM f GROUP BY ALL UNION ALL
    SELECT {outer}, (SELECT min(f.t) FROM f WHERE {match} AND f.t >= a.t + {ttl}) AS t FROM a WHERE a.t IS NOT NULL)"""


@query(_FOLD.format(key="user_id, event_type", outer="a.user_id, a.event_type", match="f.user_id = a.user_id AND f.event_type = a.event_type", ttl=3_600_000_000)
       + " SELECT user_id::VARCHAR AS user_id, event_type::VARCHAR AS event_type, t AS ts_us FROM a WHERE t IS NOT NULL")
def seen_sliding(spark: SparkSession, d: str) -> DataFrame:
    """C-11: sights that count as new under a sliding hour."""
    f = table(spark, d, "events").where("user_id is not null and event_type is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return crdt.first_seen_sliding(f, ["user_id", "event_type"], 3600)


@query(with_(E_SQL) + """, d AS (SELECT object_id AS entity_id, max(lamport) AS lamport FROM pending_deltas WHERE lamport IS NOT NULL GROUP BY object_id),
  n AS (SELECT e.entity_id, kind FROM e JOIN d USING (entity_id) WHERE kind IN ('fact', 'claim') AND sha256(text) = e.entity_id)
  SELECT entity_id, kind FROM n""")
def contract_apply(spark: SparkSession, d: str) -> DataFrame:
    """C-10, C-14, C-20: a contract's state after a delta of the entities that were changed, of two admissible kinds."""
    e = b.entities(spark, d)
    lamport = table(spark, d, "pending_deltas").where("lamport is not null").groupBy(F.col("object_id").alias("entity_id")).agg(F.max("lamport").alias("lamport"))
    delta = e.join(lamport, "entity_id").select("entity_id", "text", "lamport", "producer_id", "kind", "valid_until", F.lit(False).alias("retired"))
    state, _ = crdt.apply_contract(delta.limit(0), delta, b.now(), kinds=["fact", "claim"], cap=1 << 40)
    return crdt.fetched(state, state).join(state.select("entity_id", "kind"), "entity_id").select("entity_id", "kind")


@query("SELECT object_id, target, arrival_seq, replica, value FROM pending_deltas QUALIFY row_number() OVER (PARTITION BY object_id, target ORDER BY arrival_seq DESC) = 1")
def delta_buffer(spark: SparkSession, d: str) -> DataFrame:
    """C-18."""
    return crdt.flush_buffer(table(spark, d, "pending_deltas")).select("object_id", "target", "arrival_seq", "replica", "value")


@query("SELECT max(coalesce(lamport, 0)) + 1 AS clock FROM pending_deltas")
def lamport_clock(spark: SparkSession, d: str) -> DataFrame:
    """C-19."""
    return crdt.observed_clock(table(spark, d, "pending_deltas"))


@query("""SELECT DISTINCT kern_id, parent_id FROM kerns UNION SELECT DISTINCT 'remote-peer-' || kern_id, 'root' FROM kerns WHERE parent_id = 'root'""")
def sphere_announce(spark: SparkSession, d: str) -> DataFrame:
    """C-14, C-15: a peer's top partitions upserted as shells."""
    k = table(spark, d, "kerns").dropDuplicates(["kern_id"])
    return crdt.announce(k, k.where("parent_id = 'root'"), "peer").select("kern_id", "parent_id")


@query("""SELECT DISTINCT kern_id, least(greatest(mass, 0), 1) AS strength FROM kerns WHERE starts_with(kern_id, 'remote-')""")
def remote_pulse(spark: SparkSession, d: str) -> DataFrame:
    """C-16."""
    k = table(spark, d, "kerns")
    return crdt.remote_pulse(k, k.select("kern_id", F.col("mass").alias("strength")).distinct())


# ---- statistics

@query(with_(E_SQL, R_SQL) + """SELECT count(*) AS n_partitions, count(*) FILTER (coalesce(graviton_text, '') = '') AS n_unnamed, (SELECT count(*) FROM e) AS n_entities,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY kern_id)) AS largest_partition, (SELECT count(*) FROM r) AS n_reasons FROM (SELECT DISTINCT ON (kern_id) * FROM kerns)""")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-02, A-07."""
    return stats.counts(table(spark, d, "kerns").dropDuplicates(["kern_id"]), b.entities(spark, d), b.reasons(spark, d))


_GINI = """SELECT round(2 * sum(i * x) / (any_value(n) * sum(x)) - (any_value(n) + 1.0) / any_value(n), 6) AS gini FROM (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM ({q}))"""


@query(with_(A_SQL) + _GINI.format(q="SELECT access_count::DOUBLE AS x FROM a"))
def gini_access(spark: SparkSession, d: str) -> DataFrame:
    """A-03 over access counts."""
    return stats.gini(b.accesses(spark, d), "access_count").select(F.round("gini", 6).alias("gini"))


@query(with_(E_SQL) + _GINI.format(q="SELECT count(*)::DOUBLE AS x FROM e GROUP BY kern_id"))
def gini_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A-03 over partition sizes."""
    return stats.gini(b.entities(spark, d).groupBy("kern_id").agg(F.count("*").alias("n")), "n").select(F.round("gini", 6).alias("gini"))


@query(with_(E_SQL) + "SELECT entity_id, round(score, 6) AS score FROM e WHERE score IS NOT NULL ORDER BY e.score DESC, entity_id LIMIT 50")
def top_thoughts(spark: SparkSession, d: str) -> DataFrame:
    """A-05."""
    return stats.top_thoughts(b.entities(spark, d)).select("entity_id", F.round("score", 6).alias("score"))


@query(with_(E_SQL) + "SELECT kern_id, count(*) AS n_entities, count(*) FILTER (status = 'active') AS n_active, count(*) FILTER (kind = 'fact') AS n_facts, round(avg(score), 6) AS mean_score FROM e GROUP BY kern_id")
def partition_summary(spark: SparkSession, d: str) -> DataFrame:
    """A-06."""
    return stats.partition_summary(b.entities(spark, d))


@query("""SELECT CASE WHEN content IS NULL OR content = '' THEN 'archived' WHEN octet_length(encode(content)) > 1048576 THEN 'failed' WHEN modified_at IS NULL THEN 'stuck' ELSE 'done' END AS status, count(*) AS n FROM ingest_records GROUP BY ALL""")
def intake_report(spark: SparkSession, d: str) -> DataFrame:
    """A-08, S-08."""
    return intake.report(table(spark, d, "ingest_records"))


@query("""SELECT record_id, CASE regexp_extract(lower(source_uri), '\\.([a-z0-9]+)$', 1) WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript'
  WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'log' THEN 'log' WHEN 'csv' THEN 'csv' WHEN 'html' THEN 'html' ELSE 'text' END AS language, count(*) AS n
  FROM ingest_records WHERE content IS NOT NULL AND content <> '' AND octet_length(encode(content)) <= 1048576 GROUP BY ALL""")
def watched_records(spark: SparkSession, d: str) -> DataFrame:
    """S-08: watched files as records with a language by extension."""
    return intake.watched(table(spark, d, "ingest_records")).groupBy("record_id", "language").agg(F.count("*").alias("n"))


@query("""SELECT source_uri, record_id, epoch_us(modified_at) AS modified_us FROM ingest_records WHERE source_uri IS NOT NULL AND modified_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source_uri ORDER BY modified_at DESC, record_id DESC) = 1""")
def debounced(spark: SparkSession, d: str) -> DataFrame:
    """S-07: the last event of each path, ignored paths apart (none here)."""
    return intake.debounced(table(spark, d, "ingest_records")).select("source_uri", "record_id", F.unix_micros("modified_at").alias("modified_us"))


@query(with_(E_SQL, """q AS (SELECT entity_id, kind, row_number() OVER (PARTITION BY kern_id ORDER BY score DESC, entity_id) AS p, kern_id FROM e)""") + """, t AS (SELECT kern_id, count(*) FILTER (kind = 'fact') AS gold,
    list(p) FILTER (kind = 'fact' AND p <= 40) AS ranks FROM q GROUP BY kern_id), g AS (SELECT gold, coalesce(ranks, []) AS ranks FROM t WHERE gold > 0)
  SELECT round(avg((len(list_filter(ranks, lambda r: r <= 1)) > 0)::INT), 6) AS recall_any_1, round(avg((len(list_filter(ranks, lambda r: r <= 1)) >= gold)::INT), 6) AS recall_all_1,
    round(avg((len(list_filter(ranks, lambda r: r <= 5)) > 0)::INT), 6) AS recall_any_5, round(avg((len(list_filter(ranks, lambda r: r <= 5)) >= gold)::INT), 6) AS recall_all_5,
    round(avg((len(list_filter(ranks, lambda r: r <= 10)) > 0)::INT), 6) AS recall_any_10, round(avg((len(list_filter(ranks, lambda r: r <= 10)) >= gold)::INT), 6) AS recall_all_10,
    round(avg(coalesce(1.0 / list_min(ranks), 0)), 6) AS mrr,
    round(avg(coalesce(list_sum(list_transform(list_filter(ranks, lambda r: r <= 10), lambda r: 1 / log2(r + 1.0))), 0) / list_sum(list_transform(range(1, (least(gold, 10) + 1)::INT), lambda r: 1 / log2(r + 1.0)))), 6) AS ndcg_10 FROM g""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A-09: how facts rank by score within their partitions."""
    from pyspark.sql import Window

    w = Window.partitionBy("kern_id").orderBy(F.desc("score"), "entity_id")
    q = b.entities(spark, d).select("kern_id", "kind", F.row_number().over(w).alias("p"))
    fact = F.col("kind") == "fact"
    g = q.groupBy("kern_id").agg(F.sum(fact.cast("int")).alias("gold_n"), F.collect_list(F.when(fact & (F.col("p") <= 40), F.col("p"))).alias("ranks"))  # at most 40 places
    return stats.eval_metrics(g)


_EVENTS = """v AS (SELECT entity_id, kind, epoch_us(created_at) AS us, 0 AS change_ord, 'created' AS change FROM e WHERE created_at IS NOT NULL
  UNION ALL SELECT entity_id, kind, epoch_us(invalidated_at), 1, 'superseded' FROM e WHERE status = 'superseded' AND invalidated_at IS NOT NULL)"""


@query(with_(E_SQL, _EVENTS) + "SELECT us, entity_id, change, kind FROM v WHERE us > epoch_us(TIMESTAMPTZ '2025-06-01 00:00:00+00') ORDER BY us, entity_id, change_ord LIMIT 100")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """S-09: a page of the feed after a cursor."""
    cursor = feed.cursor(1_748_736_000_000_000, chr(0x10FFFF), 1)
    return feed.page(b.entities(spark, d), cursor, 100).select("us", "entity_id", "change", "kind")


@query(with_(E_SQL, _EVENTS) + "SELECT change, kind, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM v GROUP BY ALL")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """S-09: the whole feed, summed up."""
    return feed.events(b.entities(spark, d)).groupBy("change", "kind").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
