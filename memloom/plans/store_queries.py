"""The store, its tiers and the vector index over whole tables (S, K, V), each read back and compared with its source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import vec
from memloom.operators import changefeed, crdt, index, retrieval, search, writes
from memloom.plans import base as b
from memloom.plans.base import E_SQL, G_SQL, R_SQL, cos_sql, usable_sql, with_
from memloom.plans.search_queries import asking
from memloom.session import shared_dir, table, written
from memloom.sources.store import StaleEpoch, Store, whole
from memloom.streaming import jobs

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query with its SQL."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return keep


def _store(spark: SparkSession) -> Store:
    """A store of its own in the shared folder, deleted when the driver ends."""
    root = f"{shared_dir(spark)}/memloom-store-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return Store(spark, root)


@query(with_(E_SQL) + "SELECT entity_id, kern_id, status, text, epoch_us(created_at) AS created_us FROM e")
def store_scan(spark: SparkSession, d: str) -> DataFrame:
    """S-01, K-01: entities written as a version laid out in buckets, and scanned."""
    s = _store(spark)
    s.commit({"entities": b.entities(spark, d)}, layout={"entities": ("entity_id", 16)})
    return s.read("entities").select("entity_id", "kern_id", "status", "text", F.unix_micros("created_at").alias("created_us"))


@query(with_(E_SQL) + "SELECT entity_id, kern_id FROM e WHERE kern_id = (SELECT min(kern_id) FROM e WHERE kern_id LIKE 'kern-%')")
def store_partition(spark: SparkSession, d: str) -> DataFrame:
    """S-02: one partition of a table laid out by it; one bucket is read."""
    s, e = _store(spark), b.entities(spark, d).select("entity_id", "kern_id", "text")
    s.commit({"entities": e}, layout={"entities": ("kern_id", 16)})
    first = s.read("entities").where("kern_id like 'kern-%'").agg(F.min("kern_id")).first()[0]
    return s.partition("entities", first).select("entity_id", "kern_id")


@query(with_(E_SQL) + """SELECT entity_id, CASE WHEN kind = 'question' THEN 'asked' ELSE review END AS review FROM e WHERE NOT (kind = 'conclusion' AND status = 'superseded')""")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K-06: some rows replaced by their id and some deleted, bucket by bucket."""
    s = _store(spark)
    s.commit({"entities": b.entities(spark, d).select("entity_id", "kind", "status", "review")}, layout={"entities": ("entity_id", 32)})
    e = s.read("entities")
    s.upsert("entities", e.where("kind = 'question'").withColumn("review", F.lit("asked")), "entity_id", e.where("kind = 'conclusion' and status = 'superseded'").select("entity_id"))
    return s.read("entities").select("entity_id", "review")


@query(with_(E_SQL) + "SELECT count(*) AS n, 2 AS tries, true AS other FROM e")
def store_retry(spark: SparkSession, d: str) -> DataFrame:
    """K-02, K-03, K-05: a flush that another commit overtakes starts anew on what stands then, and both stand."""
    s, e, tries = _store(spark), b.entities(spark, d).select("entity_id"), []

    def build(old: DataFrame | None) -> DataFrame:
        tries.append(1)
        if len(tries) == 1:
            s.replace("other", e.limit(1))
        return e

    s.flush("entities", build)
    try:
        s.replace("entities", e, expected=1)
        raise AssertionError("an old epoch was taken")
    except StaleEpoch:
        pass
    return s.read("entities").agg(F.count("*").alias("n")).withColumn("tries", F.lit(len(tries))).withColumn("other", F.lit(s.exists("other")))


@query(with_(E_SQL) + """, v AS (SELECT entity_id, vector, accessed_at, created_at, kind, kern_id, status, CASE WHEN heat <= 0 THEN 0 WHEN accessed_at IS NULL OR epoch_us(accessed_at) >= epoch_us(TIMESTAMPTZ '"""
       + b.NOW + """+00') THEN heat ELSE heat * pow(2, -(epoch_us(TIMESTAMPTZ '""" + b.NOW + """+00') - epoch_us(accessed_at)) / 1e6 / 604800) END AS h FROM e)
  SELECT entity_id, 'second' AS spill FROM v WHERE NOT (NOT starts_with(kern_id, 'remote-') AND status = 'active' AND kind IN ('fact', 'document')) AND h < 0.01
    AND (epoch_us(TIMESTAMPTZ '""" + b.NOW + """+00') - epoch_us(coalesce(accessed_at, created_at))) / 1e6 > 604800""")
def cold_tier(spark: SparkSession, d: str) -> DataFrame:
    """K-07, S-03: cold rows spilled twice, of which the later ones are read."""
    s = _store(spark)
    cold = retrieval.cold_victims(b.entities(spark, d), b.now()).select("entity_id", "vector")
    for i, name in enumerate(("first", "second")):
        s.spill(cold.withColumn("spill", F.lit(name)).withColumn("spilled_at", F.timestamp_seconds(F.lit(i))))
    return s.cold().select("entity_id", "spill")


@query(with_(R_SQL) + "SELECT reason_id, from_id, to_id, kind FROM r")
def store_compact(spark: SparkSession, d: str) -> DataFrame:
    """K-09: parts appended one by one, compacted and vacuumed."""
    s, r = _store(spark), b.reasons(spark, d)
    for i in range(3):
        s.append("reasons", r.where(F.pmod(F.xxhash64("reason_id"), F.lit(3)) == i))
    s.compact("reasons")
    s.vacuum()
    return s.read("reasons").select("reason_id", "from_id", "to_id", "kind")


@query(with_(E_SQL) + f"SELECT entity_id, CASE WHEN {usable_sql('vector')} THEN true END AS near FROM e")
def store_compress(spark: SparkSession, d: str) -> DataFrame:
    """K-10: int8 vectors in place of full ones, restored on reading within a cosine of 0.999."""
    s, e = _store(spark), b.entities(spark, d).select("entity_id", "vector")
    s.replace("entities", e.where((F.size("vector") == b.DIM) | F.col("vector").isNull() | (F.size("vector") != b.DIM)))
    s.compress("entities")
    full = e.select("entity_id", F.col("vector").alias("full"))
    near = F.when((F.size("full") == b.DIM) & F.col("vector").isNotNull(), vec.cosine(F.col("vector"), F.col("full")) > 0.999)
    return whole(s.read("entities")).join(full, "entity_id").select("entity_id", near.alias("near"))


@query(with_(E_SQL) + "SELECT entity_id, kern_id, status, CASE WHEN kind = 'claim' THEN 'theirs' ELSE text END AS text FROM e")
def stores_joined(spark: SparkSession, d: str) -> DataFrame:
    """S-11, C-05, X-02: a store registers another with conflicting copies; ours stay, but where only theirs are."""
    ours, theirs, e = _store(spark), _store(spark), written(b.entities(spark, d), "entities")
    ours.replace("entities", e.where("kind <> 'claim' or kind is null"))
    theirs.replace("entities", e.withColumn("text", F.lit("theirs")))
    ours.register(theirs, crdt.absorb)
    return ours.read("entities").select("entity_id", "kern_id", "status", "text")


@query("""WITH k AS (SELECT DISTINCT kern_id AS child, coalesce(parent_id, '') AS parent FROM kerns WHERE kern_id <> 'root') SELECT child, parent FROM k
  WHERE child <> (SELECT max(child) FROM k WHERE child NOT IN (SELECT parent FROM k))""")
def claim_kind_registry(spark: SparkSession, d: str) -> DataFrame:
    """W-17: a registry written, one leaf added and removed again, and the last leaf removed."""
    s = _store(spark)
    k = table(spark, d, "kerns").where("kern_id <> 'root'").select(F.col("kern_id").alias("child"), F.coalesce("parent_id", F.lit("")).alias("parent")).distinct()
    s.replace("claim_kinds", k)
    top = k.agg(F.min("child")).first()[0]
    s.flush("claim_kinds", lambda old: writes.add_claim_kind(old, "novel", [top]))
    s.flush("claim_kinds", lambda old: writes.remove_claim_kind(old, "novel"))
    last = k.join(k.select(F.col("parent").alias("child")), "child", "left_anti").agg(F.max("child")).first()[0]
    s.flush("claim_kinds", lambda old: writes.remove_claim_kind(old, last))
    return s.read("claim_kinds").select("child", "parent")


@query("""WITH c AS (SELECT object_id, target, lamport, producer, lower(trim(op, E' \\t\\n\\r\\x0b\\x0c')) AS o, lww_value FROM pending_deltas WHERE target IN (2, 3) AND lamport IS NOT NULL),
  e AS (SELECT * FROM c WHERE o = 'delete' OR (o IN ('insert', 'update') AND coalesce((target = 2 AND octet_length(lww_value) = 8) OR (target = 3 AND octet_length(lww_value) = 1 AND hex(lww_value) = '00')
    OR (target = 3 AND octet_length(lww_value) IN (7, 11) AND hex(lww_value)[1:2] = '01'), false))),
  r AS (SELECT *, row_number() OVER (PARTITION BY object_id, target ORDER BY lamport DESC, producer DESC NULLS LAST, (o = 'delete') DESC) AS rn FROM e)
  SELECT object_id, target, lamport, producer FROM r WHERE rn = 1 AND o <> 'delete'""")
def feed_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """S-05, C-07: the change feed replayed in four batches, late rows and repeats across them, and ended; state as in one piece."""
    s, feed = _store(spark), table(spark, d, "pending_deltas")
    for i in (1, 3, 0, 2):
        jobs.step(s, "feed", feed.where(F.pmod(F.xxhash64("arrival_seq", "lamport"), F.lit(4)) == i), f"b{i}")
    jobs.end_feed(s)
    return changefeed.deciding(s.read("feed_registers")).where("not is_delete").select("object_id", "target", "lamport", "producer")


def _recalled(found: DataFrame, right: DataFrame, k: int, least: float) -> DataFrame:
    """Per query how many of the k exact hits were found, as whether they are ``least`` of them."""
    both = right.select("query_id", "entity_id").join(found.select("query_id", "entity_id").withColumn("hit", F.lit(1)), ["query_id", "entity_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("n"), (F.sum(F.coalesce("hit", F.lit(0))) >= least * F.count("*")).alias("recalled"))


@query(with_(E_SQL, G_SQL) + "SELECT kern_id AS query_id, 10::BIGINT AS n, true AS recalled FROM g")
def index_topk(spark: SparkSession, d: str) -> DataFrame:
    """V-01, V-03, V-04, V-06: the ten best by the index, of which nine in ten at least must be the exact ones."""
    e, q = written(b.entities(spark, d).select("entity_id", "vector", "status"), "entities"), b.vector_queries(spark, d)
    rows = index.usable_rows(e, b.DIM)
    c = index.fit(rows)
    return _recalled(index.topk(written(index.postings(rows, c), "lists"), c, q, 10), search.vector_topk(e, q, 10), 10, 0.9)


@query(with_(E_SQL, G_SQL) + f""", s AS (SELECT g.kern_id AS query_id, entity_id, round({cos_sql('vector', 'graviton_vec')}, 6) AS cosine FROM e JOIN g ON true
    WHERE status <> 'superseded' AND kind = 'question' AND {usable_sql('vector')}), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, entity_id) AS rank FROM s)
  SELECT query_id, count(*) AS n FROM x WHERE rank <= 10 GROUP BY query_id""")
def index_filtered(spark: SparkSession, d: str) -> DataFrame:
    """V-02: a filter leaves few rows; the search widens until k are found or there are no more."""
    e, q = written(b.entities(spark, d).select("entity_id", "vector", "status", "kind"), "entities"), b.vector_queries(spark, d)
    rows = index.usable_rows(e, b.DIM)
    c = index.fit(rows)
    found = index.topk(written(index.postings(rows, c), "lists"), c, q, 10, e.where("kind = 'question'").select("entity_id"), probe=1)
    return found.groupBy("query_id").agg(F.count("*").alias("n"))


@query("SELECT true AS recalled")
def index_nearest_other(spark: SparkSession, d: str) -> DataFrame:
    """V-14, W-04: the nearest other of every asking entity by the index; 0.9 of them at least must be as near as the exact one."""
    e = written(b.entities(spark, d).select("entity_id", "vector", "status"), "entities")
    q = asking(e).where((F.size("vector") == b.DIM) & vec.usable(F.col("vector"))).select(F.col("entity_id").alias("query_id"), "vector")
    rows = index.usable_rows(e, b.DIM)
    c = index.fit(rows)
    near = index.nearest_other(q, written(index.postings(rows, c), "lists"), c, 1).select("query_id", F.col("cosine").alias("found"))
    exact = search.nearest_other(q, rows, b.DIM, 1).join(near, "query_id", "left")
    return exact.agg(F.coalesce(F.sum(F.coalesce((F.col("found") >= F.col("cosine")).cast("int"), F.lit(0))) >= 0.9 * F.count("*"), F.lit(True)).alias("recalled"))
