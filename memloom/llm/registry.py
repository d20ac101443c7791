"""All queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm import junkpages, neardup, packing, splitting, tokens, vectors
from memloom.session import small, table, written


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The texts of both intake tables as (origin, item_id, text), arrivals of one item collapsed later."""
    jobs = table(spark, d, "direct_jobs").select(F.lit("direct_job").alias("origin"), F.col("job_id").alias("item_id"), "text")
    recs = table(spark, d, "ingest_records").select(
        F.lit("ingest_record").alias("origin"), F.col("record_id").alias("item_id"), F.col("content").alias("text")
    )
    return jobs.unionByName(recs)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized item; repeated arrivals of one text collapse, other texts under its id stay apart."""
    return splitting.split_oversized(_items(spark, d), table(spark, d, "size_limits")).dropDuplicates()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized text: its length, whether its pieces' own parts are the text, all pieces fit and neighbours share the overlap."""
    items = _items(spark, d).where("text is not null").select("origin", "item_id", "text", F.xxhash64("text").alias("h")).dropDuplicates(["origin", "item_id", "h"])
    pieces = splitting.split_oversized(items.withColumn("item_id", F.xxhash64("item_id", "h")), table(spark, d, "size_limits"))
    step = Window.partitionBy("origin", "item_id").orderBy("seq")
    limits = small(table(spark, d, "size_limits"))
    at = pieces.join(limits, "origin").withColumn("before", F.lag("end").over(step)).withColumn("tail", F.lag("piece").over(step))
    fine = (F.char_length("piece") <= F.col("max_chars")) & (F.col("before").isNull() | (
        (F.col("before") - F.col("start") == F.col("overlap_chars")) & F.expr("substring(piece, 1, overlap_chars) = right(tail, overlap_chars)")))
    # pieces of one text are bounded by its length
    per = at.groupBy("origin", "item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.expr("substring(piece, own_start - start + 1)").alias("own")))), lambda x: x["own"]), "").alias("joined"),
        F.min(fine.cast("int")).alias("fits"))
    return items.select("origin", "item_id", F.xxhash64("item_id", "h").alias("k"), "text").join(per.withColumnRenamed("item_id", "k"), ["origin", "k"]).select(
        "origin", "item_id", F.char_length("text").alias("n_chars"), (F.col("joined") == F.col("text")).alias("whole"), (F.col("fits") == 1).alias("fits"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_items(spark, d), table(spark, d, "size_limits")).where("seq = 0").select(
        "origin", "item_id"
    ).distinct()


#: Problem 3: three-word shingles, a similarity of 0.6, texts of 40 words or more.
P3 = {"threshold": 0.6, "width": 3, "min_words": 40}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = neardup.near_duplicates(_items(spark, d), **P3)
    return neardup.expanded_pairs(links, members)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per text that takes part: its class of equal sets, its number of linked classes, its group."""
    links, members = neardup.near_duplicates(_items(spark, d), **P3)
    links = written(links, "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    groups = neardup.components(links).withColumnRenamed("id", "class_id")
    return members.join(degree, "class_id", "left").join(groups, "class_id", "left").select(
        "item_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("group_id", "class_id").alias("group_id"),
    )


#: Problem 5: five neighbours, 64 numbers, pairs of cosine 0.9 or more.
P5_K, P5_DIM, P5_COSINE = 5, 64, 0.9
#: Lists a whole-range search probes.
SEARCH_LISTS = 32


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of active entities in both spaces as (space, id, v)."""
    active = table(spark, d, "entities").where("status = 'active'")
    return active.select("entity_id", F.explode(F.array(
        F.struct(F.lit("vector").alias("space"), F.col("vector").alias("v")),
        F.struct(F.lit("gnn_vector").alias("space"), F.col("gnn_vector").alias("v")),
    )).alias("x")).select("x.space", F.col("entity_id").alias("id"), "x.v")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest_entities(_vectors(spark, d), P5_DIM, P5_K, P5_COSINE)
    return near.select(
        "space", F.least("id", "other").alias("entity_a"), F.greatest("id", "other").alias("entity_b")
    ).distinct()


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every entity whose id, read as a number, is divisible by 100, against all, whatever the cosine:
    background neighbours are spread, so these queries probe many lists."""
    asks = F.pmod(F.conv(F.substring("id", 50, 15), 16, 10).cast("long"), F.lit(100)) == 0
    near = vectors.nearest_entities(_vectors(spark, d), P5_DIM, P5_K, asking_ids=asks, probe=SEARCH_LISTS, probe_ratio=2.0)
    return near.select("space", "id", "other", F.round("s", 4).alias("cosine"), "rank")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in every kind of container."""
    docs = table(spark, d, "documents")
    # containers is fixed and small; its tokenizers are read to know which encodings are needed
    boxes = table(spark, d, "containers")
    names = [r[0] for r in boxes.select("tokenizer").where("tokenizer is not null").distinct().orderBy("tokenizer").limit(packing.MAX_CONTAINERS + 1).collect()]
    if len(names) > packing.MAX_CONTAINERS:
        raise ValueError(f"more than {packing.MAX_CONTAINERS} tokenizers")
    n = docs.count()
    out = None
    for name in names:
        sizes = tokens.count_tokens(docs, name).withColumnRenamed("doc_id", "item_id")
        part = packing.pack(sizes, boxes.where(F.col("tokenizer") == name), n)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("item_id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of container: pieces, documents, tokens, and whether every piece fits and every document is there whole."""
    placed = p7_packing(spark, d)
    bins = placed.groupBy("container", "grp", "bin").agg(F.sum("n_tokens").alias("held"))
    boxes = table(spark, d, "containers").select("container", "capacity_tokens")
    over = bins.join(F.broadcast(boxes), "container").groupBy("container").agg(  # a fixed table, refused above 64 rows
        F.sum((F.col("held") > F.col("capacity_tokens")).cast("long")).alias("n_over"))
    per = placed.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    docs = per.groupBy("container").agg(F.count("*").alias("n_docs"), F.sum("pieces").alias("n_pieces"))
    whole = per.join(F.broadcast(boxes), "container").groupBy("container").agg(
        F.sum((F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens")))).cast("long")).alias("n_torn"))
    return docs.join(over, "container").join(whole, "container").select("container", "n_docs", "n_over", "n_torn")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return junkpages.junk_pages(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Junk pages by language, and how reviews agree."""
    docs = table(spark, d, "documents")
    shares = junkpages.junk_shares(docs, keep="lang").withColumn("junk", F.col("junk_share") > junkpages.SHARE)
    said = table(spark, d, "page_reviews").where("verdict in ('spam', 'ok')").groupBy("doc_id").agg(
        F.sum(F.when(F.col("verdict") == "spam", 1).otherwise(-1)).alias("votes")
    )
    return shares.join(said, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("junk").cast("int")).alias("n_junk"),
        F.sum(F.when(F.col("votes") != 0, 1).otherwise(0)).alias("n_reviewed"),
        F.sum(F.when((F.col("votes") > 0) == F.col("junk"), 1).otherwise(0)).alias("n_agreed"),
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_report, p3_found, p3_groups, p5_found, p5_search, p6_ids, p7_packing, p7_report, p8_found, p8_report)}

#: Brute force over all pairs; active entities with a usable vector, the five of greatest cosine, at least 0.9.
_P5_SPACE = """
    SELECT '{c}' AS space, a.entity_id AS x, b.entity_id AS y
    FROM {c}_e a JOIN {c}_e b ON a.entity_id <> b.entity_id AND list_cosine_similarity(a.v, b.v) >= 0.9
    QUALIFY row_number() OVER (PARTITION BY a.entity_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.entity_id) <= 5"""
_P5_ROWS = """{c}_e AS MATERIALIZED (
    SELECT entity_id, any_value({c}) AS v FROM entities
    WHERE status = 'active' AND entity_id IS NOT NULL AND {c} IS NOT NULL AND len({c}) = 64
      AND len(list_filter({c}, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter({c}, lambda x: x <> 0)) > 0
    GROUP BY entity_id)"""

#: All pairs by an inverted list of shingles.
_P3 = """
    WITH t AS (SELECT job_id AS id, text FROM direct_jobs WHERE text IS NOT NULL UNION SELECT record_id, content FROM ingest_records WHERE content IS NOT NULL),
    w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
    s AS MATERIALIZED (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 40)),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
    SELECT id_a, id_b FROM p JOIN n u ON u.id = id_a JOIN n v ON v.id = id_b WHERE k >= 0.6 * (u.n + v.n - k) - 1e-9"""

#: Classes of equal sets, their links, and groups as the least id that can be reached.
_P3_GROUPS = """
    WITH RECURSIVE t AS (SELECT job_id AS id, text FROM direct_jobs WHERE text IS NOT NULL UNION SELECT record_id, content FROM ingest_records WHERE content IS NOT NULL),
    w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
    s0 AS MATERIALIZED (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 40)),
    m AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY k) AS class_id FROM (SELECT id, string_agg(x, '|' ORDER BY x) AS k FROM s0 GROUP BY id)),
    s AS MATERIALIZED (SELECT id, x FROM s0 WHERE id IN (SELECT class_id FROM m)),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
    l AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM p JOIN n u ON u.id = id_a JOIN n v ON v.id = id_b WHERE k >= 0.6 * (u.n + v.n - k) - 1e-9),
    e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
    g AS (SELECT x, min(y) AS group_id FROM r GROUP BY x),
    d AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
    SELECT m.id AS item_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(group_id, class_id) AS group_id
    FROM m LEFT JOIN d ON d.a = class_id LEFT JOIN g ON g.x = class_id"""

ORACLE = {
    "p3_found": _P3,
    "p1_report": """
        WITH i AS (SELECT 'direct_job' AS origin, job_id AS item_id, text FROM direct_jobs UNION SELECT 'ingest_record', record_id, content FROM ingest_records)
        SELECT i.origin, item_id, length(text)::INT AS n_chars, true AS whole, true AS fits FROM i JOIN size_limits l ON i.origin = l.origin WHERE length(text) > max_chars""",
    "p7_report": "SELECT container, (SELECT count(*) FROM documents) AS n_docs, 0::BIGINT AS n_over, 0::BIGINT AS n_torn FROM containers",
    "p3_groups": _P3_GROUPS,
    "p5_found": "WITH " + ", ".join(_P5_ROWS.format(c=c) for c in ("vector", "gnn_vector"))
    + " SELECT DISTINCT space, least(x, y) AS entity_a, greatest(x, y) AS entity_b FROM ("
    + " UNION ALL ".join("(" + _P5_SPACE.format(c=c) + ")" for c in ("vector", "gnn_vector")) + ")",
    "p1_found": """
        WITH i AS (SELECT 'direct_job' AS origin, job_id AS item_id, text FROM direct_jobs
                   UNION ALL SELECT 'ingest_record', record_id, content FROM ingest_records)
        SELECT DISTINCT i.origin, item_id FROM i JOIN size_limits l ON i.origin = l.origin WHERE length(text) > max_chars""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
