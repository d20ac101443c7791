"""Scalar functions (F-01 to F-37) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.functions import text as tx
from memloom.functions import vec
from memloom.operators import stats
from memloom.plans import base as b
from memloom.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query with its SQL."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return keep


@query("SELECT doc_id, sha256(text) AS entity_id FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """F-01, W-01: the content-addressed id of every document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", sc.content_hash(F.col("text")).alias("entity_id"))


@query("""SELECT DISTINCT job_id, CASE WHEN length(source.object_id) > 0 THEN sha256(concat(coalesce(source.scheme, ''), chr(0), source.object_id, chr(0),
  coalesce(source.section, ''))) END AS source_id, split_part(source.section, '#chunk', 1) AS section_key,
  concat(source.object_id, '#chunk', (job_id % 7)::VARCHAR) AS chunk_id, left(source.title, 12) AS short_title,
  CASE WHEN length(text) > 40 THEN concat(left(text, 40), '...') ELSE text END AS head
  FROM (SELECT job_id, source, text, CASE WHEN source.object_id IS NULL THEN NULL ELSE 1 END AS has FROM direct_jobs) WHERE has = 1""")
def source_ids(spark: SparkSession, d: str) -> DataFrame:
    """source ids, F-13, F-14, F-22."""
    j = table(spark, d, "direct_jobs").where("source.object_id is not null")
    return j.select(
        "job_id", sc.source_id(F.col("source")).alias("source_id"), tx.section_key(F.col("source.section")).alias("section_key"),
        sc.chunk_source_id(F.col("source.object_id"), F.col("job_id") % 7).alias("chunk_id"), tx.short_id(F.col("source.title")).alias("short_title"),
        tx.truncate(F.col("text"), 40).alias("head"),
    ).distinct()


@query(b.with_(b.R_SQL) + """SELECT reason_id, sha256(concat_ws(chr(0), coalesce(from_id, ''), coalesce(to_id, ''), kind::VARCHAR, coalesce(text, ''),
  coalesce(to_net_id, ''))) AS body_id FROM r""")
def reason_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content ids of edges."""
    r = b.reasons(spark, d)
    return r.select("reason_id", sc.reason_id(*[F.col(c) for c in ("from_id", "to_id", "kind", "text", "to_net_id")]).alias("body_id"))


@query("""SELECT DISTINCT job_id, round(c, 6) AS confidence, CASE WHEN c >= 1.0 THEN 'fact' ELSE 'claim' END AS kind,
  round(1 + c, 6) AS alpha, round(2 - c, 6) AS beta FROM (
  SELECT job_id, least(greatest(CASE WHEN confidence IS NULL OR confidence <= 0 THEN 0.5 ELSE confidence END, 0.01),
    CASE WHEN source_tag = 'user' THEN 1.0 ELSE 0.95 END)::DOUBLE AS c FROM direct_jobs)""")
def confidence_clamp(spark: SparkSession, d: str) -> DataFrame:
    """F-06 and the ingest prior."""
    c = sc.clamp_confidence(F.col("confidence"), F.col("source_tag"))
    j = table(spark, d, "direct_jobs").select("job_id", c.alias("c"))
    return j.select("job_id", F.round("c.confidence", 6).alias("confidence"), "c.kind", F.round(1 + F.col("c.confidence"), 6).alias("alpha"),
                    F.round(2 - F.col("c.confidence"), 6).alias("beta")).distinct()


@query(b.with_(b.E_SQL) + """SELECT entity_id, round(m, 6) AS mean, round(v, 6) AS variance, round(greatest(0, m - sqrt(v)), 6) AS lcb,
  round((x + least(greatest(s, 0), 1)) / (x + y + least(greatest(s, 0), 1)), 6) AS supported
  FROM (SELECT entity_id, conf_alpha AS x, conf_beta AS y, score AS s, conf_alpha / (conf_alpha + conf_beta) AS m,
    conf_alpha * conf_beta / ((conf_alpha + conf_beta) ** 2 * (conf_alpha + conf_beta + 1)) AS v FROM e WHERE conf_alpha + conf_beta > 0)""")
def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Confidence mean, variance, lower bound, and X-07 observation of support."""
    e = b.entities(spark, d).where("conf_alpha + conf_beta > 0")
    x, y = F.col("conf_alpha").cast("double"), F.col("conf_beta").cast("double")
    o = sc.observe(x, y, F.col("score"), F.lit(True))
    return e.select("entity_id", F.round(sc.conf_mean(x, y), 6).alias("mean"), F.round(sc.conf_variance(x, y), 6).alias("variance"),
                    F.round(sc.conf_lcb(x, y), 6).alias("lcb"), F.round(sc.conf_mean(o["alpha"], o["beta"]), 6).alias("supported"))


_VEC = f"v AS (SELECT entity_id, vector::DOUBLE[] AS x, gnn_vector::DOUBLE[] AS y FROM e WHERE {b.usable_sql('vector')} AND {b.usable_sql('gnn_vector')})"


@query(b.with_(b.E_SQL, _VEC) + """SELECT entity_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(1 - list_cosine_similarity(x, y), 6) AS distance,
  round(least(greatest((list_cosine_similarity(x, y) + 1) / 2, 0), 1), 6) AS align,
  round(list_sum(list_transform(list_zip(x, y), lambda p: ((p[1] + p[2]) / 2)::FLOAT::DOUBLE)), 5) AS middle,
  round(list_sum(list_transform(x, lambda p: p / sqrt(list_dot_product(x, x)))), 6) AS unit_sum FROM v""")
def vector_scalars(spark: SparkSession, d: str) -> DataFrame:
    """F-02, F-03, F-04, F-32 between content and structure vectors."""
    e = b.entities(spark, d).where((F.size("vector") == b.DIM) & vec.usable(F.col("vector")) & (F.size("gnn_vector") == b.DIM) & vec.usable(F.col("gnn_vector")))
    x, y = F.col("vector"), F.col("gnn_vector")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return e.select(
        "entity_id", F.round(vec.cosine(x, y), 6).alias("cosine"), F.round(vec.cosine_distance(x, y), 6).alias("distance"),
        F.round(vec.cosine_align(x, y), 6).alias("align"), F.round(total(vec.average_vec(x, y)), 5).alias("middle"),
        F.round(total(vec.l2_normalize(x)), 6).alias("unit_sum"),
    )


@query(b.with_(b.E_SQL, _VEC) + """, s AS (SELECT entity_id, x, y, list_max(list_transform(x, lambda p: abs(p))) / 127.0 AS sx,
    list_max(list_transform(y, lambda p: abs(p))) / 127.0 AS sy FROM v),
  q AS (SELECT entity_id, sx, list_transform(x, lambda p: round(p / sx)::DOUBLE) AS qx, list_transform(y, lambda p: round(p / sy)::DOUBLE) AS qy FROM s)
  SELECT entity_id, round(sx, 8) AS scale, list_sum(qx)::BIGINT AS q_sum, list_sum(list_transform(qx, lambda p: abs(p)))::BIGINT AS q_mass,
    round(1 - list_cosine_similarity(qx, qy), 6) AS int8_distance FROM q""")
def int8_codes(spark: SparkSession, d: str) -> DataFrame:
    """F-08, F-10: int8 codes of content vectors and their distance to the structure vectors' codes."""
    e = b.entities(spark, d).where((F.size("vector") == b.DIM) & vec.usable(F.col("vector")) & (F.size("gnn_vector") == b.DIM) & vec.usable(F.col("gnn_vector")))
    e = e.select("entity_id", vec.quantize_int8(F.col("vector")).alias("a"), vec.quantize_int8(F.col("gnn_vector")).alias("g"))
    total = lambda f: F.aggregate("a.q", F.lit(0).cast("long"), lambda s, v: s + f(v.cast("long")))
    return e.select("entity_id", F.round("a.scale", 8).alias("scale"), total(lambda v: v).alias("q_sum"), total(F.abs).alias("q_mass"),
                    F.round(vec.int8_cosine_distance(F.col("a"), F.col("g")), 6).alias("int8_distance"))


@query(b.with_(b.E_SQL, _VEC) + """SELECT entity_id, h AS hamming, round(1 - cos(pi() * h / 64), 6) AS distance FROM (
  SELECT entity_id, list_sum(list_transform(list_zip(x, y), lambda p: CASE WHEN (p[1] >= 0) <> (p[2] >= 0) THEN 1 ELSE 0 END))::BIGINT AS h FROM v)""")
def binary_codes(spark: SparkSession, d: str) -> DataFrame:
    """F-09: binary codes and their Hamming distance."""
    e = b.entities(spark, d).where((F.size("vector") == b.DIM) & vec.usable(F.col("vector")) & (F.size("gnn_vector") == b.DIM) & vec.usable(F.col("gnn_vector")))
    e = e.select("entity_id", vec.binary_code(F.col("vector")).alias("p"), vec.binary_code(F.col("gnn_vector")).alias("q"))
    h = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return e.select("entity_id", h.alias("hamming"), F.round(vec.hamming_cosine_distance(F.col("p"), F.col("q"), F.lit(b.DIM)), 6).alias("distance"))


@query(b.with_(b.E_SQL) + f", t AS (SELECT kern_id, unnest({b.TERMS_SQL.format(t='text')}) AS w FROM e WHERE text IS NOT NULL) "
       f"SELECT kern_id, {b.STEM_SQL.format(t='w')} AS term, count(*) AS n FROM t GROUP BY ALL")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """F-11: stemmed term counts of each partition."""
    e = b.entities(spark, d).where("text is not null")
    return e.select("kern_id", F.explode(tx.stems(F.col("text"))).alias("term")).groupBy("kern_id", "term").agg(F.count("*").alias("n"))


@query(b.with_(b.E_SQL, b.R_SQL) + """, p AS (SELECT from_id, string_agg(text, ' ' ORDER BY text) AS t FROM r WHERE kind = 6 AND length(text) > 0 GROUP BY from_id)
  SELECT entity_id, concat_ws(' ', CASE WHEN length(text) > 0 THEN text END, t) AS document FROM e LEFT JOIN p ON from_id = entity_id""")
def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """F-12: the lexical document of every entity: its text and its outgoing rephrases, in text order."""
    r = b.reasons(spark, d).where((F.col("kind") == sc.Fixed.REPHRASE_KIND) & (F.length("text") > 0))
    p = r.groupBy(F.col("from_id").alias("entity_id")).agg(F.array_sort(F.collect_list("text")).alias("t"))
    e = b.entities(spark, d).join(p, "entity_id", "left")
    return e.select("entity_id", tx.entity_document(F.array(F.coalesce("text", F.lit(""))), F.col("t")).alias("document"))


_WS = r"[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim_sql(t: str) -> str:
    """SQL: ``t`` without surrounding white space."""
    return f"regexp_replace({t}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"""SELECT record_id, len(p)::INT AS n_paragraphs, coalesce(list_sum(list_transform(p, lambda x: length(x)))::BIGINT, 0) AS n_chars,
  len(t)::INT AS n_turns, sha256(array_to_string(t, '|')) AS turn_hash FROM (
  SELECT DISTINCT record_id, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda x: {trim_sql('x')}), lambda x: length(x) > 0) AS p,
    list_filter(list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: {trim_sql('x')}),
      lambda x: length(x) > 0) AS t FROM ingest_records WHERE length({trim_sql('content')}) > 0)""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    """F-15, F-17: paragraphs and turns of every record."""
    r = table(spark, d, "ingest_records").where(F.length(tx.strip(F.col("content"))) > 0)
    r = r.select("record_id", tx.paragraphs(F.col("content")).alias("p"), tx.turns(F.col("content")).alias("t")).distinct()
    chars = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return r.select("record_id", F.size("p").alias("n_paragraphs"), chars.alias("n_chars"), F.size("t").alias("n_turns"),
                    F.sha2(F.array_join("t", "|"), 256).alias("turn_hash"))


@query(f"""SELECT DISTINCT job_id, {trim_sql('text')} AS text, kind, 2 AS n_turns, true AS has_array, 'CONTRADICT' = 'CONTRADICT' AS replaces
  FROM direct_jobs WHERE length({trim_sql('text')}) > 0""")
def claim_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """F-19, F-20, F-21: claims written as a model would - prose around a JSON array - and parsed back."""
    j = table(spark, d, "direct_jobs").where(F.length(tx.strip(F.col("text"))) > 0).select("job_id", "text", "kind").distinct()
    claim = F.struct("text", F.upper("kind").alias("kind"), F.lit("2026-01-02T03:04:05Z").alias("valid_from"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("turns"))
    reply = F.concat(F.lit("Here they are: "), F.to_json(F.array(claim)), F.lit(" done."))
    c = j.select("job_id", tx.parse_claims(reply).alias("c"))
    return c.select("job_id", F.col("c")[0]["text"].alias("text"), F.col("c")[0]["kind"].alias("kind"), F.size(F.col("c")[0]["turns"]).alias("n_turns"),
                    F.col("c").isNotNull().alias("has_array"), tx.parse_contradiction(F.lit("verdict: Contradict")).alias("replaces"))


@query("""SELECT DISTINCT job_id, date_trunc('second', received_at)::TIMESTAMP AS parsed, strftime(received_at::TIMESTAMP, '%Y-%m-%d') AS day FROM direct_jobs""")
def time_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """F-21: times written with fraction and zone, parsed back."""
    j = table(spark, d, "direct_jobs").select("job_id", "received_at").distinct()
    text = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return j.select("job_id", tx.parse_time(text).cast("timestamp_ntz").alias("parsed"), tx.date_string(F.col("received_at")).alias("day")).distinct()


@query(b.with_(b.E_SQL, b.G_SQL) + f""", x AS (SELECT entity_id, g.kern_id, 1 - {b.cos_sql('vector', 'graviton_vec')} AS dist, inner_radius AS i, outer_radius AS o, mass
    FROM e JOIN g ON true WHERE {b.usable_sql('vector')})
  SELECT kern_id, count(*) AS n, count(*) FILTER (dist <= i) AS inside, round(sum(CASE WHEN dist <= i THEN 1.0 WHEN dist >= o THEN 0.0
    ELSE 1 / (1 + exp(8 * ((dist - i) / (o - i) - 0.5))) END), 4) AS expected, round(min(dist / greatest(mass, 1e-6)), 6) AS nearest FROM x GROUP BY kern_id""")
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """F-23, F-24: how many entities each attractor would accept."""
    rows = b.attractors(spark, d)
    radii = spark.createDataFrame([(r.kern_id, r.inner_radius, r.outer_radius, r.mass) for r in rows], "query_id string, i double, o double, mass double")
    x = vec.score_against(b.entities(spark, d), [(r.kern_id, list(r.graviton_vec)) for r in rows]).join(F.broadcast(radii), "query_id")
    x = x.withColumn("dist", 1.0 - F.col("cosine"))
    return x.groupBy(F.col("query_id").alias("kern_id")).agg(
        F.count("*").alias("n"), F.sum((F.col("dist") <= F.col("i")).cast("long")).alias("inside"),
        F.round(F.sum(sc.acceptance_probability(F.col("dist"), F.col("i"), F.col("o"))), 4).alias("expected"),
        F.round(F.min(sc.effective_distance(F.col("dist"), F.col("mass"))), 6).alias("nearest"),
    )


_AGE = f"(epoch_us(TIMESTAMPTZ '{b.NOW}+00') - epoch_us(accessed_at)) / 1e6"


@query(b.with_(b.E_SQL, b.A_SQL) + f"""SELECT e.entity_id, round(least(0.1, ln(coalesce(access_count, 0) + 1.0) * 0.02 + CASE WHEN accessed_at IS NULL THEN 0
  ELSE 0.05 * exp(-greatest({_AGE}, 0) / 86400.0) END), 6) AS bonus,
  round(CASE WHEN heat <= 0 THEN 0 WHEN accessed_at IS NULL OR {_AGE} <= 0 THEN heat ELSE heat * pow(2.0, -({_AGE}) / 2592000.0) END, 6) AS heat_now
  FROM e LEFT JOIN a ON a.entity_id = e.entity_id""")
def use_bonus(spark: SparkSession, d: str) -> DataFrame:
    """F-25, F-26: use bonus and decayed heat at a fixed time."""
    e = b.entities(spark, d).join(b.accesses(spark, d), "entity_id", "left")
    age = sc.seconds(b.now()) - sc.seconds(F.col("accessed_at"))
    return e.select("entity_id", F.round(sc.qbst(F.col("access_count"), age), 6).alias("bonus"),
                    F.round(sc.decayed(F.col("heat"), F.col("accessed_at"), b.now(), F.lit(b.HALF_LIFE_S)), 6).alias("heat_now"))


@query(f"""SELECT DISTINCT job_id, epoch_us(least(valid_until, CASE WHEN job_id % 3 > 0 THEN TIMESTAMPTZ '{b.NOW}+00' + to_seconds((job_id % 3) * 3600) END)) AS until_us,
  CASE source.scheme WHEN 'agent' THEN 'pending' WHEN 'ticket' THEN 'pending' ELSE 'active' END AS review,
  CASE kind WHEN 'fact' THEN 0.99 WHEN 'question' THEN 0.9 ELSE 0.98 END::DOUBLE AS threshold FROM direct_jobs""")
def ingest_policy(spark: SparkSession, d: str) -> DataFrame:
    """F-27 to F-30: deadlines tightened by retention, review states and dedup thresholds by policy."""
    j = table(spark, d, "direct_jobs")
    until = sc.resolve_valid_until(F.col("valid_until"), sc.valid_until_from_retention(b.now(), (F.col("job_id") % 3) * 3600))
    return j.select("job_id", F.unix_micros(until).alias("until_us"), sc.review_for({"agent": "pending", "ticket": "pending"}, F.col("source.scheme")).alias("review"),
                    sc.dedup_threshold_for(F.col("kind"), {"fact": 0.99, "question": 0.9}, 0.98).alias("threshold")).distinct()


@query(b.with_(b.E_SQL, b.R_SQL) + f""", c AS (SELECT reason_id, r.score, {b.cos_sql('x.vector', 'y.vector')} AS cosine FROM r
    JOIN e x ON x.entity_id = from_id JOIN e y ON y.entity_id = to_id WHERE {b.usable_sql('x.vector')} AND {b.usable_sql('y.vector')})
  SELECT reason_id, round(0.3 * cosine + 0.2 * least(1, least(greatest(score, 0), 1) + least(0.1, ln(4.0) * 0.01)), 6) AS evidence FROM c""")
def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """F-31 with the cosine of the ends in the query's place and three traversals."""
    e = b.entities(spark, d).where((F.size("vector") == b.DIM) & vec.usable(F.col("vector"))).select("entity_id", "vector")
    r = b.reasons(spark, d).join(e.select(F.col("entity_id").alias("from_id"), F.col("vector").alias("x")), "from_id").join(
        e.select(F.col("entity_id").alias("to_id"), F.col("vector").alias("y")), "to_id")
    return r.select("reason_id", F.round(sc.edge_evidence(vec.cosine(F.col("x"), F.col("y")), F.col("score"), F.lit(3), 0.3, 0.2), 6).alias("evidence"))


@query(b.with_(b.E_SQL) + """, l AS (SELECT entity_id, coalesce(sha256(text) = entity_id, false) AS matches,
    (('0x' || array_to_string(list_transform(range(8), lambda i: substr(entity_id, (15 - 2 * i)::INT, 2)), ''))::UBIGINT >> 11)::DOUBLE / 9007199254740992.0 AS loc FROM e)
  SELECT entity_id, matches, round(loc, 9) AS loc, round(least(abs(loc - 0.25), 1 - abs(loc - 0.25)), 9) AS distance FROM l""")
def ring_places(spark: SparkSession, d: str) -> DataFrame:
    """F-34, F-35: whether ids match bodies, and places on the ring."""
    e = b.entities(spark, d)
    loc = sc.loc_of(F.col("entity_id"))
    return e.select("entity_id", sc.id_matches_body(F.col("entity_id"), F.col("text")).alias("matches"), F.round(loc, 9).alias("loc"),
                    F.round(sc.ring_distance(loc, F.lit(0.25)), 9).alias("distance"))


@query("""WITH h AS (SELECT n_chars AS x, row_number() OVER (ORDER BY n_chars) AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL),
  s AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS share) SELECT share, x AS value FROM h JOIN s ON i = greatest(ceil(share * n), 1)""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """F-36: nearest-rank percentiles of document lengths."""
    return stats.nearest_rank(table(spark, d, "documents"), "n_chars", [0.5, 0.9, 0.95, 0.99])


@query(r"""SELECT DISTINCT record_id, n AS answer, name FROM (SELECT record_id, 'note ' || record_id::VARCHAR AS n, 'Topic ' || record_id::VARCHAR AS name FROM ingest_records)""")
def reply_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """F-37: model replies without thinking and labels."""
    r = table(spark, d, "ingest_records").select("record_id").distinct()
    i = F.col("record_id").cast("string")
    reply = F.concat(F.lit("<think>a\nb</think> \n note "), i, F.lit("  <think>open"))
    return r.select("record_id", tx.strip_think(reply).alias("answer"), tx.strip_name_prefixes(F.concat(F.lit('- Name: "Topic '), i, F.lit('"'))).alias("name"))


@query("""SELECT record_id, CASE WHEN n >= 2 THEN n ELSE ceil(length(w) / 4000.0)::BIGINT END AS n_examples FROM (
  SELECT DISTINCT record_id, """ + trim_sql("content") + """ AS w,
    len(list_filter(list_transform(regexp_split_to_array(content, '\\r?\\n'), lambda x: """ + trim_sql("x") + """), lambda x: length(x) > 0)) AS n
  FROM ingest_records WHERE content IS NOT NULL)""")
def seed_examples(spark: SparkSession, d: str) -> DataFrame:
    """F-16, F-18: examples an attractor would be seeded with."""
    r = table(spark, d, "ingest_records").where("content is not null").select("record_id", "content").distinct()
    return r.select("record_id", F.size(tx.seed_examples(F.col("content"))).cast("long").alias("n_examples"))
