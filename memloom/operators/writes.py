"""The write path as table-to-table plans: ingest, dedup, routing, edges, supersede, forget, degrade, move (W-01 to W-19)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.functions import text as tx
from memloom.functions import vec
from memloom.operators import filters, search
from memloom.sources import embedding

TURN_BATCH = 48


def chunked(jobs: DataFrame) -> DataFrame:
    """W-01: (job_id, entity_id, document_id, index, text, kind): the document of each job and its paragraph chunks.

    A text of one paragraph gives one row: the chunk is the document. Empty and null texts give none; repeated arrivals
    of a job count once, at the last arrival's metadata.
    """
    j = jobs.where(F.length(tx.strip(F.coalesce("text", F.lit("")))) > 0)
    last = j.groupBy("job_id").agg(F.max_by(F.struct("text", "kind"), "received_at").alias("j")).select("job_id", "j.*")
    doc = last.withColumn("document_id", sc.content_hash(F.col("text")))
    parts = doc.select("job_id", "document_id", "kind", F.posexplode(tx.paragraphs(F.col("text"))).alias("index", "part"))
    chunks = parts.select("job_id", sc.content_hash(F.col("part")).alias("entity_id"), "document_id", F.col("index").cast("int").alias("index"), F.col("part").alias("text"), "kind")
    chunks = chunks.where("entity_id <> document_id")
    whole = doc.select("job_id", F.col("document_id").alias("entity_id"), "document_id", F.lit(-1).alias("index"), "text",
                       F.when(F.col("kind") == "fact", "fact").otherwise("document").alias("kind"))
    return whole.unionByName(chunks)


def provenance_edges(chunks: DataFrame) -> DataFrame:
    """W-05: chunk to document, score 0.85."""
    e = chunks.where("index >= 0").select(F.col("entity_id").alias("from_id"), F.col("document_id").alias("to_id")).distinct()
    return e.select(sc.reason_id(F.col("from_id"), F.col("to_id"), F.lit(sc.Fixed.PROVENANCE_KIND), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("reason_id"),
                    "from_id", "to_id", F.lit(sc.Fixed.PROVENANCE_KIND).alias("kind"), F.lit(sc.Fixed.PROVENANCE).alias("score"))


def merge_duplicates(store: DataFrame, incoming: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W-02: (updated store rows, rows to insert, rephrase edges).

    ``matches(query_id, entity_id)`` says which incoming row duplicates which stored one. The survivor gains the mean
    confidence of each duplicate as support and the earliest deadline; its text and vector stay. A different text
    becomes a rephrase edge without a target.
    """
    m = matches.select(F.col("query_id").alias("in_id"), F.col("entity_id").alias("survivor"))
    dup = incoming.join(m, incoming["entity_id"] == m["in_id"])
    gain = dup.groupBy("survivor").agg(
        F.sum(sc.conf_mean(F.col("conf_alpha"), F.col("conf_beta"))).alias("support"), F.min("valid_until").alias("ttl"), F.count("*").alias("n_merged"))
    updated = store.join(gain, store["entity_id"] == gain["survivor"]).select(
        "entity_id", (F.col("conf_alpha") + F.col("support")).alias("conf_alpha"), F.col("conf_beta").cast("double").alias("conf_beta"),
        sc.resolve_valid_until(F.col("valid_until"), F.col("ttl")).alias("valid_until"), "n_merged")
    fresh = incoming.join(m.select(F.col("in_id").alias("entity_id")), "entity_id", "left_anti")
    texts = store.select(F.col("entity_id").alias("survivor"), F.col("text").alias("kept"))
    re = dup.join(texts, "survivor").where(~F.col("text").eqNullSafe(F.col("kept")) & F.col("text").isNotNull())
    re = re.select(sc.reason_id(F.col("survivor"), F.lit(""), F.lit(sc.Fixed.REPHRASE_KIND), F.col("text"), F.lit("")).alias("reason_id"),
                   F.col("survivor").alias("from_id"), F.lit("").alias("to_id"), F.lit(sc.Fixed.REPHRASE_KIND).alias("kind"), "text", F.lit(sc.Fixed.REPHRASE).alias("score")).distinct()
    return updated, fresh, re


def route(rows: DataFrame, attractors: list, depth_of: dict[str, list] | None = None) -> DataFrame:
    """W-03: (entity_id, kern_id): the attractor that accepts each row best, by probability and then smaller effective
    distance, of at least one half; ``generic`` if none does.

    Attractors are a bounded list. ``depth_of`` maps an attractor to its own children for the next levels of descent;
    a row that no child accepts stays where it is.
    """
    def level(rows: DataFrame, options: list, otherwise: Column) -> DataFrame:
        spec = rows.sparkSession.createDataFrame([(a.kern_id, a.inner_radius, a.outer_radius, a.mass) for a in options],
                                                 "query_id string, i double, o double, mass double")
        x = vec.score_against(rows, [(a.kern_id, list(a.graviton_vec)) for a in options]).join(F.broadcast(spec), "query_id")
        x = x.withColumn("dist", 1.0 - F.col("cosine"))
        x = x.withColumn("p", F.round(sc.acceptance_probability(F.col("dist"), F.col("i"), F.col("o")), 9))
        x = x.where(F.col("p") >= sc.Fixed.ACCEPT_MIN)
        best = x.groupBy("entity_id").agg(F.min(F.struct((-F.col("p")).alias("np"), F.round(sc.effective_distance(F.col("dist"), F.col("mass")), 9).alias("ed"), "query_id")).alias("b"))
        return rows.join(best, "entity_id", "left").withColumn("kern_id", F.coalesce("b.query_id", otherwise)).drop("b")

    out = level(rows.select("entity_id", "vector"), attractors, F.lit("generic"))
    for parent, children in sorted((depth_of or {}).items()):
        here = level(out.where(F.col("kern_id") == parent).select("entity_id", "vector"), children, F.lit(parent))
        out = out.where(F.col("kern_id") != parent).unionByName(here)
    return out.select("entity_id", "kern_id")


def similarity_edges(nearest: DataFrame) -> DataFrame:
    """W-04: edges from the nearest other entity found, ``nearest(query_id, entity_id, cosine)``."""
    return nearest.select(
        sc.reason_id(F.col("query_id"), F.col("entity_id"), F.lit(sc.Fixed.SIMILARITY), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("reason_id"),
        F.col("query_id").alias("from_id"), F.col("entity_id").alias("to_id"), F.lit(sc.Fixed.SIMILARITY).alias("kind"), F.col("cosine").alias("score"))


def supersede(versions: DataFrame, by: str = "external_id", at: str = "created_at", key: str = "entity_id") -> DataFrame:
    """W-06: versions of one external id in order of time: all but the last are superseded by the next, valid until it began.

    Columns: key, by, status, superseded_by, valid_from, valid_to, n_before. Rows without an external id stand alone. An
    external id's versions are one window partition; they are its revisions, not its rows in a stream.
    """
    w = Window.partitionBy(by).orderBy(at, key)
    chained = versions.where(F.col(by).isNotNull()).withColumn("superseded_by", F.lead(key).over(w)).withColumn("valid_to", F.lead(at).over(w)).withColumn(
        "n_before", F.row_number().over(w) - 1)
    alone = versions.where(F.col(by).isNull()).withColumn("superseded_by", F.lit(None).cast("string")).withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("n_before", F.lit(0))
    every = chained.unionByName(alone)
    return every.select(key, by, F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded").alias("status"), "superseded_by",
                        F.col(at).alias("valid_from"), "valid_to", "n_before")


def replaced(store: DataFrame, fresh: DataFrame, order: str = "job_id") -> DataFrame:
    """W-06: (old_id, new_id): what the rows of ``fresh(entity_id, external_id, ORDER)`` supersede by their external id.

    Of a batch's versions of one external id each supersedes the one before by ``order``, and the first supersedes what the
    store holds as active under it. An external id's versions in one batch are few.
    """
    new = fresh.where(F.col("external_id").isNotNull()).select("external_id", F.col("entity_id").alias("new_id"), F.col(order).alias("o"))
    w = Window.partitionBy("external_id").orderBy("o", "new_id")
    inside = new.withColumn("old_id", F.lag("new_id").over(w))
    first = inside.where("old_id is null").drop("old_id")
    old = store.where((F.col("status") == "active") & F.col("external_id").isNotNull()).select("external_id", F.col("entity_id").alias("old_id"))
    both = inside.where("old_id is not null").select("old_id", "new_id").unionByName(old.join(first, "external_id").select("old_id", "new_id"))
    return both.where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))


def stamped(entities: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """W-06: ``entities`` with the old ones of ``pairs(old_id, new_id)`` superseded as of ``now``."""
    e = entities.join(pairs.select(F.col("old_id").alias("entity_id"), "new_id"), "entity_id", "left")
    hit = F.col("new_id").isNotNull()
    at = {"status": F.lit("superseded"), "superseded_by": F.col("new_id"), "valid_to": F.coalesce("valid_to", now), "invalidated_at": F.coalesce("invalidated_at", now), "updated_at": now}
    return e.select(*[F.when(hit, at[c]).otherwise(F.col(c)).alias(c) if c in at else F.col(c) for c in entities.columns])


def edges_of(pairs: DataFrame) -> DataFrame:
    """W-06: an edge from each new entity to the one it supersedes, score 1."""
    kind = F.lit(sc.Fixed.SUPERSEDES)
    none = F.lit(None).cast("string")
    return pairs.select(sc.reason_id(F.col("new_id"), F.col("old_id"), kind, none, none).alias("reason_id"), F.col("new_id").alias("from_id"),
                        F.col("old_id").alias("to_id"), kind.alias("kind"), F.lit(1.0).alias("score"))


def repointed(reasons: DataFrame, pairs: DataFrame) -> DataFrame:
    """W-06: rephrases still pending on a superseded entity move to the one that superseded it."""
    r = reasons.join(pairs.select(F.col("old_id").alias("from_id"), "new_id"), "from_id", "left")
    hit = F.col("new_id").isNotNull() & (F.col("kind") == sc.Fixed.REPHRASE_KIND) & (F.coalesce("to_id", F.lit("")) == "")
    moved = F.when(hit, F.col("new_id")).otherwise(F.col("from_id"))
    new_id = F.when(hit, sc.reason_id(F.col("new_id"), F.lit(""), F.col("kind"), F.col("text"), F.lit(""))).otherwise(F.col("reason_id"))
    return r.withColumn("moved", moved).withColumn("renamed", new_id).select(
        *[F.col({"from_id": "moved", "reason_id": "renamed"}.get(c, c)).alias(c) for c in reasons.columns])


def contradicted(entities: DataFrame, reasons: DataFrame, verdicts: DataFrame, embedded: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """W-08: (entities, reasons) after ``verdicts(reason_id)`` said that these pending rephrases contradict their entity.

    The rephrase's text becomes an entity of the old one's kind and partition, with its vector from ``embedded(text, vector)``;
    it supersedes the old one, and the rephrase goes. A text that is an entity already is superseded to, not inserted again.
    """
    r = reasons.join(verdicts.select("reason_id").distinct(), "reason_id", "left_semi").where(
        (F.col("kind") == sc.Fixed.REPHRASE_KIND) & F.col("text").isNotNull()).select("reason_id", F.col("from_id").alias("old_id"), "text")
    # of several rephrases of one entity the least by id replaces it
    r = r.groupBy("old_id").agg(F.min(F.struct("reason_id", "text")).alias("r")).select("old_id", "r.*").withColumn("new_id", sc.content_hash(F.col("text"))).where("old_id <> new_id")
    old = entities.join(r.select(F.col("old_id").alias("entity_id"), "new_id", F.col("text").alias("said")), "entity_id").where("status = 'active'")
    new = old.join(embedded.select(F.col("text").alias("said"), F.col("vector").alias("v")).dropDuplicates(["said"]), "said", "left")
    made = {"entity_id": F.col("new_id"), "text": F.col("said"), "vector": F.col("v"), "gnn_vector": F.lit(None).cast("array<float>"), "status": F.lit("active"), "superseded_by": F.lit(None).cast("string"),
            "created_at": now, "updated_at": now, "accessed_at": F.lit(None).cast("timestamp"), "heat": F.lit(0.0).cast("float"), "valid_from": now,
            "valid_to": F.lit(None).cast("timestamp"), "invalidated_at": F.lit(None).cast("timestamp")}
    fresh = new.select(*[made.get(c, F.col(c)).alias(c) for c in entities.columns]).dropDuplicates(["entity_id"]).join(entities.select("entity_id"), "entity_id", "left_anti")
    pairs = old.select(F.col("entity_id").alias("old_id"), "new_id")
    e = stamped(entities, pairs, now).unionByName(fresh.select(entities.columns))
    edges = edges_of(pairs).join(old.select(F.col("entity_id").alias("to_id"), "kern_id"), "to_id")
    left = reasons.join(r.join(pairs.select("old_id"), "old_id", "left_semi").select("reason_id"), "reason_id", "left_anti")
    return e, left.unionByName(edges, allowMissingColumns=True)


def supersedes_edges(chained: DataFrame, key: str = "entity_id") -> DataFrame:
    """W-06: an edge from each new version to the one it supersedes, score 1."""
    return chained.where("superseded_by is not null").select(F.col("superseded_by").alias("from_id"), F.col(key).alias("to_id"), F.lit(sc.Fixed.SUPERSEDES).alias("kind"), F.lit(1.0).alias("score"))


def supersede_on_rename(records: DataFrame) -> DataFrame:
    """W-07: (record_id, source_uri, replaced_id, pure_rename): records whose ``replaces`` names an earlier record's uri.

    The latest record of that uri modified before is replaced; equal content is a pure rename, which only moves the uri.
    """
    r = records.select("record_id", "source_uri", "replaces", "modified_at", sc.content_hash(F.col("content")).alias("h")).distinct()
    old = r.select(F.col("source_uri").alias("replaces"), F.struct("modified_at", "record_id", "h").alias("o"))
    met = r.where("replaces is not null").join(old, "replaces").where(
        (F.col("o.record_id") != F.col("record_id")) & (F.col("o.modified_at") < F.col("modified_at")))
    best = met.groupBy("record_id", "source_uri", "h").agg(F.max("o").alias("o"))
    return best.select("record_id", "source_uri", F.col("o.record_id").alias("replaced_id"), (F.coalesce("h", F.lit("")) == F.coalesce("o.h", F.lit(""))).alias("pure_rename"))


def contradictions(pairs: DataFrame, verdict: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """W-08: pairs (old_id, old_text, new_id, new_text) whose verdict says that the new statement replaces the old.

    ``verdict`` is the injected judge, called on batches.
    """
    judge = F.pandas_udf(verdict, "string")
    return pairs.withColumn("reply", judge("old_text", "new_text")).where(tx.parse_contradiction(F.col("reply")))


def turn_batches(transcripts: DataFrame, size: int = TURN_BATCH) -> DataFrame:
    """W-09: (doc_id, batch, prompt, n_turns): transcripts in batches of turns, marked by 1-based numbers."""
    t = transcripts.select("doc_id", tx.turns(F.col("text")).alias("t")).where(F.size("t") > 0)
    b = t.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / size).cast("int"))).alias("batch"))
    part = F.slice("t", F.col("batch") * size + 1, size)
    marked = F.transform(part, lambda x, i: F.concat(F.lit("["), (i + 1 + F.col("batch") * size).cast("string"), F.lit("] "), x))
    return b.select("doc_id", "batch", F.array_join(marked, "\n").alias("prompt"), F.size(part).alias("n_turns"))


def distil(transcripts: DataFrame, model: Callable[[str], str], size: int = TURN_BATCH) -> tuple[DataFrame, DataFrame]:
    """W-09: (claims, doc_ids to retry): claims a model found in each batch; a document with any reply without an array is
    retried whole. Confidence of a claim is 0.6; its section lists the turns it cites."""
    reply = F.pandas_udf(lambda p: p.map(model), "string")
    parsed = turn_batches(transcripts, size).withColumn("claims", tx.parse_claims(reply("prompt")))
    retry = parsed.where("claims is null").select("doc_id").distinct()
    good = parsed.join(retry, "doc_id", "left_anti").select("doc_id", "batch", F.explode("claims").alias("c"))
    return good.select(
        "doc_id", sc.content_hash(F.col("c.text")).alias("entity_id"), F.col("c.text").alias("text"), F.lit("claim").alias("kind"),
        F.concat(F.lit("session://"), F.col("c.kind")).alias("title"), F.array_join(F.col("c.turns").cast("array<string>"), ",").alias("section"),
        F.lit(1 + sc.Fixed.CLAIM_CONF).alias("conf_alpha"), F.lit(2 - sc.Fixed.CLAIM_CONF).alias("conf_beta"), tx.parse_time(F.col("c.valid_from")).alias("valid_from"),
    ), retry


def link(pairs: DataFrame, user: Column) -> DataFrame:
    """W-11: asserted edges (from_id, to_id, text): score 1 by the user, 0.95 by an agent."""
    return pairs.select(sc.reason_id(F.col("from_id"), F.col("to_id"), F.lit(sc.Fixed.SIMILARITY), F.col("text"), F.lit("")).alias("reason_id"), "from_id", "to_id",
                        F.lit(sc.Fixed.SIMILARITY).alias("kind"), "text", F.when(user, sc.Fixed.LINK_USER).otherwise(sc.Fixed.LINK_AGENT).alias("score"))


def forget(entities: DataFrame, reasons: DataFrame, chosen: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W-12: (remaining entities, remaining edges, kept): removes ``chosen(entity_id)`` and every incident edge.

    Local active facts are kept unless ``force``; ``kept`` lists them.
    """
    want = entities.join(chosen.select("entity_id").distinct(), "entity_id", "left_semi")
    immune = ~sc.is_remote(F.col("kern_id")) & (F.col("status") == "active") & (F.col("kind") == "fact")
    kept = want.where(immune).select("entity_id") if not force else want.where(F.lit(False)).select("entity_id")
    gone = (want if force else want.where(~immune)).select("entity_id")
    edges = reasons.join(gone.withColumnRenamed("entity_id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("entity_id", "to_id"), "to_id", "left_anti")
    return entities.join(gone, "entity_id", "left_anti"), edges, kept


def degrade(reasons: DataFrame, chosen: DataFrame) -> DataFrame:
    """W-13: (entity_id, reason_id, score, removed): incident edges of each chosen entity, in order of id, lose 0.15 x 0.75^i; below 0.05 they go.

    An edge of two chosen entities loses for each; the window is over one entity's incident edges.
    """
    flat = reasons.select("reason_id", "score", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("entity_id"))
    hit = flat.join(chosen.select("entity_id").distinct(), "entity_id", "left_semi")
    i = F.row_number().over(Window.partitionBy("entity_id").orderBy("reason_id")) - 1
    loss = hit.withColumn("loss", F.lit(sc.Fixed.DEGRADE_STEP) * F.pow(F.lit(sc.Fixed.DEGRADE_RATIO), i)).groupBy("reason_id").agg(
        F.sum("loss").alias("loss"), F.first("score").alias("score"))
    new = F.col("score") - F.col("loss")
    return loss.select("reason_id", F.greatest(new, F.lit(0.0)).alias("score"), (new < sc.Fixed.DEGRADE_DROP).alias("removed"))


def move(entities: DataFrame, reasons: DataFrame, moves: DataFrame, kerns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W-14: (entities, edges) after ``moves(entity_id, kern_id)`` into existing partitions.

    An entity takes its outgoing edges along; incoming ones stay and are stamped with where it went. Unknown partitions
    are refused row by row.
    """
    ok = moves.join(kerns.select("kern_id").distinct(), "kern_id", "left_semi").dropDuplicates(["entity_id"]).select("entity_id", F.col("kern_id").alias("new_part"))
    e = entities.join(ok, "entity_id", "left").withColumn("kern_id", F.coalesce("new_part", "kern_id")).drop("new_part")
    src, dst = ok.select(F.col("entity_id").alias("from_id"), F.col("new_part").alias("src_part")), ok.select(F.col("entity_id").alias("to_id"), F.col("new_part").alias("dst_part"))
    r = reasons.join(src, "from_id", "left").join(dst, "to_id", "left")
    r = r.withColumn("kern_id", F.coalesce("src_part", "kern_id")).withColumn("to_kern_id", F.coalesce("dst_part", "to_kern_id")).drop("src_part", "dst_part")
    return e, r


def promote(entities: DataFrame, chosen: DataFrame) -> DataFrame:
    """W-15: chosen pending entities become active; others stay; again is the same."""
    c = chosen.select("entity_id").distinct().withColumn("_hit", F.lit(True))
    return entities.join(c, "entity_id", "left").withColumn("review", F.when(F.coalesce("_hit", F.lit(False)) & (F.col("review") == "pending"), "active").otherwise(F.col("review"))).drop("_hit")


def add_graviton(kerns: DataFrame, name: str, pooled: list[float], kern_id: str, inner: float = 0.35, outer: float = 0.75, mass: float = 1.0) -> DataFrame:
    """W-16: an attractor under the root; one of the same name is updated in place."""
    row = kerns.sparkSession.createDataFrame([(kern_id, "root", name, [float(x) for x in pooled], inner, outer, mass)],
                                             "kern_id string, parent_id string, graviton_text string, graviton_vec array<float>, inner_radius double, outer_radius double, mass double")
    same = kerns.where((F.col("parent_id") == "root") & (F.col("graviton_text") == name))
    if same.isEmpty():
        return kerns.unionByName(row, allowMissingColumns=True)
    hit = (F.col("parent_id") == "root") & (F.col("graviton_text") == name)
    new_vec = F.array(*[F.lit(float(x)).cast("float") for x in pooled])
    return kerns.withColumn("graviton_vec", F.when(hit, new_vec).otherwise(F.col("graviton_vec")))


def remove_graviton(kerns: DataFrame, name: str) -> DataFrame:
    """W-16: the named attractor becomes an unnamed child of generic."""
    hit = (F.col("parent_id") == "root") & (F.col("graviton_text") == name)
    return kerns.withColumn("parent_id", F.when(hit, "generic").otherwise(F.col("parent_id"))).withColumn("graviton_text", F.when(hit, "").otherwise(F.col("graviton_text")))


def list_gravitons(kerns: DataFrame, entities: DataFrame) -> DataFrame:
    """W-16: attractors with the number of entities they hold."""
    named = kerns.where((F.col("parent_id") == "root") & ~F.coalesce("graviton_text", F.lit("")).isin("", "generic")).select("kern_id", "graviton_text", "mass").distinct()
    n = entities.groupBy("kern_id").agg(F.count("*").alias("n_entities"))
    return named.join(n, "kern_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))


def add_claim_kind(registry: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """W-17: the registry (child, parent) with a kind below its parents; unknown parents, itself and cycles are refused."""
    below = filters.closure(registry.sparkSession, registry).where(F.col("start") == child)
    for p in parents:
        if p != "fact" and registry.where((F.col("child") == p) | (F.col("parent") == p)).isEmpty():
            raise ValueError(f"unknown parent {p!r}")
        if p == child or not below.where(F.col("reached") == p).isEmpty():
            raise ValueError(f"{child!r} can't be below {p!r}")
    return registry.unionByName(registry.sparkSession.createDataFrame([(child, p) for p in parents], "child string, parent string")).distinct()


def remove_claim_kind(registry: DataFrame, kind: str) -> DataFrame:
    """W-17: without the kind; its children move to the top level."""
    return registry.where((F.col("child") != kind) & (F.col("parent") != kind))


def set_deadline(entities: DataFrame, wanted: DataFrame, producer: str) -> DataFrame:
    """W-18: entities with tightened deadlines ``wanted(entity_id, ttl)``; (entity_id, valid_until, lamport, producer, changed)."""
    w = wanted.groupBy("entity_id").agg(F.min("ttl").alias("ttl"))
    e = entities.join(w, "entity_id")
    new = sc.resolve_valid_until(F.col("valid_until"), F.col("ttl"))
    changed = ~new.eqNullSafe(F.col("valid_until"))
    return e.select("entity_id", new.alias("valid_until"), (F.coalesce("valid_until_lamport", F.lit(0)) + changed.cast("long")).alias("lamport"),
                    F.when(changed, F.lit(producer)).otherwise(F.col("valid_until_producer")).alias("producer"), changed.alias("changed"))


def reembed(entities: DataFrame, reasons: DataFrame, embedder: Callable[[list[str]], Iterator[list[float]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """W-19, M-12: entities with fresh vectors and without structure vectors; edges with the midpoint of their ends."""
    e = embedding.embedded(entities.drop("vector"), "text", embedder).withColumn("gnn_vector", F.lit(None).cast("array<float>"))
    return e, search.reason_vectors(reasons, e)


def edit_text(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """X-08: new texts ``edits(entity_id, text)``; edited rows are marked dirty, to be embedded later."""
    n = edits.dropDuplicates(["entity_id"]).select("entity_id", F.col("text").alias("new_text"))
    e = entities.join(n, "entity_id", "left")
    return e.withColumn("dirty", F.col("new_text").isNotNull()).withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
