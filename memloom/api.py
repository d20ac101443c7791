"""One engine over a store: a method for each tool (query, ingest, events, link, forget, degrade, move, promote, graviton,
claim kinds, pulse, gc, health, ...). Methods build plans; writing ones commit a new version of the tables they change."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from memloom import config as configuration
from memloom.functions import scalars as sc
from memloom.functions import vec
from memloom.operators import crdt, filters, index, maintenance, ranking, retrieval, search, stats, walks, writes
from memloom.session import scratch, small, written
from memloom.sources import embedding, intake
from memloom.sources.store import StaleEpoch, Store, whole
from memloom.streaming import feed
from memloom.streaming.tasks import TaskQueue


#: Buckets of entities and edges by their id: a change of few ids writes few of them. Least seconds between accesses that count.
BUCKETS, COOLDOWN_S = 64, 60


class Profile:
    """A-10, X-03: seconds by phase."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        yield
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def atomic(method):
    """A writing method reads one epoch and commits only if it still stands; else it starts anew on what stands then (K-02, K-03)."""
    @wraps(method)
    def run(self, *args, **kwargs):
        if self._at is not None:
            return method(self, *args, **kwargs)
        for _ in range(5):
            self._at = self.store.snapshot()
            try:
                with scratch(self.spark):  # all is committed when the method returns
                    return method(self, *args, **kwargs)
            except StaleEpoch:
                continue
            finally:
                self._at = None
        raise StaleEpoch("gave up after 5 tries")
    return run


class MemoryEngine:
    """The engine's tools over the tables entities, reasons, kerns and cold_entities of a store."""

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[list[str]], list] | None = None, settings: dict | None = None):
        self.spark, self.store, self.embedder = spark, Store(spark, root), embedder or embedding.hashed
        self.config = configuration.check(configuration.merge(configuration.DEFAULTS, settings or {}))
        self.profile, self.tasks = Profile(), TaskQueue()
        self._at = None  # the snapshot that the running write reads
        self._ticked = -1  # the epoch after the last round of upkeep

    # -- tables
    @property
    def _tables(self):
        return self._at or self.store.snapshot()

    def _commit(self, tables: dict[str, DataFrame], **how) -> int:
        """Commit on top of the snapshot that was read; what follows in the same method reads the new one."""
        done = self.store.commit(tables, self._at.epoch if self._at else None, **how)
        if self._at is not None:
            self._at = self.store.snapshot()
        return done

    @property
    def entities(self) -> DataFrame:
        return whole(self._tables.read("entities"))

    @property
    def reasons(self) -> DataFrame:
        return self._tables.read("reasons")

    @property
    def kerns(self) -> DataFrame:
        return self._tables.read("kerns")

    def accesses(self) -> DataFrame:
        """Accesses by entity: counter slots, and what the log holds since they were folded."""
        at = self._tables
        every = self.spark.createDataFrame([], "entity_id string, access_count long")
        if at.exists("access_slots"):
            every = every.unionByName(crdt.counter_values(at.read("access_slots")).select(F.col("object_id").alias("entity_id"), F.col("total").alias("access_count")))
        if at.exists("access_log"):
            every = every.unionByName(at.read("access_log").groupBy("entity_id").agg(F.count("*").alias("access_count")))
        return every.groupBy("entity_id").agg(F.sum("access_count").alias("access_count"))

    def load(self, entities: DataFrame, reasons: DataFrame, kerns: DataFrame) -> int:
        """Start a store from tables; copies of one id are joined."""
        return self.store.commit({"entities": crdt.entity_join(entities), "reasons": crdt.reason_join(reasons), "kerns": kerns.dropDuplicates(["kern_id"])},
                                 layout={"entities": ("entity_id", BUCKETS), "reasons": ("reason_id", BUCKETS)})

    @staticmethod
    def _now(now: datetime | str | None):
        return sc.lit_ts(str(now) if now is not None else datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))

    def _attractors(self) -> list[Row]:
        named = self.kerns.where((F.col("parent_id") == "root") & ~F.coalesce("graviton_text", F.lit("")).isin("", "generic") & vec.usable(F.col("graviton_vec")))
        rows = named.orderBy("kern_id").limit(4097).collect()
        if len(rows) > 4096:
            raise ValueError("too many attractors")
        return rows

    def _upsert(self, name: str, rows: DataFrame, key: str, delete: DataFrame | None = None) -> int:
        """K-06: replace few rows by their key: of a table laid out by it only the buckets concerned are written."""
        done = self.store.upsert(name, written(rows, "upsert"), key, delete, self._at.epoch if self._at else None)
        if self._at is not None:
            self._at = self.store.snapshot()
        return done

    def _replace(self, name: str, df: DataFrame) -> int:
        return self._commit({name: df})

    # -- reading
    def query(self, text: str, k: int = 10, mode: str | None = None, options: filters.QueryOptions | None = None, now: datetime | str | None = None,
              history: bool = False, touch: bool = True) -> DataFrame:
        """Recall for one text: the pipeline with the text as its only query; where it finds fewer than k, cold entities follow
        (R-19), and with ``history`` what the hits supersede (R-20), each under the same filters and flagged. What is delivered
        counts as accessed, an entity once in COOLDOWN_S seconds (R-22)."""
        options = options or filters.QueryOptions()
        options.check()
        r = self.config["retrieval"]
        with self.profile.phase("embed"):
            vector = self.embedder([text])[0]
        s = retrieval.Settings(seed_k=r["seed_k"], max_expansions=r["max_expansions"], deliver=r["deliver"], floor=r["floor"],
                               mode=mode or r["mode"], pagerank_rounds=r["pagerank_rounds"], lexical_weight=r["lexical_weight"])
        asked = [Row(kern_id="query", graviton_vec=vector, graviton_text=text, inner_radius=0.0, outer_radius=1.0, mass=0.0)]
        known = self.entities
        cold = self.store.cold() if self.store.exists("cold_entities") else None
        with self.profile.phase("retrieve"):
            found, self.last_chains = retrieval.recall(known, self.reasons, self.accesses(), asked, self._now(now), s, options, r["source_trust"])
            hits = written(found.where(F.col("rank") <= k).select("query_id", "rank", "entity_id", "score"), "hits")
            every = hits.select("query_id", "entity_id", "score", "rank", F.lit(False).alias("cold"), F.lit(False).alias("history"))
            n = hits.count()
            keep = filters.predicate(options)
            if cold is not None and n < k:
                near = search.vector_topk(cold.where(keep).select("entity_id", "vector"), [("query", vector)], k).select("query_id", "entity_id", F.col("cosine").alias("score"))
                fill = ranking.cold_fill(hits, near, k).where("cold")
                place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id"))
                every = every.unionByName(fill.select("query_id", "entity_id", "score", (place + n).alias("rank"), F.lit(True).alias("cold"), F.lit(False).alias("history")))
            pool = known if cold is None else known.unionByName(cold.select([c for c in cold.columns if c in known.columns]).join(known.select("entity_id"), "entity_id", "left_anti"), allowMissingColumns=True)
            if history:
                every = written(every, "hits")
                links = self.reasons.where(F.col("kind") == sc.Fixed.SUPERSEDES).select(F.col("from_id").alias("newer"), F.col("to_id").alias("older"))
                old = walks.ancestors(every.select(F.col("entity_id").alias("head")), links).join(every.select(F.col("entity_id").alias("head"), "score", F.col("rank").alias("at")), "head")
                old = old.join(every.select("entity_id"), "entity_id", "left_anti").groupBy("entity_id").agg(F.min(F.struct("at", "depth", "score")).alias("h"))
                old = old.join(pool.where(keep).select("entity_id"), "entity_id", "left_semi")
                place = F.row_number().over(Window.orderBy("h.at", "h.depth", "entity_id"))  # the ancestors of k hits
                every = every.unionByName(old.select(F.lit("query").alias("query_id"), "entity_id", F.col("h.score").alias("score"), (place + k).alias("rank"), F.lit(False).alias("cold"), F.lit(True).alias("history")))
        if touch:
            self.touch(hits.select("entity_id"), now)
        return ranking.envelope(every, pool, self.reasons)

    def chains(self, most: int = 5) -> DataFrame:
        """R-18: the first chains of the last query as text."""
        return ranking.rendered_chains(self.last_chains, self.entities, self.reasons, most)

    @atomic
    def touch(self, ids: DataFrame, now: datetime | str | None = None, producer: str = "local") -> int:
        """R-22: log an access of each of ``ids(entity_id)`` that had none in the last COOLDOWN_S seconds; how many count.

        The log is appended to; :meth:`fold_accesses` moves it into counters and heat.
        """
        at = self._now(now)
        last = self.entities.select("entity_id", "accessed_at")
        if self._tables.exists("access_log"):
            last = last.unionByName(self._tables.read("access_log").select("entity_id", F.col("ts").alias("accessed_at")))
        last = last.join(ids.distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.max("accessed_at").alias("last"))
        due = F.col("last").isNull() | (F.unix_micros(at) - F.unix_micros("last") >= COOLDOWN_S * 1_000_000)
        new = written(last.where(due).select("entity_id", at.alias("ts"), F.lit(producer).alias("producer")), "touched")
        n = new.count()
        if n:
            self._commit({"access_log": new}, append=True)
        return n

    @atomic
    def fold_accesses(self) -> int:
        """R-22: what the access log holds becomes counter slots and heat; how many accesses."""
        if not self._tables.exists("access_log"):
            return 0
        log = written(self._tables.read("access_log"), "log")
        n = log.count()
        if n:
            newest = log.agg(F.max("ts")).first()[0]
            counts = log.groupBy("entity_id").agg(F.count("*").alias("n"))
            tables = self._accessed(counts, self._now(newest.strftime("%Y-%m-%d %H:%M:%S")), "local")
            self._commit(tables | {"access_log": log.limit(0)})
        return n

    def search(self, text: str, k: int = 5) -> DataFrame:
        """V-16: blended vector search only."""
        return search.blended(self.entities, [("query", self.embedder([text])[0])], k)

    def get(self, ids: list[str], now: datetime | str | None = None) -> DataFrame:
        """R-23."""
        return ranking.lookup(self.spark.createDataFrame([(i,) for i in ids], "asked string"), self.entities, self._now(now))

    def resolve(self, ids: list[str]) -> DataFrame:
        """P-19."""
        cold = self.store.cold() if self.store.exists("cold_entities") else None
        return filters.resolve_ids(self.spark.createDataFrame([(i,) for i in ids], "asked string"), self.entities, cold=cold)

    def history(self, ids: list[str]) -> DataFrame:
        """R-20."""
        links = self.reasons.where(F.col("kind") == sc.Fixed.SUPERSEDES).select(F.col("from_id").alias("newer"), F.col("to_id").alias("older"))
        return walks.ancestors(self.spark.createDataFrame([(i,) for i in ids], "head string"), links)

    def events(self, cursor: str | None = None, limit: int = feed.DEFAULT_LIMIT) -> tuple[list, str | None]:
        """S-09."""
        return feed.poll(self.entities, feed.Cursor.decode(cursor) if cursor else None, limit)

    def health(self) -> DataFrame:
        """A-07."""
        dim = filters.dominant_dim(self.entities).select("dim")
        base = stats.counts(self.kerns, self.entities, self.reasons)
        sizes = stats.gini(self.entities.groupBy("kern_id").agg(F.count("*").alias("n")), "n").withColumnRenamed("gini", "gini_partitions")
        e, at, r = self.entities, self._tables, self.config["retrieval"]
        more = e.agg(  # all rows of one kind of figure in one pass
            F.sum((F.col("status") == "superseded").cast("long")).alias("n_superseded"), F.sum((F.col("review") == "pending").cast("long")).alias("n_pending"),
            F.sum((~F.coalesce(vec.usable(F.col("vector")), F.lit(False))).cast("long")).alias("n_without_vector"), F.sum(F.col("gnn_vector").isNotNull().cast("long")).alias("n_structured"),
            F.sum(F.col("valid_until").isNotNull().cast("long")).alias("n_with_deadline"), F.sum(F.col("external_id").isNotNull().cast("long")).alias("n_versioned"),
            F.sum(sc.is_remote(F.col("kern_id")).cast("long")).alias("n_remote"), F.max("updated_at").alias("last_update"), F.sum("heat").alias("heat"),
            *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in sc.Fixed.ENTITY_KINDS])
        edges = self.reasons.agg(F.sum((F.coalesce("to_id", F.lit("")) == "").cast("long")).alias("n_open_edges"),
                                 *[F.sum((F.col("kind") == i).cast("long")).alias(f"n_{k}_edges") for i, k in enumerate(("similarity", "provenance", "question_of", "spawn", "supersedes", "ratification", "rephrase"))])
        out = base.join(F.broadcast(dim), F.lit(True), "left").join(F.broadcast(sizes), F.lit(True), "left")
        out = out.join(F.broadcast(more), F.lit(True), "left").join(F.broadcast(edges), F.lit(True), "left")  # rows of one
        echo = {"epoch": at.epoch, "n_cold_parts": self.store.parts("cold_entities"), "n_log_parts": self.store.parts("access_log"), "indexed": at.exists("index_lists"),
                "embed_stamp": json.dumps(at.meta.get("embed")), "failed_tasks": self.tasks.counts["failed"], "refused_tasks": self.tasks.counts["refused"],
                **{f"cfg_{k}": r[k] for k in ("seed_k", "max_expansions", "deliver", "floor", "mode", "lexical_weight")}, "cfg_dedup_threshold": self.config["ingest"]["dedup_threshold"]}
        return out.select("*", *[F.lit(v).alias(k) for k, v in echo.items()])

    def list_partitions(self) -> DataFrame:
        """A-06."""
        return walks.tree(self.spark, self.kerns).join(stats.partition_summary(self.entities), "kern_id", "left")

    def thought(self, entity_id: str) -> DataFrame:
        """An entity with the number and kinds of its edges."""
        row = self.entities.where(F.col("entity_id") == entity_id).select(F.lit("id").alias("query_id"), "entity_id")
        return ranking.envelope(row.withColumn("score", F.lit(0.0)), self.entities, self.reasons)

    def reason(self, reason_id: str) -> DataFrame:
        return self.reasons.where(F.col("reason_id") == reason_id)

    def resource(self, uri: str) -> DataFrame:
        """What a resource address names: ``local/health``, ``local/thoughts``, ``local/partitions``, ``local/claim-kinds``, ``thought/ID``, ``reason/ID``."""
        kind, _, rest = uri.partition("/")
        if kind in ("thought", "reason") and rest:
            return self.thought(rest) if kind == "thought" else self.reason(rest)
        found = {"health": self.health, "thoughts": self.top, "partitions": self.list_partitions, "claim-kinds": lambda: self.store.read("claim_kinds")}
        if kind != "local" or rest not in found:
            raise ValueError(f"unknown resource {uri!r}")
        return found[rest]()

    def unnamed(self) -> DataFrame:
        """Partitions without a name, with what they hold."""
        n = self.entities.groupBy("kern_id").agg(F.count("*").alias("n_entities"))
        return self.kerns.where((F.col("kern_id") != "root") & (F.coalesce("graviton_text", F.lit("")) == "")).select("kern_id", "parent_id").join(n, "kern_id", "left")

    def top(self, n: int = 50) -> DataFrame:
        """A-05."""
        return stats.top_thoughts(self.entities, n)

    # -- writing
    @atomic
    def ingest(self, jobs: DataFrame, now: datetime | str | None = None) -> dict[str, int]:
        """W-01 to W-07: chunk, embed, merge duplicates, route, link, supersede; one commit. Returns how many rows of each outcome.

        ``jobs`` may have a ``source`` (scheme, object_id, section): then an entity's external id is the source's, with the chunk's
        place for chunks, and a new version supersedes the active one; ``source.scheme`` also chooses the review state and
        the trust. With ``replaces``, a former object_id, the entities of that object are superseded by the document that
        replaces it, or, if the content is the same, take its external id.
        """
        at, policy = self._now(now), self.config["ingest"]
        sourced, renames = "source" in jobs.columns, "replaces" in jobs.columns and "source" in jobs.columns
        rows = writes.chunked(jobs)
        fields = ["confidence", "source_tag", "valid_from", "valid_until", "user_id", "agent_id", "session_id", *(["source"] if sourced else []), *(["replaces"] if renames else [])]
        meta = jobs.groupBy("job_id").agg(F.max_by(F.struct(*fields), "received_at").alias("m"))
        c = sc.clamp_confidence(F.col("m.confidence"), F.col("m.source_tag"))
        none = lambda t: F.lit(None).cast(t)
        scheme = F.col("m.source.scheme") if sourced else F.col("m.source_tag")
        own = sc.source_id(F.col("m.source")) if sourced else none("string")
        external = F.when(F.col("index") < 0, own).otherwise(sc.chunk_source_id(own, F.col("index")))
        kept_for = F.lit(None).cast("long")
        for name, seconds in sorted(policy["retention_secs"].items()):
            kept_for = F.when(F.col("kind") == name, F.lit(int(seconds))).otherwise(kept_for)
        # one row per content: the first job that brings it
        first = rows.join(meta, "job_id").groupBy("entity_id").agg(F.min_by(F.struct(*[x for x in rows.columns if x != "entity_id"], "m"), F.struct("job_id", "index")).alias("r")).select("entity_id", "r.*")
        new = embedding.embedded(first, "text", self.embedder).select(
            "entity_id", "job_id", "index", external.alias("external_id"), "kind", sc.review_for(policy["review"], scheme).alias("review"), "text", "vector", none("array<float>").alias("gnn_vector"),
            (1 + c["confidence"]).cast("float").alias("conf_alpha"), (2 - c["confidence"]).cast("float").alias("conf_beta"), ((1 + c["confidence"]) / 3).alias("score"),
            "m.valid_from", none("timestamp").alias("valid_to"), none("timestamp").alias("invalidated_at"), F.lit("local").alias("producer_id"),
            "m.user_id", "m.agent_id", "m.session_id", F.lit("active").alias("status"), none("string").alias("superseded_by"), at.alias("created_at"), at.alias("updated_at"),
            none("timestamp").alias("accessed_at"), F.lit(0.0).cast("float").alias("heat"),
            sc.resolve_valid_until(F.col("m.valid_until"), sc.valid_until_from_retention(at, kept_for)).alias("valid_until"), F.lit(0).cast("long").alias("valid_until_lamport"),
            none("string").alias("valid_until_producer"), (sc.source_id(F.col("m.source").withField("object_id", F.col("m.replaces"))) if renames else none("string")).alias("replaces"))
        new = written(new, "incoming")
        dim = new.where(F.size("vector") > 0).select(F.size("vector")).limit(1).collect()
        if not dim:
            return {"inserted": 0, "merged": 0}
        extra = ["job_id", "index", "replaces"]
        entities = self.entities
        store = entities.where("status <> 'superseded'")
        same = new.select("entity_id").join(store.select("entity_id"), "entity_id", "left_semi").select(F.col("entity_id").alias("query_id"), "entity_id")
        least = sc.dedup_threshold_for(F.col("kind"), policy["dedup_by_kind"], policy["dedup_threshold"])
        bar = min([policy["dedup_threshold"], *policy["dedup_by_kind"].values()])
        asking = new.where((F.size("vector") == dim[0][0]) & vec.usable(F.col("vector"))).select(F.col("entity_id").alias("query_id"), "vector")
        usable = written(index.usable_rows(entities, dim[0][0]), "usable")
        centroids = index.fit(usable)
        lists = written(index.postings(usable, centroids), "lists") if len(centroids) else usable
        gates = index.nearest_other(asking, lists, centroids, 1, bar).select("query_id", "entity_id", "cosine").unionByName(
            index.blended_other(asking, store, dim[0][0], 1, bar).select("query_id", "entity_id", "cosine"))  # V-14, V-15
        near = gates.join(new.select(F.col("entity_id").alias("query_id"), least.alias("least")), "query_id").where("cosine >= least")
        matched = same.withColumn("cosine", F.lit(2.0)).unionByName(near.select("query_id", "entity_id", "cosine"))
        # a new version of a source isn't a copy of the old one, however alike they are
        versions = new.select(F.col("entity_id").alias("query_id"), F.col("external_id").alias("x")).where("x is not null").join(
            store.select("entity_id", F.col("external_id").alias("x")), "x").select("query_id", "entity_id").where("query_id <> entity_id")
        matched = matched.join(versions, ["query_id", "entity_id"], "left_anti")
        matches = written(matched.groupBy("query_id").agg(F.max(F.struct("cosine", "entity_id")).alias("b")).select("query_id", F.col("b.entity_id").alias("entity_id")), "matches")
        updated, fresh, rephrases = writes.merge_duplicates(store, new, matches)
        fresh = written(fresh, "fresh")
        named = self._attractors()
        routed = writes.route(fresh, named) if named else fresh.select("entity_id", F.lit("generic").alias("kern_id"))
        placed = fresh.join(routed, "entity_id", "left").withColumn("kern_id", F.coalesce("kern_id", F.lit("generic")))
        u = updated.select("entity_id", F.col("conf_alpha").alias("a"), F.col("valid_until").alias("t"))
        kept = entities.join(u, "entity_id", "left").withColumn("conf_alpha", F.coalesce(F.col("a").cast("float"), "conf_alpha")).withColumn("valid_until", F.coalesce("t", "valid_until")).drop("a", "t")
        pairs = writes.replaced(store, fresh)
        if renames:
            moved = new.where("replaces is not null and index < 0").select("replaces", F.col("external_id").alias("to_external"), F.col("entity_id").alias("new_id"))
            old = store.where("external_id is not null").withColumn("replaces", F.regexp_replace("external_id", "#chunk\\d+$", "")).join(moved, "replaces")
            gone = old.where("entity_id <> new_id and external_id = replaces").select(F.col("entity_id").alias("old_id"), "new_id")
            pairs = pairs.unionByName(gone).groupBy("old_id").agg(F.min("new_id").alias("new_id"))
            keyed = old.join(gone.select(F.col("old_id").alias("entity_id")), "entity_id", "left_anti").select(
                "entity_id", F.concat("to_external", F.regexp_extract("external_id", "(#chunk\\d+)?$", 0)).alias("x"))
            kept = kept.join(keyed.groupBy("entity_id").agg(F.min("x").alias("x")), "entity_id", "left").withColumn("external_id", F.coalesce("x", "external_id")).drop("x")
        pairs = written(pairs, "superseded")
        every = written(writes.stamped(kept.unionByName(placed.drop(*extra), allowMissingColumns=True), pairs, at), "entities")
        live = every.where("status <> 'superseded'")
        others = index.blended_other(fresh.where((F.size("vector") == dim[0][0]) & vec.usable(F.col("vector"))).select(F.col("entity_id").alias("query_id"), "vector"), live, dim[0][0], 1)
        edges = writes.similarity_edges(others).unionByName(writes.provenance_edges(rows), allowMissingColumns=True).unionByName(
            rephrases, allowMissingColumns=True).unionByName(writes.edges_of(pairs), allowMissingColumns=True)
        edges = edges.join(every.select(F.col("entity_id").alias("from_id"), "kern_id"), "from_id").dropDuplicates(["reason_id"])
        n = {"inserted": fresh.count(), "merged": matches.count()}
        if renames or sourced:
            n["superseded"] = pairs.count()
        reasons = writes.repointed(self.reasons, pairs)
        self._commit({"entities": every, "reasons": crdt.reason_join(reasons.unionByName(edges, allowMissingColumns=True))})
        return n

    @atomic
    def settle_contradictions(self, verdict: Callable, now: datetime | str | None = None) -> int:
        """W-08: put pending rephrases of active entities before the injected judge; those it calls contradictions supersede. How many."""
        e, r = self.entities, self.reasons
        pending = r.where((F.col("kind") == sc.Fixed.REPHRASE_KIND) & (F.coalesce("to_id", F.lit("")) == "") & F.col("text").isNotNull())
        pairs = pending.join(e.where("status = 'active'").select(F.col("entity_id").alias("from_id"), F.col("text").alias("old_text")), "from_id").select(
            F.col("from_id").alias("old_id"), "old_text", F.col("reason_id").alias("new_id"), F.col("text").alias("new_text"))
        said = written(writes.contradictions(pairs, verdict), "verdicts")
        n = said.count()
        if n:
            texts = embedding.embedded(said.select(F.col("new_text").alias("text")).distinct(), "text", self.embedder)
            entities, reasons = writes.contradicted(e, r, said.select(F.col("new_id").alias("reason_id")), texts, self._now(now))
            self._commit({"entities": written(entities, "entities"), "reasons": crdt.reason_join(reasons)})
        return n

    @atomic
    def build_index(self, dim: int | None = None) -> int:
        """V-01, V-03, V-06: file every usable vector; the lists are laid out by list, so a search reads only those it probes. How many rows."""
        dim = dim or (filters.dominant_dim(self.entities).first() or [None])[0]
        rows = written(index.usable_rows(self.entities, dim), "usable") if dim else None
        if rows is None:
            return 0
        centroids = index.fit(rows)
        lists = index.postings(rows, centroids) if len(centroids) else rows.select(F.lit(0).alias("list"), "entity_id", "vector")
        self._commit({"index_lists": lists, "index_centroids": index.table(self.spark, centroids)}, layout={"index_lists": ("list", BUCKETS)})
        return rows.count()

    def near(self, text: str, k: int = 10, options: filters.QueryOptions | None = None, probe: int = index.PROBE) -> DataFrame:
        """V-04, V-05: the best k by content through the index, what came and went since it was built overlaid."""
        at = self._tables
        centroids = index.loaded(at.read("index_centroids"))
        keep = filters.predicate(options) if options and options.is_active else None
        query = [("query", self.embedder([text])[0])]
        return index.overlaid(at.read("index_lists"), centroids, self.entities, len(query[0][1]), query, k, keep, probe)

    def consolidate(self, least: int = index.CONSOLIDATE) -> bool:
        """V-06: build the index anew once so many rows came or went since."""
        at = self._tables
        if not at.exists("index_lists"):
            return self.build_index() > 0
        centroids = index.loaded(at.read("index_centroids"))
        fresh, gone = index.delta(self.entities, at.read("index_lists"), centroids.shape[1])
        if fresh.count() + gone.count() < least:
            return False
        return self.build_index() > 0

    @atomic
    def link(self, from_id: str, to_id: str, text: str | None = None, user: bool = True) -> int:
        """W-11."""
        pair = self.spark.createDataFrame([(from_id, to_id, text)], "from_id string, to_id string, text string")
        new = written(writes.link(pair, F.lit(user)), "link")
        rows = self.reasons.join(small(new.select("reason_id")), "reason_id", "left_semi").unionByName(new, allowMissingColumns=True)
        return self._upsert("reasons", crdt.reason_join(rows), "reason_id")

    @atomic
    def forget(self, ids: list[str] | None = None, source: tuple[str, str] | None = None, force: bool = False) -> dict[str, int]:
        """W-12, P-17: by ids, or by scheme and object where entities carry a source."""
        e = self.entities
        chosen = e.where(filters.forgotten_by_source(e, *source)) if source else e.where(F.col("entity_id").isin(*(ids or [])))
        left, edges, kept = writes.forget(e, self.reasons, chosen, force)
        n = {"removed": chosen.count() - kept.count(), "kept": kept.count()}
        self._commit({"entities": left, "reasons": edges})
        return n

    @atomic
    def degrade(self, ids: list[str]) -> int:
        """W-13."""
        d = writes.degrade(self.reasons, self.entities.where(F.col("entity_id").isin(*ids))).select("reason_id", F.col("score").alias("s"), "removed")
        d = written(d, "degraded")
        r = self.reasons.join(small(d), "reason_id").where("not removed").withColumn("score", F.coalesce("s", "score")).drop("s", "removed")
        return self._upsert("reasons", r, "reason_id", d.where("removed").select("reason_id"))

    @atomic
    def move(self, entity_id: str, kern_id: str) -> int:
        """W-14."""
        e, r = writes.move(self.entities, self.reasons, self.spark.createDataFrame([(entity_id, kern_id)], "entity_id string, kern_id string"), self.kerns)
        return self._commit({"entities": e, "reasons": r})

    @atomic
    def promote(self, ids: list[str]) -> int:
        """W-15."""
        chosen = written(self.entities.where(F.col("entity_id").isin(*ids)), "chosen")
        return self._upsert("entities", writes.promote(chosen, chosen), "entity_id")

    @atomic
    def graviton_add(self, name: str, examples: str) -> int:
        """W-16."""
        from memloom.functions import text as tx

        lines = self.spark.createDataFrame([(examples,)], "t string").select(F.explode(tx.seed_examples(F.col("t"))).alias("text"))
        pooled = vec.mean_pool(embedding.embedded(lines, "text", self.embedder).withColumn("g", F.lit(1)), ["g"], "vector").first()
        if pooled is None or pooled.pooled is None:
            raise ValueError("the examples have no vector")
        kern_id = self.spark.range(1).select(F.concat(F.lit("part-"), F.substring(F.sha2(F.lit(name), 256), 1, 16))).first()[0]
        return self._replace("kerns", writes.add_graviton(self.kerns, name, pooled.pooled, kern_id))

    @atomic
    def graviton_remove(self, name: str) -> int:
        """W-16."""
        return self._replace("kerns", writes.remove_graviton(self.kerns, name))

    def gravitons(self) -> DataFrame:
        """W-16."""
        return writes.list_gravitons(self.kerns, self.entities)

    @atomic
    def promote_unnamed(self, kern_id: str, name: str) -> int:
        """W-16: an unnamed partition becomes an attractor of the pooled vector of what it holds."""
        held = self.entities.where((F.col("kern_id") == kern_id) & vec.usable(F.col("vector")))
        pooled = vec.mean_pool(held, ["kern_id"], "vector").first()
        if pooled is None or pooled.pooled is None:
            raise ValueError("the partition has no vector")
        hit = F.col("kern_id") == kern_id
        new = F.array(*[F.lit(float(x)).cast("float") for x in pooled.pooled])
        k = self.kerns.withColumn("graviton_vec", F.when(hit, new).otherwise(F.col("graviton_vec")))
        return self._replace("kerns", k.withColumn("graviton_text", F.when(hit, name).otherwise(F.col("graviton_text"))).withColumn("parent_id", F.when(hit, "root").otherwise(F.col("parent_id"))))

    @atomic
    def claim_kind_add(self, kind: str, parents: list[str]) -> int:
        """W-17."""
        empty = self.spark.createDataFrame([], "child string, parent string")
        return self._replace("claim_kinds", writes.add_claim_kind(self.store.read("claim_kinds") if self.store.exists("claim_kinds") else empty, kind, parents))

    @atomic
    def claim_kind_remove(self, kind: str) -> int:
        """W-17."""
        return self._replace("claim_kinds", writes.remove_claim_kind(self.store.read("claim_kinds"), kind))

    # -- upkeep
    def pulse(self, strength: float = 1.0) -> DataFrame:
        """M-02."""
        return walks.pulse(self.spark, self.kerns, strength)

    @atomic
    def gc(self, now: datetime | str | None = None) -> int:
        """M-03: spill cold rows and drop them and their edges; how many."""
        cold, e, r = maintenance.collect_garbage(self.entities, self.reasons, self._now(now))
        n = cold.count()
        if n:
            self._commit({"cold_entities": cold.drop("heat_now"), "entities": e, "reasons": r}, append=("cold_entities",))
        return n

    @atomic
    def propagate(self, dim: int, least: int = 128) -> int:
        """M-15 to M-17."""
        return self._replace("entities", maintenance.apply_structure(self.entities, maintenance.structure_vectors(self.entities, self.reasons, dim, least)))

    @atomic
    def reembed_dirty(self) -> int:
        """M-12: embed the entities whose text has no usable vector, and those only; how many got one."""
        dim = (filters.dominant_dim(self.entities).first() or [None])[0]
        e = self.entities
        usable = vec.usable(F.col("vector")) & (F.size("vector") == dim) if dim else vec.usable(F.col("vector"))
        dirty = e.where(~F.coalesce(usable, F.lit(False)) & (F.length(F.coalesce("text", F.lit(""))) > 0) & (F.col("status") == "active"))
        done = written(embedding.embedded(dirty.drop("vector"), "text", self.embedder).select(e.columns).where(vec.usable(F.col("vector"))), "embedded")
        n = done.count()
        if n:
            self._upsert("entities", done, "entity_id")
        return n

    @atomic
    def name_partitions(self, dim: int, model: Callable[[str], str] | None = None, size: int | None = None, cohesion: float | None = None) -> int:
        """M-08: unnamed partitions with a big cohesive cluster get a name and its vector; those unlike every attractor move to the root."""
        c = maintenance.clusters(self.entities, dim)
        how = {k: v for k, v in (("size", size), ("cohesion", cohesion)) if v is not None}
        names = written(maintenance.naming(c, maintenance.centroids(c, self.entities, self.kerns), self.entities, model, **how).where("length(name) > 0"), "names")
        n = names.count()
        if n:
            held = self.entities.join(c.join(names.select("kern_id", "cluster"), ["kern_id", "cluster"]).select("entity_id"), "entity_id", "left_semi")
            pooled = vec.mean_pool(held.where(vec.usable(F.col("vector"))), ["kern_id"], "vector")
            new = names.join(pooled, "kern_id", "left").select("kern_id", "name", F.col("pooled").cast("array<float>").alias("pooled"))
            k = self.kerns.join(new, "kern_id", "left").withColumn("graviton_text", F.coalesce("name", "graviton_text")).withColumn("graviton_vec", F.coalesce("pooled", "graviton_vec"))
            k = written(k.select(self.kerns.columns), "kerns")
            up = maintenance.promotable(k, self._attractors()).select("kern_id", F.lit("root").alias("up"))
            self._replace("kerns", k.join(up, "kern_id", "left").withColumn("parent_id", F.coalesce("up", "parent_id")).drop("up"))
        return n

    @atomic
    def reembed(self) -> int:
        """W-19."""
        e, r = writes.reembed(self.entities, self.reasons, self.embedder)
        return self._commit({"entities": e, "reasons": r})

    @atomic
    def commit_access(self, counts: DataFrame, now: datetime | str | None = None, producer: str = "local") -> int:
        """R-22: counter slots and heat of accepted accesses (entity_id, n)."""
        return self._commit(self._accessed(counts, self._now(now), producer))

    def _accessed(self, counts: DataFrame, at, producer: str) -> dict[str, DataFrame]:
        done = ranking.committed_accesses(counts, self.entities, at, self.config["heat"]["half_life_secs"], producer)
        slots = done.select(F.col("entity_id").alias("object_id"), "replica", F.col("n").alias("value"))
        if self._tables.exists("access_slots"):
            old = self._tables.read("access_slots")
            mine = old.where(F.col("replica") == producer).groupBy("object_id").agg(F.max("value").alias("have"))
            slots = slots.join(mine, "object_id", "left").withColumn("value", F.col("value") + F.coalesce("have", F.lit(0))).drop("have")
            slots = crdt.merge_slots(old, slots)
        h = done.select("entity_id", F.col("heat").cast("float").alias("h"), F.col("accessed_at").alias("at"))
        e = self.entities.join(h, "entity_id", "left").withColumn("heat", F.coalesce("h", "heat")).withColumn("accessed_at", F.coalesce("at", "accessed_at")).drop("h", "at")
        return {"access_slots": slots, "entities": e}

    def absorb(self, other: "MemoryEngine") -> int:
        """C-05, X-02: entities, edges, partitions and, where there are any, cold entities and access counters of another store."""
        self.store.register(other.store, lambda a, b: crdt.absorb(whole(a), whole(b)))
        if other.store.exists("cold_entities"):
            self.store.register(other.store, lambda a, b: a.unionByName(b, allowMissingColumns=True), "cold_entities")
        if other.store.exists("access_slots"):
            self.store.register(other.store, crdt.merge_slots, "access_slots")
        self.store.register(other.store, crdt.absorb_reasons, "reasons")
        return self.store.register(other.store, crdt.absorb_partitions, "kerns")

    def compact(self) -> None:
        """K-09."""
        for name in ("entities", "reasons", "kerns"):
            self.store.compact(name)

    def compress(self) -> int:
        """K-10."""
        return self.store.compress("entities")

    @atomic
    def evict_empty(self) -> int:
        """M-13: drop partitions that are dead; how many."""
        dead = walks.dead_partitions(self.spark, self.kerns, self.entities)
        n = dead.count()
        if n:
            self._replace("kerns", self.kerns.join(dead, "kern_id", "left_anti"))
        return n

    @atomic
    def tick(self, now: datetime | str | None = None, dim: int | None = None) -> dict[str, int]:
        """M-01: one round of upkeep: accesses folded, a pulse, collection, evidence decay, embedding of what has no vector,
        spawning from clusters, naming, eviction, the index. A store that didn't change since the last round is passed over (K-05)."""
        if self._ticked == self._at.epoch:
            return {"pulsed": 0, "spilled": 0, "moved": 0, "evicted": 0}
        done = {"folded": self.fold_accesses(), "pulsed": self.pulse().count(), "spilled": self.gc(now), "embedded": self.reembed_dirty()}
        half = self.config["heat"]["evidence_half_life_secs"]
        if half > 0:
            self._replace("entities", maintenance.decay_evidence(self.entities, self._now(now), half))
        dim = dim or (filters.dominant_dim(self.entities).first() or [None])[0]
        done["moved"] = 0
        if dim:
            c = maintenance.clusters(self.entities, dim)
            moves = maintenance.spawned(c, maintenance.centroids(c, self.entities, self.kerns))
            moves = written(moves, "moves")
            done["moved"] = moves.count()
            if done["moved"]:
                shells = moves.select(F.col("new_part").alias("kern_id"), F.col("kern_id").alias("parent_id")).distinct().withColumn("graviton_text", F.lit(""))
                kerns = self.kerns.unionByName(shells.join(self.kerns.select("kern_id"), "kern_id", "left_anti"), allowMissingColumns=True)
                e, r = writes.move(self.entities, self.reasons, moves.select("entity_id", F.col("new_part").alias("kern_id")), kerns)
                self._commit({"kerns": kerns, "entities": e, "reasons": r})
            done["named"] = self.name_partitions(dim)
        done["evicted"] = self.evict_empty()
        if self._tables.exists("index_lists"):
            done["indexed"] = int(self.consolidate())
        self._ticked = self._at.epoch
        return done

    def intake_status(self, folder: str) -> dict[str, int]:
        """A-08."""
        from pathlib import Path

        return intake.folder_report(Path(folder))

    def intake_drain(self, folder: str) -> DataFrame:
        """S-04: what a folder holds, classified."""
        return intake.read_intake(self.spark, folder)
